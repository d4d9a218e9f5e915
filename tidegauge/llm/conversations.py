"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A conversation is a sequence of turns.  A node is a distinct sequence of first d turns; its
members are the conversations that start with it.  No conversation, node or group of
members is ever held in one task:

1. Turns are numbered, and sequences named, by running totals over ranges of (conversation,
   place) (``running``): a long conversation is cut like the table.  A sequence's name is
   the XOR, in two 64-bit hashes, of the hashes of its (place, role, text).
2. Nodes are a grouped count and minimum over (conversation, depth) rows.
3. Totals of subtrees come from rounds of rake and compress (``subtree_totals``).  Compress:
   in each chain of nodes with one child, pointers to the child double until all of them
   name the chain's end, with the sum on the way; the chain goes, and its end hangs on the
   chain's parent.  Rake: leaves add their sums to their parents and go.  After a compress
   every inner node has two children, so a rake takes half of the nodes: the rounds follow
   the logarithm of the nodes, whatever the depth.
4. Expansion: raked nodes know their totals; the chains follow, last round first, each by one
   join with the total of its end.

Rows: turns without conv_id belong to no conversation and are left out; a null turn number
comes first; turns with one number are ordered by role and then by a hash of the text, and
equal rows all count; null and empty roles and texts are one; an empty table has no node;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import stage

#: ids of one piece of a node's list
PIECE = 1 << 16


def running(df: DataFrame, key: str, order: Sequence[str], columns: Mapping[str, str], total: Callable[[str], Column], add: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with totals of all rows of ``key`` up to and with each row, along ``order``.

    ``columns`` maps a new column to the one (of longs) that ``total`` aggregates; ``add``
    joins two totals, and 0 adds nothing.  Rows are dealt into ranges of (key, order); each
    range's total, one row a key and range, gives the next ones their start.
    """
    by = [F.col(c) for c in (key, *order)]
    dealt = stage(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(key, "_part").agg(*[total(c).alias(f"_t_{n}") for n, c in columns.items()])
    # a key has one row here for each range that it reaches into
    starts = stage(sums.select(key, "_part", *[F.coalesce(total(f"_t_{n}").over(ahead), F.lit(0).cast("long")).alias(f"_o_{n}") for n in columns]))
    inside = Window.partitionBy(key, "_part").orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[total(c).over(inside).alias(f"_l_{n}") for n, c in columns.items()])
    joined = local.join(starts, [key, "_part"])
    return joined.select(*df.columns, *[add(F.col(f"_o_{n}"), F.col(f"_l_{n}")).alias(n) for n in columns])


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, at (place from 0), a, b (hashes of role and text), n_chars of every turn.

    Equal rows are one row with a count until they have their places, so that they cannot
    fill a range.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("later"), "turn", role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.char_length(text).cast("long").alias("n_chars"))
    order = ["later", "turn", "role", "a", "b"]
    counted = rows.groupBy("conv_id", *order).agg(F.count("*").alias("n"), F.min("n_chars").alias("n_chars"))
    placed = running(counted, "conv_id", order, {"upto": "n"}, F.sum, lambda x, y: x + y)
    return placed.select("conv_id", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("at"), "a", "b", "n_chars")


def members(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conversation and depth: conv_id, depth, node, parent, n_chars.

    ``turns`` has conv_id, at (from 0, without gaps), a, b, n_chars; ``conversations`` all
    conv_id, also of those without turns.  ``node`` and ``parent`` are structs of two longs.
    """
    hashed = turns.select(
        "conv_id", (F.col("at") + 1).alias("depth"), F.xxhash64("a", "at").alias("a"), F.xxhash64("b", "at").alias("b"), "n_chars")
    named = running(hashed, "conv_id", ["depth"], {"x": "a", "y": "b"}, F.bit_xor, lambda x, y: x.bitwiseXOR(y))
    name = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0).cast("long")
    deep = named.select(
        "conv_id", "depth", name(F.col("x"), F.col("y")).alias("node"),
        name(F.col("x").bitwiseXOR(F.col("a")), F.col("y").bitwiseXOR(F.col("b"))).alias("parent"), "n_chars")
    roots = conversations.select("conv_id", zero.alias("depth"), name(zero, zero).alias("node"), F.lit(None).cast("struct<x:bigint,y:bigint>").alias("parent"), zero.alias("n_chars"))
    return deep.unionByName(roots)


def nodes(held: DataFrame) -> DataFrame:
    """node, parent, depth, conv_id (smallest member), n_convs, n_chars of the trie of ``members``."""
    return held.groupBy("node").agg(
        F.first("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.first("n_chars").alias("n_chars"))


def subtree_totals(tree: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Sums of ``measures`` over each node's subtree, the node included, and ``n_children``.

    ``tree`` has node, parent (null: the root), depth and the measures, of a numeric type;
    it may be a forest.
    """
    own, edge = [f"own_{m}" for m in measures], [f"edge_{m}" for m in measures]
    zero = F.lit(0).cast("long")
    children = stage(tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    counted = stage(tree.join(children, "node", "left").select("node", "parent", "depth", F.coalesce("n_children", zero).alias("n_children"), *measures))
    live = counted.select(
        "node", "parent", "depth", *[F.col(m).cast("long").alias(o) for m, o in zip(measures, own, strict=True)], *[zero.alias(e) for e in edge])
    known, chains = None, []
    while not live.isEmpty():
        # a grouped count and minimum: a node with very many children is never joined with them
        below = live.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
            F.count("*").alias("n"), F.min("node").alias("child"), *[F.min(e).alias(f"child_{e}") for e in edge])
        state = stage(live.join(below, "node", "left"))
        lone = (F.col("n") == 1) & F.col("parent").isNotNull()
        chain = _doubled(state.where(lone).select(
            "node", "parent", "depth", F.col("child").alias("end"), *[(F.col(o) + F.col(f"child_{e}")).alias(o) for o, e in zip(own, edge, strict=True)], *edge), own)
        rest = state.where(~F.coalesce(lone, F.lit(False))).select("node", "parent", "depth", F.coalesce("n", zero).alias("n"), *own, *edge)
        if chain is not None:
            chains.append(chain)
            tops = chain.groupBy(F.col("end").alias("node")).agg(F.min_by(F.struct("parent", *own, *edge), "depth").alias("top"))
            # what hung on the edge from the chain to its end is part of the chain's sum
            over = lambda e, o: F.when(F.col("top").isNotNull(), F.col(f"top.{e}") + F.col(f"top.{o}")).otherwise(F.col(e))
            rest = stage(rest.join(tops, "node", "left").select(
                "node", F.when(F.col("top").isNotNull(), F.col("top.parent")).otherwise(F.col("parent")).alias("parent"), "depth", "n", *own,
                *[over(e, o).alias(e) for e, o in zip(edge, own, strict=True)]))
        leaves = rest.where("n = 0")
        done = leaves.select("node", *[F.col(o).alias(m) for o, m in zip(own, measures, strict=True)])
        known = done if known is None else known.unionByName(done)
        raked = leaves.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.col(o) + F.col(e)).alias(f"more_{o}") for o, e in zip(own, edge, strict=True)])
        live = stage(rest.where("n > 0").join(raked, "node", "left").select(
            "node", "parent", "depth", *[(F.col(o) + F.coalesce(f"more_{o}", zero)).alias(o) for o in own], *edge))
    if known is None:
        known = counted.select("node", *measures)
    for chain in reversed(chains):
        known = stage(known)
        ends = known.withColumnsRenamed({"node": "end"})
        known = known.unionByName(chain.join(ends, "end").select("node", *[(F.col(o) + F.col(m)).alias(m) for o, m in zip(own, measures, strict=True)]))
    return counted.drop(*measures).join(known, "node")


def _doubled(links: DataFrame, own: Sequence[str]) -> DataFrame | None:
    """Links (node to its only child ``end``) led to the end of their chain, ``own`` summed on the way."""
    current = stage(links.withColumn("led", F.lit(False)))
    if current.isEmpty():
        return None
    while True:
        ahead = current.select(F.col("node").alias("end"), F.col("end").alias("_end"), F.col("led").alias("_led"), *[F.col(o).alias(f"_{o}") for o in own])
        moved = current.where("NOT led").join(ahead, "end", "left").select(
            *[c for c in links.columns if c not in ("end", *own)], F.coalesce("_end", "end").alias("end"),
            *[(F.col(o) + F.coalesce(f"_{o}", F.lit(0).cast("long"))).alias(o) for o in own], F.coalesce("_led", F.lit(True)).alias("led"))
        current = stage(current.where("led").unionByName(moved))
        if current.where("NOT led").isEmpty():
            return current.drop("led")


def endings(held: DataFrame) -> DataFrame:
    """(node, low, ids): the conversations that end at a node, ascending, as text in pieces.

    A piece has at most ``PIECE`` ids; ``low`` orders a node's pieces.
    """
    last = held.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    rows = last.select("node.x", "node.y", "conv_id")
    sorted_rows = stage(rows).repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    return sorted_rows.mapInArrow(_pieces, "x bigint, y bigint, low bigint, ids string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y, ids = (c.to_pylist() for c in batch.columns)
        rows, at = [], 0
        while at < len(ids):
            end = at
            while end < len(ids) and end - at < PIECE and (x[end], y[end]) == (x[at], y[at]):
                end += 1
            rows.append((x[at], y[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        xs, ys, lows, texts = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(lows, pa.int64()), pa.array(texts, pa.string())], names=["x", "y", "low", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in a row; one digest's state and one batch are held."""
    node, state = None, None
    for batch in batches:
        rows = []
        for x, y, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != (x, y):
                if node is not None:
                    rows.append((*node, state.hexdigest()))
                node, state = (x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digest_rows(rows)
    if node is not None:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["x", "y", "ends"])


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes with their totals, and the rows of ``endings``.

    Nodes: node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens.  ``saved_tokens`` sums, over a subtree, the code points that members after
    the first repeat.
    """
    held = stage(members(turns, conversations))
    tree = stage(nodes(held))
    children = tree.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    measured = tree.join(children, "node", "left").select(
        "node", "parent", "depth", F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    totals = stage(subtree_totals(stage(measured), ["n_leaves", "saved_tokens"]).select("node", "n_children", "n_leaves", "saved_tokens"))
    above = tree.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return tree.join(totals, "node").join(above, "parent", "left"), endings(held)


def op11_tree_contraction(spark: SparkSession, folder: str) -> DataFrame:
    placed = stage(numbered(spark.read.parquet(f"{folder}/conversations.parquet")))
    lengths = stage(placed.groupBy("conv_id").agg(F.least(F.count("*"), F.lit(6)).alias("n_first")))
    # the first turns of conversation c - c % 100, and then c's own after as many
    start = lengths.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).alias("h"))
    plan = stage(start.join(lengths.select(F.col("conv_id").alias("base"), "n_first"), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_first", F.lit(0).cast("long"))).alias("taken")))
    firsts = placed.where("at < 6").withColumnsRenamed({"conv_id": "base"})
    lent = plan.join(firsts, "base").where("at < taken").select("conv_id", "at", "a", "b", "n_chars")
    kept = placed.join(plan, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "a", "b", "n_chars")
    trie, ends = prefix_trie(lent.unionByName(kept), lengths.select("conv_id"))
    digests = stage(ends).repartition("x", "y").sortWithinPartitions("x", "y", "low").mapInArrow(_digests, "x bigint, y bigint, ends string")
    return trie.select("*", "node.x", "node.y").join(digests, ["x", "y"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


#: the table of crc32 steps by byte, for SQL that has no crc32
CRC_SQL = r"""
WITH RECURSIVE crc(n, k, v) AS (
  SELECT n, 0, n FROM range(256) AS r(n) UNION ALL
  SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc WHERE k < 8),
steps AS (SELECT list(v ORDER BY n) AS t FROM crc WHERE k = 8),
"""

OP11_SQL = CRC_SQL + r"""
told AS (
  SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(turn ORDER BY p) AS turns FROM told GROUP BY conv_id),
drawn AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base,
         xor(list_reduce([4294967295] || [ord(c) FOR c IN string_split(conv_id::VARCHAR, '')], lambda s, c: xor(t[xor(s, c) % 256 + 1], s // 256)), 4294967295) % 6 AS h
  FROM own, steps),
rebuilt AS (
  SELECT d.conv_id, coalesce(b.turns, [])[1:h] || d.turns[h + 1:] AS turns FROM drawn d LEFT JOIN own b ON d.base = b.conv_id),
held AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM rebuilt, unnest(range(0, len(turns) + 1)) AS s(d)),
nodes AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM held GROUP BY path),
children AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS saved
  FROM nodes LEFT JOIN children USING (path)),
sums AS (SELECT path[:u] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM valued, unnest(range(0, depth + 1)) AS s(u) GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums USING (path) LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.path[:v.depth - 1]
"""
