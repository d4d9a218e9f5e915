"""SimHash near-duplicates through the generalised pigeonhole principle.

1. A text's fingerprint: words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, shingles of
   ``shingle`` words with repeats, XXH64 with seed 42 of each; a bit is set where over half
   of the hashes have it.  Fewer words give one shingle, none the fingerprint zero.
   Documents with one fingerprint are one node from here on.
2. The 64 bits are dealt into ``parts`` groups of correlated bits (counts of 64 x 64 bit
   pairs over all nodes), so that the values of a group are as uneven as possible between
   groups and its rare values select well.
3. With thresholds t_i >= -1 whose t_i + 1 sum to ``radius`` + 1, two fingerprints within
   ``radius`` differ in at most t_i bits of some group.  For each node a dynamic programme
   picks the t_i with the fewest estimated candidates; the estimates come from counts of
   the groups' values over all nodes, in tables of fixed size.
4. A node probes each group's index with all values within its t_i, and candidates are
   checked on all 64 bits.
5. Index values with over ``DENSE`` nodes would give quadratic candidates.  Nodes in or
   probing such a value meet on neighbours instead: fingerprints within radius r have a
   common value at most ceil(r / 2) and floor(r / 2) bits away, and one star about each
   such value has the same components as all pairs within the radius.  The pairs
   themselves are not all kept: who filters links afterwards, as ``similar_documents``
   does, needs another search for those about an unlike centre (``prefix_links``).

Rows: null and empty texts have fingerprint zero and link with each other; null ids take
part, and a component of null ids alone has a null id; repeated rows share a fingerprint;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm import bittable
from tidegauge.llm.bytewords import ALNUM, NOT_SPACE, Prefix, find_words, list_array, mix, run_hashes, signed, slices, spaced
from tidegauge.llm.components import components
from tidegauge.llm.frequent import most_frequent
from tidegauge.session import stage

RADIUS = 2
PARTS = 3
SHINGLE = 3
DENSE = 48
#: slots of one group's table of counts
TABLE = 1 << 16
#: nodes whose shingles are counted for the order of prefixes
SAMPLE = 2048
#: rounds in which nodes of a token meet its hub before the whole search
ROUNDS = 2
#: pairs of rows compared at a time
MEETINGS = 1 << 20


def fingerprint_rows(texts: pa.Array, shingle: int) -> np.ndarray:
    words = find_words(texts, NOT_SPACE, lower=True)
    joined, start, end = spaced(words)
    out = np.zeros(len(texts), np.uint64)
    counts = words.counts
    runs = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    filled = np.flatnonzero(runs)
    if not len(filled):
        return out
    sizes = runs[filled]
    opens = np.cumsum(sizes) - sizes
    low = np.arange(sizes.sum()) + np.repeat(words.first[filled] - opens, sizes)
    high = low + np.repeat(np.minimum(counts[filled], shingle) - 1, sizes)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[i:j], 42) for i, j in zip(start[low].tolist(), end[high].tolist(), strict=True)), np.dtype(">u8"), len(low))
    out[filled] = _majority(hashes, opens, sizes)
    return out


def _majority(hashes: np.ndarray, opens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits set in over half of each run of big-endian hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, opens, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel()


def _distinct_runs(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, row after row, and how many each row has."""
    keys = mix(values ^ mix(row.astype(np.uint64) + np.uint64(1)))
    first = np.sort(np.unique(keys, return_index=True)[1])
    return values[first], np.bincount(row[first], minlength=rows)


def word_set_rows(texts: pa.Array) -> np.ndarray:
    """Fingerprints of the sets of words, which are runs of letters and digits.

    A changed word moves these by much less than it moves those of shingles.
    """
    words = find_words(texts, ALNUM, lower=True)
    out = np.zeros(len(texts), np.uint64)
    if len(words.start):
        values, counts = _distinct_runs(words.hashes(), words.row, len(texts))
        filled = np.flatnonzero(counts)
        sizes = counts[filled]
        out[filled] = _majority(values.astype(">u8"), np.cumsum(sizes) - sizes, sizes)
    return out


def shingle_sets(texts: pa.Array, shingle: int) -> pa.Array:
    """Hashes of each text's distinct shingles of letter-and-digit words, as lists of longs."""
    words = find_words(texts, ALNUM, lower=True)
    row, hashes = words.row, words.hashes()
    runs = run_hashes(hashes, shingle)
    inside = np.flatnonzero(row[: len(runs)] == row[shingle - 1 :]) if len(runs) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    whole = Prefix(hashes, 0xA0761D6478BD642F).of(words.first[short], words.first[short + 1])
    values, rows = np.concatenate([runs[inside], whole]), np.concatenate([row[inside], short])
    order = np.argsort(rows, kind="stable")
    values, counts = _distinct_runs(values[order], rows[order], len(texts))
    return list_array(signed(values), np.repeat(np.arange(len(texts)), counts), len(texts))


def _fingerprints(shingle: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = word_set_rows(part.column(1)) if shingle is None else fingerprint_rows(part.column(1), shingle)
                yield pa.record_batch([part.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int | None = SHINGLE) -> DataFrame:
    """doc_id and fp, over shingles or, with None, over the set of words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprints(shingle), f"doc_id {id_type}, fp bigint")


def _bit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        prints = batch.column(0).to_numpy().astype(">i8")
        bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)[:, ::-1]
        total += bits.T @ bits
    i, j = np.indices((64, 64))
    yield pa.record_batch(
        [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel().astype(np.int64))], names=["i", "j", "n"])


def group_bits(nodes: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Bits 0 (lowest) to 63 in ``parts`` groups; correlated bits share a group."""
    pairs = nodes.select("fp").mapInArrow(_bit_pairs, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((64, 64))
    for i, j, n in pairs.collect():  # 4,096 rows, whatever the input
        both[i, j] = n
    ones = np.diag(both).copy()
    n = max(1.0, float(nodes.count()))
    p = ones / n
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    link = np.abs(np.divide(both / n - np.outer(p, p), spread, out=np.zeros((64, 64)), where=spread > 0))
    np.fill_diagonal(link, 0)
    left, groups = list(range(64)), []
    for g in range(parts):
        size = len(left) // (parts - g)
        group = [max(left, key=lambda b: (link[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (link[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def part_values(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    value = np.zeros(len(prints), np.int64)
    for at, bit in enumerate(bits):
        value |= ((prints >> np.int64(bit)) & 1) << np.int64(at)
    return value


def _slot(values: np.ndarray) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def thresholds(values: list[np.ndarray], widths: list[int], tables: np.ndarray, nodes: int, radius: int) -> np.ndarray:
    """t_i of every node (rows) and group (columns): fewest estimated candidates and probes."""
    n = len(values[0])
    costs = []
    for i, (value, width) in enumerate(zip(values, widths, strict=True)):
        chance = nodes / 2.0**width
        near = lambda v, i=i, chance=chance: np.maximum(tables[i][_slot(v)] - nodes / TABLE, 0) + chance
        cost = [np.zeros(n), near(value) + 1]
        if radius >= 1:
            cost.append(cost[-1] + sum(near(value ^ (1 << b)) for b in range(width)) + width)
        volume = width * (width - 1) / 2
        for r in range(2, radius + 1):
            cost.append(cost[-1] + volume * (chance + 1))
            volume *= (width - r) / (r + 1)
        costs.append(cost)
    best = np.full((radius + 2, n), np.inf)
    best[0] = 0
    chosen = np.zeros((len(values), radius + 2, n), np.int8)
    for i, cost in enumerate(costs):
        fresh = np.full_like(best, np.inf)
        for units in range(radius + 2):
            for own in range(units + 1):
                total = best[units - own] + cost[own]
                better = total < fresh[units]
                fresh[units][better] = total[better]
                chosen[i, units][better] = own
        best = fresh
    out = np.zeros((n, len(values)), np.int8)
    units = np.full(n, radius + 1)
    for i in range(len(values) - 1, -1, -1):
        own = chosen[i, units, np.arange(n)]
        out[:, i] = own - 1
        units = units - own
    return out


def _probes(groups: list[list[int]], tables, nodes: int, radius: int):
    widths = [len(g) for g in groups]
    masks = [[[sum(1 << b for b in c) for c in combinations(range(w), r)] for r in range(radius + 1)] for w in widths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                prints = batch.column(0).slice(at, 4096).to_numpy()
                values = [part_values(prints, g) for g in groups]
                limits = thresholds(values, widths, tables.value, nodes, radius)
                fps, parts, found = [], [], []
                for i in range(len(groups)):
                    for r in range(radius + 1):
                        who = np.flatnonzero(limits[:, i] >= r)
                        flips = np.array(masks[i][r], np.int64)
                        fps.append(np.repeat(prints[who], len(flips)))
                        found.append((values[i][who][:, None] ^ flips[None, :]).ravel())
                        parts.append(np.full(len(found[-1]), i, np.int8))
                yield pa.record_batch(
                    [pa.array(np.concatenate(fps)), pa.array(np.concatenate(parts)), pa.array(np.concatenate(found))], names=["fp", "part", "value"])

    return run


def _neighbours(radius: int):
    """Every value at most ceil(radius / 2) bits away, with its distance."""
    reach = (radius + 1) // 2
    flips, depth = [0], [0]
    for r in range(1, reach + 1):
        for c in combinations(range(64), r):
            flips.append(sum(1 << b for b in c))
            depth.append(r)
    masks, depths = np.array(flips, np.uint64).view(np.int64), np.array(depth, np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                prints = batch.column(0).slice(at, 512).to_numpy()
                yield pa.record_batch(
                    [pa.array(np.repeat(prints, len(masks))), pa.array((prints[:, None] ^ masks[None, :]).ravel()), pa.array(np.tile(depths, len(prints)))],
                    names=["fp", "key", "depth"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, parts: int = PARTS, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` with the components of all pairs within ``radius``."""
    spark = nodes.sparkSession
    groups = group_bits(nodes, parts)
    widths = [len(g) for g in groups]
    total = nodes.count()
    value = lambda g: " | ".join(f"shiftleft(shiftright(fp, {b}) & 1L, {at})" for at, b in enumerate(g))
    index = nodes.select("fp", F.posexplode(F.expr("array(" + ", ".join(value(g) for g in groups) + ")")).alias("part", "value")).select(
        "fp", F.col("part").cast("tinyint").alias("part"), "value")
    counts = stage(index.groupBy("part", "value").agg(F.count("*").alias("n")))
    tables = np.zeros((parts, TABLE))
    # the slot is the top 16 bits of a 64-bit product, taken without overflow errors
    frame = counts.mapInArrow(_table_counts, "part tinyint, slot int, n bigint").groupBy("part", "slot").agg(F.sum("n").alias("n")).toArrow()
    tables[frame.column("part").to_numpy(), frame.column("slot").to_numpy()] = frame.column("n").to_numpy()  # parts x 65,536 at most
    probes = nodes.select("fp").mapInArrow(
        _probes(groups, spark.sparkContext.broadcast(tables), total, radius), "fp bigint, part tinyint, value bigint")
    met = stage(probes.join(counts, ["part", "value"]).select("fp", "part", "value", (F.col("n") > dense).alias("crowded")))
    near = (
        met.where(~F.col("crowded"))
        .select(F.col("fp").alias("a"), "part", "value")
        .join(index.select(F.col("fp").alias("b"), "part", "value"), ["part", "value"])
        .where((F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    crowded = counts.where(F.col("n") > dense).select("part", "value")
    inside = index.join(crowded, ["part", "value"], "left_semi").select("fp").unionByName(met.where("crowded").select("fp")).distinct()
    # at most one line for each value about a node, and a value has no more nodes than neighbours
    keys = inside.mapInArrow(_neighbours(radius), "fp bigint, key bigint, depth tinyint")
    centre = F.min(F.when(F.col("depth") <= radius // 2, F.col("fp"))).over(Window.partitionBy("key"))
    around = keys.withColumn("b", centre).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(around)


def _table_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch(
            [batch.column(0), pa.array(_slot(batch.column(1).to_numpy()).astype(np.int32)), batch.column(2)], names=["part", "slot", "n"])


def _grouped(prints: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    joined = components(found).withColumnsRenamed({"node": "fp"})
    rooted = stage(nodes.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = stage(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int | None = SHINGLE, radius: int = RADIUS, parts: int = PARTS, dense: int = DENSE) -> DataFrame:
    """One row a document: doc_id, fp, component_id (smallest id reachable over links)."""
    prints = stage(fingerprints(docs, shingle))
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _grouped(prints, nodes, links(nodes, radius, parts, dense))


def similar_documents(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, parts: int = PARTS, dense: int = DENSE, rounds: int = ROUNDS,
) -> DataFrame:
    """Components of all pairs that share ``similarity`` of their distinct shingles (Jaccard).

    Two searches give candidates, and both confirm them on the texts.  Word-set
    fingerprints within ``radius`` are met through the first documents of both, and each
    text is met with the first one of its own fingerprint: this joins most copies, but not
    all, for a fingerprint says too little about shingles.  ``prefix_links`` then finds
    every pair that is still in two components, without any fingerprint.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = pa.array(word_set_rows(part.column(2)).view(np.int64))
                yield pa.record_batch([part.column(0), part.column(1), prints, _set_keys(part.column(2), shingle)], names=["doc_id", "text_key", "fp", "shingles_key"])

    prints = stage(keyed.mapInArrow(prints_of, f"doc_id {id_type}, text_key bigint, fp bigint, shingles_key bigint"))
    # texts with one set of shingles are one node; most copies end here
    nodes = stage(prints.groupBy("shingles_key").agg(F.min(F.struct("doc_id", "text_key", "fp")).alias("first")).select("shingles_key", "first.*"))
    classes = stage(nodes.groupBy("fp").agg(F.min(F.struct("doc_id", "shingles_key")).alias("first")).select("fp", "first.shingles_key"))
    near = links(classes.select("fp"), radius, parts, dense).distinct()
    first = classes.select("fp", "shingles_key")
    pairs = stage(
        near.join(first.select(F.col("fp").alias("a"), F.col("shingles_key").alias("x")), "a")
        .join(first.select(F.col("fp").alias("b"), F.col("shingles_key").alias("y")), "b")
        .select("x", "y")
        .unionByName(nodes.select("fp", F.col("shingles_key").alias("x")).join(first.withColumnsRenamed({"shingles_key": "y"}), "fp").where("x <> y").select("x", "y")))
    alike = stage(_confirmed(keyed, nodes, pairs, shingle, similarity))
    joined = components(alike).withColumnsRenamed({"node": "shingles_key"})
    placed = stage(nodes.join(joined, "shingles_key", "left").select("shingles_key", "text_key", F.coalesce("root", "shingles_key").alias("root")))
    alike = alike.unionByName(prefix_links(keyed, nodes, placed, shingle, similarity, rounds))
    as_print = {"shingles_key": "fp", "doc_id": "least"}
    return _grouped(
        prints.select("doc_id", F.col("shingles_key").alias("fp")), nodes.select("shingles_key", "doc_id").withColumnsRenamed(as_print), alike)


def _sets(keyed: DataFrame, ends: DataFrame, shingle: int) -> DataFrame:
    """shingles_key and shingles of the nodes ``ends`` (shingles_key, text_key)."""
    table = keyed.sparkSession.sparkContext.broadcast(bittable.collect_bits(ends, "text_key"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.filter(pa.array(bittable.member(table.value, batch.column(1).to_numpy())))
            for part in slices(wanted):
                yield pa.record_batch([part.column(1), shingle_sets(part.column(2), shingle)], names=["text_key", "shingles"])

    return stage(keyed.mapInArrow(sets_of, "text_key bigint, shingles array<bigint>").join(ends, "text_key").select("shingles_key", "shingles").dropDuplicates(["shingles_key"]))


def _confirmed(keyed: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The written ``pairs`` (x, y) of nodes that share ``similarity`` of their shingles."""
    ends = stage(pairs.select(F.col("x").alias("shingles_key")).unionByName(pairs.select(F.col("y").alias("shingles_key"))).distinct()
                 .join(nodes.select("shingles_key", "text_key"), "shingles_key"))
    sets = _sets(keyed, ends, shingle)
    side = lambda c: sets.select(F.col("shingles_key").alias(c), F.col("shingles").alias(f"s{c}"))
    shared = F.size(F.array_intersect("sx", "sy"))
    return pairs.join(side("x"), "x").join(side("y"), "y").where(shared >= similarity * (F.size("sx") + F.size("sy") - shared)).select("x", "y")


def prefix_links(keyed: DataFrame, nodes: DataFrame, placed: DataFrame, shingle: int, similarity: float, rounds: int = ROUNDS) -> DataFrame:
    """Confirmed links (x, y) that, with the given roots, join all pairs of ``similarity``.

    ``placed`` has shingles_key, text_key and root.  All sets are put in one order, and two
    sets that share ``similarity`` of their union share a token among their first
    ``size - ceil(similarity * size) + 1``.  Only tokens that nodes of two roots hold are
    kept.  First, in each of ``rounds`` rounds, the nodes of a token meet one hub of it:
    one candidate a row at most, and what is confirmed shares a root from then on.  So a
    group of near copies ends as a star or a few, and the last search, which is whole,
    meets pairs of nodes only where their roots still differ.
    """
    firsts = stage(_prefixes(keyed, placed, shingle, similarity))
    side = lambda c: firsts.select(F.col("shingles_key").alias(c), F.col("size").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))

    def near(met: DataFrame) -> DataFrame:
        both = met.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "px", "py")
        return stage(both.mapInArrow(_near_parities(similarity), "x bigint, y bigint"))

    rows = _contested(firsts.select("shingles_key", "root", "size", F.posexplode("tokens").alias("at", "token")))
    found = None
    for r in range(rounds):
        hubs = rows.join(_hub_order(rows, r), "shingles_key").groupBy("token").agg(F.max(F.struct("order", "shingles_key", "root", "size")).alias("hub"))
        met = (
            rows.join(stage(hubs), "token")
            .where("root <> hub.root")
            .where(F.least("size", "hub.size") >= similarity * F.greatest("size", "hub.size") - 1e-6)
            .select(F.col("shingles_key").alias("x"), F.col("hub.shingles_key").alias("y"))
            .distinct()
        )
        linked = stage(_confirmed(keyed, nodes, near(stage(met)), shingle, similarity))
        found = linked if found is None else found.unionByName(linked)
        rows = _contested(_rerooted(rows, linked))
    ordered = rows.select("token", "shingles_key", "size", "at", "root").repartition("token").sortWithinPartitions("token")
    met = stage(ordered.mapInArrow(_meetings(similarity), "x bigint, y bigint").distinct())
    last = _confirmed(keyed, nodes, near(met), shingle, similarity)
    return last if found is None else found.unionByName(last)


def _contested(rows: DataFrame) -> DataFrame:
    """The written rows of tokens that nodes of more than one root hold."""
    tokens = stage(rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token"))
    return stage(rows.join(tokens, "token", "left_semi"))


def _hub_order(rows: DataFrame, r: int) -> DataFrame:
    """Each node's place among the hubs of its tokens.

    First by the share of its shingles that others hold too, for the original of a group
    has no edits of its own; then by a hash of the round, so that others take turns.
    """
    order = F.count("*") / F.first("size") if r == 0 else F.xxhash64("shingles_key", F.lit(r)).cast("double")
    return rows.groupBy("shingles_key").agg(order.alias("order"))


def _rerooted(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """``rows`` with the roots that ``linked`` pairs (x, y) of nodes have in common made one."""
    roots = stage(rows.select("shingles_key", "root").distinct())
    of = lambda c: roots.select(F.col("shingles_key").alias(c), F.col("root").alias(f"r{c}"))
    merged = stage(components(linked.join(of("x"), "x").join(of("y"), "y").select("rx", "ry")).select(F.col("node").alias("root"), F.col("root").alias("fresh")))
    return rows.join(merged, "root", "left").select("shingles_key", F.coalesce("fresh", "root").alias("root"), "size", "at", "token")


def _prefixes(keyed: DataFrame, placed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """shingles_key, root, size, parity and the first tokens of each node's set.

    Any order is right; shingles that are frequent in a sample of nodes go last, so that
    templates and stock lines meet seldom.
    """
    spark = keyed.sparkSession
    step = max(1, placed.count() // SAMPLE)
    sample = placed.where(F.pmod(F.xxhash64("shingles_key"), F.lit(step)) == 0).select("shingles_key", "text_key")
    counts = stage(_sets(keyed, sample, shingle).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1"))
    frequent = most_frequent(counts, "n", TABLE).toArrow()  # at most 65,536 rows
    values, ranks = frequent.column("s").to_numpy(), frequent.column("n").to_numpy()
    order = np.argsort(values)
    table = spark.sparkContext.broadcast((values[order], ranks[order]))

    def prefixes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(2), shingle)
                sizes = sets.value_lengths().to_numpy()
                row, tokens = np.repeat(np.arange(len(sizes)), sizes), sets.flatten().to_numpy()
                by = np.lexsort((tokens, _ranks(table.value, tokens), row))
                at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = at <= np.repeat(sizes - np.ceil(similarity * sizes - 1e-9), sizes)
                yield pa.record_batch(
                    [part.column(1), pa.array(sizes.astype(np.int32)), _parities(tokens, sizes), list_array(pa.array(tokens[by][keep]), row[keep], len(sizes))],
                    names=["text_key", "size", "parity", "tokens"])

    prefixes = keyed.mapInArrow(prefixes_of, "text_key bigint, size int, parity binary, tokens array<bigint>").dropDuplicates(["text_key"])
    return prefixes.join(placed, "text_key").select("shingles_key", "root", "size", "parity", "tokens")


def _parities(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each set's bits, about one a token: whether an odd number of tokens has that slot.

    Two sets differ in at least as many tokens as bits; a half xor the other is the shorter row.
    """
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    opens = np.concatenate([[0], np.cumsum(bits)])
    slot = mix(tokens.view(np.uint64)) & np.repeat(bits - 1, sizes).astype(np.uint64)
    odd = np.bincount(np.repeat(opens[:-1], sizes) + slot.astype(np.int64), minlength=opens[-1]) & 1
    data = np.packbits(odd.astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((opens // 8).astype(np.int32)), pa.py_buffer(data)])


def _near_parities(similarity: float):
    """Drops pairs whose bits differ in more places than similar sets may have tokens of one side."""

    def folded(row: np.ndarray, size: int) -> np.ndarray:
        while len(row) > size:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = np.zeros(batch.num_rows, np.int64)
            for i, (px, py) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(px, np.uint64), np.frombuffer(py, np.uint64)
                least = min(len(x), len(y))
                apart[i] = np.bitwise_count(folded(x, least) ^ folded(y, least)).sum()
            near = pa.array(apart <= (1 - similarity) / (1 + similarity) * sizes + 1e-6)
            yield pa.record_batch([batch.column(0).filter(near), batch.column(1).filter(near)], names=["x", "y"])

    return run


def _ranks(table: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """The count of each token in a table sorted by token, else 0."""
    values, counts = table
    if not len(values):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
    return np.where(values[at] == tokens, counts[at], 0)


def _meetings(similarity: float):
    """Pairs of nodes that share a token, from rows in the order of their tokens."""

    def met(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        token, key, size, at, root = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.lexsort((size, token))
        token, key, size, at, root = token[by], key[by], size[by].astype(np.int64), at[by].astype(np.int64), root[by]
        group = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
        opens = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        mixed = np.minimum.reduceat(root, opens) != np.maximum.reduceat(root, opens)
        # of the larger set's sizes; nothing before the first shared token is shared, so places bound the overlap
        reach = (1 + similarity) / similarity * (size - at)
        most = np.floor(np.minimum(size / similarity, reach - size) + 1e-6).astype(np.int64)
        line = group * (1 << 40) + size
        i = np.arange(len(token))
        ends = np.where(mixed[group], np.searchsorted(line, group * (1 << 40) + np.maximum(most, 0), side="right"), i + 1)
        counts = np.maximum(ends - i - 1, 0)
        done = np.concatenate([[0], np.cumsum(counts)])
        start = 0
        while done[start] < done[-1]:
            stop = max(start + 1, int(np.searchsorted(done, done[start] + MEETINGS, side="right")) - 1)
            own = counts[start:stop]
            a = np.repeat(i[start:stop], own)
            b = a + 1 + np.arange(len(a)) - np.repeat(done[start:stop] - done[start], own)
            fits = (root[a] != root[b]) & (size[a] + size[b] <= reach[b] + 1e-6)
            a, b = key[a[fits]], key[b[fits]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["x", "y"])
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            # a token's rows may go on in the next batch
            if held and (cut or held[0][0][-1] != rows[0][-1]):
                yield from met([*held, [c[:cut] for c in rows]])
                held = []
            elif cut:
                yield from met([[c[:cut] for c in rows]])
            held.append([c[cut:] for c in rows])
        if held:
            yield from met(held)

    return run


def _set_keys(texts: pa.Array, shingle: int) -> pa.Array:
    """One hash of each text's set of shingles; 0 for no words."""
    sets = shingle_sets(texts, shingle)
    values = mix(sets.flatten().to_numpy().view(np.uint64))
    totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    bounds = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
    return signed(totals[bounds[1:]] - totals[bounds[:-1]])


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
