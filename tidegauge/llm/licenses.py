"""Licence scan with a positional index of rare licence words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A template is a
licence notice: its indexed words with their places in the notice, a mandatory key phrase
of consecutive words, and the share of the notice's weight that a place must show.  Base
templates are key phrases alone.

1. One scan takes the places of all licence words of every text.
2. Document frequencies of these words over the whole corpus give their weights (IDF); the
   licence vocabulary is part of the code, so the driver gets at most one number a word.
3. A text looks up the highest-IDF word of each key phrase.  Only templates whose rarest
   key word it holds are intersected: each place of a template word votes for the place
   where the template would start, and votes for one start meet in a grouped count.
4. A start is a finding when all words of the key phrase voted for it (so they stand
   consecutively) and the words that agree carry enough of the template's weight.

Only DataFrame and SQL functions run on the executors.  Nothing is grouped by a key that
documents share but the vocabulary's counts, which are summed in each task first.

Rows: null texts have no words; texts without findings have no labels (empty strings), no
first and last word, score 0; repeated rows and null ids are rows of their own; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import stage


@dataclass(frozen=True)
class Template:
    """A notice: ``words`` in order ("_" is any word), its key phrase, the share it must show."""

    label: str
    words: str
    key: str
    share: float = 0.5
    base: bool = False


#: fixed values: base phrases, then public licence notices with their labels
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", 1.0, True),
    Template("gpl", "general public license", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", "all rights reserved", 1.0, True),
    Template("apache", "licensed under _ apache license version 2 0", "apache license"),
    Template("mit", "released under _ mit license", "mit license"),
    Template("mit", "permission _ hereby granted free _ charge _ _ person obtaining _ copy _ _ software", "hereby granted free"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("mpl", "source code form _ subject _ _ terms _ _ mozilla public license", "mozilla public license"),
    Template("bsd", "redistribution _ use _ source _ binary forms _ _ without modification _ permitted provided", "binary forms"),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _key_places(template: Template) -> range:
    words, key = template.words.split(), template.key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return range(at, at + len(key))


def licence_postings(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """row, doc_id, n_words and the licence words of every text with their places."""
    vocabulary = sorted({w for t in templates for w in t.words.split()} - {"_"})
    taken = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), *LETTERS), F.lit(WORD), F.lit(0))
    # one lambda over the list, so that the words are taken once for both figures
    both = F.transform(
        F.array(taken),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("p"))))).alias("hits"),
        ),
    )[0]
    return (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", both.alias("found"))
        .select("row", "doc_id", "found.n_words", "found.hits")
    )


def weights(postings: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF of the licence vocabulary over all documents."""
    found = postings.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    df = {r["w"]: r["n"] for r in found.collect()}  # the vocabulary's size at most
    total = postings.count()
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for t in templates for w in t.words.split() if w != "_"}


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row a document: row, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    postings = stage(licence_postings(docs, templates))
    idf = weights(postings, templates)
    lines, anchors, totals = [], [], []
    for number, template in enumerate(templates):
        key = _key_places(template)
        words = [(i, w) for i, w in enumerate(template.words.split()) if w != "_"]
        anchors.append(max((template.words.split()[i] for i in key), key=lambda w: (idf[w], w)))
        totals.append(sum(idf[w] for _, w in words))
        lines += [f"({number}, '{w}', {i}, {int(i in key)}, {idf[w]!r}D)" for i, w in words]
    index = spark.sql(f"SELECT * FROM VALUES {', '.join(lines)} AS t(template, w, off, is_key, idf)")
    facts = spark.sql("SELECT * FROM VALUES " + ", ".join(
        f"({n}, '{t.label}', {len(t.key.split())}, {_key_places(t)[0]}, {totals[n]!r}D, {t.share}D, {str(t.base).lower()})" for n, t in enumerate(templates)
    ) + " AS t(template, label, key_words, key_at, weight, least, base)")

    looked_up: Column = F.array_compact(F.array(*[F.when(F.array_contains("hits.w", a), F.lit(n)) for n, a in enumerate(anchors)]))
    votes = (
        postings.select("row", looked_up.alias("held"), "hits")
        .where(F.size("held") > 0)
        .select("row", "held", F.inline("hits"))
        .join(F.broadcast(index), "w")  # a table of the code's own templates
        .where("array_contains(held, template)")
        .groupBy("row", "template", (F.col("p") - F.col("off")).alias("start"))
        .agg(F.sum("is_key").alias("keys"), F.sum("idf").alias("agreed"))
    )
    places = (
        votes.join(F.broadcast(facts), "template")
        .withColumn("share", F.least(F.lit(1.0), F.round(F.col("agreed") / F.col("weight"), 9)))
        .where("keys = key_words and share >= least")
        .withColumn("at", F.when(F.col("base"), F.col("start") + F.col("key_at")))
    )
    found = places.groupBy("row").agg(
        F.count("at").alias("n_base"), F.min("at").cast("long").alias("first_word"), F.max("at").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    return postings.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_rare_words(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark.read.parquet(f"{folder}/documents.parquet")).drop("row")
