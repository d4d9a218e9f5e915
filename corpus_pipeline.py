"""A training-data pipeline over ``documents``: each stage takes what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's ``docs``.  All but the last
return the columns of ``docs``.  ``run`` applies all of them.

Rows: a null text has no letter, so the first stage drops it; empty tables pass through;
repeated rows are copies of each other, of which near-deduplication keeps one; null ids are
documents like others; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate, language, pieces, secrets, simhash
from tidegauge.llm.tokens import tokenizer_path
from tidegauge.session import stage

#: near copies share 0.8 of their shingles of five words
SHINGLE, SIMILARITY = 5, 0.8
#: of 64 bits of the word-set fingerprints that join most of them
RADIUS = 2


def _identity() -> Column:
    """A row's place among documents: its id, nulls last, then its text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without any letter have no language and go."""
    model = language.fit(docs)
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    judged = language.predict(docs.select(F.col("text").cast("string").alias("text"), record), model)
    return judged.where(F.col("lang_pred") != language.UNKNOWN).select("record.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the first document by id of each group of near copies stays."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), _identity().alias("key"))
    groups = simhash.similar_documents(docs.select(_identity().alias("doc_id"), "text"), SHINGLE, SIMILARITY, RADIUS)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(first, F.hash(keyed["key"]).eqNullSafe(F.hash(first["key"])) & keyed["key"].eqNullSafe(first["key"]), "left_semi").dropDuplicates(["key"]).select("record.*")


def unseen_by_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs.select(_identity().alias("doc_id"), "text"), items)
    tainted = stage(found.where("n_hit > 0").select("doc_id.*").distinct())
    return docs.join(
        tainted, docs["doc_id"].eqNullSafe(tainted["id"]) & (F.xxhash64(docs["text"]) == tainted["text"]), "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets are masked in the text; ``n_chars`` follows."""
    columns = [
        F.col("masked").alias("text") if c == "text" else F.length("masked").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"record.`{c}`")
        for c in docs.columns
    ]
    return secrets.scan(docs).select(*columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids with source offsets of every piece, and the decoded text."""
    return pieces.digests(docs, tokenizer_path("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("language", known_language), ("near_duplicates", one_of_each), ("decontaminate", unseen_by_tests),
    ("secrets", without_secrets), ("pieces", as_pieces),
]

#: no stage but decontamination can be said in SQL; tests compare with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
