"""Language identification, words first, shorter and shorter n-grams for unseen words.

Words are runs of letters, lower-cased.  A word the model knows adds its log frequency in
each language.  An unseen word, bounded by ``_``, is scored by all of its known 4-grams; if
none is known by its 3-grams, then 2-grams, then letters; a word without any known letter
adds nothing.  The language with the highest sum wins, the first by name on a tie.

Fitting: counts are grouped sums over a bounded sample of labelled rows, about
``fit_rows`` rows a language chosen by hash of the id (all rows of smaller languages).  The
model keeps the ``words`` and ``grams`` most frequent entries, so what tasks receive is
bounded whatever the corpus.  Prediction uses the text alone and reads it whole.

Rows: null texts and texts without a letter are ``und`` with score 0, as is everything when
nothing can be learnt; null ids are held in, but not learnt from; repeated rows are kept;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import slices
from tidegauge.llm.frequent import most_frequent
from tidegauge.session import stage

FIT_ROWS = 2_000
WORDS = 60_000
GRAMS = 60_000
SEEN = 3
UNKNOWN = "und"
KEPT_WORDS = 200_000

LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    """Entries (words, and grams after ``_GRAM``) with a row of log frequencies each."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        padded = f"_{word}_"
        for n in (4, 3, 2, 1):
            at = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i : i + n])) is not None]
            if at:
                return self.logs[at].sum(axis=0)
        return np.zeros(len(self.langs))


class Scorer(dict):
    """From a word to its row in a growing table, for one worker."""

    def __init__(self, model: LanguageModel):
        super().__init__(model.words)
        self.model = model
        self.rows = np.zeros((len(model.logs) + KEPT_WORDS, len(model.langs)))
        self.rows[: len(model.logs)] = model.logs
        self.used = len(model.logs)
        self.over = np.zeros(len(model.langs))

    def __missing__(self, word: str) -> int:
        row = self.model.unseen(word)
        if self.used == len(self.rows):
            self.over += row
            return -1
        at = self.used
        self.rows[at] = row
        self[word] = at
        self.used += 1
        return at

    def text(self, text: str | None) -> tuple[str, float]:
        found = LETTERS.findall(text.lower()) if text else []
        if not found or not (found[0][0].isalpha() or any(c.isalpha() for w in found for c in w)):
            return UNKNOWN, 0.0
        self.over[:] = 0
        at = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        total = self.rows[at[at >= 0]].sum(axis=0) + self.over
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.langs[best], float(share[best] / share.sum())


_SCORERS: dict[str, Scorer] = {}


def words_of(text: Column) -> Column:
    """The same runs of letters in Spark."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def fit(train: DataFrame, fit_rows: int = FIT_ROWS, words: int = WORDS, grams: int = GRAMS) -> LanguageModel:
    """Counts words and n-grams of a bounded sample of ``train`` (doc_id, text, lang)."""
    usable = train.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # a written table of a few rows is broadcast by its size, so texts are not dealt by language
    sizes = stage(usable.groupBy("lang").agg(F.count("*").alias("rows")))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.join(sizes, "lang").where(chance < fit_rows / F.col("rows")).select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counted = stage(sample.groupBy("lang", "word").agg(F.count("*").alias("n")))
    padded = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    pieces = F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i, n=n: F.substring(padded, i, F.lit(n)))
        for n in (1, 2, 3, 4)]))
    entries = counted.select("lang", F.lit(0).alias("gram"), F.col("word").alias("entry"), "n").unionByName(
        counted.select("lang", F.lit(1).alias("gram"), F.explode(pieces).alias("entry"), "n"))
    per_lang = stage(entries.groupBy("gram", "entry", "lang").agg(F.sum("n").alias("n")))
    top = stage(per_lang.groupBy("gram", "entry").agg(F.sum("n").alias("all")).where(F.col("all") >= SEEN))
    kept = [most_frequent(top.where(F.col("gram") == g), "all", size) for g, size in ((0, words), (1, grams))]
    rows = per_lang.join(kept[0].unionByName(kept[1]).select("gram", "entry"), ["gram", "entry"]).toArrow()
    totals = {(r["gram"], r["lang"]): r["n"] for r in per_lang.groupBy("gram", "lang").agg(F.sum("n").alias("n")).collect()}

    langs = sorted({lang for _, lang in totals})
    names = sorted(set(zip(rows.column("gram").to_pylist(), rows.column("entry").to_pylist(), strict=True)))
    index = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), max(len(langs), 1)))
    place = {lang: i for i, lang in enumerate(langs)}
    for gram, entry, lang, n in zip(*(rows.column(c).to_pylist() for c in ("gram", "entry", "lang", "n")), strict=True):
        counts[index[gram, entry], place[lang]] = n
    kinds = np.array([g for g, _ in names], np.int64)
    logs = np.zeros_like(counts)
    for kind in (0, 1):
        own = kinds == kind
        total = np.array([totals.get((kind, lang), 0) for lang in langs]) + 0.5 * own.sum()
        if own.any():
            logs[own] = np.log((counts[own] + 0.5) / total)
    return LanguageModel(
        langs, {e: i for (g, e), i in index.items() if not g}, {e: i for (g, e), i in index.items() if g}, logs)


def _predict(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()  # one model a worker
            _SCORERS[key] = Scorer(shared.value)
        scorer = _SCORERS[key]
        at = None
        for batch in batches:
            for part in slices(batch):
                at = part.schema.get_field_index("text") if at is None else at
                found = [scorer.text(t) if scorer.model.langs else (UNKNOWN, 0.0) for t in part.column(at).to_pylist()]
                yield pa.record_batch(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone."""
    import uuid

    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predict(shared, uuid.uuid4().hex), f"{columns}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_backoff(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
