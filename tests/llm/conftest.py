import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import FOLDER  # noqa: E402


@pytest.fixture(scope="session")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())


#: columns that operators use inside; documents may have them too
CLASHING = "row bigint, found string, bucket int, key string, fp bigint, shard int, slot int, n_words string, score string, text_hash string, record string"


@pytest.fixture
def awkward(spark):
    """Nulls, empties, one very long text, repeated rows, repeated ids, extra columns."""
    long = " ".join(f"w{i % 977} cc by" for i in range(20_000))
    rows = [
        (1, "All rights reserved. CC BY 4.0", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "en"), (5, long, "en"), (6, long, "en"),
        (7, "12345 67890", "en"), (None, "no id at all here", "en"), (None, None, None), (8, "same row", "fr"), (8, "same row", "fr"), (9, "one", None),
    ]
    clash = [c.split()[0] for c in CLASHING.split(", ")]
    data = [(i, t, lang, "src", None if t is None else len(t), *[None] * len(clash)) for i, t, lang in rows]
    return spark.createDataFrame(data, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}")


@pytest.fixture
def empty(awkward):
    return awkward.limit(0)
