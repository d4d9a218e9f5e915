"""Secret scan: candidates by rule, false positives removed by a random forest.

Candidates are values assigned to a credential-like name, and long runs of letters and
digits anywhere.  Each becomes a row of numbers: length, character transitions (how likely
they are inside dictionary words, how often the kind of character changes), coverage by
dictionary words, the document's path, and the neighbouring words.  A random forest trained
on labelled findings decides which candidates are secrets.

Labelled findings are a table (value, left, right, path, label).  ``seed_findings`` makes
a bounded set from rules: credential formats with assignments around them, against hashes,
identifiers, placeholders, paths and words.  The dictionary is the ``dictionary_words``
most frequent words over all documents (seen twice at least), so what tasks receive does not grow.

Rows: null texts have no findings; empty and repeated rows are scanned like others; empty
tables give an empty dictionary and no findings; all columns are kept.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bytewords import slices
from tidegauge.llm.frequent import most_frequent
from tidegauge.session import stage

DICTIONARY_WORDS = 20_000
FINDINGS = 6_000
TREES = 40
MASK = "<SECRET>"

#: fixed values: names that credentials are assigned to, words that speak against one
NAMES = "token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|private[_-]?key|client[_-]?key"
PLACEHOLDERS = re.compile(r"example|sample|dummy|placeholder|changeme|your|fake|test|todo|none|null|xxxx|1234|abcd|<|\{", re.I)
HASH_WORDS = re.compile(r"\b(sha|sha1|sha256|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|build|version|isbn|id)\b", re.I)
TEST_PATHS = re.compile(r"test|example|sample|doc|mock|fixture", re.I)
CONFIG_PATHS = re.compile(r"\.env|\.ya?ml|\.ini|\.cfg|\.conf|\.properties|\.tf|secret|config", re.I)

ASSIGNED = re.compile(rf"(?:{NAMES})[\w.\-]*[^\w\n]{{0,6}}[=:][^\w\n]{{0,8}}([^\s\"'`,;<>]{{8,}})", re.I)
BARE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_\-]{19,}={0,2}")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)
NAMED = re.compile(rf"(?:{NAMES})", re.I)
TAIL = ".,;:!?)]}|*$%&#"
CONTEXT = 48

FEATURES = [
    "length", "word_transitions", "kind_changes", "dictionary", "entropy", "digits", "upper", "hex", "longest_run", "distinct",
    "named", "assigned", "quoted", "placeholder", "hash_word", "test_path", "config_path", "key_block",
]


def candidates(text: str) -> list[tuple[int, int]]:
    """Non-overlapping (start, end) of candidate values, in order."""
    found: dict[int, int] = {}
    if "=" in text or ":" in text:
        for m in ASSIGNED.finditer(text):
            value = m.group(1).rstrip(TAIL)
            if len(value) >= 8:
                found[m.start(1)] = m.start(1) + len(value)
    if "-----BEGIN" in text:
        found.update((m.start(), m.end()) for m in PRIVATE_KEY.finditer(text))
    for m in BARE.finditer(text):
        value = m.group()
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            found.setdefault(m.start(), m.end())
    out: list[tuple[int, int]] = []
    for start, end in sorted(found.items()):
        if not out or start >= out[-1][1]:
            out.append((start, end))
        elif end > out[-1][1]:
            out[-1] = (out[-1][0], end)
    return out


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _letter(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26 if c.isdigit() else 27


@dataclass
class Lexicon:
    """Dictionary words and the log chance of each character transition inside them."""

    words: frozenset[str]
    longest: int
    transitions: np.ndarray

    @classmethod
    def of(cls, counted: list[tuple[str, int]]) -> Lexicon:
        pairs = np.full((28, 28), 0.5)
        for word, n in counted:
            for a, b in zip(word, word[1:], strict=False):
                pairs[_letter(a), _letter(b)] += math.log1p(n)
        words = frozenset(w for w, _ in counted if len(w) >= 3)
        return cls(words, max(map(len, words), default=0), np.log(pairs / pairs.sum(axis=1, keepdims=True)))

    def coverage(self, value: str) -> float:
        """Share of characters that greedy dictionary words cover."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            size = next((n for n in range(min(self.longest, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            covered += size
            at += size or 1
        return covered / max(1, len(low))


def describe(value: str, left: str, right: str, path: str, lexicon: Lexicon) -> list[float]:
    """The numbers FEATURES of one candidate, over its whole value."""
    n = max(1, len(value))
    low = value.lower()
    kinds = [kind(c) for c in value]
    counts = Counter(value)
    letters = np.array([_letter(c) for c in low], np.int64)
    steps = lexicon.transitions[letters[:-1], letters[1:]]
    longest = max((sum(1 for _ in same) for _, same in groupby(value)), default=1)
    near = left[-CONTEXT:]
    return [
        math.log2(n), float(np.mean(steps)) if len(steps) else 0.0,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, lexicon.coverage(value),
        -sum(v / n * math.log2(v / n) for v in counts.values()), kinds.count(2) / n, kinds.count(1) / n,
        float(all(c in "0123456789abcdef" for c in low)), longest / n, len(counts) / n,
        float(bool(NAMED.search(near))), float(bool(re.search(r"[=:][^\w]*$", near))), float(near[-1:] in ("'", '"', "`") and near != ""),
        float(bool(PLACEHOLDERS.search(value)) or bool(PLACEHOLDERS.search(near[-16:]))), float(bool(HASH_WORDS.search(near)) or bool(HASH_WORDS.search(right[:16]))),
        float(bool(TEST_PATHS.search(path))), float(bool(CONFIG_PATHS.search(path))),
        float(value.startswith("-----BEGIN")),
    ]


def seed_findings(n: int = FINDINGS, seed: int = 42) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, left, right, path, label) made by rule, half of each label."""
    rng = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "config value server client result data load store model user time line point group state index table field".split()
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    prose = lambda: " ".join(rng.choice(words) for _ in range(3))
    paths = ["src1", "src7", "app/settings.yml", "lib/main.py", "deploy/.env", "notes.txt", "service.go", "web/index.html"]
    names = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "TOKEN", "API_KEY", "private_key"]
    block = lambda lines: "\n".join(draw(alnum + "+/", 64) for _ in range(lines))
    signs = [' = "', " = '", "=", ": ", ': "', ' := "', "!! =!! \""]
    out = []
    for i in range(n):
        if i % 2:
            value = rng.choice([
                lambda: draw(hexes, rng.choice([32, 40, 64])), lambda: draw(hexes, rng.choice([32, 40, 64])).upper(), lambda: draw(alnum, rng.randint(16, 48)),
                lambda: draw(alnum + "+/", rng.randint(24, 64)) + "==", lambda: "AKIA" + draw(alnum[:26] + "0123456789", 16), lambda: "ghp_" + draw(alnum, 36),
                lambda: "sk-" + draw(alnum, 40), lambda: draw(alnum + "!#$%&*", rng.randint(10, 20)), lambda: draw(alnum + "+/", rng.randint(200, 2000)),
                lambda: f"-----BEGIN {rng.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n{block(rng.randint(3, 40))}\n-----END PRIVATE KEY-----"])()
            bare = value.startswith("-----") or value.startswith(("AKIA", "ghp_", "sk-")) and rng.random() < 0.4
            left = prose() + " " + ("" if bare else rng.choice(names) + rng.choice(signs))
            out.append((value, left, '" ' + prose(), rng.choice(paths), 1))
            continue
        shape = rng.randrange(8)
        left, path = prose() + " ", rng.choice(paths)
        if shape == 0:  # hashes and ids without a credential's name
            value = draw(hexes, rng.choice([32, 40, 64]))
            left += rng.choice(["", "commit ", "sha256: ", "md5 = ", "checksum ", "digest: ", "id=", "etag: \""])
        elif shape == 1:
            value = "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12))
            left += rng.choice(["", "uuid ", "id = \"", "session "])
        elif shape == 2:  # placeholders
            value = rng.choice(["your_token_here", "xxxxxxxxxxxxxxxx", "changeme123", "example-token-1234", "placeholder_value", "<your-api-key>", "${SECRET_TOKEN}", "test_password_1", "dummy-secret-0000", "os.environ[TOKEN]"])
            left += rng.choice(names) + rng.choice(signs)
        elif shape == 3:
            value = "/".join(rng.choice(words) for _ in range(4)) + f"/v{rng.randint(1, 9)}"
        elif shape == 4:
            value = "".join(rng.choice(words).title() for _ in range(4)) + str(rng.randint(0, 99))
        elif shape == 5:  # plain words after a name
            value = rng.choice(["required", "invalid", "expired", "generated", "configuration", "authentication"]) + rng.choice(["", "Error", "_value", "Handler"])
            left += rng.choice(names) + rng.choice([": ", " = "])
        elif shape == 6:  # embedded files and dumps
            value = draw(rng.choice([hexes, alnum + "+/"]), rng.randint(200, 2000))
            left += rng.choice(["", "data:image/png;base64,", "src=\"data:font/woff;base64,", "body: ", "dump = "])
        else:
            value = "".join(rng.choice(words) for _ in range(5)) + rng.choice(["", "2", "_01"])
        out.append((value, left, " " + prose(), rng.choice(["tests/test_app.py", "docs/example.md", path, path]), 0))
    return out


class RandomForest:
    """Gini trees on bootstrap rows and random statistics; trees are arrays."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = 10, seed: int = 42) -> RandomForest:
        random_ = np.random.default_rng(seed)
        some = max(1, round(math.sqrt(x.shape[1])))
        grown = []
        for _ in range(trees):
            feature, place, left, right, share = [], [], [], [], []
            todo = [(random_.integers(len(x), size=len(x)), 0, None)]
            while todo:
                rows, level, parent = todo.pop()
                at, p = len(feature), float(y[rows].mean())
                if parent is not None:
                    (left if parent[1] else right)[parent[0]] = at
                best = None
                if level < depth and 0 < p < 1 and len(rows) >= 4:
                    for f in random_.choice(x.shape[1], some, replace=False):
                        order = np.argsort(x[rows, f], kind="stable")
                        values, hits = x[rows[order], f], np.cumsum(y[rows[order]])
                        cut = np.flatnonzero(np.diff(values) > 0)
                        if not len(cut):
                            continue
                        n1, n = cut + 1.0, float(len(rows))
                        h1, h = hits[cut], float(hits[-1])
                        cost = 2 * (h1 - h1**2 / n1 + (h - h1) - (h - h1) ** 2 / (n - n1))
                        k = int(cost.argmin())
                        if best is None or cost[k] < best[0]:
                            low, high = float(values[cut[k]]), float(values[cut[k] + 1])
                            best = (float(cost[k]), int(f), (low + high) / 2 if low < (low + high) / 2 <= high else high)
                feature.append(best[1] if best else -1)
                place.append(best[2] if best else 0.0)
                left.append(-1)
                right.append(-1)
                share.append(p)
                if best:
                    below = x[rows, best[1]] < best[2]
                    todo += [(rows[~below], level + 1, (at, False)), (rows[below], level + 1, (at, True))]
            grown.append(tuple(np.array(v) for v in (feature, place, left, right, share)))
        return cls(grown)

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, place, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            live = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
            while len(live):
                node = at[live]
                at[live] = np.where(x[live, feature[node]] < place[node], left[node], right[node])
                live = live[feature[at[live]] >= 0]
            total += share[at]
        return total / max(1, len(self.trees))


def lexicon_of(docs: DataFrame, size: int = DICTIONARY_WORDS) -> Lexicon:
    """The most frequent words of all documents; at most ``size`` rows reach the driver."""
    counted = stage(
        docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"\p{L}{3,24}"), F.lit(0))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    )
    return Lexicon.of(sorted((r["word"], r["n"]) for r in most_frequent(counted, "n", size).collect()))


def train(findings: list[tuple[str, str, str, str, int]], lexicon: Lexicon, seed: int = 42) -> RandomForest:
    x = np.array([describe(value, left, right, path, lexicon) for value, left, right, path, _ in findings])
    return RandomForest.fit(x, np.array([float(f[4]) for f in findings]), seed=seed)


def find(text: str, path: str, lexicon: Lexicon, forest: RandomForest) -> list[tuple[int, int, float]]:
    """(start, end, chance) of every candidate."""
    places = candidates(text)
    if not places:
        return []
    x = np.array([describe(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], path, lexicon) for a, b in places])
    return [(a, b, float(p)) for (a, b), p in zip(places, forest.chance(x), strict=True)]


def _scan(shared, least: float, text_at: int, path_at: int | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, forest = shared.value
        for batch in batches:
            for part in slices(batch, batch.schema.names[text_at]):
                texts = part.column(text_at).to_pylist()
                paths = part.column(path_at).to_pylist() if path_at is not None else [""] * len(texts)
                found = [[f for f in find(t, str(p or ""), lexicon, forest) if f[2] >= least] if t else [] for t, p in zip(texts, paths, strict=True)]
                masked = []
                for text, own in zip(texts, found, strict=True):
                    for a, b, _ in reversed(own):
                        text = text[:a] + MASK + text[b:]
                    masked.append(text)
                listed = pa.array([[{"start": a, "end": b, "chance": p, "value": t[a:b]} for a, b, p in own] for t, own in zip(texts, found, strict=True)],
                                  pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64()), ("value", pa.string())])))
                yield pa.record_batch([*part.columns, pa.array(masked, pa.string()), listed], names=[*names, "masked", "findings"])

    return run


def scan(docs: DataFrame, findings: list | None = None, least: float = 0.5, path: str | None = "source", dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """``docs`` in the struct ``record``, its masked text and its findings (start, end, chance, value)."""
    lexicon = lexicon_of(docs, dictionary_words)
    forest = train(findings if findings is not None else seed_findings(), lexicon)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, forest))
    path_at = 2 if path and path in docs.columns else None
    frame = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("text").cast("string").alias("text"),
        *([F.col(path).cast("string").alias("path")] if path_at else []))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(
        _scan(shared, least, 1, path_at, frame.columns),
        schema + ", masked string, findings array<struct<start:bigint,end:bigint,chance:double,value:string>>",
    ).select("record", "masked", "findings")


def op3_forest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a finding: doc_id, start and end in characters, chance, SHA-256 of the value."""
    found = scan(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(F.col("record.doc_id").alias("doc_id"), F.inline("findings")).select(
        "doc_id", "start", "end", F.round("chance", 9).alias("chance"), F.sha2("value", 256).alias("value_sha256"))
