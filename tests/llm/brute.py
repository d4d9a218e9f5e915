"""Plain versions of the operators' contracts, one document at a time."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import xxhash

FOLDER = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def spaced(text):
    return SPACED.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licences(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    words, places, labels = alnum(text), [], set()
    for label, phrase in PHRASES.items():
        phrase = phrase.split()
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def contamination(docs, items, length=10):
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = collections.defaultdict(set)
    for item, text in items:
        words = alnum(text)
        n = min(len(words), length)
        for i in range(len(words) - n + 1) if n else ():
            windows[tuple(words[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = alnum(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = spaced(text)
    count = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if SPACED.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def removed(docs, length=50):
    """Per document: n_words, n_removed, kept_sha256."""
    origin = {}
    for doc, text in docs:
        words = spaced(text)
        for i in range(len(words) - length + 1) if doc is not None else ():
            key = tuple(words[i : i + length])
            origin[key] = min(doc, origin.get(key, doc))
    out = []
    for doc, text in docs:
        words, gone = spaced(text), set()
        for i in range(len(words) - length + 1) if doc is not None else ():
            if origin[tuple(words[i : i + length])] < doc:
                gone.update(range(i, i + length))
        out.append((doc, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def simhash(text, k=3):
    words = spaced((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(prints, radius):
    """doc -> smallest doc reachable over links of at most ``radius`` bits; ``prints`` is a list of (doc, fp)."""
    prints = sorted(prints)
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([f for _, f in prints], np.uint64)
    for n, (doc, _) in enumerate(prints):
        for m in np.flatnonzero(np.bitwise_count(values[:n] ^ values[n]) <= radius):
            a, b = find(prints[m][0]), find(doc)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}


def similar(texts, k, least):
    """doc -> smallest doc reachable over pairs that share ``least`` of their k-word shingles; ``texts`` is a dict."""
    sets = {}
    for doc, text in texts.items():
        words = alnum(text)
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(texts)
    for n, b in enumerate(order):
        for a in order[:n]:
            shared = len(sets[a] & sets[b])
            if shared >= least * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}
