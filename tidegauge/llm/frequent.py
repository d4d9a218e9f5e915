"""The most frequent entries of a count table, at most a given number of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: steps of the count axis for each doubling
STEPS = 16
#: cells of one step, and of the hash that orders equal counts
CELLS = 1 << 16


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The ``most`` entries with the largest counts ``n``; all of them if there are fewer.

    Entries with equal counts follow in the order of a hash of their other columns, so the
    table is full whatever the ties, and the same for any partitioning.  A histogram of the
    logarithm of the counts (about a thousand rows) tells which step does not fit whole, one
    of that step which count, and one of the hash which cell (65,536 rows at most each); only
    the entries of one such cell are sorted.  A sort of all with a limit would make every
    task send its own first ``most`` rows to one place.
    """
    others = [c for c in counts.columns if c != n]
    place = F.log2(F.col(n)) * STEPS
    tie = F.xxhash64(*others)
    cells = [F.floor(place), F.floor((place - F.floor(place)) * CELLS), F.shiftrightunsigned(tie, 48)]
    room, split, whole = most, F.lit(True), F.lit(False)
    for cell in cells:
        bars = counts.where(split).groupBy(cell.alias("cell")).agg(F.count("*").alias("entries")).collect()
        cut = None
        for bar in sorted(bars, key=lambda r: -r["cell"]):
            if bar["entries"] > room:
                cut = bar["cell"]
                break
            room -= bar["entries"]
        if cut is None:
            return counts.where(whole | split)
        whole, split = whole | (split & (cell > cut)), split & (cell == cut)
    rest = counts.where(split).orderBy(tie, *others).limit(room)
    return counts.where(whole).unionByName(rest)
