"""Periodic runs: harmonic grid probing.

Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0.  A run is a stretch of words with
smallest period q (words q apart are the same) and at least max(12, 2q) words,
which no neighbouring word extends.  For every period p the words at jp and
(j + 1)p are compared: a run of period p has two such grid points, and there are
about n ln n of them in all.  Equal pairs are survivors; those whose equal
stretch is too short within a few words are dropped together, the others are
extended to both sides by comparing chunks of doubling length.  Periods go
upwards, and once a run of period q is known, the grid points of multiples of q
inside it are skipped: what they would find is that run.  So every run is found
with its smallest period, and once.

A text is worked on alone, in memory in proportion to its length: words become
numbers by a dictionary of that text (no hashes), and grid points come in pieces
of at most `PAIRS`.  No row meets another, so nothing is shuffled.

Defined results: null and empty texts have no words and no run; a null id leaves
a text undamaged; repeated rows give equal rows; an empty table gives no rows;
columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a run; of equal stretches, words to each side that all survivors are compared on at first; grid points at a time.
LEAST, NEAR, PAIRS = 12, 6, 1 << 20


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for every word, equal just for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def looped(n: int, doc_id: int | str) -> np.ndarray | None:
    """For the texts that are damaged, by crc32 of the id: which of the n words stands at each place; else None."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def need(p):
    """Fewest neighbours i with equal words at i and i + p in a run of period p."""
    return np.maximum(LEAST - p, p)


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(j * p, p) of all periods p of a text of n words, upwards, in pieces."""
    p = 1
    while p <= n // 2:
        stop = int(min(n // 2 + 1, max(p + 1, p + PAIRS * p // n)))
        periods = np.arange(p, stop)
        points = (n - 1) // periods
        each = np.repeat(periods, points)
        j = np.arange(len(each)) - np.repeat(np.cumsum(points) - points, points)
        yield j * each, each
        p = stop


def survivors(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points with equal words whose equal stretch may be long enough, upwards by period."""
    n = len(ids)
    for at, p in grid(n):
        same = np.flatnonzero(ids[at] == ids[at + p])
        at, p = at[same], p[same]
        total, open_end = np.ones(len(at), np.int64), np.zeros(len(at), bool)
        for side in (-1, 1):
            alive = np.arange(len(at))
            for k in range(1, NEAR + 1):
                i = at[alive] + side * k
                inside = (i >= 0) & (i + p[alive] < n)
                alive, i = alive[inside], i[inside]
                alive = alive[ids[i] == ids[i + p[alive]]]
                total[alive] += 1
                if not len(alive):
                    break
            open_end[alive] = True
        good = open_end | (total >= need(p))
        yield at[good], p[good]


def reach(ids: np.ndarray, at: int, p: int, side: int) -> int:
    """How many places from `at` on, `at` itself left out, go on with equal words p apart, to one side."""
    done, size, n = 0, 16, len(ids)
    while True:
        if side > 0:
            a = at + 1 + done
            b = min(a + size, n - p)
            differ = np.flatnonzero(ids[a:b] != ids[a + p : b + p]) if a < b else ()
            if len(differ):
                return done + int(differ[0])
        else:
            b = at - done
            a = max(b - size, 0)
            differ = np.flatnonzero(ids[a:b] != ids[a + p : b + p]) if a < b else ()
            if len(differ):
                return done + b - a - 1 - int(differ[-1])
        if a >= b:
            return done
        done, size = done + b - a, size * 2


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    by_period: dict[int, list[tuple[int, int]]] = {}
    longest: dict[int, int] = {}
    for points, periods in survivors(ids):
        edges = np.append(np.flatnonzero(np.diff(periods, prepend=-1)), len(periods))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            q, at = int(periods[a]), points[a:b]
            around = sorted(x for d, known in by_period.items() if q % d == 0 and longest[d] > q for x in known if x[1] - x[0] > q)
            if around:  # of the runs that start at or before a point, the furthest end tells whether one holds both points
                starts, ends = np.array(around).T
                last = np.searchsorted(starts, at, "right") - 1
                at = at[~((last >= 0) & (np.maximum.accumulate(ends)[last] > at + q))]
            k = 0
            while k < len(at):
                i = int(at[k])
                start = i - reach(ids, i, q, -1)
                stop = i + 1 + reach(ids, i, q, 1) + q
                if stop - start - q >= need(q):
                    by_period.setdefault(q, []).append((start, stop))
                    longest[q] = max(longest.get(q, 0), stop - start)
                k = int(np.searchsorted(at, stop - q))
    return sorted(((s, e - s, q) for q, known in by_period.items() for s, e in known), key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def described(text: str | None, doc_id: int | str | None = None) -> tuple:
    """The row of one text, damaged by its id if there is one."""
    words = (text or "").encode().split()  # of bytes: at 0x20 and 0x09-0x0D
    ids, n = numbered(words), len(words)
    at = looped(n, doc_id) if doc_id is not None else None
    if at is not None:
        ids, words = ids[at], [words[k] for k in at.tolist()]
    found = runs(ids) if n >= LEAST else []
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
    left = b" ".join(words[k] for k in np.flatnonzero(kept(n, found)).tolist()) if found else b" ".join(words)
    largest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *largest, digest, hashlib.sha256(left).hexdigest(), [{"start": s, "length": m, "period": q} for s, m, q in found], left.decode()


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"
KINDS = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", damage: bool = False) -> DataFrame:
    """(id, n_runs, start, length, period and exponent_milli of the longest run, runs_sha256, collapsed_sha256, runs, collapsed) of every row.

    `collapsed` has the words that no run repeats, one space apart.  `damage` makes
    a tenth of the texts periodic first, by their ids.
    """
    kind, names = docs.schema[id_col].dataType.simpleString(), [f.split()[0] for f in FIELDS.replace("array<struct<start: long, length: long, period: long>>", "x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # the results are as long as the texts
                part = batch.slice(a, 256)
                rows = [described(t.as_py(), i.as_py() if damage else None) for i, t in zip(part.column(0), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True))], ["_id", *names])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, {FIELDS}").withColumnRenamed("_id", id_col)
