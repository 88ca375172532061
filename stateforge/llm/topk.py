"""Exact top-k search by distributed histogram selection.

Components become floor(256 * x) and a score is the integer inner product.
Queries and candidates are dealt to a grid of groups of bounded size, and each
grid cell scores its queries against its candidates as one matrix product.  A
pass counts the scores of a query in `BINS` equal bins of an interval; the sums
over all cells show which bin holds the k-th largest score, and the next pass
looks into that bin, until bins are single values.  A cell leaves out bins that
lie below its own k-th score, as the global one is no lower.  A last pass keeps
what scores above the k-th value and, of those equal to it, each cell's k
smallest ids; ties go to the smaller id.

Defined results: vectors that are null or hold null or non-finite components, and
rows without id, take no part; a shorter vector counts as
filled with zeros, an empty one is all zeros; a query's own id is no candidate
for it; repeated rows are candidates (and queries) of their own; other columns
are ignored.  Pairs with a vector of a length of 2**31 or more (after the scaling),
whose scores may not fit 64 bits, are scored with integers of any size, in
cells of their own; one of a query's k best that doesn't fit is an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateforge.llm import kit

BINS = 4096
#: The length from which a vector's scores may leave 64 bits, and vectors of a cell that meets such ones.
LONG, LONG_CELL = 2.0**31, 1024
#: Most vectors and queries of a grid cell, and scores held at a time.
CELL_VECTORS, CELL_QUERIES, SCORES = 65_536, 8_192, 2_000_000


def packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vec, norm): the usable rows, their components as packed 64-bit integers, or of a length of LONG or more as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, norms = [], [], []
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                if not i.is_valid or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(scale * v.values.cast(pa.float64()).to_numpy(zero_copy_only=False))
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    norm = float(np.linalg.norm(x))
                ids.append(i.as_py())
                vecs.append((x.astype(np.int64) if norm < LONG else x).tobytes())
                norms.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(norms, pa.float64())], ["id", "vec", "norm"])

    return vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_vec")).mapInArrow(run, "id long, vec binary, norm double")


def matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, x in enumerate(column):
        v = np.frombuffer(x.as_buffer(), np.int64)
        out[k, : len(v)] = v
    return out


def scored(left: pa.Table, right: pa.Table, width: int, exact: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Blocks of (queries, their scores against all candidates, which are not their own)."""
    kind = np.float64 if exact else np.int64
    q, c = matrix(left["vec"], width).astype(kind), matrix(right["vec"], width).astype(kind)
    qid, cid = left["qid"].to_numpy(), right["id"].to_numpy()
    step = max(1, SCORES // max(1, len(c)))
    for a in range(0, len(q), step):
        part = slice(a, min(a + step, len(q)))
        yield part, (q[part] @ c.T).astype(np.int64), qid[part, None] != cid[None, :]


NONE = -(1 << 62)


def whole(column, long: np.ndarray) -> list[np.ndarray]:
    """Vectors as arrays of Python's integers."""
    return [np.array([int(v) for v in np.frombuffer(x.as_buffer(), np.float64 if is_long else np.int64).tolist()], object) for x, is_long in zip(column, long, strict=True)]


def _long(asking: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(q, query_id, id, score, over): the k best candidates of each query within each cell, by integers of any size; `over` says that the score doesn't fit 64 bits."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids = right["id"].to_pylist()
            others = whole(right["vec"], right["norm"].to_numpy() >= LONG)
            for q, qid, x in zip(left["q"].to_pylist(), left["qid"].to_pylist(), whole(left["vec"], left["norm"].to_numpy() >= LONG), strict=True):
                scores = ((int(x[: len(y)] @ y[: len(x)]) if len(x) and len(y) else 0, i) for i, y in zip(ids, others, strict=True) if i != qid)
                for score, i in heapq.nsmallest(k, scores, key=lambda s: (-s[0], s[1])):
                    held = max(-(1 << 63), min(score, (1 << 63) - 1))
                    out.append((q, qid, i, held, held != score))
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("q", "query_id", "id", "score", "over"), zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)})

    cells = [max(1, -(-df.count() // LONG_CELL)) for df in (asking, candidates)]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in cells]
    left = asking.select("q", "qid", "vec", "norm", F.pmod("q", F.lit(cells[0])).cast("int").alias("h"), every[1].alias("g"))
    right = candidates.select("id", "vec", "norm", F.pmod(F.xxhash64("id", "vec"), F.lit(cells[1])).cast("int").alias("g"), every[0].alias("h"))
    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(run, "q long, query_id long, id long, score long, over boolean")


def top_k(vectors: DataFrame, is_query, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of every row for which the column `is_query` (of the id) is true."""
    spark = vectors.sparkSession
    every = kit.written(packed(vectors, id_col, vector_col, scale), "vectors", compact=False)
    rows = every.where(F.col("norm") < LONG)
    asking = kit.written(every.where(is_query(F.col("id"))).select(F.col("id").alias("qid"), "vec", "norm").withColumn("q", F.monotonically_increasing_id()), "queries")
    queries = asking.where(F.col("norm") < LONG)
    n, largest, width = rows.agg(F.count("id"), F.max("norm"), F.max(F.length("vec") / 8)).head()
    nq, q_largest = queries.agg(F.count("q"), F.max("norm")).head()
    bound = math.ceil((largest or 0.0) * (q_largest or 0.0)) + 1
    width, exact = int(width or 0), bound < 1 << 52
    cores = spark.sparkContext.defaultParallelism
    across = max(-(-n // CELL_VECTORS), min(2 * cores, -(-n // 512)), 1)
    down = max(-(-nq // CELL_QUERIES), 1)
    candidates = rows.withColumn("g", F.pmod(F.xxhash64("id", "vec"), F.lit(across))).select("g", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("h"), "id", "vec")
    asked = queries.withColumn("h", F.pmod(F.col("q"), F.lit(down)).cast("int"))

    def grid(state: DataFrame, run, schema: str) -> DataFrame:
        left = asked.join(state, "q").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("g"), "h", "q", "qid", "vec", "low")
        return left.groupBy("g", "h").cogroup(candidates.groupBy("g", "h")).applyInArrow(run, schema)

    def counter(step: int, span: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, bins, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if left.num_rows and right.num_rows:
                low, q = left["low"].to_numpy(), left["q"].to_numpy()
                for part, s, other in scored(left, right, width, exact):
                    at = low[part, None]
                    s = np.where(other & (s >= at) & (s < at + span), s, NONE)
                    own = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)] if s.shape[1] > k else np.full(len(s), NONE)
                    floor = np.where(own > NONE, at[:, 0] + (own - at[:, 0]) // step * step, at[:, 0])
                    r, c = np.nonzero(s >= floor[:, None])
                    keys, n = np.unique(r * BINS + (s[r, c] - low[part][r]) // step, return_counts=True)
                    ids.append(q[part][keys // BINS])
                    bins.append(keys % BINS)
                    counts.append(n.astype(np.int64))
            return pa.table({"q": np.concatenate(ids), "bin": np.concatenate(bins), "n": np.concatenate(counts)})

        return run

    state = queries.select("q", F.lit(-bound).cast("long").alias("low"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("few"))
    span = 2 * bound + 1
    while True:
        step = max(1, -(-span // BINS))
        counts = grid(state, counter(step, span), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # the k-th largest is in the first bin from above with which the count comes to k
        running = counts.join(state, "q").withColumn("sum", F.col("above") + F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin"))))
        found = running.where((F.col("sum") >= k)).groupBy("q").agg(F.max(F.struct("bin", (F.col("sum") - F.col("n")).alias("above"))).alias("x"))
        state = state.join(found, "q", "left").select("q", F.when(F.col("few") | F.col("x").isNull(), F.lit(-bound)).otherwise(F.col("low") + F.col("x.bin") * step).cast("long").alias("low"), F.coalesce("x.above", "above").alias("above"), (F.col("few") | F.col("x").isNull()).alias("few"))
        state = kit.written(state, "thresholds")
        if step == 1:
            break
        span = step

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right["id"]))
            low, q, qid, cid = (x.to_numpy() for x in (left["low"], left["q"], left["qid"], right["id"]))
            for part, s, other in scored(left, right, width, exact):
                equal = other & (s == low[part, None])
                r, c = np.nonzero(other & (s > low[part, None]) | equal & (np.cumsum(equal, axis=1) <= k))
                out.append((q[part][r], qid[part][r], cid[c], s[r, c]))
        return pa.table(dict(zip(("q", "query_id", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    kept = grid(state, keep, "q long, query_id long, id long, score long")
    score = F.col("score")
    if every.where(F.col("norm") >= LONG).limit(1).count():
        score = F.when(F.col("over"), F.raise_error(F.concat(F.lit("the score of "), F.col("query_id"), F.lit(" and "), F.col("id"), F.lit(" doesn't fit 64 bits"))).cast("long")).otherwise(score).alias("score")
        kept = kept.withColumn("over", F.lit(False)).unionByName(_long(asking, every.where(F.col("norm") >= LONG), k)).unionByName(_long(asking.where(F.col("norm") >= LONG), rows, k))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), score)
