"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words.  Sources are ordered by code point (null last) and take the
weights in turn; they share `share` times all words by weight, a source stops
at `repeats` times its own words, and what it leaves is shared again.

Documents are dealt to shards by a seeded hash; a source is spread over only as
many shards as it has `CELL_WORDS` words or `CELL_ROWS` rows, so a (shard, source)
cell is of bounded size however large the source is and however short its texts.  In each shard, seats are blocks of
equally many words: they go to the sources one by one by the highest quotient
of a source's target there over 1, 3, 5, ... (computed with a divisor, which
gives the same seats).  A cell's documents stand in seeded order, cut into
blocks; each block is taken (seats div blocks) times, and the seats left over
pick blocks at even steps from a seeded place.  A document's `taken` words are
those of its part of these blocks: closed arithmetic, no row a block.

Defined results: a null or empty text has size 0 and nothing taken; a null
source is a source; repeated rows are documents of their own; an empty table
gives an empty result; columns beside id, source and text are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateforge.llm import kit

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words of a block (at most; less where the smallest source has under 256 blocks), words and rows of a cell; rows of the source table that are broadcast.
BLOCK_WORDS, CELL_WORDS, CELL_ROWS, SEED, BROADCAST_SOURCES = 64, 1 << 16, 1 << 14, 20, 100_000


def apportion(weights: np.ndarray, limits: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë: `seats` seats by highest quotients weight / (2 k + 1), a party getting `limits` at most; ties to the earlier."""
    weights, limits = np.asarray(weights, float), np.asarray(limits, np.int64)
    if seats >= limits[weights > 0].sum():
        return np.where(weights > 0, limits, 0)
    got = lambda q: np.minimum(limits, np.floor((weights / q + 1) / 2)).astype(np.int64)  # noqa: E731  quotients of q or more
    low, high = weights.sum() / (4.0 * seats + 4 * len(weights)), weights.max() * 2 if len(weights) else 1.0
    while got(low).sum() < seats:
        low /= 4
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if got(middle).sum() <= seats else (middle, high)
    out = got(high)
    queue = [(-weights[i] / (2 * out[i] + 1), i) for i in np.flatnonzero((out < limits) & (weights > 0))]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < limits[i]:
            heapq.heappush(queue, (-weights[i] / (2 * out[i] + 1), i))
    return out


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) with `sid` (rank), `weight` and `target`; a row a source.

    With sources by size / weight, the first i that the level reached by all
    others, (total - limits before i) / (weights from i on), doesn't fill
    decides the level; a target is the lesser of limit and level * weight.
    """
    ranked = sources.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    limit = (F.col("source_size") * repeats).cast("double")
    order = W.orderBy(limit / F.col("weight"), "sid")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) * share - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("_level", level)
    reached = F.min(F.when(limit >= F.col("_level") * F.col("weight"), F.struct((limit / F.col("weight")).alias("r"), "sid", "_level"))).over(W.partitionBy())["_level"]
    return ranked.withColumn("target", F.least(limit, F.coalesce(reached * F.col("weight"), limit))).drop("_level")


def sized(docs: DataFrame, *, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, size, h): words and a seeded hash of each document."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        hashed(id_col, source_col, text_col).alias("h"),
    )


def hashed(id_col: str, source_col: str, text_col: str):
    """A document's place in its cell; the same for rows equal in id, source and text."""
    return F.xxhash64(F.lit(SEED), F.col(id_col), F.col(source_col), F.col(text_col))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, cell_words: int = CELL_WORDS, cell_rows: int = CELL_ROWS, with_hash: bool = False) -> DataFrame:
    """(id, size, source_size, target, taken, shard[, sid, h]) of every row; `h` is `hashed`, and (shard, sid) its cell."""
    rows = kit.written(sized(docs, id_col=id_col, source_col=source_col, text_col=text_col), "sized", compact=False)
    sources = kit.written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), weights, share, repeats), "sources")
    spread = F.greatest(F.lit(1), F.ceil(F.col("source_size") / cell_words), F.ceil(F.col("source_rows") / cell_rows))
    most, least = sources.agg(F.max(spread), F.min(F.when(F.col("source_size") > 0, F.col("source_size")))).head()
    block = max(1, min(block_words, (least or 1) // 256))
    shards = most or 1
    known = kit.bounded_broadcast(sources.withColumnRenamed("source", "_source"), BROADCAST_SOURCES)
    dealt = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(F.pmod(F.xxhash64(F.lit(SEED), "sid"), F.lit(shards)) + F.pmod(F.col("h"), spread), F.lit(shards)).cast("long"))
    dealt = dealt.select("id", "size", "h", "sid", "source_size", "target", "shard")

    def seats(table: pa.Table) -> pa.Table:
        table = table.sort_by("sid")
        words, want = table["words"].to_numpy(), table["want"].to_numpy()
        blocks = -(-words // block)
        n = apportion(want, blocks * repeats, int(np.floor(want.sum() / block + 0.5)))
        return pa.table({"_shard": table["shard"], "_sid": table["sid"], "seats": pa.array(n, pa.int64())})

    cells = dealt.groupBy("shard", "sid").agg(F.sum("size").alias("words"), F.max(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("_rate")).withColumn("want", F.col("words") * F.col("_rate"))
    quotas = cells.groupBy("shard").applyInArrow(seats, "_shard long, _sid int, seats long")

    cell = W.partitionBy("shard", "sid")
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(cell.orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("words", F.sum("size").over(cell))
    placed = placed.join(quotas, (F.col("shard") == F.col("_shard")) & (F.col("sid") == F.col("_sid")))
    placed = placed.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / block))).withColumn("_from", F.pmod(F.xxhash64(F.lit(SEED + 1), "shard", "sid"), F.col("blocks")))

    def until(x):
        """Words taken of the first x of the cell."""
        full, rest = F.floor(x / block), x % block
        picked = lambda b: F.floor((b * (F.col("seats") % F.col("blocks")) + F.col("_from")) / F.col("blocks"))
        return F.floor(F.col("seats") / F.col("blocks")) * x + block * picked(full) + rest * (picked(full + 1) - picked(full))

    taken = (until(F.col("start") + F.col("size")) - until(F.col("start"))).cast("long")
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "shard", *["sid", "h"] * with_hash)


def whole(sizes: list[int], taken: list[int], repeats: int = REPEATS) -> list[int]:
    """How often each of a cell's documents, in their order, is drawn: what a draw is short of or beyond `taken` goes over to the next one, so the words drawn are within a document of those taken.  Documents without words are drawn once."""
    out, owed = [], 0
    for size, words in zip(sizes, taken, strict=True):
        owed += words
        times = min(repeats, max(0, (2 * owed + size) // (2 * size))) if size else 1
        owed -= times * size
        out.append(times)
    return out


def drawn(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of `docs`, all columns, each as often as it is drawn (0 to REPEATS times).

    Whole documents are drawn by the running sum of the words that the mix takes
    of their cell (`whole`).  Rows equal in id, source and text are one document,
    drawn as often as all of them together; documents without words stay.
    """
    taken = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, with_hash=True).select("shard", "sid", F.col(id_col).alias("id"), "h", "size", "taken")
    kind = docs.schema[id_col].dataType.simpleString()

    def cell(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("id", "ascending")])
        return pa.table({"id": table["id"], "h": table["h"], "times": pa.array(whole(table["size"].to_pylist(), table["taken"].to_pylist()), pa.int32())})

    times = taken.groupBy("shard", "sid").applyInArrow(cell, f"id {kind}, h long, times int")
    times = kit.written(times.groupBy(F.col("id").alias("__mix_id"), F.col("h").alias("__mix_h")).agg(F.sum("times").alias("__mix_times"), F.count("h").alias("__mix_rows")), "times")
    rows = docs.withColumn("__mix_hash", hashed(id_col, source_col, text_col))
    found = rows.join(times.hint("shuffle_hash"), (F.col("__mix_hash") == F.col("__mix_h")) & F.col(id_col).eqNullSafe(F.col("__mix_id")))
    if times.where(F.col("__mix_rows") > 1).limit(1).count():
        found = found.groupBy("__mix_id", "__mix_h").agg(F.max("__mix_times").alias("__mix_times"), F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__mix_row"))
        found = found.select("__mix_row.*", "__mix_times")
    return found.where(F.col("__mix_times") > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).select(*docs.columns)
