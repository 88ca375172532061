"""From raw rows to prompts: alias columns, identities, first occurrences, seeded order, splits, counts."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateforge.functions import text
from stateforge.sources import shared

# The columns that a field may come under, in order of preference.
ALIASES = {
    "problem": ("problem", "prompt", "question"),
    "answer": ("answer", "reference_answer", "final_answer"),
    "source": ("source", "origin"),
    "subject": ("problem_type", "subject", "category"),
    "difficulty": ("level", "difficulty"),
    "solution": ("solution", "reference_solution"),
}
FLAGS = ("synthetic", "problem_is_valid", "solution_is_valid")


def aliased(df: DataFrame, field: str, default: str | None = None) -> Column:
    """The first non-blank of a field's columns that `df` has, stripped; else the default."""
    found = [F.col(c) for c in ALIASES[field] if c in df.columns]
    cols = [text.non_empty(*found)] if found else []
    return F.coalesce(*cols, F.lit(default)) if cols or default is not None else F.lit(None).cast("string")


def prompts(df: DataFrame, *, dataset: str = "local-fixture", revision: str = "local", split: str = "unassigned", keep: tuple[str, ...] = ()) -> DataFrame:
    """Prompt records of the rows that have a problem and an answer; `keep` columns (a row order) are carried along."""
    flags = F.to_json(F.struct(*((F.col(c) if c in df.columns else F.lit(None).cast("boolean")).alias(c) for c in sorted(FLAGS))), {"ignoreNullFields": "false"})
    out = df.select(
        *keep,
        aliased(df, "problem").alias("problem"),
        aliased(df, "answer").alias("reference_answer"),
        aliased(df, "solution").alias("reference_solution"),
        aliased(df, "subject", "unknown").alias("subject"),
        aliased(df, "difficulty", "unknown").alias("difficulty"),
        aliased(df, "source", dataset).alias("source"),
        F.lit(dataset).alias("source_dataset"),
        F.lit(revision).alias("source_revision"),
        F.lit(split).alias("split"),
        flags.alias("metadata"),
    ).where(F.col("problem").isNotNull() & F.col("reference_answer").isNotNull())
    identity = text.stable_hash(20, dataset=text.json_string(F.col("source_dataset")), problem=text.json_string(F.col("problem")), source=text.json_string(F.col("source")))
    return out.withColumn("sample_id", identity)


def dedup_key(problem: Column) -> Column:
    """What makes two problems the same: the hash of the stripped, lower-case text."""
    return text.stable_hash(problem=text.json_string(F.lower(text.strip(problem))))


def first_occurrences(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, by an order that is total.

    An aggregation over (order, row) rather than a window: it combines before
    the shuffle, so a key that a third of all rows share is no hot spot.
    """
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


#: Rows whose numbers are broadcast, so that those of texts needn't be shuffled to be dropped.
NUMBERS_HELD = 1 << 20


def only_first(df: DataFrame, key: Column, order: list[str], row: str = "row") -> tuple[DataFrame, DataFrame]:
    """(rows, numbers): what `first_occurrences` gives, in the columns of `df`, and their `row` numbers (unique, and last in the order).

    Keys and numbers alone are shuffled.  The numbers of the rows that go, or that
    stay where these are fewer, meet the rows by broadcast while they are few.
    """
    keyed = df.select(F.unhex(key).alias("_key"), F.struct(*dict.fromkeys([*order, row])).alias("_at"))
    first = shared.table(keyed.groupBy("_key").agg(F.min("_at").alias("_at")).select(F.col(f"_at.{row}").alias(row)))
    n, of = first.count(), df.count()
    kept = n <= of - n
    numbers = first if kept else shared.table(df.select(row).join(first, row, "left_anti"))
    return df.join(F.broadcast(numbers) if min(n, of - n) <= NUMBERS_HELD else numbers, row, "left_semi" if kept else "left_anti"), first


def permuted(df: DataFrame, order: list[str], seed: int, cut: bool = True) -> DataFrame:
    """`df` with `position`: a scalable seeded order (hash of seed and rank keys, ties by the keys)."""
    return ranked(df, [F.xxhash64(F.lit(seed), *order), *map(F.col, order)], "position", cut=cut)


#: Rows that one task numbers or adds up without more ado: of a table that is one range, and of a block of `running`.
BLOCK = 1 << 16


def in_ranges(df: DataFrame, order: list[Column], within: list[Column] | None = None, cut: bool = True, spare: list[str] | None = None) -> DataFrame:
    """A table of `df` with each row's range `_p`, ascending in `order`, and its place `_r` in it, from 0, by `within` (or the order).

    A range exchange finds the bounds and searches them, and a range's task numbers
    its own rows; both are stored, so they are settled once.  The exchange reads its
    input twice (for a sample, then for good): what is dear to compute is cut first,
    and then a table of at most BLOCK rows is one range as it is.  `spare` columns
    count for the order and are not stored.
    """
    if cut:
        df = shared.table(df)
        if df.limit(BLOCK + 1).count() <= BLOCK:  # one range holds them
            return df.withColumn("_p", F.lit(0)).withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*(within or order))) - F.lit(1).cast("long")).drop(*(spare or []))
    placed = df.repartitionByRange(*order).sortWithinPartitions(*(within or order))
    bits = 33  # fixed value: of an id, those that count a partition's rows
    return shared.table(placed.drop(*(spare or [])).withColumn("_r", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_r", bits).cast("int")).withColumn("_r", F.col("_r").bitwiseAND((1 << bits) - 1)))


def ranked(df: DataFrame, order: list[Column], name: str, first: int = 0, within: list[Column] | None = None, cut: bool = True, spare: list[str] | None = None) -> DataFrame:
    """`df`, but for `spare` columns, with a gapless global rank by ascending columns, without one task for all rows.

    Rows are numbered inside their range, and the ranges' sizes, a row for each
    shuffle partition, give the offsets.  `within` is the order in full where `order`
    has only short leading columns of it.
    """
    placed = in_ranges(df, order, within, cut, spare)
    sizes = placed.groupBy(F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_q", F.coalesce(F.sum("_n").over(W.orderBy("_q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), F.col("_p") == F.col("_q")).withColumn(name, (F.col("_before") + F.col("_r") + first).cast("long")).drop("_p", "_q", "_r", "_before")


#: Rows (of a range and a stratum) up to which `places` broadcasts the ranges' strata.
STRATA_HELD = 1 << 17


def places(df: DataFrame, strata: list[str], then: list[str], name: str, spare: list[str] | None = None) -> DataFrame:
    """`df`, but for `spare` columns, with a row's place from 0 in its stratum, by `then`; a stratum that holds most rows is no hot spot.

    A range numbers its own rows, and a row for each stratum of a range says where it
    starts there and how many rows earlier ranges hold of it: a stratum a range and
    one for each bound between ranges, so the rows themselves need no further shuffle
    unless the strata are very many.
    """
    placed = in_ranges(df, [F.col(c) for c in (*strata, *then)], cut=False, spare=spare)
    sizes = placed.groupBy(F.col("_p").alias("_q"), *(F.col(c).alias(f"_of{k}") for k, c in enumerate(strata))).agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_s"))
    keys = [f"_of{k}" for k in range(len(strata))]
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_q", *keys, (earlier - F.col("_s")).alias("_start"))
    few = starts.limit(STRATA_HELD + 1).count() <= STRATA_HELD
    same = F.col("_p") == F.col("_q")
    for key, c in zip(keys, strata, strict=True):
        same &= F.col(key).eqNullSafe(F.col(c))
    return placed.join(F.broadcast(starts) if few else starts, same).withColumn(name, (F.col("_r") + F.col("_start")).cast("long")).drop("_p", "_r", "_q", "_start", *keys)


def running(df: DataFrame, position: str, what: dict[str, tuple[str, Column]]) -> DataFrame:
    """`df` with running "sum" or "max" columns over all rows before, by a gapless position from 0; null where there are none.

    A block of BLOCK rows is one window, and what comes before a block is the same
    over the blocks' totals, a row for each BLOCK rows, in blocks of their own.  Blocks
    meet their starts in the partitions that the window has dealt them to.
    """
    both = {"sum": (F.sum, lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y)), "max": (F.max, F.greatest)}

    def before(rows: DataFrame, at: str, values: dict[str, tuple[str, Column]], levels: int) -> DataFrame:
        block = f"_block{levels}"
        rows = rows.withColumn(block, F.floor(F.col(at) / BLOCK) if levels else F.lit(0))
        inside = W.partitionBy(block).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        here = rows.withColumns({name: both[kind][0](c).over(inside) for name, (kind, c) in values.items()})
        if not levels:
            return here.drop(block)
        above = {f"{name}_{levels}": kind for name, (kind, _) in values.items()}
        totals = rows.groupBy(F.col(block).alias(f"_at{levels}")).agg(*(both[kind][0](c).alias(f"{name}_{levels}") for name, (kind, c) in values.items()))
        starts = before(totals, f"_at{levels}", {name: (kind, F.col(name)) for name, kind in above.items()}, levels - 1)
        out = here.join(starts, F.col(block) == F.col(f"_at{levels}"))
        return out.withColumns({name: both[kind][1](F.col(f"{name}_{levels}"), F.col(name)) for name, (kind, _) in values.items()}).drop(block, f"_at{levels}", *above)

    return before(df, position, what, 2)  # blocks of blocks of rows: what one task adds up is a row for each BLOCK * BLOCK


def last_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an order, as a keyed map keeps it; without the order column.

    The key stays the column that rows were dealt by, so a join on it needs no further shuffle.
    """
    kept = [c for c in df.columns if c != order]
    rest = [c for c in kept if c != key]
    if not rest:
        return df.select(key).distinct()
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(*(F.col(key) if c == key else F.col("_last")[c].alias(c) for c in kept))


def shuffled_like_python(n: int, seed: int) -> list[int]:
    """The order in which Python's random.Random(seed).shuffle leaves n rows (for exact parity on data that fits a driver)."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def split_sizes(available: int, smoke: int, validation: int, train: int, allow_smaller: bool = False) -> dict[str, int]:
    """How many rows each split gets; too few rows are an error, or shrink the splits."""
    if available >= smoke + validation + train:
        return {"smoke": smoke, "validation": validation, "train": train}
    if not allow_smaller:
        raise ValueError(f"the splits take {smoke + validation + train} rows, and there are {available}")
    first = min(smoke, available)
    second = min(validation, max(0, (available - first) // 4))
    return {"smoke": first, "validation": second, "train": available - first - second}


def with_split(df: DataFrame, sizes: dict[str, int], position: str = "position") -> DataFrame:
    """Rows by position to splits, in the order of `sizes`; rows beyond the last are dropped."""
    edge, out = 0, F.lit(None).cast("string")
    for name, n in sizes.items():
        out = F.when((F.col(position) >= edge) & (F.col(position) < edge + n), name).otherwise(out)
        edge += n
    return df.withColumn("split", out).where(F.col("split").isNotNull())


def permuted_with_split(df: DataFrame, placed: DataFrame, order: list[str], seed: int, sizes: dict[str, int]) -> DataFrame:
    """`df` in its seeded order with `split`, as `with_split` of `permuted` gives it, of what `permuted` makes of the order's columns alone.

    The first row of each split says where it begins, so rows need no position and move once.
    """
    key = lambda at: F.struct(F.xxhash64(F.lit(seed), *at).alias("_h"), *(c.alias(f"_{k}") for k, c in enumerate(at)))
    by = key([F.col(c) for c in order])
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    ends = [sum([*sizes.values()][: k + 1]) for k in range(len(sizes))]
    starts = {r["position"]: key([F.lit(r[c]).cast(kinds[c]) for c in order]) for r in placed.where(F.col("position").isin(ends)).select("position", *order).collect()}
    out = F.lit(None).cast("string")
    for name, end in reversed([*zip(sizes, ends, strict=True)]):  # an end beyond the last row has no start after it
        out = F.when(by < starts[end], name).otherwise(out) if end in starts else F.lit(name)
    return df.withColumn("split", out).where(F.col("split").isNotNull()).orderBy(F.xxhash64(F.lit(seed), *order), *order)


def counts(df: DataFrame, by: tuple[str, ...] = ("split", "subject", "source")) -> DataFrame:
    """(field, value, n) for each field, from one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in by))
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def prefix(df: DataFrame, rank: str, n: int) -> DataFrame:
    """The first n rows by an explicit rank."""
    if n <= 0:
        raise ValueError("the limit must be positive")
    return df.where(F.col(rank) < n)
