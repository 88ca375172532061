"""Which rollouts a teacher annotates under a token budget: groups, candidate orders, the greedy fold, reasons, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from stateforge.functions import text
from stateforge.operators import prepare
from stateforge.sources import shared

# Strategies, groups and statuses in their default priority.
STRATEGIES = ("dense", "random_budget", "verifier_filtered", "vfs")
GROUPS = ("boundary", "uncertain", "solved", "failed")
STATUSES = ("pass", "unknown", "fail")
STRATA = ("subject", "difficulty")


def permutation(values, allowed: tuple[str, ...], name: str) -> list[str]:
    """`values` as a list if it holds each allowed value once."""
    out = [str(v) for v in values]
    if sorted(out) != sorted(allowed):
        raise ValueError(f"{name} must contain each of {sorted(allowed)} exactly once")
    return out


def budget_of(dense_tokens: int, strategy: str, *, ratio: float = 1.0, tokens: int | None = None) -> int:
    """The token budget: all for dense, else the given one, else the ratio of all, cut."""
    if not 0.0 < ratio <= 1.0:
        raise ValueError("the budget ratio must be above 0 and at most 1")
    if tokens is not None and tokens <= 0:
        raise ValueError("a token budget must be positive")
    if strategy == "dense":
        return dense_tokens
    return tokens if tokens is not None else int(dense_tokens * ratio)


def group_of(status: Column, answer: Column, window: WindowSpec | None = None) -> Column:
    """A sample's group by the statuses and answers of its rollouts: an aggregate, or the same over a window."""
    over = lambda c: c if window is None else c.over(window)
    passed, answer = status == "pass", F.nullif(F.lower(text.strip(answer)), F.lit(""))
    some, every = over(F.bool_or(passed)), over(F.bool_and(passed))
    unsure = over(F.bool_or(status == "unknown")) | F.coalesce(over(F.min(answer)) != over(F.max(answer)), F.lit(False))
    return F.when(some & ~every, "boundary").when(every, "solved").when(unsure, "uncertain").otherwise("failed")


def state_groups(verified: DataFrame) -> DataFrame:
    """(sample_id, group_type) of verified rollouts (sample_id, verifier_status, extracted_answer)."""
    return verified.groupBy("sample_id").agg(group_of(F.col("verifier_status"), F.col("extracted_answer")).alias("group_type"))


def k_violations(rollouts: DataFrame, k: int) -> DataFrame:
    """(sample_id, candidates) of samples that have not k different candidates."""
    if k < 2:
        raise ValueError("selection needs at least 2 rollouts a prompt")
    return rollouts.groupBy("sample_id").agg(F.count_distinct("candidate_index").alias("candidates")).where(F.col("candidates") != k)


def tiebreak(strategy: str, seed: int) -> Column:
    """The stable hash that orders what is equal otherwise."""
    return text.stable_hash(rollout_id=text.json_string(F.col("rollout_id")), seed=F.lit(str(seed)), strategy=F.lit(f'"{strategy}"'))


def decisions(rollouts: DataFrame, verifications: DataFrame | None, prompts: DataFrame, *, strategy: str, seed: int, max_new_tokens: int, teacher_max_length: int, order: str | None = None) -> DataFrame:
    """A row a rollout with what the order needs, written once; missing verifications or prompts are an error.  Of a rollout's verifications and a sample's prompts the last by `order` (without one they are unique).

    Without `verifications` the rollouts carry their verifier_status and extracted_answer.
    A sample's rollouts meet once, for its prompt and its group, and the tie-break,
    a function of the rollout's id and larger than the rest of the row, isn't stored.
    """
    if order:
        prompts = prepare.last_of_key(prompts, "sample_id", order)
        verifications = None if verifications is None else prepare.last_of_key(verifications, "rollout_id", order)
    asked = prompts.select("sample_id", "subject", "difficulty", F.lit(True).alias("_asked"))
    if verifications is None:
        verified = rollouts.withColumn("_verified", F.lit(True))
    else:
        found = verifications.select("rollout_id", F.col("status").alias("verifier_status"), "extracted_answer", F.lit(True).alias("_verified"))
        verified = rollouts.join(found, "rollout_id", "left")
    rows = verified.join(asked, "sample_id", "left").withColumn("group_type", group_of(F.col("verifier_status"), F.col("extracted_answer"), W.partitionBy("sample_id")))
    decided = rows.select(
        "rollout_id",
        "sample_id",
        "candidate_index",
        "group_type",
        "verifier_status",
        "extracted_answer",
        "subject",
        "difficulty",
        F.least(F.col("prompt_tokens") + F.col("response_tokens"), F.lit(teacher_max_length)).cast("long").alias("estimated_teacher_tokens"),
        (F.col("response_tokens") >= max_new_tokens).alias("truncated"),
        "status",
        "_verified",
        "_asked",
    )
    decided = shared.table(decided)
    for mark, key, what in (("_verified", "rollout_id", "verification"), ("_asked", "sample_id", "prompt")):
        lost = decided.where(F.col(mark).isNull()).select(key).limit(1).collect()
        if lost:
            raise KeyError(f"{lost[0][0]} has no {what}")
    return decided.drop("_verified", "_asked").withColumns({"strategy": F.lit(strategy), "stable_tiebreak": tiebreak(strategy, seed)})


def _rank_of(c: Column, priority: list[str]) -> Column:
    """A value's place in a list (after all if it is not there)."""
    out = F.lit(len(priority))
    for k, v in enumerate(priority):
        out = F.when(c == v, k).otherwise(out)
    return out


def _tied(df: DataFrame) -> DataFrame:
    """`df` with its tie-break in short, `_tie` and `_name`, for orders that cross the network.

    Of a SHA-256 in hexadecimal the first 128 bits, which no two rows share; any other text as it is.
    """
    of = F.col("stable_tiebreak")
    hashed = of.rlike("^[0-9a-f]{64}$")
    return df.withColumns({"_tie": F.when(hashed, F.unhex(F.left(of, F.lit(32)))), "_name": F.when(hashed, F.lit(None)).otherwise(of)})


def order_columns(df: DataFrame, strategy: str, *, status_priority=STATUSES, group_priority=GROUPS, stratify_by=STRATA, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The candidates that the strategy considers, with the columns that order them, and of the others those to `keep` (all).

    Waves: each sample's candidates are ranked, and all first ones come before
    all second ones.  In a wave (vfs: in a group of a wave) strata take turns,
    which is an order by the place inside the stratum, then by the stratum.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if not set(stratify_by) <= set(STRATA):
        raise ValueError(f"stratify_by must be among {STRATA}")
    statuses, groups = permutation(status_priority, STATUSES, "status_priority"), permutation(group_priority, GROUPS, "group_priority")
    kept = [c for c in df.columns if keep is None or c in keep]
    only = lambda rows, by: rows.select(*dict.fromkeys([*kept, *by]))
    if strategy == "dense":
        return only(df, ["rollout_id"]), ["rollout_id"]
    if strategy == "random_budget":
        by = ["_tie", "_name", "rollout_id"]
        return only(_tied(df), by), by
    if strategy == "verifier_filtered":
        df = df.where(F.col("verifier_status").isin("pass", "unknown"))
    df = df.withColumn("_status", _rank_of(F.col("verifier_status"), statuses)).withColumn("_group", _rank_of(F.col("group_type"), groups) if strategy == "vfs" else F.lit(0))
    inside = ["truncated", "_status", "estimated_teacher_tokens", "_tie", "_name", "rollout_id"]
    df = only(_tied(df), ["sample_id", "_group", *inside, *stratify_by])
    df = df.withColumn("wave", F.row_number().over(W.partitionBy("sample_id").orderBy(*inside)) - 1)
    then = inside if strategy == "vfs" else ["_status", "truncated", *inside[2:]]
    if not stratify_by:
        return only(df, ["wave", "_group", *then]), ["wave", "_group", *then]
    by = ["wave", "_group", "turn", *stratify_by]
    spare = [c for c in df.columns if c not in (*kept, *by)]
    return prepare.places(df, ["wave", "_group", *stratify_by], then, "turn", spare), by


def ordered(df: DataFrame, strategy: str, keep: list[str] | None = None, **options) -> DataFrame:
    """The considered candidates, or their columns to `keep`, with `position` from 0 in the strategy's order."""
    kept = df.columns if keep is None else keep
    rows, by = order_columns(df, strategy, keep=kept, **options)
    spare = [c for c in rows.columns if c not in kept]
    return prepare.ranked(rows, [F.col(c) for c in by], "position", cut=False, spare=spare)


def greedy(df: DataFrame, budget: int, *, tokens: str = "estimated_teacher_tokens", position: str = "position", keep: list[str] | None = None) -> DataFrame:
    """`position`, the columns to `keep`, selected, selection_rank, budget_before, budget_after: takes by position (gapless, from 0) what still fits, and goes on after what doesn't.

    Up to the first row that doesn't fit all are taken: sums of blocks find its block,
    and a running sum in that block the row.
    What is left then is less than that row's tokens, so few can follow: of rows of
    t tokens only the first (left div t) after it come into question, `left` times
    its logarithm rows in all, whatever the table's size.  These are folded on the
    driver, and running sums over all rows give the ranks and budgets.  `df` is read
    more than once and should be stored.
    """
    line = df.select(F.col(position).cast("long").alias("position"), F.col(tokens).cast("long").alias("_tokens"), *(keep or []))
    at = F.floor(F.col("position") / prepare.BLOCK)
    over, first = None, lambda rows: rows.where(F.coalesce("_sum", F.lit(0)) + F.col("_tokens") > budget).agg(F.min(F.struct("position", F.coalesce("_sum", F.lit(0)).alias("used")))).head()[0]
    block = first(prepare.running(line.groupBy(at.alias("position")).agg(F.sum("_tokens").alias("_tokens")), "position", {"_sum": ("sum", F.col("_tokens"))}))
    if block is not None:
        inside = W.partitionBy(at).orderBy("position").rowsBetween(W.unboundedPreceding, -1)
        over = first(line.where(at == block["position"]).select("position", "_tokens", (F.coalesce(F.sum("_tokens").over(inside), F.lit(0)) + block["used"]).alias("_sum")))
    chosen = F.lit(True)
    if over is not None:
        left = budget - over["used"]
        open_rows = line.select("position", "_tokens").where((F.col("position") > over["position"]) & F.col("_tokens").between(1, left))
        # first the rows of each block that could be among the first of their size, then of these
        for part in ([at], []):
            nth = F.row_number().over(W.partitionBy("_tokens", *part).orderBy("position"))
            open_rows = open_rows.withColumn("_nth", nth).where((F.col("_nth") <= left) & (F.col("_nth") * F.col("_tokens") <= left)).drop("_nth")
        picks = []
        for row in open_rows.orderBy("position").toArrow().to_pylist():
            if row["_tokens"] <= left:
                picks.append((row["position"],))
                left -= row["_tokens"]
        picked = df.sparkSession.createDataFrame(picks, "_pick long")
        line = line.join(F.broadcast(picked), F.col("position") == F.col("_pick"), "left")
        chosen = (F.col("position") < over["position"]) | (F.col("_tokens") == 0) & (F.col("position") > over["position"]) | F.col("_pick").isNotNull()
    line = line.withColumn("selected", chosen).drop("_pick")
    taken = F.when(F.col("selected"), F.col("_tokens")).otherwise(0)
    out = prepare.running(line, "position", {"_used": ("sum", taken), "_count": ("sum", F.col("selected").cast("long"))})
    before = F.lit(budget).cast("long") - F.coalesce("_used", F.lit(0))
    return out.select("position", *(keep or []), "selected", F.when(F.col("selected"), F.coalesce("_count", F.lit(0)) + 1).alias("selection_rank"), before.alias("budget_before"), (before - taken).alias("budget_after"))


def select(rows: DataFrame, *, strategy: str, ratio: float = 1.0, tokens: int | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """Every row of `decisions` with its choice, reason and budget.

    With `columns` of the rows alone, which go along with the order; without, with all of them, which a join brings back.
    """
    eligible = rows.where(F.col("status") == "success")
    dense = eligible.agg(F.coalesce(F.sum("estimated_teacher_tokens"), F.lit(0))).head()[0]
    carried = list(dict.fromkeys(["rollout_id", *(columns or [])]))
    order = ordered(eligible, strategy, list(dict.fromkeys([*carried, "estimated_teacher_tokens"])), **options)
    chosen = greedy(order, budget_of(dense, strategy, ratio=ratio, tokens=tokens), keep=carried).drop("position")
    if columns is None:
        out = rows.join(chosen, "rollout_id", "left")
    else:
        considered = F.col("verifier_status").isin("pass", "unknown") if strategy == "verifier_filtered" else F.lit(True)
        others = rows.where((F.col("status") != "success") | F.col("status").isNull() | ~F.coalesce(considered, F.lit(False)))
        out = chosen.withColumn("status", F.lit("success")).unionByName(others.select(*carried, "status"), allowMissingColumns=True)
    rest = "verifier_status_filtered" if strategy == "verifier_filtered" else "not_selected"
    reason = F.when(F.col("status") != "success", "upstream_rollout_failed").when(F.col("selected").isNull(), rest).when(F.col("selected"), f"selected_by_{strategy}").otherwise("teacher_token_budget_exceeded")
    out = out.withColumn("selection_reason", reason)
    return out.withColumn("selected", F.coalesce("selected", F.lit(False))).drop("status")


def selected_rollouts(rollouts: DataFrame, selection: DataFrame) -> DataFrame:
    """The chosen rollouts by rank; none is an error."""
    chosen = selection.where("selected").select("rollout_id", "selection_rank")
    if not chosen.limit(1).count():
        raise ValueError("no rollout was selected")
    return rollouts.join(chosen, "rollout_id").orderBy("selection_rank").drop("selection_rank")


def report(selection: DataFrame, budget: int, dense: int) -> DataFrame:
    """One row: counts, token sums and ratios (0 where the divisor is 0)."""
    used = F.coalesce(F.sum(F.when(F.col("selected"), F.col("estimated_teacher_tokens"))), F.lit(0))
    return selection.agg(
        F.count(F.lit(1)).alias("candidate_records"),
        F.count_if(F.col("selection_reason") != "upstream_rollout_failed").alias("eligible_records"),
        F.count_if("selected").alias("selected_records"),
        F.lit(dense).cast("long").alias("dense_estimated_teacher_tokens"),
        F.lit(budget).cast("long").alias("teacher_token_budget"),
        used.alias("selected_estimated_teacher_tokens"),
        (used / budget if budget else F.lit(0.0)).alias("budget_utilization"),
        (used / dense if dense else F.lit(0.0)).alias("selected_token_ratio"),
        F.count_if("truncated").alias("truncated_records"),
        F.count_if(F.col("truncated") & F.col("selected")).alias("selected_truncated_records"),
    )


def report_counts(selection: DataFrame) -> DataFrame:
    """(field, value, n, n_selected) of group_type and verifier_status."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("group_type", "verifier_status")))
    return selection.select("selected", F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"))
