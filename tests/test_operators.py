import random

import pytest
from pyspark.sql import functions as F

from stateforge.operators import contamination, evaluation, prepare, reports, rollout, schemas, selection, training, views


def test_prompts_take_the_first_filled_alias(spark):
    raw = spark.createDataFrame([(" ", "Q ", "7", None, True), (None, None, "1", "x", False)], "problem string, question string, final_answer string, solution string, synthetic boolean")
    rows = prepare.prompts(raw, dataset="d").collect()
    assert len(rows) == 1 and (rows[0].problem, rows[0].reference_answer, rows[0].subject, rows[0].source) == ("Q", "7", "unknown", "d")
    assert rows[0].metadata == '{"problem_is_valid":null,"solution_is_valid":null,"synthetic":true}'


def test_split_sizes():
    assert prepare.split_sizes(10, 2, 3, 5) == {"smoke": 2, "validation": 3, "train": 5}
    assert prepare.split_sizes(10, 4, 8, 8, True) == {"smoke": 4, "validation": 1, "train": 5}
    with pytest.raises(ValueError, match="take 16"):
        prepare.split_sizes(10, 4, 4, 8)


def test_ranked_is_gapless(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x long")
    assert sorted((r.x, r.position) for r in prepare.ranked(df, [F.col("x")], "position").collect()) == [(i, i) for i in range(101)]


def test_places_in_strata_of_any_size(spark):
    """Most rows are of one stratum, which spans all ranges; nulls are a stratum too."""
    rows = [(None if i % 11 == 0 else "b" if i % 7 == 0 else "a", 1 if i % 50 == 0 else 0, i * 389 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "s string, w int, x long")
    seen, want = {}, {}
    for s, w, x in sorted(rows, key=lambda r: r[2]):
        want[x] = seen.get((s, w), 0)
        seen[s, w] = want[x] + 1
    assert {r.x: r.place for r in prepare.places(df, ["w", "s"], ["x"], "place").collect()} == want
    assert prepare.places(df.limit(0), ["w", "s"], ["x"], "place").count() == 0


def test_near_edges(spark):
    train = spark.createDataFrame([("s1", 1, "a b c d e f g h i"), ("s2", 2, " "), ("s3", 3, "x y"), ("s4", 4, "one two three four five")], "sample_id string, row long, text string")
    evals = spark.createDataFrame([("e1", 0, ""), ("e2", 1, "a b c d e f g h j"), ("e3", 2, "a b c d e f g h j k"), ("e4", 3, "a b c d e f g h j"), ("e5", 4, "x y"), ("e6", 5, "X  Y")], "eval_id string, ordinal long, text string")
    rows = {r.sample_id: (r.match_type, round(r.score, 9), r.eval_id) for r in contamination.matches(train, evals, threshold=4 / 6).collect()}
    assert rows == {"s1": ("near", round(4 / 6, 9), "e2"), "s2": ("near", 1.0, "e1"), "s3": ("exact", 1.0, "e6")}
    assert "s1" not in {r.sample_id for r in contamination.matches(train, evals, threshold=0.67).collect()}
    assert {r.sample_id for r in contamination.matches(train, evals, near_duplicates=False).collect()} == {"s3"}


def test_greedy_goes_on_after_a_large_one(spark):
    df = spark.createDataFrame([(0, 6), (1, 5), (2, 3), (3, 1)], "position long, estimated_teacher_tokens long")
    rows = sorted(selection.greedy(df, 10).collect())
    assert [(r.selected, r.selection_rank, r.budget_before, r.budget_after) for r in rows] == [(True, 1, 10, 4), (False, None, 4, 4), (True, 2, 4, 1), (True, 3, 1, 0)]


def model_order(rows, strategy):
    """Waves, groups and strata taking turns, with lists."""
    status = {s: i for i, s in enumerate(selection.STATUSES)}
    if strategy == "verifier_filtered":
        rows = [r for r in rows if r["verifier_status"] != "fail"]
    inside = lambda r: (r["truncated"], status[r["verifier_status"]], r["estimated_teacher_tokens"], r["stable_tiebreak"])
    then = inside if strategy == "vfs" else lambda r: (status[r["verifier_status"]], r["truncated"], r["estimated_teacher_tokens"], r["stable_tiebreak"])
    waves = {}
    for s in {r["sample_id"] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r["sample_id"] == s), key=inside)):
            waves.setdefault(k, []).append(r)
    out = []
    for k in sorted(waves):
        for group in selection.GROUPS if strategy == "vfs" else [None]:
            strata = {}
            for r in sorted((r for r in waves[k] if group in (None, r["group_type"])), key=then):
                strata.setdefault((r["subject"], r["difficulty"]), []).append(r)
            while strata:
                for key in sorted(strata):
                    out.append(strata[key].pop(0)["rollout_id"])
                    if not strata[key]:
                        del strata[key]
    return out


@pytest.mark.parametrize("strategy", ["vfs", "verifier_filtered"])
def test_orders_are_the_models(spark, strategy):
    rng = random.Random(3)
    group = {f"s{i}": (rng.choice(selection.GROUPS), rng.choice(["é", "a", "中"]), rng.choice("xy")) for i in range(80)}
    rows = [dict(rollout_id=f"{s}-{k}", sample_id=s, group_type=g, verifier_status=rng.choice(selection.STATUSES), subject=u, difficulty=d, estimated_teacher_tokens=rng.randint(1, 5), truncated=rng.random() < 0.3, stable_tiebreak=f"{rng.random():.9f}") for s, (g, u, d) in group.items() for k in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "rollout_id string, sample_id string, group_type string, verifier_status string, subject string, difficulty string, estimated_teacher_tokens long, truncated boolean, stable_tiebreak string")
    got = [r.rollout_id for r in selection.ordered(df, strategy).orderBy("position").collect()]
    assert got == model_order(rows, strategy)


def test_options_are_checked(spark):
    with pytest.raises(ValueError, match="exactly once"):
        selection.permutation(["pass", "pass", "fail"], selection.STATUSES, "status_priority")
    with pytest.raises(ValueError, match="budget ratio"):
        selection.budget_of(10, "vfs", ratio=0.0)
    assert (selection.budget_of(11, "vfs", ratio=0.5), selection.budget_of(11, "dense", ratio=0.5), selection.budget_of(11, "vfs", tokens=3)) == (5, 11, 3)
    with pytest.raises(ValueError, match="at least 2"):
        selection.k_violations(spark.range(1), 1)


def test_groups(spark):
    rows = [("b", "pass", "1"), ("b", "fail", "2"), ("s", "pass", "1"), ("u", "fail", "1"), ("u", "fail", " 2"), ("v", "unknown", None), ("f", "fail", "A "), ("f", "fail", "a")]
    df = spark.createDataFrame(rows, "sample_id string, verifier_status string, extracted_answer string")
    assert {r[0]: r[1] for r in selection.state_groups(df).collect()} == {"b": "boundary", "s": "solved", "u": "uncertain", "v": "uncertain", "f": "failed"}


def test_mismatched_tokenizers_fail(spark):
    r = spark.createDataFrame([("r1", "s", "p", "q", "A")], "rollout_id string, sample_id string, prompt string, response string, tokenizer_fingerprint string")
    v = spark.createDataFrame([("r1", "pass")], "rollout_id string, status string")
    a = v.select("rollout_id", F.lit("success").alias("status"), F.lit("B").alias("tokenizer_fingerprint"), F.array(F.lit(1)).alias("input_ids"), F.lit(1).alias("response_start"), *(F.array(F.lit(1)).alias(c) for c in views.PER_TOKEN))
    with pytest.raises(ValueError, match="r1 was generated"):
        views.joined(r, v, a)


def test_shapes_are_checked(spark):
    df = spark.createDataFrame([("r", [1], [])], "rollout_id string, response_token_ids array<int>, topk_logprobs array<array<double>>")
    bad = schemas.violations(df, [schemas._per_token("topk_logprobs")], "rollout_id").collect()
    assert bad[0].violations == ["size(topk_logprobs)=size(response_token_ids)"]
    with pytest.raises(ValueError, match="unexpected"):
        schemas.conform(df, schemas.PROMPT)


def test_statistics(spark):
    assert evaluation.mcnemar_p(0, 2) == 0.5 and evaluation.mcnemar_p(0, 0) == 1.0
    b = evaluation.paired_bootstrap([0, 1, 0, 1], [1, 1, 1, 1], iterations=500)
    assert b.mean_difference == 0.5 and 0 <= b.ci_low <= 0.5 <= b.ci_high <= 1
    with pytest.raises(ValueError, match="at least one"):
        evaluation.paired_bootstrap([], [])


def test_bootstrap_is_the_same_at_every_size(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.random() < 0.5), rng.choice([0.0, 0.5, 1.0])) for i in range(300)]
    pairs = spark.createDataFrame([*rows, (300, None, 1.0)], "sample_id long, baseline double, candidate double")
    a = evaluation.paired_bootstrap([r[1] for r in rows], [r[2] for r in rows], iterations=4000)
    b = evaluation.distributed_bootstrap(pairs)
    assert b.samples == a.samples == 300 and b.mean_difference == pytest.approx(a.mean_difference)
    assert b.ci_low == pytest.approx(a.ci_low, abs=0.01) and b.ci_high == pytest.approx(a.ci_high, abs=0.01)
    one = evaluation.distributed_bootstrap(pairs, iterations=1)
    assert one.ci_low == one.ci_high
    with pytest.raises(ValueError, match="at least one"):
        evaluation.distributed_bootstrap(pairs.limit(0))


def test_bootstrap_of_continuous_scores(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, 0.0, rng.gauss(0.1, 1)) for i in range(400)] + [(i, 0.0, 0.5) for i in range(400, 500)]
    pairs = spark.createDataFrame(rows, "sample_id long, baseline double, candidate double")
    a = evaluation.paired_bootstrap([0.0] * 500, [r[2] for r in rows], iterations=4000)
    whole = evaluation.distributed_bootstrap(pairs.repartition(3), iterations=4000)
    monkeypatch.setattr(evaluation, "BLOCK_VALUES", 16)
    monkeypatch.setattr(evaluation, "AT_ONCE", 1000)
    for b in (whole, evaluation.distributed_bootstrap(pairs, iterations=4000)):
        assert b.samples == 500 and b.mean_difference == pytest.approx(a.mean_difference)
        assert b.ci_low == pytest.approx(a.ci_low, abs=0.02) and b.ci_high == pytest.approx(a.ci_high, abs=0.02)
    again = evaluation.distributed_bootstrap(pairs.repartition(7), iterations=4000)
    assert (again.ci_low, again.ci_high) == pytest.approx((b.ci_low, b.ci_high))


def test_early_stop_follows_the_last_accepted(spark):
    h = spark.createDataFrame([("r", s, v) for s, v in enumerate([0.5, 0.55, 0.6, 0.5, 0.58])], "run string, step long, score double")
    row = evaluation.early_stop(h, run="run", min_delta=0.1, patience=2).head()
    assert (row.best_score, row.best_step, row.stale_evaluations, row.stopped) == (0.6, 2, 2, True)
    assert evaluation.needs_final_validation(True, 5, 2) and not evaluation.needs_final_validation(True, 4, 2)


def test_budget_and_promotion(spark):
    m = spark.createDataFrame([(3.0,), (8.0,)], "estimated_gpu_hours double")
    with pytest.raises(RuntimeError, match="hard cap"):
        reports.check_budget(m, 5, 10)
    assert reports.check_budget(m.limit(1), 5, 10)["status"] == "within_budget"
    base = {"samples": 10, "accuracy": 0.5, "mean_response_tokens": 100, "status_counts": {"unknown": 0}}
    gates = lambda c, h: reports.promotion_gates(base, base | c, h, checkpoint_exists=True, artifact_complete=True, lineage=["a"], git_commit="x")
    assert gates({}, [{"loss": 1.0}])["promotable"]
    assert not gates({}, [{"loss": float("nan")}])["checks"]["finite_training_loss"]
    assert not gates({"accuracy": 0.4}, [])["checks"]["accuracy_gate"]
    assert not gates({"mean_response_tokens": 140}, [])["checks"]["length_gate"]
    assert not gates({"status_counts": {"unknown": 1}}, [])["checks"]["unknown_rate_gate"]


def test_mock_arithmetic():
    reply = rollout.MockBackend.reply
    assert "{7}" in reply("Compute 1 + 2 * 3.") and "{-4}" in reply("calculate -(2 ** 2)?") and "{2}" in reply("compute 4 / 2")
    for odd in ("compute 1/0", "compute __import__('os')", "compute 9**9**9", "hello"):
        assert reply(odd) == rollout.GAVE_UP


def test_failing_backend_gives_failed_rows(spark):
    class Broken(rollout.MockBackend):
        def generate(self, prompts, *, seed):
            raise OSError("down")

    p = spark.createDataFrame([("s", "compute 1+1", 0)], "sample_id string, problem string, n long")
    rows = rollout.generate(rollout.candidates(p, 2, round_id=1, shard_size=5, rank="n"), Broken, seed=1).collect()
    assert [(r.rollout_id, r.status, r.error) for r in sorted(rows)] == [("r1_s_0", "failed", "OSError: down"), ("r1_s_1", "failed", "OSError: down")]


def test_audit():
    out = training.audit_sparse_kl()
    assert out["mean_gradient_cosine"] > 0.5 and out["sparse_step_improvement_rate"] == 1.0
    rng, row = random.Random(1), out["rows"][3]
    import numpy as np

    draws = np.random.default_rng(42)
    for _ in range(3):
        draws.normal(scale=2.5, size=64), draws.normal(scale=1.0, size=64)
    teacher = draws.normal(scale=2.5, size=64)
    student = teacher + draws.normal(scale=1.0, size=64)
    p, q = np.exp(teacher) / np.exp(teacher).sum(), np.exp(student) / np.exp(student).sum()
    top = np.argsort(-p)[:8]
    rest = np.setdiff1d(np.arange(64), top)
    sparse = sum(p[k] * np.log(p[k] / q[k]) for k in top) + p[rest].sum() * np.log(p[rest].sum() / q[rest].sum())
    assert row["full_loss"] == pytest.approx((p * np.log(p / q)).sum()) and row["sparse_loss"] == pytest.approx(sparse) and row["topk_mass"] == pytest.approx(p[top].sum())
    with pytest.raises(ValueError, match="top_k"):
        training.audit_sparse_kl(top_k=64)
    assert rng


def test_last_duplicate_counts(spark):
    a = spark.createDataFrame([("x", 0.0, 0), ("x", 1.0, 1), ("y", 0.5, 2)], "sample_id string, score double, n long")
    b = spark.createDataFrame([("x", 1.0, 5), ("x", 0.0, 9), ("y", 0.0, 7), ("z", 1.0, 8)], "sample_id string, score double, n long")
    pairs = evaluation.paired(a, b, order="n")
    assert sorted(map(tuple, pairs.collect())) == [("x", 1.0, 0.0), ("y", 0.5, 0.0)]
    row = evaluation.discordance(pairs).head()
    assert (row.samples, row.baseline_only_correct, row.candidate_only_correct) == (2, 2, 0)  # any score but 0 is correct


def test_greedy_is_the_models(spark):
    rng = random.Random(4)
    for case in range(6):
        tokens = [rng.choice([0, 1, 3, 8, 20, 40]) for _ in range(300)]
        budget = rng.choice([0, 5, 100, 10**6, sum(tokens) // 2, sum(tokens) - 1])
        left, rank, want = budget, 0, []
        for k, t in enumerate(tokens):
            before, fits = left, t <= left
            left -= t * fits
            rank += fits
            want.append((k, fits, rank if fits else None, before, left))
        df = spark.createDataFrame(list(enumerate(tokens)), "position long, estimated_teacher_tokens long").repartition(3)
        block, prepare.BLOCK = prepare.BLOCK, 32
        try:
            assert sorted(map(tuple, selection.greedy(df, budget).collect())) == want, case
        finally:
            prepare.BLOCK = block


def test_running_and_epochs(spark):
    df = spark.createDataFrame([(i, i * 7 % 5) for i in range(100)], "k long, x long")
    block, prepare.BLOCK = prepare.BLOCK, 16
    try:
        got = sorted((r.k, r.s, r.m) for r in prepare.running(df, "k", {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}).collect())
    finally:
        prepare.BLOCK = block
    xs = [i * 7 % 5 for i in range(100)]
    assert got == [(k, sum(xs[:k]) if k else None, max(xs[:k]) if k else None) for k in range(100)]
    order = evaluation.epoch_order(df, ["k"], 3, 10)
    assert sorted(r.read_at for r in order.collect()) == list(range(10)) and {r.k for r in order.collect()} == set(range(10))


def test_annotators_store_failures(spark):
    from stateforge.operators import teacher

    class Some:
        def annotate(self, prompt, response):
            if response == "bad":
                raise OSError("down")
            return {"input_ids": [1, 2], "response_start": 1, "response_token_ids": [2], "topk_token_ids": [[2]], "topk_logprobs": [[0.0]], "tail_mass": [0.1], "token_entropy": [0.2], "tokenizer_revision": "r", "tokenizer_fingerprint": "f"}

    df = spark.createDataFrame([("a", "s", "p", "good", "success"), ("b", "s", "p", "bad", "success"), ("c", "s", "p", "x", "failed")], "rollout_id string, sample_id string, prompt string, response string, status string")
    got = {r.rollout_id: r for r in teacher.by_rows(Some, model="m")(df).collect()}
    assert got["a"].status == "success" and got["a"].teacher_tokens == 2 and got["b"].error == "OSError: down" and got["c"].status == "failed"
    with pytest.raises(Exception, match="register"):
        teacher.ANNOTATORS["transformers"](df)
