"""What showed on larger tables only, on a few rows."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stateforge.functions import arrays
from stateforge.llm import secrets
from stateforge.operators import prepare, reports, selection, training
from stateforge.plans import queries, record_queries  # noqa: F401
from stateforge.plans.stages import Stages
from stateforge.sources import records, shared


def test_labels_mask_multiplies_floats(spark, tmp_path):
    import duckdb

    x = np.concatenate([np.nextafter(np.float32(k / 100), np.float32(d)) for k in range(1, 100) for d in (0, 1)] + [np.arange(1, 100, dtype="f4") / np.float32(100)], axis=None).astype("f4")
    x = np.resize(x, (len(x) // 64 + 1, 64))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = [(r.vec_id, r.input_ids, r.labels) for r in queries.QUERIES["labels_mask"](spark, str(tmp_path)).orderBy("vec_id").collect()]
    assert got == duck.execute(f"SELECT vec_id, input_ids, labels FROM ({queries.ORACLE['labels_mask']}) ORDER BY vec_id").fetchall()


def test_weights_are_rounded_as_doubles(spark, tmp_path):
    """Of the first vector 1,000,000,000 times a weight is half as a decimal, but not as a double; the others are odd ones."""
    import duckdb

    vectors = [[0.2729881703853607, 0.23744842410087585], None, [], [None, 0.1], [float("nan"), 0.1], [float("inf"), 0.1], [9.0, 9.0]]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = [(r.vec_id, r.weights) for r in queries.QUERIES["conf_weights"](spark, str(tmp_path)).orderBy("vec_id").collect()]
    assert repr(got) == repr(duck.execute(f"SELECT vec_id, weights FROM ({queries.ORACLE['conf_weights']}) ORDER BY vec_id").fetchall())
    doubles = [1.0593715535, -1.0593715535, 5e-10, 0.49999999999999994e-9, 1e300, float("inf"), float("nan"), None]
    wide = spark.createDataFrame([(x,) for x in doubles], "x double").select(arrays.rounded("x", 9)).collect()
    assert repr([r[0] for r in wide]) == repr([duck.execute("SELECT round(?::DOUBLE, 9)", [x]).fetchone()[0] for x in doubles])


def test_empty_texts_and_odd_spaces_count_as_in_sql(spark, tmp_path):
    import duckdb

    texts = ["a b", None, "", "  ", "a\x0bb", "a\x1cb\x1dc", "a\u00a0b", "a\u3000b\u2028c", "\u00a0", "a\tb\nc\rd\x0ce", "a\x85b"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["en"] * len(texts)}), tmp_path / "documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert tuple(queries.QUERIES["mock_sft"](spark, str(tmp_path)).head()) == duck.execute(queries.ORACLE["mock_sft"]).fetchone()
    # the operator keeps Python's words, and takes the answer where there is no solution
    prompts = spark.createDataFrame([(x, "an answer") for x in texts], "reference_solution string, reference_answer string")
    assert training.mock_sft(prompts).head()["token_count"] == sum(len((x or "an answer").split()) for x in texts)


def test_a_length_at_the_bound_passes_in_any_order(spark):
    exact, row = 0.84, "run string, base_accuracy double, accuracy double, base_tokens double, tokens double, base_unknown double, unknown double"
    lengths = {"below": np.nextafter(exact, 0), "at": exact, "above": np.nextafter(exact, 1), "short": exact - 1e-9}
    df = spark.createDataFrame([(k, 1.0, 1.0, 1.0, float(v), 0.0, 0.0) for k, v in lengths.items()], row)
    got = {r.run: r.length_gate for r in reports.comparison_gates(df, min_length_ratio=exact).collect()}
    assert got == {"below": True, "at": True, "above": True, "short": False}


def test_names_are_counted_in_all_texts(spark):
    """In more texts than any sample, at any place of them, however many names each has; what follows a sensitive word doesn't count."""
    filler = " ".join(f"filler_{i}" for i in range(300))
    rows = [(i, f"{filler} {'x ' * 40_000 if i < 3 else ''}late_name_{i % 2} token of_{i}") for i in range(4_500)]
    got = dict(map(tuple, secrets.name_counts(spark.createDataFrame([*rows, (None, None), (7, "")], "doc_id long, text string").repartition(3)).collect()))
    assert got == {**{f"filler_{i}": 4_500 for i in range(300)}, "late_name_0": 2_250, "late_name_1": 2_250}


@pytest.mark.parametrize("strategy", ["vfs", "verifier_filtered", "random_budget"])
def test_carried_columns_are_the_joined_ones(spark, strategy, monkeypatch):
    """Rows go along with the order, and few bytes of each: no tie-break is stored, nothing is lost, and many strata change nothing."""
    rng = random.Random(6)
    rows = [(f"s{i}-{k}", f"s{i}", k, rng.randint(1, 9), rng.randint(1, 60), rng.choice(["success", "success", "failed"]), rng.choice(selection.STATUSES), rng.choice("ab")) for i in range(60) for k in range(3)]
    rollouts = spark.createDataFrame(rows, "rollout_id string, sample_id string, candidate_index int, prompt_tokens int, response_tokens int, status string, verifier_status string, extracted_answer string")
    prompts = spark.createDataFrame([(f"s{i}", rng.choice("uv"), rng.choice("xy")) for i in range(60)], "sample_id string, subject string, difficulty string")
    given = dict(strategy=strategy, seed=1, max_new_tokens=50, teacher_max_length=40)
    stored = selection.decisions(rollouts, None, prompts, **given)
    joined = selection.decisions(rollouts.drop("verifier_status", "extracted_answer"), rollouts.select("rollout_id", F.col("verifier_status").alias("status"), "extracted_answer"), prompts, **given)
    assert sorted(map(str, stored.collect())) == sorted(map(str, joined.collect()))
    assert "stable_tiebreak" not in spark.read.parquet(*stored.inputFiles()).columns
    names = ["rollout_id", "group_type", "estimated_teacher_tokens", "truncated"]
    made = [*names, "selected", "selection_rank", "selection_reason", "budget_before", "budget_after"]
    want = sorted(map(str, selection.select(stored, strategy=strategy, ratio=0.4).select(made).collect()))
    assert len(want) == 180
    monkeypatch.setattr(prepare, "STRATA_HELD", 0)
    assert sorted(map(str, selection.select(stored, strategy=strategy, ratio=0.4, columns=names).select(made).collect())) == want


def test_the_last_of_a_key_meets_a_join_without_another_shuffle(spark):
    """Rows with the order of their file don't move, and the last of each key is dealt by the key that a join asks for."""
    rows = spark.range(40).select((F.col("id") % 7).cast("string").alias("k"), F.col("id").alias("v"), F.col("id").alias("o"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = prepare.last_of_key(rows.repartition(3), "k", "o")
        plan = last.join(last.select("k", F.col("v").alias("w")), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ENSURE_REQUIREMENTS") <= 2
    assert last.columns == ["k", "v"] and sorted(map(tuple, last.collect())) == [(str((33 + i) % 7), 33 + i) for i in sorted(range(7), key=lambda i: (33 + i) % 7)]


def test_the_order_of_a_table_moves_no_rows(spark, tmp_path):
    spark.range(1000).repartition(5).withColumn("x", F.rand(1)).write.parquet(f"{tmp_path}/t.parquet")
    table = spark.read.parquet(f"{tmp_path}/t.parquet")
    got = records.with_row(table, "n")
    want = [r[0] for r in table.select("id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    assert [(r.id, r.n) for r in got.select("id", "n").orderBy("n").collect()] == [(x, n) for n, x in enumerate(want)]
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert got.columns == ["id", "x", "n"]


def test_distillation_draws_one_stream_in_tasks(spark):
    """The losses are those of a loop over the records in order with one generator, wherever ranges, records and stretches of the stream end."""
    rng, rows = np.random.default_rng(3), []
    for i in range(300):
        n = int(rng.integers(0, 9))
        ids = [[int(x) for x in rng.permutation(256)[:4]] for _ in range(n)]
        rows.append((f"r{i:03d}", list(range(n)) if i % 50 else None, ids, [[-0.4, -2.9, -2.8, -2.7]] * n, [0.1] * n, [float(x) for x in rng.uniform(0.5, 1, n)], float(i % 3) / 2, "pass" if i % 4 else "fail"))
    view = spark.createDataFrame(rows, "rollout_id string, response_token_ids array<int>, topk_token_ids array<array<int>>, topk_logprobs array<array<double>>, tail_mass array<double>, confidence_weights array<double>, verifier_weight double, verifier_status string").repartition(5)
    one, losses, passed = np.random.default_rng(42), [], 0
    for r in rows:
        if r[1]:
            losses.append(arrays.sparse_kl_numpy(one.normal(size=(len(r[1]), 256)), *map(np.asarray, r[2:6])) * r[6])
            passed += r[7] == "pass"
    for size in (1 << 24, 1 << 12, 37):
        if size > 100:
            got = training.mock_distillation(view, size=size)
            assert got["initial_loss"] == pytest.approx(np.mean(losses), rel=1e-13) and (got["record_count"], got["validation_score"]) == (300, passed / 300)
        draws = np.random.default_rng(42).normal(size=5_000)
        for at, raw in training.stream_starts(spark, 42, 4_000, size):
            if at < 4_900:
                assert (training._generator(42, raw).normal(size=90) == draws[at : at + 90]).all()
    assert training.mock_distillation(view.limit(0))["record_count"] == 0


def test_prompts_are_prepared_without_storing_or_shuffling_texts_before_they_are_written(spark, tmp_path, monkeypatch):
    """First occurrences by an order, their seeded order and splits are those of whole rows, and only numbers wait in tables."""
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 40), f"Problem {rng.randint(0, 60)}", "1") for i in range(200)]
    raw = spark.createDataFrame(rows, "row long, at long, problem string, answer string").repartition(5)
    made = prepare.prompts(raw, keep=("row", "at"))
    key = prepare.dedup_key(F.col("problem"))
    want = prepare.permuted(prepare.first_occurrences(made.withColumn("_k", key), F.col("_k"), ["at", "row"]).drop("_k"), ["row"], 3)
    n = want.count()
    for held, sizes in ((1 << 20, (4, 5, n)), (0, (0, 7, 11)), (1 << 20, (0, 0, n)), (0, (n, 1, 2)), (1 << 20, (2, 0, 5))):
        monkeypatch.setattr(prepare, "NUMBERS_HELD", held)
        split = dict(zip(("smoke", "validation", "train"), sizes, strict=True))
        first, numbers = prepare.only_first(made, key, ["at"])
        if held:
            assert first._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 0
        got = prepare.permuted_with_split(first, prepare.permuted(numbers, ["row"], 3), ["row"], 3, split)
        assert [(r.row, r.at, r.split) for r in got.collect()] == [(r.row, r.at, r.split) for r in prepare.with_split(want, split).orderBy("position").collect()]
    monkeypatch.undo()
    stored, table = [], shared.table
    monkeypatch.setattr(shared, "table", lambda df: stored.append(df.columns) or table(df))
    s = Stages(spark, {"project": {"seed": 3}}, str(tmp_path))
    raw.drop("row").write.parquet(f"{tmp_path}/raw.parquet")
    assert s.prepare(f"{tmp_path}/raw.parquet", smoke=2, validation=3, train=n - 5, order=("at",))["record_count"] == n
    assert stored and not any("problem" in columns for columns in stored)
