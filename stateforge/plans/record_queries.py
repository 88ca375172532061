"""More registered queries: keyed maps, row orders, mocks in full, methods and constraints of records, and a chain of stages."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateforge.functions import answers, arrays, text
from stateforge.operators import contamination, evaluation, prepare, reports, rollout, schemas, selection, teacher, training, views
from stateforge.plans import queries as q
from stateforge.plans.queries import query, table
from stateforge.plans.stages import Stages
from stateforge.sources import digests, records, shared

# ---------------------------------------------------------------- keyed maps keep the last of a key


def _runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Events of even and of odd ids as two runs' predictions of users, many of each; scores are tenths, some of them 0."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), (F.pmod(F.col("event_id"), F.lit(4)) / 2).alias("score"), "event_id")
    return [rows.where(F.pmod(F.floor(F.col("event_id") / 4), F.lit(2)) == k) for k in (0, 1)]


_RUNS = "b AS (SELECT user_id, arg_max((event_id % 4) / 2, event_id) AS x FROM events WHERE (event_id // 4) % 2 = 0 GROUP BY user_id), c AS (SELECT user_id, arg_max((event_id % 4) / 2, event_id) AS y FROM events WHERE (event_id // 4) % 2 = 1 GROUP BY user_id)"


@query(f"WITH {_RUNS} SELECT user_id AS sample_id, x AS baseline, y AS candidate FROM b JOIN c USING (user_id)")
def paired_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.paired(*_runs(spark, sf_dir), order="event_id")


@query(f"WITH {_RUNS} SELECT count(*) AS samples, round(avg(y - x), 9) AS mean_difference, count_if(x <> 0 AND y = 0) AS baseline_only_correct, count_if(x = 0 AND y <> 0) AS candidate_only_correct, count_if((x = 0) <> (y = 0)) AS discordant FROM b JOIN c USING (user_id)")
def mcnemar_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.discordance(evaluation.paired(*_runs(spark, sf_dir), order="event_id")).withColumn("mean_difference", arrays.rounded("mean_difference", 9))


def _doubled(rows: DataFrame, wrong: dict) -> DataFrame:
    """Every row twice, the first time (by `_row`) with other values."""
    first = rows.withColumns(wrong).withColumn("_row", F.lit(0))
    return first.unionByName(rows.withColumn("_row", F.lit(1)))


@query(f"WITH {q._ROLLOUTS}, {q._DECIDED.replace('STRATEGY', 'dense')} SELECT rollout_id, verifier_status, group_type, subject, difficulty, t AS estimated_teacher_tokens FROM d")
def decisions_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q._lines(spark, sf_dir)
    verdicts = _doubled(q._verified(rows), {"status": F.lit("unknown"), "extracted_answer": F.lit("none")})
    prompts = _doubled(q._orders(spark, sf_dir), {"subject": F.lit("wrong")})
    out = selection.decisions(rows.drop("verifier_status", "extracted_answer"), verdicts, prompts, strategy="dense", seed=42, max_new_tokens=45, teacher_max_length=48, order="_row")
    return out.select("rollout_id", "verifier_status", "group_type", "subject", "difficulty", "estimated_teacher_tokens")


@query(f"WITH {q._TURN_PAIRS} SELECT rollout_id, CASE WHEN length(response) > 200 THEN 'pass' ELSE 'fail' END AS verifier_status, length(prompt) AS response_start FROM p")
def view_join_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = q._turns(spark, sf_dir).withColumn("tokenizer_fingerprint", F.lit("f"))
    verdicts = _doubled(turns.select("rollout_id", F.when(F.length("response") > 200, "pass").otherwise("fail").alias("status")), {"status": F.lit("unknown")})
    ids = F.array(F.lit(1))
    made = turns.select("rollout_id", F.lit("success").alias("status"), "tokenizer_fingerprint", ids.alias("input_ids"), F.length("prompt").alias("response_start"), *(ids.alias(c) for c in views.PER_TOKEN))
    out = views.joined(turns, verdicts, _doubled(made, {"response_start": F.lit(-1)}), order="_row")
    return out.select("rollout_id", "verifier_status", F.col("response_start").cast("long").alias("response_start"))


@query("SELECT user_id AS sample_id, arg_max(value, event_id) AS reference_answer FROM events GROUP BY user_id")
def prompt_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.col("value").alias("reference_answer"), "event_id")
    return prepare.last_of_key(rows, "sample_id", "event_id")


# ---------------------------------------------------------------- orders, prefixes, concatenation


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders QUALIFY n < 500")
def prompt_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of prompts is the feature: the first 500 by an explicit order."""
    rows = prepare.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], "n", cut=False)
    return prepare.prefix(rows, "n", 500).select("o_orderkey", "n")


@query()
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.permuted(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 42)


@query()
def epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.epoch_order(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 42, 1000)


@query("WITH b AS (SELECT item_id, row_number() OVER () - 1 AS k, (SELECT count(*) FROM benchmark) AS n FROM benchmark) SELECT item_id, k + n * t.i AS ordinal FROM b, (SELECT unnest([0, 1]) AS i) t")
def eval_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return records.concatenated([rows, rows]).select("item_id", "ordinal")


@query(q._VFS + " SELECT rollout_id, t AS tokens FROM z WHERE selected")
def selected_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q._lines(spark, sf_dir)
    chosen = selection.select(q._decisions(spark, sf_dir, "vfs"), strategy="vfs", ratio=0.5, columns=["rollout_id"])
    return selection.selected_rollouts(rows, chosen).select("rollout_id", F.least(F.col("prompt_tokens") + F.col("response_tokens"), F.lit(48)).cast("long").alias("tokens"))


@query("WITH o AS (SELECT p_partkey AS name, p_retailprice AS c, p_size AS a FROM part p WHERE NOT EXISTS (SELECT 1 FROM part x WHERE x.p_retailprice <= p.p_retailprice AND x.p_size >= p.p_size AND (x.p_retailprice < p.p_retailprice OR x.p_size > p.p_size))) SELECT name, row_number() OVER (ORDER BY c, a DESC, name) - 1 AS place FROM o")
def pareto_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("gpu_hours"), F.col("p_size").cast("double").alias("accuracy"))
    best = reports.pareto(points).where("pareto_optimal")
    return prepare.ranked(best, [F.col("gpu_hours"), -F.col("accuracy"), F.col("name")], "place").select("name", "place")


@query("SELECT user_id AS run, event_id AS step, CASE WHEN event_type = 'click' THEN value * 0.8 + 0.05 ELSE value END AS value FROM events WHERE event_type <> 'view'")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    score = F.when(F.col("event_type") == "click", F.col("value") * 0.8 + 0.05)
    return evaluation.curve(events.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.when(F.col("event_type") != "view", F.col("value")).alias("validation_accuracy"), score.alias("composite_score")))


@query("SELECT doc_id, round(0.8 * quality + 0.1 * toxic + 0.1 * (1 - toxic), 9)::DOUBLE AS score FROM labels")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", arrays.rounded(evaluation.composite(F.col("quality"), F.col("toxic"), 1 - F.col("toxic")).cast("double"), 9).alias("score"))


# ---------------------------------------------------------------- functions


_WORDS_OF = "list_distinct(list_filter(string_split({}, ' '), lambda t: t <> ''))"
_SIDE = q._NORM.replace("lower(text)", "lower({})")


@query(f"WITH {q._TURN_PAIRS}, s AS (SELECT rollout_id, {_WORDS_OF.format(_SIDE.format('prompt'))} AS a, {_WORDS_OF.format(_SIDE.format('response'))} AS b FROM p) SELECT rollout_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 9)::DOUBLE AS similarity FROM s")
def jaccard_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = q._turns(spark, sf_dir).select("rollout_id", text.tokens(text.normalize_text(F.col("prompt"))).alias("a"), text.tokens(text.normalize_text(F.col("response"))).alias("b"))
    return words.select("rollout_id", arrays.rounded(text.jaccard(text.shingles(F.col("a"), 1), text.shingles(F.col("b"), 1)), 9).alias("similarity"))


@query("SELECT vec_id, vec_id % 70 AS logits_start, vec_id % 70 + 5 AS logits_end FROM embeddings")
def logit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.pmod("vec_id", F.lit(70)) + 1
    bounds = arrays.logit_bounds(start, F.lit(5), start + 5)
    return table(spark, sf_dir, "embeddings").select("vec_id", bounds.alias("b")).select("vec_id", F.col("b.start").cast("long").alias("logits_start"), F.col("b.end").cast("long").alias("logits_end"))


@query(
    f"WITH {q._VIEW} SELECT m.method, rollout_id, CAST(CASE WHEN m.method = 'verifier_opd' THEN vw ELSE 1 END AS DOUBLE) AS verifier_weight, round(CASE WHEN m.method = 'confidence_opd' THEN list_max(w) / (list_sum(w) / len(w)) ELSE 1 END, 9)::DOUBLE AS largest FROM c, (SELECT unnest(['vanilla_opd', 'verifier_opd', 'confidence_opd']) AS method) m"
)
def view_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for method in views.METHODS[:3]:
        view = views.training_view(q._annotated(spark, sf_dir), method=method, max_length=60, weights={"pass": 1.0, "unknown": 0.5, "fail": 0.0})
        part = view.select("method", "rollout_id", "verifier_weight", arrays.rounded(F.array_max("confidence_weights"), 9).alias("largest"))
        out = part if out is None else out.unionByName(part)
    return out


_IDS = "list_transform(list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> ''), lambda t: 2 + list_sum(list_transform(generate_series(1, length(hex(t)), 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(t), i, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(t), i + 1, 1)) - 1)) % 254)"
_SPARE = "CASE WHEN len({x}) > 0 THEN {x} ELSE [1] END"


@query(
    f"WITH {q._TURN_PAIRS}, i AS (SELECT rollout_id, {_SPARE.format(x=_IDS.format(c='prompt'))} AS a, {_SPARE.format(x=_IDS.format(c='response'))} AS b FROM p) SELECT rollout_id, CAST(list_concat(a, b) AS BIGINT[]) AS input_ids, CAST(b AS BIGINT[]) AS response_token_ids, CAST(flatten(list_transform(b, lambda t: [t, (t + 1) % 256, (t + 2) % 256, (t + 3) % 256])) AS BIGINT[]) AS top_ids, len(a) + len(b) AS teacher_tokens, round(len(b) * 0.1, 6)::DOUBLE AS tail, round(len(b) * (ln(0.72) + 3 * ln(0.06)), 6) AS logprobs, round(len(b) * -(0.72 * ln(0.72) + 0.18 * ln(0.06) + 0.1 * ln(0.1 / 252)), 6) AS entropy FROM i"
)
def mock_annotation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = teacher.mock_annotations(q._turns(spark, sf_dir))
    wide = lambda c: F.col(c).cast("array<bigint>").alias(c)
    return out.select(
        "rollout_id",
        wide("input_ids"),
        wide("response_token_ids"),
        F.flatten("topk_token_ids").cast("array<bigint>").alias("top_ids"),
        F.col("teacher_tokens").cast("long").alias("teacher_tokens"),
        arrays.rounded(arrays.total(F.col("tail_mass")), 6).alias("tail"),
        arrays.rounded(arrays.total(F.flatten("topk_logprobs")), 6).alias("logprobs"),
        arrays.rounded(arrays.total(F.col("token_entropy")), 6).alias("entropy"),
    )


# ---------------------------------------------------------------- records' own rules


@query(f"WITH {q._ROLLOUTS}, v AS (SELECT rollout_id, list_filter([CASE WHEN candidate_index - 1 < 0 THEN 'candidate_index>=0' END, CASE WHEN response_tokens - 10 < 0 THEN 'response_tokens>=0' END, CASE WHEN status = 'failed' THEN 'status' END], lambda x: x IS NOT NULL) AS n FROM r) SELECT rollout_id, len(n) AS broken FROM v WHERE len(n) > 0")
def rollout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of rollout records on rows that break three of them now and then."""
    rows = q._lines(spark, sf_dir).withColumns({"candidate_index": F.col("candidate_index") - 1, "response_tokens": F.col("response_tokens") - 10, "latency_ms": F.lit(0), "status": F.when(F.col("status") == "failed", "lost").otherwise(F.col("status"))})
    return schemas.violations(rows, schemas.rules("rollout"), "rollout_id").select("rollout_id", F.size("violations").cast("long").alias("broken"))


@query("SELECT vec_id, CAST((vec_id % 3 = 0)::INT + (vec_id % 5 = 0)::INT AS BIGINT) AS broken FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 = 0")
def annotation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of annotation records: too few tail masses every third row, a negative latency every fifth."""
    ids = F.array(F.lit(1), F.lit(2))
    some = lambda k: F.pmod("vec_id", F.lit(k)) == 0
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.lit(1).alias("response_start"),
        F.lit(4).alias("teacher_tokens"),
        F.when(some(5), -1).otherwise(0).alias("latency_ms"),
        ids.alias("response_token_ids"),
        F.transform(ids, lambda i: F.array(i)).alias("topk_token_ids"),
        F.transform(ids, lambda i: F.array(F.lit(0.0))).alias("topk_logprobs"),
        F.when(some(3), F.array(F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.1))).alias("tail_mass"),
        F.array(F.lit(0.5), F.lit(0.5)).alias("token_entropy"),
        F.lit("success").alias("status"),
    )
    return schemas.violations(rows, schemas.rules("annotation"), "vec_id").select("vec_id", F.size("violations").cast("long").alias("broken"))


# ---------------------------------------------------------------- mocks and audits with numbers of their own


@query()
def mock_distillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the mock distillation on annotated turns (its logits are numpy's stream, which SQL hasn't)."""
    turns = q._turns(spark, sf_dir).withColumn("tokenizer_fingerprint", F.lit(teacher.FINGERPRINT))
    verdicts = turns.select("rollout_id", F.when(F.length("response") > 200, "pass").otherwise("fail").alias("status"))
    view = views.training_view(views.joined(turns, verdicts, teacher.mock_annotations(turns)), method="weighted_opd", max_length=2048, weights={"pass": 1.0, "unknown": 0.5, "fail": 0.0})
    out = training.mock_distillation(view)
    return spark.createDataFrame([(out["record_count"], out["initial_loss"], out["final_loss"], out["validation_score"])], "record_count long, initial_loss double, final_loss double, validation_score double")


@query()
def sparse_kl_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's rows; it draws its own distributions and reads no table."""
    rows = training.audit_sparse_kl()["rows"]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in rows[0].items()))


@query(f"WITH {q._ROLLOUTS} SELECT CAST(sample_id AS BIGINT) // 200 AS shard, count(*) * 2 AS records, CAST(max(CAST(sample_id AS BIGINT) % 200) AS BIGINT) AS last FROM (SELECT DISTINCT sample_id FROM r) GROUP BY 1")
def shard_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates of each order in shards of 200 by the order's number."""
    orders = q._lines(spark, sf_dir).select("sample_id").distinct().withColumn("n", F.col("sample_id").cast("long"))
    made = rollout.candidates(orders, 2, round_id=0, shard_size=200, rank="n")
    return made.groupBy("shard").agg(F.count("rollout_id").alias("records"), F.max(F.pmod("n", F.lit(200))).alias("last"))


@query(f"WITH {q._RESPONSES} SELECT rollout_id, CASE WHEN extracted IS NULL THEN 'unknown' WHEN k <> 5 AND off = 0 THEN 'pass' ELSE 'fail' END AS status, (CASE WHEN extracted IS NOT NULL AND k <> 5 AND off = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM y")
def verify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.verified(q._responses(spark, sf_dir), reference="reference").select("rollout_id", "status", "score")


# ---------------------------------------------------------------- what is resumed, and when to stop


_ROW_HASH = "CAST(concat('0x', left(sha256(concat(length(id), ':', id, length(o), ':', o, length(prompt), ':', prompt)), 15)) AS BIGINT)"
_WORK = "SELECT shard, count(*) AS n, sum(h) AS s, bit_xor(h) AS x FROM (SELECT shard, " + _ROW_HASH + " AS h FROM {}) GROUP BY shard"


@query(
    f"WITH w AS (SELECT o_orderkey // 100 AS shard, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS o, o_orderpriority || CASE WHEN o_orderkey % 500 = 7 THEN '!' ELSE '' END AS prompt, o_orderpriority AS before FROM orders),"
    f" a AS ({_WORK.format('w')}), b AS ({_WORK.format('(SELECT shard, id, o, before AS prompt FROM w)')}) SELECT a.shard, a.n AS rows, CAST(a.s AS VARCHAR) || ':' || CAST(a.x AS VARCHAR) AS digest, a.s = b.s AND a.x = b.x AS reusable FROM a JOIN b ON a.shard = b.shard"
)
def resume_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders as work in shards of 100 keys are, and which shards made before some prompts changed can be used again."""
    orders = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("shard"), "o_orderkey", "o_custkey", "o_orderpriority")
    columns = ("o_orderkey", "o_custkey", "prompt")
    want = orders.withColumn("prompt", F.concat("o_orderpriority", F.when(F.pmod("o_orderkey", F.lit(500)) == 7, "!").otherwise("")))
    stored = orders.withColumn("prompt", F.col("o_orderpriority")).withColumn("status", F.lit("success"))
    whole = rollout.complete_shards(stored, want, columns=columns).withColumn("_whole", F.lit(True))
    return rollout.work_digests(want, columns).join(whole, "shard", "left").select("shard", "rows", "digest", F.coalesce("_whole", F.lit(False)).alias("reusable"))


@query(f"{q._GATE}, o AS (SELECT shard, row_number() OVER (ORDER BY shard) AS k FROM c), w AS (SELECT shard, CAST(floor(log2(k)) AS BIGINT) AS wave FROM o), f AS (SELECT min(wave) AS stop FROM w WHERE shard = (SELECT min(shard) FROM c WHERE a >= 5000 AND b / a > 0.1205)) SELECT shard, wave, wave <= coalesce(stop, wave) AS made FROM w, f".replace(") SELECT shard, CAST(a AS BIGINT) AS successful_records, CAST(b AS BIGINT) AS truncated_records, round(b / a, 9) AS truncation_rate, CASE WHEN a >= 800 AND b / a > 0.12 THEN 'failed' WHEN a >= 800 THEN 'passed' ELSE 'collecting' END AS status FROM c", ")"))
def gate_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as prompts in shards of 500: the wave in which each shard is made, and whether the gate lets it come to that."""
    rows = q._lines(spark, sf_dir).withColumn("shard", F.floor(F.col("sample_id").cast("long") / 500))
    gate = reports.quality_gate(rows, shard="shard", max_new_tokens=45, min_samples=5000, max_rate=0.1205)
    placed = shared.table(prepare.ranked(gate, [F.col("shard")], "n"))
    edges = rollout.waves(placed.count())
    wave = F.lit(0).cast("long")
    for k, (first, _) in enumerate(edges):
        wave = F.when(F.col("n") >= first, F.lit(k).cast("long")).otherwise(wave)
    placed = placed.withColumn("wave", wave)
    stop = placed.join(reports.first_failure(placed, "shard").select(F.col("shard").alias("_failed")), F.col("shard") == F.col("_failed")).agg(F.min("wave").alias("_stop"))
    return placed.join(F.broadcast(stop), F.lit(True)).select("shard", "wave", (F.col("wave") <= F.coalesce("_stop", "wave")).alias("made"))


_STEPS = f"{q._RESPONSES.strip()}, v AS (SELECT 'run ' || CAST(n % 3 AS VARCHAR) AS run, n // 3 % 12 AS step, CASE WHEN extracted IS NULL THEN 0 ELSE 1 END AS found, CASE WHEN extracted IS NOT NULL AND k <> 5 AND off = 0 THEN 1 ELSE 0 END AS right_answer FROM (SELECT *, CAST(substr(rollout_id, 2) AS BIGINT) AS n FROM y))"


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as three runs' validation at twelve steps, turns of conversations as their instructions."""
    key = F.substring("rollout_id", 2, 20).cast("long")
    math_rows = q._responses(spark, sf_dir).select(F.concat(F.lit("run "), F.pmod(key, F.lit(3)).cast("string")).alias("run"), F.pmod(F.floor(key / 3), F.lit(12)).alias("step"), "response", F.col("reference").alias("reference_answer"))
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("run "), F.pmod("conv_id", F.lit(3)).cast("string")).alias("run"), F.col("turn").alias("step"), F.col("text").alias("response"), F.lit('{"ends_with": "."}').alias("metadata"))
    return evaluation.validation_points(math_rows, turns)


@query(
    f"WITH {_STEPS}, m AS (SELECT run, step, avg(right_answer) AS a, avg(found) AS f FROM v GROUP BY ALL), c AS (SELECT 'run ' || CAST(conv_id % 3 AS VARCHAR) AS run, turn AS step, avg(CASE WHEN ends_with(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '.') THEN 1 ELSE 0 END) AS i FROM conversations GROUP BY ALL)"
    " SELECT run, step, round(a, 9) AS validation_accuracy, round(f, 9) AS format_pass_rate, round(coalesce(i, 0), 9) AS instruction_regression_score, round(0.8 * a + 0.1 * f + 0.1 * coalesce(i, 0), 9) AS composite_score FROM m LEFT JOIN c USING (run, step)"
)
def validation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, format, instructions and the composite score of every run and step."""
    out = _validation(spark, sf_dir)
    return out.select("run", "step", *(arrays.rounded(c, 9).alias(c) for c in ("validation_accuracy", "format_pass_rate", "instruction_regression_score", "composite_score")))


def _same_words(reference: str, candidate: str) -> bool:
    """A comparer of the queries: the words of both, whatever their order."""
    return sorted(reference.split("_")) == sorted(candidate.split("_"))


@query("SELECT c_custkey, c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) = CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NONE' END || '_' || CAST(c_nationkey AS VARCHAR) AS equivalent FROM customer")
def answer_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of words that a registered comparer calls the same in any order; every second has another word."""
    answers.COMPARERS["words"] = lambda: _same_words
    number = F.col("c_nationkey").cast("string")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("_"), number).alias("reference"), F.concat(number, F.lit("_"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_mktsegment")).otherwise("NONE")).alias("candidate"))
    return answers.with_equivalence(rows, "reference", "candidate", comparer="words").select("c_custkey", "equivalent")


@query()
def artifact_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content hash of each table's folder, by byte ranges (SQL reads rows, not files)."""
    out = None
    for name in ("lineitem", "orders", "documents", "pages"):
        one = digests.folder_root(digests.table_roots(spark, f"{sf_dir}/{name}.parquet")).select(F.lit(name).alias("name"), "files", "root")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- stages


_FIRST = f"f AS (SELECT * FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY lower({q._T}) ORDER BY doc_id) AS k FROM documents WHERE {q._T} <> '') WHERE k = 1)"
_KEPT = f"k AS (SELECT f.*, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS words FROM f WHERE doc_id NOT IN (SELECT doc_id FROM best WHERE k = 1 AND score >= 0.1))"


@query(
    f"WITH {q._SHINGLES}, {q._BEST}, {_FIRST}, {_KEPT}, n AS (SELECT (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM k) AS k, (SELECT count(*) FROM k WHERE words < 1000) AS short)"
    " SELECT t.stage, CASE t.stage WHEN 'prepare' THEN f WHEN 'audit' THEN f WHEN 'view' THEN 2 * short ELSE 2 * k END AS records FROM n, (SELECT unnest(['prepare', 'audit', 'rollout', 'verify', 'select', 'annotate', 'view']) AS stage) t"
)
def stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that each stage's manifest counts: documents as prompts from raw rows to a training view, against the benchmark."""
    root = f"{shared.folder(spark)}/stages-{uuid4().hex}"
    evals = f"{root}/eval.parquet"
    raw = records.with_row(table(spark, sf_dir, "documents")).select("row", "doc_id", F.col("text").alias("problem"), F.lit("0").alias("answer"), F.col("lang").alias("subject"))
    table(spark, sf_dir, "benchmark").orderBy("item_id").select(F.col("item_id").cast("string").alias("sample_id"), F.col("text").alias("problem")).write.parquet(evals)
    s = Stages(spark, {"project": {"seed": 42}}, root)
    done = {"prepare": s.prepare(raw, smoke=0, validation=0, train=1 << 60, allow_smaller=True, order=("doc_id",)), "audit": s.audit([evals], threshold=0.1)}
    done["rollout"] = s.rollouts(k=2, shard_size=1000)
    done["verify"], done["select"], done["annotate"] = s.verify(), s.select(k=2), s.annotate(shard_size=5000)
    done["view"] = s.view(max_length=1000)
    return spark.createDataFrame([(name, m["record_count"]) for name, m in done.items()], "stage string, records long")


@query(f"WITH {q._SHINGLES}, {q._BEST} SELECT doc_id AS sample_id, item_id AS eval_id, round(score, 9) AS score FROM best WHERE k = 1 AND score >= 0.1")
def decontam_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`decontam_near` with an index of evaluation texts that is too large to broadcast."""
    docs, evals = q._train_eval(spark, sf_dir)
    return contamination.near(docs, evals, threshold=0.1, broadcast_hashes=0).select("sample_id", "eval_id", arrays.rounded("score", 9).alias("score"))
