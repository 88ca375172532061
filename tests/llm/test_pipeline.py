import collections

from pyspark.sql import functions as F

import corpus_pipeline
from stateforge.llm import kit, toxicity
from tests.conftest import DATA
from tests.llm.test_operators import SCHEMA, classes, rows

FOLDER = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "secrets", "mixing", "bpe"]
    steps = dict(corpus_pipeline.STAGES)

    clean = kit.written(steps["toxicity"](spark, docs, FOLDER), "t")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < corpus_pipeline.TOXIC}

    single = kit.written(steps["ngram_jaccard"](spark, clean, FOLDER), "j")
    items = [(r.doc_id, r.text) for r in clean.orderBy("doc_id").collect()]
    found, size = classes(items, corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    assert sorted(r.doc_id for r in single.collect()) == sorted(items[k][0] for k in range(len(items)) if not size[k] or found[k] == k)

    safe = kit.written(steps["secrets"](spark, single, FOLDER), "s")
    assert safe.count() == single.count() and safe.where("text rlike '[0-9a-f]{16,}'").count() == 0
    assert safe.where("n_chars <> length(text)").count() == 0

    mixed = kit.written(steps["mixing"](spark, safe, FOLDER), "m")
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    for df in (clean, single, safe, mixed):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes

    out = steps["bpe"](spark, mixed, FOLDER)
    assert out.count() == mixed.count() == corpus_pipeline.run(spark, FOLDER).count()


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    """Every stage on null ids, texts and sources, repeated rows, ties and columns named like the operators' own."""
    odd = rows() + [(None, None, None, None, None, *rows()[0][5:])] * 2
    docs = spark.createDataFrame([(*r, "t", 1.5) for r in odd], SCHEMA + ", _text string, _score double").repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    count = lambda df: collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())

    clean = kit.written(steps["toxicity"](spark, docs, FOLDER), "t")
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")), keep=("doc_id", "text", "source"))
    assert count(clean) == count(scored.where(F.col("score") < corpus_pipeline.TOXIC)) and (None, None, None) in count(clean)

    single = kit.written(steps["ngram_jaccard"](spark, clean, FOLDER), "j")
    items = sorted(count(clean).elements(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    found, size = classes([r[:2] for r in items], corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    assert single.count() == sum(1 for k in range(len(items)) if not size[k] or found[k] == k)
    assert not count(single) - count(clean)

    safe = kit.written(steps["secrets"](spark, single, FOLDER), "s")
    assert safe.count() == single.count() and safe.where("text IS NULL").count() == single.where("text IS NULL").count()
    assert safe.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0

    for before in (safe, docs):  # with repeated rows too
        mixed = kit.written(steps["mixing"](spark, before, FOLDER), "m")
        had, has = count(before), count(mixed)
        assert set(has) <= set(had) and all(n <= 2 * had[r] for r, n in has.items())
    for df in (clean, single, safe, mixed):
        assert df.dtypes == docs.dtypes
    assert steps["bpe"](spark, mixed, FOLDER).count() == mixed.count()
