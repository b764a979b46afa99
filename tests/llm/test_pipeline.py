"""The pipeline's stages, each on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import brute
from quillspan.llm import common, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def test_columns_are_kept(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = before.join(labels.where("toxic = 0"), "doc_id")
    assert after.join(labels.where("toxic = 0"), "doc_id").count() >= 0.98 * clean.count()
    assert after.count() < before.count()


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after = stages["near_duplicates"]
    classes = brute.near_classes([tuple(r) for r in before.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(classes.values()))


def test_secrets_are_blacked_out(stages):
    before, after = stages["secrets"]
    assert after.count() == before.count()
    assert all(not brute.base_spans(r.text) and r.n_chars == len(r.text) for r in after.collect())
    same = before.join(after.withColumnRenamed("text", "clean"), "doc_id").where(F.col("text") == F.col("clean")).count()
    assert same >= sum(not brute.base_spans(r.text) for r in before.collect()) * 0.99


def test_the_mix_nears_its_targets(stages):
    before, after = stages["mixing"]
    words = lambda df: sum(len(brute.words(r.text)) for r in df.collect())
    assert words(after) == pytest.approx(1.5 * words(before), rel=0.1)
    assert {r["count"] for r in after.groupBy("doc_id").count().collect()} <= {1, 2}


def test_packing_takes_all_rows(stages):
    before, after = stages["packing"]
    assert after.where("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_python_workers_get_small_batches(spark, stages):
    """A task's whole split in one batch took an executor past its memory."""
    corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1500).alias("text"))  # 30 MB in one task
    sizes = [r.n for r in rows.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()]
    assert sum(sizes) > 29_000_000 and max(sizes) < 2 * common.BATCH_BYTES
