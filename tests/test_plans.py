"""Whole plans, snapshots, catalogue states and streams."""

import pytest
from pyspark.sql import functions as F

from quillspan.extensions import ExtractiveGenerator, HashingEmbedder, HeadingEnricher, NoEvidence, NoKnowledge, NoReranking, SemanticRetrieval
from quillspan.operators import catalog, retrieval, snapshot
from quillspan.plans.ingest import CHUNK_SCHEMA, ingest
from quillspan.plans.question import ask
from quillspan.streaming.ingest import ingest_stream, ingested
from quillspan.streaming.tokens import folded_stream

SF = "/root/testdata/sf0.001"


def uploads(spark, n=12):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id < {n}")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit(".txt")).alias("filename"), F.lit("2024-01-01").alias("upload_date"), F.lit("txt").alias("extension"), F.sha2("text", 256).alias("sha256"), "text")


def test_ingest_then_ask(spark):
    chunks = ingest(uploads(spark))
    assert [(f.name, f.dataType) for f in chunks.schema.fields] == [(f.name, f.dataType) for f in CHUNK_SCHEMA.fields]
    chunks = chunks.cache()
    assert "Exchange" not in chunks._jdf.queryExecution().optimizedPlan().toString()
    target = chunks.where("document_id = '3' and chunk_index = 0").first()
    messages = spark.createDataFrame([("c", 0, "user", "hi"), ("c", 1, "assistant", "yes")], "conversation string, id int, role string, text string")
    questions = spark.createDataFrame([(1, target.text, "c"), (2, "", "d")], "query_id long, question string, conversation string")
    got = {r.query_id: r for r in ask(questions, chunks, messages).collect()}
    assert got[1].sources[0].provenance_id == target.provenance_id
    assert got[1].sources[0].similarity == pytest.approx(1.0)
    assert "User: hi" in got[1].prompt and target.text[:50] in got[1].prompt
    assert got[1].answer
    assert got[2].sources is None
    chunks.unpersist()


def test_extension_defaults(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    v = [r[0] for r in df.select(HashingEmbedder(16).embed(F.col("text"))).collect()]
    assert len(v[0]) == 16 and sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-6) and not any(v[1])
    assert NoKnowledge().facts(df) is None
    assert NoEvidence().verify(df).first().verified is False
    assert NoReranking().rerank(df) is df
    assert isinstance(HeadingEnricher(), HeadingEnricher) and isinstance(ExtractiveGenerator(), ExtractiveGenerator)
    assert SemanticRetrieval(3).k == 3


def test_ranking_ties_and_thresholds(spark):
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.top_k(vectors, [1.0, 0.0], 2).orderBy("rank").collect()] == [1, 3]
    questions = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in retrieval.top_k_batch(vectors, questions, 1, None).collect()] == [(1, 1)]
    assert retrieval.top_k_batch(vectors, questions.limit(0)).count() == 0


def test_writes(spark):
    docs = spark.createDataFrame([(1, 0), (2, 1)], "id int, is_deleted int")
    gone = spark.createDataFrame([(1,), (2,), (9,)], "id int")
    assert sorted(tuple(r) for r in catalog.soft_deleted(docs, gone).collect()) == [(1, 1, True), (2, 1, False)]
    talks = spark.createDataFrame([("a", 1, "t", 5)], "id string, user_id int, title string, updated_at int")
    said = spark.createDataFrame([("a", 1, 7), ("b", 1, 8)], "conversation_id string, user_id int, timestamp int")
    assert catalog.renamed(talks, "a", 2, "x", F.lit(9)).first().title == "t"
    assert catalog.renamed(talks, "a", 1, "  ", F.lit(9)).first().title == "t"
    assert catalog.touched(talks, said).first().updated_at == 7
    left = catalog.without_conversation(talks, said, "a", 1)
    assert left[0].count() == 0 and [r.conversation_id for r in left[1].collect()] == ["b"]
    chunks = spark.createDataFrame([("d", 1, "g", "2024-02"), ("d", 0, "f", "2024-01"), ("", 0, "h", "2024-03")], "document_id string, chunk_index int, filename string, upload_date string")
    assert [tuple(r) for r in catalog.documents_of_chunks(chunks).collect()] == [("d", 2, "f", "2024-01")]


def test_restore_takes_shared_columns(spark):
    live = spark.createDataFrame([], "id long, name string, role string")
    saved = spark.createDataFrame([(1, "a", "gone")], "id int, name string, old string")
    got = snapshot.restored(live, saved, {"role": F.lit("user")})
    assert got.columns == ["id", "name", "role"] and tuple(got.first()) == (1, "a", "user")
    assert snapshot.restored(live, saved.select("old")) is None
    assert snapshot.restorable_tables(["users", "sqlite_x", "_migrations"]) == ["users"]


def test_snapshot_round_trip_and_tampering(spark, tmp_path):
    users = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    snapshot.save({"users": users}, str(tmp_path))
    assert sorted(map(tuple, snapshot.load(spark, str(tmp_path))["users"].collect())) == [(1, "a"), (2, None)]
    users.limit(1).write.mode("overwrite").parquet(str(tmp_path / "users"))
    with pytest.raises(ValueError, match="differs"):
        snapshot.load(spark, str(tmp_path))


def test_snapshot_files_are_checked_one_by_one(spark, tmp_path):
    """Rows dealt to other files are the same table, but not the snapshot; nor is a file too many."""
    rows = spark.range(10).withColumn("name", F.col("id").cast("string"))
    snapshot.save({"a": rows.repartition(2), "b": rows}, str(tmp_path))
    assert {n: t.count() for n, t in snapshot.load(spark, str(tmp_path)).items()} == {"a": 10, "b": 10}
    rows.limit(0).write.mode("append").parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="differs"):
        snapshot.load(spark, str(tmp_path))


def test_questions_with_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 2.0]), (8, []), (9, [3.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.top_k_batch(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 2, None).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 6)) for r in got) == [
        (1, 1, 1, 1.0), (1, 2, 9, 0.707107), (6, 1, 6, 1.0), (7, 1, 7, 1.0), (7, 2, 9, 0.707107), (9, 1, 9, 1.0), (9, 2, 1, 0.707107)]


def test_extension_points_are_called(spark):
    class Facts:
        def facts(self, questions):
            return questions.select("query_id", F.lit("FACTS").alias("structured"))

    class Route:
        def route(self, questions):
            return questions.withColumn("route", F.lit("both"))

    class Proof:
        def verify(self, answers):
            return answers.withColumn("verified", F.col("route") == "both")

    asked = spark.createDataFrame([(1, "anything at all")], "query_id long, question string")
    got = ask(asked, ingest(uploads(spark)), knowledge=Facts(), planner=Route(), evidence=Proof()).first()
    assert "FACTS" in got.prompt and got.verified
    plain = ask(asked, ingest(uploads(spark))).first()
    assert plain.route == "semantic" and not plain.verified and "{structured}" not in plain.prompt


def test_ingest_stream_appends_once(spark, tmp_path):
    source = tmp_path / "in"
    uploads(spark, 4).coalesce(1).write.parquet(str(source))
    plan = lambda df: ingest(df)
    read = lambda: spark.readStream.schema(uploads(spark).schema).parquet(str(source))
    ingest_stream(read(), plan, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == ingest(uploads(spark, 4)).dropDuplicates(["provenance_id"]).count()
    ingest_stream(read(), plan, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()  # the batch again
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    ingest_stream(read(), plan, str(tmp_path / "out"), str(tmp_path / "c3"), name="other").awaitTermination()
    both = spark.read.parquet(str(tmp_path / "out"))
    assert both.count() == 2 * n and ingested(both).count() == n


def test_token_stream_folds_like_the_batch(spark, tmp_path):
    schema = "stream_id long, seq long, ts timestamp, token string, done boolean"
    rows = [(1, i, f"t{i} ", False) for i in range(5)] + [(1, 5, "", True), (1, 6, "late", False)]
    rows += [(2, i, "the same phrase over and over ", False) for i in range(200)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, token string, done boolean").selectExpr("stream_id", "seq", "timestamp_seconds(seq) ts", "token", "done")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = folded_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.stream_id: r for r in spark.sql("select * from folded").collect()}
    assert (got[1].answer, got[1].n_tokens, got[1].done) == ("t0 t1 t2 t3 t4 ", 5, True)
    assert got[2].stopped and got[2].n_tokens == 80


def test_session_facts_and_report(spark, tmp_path):
    from quillspan.plans.report import report_lines, write_report
    from quillspan.streaming.recorder import FACTS, record, recorded

    rows = [("r1", "upload", "split", 30.0, None, None), ("r1", "upload", "embed", 70.0, None, None), ("r2", "upload", "embed", 130.0, None, None)]
    target = str(tmp_path / "facts")
    for session, some in (("a", rows[:2]), ("a", rows[2:]), ("b", rows[:1])):
        record(spark.createDataFrame(some, FACTS), target, session)
    assert recorded(spark, target).count() == 4 and recorded(spark, target, "b").count() == 1
    write_report(report_lines(recorded(spark, target, "a"), "stage", "ms", "Session a"), str(tmp_path / "md"))
    lines = "".join(p.read_text() for p in (tmp_path / "md").glob("part-*")).split("\n")
    assert lines[:7] == ["# Session a", "", "| Stage | Mean time (ms) | % of total |", "|---|---|---|", "| embed | 100.0 | 76.9% |", "| split | 30.0 | 23.1% |", "| **Total** | **130.0** | **100%** |"]
    assert "**Bottleneck**: embed (76.9% of total time)" in lines and '    "split" : 30.0' in lines
    assert lines[-4:] == ["| embed | 130.0 |", "| embed | 70.0 |", "| split | 30.0 |", ""]
    assert report_lines(spark.createDataFrame([], FACTS), "stage", "ms", "none").count() == 0


def test_paced_stream_bounds_a_batch(spark, tmp_path):
    from quillspan.streaming.ingest import paced

    source, out = tmp_path / "in", tmp_path / "out"
    uploads(spark, 5).repartition(5).write.parquet(str(source))
    files = len(list(source.glob("part-*")))
    ingest_stream(paced(spark, str(source), uploads(spark).schema, 2), ingest, str(out), str(tmp_path / "c")).awaitTermination()
    assert len(list(out.glob("stream=ingest/batch=*"))) == -(-files // 2)
    assert ingested(spark.read.parquet(str(out))).count() == ingest(uploads(spark, 5)).dropDuplicates(["provenance_id"]).count()


def test_manifest_and_requests(spark):
    from quillspan.functions.requests import embed_request
    from quillspan.sources.manifests import component_rows, manifest_rows

    one = '[[component]]\nname = "m"\nkind = "model"\nurl = "u"\nsha256 = "0"\nsize = 9\ndest = "{data}/m"\nexec = false\n'
    first, second = component_rows(spark, one + one.replace('"m"', '"n"') + 'target = "x"\nunpack_dir = true\n').orderBy("listed").collect()
    assert (first.name, first.target, first.unpack_dir, first.listed) == ("m", None, False, 1) and (second.target, second.unpack_dir) == ("x", True)
    for broken in ("", one.replace("size = 9\n", ""), one + 'unpack_dir = true\narchive_member = "a"\n'):
        with pytest.raises(ValueError):
            manifest_rows(broken)
    df = spark.createDataFrame([(["a"],), (["a", "b"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(embed_request(F.col("t"), "e")).collect()] == ['{"model":"e","input":"a"}', '{"model":"e","input":["a","b"]}', '{"model":"e","input":[]}']
