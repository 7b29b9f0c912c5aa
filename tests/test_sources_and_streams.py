import pytest
from pyspark.sql import functions as F

from marlspring.sources.files import Collection, InputError, append_log, markdown_table, read_gold, read_qrels, read_queries, read_runs, read_texts, write_csv
from marlspring.streaming import jobs as J


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_queries(spark, tmp_path):
    ok = put(tmp_path / "q.jsonl", '{"qid": "1", "question": "a"}\n\n{"qid": "2", "question": "b", "more": 1}\n')
    assert {r.qid: r.question for r in read_queries(spark, ok).collect()} == {"1": "a", "2": "b"}
    for bad in ('{"qid": "1"}', "not json", '{"qid": "1", "question": "a"}\n{"qid": "1", "question": "b"}'):
        with pytest.raises(InputError):
            read_queries(spark, put(tmp_path / "bad.jsonl", bad))


def test_qrels(spark, tmp_path):
    ok = put(tmp_path / "a.csv", "qid,doc_id,relevance\n1,a,2\n1,a,2\n1,b,0\n")
    assert sorted((r.qid, r.doc_id, r.relevance) for r in read_qrels(spark, ok).collect()) == [("1", "a", 2), ("1", "b", 0)]
    for bad in ("qid,doc_id\n1,a\n", "qid,doc_id,relevance\n1,a,3\n", "qid,doc_id,relevance\n1,a,x\n", "qid,doc_id,relevance\n1,a,1\n1,a,2\n"):
        with pytest.raises(InputError):
            read_qrels(spark, put(tmp_path / "bad.csv", bad))


def test_runs_by_several_names(spark, tmp_path):
    p = put(tmp_path / "r.jsonl", '{"qid": "1", "results": [{"doc_id": "a", "rank": 3}, {"document_id": "b", "score": 0.5}]}\n{"query_id": "2", "hits": [{"id": "c", "idx": 0}]}\n')
    assert sorted((r.qid, r.doc_id, r["rank"]) for r in read_runs(spark, p).collect()) == [("1", "a", 3), ("1", "b", 2), ("2", "c", 1)]


def test_gold_with_byte_order_mark(spark, tmp_path):
    p = put(tmp_path / "g.csv", "﻿doc_id,gold_a\n1,x\n")
    r = read_gold(spark, p, ["doc_id", "gold_a"], ["note"]).first()
    assert (r.doc_id, r.gold_a, r.note) == ("1", "x", None)
    with pytest.raises(InputError):
        read_gold(spark, p, ["missing"])


def test_csv_log_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "m string, v double")
    write_csv(df.coalesce(1), str(tmp_path / "out"), ["m", "v"], 4)
    lines = sorted(x for p in (tmp_path / "out").glob("*.csv") for x in p.read_text().splitlines())
    assert lines == ["a,0.5000", "b,", "m,v"]
    append_log(df, str(tmp_path / "log"))
    append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert "| a | 0.5000 |" in markdown_table(df, ["m", "v"])


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.insert(spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("x").alias("content")))
    c.insert(spark.range(300, 310).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("y").alias("content")))
    assert c.count() == 310 and c.of_document(305).first().content == "y"
    assert [r.doc_id for r in c.scan(3, 5).collect()] == [5, 6, 7]
    c.delete(spark.range(0, 310, 2).select(F.col("id").alias("doc_id")))
    assert c.count() == 155 and c.of_document(4).count() == 0 and c.of_document(5).count() == 1
    other = Collection(spark, str(tmp_path / "d"))
    assert c.migrate(other).count() == 0 and other.count() == 155


def test_texts_have_a_status(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    put(d / "a.txt", "text"), put(d / "b.txt", ""), put(d / "c.txt", "  \n")
    assert {r.path.rsplit("/", 1)[1]: r.status for r in read_texts(spark, str(d)).collect()} == {"a.txt": "ok", "c.txt": "NO_TEXT_EXTRACTED"}


def attempts(spark, rows):
    return spark.createDataFrame(rows, "item long, attempt long, failed boolean")


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    first = attempts(spark, [(1, 1, True), (1, 2, True), (2, 1, False)])
    first.coalesce(1).write.parquet(src)
    stream = lambda: J.failure_gate(J.folder(spark, src, first.schema))
    J.run_once(stream(), out, mark)
    attempts(spark, [(1, 3, True), (1, 4, False), (2, 2, True)]).coalesce(1).write.mode("append").parquet(src)
    J.run_once(stream(), out, mark)
    got = {(r.item, r.attempt): r.allowed for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): True, (1, 4): False, (2, 1): True, (2, 2): True}


def test_batches_see_every_row_once(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    attempts(spark, [(k, 1, False) for k in range(40)]).repartition(4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    J.run_batches(J.folder(spark, src, schema, files_per_trigger=1), lambda df, i: seen.append((i, df.count())), str(tmp_path / "ck"))
    assert len(seen) >= 4 and sum(n for _, n in seen) == 40 and len({i for i, _ in seen}) == len(seen)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(2000).select(F.timestamp_seconds(F.col("id") * 97).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), (F.col("id") % 7).cast("double").alias("value"), (F.col("id") % 5).alias("user_id"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    J.run_once(J.hourly_counts(J.folder(spark, str(tmp_path / "in"), rows.schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    key = lambda df: {(r.start, r.event_type): (r.n, r.sum_value) for r in df.collect()}
    streamed, batch = key(spark.read.parquet(str(tmp_path / "out"))), key(J.hourly_counts(rows))
    assert streamed.items() <= batch.items() and len(batch) - len(streamed) <= 6  # hours the watermark hasn't closed
