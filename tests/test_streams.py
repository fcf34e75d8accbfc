"""Streams of files and events: each content once, after a restart too; failures by file; windows and late events."""

import os
import shutil

from pyspark.sql import functions as F
from test_files import word

from inkveil.registry import Settings
from inkveil.streaming import jobs

EMAILS = Settings(only=frozenset({"EMAIL"}), propagate=False)


def run(spark, folder, out, **more):
    jobs.analyse_files(jobs.stream_files(spark, f"{folder}/in", **more), f"{out}/found", f"{out}/checkpoint", EMAILS).awaitTermination()
    items = sorted((r.value, r["count"]) for r in spark.read.parquet(f"{out}/found/items").collect())
    files = sorted((os.path.basename(r.path), r.error or "") for r in spark.read.parquet(f"{out}/found/files").collect())
    return items, files


def test_raw_files(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "sub")
    (tmp_path / "in" / "a.txt").write_text("mail a@mail.org\n\nand A@mail.org")
    (tmp_path / "in" / "b.docx").write_bytes(word("到 b@mail.org"))
    (tmp_path / "in" / "c.pdf").write_text("c@mail.org")
    (tmp_path / "in" / "d.docx").write_text("no word file")
    (tmp_path / "in" / "e.txt").write_text("e@mail.org " * 1000)
    shutil.copy(tmp_path / "in" / "a.txt", tmp_path / "in" / "sub" / "copy.md")
    items, files = run(spark, tmp_path, tmp_path, most_bytes=5000)
    assert items == [("a@mail.org", 2), ("b@mail.org", 1)]
    names = {n for n, _ in files}
    assert len(names & {"a.txt", "copy.md"}) == 1 and {"b.docx", "c.pdf", "d.docx", "e.txt"} <= names and len(files) == 5
    errors = dict(files)
    assert errors["b.docx"] == "" and "kind" in errors["c.pdf"] and errors["d.docx"] and "5000" in errors["e.txt"]

    # a restart: contents seen before stay out under new names, new ones come in
    shutil.copy(tmp_path / "in" / "a.txt", tmp_path / "in" / "late.txt")
    shutil.copy(tmp_path / "in" / "b.docx", tmp_path / "in" / "late.docx")
    (tmp_path / "in" / "new.txt").write_text("new@mail.org")
    items, files = run(spark, tmp_path, tmp_path, most_bytes=5000)
    assert items == [("a@mail.org", 2), ("b@mail.org", 1), ("new@mail.org", 1)] and len(files) == 6
    # a batch that ran, but whose end was not noted, runs again and leaves the same rows
    last = max((int(n) for n in os.listdir(tmp_path / "checkpoint" / "commits") if n.isdigit()))
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    again, _ = run(spark, tmp_path, tmp_path, most_bytes=5000)
    assert again == items


def test_repeats_of_texts(spark, tmp_path):
    rows = [(1, "same", "2024-01-01 00:00:00"), (2, "same", "2024-01-01 01:00:00"), (3, "other", "2024-01-01 02:00:00"), (4, None, "2024-01-01 02:00:00"), (5, None, "2024-01-01 03:00:00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    stream = jobs.without_repeats(jobs.stream_documents(spark, f"{tmp_path}/docs", docs.schema), "at")
    jobs.write_items(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got & {1, 2}) == 1 and 3 in got and len(got & {4, 5}) == 1


def test_windows(spark, tmp_path):
    """Open windows aren't given out; events later than the watermark are left out of the stream, and counted in a table."""
    first = [("2024-01-01 05:00:00", "a", 1.0), ("2024-01-01 06:00:00", "a", None), ("2024-01-02 01:00:00", "b", 2.0), ("2024-01-06 00:00:00", "a", 1.0)]
    late = [("2024-01-01 07:00:00", "a", 1.0), ("2024-01-05 07:00:00", "a", 1.0)]
    kind = "ts string, event_type string, value double"
    for k, rows in enumerate((first, late)):
        spark.createDataFrame(rows, kind).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        schema = spark.read.parquet(f"{tmp_path}/events").schema
        counted = jobs.window_counts(jobs.stream_documents(spark, f"{tmp_path}/events", schema))
        jobs.write_items(counted, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        got = {(str(r.window_start)[:10], r.event_type): (r.events, r.hits) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert got == {("2024-01-01", "a"): (2, 1), ("2024-01-02", "b"): (1, 1)}, k
    table = jobs.window_counts(spark.read.parquet(f"{tmp_path}/events")).collect()
    assert {(str(r.window_start)[:10], r.event_type): (r.events, r.hits) for r in table}["2024-01-01", "a"] == (3, 2)


def test_stream_detect_by_writing(spark, tmp_path):
    """A value in two writings within one document has two rows, as in the SQL."""
    import duckdb

    from inkveil.oracle import ORACLE_SQL
    from inkveil.queries import QUERIES

    text = "abcd@mail.com Abcd@mail.com abcd@mail.com pay 4539148803436467 or 4539 1488 0343 6467."
    spark.createDataFrame([(1, text), (2, text[:14]), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["stream_detect"](spark, str(tmp_path)).select("doc_id", "type_id", "value", "masked", "n").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE_SQL["stream_detect"]).fetchall()) and len(got) == 5
