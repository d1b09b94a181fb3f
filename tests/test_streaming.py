import os
from datetime import datetime

from pyspark.sql import functions as F

from cueflow.operators import knowledge
from cueflow.plans.validation import validation_report
from cueflow.sources import codec
from cueflow.sources.knowledge_store import read_version
from cueflow.streaming import jobs
from tests.test_knowledge import kb_of


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def srt(n, extra=0):
    return "\n\n".join(
        f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i + 1 + extra:02d},000\nline {i}" for i in range(n))


def test_arriving_files_equal_the_batch(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    put(inbox, "a.srt", srt(4))
    jobs.run_available(jobs.arriving_issues(spark, inbox), out, progress)
    put(inbox, "b.vtt", "WEBVTT\n\n00:01.000 --> 00:01.100\nshort")
    jobs.run_available(jobs.arriving_issues(spark, inbox), out, progress)
    got = spark.read.parquet(out).groupBy("issue_type").count().collect()
    assert {(r["issue_type"], r["count"]) for r in got} == {
        ("duration_short", 4), ("duration_too_short", 1), ("cps_too_high", 1)}


def test_report_per_batch(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    put(inbox, "a.srt", srt(5, extra=1))
    jobs.report_per_batch(spark, inbox, out, progress)
    [row] = spark.read.parquet(out).collect()
    docs = spark.createDataFrame([("a", srt(5, extra=1))], "doc_id string, content string")
    [batch] = validation_report(codec.parse_srt(docs)).collect()
    for name in ("segment_count", "overlap_count", "errors", "warnings"):
        assert row[name] == batch[name]
    assert row["overlap_count"] == 4


PAIRS = (
    "wrong_term string, correct_term string, topic string, industry string, country string, "
    "tags array<string>, seq long"
)


def test_knowledge_versions_survive_a_repeated_batch(spark, tmp_path):
    inbox, path, progress = (str(tmp_path / n) for n in ("in", "kb", "progress"))
    rows = [("a", "b", "t", "i", "c", [], n) for n in range(3)] + [("k", "K", "t", "i", "c", [], 9)]
    spark.createDataFrame(rows, PAIRS).write.mode("append").parquet(inbox)
    start = kb_of(spark, [("k", "K", "t", "i", "c", 5)])
    stream = spark.readStream.schema(PAIRS).parquet(inbox)
    jobs.knowledge_versions(stream, start, path, progress)
    got = {r["wrong_term"]: r["count"] for r in read_version(spark, path, 1).collect()}
    assert got == {"a": 3, "k": 6}
    again = knowledge.upsert(read_version(spark, path, 0), spark.read.schema(PAIRS).parquet(inbox))
    assert {r["wrong_term"]: r["count"] for r in again.collect()} == got


def test_running_counts(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.createDataFrame([("a", "b", "t", "i", "c", [], n) for n in range(3)], PAIRS).write.parquet(inbox)
    counts = jobs.knowledge_counts(spark.readStream.schema(PAIRS).parquet(inbox))
    query = (counts.writeStream.outputMode("update").format("memory").queryName("kb_counts")
             .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert [r["count"] for r in spark.table("kb_counts").collect()] == [3]


def test_windows_also_open_ones_without_late_rows(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = jobs.LOG_SCHEMA

    def arrive(*days):
        rows = [("t", 1, day % 2 == 0, datetime(2024, 1, day, 12)) for day in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        run()

    def run():
        jobs.run_outcome_windows(spark.readStream.schema(schema).parquet(inbox), out, progress)

    def windows():
        return {(r["window_start"].day, r["applied"], r["successful"])
                for r in jobs.read_outcome_windows(spark, out).withColumn(
                    "window_start", F.col("window_start").cast("timestamp_ntz")).collect()}

    arrive(1, 2, 10)
    assert windows() == {(1, 1, 0), (2, 1, 1), (10, 1, 1)}  # also the windows still open
    arrive(1, 10, 20)  # the first is too late by now, its window is closed
    want = {(1, 1, 0), (2, 1, 1), (10, 2, 2), (20, 1, 1)}
    assert windows() == want
    run()  # nothing new
    assert windows() == want


def test_windows_survive_a_restart_within_a_batch(spark, tmp_path):
    """A batch whose files were written, but which was not yet marked as done, is written again."""
    inbox, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = jobs.LOG_SCHEMA
    for day in (3, 4):
        rows = [("t", 1, True, datetime(2024, 1, day, hour)) for hour in range(day)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        jobs.run_outcome_windows(spark.readStream.schema(schema).parquet(inbox), out, progress)
    want = sorted(jobs.read_outcome_windows(spark, out).collect())
    for name in os.listdir(f"{progress}/commits"):
        if name.strip(".").startswith("1"):
            os.remove(f"{progress}/commits/{name}")
    jobs.run_outcome_windows(spark.readStream.schema(schema).parquet(inbox), out, progress)
    assert sorted(jobs.read_outcome_windows(spark, out).collect()) == want
    assert sorted(r.applied for r in jobs.read_outcome_windows(spark, out).collect()) == [3, 4]
