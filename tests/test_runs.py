"""Runs closed on a stream: told once, across loads, late rows dropped, state emptied."""

from datetime import datetime, timedelta

from assayframe.streaming import events as ev

T0 = datetime(2024, 1, 1)
SCHEMA = "log_id string, assessment_id string, event_type string, event_timestamp timestamp"


def frame(spark, *rows):
    return spark.createDataFrame([(i, a, k, None if m is None else T0 + timedelta(minutes=m)) for i, a, k, m in rows], SCHEMA)


def told(df):
    return sorted((str(r["assessment_id"]), int((r["opened_at"] - T0).total_seconds() // 60), r["events"], r["last_event"], r["ended_at"] is not None) for r in df.collect())


def test_batch(spark):
    df = frame(spark, ("1", "a", "assessment_submitted", 0), ("2", "a", "assessment_started", 59), ("3", "a", "assessment_complete", 118), ("4", "a", "assessment_submitted", 179),
               ("5", None, "x", 5), ("6", "b", "x", None), ("7", "b", "x", 7), ("7", "b", "x", 7), ("8", "c", "x", 0), ("9", "c", "y", 60))
    assert told(ev.closed_runs(df)) == [("None", 5, 1, "x", False), ("a", 0, 3, "assessment_complete", True), ("a", 179, 1, "assessment_submitted", False), ("b", 7, 2, "x", False), ("c", 0, 2, "y", False)]
    assert ev.closed_runs(frame(spark)).count() == 0


def test_stream(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    loads = [[("1", "a", "assessment_submitted", 0), ("2", "b", "assessment_submitted", 30)], [("3", "a", "assessment_complete", 50), ("4", "c", "x", 300)],
             [("5", "a", "late", 55), ("6", "d", "x", 310)], [("7", "z", "x", 100_000)]]
    state = []
    for load in loads:
        frame(spark, *load).write.mode("append").parquet(source)
        runs = ev.closed_runs(ev.read_stream(spark, source, frame(spark).schema))
        query = (runs.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start())
        query.awaitTermination()
        state.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert told(spark.read.parquet(out)) == [("a", 0, 2, "assessment_complete", True), ("b", 30, 1, "assessment_submitted", False), ("c", 300, 1, "x", False), ("d", 310, 1, "x", False)]
    assert state == [2, 1, 2, 1]  # open runs only
