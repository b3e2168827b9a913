"""State of the latest-status stream: what is kept, what expires, what comes too late."""

from datetime import datetime, timedelta

from sheetloom.streaming import flows

SCHEMA = "processing_id BIGINT, status STRING, type STRING, filename STRING, ts TIMESTAMP, seq BIGINT"


def test_idle_ids_leave_the_state(spark, tmp_path):
    start = datetime(2025, 1, 1)
    at = lambda day: start + timedelta(days=day)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "progress"))

    def arrive(*rows):
        spark.createDataFrame([(i, s, "pdf", f"f{i}", at(day), seq) for i, s, day, seq in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        flows.latest_status_stream(spark, source, SCHEMA, target, checkpoint, keep="10 days", delay="1 day")

    state = lambda: {r.processing_id: (r.status, r.seq) for r in flows.status_state(spark, checkpoint).collect()}
    arrive((1, "processing", 0, 1), (1, None, 1, 2), (2, "processing", 0, 1), (2, "failed", 0, 3))
    assert state() == {1: ("completed", 2), 2: ("failed", 3)}
    arrive((3, "processing", 11.5, 1))  # the watermark is at day 10.5: id 2 of day 0 goes, id 1 of day 1 stays
    assert state() == {1: ("completed", 2), 3: ("processing", 1)}
    arrive((1, "failed", 10.6, 5), (1, "processing", 2, 4), (2, "processing", 11, 4))  # day 2 is late; id 2 starts anew
    assert state() == {1: ("failed", 5), 2: ("processing", 4), 3: ("processing", 1)}
    changes = spark.read.parquet(f"{target}/*").collect()
    assert (1, 4) not in {(r.processing_id, r.seq) for r in changes}
    last = {r.processing_id: (r.status, r.seq) for r in flows.latest_status(spark.read.parquet(f"{target}/*")).collect()}
    assert last == {1: ("failed", 5), 2: ("processing", 4), 3: ("processing", 1)}
