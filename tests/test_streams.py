"""Streams in the order of time against batches, and landed pages as tables."""

import random
from datetime import datetime, timedelta, timezone

from marketloom.operators.tables import rolling_count
from marketloom.streaming import events as E
from marketloom.streaming import landed, ordered
from pyspark.sql import functions as F

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
EVENT = "event_id long, ts timestamp, user_id long, event_type string"


def shuffled(spark, tmp_path, late_minutes=50):
    """Files of events, each row at most so late, and a last row that lets the watermark pass all others."""
    rng = random.Random(8)
    rows = [(k, START + timedelta(minutes=rng.choice([rng.randint(0, 6000), 1440 * (k % 4)])), rng.randint(1, 9), rng.choice(["view", "click"])) for k in range(900)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randint(0, late_minutes)))
    rows.append((9999, START + timedelta(days=40), 77, "view"))
    for k in range(0, len(rows), 200):
        spark.createDataFrame(rows[k : k + 200], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{k:04d}"))
    return rows


def run(spark, tmp_path, name, rows_of):
    got, folder = [], tmp_path / f"{name}-in"
    folder.mkdir()
    for k, part in enumerate(sorted(p for p in tmp_path.iterdir() if p.name.startswith("part"))):
        (f,) = part.glob("*.parquet")
        (folder / f"{k}.parquet").write_bytes(f.read_bytes())
        stream = spark.readStream.schema(EVENT).parquet(str(folder))
        query = rows_of(stream).writeStream.outputMode("append").foreachBatch(lambda d, _: got.extend(map(tuple, d.collect()))).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    return got, query.lastProgress


def test_rolling_counts_equal_the_batch(spark, tmp_path):
    rows = shuffled(spark, tmp_path)
    batch = spark.createDataFrame(rows, EVENT)
    want = {r.event_id: r.n for r in batch.select("event_id", rolling_count(batch, ["user_id"], "ts", F.col("event_type") == "view").alias("n")).collect()}
    got, last = run(spark, tmp_path, "counts", lambda s: ordered.rolling_counts(s, F.col("event_type") == "view"))
    assert len(got) == len({i for i, _, _ in got}) == 900  # the last row waits for a later one
    assert {i: n for i, _, n in got} == {i: n for i, n in want.items() if i != 9999}
    assert last.stateOperators[0].numRowsTotal <= 1  # users of long ago have no state


def test_first_within_a_day(spark, tmp_path):
    rows = shuffled(spark, tmp_path)
    got, last = run(spark, tmp_path, "first", ordered.first_within)
    accepted, want = {}, {}
    for i, ts, user, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        before = accepted.get((user, kind))
        want[i] = before is None or ts - before >= timedelta(hours=24)
        accepted[user, kind] = ts if want[i] else before
    assert {i: fine for i, _, _, fine in got} == {i: fine for i, fine in want.items() if i != 9999}
    assert not all(want.values()) and last.stateOperators[0].numRowsTotal <= 1


LANDED = "url string, html string, crawled_at timestamp, removed boolean"


def page(url, words, hour, removed=False):
    return (f"https://a.example/{url}", f"<p>{words}</p>", START + timedelta(hours=hour), removed)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_landed_pages(spark, tmp_path):
    write = landed.land_pages(str(tmp_path), buckets=8)
    first = spark.createDataFrame([page("a", "alpha " * 300, 1), page("b", "beta", 1), page("a", "old", 0), *(page(f"x{k}", f"page {k}", 1) for k in range(20))], LANDED)
    write(first, 0)
    pages = {r.url[-1]: r.text for r in landed.live_pages(spark, str(tmp_path)).collect() if len(r.url) == 19}
    assert pages["a"].startswith("alpha alpha") and pages["b"] == "beta"
    parts = landed.live_chunks(spark, str(tmp_path)).where("url like '%/a'").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in parts] == [0, 1, 2, 3] and " ".join(r.content for r in parts) == ("alpha " * 300).strip()
    before = files(tmp_path)
    write(first, 0)  # an epoch that comes again
    assert files(tmp_path) == before
    second = spark.createDataFrame([page("a", "short now", 2), page("b", None, 3, True), page("b", "too late", 2)], LANDED)
    write(second, 1)
    after = files(tmp_path)
    bucket = lambda name: name.split("bucket=")[1].split("/")[0]
    changed = {bucket(f) for f, _ in set(after.items()) ^ set(before.items())}
    assert len(changed) <= 2 and all(after[f] == t for f, t in before.items() if bucket(f) not in changed)
    rows = [(r.url[-1], r.chunk_index, r.content) for r in landed.live_chunks(spark, str(tmp_path)).where("length(url) = 19").collect()]
    assert rows == [("a", 0, "short now")]  # fewer chunks than before leave none behind, and a removed page takes its own along
    write(spark.createDataFrame([page("b", "older than its removal", 2)], LANDED), 2)
    assert files(tmp_path) == after and landed.live_pages(spark, str(tmp_path)).count() == 21


def test_newest_rows_by_bucket(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "ts")
    write = landed.keep_latest_rows(str(tmp_path / "t"), "user_id long, event_id long, ts timestamp_ntz", ["user_id"], "ts", "event_id", 8)
    write(batch.where("event_id % 2 = 0"), 0)
    write(batch.where("event_id % 2 = 1"), 1)
    want = {r.user_id: r.e for r in batch.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "t")).collect()} == want
    before = files(tmp_path)
    write(batch.where("event_id % 2 = 0"), 0)
    assert files(tmp_path) == before
