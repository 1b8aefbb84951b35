"""Small cases of operators, columns, sources and streams."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.columns import canonical_url, number, page_type, rounded, site_id, visible_text
from marketloom.operators.association import category_breakdown, chi2_tail, contingency, feature_summary
from marketloom.operators.health import advice
from marketloom.operators.peers import nearest
from marketloom.operators.tables import insert_missing, upsert
from marketloom.sources.files import read_csv, write_csv
from marketloom.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_columns(spark):
    assert one(spark, rounded(F.lit(2.5))) == 3
    assert [one(spark, number(F.lit(x))) for x in (" 3.5 ", "", "NaN", "Infinity", "x")] == [3.5, None, None, None, None]
    assert one(spark, canonical_url(F.lit("https://a.example/shop/?q=1#top"))) == "https://a.example/shop"
    assert [one(spark, page_type(F.lit(f"https://a.example{p}"))) for p in ("", "/shop/1", "/returns", "/x")] == ["homepage", "products", "returns", "page"]
    assert one(spark, site_id(F.lit("http://www.A.example/x"))) == "a.example"
    assert one(spark, visible_text(F.lit("<script>a</script><p>b  c</p><style>d</style>"))) == "b c"


def test_association_of_many_categories(spark):
    """p-values for any degrees of freedom; 99 degrees aren't held against the 5 % point of 30."""
    for x, dof in ((3.841459, 1), (5.991465, 2), (43.772972, 30), (123.225221, 99), (124.342113, 100)):
        assert abs(chi2_tail(x, dof) - 0.05) < 1e-7
    df = spark.createDataFrame([(f"f{k}", c) for k in range(100) for c in [0] * (10 + 10 * (k % 2)) + [1] * 10], "f string, t int")
    row = feature_summary(contingency(df, ["f"], "t")).first()
    assert row.dof == 99 and 43.773 < row.chi2 < 123.225 and row.p_value > 0.05 and row.is_important == 0
    assert row.cramer_v >= 0.05  # only the p-value speaks against it


def test_association_with_correction_and_edges(spark):
    rows = [("yes", 1)] * 30 + [("yes", 0)] * 20 + [("no", 1)] * 10 + [("no", 0)] * 40 + [(None, 1), ("yes", None), ("no", 7)]
    df = spark.createDataFrame(rows, "f string, t int")
    table = contingency(df, ["f"], "t")
    assert {tuple(r) for r in table.collect()} == {("f", "yes", 20, 30), ("f", "no", 40, 10), ("f", "nan", 0, 1)}
    row = feature_summary(contingency(df.where("f is not null"), ["f"], "t")).first()
    assert row.chi2 == pytest.approx(15.042, abs=1e-3) and row.is_important == 1 and row.relative_importance_pct == 100
    assert feature_summary(contingency(df.where("t = 1"), ["f"], "t")).first().cramer_v == 0
    assert category_breakdown(table).where("category = 'no'").first().pct_yes == 20


def test_peers_and_tables(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (2, 1, 10.0), (3, 1, 12.0), (4, 1, 8.0), (5, 2, 1.0)], "site long, model int, overall double")
    assert [(r.peer, r.distance) for r in nearest(df, 2).where("site = 1").orderBy("position").collect()] == [(2, 0.0), (3, 2.0)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in insert_missing(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_advice_bounds(spark):
    schema = "conversion_rate double, repeat_customer_rate double, ad_spend_to_revenue_pct double, avg_delivery_days double, refund_rate double, monthly_sessions double"
    df = spark.createDataFrame([(1.5, 22.0, 30.0, 6.0, 5.0, 10000.0), (1.4, 22.0, 30.0, 6.1, 5.0, 10000.0)], schema)
    assert sorted(r.problem for r in advice(df).collect()) == ["avg_delivery_days", "conversion_rate", "keep_monitoring"]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "x"'), ("two\nlines", ""), ("", "")]
    write_csv(spark.createDataFrame(rows, "a string, b string"), str(tmp_path / "x"))
    assert {tuple(r) for r in read_csv(spark, str(tmp_path / "x"), ["a", "b"]).collect()} == set(rows[:2])
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "x"), ["c"])


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(2):
        batch.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    query = events.balances(stream).writeStream.outputMode("complete").format("memory").queryName("balances").start()
    query.processAllAvailable()
    query.stop()
    got = {r.user_id: round(r.balance, 6) for r in spark.table("balances").collect()}
    assert got == {r.user_id: round(r.balance, 6) for r in events.balances(batch).collect()}
    query = stream.select("user_id", "event_id", "ts").writeStream.foreachBatch(events.keep_latest(str(tmp_path / "out"), ["user_id"], "ts", "event_id")).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    kept = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "out" / str(last))).collect()}
    assert kept == {r.user_id: r.e for r in batch.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}


def test_admission_streams(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id").withColumn("part", F.ntile(3).over(Window.partitionBy().orderBy("ts", "event_id")))
    for k in range(1, 4):
        batch.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    rows, credit, times, want, quota = batch.orderBy("ts", "event_id").collect(), {}, {}, {}, {}
    for r in rows:
        if r.event_type in ("purchase", "signup"):
            credit[r.user_id] = credit.get(r.user_id, 0.0) + r.value
        else:
            want[r.event_id] = credit.get(r.user_id, 0.0) >= 10
            credit[r.user_id] = credit.get(r.user_id, 0.0) - 10 * want[r.event_id]
        own = times[r.user_id] = [t for t in times.get(r.user_id, []) if (r.ts - t).total_seconds() < 86400]
        quota[r.event_id] = len(own) < 2
        if quota[r.event_id]:
            own.append(r.ts)

    def accepted(name, admission):
        done = {}
        for k in range(1, 4):  # files arrive one after another
            for f in (tmp_path / "in" / str(k)).glob("*.parquet"):
                (tmp_path / name).mkdir(exist_ok=True)
                (tmp_path / name / f"{k}.parquet").write_bytes(f.read_bytes())
            query = admission(events.event_stream(spark, str(tmp_path / name))).writeStream.outputMode("append").foreachBatch(lambda d, _: done.update({r.event_id: r.accepted for r in d.collect()})).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
            query.awaitTermination()
        return done

    assert accepted("credit", events.credit_admission) == want and not all(want.values()) and any(want.values())
    assert accepted("quota", lambda e: events.quota_admission(e, 2)) == quota and not all(quota.values())


def test_late_rows_and_repeats(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.unionByName(batch).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    for name, rows in (("once", events.once(stream)), ("counts", events.windowed_counts(stream, late="0 seconds"))):
        query = rows.writeStream.outputMode("append").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("once").count() == batch.count()
    n = {(r.window.start, r.user_id): r.n for r in spark.table("counts").collect()}
    assert n and all(x % 2 == 0 for x in n.values())
