import json

from pyspark.sql import functions as F

from siltline.streaming.ingest import frontier, ingest, latest, merge, until_run, unknown_rows


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    landing, table, state = (str(tmp_path / x) for x in ("landing", "table", "state"))
    (tmp_path / "landing").mkdir()
    for n in (1, 2):
        (tmp_path / "landing" / f"{n}.json").write_text(json.dumps({"id": f"v{n}", "t": n}) + "\n" + json.dumps({"id": "same", "t": n}))
        for _ in range(2):
            ingest(spark, landing, table, state, "id string, t bigint")
        rows = spark.read.parquet(table).drop("batch_id")
        assert rows.count() == 2 * n
    assert sorted(tuple(r) for r in latest(rows, ["id"], "t").collect()) == [("same", 2), ("v1", 1), ("v2", 2)]
    assert sorted(tuple(r) for r in merge(rows.filter("t = 1"), rows.filter("t = 2"), ["id"], "t").collect()) == [("same", 2), ("v1", 1), ("v2", 2)]


def test_stops_at_a_run(spark):
    flags = {"s": "0110111011", "t": "0101", "u": "111"}
    rows = spark.createDataFrame([(s, i, f == "1") for s, x in flags.items() for i, f in enumerate(x)], "s string, p bigint, f boolean")
    got = until_run(rows, "s", "p", F.col("f"), 3).groupBy("s").agg(F.max("p").alias("p")).collect()
    assert {r.s: r.p for r in got} == {"s": 6, "t": 3, "u": 2}


def test_known_overlap_and_frontier(spark):
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate("abKcKKde")], "s string, p bigint, id string")
    known = spark.createDataFrame([("K",)], "id string")
    assert sorted(r.id for r in unknown_rows(rows, known, "s", "p", "id", 2).collect()) == ["a", "b", "c"]
    assert tuple(frontier(rows.withColumn("t", F.col("p")), "s", "p", "id", "t").head()) == ("s", 6, "a", 7)


def test_numbers_within_sources(spark):
    from siltline.streaming.ingest import numbered_within

    df = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("s"), (F.col("id") * 7).alias("o"))
    got = {}
    for r in numbered_within(df, "s", ["o"], "place").collect():
        got.setdefault(r.s, []).append((r.o, r.place))
    for own in got.values():
        assert [p for _, p in sorted(own)] == list(range(1, len(own) + 1))
    assert sum(map(len, got.values())) == 5_000


def test_a_listing_is_read_until_rows_are_too_old(spark):
    from datetime import datetime

    from siltline.streaming.ingest import too_old

    days = [40, 30, 5, 20, 4, 3, 2, 1, 39]
    df = spark.createDataFrame([("a", i, datetime(2024, 3, d) if d <= 31 else datetime(2024, 4, d - 31)) for i, d in enumerate(days, 1)] + [("b", 1, None), ("b", 2, datetime(2020, 1, 1))], "s string, p int, t timestamp")
    got = sorted((r.s, r.p) for r in too_old(df, "s", "p", "t", datetime(2024, 3, 15), 5, 3).collect())
    assert got == [("a", p) for p in range(1, 8)] + [("b", 1), ("b", 2)]
