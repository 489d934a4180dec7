import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from siltline.operators import exchange


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "é,\"x\"\ny", None, True, ["a", None], date(2024, 2, 29), datetime(2024, 1, 2, 3, 4, 5)), (2, None, 1.5, None, None, None, None)], "i bigint, t string, d double, b boolean, c array<string>, day date, ts timestamp")


def text(spark, path):
    return [r[0] for r in spark.read.text(str(path)).collect()]


def test_json_lines(spark, rows, tmp_path):
    exchange.write(rows.coalesce(1), str(tmp_path / "j"), "auto")
    first, second = map(json.loads, text(spark, tmp_path / "j"))
    assert first == {"i": 1, "t": "é,\"x\"\ny", "d": None, "b": True, "c": ["a", None], "day": "2024-02-29", "ts": "2024-01-02T03:04:05+00:00"} and set(second) == set(first) and second["t"] is None
    assert "é" in text(spark, tmp_path / "j")[0]


def test_lines(spark, rows, tmp_path):
    exchange.write(rows.select("b").coalesce(1), str(tmp_path / "b"))
    assert text(spark, tmp_path / "b") == ["true", ""]
    exchange.write(rows.select("c").coalesce(1), str(tmp_path / "c"))
    assert text(spark, tmp_path / "c") == ['["a",null]', ""]
    with pytest.raises(ValueError):
        exchange.as_lines(rows)
    with pytest.raises(ValueError):
        exchange.write(rows, str(tmp_path / "x"), "xml")


@pytest.mark.parametrize("form", ["csv", "tsv"])
def test_separated(rows, tmp_path, form):
    exchange.write(rows.select("i", "t", "d").coalesce(1), str(tmp_path / form), form)
    content = "".join(p.read_text() for p in (tmp_path / form).glob("part*"))
    s = "," if form == "csv" else "\t"
    assert content.splitlines()[0] == s.join("itd") and content.endswith(f"2{s}{s}1.5\n") and '""x""' in content


def test_ids_and_urls(spark, tmp_path):
    exchange.write(spark.createDataFrame([("a",)], "id string"), str(tmp_path / "u"), "urls", "https://host.example/")
    assert text(spark, tmp_path / "u") == ["https://host.example/a"]


def test_archive(spark, tmp_path):
    (tmp_path / "archive").write_text("# note\nsite a\n\n  b  \nx y c\n")
    archive = exchange.archived_ids(spark, str(tmp_path / "archive"))
    assert sorted(r.id for r in archive.collect()) == ["a", "b", "c"]
    rows = spark.createDataFrame([("a",), ("z",), (None,)], "id string")
    assert sorted((r.id for r in exchange.without_archived(rows, archive, "id").collect()), key=str) == [None, "z"]


def test_append(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "id string")
    path = str(tmp_path / "ids")
    assert exchange.append_unseen(spark, ids, path) == 2 and exchange.append_unseen(spark, ids, path) == 0
    assert exchange.append_unseen(spark, ids.union(spark.createDataFrame([("c",)], "id string")), path) == 1 and sorted(text(spark, path)) == ["a", "b", "c"]


def test_collection(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", "T")], "n int, id string, title string")
    document = "".join(r.value for r in exchange.collection_lines(rows, "id", ["title"], {"title": "P"}, ["n"]).orderBy("place").collect())
    assert json.loads(document)["entries"] == [{"target": "a", "metadata": {"title": "T"}}, {"target": "b", "metadata": {}}]
    (tmp_path / "d.json").write_text(document)
    assert [(r.place, r.target) for r in exchange.read_collection(spark, str(tmp_path / "d.json")).collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="no id"):
        exchange.collection_entries(spark.createDataFrame([("", "x")], "id string, title string"), "id", ["title"]).collect()
    import hashlib

    assert exchange.sequence_fingerprint(rows, "id", ["n"]).head()[0] == hashlib.sha256(b'["a","b"]').hexdigest()


def test_agreement_and_freshness(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "", None), ("b", "x", 1), ("b", "y", 1)], "k string, s string, n int")
    assert sorted(tuple(r) for r in exchange.consistent_values(rows, ["k"], ["s", "n"]).collect()) == [("a", "x", 1), ("b", None, 1)]
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    old = spark.createDataFrame([(1, None), (2, 10), (3, 10)], "i int, age bigint").withColumn("t", F.when(F.col("i") == 2, F.timestamp_seconds(F.lit(int(now.timestamp()) - 5))).when(F.col("i") == 3, F.timestamp_seconds(F.lit(int(now.timestamp()) - 11))))
    assert [r.i for r in exchange.fresh(old, "t", "age", now).collect()] == [1, 2]
    assert exchange.schema_listing(rows)[0] == ("k", "string", True)
