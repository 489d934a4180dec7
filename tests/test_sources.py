import json

import pytest
from pyspark.sql import functions as F

from siltline.__main__ import main
from siltline.plans.engine import prepare, sql
from siltline.plans.report import analyse, provenance, report
from siltline.sources.catalog import Catalog, table_catalog
from siltline.sources.records import media_records, normalised
from siltline.sources.references import BASE, classify

UC = "UC" + "a" * 22


@pytest.mark.parametrize(
    ("text", "kind", "url", "id"),
    [
        ("@name", "channel", f"{BASE}/@name", "@name"), (" name ", "channel", f"{BASE}/@name", "name"), (UC, "channel", f"{BASE}/channel/{UC}", UC), ("PLabcdefgh", "playlist", f"{BASE}/playlist?list=PLabcdefgh", "PLabcdefgh"),
        ("https://www.youtube.com/@name/videos", "channel", f"{BASE}/@name", None), ("https://m.youtube.com:443/playlist?x=1&list=PLabcdefgh", "playlist", f"{BASE}/playlist?list=PLabcdefgh", "PLabcdefgh"), ("https://other.example/x", "url", "https://other.example/x", None),
        ("https://youtu.be/abc", "invalid", None, None), ("https://www.youtube.com/watch?v=1", "invalid", None, None), ("https://www.youtube.com/playlist?list=", "invalid", None, None), ("https://youtube.com/", "invalid", None, None), ("", "invalid", None, None), ("a b", "invalid", None, None),
    ],
)
def test_references(spark, text, kind, url, id):
    got = spark.createDataFrame([(text,)], "s string").select(classify(F.col("s")).alias("c")).head().c
    assert (got.kind, got.url, got.id) == (kind, url, id)


def test_no_reference(spark):
    assert spark.createDataFrame([(None,)], "s string").select(classify(F.col("s")).alias("c")).head().c is None


def test_media_records(spark):
    rows = [("2025-01-01", {"id": "a", "title": "old"}), ("2025-01-02T00:00:00Z", {"id": "a", "title": "new", "duration": 61, "upload_date": "20250101", "tags": ["b", None, "a"], "formats": [{"height": 720}], "odd": {"x": 1}}), ("?", {"id": "b", "formats": "text"}), ("2025-01-01", None)]
    cached = spark.createDataFrame([(t, json.dumps(r) if r else "broken") for t, r in rows], "fetched_at string, raw_json string")
    media = media_records(cached)
    assert sorted((r.id, r.title) for r in media.collect()) == [("a", "new"), ("b", None)] and media_records(cached, only_latest=False).count() == 3
    catalog = Catalog().register("m", media)
    assert [tuple(r) for r in sql("SELECT id, tags[0] AS t FROM m WHERE duration = 1m1s AND upload_date = 2025-01-01 AND ANY(formats AS f WHERE f.height = 720)", catalog).collect()] == [("a", "a")]
    assert "formats" in normalised(media).columns and normalised(media.withColumn("odd", F.struct("id"))).columns == media.columns


def test_reports(spark, data):
    plan = prepare("SELECT r_name FROM region AS r WHERE r_regionkey < 3 ORDER BY r_name", table_catalog(spark, data))
    measured = analyse(plan)
    assert measured["rows"] == 3 and measured["sources"] == ["region"] and "Rows: 3" in report(measured) and "| Rows | 3 |" in report(measured, "markdown")
    assert json.loads(provenance(plan, run=1))["run"] == 1


def test_command_line(spark, data, tmp_path, capsys):
    assert main(["--check-query", "select  id where a=1"]) == 0 and capsys.readouterr().out == "SELECT id\nWHERE a = 1\n"
    assert main(["--tables", data, "SELECT r_name FROM region WHERE r_regionkey < :n ORDER BY r_name DESC", "--param", "n=2", "--limit", "1"]) == 0
    assert list(json.loads(capsys.readouterr().out)) == ["r_name"]
    assert main(["--tables", data, "SELECT nothing FROM region"]) == 2 and "Unknown field" in capsys.readouterr().err
    assert main(["--tables", data, "SELECT r_name FROM region", "--explain"]) == 0 and json.loads(capsys.readouterr().out)["columns"][0]["kind"] == "string"
    (tmp_path / "q").write_text("SELECT r_regionkey, r_name FROM region")
    assert main(["--tables", data, "--query-file", str(tmp_path / "q"), "--output", str(tmp_path / "o"), "--format", "csv"]) == 0 and list((tmp_path / "o").glob("*.csv"))
    with pytest.raises(SystemExit):
        main([])
