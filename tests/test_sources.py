"""Readers, sinks, reports and streams on files of a temporary folder."""

import json

import pytest

from tracegrid.operators import discrimination as D
from tracegrid.plans.report import render
from tracegrid.sources import files
from tracegrid.sources import observations as O
from tracegrid.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_captures_of_both_shapes(spark, tmp_path):
    new = {"url": "http://a", "httpHeaders": {"Server": "x"}, "metaTags": [{"name": "generator", "content": "W"}, {"property": "og:type", "content": "p"}], "scripts": [{"src": "s.js"}, {"inline": True}], "statusCode": 200}
    old = {"url": "http://b", "pageData": {"httpInfo": {"headers": {"Via": "v"}}, "metadata": {"title": "t"}, "scripts": [{"src": "o.js"}]}, "robotsTxt": {"httpHeaders": {"VIA": "w"}}}
    (tmp_path / "c.json").write_text(json.dumps(new) + "\n" + json.dumps(old) + '\n{"cut\n')
    good, bad = files.captures(spark, str(tmp_path / "c.json"))
    got = {r["url"]: r for r in good.collect()}
    assert got["http://a"]["headers"] == {"server": ["x"]} and got["http://a"]["metas"] == {"generator": "W"} and got["http://a"]["scripts"] == ["s.js"]
    assert sorted(got["http://b"]["headers"]["via"]) == ["v", "w"] and got["http://b"]["metas"] == {"title": "t"}
    assert bad.count() == 1


def test_lists_and_labels(spark, tmp_path):
    (tmp_path / "u.csv").write_text("name,Website\na,http://a\nb, \nc,http://c\n")
    assert [r[0] for r in files.addresses(spark, str(tmp_path / "u.csv")).collect()] == ["http://a", "http://c"]
    (tmp_path / "x.csv").write_text("name\na\n")
    with pytest.raises(ValueError):
        files.addresses(spark, str(tmp_path / "x.csv"))
    row = {"fileId": "f", "url": "http://a", "confidence": 0.5}
    for name, doc in (("bare", [row]), ("kept", {"files": [row]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        assert files.index(spark, str(tmp_path / f"{name}.json")).first()["confidence"] == 0.5
    (tmp_path / "g.json").write_text(json.dumps({"version": "1", "sites": [{"url": "http://a", "cms": "W"}]}))
    assert files.labelled(spark, str(tmp_path / "g.json")).first()["cms"] == "W"
    (tmp_path / "r.json").write_text(json.dumps({"cms": "W", "required_patterns": ["a", "a", "b"]}))
    assert files.required_patterns(spark, str(tmp_path / "r.json")).count() == 2


def test_sinks_and_reports(spark, tmp_path):
    df = D.dense(O.headers(spark, SF), 2).orderBy("feature")
    files.append(spark.read.parquet(f"{SF}/header_values.parquet"), str(tmp_path / "p"), "captured_at")
    plan = spark.read.parquet(str(tmp_path / "p")).where("captured_date = date'2024-02-01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(captured_date" in plan
    for fmt in ("csv", "jsonl"):
        files.export(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == df.count() == spark.read.json(str(tmp_path / "jsonl")).count()
    for fmt in ("human", "markdown", "csv", "json"):
        assert "server" in render({"headers": df}, fmt)


def test_stream_counts_match_batch(spark, tmp_path):
    t = spark.read.parquet(f"{SF}/header_values.parquet")
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{c} {k}" for c, k in t.dtypes)
    obs = ingest.observations(spark, str(tmp_path / "in"), schema, watermark="4000 days")
    ingest.run_available(obs.select("site_host", "feature", "header_value", "page_kind"), str(tmp_path / "ck"), "streamed")
    want = t.where("site_host is not null and header_name is not null").selectExpr("site_host", "lower(header_name)", "header_value", "page_kind").distinct().count()
    assert spark.table("streamed").count() == want


def test_reports_tell_what_they_leave_out(spark):
    df = spark.range(60).selectExpr("id AS a", "'x' AS b").orderBy("a")
    assert "... 50 more rows" in render({"rows": df}, "markdown", 10) and "more rows" not in render({"rows": df}, "csv", 60)


def test_functions_in_sql(spark):
    from tracegrid.session import register

    names = register(spark, [("tg_twice", "x INT", "INT", "x * 2")])
    assert "tg_twice" in names
    r = spark.sql("SELECT tg_host('HTTPS://www.A.example/x'), tg_platform('  WordPress '), tg_platform(NULL), tg_share(1, 0), tg_twice(4), round(tg_wilson_lower(8, 10), 6)").first()
    assert tuple(r) == ("a.example", "wordpress", "unknown", 0.0, 8, pytest.approx(0.490162, abs=1e-5))


def test_tables_of_any_size(spark):
    from tracegrid.operators.bias import table_test

    df = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5), ("c", "x", 7)], "r string, c string, n long")
    r = table_test(df, "r", "c", "n").first()
    assert (r["rows"], r["columns"], r["df"]) == (3, 2, 2) and r["statistic"] == pytest.approx(23.6790, abs=1e-3) and r["p_value"] == 0.04 and r["critical"] == 5.991
    two = table_test(df.where("r <> 'c'"), "r", "c", "n").first()
    assert two["df"] == 1 and two["statistic"] == pytest.approx(16.5785, abs=1e-3)
