"""Operators on small fixtures: hand-computed values, nulls, empty tables, ties, repeated rows, clashing names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracegrid.functions import stats as S
from tracegrid.operators import cooccurrence as C
from tracegrid.operators import corpus as K
from tracegrid.operators import discrimination as D
from tracegrid.operators import merkle, schema_drift
from tracegrid.operators import vendors as V
from tracegrid.operators.tree_aggregate import platform_key, shares, tree_aggregate

OBS = "site string, platform string, feature string, value string, page_kind string, captured_at timestamp_ntz"


def six_sites(spark):
    """The six-site corpus of FIXTURES.md."""
    platform = dict(a="WordPress", b="WordPress", c="WordPress", d="Drupal", e="Drupal", f="unknown")
    carried = {"x-pingback": "ab", "x-drupal-cache": "de", "cf-ray": "abcd", "server": "abcdef", "x-powered-by": "adf"}
    rows = [(s, platform[s], f, "v", "mainpage", dt.datetime(2024, 1, 1)) for f, ss in carried.items() for s in ss]
    return spark.createDataFrame(rows, OBS)


def by(rows, key):
    return {r[key]: r for r in rows}


def test_dense_discrimination(spark):
    got = by(D.dense(six_sites(spark)).collect(), "feature")
    assert got["x-pingback"]["entropy"] == 0 and got["x-pingback"]["max_specificity"] == 2.0 and got["x-pingback"]["discriminative_score"] == 1.0
    assert got["x-drupal-cache"]["max_specificity"] == 3.0 and got["x-drupal-cache"]["target_platform"] == "Drupal"
    assert got["cf-ray"]["entropy"] == pytest.approx(0.51186, abs=1e-5) and got["cf-ray"]["discriminative_score"] == pytest.approx(0.48814, abs=1e-5)
    assert got["server"]["is_noise"] and got["server"]["discriminative_score"] == 0
    assert got["x-powered-by"]["entropy"] == 1.0 and got["x-powered-by"]["target_platform"] == "unknown"


def test_sparse_discrimination(spark):
    got = by(D.sparse(six_sites(spark)).collect(), "feature")
    assert got["x-pingback"]["discriminative_score"] == pytest.approx(0.66667, abs=1e-5)
    assert got["x-drupal-cache"]["discriminative_score"] == 1.0
    assert got["cf-ray"]["discriminative_score"] == pytest.approx(0.12581, abs=2e-5)
    assert got["x-powered-by"]["discriminative_score"] == 0


def test_small_corpus_specificity_and_concentration(spark):
    got = by(D.specificity(six_sites(spark)).collect(), "feature")
    assert got["cf-ray"]["specificity"] == pytest.approx(0.8165, abs=1e-4) and got["x-powered-by"]["specificity"] == pytest.approx(0.46355, abs=1e-4)
    c = D.concentration(six_sites(spark)).first()
    assert c["hhi"] == pytest.approx(0.388889, abs=1e-6) and c["shannon"] == pytest.approx(1.011404, abs=1e-6) and c["dominance"] == 1.5


def test_pairs(spark):
    got = {(r["f1"], r["f2"]): r for r in C.pairs(six_sites(spark)).collect()}
    assert len(got) == 9
    r = got["cf-ray", "x-pingback"]
    assert (r["n"], r["p"]) == (2, 0.5) and r["mi"] == pytest.approx(0.135155, abs=1e-6)
    assert got["cf-ray", "x-drupal-cache"]["mi"] == pytest.approx(-0.047947, abs=1e-6)
    assert ("x-drupal-cache", "x-pingback") not in got


def test_pruned_pairs_are_the_frequent_pairs(spark):
    obs = six_sites(spark)
    assert {tuple(r) for r in C.pairs(obs, 2).collect()} == {tuple(r) for r in C.pairs(obs).where("n >= 2").collect()}


def test_doubling_the_corpus_changes_no_frequency(spark):
    obs = six_sites(spark)
    twice = obs.unionByName(obs.withColumn("site", F.concat("site", F.lit("2"))))
    cols = ["feature", "frequency", "entropy", "max_specificity", "discriminative_score"]
    assert {tuple(r) for r in D.dense(obs).select(cols).collect()} == {tuple(r) for r in D.dense(twice).select(cols).collect()}


def test_exclusive_groups_of_more_edges_than_a_list_holds(spark):
    """450 features that all meet (101,025 edges) make one star; two stars and a pair beside it keep their order."""
    found = spark.range(450).crossJoin(spark.range(450).withColumnRenamed("id", "j")).where("id < j")
    found = found.selectExpr("format_string('m%03d', id) f1", "format_string('m%03d', j) f2", "1D freq_pct", "0.01D p")
    few = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("y", "z")]
    few = spark.createDataFrame([(x, y, 1.0, 0.01) for x, y in few] + [("a", "d", 6.0, 0.01), ("a", "e", 1.0, 0.5)], found.schema)
    got = C.exclusive_groups(found.unionByName(few)).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["hub"], r["score"]), set()).add(r["feature"])
    assert groups == {("a", 0.666667): {"a", "b", "c"}, ("d", 0.444444): {"d", "e", "f"}, ("m000", 0.997778): {f"m{i:03}" for i in range(450)}}
    assert len(got) == 456
    assert C.exclusive_groups(found.limit(0)).count() == 0


def test_statistics(spark):
    one = spark.range(1).select(
        S.yates(*[F.lit(x) for x in (30, 10, 20, 40)]).alias("x"), S.binomial_p(F.lit(20), F.lit(200)).alias("p"), S.wilson_lower(F.lit(2), F.lit(3)).alias("w"), S.step_p(F.lit(5.0)).alias("s"), S.ratio(F.lit(1), F.lit(0)).alias("z")
    ).first()
    assert one["x"] == pytest.approx(15.041667, abs=1e-6) and one["p"] == pytest.approx(0.000615, abs=1e-6)
    assert one["w"] == pytest.approx(0.412845, abs=1e-6) and one["s"] == 0.05 and one["z"] == 0


def test_addresses(spark):
    cases = {
        "https://www.Example.com/": "example.com/", "http://example.com": "example.com/", "https://example.com/a/?x=1#y": "example.com/a", "https://example.com:443/a": "example.com/a",
        "https://example.com:8443/a": "example.com:8443/a", "not a url": "not a url",
    }
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", K.normalized_url(F.col("u"))).collect()
    assert dict(map(tuple, got)) == cases


def test_reject_reasons(spark):
    long = "x" * 200
    rows = [(403, "access denied" + long, "bot-detection"), (403, long, "error-page"), (None, "x" * 99, "insufficient-data"), (200, "page not found" + long, "error-page"), (200, long, None), (None, None, "insufficient-data")]
    df = spark.createDataFrame([(i, s, h) for i, (s, h, _) in enumerate(rows)], "i int, s int, h string")
    heads = F.create_map(F.lit("server"), F.lit("x"))
    got = df.select("i", K.reject_reason(F.col("s"), F.col("h"), F.lit(None).cast("string"), heads, F.lit("http://a.b/"))).orderBy("i").collect()
    assert [r[1] for r in got] == [r[2] for r in rows]


def test_scripts(spark):
    html = """<script src="https://cdn.x.y/jquery.js"></script><script src='/local.js'></script><script>var answer = 42;</script><script>a=1<2;</script><script>short</script>"""
    r = spark.createDataFrame([(html,)], "h string").select(K.external_scripts(F.col("h")), K.inline_scripts(F.col("h"))).first()
    assert r[0] == ["https://cdn.x.y/jquery.js"] and r[1] == ["inline:var answer = 42;"]
    names = spark.createDataFrame([("https://cdn.x.y/jquery.js",), ("/wp-includes/x.js",), ("inline:window.wp = 1",)], "s string").select(K.script_names(F.col("s"))).collect()
    assert names[0][0] == ["cdn-usage", "jquery"] and names[1][0] == ["inline-script"] and "wordpress-global-objects" in names[2][0]


def test_header_classes(spark):
    got = by(V.classified(spark.createDataFrame([(x,) for x in ("x-frame-options", "date", "server", "x-varnish", "my-wp-header", "x-own", "d-cache")], "feature string")).collect(), "feature")
    assert (got["x-frame-options"]["category"], got["x-frame-options"]["score"]) == ("platform", 0.1)
    assert got["date"]["advice"] == "always-filter" and got["server"]["score"] == 0.6 and got["x-varnish"]["category"] == "infrastructure"
    assert got["my-wp-header"]["named_platform"] == "WordPress" and got["x-own"]["category"] == "custom" and got["d-cache"]["named_platform"] == "Duda"


def test_tree_aggregate_over_skew_nulls_and_empty(spark):
    rows = [("Hot", i) for i in range(900)] + [(" hot ", None), (None, 5), ("  ", 7), (" HOT", 1)] + [(f"k{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "name string, v long").repartition(13)
    keys, measures = {"k": platform_key(F.col("name"))}, {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    got = by(tree_aggregate(df, keys, measures, fan_in=2).collect(), "k")
    assert (got["hot"]["n"], got["hot"]["s"], got["hot"]["m"]) == (902, sum(range(900)) + 1, 899)
    assert got["unknown"]["s"] == 12 and len(got) == 52
    assert tree_aggregate(df.limit(0), keys, measures).count() == 0
    assert shares(tree_aggregate(df, keys, measures).withColumn("g", F.lit(1)), "g", "n").where("n * 2 > total").count() == 1


def test_merkle_bridges(spark):
    kind = "id long, child_path string, body struct<headers:map<string,array<string>>,meta:map<string,string>,items:array<struct<a:string,parts:array<struct<n:string,v:string>>>>>"
    item = {"a": "x", "parts": [None, {"n": "p", "v": None}]}
    body = {"headers": {"h": ["1", None, "2"], "none": None, "empty": []}, "meta": {"k": "v", "n": None}, "items": [None, item, item]}
    rows = [(1, "clash", body), (1, "clash", body), (2, "clash", None), (3, None, {"headers": None, "meta": None, "items": []}), (None, None, body)]
    df = spark.createDataFrame(rows, kind)
    got = merkle.bridges(df, "t", F.col("id"), F.col("body"), content=True)
    one = sorted((r["child_path"], r["parent_key"], r["item_no"]) for r in got.where("owner_id = 1").collect())
    assert one == [("headers", "h", 0), ("headers", "h", 2), ("items", "", 1), ("items", "", 2), ("items.parts", "1", 1), ("items.parts", "2", 1), ("meta", "k", 0)]
    assert got.where("owner_id in (2, 3)").count() == 0 and got.where("owner_id is null").count() == 7
    same = [r["node_hash"] for r in got.where("owner_id = 1 and child_path = 'items'").collect()]
    assert same[0] == same[1]
    assert {r["parent_hash"] for r in got.where("child_path = 'items.parts'").collect()} == {same[0]}
    nodes = by(merkle.nodes(got).collect(), "node_hash")
    assert nodes[same[0]]["n_occurrences"] == 4 and '"a":"x"' in nodes[same[0]]["content"]
    assert merkle.bridges(df.limit(0), "t", F.col("id"), F.col("body")).count() == 0


def test_merkle_walk_reaches_every_leaf(spark):
    """Maps of structs, lists of lists, lists of maps, maps of maps and structs between them, against a walk in Python."""
    from pyspark.sql import types as T

    kind = "struct<a:map<string,struct<xs:array<string>,m:map<string,map<string,array<struct<z:array<int>>>>>>>,b:array<array<array<int>>>,c:array<map<string,array<string>>>,d:struct<e:struct<f:array<struct<g:map<string,int>>>>>,n:int>"
    body = {
        "a": {"k": {"xs": ["p", None], "m": {"o": {"i": [{"z": [1, None, 2]}, None]}, "none": None}}, "l": None},
        "b": [[[1, 2], None, [3]], None, [[], [4]]], "c": [{"q": ["r", "s"]}, None, {"t": None}], "d": {"e": {"f": [{"g": {"h": 7, "i": None}}, {"g": None}]}}, "n": 5,
    }
    df = spark.createDataFrame([(1, body), (2, body)], f"id long, body {kind}")
    of = df.schema["body"].dataType
    want = []

    def under(key, part):
        return str(part) if key == "" else f"{key}.{part}"

    def items(v, t, path, key):
        for i, x in enumerate(v or []):
            if x is not None:
                want.append((path, key, i))
                walk(x, t, path + ("[]" if isinstance(t, T.ArrayType) else "{}" if isinstance(t, T.MapType) else ""), under(key, i))

    def walk(v, t, path, key):
        if v is None:
            return
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(v.get(f.name), f.dataType, f"{path}.{f.name}" if path and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else f.name, key)
        elif isinstance(t, T.ArrayType):
            items(v, t.elementType, path, key)
        elif isinstance(t, T.MapType):
            for k, x in v.items():
                if isinstance(t.valueType, T.ArrayType):
                    items(x, t.valueType.elementType, path, under(key, k))
                elif x is not None:
                    want.append((path, under(key, k), 0))
                    walk(x, t.valueType, path + ("{}" if isinstance(t.valueType, T.MapType) else ""), under(key, k))

    walk(body, of, "", "")
    got = merkle.bridges(df, "t", F.col("id"), F.col("body"), content=True, roots=True).collect()
    one = [r for r in got if r["owner_id"] == 1 and r["child_path"]]
    assert sorted((r["child_path"], r["parent_key"], r["item_no"]) for r in one) == sorted(want) and len(want) == 23
    held = {r["node_hash"] for r in got}
    assert all(r["parent_hash"] in held for r in got if r["child_path"]) and sum(r["child_path"] == "" for r in got) == 2
    # Equal objects have one identity and one content.
    assert {r["node_hash"]: r["content"] for r in one} == {r["node_hash"]: r["content"] for r in got if r["owner_id"] == 2 and r["child_path"]}
    # Rows that differ under one id all count.
    two = spark.createDataFrame([(1, {"b": [[[1]]]}), (1, {"b": [[[2]]]})], f"id long, body {kind}")
    assert merkle.bridges(two, "t", F.col("id"), F.col("body")).count() == 6


def test_robots_documents(spark):
    docs = ['{"signals":"one","headers":{"a":["1",null],"b":"2","c":null},"robots":{"groups":{"userAgents":"*","disallows":[null,"/x"]}}}', '"{\\"signals\\":[\\"w\\"]}"', '{"signals":["cut', None, "[1,2]", "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = merkle.bridges(df, "s", F.col("id"), merkle.robots_document(F.col("doc"))).collect()
    assert sorted((r["owner_id"], r["child_path"], r["parent_key"], r["item_no"]) for r in got) == [
        (0, "groups", "", 0), (0, "groups.agents", "0", 0), (0, "groups.disallows", "0", 1), (0, "headers", "a", 0), (0, "headers", "b", 0), (0, "signals", "", 0), (1, "signals", "", 0),
    ]


def test_edit_scripts():
    s = schema_drift.edit_script
    assert s({"a": "string"}, {"a": "number"}, {}) == [("retyped", "a", "")]
    assert s({"a": "object", "a.b": "string"}, {}, {}) == [("removed", "a", "")]
    assert s({}, {"a": "object", "a.b": "string"}, {}) == [("added", "a", "")]
    assert s({"p": "object", "p.x": "string"}, {"q": "object", "q.x": "string"}, {("p.x", "q.x"): (10, 9, 8)}) == [("renamed", "p", "q")]
    assert sorted(s({"x": "string"}, {"y": "string"}, {("x", "y"): (10, 2, 8)})) == [("added", "y", ""), ("removed", "x", "")]
    # A map that moves out of an object which is renamed in the same batch.
    before = {"i": "object", "i.h": "object", "i.h.*": "string", "i.p": "string"}
    after = {"t": "object", "t.p": "string", "h": "object", "h.*": "string"}
    got = s(before, after, {("i.h", "h"): (9, 9, 9), ("i.p", "t.p"): (9, 8, 7)})
    assert sorted(got) == [("moved", "i.h", "h"), ("renamed", "i", "t")]
    assert schema_drift.distance(before, after, got) == 2 + 2
    assert s({"a": "object", "a.c": "string", "z": "object"}, {"a": "object", "z": "object", "z.c": "string"}, {("a.c", "z.c"): (9, 9, 9)}) == [("moved", "a.c", "z.c")]
    # Without common keys, names and forms decide.
    assert s({"p": "object", "p.title": "string"}, {"p": "object", "p.page_title": "string"}, {}) == [("renamed", "p.title", "p.page_title")]
    assert sorted(s({"p": "object", "p.x": "string"}, {"q": "object", "q.y": "number"}, {})) == [("added", "q", ""), ("removed", "p", "")]
    # Chance agreement of two booleans is no evidence.
    assert ("renamed", "x", "y") not in s({"x": "boolean"}, {"y": "boolean"}, {("x", "y"): (10, 6, 2)})


def test_edit_scripts_are_the_cheapest_at_any_size():
    # r1 fits a1 best, but r1 to a2 and r2 to a1 save more together; the other renames only make the mappings many.
    for n in (0, 14, 60):
        before, after = ({x: "string" for x in (*names, *(f"{c}{i:02}" for i in range(n)))} for c, names in (("x", ("r1", "r2")), ("y", ("a1", "a2"))))
        seen = {("r1", "a1"): (100, 100, 99), ("r1", "a2"): (100, 90, 99), ("r2", "a1"): (100, 90, 99)} | {(f"x{i:02}", f"y{i:02}"): (9, 9, 9) for i in range(n)}
        got = schema_drift.edit_script(before, after, seen)
        assert sorted(got) == [("renamed", "r1", "a2"), ("renamed", "r2", "a1"), *(("renamed", f"x{i:02}", f"y{i:02}") for i in range(n))]


def test_drift_of_a_feed(spark):
    import json

    def record(i, batch):
        r = {"url": f"u{i}", "statusCode": 200, "httpHeaders": {f"x-{i}": "v"}, "pageData": {"title": f"t{i}", "size": i * 7 + 1}}
        if batch > 1:
            r["pageData"]["name"] = r["pageData"].pop("title")
        if batch > 2:
            r["pageData"]["size"] = str(r["pageData"]["size"])
            r["extra"] = {"deep": [i]}
        return json.dumps(r)

    rows = [(b * 100 + i, "f", b, record(i, b)) for b in (1, 2, 3) for i in range(12)]
    rows += [rows[0], (999, "f", 2, '{"cut'), (998, "f", 2, None), (997, "f", 2, "[]"), (996, "g", 1, "null")]
    df = spark.createDataFrame(rows, "raw_id long, feed_id string, batch_no int, payload string").withColumn("path", F.lit("clash"))
    got = sorted(tuple(r) for r in schema_drift.changes(df).collect())
    assert got == [("f", 2, "renamed", "pageData.title", "pageData.name"), ("f", 3, "added", "extra", ""), ("f", 3, "retyped", "pageData.size", "")]
    table = schema_drift.unified(df)
    assert table.count() == 36
    assert {r["page"]["title"][0] for r in table.where("batch_no = 3").collect()} == {f"t{i}" for i in range(12)}
    assert {r["page"]["size"][0] for r in table.where("url = 'u3'").collect()} == {"22"}
    assert schema_drift.changes(df.limit(0)).count() == 0


def test_no_value_of_a_record_is_lost(spark):
    """Every atom of every payload is in its row of the unified table."""
    import json

    def atoms(v):
        if isinstance(v, dict):
            return [x for m in v.values() for x in atoms(m)]
        if isinstance(v, list):
            return [x for m in v for x in atoms(m)]
        return [] if v is None else [v if isinstance(v, str) else json.dumps(v)]

    first = {"url": "u", "statusCode": 200, "pageData": {"title": "t", "size": 7, "tags": ["a", "b"], "flag": True}, "httpHeaders": {"server": "x", "etag": ["1", "2"]}, "result": {"all": ["WP"]}}
    odd = [
        {"url": "u", "statusCode": "200 OK", "pageData": {"title": ["a", "b", "c"], "size": "12 ms", "tags": "p,q", "flag": {"deep": [1, {"er": 2}]}}, "httpHeaders": [{"key": "server", "value": "y"}, {"key": "server", "value": "z"}], "result": {"all": [{"name": "Joomla", "v": 3}]}},
        {"url": ["list"], "pageData": {"title": {"x": 1, "y": 2}, "size": None, "tags": [], "flag": False}, "other": {"title": "second", "page.title": "third"}}, {"pageData": "plain", "meta": {"og:title": "q", "title": "r"}},
    ]
    rows = [(i, "f", 1, json.dumps(first)) for i in range(6)] + [(100 + i, "f", 2, json.dumps(odd[i % 3])) for i in range(9)] + [(200, None, None, json.dumps(odd[0]))]
    df = spark.createDataFrame(rows, "raw_id long, feed_id string, batch_no int, payload string")
    got = {r["raw_id"]: r.asDict(True) for r in schema_drift.unified(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for raw_id, _, _, payload in rows:
        held = json.dumps(got[raw_id], default=str)
        assert [a for a in atoms(json.loads(payload)) if not all(part in held.replace("\\", "") for part in a.replace('"', "").split(","))] == []


def test_evolution_needs_both_halves(spark):
    from tracegrid.operators.discovery import evolution

    rows = [(str(i), "p", "old" if i < 5 else "new" if i >= 15 else "both", "v", None, dt.datetime(2024, 1, 1 + i)) for i in range(20)]
    got = by(evolution(spark.createDataFrame(rows, OBS)).collect(), "feature")
    assert got["old"]["change"] == "deprecated" and got["new"]["change"] == "new" and "both" not in got


def test_technologies_versions_and_features(spark):
    from tracegrid.operators import technology as T

    rows = [("a", "header", "server", "Apache/2"), ("a", "script", "", "/wp-content/jquery.js"), ("b", "header", "Server", None), ("b", "meta", "ng-version", "9"), ("c", "platform", "", "Joomla")]
    found = T.detections(spark.createDataFrame(rows, "site string, dim string, name string, value string"), F.lit(3))
    got = by(found.collect(), "technology")
    assert set(got) == {"Apache", "WordPress", "jQuery", "Angular", "Drupal"} and got["jQuery"]["security"] == 0.6
    one = T.stack(found).first()
    assert (one["categories"], one["complexity"], one["modernity"]) == (3, "moderate", 0.5)
    assert by(T.compatibility(found).collect(), "technology")["WordPress"]["fits"] == "Apache"
    texts = spark.createDataFrame([(1, "WordPress 6.4.2"), (2, "Drupal 10"), (3, "WordPress 3.1"), (4, "Joomla! 4.2"), (5, None)], "id int, t string")
    best = T.best_versions(texts.select("id", F.explode(T.versions_of(F.col("t"), "meta-generator", "high")).alias("v")).select("id", "v.*"), "id")
    assert sorted((r["id"], r["version"]) for r in best.collect()) == [(1, "6.4.2"), (2, "10"), (4, "4.2")]
    page = spark.createDataFrame([(1, "<link href='/wp-content/x'>", {"X-Pingback": ["u"]}, None), (2, None, None, None)], "id int, h string, m map<string,array<string>>, g string")
    assert {r["feature"] for r in T.features(page, "id", F.col("h"), F.col("m"), F.col("g")).collect()} == {"hasWpContent", "hasPingback"}


def test_pages_and_their_parts(spark):
    from tracegrid.operators import pages as P

    html = """<a href='/a'>One <b>two</b></a><a class=x href="https://b.example/c">C</a><link rel="stylesheet" href="/s.css"><form><input type=text><input TYPE="Email"><select></select><input></form>
    <script src="/wp-content/plugins/shop-kit/a.js?ver=1.2"></script><link href='/wp-content/plugins/seo/b.css'><div class="x wp-block"></div>"""
    df = spark.createDataFrame([(html,), (None,)], "h string")
    r, none = df.select(P.links(F.col("h")).alias("l"), P.stylesheets(F.col("h")).alias("s"), P.forms(F.col("h")).alias("f"), P.plugins(F.col("h")).alias("p"), P.selector_counts(F.col("h")).alias("c"), F.size(P.scripts(F.col("h"))).alias("n")).collect()
    assert [(x["href"], x["text"]) for x in r["l"]] == [("/a", "One two"), ("https://b.example/c", "C")] and r["s"] == ["/s.css"] and r["n"] == 1
    assert [(x["field_count"], x["field_types"]) for x in r["f"]] == [(4, ["email", "select", "text"])]
    assert [(x["slug"], x["version"]) for x in r["p"]] == [("seo", None), ("shop-kit", "1.2")]
    assert {x["selector"]: x["count"] for x in r["c"] if x["count"]} == {'script[src*="wp-"]': 1, 'link[href*="wp-"]': 1, 'div[class*="wp-"]': 1}
    assert none["l"] == [] and none["p"] == [] and none["n"] == 0


def test_own_addresses(spark):
    from tracegrid.operators import pages as P

    rows = [("see https://www.a.example/x/map.xml here", True, 1), ("see https://b.example/x/map.xml here", False, 0), ("Sitemap: /map.xml", True, 1), ("href=map.xml " + "y" * 60 + " map.xml", True, 2), ("nothing", False, 0), (None, False, 0)]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "t string")
    got = df.select(P.own_pattern(F.col("t"), F.lit("a.example"), "map.xml"), P.own_pattern_count(F.col("t"), F.lit("a.example"), "map.xml")).collect()
    assert [(r[0], r[1]) for r in got] == [(o, n) for _, o, n in rows]


def test_telling_filters(spark):
    from tracegrid.operators import filters as X

    df = spark.createDataFrame([(["Server", "date", "cf-ray", "x-own"], ["viewport", "generator"], ["/jquery.js", None, "/own.js", "/swiper.js"]), (None, None, None)], "h array<string>, m array<string>, s array<string>")
    go = lambda level, custom=None: X.discriminative(df, F.col("h"), F.col("m"), F.col("s"), level, custom).select("headers", "metas", "scripts", F.round("reduction", 4)).collect()
    assert tuple(go("conservative")[0]) == (["Server", "x-own"], ["generator"], ["/jquery.js", None, "/own.js", "/swiper.js"], round(65 / 210, 4))
    assert go("aggressive")[0]["scripts"] == [None, "/own.js"] and go("custom", ["OWN"])[0]["scripts"] == ["/jquery.js", None, "/swiper.js"]
    assert tuple(go("aggressive")[1]) == ([], [], [], 0.0)
    obs = spark.createDataFrame([("a", "f"), ("b", "f")], "site string, feature string")
    assert X.require_sites(obs, 2).count() == 2
    with pytest.raises(Exception, match="fewer than 3 sites"):
        X.require_sites(obs, 3).count()


def test_signals_and_marks(spark):
    from tracegrid.operators import pages as P

    df = spark.createDataFrame([("<p>wp-json</p>", {"X-Pingback": ["u"], "Set-Cookie": ["wordpress_x=1", None]}, "Drupal 10", ["/sites/x.js", None]), (None, None, None, None)], "h string, m map<string,array<string>>, g string, s array<string>")
    got = df.select(P.signals(F.col("h"), F.col("m"), F.col("g"), F.col("s")).alias("x"), P.duda_confidence(F.col("h")).alias("d")).collect()
    assert {(x["signal"], x["platform"]) for x in got[0]["x"]} == {("html:wp-json", "WordPress"), ("header:x-pingback", "WordPress"), ("cookie:wordpress", "WordPress"), ("script:/sites/", "Drupal"), ("meta:generator", "Drupal"), ("meta:generator", "any")}
    assert got[1]["x"] == [] and got[0]["d"] == 0
    d = spark.createDataFrame([("SystemID: 'US_DIRECT_PRODUCTION' dmalbum",)], "t string").select(P.duda_confidence(F.col("t"))).first()[0]
    assert d == pytest.approx((0.9 + 0.75) / 2 + 0.1)
