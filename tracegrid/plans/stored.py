"""Queries on stored pages, scripts and verdicts: elements, filters, exports, catalogue matches, agreement of detectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K
from tracegrid.operators import analyses as S
from tracegrid.operators import corpus as C
from tracegrid.operators import filters as X
from tracegrid.operators import pages as P
from tracegrid.operators import scripts as T
from tracegrid.operators.merkle import unwrapped
from tracegrid.operators.tree_aggregate import platform_key
from tracegrid.plans.names import _in
from tracegrid.sources import observations as O
from tracegrid.session import table

Query = Callable[[SparkSession, str], DataFrame]
#: Parts that a custom filter leaves out of script addresses.
CUSTOM = ["/loader", "shared"]


def _captures(spark: SparkSession, sf: str, **cols: F.Column) -> DataFrame:
    """capture_id and the columns, of every capture once."""
    return C.once(table(spark, sf, "captures"), "capture_id", **cols)


def _html() -> F.Column:
    return F.col("page_data.html_content")


def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Links, scripts, style sheets and forms of every stored page, and headings."""
    n = lambda rx: F.size(P.all_of(_html(), rx))
    return _captures(spark, sf, links=n(P.LINK), scripts=n(P.SCRIPT), stylesheets=n(P.STYLESHEET), forms=n(P.FORM), headings=n(r"(?i)<h[1-6]\b[^>]*>"), paragraphs=n(r"(?i)<p\b[^>]*>"))


def dom_selectors(spark: SparkSession, sf: str) -> DataFrame:
    """How often the fixed selectors meet an element, over all pages."""
    rows = _captures(spark, sf, counts=P.selector_counts(F.coalesce(_html(), F.lit("")))).select(F.explode("counts").alias("c"))
    return rows.groupBy("c.selector").agg(F.sum("c.count").alias("elements"), F.count_if(F.col("c.count") > 0).alias("pages"))


def form_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Forms by their distinct field types."""
    t = table(spark, sf, "captures").select("capture_id", F.posexplode("page_data.forms").alias("form_no", "f")).where("f is not null").distinct()
    types = F.array_sort(F.array_distinct(F.filter(F.coalesce("f.field_types", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    size = F.coalesce(F.size("f.field_types"), F.lit(0))
    return t.select(F.array_join(types, ",").alias("field_types"), F.when(F.col("f.field_types").isNull(), 0).otherwise(size).alias("n")).groupBy("field_types").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("fields"))


def truncated_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages cut at 400 characters with a mark: how many, and the characters kept."""
    t = _captures(spark, sf, n=F.length(_html()), cut=F.length(C.truncated(_html(), 400)))
    return t.agg(F.count("n").alias("pages"), F.count_if(F.col("n") > 400).alias("cut"), F.sum("n").alias("characters"), F.sum("cut").alias("kept"))


def stripped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of pages before and after scripts and styles are taken out."""
    t = _captures(spark, sf, a=F.length(_html()), b=F.length(X.stripped(_html())))
    return t.agg(F.sum("a").alias("before"), F.sum("b").alias("after"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def capture_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Captures by data quality."""
    scripts, metas = F.coalesce(F.size("page_data.scripts"), F.lit(0)), F.coalesce(F.size("page_data.metadata"), F.lit(0))
    fix = lambda c, of: F.when(F.col(of).isNull(), 0).otherwise(c)
    t = _captures(spark, sf, label=C.quality_label(F.round(C.quality_score(_html(), fix(scripts, "page_data.scripts"), fix(metas, "page_data.metadata")), 6)))
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("captures"))


def rejected_v1(spark: SparkSession, sf: str) -> DataFrame:
    """Captures by the reason of the older filter over one year; null for those that stay."""
    reason = X.reject_reason_v1(F.col("status_code"), F.col("captured_at"), F.lit("mainpage"), _html(), F.col("page_data.metadata")["title"], F.col("url"), "2024-01-01", "2025-01-01")
    return _captures(spark, sf, reason=reason).groupBy("reason").agg(F.count(F.lit(1)).alias("captures"))


def captures_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """Captures per month within a range of dates, both ends included."""
    t = table(spark, sf, "captures").where(C.in_range(F.col("captured_at"), "2024-02-01", "2024-09-30")).select("capture_id", F.date_format("captured_at", "yyyy-MM").alias("month")).distinct()
    return t.groupBy("month").agg(F.count(F.lit(1)).alias("captures"))


def capture_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of one stored file: a point lookup that reaches the scan as a filter."""
    first = table(spark, sf, "capture_index").where("file_id is not null").agg(F.min("file_id")).scalar()
    return table(spark, sf, "capture_index").where(F.col("file_id") == first).select("entry_id", "file_id", "url")


def capture_export(spark: SparkSession, sf: str) -> DataFrame:
    """The flat export in its fixed columns; what a capture does not record is empty."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    t = _captures(
        spark, sf, url=F.col("url"), timestamp=F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"), statusCode=F.col("status_code"), htmlSize=F.coalesce(F.length(_html()), F.lit(0)), metaTagCount=size("page_data.metadata"), scriptCount=size("page_data.scripts"), linkCount=F.size(P.all_of(_html(), P.LINK)),
    )
    site = O.site_platform(spark, sf).select(F.col("site").alias("_site"), F.col("platform").alias("cms"))
    t = t.withColumn("_site", O.host(F.col("url"))).join(site, "_site", "left")
    empty = {"finalUrl": F.col("url"), "cms": F.coalesce("cms", F.lit("unknown")), "confidence": F.lit(""), "version": F.lit(""), "redirectCount": F.lit(0), "protocolUpgraded": F.lit(False), "loadTime": F.lit("")}
    return t.withColumns(empty).select("capture_id", *K.EXPORT_COLUMNS)


def discriminative_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Per level of filtering: headers, meta tags and scripts before and after, and the mean share of tokens saved."""
    keys = lambda c: F.map_keys(c)
    src = F.transform("page_data.scripts", lambda s: s["src"])
    t = _captures(spark, sf, h=keys(F.col("page_data.http_info.headers")), m=keys(F.col("page_data.metadata")), s=src)
    out = None
    for level in X.LEVELS:
        f = X.discriminative(t, F.col("h"), F.col("m"), F.col("s"), level, CUSTOM if level == "custom" else None)
        sums = [F.sum(f"{k}_before").alias(f"{k}_before") for k in ("headers", "metas", "scripts")] + [F.sum(F.size(k)).alias(f"{k}_after") for k in ("headers", "metas", "scripts")]
        one = f.agg(F.lit(level).alias("level"), *sums, F.round(F.avg("reduction"), 6).alias("reduction"))
        out = one if out is None else out.unionByName(one)
    return out


def own_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Robots files that name a sitemap of their own host, and how often."""
    doc = unwrapped(F.col("robots_analysis"))
    t = table(spark, sf, "site_analyses").select("record_id", O.host(F.col("url")).alias("host"), F.try_variant_get(doc, "$.content", "string").alias("content")).where("content is not null").distinct()
    return t.select("record_id", P.own_pattern(F.col("content"), F.col("host"), "sitemap.xml").alias("own"), P.own_pattern_count(F.col("content"), F.col("host"), "sitemap.xml").alias("times"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """site, source: every example of a script pattern; its file stands for the site."""
    return table(spark, sf, "script_patterns").select(F.coalesce("file_id", F.lit("")).alias("site"), F.explode("examples").alias("source")).where("source is not null and source <> ''")


def script_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Platforms that script addresses and page addresses speak of, by the catalogue of parts."""
    rows = _sources(spark, sf).unionByName(table(spark, sf, "capture_index").where("url is not null").select(F.coalesce("file_id", F.lit("")).alias("site"), F.col("url").alias("source")))
    total = rows.agg(F.count_distinct("site")).scalar().cast("double")
    return T.platform_confidence(T.catalogue_matches(rows), total)


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "script_patterns").where("script_pattern is not null").select(F.split_part("script_pattern", F.lit(":"), F.lit(1)).alias("kind"), "file_id", "occurrences", "examples")


def script_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = T.kinds(_kinds(spark, sf))
    return k.join(T.cdn_share(k), "kind")


def _kind_shares(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "capture_index").where("file_id is not null").groupBy("file_id").agg(F.min(platform_key(F.col("cms"))).alias("platform"))
    rows = _kinds(spark, sf).where("file_id is not null").join(index, "file_id").select(F.col("file_id").alias("site"), "platform", "kind")
    return T.by_platform(rows)


def platform_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of scripts by platform, of those with three sites and more."""
    return _kind_shares(spark, sf)


def script_power(spark: SparkSession, sf: str) -> DataFrame:
    return T.kind_power(_kind_shares(spark, sf))


def script_advice(spark: SparkSession, sf: str) -> DataFrame:
    s = _kind_shares(spark, sf)
    return T.recommendations(s, T.kind_power(s))


def two_platforms(spark: SparkSession, sf: str) -> DataFrame:
    """Two platforms side by side by their kinds of scripts."""
    return T.two_platforms(_kind_shares(spark, sf), "drovana", "quillpress")


def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    doc = unwrapped(F.col("robots_analysis"))
    t = table(spark, sf, "site_analyses")
    return t.select(
        "record_id", "url", "main_page_cms", "main_page_confidence", "final_cms", "final_method", "agreement",
        F.try_variant_get(doc, "$.cms", "string").alias("robots_cms"), F.try_variant_get(doc, "$.confidence", "double").alias("robots_confidence"),
    ).distinct()


def hybrid_detection(spark: SparkSession, sf: str) -> DataFrame:
    """The platform of each record by robots files (generated) and main pages (built in) together."""
    t = _analyses(spark, sf)
    a = t.select("record_id", F.col("robots_cms").alias("platform"), F.lit("generated").alias("source"), F.col("robots_confidence").alias("confidence"))
    b = t.select("record_id", F.col("main_page_cms").alias("platform"), F.lit("builtin").alias("source"), F.col("main_page_confidence").alias("confidence"))
    return S.hybrid(a.unionByName(b), "record_id")


def collected_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The largest confidence of each platform at each address."""
    return S.best_per_address(_analyses(spark, sf).where("url is not null and main_page_cms is not null"), ["url", "main_page_cms"], F.col("main_page_confidence"))


def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Records by final platform and method, and how many agree."""
    return _analyses(spark, sf).groupBy("final_cms", "final_method").agg(F.count(F.lit(1)).alias("records"), F.count_if("agreement").alias("agreeing"))


def method_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How often the main page's verdict is the final one, by method."""
    return S.accuracy(_analyses(spark, sf), "final_method", F.col("main_page_cms"), F.col("final_cms"))


def confidence_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of the main page's confidence by method."""
    return S.spread(_analyses(spark, sf), "final_method", F.col("main_page_confidence"))


def _counted(v: str) -> F.Column:
    doc = unwrapped(F.col("robots_analysis"))
    own = F.try_variant_get(doc, v, "array<variant>")
    return F.when(own.isNull(), 0).otherwise(F.size(own))


def extra_context(spark: SparkSession, sf: str) -> DataFrame:
    """Signals and groups listed by the records."""
    t = table(spark, sf, "site_analyses").select("record_id", _counted("$.signals").alias("signals"), _counted("$.robots.groups").alias("groups")).distinct()
    return t.groupBy("signals", "groups").agg(F.count(F.lit(1)).alias("records"))


def header_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Telling signals of captures by tier."""
    s = P.signals(_html(), F.col("page_data.http_info.headers"), F.col("page_data.metadata")["generator"], F.transform("page_data.scripts", lambda x: x["src"]))
    rows = _captures(spark, sf, s=s).select("capture_id", F.explode("s").alias("x"))
    return rows.groupBy("x.signal", "x.tier", "x.platform").agg(F.count_distinct("capture_id").alias("captures"))


_ALL = (
    page_elements, dom_selectors, form_fields, truncated_pages, stripped_pages, capture_quality, rejected_v1, captures_in_range, capture_lookup, capture_export, discriminative_filters, own_addresses, script_catalogue, script_kinds, platform_scripts,
    script_power, script_advice, two_platforms, hybrid_detection, collected_analysis, verdict_counts, method_accuracy, confidence_spread, extra_context, header_signals,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


_ONE = "cp AS (SELECT DISTINCT ON (capture_id) capture_id, url, status_code, captured_at, page_data FROM captures)"
_HTML = "page_data.html_content"
_KINDS = "kd AS (SELECT split_part(script_pattern, ':', 1) AS kind, file_id, occurrences, list_filter(coalesce(examples, []), lambda e: e IS NOT NULL AND e <> '') AS e FROM script_patterns WHERE script_pattern IS NOT NULL)"
_KEY = O._KEY
_SHARES = f"""{_KINDS}, ix AS (SELECT file_id, min({_KEY}) AS platform FROM capture_index WHERE file_id IS NOT NULL GROUP BY 1), rw AS (SELECT DISTINCT file_id AS site, platform, kind FROM kd JOIN ix USING (file_id)),
sz AS (SELECT platform, count(DISTINCT site) AS np FROM rw GROUP BY 1 HAVING count(DISTINCT site) >= 3), sh AS (SELECT kind, platform, count(*) AS sites, round(count(*) / any_value(np)::DOUBLE, 6) AS share FROM rw JOIN sz USING (platform) GROUP BY ALL)"""
_POWER = "pw AS (SELECT kind, count(*) AS platforms, round(CASE WHEN count(*) <= 1 THEN 0 ELSE least(1, 2 * stddev_pop(share)) END, 6) AS power FROM sh GROUP BY 1)"
_DOC = "j0 AS (SELECT *, try_cast(robots_analysis AS JSON) AS j0 FROM site_analyses), jd AS (SELECT * EXCLUDE (j0), CASE WHEN json_type(j0) = 'VARCHAR' THEN try_cast(j0->>'$' AS JSON) ELSE j0 END AS j FROM j0)"
_ANALYSES = f"""{_DOC}, an AS (SELECT DISTINCT record_id, url, main_page_cms, main_page_confidence, final_cms, final_method, agreement, j->>'$.cms' AS robots_cms, try_cast(j->>'$.confidence' AS DOUBLE) AS robots_confidence FROM jd)"""


def _count(rx: str) -> str:
    return f"coalesce(len(regexp_extract_all({_HTML}, '{rx.replace(chr(39), chr(39) * 2)}')), 0)"


def _level(name: str) -> str:
    h, m, t, lib = X.LEVELS[name]
    parts = (K.TRACKING_SCRIPTS if t else []) + (K.COMMON_LIBRARIES if lib else []) + (CUSTOM if name == "custom" else [])
    no = " OR ".join(f"contains(lower(x), '{p}')" for p in parts)
    h2 = f"list_filter(h, lambda x: lower(x) NOT IN {_in(K.GENERIC_HEADERS + K.INFRASTRUCTURE_HEADERS)})" if h else "h"
    m2 = f"list_filter(m, lambda x: lower(x) NOT IN {_in(K.UNIVERSAL_METAS)})" if m else "m"
    s2 = f"list_filter(s, lambda x: x IS NULL OR NOT ({no}))" if no else "s"
    return f"""SELECT '{name}' AS level, sum(len(h)) AS headers_before, sum(len(m)) AS metas_before, sum(len(s)) AS scripts_before, sum(len(h2)) AS headers_after, sum(len(m2)) AS metas_after, sum(len(s2)) AS scripts_after,
  round(avg(CASE WHEN b > 0 THEN (b - len(h2) * 25 - len(m2) * 15 - len(s2) * 20) / b::DOUBLE ELSE 0 END), 6) AS reduction FROM (SELECT *, {h2} AS h2, {m2} AS m2, {s2} AS s2, len(h) * 25 + len(m) * 15 + len(s) * 20 AS b FROM x)"""


def oracle_sql() -> dict[str, str]:
    sel = " UNION ALL ".join(f"SELECT '{n}' AS selector, coalesce(len(regexp_extract_all({_HTML}, '{('(?i)' + rx).replace(chr(39), chr(39) * 2)}')), 0) AS c FROM cp" for n, rx in K.SELECTORS)
    cat = []
    for part, category, platform in K.SCRIPT_PARTS:
        base = 0.95 if any(x in part for x in K.SURE_SCRIPT_PARTS) else K.SCRIPT_CATEGORY_CONFIDENCE[category]
        cat.append(f"('{part.lower()}', '{category}', '{platform}', {base}::DOUBLE)")
    strip = _HTML
    for rx in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<noscript\b.*?</noscript\s*>", r"(?i)\bclass\s*=\s*[\"''][^\"'']*(?:404|font)[^\"'']*[\"'']"):
        strip = f"regexp_replace({strip}, '{rx}', ' ', 'g')"
    bot, title = " OR ".join(f"contains(t, '{p}')" for p in X.V1_BOT), " OR ".join(f"contains(n, '{p}')" for p in X.V1_ERROR_TITLES)
    return {
        "page_elements": f"WITH {_ONE} SELECT capture_id, {_count(P.LINK)} AS links, {_count(P.SCRIPT)} AS scripts, {_count(P.STYLESHEET)} AS stylesheets, {_count(P.FORM)} AS forms, {_count(r'(?i)<h[1-6]\b[^>]*>')} AS headings, {_count(r'(?i)<p\b[^>]*>')} AS paragraphs FROM cp",
        "dom_selectors": f"WITH {_ONE} SELECT selector, sum(c)::BIGINT AS elements, count(*) FILTER (WHERE c > 0) AS pages FROM ({sel}) GROUP BY 1",
        "form_fields": """WITH q AS (SELECT DISTINCT capture_id, i, f FROM (SELECT capture_id, unnest(range(len(page_data.forms))) AS i, unnest(page_data.forms) AS f FROM captures) WHERE f IS NOT NULL)
SELECT array_to_string(list_sort(list_distinct(list_filter(coalesce(f.field_types, []), lambda x: x IS NOT NULL))), ',') AS field_types, count(*) AS forms, sum(coalesce(len(f.field_types), 0))::BIGINT AS fields FROM q GROUP BY 1""",
        "truncated_pages": f"WITH {_ONE} SELECT count({_HTML}) AS pages, count(*) FILTER (WHERE length({_HTML}) > 400) AS cut, sum(length({_HTML}))::BIGINT AS characters, sum(CASE WHEN length({_HTML}) > 400 THEN 400 + length('<!-- truncated -->') ELSE length({_HTML}) END)::BIGINT AS kept FROM cp",
        "stripped_pages": f"WITH {_ONE}, x AS (SELECT length({_HTML}) AS a, length({strip}) AS b FROM cp) SELECT sum(a)::BIGINT AS before, sum(b)::BIGINT AS after, count(*) FILTER (WHERE a <> b) AS changed FROM x",
        "capture_quality": f"""WITH {_ONE}, x AS (SELECT lower(coalesce({_HTML}, '')) AS t, coalesce(len(page_data.scripts), 0) AS s, coalesce(cardinality(page_data.metadata), 0) AS m FROM cp),
y AS (SELECT round(greatest(0, 1 - CASE WHEN t = '' THEN .4 WHEN length(t) < 1000 THEN .2 ELSE 0 END - CASE WHEN s = 0 THEN .2 WHEN s < 2 THEN .1 ELSE 0 END - CASE WHEN m = 0 THEN .1 ELSE 0 END - CASE WHEN regexp_matches(t, 'access denied|forbidden|not found|error') THEN .3 ELSE 0 END)::DOUBLE, 6) AS q FROM x)
SELECT CASE WHEN q >= .8 THEN 'high' WHEN q >= .5 THEN 'medium' WHEN q >= .3 THEN 'low' ELSE 'blocked' END AS label, count(*) AS captures FROM y GROUP BY 1""",
        "rejected_v1": f"""WITH {_ONE}, x AS (SELECT *, lower({strip.replace(_HTML, f"coalesce({_HTML}, '')")}) AS t, lower(coalesce(page_data.metadata['title'], '')) AS n FROM cp)
SELECT CASE WHEN NOT coalesce(captured_at >= TIMESTAMP '2024-01-01' AND captured_at < TIMESTAMP '2025-01-01', false) THEN 'date-range' WHEN NOT coalesce(regexp_matches(url, '^(?i)https?://[^\\s/]+'), false) THEN 'invalid-url' WHEN coalesce(status_code >= 400, false) THEN 'error-status'
  WHEN {bot} THEN 'bot-detection' WHEN {title} OR (contains(t, 'page not found') AND NOT regexp_matches(t, '{X._QUOTED}')) THEN 'error-page' END AS reason, count(*) AS captures FROM x GROUP BY 1""",
        "captures_in_range": "SELECT strftime(captured_at, '%Y-%m') AS month, count(DISTINCT capture_id) AS captures FROM captures WHERE captured_at >= TIMESTAMP '2024-02-01' AND captured_at <= TIMESTAMP '2024-09-30 23:59:59.999' GROUP BY 1",
        "capture_lookup": "SELECT entry_id, file_id, url FROM capture_index WHERE file_id = (SELECT min(file_id) FROM capture_index)",
        "capture_export": f"""WITH {O._SP}, {_ONE} SELECT capture_id, url, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS timestamp, url AS finalUrl, status_code AS statusCode, coalesce(platform, 'unknown') AS cms, '' AS confidence, '' AS version, 0 AS redirectCount, false AS protocolUpgraded, '' AS loadTime,
  coalesce(length({_HTML}), 0) AS htmlSize, coalesce(cardinality(page_data.metadata), 0)::INT AS metaTagCount, coalesce(len(page_data.scripts), 0) AS scriptCount, {_count(P.LINK)} AS linkCount FROM cp LEFT JOIN sp ON site = lower(regexp_extract(url, '{O.HOST}', 1))""",
        "discriminative_filters": f"""WITH {_ONE}, x AS (SELECT coalesce(map_keys(page_data.http_info.headers), []) AS h, coalesce(map_keys(page_data.metadata), []) AS m, coalesce(list_transform(page_data.scripts, lambda z: z.src), []) AS s FROM cp) {' UNION ALL '.join(_level(n) for n in X.LEVELS)}""",
        "own_addresses": f"""WITH {_DOC}, q AS (SELECT DISTINCT record_id, regexp_replace(lower(regexp_extract(url, '{O.HOST}', 1)), '^www\\.', '') AS host, j->>'$.content' AS c FROM jd WHERE j->>'$.content' IS NOT NULL), x AS (SELECT *, string_split(c, 'sitemap.xml') AS ps,
  len(list_filter(regexp_extract_all(c, '(?i)https?://[^\\s"''<>)]*?sitemap\\.xml'), lambda u: regexp_replace(lower(regexp_extract(u, '(?i)^https?://([^/:?#\\s]+)', 1)), '^www\\.', '') = host)) AS o FROM q),
y AS (SELECT record_id, o, list_transform(range(1, len(ps)), lambda i: array_to_string(ps[1:i], 'sitemap.xml')) AS le FROM x)
SELECT record_id, o > 0 OR len(list_filter(le, lambda z: NOT regexp_matches(lower(right(z, 50)), 'https?://'))) > 0 AS own, (o + len(list_filter(le, lambda z: NOT regexp_matches(lower(regexp_extract(right(z, 100), '([^\\s"''<>)]*)$', 1)), 'https?://'))))::INT AS times FROM y""",
        "script_catalogue": f"""WITH src AS (SELECT coalesce(file_id, '') AS site, unnest(examples) AS s FROM script_patterns UNION ALL SELECT coalesce(file_id, ''), url FROM capture_index), rw AS (SELECT * FROM src WHERE s IS NOT NULL AND s <> ''), n AS (SELECT count(DISTINCT site)::DOUBLE AS n FROM rw),
ct AS (SELECT * FROM (VALUES {', '.join(cat)}) AS t(part, category, platform, base)), m AS (SELECT part, category, platform, base, count(DISTINCT site) AS k FROM rw JOIN ct ON contains(lower(s), part) GROUP BY ALL)
SELECT platform, category, count(*) AS patterns, round(max(base * (.7 + .3 * least(3 * k / n, 1))), 6) AS confidence FROM m, n GROUP BY ALL""",
        "script_kinds": f"""WITH {_KINDS}, q AS (SELECT kind, count(*) AS patterns, sum(occurrences)::BIGINT AS occurrences, sum(len(e))::BIGINT AS examples, sum(len(list_filter(e, lambda x: regexp_matches(lower(x), '^(?:https?:)?//cdn\\.'))))::BIGINT AS on_cdn, sum(len(list_filter(e, lambda x: regexp_matches(x, '^/[^/]'))))::BIGINT AS relative,
  sum(len(list_filter(e, lambda x: regexp_matches(lower(x), '[?&]v(?:er)?='))))::BIGINT AS versioned FROM kd GROUP BY 1) SELECT *, round(CASE WHEN examples > 0 THEN on_cdn / examples::DOUBLE ELSE 0 END, 6) AS cdn_share FROM q""",
        "platform_scripts": f"WITH {_SHARES} SELECT * FROM sh",
        "script_power": f"WITH {_SHARES}, {_POWER} SELECT * FROM pw",
        "script_advice": f"""WITH {_SHARES}, {_POWER}, b AS (SELECT kind, max(share) AS share, arg_min(platform, (-share, platform)) AS platform FROM sh GROUP BY 1)
SELECT kind, platform, share, CASE WHEN power >= .5 THEN 'learn' WHEN power < .1 AND share > .5 THEN 'skip' ELSE 'watch' END AS advice FROM b JOIN pw USING (kind)""",
        "two_platforms": f"WITH {_SHARES}, q AS (SELECT kind, coalesce(max(share) FILTER (WHERE platform = 'drovana'), 0) AS first, coalesce(max(share) FILTER (WHERE platform = 'quillpress'), 0) AS second FROM sh WHERE platform IN ('drovana', 'quillpress') GROUP BY 1) SELECT *, round(first - second, 6) AS difference FROM q",
        "hybrid_detection": f"""WITH {_ANALYSES}, r AS (SELECT record_id, robots_cms AS platform, 1.2 AS w, robots_confidence AS c FROM an UNION ALL SELECT record_id, main_page_cms, 1.0, main_page_confidence FROM an),
p AS (SELECT record_id, platform, round(least(1, sum(c * w) / sum(w)), 9) AS c, round(avg(c) FILTER (WHERE w > 1.1), 6) AS generated, round(avg(c) FILTER (WHERE w < 1.1), 6) AS builtin FROM r WHERE c > 0 AND platform IS NOT NULL GROUP BY ALL)
SELECT record_id, CASE WHEN c >= .4 THEN platform ELSE 'Unknown' END AS platform, round(c, 6) AS confidence, generated, builtin FROM p QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY c DESC, platform) = 1""",
        "collected_analysis": f"WITH {_ANALYSES} SELECT url, main_page_cms, round(max(main_page_confidence), 6) AS confidence, count(*) AS records FROM an WHERE url IS NOT NULL AND main_page_cms IS NOT NULL GROUP BY ALL",
        "verdict_counts": f"WITH {_ANALYSES} SELECT final_cms, final_method, count(*) AS records, count(*) FILTER (WHERE agreement) AS agreeing FROM an GROUP BY ALL",
        "method_accuracy": f"WITH {_ANALYSES} SELECT final_method, count(*) AS records, count(*) FILTER (WHERE main_page_cms = final_cms) AS \"right\", round(count(*) FILTER (WHERE main_page_cms = final_cms) / count(*)::DOUBLE, 6) AS accuracy FROM an GROUP BY 1",
        "confidence_spread": f"WITH {_ANALYSES} SELECT final_method, count(*) AS n, min(main_page_confidence) AS lowest, max(main_page_confidence) AS highest, round(avg(main_page_confidence), 6) AS mean, round(quantile_cont(main_page_confidence, .5), 6) AS median, round(quantile_cont(main_page_confidence, .95), 6) AS p95 FROM an WHERE main_page_confidence IS NOT NULL GROUP BY 1",
        "extra_context": f"WITH {_DOC}, q AS (SELECT DISTINCT record_id, CASE WHEN json_type(j, '$.signals') = 'ARRAY' THEN json_array_length(j, '$.signals') ELSE 0 END AS signals, CASE WHEN json_type(j, '$.robots.groups') = 'ARRAY' THEN json_array_length(j, '$.robots.groups') ELSE 0 END AS groups FROM jd) SELECT signals::INT AS signals, groups::INT AS groups, count(*) AS records FROM q GROUP BY ALL",
    }
