"""Queries on stored captures: normalising, filtering, extracting, detecting, mining and reporting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K
from tracegrid.operators import corpus as C
from tracegrid.operators import detect as D
from tracegrid.operators import technology as T
from tracegrid.operators.merkle import unwrapped
from tracegrid.operators.tree_aggregate import platform_key
from tracegrid.plans.names import _in
from tracegrid.sources import observations as O
from tracegrid.session import table

Query = Callable[[SparkSession, str], DataFrame]


def index_query(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows of named platforms with a confidence of .8 and more that were loaded in half a year."""
    t = table(spark, sf, "capture_index").where((F.col("confidence") >= 0.8) & (F.col("loaded_at") >= F.lit("2024-03-01").cast("timestamp_ntz")) & (F.col("loaded_at") < F.lit("2024-09-01").cast("timestamp_ntz")))
    return t.select("entry_id", platform_key(F.col("cms")).alias("platform"), "confidence").where("platform <> 'unknown'")


def url_normalise_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One index row per normalised address, the most confident, ties to the first."""
    t = table(spark, sf, "capture_index").where("url is not null").select("entry_id", "url", "confidence")
    return C.deduplicated(t, "url", F.col("confidence"), "entry_id").select("normalized_url", "n_rows", "entry_id")


def latest_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One index row per normalised address with its scheme, the last loaded."""
    t = table(spark, sf, "capture_index").where("url is not null").select("entry_id", C.normalized_url(F.col("url"), keep_scheme=True).alias("u"), "loaded_at")
    best = F.min_by("entry_id", F.struct((-F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(0))).alias("t"), "entry_id"))
    return t.groupBy("u").agg(best.alias("entry_id")).select(F.col("u").alias("normalized_url"), "entry_id")


def _reasons(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "captures")
    reason = C.reject_reason(F.col("status_code"), F.col("page_data.html_content"), F.col("page_data.metadata")["title"], F.col("page_data.http_info.headers"), F.col("url"))
    return t.select("capture_id", reason.alias("reason"))


def quality_filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _reasons(spark, sf).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def script_names(spark: SparkSession, sf: str) -> DataFrame:
    """pattern, captures: named patterns of the scripts of captures, external and inline."""
    t = table(spark, sf, "captures").select("capture_id", F.explode("page_data.scripts").alias("s")).where("s is not null")
    src = F.coalesce("s.src", F.concat(F.lit("inline:"), F.substring("s.content", 1, 200)))
    rows = t.select("capture_id", F.explode(C.script_names(src)).alias("pattern"))
    return rows.groupBy("pattern").agg(F.count_distinct("capture_id").alias("captures"))


def script_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts found in the html of captures."""
    html = F.col("page_data.html_content")
    t = table(spark, sf, "captures").select("capture_id", F.explode(F.array_union(C.external_scripts(html), C.inline_scripts(html))).alias("script"))
    return t.distinct()


def meta_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Meta tags found in the html of captures."""
    return table(spark, sf, "captures").select("capture_id", F.explode(C.meta_tags(F.col("page_data.html_content"))).alias("tag")).distinct()


def same_domain_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts of captures, own and foreign."""
    t = table(spark, sf, "captures").select(O.host(F.col("url")).alias("h"), F.explode("page_data.scripts.src").alias("src")).where("src is not null")
    return t.groupBy(C.same_domain(F.col("src"), F.col("h")).alias("own")).agg(F.count(F.lit(1)).alias("scripts"))


def _robots(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "site_analyses")
    return t.select("record_id", F.try_variant_get(unwrapped(F.col("robots_analysis")), "$.content", "string").alias("content")).where("content is not null").distinct()


def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct agents, paths and sitemaps of each stored robots.txt."""
    r = _robots(spark, sf).select("record_id", C.robots_rules(F.col("content")).alias("r"))
    return r.select("record_id", F.array_join("r.agents", " ").alias("agents"), F.array_join("r.disallows", " ").alias("disallows"), F.array_join("r.sitemaps", " ").alias("sitemaps"))


def robots_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Paths are mapped onto the catalogue's first, so that rules meet data."""
    content = F.col("content")
    for a, b in _PATHS:
        content = F.replace(content, F.lit(a), F.lit(b))
    return D.robots_scores(_robots(spark, sf), "record_id", content)


_PATHS = [("/admin/", "/wp-admin/"), ("/search", "/wp-content/"), ("/tmp/", "/modules/"), ("/cgi/", "/core/"), ("/error/404", "/administrator/")]


def wall_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "captures")
    v = C.wall_verdicts(t, "capture_id", F.concat_ws(" ", "page_data.html_content", F.col("page_data.metadata")["title"], "url", F.to_json("page_data.http_info.headers")))
    return C.once(v, "capture_id", **{c: F.col(c) for c in v.columns if c != "capture_id"})


def wall_report(spark: SparkSession, sf: str) -> DataFrame:
    """primary_wall, risk, captures: the report over all captures."""
    return wall_verdicts(spark, sf).groupBy("primary_wall", "risk").agg(F.count(F.lit(1)).alias("captures"))


def storage_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = C.storage_statistics(table(spark, sf, "capture_index"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


def temporal_range(spark: SparkSession, sf: str) -> DataFrame:
    """First and last observation of headers and the span between in words."""
    a = table(spark, sf, "header_values").agg(F.min("captured_at").alias("a"), F.max("captured_at").alias("b"))
    days = F.datediff("b", "a")
    return a.select(F.date_format("a", "yyyy-MM-dd").alias("first"), F.date_format("b", "yyyy-MM-dd").alias("last"), C.span_text(days).alias("span"))


def index_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of script occurrences by kind of pattern."""
    t = table(spark, sf, "script_patterns").select(F.split_part("script_pattern", F.lit(":"), F.lit(1)).alias("kind"), "occurrences").where("kind is not null")
    return C.index_percentiles(t, "kind", "occurrences")


def platform_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Per platform: captures, mean scripts, forms, html size and technologies, and the share of status 200."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    mean = lambda c: F.round(F.avg(c), 4)
    cols = {"site": O.host(F.col("url")), "scripts": size("page_data.scripts"), "forms": size("page_data.forms"), "html_size": F.length("page_data.html_content"), "technologies": size("detection_result.all_technologies"), "status": F.col("status_code")}
    t = C.once(table(spark, sf, "captures"), "capture_id", **cols).join(O.site_platform(spark, sf), "site", "left")
    return t.groupBy(F.coalesce("platform", F.lit("unknown")).alias("platform")).agg(
        F.count(F.lit(1)).alias("captures"),
        *[mean(F.col(c)).alias(c) for c in ("scripts", "forms", "html_size", "technologies")],
        F.round(F.count_if(F.col("status") == 200) / F.count(F.lit(1)), 6).alias("ok"),
    )


def best_of_detectors(spark: SparkSession, sf: str) -> DataFrame:
    """Platforms by offline scores; words of the corpus stand in for signatures, so that rules meet data."""
    html = F.coalesce("page_data.html_content", F.lit(""))
    for a, b in _STAND_INS:
        html = F.replace(html, F.lit(a), F.lit(b))
    found = D.detected(table(spark, sf, "captures"), "capture_id", html, F.col("page_data.http_info.headers"), F.col("page_data.metadata")["generator"])
    return C.once(found, "capture_id", confidence=F.col("confidence"), platform=F.col("platform")).select("capture_id", "platform", "confidence")


_STAND_INS = [("sitemap", "/wp-content/"), ("plugin folder", "/wp-includes/"), ("redirect", "/administrator/"), ("certificate", "/components/"), ("meta tag", "/templates/"), ("robots check", "/core/"), ("theme", "dmalbum")]


def mined_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return D.mined_patterns(O.words(spark, sf), 0.01, 0.5)


def mined_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return D.signatures(D.mined_patterns(O.words(spark, sf), 0.01, 0.5))


def rule_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    obs = O.words(spark, sf)
    return D.rule_evaluation(D.signatures(D.mined_patterns(obs, 0.01, 0.5)), obs)


_REQUIRED = ["server", "etag", "vary", "server", "x-quill-link", "x-never-seen"]


def set_completeness(spark: SparkSession, sf: str) -> DataFrame:
    need = spark.createDataFrame([(x,) for x in _REQUIRED], "pattern string")
    return D.completeness(O.headers(spark, sf).select("platform", F.col("feature").alias("pattern")), need, "platform")


def name_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return D.name_consistency(table(spark, sf, "documents"), ["text"], "lang")


def _technologies(spark: SparkSession, sf: str) -> DataFrame:
    m = O.mapped_headers(spark, sf)
    heads = m.select("site", F.lit("header").alias("dim"), F.col("feature").alias("name"), "value")
    rows = heads.unionByName(m.select("site", F.lit("platform").alias("dim"), F.lit("").alias("name"), F.col("platform").alias("value")).distinct())
    return T.detections(rows, m.agg(F.count_distinct("site")).scalar())


def technology_detections(spark: SparkSession, sf: str) -> DataFrame:
    return _technologies(spark, sf)


def technology_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.stack(_technologies(spark, sf))


def technology_fits(spark: SparkSession, sf: str) -> DataFrame:
    return T.compatibility(_technologies(spark, sf))


def platform_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Best valid version per site from generator tags; platforms of the catalogue stand in for the invented names."""
    t = table(spark, sf, "meta_values").where("tag_key = 'name:generator' and tag_value is not null and site_host is not null")
    name = F.element_at(F.array(*[F.lit(x) for x in D.ORDER]), F.length("tag_value") % 4 + 1)
    text = F.concat(name, F.lit(" "), F.regexp_replace("tag_value", r"[^0-9.]", ""))
    found = t.select("site_host", F.explode(T.versions_of(text, "meta-generator", "high")).alias("v")).select("site_host", "v.*")
    return T.best_versions(found, "site_host")


def capture_features(spark: SparkSession, sf: str) -> DataFrame:
    """Telling features per platform: captures that show them."""
    html = F.coalesce("page_data.html_content", F.lit(""))
    for a, b in _STAND_INS:
        html = F.replace(html, F.lit(a), F.lit(b))
    per = T.features(table(spark, sf, "captures"), "capture_id", html, F.col("page_data.http_info.headers"), F.col("page_data.metadata")["generator"])
    return per.groupBy("platform", "feature", "confidence").agg(F.count_distinct("capture_id").alias("captures"))


_ALL = (
    technology_detections, technology_summary, technology_fits, platform_versions, capture_features, index_query, url_normalise_dedup, latest_dedup, quality_filter_counts, script_names, script_extract, meta_extract, same_domain_scripts, robots_rules, robots_scores, wall_verdicts, wall_report,
    storage_stats, temporal_range, index_percentiles, platform_comparison, best_of_detectors, mined_patterns, mined_signatures, rule_evaluation, set_completeness, name_consistency,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def _like(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_URL = r"^(?i:(https?))://([^/?#\s]+)([^?#\s]*)(?:\?[^#\s]*)?(?:#\S*)?\z"


def _normal(scheme: bool = False) -> str:
    host = rf"lower(regexp_extract(url, '{_URL}', 2))"
    bare = rf"regexp_replace(CASE WHEN lower(regexp_extract(url, '{_URL}', 1)) = 'https' THEN regexp_replace({host}, ':443$', '') ELSE regexp_replace({host}, ':80$', '') END, '^www\.', '')"
    path = rf"regexp_extract(url, '{_URL}', 3)"
    whole = f"{bare} || CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') WHEN {path} = '' THEN '/' ELSE {path} END"
    if scheme:
        whole = rf"lower(regexp_extract(url, '{_URL}', 1)) || '://' || {whole}"
    return rf"CASE WHEN regexp_matches(url, '{_URL}') THEN {whole} ELSE url END"


def _mined(frequency: float, share: float) -> str:
    return f"""WITH {O.WORDS_SQL}, sz AS (SELECT platform, count(DISTINCT site) AS np FROM obs GROUP BY 1), p AS (SELECT platform, feature, count(*) AS c, count(DISTINCT site) AS n FROM obs GROUP BY ALL), q AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS e FROM p),
mn AS (SELECT platform, feature AS pattern, round(c / np::DOUBLE, 6) AS frequency, round(n / e::DOUBLE, 6) AS share FROM q JOIN sz USING (platform)), mi AS (SELECT * FROM mn WHERE frequency >= {frequency} AND share >= {share}),
sg AS (SELECT platform, pattern, round(share * least(frequency, 1), 6) AS weight, frequency > .9 AND share > .9 AS required FROM mi QUALIFY row_number() OVER (PARTITION BY platform ORDER BY round(share * least(frequency, 1), 6) DESC, pattern) <= 5)"""


_CONTENT = """j0 AS (SELECT record_id, try_cast(robots_analysis AS JSON) AS j FROM site_analyses), j1 AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN try_cast(j->>'$' AS JSON) ELSE j END AS j FROM j0),
rb AS (SELECT DISTINCT record_id, j->>'$.content' AS content FROM j1 WHERE j->>'$.content' IS NOT NULL)"""


def _robots_sql() -> str:
    content = "content"
    for a, b in _PATHS:
        content = f"replace({content}, '{a}', '{b}')"
    met = lambda p: f"len(list_filter(ps, lambda p: {f"contains(p, '{p}') OR " if not p.startswith('/') else ''}regexp_replace(p, '/+$', '') = '{p.rstrip('/')}' OR p = '{p}' OR starts_with(p, '{p}*'))) > 0"
    cols = []
    for name, rules in K.ROBOTS_PATHS.items():
        total = " + ".join(f"CASE WHEN {met(p)} THEN {c} ELSE 0 END" for p, c in rules)
        n = " + ".join(f"({met(p)})::INT" for p, _ in rules)
        s = " + ".join(f"({met(p)})::INT" for p, _ in rules if p in K.SHARED_PATHS) or "0"
        cols.append(f"({total})::DOUBLE AS t_{name}, {n} AS n_{name}, {s} AS s_{name}")
    score = lambda x: f"CASE WHEN n_{x} > 0 THEN greatest(0, least(1, t_{x} / n_{x} + least(n_{x} * .1, .3) + least((n_{x} - s_{x}) * .15, .3) - least(s_{x} * .2, .4) + CASE WHEN legacy THEN .2 ELSE 0 END)) ELSE 0 END"
    names = list(K.ROBOTS_PATHS)
    return rf"""WITH {_CONTENT}, m AS (SELECT record_id, {content} AS content FROM rb), l AS (SELECT record_id, lower(content) AS t, list_filter(list_transform(string_split(lower(content), chr(10)), lambda x: regexp_extract(trim(replace(x, chr(13), ''), ' '), '^(?:dis)?allow:\s*(.*)$', 1)), lambda p: p <> '') AS ps FROM m),
h AS (SELECT record_id, contains(t, '/misc/') AND contains(t, '/profiles/') AND contains(t, '/modules/') AND contains(t, '/themes/') AND NOT contains(t, '/core/') AS legacy, {', '.join(cols)} FROM l),
s AS (SELECT record_id, {', '.join(f'round({score(x)}, 9) AS {x}' for x in names)} FROM h), b AS (SELECT *, greatest({', '.join(names)}) AS best FROM s)
SELECT record_id, CASE WHEN best > .3 THEN CASE {' '.join(f"WHEN {x} = best THEN '{x}'" for x in names)} END ELSE 'Unknown' END AS platform, round(CASE WHEN best > .3 THEN best ELSE 0 END, 6) AS confidence FROM b"""


def _walls_sql() -> str:
    hits = ", ".join(f"CASE WHEN {_like('t', ind)} THEN {{'name': '{n}', 'c': {c}::DOUBLE, 'r': {d}, 'i': {i}}} END" for i, (n, _, _, c, d, ind) in enumerate(K.WALLS))
    return f"""WITH cp AS (SELECT DISTINCT capture_id, lower(concat_ws(' ', page_data.html_content, page_data.metadata['title'], url, page_data.http_info.headers::VARCHAR)) AS t FROM captures), w AS (SELECT capture_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS w FROM cp),
v AS (SELECT *, list_avg(list_transform(w, lambda x: x.c)) AS m, list_max(list_transform(w, lambda x: x.r)) AS h FROM w)
SELECT capture_id, len(w)::INT AS walls, coalesce(list_sort(list_transform(w, lambda x: {{'c': -x.c, 'i': x.i, 'name': x.name}}))[1].name, 'none') AS primary_wall,
  CASE WHEN len(w) = 0 THEN 'low' WHEN h >= 4 OR m >= .9 - 1e-12 THEN 'critical' WHEN h >= 3 OR m >= .8 - 1e-12 THEN 'high' WHEN h >= 2 OR m >= .6 - 1e-12 THEN 'medium' ELSE 'low' END AS risk FROM v"""


def oracle_sql() -> dict[str, str]:
    stand_in = "coalesce(page_data.html_content, '')"
    for a, b in _STAND_INS:
        stand_in = f"replace({stand_in}, '{a}', '{b}')"
    tech = f"""{O.MAPPED_SQL}, n AS (SELECT count(DISTINCT site) AS n FROM obs), f AS (
SELECT site, 'Cloudflare' AS technology FROM obs WHERE feature = 'cf-ray' AND value <> '' UNION ALL SELECT site, 'AWS CloudFront' FROM obs WHERE contains(feature, 'x-amz-cf') AND value <> ''
UNION ALL SELECT site, CASE platform WHEN 'WordPress' THEN 'WordPress' ELSE 'Drupal' END FROM obs WHERE platform IN ('WordPress', 'Drupal', 'Joomla')),
td AS (SELECT technology, count(DISTINCT site) AS sites, CASE technology WHEN 'Cloudflare' THEN 'cdn' WHEN 'AWS CloudFront' THEN 'cdn' ELSE 'cms' END AS category, CASE technology WHEN 'Cloudflare' THEN .95 ELSE .9 END::DOUBLE AS confidence, CASE technology WHEN 'Cloudflare' THEN 'rising' ELSE 'stable' END AS trend,
  round(count(DISTINCT site) / any_value(n)::DOUBLE, 6) AS adoption, CASE WHEN technology IN ('WordPress', 'Drupal') THEN .7 ELSE .8 END::DOUBLE AS security FROM f, n GROUP BY technology)"""
    lists = lambda name: f"array_to_string(list_sort(list_distinct(list_filter(list_transform(ls, lambda x: regexp_extract(x, '^(?i){name}\\s*:\\s*(.*?)\\s*$', 1)), lambda v: v <> ''))), ' ')"
    mined = _mined(0.01, 0.5)
    return {
        "technology_detections": f"WITH {tech} SELECT * FROM td",
        "technology_summary": f"WITH {tech} SELECT count(DISTINCT category) AS categories, 'simple' AS complexity, .5::DOUBLE AS modernity, string_agg(technology, ', ' ORDER BY technology) FILTER (WHERE confidence > .8) AS primary_stack FROM td",
        "platform_versions": r"""WITH g AS (SELECT site_host, (['WordPress', 'Joomla', 'Drupal', 'Duda'])[(length(tag_value) % 4 + 1)::INT] AS platform, regexp_extract(regexp_replace(tag_value, '[^0-9.]', '', 'g'), '(\d+(?:\.\d+)*)', 1) AS v0 FROM meta_values WHERE tag_key = 'name:generator' AND tag_value IS NOT NULL AND site_host IS NOT NULL),
h AS (SELECT site_host, platform, CASE WHEN platform IN ('WordPress', 'Joomla') THEN regexp_extract(v0, '^(\d+\.\d+(?:\.\d+)?)', 1) ELSE v0 END AS version FROM g),
p AS (SELECT *, coalesce(try_cast(split_part(version, '.', 1) AS INT), 0) AS a, coalesce(try_cast(split_part(version, '.', 2) AS INT), 0) AS b, coalesce(try_cast(split_part(version, '.', 3) AS INT), 0) AS c FROM h WHERE version <> ''),
ok AS (SELECT * FROM p WHERE (platform = 'WordPress' AND regexp_matches(version, '^\d+\.\d+(?:\.\d+)?$') AND a BETWEEN 4 AND 10 AND b <= 20 AND c <= 20) OR (platform = 'Drupal' AND regexp_matches(version, '^\d+(?:\.\d+){0,2}$') AND a BETWEEN 6 AND 11 AND b <= 50 AND c <= 50)
  OR (platform = 'Joomla' AND regexp_matches(version, '^\d+\.\d+(?:\.\d+)?$') AND a BETWEEN 1 AND 5 AND b <= 10 AND c <= 50) OR (platform = 'Duda' AND regexp_matches(version, '^\d{4}$') AND a BETWEEN 4000 AND 9999))
SELECT site_host, platform, min(version) AS version, 'meta-generator' AS source FROM ok GROUP BY site_host, platform""",
        "capture_features": f"WITH c AS (SELECT DISTINCT ON (capture_id) capture_id, lower({stand_in}) AS t, list_transform(map_keys(page_data.http_info.headers), lambda k: lower(k)) AS h, lower(coalesce(page_data.metadata['generator'], '')) AS g FROM captures) "
        + " UNION ALL ".join(f"SELECT '{p}' AS platform, '{f}' AS feature, {c}::DOUBLE AS confidence, count(*) AS captures FROM c WHERE {dict(html=f"contains(t, '{x}')", header=f"list_contains(h, '{x}')", generator=f"contains(g, '{x}')")[w]} HAVING count(*) > 0" for f, p, c, w, x in T.FEATURES),
        "index_query": f"SELECT * FROM (SELECT entry_id, {O._KEY} AS platform, confidence FROM capture_index WHERE confidence >= .8 AND loaded_at >= TIMESTAMP '2024-03-01' AND loaded_at < TIMESTAMP '2024-09-01') WHERE platform <> 'unknown'",
        "url_normalise_dedup": f"SELECT u AS normalized_url, count(*) AS n_rows, arg_min(entry_id, (-coalesce(confidence, -1e300), entry_id)) AS entry_id FROM (SELECT *, {_normal()} AS u FROM capture_index WHERE url IS NOT NULL) GROUP BY u",
        "latest_dedup": f"SELECT u AS normalized_url, arg_min(entry_id, (-coalesce(epoch_us(loaded_at), 0), entry_id)) AS entry_id FROM (SELECT *, {_normal(True)} AS u FROM capture_index WHERE url IS NOT NULL) GROUP BY u",
        "quality_filter_counts": rf"""WITH x AS (SELECT status_code AS s, page_data.html_content AS h, lower(coalesce(page_data.html_content, '')) AS t, lower(coalesce(page_data.metadata['title'], '')) AS ti, page_data.http_info.headers AS hd, url FROM captures)
SELECT CASE WHEN s IN (403, 503) AND ({_like('t', K.BOT_PHRASES)} OR {_like('ti', K.BOT_PHRASES)}) THEN 'bot-detection' WHEN s >= 400 OR (s = 200 AND ({_like('t', K.ERROR_PHRASES)} OR {_like('ti', K.ERROR_PHRASES)})) THEN 'error-page'
  WHEN h IS NULL OR length(h) < 100 OR hd IS NULL OR cardinality(hd) = 0 THEN 'insufficient-data' WHEN NOT coalesce(regexp_matches(url, '{_URL}'), false) THEN 'invalid-url' ELSE 'kept' END AS reason, count(*) AS n FROM x GROUP BY 1""",
        "same_domain_scripts": rf"""WITH x AS (SELECT lower(regexp_extract(url, '{O.HOST}', 1)) AS h, unnest(list_transform(page_data.scripts, lambda z: z.src)) AS src FROM captures), y AS (SELECT h, regexp_replace(lower(regexp_extract(src, '^(?i)(?:https?:)?//([^/?#:]+)', 1)), '^www\.', '') AS sh FROM x WHERE src IS NOT NULL)
SELECT sh = '' OR sh = regexp_replace(lower(h), '^www\.', '') AS own, count(*) AS scripts FROM y GROUP BY 1""",
        "robots_rules": f"WITH {_CONTENT}, l AS (SELECT record_id, list_transform(string_split_regex(content, '\\r?\\n'), lambda x: trim(x, ' ')) AS ls FROM rb) SELECT record_id, {lists('user-agent')} AS agents, {lists('disallow')} AS disallows, {lists('sitemap')} AS sitemaps FROM l",
        "robots_scores": _robots_sql(),
        "wall_verdicts": _walls_sql(),
        "wall_report": f"SELECT primary_wall, risk, count(*) AS captures FROM ({_walls_sql()}) GROUP BY ALL",
        "storage_stats": "SELECT count(*) AS n, strftime(min(loaded_at), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S') AS last, round(avg(confidence) FILTER (WHERE confidence > 0), 6) AS mean_confidence FROM capture_index",
        "temporal_range": """WITH a AS (SELECT min(captured_at)::DATE AS a, max(captured_at)::DATE AS b FROM header_values), d AS (SELECT *, b - a AS d FROM a), u AS (SELECT *, CASE WHEN d < 7 THEN d WHEN d < 30 THEN d // 7 WHEN d < 365 THEN d // 30 ELSE d // 365 END AS n, CASE WHEN d < 7 THEN 'day' WHEN d < 30 THEN 'week' WHEN d < 365 THEN 'month' ELSE 'year' END AS w FROM d)
SELECT a::VARCHAR AS first, b::VARCHAR AS last, n || ' ' || w || CASE WHEN n = 1 THEN '' ELSE 's' END AS span FROM u""",
        "index_percentiles": """WITH x AS (SELECT split_part(script_pattern, ':', 1) AS kind, occurrences FROM script_patterns WHERE script_pattern IS NOT NULL AND occurrences IS NOT NULL), l AS (SELECT kind, list_sort(list(occurrences)) AS d, count(*) AS n FROM x GROUP BY 1)
SELECT kind, n, d[(floor(n * .5) + 1)::INT] AS p50, d[(floor(n * .95) + 1)::INT] AS p95, d[(floor(n * .99) + 1)::INT] AS p99 FROM l""",
        "platform_comparison": f"""WITH {O._SP}, cp AS (SELECT DISTINCT ON (capture_id) *, lower(regexp_extract(url, '{O.HOST}', 1)) AS h FROM captures)
SELECT coalesce(platform, 'unknown') AS platform, count(*) AS captures, round(avg(coalesce(len(page_data.scripts), 0)), 4) AS scripts, round(avg(coalesce(len(page_data.forms), 0)), 4) AS forms, round(avg(length(page_data.html_content)), 4) AS html_size,
  round(avg(coalesce(len(detection_result.all_technologies), 0)), 4) AS technologies, round(count(*) FILTER (WHERE status_code = 200) / count(*)::DOUBLE, 6) AS ok FROM cp LEFT JOIN sp ON site = h GROUP BY 1""",
        "mined_patterns": f"{mined} SELECT * FROM mi",
        "mined_signatures": f"{mined} SELECT * FROM sg",
        "rule_evaluation": f"""{mined}, n AS (SELECT count(DISTINCT site) AS n FROM obs), h AS (SELECT DISTINCT site, obs.platform AS own, sg.platform AS rule FROM obs JOIN sg ON pattern = feature), c AS (SELECT rule, count(*) FILTER (WHERE own = rule) AS tp, count(*) FILTER (WHERE own <> rule) AS fp FROM h GROUP BY 1)
SELECT platform, tp, fp, np - tp AS fn, n - fp - np AS tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / np::DOUBLE, 6) AS recall, round((tp + n - fp - np) / n::DOUBLE, 6) AS accuracy FROM sz JOIN c ON rule = platform, n""",
        "set_completeness": f"""WITH {O.HEADERS_SQL}, r AS (SELECT DISTINCT unnest({_REQUIRED!r}) AS pattern), n AS (SELECT count(*) AS n FROM r), f AS (SELECT platform, count(DISTINCT feature) FILTER (WHERE feature IN (SELECT pattern FROM r)) AS found FROM obs GROUP BY 1)
SELECT platform, found, n - found AS missing, round(found * 100 / n::DOUBLE, 4) AS score FROM f, n""",
        "name_consistency": "WITH p AS (SELECT coalesce(text, '') AS t, count(DISTINCT lang) AS k FROM documents GROUP BY 1) SELECT count(*) AS identities, count(*) FILTER (WHERE k = 1) AS single, round(count(*) FILTER (WHERE k = 1) / count(*)::DOUBLE, 6) AS consistency FROM p",
    }
