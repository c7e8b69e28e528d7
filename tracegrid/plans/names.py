"""Queries on what header names say: classes, vendors, naming patterns, change over time, advice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K
from tracegrid.operators import discovery as G
from tracegrid.operators import frequency as Q
from tracegrid.operators import vendors as V
from tracegrid.plans.features import _SITES
from tracegrid.sources import observations as O

Query = Callable[[SparkSession, str], DataFrame]


def _obs(spark: SparkSession, sf: str) -> DataFrame:
    return O.mapped_headers(spark, sf)


def header_classes(spark: SparkSession, sf: str) -> DataFrame:
    return V.classified(_obs(spark, sf).select("feature").unionByName(O.headers(spark, sf).select("feature")).distinct())


def vendor_detections(spark: SparkSession, sf: str) -> DataFrame:
    return V.detections(_obs(spark, sf))


def vendor_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return V.vendor_rollup(V.detections(_obs(spark, sf)))


def vendor_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return V.vendor_concentration(V.detections(_obs(spark, sf)))


def technology_stack(spark: SparkSession, sf: str) -> DataFrame:
    return V.technology_stack(V.detections(_obs(spark, sf)))


def vendor_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return V.vendor_conflicts(V.detections(_obs(spark, sf)))


def category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return V.category_distribution(_obs(spark, sf))


def semantic_quality(spark: SparkSession, sf: str) -> DataFrame:
    return V.semantic_quality(_obs(spark, sf))


def site_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return V.site_conflicts(_obs(spark, sf))


def filter_advice(spark: SparkSession, sf: str) -> DataFrame:
    return V.filter_advice(_obs(spark, sf))


def retention_advice(spark: SparkSession, sf: str) -> DataFrame:
    return V.retention_advice(_obs(spark, sf))


def prefix_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return G.prefix_patterns(_obs(spark, sf))


def suffix_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return G.suffix_patterns(_obs(spark, sf))


def token_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return G.token_patterns(_obs(spark, sf))


def shape_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return G.shape_patterns(_obs(spark, sf))


def discovered_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return G.discovered(_obs(spark, sf), 5)


def emerging_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return G.emerging_vendors(G.discovered(_obs(spark, sf), 5))


def name_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    obs = _obs(spark, sf)
    return G.anomalies(V.classified(obs.select("feature").distinct()), Q.feature_frequency(obs))


def value_evolution(spark: SparkSession, sf: str) -> DataFrame:
    """Header values as features, because names occur in both halves."""
    obs = O.headers(spark, sf).where("value is not null").withColumn("feature", F.concat_ws("=", "feature", "value"))
    return G.evolution(obs)


def version_families(spark: SparkSession, sf: str) -> DataFrame:
    obs = O.headers(spark, sf).where("value is not null").withColumn("feature", F.lower("value"))
    return G.version_families(obs)


_ALL = (
    header_classes, vendor_detections, vendor_rollup, vendor_concentration, technology_stack, vendor_conflicts, category_distribution, semantic_quality, site_conflicts, filter_advice,
    retention_advice, prefix_patterns, suffix_patterns, token_patterns, shape_patterns, discovered_patterns, emerging_vendors, name_anomalies, value_evolution, version_families,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def _class_sql(source: str) -> str:
    known = [h for h, *_ in K.PLATFORM_HEADERS]
    ordered = sorted(K.NAME_PATTERNS, key=lambda x: -len(x[0]))
    tests = " ".join(f"WHEN {f"starts_with(feature, '{p}') OR " if p.endswith('-') else ''}{f"contains(feature, '{p}')" if len(p) >= 3 else f"feature = '{p}'"} THEN '{v}'" for p, v in ordered)
    spec = " ".join(f"WHEN feature = '{h}' THEN {s}" for h, _, _, s in K.PLATFORM_HEADERS)
    named = " ".join(f"WHEN feature = '{h}' THEN '{p[0]}'" for h, p, _, _ in K.PLATFORM_HEADERS if p)
    return f"""nm AS (SELECT *, CASE {tests} END AS np FROM ({source})),
cl AS (SELECT * EXCLUDE (np), CASE WHEN feature IN {_in(known)} THEN 'platform' WHEN feature IN {_in(K.GENERIC_HEADERS)} THEN 'generic' WHEN feature IN {_in(K.INDICATIVE_HEADERS)} THEN 'cms-indicative' WHEN feature IN {_in(K.INFRASTRUCTURE_HEADERS)} THEN 'infrastructure' WHEN np IS NOT NULL THEN 'platform' ELSE 'custom' END AS category,
  (CASE {spec} WHEN feature IN {_in(K.GENERIC_HEADERS)} THEN 0 WHEN feature IN {_in(K.INDICATIVE_HEADERS)} THEN .6 WHEN feature IN {_in(K.INFRASTRUCTURE_HEADERS)} THEN .3 WHEN np IS NOT NULL THEN .8 ELSE .5 END)::DOUBLE AS score,
  CASE WHEN feature IN {_in(known)} THEN 'never-filter' WHEN feature IN {_in(K.GENERIC_HEADERS)} THEN 'always-filter' WHEN feature IN {_in(K.INDICATIVE_HEADERS + K.INFRASTRUCTURE_HEADERS)} THEN 'context-dependent' WHEN np IS NOT NULL THEN 'never-filter' ELSE 'context-dependent' END AS advice,
  CASE WHEN feature IN {_in(known)} THEN CASE {named} END WHEN feature NOT IN {_in(K.GENERIC_HEADERS + K.INDICATIVE_HEADERS + K.INFRASTRUCTURE_HEADERS)} THEN np END AS named_platform FROM nm)"""


_EXACT = " ".join(f"WHEN feature IN {_in(h.split())} THEN '{v}'" for v, _, h in K.VENDORS)
_INSIDE = " ".join(f"WHEN {' OR '.join(f"contains(feature, '{x}')" for x in h.split() if len(x) > 3)} THEN '{v}'" for v, _, h in K.VENDORS)
_CATEGORY = " ".join(f"WHEN vendor = '{v}' THEN '{c}'" for v, c, _ in K.VENDORS)
_DETECT = f"""{O.MAPPED_SQL}, {_SITES},
v0 AS (SELECT feature, coalesce(CASE {_EXACT} END, CASE {_INSIDE} END) AS vendor, count(DISTINCT site) AS site_count FROM obs GROUP BY feature),
v1 AS (SELECT *, CASE {_CATEGORY} END AS category, site_count / n::DOUBLE AS f FROM v0, n WHERE vendor IS NOT NULL),
v2 AS (SELECT *, CASE WHEN category IN ('cdn', 'hosting') THEN 'infrastructure' WHEN category IN ('cms', 'ecommerce', 'framework') THEN 'discriminative' ELSE 'mixed' END AS kind FROM v1),
v AS (SELECT feature, vendor, category, kind, site_count, round(f, 6) AS frequency, round(greatest(0, least(1, .7 + CASE kind WHEN 'discriminative' THEN .25 WHEN 'infrastructure' THEN -.1 ELSE 0 END + CASE WHEN f > .1 THEN .2 ELSE 0 END + CASE WHEN f > .3 THEN .1 ELSE 0 END
  - CASE WHEN f < .01 THEN .3 ELSE 0 END + CASE WHEN category IN ('cms', 'ecommerce') THEN .1 WHEN category = 'framework' THEN -.1 ELSE 0 END))::DOUBLE, 4) AS confidence FROM v2)"""


def _rolled(members: str, kind: str, least: int, full: int) -> str:
    return f"""WITH {O.MAPPED_SQL}, {_SITES}, nm AS (SELECT DISTINCT feature FROM obs), {members},
sz AS (SELECT pattern, count(*) AS members FROM mb GROUP BY 1 HAVING count(*) >= {least}), st AS (SELECT pattern, members, count(DISTINCT site) AS site_count FROM mb JOIN sz USING (pattern) JOIN obs USING (feature) GROUP BY ALL)
SELECT pattern, '{kind}' AS type, members, site_count, round(site_count / n::DOUBLE, 6) AS frequency, round(least(members / {full}.0::DOUBLE, 1), 6) AS confidence FROM st, n"""


_PREFIX = "mb AS (SELECT feature, substr(feature, 1, i + 1) AS pattern FROM (SELECT feature, unnest(range(2, least(12, length(feature) - 2) + 1)) AS i FROM nm) WHERE substr(feature, i + 1, 1) IN ('-', '_'))"
_SUFFIX = """sx AS (SELECT feature, right(feature, i) AS pattern FROM (SELECT feature, unnest(range(2, least(8, length(feature) - 1) + 1)) AS i FROM nm)), sh AS (SELECT pattern FROM sx GROUP BY 1 HAVING count(*) >= 2),
mb AS (SELECT feature, pattern FROM sx JOIN sh USING (pattern) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY length(pattern) DESC) = 1)"""
_TOKEN = r"mb AS (SELECT DISTINCT feature, pattern FROM (SELECT feature, unnest(list_concat(string_split_regex(feature, '[-_.\s]'), regexp_extract_all(feature, '[a-z]{3,}'))) AS pattern FROM nm) WHERE length(pattern) >= 3)"
_SHAPE = "mb AS (" + " UNION ALL ".join(f"SELECT feature, '{n}' AS pattern FROM nm WHERE regexp_matches(feature, '{rx}')" for n, rx in K.NAME_SHAPES) + ")"


def oracle_sql() -> dict[str, str]:
    m = O.MAPPED_SQL
    parts = [_rolled(_PREFIX, "prefix", 2, 10), _rolled(_SUFFIX, "suffix", 2, 8), _rolled(_TOKEN, "contains", 3, 15), _rolled(_SHAPE, "regex", 2, 5)]
    found = f"""SELECT *, round(frequency * confidence, 6) AS rank_value, round(CASE WHEN site_count < 5 THEN .1 ELSE (least(frequency * 2, 1) + least(site_count / 100.0, 1)) / 2 END, 6)::DOUBLE AS significance
FROM ({' UNION ALL '.join(f'({p})' for p in parts)}) WHERE frequency >= .05 AND site_count >= 5 ORDER BY rank_value DESC, type, pattern LIMIT 100"""
    hints = " ".join(f"WHEN {' OR '.join(f"contains(tk, '{h}')" for h in hs)} THEN '{v}'" for v, hs in G._INDICATORS)
    dims = " UNION ALL ".join(f"SELECT '{h}' AS feature, '{p}' AS target, {cs!r}::VARCHAR[] AS excludes, {s} AS spec" for h, ps, cs, s in K.PLATFORM_HEADERS for p in ps)
    return {
        "header_classes": f"WITH {O.HEADERS_SQL.replace('obs AS', 'hobs AS')}, {m}, {_class_sql('SELECT feature FROM hobs UNION SELECT feature FROM obs')} SELECT * FROM cl",
        "vendor_detections": f"WITH {_DETECT} SELECT * FROM v",
        "vendor_rollup": f"WITH {_DETECT} SELECT vendor, category, count(*) AS headers, max(confidence) AS confidence, round(count(*) / (SELECT count(*) FROM v)::DOUBLE, 6) AS share FROM v GROUP BY ALL",
        "vendor_concentration": f"WITH {_DETECT}, r AS (SELECT vendor, count(*) AS k FROM v GROUP BY 1), t AS (SELECT sum(k)::DOUBLE AS t FROM r) SELECT sum(k)::BIGINT AS headers, count(*) AS vendors, round(sum(pow(k / t, 2)), 6) AS hhi, round(max(round(k / t, 6)) * count(*), 4) AS over_equal FROM r, t",
        "technology_stack": f"WITH {_DETECT}, r AS (SELECT category, vendor, max(confidence) AS c FROM v GROUP BY ALL) SELECT category, string_agg(vendor, ', ' ORDER BY c DESC, vendor) AS vendors, count(*) AS n, arg_min(vendor, (-c, vendor)) AS best FROM r GROUP BY 1",
        "vendor_conflicts": f"""WITH {_DETECT}, a AS (SELECT count(*) FILTER (WHERE category = 'cms') AS c, count(*) FILTER (WHERE category = 'framework') AS w, count(*) FILTER (WHERE frequency > .9) AS u, list(DISTINCT vendor) AS vs FROM v),
b AS (SELECT *, (list_has_all(vs, ['WordPress', 'Shopify']))::INT + (list_has_all(vs, ['WordPress', 'Drupal']))::INT + (list_has_all(vs, ['Drupal', 'Shopify']))::INT AS x FROM a)
SELECT 'several platforms' AS conflict, c AS n FROM b WHERE c > 1 UNION ALL SELECT 'several frameworks', w FROM b WHERE w > 2 UNION ALL SELECT 'excluding platforms', x FROM b WHERE x > 0 UNION ALL SELECT 'ubiquitous vendors', u FROM b WHERE u > 3""",
        "category_distribution": f"""WITH {m}, ft AS (SELECT feature, count(DISTINCT site) AS n FROM obs GROUP BY 1), {_class_sql('SELECT feature, n FROM ft')}, rk AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, feature) AS r FROM cl),
s AS (SELECT category, count(DISTINCT site) AS sites FROM obs JOIN cl USING (feature) GROUP BY 1)
SELECT category, count(*) AS headers, round(avg(score), 6) AS mean_score, string_agg(feature, ', ' ORDER BY r) FILTER (WHERE r <= 5) AS top5, any_value(sites) AS sites FROM rk JOIN s USING (category) GROUP BY category""",
        "semantic_quality": f"""WITH {m}, {_class_sql('SELECT DISTINCT feature FROM obs')}, vv AS (SELECT *, coalesce(CASE {_EXACT} END, CASE {_INSIDE} END) AS vendor FROM cl)
SELECT count(*) AS headers, round(count(*) FILTER (WHERE category <> 'custom') / count(*)::DOUBLE, 6) AS categorised, round(avg(score), 6) AS mean_score, round(count(vendor) / count(*)::DOUBLE, 6) AS vendor_rate, round(count(*) FILTER (WHERE category = 'custom') / count(*)::DOUBLE, 6) AS custom_ratio FROM vv""",
        "site_conflicts": f"""WITH {m}, dim AS ({dims}), h AS (SELECT DISTINCT site, feature, target, excludes, spec FROM obs JOIN dim USING (feature)),
p AS (SELECT site, target, arg_min(excludes, feature) AS ex, max(spec) AS spec, count(*) AS n FROM h GROUP BY ALL),
x AS (SELECT a.site, greatest(a.spec, b.spec) AS s FROM p a JOIN p b ON a.site = b.site AND a.target < b.target WHERE list_contains(a.ex, b.target) OR list_contains(b.ex, a.target)),
w AS (SELECT site, count(*) AS conflicts, sum(CASE WHEN s > .9 THEN 1 WHEN s > .7 THEN .6 ELSE .3 END) AS w FROM x GROUP BY 1), q AS (SELECT site, count(*) AS platforms, arg_min(target, (-n, target)) AS dominant FROM p GROUP BY 1)
SELECT site, platforms, coalesce(conflicts, 0) AS conflicts, round(least(coalesce(w, 0) / greatest(platforms, 1), 1)::DOUBLE, 6) AS score, dominant FROM q LEFT JOIN w USING (site)""",
        "filter_advice": f"""WITH {m}, {_SITES}, ft AS (SELECT feature, count(DISTINCT site) / any_value(n)::DOUBLE AS f FROM obs, n GROUP BY 1), {_class_sql('SELECT feature, f FROM ft')},
q AS (SELECT *, greatest(0, least(1, f * CASE WHEN f < .05 THEN .7 WHEN f > .2 THEN 1.1 ELSE 1 END)) AS c FROM cl)
SELECT feature, category, round(f, 6) AS frequency, CASE WHEN (regexp_matches(feature, 'security|csp|frame|xss|policy') AND f > .3) OR f < .05 THEN 'filter' ELSE 'retain' END AS action, round(c, 6) AS confidence,
  CASE WHEN c >= .8 THEN 'very-high' WHEN c >= .6 THEN 'high' WHEN c >= .4 THEN 'medium' ELSE 'low' END AS level FROM q""",
        "retention_advice": f"""WITH {m}, {_SITES}, ft AS (SELECT feature, count(DISTINCT site) / any_value(n)::DOUBLE AS f FROM obs, n GROUP BY 1), {_class_sql('SELECT feature, f FROM ft')},
q AS (SELECT feature, list_filter([CASE WHEN coalesce(CASE {_EXACT} END, CASE {_INSIDE} END) IS NOT NULL THEN 'vendor' END, CASE WHEN category IN ('platform', 'cms-indicative') THEN 'category' END, CASE WHEN f BETWEEN .1 AND .8 THEN 'frequency' END], lambda z: z IS NOT NULL) AS r FROM cl)
SELECT feature, array_to_string(r, ', ') AS reasons, round(exp(list_sum(list_transform(r, lambda z: ln(CASE z WHEN 'vendor' THEN .8 WHEN 'category' THEN .7 ELSE .6 END))) / len(r)), 6) AS confidence FROM q WHERE len(r) > 0""",
        "prefix_patterns": parts[0],
        "suffix_patterns": parts[1],
        "token_patterns": parts[2],
        "shape_patterns": parts[3],
        "discovered_patterns": found,
        "emerging_vendors": f"""WITH f AS ({found}), t AS (SELECT *, lower(regexp_replace(pattern, '[-_*]', '', 'g')) AS tk FROM f), v AS (SELECT *, CASE {hints} WHEN length(tk) >= 3 AND tk NOT IN {_in(G._COMMON)} THEN tk END AS vendor FROM t)
SELECT vendor, count(*) AS patterns, round(avg(confidence), 6) AS confidence, max(site_count) AS most_sites FROM v WHERE vendor IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND round(avg(confidence), 6) >= .3""",
        "name_anomalies": f"""WITH {m}, {_SITES}, ft AS (SELECT feature, round(count(DISTINCT site) / any_value(n)::DOUBLE, 6) AS frequency FROM obs, n GROUP BY 1), {_class_sql('SELECT feature, frequency FROM ft')},
q AS (SELECT *, CASE WHEN contains(feature, 'cache') THEN 'infrastructure' WHEN contains(feature, 'security') OR contains(feature, 'csp') THEN 'security' WHEN contains(feature, 'wp') THEN 'cms-indicative' END AS expected FROM cl)
SELECT feature, expected, category AS actual, score AS confidence, frequency FROM q WHERE expected <> category AND frequency > .01""",
        "value_evolution": f"""WITH {O.HEADERS_SQL}, r AS (SELECT feature || '=' || value AS feature, row_number() OVER (ORDER BY captured_at, site, feature || '=' || value, value) AS pos, count(*) OVER () AS n FROM obs WHERE value IS NOT NULL AND captured_at IS NOT NULL),
g AS (SELECT feature, bool_or(pos > n // 2) AS l, bool_or(pos <= n // 2) AS e FROM r GROUP BY 1) SELECT feature, CASE WHEN l THEN 'new' ELSE 'deprecated' END AS change FROM g WHERE l <> e""",
        "version_families": rf"""WITH {O.HEADERS_SQL}, q AS (SELECT DISTINCT lower(value) AS f FROM obs WHERE value IS NOT NULL), x AS (SELECT regexp_extract(f, '^(.+?)-?v?(\d+)$', 1) AS family, regexp_extract(f, '^(.+?)-?v?(\d+)$', 2) AS v FROM q)
SELECT family, count(*) AS versions, min(v::DECIMAL(38,0))::VARCHAR AS earliest, max(v::DECIMAL(38,0))::VARCHAR AS latest FROM x WHERE family <> '' GROUP BY 1 HAVING count(*) >= 2""",
    }
