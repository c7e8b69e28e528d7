"""Queries on sample sizes, consistency, shares, names, vendor signatures and strengths of platform signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K
from tracegrid.operators import bias as B
from tracegrid.operators import cooccurrence as C
from tracegrid.operators import discovery as G
from tracegrid.operators import filters as X
from tracegrid.operators import frequency as Q
from tracegrid.operators import vendors as V
from tracegrid.plans import names as N
from tracegrid.plans import validation as A
from tracegrid.plans.features import _CELLS, _SITES, MIN
from tracegrid.plans.names import _class_sql, _in
from tracegrid.sources import observations as O
from tracegrid.session import table

Query = Callable[[SparkSession, str], DataFrame]


def statistical_summary(spark: SparkSession, sf: str) -> DataFrame:
    return B.statistical_summary(O.headers(spark, sf), MIN)


def sample_adequacy(spark: SparkSession, sf: str) -> DataFrame:
    return B.sample_adequacy(O.words(spark, sf), MIN)


def consistency_checks(spark: SparkSession, sf: str) -> DataFrame:
    return B.consistency(O.headers(spark, sf), MIN)


def feature_shares(spark: SparkSession, sf: str) -> DataFrame:
    return B.feature_shares(O.headers(spark, sf), MIN)


def prefix_shares(spark: SparkSession, sf: str) -> DataFrame:
    obs = O.headers(spark, sf)
    return B.prefix_shares(obs, G._prefix_members(G._names(obs)).select("pattern", "feature"))


def naming_conventions(spark: SparkSession, sf: str) -> DataFrame:
    """How header names are written and built, by number of distinct names."""
    names = table(spark, sf, "header_values").where("header_name is not null and header_name <> ''").select("header_name").distinct()
    return names.groupBy(B.naming_convention(F.col("header_name")).alias("convention"), B.name_structure(F.col("header_name")).alias("structure")).agg(F.count(F.lit(1)).alias("names"))


def header_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Headers, sites and pairs of sites and headers by the category that names hint at."""
    obs = O.headers(spark, sf).select("site", "feature").distinct()
    return obs.groupBy(B.name_category(F.col("feature")).alias("category")).agg(F.count_distinct("feature").alias("headers"), F.count_distinct("site").alias("sites"), F.count(F.lit(1)).alias("pairs"))


def top_pattern_test(spark: SparkSession, sf: str) -> DataFrame:
    return B.top_pattern_test(O.headers(spark, sf))


def context_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Which headers are filtered by class, and by rarity where the class leaves it open."""
    freq = Q.feature_frequency(O.headers(spark, sf))
    return X.context_filter(V.classified(freq.select("feature", "frequency")), F.col("frequency"))


def vendor_signatures(spark: SparkSession, sf: str) -> DataFrame:
    obs = O.mapped_headers(spark, sf)
    return B.vendor_signatures(obs, C.signature_sites(obs, K.VENDOR_SIGNATURES))


def vendor_consistency(spark: SparkSession, sf: str) -> DataFrame:
    obs = O.mapped_headers(spark, sf)
    return B.vendor_consistency(V.detections(obs), V.classified(obs.select("feature").distinct()))


def signature_strength(spark: SparkSession, sf: str) -> DataFrame:
    return B.signature_strength(A.dimension_support(spark, sf))


def platforms_with_header(spark: SparkSession, sf: str) -> DataFrame:
    """Which platforms send one header, and on how many sites with how many values."""
    obs = O.headers(spark, sf).where("feature = 'server'")
    return obs.groupBy("platform").agg(F.count_distinct("site").alias("sites"), F.count_distinct("value").alias("values"), F.count(F.lit(1)).alias("observations"))


def robots_features(spark: SparkSession, sf: str) -> DataFrame:
    """Header frequency over robots pages alone."""
    return Q.feature_frequency(O.headers(spark, sf).where("page_kind = 'robots'"), MIN)


def table_test(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the kind of page depends on the platform: a table of any size."""
    obs = O.headers(spark, sf).where("page_kind is not null")
    return B.table_test(obs.groupBy("platform", "page_kind").agg(F.count(F.lit(1)).alias("n")), "platform", "page_kind", "n")


def category_bias(spark: SparkSession, sf: str) -> DataFrame:
    return B.category_bias(V.category_distribution(O.headers(spark, sf)))


def classification_insights(spark: SparkSession, sf: str) -> DataFrame:
    c = V.classified(O.headers(spark, sf).select("feature").distinct())
    return B.classification_insights(c, V.vendor_of(F.col("feature")))


def meta_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Meta values by rows, with the older confidence."""
    return Q.occurrence_patterns(O.metas(spark, sf))


def frequent_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of headers on a tenth of the sites and more, and whether one never comes without the other."""
    p = C.pairs(O.headers(spark, sf), MIN).where("freq_pct >= 10")
    return p.select("f1", "f2", "n", "freq_pct", (F.col("n") == F.least("n1", "n2")).alias("inseparable"))


_ALL = (
    table_test, category_bias, classification_insights, meta_occurrences, frequent_combinations, statistical_summary, sample_adequacy, consistency_checks, feature_shares, prefix_shares, naming_conventions, header_categories, top_pattern_test, context_filter, vendor_signatures, vendor_consistency, signature_strength,
    platforms_with_header, robots_features,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


_PER = """pf AS (SELECT feature, nf, sum(pow(n - nf / total * np, 2) / (nf / total * np)) + nf - sum(nf / total * np) AS x, any_value(nf / total * least) AS le, CASE WHEN count(*) < any_value(k) THEN 0 ELSE min(n) END AS mn, any_value(k) AS k FROM c GROUP BY feature, nf)"""


def oracle_sql() -> dict[str, str]:
    h, w, m = O.HEADERS_SQL, O.WORDS_SQL, O.MAPPED_SQL
    fits = " OR ".join(f"(v.category = '{c}' AND cl.category IN {_in(n)})" for c, n in K.FITTING_CATEGORIES.items())
    sigs = []
    for (n, req, con), opt in zip(K.VENDOR_SIGNATURES, K.VENDOR_OPTIONAL):
        excl = f" AND NOT list_has_any(fs, {con!r})" if con else ""
        many = len(req) + len(opt)
        sigs.append(f"SELECT '{n}' AS signature, site, len(list_intersect(fs, {opt!r})) AS hits, {len(opt)} AS width, {many} AS many FROM s WHERE list_has_all(fs, {req!r}){excl}")
    names = A.oracle_sql()
    pairs = [(a.lower(), b.lower()) for a, b in K.EXCLUSIVE_PLATFORMS]
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs + [(b, a) for a, b in pairs])
    return {
        "table_test": f"""WITH {h}, c AS (SELECT platform AS a, page_kind AS b, count(*)::DOUBLE AS o FROM obs WHERE page_kind IS NOT NULL GROUP BY ALL), r AS (SELECT a, sum(o) AS rt FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS kt FROM c GROUP BY 1), t AS (SELECT sum(o) AS t, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nk FROM c),
f AS (SELECT coalesce(o, 0) AS o, rt * kt / t AS e, nr, nk FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b)), x AS (SELECT any_value(nr) AS nr, any_value(nk) AS nk, sum(pow(CASE WHEN nr = 2 AND nk = 2 THEN greatest(0, abs(o - e) - .5) ELSE abs(o - e) END, 2) / e) AS x, min(e) AS le FROM f),
y AS (SELECT *, (nr - 1) * (nk - 1) AS df, CASE (nr - 1) * (nk - 1) WHEN 2 THEN 5.991 WHEN 3 THEN 7.815 WHEN 4 THEN 9.488 ELSE 3.841 END::DOUBLE AS cv FROM x)
SELECT nr AS rows, nk AS columns, round(x, 4) AS statistic, df, cv AS critical, CASE WHEN df = 1 THEN CASE WHEN x >= 10.828 THEN .001 WHEN x >= 6.635 THEN .01 WHEN x >= 3.841 THEN .05 WHEN x >= 2.706 THEN .1 ELSE .2 END WHEN x > cv THEN .04 ELSE .1 END::DOUBLE AS p_value, le < 5 AS low_expected FROM y""",
        "category_bias": f"""WITH {h}, {_class_sql('SELECT DISTINCT feature FROM obs')}, q AS (SELECT category, count(*) AS n FROM cl GROUP BY 1), t AS (SELECT sum(n) / count(*)::DOUBLE AS e FROM q)
SELECT category, floor(e + .5)::BIGINT AS expected, n AS actual, round(n / e, 6) AS ratio, CASE WHEN n / e > 2 OR n / e < .5 THEN 'high' WHEN n / e > 1.5 OR n / e < .67 THEN 'medium' ELSE 'low' END AS level, CASE WHEN n / e > 1.8 THEN 'over' WHEN n / e < .6 THEN 'under' ELSE 'even' END AS imbalance FROM q, t""",
        "classification_insights": f"""WITH {h}, {_class_sql('SELECT DISTINCT feature FROM obs')} SELECT count(*) AS headers, count(*) FILTER (WHERE category <> 'custom') AS categorised, (SELECT category FROM cl GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 1) AS most_common, count(*) FILTER (WHERE score > .8) AS sure,
  count(*) FILTER (WHERE coalesce(CASE {N._EXACT} END, CASE {N._INSIDE} END, named_platform) IS NOT NULL) AS of_vendors, count(*) FILTER (WHERE category = 'custom') AS custom, count(*) FILTER (WHERE category = 'security' OR regexp_matches(feature, 'security|csp|cors')) AS security FROM cl""",
        "meta_occurrences": f"""WITH {O.METAS_SQL}, {_SITES}, a AS (SELECT feature, value, count(*) AS occurrences, count(DISTINCT platform) AS platforms FROM obs WHERE value IS NOT NULL GROUP BY ALL)
SELECT feature, value, occurrences, platforms, round(occurrences / n::DOUBLE, 6) AS frequency, round(greatest(.1, least(1, (1 - occurrences / n::DOUBLE) * CASE WHEN platforms > 5 THEN .5 WHEN platforms = 1 THEN 1.2 ELSE 1 END))::DOUBLE, 6) AS confidence FROM a, n""",
        "frequent_combinations": f"""WITH {h}, {_SITES}, d AS (SELECT DISTINCT site, feature FROM obs), f AS (SELECT feature, count(*) AS k FROM d GROUP BY 1 HAVING count(*) >= {MIN}), p AS (SELECT a.feature AS f1, b.feature AS f2, count(*) AS c FROM d a JOIN d b ON a.site = b.site AND a.feature < b.feature GROUP BY ALL)
SELECT f1, f2, c AS n, round(c * 100 / n::DOUBLE, 6) AS freq_pct, c = least(x.k, y.k) AS inseparable FROM p JOIN f x ON x.feature = f1 JOIN f y ON y.feature = f2, n WHERE c >= {MIN} AND round(c * 100 / n::DOUBLE, 6) >= 10""",
        "sample_adequacy": f"WITH {w}, {_CELLS}, {_PER} SELECT feature, nf AS sites, mn AS least, CASE WHEN nf >= 30 AND mn >= 5 THEN 'adequate' WHEN nf >= 15 AND mn >= 3 THEN 'marginal' ELSE 'inadequate' END AS label FROM pf",
        "consistency_checks": f"WITH {h}, {_CELLS}, q AS (SELECT count(*) AS m FROM (SELECT feature FROM obs GROUP BY 1 HAVING count(DISTINCT site) >= {MIN})) SELECT unnest(['feature counts', 'site totals', 'frequencies']) AS \"check\", unnest([m, 1, m]) AS compared, unnest([0, 0, 0])::BIGINT AS issues FROM q",
        "feature_shares": f"WITH {h}, {_CELLS} SELECT feature, platform, n AS sites, round(nf / total, 6) AS frequency, round(n / nf::DOUBLE, 6) AS share FROM c",
        "prefix_shares": f"""WITH {h}, {_CELLS}, nm AS (SELECT DISTINCT feature FROM obs), {N._PREFIX}, sz AS (SELECT pattern, count(*) AS m FROM mb GROUP BY 1 HAVING count(*) >= 2), fn AS (SELECT feature, sum(n) AS nf FROM c0 GROUP BY 1)
SELECT pattern, platform, round(sum(n / nf::DOUBLE) / m, 6) AS share FROM mb JOIN sz USING (pattern) JOIN c0 USING (feature) JOIN fn USING (feature) GROUP BY pattern, m, platform""",
        "naming_conventions": r"""WITH q AS (SELECT DISTINCT header_name AS n FROM header_values WHERE header_name <> '')
SELECT CASE WHEN regexp_full_match(n, '[a-z]+(-[a-z]+)*') THEN 'kebab-case' WHEN regexp_full_match(n, '[a-zA-Z]+([A-Z][a-z]*)*') THEN 'camelCase' WHEN regexp_full_match(n, '[a-z]+(_[a-z]+)*') THEN 'underscore_case' WHEN regexp_full_match(n, '[A-Z]+(_[A-Z]+)*') THEN 'UPPER_CASE' ELSE 'mixed' END AS convention,
  CASE len(string_split_regex(n, '[-_]')) WHEN 3 THEN 'vendor-service-action' WHEN 2 THEN 'vendor-purpose' ELSE 'simple' END AS structure, count(*) AS names FROM q GROUP BY ALL""",
        "header_categories": f"""WITH {h}, d AS (SELECT DISTINCT site, feature FROM obs)
SELECT CASE WHEN regexp_matches(feature, 'csp|security|cors|frame|hsts') THEN 'security' WHEN regexp_matches(feature, 'cache|etag|vary|expires|modified') THEN 'caching' WHEN regexp_matches(feature, 'content|type|encoding|language|length|request|id|trace|correlation|session|timing|performance|speed') THEN 'infrastructure' ELSE 'custom' END AS category,
  count(DISTINCT feature) AS headers, count(DISTINCT site) AS sites, count(*) AS pairs FROM d GROUP BY 1""",
        "top_pattern_test": f"""WITH {h}, {_SITES}, d AS (SELECT DISTINCT site, platform, feature FROM obs), tp AS (SELECT feature FROM d GROUP BY 1 ORDER BY count(*) DESC, feature LIMIT 1), p2 AS (SELECT platform, row_number() OVER (ORDER BY count(*) DESC, platform) AS r FROM d GROUP BY 1 QUALIFY r <= 2),
x AS (SELECT (SELECT feature FROM tp) AS feature, count(*) FILTER (WHERE r = 1 AND ok) AS a, count(*) FILTER (WHERE r = 2 AND ok) AS b, count(*) FILTER (WHERE r = 1 AND NOT ok) AS c, count(*) FILTER (WHERE r = 2 AND NOT ok) AS d FROM (SELECT r, sites.site IN (SELECT site FROM d JOIN tp USING (feature)) AS ok FROM sites JOIN p2 USING (platform))),
y AS (SELECT *, (a + b + c + d)::DOUBLE AS t FROM x), z AS (SELECT *, (SELECT sum(pow(greatest(0, abs(o - e) - .5), 2) / e) FROM (SELECT unnest([a, b, c, d]) AS o, unnest([(a + b) * (a + c) / t, (a + b) * (b + d) / t, (c + d) * (a + c) / t, (c + d) * (b + d) / t]) AS e)) AS v FROM y)
SELECT feature, (SELECT platform FROM p2 WHERE r = 1) AS first_platform, (SELECT platform FROM p2 WHERE r = 2) AS second_platform, round(v, 4) AS chi_square, CASE WHEN v >= 10.828 THEN .001 WHEN v >= 6.635 THEN .01 WHEN v >= 3.841 THEN .05 WHEN v >= 2.706 THEN .1 ELSE .2 END::DOUBLE AS p_value FROM z""",
        "context_filter": f"""WITH {h}, {_SITES}, ft AS (SELECT feature, round(count(DISTINCT site) / any_value(n)::DOUBLE, 6) AS frequency FROM obs, n GROUP BY 1), {_class_sql('SELECT feature, frequency FROM ft')}
SELECT feature, advice, frequency, CASE advice WHEN 'always-filter' THEN true WHEN 'never-filter' THEN false ELSE frequency < .02 END AS filtered FROM cl""",
        "vendor_signatures": f"""WITH {m}, {_SITES}, s AS (SELECT site, list(DISTINCT feature) AS fs FROM obs GROUP BY 1), q AS ({' UNION ALL '.join(sigs)}), g AS (SELECT signature, count(*) AS sites, sum(hits) AS hits, any_value(width) AS width, any_value(many) AS many FROM q GROUP BY 1)
SELECT signature, sites, round(greatest(0, least(1, .6 + CASE WHEN sites / n::DOUBLE BETWEEN .05 AND .5 THEN .2 WHEN sites / n::DOUBLE > .01 THEN .1 ELSE 0 END + CASE WHEN many >= 3 THEN .1 ELSE 0 END + CASE WHEN many >= 4 THEN .05 ELSE 0 END + .1 * hits / (width * sites)))::DOUBLE, 6) AS confidence FROM g, n""",
        "vendor_consistency": f"""WITH {N._DETECT}, {_class_sql('SELECT DISTINCT feature FROM obs')}, q AS (SELECT count(*) FILTER (WHERE {fits}) AS a, count(*) FILTER (WHERE NOT ({fits})) AS b FROM v JOIN cl ON v.feature = cl.feature)
SELECT a AS consistent, b AS inconsistent, round(a / (a + b)::DOUBLE, 6) AS ratio, a / (a + b)::DOUBLE > .8 AS overall FROM q""",
        "signature_strength": f"""WITH u AS ({names['dimension_support']}), p AS (SELECT platform, sum(support) AS s, sum(support * support) AS q, count(*) FILTER (WHERE support > .3) AS o, count(*) AS act, sum(patterns)::DOUBLE AS m, sum(patterns * patterns)::DOUBLE AS mm FROM u GROUP BY 1),
r AS (SELECT platform, s / 3 AS mean, s, 1 - sqrt(greatest(0, q / 3 - pow(s / 3, 2))) AS st, o IN (0, 3) AS ag, act, CASE WHEN act = 1 THEN .3 ELSE greatest(0, 1 - least(1, (mm / 3 - pow(m / 3, 2)) / (m * m / 3))) * act / 3 END AS dv FROM p),
ex AS (SELECT * FROM (VALUES {values}) AS t(platform, other)), fi AS (SELECT r.platform, least(.6, sum(CASE WHEN least(r.st, y.st) > .7 THEN .4 WHEN least(r.st, y.st) > .5 THEN .25 WHEN least(r.st, y.st) > .3 THEN .15 ELSE 0 END)) AS f FROM r JOIN ex USING (platform) JOIN r AS y ON y.platform = ex.other GROUP BY 1),
z AS (SELECT r.*, least(.4, CASE WHEN ag THEN .15 ELSE 0 END + CASE WHEN st > .8 THEN .1 ELSE 0 END + (greatest(act, 1) - 1) * .05 + dv * .1) AS b, coalesce(f, 0) AS f FROM r LEFT JOIN fi USING (platform))
SELECT platform, round(b::DOUBLE, 6) AS boost, round(f::DOUBLE, 6) AS penalty, round(dv::DOUBLE, 6) AS diversity, round(greatest(0, least(1, mean * (1 + b) - f))::DOUBLE, 6) AS score, s >= .3 AS counts FROM z""",
        "platforms_with_header": f"WITH {h} SELECT platform, count(DISTINCT site) AS sites, count(DISTINCT value) AS values, count(*) AS observations FROM obs WHERE feature = 'server' GROUP BY 1",
        "robots_features": f"WITH {h}, o2 AS (SELECT * FROM obs WHERE page_kind = 'robots'), t AS (SELECT count(DISTINCT site) AS n FROM o2) SELECT feature, count(DISTINCT site) AS site_count, round(count(DISTINCT site) / any_value(n)::DOUBLE, 6) AS frequency FROM o2, t GROUP BY 1 HAVING count(DISTINCT site) >= {MIN}",
        "statistical_summary": f"""WITH {h}, {_CELLS}, {_PER}, hh AS (SELECT sum(pow(np / total, 2)) AS hhi FROM pl, t)
SELECT count(*) AS features, count(*) FILTER (WHERE le >= 5) AS adequate, count(*) FILTER (WHERE le < 5 AND le >= 2) AS marginal, count(*) FILTER (WHERE le < 2) AS inadequate, round(avg(x), 4) AS mean_chi_square, count(*) FILTER (WHERE k - 1 >= 3 AND x >= 6.64 + (k - 2) * 2.5) AS significant, any_value(round(hhi, 6)) AS bias_risk, any_value(round(1 - round(hhi, 6), 6)) AS reliability FROM pf, hh""",
    }
