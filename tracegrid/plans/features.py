"""Queries on how often features occur and what they tell about platforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.operators import discrimination as D
from tracegrid.operators import frequency as Q
from tracegrid.sources import observations as O

Query = Callable[[SparkSession, str], DataFrame]
MIN = 5

_SITES = "sites AS (SELECT DISTINCT site, platform FROM obs), n AS (SELECT count(DISTINCT site) AS n FROM obs)"
_CELLS = f"""{_SITES}, d AS (SELECT DISTINCT site, platform, feature FROM obs),
pl AS (SELECT platform, count(*) AS np FROM sites GROUP BY platform),
t AS (SELECT sum(np)::DOUBLE AS total, count(*)::DOUBLE AS k, min(np) AS least FROM pl),
c0 AS (SELECT feature, platform, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT c0.feature, c0.platform, c0.n, x.nf, pl.np, c0.n / pl.np::DOUBLE AS f, total, k, least
  FROM c0 JOIN (SELECT feature, sum(n)::BIGINT AS nf FROM c0 GROUP BY feature HAVING sum(n) >= {MIN}) x USING (feature) JOIN pl USING (platform), t)"""


def _dense_sql(obs: str) -> str:
    return f"""WITH {obs}, {_CELLS},
full_cells AS (SELECT fs.feature, fs.nf, pl.platform, fs.total, fs.k, pl.np, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / pl.np::DOUBLE AS f
  FROM (SELECT DISTINCT feature, nf, total, k FROM c) fs CROSS JOIN pl LEFT JOIN c ON c.feature = fs.feature AND c.platform = pl.platform),
a AS (SELECT feature, nf, total, k, avg(f) AS mean, max(f) AS hi, min(f) AS lo, -sum(CASE WHEN n > 0 THEN n / nf::DOUBLE * log2(n / nf::DOUBLE) ELSE 0 END) AS h,
  arg_min(platform, (-f, platform)) AS best FROM full_cells GROUP BY ALL),
b AS (SELECT *, k >= 2 AND hi - mean <= .1 + 1e-12 AND mean - lo <= .1 + 1e-12 AS noise, CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END AS e, hi / (nf / total) AS spec FROM a)
SELECT feature, nf AS site_count, round(nf / total, 6) AS frequency, round(e, 5) + 0 AS entropy, round(spec, 5) AS max_specificity, best AS target_platform, noise AS is_noise,
  round(CASE WHEN noise THEN 0 ELSE least((1 - e) * least(spec, 1), 1) END, 5) AS discriminative_score FROM b"""


_SPARSE = f"""WITH {{obs}}, {_CELLS},
a AS (SELECT feature, nf, total, count(*) AS k, avg(f) AS mean, max(f) AS hi, min(f) AS lo, sum(f) AS s, -sum(n / nf::DOUBLE * log2(n / nf::DOUBLE)) AS h, arg_min(platform, (-f, platform)) AS best FROM c GROUP BY feature, nf, total),
b AS (SELECT *, k >= 2 AND greatest(hi - mean, mean - lo) <= .1 + 1e-12 AS noise, CASE WHEN k < 2 THEN 0 ELSE h / log2(k) END AS e, CASE WHEN k = 1 THEN hi ELSE hi / (hi + (s - hi) / (k - 1)) END AS spec FROM a)
SELECT feature, nf AS site_count, round(nf / total, 6) AS frequency, round(e, 5) + 0 AS entropy, round(spec, 5) AS max_specificity, best AS target_platform, noise AS is_noise,
  round(CASE WHEN noise THEN 0 ELSE least((1 - e) * least(spec, 1), 1) END, 5) AS discriminative_score FROM b"""


def feature_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return Q.header_frequency(O.headers(spark, sf), MIN)


def word_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return Q.feature_frequency(O.words(spark, sf), MIN)


def value_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return Q.value_frequency(O.headers(spark, sf), MIN)


def value_top_share(spark: SparkSession, sf: str) -> DataFrame:
    return Q.top_values(O.headers(spark, sf))


def page_split(spark: SparkSession, sf: str) -> DataFrame:
    return Q.page_distribution(O.headers(spark, sf))


def meta_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return Q.meta_frequency(O.metas(spark, sf), MIN)


def meta_value_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return Q.value_frequency(O.metas(spark, sf), MIN)


def occurrence_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return Q.occurrence_patterns(O.headers(spark, sf))


def summary_top10(spark: SparkSession, sf: str) -> DataFrame:
    return Q.top_features({"header": O.headers(spark, sf), "meta": O.metas(spark, sf), "word": O.words(spark, sf)})


def platform_cube(spark: SparkSession, sf: str) -> DataFrame:
    return D.cube(O.headers(spark, sf))


def discrimination_dense(spark: SparkSession, sf: str) -> DataFrame:
    return D.dense(O.words(spark, sf), MIN)


def discrimination_headers(spark: SparkSession, sf: str) -> DataFrame:
    return D.dense(O.headers(spark, sf), MIN)


def discrimination_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return D.sparse(O.words(spark, sf), MIN)


def discrimination_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.summary(D.dense(O.words(spark, sf), MIN))


def conditional_probability(spark: SparkSession, sf: str) -> DataFrame:
    return D.conditional(D.counted(O.headers(spark, sf)), MIN)


def information_gain(spark: SparkSession, sf: str) -> DataFrame:
    return D.information(D.counted(O.headers(spark, sf)), MIN)


def platform_specificity(spark: SparkSession, sf: str) -> DataFrame:
    return D.specificity(D.counted(O.words(spark, sf)), MIN)


def bias_adjustment(spark: SparkSession, sf: str) -> DataFrame:
    return D.bias_adjustment(D.counted(O.headers(spark, sf)), MIN)


def chi_square_feature(spark: SparkSession, sf: str) -> DataFrame:
    return D.chi_square(D.counted(O.words(spark, sf)), MIN)


def corpus_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return D.concentration(O.headers(spark, sf))


def platform_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return D.platform_distribution(O.headers(spark, sf))


def frequency_interval(spark: SparkSession, sf: str) -> DataFrame:
    return D.frequency_interval(O.headers(spark, sf), MIN)


_ALL = (
    feature_frequency, word_frequency, value_frequency, value_top_share, page_split, meta_frequency, meta_value_frequency, occurrence_patterns, summary_top10, platform_cube,
    discrimination_dense, discrimination_headers, discrimination_sparse, discrimination_summary, conditional_probability, information_gain, platform_specificity, bias_adjustment,
    chi_square_feature, corpus_concentration, platform_distribution, frequency_interval,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in names)


def oracle_sql() -> dict[str, str]:
    h, m, w = O.HEADERS_SQL, O.METAS_SQL, O.WORDS_SQL
    values = f"SELECT feature, value, count(DISTINCT site) AS site_count, CASE WHEN length(value) > 100 THEN substr(value, 1, 97) || '...' ELSE value END AS example FROM obs WHERE value IS NOT NULL GROUP BY feature, value HAVING count(DISTINCT site) >= {MIN}"
    dense = _dense_sql(w)
    return {
        "feature_frequency": f"""WITH {h}, {_SITES} SELECT feature, site_count, round(site_count / n::DOUBLE, 6) AS frequency, feature IN ({_quoted(Q.SECURITY)}) AS is_security,
  starts_with(feature, 'x-') AND feature NOT IN ({_quoted(Q.SECURITY)}) AS is_custom FROM (SELECT feature, count(DISTINCT site) AS site_count FROM obs GROUP BY 1) , n WHERE site_count >= {MIN}""",
        "word_frequency": f"WITH {w}, {_SITES} SELECT feature, site_count, round(site_count / n::DOUBLE, 6) AS frequency FROM (SELECT feature, count(DISTINCT site) AS site_count FROM obs GROUP BY 1), n WHERE site_count >= {MIN}",
        "value_frequency": f"WITH {h} {values}",
        "meta_value_frequency": f"WITH {m} {values}",
        "value_top_share": f"""WITH {h}, v AS (SELECT feature, value, count(DISTINCT site) AS k FROM obs WHERE value IS NOT NULL GROUP BY ALL), s AS (SELECT feature, count(DISTINCT site) AS n FROM obs GROUP BY 1)
SELECT feature, value AS top_value, k AS top_sites, round(k / n::DOUBLE, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY k DESC, value) AS r FROM v) JOIN s USING (feature) WHERE r = 1""",
        "page_split": f"""WITH {h}, a AS (SELECT feature, count(DISTINCT site) FILTER (WHERE page_kind = 'mainpage') AS m, count(DISTINCT site) FILTER (WHERE page_kind = 'robots') AS r FROM obs GROUP BY 1)
SELECT feature, round(CASE WHEN m + r = 0 THEN 1 ELSE m / (m + r)::DOUBLE END, 6) AS main_share, round(CASE WHEN m + r = 0 THEN 0 ELSE r / (m + r)::DOUBLE END, 6) AS robots_share FROM a""",
        "meta_frequency": f"""WITH {m}, {_SITES}, a AS (SELECT feature, count(DISTINCT site) AS site_count FROM obs WHERE regexp_replace(feature, '^(?:name|property|http-equiv):', '') NOT IN ({_quoted(Q.SKIPPED_TAGS)}) GROUP BY 1)
SELECT feature, site_count, round(site_count / n::DOUBLE, 6) AS frequency, CASE WHEN starts_with(feature, 'property:') THEN 'property' WHEN starts_with(feature, 'http-equiv:') THEN 'http-equiv' ELSE 'name' END AS kind,
  contains(feature, 'og:') AS is_og, contains(feature, 'twitter:') AS is_twitter FROM a, n WHERE site_count >= {MIN}""",
        "occurrence_patterns": f"""WITH {h}, {_SITES}, a AS (SELECT feature, value, count(*) AS occurrences, count(DISTINCT platform) AS platforms FROM obs WHERE value IS NOT NULL GROUP BY ALL)
SELECT feature, value, occurrences, platforms, round(occurrences / n::DOUBLE, 6) AS frequency,
  round(greatest(.1, least(1, (1 - occurrences / n::DOUBLE) * CASE WHEN platforms > 5 THEN .5 WHEN platforms = 1 THEN 1.2 ELSE 1 END)), 6) AS confidence FROM a, n""",
        "summary_top10": f"""SELECT * FROM (WITH {h} SELECT 'header' AS dim, row_number() OVER (ORDER BY count(DISTINCT site) DESC, feature) AS rank, feature, count(DISTINCT site) AS site_count FROM obs GROUP BY feature QUALIFY rank <= 10)
UNION ALL SELECT * FROM (WITH {m} SELECT 'meta' AS dim, row_number() OVER (ORDER BY count(DISTINCT site) DESC, feature) AS rank, feature, count(DISTINCT site) AS site_count FROM obs GROUP BY feature QUALIFY rank <= 10)
UNION ALL SELECT * FROM (WITH {w} SELECT 'word' AS dim, row_number() OVER (ORDER BY count(DISTINCT site) DESC, feature) AS rank, feature, count(DISTINCT site) AS site_count FROM obs GROUP BY feature QUALIFY rank <= 10)""",
        "platform_cube": f"""WITH {h}, {_SITES}, d AS (SELECT DISTINCT site, platform, feature FROM obs)
SELECT feature, platform, 'cell' AS level, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT feature, NULL, 'feature', count(*) FROM d GROUP BY ALL UNION ALL SELECT NULL, platform, 'platform', count(*) FROM sites GROUP BY ALL""",
        "discrimination_dense": dense,
        "discrimination_headers": _dense_sql(h),
        "discrimination_sparse": _SPARSE.format(obs=w),
        "discrimination_summary": f"""SELECT count(*) AS patterns, count(*) FILTER (WHERE discriminative_score > .3) AS discriminatory, count(*) FILTER (WHERE is_noise) AS noise, count(*) FILTER (WHERE max_specificity > .7) AS specific,
  round(avg(discriminative_score), 3) AS mean_score, round(count(*) FILTER (WHERE is_noise) * 100 / count(*)::DOUBLE, 2) AS noise_pct, round(avg(discriminative_score) * .5, 4) AS boost FROM ({dense})""",
        "conditional_probability": f"""WITH {h}, {_CELLS} SELECT feature, platform, n, round(n / nf::DOUBLE, 6) AS p_platform, round(f, 6) AS p_feature, round(n / nf::DOUBLE / (np / total), 5) AS lift, round(nf * (np / total), 5) AS expected,
  round(CASE WHEN n = 0 THEN 0 ELSE (f + 3.8416 / (2 * np) - 1.96 * sqrt((f * (1 - f) + 3.8416 / (4 * np)) / np) / (1 + 3.8416 / np)) / (1 + 3.8416 / np) END, 6) AS lower_bound,
  np >= 5 AND n > 0 AND np * (nf / total) >= 5 AND pow(n - np * (nf / total), 2) / (np * (nf / total)) > 3.84 AS significant FROM c""",
        "information_gain": f"""WITH {h}, {_CELLS}, g AS (SELECT -sum(np / total * log2(np / total)) AS h FROM pl, t),
a AS (SELECT feature, k, max(n / nf::DOUBLE) AS m, sum(n / nf::DOUBLE) AS s, sum(-pow(n / nf::DOUBLE, 2) * log2(n / nf::DOUBLE)) AS w FROM c GROUP BY ALL)
SELECT feature, round(greatest(0, h - w / s), 5) AS information_gain, round(CASE WHEN k > 1 AND (s - m) / (k - 1) > 1e-12 THEN m / ((s - m) / (k - 1)) ELSE m END, 4) AS power FROM a, g""",
        "platform_specificity": f"""WITH {w}, {_CELLS}, x AS (SELECT fs.feature, fs.nf, fs.total, fs.k, pl.platform, coalesce(c.f, 0) AS f, coalesce(c.n, 0) / fs.nf::DOUBLE AS p FROM (SELECT DISTINCT feature, nf, total, k FROM c) fs CROSS JOIN pl LEFT JOIN c ON c.feature = fs.feature AND c.platform = pl.platform),
a AS (SELECT feature, nf, total, coalesce(max(p) FILTER (WHERE platform NOT IN ('unknown', 'enterprise', 'cdn')), 0) AS top, arg_min(f, (-p, platform)) FILTER (WHERE platform NOT IN ('unknown', 'enterprise', 'cdn')) AS ftop, stddev_pop(f) AS sd, avg(f) AS mean FROM x GROUP BY ALL)
SELECT feature, round(CASE WHEN total >= 30 THEN CASE WHEN top >= .4 THEN .5 * least(1, 2 * top) + .3 * least(1, log10(nf) / 2) + .2 * least(1, least(2, ftop / greatest(nf / total, .001)) / 2) ELSE 0 END ELSE least(1, sd / mean) END, 5) AS specificity,
  CASE WHEN total >= 30 THEN 'concentration' ELSE 'variation' END AS method FROM a""",
        "bias_adjustment": f"""WITH {h}, {_CELLS}, mj AS (SELECT platform, platform <> 'unknown' AND np / total > .05 AS major FROM pl, t), q AS (SELECT count(*) FILTER (WHERE major) AS q FROM mj),
a AS (SELECT feature, sum(f) / any_value(k) AS raw, CASE WHEN any_value(q) = 0 THEN 0 ELSE coalesce(sum(f) FILTER (WHERE major), 0) / any_value(q) END AS adjusted FROM c JOIN mj USING (platform), q GROUP BY feature)
SELECT feature, round(raw, 6) AS raw, round(adjusted, 6) AS adjusted, round(adjusted / raw, 5) AS factor, CASE WHEN abs(adjusted / raw - 1) <= .1 THEN 'minimal' WHEN abs(adjusted / raw - 1) <= .3 THEN 'moderate' ELSE 'significant' END AS impact FROM a""",
        "chi_square_feature": f"""WITH {w}, {_CELLS}, x AS (SELECT fs.feature, fs.nf, fs.total, fs.k, fs.least, coalesce(c.n, 0) AS o, fs.nf / fs.total * pl.np AS e FROM (SELECT DISTINCT feature, nf, total, k, least FROM c) fs CROSS JOIN pl LEFT JOIN c ON c.feature = fs.feature AND c.platform = pl.platform),
a AS (SELECT feature, nf, k - 1 AS df, sum(pow(o - e, 2) / e) AS s, min(e) >= 5 AND nf >= 10 AS valid FROM x GROUP BY feature, nf, k)
SELECT feature, round(CASE WHEN valid THEN s ELSE 0 END, 4) AS statistic, CASE WHEN NOT valid OR s <= 0 OR df <= 0 THEN 1 WHEN df = 1 THEN CASE WHEN s >= 3.84 THEN .05 ELSE .1 END WHEN df = 2 THEN CASE WHEN s >= 5.99 THEN .05 ELSE .1 END
  WHEN s >= 6.64 + (df - 1) * 2.5 THEN .01 WHEN s >= 3.84 + (df - 1) * 2 THEN .05 ELSE .1 END::DOUBLE AS p_value, valid FROM a""",
        "corpus_concentration": f"""WITH {h}, {_SITES}, pl AS (SELECT platform, count(*) AS np FROM sites GROUP BY 1), p AS (SELECT np, np / (SELECT sum(np) FROM pl)::DOUBLE AS p, row_number() OVER (ORDER BY np DESC) AS r FROM pl),
a AS (SELECT sum(np)::BIGINT AS sites, count(*) AS platforms, sum(p * p) AS hhi, -sum(p * ln(p)) AS h, max(np) FILTER (WHERE r = 1) AS a, max(np) FILTER (WHERE r = 2) AS b FROM p)
SELECT sites, platforms, round(hhi, 6) AS hhi, round(h, 6) AS shannon, round(exp(h), 4) AS effective_number, round(CASE WHEN b IS NULL THEN 1 ELSE a / b::DOUBLE END, 5) AS dominance,
  CASE WHEN hhi > .6 OR h < 1 THEN 'high' WHEN hhi > .3 OR h < 2 THEN 'medium' ELSE 'low' END AS risk, round((least(1, h / 3) + 1 - hhi + least(1, log10(sites) / 3)) / 3, 6) AS quality FROM a""",
        "platform_distribution": f"WITH {h}, {_SITES} SELECT platform, count(*) AS sites, round(count(*) * 100 / (SELECT count(*) FROM sites)::DOUBLE, 6) AS pct FROM sites GROUP BY 1",
        "frequency_interval": f"""WITH {h}, {_SITES}, a AS (SELECT feature, count(DISTINCT site) / any_value(n)::DOUBLE AS p, any_value(n) AS n FROM obs, n GROUP BY 1 HAVING count(DISTINCT site) >= {MIN})
SELECT feature, round(greatest(0, least(1, p - 1.96 * sqrt(p * (1 - p) / n))), 6) AS low, round(greatest(0, least(1, p + 1.96 * sqrt(p * (1 - p) / n))), 6) AS high FROM a WHERE p > 0 AND p < 1""",
    }
