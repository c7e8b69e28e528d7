"""Queries on validation, bias and platform signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.operators import discrimination as D
from tracegrid.operators import validate as V
from tracegrid.plans.features import _CELLS, _SITES, MIN
from tracegrid.plans import features as A
from tracegrid.sources import observations as O

Query = Callable[[SparkSession, str], DataFrame]


def validation_stages(spark: SparkSession, sf: str) -> DataFrame:
    return V.stages(O.words(spark, sf), MIN)


def validation_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return V.verdict(V.stages(O.words(spark, sf), MIN, 12))


def platform_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return V.platform_metrics(O.headers(spark, sf), MIN)


def overall_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return V.overall_metrics(O.headers(spark, sf), MIN)


def recommendation_risk(spark: SparkSession, sf: str) -> DataFrame:
    return V.risk(O.headers(spark, sf), MIN)


def bias_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return V.warnings(O.headers(spark, sf))


def sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return V.sensitivity(O.words(spark, sf), MIN)


def dimension_support(spark: SparkSession, sf: str) -> DataFrame:
    m = O.mapped_headers(spark, sf)
    third = lambda k: D.dense(D.counted(m.where(F.length("feature") % 3 == k)), MIN).withColumn("discriminative_score", F.greatest("discriminative_score", "entropy"))
    return V.dimension_support({"header": third(0), "meta": third(1), "script": third(2)})


def platform_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return V.platform_signatures(dimension_support(spark, sf))


_ALL = (validation_stages, validation_verdict, platform_metrics, overall_metrics, recommendation_risk, bias_warnings, sensitivity, dimension_support, platform_signatures)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    h, w = O.HEADERS_SQL, O.WORDS_SQL
    support = []
    for k, dim in enumerate(("header", "meta", "script")):
        dense = A._dense_sql(O.MAPPED_SQL.replace("obs AS (", "ob0 AS (") + f", obs AS (SELECT * FROM ob0 WHERE length(feature) % 3 = {k})")
        for p in V.SUPPORTED:
            support.append(
                f"SELECT '{p}' AS platform, '{dim}' AS dim, greatest(discriminative_score, entropy) AS d, CASE WHEN regexp_matches(feature, '{V._TELLING[p]}') THEN .95 WHEN regexp_matches(feature, '{V._NAMING[p]}') THEN .7 ELSE .1 END AS s, frequency AS f FROM ({dense}) WHERE regexp_matches(feature, '{V._RELEVANT[p]}')"
            )
    sup = f"SELECT platform, dim, round(avg(d * s * f), 6) AS support, count(*) AS patterns FROM ({' UNION ALL '.join(f'({x})' for x in support)}) WHERE d > .3 AND s > .3 GROUP BY ALL"
    freq = f"f0 AS (SELECT feature, count(DISTINCT site) AS k, round(count(DISTINCT site) / any_value(n)::DOUBLE, 6) AS f FROM obs, n GROUP BY 1), f AS (SELECT * FROM f0 WHERE k >= {MIN})"
    stages = f"""WITH {w}, {_CELLS}, {freq},
s1 AS (SELECT count(*) FILTER (WHERE k < {MIN}) / count(*)::DOUBLE AS r, count(*) FILTER (WHERE k >= {MIN} AND ((f < .01 AND k < 5) OR f > .95)) AS w FROM f0),
s3 AS (SELECT avg(f) AS mu, stddev_pop(f) AS sd, round(max(f) - min(f), 6) AS cov FROM f), s3b AS (SELECT round(avg(pow(f - mu, 3)) / pow(any_value(sd), 3), 4) AS sk, count(*) FILTER (WHERE abs(round((f - mu) / sd, 5)) > 2.5) AS o, any_value(cov) AS cov FROM f, s3),
bal AS (SELECT -sum(np / total * log2(np / total)) / log2(count(*)) AS b FROM pl, t), s4 AS (SELECT avg(r) AS r, count(*) FILTER (WHERE r > .95) AS hi FROM (SELECT least(1, nf / max(np)::DOUBLE) AS r FROM c GROUP BY feature, nf)),
s5 AS (SELECT count(*) FILTER (WHERE abs(s - 1) > .01) AS sums, sum(weak)::BIGINT AS weak, count(*) FILTER (WHERE sn <> nf) AS cnt, sum(ov)::BIGINT AS ov FROM (SELECT feature, nf, sum(n / nf::DOUBLE) AS s, sum(n) AS sn, count(*) FILTER (WHERE n / nf::DOUBLE > .7 AND n < 30) AS weak, count(*) FILTER (WHERE n > nf) AS ov FROM c GROUP BY ALL)),
bi AS (SELECT feature, CASE WHEN n >= 30 AND n * .05 >= 5 THEN 2 * (1 - .5 * (1 + sqrt(1 - exp(-2 * pow((k - n * .05) / sqrt(n * .05 * .95), 2) / 3.141592653589793)))) WHEN k < n * .05 THEN .5 ELSE .01 END AS p FROM f, n), s6 AS (SELECT count(*) FILTER (WHERE p < .05) AS k, count(*) AS m FROM bi),
al AS (
SELECT 'frequency' AS stage, greatest(.5, 1 - .1 * w - .3 * r) AS score, true AS passed, unnest(['filter_rate', 'warnings']) AS metric, unnest([r, w]) AS value FROM s1
UNION ALL SELECT 'sample-size', (least(1, n / 30.0) + greatest(.3, least(1, n / 200.0))) / 2, n >= 5, unnest(['sites', 'power', 'required']), unnest([n, greatest(.3, least(1, n / 200.0)), ceil(384.16 / (1 + 383.16 / n))]) FROM n
UNION ALL SELECT 'distribution', CASE WHEN abs(sk) > 3 THEN .56 WHEN abs(sk) > 2 THEN .8 ELSE 1 END * greatest(.5, 1 - o * .1) * (.5 + .5 * cov), true, unnest(['skewness', 'outliers', 'coverage']), unnest([sk, o, cov]) FROM s3b
UNION ALL SELECT 'correlation', (b + r) / 2, true, unnest(['balance', 'mean_correlation', 'high']), unnest([b, r, hi]) FROM bal, s4
UNION ALL SELECT 'sanity', CASE WHEN sums + cnt + ov = 0 THEN greatest(.7, 1 - weak * .1) ELSE greatest(.2, (6 - (sums > 0)::INT - (cnt > 0)::INT - (ov > 0)::INT) / 6.0) END, sums = 0 AND cnt = 0 AND ov = 0, unnest(['sums', 'ranges', 'weak_support', 'bayes', 'counts', 'impossible']), unnest([sums, 0, weak, 0, cnt, ov]) FROM s5
UNION ALL SELECT 'significance', greatest(.3, k / m::DOUBLE), true, unnest(['significant', 'rate']), unnest([k, k / m::DOUBLE]) FROM s6
UNION ALL SELECT 'recommendation', (coalesce(list_avg(r), 1) + 1) / 2, true, unnest(['recommendations', 'mean_confidence']), unnest([len(r), coalesce(list_avg(r), 1)]) FROM (SELECT list_filter([CASE WHEN s1.r > .5 THEN .8 END, CASE WHEN greatest(.3, least(1, n / 200.0)) < .8 THEN .9 END, CASE WHEN cov < .5 THEN .7 END, CASE WHEN sums + cnt + ov > 0 THEN .8 END], lambda z: z IS NOT NULL) AS r FROM s1, n, s3b, s5))
SELECT stage, round(score, @D)::DOUBLE AS score, passed, metric, round(value::DOUBLE, 5) AS value FROM al"""
    metrics = f"""WITH {h}, v AS (SELECT feature, value, count(DISTINCT site) AS k FROM obs WHERE value IS NOT NULL GROUP BY ALL), p AS (SELECT feature, count(*) AS values FROM v GROUP BY 1), s AS (SELECT feature, count(DISTINCT site) AS sites FROM obs GROUP BY 1 HAVING count(DISTINCT site) >= {MIN})
SELECT feature, sites, values FROM s JOIN p USING (feature)"""
    other = A.oracle_sql()
    risk = f"""WITH sp AS ({other['platform_specificity'].replace(w, h)}), fi AS (SELECT feature, count(*) FILTER (WHERE significant) AS sig FROM ({other['conditional_probability']}) GROUP BY 1), m AS ({metrics}),
ld AS (WITH {h}, {_CELLS} SELECT feature, arg_min({{'f': f, 'np': np}}, (-f, platform)) AS b FROM c WHERE platform <> 'unknown' GROUP BY 1), tt AS (WITH {h}, {_CELLS} SELECT total, k FROM t),
x AS (SELECT m.feature, list_filter([CASE WHEN specificity > .7 THEN 'high:platform' END, CASE WHEN b.f > .8 AND b.np / total > .5 THEN 'high:dataset' END, CASE WHEN sites / total < .1 AND specificity > .5 THEN 'medium:concentration' END, CASE WHEN sites < 5 THEN 'medium:sample' END,
  CASE WHEN sig / k < .3 THEN 'medium:significance' END, CASE WHEN values < 3 AND sites > 10 THEN 'low:values' END], lambda z: z IS NOT NULL) AS x FROM m JOIN sp USING (feature) JOIN fi USING (feature) LEFT JOIN ld USING (feature), tt),
y AS (SELECT *, len(list_filter(x, lambda z: starts_with(z, 'high'))) > 0 AS hi, len(list_filter(x, lambda z: starts_with(z, 'medium'))) AS md FROM x)
SELECT feature, array_to_string(x, ', ') AS factors, CASE WHEN hi THEN 'high' WHEN md > 1 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN hi THEN 'low' WHEN list_contains(x, 'medium:concentration') OR list_contains(x, 'medium:sample') THEN 'medium' ELSE 'high' END AS confidence FROM y"""
    return {
        "recommendation_risk": risk,
        "validation_stages": stages.replace("@D", "5"),
        "validation_verdict": f"""WITH p AS (SELECT DISTINCT stage, score, passed FROM ({stages.replace("@D", "12")})), a AS (SELECT exp(sum(ln(greatest(score * CASE WHEN passed THEN 1 ELSE .5 END, 1e-9)))) AS s, bool_and(passed) AS ok, count(*) AS stages FROM p)
SELECT stages, round(s, 4) AS score, CASE WHEN s >= .9 THEN 'A' WHEN s >= .8 THEN 'B' WHEN s >= .7 THEN 'C' WHEN s >= .6 THEN 'D' ELSE 'F' END AS grade, ok AND s >= .7 AS passed FROM a""",
        "platform_metrics": f"""WITH {h}, {_CELLS}, vv AS (SELECT feature, platform, value, count(DISTINCT site) AS k FROM obs WHERE value IS NOT NULL GROUP BY ALL), sp2 AS (SELECT feature, platform, count(*) AS values, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM vv GROUP BY ALL),
x AS (SELECT *, nf / total AS q, nf / total * np AS e FROM c LEFT JOIN sp2 USING (feature, platform))
SELECT feature, platform, n, round(e, 5) AS expected, round(pow(n - e, 2) / e, 4) AS chi_share, abs(n - e) > 1.96 * sqrt(e * (1 - q)) + 1e-12 AS stands_out, coalesce(values, 0) AS values, round(CASE WHEN values > 1 THEN h / log2(values) ELSE 0 END, 5) AS spread FROM x""",
        "overall_metrics": f"""WITH {h}, v AS (SELECT feature, value, count(DISTINCT site) AS k FROM obs WHERE value IS NOT NULL GROUP BY ALL), p AS (SELECT feature, count(*) AS values, sum(k) AS pairs, arg_min(value, (-k, value)) AS m FROM v GROUP BY 1), s AS (SELECT feature, count(DISTINCT site) AS sites FROM obs GROUP BY 1 HAVING count(DISTINCT site) >= {MIN})
SELECT feature, sites, values, round(pairs / sites::DOUBLE, 5) AS values_per_site, m AS modal_value FROM s JOIN p USING (feature)""",
        "bias_warnings": f"""WITH {h}, {_SITES}, pl AS (SELECT platform, count(*) AS np FROM sites GROUP BY 1), t AS (SELECT sum(np)::DOUBLE AS t FROM pl), a AS (SELECT max(np) / any_value(t) AS top, count(*) AS k, coalesce(sum(np) FILTER (WHERE platform = 'unknown'), 0) / any_value(t) AS u, sum(pow(np / t, 2)) AS h FROM pl, t)
SELECT 'dominant platform' AS warning, round(top, 6)::DOUBLE AS value FROM a WHERE top > .6 UNION ALL SELECT 'few platforms', k FROM a WHERE k <= 2 UNION ALL SELECT 'many unknown', round(u, 6) FROM a WHERE u > .3 UNION ALL SELECT 'concentrated', round(h, 6) FROM a WHERE h > .3""",
        "sensitivity": f"""WITH q AS ({A.oracle_sql()['platform_specificity']}), r AS (WITH {w}, {_CELLS} SELECT feature, max(n / nf::DOUBLE) AS p FROM c GROUP BY 1), z AS (WITH {w}, {_SITES}, pl AS (SELECT count(*) AS np FROM sites GROUP BY platform) SELECT round(sum(pow(np / (SELECT sum(np) FROM pl)::DOUBLE, 2)), 6) AS h FROM pl),
s AS (SELECT feature, least(1, specificity * p * h) AS s FROM q JOIN r USING (feature), z) SELECT feature, round(s, 5) AS sensitivity, CASE WHEN s < .2 THEN 'robust' WHEN s > .5 THEN 'sensitive' ELSE 'moderate' END AS label FROM s""",
        "dimension_support": sup,
        "platform_signatures": f"""WITH u AS ({sup}), p AS (SELECT platform, sum(support) AS s, sum(support * support) AS q, count(*) FILTER (WHERE support > .3) AS o FROM u GROUP BY 1)
SELECT platform, round(1 - sqrt(greatest(0, q / 3 - pow(s / 3, 2))), 6) AS strength, o IN (0, 3) AS agreement, round(s, 6) AS total, row_number() OVER (ORDER BY round(s, 6) DESC, platform) AS rank FROM p""",
    }
