"""Queries on features that occur together, and on tests of significance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions.catalogue import SIGNATURES
from tracegrid.operators import cooccurrence as C
from tracegrid.operators import discrimination as D
from tracegrid.operators import frequency as Q
from tracegrid.plans.features import _CELLS, _SITES, MIN
from tracegrid.sources import observations as O

Query = Callable[[SparkSession, str], DataFrame]
#: Signatures that this corpus can carry, beside the catalogue's.
OWN = [("quill behind ostra", ["x-quill-link", "x-ostra-edge"], ["x-drova-id"]), ("fold with server", ["x-fold-hit", "server"], ["x-umbra-via", "x-vexlet-cache"])]


def cooccur_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return C.pairs(O.headers(spark, sf), MIN)


def cooccur_orders(spark: SparkSession, sf: str) -> DataFrame:
    return C.pairs(O.orders(spark, sf), MIN)


def cooccur_words(spark: SparkSession, sf: str) -> DataFrame:
    return C.pairs(O.words(spark, sf), MIN)


def strong_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return C.strong(C.pairs(O.words(spark, sf), MIN))


def pair_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.summary(C.pairs(O.headers(spark, sf), MIN))


def platform_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return C.platform_pairs(O.headers(spark, sf), MIN)


def signature_match(spark: SparkSession, sf: str) -> DataFrame:
    return C.signature_sites(O.headers(spark, sf), SIGNATURES + OWN)


def signature_confidence(spark: SparkSession, sf: str) -> DataFrame:
    obs = O.headers(spark, sf)
    return C.signature_confidence(C.signature_sites(obs, SIGNATURES + OWN), C.pairs(obs), SIGNATURES + OWN)


def set_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return C.set_cosine(O.headers(spark, sf))


def exclusive_groups(spark: SparkSession, sf: str) -> DataFrame:
    return C.exclusive_groups(C.pairs(O.orders(spark, sf)))


def cell_tests(spark: SparkSession, sf: str) -> DataFrame:
    obs = O.headers(spark, sf)
    return C.cell_tests(D.cells(obs, MIN), D.platforms(obs).agg(F.sum("np")).scalar())


def binomial_test(spark: SparkSession, sf: str) -> DataFrame:
    return C.binomial(O.words(spark, sf), MIN)


def frequency_moments(spark: SparkSession, sf: str) -> DataFrame:
    return C.moments(Q.feature_frequency(O.words(spark, sf), MIN))


def outliers_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return C.outliers(Q.feature_frequency(O.words(spark, sf), MIN))


_ALL = (
    cooccur_pairs, cooccur_orders, cooccur_words, strong_pairs, pair_summary, platform_pairs, signature_match, signature_confidence, set_cosine, exclusive_groups,
    cell_tests, binomial_test, frequency_moments, outliers_zscore,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def _pairs(obs: str, least: int = MIN, vocabulary: str = "SELECT DISTINCT feature FROM obs") -> str:
    return f"""{obs}, {_SITES}, d0 AS (SELECT DISTINCT site, feature FROM obs WHERE feature IN ({vocabulary})),
nn AS (SELECT feature, count(*) AS nf FROM d0 GROUP BY 1 HAVING count(*) >= {least}), d1 AS (SELECT site, feature, nf FROM d0 JOIN nn USING (feature)), sz AS (SELECT count(DISTINCT site)::DOUBLE AS n FROM d0),
pp AS (SELECT a.feature AS f1, b.feature AS f2, a.nf AS n1, b.nf AS n2, count(*) AS n FROM d1 a JOIN d1 b ON a.site = b.site AND a.feature < b.feature GROUP BY ALL HAVING count(*) >= {least}),
pr AS (SELECT f1, f2, pp.n, n1, n2, round(pp.n / sz.n * 100, 6) AS freq_pct, round(pp.n / n1::DOUBLE, 6) AS p, round(pp.n / sz.n * ln(pp.n / sz.n / (n1 / sz.n * (n2 / sz.n))), 6) + 0 AS mi FROM pp, sz)"""


_TESTS = """yt AS (SELECT *, (a + b) * (a + c) / t::DOUBLE AS e1, (a + b) * (b + d) / t::DOUBLE AS e2, (c + d) * (a + c) / t::DOUBLE AS e3, (c + d) * (b + d) / t::DOUBLE AS e4 FROM tb),
ts AS (SELECT *, coalesce(pow(greatest(0, abs(a - e1) - .5), 2) / nullif(e1, 0), 0) + coalesce(pow(greatest(0, abs(b - e2) - .5), 2) / nullif(e2, 0), 0) + coalesce(pow(greatest(0, abs(c - e3) - .5), 2) / nullif(e3, 0), 0) + coalesce(pow(greatest(0, abs(d - e4) - .5), 2) / nullif(e4, 0), 0) AS x,
  coalesce(abs(a - e1) / nullif(sqrt((a + b)::DOUBLE * (a + c) * (b + d) * (c + d) / (t::DOUBLE * t * (t - 1))), 0), 0) AS z, t <= 100 OR least(e1, e2, e3, e4) < 5 AS small FROM yt),
tp AS (SELECT *, CASE WHEN x >= 10.828 THEN .001 WHEN x >= 6.635 THEN .01 WHEN x >= 3.841 THEN .05 WHEN x >= 2.706 THEN .1 ELSE .2 END::DOUBLE AS cp,
  CASE WHEN z >= 2.576 THEN .01 WHEN z >= 1.96 THEN .05 WHEN z >= 1.645 THEN .1 ELSE .2 END::DOUBLE AS fp FROM ts)"""


def _signature_sql() -> str:
    tests = []
    for name, r, c in SIGNATURES + OWN:
        need = " AND ".join(f"list_contains(fs, '{x}')" for x in r)
        out = "".join(f" AND NOT list_contains(fs, '{x}')" for x in c)
        tests.append(f"SELECT '{name}' AS signature, site FROM w WHERE {need}{out}")
    return f"WITH {O.HEADERS_SQL}, w AS (SELECT site, list(DISTINCT feature) AS fs FROM obs GROUP BY 1) " + " UNION ALL ".join(tests)


def oracle_sql() -> dict[str, str]:
    h, w, o = O.HEADERS_SQL, O.WORDS_SQL, O.ORDERS_SQL
    columns = "f1, f2, n, n1, n2, freq_pct, p, mi"
    freq = f"f AS (SELECT feature, round(count(DISTINCT site) / any_value(n)::DOUBLE, 6) AS frequency, count(DISTINCT site) AS k, any_value(n) AS n FROM obs, n GROUP BY 1 HAVING count(DISTINCT site) >= {MIN})"
    wanted = " UNION ALL ".join(f"SELECT '{n}' AS signature, '{a}' AS f1, '{b}' AS f2" for n, r, _ in SIGNATURES + OWN for i, a in enumerate(sorted(r)) for b in sorted(r)[i + 1 :])
    return {
        "cooccur_pairs": f"WITH {_pairs(h)} SELECT {columns} FROM pr",
        "cooccur_orders": f"WITH {_pairs(o)} SELECT {columns} FROM pr",
        "cooccur_words": f"WITH {_pairs(w)} SELECT {columns} FROM pr",
        "strong_pairs": f"WITH {_pairs(w)} SELECT {columns} FROM pr WHERE mi > .1 AND p > .7 ORDER BY mi DESC, f1, f2 LIMIT 10",
        "pair_summary": f"WITH {_pairs(h)} SELECT count(*) AS pairs, count(*) FILTER (WHERE mi > .05) AS significant, round(avg(mi), 6) AS mean_mi, max(p) AS max_p FROM pr",
        "platform_pairs": f"""WITH {h}, {_SITES}, d AS (SELECT DISTINCT site, platform, feature FROM obs), pl AS (SELECT platform, count(*) AS np FROM sites GROUP BY 1 HAVING count(*) >= {MIN}),
x AS (SELECT a.platform, a.feature AS f1, b.feature AS f2, count(*) AS n FROM d a JOIN d b ON a.site = b.site AND a.feature < b.feature GROUP BY ALL), y AS (SELECT *, sum(n) OVER (PARTITION BY f1, f2) AS anywhere FROM x)
SELECT platform, f1, f2, n, round(n / np::DOUBLE, 6) AS freq, round(n / anywhere::DOUBLE, 6) AS exclusivity FROM y JOIN pl USING (platform) WHERE n >= {MIN} AND n / np::DOUBLE >= .1""",
        "signature_match": _signature_sql(),
        "signature_confidence": f"""SELECT m.signature, sites, confidence FROM (SELECT signature, count(*) AS sites FROM ({_signature_sql()}) GROUP BY 1) m JOIN (
WITH {_pairs(h, 1)}, want AS ({wanted}) SELECT signature, round(coalesce(avg(p), 0), 6) AS confidence FROM want LEFT JOIN pr USING (f1, f2) GROUP BY 1) c ON c.signature = m.signature""",
        "set_cosine": f"""WITH {_pairs(h, 1, "SELECT feature FROM (SELECT feature, count(DISTINCT site) AS k FROM obs GROUP BY 1 ORDER BY k DESC, feature LIMIT 5)")},
tb AS (SELECT f1, f2, n1, n2, pr.n AS a, n1 - pr.n AS b, n2 - pr.n AS c, n.n - n1 - n2 + pr.n AS d, n.n AS t FROM pr, n), {_TESTS}
SELECT f1, f2, round(a / sqrt(n1 * n2), 6) AS cosine, CASE WHEN small THEN fp ELSE cp END AS p_value FROM tp""",
        "cell_tests": f"""WITH {h}, {_CELLS}, tb AS (SELECT feature, platform, n AS a, nf - n AS b, np - n AS c, total::BIGINT - nf - np + n AS d, total::BIGINT AS t FROM c), {_TESTS}
SELECT feature, platform, round(x, 4) AS chi_square, cp AS chi_p, fp AS fisher_p, CASE WHEN small THEN 'fisher-exact' ELSE 'chi-square' END AS method, CASE WHEN small THEN fp ELSE cp END AS p_value,
  CASE WHEN CASE WHEN small THEN fp ELSE cp END < .01 THEN 'use' WHEN CASE WHEN small THEN fp ELSE cp END < .05 THEN 'caution' ELSE 'reject' END AS advice FROM tp""",
        "binomial_test": f"""WITH {w}, {_SITES}, {freq}, z AS (SELECT *, n * .05 AS e, abs(k - n * .05) / sqrt(n * .05 * .95) AS z FROM f),
q AS (SELECT feature, k, CASE WHEN n >= 30 AND e >= 5 THEN 2 * (1 - .5 * (1 + sqrt(1 - exp(-2 * z * z / 3.141592653589793)))) WHEN k < e THEN .5 ELSE .01 END AS p FROM z)
SELECT feature, k, round(p, 6) AS p_value, p < .05 AS significant FROM q""",
        "frequency_moments": f"""WITH {w}, {_SITES}, {freq}, m AS (SELECT avg(frequency) AS mu, stddev_pop(frequency) AS sd FROM f)
SELECT round(any_value(mu), 6) AS mean, round(any_value(sd), 6) AS sd, round(avg(pow(frequency - mu, 3)) / pow(any_value(sd), 3), 4) AS skewness, round(avg(pow(frequency - mu, 4)) / pow(any_value(sd), 4) - 3, 3) AS kurtosis,
  round(max(frequency) - min(frequency), 6) AS coverage FROM f, m""",
        "outliers_zscore": f"WITH {w}, {_SITES}, {freq} SELECT feature, round((frequency - mu) / sd, 5) AS z FROM f, (SELECT avg(frequency) AS mu, stddev_pop(frequency) AS sd, count(*) AS c FROM f) WHERE c >= 3 AND abs(round((frequency - mu) / sd, 5)) > 2.5",
    }
