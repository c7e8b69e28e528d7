"""Which features occur together on a site, how much that says, and which signatures a site carries.

Features below the threshold leave before the self-join, which is exact because a pair is no more frequent than either
of its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions import stats as S
from tracegrid.operators import discrimination as D
from tracegrid.session import cut


def most_frequent(obs: DataFrame, k: int) -> DataFrame:
    """Observations of the k features with the most sites, ties by name: for vocabularies too large to pair."""
    top = obs.groupBy("feature").agg(F.count_distinct("site").alias("n")).orderBy(F.desc("n"), "feature").limit(k).select("feature")
    return obs.join(top, "feature", "left_semi")


def _carried(obs: DataFrame, min_sites: int) -> DataFrame:
    """site, feature, nf: distinct, with the sites of the feature.

    Counts have one row per feature and are joined back, so a feature that all sites carry can be split; a window would
    bring its rows into one task.
    """
    d = obs.select("site", "feature").distinct()
    n = d.groupBy("feature").agg(F.count(F.lit(1)).alias("nf")).where(F.col("nf") >= min_sites)
    return d.join(n, "feature")


def pairs(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """f1 < f2 with the sites of both: n, n1, n2, freq_pct, p (of f2 given f1) and mi, the pair's term of mutual information."""
    total = obs.agg(F.count_distinct("site")).scalar().cast("double")
    d = _carried(obs, min_sites)
    a, b = d.select("site", F.col("feature").alias("f1"), F.col("nf").alias("n1")), d.select("site", F.col("feature").alias("f2"), F.col("nf").alias("n2"))
    both = a.join(b, "site").where("f1 < f2").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.max("n1").alias("n1"), F.max("n2").alias("n2")).where(F.col("n") >= min_sites)
    both = both.withColumn("total", total)
    p12 = F.col("n") / F.col("total")
    mi = p12 * F.ln(p12 / (F.col("n1") / F.col("total") * (F.col("n2") / F.col("total"))))
    return both.select("f1", "f2", "n", "n1", "n2", F.round(p12 * 100, 6).alias("freq_pct"), F.round(F.col("n") / F.col("n1"), 6).alias("p"), F.round(mi, 6).alias("mi"))


def strong(found: DataFrame, k: int = 10) -> DataFrame:
    """The k pairs that say most: mi > .1 and p > .7."""
    return found.where("mi > 0.1 and p > 0.7").orderBy(F.desc("mi"), "f1", "f2").limit(k)


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("mi") > 0.05).alias("significant"), F.round(F.avg("mi"), 6).alias("mean_mi"), F.max("p").alias("max_p"))


def platform_pairs(obs: DataFrame, min_sites: int = 2, share: float = 0.1) -> DataFrame:
    """platform, f1, f2, n, freq, exclusivity: pairs frequent within a platform, and their share of the pair's sites anywhere."""
    sizes = obs.select("site", "platform").distinct().groupBy("platform").agg(F.count(F.lit(1)).alias("np")).where(F.col("np") >= max(2, min_sites))
    d = obs.select("site", "platform", "feature").distinct()
    # A pair is no more frequent in a platform than either of its features, so a feature that is below the floors on every
    # platform is in no pair that counts and goes before the self-join. A site has one platform, so the pairs of the others
    # still have all their sites.
    n = d.groupBy("platform", "feature").agg(F.count(F.lit(1)).alias("n")).join(sizes, "platform").where((F.col("n") >= min_sites) & (F.col("n") / F.col("np") >= share))
    near = d.join(n.select("feature").distinct(), "feature", "left_semi")
    both = near.withColumnRenamed("feature", "f1").join(near.select("site", "platform", F.col("feature").alias("f2")), ["site", "platform"]).where("f1 < f2")
    counts = both.groupBy("platform", "f1", "f2").agg(F.count(F.lit(1)).alias("n"))
    anywhere = counts.groupBy("f1", "f2").agg(F.sum("n").alias("anywhere"))
    per = counts.join(sizes, "platform").where((F.col("n") >= min_sites) & (F.col("n") / F.col("np") >= share))
    rows = per.join(anywhere, ["f1", "f2"])
    return rows.select("platform", "f1", "f2", "n", F.round(F.col("n") / F.col("np"), 6).alias("freq"), F.round(F.col("n") / F.col("anywhere"), 6).alias("exclusivity"))


def signature_sites(obs: DataFrame, signatures: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """signature, site: sites that carry every required feature and no excluding one.

    Counted by conditional aggregation over the few features that signatures name; all others leave at the scan.
    """
    named = sorted({f for _, r, c in signatures for f in r + c})
    d = obs.where(F.col("feature").isin(named)).select("site", "feature").distinct()
    tests = [
        F.when((F.count_if(F.col("feature").isin(r)) == len(set(r))) & (F.count_if(F.col("feature").isin(c) if c else F.lit(False)) == 0), F.lit(name)) for name, r, c in signatures
    ]
    return d.groupBy("site").agg(F.array_compact(F.array(*tests)).alias("s")).select(F.explode("s").alias("signature"), "site")


def signature_confidence(matches: DataFrame, found: DataFrame, signatures: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """signature, sites, confidence: the mean P(f2 | f1) over the required pairs that occur."""
    spark = matches.sparkSession
    rows = [(n, a, b) for n, r, _ in signatures for i, a in enumerate(sorted(r)) for b in sorted(r)[i + 1 :]]
    want = spark.createDataFrame(rows, "signature string, f1 string, f2 string")
    conf = want.join(found, ["f1", "f2"], "left").groupBy("signature").agg(F.round(F.coalesce(F.avg("p"), F.lit(0.0)), 6).alias("confidence"))
    return matches.groupBy("signature").agg(F.count(F.lit(1)).alias("sites")).join(conf, "signature")


def set_cosine(obs: DataFrame, k: int = 5) -> DataFrame:
    """f1, f2, cosine, p_value of the k most frequent features, pair by pair."""
    total = obs.agg(F.count_distinct("site")).scalar()
    found = pairs(most_frequent(obs, k)).withColumn("total", total)
    a, b, c = F.col("n"), F.col("n1") - F.col("n"), F.col("n2") - F.col("n")
    d = F.col("total") - a - b - c
    small = (F.col("total") <= 100) | S.low_expected(a, b, c, d)
    p = F.when(small, S.fisher_p(a, b, c, d)).otherwise(S.step_p(S.yates(a, b, c, d)))
    return found.select("f1", "f2", F.round(a / F.sqrt(F.col("n1") * F.col("n2")), 6).alias("cosine"), p.alias("p_value"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hub, feature of the greedy stars, from all (feature, neighbour) rows in order of the feature."""
    seen: set[str] = set()

    def star(f: str | None, near: list[str]) -> Iterator[pa.RecordBatch]:
        free = [] if f in seen else [x for x in near if x not in seen]
        if len(free) >= 2:
            seen.update([f, *free])
            yield pa.RecordBatch.from_pydict({"hub": [f] * (len(free) + 1), "feature": [f, *free]})

    hub: str | None = None
    near: list[str] = []
    for b in batches:
        for f, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if f != hub:
                yield from star(hub, near)
                hub, near = f, []
            near.append(x)
    yield from star(hub, near)


def exclusive_groups(found: DataFrame) -> DataFrame:
    """group_id, feature, score: greedy stars around features that rarely meet (under 5 % of sites and p < .1).

    The order decides, so one task goes through the sorted adjacency as a stream; it holds the features seen and the
    neighbours of one, never the edges. Groups are disjoint, so the edges inside them are counted by joins.
    """
    edges = cut(found.where("freq_pct < 5 and p < 0.1").select("f1", "f2"))
    near = edges.unionByName(edges.select(F.col("f2").alias("f1"), F.col("f1").alias("f2")))
    stars = cut(near.repartition(1).sortWithinPartitions("f1", "f2").mapInArrow(_stars, "hub string, feature string"))
    a, b = stars.select("hub", F.col("feature").alias("f1")), stars.select("hub", F.col("feature").alias("f2"))
    inner = edges.join(a, "f1").join(b, ["hub", "f2"]).groupBy("hub").agg(F.count(F.lit(1)).alias("inner"))
    sizes = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).join(inner, "hub")
    scores = sizes.select("hub", F.round(2 * F.col("inner") / F.col("size") / F.col("size"), 6).alias("score"))
    return stars.join(scores, "hub").select("hub", "feature", "score")


def cell_tests(cells: DataFrame, total: Column) -> DataFrame:
    """Per cell of the contingency cube the 2 x 2 tests and the one the sample allows, with what it recommends."""
    rows, a = cells.withColumn("total", total), F.col("n")
    b, c = F.col("nf") - a, F.col("np") - a
    d = F.col("total") - a - b - c
    small = (F.col("total") <= 100) | S.low_expected(a, b, c, d)
    x = S.yates(a, b, c, d)
    p = F.when(small, S.fisher_p(a, b, c, d)).otherwise(S.step_p(x))
    advice = F.when(p < 0.01, "use").when(p < 0.05, "caution").otherwise("reject")
    return rows.select("feature", "platform", F.round(x, 4).alias("chi_square"), S.step_p(x).alias("chi_p"), S.fisher_p(a, b, c, d).alias("fisher_p"), F.when(small, "fisher-exact").otherwise("chi-square").alias("method"), p.alias("p_value"), advice.alias("advice"))


def binomial(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, p_value, significant: site counts against a base rate of 5 %."""
    n = D.sites(obs)
    per = D.features(obs).withColumnRenamed("n", "k").where(F.col("k") >= min_sites).withColumn("n", n)
    p = S.binomial_p(F.col("k"), F.col("n"))
    return per.select("feature", "k", F.round(p, 6).alias("p_value"), (p < S.ALPHA).alias("significant"))


def moments(freq: DataFrame) -> DataFrame:
    """Population moments of the frequencies: mean, sd, skewness, excess kurtosis, and the range they cover."""
    return freq.agg(
        F.round(F.avg("frequency"), 6).alias("mean"), F.round(F.stddev_pop("frequency"), 6).alias("sd"), F.round(F.skewness("frequency"), 4).alias("skewness"), F.round(F.kurtosis("frequency"), 3).alias("kurtosis"), F.round(F.max("frequency") - F.min("frequency"), 6).alias("coverage")
    )


def outliers(freq: DataFrame, threshold: float = 2.5) -> DataFrame:
    """feature, z of the frequencies more than ``threshold`` standard deviations from the mean; none below three features."""
    m, s, n = freq.agg(F.avg("frequency")).scalar(), freq.agg(F.stddev_pop("frequency")).scalar(), freq.agg(F.count(F.lit(1))).scalar()
    z = F.try_divide(F.col("frequency") - m, s)
    return freq.where(n >= 3).select("feature", F.round(z, 5).alias("z")).where(F.abs("z") > threshold)
