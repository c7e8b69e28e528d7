"""The contingency cube of features and platforms, and what tells platforms apart.

The cube is built once from distinct (site, platform, feature) by grouping sets. Everything below is an aggregate over it;
zero cells are accounted for in closed form instead of being filled in, so nothing grows as features times platforms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions.stats import clamp, goodness_of_fit, ratio, wide_p, wilson_lower
from tracegrid.session import cut

NOISE = 0.1


def counted(obs: DataFrame) -> DataFrame:
    """The cube of an observation relation, written once. Every function here and the counts by feature take it in place of
    the relation itself, so what needs many of them reads the raw tables once; a site has one platform, so nothing is lost."""
    return cut(cube(obs))


def is_counted(obs: DataFrame) -> bool:
    return "level" in obs.columns


def sites(obs: DataFrame) -> Column:
    """The number of sites."""
    return platforms(obs).agg(F.sum("np")).scalar() if is_counted(obs) else obs.agg(F.count_distinct("site")).scalar()


def features(obs: DataFrame) -> DataFrame:
    """feature, n: sites of each feature."""
    if is_counted(obs):
        return obs.where("level = 'feature'").select("feature", "n")
    return obs.groupBy("feature").agg(F.count_distinct("site").alias("n"))


def distinct_sites(obs: DataFrame) -> DataFrame:
    return obs.select("site", "platform", "feature").distinct()


def platforms(obs: DataFrame) -> DataFrame:
    """platform, np: sites of each platform."""
    if is_counted(obs):
        return obs.where("level = 'platform'").select("platform", F.col("n").alias("np"))
    return obs.select("site", "platform").distinct().groupBy("platform").agg(F.count(F.lit(1)).alias("np"))


def cube(obs: DataFrame) -> DataFrame:
    """feature, platform, level, n: all cells and both margins in one pass; level names what is summed over."""
    d = distinct_sites(obs)
    level = F.when(F.grouping_id() == 0, "cell").when(F.grouping_id() == 1, "feature").when(F.grouping_id() == 2, "platform")
    g = d.groupingSets([["feature", "platform"], ["feature"]], "feature", "platform")
    cells = g.agg(F.count(F.lit(1)).alias("n"), level.alias("level")).select("feature", "platform", "level", "n")
    # The platform margin counts sites, and a site has many features: it comes from the sites of the same distinct rows. The
    # count keeps the planner from going back to the raw rows for them.
    sites_ = d.groupBy("site", "platform").agg(F.count(F.lit(1)).alias("k")).where("k > 0").groupBy("platform").agg(F.count(F.lit(1)).alias("np"))
    return cells.unionByName(sites_.select(F.lit(None).cast("string").alias("feature"), "platform", F.lit("platform").alias("level"), F.col("np").alias("n")))


def cells(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, platform, n (sites with both), nf (sites with the feature), np (sites of the platform), f = n / np."""
    if is_counted(obs):
        nf = features(obs).where(F.col("n") >= min_sites).withColumnRenamed("n", "nf")
        return obs.where("level = 'cell'").select("feature", "platform", "n").join(nf, "feature").join(platforms(obs), "platform").withColumn("f", F.col("n") / F.col("np"))
    per = distinct_sites(obs).groupBy("feature", "platform").agg(F.count(F.lit(1)).alias("n"))
    nf = F.sum("n").over(Window.partitionBy("feature"))
    return per.withColumn("nf", nf).where(F.col("nf") >= min_sites).join(platforms(obs), "platform").withColumn("f", F.col("n") / F.col("np"))


def _scalars(obs: DataFrame) -> tuple[Column, Column]:
    p = platforms(obs)
    return p.agg(F.sum("np")).scalar(), p.agg(F.count(F.lit(1))).scalar()


def dense(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """Discrimination over all platforms, zeros included.

    Specificity of a platform is its frequency over the overall one; a feature is noise if there are two platforms at
    least and every frequency lies within .1 of their mean; entropy is that of the site counts, over log2 of the number
    of platforms; the score is (1 - entropy) * min(specificity, 1), 0 for noise.
    """
    total, k = _scalars(obs)
    per = cells(obs, min_sites).groupBy("feature", "nf").agg(
        F.count(F.lit(1)).alias("held"),
        F.sum("f").alias("sum_f"),
        F.max("f").alias("max_f"),
        F.min("f").alias("min_f"),
        F.sum(F.col("n") * F.log2("n")).alias("nlogn"),
        F.min(F.struct((-F.col("f")).alias("f"), "platform")).alias("best"),
    )
    per = per.withColumns({"k": k.cast("double"), "total": total.cast("double")})
    mean = F.col("sum_f") / F.col("k")
    low = F.when(F.col("held") < F.col("k"), 0.0).otherwise(F.col("min_f"))
    noise = (F.col("k") >= 2) & (F.col("max_f") - mean <= NOISE + 1e-12) & (mean - low <= NOISE + 1e-12)
    entropy = ratio(F.log2("nf") - F.col("nlogn") / F.col("nf"), F.log2("k"))
    spec = F.col("max_f") / (F.col("nf") / F.col("total"))
    score = F.when(noise, 0.0).otherwise(F.least((1 - entropy) * F.least(spec, F.lit(1.0)), F.lit(1.0)))
    return per.select(
        "feature",
        F.col("nf").alias("site_count"),
        F.round(F.col("nf") / F.col("total"), 6).alias("frequency"),
        F.round(entropy, 5).alias("entropy"),
        F.round(spec, 5).alias("max_specificity"),
        F.col("best.platform").alias("target_platform"),
        noise.alias("is_noise"),
        F.round(score, 5).alias("discriminative_score"),
    )


def sparse(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """Discrimination over the platforms that carry a feature at all: specificity f / (f + mean of the others)."""
    total, _ = _scalars(obs)
    per = cells(obs, min_sites).groupBy("feature", "nf").agg(
        F.count(F.lit(1)).alias("k"), F.sum("f").alias("s"), F.max("f").alias("m"), F.min("f").alias("lo"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.min(F.struct((-F.col("f")).alias("f"), "platform")).alias("best")
    )
    others = F.try_divide(F.col("s") - F.col("m"), F.col("k") - 1)
    spec = F.when(F.col("k") == 1, F.col("m")).otherwise(F.col("m") / (F.col("m") + others))
    mean = F.col("s") / F.col("k")
    noise = (F.col("k") >= 2) & (F.greatest(F.col("m") - mean, mean - F.col("lo")) <= NOISE + 1e-12)
    entropy = F.when(F.col("k") < 2, 0.0).otherwise(ratio(F.log2("nf") - F.col("nlogn") / F.col("nf"), F.log2("k")))
    score = F.when(noise, 0.0).otherwise(F.least((1 - entropy) * F.least(spec, F.lit(1.0)), F.lit(1.0)))
    return per.select(
        "feature",
        F.col("nf").alias("site_count"),
        F.round(F.col("nf") / total, 6).alias("frequency"),
        F.round(entropy, 5).alias("entropy"),
        F.round(spec, 5).alias("max_specificity"),
        F.col("best.platform").alias("target_platform"),
        noise.alias("is_noise"),
        F.round(score, 5).alias("discriminative_score"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """Counts over a discrimination table: discriminatory (> .3), noise, mean score, share of noise, boost."""
    a = scored.agg(
        F.count(F.lit(1)).alias("patterns"),
        F.count_if(F.col("discriminative_score") > 0.3).alias("discriminatory"),
        F.count_if("is_noise").alias("noise"),
        F.count_if(F.col("max_specificity") > 0.7).alias("specific"),
        F.avg("discriminative_score").alias("m"),
    )
    return a.select("patterns", "discriminatory", "noise", "specific", F.round("m", 3).alias("mean_score"), F.round(ratio(F.col("noise") * 100, F.col("patterns")), 2).alias("noise_pct"), F.round(F.coalesce("m", F.lit(0.0)) * 0.5, 4).alias("boost"))


def conditional(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """P(platform | feature), P(feature | platform), lift, lower bound and fit of every cell that is not empty."""
    total, _ = _scalars(obs)
    c = cells(obs, min_sites).withColumn("total", total.cast("double"))
    share = F.col("np") / F.col("total")
    p = F.col("n") / F.col("nf")
    return c.select(
        "feature",
        "platform",
        F.col("n"),
        F.round(p, 6).alias("p_platform"),
        F.round("f", 6).alias("p_feature"),
        F.round(p / share, 5).alias("lift"),
        F.round(F.col("nf") * share, 5).alias("expected"),
        F.round(wilson_lower(F.col("n"), F.col("np")), 6).alias("lower_bound"),
        goodness_of_fit(F.col("n"), F.col("np"), F.col("nf") / F.col("total")).alias("significant"),
    )


def information(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, information_gain, power: entropy of the platforms less that under the feature; best over mean of others.

    The weights are the probabilities over their sum, and zero cells count among the others.
    """
    sizes = platforms(obs)
    total, k = _scalars(obs)
    h = sizes.select(F.col("np") / total.cast("double")).toDF("p").agg(F.coalesce(-F.sum(F.col("p") * F.log2("p")), F.lit(0.0))).scalar()
    per = cells(obs, min_sites).withColumn("p", F.col("n") / F.col("nf")).groupBy("feature").agg(F.max("p").alias("m"), F.sum("p").alias("s"), F.sum(-F.col("p") * F.col("p") * F.log2("p")).alias("w"))
    others = F.try_divide(F.col("s") - F.col("m"), k.cast("double") - 1)
    power = F.when(F.coalesce(others, F.lit(0.0)) > 1e-12, F.col("m") / others).otherwise(F.col("m"))
    return per.select("feature", F.round(F.greatest(F.lit(0.0), h - F.col("w") / F.col("s")), 5).alias("information_gain"), F.round(power, 4).alias("power"))


def specificity(obs: DataFrame, min_sites: int = 1, floor: float = 0.4) -> DataFrame:
    """Platform specificity in two tiers: by concentration from 30 sites on, by variation of frequencies below."""
    total, k = _scalars(obs)
    c = cells(obs, min_sites).withColumns({"p": F.col("n") / F.col("nf"), "total": total.cast("double"), "k": k.cast("double")})
    named = ~F.col("platform").isin("unknown", "enterprise", "cdn")
    per = c.groupBy("feature", "nf", "total", "k").agg(
        F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("s2"), F.min(F.when(named, F.struct((-F.col("p")).alias("p"), "platform", "f"))).alias("b")
    )
    top, f = -F.col("b.p"), F.col("nf") / F.col("total")
    large = 0.5 * F.least(F.lit(1.0), 2 * top) + 0.3 * F.least(F.lit(1.0), F.log10("nf") / 2) + 0.2 * F.least(F.lit(1.0), F.least(F.lit(2.0), F.col("b.f") / F.greatest(f, F.lit(0.001))) / 2)
    mean = F.col("s") / F.col("k")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("k") - mean * mean))
    score = F.when(F.col("total") >= 30, F.when(F.coalesce(top, F.lit(0.0)) >= floor, large).otherwise(0.0)).otherwise(F.least(F.lit(1.0), ratio(sd, mean)))
    return per.select("feature", F.round(score, 5).alias("specificity"), F.when(F.col("total") >= 30, "concentration").otherwise("variation").alias("method"))


def bias_adjustment(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, raw, adjusted, factor, impact: mean frequency over platforms against that over the larger named ones."""
    total, k = _scalars(obs)
    sizes = platforms(obs).withColumn("major", (F.col("platform") != "unknown") & (F.col("np") / total.cast("double") > 0.05))
    majors = sizes.agg(F.count_if("major")).scalar()
    c = cells(obs, min_sites).join(sizes.select("platform", "major"), "platform")
    per = c.groupBy("feature").agg(F.sum("f").alias("s"), F.sum(F.when(F.col("major"), F.col("f")).otherwise(0.0)).alias("t"))
    raw, adjusted = F.col("s") / k.cast("double"), ratio(F.col("t"), majors)
    factor = ratio(adjusted, raw, 1.0)
    far = F.abs(factor - 1)
    impact = F.when(far <= 0.1, "minimal").when(far <= 0.3, "moderate").otherwise("significant")
    return per.select("feature", F.round(raw, 6).alias("raw"), F.round(adjusted, 6).alias("adjusted"), F.round(factor, 5).alias("factor"), impact.alias("impact"))


def chi_square(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, statistic, p_value, valid: k-platform test; valid with five expected everywhere and ten observed.

    A zero cell adds its expectation, so the sum over held cells is completed by the sites of the other platforms.
    """
    total, k = _scalars(obs)
    least = platforms(obs).agg(F.min("np")).scalar()
    c = cells(obs, min_sites).withColumn("total", total.cast("double"))
    e = F.col("nf") / F.col("total") * F.col("np")
    per = c.groupBy("feature", "nf", "total").agg(F.sum(F.pow(F.col("n") - e, F.lit(2)) / e).alias("x"), F.sum(e).alias("e"))
    x = F.col("x") + (F.col("nf") - F.col("e"))
    valid = (F.col("nf") / F.col("total") * least >= 5) & (F.col("nf") >= 10)
    df = k - 1
    return per.select("feature", F.round(F.when(valid, x).otherwise(0.0), 4).alias("statistic"), F.when(valid, wide_p(x, df)).otherwise(1.0).alias("p_value"), valid.alias("valid"))


def concentration(obs: DataFrame) -> DataFrame:
    """One row over the corpus: sites, platforms, Herfindahl index, Shannon diversity, effective number, dominance, risk."""
    sizes = platforms(obs)
    total = sizes.agg(F.sum("np")).scalar().cast("double")
    p = sizes.select(F.col("np"), (F.col("np") / total).alias("p"))
    second = sizes.orderBy(F.desc("np")).limit(2).agg(F.min("np")).scalar().cast("double")
    a = p.agg(F.sum("np").alias("sites"), F.count(F.lit(1)).alias("platforms"), F.sum(F.col("p") * F.col("p")).alias("hhi"), (-F.sum(F.col("p") * F.ln("p"))).alias("h"), F.max("np").alias("t"))
    dominance = F.when(F.col("platforms") > 1, F.col("t") / second).otherwise(1.0)
    risk = F.when((F.col("hhi") > 0.6) | (F.col("h") < 1), "high").when((F.col("hhi") > 0.3) | (F.col("h") < 2), "medium").otherwise("low")
    quality = (F.least(F.lit(1.0), F.col("h") / 3) + (1 - F.col("hhi")) + F.least(F.lit(1.0), F.log10("sites") / 3)) / 3
    return a.select("sites", "platforms", F.round("hhi", 6).alias("hhi"), F.round("h", 6).alias("shannon"), F.round(F.exp("h"), 4).alias("effective_number"), F.round(dominance, 5).alias("dominance"), risk.alias("risk"), F.round(quality, 6).alias("quality"))


def platform_distribution(obs: DataFrame) -> DataFrame:
    total = platforms(obs).agg(F.sum("np")).scalar().cast("double")
    return platforms(obs).select("platform", F.col("np").alias("sites"), F.round(F.col("np") * 100 / total, 6).alias("pct"))


def frequency_interval(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, low, high: normal confidence interval of the frequency within 0 and 1, for frequencies strictly between."""
    n = sites(obs).cast("double")
    per = features(obs).withColumnRenamed("n", "k").where(F.col("k") >= min_sites).withColumn("p", F.col("k") / n)
    m = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / n)
    return per.where("p > 0 and p < 1").select("feature", F.round(clamp(F.col("p") - m, 0, 1), 6).alias("low"), F.round(clamp(F.col("p") + m, 0, 1), 6).alias("high"))
