"""How far the statistics on features can be trusted: sample sizes, agreement of the stages, shares by platform, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K
from tracegrid.functions import stats as S
from tracegrid.operators import discrimination as D
from tracegrid.operators import frequency as Q


def _per_feature(obs: DataFrame, min_sites: int) -> DataFrame:
    """feature, nf, x (chi-square over all platforms), least_expected, least (sites on the platform with fewest, zeros count)."""
    sizes = D.platforms(obs)
    total, k, small = sizes.agg(F.sum("np")).scalar().cast("double"), sizes.agg(F.count(F.lit(1))).scalar(), sizes.agg(F.min("np")).scalar()
    c = D.cells(obs, min_sites).withColumn("e", F.col("nf") / total * F.col("np"))
    per = c.groupBy("feature", "nf").agg(F.sum(F.pow(F.col("n") - F.col("e"), F.lit(2)) / F.col("e")).alias("x"), F.sum("e").alias("e"), F.min("n").alias("least"), F.count(F.lit(1)).alias("held"))
    # A platform without the feature adds its expectation.
    return per.select("feature", "nf", (F.col("x") + F.col("nf") - F.col("e")).alias("x"), (F.col("nf") / total * small).alias("least_expected"), F.when(F.col("held") < k, 0).otherwise(F.col("least")).alias("least"), k.alias("k"))


def statistical_summary(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """One row: features, how many of them have adequate (5), marginal (2) and inadequate expected counts, mean chi-square,
    those significant at 5 %, and the concentration of the corpus as bias risk."""
    obs = D.counted(obs)
    hhi = D.concentration(obs).select("hhi").scalar()
    per = _per_feature(obs, min_sites).withColumn("p", S.wide_p(F.col("x"), F.greatest(F.lit(1), F.col("k") - 1)))
    e = F.col("least_expected")
    a = per.agg(
        F.count(F.lit(1)).alias("features"), F.count_if(e >= 5).alias("adequate"), F.count_if((e < 5) & (e >= 2)).alias("marginal"), F.count_if(e < 2).alias("inadequate"), F.round(F.avg("x"), 4).alias("mean_chi_square"), F.count_if(F.col("p") < 0.05).alias("significant"),
    )
    return a.withColumns({"bias_risk": F.round(hhi, 6), "reliability": F.round(1 - hhi, 6)})


def sample_adequacy(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, sites, least, label: adequate from 30 sites with 5 on every platform, marginal from 15 with 3."""
    obs = D.counted(obs)
    n, m = F.col("nf"), F.col("least")
    label = F.when((n >= 30) & (m >= 5), "adequate").when((n >= 15) & (m >= 3), "marginal").otherwise("inadequate")
    return _per_feature(obs, min_sites).select("feature", n.alias("sites"), m.alias("least"), label.alias("label"))


def consistency(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """check, compared, issues: whether counts by feature, the total and the frequencies agree between the cube and the counts."""
    counted = Q.feature_frequency(obs, min_sites).select("feature", "site_count", "frequency")
    cube = D.cells(obs, min_sites).groupBy("feature").agg(F.sum("n").alias("n"))
    total, sites = D.platforms(obs).agg(F.sum("np")).scalar(), obs.agg(F.count_distinct("site")).scalar()
    both = counted.join(cube, "feature", "full_outer").withColumns({"total": total, "sites": sites})
    a = both.agg(
        F.count(F.lit(1)).alias("m"), F.count_if(F.coalesce("site_count", F.lit(0)) != F.coalesce("n", F.lit(0))).alias("counts"), F.count_if(F.abs(F.col("n") / F.col("total") - F.col("frequency")) > 0.001).alias("shares"), F.max(F.when(F.col("total") != F.col("sites"), 1).otherwise(0)).alias("totals"),
    )
    rows = F.array(*[F.struct(F.lit(c).alias("check"), n.cast("bigint").alias("compared"), F.col(i).cast("bigint").alias("issues")) for c, n, i in (("feature counts", F.col("m"), "counts"), ("site totals", F.lit(1), "totals"), ("frequencies", F.col("m"), "shares"))])
    return a.select(F.explode(rows).alias("r")).select("r.*")


def feature_shares(obs: DataFrame, min_sites: int = 1) -> DataFrame:
    """feature, platform, sites, frequency of the feature, share of its sites on the platform."""
    total = D.platforms(obs).agg(F.sum("np")).scalar().cast("double")
    return D.cells(obs, min_sites).select("feature", "platform", F.col("n").alias("sites"), F.round(F.col("nf") / total, 6).alias("frequency"), F.round(F.col("n") / F.col("nf"), 6).alias("share"))


def prefix_shares(obs: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """pattern, platform, share: the mean of the shares of a pattern's names, of those with several; members: pattern, feature."""
    sizes = members.groupBy("pattern").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least)
    cells = D.cells(obs).select("feature", "platform", (F.col("n") / F.col("nf")).alias("s"))
    rows = members.join(sizes, "pattern").join(cells, "feature").groupBy("pattern", "m", "platform").agg(F.sum("s").alias("s"))
    return rows.select("pattern", "platform", F.round(F.col("s") / F.col("m"), 6).alias("share"))


def naming_convention(name: Column) -> Column:
    """How a name is written, first match."""
    rules = [("kebab-case", r"^[a-z]+(-[a-z]+)*$"), ("camelCase", r"^[a-zA-Z]+([A-Z][a-z]*)*$"), ("underscore_case", r"^[a-z]+(_[a-z]+)*$"), ("UPPER_CASE", r"^[A-Z]+(_[A-Z]+)*$")]
    out = None
    for n, rx in rules:
        out = F.when(name.rlike(rx), n) if out is None else out.when(name.rlike(rx), n)
    return out.otherwise("mixed")


def name_structure(name: Column) -> Column:
    """What the parts of a name stand for, by their number."""
    parts = F.size(F.split(F.lower(name), "[-_]"))
    return F.when(parts == 3, "vendor-service-action").when(parts == 2, "vendor-purpose").otherwise("simple")


def name_category(name: Column) -> Column:
    """Category of a header by parts of its name, in this order; short parts match widely."""
    n = F.lower(name)
    has = lambda words: F.lit(False) if not words else F.greatest(*[n.contains(w) for w in words])
    return (
        F.when(has(["csp", "security", "cors", "frame", "hsts"]), "security").when(has(["cache", "etag", "vary", "expires", "modified"]), "caching")
        .when(has(["content", "type", "encoding", "language", "length", "request", "id", "trace", "correlation", "session", "timing", "performance", "speed"]), "infrastructure").otherwise("custom")
    )


def top_pattern_test(obs: DataFrame) -> DataFrame:
    """feature, first_platform, second_platform, chi_square, p_value: the most frequent feature against the two platforms that
    carry most features; ties to the first name. No row with fewer than two platforms."""
    d = D.distinct_sites(obs)
    top = d.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "feature"))["feature"].alias("f")).scalar()
    carried = d.groupBy("platform").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "platform").limit(2).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "platform"))).alias("p")).select("p.platform")
    sites = obs.select("site", "platform").distinct().join(d.where(F.col("feature") == top).select("site", F.lit(1).alias("has")), "site", "left")
    two = carried.where(F.size("platform") == 2).select(F.col("platform")[0].alias("a"), F.col("platform")[1].alias("b"))
    one, other = two.select("a").scalar(), two.select("b").scalar()
    has, none = F.col("has").isNotNull(), F.col("has").isNull()
    cells = sites.agg(*[F.count_if((F.col("platform") == p) & h).alias(n) for n, p, h in (("a", one, has), ("b", other, has), ("c", one, none), ("d", other, none))])
    x = S.yates(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return cells.where(one.isNotNull()).select(top.alias("feature"), one.alias("first_platform"), other.alias("second_platform"), F.round(x, 4).alias("chi_square"), S.step_p(x).alias("p_value"))


def vendor_consistency(detections: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: headers whose vendor's category fits their own, those whose does not, the ratio and whether it exceeds .8."""
    fits = F.lit(False)
    for c, names in K.FITTING_CATEGORIES.items():
        fits = fits | ((F.col("category") == c) & F.col("own").isin(*names))
    rows = detections.select("feature", "category").join(classified.select("feature", F.col("category").alias("own")), "feature")
    a = rows.agg(F.count_if(fits).alias("consistent"), F.count_if(~fits).alias("inconsistent"))
    r = S.ratio(F.col("consistent"), F.col("consistent") + F.col("inconsistent"))
    return a.withColumns({"ratio": F.round(r, 6), "overall": r > 0.8})


def vendor_signatures(obs: DataFrame, matches: DataFrame) -> DataFrame:
    """signature, sites, confidence of the vendor signatures.

    .6, plus .2 for a frequency of .05 to .5 or .1 above .01, .1 for three names and .05 more for four, and up to .1 by the
    share of optional headers that the matching sites carry (all of them, so the result does not depend on an order).
    """
    total = obs.agg(F.count_distinct("site")).scalar().cast("double")
    optional = [(n, o) for (n, _, _), os in zip(K.VENDOR_SIGNATURES, K.VENDOR_OPTIONAL, strict=True) for o in os]
    carried = obs.where(F.col("feature").isin(sorted({o for _, o in optional}))).select("site", "feature").distinct()
    rows = matches.join(carried, "site", "left")
    counts = [F.count_if((F.col("signature") == n) & (F.col("feature") == o)) for n, o in optional]
    per = rows.groupBy("signature").agg(F.count_distinct("site").alias("sites"), sum(counts[1:], counts[0]).alias("hits"))
    name = F.col("signature")
    pick = lambda xs: F.element_at(F.create_map(*[F.lit(y) for (n, *_), x in zip(K.VENDOR_SIGNATURES, xs, strict=True) for y in (n, x)]), name)
    width, many = pick([len(o) for o in K.VENDOR_OPTIONAL]), pick([len(r) + len(o) for (_, r, _), o in zip(K.VENDOR_SIGNATURES, K.VENDOR_OPTIONAL, strict=True)])
    f = F.col("sites") / total
    c = 0.6 + F.when((f >= 0.05) & (f <= 0.5), 0.2).when(f > 0.01, 0.1).otherwise(0.0) + F.when(many >= 3, 0.1).otherwise(0.0) + F.when(many >= 4, 0.05).otherwise(0.0) + 0.1 * F.col("hits") / (width * F.col("sites"))
    return per.select("signature", "sites", F.round(S.clamp(c, 0.0, 1.0), 6).alias("confidence"))


def signature_strength(support: DataFrame, dims: int = 3) -> DataFrame:
    """platform, boost, penalty, diversity, score, counts: a signature counts from supports of .3 together.

    boost: .15 if the dimensions agree, .1 if they lie close (strength above .8), .05 for each dimension beyond the first,
    .1 times the diversity of patterns; at most .4. penalty: for each platform that excludes this one, by the smaller of both
    strengths, .3, .15 or .05 and .1 more; at most .6. score: mean support with boost and penalty, within 0 and 1.
    """
    q, n = F.col("support"), F.col("patterns")
    per = support.groupBy("platform").agg(F.sum(q).alias("s"), F.sum(q * q).alias("q"), F.count_if(q > 0.3).alias("over"), F.count(F.lit(1)).alias("active"), F.sum(n).alias("m"), F.sum(n * n).alias("mm"))
    mean = F.col("s") / dims
    strength = 1 - F.sqrt(F.greatest(F.lit(0.0), F.col("q") / dims - mean * mean))
    spread = F.col("mm") / dims - F.pow(F.col("m") / dims, F.lit(2))
    even = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), spread / (F.pow(F.col("m"), F.lit(2)) / 3))) * F.col("active") / 3
    diversity = F.when(F.col("active") == 1, 0.3).otherwise(even)
    rows = per.select("platform", mean.alias("mean"), F.col("s"), strength.alias("strength"), F.col("over").isin(0, dims).alias("agree"), "active", diversity.alias("diversity"))
    # Five platforms at most.
    other = rows.select(F.col("platform").alias("other"), F.col("strength").alias("theirs"))
    pairs = [(a.lower(), b.lower()) for a, b in K.EXCLUSIVE_PLATFORMS]
    excluded = rows.sparkSession.createDataFrame(pairs + [(b, a) for a, b in pairs], "platform string, other string")
    low = F.least("strength", "theirs")
    cost = F.when(low > 0.7, 0.4).when(low > 0.5, 0.25).when(low > 0.3, 0.15).otherwise(0.0)
    fines = rows.join(excluded, "platform").join(other, "other").groupBy("platform").agg(F.least(F.sum(cost), F.lit(0.6)).alias("penalty"))
    boost = F.least(F.when(F.col("agree"), 0.15).otherwise(0.0) + F.when(F.col("strength") > 0.8, 0.1).otherwise(0.0) + (F.greatest(F.col("active"), F.lit(1)) - 1) * 0.05 + F.col("diversity") * 0.1, F.lit(0.4))
    out = rows.join(fines, "platform", "left").withColumns({"boost": boost, "penalty": F.coalesce("penalty", F.lit(0.0))})
    return out.select("platform", F.round("boost", 6).alias("boost"), F.round("penalty", 6).alias("penalty"), F.round("diversity", 6).alias("diversity"), F.round(S.clamp(F.col("mean") * (1 + F.col("boost")) - F.col("penalty"), 0.0, 1.0), 6).alias("score"), (F.col("s") >= 0.3).alias("counts"))


def table_test(cells: DataFrame, row: str, column: str, n: str) -> DataFrame:
    """rows, columns, statistic, df, critical, p_value, low_expected of a table of counts (row, column, n), zeros left out or not.

    Corrected for continuity if it is two by two. A cell without observations adds its expectation, so zeros are not filled in.
    """
    c = cells.groupBy(row, column).agg(F.sum(n).alias("o")).where("o > 0")
    r, k = c.groupBy(F.col(row).alias("_r")).agg(F.sum("o").alias("rt")), c.groupBy(F.col(column).alias("_k")).agg(F.sum("o").alias("kt"))
    total, rows, cols = c.agg(F.sum("o")).scalar().cast("double"), r.agg(F.count(F.lit(1))).scalar(), k.agg(F.count(F.lit(1))).scalar()
    least = r.agg(F.min("rt")).scalar() * k.agg(F.min("kt")).scalar() / total
    e = F.col("rt") * F.col("kt") / total
    square = (rows == 2) & (cols == 2)
    # Four cells at most are filled in where the correction needs them; its term for an empty cell is that of its expectation.
    gap = F.abs(F.col("o") - e)
    held = c.join(r, F.col(row).eqNullSafe(F.col("_r"))).join(k, F.col(column).eqNullSafe(F.col("_k"))).select("o", e.alias("e"), (F.when(square, F.greatest(F.lit(0.0), gap - 0.5)).otherwise(gap)).alias("d"))
    a = held.agg(F.sum(F.col("d") * F.col("d") / F.col("e")).alias("x"), F.sum("e").alias("e"))
    empty = F.greatest(F.lit(0.0), total - F.col("e"))
    x = F.col("x") + F.when(square & (empty > 1e-9), F.pow(F.greatest(F.lit(0.0), empty - 0.5), F.lit(2)) / F.greatest(empty, F.lit(1e-9))).otherwise(empty)
    df = (rows - 1) * (cols - 1)
    return a.select(rows.alias("rows"), cols.alias("columns"), F.round(x, 4).alias("statistic"), df.alias("df"), S.critical_value(df).alias("critical"), S.table_p(x, df).alias("p_value"), (least < 5).alias("low_expected"))


def category_bias(categories: DataFrame) -> DataFrame:
    """category, expected, actual, ratio, level, imbalance: headers of a category against an equal share of all."""
    total, k = categories.agg(F.sum("headers")).scalar(), categories.agg(F.count(F.lit(1))).scalar()
    even = total / k
    r = F.col("headers") / even
    level = F.when((r > 2) | (r < 0.5), "high").when((r > 1.5) | (r < 0.67), "medium").otherwise("low")
    return categories.select("category", F.floor(even + 0.5).alias("expected"), F.col("headers").alias("actual"), F.round(r, 6).alias("ratio"), level.alias("level"), F.when(r > 1.8, "over").when(r < 0.6, "under").otherwise("even").alias("imbalance"))


def classification_insights(classified: DataFrame, vendor: Column) -> DataFrame:
    """One row: headers, categorised, most common category (ties to the first name), sure (score above .8), with a vendor or
    platform, custom, and those that may concern security."""
    n = F.lower("feature")
    safe = n.contains("security") | n.contains("csp") | n.contains("cors") | (F.col("category") == "security")
    most = classified.groupBy("category").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "category"))["category"]).scalar()
    return classified.agg(
        F.count(F.lit(1)).alias("headers"), F.count_if(F.col("category") != "custom").alias("categorised"), F.max(most).alias("most_common"), F.count_if(F.col("score") > 0.8).alias("sure"), F.count_if(vendor.isNotNull() | F.col("named_platform").isNotNull()).alias("of_vendors"),
        F.count_if(F.col("category") == "custom").alias("custom"), F.count_if(safe).alias("security"),
    )
