"""From raw captures to a corpus: address normalisation, date and quality filters, one capture per site, extraction.

Everything is a column expression. Addresses that do not parse keep their text and are rejected as invalid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K

#: Buckets into which the values of a key are spread for percentiles.
BUCKETS = 64
_URL = r"^(?i)(https?)://([^/?#\s]+)([^?#\s]*)(?:\?[^#\s]*)?(?:#\S*)?\z"


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_URL), F.lit(False))


def normalized_url(url: Column, keep_scheme: bool = False) -> Column:
    """Host without ``www.`` and default port, and the path without one trailing slash; scheme, query and fragment dropped."""
    scheme, host, path = F.lower(F.regexp_extract(url, _URL, 1)), F.lower(F.regexp_extract(url, _URL, 2)), F.regexp_extract(url, _URL, 3)
    bare = F.regexp_replace(F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(F.regexp_replace(host, r":80$", "")), r"^www\.", "")
    cut = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(F.when(path == "", "/").otherwise(path))
    whole = F.concat(scheme, F.lit("://"), bare, cut) if keep_scheme else F.concat(bare, cut)
    return F.when(is_valid_url(url), whole).otherwise(url)


def deduplicated(df: DataFrame, url: str, order: Column, first: str) -> DataFrame:
    """One row per normalised address: the largest ``order``, ties to the smallest ``first``. Rows are packed, so partial maxima travel."""
    cols = [F.col(c) for c in df.columns]
    best = F.min_by(F.struct(*cols), F.struct((-F.coalesce(order.cast("double"), F.lit(-1e300))).alias("o"), F.col(first).alias("f")))
    return df.groupBy(normalized_url(F.col(url)).alias("normalized_url")).agg(best.alias("_r"), F.count(F.lit(1)).alias("n_rows")).select("normalized_url", "n_rows", "_r.*")


def once(df: DataFrame, key: str, **cols: Column) -> DataFrame:
    """key and the columns, one row per key: what is asked for is computed first, so that whole pages are not shuffled.

    Of rows that differ under one key the smallest in the order of the columns is kept.
    """
    return df.select(key, *[c.alias(k) for k, c in cols.items()]).groupBy(key).agg(F.min(F.struct(*cols)).alias("_r")).select(key, "_r.*")


def in_range(when: Column, start: str | None = None, end: str | None = None, last_days: int | None = None, now: Column | None = None) -> Column:
    """Inclusive date range; ``last_days`` alone decides when given, from midnight that many days ago."""
    if last_days is not None:
        return when >= F.date_trunc("DAY", F.date_sub(now if now is not None else F.current_timestamp(), last_days))
    ok = F.lit(True)
    if start:
        ok = ok & (when >= F.lit(start).cast("timestamp"))
    if end:
        ok = ok & (when <= F.expr(f"timestamp'{end} 23:59:59.999'"))
    return ok


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def reject_reason(status: Column, html: Column, title: Column, headers: Column, url: Column) -> Column:
    """Why a capture is not used, first match: bot-detection, error-page, insufficient-data, invalid-url; null if it is."""
    text, name = F.lower(F.coalesce(html, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    bot = status.isin(403, 503) & (_any(text, K.BOT_PHRASES) | _any(name, K.BOT_PHRASES))
    error = (status >= 400) | ((status == 200) & (_any(text, K.ERROR_PHRASES) | _any(name, K.ERROR_PHRASES)))
    thin = html.isNull() | (F.length(html) < 100) | headers.isNull() | (F.size(headers) == 0)
    return F.when(F.coalesce(bot, F.lit(False)), "bot-detection").when(F.coalesce(error, F.lit(False)), "error-page").when(thin, "insufficient-data").when(~is_valid_url(url), "invalid-url")


def external_scripts(html: Column) -> Column:
    """Sources of script tags that start with http."""
    return F.filter(F.regexp_extract_all(html, F.lit(r"""(?i)<script[^>]+src\s*=\s*["']([^"']+)["'][^>]*>"""), 1), lambda s: s.startswith("http"))


def inline_scripts(html: Column) -> Column:
    """Bodies of inline scripts longer than 10 characters, cut to 200, with the prefix inline:."""
    bodies = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<script[^>]*>([^<]+)</script>"), 1), lambda s: F.trim(s))
    return F.transform(F.filter(bodies, lambda s: F.length(s) > 10), lambda s: F.concat(F.lit("inline:"), F.substring(s, 1, 200)))


def script_names(src: Column) -> Column:
    """The named patterns of a script: by host and path of an address, by content of an inline body, else the fallback."""
    text = F.lower(F.regexp_replace(src, "^inline:", ""))
    host, path = F.lower(F.regexp_extract(src, r"^(?i)https?://([^/?#:]+)", 1)), F.regexp_extract(src, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    bare = F.regexp_replace(host, r"^www\.", "")
    domain = None
    for d in ("googleapis.com", "cloudflare.com", "jsdelivr.net", "unpkg.com"):
        domain = F.when(bare.endswith(d), f"{d}-scripts") if domain is None else domain.when(bare.endswith(d), f"{d}-scripts")
    by_url = [
        (host.contains("cdn."), "cdn-usage"),
        (host.contains("google-analytics") | host.contains("googletagmanager"), "google-analytics"),
        (host.contains("facebook.net") | path.contains("fbevents"), "facebook-pixel"),
        *[(path.contains(x), x) for x in ("jquery", "bootstrap", "angular", "react", "vue")],
        (path.contains("wp-content") | path.contains("wp-includes"), "wordpress-scripts"),
        (path.contains("/sites/") & path.contains("/modules/"), "drupal-scripts"),
        (path.contains("/media/jui/") | path.contains("/media/system/"), "joomla-scripts"),
    ]
    urls = F.array_compact(F.array(*[F.when(c, n) for c, n in by_url], domain))
    by_body = [
        (text.rlike(r"window\.(?:duda|_duda)|dmapi"), "duda-global-objects"),
        (text.rlike(r"window\.wp\b|wpapisettings"), "wordpress-global-objects"),
        (text.rlike(r"window\.shopify|shopify\."), "shopify-global-objects"),
        (text.rlike(r"window\.drupal|drupal\."), "drupal-global-objects"),
        (text.rlike(r"window\.joomla|joomla\."), "joomla-global-objects"),
        (text.rlike(r"window\.magento|mage\."), "magento-global-objects"),
        *[(text.contains(x), f"{x}-inline") for x in ("jquery", "react", "angular", "vue")],
        (F.lit(True), "inline-script"),
    ]
    bodies = F.array_compact(F.array(*[F.when(c, n) for c, n in by_body]))
    other = F.array_compact(F.array(F.when(src.contains("$") | src.contains("jQuery"), "jquery-inline"), F.when(src.contains("wp_"), "wordpress-inline"), F.lit("inline-script")))
    return F.when(src.startswith("inline:"), bodies).when(host != "", urls).otherwise(other)


def same_domain(src: Column, page_host: Column) -> Column:
    """Whether a script belongs to its page: relative, or of one host without ``www.``."""
    host = F.regexp_replace(F.lower(F.regexp_extract(src, r"^(?i)(?:https?:)?//([^/?#:]+)", 1)), r"^www\.", "")
    return (host == "") | (host == F.regexp_replace(F.lower(page_host), r"^www\.", ""))


def meta_tags(html: Column) -> Column:
    """Meta tags of a page as key=content, the key with its kind as prefix."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), 1)
    part = lambda t, a: F.regexp_extract(t, rf"""(?i)\b{a}\s*=\s*["']([^"']*)["']""", 1)
    key = lambda t: F.when(part(t, "name") != "", F.concat(F.lit("name:"), F.lower(part(t, "name")))).when(part(t, "property") != "", F.concat(F.lit("property:"), F.lower(part(t, "property")))).when(part(t, "http-equiv") != "", F.concat(F.lit("http-equiv:"), F.lower(part(t, "http-equiv"))))
    return F.filter(F.transform(tags, lambda t: F.concat(key(t), F.lit("="), part(t, "content"))), lambda x: x.isNotNull())


def truncated(html: Column, most: int) -> Column:
    return F.when(F.length(html) > most, F.concat(F.substring(html, 1, most), F.lit("<!-- truncated -->"))).otherwise(html)


def robots_rules(content: Column) -> Column:
    """Directives of a robots.txt as a struct: agents, disallowed paths, sitemaps (each distinct) and the last crawl delay."""
    lines = F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x))
    of = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"^(?i){name}\s*:\s*(.*?)\s*$", 1)), lambda v: v != "")))
    delay = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^(?i)crawl-delay\s*:\s*([0-9.]+)", 1)), lambda v: v != "")
    return F.struct(of("user-agent").alias("agents"), of("disallow").alias("disallows"), of("sitemap").alias("sitemaps"), F.try_element_at(delay, F.lit(-1)).try_cast("double").alias("crawl_delay"))


def quality_score(html: Column, n_scripts: Column, n_meta: Column) -> Column:
    """1 less penalties: no html .4, short html .2, no scripts .2, fewer than two .1, no meta .1, error words .3."""
    text = F.lower(F.coalesce(html, F.lit("")))
    score = 1.0 - F.when(text == "", 0.4).when(F.length(text) < 1000, 0.2).otherwise(0.0) - F.when(n_scripts == 0, 0.2).when(n_scripts < 2, 0.1).otherwise(0.0) - F.when(n_meta == 0, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), score - F.when(_any(text, ["access denied", "forbidden", "not found", "error"]), 0.3).otherwise(0.0))


def quality_label(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score >= 0.3, "low").otherwise("blocked")


def walls(text: Column) -> Column:
    """Walls against automated visits whose indicators a text holds, as an array of structs in catalogue order."""
    hits = [F.when(_any(text, ind), F.struct(F.lit(n).alias("name"), F.lit(p).alias("provider"), F.lit(k).alias("kind"), F.lit(c).alias("confidence"), F.lit(d).alias("rank"))) for n, p, k, c, d, ind in K.WALLS]
    return F.array_compact(F.array(*hits))


def wall_verdicts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, walls, primary (most confident, ties in catalogue order), risk."""
    rows = df.select(key, walls(F.lower(text)).alias("w"))
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size("w")
    hardest = F.array_max(F.transform("w", lambda x: x["rank"]))
    risk = F.when(F.size("w") == 0, "low").when((hardest >= 4) | (mean >= 0.9 - 1e-12), "critical").when((hardest >= 3) | (mean >= 0.8 - 1e-12), "high").when((hardest >= 2) | (mean >= 0.6 - 1e-12), "medium").otherwise("low")
    best = F.array_max(F.transform("w", lambda x, i: F.struct(x["confidence"].alias("c"), (-i).alias("i"), x["name"].alias("name"))))
    return rows.select(key, F.size("w").alias("walls"), F.coalesce(best["name"], F.lit("none")).alias("primary_wall"), risk.alias("risk"))


def storage_statistics(df: DataFrame) -> DataFrame:
    """Rows, first and last time, mean of the confidences above zero."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("first"), F.max("loaded_at").alias("last"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 6).alias("mean_confidence"))


def span_text(days: Column) -> Column:
    """A span in words: days, weeks, months or years, rounded down."""
    unit = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n == 1, "").otherwise("s"))
    return F.when(days < 7, unit(days, "day")).when(days < 30, unit(F.floor(days / 7), "week")).when(days < 365, unit(F.floor(days / 30), "month")).otherwise(unit(F.floor(days / 365), "year"))


def index_percentiles(df: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles by the index rule d[floor(q * n)] of the sorted values, without gathering a group in one task.

    Values are counted, and counts added up per bucket of a key: a bucket holds the values that share a quantile of a sketch,
    so a key of any number of distinct values is spread over buckets. Running sums go over the buckets of a key and within
    each bucket, and both are exact.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    cuts = counts.groupBy(key).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("_cuts")).withColumnRenamed(key, "_k")
    placed = counts.join(cuts, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_k", "_cuts")
    sums = placed.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.sum("c").alias("s"))
    w = Window.partitionBy("_k")
    sums = sums.withColumns({"before": F.sum("s").over(w.orderBy("_kb").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s"), "n": F.sum("s").over(w)})
    both = placed.join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    run = both.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col(value))).alias(f"p{round(q * 100)}") for q in shares]
    return run.groupBy(key).agg(F.max("n").alias("n"), *picks)
