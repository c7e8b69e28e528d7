"""Filters that leave what tells platforms apart, and what they save."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K
from tracegrid.functions.stats import ratio

#: Tokens that a header, a meta tag and a script take in a prompt, about.
TOKENS = (25, 15, 20)
LEVELS = {"conservative": (True, True, False, False), "aggressive": (True, True, True, True), "custom": (False, False, False, False)}


def _has(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts], F.lit(False))


def kept_headers(names: Column) -> Column:
    """Header names that are neither standard nor of infrastructure."""
    return F.filter(names, lambda n: ~F.lower(n).isin(*K.GENERIC_HEADERS, *K.INFRASTRUCTURE_HEADERS))


def kept_metas(names: Column) -> Column:
    return F.filter(names, lambda n: ~F.lower(n).isin(*K.UNIVERSAL_METAS))


def kept_scripts(sources: Column, tracking: bool, libraries: bool, custom: list[str]) -> Column:
    """Script sources without trackers, libraries or the given parts; inline scripts (null sources) stay."""
    parts = (K.TRACKING_SCRIPTS if tracking else []) + (K.COMMON_LIBRARIES if libraries else []) + [c.lower() for c in custom]
    return F.filter(sources, lambda s: s.isNull() | ~_has(F.lower(s), parts)) if parts else sources


def discriminative(df: DataFrame, headers: Column, metas: Column, scripts: Column, level: str = "conservative", custom: list[str] | None = None) -> DataFrame:
    """df with headers, metas and scripts (arrays) after the filters of a level, and reduction, the share of tokens saved.

    Null arrays count as empty; custom filters apply at every level.
    """
    h, m, t, c = LEVELS[level]
    none = F.array().cast("array<string>")
    before = [F.coalesce(x, none) for x in (headers, metas, scripts)]
    after = [kept_headers(before[0]) if h else before[0], kept_metas(before[1]) if m else before[1], kept_scripts(before[2], t, c, custom or [])]
    tokens = lambda xs: reduce(lambda a, b: a + b, [F.size(x) * n for x, n in zip(xs, TOKENS, strict=True)])
    saved = ratio(tokens(before) - tokens(after), tokens(before))
    sizes = {f"{k}_before": F.size(x) for k, x in zip(("headers", "metas", "scripts"), before, strict=True)}
    return df.withColumns(sizes | {"headers": after[0], "metas": after[1], "scripts": after[2], "reduction": saved})


def context_filter(classified: DataFrame, frequency: Column) -> DataFrame:
    """feature, advice, frequency, filtered: always and never by class, else where the feature is rarer than 2 %."""
    advice = F.col("advice")
    out = F.when(advice == "always-filter", True).when(advice == "never-filter", False).otherwise(frequency < 0.02)
    return classified.select("feature", "advice", F.round(frequency, 6).alias("frequency"), out.alias("filtered"))


def require_sites(obs: DataFrame, least: int = 100) -> DataFrame:
    """obs, or an error on execution if it has fewer sites: a guard that does not run the query to plan it."""
    n = obs.agg(F.count_distinct("site")).scalar()
    return obs.where(F.when(n >= least, True).otherwise(F.raise_error(F.lit(f"fewer than {least} sites")).cast("boolean")))


_QUOTED = r"(?i)(?:fix|solve|resolve|handle|about|explain|understanding)[^.<]{0,80}?(?:404|not found|error)"
V1_BOT = ["checking your browser", "ddos protection by", "please complete the security check", "verify you are human"]
V1_ERROR_TITLES = ["404", "not found", "error", "forbidden", "access denied", "unavailable"]


def reject_reason_v1(status: Column, when: Column, kind: Column, html: Column, title: Column, url: Column, start: str, end: str, page_kind: str = "mainpage") -> Column:
    """The older filter with six reasons, first match: date-range, page-type, invalid-url, error-status, bot-detection, error-page.

    Scripts, styles and the like are taken out before words are looked for, and texts about errors are none.
    """
    text, name = F.lower(stripped(F.coalesce(html, F.lit("")))), F.lower(F.coalesce(title, F.lit("")))
    day = F.coalesce((when >= F.lit(start).cast("timestamp")) & (when < F.lit(end).cast("timestamp")), F.lit(False))
    error = _has(name, V1_ERROR_TITLES) | (text.contains("page not found") & ~text.rlike(_QUOTED))
    return (
        F.when(~day, "date-range").when(F.coalesce(kind, F.lit("")) != page_kind, "page-type").when(~F.coalesce(url.rlike(r"^(?i)https?://[^\s/]+"), F.lit(False)), "invalid-url")
        .when(F.coalesce(status >= 400, F.lit(False)), "error-status").when(_has(text, V1_BOT), "bot-detection").when(error, "error-page")
    )


def stripped(html: Column) -> Column:
    """A page without scripts, styles and elements whose class speaks of 404 or fonts."""
    out = html
    for rx in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<noscript\b.*?</noscript\s*>", r"(?i)\bclass\s*=\s*[\"'][^\"']*(?:404|font)[^\"']*[\"']"):
        out = F.regexp_replace(out, rx, " ")
    return out
