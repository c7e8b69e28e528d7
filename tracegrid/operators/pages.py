"""What a stored page consists of: links, scripts, style sheets, forms, selected elements, addresses of its own domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegrid.functions import catalogue as K

#: A capture stores so many links, scripts and style sheets, and so much of a link's text; counts are of all.
STORED = {"links": 100, "scripts": 50, "stylesheets": 20, "text": 100}
LINK = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>"
LINK_TEXT = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>(.*?)</a\s*>"
SCRIPT = r"(?i)<script\b[^>]*>"
STYLESHEET = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?stylesheet[\"']?[^>]*>"
FORM = r"(?is)<form\b[^>]*>(.*?)</form\s*>"
FIELD = r"(?i)<(?:input|select|textarea)\b[^>]*>"


def all_of(html: Column, pattern: str, group: int = 0) -> Column:
    """Every match of a pattern; none in a null text."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def links(html: Column) -> Column:
    """The first links as structs of href and text, which is cut to what is stored."""
    hrefs, texts = all_of(html, LINK, 1), all_of(html, LINK_TEXT, 1)
    bare = lambda t: F.substring(F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " ")), 1, STORED["text"])
    both = F.arrays_zip(hrefs.alias("href"), F.transform(texts, bare).alias("text"))
    return F.slice(both, 1, STORED["links"])


def scripts(html: Column) -> Column:
    return F.slice(all_of(html, SCRIPT), 1, STORED["scripts"])


def stylesheets(html: Column) -> Column:
    """Addresses of the first style sheets."""
    return F.transform(F.slice(all_of(html, STYLESHEET), 1, STORED["stylesheets"]), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1))


def forms(html: Column) -> Column:
    """Forms as structs of field_count and field_types (each once, sorted); a field without a type is text or its tag."""
    kind = lambda f: F.when(F.lower(f).startswith("<input"), F.coalesce(F.nullif(F.lower(F.regexp_extract(f, r"(?i)\btype\s*=\s*[\"']?([\w-]+)", 1)), F.lit("")), F.lit("text"))).otherwise(F.lower(F.regexp_extract(f, r"<(\w+)", 1)))
    return F.transform(all_of(html, FORM, 1), lambda b: F.struct(F.size(F.regexp_extract_all(b, F.lit(FIELD), F.lit(0))).alias("field_count"), F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(b, F.lit(FIELD), F.lit(0)), kind))).alias("field_types")))


def selector_counts(html: Column) -> Column:
    """selector, count for each of the fixed selectors, zeros included."""
    return F.array(*[F.struct(F.lit(n).alias("selector"), F.size(all_of(html, "(?i)" + rx)).alias("count")) for n, rx in K.SELECTORS])


def _bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def _hits(text: Column, pattern: str, before: int) -> tuple[Column, Column]:
    """Texts that lie before the occurrences of a pattern, and the addresses that hold it."""
    pieces = F.split(text, r"\Q" + pattern + r"\E", -1)
    count = F.size(pieces) - 1
    leads = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.right(F.array_join(F.slice(pieces, 1, i), pattern), F.lit(before)))).otherwise(F.array().cast("array<string>"))
    urls = all_of(text, r"(?i)https?://[^\s\"'<>)]*?\Q" + pattern + r"\E")
    return leads, urls


def own_pattern(text: Column, host: Column, pattern: str) -> Column:
    """Whether a text holds a pattern within an address of the host, or relative, with no address begun in the 50 characters before."""
    leads, urls = _hits(text, pattern, 50)
    same = F.exists(urls, lambda u: _bare_host(F.regexp_extract(u, r"(?i)^https?://([^/:?#\s]+)", 1)) == _bare_host(host))
    return F.coalesce(same | F.exists(leads, lambda x: ~F.lower(x).rlike("https?://")), F.lit(False))


def own_pattern_count(text: Column, host: Column, pattern: str) -> Column:
    """How many occurrences belong to the host: those in its addresses, and those whose token begins no address (100 characters back)."""
    leads, urls = _hits(text, pattern, 100)
    same = F.size(F.filter(urls, lambda u: _bare_host(F.regexp_extract(u, r"(?i)^https?://([^/:?#\s]+)", 1)) == _bare_host(host)))
    free = F.size(F.filter(leads, lambda x: ~F.lower(F.regexp_extract(x, r"(?s)([^\s\"'<>)]*)$", 1)).rlike("https?://")))
    return F.coalesce(same + free, F.lit(0))


def plugins(html: Column) -> Column:
    """Plugins named in paths, each once with the version in its address, as structs of slug and version."""
    slugs = F.array_sort(F.array_distinct(all_of(html, r"/wp-content/plugins/([a-zA-Z0-9_-]+)/", 1)))
    tagged = all_of(html, r"(?i)/wp-content/plugins/[a-zA-Z0-9_-]+/[^\"']*\?ver=[0-9.]+")
    version = lambda s: F.try_element_at(F.transform(F.filter(tagged, lambda t: F.lower(t).contains(F.lower(F.concat(F.lit("/plugins/"), s, F.lit("/"))))), lambda t: F.regexp_extract(t, r"(?i)\?ver=([0-9.]+)", 1)), F.lit(1))
    return F.transform(slugs, lambda s: F.struct(s.alias("slug"), version(s).alias("version")))


def duda_confidence(text: Column) -> Column:
    """Mean of the marks that a page or its scripts hold, plus .1 for each sure one up to .3, at most 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(low.contains(m), F.lit(c)) for m, c in K.DUDA_SCRIPT_MARKS]))
    mean = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / F.size(hits)
    return F.when(F.size(hits) == 0, 0.0).otherwise(F.least(F.lit(1.0), mean + F.least(F.size(F.filter(hits, lambda x: x >= 0.9)) * 0.1, F.lit(0.3))))


def signals(html: Column, headers: Column, generator: Column, sources: Column) -> Column:
    """Telling signals of a capture as structs of signal, tier and platform: scripts, html, headers, cookies, generator."""
    low = F.lower(F.coalesce(html, F.lit("")))
    src = F.coalesce(F.transform(sources, lambda s: F.lower(s)), F.array().cast("array<string>"))
    names = F.coalesce(F.transform(F.map_keys(headers), lambda k: F.lower(k)), F.array().cast("array<string>"))
    cookies = F.lower(F.array_join(F.flatten(F.filter(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "set-cookie")), lambda v: v.isNotNull())), " "))
    in_src = lambda p: F.coalesce(F.exists(src, lambda s: s.contains(p)), F.lit(False))
    gen = F.lower(F.coalesce(generator, F.lit("")))
    rules = [
        ("script:wp-content", "high", "WordPress", in_src("wp-content")), ("script:wp-includes", "high", "WordPress", in_src("wp-includes")), ("script:/sites/", "high", "Drupal", in_src("/sites/")), ("script:/modules/", "high", "Drupal", in_src("/modules/")),
        ("script:/media/jui/js/", "high", "Joomla", in_src("/media/jui/js/")), ("script:/core/", "medium", "Drupal", in_src("/core/")), ("script:/media/", "medium", "Joomla", in_src("/media/")), ("script:/components/", "medium", "Joomla", in_src("/components/")),
        ("script:jquery", "low", "any", in_src("jquery")), ("script:bootstrap", "low", "any", in_src("bootstrap")),
        ("html:wp-content", "high", "WordPress", low.contains("wp-content")), ("html:wp-json", "high", "WordPress", low.contains("wp-json")), ("html:drupal.settings", "high", "Drupal", low.contains("drupal.settings")), ("html:joomla-script-options", "high", "Joomla", low.contains("joomla-script-options")),
        ("html:com_content", "medium", "Joomla", low.contains("com_content")), ("html:drupal.js", "medium", "Drupal", low.contains("drupal.js")),
        ("header:x-pingback", "high", "WordPress", F.array_contains(names, "x-pingback")), ("header:x-drupal-cache", "high", "Drupal", F.array_contains(names, "x-drupal-cache")), ("header:x-generator", "high", "any", F.array_contains(names, "x-generator")), ("header:x-content-encoded-by", "high", "Joomla", F.array_contains(names, "x-content-encoded-by")),
        ("cookie:wordpress", "medium", "WordPress", cookies.contains("wordpress") | cookies.contains("wp-")), ("cookie:drupal", "medium", "Drupal", cookies.contains("drupal")), ("cookie:joomla", "medium", "Joomla", cookies.contains("joomla")), ("cookie:session", "low", "any", cookies.contains("phpsessid") | cookies.contains("sessionid")),
        ("meta:generator", "high", "WordPress", gen.contains("wordpress")), ("meta:generator", "high", "Drupal", gen.contains("drupal")), ("meta:generator", "high", "Joomla", gen.contains("joomla")), ("meta:generator", "low", "any", gen != ""),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("signal"), F.lit(t).alias("tier"), F.lit(p).alias("platform"))) for s, t, p, c in rules]))
