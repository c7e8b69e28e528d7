"""Records that hold template residue, filler or an error page instead of content.

A record is cut into blocks (titles and headings, paragraphs, comments, metadata values), each normalised and hashed. Blocks
are counted by host over all records; those that recur there are boilerplate and are subtracted, in every role. What is left
is the residual: what this record says and its neighbours do not. The residual decides:

* placeholder or filler in any block of it;
* an error, outage, refusal or scripts-required message as a title or heading of it;
* such messages as all of its paragraphs.

What is evidence in a block is told by ``evidence``. A notice in ``noscript`` beside content and rules of a robots file are
content, so a message beside them is not all that the record says.

Cutting and judging need nested context that SQL functions cannot see, so they run in Python over Arrow batches; counting
and subtracting are joins on 64-bit hashes of blocks. A record without evidence in any block is no case whatever recurs, so
only the others meet the counts.

Defined cases: null and unreadable records, null and empty containers hold no residue; rows repeated in full are one
owner; a record whose blocks all recur keeps them as its residual; texts of any length are read whole; a null host is a
host of its own.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm import evidence
from tracegrid.llm.evidence import FILLER_BIT, MESSAGE_BIT, PLACEHOLDER_BIT, is_filler, is_message, is_placeholder  # noqa: F401
from tracegrid.session import cut

RECURS_ON = 5
RECURS_SHARE = 0.2
TITLE, PARAGRAPH, COMMENT, VALUE = range(4)

_PIECE = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)[^<>]*>|<![^<>]*>", re.S)
_BLANK_LINE = re.compile(r"\n\s*\n")
_SKIPPED = frozenset("script style code pre template svg textarea".split())
_INLINE = frozenset("a b i em strong span u small sup sub mark abbr q cite font wbr".split())
_HEADINGS = frozenset(("title", "h1", "h2", "h3"))
_FRAMES = frozenset(("nav", "footer"))
_DIRECTIVE = re.compile(r"\s*(?:user-agent|disallow|allow|sitemap|crawl-delay|host|clean-param|noindex)\s*:", re.I)
_IS_PAGE = re.compile(r"<(?:!doctype|html|head|body)\b", re.I)
_DIGITS = re.compile(r"\d+")


def plain(text: str) -> str:
    """Text without character references and with single blanks."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


def html_blocks(text: str) -> tuple[list[str], list[str], list[str]]:
    """Titles and headings, other blocks of the page, and comments, in one pass over its tags.

    Scripts, styles and code are left out. Navigation, footers and noscript are blocks of their own only if the page has no
    other; a tag that is a placeholder (<your name>) is text.
    """
    heads: list[str] = []
    main: list[str] = []
    spare: list[str] = []
    comments: list[str] = []
    held: list[str] = []
    skip = frame = noscript = None
    head = False
    at = 0

    def close() -> None:
        if not held:
            return
        whole = "".join(held)
        held.clear()
        if frame:
            return
        where = heads if head else spare if noscript else main
        for part in _BLANK_LINE.split(whole) if "\n" in whole else (whole,):
            t = plain(part)
            if t:
                where.append(t)

    for m in _PIECE.finditer(text):
        name = m.group(3)
        low = name.lower() if name else ""
        if skip:
            if low == skip and m.group(2):
                skip, at = None, m.end()
            continue
        if m.start() > at:
            held.append(text[at : m.start()])
        at = m.end()
        if m.group(1) is not None:
            t = plain(m.group(1))
            if t:
                comments.append(t)
        elif not name:
            continue
        elif low in ("your", "insert", "enter", "my") and not m.group(2):
            held.append(f"‹{m.group()[1:-1]}›")
        elif low in _INLINE:
            continue
        elif low in _SKIPPED:
            held.append(" ")
            if not m.group(2) and not m.group().endswith("/>"):
                skip = low
        else:
            close()
            if low in _HEADINGS:
                head = not m.group(2)
            elif low in _FRAMES:
                frame = not m.group(2)
            elif low == "noscript":
                noscript = not m.group(2)
    if not skip and at < len(text):
        held.append(text[at:])
    close()
    return heads, main or spare, comments


def robots_blocks(text: str) -> tuple[list[str], list[str], list[str]]:
    """Heads, blocks and comments of what was stored as robots.txt; directives are content of their own."""
    if _IS_PAGE.search(text):
        return html_blocks(text)
    blocks, comments, directives = [], [], False
    for line in text.splitlines():
        if _DIRECTIVE.match(line):
            directives = True
        elif line.lstrip().startswith("#"):
            comments.append(" ".join(line.strip().lstrip("#").split()))
        elif line.strip():
            blocks.append(" ".join(line.split()))
    comments = [c for c in comments if c]
    # Without a directive a comment is all the file says.
    return ([], blocks if directives else blocks + comments, comments)


_OUT = "owner_table string, owner_id bigint, host string, rules boolean, blocks array<struct<h:bigint,role:int,evidence:int>>"
_BLOCK = pa.struct([("h", pa.int64()), ("role", pa.int32()), ("evidence", pa.int32())])


def _hash(block: str) -> int:
    v = xxhash.xxh64_intdigest(_DIGITS.sub("0", block.lower()))
    return v - (1 << 64) if v >> 63 else v


_HOST = re.compile(r"\s*(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:\s]+)", re.I)


def _host(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else None


def judge(heads: list[str], blocks: list[str], comments: list[str], values: list[str]) -> list[tuple[int, int, int]]:
    """Hash, role and kinds of evidence of each block, once each."""
    roles = ((heads, TITLE), (blocks, PARAGRAPH), (comments, COMMENT), (values, VALUE))
    return [(_hash(t), role, evidence.of_block(t, role == TITLE)) for texts, role in roles for t in dict.fromkeys(texts)]


def _judged(owner_table: str):
    def one(row: dict) -> tuple[list[tuple[int, int, int]], bool]:
        if owner_table == "captures":
            heads, blocks, comments = html_blocks(row["text"]) if row["text"] else ([], [], [])
            meta = [(k or "", plain(v)) for k, v in row["meta"] or [] if v]
            is_title = lambda k: k.lower().rsplit(":", 1)[-1] == "title"
            return judge(heads + [v for k, v in meta if v and is_title(k)], blocks, comments, [v for k, v in meta if v and not is_title(k)]), False
        text = robots_text(row["text"])
        if not text:
            return [], False
        heads, blocks, comments = robots_blocks(text)
        # Rules are real content, so a message beside them is not the main one, however many neighbours have rules too.
        return judge(heads, blocks, comments, []), any(_DIRECTIVE.match(x) for x in text.splitlines())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            found = [one(r) for r in rows]
            ends = [0]
            for x, _ in found:
                ends.append(ends[-1] + len(x))
            flat = [y for x, _ in found for y in x]
            parts = [pa.array([y[i] for y in flat], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_BLOCK)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([owner_table] * len(rows), pa.string()), b.column(0), pa.array([_host(r["url"]) for r in rows], pa.string()), pa.array([r for _, r in found], pa.bool_()), lists],
                ["owner_table", "owner_id", "host", "rules", "blocks"],
            )

    return run


def robots_text(document: str | None) -> str | None:
    """The content of a stored robots analysis; null if there is none or the document cannot be read."""
    if not document:
        return None
    try:
        doc = json.loads(document)
        if isinstance(doc, str):
            doc = json.loads(doc)
    except ValueError:
        return None
    text = doc.get("content") if isinstance(doc, dict) else None
    return text if isinstance(text, str) else None


def judged_captures(df: DataFrame, owner_id: Column, url: Column, metadata: Column, html_content: Column) -> DataFrame:
    rows = df.select(owner_id.alias("owner_id"), url.alias("url"), metadata.alias("meta"), html_content.alias("text"))
    return rows.mapInArrow(_judged("captures"), _OUT)


def judged_robots(df: DataFrame, owner_id: Column, url: Column, document: Column) -> DataFrame:
    rows = df.select(owner_id.alias("owner_id"), url.alias("url"), document.alias("text"))
    return rows.mapInArrow(_judged("site_analyses"), _OUT)


def boilerplate(judged: DataFrame) -> DataFrame:
    """owner_table, host, h: blocks that recur on at least RECURS_ON records and RECURS_SHARE of the records of a host.

    Copies of a record count once. A hot host sends one partial count per block and task.
    """
    once = judged.select("owner_table", "host", "owner_id", F.array_distinct("blocks.h").alias("hs")).groupBy("owner_table", "host", "owner_id").agg(F.max("hs").alias("hs"))
    rows = once.select("owner_table", "host", F.explode(F.array_append("hs", F.lit(None).cast("bigint"))).alias("h"))
    n = rows.groupBy("owner_table", "host", "h").agg(F.count(F.lit(1)).alias("n"))
    # The row without a block counts the records of the host.
    records = n.where("h is null").select(F.col("owner_table").alias("_t"), F.col("host").alias("_host"), F.col("n").alias("records"))
    lines = n.where((F.col("n") >= RECURS_ON) & F.col("h").isNotNull())
    return lines.join(records, (F.col("owner_table") == F.col("_t")) & F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") >= F.col("records") * RECURS_SHARE).select("owner_table", "host", "h")


def residuals(judged: DataFrame) -> DataFrame:
    """owner_table, owner_id, rules, blocks, recurring: the records with any evidence; recurring are hashes to subtract."""
    judged = cut(judged)
    suspects = judged.where("exists(blocks, b -> b.evidence > 0)")
    asked = suspects.select("owner_table", "owner_id", "host", F.explode("blocks.h").alias("h"))
    known = boilerplate(judged).withColumnsRenamed({"owner_table": "_t", "host": "_host", "h": "_h"})
    on = (F.col("owner_table") == F.col("_t")) & F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h"))
    hit = asked.join(known, on, "left_semi").groupBy(F.col("owner_table").alias("_t"), F.col("owner_id").alias("_id")).agg(F.collect_set("h").alias("recurring"))
    rows = suspects.join(hit, (F.col("owner_table") == F.col("_t")) & F.col("owner_id").eqNullSafe(F.col("_id")), "left")
    return rows.select("owner_table", "owner_id", "rules", "blocks", F.coalesce("recurring", F.array().cast("array<bigint>")).alias("recurring"))


def verdicts(judged: DataFrame) -> DataFrame:
    """owner_table, owner_id, reason, subtracted: 'placeholder', 'filler', 'title', 'page' for what the residual shows.

    subtracted tells whether boilerplate had to go for it.
    """
    left = residuals(judged).withColumn("rest", F.filter("blocks", lambda b: ~F.array_contains(F.col("recurring"), b["h"])))
    left = left.withColumn("rest", F.when(F.size("rest") == 0, F.col("blocks")).otherwise(F.col("rest")))
    bit = lambda b, k: b["evidence"].bitwiseAND(k) > 0
    text = lambda bs: F.filter(bs, lambda b: b["role"] == PARAGRAPH)
    whole = lambda bs: ~F.col("rules") & (F.size(text(bs)) > 0) & F.forall(text(bs), lambda b: bit(b, MESSAGE_BIT))
    reason = (
        F.when(F.exists("rest", lambda b: bit(b, PLACEHOLDER_BIT)), "placeholder")
        .when(F.exists("rest", lambda b: bit(b, FILLER_BIT)), "filler")
        .when(F.exists("rest", lambda b: (b["role"] == TITLE) & bit(b, MESSAGE_BIT)), "title")
        .when(whole(F.col("rest")), "page")
    )
    found = left.withColumn("reason", reason).where("reason is not null")
    return found.select("owner_table", "owner_id", "reason", ((F.col("reason") == "page") & ~whole(F.col("blocks"))).alias("subtracted"))


def residue(judged: DataFrame) -> DataFrame:
    """owner_table, owner_id of the records whose residual holds residue, once each."""
    return verdicts(judged).select("owner_table", "owner_id").distinct()
