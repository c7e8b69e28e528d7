"""Weak labels for a sample of texts: labelling functions that vote for a class or abstain.

Every function reads the text by rules of its own and knows nothing of the statistics that the model is trained on. A label
needs a clear majority of the votes; a text on which the functions disagree or are silent has none and trains nothing. The
functions know the common words of four languages and may abstain on others; the model, whose statistics name no language,
is what carries their verdicts to all texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

CLASSES = ("prose", "list", "table", "junk")
#: The most common words of the four languages, a few dozen each.
COMMON = frozenset(
    """the of and to in a is was for on that with as by at from it this an be are or which not had has have its but our we so if when after before no into
    der die das und in zu den von mit auf ist war ein eine einer einem nicht für dem des im sich als auch an nach bis weil wie aus bei hat kam noch diese dieses zwei
    de la que el en y a los se del las un por con no una su para es al lo como más pero fue dos este esta o hasta todavía sin sobre
    le les des et à est en du une que pour dans qui pas ce au sur plus par ne se a été cette deux était bien jusqu son ses aux avec ou""".split()
)
_NO_WORD = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"\s*(?:[-*•–—+·▪◦‣]\s+|\d{1,3}[.)]\s+|\[[ xX]?\]\s+|\([a-z0-9]{1,2}\)\s+)")
_LOCATION = re.compile(r"\s*(?:https?://\S+|/[\w*./?=&%-]*)[.,;]?\s*")
_PAIR = re.compile(r"\s*[\w.-]{1,40}\s*[:=]\s+\S.{0,80}")
_DIRECTIVE = re.compile(r"\s*(?:user-agent|allow|disallow|sitemap|crawl-delay|host|noindex)\s*:", re.I)
_BORDER = re.compile(r"[\s+|:=-]*[+|][\s+|:=-]*")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_CODE = re.compile(r"function\b|\bvar\b|\breturn\b|=>|[{}]|;(?=\S)|\)\s*\{|_0x[0-9a-f]+|[\w\])]\[|!0|\bdef\b|\bimport\b|&&|\|\|")
_CODE_HINT = re.compile(r"[{}()\[\]=|&]")
_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|&#x?[0-9a-fA-F]+;|�")
_MOJIBAKE = re.compile(r"Ã[\x80-\xbf¤¨©¼¶¡±³­ºŸ§]?|â€|Â[\xa0-\xbf]|Ð|Ñ[\x80-\xbf]")
_BROKEN_HINT = re.compile(r"[ÃâÂÐÑ]")
_IS_VOWEL = np.array([chr(i).lower() in "aeiouyàâäáãåèéêëìíîïòóôöõùúûüœæ" for i in range(0x250)])
_SENTENCE = re.compile(r"[A-ZÀ-ÖØ-Þ][^.!?\n|\t]*[.!?]")
_UNIT = re.compile(r"(.{1,8}?)\1{5,}.{0,8}")
_CELLS = (("\t", re.compile(r"\t")), ("|", re.compile(r"\s*\|\s*")), (";", re.compile(r";")), (",", re.compile(r",")), ("/", re.compile(r" / ")), ("  ", re.compile(r" {2,}")))
_CLAUSE = re.compile(r"[a-z'][.,;:!?] |[a-z][.!?]$")
_FULL = str.maketrans({".": "。", ",": "，", "!": "！", "?": "？", ";": "；", ":": "："})
_ITEMS = re.compile(r"\s*[;,•|·]\s*")


def _row_items(line: str) -> bool:
    """Whether a line sets out short items one after another."""
    parts = [p for p in _ITEMS.split(line.strip(" .;,")) if p]
    if len(parts) < 3:
        return False
    words = [len(p.split()) for p in parts]
    return max(words) <= 6 and sum(words) <= 3.2 * len(parts) and sum(w.lower() in COMMON for p in parts for w in p.split()) <= 0.15 * sum(words)


def _marks(line: str) -> tuple[int, int, int, int]:
    """Escapes, characters of broken encodings, characters of tags, and signs of code in a line."""
    escapes = len(_ESCAPE.findall(line)) if "\\" in line or "\ufffd" in line or "&#" in line else 0
    broken = sum(map(len, _MOJIBAKE.findall(line))) if _BROKEN_HINT.search(line) else 0
    tags = sum(map(len, _TAG.findall(line))) if "<" in line else 0
    return escapes, broken, tags, len(_CODE.findall(line)) if _CODE_HINT.search(line) else 0


def _vowels(text: str) -> int:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return int(_IS_VOWEL[codes[codes < 0x250]].sum())


def _is_junk(line: str, tokens: list[str], words: list[str], common: int, marks: tuple[int, int, int, int]) -> tuple[bool, bool]:
    """Whether a line is damaged, encoded, code or endless repetition; and whether it is words at random."""
    n = len(line)
    escapes, broken, tags, code = marks
    if escapes * 6 > 0.3 * n or broken > 0.02 * n or tags > 0.4 * n:
        return True, False
    longest = max(tokens, key=len)
    if len(longest) >= 40 and len(longest) > 0.4 * n and not _LOCATION.fullmatch(longest):
        return True, False
    if len(set(line)) <= 16 and _UNIT.fullmatch(line):
        return True, False
    letters = sum(map(len, words))
    if n >= 12 and letters < 0.3 * n and sum(c.isdigit() for c in line) < 0.5 * n and not _BORDER.fullmatch(line):
        return True, False
    if n >= 40 and code > n / 25:
        return True, False
    # Endless repetition: a handful of tokens, however long the line; a long text with few words of its own is not it.
    if len(tokens) >= 6 and len({t.lower().strip(".,;!") for t in tokens}) <= min(3, len(tokens) / 4) and not _row_items(line):
        return True, False
    # Words at random: no common word and nothing that a sentence has, stops and capitals; unknown languages have these.
    if len(words) >= 5 and common < 0.1 * len(words) and line.isascii() and not _CLAUSE.search(line):
        if _vowels(line) < 0.3 * letters:
            return True, False
        marked = len(re.findall(r"[;,:|/•]\s|\t| {2,}", line))
        if len(words) >= 10 and marked < len(tokens) / 8:
            return True, True
    return False, False


def parts(text: str) -> dict[str, float]:
    """The share of a text's characters in lines that the rules take for prose, list items, rows or junk."""
    raw = [x for x in text.splitlines() if x.strip()]
    lines = [x.strip() for x in raw]
    m = len(lines)
    per_line = [_WORD.findall(x.lower()) for x in lines]
    per_tokens = [x.split() for x in lines]
    # Columns: the delimiter by which most characters lie in neighbouring lines with equally many cells, three at least.
    best, row = 0, [False] * m
    for mark, cut in _CELLS:
        if mark not in text:
            continue
        cells = [len([c for c in cut.split(x.strip("| ") if mark == "|" else x) if c != ""]) if mark in x else 0 for x in lines]
        wide = [len(x) / max(1, c) <= 40 for x, c in zip(lines, cells)]
        body = [i for i in range(m) if not _BORDER.fullmatch(lines[i])]
        hit = [False] * m
        for a, b in zip(body, body[1:]):
            if cells[a] == cells[b] >= 3 and wide[a] and wide[b] and not _BULLET.match(lines[a]):
                hit[a] = hit[b] = True
        if mark in ("|",) and any(hit):
            hit = [h or bool(_BORDER.fullmatch(x)) for h, x in zip(hit, lines)]
        size = sum(len(x) for x, h in zip(lines, hit) if h)
        # Commas and semicolons with blanks set out items in running text; as columns they stand close.
        if mark in ",;" and size and sum(x.count(mark + " ") for x, h in zip(lines, hit) if h) > 0.5 * sum(x.count(mark) for x, h in zip(lines, hit) if h):
            continue
        if size > best:
            best, row = size, hit
    pairs = [(":" in x or "=" in x) and len(x) <= 130 and bool(_PAIR.fullmatch(x)) and not _DIRECTIVE.match(x) and not _BULLET.match(x) and not x.lower().startswith("http") and len(x.split()) <= 6 for x in lines]
    n_pairs = sum(pairs)
    marks = [_marks(x) for x in lines]
    part = Counter()
    short = [len(x.split()) <= 4 for x in lines]
    for i, x in enumerate(lines):
        size = len(x)
        w = per_line[i]
        common = sum(1 for t in w if t in COMMON)
        bullet, place, rule = bool(_BULLET.match(raw[i])), bool(_LOCATION.fullmatch(x)), bool(_DIRECTIVE.match(x))
        junk, salad = _is_junk(x, per_tokens[i], w, common, marks[i])
        items = _row_items(x)
        if row[i]:
            kind = "table"
        elif pairs[i] and n_pairs >= 2:
            kind = "table"
        elif bullet or place or rule:
            kind = "list"
        elif junk and not (items and salad):
            kind = "junk"
        elif items:
            kind = "list"
        elif len(w) >= 4 and common >= 0.15 * len(w):
            kind = "prose"
        elif short[i] and m >= 3 and common == 0 and ((i and short[i - 1]) or (i + 1 < m and short[i + 1])):
            kind = "list"
        elif len(w) >= 4:
            kind = "prose"
        else:
            kind = "other"
        part[kind] += size
    total = sum(map(len, lines))
    return {k: v / total for k, v in part.items()}


def by_lines(text: str) -> str | None:
    """The class of most lines, if it is clear."""
    p = sorted(parts(text).items(), key=lambda x: -x[1])
    if not p or p[0][0] == "other" or p[0][1] < 0.5 or (len(p) > 1 and p[0][1] - p[1][1] < 0.12):
        return None
    return p[0][0]


def is_damaged(text: str) -> bool:
    """Whether an encoding was taken for another one somewhere in the text."""
    return bool(_BROKEN_HINT.search(text)) and sum(map(len, _MOJIBAKE.findall(text))) > 0.005 * len(text)


def by_sentences(text: str) -> str | None:
    """Prose, if most of the text lies in sentences of five words and more that begin with a capital and end in a stop."""
    if is_damaged(text):
        return None
    long = sum(len(s) for s in _SENTENCE.findall(text) if s.count(" ") >= 4 and not (_CODE_HINT.search(s) and _CODE.search(s)))
    return "prose" if long > 0.7 * len(text.strip()) else None


def by_words(text: str) -> str | None:
    """Prose, if common words make up a quarter of words on long lines."""
    words = _WORD.findall(text.lower())
    lines = [x for x in text.splitlines() if x.strip()]
    if is_damaged(text):
        return None
    if len(words) >= 8 * len(lines) and sum(w in COMMON for w in words) >= 0.25 * len(words):
        return "prose"
    return None


def by_alphabet(text: str) -> str | None:
    """Junk, if the characters of the text are few, or hardly any are letters, digits or blanks."""
    bare = "".join(text.split())
    if len(bare) >= 20 and (len(set(bare)) <= 4 or len(_NO_WORD.sub("", bare)) < 0.35 * len(bare)):
        return "junk"
    return None


def label(text: str) -> int:
    """The index of the class that the functions agree on; -1 if two classes have votes or none has."""
    # Two votes for prose settle it, without the dearer look at lines.
    cheap = (by_words(text), by_sentences(text))
    if all(cheap):
        return 0
    votes = {*cheap, by_lines(text), by_alphabet(text)} - {None}
    return CLASSES.index(votes.pop()) if len(votes) == 1 else -1


def varied(text: str) -> list[str]:
    """Prose as other languages would set it: with hardly any short words, and in characters without spaces between them.

    The functions know only languages with many short words; the model learns from these variants that prose can do without.
    """
    words = text.split(" ")
    longer = " ".join(w for w in words if sum(c.isalpha() for c in w) > 3 or not w.isalpha())
    wide = "".join(_wide(w) for w in words)
    return [longer, wide]


def _wide(word: str) -> str:
    """A word as one or two ideographs, picked by a hash of its letters, with the marks around it."""
    bare = word.rstrip(".,;:!?\n")
    tail = word[len(bare) :].translate(_FULL)
    h = zlib.crc32(bare.lower().encode("utf-8", "replace"))
    return "".join(chr(0x4E00 + (h >> s) % 1500) for s in ((0,) if len(bare) < 4 else (0, 11))) + tail
