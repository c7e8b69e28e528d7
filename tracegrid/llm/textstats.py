"""Statistics of texts that name no language and no script, computed for a whole batch of texts at once.

The texts of a batch are laid end to end as code points. A table gives each its Unicode class; everything else is sums over
the segments of that array that make up tokens, lines and texts. No loop runs over characters, tokens or lines, so the cost
of a text is that of reading it. Scripts without spaces between words are cut into tokens of two characters.

Letters of alphabets are judged by how unevenly they occur (the index of coincidence times the size of the alphabet used), which is 1 for
letters drawn at random and well above it for writing in any alphabet, and words by how much shorter the repeated ones are.

Defined cases: a blank text has zeros; texts of any length are read whole; code points that are no characters count as odd.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Characters of a chunk, so that its arrays stay in cache; a longer text is a chunk of its own.
CHUNK = 1 << 18
_STOPS = ".!?…。！？｡।؟۔։"
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: The names that begin the lines of a robots.txt.
DIRECTIVES = ("user-agent", "allow", "disallow", "sitemap", "crawl-delay", "host", "noindex")
#: Classes of characters. What comes before BLANK_END is white space, letters lie between LETTERS and LETTERS_END.
BREAK, BLANK, TAB, OTHER_SPACE, LOWER, CAPITAL, ACCENT, ACCENT_CAPITAL, WIDE, DIGIT, STOP, HIGH, ODD, MARK, OPEN = range(15)
_OWN = {c: 15 + i for i, c in enumerate(",;|/:=<>&\\+•·-")}
_OWN["，"] = _OWN["、"] = _OWN[","]
_OWN["；"] = _OWN[";"]
CLASSES = 32
BINS = 512
#: The coincidence of most writing in letters.
USUAL = 1.5

NAMES = (
    "log_chars log_lines words_per_line letters digits marks upper odd accents_broken escapes in_tags code top_char coincidence word_length word_spread long_tokens very_long_tokens "
    "short_words distinct repeated_shorter most_frequent echo line_repeats stops_per_word wordy_lines short_lines one_word_lines stopped_lines sentence_lines led_lines slash_lines directive_lines "
    "pair_lines same_start columns columns_tab columns_bar columns_gap columns_slash columns_close item_lines separators number_words mixed_words capital_words line_spread code_lines tag_lines "
    "plain_words wordy_unmarked"
).split()


def _is_wide(c: int) -> bool:
    """Whether a letter belongs to a script that sets no spaces between words."""
    ranges = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3000), (0x3005, 0x3130), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0))
    return any(a <= c < b for a, b in ranges)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, bin and hash of the characters of the basic plane. Letters of either case share bin and hash."""
    kinds, bins, hashes = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)
    random = np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)
    for c in range(1 << 16):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if ch in _BREAKS:
            k = BREAK
        elif ch in _OWN:
            k = _OWN[ch]
        elif ch in "{}()[]$_^~`@#%":
            k = OPEN
        elif ch.isspace():
            k = BLANK if c == 32 else TAB if c == 9 else OTHER_SPACE
        elif kind[0] in "LM":
            up = kind in ("Lu", "Lt")
            k = WIDE if _is_wide(c) else ((ACCENT_CAPITAL if up else ACCENT) if 0xC0 <= c < 0x100 else CAPITAL if up else LOWER)
        elif kind[0] == "N":
            k = DIGIT
        elif kind[0] in "PS" and c != 0xFFFD:
            k = STOP if ch in _STOPS else HIGH if c >= 0x80 else MARK
        else:
            k = MARK if kind == "Cf" else ODD
        kinds[c] = k
        low = ord(ch.lower()) if len(ch.lower()) == 1 and ord(ch.lower()) < 1 << 16 else c
        if LOWER <= k < WIDE and not 0xAC00 <= c < 0xD7B0:
            bins[c] = 1 + low % 255
        elif k > OTHER_SPACE:
            bins[c] = 256 + c % 256
        if LOWER <= k <= DIGIT:
            hashes[c] = random[low]
    return kinds, bins, hashes


def _hash_of(word: str) -> int:
    _, _, hashes = _tables()
    v = hashes[[ord(c) for c in word]]
    return int((v * np.arange(1, len(word) + 1, dtype=np.uint64)).sum(dtype=np.uint64))


@cache
def _directive_hashes() -> np.ndarray:
    return np.array([_hash_of(x) for x in DIRECTIVES], np.uint64)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of NAMES per text."""
    out = np.zeros((len(texts), len(NAMES)))
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > CHUNK or i - first >= 1 << 15):
            out[first:i] = _chunk(texts[first:i])
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        out[first:] = _chunk(texts[first:])
    return out


def _chunk(texts: list[str]) -> np.ndarray:
    kind_of, bin_of, hash_of = _tables()
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    far = codes > 0xFFFF
    basic = np.minimum(codes, 0xFFFF)
    kind = kind_of[basic]
    if far.any():
        kind = np.where(codes >= 0x20000, np.uint8(WIDE), np.where(far, np.uint8(HIGH), kind))
    n_docs, n = len(texts), len(codes)
    doc_end = np.cumsum(lengths) - 1
    chars = np.maximum(1, lengths - 1).astype(float)
    space = kind <= OTHER_SPACE
    letter = (kind >= LOWER) & (kind <= WIDE)

    # Tokens: from a solid character after a space to the last before one; wide letters by twos.
    start = ~space
    start[1:] &= space[:-1]
    wide = kind == WIDE
    if wide.any():
        idx = np.flatnonzero(wide)
        run = np.ones(len(idx), bool)
        run[1:] = np.diff(idx) > 1
        pos = idx - np.maximum.accumulate(np.where(run, idx, 0))
        start[idx[pos % 2 == 0]] = True
        start[np.flatnonzero(wide[:-1] & letter[1:] & ~wide[1:]) + 1] = True
    t_at = np.flatnonzero(start)
    if not len(t_at):
        return np.zeros((n_docs, len(NAMES)))
    stop = ~space
    stop[:-1] &= space[1:] | start[1:]
    t_end = np.flatnonzero(stop)
    t_len = t_end - t_at + 1
    place = np.arange(n, dtype=np.uint64)
    h = hash_of[basic]
    t_sum = np.add.reduceat(h, t_at)
    t_hash = np.add.reduceat(h * place, t_at) - t_sum * (t_at.astype(np.uint64) - np.uint64(1))
    bare = t_hash == 0
    # A token of marks alone is told by its length and its first and last mark.
    t_hash[bare] = (codes[t_at[bare]].astype(np.uint64) << np.uint64(42)) ^ (codes[t_end[bare]].astype(np.uint64) << np.uint64(21)) ^ t_len[bare].astype(np.uint64)
    count = np.cumsum(letter, dtype=np.int32)
    t_letters = count[t_end] - count[t_at] + letter[t_at]
    digit = kind == DIGIT
    count = np.cumsum(digit, dtype=np.int32)
    t_digits = count[t_end] - count[t_at] + digit[t_at]
    t_doc = np.searchsorted(doc_end, t_at)
    t_last, t_lastc, t_head = kind[t_end], codes[t_end], kind[t_at]
    n_tokens = np.bincount(t_doc, minlength=n_docs).astype(float)
    tokens = np.maximum(1, n_tokens)

    # Lines that are not blank, and how many characters of each class they have.
    breaks = np.flatnonzero(kind == BREAK)
    line_start = np.concatenate([[0], breaks[:-1] + 1])
    held = np.bincount(np.repeat(np.arange(len(breaks)) * CLASSES, breaks - line_start + 1) + kind, minlength=len(breaks) * CLASSES).reshape(-1, CLASSES)
    of_doc = np.add.reduceat(held, np.searchsorted(breaks, np.concatenate([[0], doc_end[:-1] + 1])), axis=0).astype(float)
    l_first = np.searchsorted(t_at, line_start)
    l_tokens = np.diff(np.concatenate([l_first, [len(t_at)]]))
    keep = l_tokens > 0
    ends, l_start, held, l_first, l_tokens = breaks[keep], line_start[keep], held[keep], l_first[keep], l_tokens[keep]
    l_doc = np.searchsorted(doc_end, ends)
    m = len(ends)
    t_sizes = np.cumsum(t_len)
    last_tok = l_first + l_tokens - 1
    l_size = (t_sizes[last_tok] - t_sizes[l_first] + t_len[l_first] + l_tokens - 1).astype(float)
    doc_size = np.maximum(1.0, np.bincount(l_doc, l_size, n_docs))
    n_lines = np.maximum(1, np.bincount(l_doc, minlength=n_docs)).astype(float)

    def share_of(lines: np.ndarray) -> np.ndarray:
        """The share of a text's characters that lie in such lines."""
        return np.bincount(l_doc, l_size * lines, n_docs) / doc_size

    def per_line(at: np.ndarray) -> np.ndarray:
        """How many of the places each line has; places on blank lines are not counted."""
        line = np.minimum(np.searchsorted(ends, at), m - 1)
        return np.bincount(line[(l_start[line] <= at) & (at <= ends[line])], minlength=m)

    def places(c: str) -> np.ndarray:
        return np.flatnonzero(kind == _OWN[c])

    l_letters = held[:, LOWER : WIDE + 1].sum(1)
    stopped = t_last[last_tok] == STOP
    # A closing quote or bracket may follow the stop.
    closed = np.isin(t_lastc[last_tok], [34, 39, 41, 0x201D, 0x2019, 0xBB, 0x300D]) & (t_len[last_tok] > 1)
    stopped |= closed & (kind[np.maximum(0, t_end[last_tok] - 1)] == STOP)
    wordy = (l_tokens >= 6) & (l_letters >= 0.6 * l_size)
    head, headc, lead_len = t_head[l_first], codes[t_at[l_first]], t_len[l_first]
    second = letter[np.minimum(n - 1, t_at[l_first] + 1)]
    more = l_tokens >= 2
    led = (lead_len <= 4) & (t_letters[l_first] <= 1) & (head > DIGIT) & (head != ODD) & ~second & (headc != 0x2026)
    led |= (lead_len <= 4) & (t_digits[l_first] == lead_len - 1) & (lead_len >= 2) & np.isin(t_lastc[l_first], [41, 46])
    led = (led | ((headc == 91) & (lead_len <= 3))) & more
    slashes = held[:, _OWN["/"]]
    one = l_tokens == 1
    lead_hash = t_hash[np.minimum(len(t_hash) - 1, l_first + led)]
    colon = (t_last[l_first] == _OWN[":"]) & (lead_len > 1)
    directive = colon & np.isin(t_hash[l_first], _directive_hashes())
    equals = held[:, _OWN["="]] + held[:, _OWN[":"]]
    pair = (colon | ((equals == 1) & (l_tokens <= 3) & (slashes == 0))) & more & (l_tokens <= 6) & ~directive & ~led & (l_size <= 140)
    near = np.zeros(m, bool)
    near[1:] = l_doc[1:] == l_doc[:-1]

    def beside(same: np.ndarray) -> np.ndarray:
        """Lines for which the test of a line against the one before holds on either side; same[i] is that of i and i - 1."""
        same = same & near
        out = same.copy()
        out[:-1] |= same[1:]
        return out

    def regular(cells: np.ndarray, least: int = 2) -> np.ndarray:
        same = np.zeros(m, bool)
        same[1:] = (cells[1:] == cells[:-1]) & (cells[1:] >= least)
        return beside(same)

    same_start = np.zeros(m, bool)
    same_start[1:] = lead_hash[1:] == lead_hash[:-1]
    same_start = beside(same_start) & more
    after = np.concatenate([kind[1:], [BREAK]])
    seps = np.sort(np.concatenate([places(","), places(";")]))
    n_tight = per_line(seps[after[seps] > OTHER_SPACE])
    parts = np.concatenate([places("|"), places("•"), places("·")])
    parts = parts[(after[parts] <= OTHER_SPACE) & (after[parts] != BREAK) & (np.concatenate([[BREAK], kind])[parts] <= OTHER_SPACE)]
    # A separator at the end of a line sets nothing apart from anything.
    n_loose = per_line(seps[(after[seps] <= OTHER_SPACE) & (after[seps] != BREAK)]) + per_line(parts)
    n_bar, n_tab = held[:, _OWN["|"]], held[:, TAB]
    # A gap is where a token starts after two blanks or more on its line.
    g = t_at[t_at >= 2]
    g = g[(kind[g - 1] == BLANK) & (kind[g - 2] == BLANK)]
    n_gap = per_line(g)
    n_gap -= (kind[l_start] == BLANK) & (kind[np.minimum(n - 1, l_start + 1)] == BLANK)
    sl = places("/")
    sl = sl[(after[sl] == BLANK) & (np.concatenate([[BREAK], kind])[sl] == BLANK)]
    n_slash = per_line(sl)
    # Rules between the rows of a table have no letters; they belong to the rows they part.
    ruled = (l_letters == 0) & (held[:, DIGIT] == 0) & (n_bar + held[:, _OWN["+"]] > 1)
    barred = n_bar >= 2
    bars = regular(n_bar) | (ruled & (beside(np.concatenate([[False], barred[:-1]])) | beside(barred)))
    tabs, gaps, slash_cols = regular(n_tab, 1), regular(n_gap) & (l_tokens <= 3 * (n_gap + 1)), regular(n_slash)
    close = regular(n_tight) & (n_loose <= n_tight)
    columns = bars | tabs | gaps | slash_cols | close
    items = (n_loose >= 2) & (l_tokens <= 3.5 * (n_loose + 1)) & ~columns
    codey = held[:, OPEN] + held[:, [_OWN[c] for c in ";|=<>&\\"]].sum(1)
    code_line = (codey > l_size / 12) & ~led & ~columns

    # Characters within <...> on a line.
    lt, gt = places("<"), places(">")
    tagged = np.zeros(m)
    if len(lt) and len(gt):
        near_gt = gt[np.minimum(len(gt) - 1, np.searchsorted(gt, lt))]
        line = np.minimum(np.searchsorted(ends, lt), m - 1)
        good = (near_gt > lt) & (near_gt <= ends[line]) & (near_gt < np.concatenate([lt[1:], [n]]))
        tagged = np.bincount(line[good], (near_gt - lt + 1)[good], m)

    # Damage: an accented letter and a mark or capital that no alphabet puts behind it; escapes.
    acc = np.flatnonzero((kind == ACCENT) | (kind == ACCENT_CAPITAL))
    nxt, nxtc = after[acc], codes[np.minimum(n - 1, acc + 1)]
    broken = acc[(nxt == HIGH) | (nxt == ODD) | ((nxtc >= 0x80) & (nxtc < 0xC0)) | ((nxt == ACCENT_CAPITAL) & (kind[acc] == ACCENT)) | ((codes[acc] < 0xE0) & np.isin(nxtc, [0x20AC, 0x178, 0x153, 0x160, 0x161]))]
    esc = np.concatenate([places("\\"), places("&")])
    nxtc = codes[np.minimum(n - 1, esc + 1)]
    esc = esc[np.where(codes[esc] == 92, (nxtc == 117) | (nxtc == 120), nxtc == 35)]
    doc_at = lambda at: np.bincount(np.searchsorted(doc_end, at), minlength=n_docs)

    # Characters: how unevenly letters occur, and the most frequent of all.
    hist = np.bincount(np.repeat(np.arange(n_docs) * BINS, lengths) + bin_of[basic], minlength=n_docs * BINS).reshape(n_docs, BINS)
    top_char = hist[:, 1:].max(1)
    hist = hist[:, 1:256].astype(float)
    total = hist.sum(1)
    coincidence = (hist * (hist - 1)).sum(1) / np.maximum(1, total * (total - 1)) * np.maximum(1, (hist > 0).sum(1))
    # Too few letters of an alphabet say nothing, and syllabaries and ideographs are none.
    coincidence = np.where(total < 20, USUAL, coincidence)

    # Words of a text: how many differ, how often the most frequent occurs, how long the repeated ones are.
    key = (t_hash ^ (t_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key)
    key = key[order]
    g_at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    g_n = np.diff(np.concatenate([g_at, [len(key)]]))
    g_tok = order[g_at]
    g_doc = t_doc[g_tok]
    most = np.zeros(n_docs)
    rank = np.argsort(g_n, kind="stable")
    most[g_doc[rank]] = g_n[rank]
    wl = np.where(t_letters > 0, t_letters, t_len).astype(float)
    mean_len = np.bincount(t_doc, wl, n_docs) / tokens
    spread = np.sqrt(np.maximum(0, np.bincount(t_doc, wl * wl, n_docs) / tokens - mean_len**2))
    rep, g_len = g_n >= 2, wl[g_tok]
    rep_n = np.bincount(g_doc, g_n * rep, n_docs)
    rep_len = np.bincount(g_doc, g_n * g_len * rep, n_docs) / np.maximum(1, rep_n)
    once_n = np.bincount(g_doc, ~rep, n_docs)
    once_len = np.bincount(g_doc, g_len * ~rep, n_docs) / np.maximum(1, once_n)
    shorter = np.where((rep_n > 0) & (once_n > 0), rep_len / np.maximum(0.5, once_len), 1.0)
    echo = np.zeros(len(t_hash), bool)
    for lag in (1, 2, 3):
        echo[lag:] |= (t_hash[lag:] == t_hash[:-lag]) & (t_doc[lag:] == t_doc[:-lag])
    turn = np.arange(1, len(t_at) + 1, dtype=np.uint64)
    l_hash = np.add.reduceat(t_hash * turn, l_first) - np.add.reduceat(t_hash, l_first) * l_first.astype(np.uint64)
    l_key = np.sort((l_hash * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)) | (l_doc.astype(np.uint64) << np.uint64(48)))
    dup = np.flatnonzero(l_key[1:] == l_key[:-1])
    line_repeats = np.bincount((l_key[dup] >> np.uint64(48)).astype(np.int64), minlength=n_docs) / n_lines
    short = (t_letters > 0) & (t_letters <= 3) & (t_len <= 4)
    l_short = np.add.reduceat(short, l_first, dtype=np.int64)
    l_stops = np.add.reduceat(t_last == STOP, l_first, dtype=np.int64)
    size_mean = doc_size / n_lines
    size_sd = np.sqrt(np.maximum(0, np.bincount(l_doc, l_size**2, n_docs) / n_lines - size_mean**2))
    n_letters = of_doc[:, LOWER : WIDE + 1].sum(1)
    n_space = of_doc[:, : OTHER_SPACE + 1].sum(1) - 1
    solid = np.maximum(1, chars - n_space)

    def by_token(mask: np.ndarray) -> np.ndarray:
        return np.bincount(t_doc, mask, n_docs) / tokens

    cols = [
        np.log1p(chars),
        np.log1p(n_lines),
        np.minimum(tokens / n_lines, 500),
        n_letters / chars,
        of_doc[:, DIGIT] / chars,
        of_doc[:, [STOP, HIGH, *range(MARK, CLASSES)]].sum(1) / chars,
        of_doc[:, [CAPITAL, ACCENT_CAPITAL]].sum(1) / np.maximum(1, n_letters),
        of_doc[:, ODD] / chars,
        doc_at(broken) / chars,
        doc_at(esc) * 6 / chars,
        np.bincount(l_doc, tagged, n_docs) / doc_size,
        (of_doc[:, OPEN] + of_doc[:, [_OWN[c] for c in ";|=<>&\\"]].sum(1)) / chars,
        top_char / solid,
        np.minimum(coincidence, 12),
        np.minimum(mean_len, 60),
        np.minimum(spread / np.maximum(1, mean_len), 5),
        np.bincount(t_doc, t_len * (t_len >= 25), n_docs) / solid,
        np.bincount(t_doc, t_len * (t_len >= 60), n_docs) / solid,
        by_token(short),
        np.bincount(g_doc, minlength=n_docs) / tokens,
        np.minimum(shorter, 4),
        most / tokens,
        by_token(echo),
        line_repeats,
        by_token(t_last == STOP),
        share_of(wordy),
        share_of(l_tokens <= 4),
        share_of(one),
        share_of(stopped),
        share_of(stopped & wordy),
        share_of(led),
        share_of(one & (slashes > 0) & (l_size < 400)),
        share_of(directive),
        share_of(pair),
        share_of(same_start),
        share_of(columns),
        share_of(tabs),
        share_of(bars),
        share_of(gaps),
        share_of(slash_cols),
        share_of(close),
        share_of(items),
        np.bincount(l_doc, n_loose, n_docs) / tokens,
        by_token((t_digits > 0) & (t_letters == 0)),
        by_token((t_letters > 0) & (t_digits > 0) & (t_len >= 6)),
        by_token(((t_head == CAPITAL) | (t_head == ACCENT_CAPITAL)) & (t_letters > 1)),
        np.minimum(size_sd / size_mean, 5),
        share_of(code_line),
        share_of(tagged > 0.4 * l_size),
        share_of(wordy & (l_short < 0.08 * l_tokens) & (l_stops * 25 < l_tokens) & ~items),
        share_of(wordy & ~led & ~items & ~columns & ~same_start),
    ]
    x = np.stack(cols, 1)
    x[n_tokens == 0] = 0
    return x
