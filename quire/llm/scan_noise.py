"""Noise in text from scanned pages.

Page furniture first: lines above the text's upper edge or at the page's foot, lines at the bottom that are a page number,
and running heads, i.e. lines that come back on other pages of the article or in other articles of the journal, exactly
or nearly. Then words: halves of words broken at line ends are joined. All kinds of words there are, with their numbers,
are looked up in tries of the more frequent ones, intersected with their Levenshtein automata (bit-parallel, for many
words at once), which gives every candidate there is. How often scanning makes one character out of another is estimated
from all these pairs; a kind of word that is no more frequent than its candidate's misreadings would be is a misread one.
Of a misread word's candidates the one that fits the neighbouring words best is the reading. At last the text is reflown
into paragraphs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.lookalike import fold_word, plain_form
from quire.session import cut
from quire.sources.tables import table

#: A candidate is so many times as frequent as the word that can be its misreading; this and no share of all words tells
#: what may be a reading, so words of any rarity are judged.
TIMES = 10
#: A word is a misread one if it is at most so many times as frequent as expected, and so many more.
BEYOND, STRAY = 8, 2
#: Likewise at less than this share of the candidate's number, which no word of its own has been seen to have.
TRACE = 1 / 500
#: Of one pair's number, the share of the candidate's that goes into the estimate at most; the rest is a word of its own.
PAIR_MOST = 0.05
#: Words of a trie and words looked up in it by one task; more words make more tries.
TRIE_WORDS, ASKED_WORDS = 20_000, 100_000
#: So many of the most frequent words that aren't misread, at most, are known to every task, which then needn't ask for them.
FREQUENT = 50_000
#: Words of a running head at most; pages or articles that must have it.
HEAD_WORDS, HEAD_PAGES, HEAD_STEMS = 12, 2, 2
#: A head's form (its common words, the others left open) must be that of so many journals.
FORM_SHARE, FORM_LEAST = 0.02, 2
LONGEST_WORD = 60
HYPHENS = "-‐‑‒–¬=­"
# Characters that scanning takes for others.
CONFUSED = [("ci", "a"), ("cl", "d"), ("li", "h"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w")]
CONFUSED += [(b, a) for a, b in CONFUSED]
_EDGE = ".,;:()[]{}«»\"“”„'’‘،؛؟?!—–-…"
_END = tuple(".!?؟۔")
_NUMBER = r"(?:[\dlOoIS]{1,4}|[ivxlc]{1,7})"
_PAGE = rf"(?:[-–—]\s?{_NUMBER}\s?[-–—]|\[{_NUMBER}\]|\({_NUMBER}\)|(?:[pP]{{1,2}}|[sS]|ص|صفحه)[.:]?\s?{_NUMBER})"
_PURE = re.compile(rf"^(?:{_PAGE}|{_NUMBER})$")
_BEFORE, _AFTER = re.compile(rf"^(?:{_PAGE}|{_NUMBER})\s+(?=\S)"), re.compile(rf"(?<=\S)\s+(?:{_PAGE}|{_NUMBER})$")
# With a sign beside the number: such a line says itself that it is a head or foot.
_SIGNED = re.compile(rf"^{_PAGE}\s+\S|\S\s+{_PAGE}$")
_ROMAN = re.compile(r"^[ivxlc]+$")
_ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|er|e|a|o|º|ª)$")
_LETTERS = re.compile(r"[^\W\d_]")


def plain_line(line: str) -> str:
    t = plain_form(line)
    return re.sub(r"\s+", " ", "".join(c for c in t if not "ً" <= c <= "ْ")).strip()


def line_key(line: str) -> str:
    """Folded words, digits masked."""
    return " ".join(x for x in (re.sub(r"\d+", "#", fold_word(w)) for w in line.split(" ")) if x)


def head_keys(line: str) -> tuple[bool, list[str]]:
    """Whether the line is a page number only, and the keys of what else can be a head: as it is, and without a number."""
    t = plain_line(line)
    if not t:
        return True, []
    if _PURE.match(t) and any(c.isdigit() or c.lower() in "ivxlc" for c in t):
        return True, []
    rest = _AFTER.sub("", _BEFORE.sub("", t))
    return False, list(dict.fromkeys(k for k in (line_key(t), line_key(rest)) if _LETTERS.search(k)))


# --- furniture ----------------------------------------------------------------------------------------------------

_CANDIDATE = "stem string, page int, block_pk long, pos string, rank int, line int, pure boolean, keys array<string>, fit boolean, zone boolean"


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines that can be furniture: of the first two and last two blocks of a page the outermost two lines."""
    for f in frames:
        rows = []
        for stem, page, pk, text, top, bottom, head, foot in zip(f["stem"], f["page"], f["block_pk"], f["text"], f["top"], f["bottom"], f["head"], f["foot"]):
            lines = text.split("\n")
            n = len(lines)
            picks = []
            if top == 0 or (top == 1 and n <= 2):
                picks += [("top", i, i) for i in range(min(2, n))]
            if bottom == 0 or (bottom == 1 and n <= 2):
                picks += [("bottom", i, n - 1 - i) for i in range(min(2, n))]
            for pos, rank, i in picks:
                pure, keys = head_keys(lines[i])
                t = plain_line(lines[i])
                signed = bool(_SIGNED.search(t))
                fit = len(t.split(" ")) <= HEAD_WORDS and not t.endswith(_END + tuple(",،;؛")) and (signed or not t.endswith(tuple(HYPHENS)))
                if pure or fit:
                    # A second line is a head's only in a block of the head's own.
                    zone = (head if rank == 0 or n <= 2 or pd.isna(head) else False) if pos == "top" else foot if n <= 2 or pd.isna(foot) else False
                    rows.append((stem, page, pk, pos, rank, i, pure or (signed and rank == 0), keys, fit, None if pd.isna(zone) else bool(zone)))
        yield pd.DataFrame(rows, columns=["stem", "page", "block_pk", "pos", "rank", "line", "pure", "keys", "fit", "zone"])


def _journal(stem):
    return F.substring_index(stem, "-", 1)


def _form(key, common: list[str]):
    """A head with its rarer words left open; they are parts of names and titles."""
    if not common:
        return F.lit(None).cast("string")
    return F.array_join(F.transform(F.split(key, " "), lambda w: F.when(w.isin(common), w).otherwise("*")), " ")


#: Pixels; where a page's foot begins, as a share of its height.
PAGE_HEIGHT, FOOT = 3300, 0.9


class Furniture:
    """The lines of the blocks that are furniture, and what was learned about heads."""

    def __init__(self, blocks: DataFrame):
        b = blocks.where(F.col("text").isNotNull() & (F.col("text") != "")).select("block_pk", "stem", "page", "ord", "vpos", "text")
        o = b.select("stem", "page", "ord").distinct().groupBy("stem", "page").agg(F.sort_array(F.collect_list("ord")).alias("ords"))
        at = F.array_position("ords", F.col("ord"))
        b = b.join(o, ["stem", "page"]).withColumn("top", at - 1).withColumn("bottom", F.size("ords") - at).where("top <= 1 or bottom <= 1")
        # The text's upper edge is where most pages' first block stands; heads stand above it.
        edge = b.where("top = 0").groupBy("vpos").agg(F.count("*").alias("n")).where("vpos is not null").orderBy(F.desc("n"), "vpos").first()
        head = F.col("vpos") < F.lit(edge[0] if edge and 0.05 * PAGE_HEIGHT < edge[0] < 0.12 * PAGE_HEIGHT else 0.06 * PAGE_HEIGHT)
        b = b.withColumn("head", head).withColumn("foot", F.col("vpos") > FOOT * PAGE_HEIGHT)
        c = cut(b.select("stem", "page", "block_pk", "text", "top", "bottom", "head", "foot").mapInPandas(_candidates, _CANDIDATE))
        keyed = c.where("fit").select("stem", "page", "pos", F.explode("keys").alias("key")).where("not (key like '%#%' and key not like '%#%#%')").distinct()
        own = keyed.groupBy("stem", "pos", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= HEAD_PAGES)
        wide = keyed.select(_journal(F.col("stem")).alias("journal"), "stem", "pos", "key").distinct().groupBy("journal", "pos", "key").agg(F.count("*").alias("stems")).where(F.col("stems") >= HEAD_STEMS)
        own, wide = cut(own.select("stem", "pos", "key")), cut(wide.select("journal", "pos", "key"))
        # The words that heads of many journals have, and the forms they make.
        words = wide.select("journal", F.explode(F.array_distinct(F.split("key", " "))).alias("w")).distinct().groupBy("w").agg(F.count("*").alias("n"))
        least = max(FORM_LEAST, FORM_SHARE * wide.select("journal").distinct().count())
        self.common = sorted(r[0] for r in words.where(F.col("n") >= least).select("w").collect())
        forms = wide.select("journal", _form(F.col("key"), self.common).alias("form")).where("form like '%*%' and form rlike '[^*# ]' and not (form like '%#%' and form not like '%#%#%')").distinct().groupBy("form").agg(F.count("*").alias("n"))
        self.forms = sorted(r[0] for r in forms.where(F.col("n") >= least).select("form").collect())
        self.own, self.wide = own, wide
        heads = own.groupBy("stem", "pos").agg(F.collect_list("key").alias("near"))
        in_journal = wide.groupBy("journal", "pos").agg(F.collect_list("key").alias("far"))
        m = c.withColumn("journal", _journal(F.col("stem"))).join(heads, ["stem", "pos"], "left").join(in_journal, ["journal", "pos"], "left")
        # In the head's or foot's zone any first line is one, in a place that isn't known or in the body what says so itself.
        known_head = F.col("fit") & self.is_head(F.col("keys"), F.col("near"), F.col("far"))
        zone = F.coalesce("zone", F.lit(True) & (F.col("pure") | known_head))
        m = m.withColumn("is", F.when(F.col("rank") > 0, F.col("pure") | (known_head & zone)).otherwise(zone | (F.col("pure") & (F.col("pos") == "bottom"))))
        # The second line counts only behind a first one.
        first = m.where("rank = 0 and is").select("block_pk", "pos").distinct().withColumn("led", F.lit(True))
        m = m.where("is").join(first, ["block_pk", "pos"], "left").where("rank = 0 or led")
        self.lines = cut(m.groupBy("block_pk").agg(F.collect_set("line").alias("gone")))

    def is_head(self, keys, *known):
        """Whether one of the keys is nearly a known head, or has the form of one."""
        none = F.array().cast("array<string>")
        close = lambda k, h: F.levenshtein(k, h) <= F.greatest(F.lit(1), F.floor(F.least(F.length(k), F.length(h)) / 8))
        all_known = F.flatten(F.array(*[F.coalesce(h, none) for h in known]))
        out = F.exists(keys, lambda k: F.exists(all_known, lambda x: close(k, x)))
        return (out | F.exists(keys, lambda k: _form(k, self.common).isin(self.forms))) if self.forms else out


# --- words --------------------------------------------------------------------------------------------------------


class _Cores(dict):
    """raw word -> its letters and what is between them, in plain lower-case characters."""

    def __missing__(self, w: str) -> str:
        if len(self) > 500_000:
            self.clear()
        t = w
        if not t.isascii():
            t = plain_form(t)
            if not t.isascii():
                t = unicodedata.normalize("NFC", "".join(c for c in t if not "ً" <= c <= "ْ" and c != "‌"))
                t = t.replace("ي", "ی").replace("ك", "ک").replace("ى", "ی")
        self[w] = t = t.strip(_EDGE + " ").lower()
        return t


_CORES = _Cores()


class Trie:
    """Words as a trie in arrays, level by level."""

    def __init__(self, words: list[str]):
        self.words = sorted(w for w in set(words) if 0 < len(w) <= LONGEST_WORD)
        self.known = set(self.words)
        alphabet = sorted({c for w in self.words for c in w})
        self.code = {c: i + 1 for i, c in enumerate(alphabet)}
        ids: dict[str, int] = {"": 0}
        by_len: list[list[str]] = [[""]]
        level = sorted({w[:1] for w in self.words})
        while level:
            by_len.append(level)
            n = len(by_len)
            level = sorted({w[:n] for w in self.words if len(w) >= n})
        for lv in by_len[1:]:
            for p in lv:
                ids[p] = len(ids)
        nodes = list(ids)
        self.char = np.array([0] + [self.code[p[-1]] for p in nodes[1:]], dtype=np.int64)
        parent = np.array([0] + [ids[p[:-1]] for p in nodes[1:]], dtype=np.int64)
        count = np.bincount(parent[1:], minlength=len(nodes)) if len(nodes) > 1 else np.zeros(len(nodes), dtype=np.int64)
        self.begin = np.concatenate([[1], 1 + np.cumsum(count)])[: len(nodes)]
        self.count = count
        where = {w: i for i, w in enumerate(self.words)}
        self.word = np.array([where.get(p, -1) for p in nodes], dtype=np.int64)

    def near(self, words: list[str]) -> list[list[str]]:
        """All words of the trie within distance 1 of each of the words."""
        out: list[list[str]] = [[] for _ in words]
        for a in range(0, len(words), 4_000):
            part = words[a : a + 4_000]
            for i, w in zip(*self._near(part)):
                out[a + i].append(self.words[w])
        return out

    def _near(self, words: list[str]) -> tuple[list[int], list[int]]:
        n = np.array([len(w) for w in words], dtype=np.uint64)
        at = np.zeros((len(words), len(self.code) + 1), dtype=np.uint64)
        for i, w in enumerate(words):
            for k, c in enumerate(w):
                if c in self.code:
                    at[i, self.code[c]] |= np.uint64(1 << k)
        one = np.uint64(1)
        full = one << n
        tok, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        r0, r1 = np.full(len(words), 1, dtype=np.uint64), np.full(len(words), 3, dtype=np.uint64)
        hit_t, hit_w = [], []
        while len(tok):
            size = self.count[node]
            t = np.repeat(tok, size)
            child = np.repeat(self.begin[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
            p0, p1 = np.repeat(r0, size), np.repeat(r1, size)
            m = at[t, self.char[child]]
            q0 = (p0 & m) << one
            q1 = ((p1 & m) << one) | (p0 << one) | p0 | (q0 << one)
            # States behind the word's end can't come to anything.
            q0 &= (full[t] << one) - one
            q1 &= (full[t] << one) - one
            alive = (q0 | q1) > 0
            tok, node, r0, r1 = t[alive], child[alive], q0[alive], q1[alive]
            done = (((r0 | r1) & full[tok]) > 0) & (self.word[node] >= 0)
            hit_t += tok[done].tolist()
            hit_w += self.word[node[done]].tolist()
        return hit_t, hit_w


_ELISION = re.compile(r"^(?:l|d|n|qu|s|c|j|m|t|jusqu|lorsqu|puisqu)['’]", re.I)
_INNER = re.compile(r"(?<=[^\W\d_])[.:·!,;*^~|'’#+/\\_§](?=[^\W\d_])")


def readings(core: str, trie: Trie) -> list[str]:
    """Vocabulary words that become `core` by one confusion of characters."""
    out = []
    for seen, meant in CONFUSED:
        i = core.find(seen)
        while i >= 0:
            w = core[:i] + meant + core[i + len(seen) :]
            if w in trie.known:
                out.append(w)
            i = core.find(seen, i + 1)
    return out


#: What a word is by itself: nothing to judge, a word, a word with signs or digits that no word has.
SKIP, WORD, ODD = 0, 1, 2


def kind_of(core: str) -> int:
    if not core or not _LETTERS.search(core) or _ROMAN.match(core) or len(core) > LONGEST_WORD:
        return SKIP
    if any(c.isdigit() for c in core):
        return SKIP if _ORDINAL.match(core) else ODD
    return ODD if _INNER.search(_ELISION.sub("", core)) else WORD


def change(meant: str, seen: str) -> tuple[str, str]:
    """The part of a word and what became of it, without what both have before and behind it."""
    least = min(len(meant), len(seen))
    a = 0
    while a < least and meant[a] == seen[a]:
        a += 1
    b = 0
    while b < least - a and meant[-1 - b] == seen[-1 - b]:
        b += 1
    return meant[a : len(meant) - b], seen[a : len(seen) - b]


def _find_candidates(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """All pairs of a word asked for and a known one at most one edit or confusion away."""
    out = []
    if len(asked) and len(known):
        n_of = dict(zip(known["v"], known["nv"].tolist()))
        trie = Trie(list(n_of))
        words = sorted(set(asked["core"]))
        n_asked = dict(zip(asked["core"], asked["n"].tolist()))
        for w, near in zip(words, trie.near(words)):
            n = max(n_asked[w], 1)
            out += [(w, n, v, n_of[v], *change(v, w)) for v in dict.fromkeys(readings(w, trie) + near) if v != w and n_of[v] >= TIMES * n]
    return pd.DataFrame(out, columns=["core", "n", "v", "nv", "meant", "seen"])


def _cells_of(length, core, of_known: bool):
    """Cells such that a known word and one an edit or a confusion away have one in common: by length up to four
    letters, else by the first two letters and by the last two, of which one pair is the same."""
    by_length = [F.when(F.lit(k).between(length - (0 if of_known else 1), length + (0 if of_known else 1)), F.lit(f"#{k}")) for k in range(1, 5)]
    long = length >= (5 if of_known else 4)
    ends = [F.when(long, F.concat(F.lit("<"), F.substring(core, 1, 2))), F.when(long, F.concat(F.lit(">"), F.substring(core, -2, 2)))]
    return F.filter(F.array(*by_length, *ends), lambda c: c.isNotNull())


def candidates(types: DataFrame, trie_words: int = TRIE_WORDS, asked_words: int = ASKED_WORDS) -> DataFrame:
    """(core, n, v, nv, meant, seen): for each word (core, n, kind) all words v of TIMES its number within one edit or confusion.

    The known words are dealt to tries by cells, so that no trie has all of them; words asked for go to the tries of
    their cells, those of a trie that many ask for in several tasks.
    """
    known = types.where((F.col("kind") == WORD) & (F.col("n") >= TIMES)).select("core", "n")
    asked = types.where((F.col("kind") != SKIP) & F.length("core").between(2, LONGEST_WORD)).select("core", "n")
    buckets = max(1, -(-2 * known.count() // trie_words))
    bucket = lambda w, of_known: F.explode(F.array_distinct(F.transform(_cells_of(F.length(w), F.col(w), of_known), lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")))).alias("bucket")
    known, asked = known.select(F.col("core").alias("v"), F.col("n").alias("nv"), bucket("core", True)), asked.select("core", "n", bucket("core", False))
    # One row for each trie.
    shares = asked.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(asked_words)).cast("int").alias("parts"))
    asked = asked.join(F.broadcast(shares), "bucket").withColumn("part", F.pmod(F.xxhash64("core"), F.col("parts")).cast("int"))
    known = known.join(F.broadcast(shares), "bucket").select("v", "nv", F.col("bucket").alias("known_bucket"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("known_part"))
    found = asked.groupBy("bucket", "part").cogroup(known.groupBy("known_bucket", "known_part")).applyInPandas(_find_candidates, "core string, n long, v string, nv long, meant string, seen string")
    return found.distinct() if buckets > 1 else found


def misread_types(types: DataFrame) -> DataFrame:
    """(core, reading, readings): the words (core, n, kind) that are misread ones, the likeliest reading, and all likely ones.

    Words with signs or digits between their letters are, with or without candidates. Of the others those whose number is
    what the misreadings of a candidate come to: its own number by the rate at which that part of a word becomes the
    other, estimated from all pairs but those with the candidate (a word of its own would prove itself a misread one).
    """
    c = cut(candidates(types))
    own = F.least(F.col("n").cast("double"), PAIR_MOST * F.col("nv"))
    changed = c.groupBy("meant", "seen").agg(F.sum(own).alias("all"))
    words = types.where(F.col("kind") == WORD)
    places = F.sequence(F.lit(1), F.length("core"))
    parts = F.array_distinct(F.concat(F.transform(places, lambda i: F.substring("core", i, F.lit(1))), F.transform(places, lambda i: F.substring("core", i, F.lit(2)))))
    rooms = words.select("n", F.explode(F.concat(parts, F.array(F.lit("")))).alias("meant")).groupBy("meant").agg(F.sum("n").alias("room"))
    x = c.join(changed, ["meant", "seen"]).join(rooms, "meant", "left")
    # The part may have been changed in several ways; what this candidate gave to the estimate is taken out of it.
    mine = F.sum(own).over(Window.partitionBy("meant", "seen", "v"))
    rate = F.greatest(F.col("all") - mine, F.lit(0.0)) / F.greatest(F.coalesce("room", F.lit(0)) - F.col("nv"), F.lit(1))
    x = x.withColumn("expected", F.col("nv") * rate)
    likely = x.where((F.col("n") <= BEYOND * F.col("expected") + STRAY) | (F.col("n") <= TRACE * F.col("nv")))
    best = F.sort_array(F.collect_list(F.struct(F.col("expected"), F.col("nv"), F.col("v"))), asc=False)
    likely = likely.groupBy("core").agg(F.transform(best, lambda s: s["v"]).alias("readings"))
    # An article or the like before a known word makes a word.
    split = F.regexp_extract("core", r"^(?:l|d|n|qu|s|c|j|m|t|jusqu|lorsqu|puisqu)['’](.+)$", 1)
    odd = types.where(F.col("kind") == ODD).select("core")
    likely = odd.join(likely, "core", "full").withColumn("rest", split)
    whole = words.where(F.col("n") >= TIMES).select(F.col("core").alias("rest")).join(likely.select(F.col("core").alias("rest")), "rest", "left_anti")
    fine = likely.where("rest <> ''").select("core", "rest").join(whole, "rest").select("core")
    out = likely.join(fine, "core", "left_anti")
    readings_ = F.coalesce("readings", F.array().cast("array<string>"))
    return out.select("core", F.get(readings_, F.lit(0)).alias("reading"), readings_.alias("readings"))


def _broken(raw: str) -> bool:
    return len(raw) > 1 and raw[-1] in HYPHENS and raw[-2].isalpha()


def _tokens(text: str, gone) -> list[tuple[int, int, str, bool]]:
    """(place among all words, line, raw, last of its line) of the words outside of the lines `gone`."""
    out, k = [], 0
    off = set(gone) if gone is not None else set()
    for i, line in enumerate(text.split("\n")):
        w = [x for x in line.split(" ") if x]
        if i not in off:
            out += [(k + j, i, x, j == len(w) - 1) for j, x in enumerate(w)]
        k += len(w)
    return out


def _units(tok: list) -> list[tuple[list, str]]:
    """Whole words: the parts (one, or two of a broken word) and the core."""
    out, i = [], 0
    while i < len(tok):
        if tok[i][3] and _broken(tok[i][2]) and i + 1 < len(tok) and tok[i + 1][1] > tok[i][1]:
            out.append(([tok[i], tok[i + 1]], _CORES[tok[i][2][:-1] + tok[i + 1][2]]))
            i += 2
        else:
            out.append(([tok[i]], _CORES[tok[i][2]]))
            i += 1
    return out


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        words: Counter = Counter()
        for text, gone in zip(f["text"], f["gone"]):
            words.update(c for _, c in _units(_tokens(text, gone)))
        if words:
            yield pd.DataFrame({"core": list(words), "n": list(words.values()), "kind": [kind_of(w) for w in words]})


def _pair_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        pairs: Counter = Counter()
        for text, gone in zip(f["text"], f["gone"]):
            c = [c for _, c in _units(_tokens(text, gone))]
            pairs.update(zip(c, c[1:]))
        if pairs:
            yield pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "n": list(pairs.values())})


def word_types(marked: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(core, n, kind) of all words of the running text (text, gone); those of `more` (text) are there, but don't count."""
    t = marked.select("text", "gone").mapInPandas(_counts, "core string, n long, kind int")
    if more is not None:
        extra = more.select("text", F.lit(None).cast("array<int>").alias("gone")).mapInPandas(_counts, "core string, n long, kind int")
        t = t.unionByName(extra.withColumn("n", F.lit(0).cast("long")))
    return cut(t.groupBy("core", "kind").agg(F.sum("n").alias("n")))


def judge(text: str, gone, frequent=frozenset(), continued: bool = False) -> list[tuple]:
    """(place, kind, second, core, head, unit, before, after) for what is wrong, or may be, with the words of a block.

    The kinds are furniture, hyphen and `word`, a word that is misread if its core is; then second is the place of its
    second half, if it is broken, else -1, and head the core of the first. before and after are the cores beside it.
    continued: the block begins with the second half of a word; that is nothing to look up.
    """
    out: list[tuple] = []
    if gone is not None and len(gone):
        off, k = set(gone), 0
        for i, line in enumerate(text.split("\n")):
            n = sum(1 for x in line.split(" ") if x)
            if i in off:
                out += [(k + j, "furniture", -1, None, None, -1, None, None) for j in range(n)]
            k += n
    units = _units(_tokens(text, gone))
    for j, (parts, core) in enumerate(units):
        whole = len(parts) == 1
        if not whole or (j == len(units) - 1 and parts[0][3] and _broken(parts[0][2])):
            out.append((parts[0][0], "hyphen", -1, None, None, -1, None, None))
            if whole:
                continue
        if core in frequent or kind_of(core) == SKIP or (whole and continued and j == 0):
            continue
        before, after = units[j - 1][1] if j else None, units[j + 1][1] if j + 1 < len(units) else None
        out.append((parts[0][0], "word", -1 if whole else parts[1][0], core, None if whole else _CORES[parts[0][2][:-1]], j, before, after))
    return out


_FOUND = ["ord", "kind", "second", "core", "head", "unit", "before", "after"]
FOUND = "key long, ord int, kind string, second int, core string, head string, unit int, before string, after string"


def _judged(frequent: frozenset):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(key, *r) for key, text, gone, c in zip(f["key"], f["text"], f["gone"], f["continued"]) for r in judge(text, gone, frequent, bool(c))]
            yield pd.DataFrame(rows, columns=["key", *_FOUND]).astype({"ord": "int32", "second": "int32", "unit": "int32"})

    return run


def frequent_words(types: DataFrame, misread: DataFrame) -> frozenset:
    """At most FREQUENT words that need no looking up: all from a power of two on; it makes no difference to the result which."""
    t = types.where((F.col("kind") == WORD) & (F.col("n") > 0)).withColumn("power", F.floor(F.log2("n")).cast("int"))
    most, first = 0, None
    for power, k in sorted(map(tuple, t.groupBy("power").agg(F.count("*")).collect()), reverse=True):  # 63 rows at most
        most += k
        if most > FREQUENT:
            break
        first = power
    if first is None:
        return frozenset()
    return frozenset(r[0] for r in t.where(F.col("power") >= first).join(misread.select("core"), "core", "left_anti").select("core").collect())


def suspects(texts: DataFrame, frequent: frozenset, misread: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts (key, text, gone, continued): (key, ord, kind) of furniture and broken words, and the misread words with
    their readings. A half in which the reading doesn't differ is none; can both not be told apart, the first is it."""
    found = cut(texts.select("key", "text", "gone", "continued").mapInPandas(_judged(frequent), FOUND))
    words = found.where("kind = 'word'").join(misread, "core")
    second = (F.col("second") >= 0) & F.coalesce(F.startswith(F.col("reading"), F.col("head")), F.lit(False))
    return found.where("kind <> 'word'").select("key", "ord", "kind"), words.withColumn("ord", F.when(second, F.col("second")).otherwise(F.col("ord")))


_LINES = "n long, journal string, stem string, pure boolean, keys array<string>, fit boolean"


def _held_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for n, stem, text in zip(f["n"], f["stem"], f["text"]):
            for line in text.split("\n"):
                pure, keys = head_keys(line)
                rows.append((n, (stem or "").split("-")[0], stem, pure, keys, len(line.split(" ")) <= HEAD_WORDS and not line.rstrip().endswith(_END)))
        yield pd.DataFrame(rows, columns=["n", "journal", "stem", "pure", "keys", "fit"])


def continued(marked: DataFrame) -> DataFrame:
    """(block_pk, continued): whether the block before it on the page ends in a broken word, or, for a page's first block, one
    of the page before (notes and cells may stand between)."""
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    b = marked.select("block_pk", "stem", "page", "ord", kept.alias("kept")).where(F.size("kept") > 0)
    b = b.select("block_pk", "stem", "page", "ord", F.element_at("kept", -1).rlike(rf"\p{{L}}[{HYPHENS}]+\s*$").alias("broken"))
    before = F.last("broken").over(Window.partitionBy("stem", "page").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1))
    ends = b.groupBy("stem", (F.col("page") + 1).alias("page")).agg(F.max("broken").alias("page_before"))
    return b.withColumn("before", before).join(ends, ["stem", "page"], "left").select("block_pk", F.coalesce("before", "page_before", F.lit(False)).alias("continued"))


def _learned(spark, root: str, held: DataFrame | None = None):
    blocks = table(spark, root, "blocks")
    furniture = Furniture(blocks)
    marked = blocks.where(F.col("text").isNotNull()).select("block_pk", "stem", "page", "ord", "text", "loaded", "block_id").join(furniture.lines, "block_pk", "left")
    types = word_types(marked, held)
    misread = cut(misread_types(types))
    return furniture, marked, misread, frequent_words(types, misread)


def p2_found(spark, root: str) -> DataFrame:
    held = table(spark, root, "heldout_blocks").where(F.col("text").isNotNull()).select(F.col("n").cast("long").alias("n"), F.col("doc").alias("stem"), "text")
    furniture, marked, misread, frequent = _learned(spark, root, held)
    texts = marked.join(continued(marked), "block_pk", "left").select(F.col("block_pk").alias("key"), "text", "gone", F.coalesce("continued", F.lit(False)).alias("continued"))
    plain, words = suspects(texts, frequent, misread)
    found = plain.unionByName(words.select("key", "ord", F.lit("misread").alias("kind")))
    keys = table(spark, root, "words").select(F.col("block_pk").alias("key"), F.col("ord").cast("int").alias("ord"), "word_pk")
    of_words = keys.join(found, ["key", "ord"]).select(F.lit("words").alias("tbl"), F.col("word_pk").alias("row_id"), "kind").distinct()
    near, far = furniture.own.groupBy("stem").agg(F.collect_set("key").alias("near")), furniture.wide.groupBy("journal").agg(F.collect_set("key").alias("far"))
    lines = held.mapInPandas(_held_lines, _LINES).join(near, "stem", "left").join(far, "journal", "left")
    whole = cut(lines.groupBy("n").agg(F.min(F.col("pure") | (F.col("fit") & furniture.is_head(F.col("keys"), F.col("near"), F.col("far")))).alias("all_gone")))
    rest = held.join(whole.where("not all_gone"), "n").select(F.col("n").alias("key"), "text", F.lit(None).cast("array<int>").alias("gone"), F.lit(False).alias("continued"))
    plain, words = suspects(rest, frequent, misread)
    kinds = plain.select(F.col("key").alias("row_id"), "kind").unionByName(words.select(F.col("key").alias("row_id"), F.lit("misread").alias("kind"))).unionByName(whole.where("all_gone").select(F.col("n").alias("row_id"), F.lit("furniture").alias("kind")))
    return of_words.unionByName(kinds.distinct().select(F.lit("heldout_blocks").alias("tbl"), "row_id", "kind"))


def best_readings(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, unit, want): for misread words (key, unit, core, before, after, readings) the reading that fits best: whose
    pairs with the words beside it are the most frequent (a, b, n), then of the most alike length, then the likeliest."""
    r = words.select("key", "unit", "core", "before", "after", F.posexplode("readings").alias("no", "v"))
    asked = r.select("key", "unit", "v", F.explode(F.array(F.struct(F.col("before").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("after").alias("b")))).alias("p")).select("key", "unit", "v", "p.a", "p.b")
    n = asked.join(pairs, ["a", "b"]).groupBy("key", "unit", "v").agg(F.sum("n").alias("n"))
    x = r.join(n, ["key", "unit", "v"], "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.abs(F.length("v") - F.length("core"))).alias("d"), (-F.col("no")).alias("no"), "v")
    return x.groupBy("key", "unit").agg(F.max_by("v", rank).alias("want"))


def _reflow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for text, gone, fixes in zip(f["text"], f["gone"], f["fixes"]):
            want = {x["unit"]: x["want"] for x in fixes} if fixes is not None else {}
            words = []
            for j, (parts, _) in enumerate(_units(_tokens(text, gone))):
                raw = parts[0][2] if len(parts) == 1 else parts[0][2][:-1] + parts[1][2]
                if want.get(j):
                    a, b = len(raw) - len(raw.lstrip(_EDGE)), len(raw.rstrip(_EDGE))
                    raw = raw[:a] + (want[j].capitalize() if raw[a : a + 1].isupper() else want[j]) + raw[b:]
                words.append(raw)
            out.append(" ".join(words))
        yield f.assign(text=out)[["block_pk", "stem", "page", "ord", "text"]]


def p2_paragraphs(spark, root: str) -> DataFrame:
    """(stem, page, ord, text): the blocks of each page as continuous text, in reading order, without furniture.

    Of a block that was delivered again the latest counts. A paragraph that a page's end breaks off in a word stays two
    rows, its first half as printed.
    """
    _, marked, misread, frequent = _learned(spark, root)
    _, words = suspects(marked.select(F.col("block_pk").alias("key"), "text", "gone", F.lit(False).alias("continued")), frequent, misread)
    pairs = marked.select("text", "gone").mapInPandas(_pair_counts, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    fixes = best_readings(words, pairs).groupBy(F.col("key").alias("block_pk")).agg(F.collect_list(F.struct("unit", "want")).alias("fixes"))
    text = marked.join(fixes, "block_pk", "left").select("block_pk", "stem", "page", "ord", "text", "gone", "fixes").mapInPandas(_reflow, "block_pk long, stem string, page int, ord int, text string")
    latest = marked.groupBy("stem", "block_id").agg(F.max(F.struct("loaded", "block_pk")).alias("s")).select(F.col("s.block_pk").alias("block_pk"))
    return text.where("text <> ''").join(latest, "block_pk").select("stem", "page", "ord", "text")


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
ORACLE: dict[str, str] = {}
