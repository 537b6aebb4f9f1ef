"""Evaluation texts that leak into a corpus.

Winnowing: of the hashes of all three-word sequences, the smaller of each two neighbours is kept, on both sides. Any four
equal words in a row thereby share a kept hash; and ten words of which at most one in five is misread hold four such
words. Equal hashes are hits. A hit is extended along its diagonal and those beside it, first by counting equal words,
then word by word with misreadings and words split or joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.edit import distance
from quire.llm.lookalike import fold_word
from quire.sources.tables import table

#: Words of an item that a document must hold in a row, and among how many of them one may be misread.
LEAST_WORDS, ONE_IN = 10, 5
#: Equal words among ten, at least, where a hit is looked at first: two may be misread, of which a split word counts as one.
LEAST_EQUAL = LEAST_WORDS - 2
#: A split or joined word moves the words behind it to the next diagonal.
SHIFTS = (-1, 0, 1)
#: Items whose fingerprints are sent to the executors at a time; more items make more passes over the corpus.
ITEM_BLOCK = 5_000
BATCH_CHARS = 2_000_000
#: Raw words whose folded form a worker keeps at a time.
KEPT_WORDS = 1_000_000
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑‒–—=¬­]+[^\S\n]*\n\s*(?=[^\W\d_])")
_ASCII = str.maketrans("", "", "".join(chr(c) for c in range(128) if not chr(c).isalnum()))
# Character sequences that scanning takes for one another.
_CONFUSED = [("rn", "m"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("cl", "d"), ("ci", "a"), ("0", "o"), ("1", "l"), ("5", "s"), ("9", "و"), ("ı", "i")]


def words_of(text: str) -> list[str]:
    """The words as they stand, those broken at a line's end joined."""
    return _BROKEN.sub("", text).split()


def fold(word: str) -> str:
    return word.lower().translate(_ASCII) if word.isascii() else fold_word(word)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
            _FOLDED.clear()
        f = _FOLDED[word] = fold(word)
        h = self[word] = hash_word(f) if f else 0
        return h


def hash_word(f: str) -> int:
    """63 bits, never 0."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f) >> 1 or 1


_FOLDED: dict[str, str] = {}
_HASHES = _Hashes()


def _grams(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes of three words and where they begin."""
    if len(h) < 3:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    u = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        g = u[:-2] * np.uint64(0x9E3779B97F4A7C15) + u[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + u[2:] * np.uint64(0x165667B19E3779F9)
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
    inside = owner[:-2] == owner[2:]
    g[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
    keep = np.zeros(len(g), dtype=bool)
    first = g[:-1] <= g[1:]
    keep[:-1] |= first
    keep[1:] |= ~first
    at = np.nonzero(keep & inside)[0]
    return g[at], at


class Index:
    """The items' words and kept hashes, and a table that tells most other hashes apart by their first bits."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [[f for f in map(fold, words_of(t)) if f] for _, t in items]
        self.known = {f for w in self.words for f in w}
        pad = [0] * (2 * LEAST_WORDS)
        flat, owner, joined = list(pad), [-1] * len(pad), list(pad)
        self.begin = []
        for k, w in enumerate(self.words):
            self.begin.append(len(flat))
            flat += [hash_word(f) for f in w] + pad
            owner += [k] * len(w) + [-1] * len(pad)
            joined += [hash_word(a + b) for a, b in zip(w, w[1:])] + [0] * min(1, len(w)) + pad
        self.h, self.owner = np.array(flat, dtype=np.int64), np.array(owner, dtype=np.int64)
        self.joined = np.array(joined, dtype=np.int64)
        g, at = _grams(self.h, self.owner)
        ok = self.owner[at] >= 0
        order = np.argsort(g[ok], kind="stable")
        self.g, self.at = g[ok][order], at[ok][order]
        self.first = np.zeros(1 << 22, dtype=bool)
        self.first[self.g >> np.uint64(42)] = True


def _like(a: str, b: str) -> str:
    for x, y in _CONFUSED:
        a, b = a.replace(x, y), b.replace(x, y)
    return a + "\0" + b


def misread(word: str, seen: str, known: set[str]) -> bool:
    """Whether `seen` (both folded) can be a misreading of `word`: close to it, and no other word of the items."""
    return not (seen in known or (word.isdigit() and seen.isdigit())) and _close(word, seen)


@lru_cache(KEPT_WORDS)
def _close(word: str, seen: str) -> bool:
    n = len(word)
    if abs(n - len(seen)) > 4:
        return False
    a, b = _like(word, seen).split("\0")
    if a == b:
        return True
    most = 0 if n < 2 else 1 if n < 6 else 2
    return distance(a, b, most) <= most or distance(word, seen, most) <= most


def _states(item: list[str], doc: list[str], i: int, j: int, step: int, known: set[str]) -> list[int]:
    """From item word i and document word j on: 0 for an equal word, 1 for a misread one, up to the first other one."""
    out: list[int] = []
    while 0 <= i < len(item) and 0 <= j < len(doc):
        k, m = i + step, j + step
        if item[i] == doc[j]:
            out.append(0)
        elif 0 <= m < len(doc) and item[i] == (doc[j] + doc[m] if step > 0 else doc[m] + doc[j]):
            out.append(0)
            m += step
        elif 0 <= k < len(item) and doc[j] == (item[i] + item[k] if step > 0 else item[k] + item[i]):
            out += [0, 0]
            k += step
        elif misread(item[i], doc[j], known):
            out.append(1)
        else:
            break
        i, j = k, m
    return out


def holds(item: list[str], doc: list[str], i: int, j: int, known: set[str]) -> bool:
    """Whether LEAST_WORDS item words in a row around the pair (i, j) stand in the document."""
    s = _states(item, doc, i - 1, j - 1, -1, known)[::-1] + _states(item, doc, i, j, 1, known)
    run, last = 0, -ONE_IN
    for k, bad in enumerate(s):
        run += 1
        if bad:
            if k - last < ONE_IN:
                run = min(run, k - last)
            last = k
        if run >= LEAST_WORDS:
            return True
    return False


def _search(index: Index):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["text"].notna()]
            part = np.cumsum(f["text"].str.len().to_numpy()) // BATCH_CHARS if len(f) else []
            for k in np.unique(part):
                yield _find(index, f[part == k])

    return search


def _find(index: Index, f: pd.DataFrame) -> pd.DataFrame:
    words: list[str] = []
    size = []
    for t in f["text"]:
        w = words_of(t)
        words += w
        size.append(len(w))
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(size)), size)
    full = np.nonzero(h)[0]
    h, owner = h[full], owner[full]
    g, at = _grams(h, owner)
    can = index.first[g >> np.uint64(42)]
    g, at = g[can], at[can]
    lo, hi = np.searchsorted(index.g, g, side="left"), np.searchsorted(index.g, g, side="right")
    n = hi - lo
    j = np.repeat(at, n)
    i = index.at[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())]
    span = np.arange(-LEAST_WORDS + 1, LEAST_WORDS + 2)
    m = len(span)
    far = LEAST_WORDS + 2 + max(SHIFTS)
    hp, op = np.pad(h, far, constant_values=-1), np.pad(owner, far, constant_values=-1)
    found = set()
    for a in range(0, len(j), 200_000):
        jj, ii = j[a : a + 200_000], i[a : a + 200_000]
        want, mine = index.h[ii[:, None] + span], owner[jj][:, None]
        eq = np.zeros(want.shape, dtype=bool)
        for shift in SHIFTS:
            near = jj[:, None] + (far + shift) + span
            one = op[near] == mine
            eq |= (hp[near] == want) & one
            both = (hp[near] == index.joined[ii[:, None] + span]) & one
            eq |= both
            eq[:, 1:] |= both[:, :-1]
        c = np.concatenate([np.zeros((len(eq), 1), dtype=np.int16), np.cumsum(eq, axis=1, dtype=np.int16)], axis=1)
        ok = (c[:, LEAST_WORDS:] - c[:, : m + 1 - LEAST_WORDS]).max(axis=1, initial=0) >= LEAST_EQUAL
        found.update(zip(jj[ok].tolist(), ii[ok].tolist()))
    rows, begin = set(), np.searchsorted(owner, np.arange(len(size)))
    judged: dict[int, int] = {}
    for x, y in sorted(found):
        d, k = int(owner[x]), int(index.owner[y])
        # A hit that goes on from one just judged is in the same run of words.
        again = x - judged.get(y - x, -9) <= 3
        judged[y - x] = x
        if again or (d, k) in rows:
            continue
        item, i = index.words[k], y - index.begin[k]
        a = max(int(begin[d]), x - 2 * i - 2)
        b = min(int(begin[d + 1]) if d + 1 < len(size) else len(full), x + 2 * (len(item) - i) + 2)
        if holds(item, [_FOLDED.get(words[p]) or fold(words[p]) for p in full[a:b]], i, x - a, index.known):
            rows.add((d, k))
    ids = f["doc_id"].to_numpy()
    return pd.DataFrame({"doc_id": [ids[d] for d, _ in rows], "item_id": [index.ids[k] for _, k in rows]}, dtype="int64")


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds ten words of the item in a row, of which at most one in any five is misread.

    docs: (doc_id BIGINT unique, text), items: (item_id BIGINT unique, text). Case, punctuation, spacing, line ends,
    vowel marks and variant characters don't count. Null and shorter texts hold nothing, items of fewer than ten words
    are never found. The items are the stated query set: they are sent out in blocks of ITEM_BLOCK, each block makes one
    pass over all documents; the documents are not shuffled.
    """
    out = None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    block: list[tuple[int, str]] = []

    def one_pass(block):
        index = Index(block)
        return docs.mapInPandas(_search(index), "doc_id long, item_id long")

    for r in items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEM_BLOCK:
            out = one_pass(block) if out is None else out.unionByName(one_pass(block))
            block = []
    if block or out is None:
        out = one_pass(block) if out is None else out.unionByName(one_pass(block))
    return out.distinct()


def p8_found(spark, root: str) -> DataFrame:
    return leaked(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_items(spark, root: str) -> DataFrame:
    """Per item, the documents that hold it."""
    items = table(spark, root, "eval_items").select("item_id", "lang")
    n = p8_found(spark, root).groupBy("item_id").agg(F.count("*").alias("docs"))
    return items.join(n, "item_id", "left").select("item_id", "lang", F.coalesce("docs", F.lit(0)).alias("docs"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
ORACLE: dict[str, str] = {}
