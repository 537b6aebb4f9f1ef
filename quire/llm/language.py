"""Languages of texts, of their segments and words.

A linear-chain conditional random field over words: features of the word itself (the lexicon), its affixes, its n-grams
of characters and its script, and learned transitions; forward-backward gives each word's languages and their
confidence. Words in a row with one language are a segment; segments below ten words fall to what surrounds them.

The field is fitted on a bounded sample of labelled rows (TRAIN_DOCS, TRAIN_BLOCKS). Labels may be wrong or stand for
texts in two languages: the sample is relabelled by its own words first, then word by word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalike import LOOKALIKE
from quire.session import cut
from quire.sources.tables import table

LANGS = ["ara", "eng", "fre", "per", "ger", "spa", "tur"]
# The codes in use, two letters and three.
CODES = {"ar": "ara", "ara": "ara", "en": "eng", "eng": "eng", "fr": "fre", "fre": "fre", "fra": "fre", "fa": "per", "per": "per", "fas": "per", "de": "ger", "ger": "ger", "deu": "ger", "es": "spa", "spa": "spa", "tr": "tur", "tur": "tur"}
#: The sample a field is fitted on, at most so many documents and blocks, and no text longer than so many characters.
TRAIN_DOCS, TRAIN_BLOCKS, TRAIN_CHARS = 1_500, 3_000, 20_000
#: A text must have so many words to be judged; a segment is at least so long.
LEAST_WORDS, SEGMENT_WORDS = 12, 10
#: Long texts go through forward-backward in pieces of CORE words, each with CONTEXT more words on either side.
CORE, CONTEXT = 160, 32
BATCH_CHARS = 2_000_000
KEPT_WORDS = 400_000
BUCKETS = 1 << 17
LETTERS = 16
K = len(LANGS)


def _clean(w: str) -> str:
    """Lower case, without what isn't a letter; look-alikes of Latin letters replaced in words with Latin ones."""
    if not w.isascii():
        w = unicodedata.normalize("NFKC", w)
        if any("Ͱ" <= c <= "ԯ" for c in w) and any("a" <= c.lower() <= "ɏ" for c in w):
            w = "".join(LOOKALIKE.get(c, c) for c in w)
    return "".join(c for c in w.lower() if c.isalpha() or c == "‌")


def features(words: list[str]) -> np.ndarray:
    """Feature numbers of words, a row each; 0 for none. Word, prefixes and suffixes to 4, n-grams of 2 and 3."""
    clean = [_clean(w) for w in words]
    n = len(clean)
    size = np.array([len(c) for c in clean])
    short = [c if len(c) <= LETTERS else c[: LETTERS // 2] + c[-LETTERS // 2 :] for c in clean]
    kept = np.minimum(size, LETTERS)
    m = np.zeros((n, LETTERS + 2), dtype=np.uint64)
    if n:
        flat = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(n), kept)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(kept) - kept, kept) + 1
        m[row, col] = flat
    m[:, 0] = 1
    m[np.arange(n), kept + 1] = 2
    has = kept > 0
    out = []

    def add(h: np.ndarray, kind: int, ok: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            x = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out.append(np.where(ok & has, (x >> np.uint64(40)) % np.uint64(BUCKETS - 2) + np.uint64(2), np.uint64(0)).astype(np.int32))

    with np.errstate(over="ignore"):
        p = np.uint64(0x100000001B3)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(1, LETTERS + 1):
            h = np.where(k <= kept, h * p + m[:, k], h)
            if k <= 4:
                add(h, 100 + k, k <= kept)
        add(h + size.astype(np.uint64), 7, has)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(1, 5):
            h = h * p + m[np.arange(n), np.maximum(kept - k + 1, 0)]
            add(h, 200 + k, k <= kept)
        for k in range(LETTERS + 1):
            add(m[:, k] * p + m[:, k + 1], 300, (k <= kept) & ((k > 0) | (kept >= 1)))
            if k < LETTERS:
                add((m[:, k] * p + m[:, k + 1]) * p + m[:, k + 2], 400, k + 1 <= kept)
    first = m[:, 1]
    script = np.where(~has, 0, np.where(first < 0x250, 1, np.where((first >= 0x600) & (first < 0x700), 2, 3)))
    add(script.astype(np.uint64), 900, has)
    return np.stack(out, axis=1) if n else np.zeros((0, len(out)), dtype=np.int32)


def _forward_backward(em: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """em: T x B x K likelihoods, columns padded behind their length. The words' posteriors, the forward and the backward pass."""
    t_max = em.shape[0]
    alpha = np.empty_like(em)
    a = em[0] / em[0].sum(axis=1, keepdims=True)
    alpha[0] = a
    for t in range(1, t_max):
        a = (a @ trans) * em[t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t] = a
    back = np.empty_like(em)
    b = np.full(em.shape[1:], 1.0 / K, dtype=em.dtype)
    back[t_max - 1] = b
    tt = trans.T.copy()
    for t in range(t_max - 2, -1, -1):
        b = (b * em[t + 1]) @ tt
        b /= b.sum(axis=1, keepdims=True)
        b[length <= t + 1] = 1.0 / K
        back[t] = b
    g = alpha * back
    g /= g.sum(axis=2, keepdims=True)
    return g, alpha, back


def _expected_pairs(em: np.ndarray, inside: np.ndarray, trans: np.ndarray, alpha: np.ndarray, back: np.ndarray) -> np.ndarray:
    """K x K: how many pairs of neighbours there are of each two languages, by the posterior of both together."""
    right = em[1:] * back[1:]
    whole = np.einsum("tbi,ij,tbj->tb", alpha[:-1], trans, right)
    weight = np.where(inside[1:], 1.0 / np.maximum(whole, 1e-300), 0.0)
    return trans * np.einsum("tbi,tbj->ij", alpha[:-1] * weight[:, :, None], right)


class Field:
    """Weights of the features and transitions, and the likelihoods of the words seen so far."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights.astype(np.float32), trans.astype(np.float32)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, K), dtype=np.float32)

    def __getstate__(self):
        return {"weights": self.weights, "trans": self.trans, "rows": {}, "table": np.zeros((0, K), dtype=np.float32)}

    def likelihoods(self, words: list[str]) -> np.ndarray:
        f = features(words)
        s = np.zeros((len(words), K), dtype=np.float32)
        for c in range(f.shape[1]):
            s += self.weights[f[:, c]]
        return np.exp(s - s.max(axis=1, keepdims=True)) + 1e-6

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > KEPT_WORDS:
            self.rows, self.table = {}, self.table[:0]
        fresh = [w for w in dict.fromkeys(words) if w not in self.rows]
        if fresh:
            self.rows.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
            self.table = np.concatenate([self.table, *(self.likelihoods(fresh[a : a + 50_000]) for a in range(0, len(fresh), 50_000))])
        return np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))

    def label(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and confidence of each word of the texts, one after the other with `size` words each."""
        ids = self.ids(words)
        lang, conf = np.zeros(len(ids), dtype=np.int8), np.zeros(len(ids), dtype=np.float32)
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        pieces = np.maximum(1, -(-size // CORE))
        text = np.repeat(np.arange(len(size)), pieces)
        no = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo, hi = begin[text] + no * CORE, np.minimum(begin[text] + (no + 1) * CORE, begin[text + 1])
        a, b = np.maximum(lo - CONTEXT, begin[text]), np.minimum(hi + CONTEXT, begin[text + 1])
        order = np.argsort(b - a, kind="stable")
        order = order[(b - a)[order] > 0]
        at = 0
        while at < len(order):
            longest = (b - a)[order[at]]
            stop = int(np.searchsorted((b - a)[order], longest + max(8, longest // 4), side="right"))
            stop = min(stop, at + 1_000)
            o = order[at:stop]
            at = stop
            length = (b - a)[o]
            t = np.arange(length.max())[:, None]
            inside = t < length
            pos = np.where(inside, a[o] + t, a[o])
            em = np.where(inside[:, :, None], self.table[ids[pos]], np.float32(1))
            g = _forward_backward(em, length, self.trans)[0]
            mine = inside & (pos >= lo[o]) & (pos < hi[o])
            best = g.argmax(axis=2)
            lang[pos[mine]] = best[mine]
            conf[pos[mine]] = g.max(axis=2)[mine]
        return lang, conf


def segments_of(lang: np.ndarray, least: int = SEGMENT_WORDS) -> list[tuple[int, int, int]]:
    """(begin, end, language number) in order. Till no run below `least` is left, the shortest joins a neighbour, the longer
    one; runs between two of one language go first."""
    cut_at = np.flatnonzero(np.diff(lang)) + 1
    b = [0, *cut_at.tolist(), len(lang)]
    runs = [[x, y, int(lang[x])] for x, y in zip(b, b[1:])]
    while len(runs) > 1:
        short = [i for i, r in enumerate(runs) if r[1] - r[0] < least]
        if not short:
            break
        k = min(short, key=lambda i: (not (0 < i < len(runs) - 1 and runs[i - 1][2] == runs[i + 1][2]), runs[i][1] - runs[i][0], i))
        near = [i for i in (k - 1, k + 1) if 0 <= i < len(runs)]
        to = max(near, key=lambda i: (runs[i][1] - runs[i][0], -i))
        x, y = min(k, to), max(k, to)
        runs[x : y + 1] = [[runs[x][0], runs[y][1], runs[to][2]]]
        merged: list[list[int]] = []
        for r in runs:
            if merged and merged[-1][2] == r[2]:
                merged[-1][1] = r[1]
            else:
                merged.append(r)
        runs = merged
    return [tuple(r) for r in runs]


def split_words(text: str) -> list[str]:
    """Words parted by plain blanks and line feeds."""
    return [w for w in text.replace("\n", " ").split(" ") if w]


def _fit(rows: list[tuple[str, str]]) -> Field:
    """From (text, label). Without any word the field knows nothing, but that languages stay."""
    stay = np.full((K, K), 0.01 / (K - 1)) + np.eye(K) * (0.99 - 0.01 / (K - 1))
    texts = [split_words(t) for t, _ in rows]
    if not any(texts):
        return Field(np.zeros((BUCKETS, K)), stay)
    y = np.array([LANGS.index(x) for _, x in rows], dtype=np.int64)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    kinds: dict[str, int] = {}
    ids = np.array([kinds.setdefault(w, len(kinds)) for t in texts for w in t], dtype=np.int64)
    v = len(kinds)
    owner = np.repeat(np.arange(len(size)), size)

    def log_words(lab: np.ndarray) -> np.ndarray:
        c = np.bincount(ids * K + lab, minlength=v * K).reshape(v, K) + 0.05
        return np.log(c / c.sum(axis=0))

    # Texts first: each takes the language that its words have in the other texts.
    for _ in range(3):
        s = log_words(y[owner])[ids]
        y = np.stack([np.bincount(owner, weights=s[:, k], minlength=len(size)) for k in range(K)], axis=1).argmax(axis=1)
    # Then words, by the neighbours' words.
    lab = y[owner]
    field = Field(np.zeros((BUCKETS, K)), stay)
    field.rows = kinds
    for _ in range(2):
        s = log_words(lab)
        field.table = np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -6)).astype(np.float32)
        lab = field.label([w for t in texts for w in t], size)[0].astype(np.int64)
    # The field proper, on pieces of the texts, by gradient steps (Adam).
    words, t_len = list(kinds), 48
    f = features(words)
    starts = np.concatenate([np.arange(b, max(b + 1, e - t_len // 3), t_len) for b, e in zip(np.cumsum(size) - size, np.cumsum(size))]) if len(size) else np.zeros(0, dtype=np.int64)
    ends = np.minimum(starts + t_len, np.cumsum(size)[owner[np.minimum(starts, max(len(owner) - 1, 0))]] if len(owner) else starts)
    w = np.zeros((BUCKETS, K), dtype=np.float32)
    tr = np.log(stay)
    m1, m2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)
    rng, batch, steps = np.random.default_rng(7), 384, 140
    for step in range(1, steps + 1 if len(starts) else 1):
        o = rng.integers(0, len(starts), batch)
        length = ends[o] - starts[o]
        t = np.arange(t_len)[:, None]
        inside = t < length
        pos = np.where(inside, starts[o] + t, starts[o])
        seen, back = np.unique(ids[pos], return_inverse=True)
        back = back.reshape(pos.shape)
        s = np.zeros((len(seen), K), dtype=np.float32)
        for c in range(f.shape[1]):
            s += w[f[seen, c]]
        e = np.exp(s - s.max(axis=1, keepdims=True)) + 1e-8
        trans = np.exp(tr)
        em = np.where(inside[:, :, None], e[back], 1.0)
        g, alpha, after = _forward_backward(em, length, trans)
        gold = np.eye(K)[lab[pos]]
        diff = np.where(inside[:, :, None], g - gold, 0.0)
        by_word = np.stack([np.bincount(back.ravel(), weights=diff[:, :, k].ravel(), minlength=len(seen)) for k in range(K)], axis=1) / batch
        grad = np.zeros_like(w)
        for c in range(f.shape[1]):
            np.add.at(grad, f[seen, c], by_word.astype(np.float32))
        grad[0] = 0
        grad += 1e-5 * w
        both = inside[1:]
        exp_pairs = _expected_pairs(em, inside, trans, alpha, after)
        got_pairs = np.einsum("tbi,tbj->ij", np.where(both[:, :, None], gold[:-1], 0), np.where(both[:, :, None], gold[1:], 0))
        # A weak pull keeps the transitions of unseen pairs finite.
        gt = (exp_pairs - got_pairs) / batch + 1e-4 * (tr - np.log(stay))
        for x, gr, a, b, rate in ((w, grad, m1, m2, 0.05), (tr, gt, t1, t2, 0.02)):
            a += 0.1 * (gr - a)
            b += 0.01 * (gr * gr - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    trans = np.exp(tr)
    # Potentials, not probabilities: a common factor makes no difference, a factor by row would.
    return Field(w, trans / trans.max())


def code_of(c: Column) -> Column:
    """The three-letter code a label stands for; null for none, empty and `und`, `?` for one that isn't known."""
    k = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for p in CODES.items() for x in p])
    return F.when(c.isNull() | (k == "") | (k == "und"), F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, k), F.lit("?")))


def fit(docs: DataFrame, blocks: DataFrame) -> Field:
    """A field fitted on a bounded sample, taken by the hash of the row's key, of (key, text, lang)."""
    rows: list = []
    for df, most in ((docs, TRAIN_DOCS), (blocks, TRAIN_BLOCKS)):
        s = df.select("key", "text", code_of(F.col("lang")).alias("code")).where(F.col("code").isNotNull() & (F.col("code") != "?") & F.length("text").between(40, TRAIN_CHARS))
        # The keys first: a task that sends its candidates to the driver then sends no texts.
        keys = s.select("key").orderBy(F.xxhash64("key"), "key").limit(most).collect()
        rows += s.where(F.col("key").isin([r[0] for r in keys])).select("text", "code").collect()
    return _fit([(r[0], r[1]) for r in rows])


SEGMENTS = "key long, seg_no int, lang string, confidence double, begin int, end int, segs int"


def _segment(field: Field):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["text"].notna()]
            part = np.cumsum(f["text"].str.len().to_numpy()) // BATCH_CHARS if len(f) else []
            for k in np.unique(part):
                g = f[part == k]
                words: list[str] = []
                size = []
                for t in g["text"]:
                    w = split_words(t)
                    words += w
                    size.append(len(w))
                size = np.array(size, dtype=np.int64)
                lang, conf = field.label(words, size)
                sums = np.concatenate([[0.0], np.cumsum(conf, dtype=np.float64)])
                rows, at = [], 0
                for key, n in zip(g["key"].tolist(), size.tolist()):
                    if n >= LEAST_WORDS:
                        s = segments_of(lang[at : at + n])
                        rows += [(key, i, LANGS[x], round(float(sums[at + e] - sums[at + b]) / (e - b), 4), b, e, len(s)) for i, (b, e, x) in enumerate(s)]
                    at += n
                yield pd.DataFrame(rows, columns=["key", "seg_no", "lang", "confidence", "begin", "end", "segs"])

    return run


def segments(texts: DataFrame, field: Field) -> DataFrame:
    """(key, seg_no, lang, confidence, begin, end, segs) of (key, text): a row for each segment, words begin .. end - 1.

    Null texts and those below 12 words have none. Repeated rows are each segmented. Words without letters take the
    language around them; a text without any letter is one segment of the commonest language, with a low confidence.
    """
    return texts.select("key", "text").mapInPandas(_segment(field), SEGMENTS)


def _rows(spark, root: str, name: str, key: str) -> DataFrame:
    return table(spark, root, name).select(F.col(key).cast("long").alias("key"), "text", "lang")


def _cases(seg: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Segments of the rows whose label is missing or wrong, or that have more than one."""
    lab = rows.select("key", code_of(F.col("lang")).alias("code"))
    wrong = F.col("code").isNull() | (F.col("code") != F.col("lang")) | (F.col("segs") > 1)
    return seg.join(lab, "key").where(wrong).select(F.lit(name).alias("tbl"), F.col("key").alias("row_id"), "seg_no", "lang")


def p1_found(spark, root: str) -> DataFrame:
    docs, blocks = _rows(spark, root, "documents", "doc_id"), _rows(spark, root, "blocks", "block_pk")
    field = fit(docs, blocks)
    in_blocks = cut(segments(blocks, field))
    w = table(spark, root, "words").select("word_pk", F.col("block_pk").alias("key"), "ord", code_of(F.col("lang")).alias("code")).where("code is not null")
    of_word = w.join(in_blocks.select("key", "lang", "begin", "end"), "key").where((F.col("ord") >= F.col("begin")) & (F.col("ord") < F.col("end")) & (F.col("code") != F.col("lang")))
    return (
        _cases(in_blocks, blocks, "blocks")
        .unionByName(_cases(segments(docs, field), docs, "documents"))
        .unionByName(of_word.select(F.lit("words").alias("tbl"), F.col("word_pk").alias("row_id"), F.lit(0).alias("seg_no"), "lang"))
    )


def p1_segments(spark, root: str) -> DataFrame:
    """Every segment of the documents with its language and confidence."""
    docs, blocks = _rows(spark, root, "documents", "doc_id"), _rows(spark, root, "blocks", "block_pk")
    return segments(docs, fit(docs, blocks)).select(F.col("key").alias("doc_id"), "seg_no", "lang", "confidence", "begin", "end")


QUERIES = {"p1_found": p1_found, "p1_segments": p1_segments}
ORACLE: dict[str, str] = {}
