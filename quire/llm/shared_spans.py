"""Long exact spans shared between records.

Sliding sentence spans. A text is cut at sentence ends; where 64 positions in a row hold none, also before the word start
(or, without one, the position) with the smallest hash among them. Every run of consecutive pieces, from each cut to the
first cut at least 200 characters on, is hashed and joined globally. A cut depends on 64 positions only, so two texts that
share 400 characters also share a run among them (see LEAST_RUN): no shared stretch is missed.

An exact check follows on the runs that more than one document holds, by hashes again and without pairs: the stretches
that begin up to 66 positions before the run's first cut are all shared if the 466 characters they cover are, none is if
the 334 characters they have in common aren't. Only at the ends of a span is each stretch of 400 looked up by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut
from quire.sources.tables import table

#: Positions among which there is always a cut.
W = 64
STRETCH = 400
#: What decides on a cut reaches two characters before its window and three behind it. So a shared stretch has a common
#: cut at most REACH positions after its begin.
REACH = W + 2
#: A run is at least so long, and ends at the latest REACH + LEAST_RUN + W positions after a stretch's begin; that must be
#: before STRETCH - W - 3, where cuts begin to depend on what follows the stretch.
LEAST_RUN = 200
SENTENCE_END = np.array(sorted(map(ord, ".!?؟۔。")), dtype=np.uint32)
#: Characters hashed at a time. Longer texts make a larger batch, a text is never parted.
BATCH_CHARS = 2_000_000
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse (mod 2^64), at least n of each; kept for the next batch."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, dtype=np.uint64)])) for b in (_B, _BINV)]
    return _POWERS[0], _POWERS[1]


class Texts:
    """A batch of texts as one array of code points, with hashes of any of its substrings."""

    def __init__(self, texts: list[str]):
        coded = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        self.n = np.array([len(c) for c in coded], dtype=np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        self.c = np.concatenate([*coded, np.zeros(0, dtype=np.uint32)])
        p, self.inv = _powers(len(self.c) + 1)
        self.h = _mix(self.c.astype(np.uint64) + np.uint64(11))
        with np.errstate(over="ignore"):
            self.q = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.h * p[: len(self.c)])])

    def hash(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """Of the substrings from a up to but without b, as signed 64-bit numbers."""
        with np.errstate(over="ignore"):
            return _mix((self.q[b] - self.q[a]) * self.inv[a] + (np.asarray(b) - a).astype(np.uint64)).view(np.int64)

    def cuts(self) -> np.ndarray:
        """Positions where a piece begins; see the module."""
        c, n = self.c, len(self.c)
        if n == 0:
            return np.zeros(0, dtype=np.int64)
        blank = (c == 32) | (c == 10) | (c == 9) | (c == 13) | (c == 0xA0)
        starts = np.zeros(n, dtype=bool)
        starts[1:] = blank[:-1] & ~blank[1:]
        # A sentence begins at the first character after its end mark and blanks, or after an empty line.
        end = np.isin(c, SENTENCE_END)
        fresh = np.zeros(n, dtype=bool)
        fresh[2:] = starts[2:] & blank[1:-1] & (end[:-2] | ((c[1:-1] == 10) & (c[:-2] == 10)))
        # Rank of the positions: word starts before others, then by the hash of the next four characters.
        with np.errstate(over="ignore"):
            r = self.h.copy()
            for k in (1, 2, 3):
                r[: n - k] += self.h[k:] * np.uint64(2 * k + 7)
        r = _mix(r) >> np.uint64(2)
        r |= np.where(starts, np.uint64(0), np.uint64(1) << np.uint64(62))
        # Smallest rank in each window of W positions; a window with a sentence's begin chooses nothing.
        m = r.copy()
        m[fresh] = 0
        size = 1
        while size < W:
            step = min(size, W - size)
            m = np.minimum(m[: len(m) - step], m[step:]) if len(m) > step else m[:0]
            size += step
        if len(m):
            # A position is chosen if its rank is the smallest of a window that holds it.
            most = np.zeros(n, dtype=np.uint64)
            most[: len(m)] = m
            size = 1
            while size < W:
                step = min(size, W - size)
                most[step:] = np.maximum(most[step:], most[:-step].copy())
                size += step
            fresh |= (r == most) & (most > 0)
        return np.nonzero(fresh)[0]

    def text_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, pos, side="right") - 1


def _batches(frames: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """Frames of about BATCH_CHARS characters, without null texts."""
    for f in frames:
        f = f[f[text].notna()]
        size = f[text].str.len().to_numpy()
        part = np.cumsum(size) // BATCH_CHARS if len(f) else size
        for k in np.unique(part):
            yield f[part == k]


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in _batches(frames, "text"):
        t = Texts(f["text"].tolist())
        c = t.cuts()
        ends = np.searchsorted(c, c + LEAST_RUN)
        ok = ends < len(c)
        c, e = c[ok], c[ends[ok]]
        d = t.text_of(c)
        last = t.off[d + 1]
        ok = e <= last
        c, e, d, last = c[ok], e[ok], d[ok], last[ok]
        # The stretches to test begin at lo .. hi, so that all of them lie within the text and hold the cut.
        first = t.off[d]
        lo, hi = np.maximum(c - REACH, first), np.minimum(c, last - STRETCH)
        ok = lo <= hi
        c, e, d, lo, hi = c[ok], e[ok], d[ok], lo[ok], hi[ok]
        # Both are told from the cut alone, else equal texts would differ where one of them begins or ends.
        full = hi - lo == REACH
        outer = pd.array(t.hash(lo, np.where(full, hi + STRETCH, lo)), dtype="Int64")
        outer[~full] = pd.NA
        yield pd.DataFrame(
            {
                "run": t.hash(c, e), "outer": outer, "inner": t.hash(c, c + STRETCH - REACH),
                "doc_id": f["doc_id"].to_numpy()[d], "pos": (c - t.off[d]) * PACK + (c - hi),
            }
        )


_RUNS = "run long, outer long, inner long, doc_id long, pos long"
#: pos holds the cut's position times PACK, and how far before it the last stretch begins. One number shuffles as one field.
PACK = 128


def _unpacked(df: DataFrame) -> DataFrame:
    """With the first and the last begin of the stretches in place of pos."""
    at = F.floor(F.col("pos") / PACK)
    return df.withColumn("lo", F.greatest(at - REACH, F.lit(0)).cast("int")).withColumn("hi", (at - F.pmod("pos", F.lit(PACK))).cast("int")).drop("pos")


def _shared(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that rows of more than one document have."""
    return df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select(*keys)


def _stretches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every stretch of the documents that begins in one of their ranges (los .. his)."""
    for f in _batches(frames, "text"):
        t = Texts(f["text"].tolist())
        at = [
            np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(x, y)])) + o for x, y, o in zip(f["los"], f["his"], t.off)
        ]
        d = np.repeat(np.arange(len(at)), [len(a) for a in at])
        at = np.concatenate([*at, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        yield pd.DataFrame({"h": t.hash(at, at + STRETCH), "doc_id": f["doc_id"].to_numpy()[d], "lo": (at - t.off[d]).astype(np.int32)})


def _merged(rows: DataFrame) -> DataFrame:
    """Stretches that begin at lo .. hi, merged into spans per document."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = rows.withColumn("new", F.when(F.col("lo") <= before + STRETCH, 0).otherwise(1))
    s = s.withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy("doc_id", "no").agg(F.min("lo").alias("span_start"), (F.max("hi") + STRETCH).cast("int").alias("span_end")).drop("no")


def shared_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): the stretches of 400 characters that also occur in another document, merged.

    docs: (doc_id BIGINT unique, text). Null and shorter texts have no spans. Code points are counted and compared as
    they are. A stretch that only the same document repeats is not shared. Rows with the same doc_id count as one
    document. No pairs of documents are formed: groups of equal hashes are only counted, after a partial count on the
    map side.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= STRETCH)
    runs = docs.mapInPandas(_runs, _RUNS)
    held = cut(runs.join(_shared(runs, "run"), "run", "left_semi"))
    outer = _shared(held, "outer").withColumn("whole", F.lit(True))
    inner = _shared(held, "inner").withColumn("some", F.lit(True))
    held = cut(_unpacked(held.join(outer, "outer", "left").join(inner, "inner", "left").where("some").select("run", "outer", "doc_id", "pos", "whole")))
    # What can hold a partner of a stretch at an end: such rows themselves, and of the rows that are shared whole, one
    # document for each text. They have the run in common.
    open_ = held.where("whole is null").select("run").distinct()
    near = held.join(open_, "run", "left_semi")
    one = near.where("whole").groupBy("outer").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("s")).select("s.doc_id", "s.lo", "s.hi")
    two = near.where("whole").groupBy("outer").agg(F.max(F.struct("doc_id", "lo", "hi")).alias("s")).select("s.doc_id", "s.lo", "s.hi")
    ends = near.where("whole is null").select("doc_id", "lo", "hi").unionByName(one).unionByName(two)
    ranges = ends.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("s")).select("doc_id", F.col("s.lo").alias("los"), F.col("s.hi").alias("his"))
    each = cut(docs.join(ranges, "doc_id").mapInPandas(_stretches, "h long, doc_id long, lo int"))
    at_ends = each.join(_shared(each, "h"), "h", "left_semi").select("doc_id", "lo", F.col("lo").alias("hi"))
    return _merged(held.where("whole").select("doc_id", "lo", "hi").unionByName(at_ends))


def p9_found(spark, root: str) -> DataFrame:
    return shared_spans(table(spark, root, "documents"))


def p9_share(spark, root: str) -> DataFrame:
    """For each document with a text, how much of it is shared elsewhere."""
    docs = table(spark, root, "documents")
    s = shared_spans(docs).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    n = F.length("text")
    return (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", n.cast("long").alias("chars"))
        .join(s, "doc_id", "left")
        .select("doc_id", "chars", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.round(F.coalesce("shared_chars", F.lit(0)) / F.greatest("chars", F.lit(1)), 6).alias("share"))
    )


QUERIES = {"p9_found": p9_found, "p9_share": p9_share}
ORACLE: dict[str, str] = {}
