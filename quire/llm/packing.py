"""Fixed-capacity containers filled with documents.

Conflict-constrained best-fit. Documents go through in falling size; the bins stand in the order of their free room and
carry bitmaps of the sources and duplicate clusters in them. From the tightest bin with room enough the search goes on to
the next until one holds neither the document's source nor its cluster. Where the sources leave none (one of them may
hold a third of all rows), the tightest bin without the cluster takes it; only where there is none either, a new bin opens.

Documents are dealt to shards by their key's hash, each shard is packed by itself, and its open bins go into a last round.

A duplicate cluster is documents that are linked by five-word shingles alike to SIMILAR and more: their minima under
HASHES orders of the shingles are compared with those of the first document that has a band of them in common, and the
links are consolidated. Of pairs alike to 0.8 all but 4 in 10,000 have a common band.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.components import seed_tree
from quire.operators.skew import hot_join, hot_keys
from quire.session import cut
from quire.sources.tables import table

CAPACITY = 2048
#: The public tokenizer whose tokens are counted; see the folder's README.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level tokenizers part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that are packed in one task, on average.
PER_SHARD = 20_000
PIECES = "doc_id long, piece int, char_start int, char_end int, tokens int"

#: Words of a shingle, orders of shingles, those of a band, and the share of equal minima that makes a link (0.8 is in
#: 97 of 100 cases seen as 0.72 or more).
SHINGLE, HASHES, BAND, SIMILAR = 5, 100, 5, 0.72
#: Words whose hash a worker keeps at a time.
KEPT_WORDS = 500_000

_ENCODERS: dict = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def cut_tokens(enc, tokens: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(char_start, char_end, tokens) of pieces of at most `capacity` tokens that end between two characters."""
    raw = [enc.decode_single_token_bytes(t) for t in tokens]
    ends = []  # characters that are complete after each token, -1 inside of one
    chars = open_ = 0
    for r in raw:
        for b in r:
            if b & 0xC0 != 0x80:
                chars += 1
                open_ = 0 if b < 0x80 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            else:
                open_ -= 1
        ends.append(chars if open_ == 0 else -1)
    out, a, at = [], 0, 0
    while a < len(tokens):
        b = min(a + capacity, len(tokens))
        while b > a + 1 and ends[b - 1] < 0:
            b -= 1
        out.append((at, ends[b - 1], b - a))
        a, at = b, ends[b - 1]
    return out


def _sizes(path: str, capacity: int):
    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"].tolist(), f["text"]):
                tokens = enc.encode_ordinary(t)
                if len(tokens) <= capacity:
                    rows.append((d, 0, 0, len(t), len(tokens)))
                else:
                    rows += [(d, i, *p) for i, p in enumerate(cut_tokens(enc, tokens, capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "char_start", "char_end", "tokens"])

    return sizes


def best_fit(items: list[tuple[int, int, int]], capacity: int, bins: list[list] | None = None) -> tuple[list[int], list[list]]:
    """Bin numbers of the items (size, source bit, cluster bit or -1), and the bins [free, sources, clusters]. Sizes should fall."""
    bins = [] if bins is None else bins
    order = sorted((b[0], k) for k, b in enumerate(bins))
    where = []
    for size, src, dup in items:
        s, c = 1 << src, 1 << dup if dup >= 0 else 0
        take = second = -1
        for i in range(bisect_left(order, (size, -1)), len(order)):
            b = bins[order[i][1]]
            if b[2] & c:
                continue
            if not b[1] & s:
                take = i
                break
            second = i if second < 0 else second
        i = take if take >= 0 else second
        if i < 0:
            bins.append([capacity, 0, 0])
            k = len(bins) - 1
        else:
            k = order.pop(i)[1]
        b = bins[k]
        b[0] -= size
        b[1] |= s
        b[2] |= c
        if b[0] > 0:
            insort(order, (b[0], k))
        where.append(k)
    return where, bins


def _pack(capacity: int):
    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        src, dup = pd.factorize(f["source"], use_na_sentinel=False)[0], pd.factorize(f["cluster"])[0]
        where, bins = best_fit(list(zip(f["tokens"].tolist(), src.tolist(), dup.tolist())), capacity)
        f["bin"] = pd.Series(where, dtype="int64")
        f["free"] = [bins[k][0] for k in where]
        return f[["doc_id", "piece", "tokens", "source", "cluster", "shard", "bin", "free"]]

    return pack


_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w) >> 1
        return h


_HASHES = _Hashes()
_ORDERS = np.random.default_rng(5).integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def minima(text: str) -> np.ndarray | None:
    """The least hash of the text's shingles in each order; of fewer words than a shingle's their only one, None without words."""
    words = _WORD.findall(text.lower())
    if not words:
        return None
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(h))
    g = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        g ^= g >> np.uint64(31)
        g = np.unique(g * np.uint64(0xD6E8FEB86659FD93))
        least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for a in range(0, len(g), 20_000):
            x = g[a : a + 20_000, None] * _ORDERS
            least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    return least


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    mix = np.uint64(0x100000001B3)
    for f in frames:
        rows = []
        for d, t in zip(f["doc_id"].tolist(), f["text"]):
            m = minima(t)
            if m is not None:
                bands = np.arange(HASHES // BAND, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(BAND):
                        bands = (bands ^ m[k::BAND]) * mix
                rows.append((d, (m >> np.uint64(20)).astype(np.uint16).tobytes(), bands.view(np.int64)))
        yield pd.DataFrame(rows, columns=["doc_id", "sig", "bands"])


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean()) for x, y in zip(a, b)])


def duplicate_clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, cluster): of documents (doc_id BIGINT, text) that others are nearly or wholly alike to, the cluster's first
    document; of all others themselves. Texts without letters and digits, and null ones, are in no cluster and have no row.
    """
    signed = cut(docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(_signed, "doc_id long, sig binary, bands array<long>"))
    in_band = signed.select("doc_id", F.explode("bands").alias("band"))
    firsts = in_band.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = hot_join(in_band, firsts.select("band", "first"), "band", hot_keys(firsts, "band", "n"), F.col("doc_id")).where("doc_id <> first").select("doc_id", "first").distinct()
    met = cut(met)
    sig = signed.select("doc_id", "sig").dropDuplicates(["doc_id"])
    with_own = met.join(sig, "doc_id")
    hot = hot_keys(met.groupBy("first").agg(F.count("*").alias("n")), "first", "n")
    both = hot_join(with_own, sig.select(F.col("doc_id").alias("first"), F.col("sig").alias("sig_first")), "first", hot, F.col("doc_id"))
    links = both.where(_likeness("sig", "sig_first") >= SIMILAR).select("doc_id", "first")
    groups = seed_tree(links, "doc_id", "first").select(F.col("member_key").cast("long").alias("doc_id"), F.col("first_key").cast("long").alias("cluster"))
    return signed.select("doc_id").distinct().join(groups, "doc_id", "left").select("doc_id", F.coalesce("cluster", "doc_id").cast("string").alias("cluster"))


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, per_shard: int = PER_SHARD) -> DataFrame:
    """(doc_id, piece, char_start, char_end, tokens, container): every document in a container, pieces in order from 0.

    docs: (doc_id BIGINT unique, text, source). The sizes are tokens of a public tokenizer; no container holds more than
    `capacity`, and only a document of more is divided, into full containers and a rest, between two characters. A null
    or empty text has no tokens, it goes into any container. A container holds one document of a duplicate cluster, but
    any number of those without letters and digits; null sources are one source. Repeated rows are copies of one another.
    An empty table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "source")
    info = d.select("doc_id", "source").join(duplicate_clusters(d), "doc_id", "left")
    pieces = cut(d.select("doc_id", "text").mapInPandas(_sizes(tokenizer, capacity), PIECES))
    shards = max(1, -(-pieces.count() // per_shard))
    items = pieces.join(info, "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    schema = "doc_id long, piece int, tokens int, source string, cluster string, shard int, bin long, free int"
    done = cut(items.select("doc_id", "piece", "tokens", "source", "cluster", "shard").groupBy("shard").applyInPandas(_pack(capacity), schema))
    if shards > 1:
        # Bins that a shard left open, less than 15/16 full, are opened again and packed together; they are few.
        loose = F.col("free") * 16 > capacity
        again = done.where(loose).select("doc_id", "piece", "tokens", "source", "cluster", (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, shards // 16))) + shards).cast("int").alias("shard"))
        done = done.where(~loose).unionByName(again.groupBy("shard").applyInPandas(_pack(capacity), schema))
    box = done.select("doc_id", "piece", F.concat_ws("-", "shard", "bin").alias("container"))
    return pieces.join(box, ["doc_id", "piece"])


def p7_packed(spark, root: str) -> DataFrame:
    return packed(table(spark, root, "documents"))


def p7_fill(spark, root: str) -> DataFrame:
    """One row: containers, tokens, the share of room that is used, and the most a container holds."""
    b = p7_packed(spark, root).groupBy("container").agg(F.sum("tokens").alias("t"))
    return b.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * CAPACITY), 4).alias("used"), F.max("t").alias("most"))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
