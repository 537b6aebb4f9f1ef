"""Text, search and linkage queries."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.plans.citations import t

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Query vectors that are broadcast at a time.
QUERY_BLOCK = 20_000
# Both engines fold alike: composed; without marks, tatweel, joiners and direction signs; letters and digits folded, lower
# case; what is neither letter, mark nor digit of any script becomes one blank. Two capitals that have no plain small letter go first.
_GONE = "|".join((X.MARKS, X.TATWEEL, X.BIDI, X.JOINERS))
_FROM, _TO = X.LETTERS_FROM + X.DIGITS_FROM + "İΣ", X.LETTERS_TO + X.DIGITS_TO + "iσ"
_APART = r"[^\p{L}\p{M}\p{N}]+"


def fold_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(translate(regexp_replace(nfc_normalize({c}), '{_GONE}', '', 'g'), '{_FROM}', '{_TO}')), '{_APART}', ' ', 'g'))"


class _Letters(dict):
    """Code points as they come out: letters, marks and digits folded by a table, what goes as nothing, the rest as `apart`."""

    def __init__(self, table: dict[int, int], apart: str | None):
        super().__init__()
        self.table, self.apart, self.gone = table, apart, re.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", _GONE))

    def __missing__(self, c: int) -> str | None:
        x = chr(c)
        kept = unicodedata.category(x)[0] in "LMN"
        self[c] = v = None if self.gone.match(x) else chr(self.table.get(c, c)) if kept else self.apart
        return v


_WORDS_OF, _KEY_OF = _Letters(str.maketrans(_FROM, _TO), " "), _Letters(str.maketrans(X.DIGITS_FROM, X.DIGITS_TO), None)


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: " ".join(unicodedata.normalize("NFC", x).translate(_WORDS_OF).lower().split()), na_action="ignore")


@F.pandas_udf(T.StringType())
def _exact(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x).translate(_KEY_OF), na_action="ignore")


def folded(c="text"):
    """Normal forms need Python; the rest goes along in the same Arrow batch, at a tenth of what it takes as expressions."""
    return _folded(F.col(c))


def words_sql(c: str) -> str:
    return f"list_filter(string_split({fold_sql(c)}, ' '), lambda x: x <> '')"


def words(c="text"):
    return F.filter(F.split(folded(c), " "), lambda w: w != "")


def worded(df, key, text="text", w="w"):
    """(key, w): the words, behind a generator so that folding isn't repeated for each use of them; null texts have none."""
    return df.where(F.col(text).isNotNull()).select(key, F.explode(F.array(words(text))).alias(w))


WORDS = words_sql("text")


@query(f"""SELECT coalesce(lang, '-') AS lang, count(*) AS docs, CAST(sum(len({WORDS})) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def folded_token_counts(s, d):
    return t(s, d, "documents").groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("docs"), F.sum(F.size(words())).cast("long").alias("words"), F.sum(F.length("text")).alias("chars"))


@query(f"""SELECT w AS word, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM words) WHERE length(w) >= 2 GROUP BY 1 HAVING count(*) >= 2""")
def word_list_learning(s, d):
    # The spellings are counted first, so that each is folded once.
    spelled = t(s, d, "words").where("text is not null").groupBy("text").agg(F.count("*").alias("k"))
    return spelled.select("k", F.explode(words()).alias("word")).where("length(word) >= 2").groupBy("word").agg(F.sum("k").alias("n")).where("n >= 2")


@query(f"""SELECT w AS word, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest({WORDS}) AS w FROM documents) WHERE w <> '' GROUP BY 1 HAVING count(*) >= 5""")
def lexicon_doc_frequency(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(F.array_distinct(words())).alias("word")).groupBy("word").agg(F.count("*").alias("docs")).where("docs >= 5")


_FR, _EN = ["le", "la", "les", "des", "du", "et", "est", "dans"], ["the", "of", "and", "in", "to", "is", "that", "from"]


@query(f"""WITH c AS (SELECT doc_id, len(list_filter({WORDS}, lambda x: x IN ({", ".join(map(repr, _FR))}))) AS fr, len(list_filter({WORDS}, lambda x: x IN ({", ".join(map(repr, _EN))}))) AS en,
  length(regexp_replace(text, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) AS ar, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS la FROM documents)
  SELECT CASE WHEN ar > la THEN 'ara' WHEN fr > en THEN 'fre' ELSE 'eng' END AS guess, count(*) AS docs FROM c GROUP BY 1""")
def language_by_marker_words(s, d):
    hits = lambda ws: F.size(F.filter("w", lambda x: x.isin(ws)))
    n = lambda p: F.length(F.regexp_replace("text", p, ""))
    g = F.when(n(r"[^\x{0600}-\x{06FF}]") > n("[^A-Za-z]"), "ara").when(hits(_FR) > hits(_EN), "fre").otherwise("eng")
    return t(s, d, "documents").select("text", F.explode(F.array(F.coalesce(words(), F.array().cast("array<string>")))).alias("w")).groupBy(g.alias("guess")).agg(F.count("*").alias("docs"))


@query()
def loop_detection(s, d):
    """Documents in which a phrase of one to six words stands four times in a row."""
    return t(s, d, "documents").where(F.regexp_replace("text", r"\s+", " ").rlike(X.LOOP)).select("doc_id")


@query("""WITH h AS (SELECT DISTINCT stem, page, trim(regexp_replace(string_split(text, chr(10))[1], '[0-9]+', '#', 'g')) AS head FROM blocks)
  SELECT stem, head, count(*) AS pages FROM h GROUP BY 1, 2 HAVING count(*) >= 3""")
def repeated_line_heads(s, d):
    h = t(s, d, "blocks").select("stem", "page", F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), "[0-9]+", "#")).alias("head")).distinct()
    return h.groupBy("stem", "head").agg(F.count("*").alias("pages")).where("pages >= 3")


@query("""SELECT sha, count(*) AS rows_, count(DISTINCT stem) AS stems, min(stem) AS first_stem FROM article_runs WHERE sha IS NOT NULL GROUP BY 1 HAVING count(DISTINCT stem) > 1""")
def contradiction_groups(s, d):
    return t(s, d, "article_runs").where("sha is not null").groupBy("sha").agg(F.count("*").alias("rows_"), F.countDistinct("stem").alias("stems"), F.min("stem").alias("first_stem")).where("stems > 1")


@query(f"""WITH k AS (SELECT doc_id, regexp_replace(translate(regexp_replace(nfc_normalize(text), '{_GONE}', '', 'g'), '{X.DIGITS_FROM}', '{X.DIGITS_TO}'), '{_APART}', '', 'g') AS k FROM documents)
  SELECT md5(k) AS key, min(doc_id) AS first_doc, count(*) AS copies FROM k WHERE k <> '' GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(s, d):
    """Texts of equal letters and digits, of any script; letters that only resemble each other stay apart."""
    k = t(s, d, "documents").select("doc_id", _exact("text").alias("k")).where("k <> ''")
    return k.groupBy(F.md5("k").alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


@query(f"""WITH a AS (SELECT DISTINCT stem, issue_id, list_distinct({words_sql("title")}) AS w FROM articles WHERE title IS NOT NULL)
  SELECT x.stem AS stem_a, y.stem AS stem_b, round(max(len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w))), 6) AS share FROM a x JOIN a y ON x.issue_id = y.issue_id AND x.stem < y.stem
  WHERE len(x.w) > 0 AND len(y.w) > 0 AND len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) >= 0.3 GROUP BY 1, 2""")
def same_title_candidates(s, d):
    a = t(s, d, "articles").where("title is not null").select("stem", "issue_id", F.array_sort(F.array_distinct(words("title"))).alias("w")).where("size(w) > 0").distinct()
    b = a.select(F.col("stem").alias("stem_b"), "issue_id", F.col("w").alias("v"))
    x = a.join(b, "issue_id").where("stem < stem_b").withColumn("share", X.tokset("w", "v")).where("share >= 0.3")
    return x.groupBy(F.col("stem").alias("stem_a"), "stem_b").agg(F.round(F.max("share"), 6).alias("share"))


@query(f"""WITH i AS (SELECT item_id, {WORDS} AS w FROM eval_items), ib AS (SELECT DISTINCT item_id, w[k] || ' ' || w[k + 1] AS g FROM (SELECT item_id, w, unnest(range(1, len(w))) AS k FROM i)),
  o AS (SELECT doc_id, {WORDS} AS w FROM documents), ob AS (SELECT DISTINCT doc_id, w[k] || ' ' || w[k + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM o))
  SELECT item_id, count(*) AS seeds, count(DISTINCT doc_id) AS docs FROM ib JOIN ob ON ib.g = ob.g GROUP BY 1""")
def quotation_seeds(s, d):
    """How many pairs of neighbouring words of each item stand in documents.

    The pairs of a document that no item has are gone before the documents' pairs are shuffled: those of the items, the
    query set, tell them apart where they are few enough to be sent out (Spark decides by their size).
    """
    grams = lambda n, k: worded(t(s, d, n), k).select(k, F.explode(F.array_distinct(X.ngram_hashes(F.col("w"), 2))).alias("g"))
    asked = grams("eval_items", "item_id")
    hits = grams("documents", "doc_id").join(asked, "g")
    return hits.groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.sum("n").alias("seeds"), F.count("*").alias("docs"))


_ASKED = ["library", "treaty", "survey"]


@query(f"""SELECT doc_id FROM (SELECT DISTINCT doc_id, unnest({WORDS}) AS w FROM documents) WHERE w IN ({", ".join(map(repr, _ASKED))}) GROUP BY 1 HAVING count(*) = {len(_ASKED)}""")
def and_search(s, d):
    return X.and_search(worded(t(s, d, "documents"), "doc_id"), "doc_id", "w", _ASKED)


@query(f"""WITH o AS (SELECT doc_id, {WORDS} AS w FROM documents), tf AS (SELECT doc_id, x AS w, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS x FROM o) WHERE x IN ({", ".join(map(repr, _ASKED))}) GROUP BY 1, 2),
  df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM o)
  SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(o.w) / avg_len))), 6) AS score
  FROM tf JOIN df ON tf.w = df.w JOIN o ON tf.doc_id = o.doc_id CROSS JOIN n GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""")
def ranked_search(s, d):
    return X.bm25(worded(t(s, d, "documents"), "doc_id"), "doc_id", "w", _ASKED, 20)


@query()
def greedy_name_pairs(s, d):
    """Per publication, printed names paired best first with catalogue names of the same text similarity of .6 at least."""
    from quire.functions.kernels import greedy_pairs

    m = t(s, d, "meta_draw").where("authors is not null").groupBy("stem", "seq").agg(F.array_sort(F.collect_set(F.when(F.col("source") == "ours", F.col("authors")))).alias("ours"), F.array_sort(F.collect_set(F.when(F.col("source") != "ours", F.col("authors")))).alias("theirs"))
    m = m.where((F.size("ours") > 0) & (F.size("theirs") > 0))

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([(a, b, x, y, round(z, 4)) for a, b, o, c in zip(f["stem"], f["seq"], f["ours"], f["theirs"]) for x, y, z in greedy_pairs(list(o), list(c), 0.6)], columns=["stem", "seq", "ours", "theirs", "score"])

    return m.mapInPandas(run, "stem string, seq int, ours string, theirs string, score double")


@query()
def cer_by_journal(s, d):
    """First delivery of a block against its last, in characters of any script; DuckDB's distance counts bytes."""
    k = F.struct("loaded", "block_pk")
    o = t(s, d, "blocks").withColumn("x", X.squeeze(X.nfc(F.col("text")))).groupBy("stem", "block_id").agg(F.min_by("x", k).alias("a"), F.max_by("x", k).alias("b"), F.count("*").alias("n")).where("n > 1")
    x = o.groupBy(F.substring_index("stem", "-", 1).alias("journal")).agg(F.count("*").alias("blocks"), F.sum(F.levenshtein("a", "b").cast("long")).alias("errors"), F.sum(F.length("a").cast("long")).alias("chars"))
    return x.withColumn("cer", F.round(F.try_divide(F.col("errors"), F.col("chars")), 6))


@query("""WITH b AS (SELECT DISTINCT stem, page, ord, vpos FROM blocks) SELECT x.stem, count(*) AS pairs, CAST(sum(CASE WHEN x.vpos < y.vpos THEN 1 ELSE 0 END) AS BIGINT) AS concordant
  FROM b x JOIN b y ON x.stem = y.stem AND x.page = y.page AND x.ord < y.ord GROUP BY 1""")
def order_concordance(s, d):
    b = t(s, d, "blocks").select("stem", "page", "ord", "vpos").distinct()
    y = b.select("stem", "page", F.col("ord").alias("o"), F.col("vpos").alias("v"))
    return b.join(y, ["stem", "page"]).where("ord < o").groupBy("stem").agg(F.count("*").alias("pairs"), F.sum(F.when(F.col("vpos") < F.col("v"), 1).otherwise(0)).alias("concordant"))


@query(f"""WITH w AS (SELECT stem, text AS x, count(*) AS n FROM words GROUP BY 1, 2), b AS (SELECT stem, x, count(*) AS m FROM (SELECT stem, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS x FROM blocks) GROUP BY 1, 2)
  SELECT coalesce(w.stem, b.stem) AS stem, CAST(sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0)) AS BIGINT) AS missing, CAST(sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0)) AS BIGINT) AS extra, CAST(sum(coalesce(m, 0)) AS BIGINT) AS expected
  FROM w FULL JOIN b ON w.stem = b.stem AND w.x = b.x GROUP BY 1""")
def multiset_balance(s, d):
    w = t(s, d, "words").groupBy("stem", F.col("text").alias("x")).agg(F.count("*").alias("n"))
    b = t(s, d, "blocks").select("stem", F.explode(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")).alias("x")).groupBy("stem", "x").agg(F.count("*").alias("m"))
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return w.join(b, ["stem", "x"], "full").groupBy("stem").agg(F.sum(F.greatest(m - n, F.lit(0))).alias("missing"), F.sum(F.greatest(n - m, F.lit(0))).alias("extra"), F.sum(m).alias("expected"))


@query("""SELECT regexp_replace(stem, '[0-9]', 'N', 'g') AS shape, count(*) AS n FROM article_runs WHERE stem IS NOT NULL GROUP BY 1 ORDER BY n DESC, shape LIMIT 25""")
def id_shape_profile(s, d):
    return t(s, d, "article_runs").where("stem is not null").groupBy(F.regexp_replace("stem", "[0-9]", "N").alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(25)


@query("""SELECT doc_id, lang, split_part(stem, '-', 1) AS journal, CAST(split_part(stem, '-', 2) AS INT) AS volume, CAST(split_part(stem, '-', 3) AS INT) AS issue, CAST(split_part(stem, '-', 4) AS INT) AS article FROM documents WHERE regexp_full_match(stem, '\\d+-\\d+-\\d+-\\d+')""")
def id_parts(s, d):
    p = F.split("stem", "-")
    return t(s, d, "documents").where(F.col("stem").rlike(r"^\d+-\d+-\d+-\d+$")).select("doc_id", "lang", p[0].alias("journal"), p[1].cast("int").alias("volume"), p[2].cast("int").alias("issue"), p[3].cast("int").alias("article"))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q, vec_id, label, round(list_sum(list_transform(list_zip(e, embedding), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))), 6) AS dist FROM q JOIN embeddings ON q <> vec_id)
  SELECT q, arg_min(vec_id, (dist, vec_id)) AS nearest, arg_min(label, (dist, vec_id)) AS label, min(dist) AS dist FROM d GROUP BY 1""")
def nearest_template(s, d):
    """The queries are a stated set; they are sent to all vectors in blocks of QUERY_BLOCK, and the nearest are kept by partial aggregation."""
    e = t(s, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dist = F.round(F.aggregate(F.zip_with("e", "embedding", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, b: a + b), 6)
    k = F.struct("dist", "vec_id")
    out = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else asked
        x = e.join(F.broadcast(part), F.col("q") != F.col("vec_id")).select("q", "vec_id", "label", dist.alias("dist"))
        x = x.groupBy("q").agg(F.min_by("vec_id", k).alias("nearest"), F.min_by("label", k).alias("label"), F.min("dist").alias("dist"))
        out = x if out is None else out.unionByName(x)
    return out


@query("""WITH k AS (SELECT doc_id, coalesce(lang, '-') AS lang, row_number() OVER (PARTITION BY coalesce(lang, '-') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) SELECT doc_id, lang FROM k WHERE n <= 5""")
def stratified_sample(s, d):
    """A quota of five documents for each label, drawn by hash; a sampling operator. Top five per group, without a sort of it."""
    x = t(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    return x.withColumn("n", F.row_number().over(w)).where("n <= 5").select("doc_id", "lang")


@query("""SELECT item_id, CASE WHEN instr('02468ace', substr(md5(CAST(item_id AS VARCHAR)), 32, 1)) > 0 THEN 'A' ELSE 'B' END AS side FROM eval_items""")
def blind_ab_split(s, d):
    return t(s, d, "eval_items").select("item_id", F.when(F.substring(F.md5(F.col("item_id").cast("string")), 32, 1).rlike("[02468ace]"), "A").otherwise("B").alias("side"))


@query()
def dataset_record(s, d):
    """One nested JSON record per article: its pages and blocks in order, from the latest delivery of each block."""
    latest = t(s, d, "blocks").groupBy("stem", "page", "block_id").agg(F.max_by(F.struct("ord", "role", "lang", "text"), F.struct("loaded", "block_pk")).alias("b"))
    pages = latest.groupBy("stem", "page").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    art = pages.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("page", "blocks"))).alias("pages"))
    return art.select("stem", F.to_json(F.struct("stem", "pages")).alias("record"))
