"""Doubt about words and blocks: signals, reasons, marks, and checks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below this an engine's confidence is a reason to doubt a word.
LOW = 0.8
#: A common word is forgiven a confidence of so much; common means so many documents.
FORGIVEN, COMMON = 0.6, 5
#: Marks of whole blocks: share of words and least number of them.
MOSTLY_HAND, LEAST_HAND, MOSTLY_MARKED = 0.5, 10, 0.3


def signals(words: DataFrame, by: list[str] = ("stem",)) -> DataFrame:
    """words (key columns, text, conf, height) with relative height, Latin and Persian flags. Medians are per `by`."""
    m = words.groupBy(*by).agg(F.median("height").alias("mid"))
    x = words.join(m, list(by), "left")
    return x.withColumn("rel", F.try_divide(F.col("height"), F.col("mid"))).withColumn("latin", F.col("text").rlike("[A-Za-z]")).withColumn("persian", F.col("text").rlike("[پچژگ]")).drop("mid")


def reasons(s: DataFrame) -> DataFrame:
    """Adds `why`, the array of reasons to doubt a word."""
    one = lambda c, n: F.when(c, n)
    c = F.col
    speck = (F.length("text") == 1) & (F.coalesce(c("rel"), F.lit(1.0)) < 0.5)
    why = F.array(one(c("conf") < LOW, "conf"), one(speck, "speck"), one(~c("text").rlike(r"[\p{L}\p{N}]"), "ornament"), one(c("latin"), "latin"), one(c("persian"), "persian"))
    return s.withColumn("why", F.array_compact(why))


def refine(s: DataFrame, lexicon: DataFrame, key: str = "word") -> DataFrame:
    """A word doubted only for its confidence is cleared if it is common (lexicon: word, docs) and the confidence isn't too low."""
    common = lexicon.where(F.col("docs") >= COMMON).select(F.col("word").alias("__w"), F.lit(True).alias("__common"))
    x = s.join(common, s[key] == common["__w"], "left")
    clear = (F.col("why") == F.array(F.lit("conf"))) & F.coalesce("__common", F.lit(False)) & (F.col("conf") >= FORGIVEN)
    return x.withColumn("why", F.when(clear, F.array().cast("array<string>")).otherwise(F.col("why"))).drop("__w", "__common")


def block_profile(words: DataFrame, key: str) -> DataFrame:
    """(key, n, mid, quarter, tenth): floor-index quantiles of the confidences; a block is bounded."""
    q = words.where("conf is not null").groupBy(key).agg(F.array_sort(F.collect_list("conf")).alias("c"))
    at = lambda p: F.get("c", F.floor(F.lit(p) * F.size("c")).cast("int"))
    return q.select(key, F.size("c").alias("n"), at(0.5).alias("mid"), at(0.25).alias("quarter"), at(0.1).alias("tenth"))


def in_region(words: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """In marked regions only specific reasons stay; a low confidence stays if it is low even for the block."""
    x = words.join(profile.select(key, "mid", "tenth"), key, "left")
    very = (F.col("conf") < 0.5 * F.col("mid")) & (F.col("conf") <= F.col("tenth"))
    kept = F.filter("why", lambda r: (r != "conf") | very)
    return x.withColumn("why", F.when(F.col("marked"), kept).otherwise(F.col("why"))).drop("mid", "tenth")


def region_marks(words: DataFrame, key: str) -> DataFrame:
    """(key, mark): handwritten or vowelled blocks. words: (key, text, hand)."""
    vowel = F.col("text").rlike(r"[\x{064B}-\x{0652}]")
    g = words.groupBy(key).agg(F.count("*").alias("n"), F.avg((F.col("hand") > 0.5).cast("int")).alias("h"), F.avg(vowel.cast("int")).alias("v"))
    mark = F.when((F.col("n") >= LEAST_HAND) & (F.col("h") >= MOSTLY_HAND), "handwritten").when(F.col("v") >= MOSTLY_MARKED, "vowelled")
    return g.select(key, mark.alias("mark")).where("mark is not null")


def marks(words: DataFrame) -> DataFrame:
    """Adds `mark`: verified before corrected before flagged before agreed. words: (why, verified, corrected)."""
    return words.withColumn("mark", F.when(F.col("verified"), "verified").when(F.col("corrected"), "corrected").when(F.size("why") > 0, "flagged").otherwise("agreed"))


def summary(words: DataFrame, by: list[str]) -> DataFrame:
    """Counts per mark and, under `reason`, of the flagged per reason."""
    a = words.groupBy(*by, "mark").agg(F.count("*").alias("n")).withColumn("reason", F.lit(None).cast("string"))
    b = words.where("mark = 'flagged'").select(*by, "mark", F.explode("why").alias("reason")).groupBy(*by, "mark", "reason").agg(F.count("*").alias("n"))
    return a.unionByName(b)


def trust(low_word, fixes, flagged, retried):
    """1 x .6 for a low word x .9 for each of up to three fixes x .8 for a flag x .7 for a retry, .05 at least."""
    v = F.when(low_word, 0.6).otherwise(1.0) * F.pow(F.lit(0.9), F.least(fixes, F.lit(3))) * F.when(flagged, 0.8).otherwise(1.0) * F.when(retried, 0.7).otherwise(1.0)
    return F.greatest(F.lit(0.05), v)


def page_numbers(pages: DataFrame) -> DataFrame:
    """(stem, page, folio, fixed, offset): printed numbers repaired by the offset that most of an article's pages have.

    pages: (stem, page, folio INT or null). The offset counts if two pages and two thirds of the numbered ones have it;
    a number off it between two that fit, with as many digits, is set right.
    """
    p = pages.withColumn("d", F.col("folio") - F.col("page"))
    n = p.where("d is not null").groupBy("stem", "d").agg(F.count("*").alias("n"))
    best = n.groupBy("stem").agg(F.max_by("d", F.struct("n", (-F.col("d")).alias("x"))).alias("offset"), F.max("n").alias("n"), F.sum("n").alias("all")).where("n >= 2 and 3 * n >= 2 * all")
    w = Window.partitionBy("stem").orderBy("page")
    x = p.join(best.select("stem", "offset"), "stem", "left").withColumn("before", F.lag("d").over(w)).withColumn("after", F.lead("d").over(w))
    off = F.col("offset")
    lone = (F.col("d") != off) & (F.col("before") == off) & (F.col("after") == off) & (F.length(F.col("folio").cast("string")) == F.length((F.col("page") + off).cast("string")))
    return x.select("stem", "page", "folio", F.when(lone, F.col("page") + off).otherwise(F.col("folio")).alias("fixed"), "offset")


def outliers(counts: DataFrame, by: str, n: str, least: int = 8, times: float = 3.0) -> DataFrame:
    """Rows whose count is `least` and `times` the group's median at least."""
    m = counts.groupBy(by).agg(F.median(n).alias("__m"))
    return counts.join(m, by).where(F.col(n) >= F.greatest(F.lit(float(least)), times * F.col("__m"))).drop("__m")


def unpaired(calls: DataFrame, notes: DataFrame, on: list[str]) -> DataFrame:
    """(on, kind): calls without a note and notes without a call."""
    a = calls.select(*on).distinct().join(notes.select(*on).distinct(), on, "left_anti").withColumn("kind", F.lit("call without note"))
    return a.unionByName(notes.select(*on).distinct().join(calls.select(*on).distinct(), on, "left_anti").withColumn("kind", F.lit("note without call")))


def ragged_tables(cells: DataFrame) -> DataFrame:
    """(table_id, widths): tables whose rows, with spans counted, differ in width. cells: (table_id, row, col, rowspan, colspan)."""
    c = cells.select("table_id", F.explode(F.sequence("row", F.col("row") + F.greatest(F.col("rowspan"), F.lit(1)) - 1)).alias("r"), F.greatest(F.col("colspan"), F.lit(1)).alias("w"))
    rows = c.groupBy("table_id", "r").agg(F.sum("w").alias("w"))
    return rows.groupBy("table_id").agg(F.array_sort(F.collect_set("w")).alias("widths")).where(F.size("widths") > 1)


def mention_trust(block: Column, misprint: Column, worst: Column) -> Column:
    """A mention's trust from its block's: x .85 for a misprint, x .7 or .85 by the worst flag (high, medium) on it."""
    return F.round(block * F.when(misprint, 0.85).otherwise(1.0) * F.when(worst == "high", 0.7).when(worst == "medium", 0.85).otherwise(1.0), 3)


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 1).when(c == "medium", 2).when(c == "low", 3).otherwise(4)


def routed(confidence: Column, passes: Column, dismissed: Column, tries: Column, least: float = 0.9, most_tries: int = 2) -> Column:
    """auto only with both keys, confidence and the code's check; else dismissed, retry while tries are left, human."""
    return F.when(dismissed, "dismissed").when(F.coalesce((confidence >= least) & passes, F.lit(False)), "auto").when(tries < most_tries, "retry").otherwise("human")


def noise_evidence(words: DataFrame, by: list[str]) -> DataFrame:
    """(by, words, pale, unknown, conf): of each line or block, weighted by the words' letters: how pale, unknown and uncertain it is.

    words: by, text, ink (its strength by the page's), known (in the lexicon), conf.
    """
    n = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")).cast("double")
    x = words.withColumn("__n", n).where("__n > 0")
    mean = lambda c: F.round(F.sum(c * F.col("__n")) / F.sum(F.when(c.isNotNull(), F.col("__n"))), 6)
    return x.groupBy(*by).agg(F.count("*").alias("words"), mean(1.0 - F.least(F.col("ink"), F.lit(1.0))).alias("pale"), mean(F.when(F.col("known"), 0.0).otherwise(1.0)).alias("unknown"), mean(F.col("conf")).alias("conf"))


def foreign_share(lines: DataFrame, doc: str, foreign: str) -> DataFrame:
    """(doc, lines, share, flag): lines of another article: `most` from 0.4 on, `inner` if lines of its own stand before and
    behind one, `edge` otherwise. lines: (doc, pos, foreign BOOLEAN)."""
    own, other = F.when(~F.col(foreign), F.col("pos")), F.when(F.col(foreign), F.col("pos"))
    g = lines.groupBy(doc).agg(F.count("*").alias("lines"), F.round(F.avg(F.col(foreign).cast("double")), 6).alias("share"), F.min(own).alias("a"), F.max(own).alias("z"), F.min(other).alias("p"), F.max(other).alias("q")).where("share > 0")
    return g.select(doc, "lines", "share", F.when(F.col("share") >= 0.4, "most").when((F.col("p") > F.col("a")) & (F.col("q") < F.col("z")), "inner").otherwise("edge").alias("flag"))


def real_words(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """The words with `real`: in the lexicon as they are, or without a prefix or suffix (three letters kept). Each distinct
    form is looked up once."""
    # Prefixes and suffixes that are written together with a word.
    pre, post = r"^(?:وال|بال|كال|فال|ال|لل|و|ف|ب|ك|ل|س)(?=.{3})", r"(?<=.{3})(?:هما|كما|ها|هم|هن|نا|كم|ون|ين|ات|ان|ه|ك|ي)$"
    forms = words.select(F.col(word).alias("__w")).where("__w is not null").distinct()
    no_pre = F.regexp_replace("__w", pre, "")
    tried = F.array_distinct(F.array(F.col("__w"), no_pre, F.regexp_replace("__w", post, ""), F.regexp_replace(no_pre, post, "")))
    known = forms.select("__w", F.explode(tried).alias("__t")).join(lexicon.select(F.col(word).alias("__t")).distinct(), "__t", "left_semi").select("__w").distinct().withColumn("real", F.lit(True))
    return words.join(known, words[word] == known["__w"], "left").drop("__w").withColumn("real", F.coalesce("real", F.lit(False)))
