"""Text that prints alike in different characters, brought to one form.

Confusables skeleton: decompose a text, replace every character by the prototype of those that look like it, decompose
again. Texts with equal skeletons are one group; what a group's texts should read is decided by the language around them
and, where that isn't enough, by the form most of the group has.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.skew import hot_join, hot_keys
from quire.session import cut
from quire.sources.tables import table

# Cyrillic and Greek letters that print like a Latin one.
LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι", "aeopcyxijshdqwABEKMHOPCTYXIJSABEZHIKMNOPTYXovi"))
# Letters of other scripts and phonetic ones that nearly print like a Latin one; only within a Latin word.
NEARLY = dict(zip("ακργτυχӏѵɑɡɩօոսհցᴏᴄᴠᴡᴢᴜꜱ", "akpytuxlvagionuhgocvwzus"))
# Persian letters and digits, and the Arabic ones that print like them (in some positions).
PERSIAN, ARABIC = "یکہۀ۰۱۲۳۷۸۹", "يكهه٠١٢٣٧٨٩"
PERSIAN_OF, ARABIC_OF = dict(zip(ARABIC[:2] + ARABIC[4:], PERSIAN[:2] + PERSIAN[4:])), dict(zip(PERSIAN[:2] + PERSIAN[4:], ARABIC[:2] + ARABIC[4:]))
ZWNJ = "‌"
_PROTO = {ord(a): b for a, b in (LOOKALIKE | NEARLY).items()} | {ord(a): b for a, b in zip(PERSIAN, ARABIC)} | {ord("ى"): "ي"}
_PROTO |= {0x06F4: "٤", 0x06F5: "٥", 0x06F6: "٦"}

#: In Java's regular expressions: invisible characters but the non-joiner, and blanks but the plain one.
HIDDEN = r"[\p{Cf}&&[^\x{200C}]]|[\p{Zs}&&[^ ]]|[\x{180E}\x{115F}\x{3164}\x{FE00}-\x{FE0F}]"
#: Nothing in it can be a variant: ASCII, composed Latin letters, Arabic letters both languages write alike, marks.
PLAIN = r"^[\x21-\x7E\x{A1}-\x{AC}\x{AE}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1C3}\x{1CD}-\x{1F0}\x{1F4}-\x{24F}\x{1E00}-\x{1EFF}\x{2010}-\x{2027}\x{2030}-\x{205E}]*$"
#: Signs that are written as they are, though Unicode has a longer form of them.
_WRITTEN = {c: "-" for r in (range(0xA1, 0xC0), range(0x2010, 0x205F)) for c in r if unicodedata.normalize("NFKC", chr(c)) != chr(c)}
_ARAB = re.compile("[ؠ-يٮ-ۓۺ-ۿﭐ-﷿ﹰ-ﻼ]")
_LATIN = re.compile("[A-Za-zÀ-ɏḀ-ỿＡ-Ｚａ-ｚ]")
_OTHER = re.compile("[Ͱ-ϿЀ-֏ɑɡɩᴀ-ᴢꜱ]")
#: Phonetic letters that no Latin word has; beside them the others are meant as they are.
_PHONETIC = re.compile("[ɐɒ-ɟɢ-ɨɪ-ʯː]")


def skeleton(text: str) -> str:
    """Decompose, replace by prototypes, drop what doesn't show, decompose again. Marks and case stay."""
    t = unicodedata.normalize("NFKD", text).translate(_PROTO)
    return unicodedata.normalize("NFKD", "".join(c for c in t if unicodedata.category(c) != "Cf"))


def _as_latin(m: re.Match) -> str:
    word = m[0]
    if not _LATIN.search(word) or _PHONETIC.search(word):
        return word
    word = "".join(LOOKALIKE.get(c, c) for c in word)
    return re.sub(r"[^\W\d_]+", lambda r: "".join(NEARLY.get(c, c) for c in r[0]) if _LATIN.search(r[0]) else r[0], word)


def plain_form(text: str, lang: str | None = None) -> str:
    """The text in the characters its language writes: composed, without hidden ones, blanks and widths plain.

    lang `per` takes Persian letters and keeps the non-joiner between letters, any other the Arabic letters. Letters that
    look like Latin ones become Latin only in words that also have Latin ones. Vowel marks stay.
    """
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text))
    keep = ZWNJ if lang == "per" else ""
    t = "".join(" " if unicodedata.category(c) == "Zs" else c for c in t if unicodedata.category(c) != "Cf" or c in keep)
    if keep:
        t = re.sub(f"(?<![ؠ-ۓ]){ZWNJ}|{ZWNJ}(?![ؠ-ۓ])", "", t)
    if _OTHER.search(t):
        t = re.sub(r"\S+", _as_latin, t)
    if _ARAB.search(t) or lang in ("ara", "per"):
        t = "".join(map((PERSIAN_OF if lang == "per" else ARABIC_OF).get, t, t))
    # What neither form can be asked for: blanks at the ends of the text.
    return t


def _fold(text: str) -> str:
    """For comparing words: skeleton without marks, case and anything but letters and digits."""
    t = unicodedata.normalize("NFKD", text.casefold()).translate(_PROTO).casefold()
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if c.isalnum())
    return "".join(str(unicodedata.digit(c)) if c.isdigit() and not c.isascii() else c for c in t)


fold_word = _fold


def group_key(text: str) -> str:
    """The skeleton of a word's letters and digits; its punctuation, hyphens and vowel marks part no group."""
    return skeleton("".join(c for c in text if not "\u064b" <= c <= "\u0652" and unicodedata.category(c)[0] != "P"))


def in_no_language(text: str) -> bool:
    """Whether no language writes the text so: it is neither its Persian plain form nor the other one."""
    t = text.translate(_WRITTEN)
    return plain_form(t, "per") != t and plain_form(t) != t


@F.pandas_udf(T.StructType([T.StructField("skel", T.StringType()), T.StructField("certain", T.BooleanType())]))
def _judged(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"skel": [group_key(x) for x in s], "certain": [in_no_language(x) for x in s]}).astype({"skel": object, "certain": bool})


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


#: Letters that only one of the languages has, or that show which one it is if they aren't variants.
_PER_MARK, _ARA_MARK = r"[پچژگ]|[\x{0620}-\x{06D3}]\x{200C}[\x{0620}-\x{06D3}]", r"[ةإأؤئ]|^[وفبلك]?ال"


def _evidence(t: Column) -> Column:
    """Above 0 for Arabic, below for Persian."""
    hits = lambda p: F.size(F.regexp_extract_all(t, F.lit(f"({p})"), 1))
    return 2.0 * hits(_ARA_MARK) + hits("[يك٠١٢٣٧٨٩٤٥٦]") - 2.0 * hits(_PER_MARK) - hits("[یک۰۱۲۳۷۸۹۴۵۶]")


#: Of a skeleton seen so often, in one language's form so nearly always, that form is right in any place.
SEEN, MOSTLY = 5, 0.93
#: The words before and after that tell the language of one that its own letters don't tell.
NEAR = 6


_ARABIC_SCRIPT = r"[\x{0620}-\x{064A}\x{0660}-\x{0669}\x{066E}-\x{06D3}\x{06F0}-\x{06FF}]"
_PER_FORM, _ARA_FORM = "[یک۰۱۲۳۷۸۹]", "[يك٠١٢٣٧٨٩]"


def groups(words: DataFrame) -> DataFrame:
    """(text, n, skel, certain, n_group, n_plain, n_alike, n_per, n_ara, n_joined) of all spellings (text), grouped by skeleton.

    certain: no language writes it so. Of the group's words the numbers in plain Latin characters, in letters that only
    look like Latin ones, with Persian letters only, with Arabic ones only, and with a non-joiner.
    """
    alike = f"^(?=.*\\p{{L}})[{''.join(LOOKALIKE)}\\p{{P}}]+$"
    t = words.where(F.col("text").isNotNull() & (F.col("text") != "")).groupBy("text").agg(F.count("*").alias("n"))
    t = t.withColumn("j", _judged("text")).select("text", "n", "j.skel", (F.col("j.certain") | _has(F.col("text"), HIDDEN)).alias("certain"), _has(F.col("text"), alike).alias("alike"))
    t = cut(t)
    per, ara = _has(F.col("text"), _PER_FORM), _has(F.col("text"), _ARA_FORM)
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    g = t.groupBy("skel").agg(F.count("*").alias("spellings"), F.sum("n").alias("n_group"), of(_has(F.col("text"), PLAIN)).alias("n_plain"), of(F.col("alike")).alias("n_alike"), of(per & ~ara).alias("n_per"), of(ara & ~per).alias("n_ara"), of(F.contains("text", F.lit(ZWNJ))).alias("n_joined"))
    return t.join(g, "skel")


def _arabic_script(w: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """(key) of the words in Arabic script, with what their skeleton's group has, that aren't in the form of the language around them."""
    t = F.regexp_replace("text", r"[\x{200B}\x{200D}-\x{200F}\x{061C}\x{2060}\x{FEFF}]", "")
    w = w.select(key, group, order, "text", "n_group", "n_per", "n_ara", "n_joined", _evidence(t).alias("ev"))
    near = Window.partitionBy(group).orderBy(order)
    around = F.sum("ev").over(near.rowsBetween(-NEAR, -1)), F.sum("ev").over(near.rowsBetween(1, NEAR))
    close = F.sum("ev").over(near.rowsBetween(-2, 2))
    w = w.withColumn("score", F.coalesce(around[0], F.lit(0.0)) + F.coalesce(around[1], F.lit(0.0)) + F.col("ev") + close)
    seen = F.col("n_per") + F.col("n_ara")
    share, joined = F.col("n_per") / F.greatest(seen, F.lit(1)), F.col("n_joined") / F.col("n_group")
    sure = F.coalesce(seen >= SEEN, F.lit(False))
    per = F.when(sure & (share >= MOSTLY), True).when(sure & (share <= 1 - MOSTLY), False).otherwise(F.col("score") < 0)
    wrong = F.when(per, _has(F.col("text"), _ARA_FORM)).otherwise(_has(F.col("text"), _PER_FORM))
    # A non-joiner that most of its group does without is none that the spelling needs.
    told = F.coalesce(F.col("n_group") >= SEEN, F.lit(False))
    idle = F.contains("text", F.lit(ZWNJ)) & (~per | (told & (joined < 0.5)) | ~_has(F.col("text"), r"[\x{0620}-\x{06D3}]\x{200C}[\x{0620}-\x{06D3}]"))
    return w.where(wrong | idle).select(key)


def variant_words(words: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """(key): the words whose text holds a character or sequence other than the plain composed one.

    words: (key BIGINT unique, group, order, text). All spellings are grouped by their skeletons; a spelling that no
    language writes so is a variant wherever it stands, one made of look-alike letters only is one if its group has more
    words in plain Latin characters than such ones, and one in Arabic script is one if it isn't in the form of the
    language that its group nearly always has or else of the words around it.

    Null and empty texts are none. Repeated rows are judged each by itself. Words truly in another script, vowel marks
    and the non-joiner Persian spelling needs are none.
    """
    spellings = groups(words).where(~_has(F.col("text"), PLAIN))
    variant = F.col("certain") | (F.col("alike") & (F.col("n_plain") > F.col("n_alike")))
    arabic = _has(F.col("text"), _ARABIC_SCRIPT)
    told = spellings.where(variant | (arabic & (F.col("n_group") >= SEEN) & ((F.col("n_per") + F.col("n_ara") + F.col("n_joined")) > 0))).select("text", "n", variant.alias("variant"), "n_group", "n_per", "n_ara", "n_joined")
    told = cut(told)
    w = words.select(key, group, order, "text").where(F.col("text").isNotNull() & (F.col("text") != "") & ~_has(F.col("text"), PLAIN))
    w = cut(hot_join(w, told.drop("n"), "text", hot_keys(told, "text", "n"), F.col(key), how="left").where(arabic | F.col("variant")))
    is_variant = F.coalesce("variant", F.lit(False))
    return w.where(is_variant).select(key).unionByName(_arabic_script(w.where(~is_variant), key, group, order)).distinct()


def variant_lines(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key): the lines of which a word is one in the sense of variant_words; a word's context is its line."""
    w = lines.select(F.col(key).alias("line_key"), F.col(text).alias("whole"))
    odd_blank = w.where(_has(F.col("whole"), HIDDEN)).select("line_key")
    words = w.select("line_key", F.posexplode(F.split("whole", "[ \n]")).alias("ord", "text")).withColumn("word_key", F.xxhash64("line_key", "ord"))
    found = variant_words(words, "word_key", "line_key", "ord")
    return words.join(found, "word_key", "left_semi").select("line_key").unionByName(odd_blank).distinct().withColumnRenamed("line_key", key)


def p5_found(spark, root: str) -> DataFrame:
    w = variant_words(table(spark, root, "words"), "word_pk", "block_pk", "ord").select(F.lit("words").alias("tbl"), F.col("word_pk").alias("row_id"))
    a = variant_lines(table(spark, root, "affiliations"), "aff_id", "printed").select(F.lit("affiliations").alias("tbl"), F.col("aff_id").alias("row_id"))
    return w.unionByName(a)


def p5_skeletons(spark, root: str) -> DataFrame:
    """Groups of word texts with one skeleton and more than one spelling."""
    g = groups(table(spark, root, "words").select("text")).groupBy("skel")
    g = g.agg(F.count("*").alias("spellings"), F.sum("n").alias("words"), F.max_by("text", F.struct("n", "text")).alias("commonest"))
    return g.withColumnRenamed("skel", "skeleton").where("spellings > 1")


QUERIES = {"p5_found": p5_found, "p5_skeletons": p5_skeletons}
ORACLE: dict[str, str] = {}
