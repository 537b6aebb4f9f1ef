"""Text expressions: normalising profiles, keys, n-grams, search. All but Unicode normal forms stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A phrase of one to six words that stands four times in a row.
LOOP = r"(?<!\S)((?:\S+ ){0,5}\S+)(?: \1){3}(?!\S)"
# Arabic letters, marks and digits in classes.
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
TATWEEL = "ـ"
BIDI = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{061C}]"
JOINERS = r"[\x{200C}\x{200D}]"
LETTERS_FROM, LETTERS_TO = "أإآٱىةیکہۀگپچژ", "اااايهيكههكبجز"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


def _form(name: str):
    @F.pandas_udf(T.StringType())
    def normal_form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x.isascii() else unicodedata.normalize(name, x), na_action="ignore")

    return normal_form


nfc, nfkc, nfkd = _form("NFC"), _form("NFKC"), _form("NFKD")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\x{00A0}]+", " "))


def fold_letters(c: Column) -> Column:
    return F.translate(c, LETTERS_FROM, LETTERS_TO)


def fold_digits(c: Column) -> Column:
    return F.translate(c, DIGITS_FROM, DIGITS_TO)


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(TATWEEL), F.lit("")), MARKS, "")


def _faithful(c: Column) -> Column:
    return squeeze(F.replace(nfc(c), F.lit(TATWEEL), F.lit("")))


def _folded(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(fold_digits(fold_letters(strip_marks(nfc(c)))), r"[\p{P}\p{S}]", " ")))


def _match(c: Column) -> Column:
    return F.regexp_replace(fold_digits(fold_letters(strip_marks(nfkc(c)))), r"[^\p{L}\p{N}]", "")


def _search(c: Column) -> Column:
    return F.regexp_replace(fold_digits(fold_letters(strip_marks(c))), JOINERS, "")


def _scripture(c: Column) -> Column:
    return F.regexp_replace(F.translate(strip_marks(nfc(c)), LETTERS_FROM + "ءؤئ", LETTERS_TO), r"[^\x{0621}-\x{064A} ]", "")


def _db_fold(c: Column) -> Column:
    return squeeze(F.lower(fold_digits(fold_letters(F.regexp_replace(strip_marks(c), BIDI, "")))))


def _db_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(_db_fold(c), r"[\p{P}\p{S}]", " "))


def _latin_key(c: Column) -> Column:
    return _db_key(F.regexp_replace(nfkd(c), r"[\x{0300}-\x{036F}]", ""))


def _ortho(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(strip_marks(c), "[اأإآءؤئ]", ""), "[ةته]\\b", "ه"), "([وي])\\1", "$1")


#: The normalisers are not interchangeable; each has its users.
PROFILES = {
    "match": _match, "faithful": _faithful, "folded": _folded, "search": _search, "scripture": _scripture,
    "scripture_noalef": lambda c: F.replace(_scripture(c), F.lit("ا"), F.lit("")), "scripture_skeleton": lambda c: F.translate(_scripture(c), "بتثنيجحخدذرزسشصضطظعغفق", "بببببحححددررسسصصططععفف"),
    "db_fold": _db_fold, "db_key": _db_key, "latin_key": _latin_key, "ortho": _ortho, "letters": lambda c: F.regexp_replace(_folded(c), r"[^\p{L}]", ""),
}


def normalize(c: Column, profile: str) -> Column:
    return PROFILES[profile](c)


def stem(c: Column) -> Column:
    """A word without leading conjunction, preposition and article, three letters kept at least."""
    x = F.regexp_replace(c, "^[وف](?=.{3})", "")
    x = F.regexp_replace(x, "^(?:لل|ال|[بكل]ال)(?=.{3})", "")
    return x


def stemmed(c: Column) -> Column:
    return F.array_join(F.transform(F.split(_db_fold(c), " "), stem), " ")


def tokens(c: Column) -> Column:
    """Runs of letters or of digits, folded."""
    return F.regexp_extract_all(F.lower(_db_fold(c)), F.lit(r"(\p{L}+|\p{N}+)"), 1)


def ngrams(words: Column, n: int) -> Column:
    """n words in a row, joined by blanks, in order."""
    size = F.size(words)
    at = F.sequence(F.lit(1), size - (n - 1))
    return F.when(size >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngram_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of n words in a row, in order; no texts are put together for them."""
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def tokset(a: str, b: str) -> Column:
    """Shared words by the smaller set's size; null for an empty set."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance by the longer length; 1 for two empty texts."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def near_token(a: Column, b: Column) -> Column:
    """Equal, or one edit apart where both have four letters."""
    return (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.levenshtein(a, b, 1) >= 0))


def latin_majority(c: Column) -> Column:
    n = lambda p: F.length(F.regexp_replace(c, p, ""))
    return n("[^A-Za-z\\x{00C0}-\\x{024F}]") > n("[^\\x{0600}-\\x{06FF}]")


def surrogate_key(*parts: str) -> Column:
    """A key below 2^53 from the parts' SHA-1; null parts count as empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha1(text), 1, 13), 16, 10).cast("long")


def public_id(prefix: str, *parts: str) -> Column:
    """prefix and nine base-32 digits (Crockford's) from the parts' SHA-1."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    v = F.conv(F.substring(F.sha1(text), 1, 12), 16, 10).cast("long")
    digit = lambda k: F.substring(F.lit("0123456789abcdefghjkmnpqrstvwxyz"), F.shiftright(v, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(F.lit(prefix), *[digit(k) for k in range(8, -1, -1)])


def hijri_to_gregorian(c: Column) -> Column:
    return F.round(c * 0.970229 + 621.5643).cast("int")


def gregorian_to_hijri(c: Column) -> Column:
    return F.round((c - 621.5643) / 0.970229).cast("int")


def issn_check(digits: Column) -> Column:
    """The check digit of seven digits (a text), X for ten."""
    s = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda a, i: a + F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(9) - i))
    r = F.pmod(F.lit(11) - F.pmod(s, F.lit(11)), F.lit(11))
    return F.when(r == 10, F.lit("X")).otherwise(r.cast("string"))


def year_of(c: Column) -> Column:
    """The first four-digit number, of any digits."""
    return F.nullif(F.regexp_extract(fold_digits(c), r"(?<!\d)(\d{4})(?!\d)", 1), F.lit("")).cast("int")


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, templates and tags."""
    x = F.regexp_replace(html, r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, "(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return squeeze(x)


def plain_markdown(c: Column) -> Column:
    """Markdown without YAML header, heading and emphasis signs, links and footnote keys."""
    x = F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", "")
    x = F.regexp_replace(x, r"(?m)^\s{0,3}#{1,6}\s+|^\s*([-*_])(?:\s*\1){2,}\s*$", "")
    x = F.regexp_replace(x, r"!?\[([^\]^]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"\[\^[^\]]+\]:?", "")
    return F.trim(F.regexp_replace(x, r"[*_`~]{1,3}", ""))


def isbd_trim(c: Column) -> Column:
    """Without a cataloguer's punctuation at the end."""
    return F.regexp_replace(c, r"[\s:;/=,،.]+$", "")


def and_search(docs: DataFrame, key: str, words: str, asked: list[str]) -> DataFrame:
    """(key) of the documents that hold all the words."""
    wanted = F.array(*[F.lit(w) for w in sorted(set(asked))])
    return docs.where(F.size(F.array_intersect(words, wanted)) == len(set(asked))).select(key)


def bm25(docs: DataFrame, key: str, words: str, asked: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): the k best documents for the words. One pass for the counts, one for the scores; nothing is exploded."""
    asked = sorted(set(asked))
    tf = [F.size(F.filter(F.col(words), _is(w))) for w in asked]
    d = docs.select(key, F.size(words).alias("len"), *[x.alias(f"tf{i}") for i, x in enumerate(tf)])
    s = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))]).first()
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.log(F.lit(1.0) + (s["n"] - s[f"df{i}"] + 0.5) / (s[f"df{i}"] + 0.5))
        f = F.col(f"tf{i}")
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.lit(s["avg"] or 1.0)))).otherwise(0.0)
    any_ = F.greatest(*[F.col(f"tf{i}") for i in range(len(asked))], F.lit(0)) > 0
    return d.where(any_).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _is(w: str):
    return lambda x: x == F.lit(w)


def is_real(c: Column) -> Column:
    """Whether there is anything to judge: a letter or a digit."""
    return c.rlike(r"[\p{L}\p{N}]")


def same_reading(a: Column, b: Column) -> Column:
    """Equal letters; of texts without letters equal digits."""
    letters = lambda c: F.regexp_replace(_match(c), r"\p{N}", "")
    digits = lambda c: F.regexp_replace(fold_digits(c), r"[^\p{Nd}]", "")
    return F.when((letters(a) == "") & (letters(b) == ""), (digits(a) == digits(b)) & (digits(a) != "")).otherwise(letters(a) == letters(b))


def script_of(c: Column) -> Column:
    """Arab or Latn by the majority of letters; null without any."""
    n = lambda p: F.length(c) - F.length(F.regexp_replace(c, p, ""))
    arab, latn = n(r"\p{IsArabic}"), n(r"\p{IsLatin}")
    return F.when((arab > 0) | (latn > 0), F.when(arab >= latn, "Arab").otherwise("Latn"))


#: Letters and digits that only Persian or Urdu has; a text with one keeps its Persian forms.
_NOT_ARABIC = r"[ٹڈڑںھہےۓگپچژ]"


def arabic_letters(c: Column) -> Column:
    """Persian kaf and ya as an Arabic text has them: ya with dots before a letter, without at a word's end."""
    x = F.replace(c, F.lit("ک"), F.lit("ك"))
    x = F.regexp_replace(x, rf"ی(?={MARKS}*[\x{{0620}}-\x{{064A}}\x{{066E}}-\x{{06D3}}])", "ي")
    return F.when(c.rlike(_NOT_ARABIC), c).otherwise(F.replace(x, F.lit("ی"), F.lit("ى")))


def arabic_digits(c: Column) -> Column:
    """Persian digits as Arabic ones, but in a Persian or Urdu text."""
    return F.when(c.rlike(_NOT_ARABIC), c).otherwise(F.translate(c, "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"))


def joined_runs(c: Column) -> Column:
    """A word's runs of connected letters: they end behind letters that don't join to the left. Marks stay with their
    letter; digits, Latin and signs make a run of their own."""
    # Letters that join to the right only, and the one that joins to neither side.
    ends, alone = "اأإآدذرزوؤةىٱ", "ء"
    m = rf"{MARKS}*"
    inner = rf"[\x{{0620}}-\x{{064A}}\x{{066E}}-\x{{06D3}}&&[^{ends}{alone}]]"
    return F.regexp_extract_all(c, F.lit(rf"((?:{inner}{m})*[{ends}]{m}|{alone}{m}|(?:{inner}{m})+{alone}{m}|(?:{inner}{m})+|[^\s\x{{0620}}-\x{{06D3}}]+)"), 1)


def graphemes(c: Column) -> Column:
    """User-perceived characters; a carriage return and line feed are one."""
    return F.regexp_extract_all(c, F.lit(r"(\X)"), 1)


def attached_punctuation(c: Column) -> Column:
    """Words, each with the lone punctuation behind it."""
    return F.regexp_extract_all(squeeze(c), F.lit(r"(\S*[\p{L}\p{N}]\S*(?: [^\s\p{L}\p{N}]+(?=\s|$))*|^[^\p{L}\p{N}]+(?=\s|$))"), 1)


def latex_tokens(c: Column) -> Column:
    """Commands, escapes, letters, digits and signs of a formula; braces around one of them and spacing left out."""
    x = F.regexp_replace(c, r"\\(?:left|right|displaystyle|textstyle|qquad|quad|[,;!])(?![A-Za-z])", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"^[\s$]+|[\s$]+$", ""), r"\{\s*(\\[A-Za-z]+|\\.|\S)\s*\}", " $1 ")
    return F.regexp_extract_all(x, F.lit(r"(\\[A-Za-z]+|\\.|[A-Za-z]|\d|\S)"), 1)


def year_in_range(c: Column) -> Column:
    """The first number from 1500 to 2099 that stands by itself."""
    return F.nullif(F.regexp_extract(fold_digits(c), r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)", 1), F.lit("")).cast("int")


# Month names of three calendars (folded) and seasons.
MONTHS = {
    "gregorian": "يناير كانون الثاني|فبراير شباط|مارس اذار|ابريل نيسان|مايو ايار|يونيو حزيران|يوليو تموز|اغسطس اب|سبتمبر ايلول|اكتوبر تشرين الاول|نوفمبر تشرين الثاني|ديسمبر كانون الاول",
    "hijri": "محرم|صفر|ربيع الاول|ربيع الاخر|جمادي الاولي|جمادي الاخره|رجب|شعبان|رمضان|شوال|ذو القعده|ذو الحجه",
}


def month_numbers(c: Column) -> Column:
    """struct(gregorian, hijri): the months a label names, of a calendar the one with the longest name that begins there."""
    x = F.replace(fold_letters(strip_marks(c)), F.lit(" "), F.lit(""))

    def number(calendar: str, names: list[tuple[str, int]]) -> Column:
        out = F.lit(None).cast("int")
        for name, k in sorted(names, key=lambda n: len(n[0])):
            out = F.when(x.rlike(rf"(?:^|[/\-–،,]|و){name}"), k).otherwise(out)
        return out.alias(calendar)

    folded = str.maketrans(LETTERS_FROM, LETTERS_TO)
    one = lambda w: w.translate(folded).replace(" ", "")
    greg = [(one(n), k) for k, ns in enumerate(MONTHS["gregorian"].split("|"), 1) for n in (ns.split(" ", 1))]
    hij = [(one(n), k) for k, n in enumerate(MONTHS["hijri"].split("|"), 1)]
    return F.struct(number("gregorian", greg), number("hijri", hij))


def history_dates(c: Column) -> Column:
    """array(struct(kind, printed)): received, revised and accepted dates of a line."""
    x = F.regexp_extract_all(c, F.lit(r"(?i)((?:received|revised|accepted)\s*:?\s*[^;،,.]*?\d{4})"), 1)
    return F.transform(x, lambda p: F.struct(F.lower(F.regexp_extract(p, r"^(\p{L}+)", 1)).alias("kind"), F.trim(F.regexp_replace(p, r"^\p{L}+\s*:?\s*", "")).alias("printed")))
