"""Names, numbers, dates and identifiers: expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import fold_digits, squeeze


def page_range(c: Column) -> Column:
    """[first, last] of the one or two numbers in a text, ordered; null without a number."""
    n = F.transform(F.regexp_extract_all(fold_digits(c), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    return F.when(F.size(n) >= 1, F.array(F.least(n[0], F.coalesce(F.get(n, F.lit(1)), n[0])), F.greatest(n[0], F.coalesce(F.get(n, F.lit(1)), n[0]))))


def issue_number(c: Column) -> Column:
    """Without leading zeros; a double issue "071,072" as "71-72"."""
    parts = F.transform(F.split(c, r"\s*[,،/-]\s*"), lambda x: F.regexp_replace(F.trim(x), "^0+(?=.)", ""))
    return F.array_join(F.filter(parts, lambda x: x != ""), "-")


def calendar_of(printed: Column, year: Column) -> Column:
    """hijri where marked or below 1500, else gregorian; null without a year."""
    return F.when(year.isNull(), None).when(printed.rlike(r"هـ|هجري|\bAH\b") | (year < 1500), "hijri").otherwise("gregorian")


def year_agrees(a: Column, b: Column) -> Column:
    """Equal, or within 1.5 years after a year below 1500 is converted."""
    g = lambda y: F.when(y < 1500, y * 0.970229 + 621.5643).otherwise(y)
    return (a == b) | (((a < 1500) | (b < 1500)) & (F.abs(g(a) - g(b)) <= 1.5))


def issn_clean(c: Column) -> Column:
    """struct(issn, valid): "NNNN-NNNX" and whether its check digit fits; null where there are no eight signs."""
    from quire.functions.text import issn_check

    raw = F.upper(F.regexp_replace(fold_digits(c), r"[^0-9Xx]", ""))
    form = F.concat(F.substring(raw, 1, 4), F.lit("-"), F.substring(raw, 5, 4))
    return F.when(raw.rlike(r"^\d{7}[\dX]$"), F.struct(form.alias("issn"), (issn_check(F.substring(raw, 1, 7)) == F.substring(raw, 8, 1)).alias("valid")))


def split_name(c: Column) -> Column:
    """struct(family, given) of "family، given"."""
    p = F.split(c, r"\s*[,،]\s*", 2)
    return F.struct(F.trim(p[0]).alias("family"), F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("given"))


def display_name(c: Column) -> Column:
    n = split_name(c)
    return F.when(n["given"] == "", n["family"]).otherwise(F.concat_ws(" ", n["given"], n["family"]))


def strip_titles(c: Column) -> Column:
    """A name without the titles before it; a name of titles only stays."""
    x = F.trim(F.regexp_replace(c, r"^(?:\s*(?:(?:أ\.\s?)?د\.|الدكتور|الأستاذ|الاستاذ|الشيخ|Prof\.?|Dr\.?|Mr\.?|Mrs\.?)\s+)+", ""))
    return F.when(x == "", c).otherwise(x)


def life_years(c: Column) -> Column:
    """struct(born, died) of a heading's note of life."""
    y = F.regexp_extract_all(fold_digits(c), F.lit(r"(\d{3,4})\s*(?=[-–م هـ]|$)"), 1)
    return F.struct(F.get(y, F.lit(0)).cast("int").alias("born"), F.get(y, F.lit(1)).cast("int").alias("died"))


def clean_label(c: Column) -> Column:
    """ "Vol. 6" as "6", in the digits as printed."""
    return F.nullif(F.regexp_extract(c, r"([\p{Nd}]+(?:\s*[-/]\s*[\p{Nd}]+)?)", 1), F.lit(""))


def join_address(c: Column) -> Column:
    """A web address broken by line ends, put together."""
    return F.regexp_replace(c, r"(?<=[/.\-_=&?])\s*\n\s*|\s*\n\s*(?=[/.\-_=&?])", "")


def parse_date(c: Column) -> Column:
    """A date in one of the printed forms; null if none fits."""
    x = squeeze(fold_digits(c))
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd", "d/M/yyyy", "d.M.yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyy/M/d")]).cast("date")


def id_split(c: Column) -> Column:
    """struct(journal, volume, issue, article) of a document's id; null for other texts."""
    g = lambda k: F.regexp_extract(c, r"^(\d{4})-(\d{3})-(\d{3}[ab]?)-(\d{3})$", k)
    return F.when(g(1) != "", F.struct(g(1).alias("journal"), g(2).cast("int").alias("volume"), g(3).alias("issue"), g(4).cast("int").alias("article")))


def line_end_join(before: Column, after: Column) -> Column:
    """A Latin word broken between two lines, joined; null if it isn't."""
    return F.when(before.rlike(r"\p{IsLatin}[-¬]$") & after.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(before, "[-¬]$", ""), after))


def affiliation_pieces(c: Column) -> Column:
    """The parts of an affiliation line, each with its level: array of struct(level, text)."""
    parts = F.filter(F.transform(F.split(c, r"\s*(?:[,،;؛]|\s[-–]\s)\s*"), lambda x: F.trim(x)), lambda x: x != "")
    level = lambda x: (
        F.when(x.rlike(r"(?i)universi|جامع|معهد|institut|college|hochschule|مركز"), "organisation").when(x.rlike(r"(?i)facult|كلية"), "faculty").when(x.rlike(r"(?i)d[eé]part|dept|abteilung|قسم"), "department").otherwise("other")
    )
    return F.transform(parts, lambda x: F.struct(level(x).alias("level"), x.alias("text")))


def total_variation(a: Column, b: Column) -> Column:
    """Half the sum of differences of two maps of counts, as shares."""
    total = lambda m: F.greatest(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x), F.lit(1e-12))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k).cast("double"), F.lit(0.0))
    return F.aggregate(F.array_union(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, k: s + F.abs(at(a, k) / total(a) - at(b, k) / total(b))) / 2
