"""Names of people, places of work and works: parts, keys and printed forms, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import fold_digits, gregorian_to_hijri, hijri_to_gregorian, normalize, squeeze
from quire.functions.values import display_name, split_name, strip_titles

ARABIC = r"[\x{0600}-\x{06FF}]"
# Words that begin a by-name, a line of descent, an honorary name; endings of honorary names.
_KUNYA, _BIN, _HONOUR = "أبو|ابو|أبي|ابي|أبا|أم|ام", "بن|ابن|بنت|إبن", "الدين|الدولة|الإسلام|الاسلام|الملك"
#: A word after these takes the next one along.
_WITH = r"(?:عبد )?\S+"
_LIFE = r"\s*[،,]?\s*\(?\s*(?:(?:ت\.?|توفي|المتوفى|d\.|died)\s*\d{3,4}\s*(?:هـ|ه|م|AH|CE)?|\d{3,4}\s*[-–]\s*\d{3,4}\s*(?:هـ|م)?)\s*\)?\s*$"


def _let(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it; else plans would double at each step."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def life_note(c: Column) -> Column:
    """struct(name, born, died, died_hijri) of a heading: its name without the note of life, years in the Gregorian count."""

    def parts(s: Column) -> Column:
        note, died = s["note"], F.try_element_at(s["years"], F.lit(-1))
        born = F.when(F.size(s["years"]) > 1, F.get(s["years"], F.lit(0)))
        hijri = note.rlike(r"هـ|ه\b|AH") | ((died < 1500) & ~note.rlike("م"))
        year = lambda y: F.when(hijri, hijri_to_gregorian(y)).otherwise(y)
        return F.struct(F.when(s["name"] == "", F.trim(s["x"])).otherwise(s["name"]).alias("name"), year(born).alias("born"), year(died).alias("died"), F.when(hijri, died).otherwise(gregorian_to_hijri(died)).alias("died_hijri"))

    years = lambda note: F.transform(F.regexp_extract_all(note, F.lit(r"(\d{3,4})"), 1), lambda y: y.cast("int"))
    noted = lambda x: F.struct(x.alias("x"), F.regexp_extract(x, _LIFE, 0).alias("note"), F.trim(F.regexp_replace(x, _LIFE, "")).alias("name"))
    return _let(fold_digits(c), lambda x: _let(noted(x), lambda s: _let(F.struct(s["x"].alias("x"), s["note"].alias("note"), s["name"].alias("name"), years(s["note"]).alias("years")), parts)))


def _taken(x: Column, pattern: str) -> Column:
    """struct(found, rest): what the pattern finds, joined, and the text without it."""
    found = F.regexp_extract_all(x, F.lit(f"({pattern})"), 1)
    return F.struct(F.nullif(F.trim(F.array_join(found, " ")), F.lit("")).alias("found"), squeeze(F.regexp_replace(x, pattern, " ")).alias("rest"))


_PARTS = ("ism", "nasab", "nisba", "laqab", "kunya", "family", "shuhra")


def _latin_parts(x: Column) -> Column:
    words = F.split(x, " ")
    several = F.size(words) > 1
    of = {"ism": F.when(several, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(F.nullif(x, F.lit(""))), "family": F.when(several, F.element_at(words, -1))}
    return F.struct(*[of.get(k, F.lit(None).cast("string")).alias(k) for k in _PARTS])


def _arabic_parts(x: Column) -> Column:
    empty = lambda v: F.nullif(v, F.lit(""))

    def core(shuhra, kunya, laqab, nasab):
        def of(s: Column) -> Column:
            lone = s["rest"].rlike(r"^ال\S+ي$") & F.coalesce(kunya, laqab, shuhra).isNotNull()
            nisbas = F.filter(F.split(F.when(lone, s["rest"]).otherwise(s["tail"]), " "), lambda w: w.rlike(r"^ال\S+ي$"))
            family = F.when(~lone & (s["tail"] != ""), F.element_at(F.split(s["tail"], " "), -1))
            return F.struct(F.when(~lone, empty(s["first"])).alias("ism"), nasab.alias("nasab"), empty(F.array_join(nisbas, " ")).alias("nisba"), laqab.alias("laqab"), kunya.alias("kunya"), family.alias("family"), shuhra.alias("shuhra"))

        return of

    first = r"^((?:عبد )?\S+)"
    halves = lambda r: F.struct(r.alias("rest"), F.regexp_extract(r, first, 1).alias("first"), F.trim(F.regexp_replace(r, first, "")).alias("tail"))
    return _let(_taken(x, r"^(?:ابن|إبن) \S+"), lambda a:
        _let(_taken(a["rest"], rf"(?:^|(?<=\s))(?:{_KUNYA}) {_WITH}"), lambda b:
            _let(_taken(b["rest"], rf"(?:^|(?<=\s))\S+ (?:{_HONOUR})(?=\s|$)"), lambda c:
                _let(_taken(c["rest"], rf"(?:^|(?<=\s))(?:{_BIN}) {_WITH}"), lambda d:
                    _let(halves(d["rest"]), core(a["found"], b["found"], c["found"], d["found"]))))))


def name_parts(c: Column) -> Column:
    """struct(ism, nasab, nisba, laqab, kunya, family, shuhra) of a name; of a Latin one ism and family only."""
    name = _let(life_note(strip_titles(c)), lambda s: squeeze(display_name(s["name"])))
    return _let(name, lambda x: F.when(~x.rlike(ARABIC), _latin_parts(x)).otherwise(_arabic_parts(x)))


def name_variants(c: Column) -> Column:
    """array(struct(form, least)): printed forms of "family، given" with the similarity each needs."""
    n = split_name(c)
    first = F.regexp_extract(n["given"], r"^(\S+)\s", 1)
    form = lambda f, least: F.struct(f.alias("form"), F.lit(least).alias("least"))
    more = F.array(F.when(n["given"] != "", form(F.concat_ws(" ", n["family"], n["given"]), 0.8)), F.when(first != "", form(F.concat_ws(" ", first, n["family"]), 0.9)))
    return F.array_distinct(F.concat(F.array(form(display_name(c), 0.8)), F.array_compact(more)))


def _key(c: Column) -> Column:
    return F.replace(F.when(c.rlike(ARABIC), normalize(c, "db_key")).otherwise(normalize(c, "latin_key")), F.lit(" "), F.lit(""))


def name_key(c: Column) -> Column:
    """Folded, without titles and blanks; for matching, never an identity."""
    return _key(strip_titles(c))


def heading_key(c: Column) -> Column:
    """The key of a catalogue heading "family، given, note of life", turned round; no word of it is taken for a title."""
    return _key(display_name(life_note(c)["name"]))


def title_key(c: Column) -> Column:
    """Folded, the honorific ligature written out, a number in brackets at the end left out."""
    x = F.regexp_replace(F.replace(c, F.lit("ﷺ"), F.lit("صلى الله عليه وسلم")), r"\s*\([\p{Nd}]+\)\s*$", "")
    return normalize(x, "db_key")


def given_agrees(given: Column, printed: Column) -> Column:
    """Whether a given name or its initial is among the printed words (an array)."""
    g = F.lower(F.regexp_replace(given, r"[.\s].*$", ""))
    return F.coalesce(F.exists(printed, lambda w: (F.lower(w) == g) | ((F.length(F.regexp_replace(w, r"\.", "")) == 1) & F.startswith(g, F.lower(F.substring(w, 1, 1))))), F.lit(False)) & (g != "")


def sound_classes(c: Column) -> Column:
    """A name's consonants in classes both scripts share: a check of transliterations, not a spelling."""
    # Sounds of one class, of Arabic letters and of Latin ones.
    arabic_from, arabic_to = "بتطثجغخقكدضذرزظسصشفلمن", "BTTTGGKKKDDDRSSSSSFLMN"
    latin_from, latin_to = "ckqgjszpbvftdrlmn", "KKKGGSSBBFFTDRLMN"
    x = F.regexp_replace(F.lower(normalize(c, "db_fold")), r"(?<!\S)(?:ال|(?:al|el)[-‐])", "")
    for a, b in (("sh|ch", "s"), ("kh", "k"), ("th", "t"), ("gh", "g"), ("ph", "f"), ("x", "ks")):
        x = F.regexp_replace(x, a, b)
    x = F.regexp_replace(F.translate(x, arabic_from + latin_from, arabic_to + latin_to), r"[^A-Z ]", "")
    return F.replace(F.regexp_replace(x, r"(.)\1+", "$1"), F.lit(" "), F.lit(""))


def strip_role(c: Column) -> Column:
    """An affiliation without the position before it; a position alone stays."""
    # Positions.
    roles = "الأستاذ|الاستاذ|أستاذ|استاذ|المدرس|مدرس|محاضر|الباحث|باحث|معيد|عضو هيئة التدريس|عميد|وكيل|رئيس|مدير|مستشار|dean|head|lecturer|(?:assistant |associate )?professor|researcher|teacher"
    x = F.regexp_replace(c, rf"(?i)^\s*(?:{roles})(?:\s+(?:مساعد|مشارك|دكتور|في|at|in|of))*\s+", "")
    x = F.regexp_replace(x, "^ب(?=قسم|كلي|جامع|معهد)", "")
    return F.when(F.trim(x) == "", c).otherwise(x)


def same_title(a: Column, b: Column, ratio: Column) -> Column:
    """Equal keys; or one inside the other (six letters at least) or much alike, with four fifths of the words shared.
    ratio: the letters' likeness, from kernels.ratio."""
    x, y = F.filter(F.split(a, " "), lambda w: w != ""), F.filter(F.split(b, " "), lambda w: w != "")
    shared = F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y))), F.lit(1))
    inside = (F.contains(a, b) | F.contains(b, a)) & (F.least(F.length(a), F.length(b)) >= 6)
    return F.coalesce((a != "") & (b != "") & ((a == b) | ((shared >= 0.8) & (inside | (ratio >= 0.85)))), F.lit(False))
