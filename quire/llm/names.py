"""Variant spellings of names typed by people.

Metric-space partitioning: every name goes to its nearest pivot by Levenshtein distance; a name is repeated in the cells
of all pivots that the triangle inequality leaves possible (d(x, p) <= d(x, nearest) + 2 r). Inside each cell the names at
home there are joined with all names in it, exactly within radius r: candidates share a name with at most r letters left
out, and the true distance decides.

Organisations are joined on the name of their place and keep apart by their kind; persons on their family name and keep
apart by their given names, which may be initials, nicknames or missing.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.edit import codes, distance, distances, swapped
from quire.llm.components import seed_tree
from quire.llm.lookalike import LOOKALIKE
from quire.session import cut
from quire.sources.tables import table

#: Pivots are chosen from so many names; they balance the cells and have no influence on the result.
PIVOT_SAMPLE, MOST_PIVOTS, NAMES_PER_PIVOT = 2_000, 24, 1_500
RADIUS = 2
#: A spelling of a place that so many names have may be a misspelling whatever the other's number.
FEW = 2
_LOOK = {ord(a): b for a, b in LOOKALIKE.items()}
_ALEF = str.maketrans("أإآٱىةکیھہ", "ااااىهكيهه")


def fold(text: str) -> str:
    """Lower case without accents, vowel marks and hidden characters; Arabic letters that vary in one form."""
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)).lower()
    if any("a" <= c <= "z" for c in t):
        t = t.translate(_LOOK)
    t = "".join(" " if unicodedata.category(c) == "Zs" else c for c in t if unicodedata.category(c) not in ("Mn", "Cf"))
    return re.sub(r"\s+", " ", t.translate(_ALEF).replace("ى", "ي").replace("ـ", "")).strip()


def tasks(spark) -> int:
    """Partitions for work that is heavy for its bytes, which adaptive execution would put together."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- the radius join ----------------------------------------------------------------------------------------------


def _pivots(names: list[str], most: int) -> list[str]:
    """Farthest first, from a sample in a fixed order."""
    out = [names[0]]
    m, n = codes(names)
    near = np.full(len(names), 1 << 14)
    while len(out) < min(most, len(names)):
        k = names.index(out[-1])
        near = np.minimum(near, distances(m, n, np.repeat(m[k : k + 1], len(m), axis=0), np.repeat(n[k : k + 1], len(m))))
        if near.max() == 0:
            break
        out.append(names[int(near.argmax())])
    return out


def _shortened(m: np.ndarray, n: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the names with at most r letters left out, and the names' numbers."""
    rows, hashes = [], []
    w = m.shape[1]
    for k in range(r + 1):
        for out in combinations(range(w), k):
            ok = np.flatnonzero(n > out[-1]) if out else np.arange(len(n))
            if len(ok) == 0:
                continue
            h = np.full(len(ok), 1469598103934665603, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for c in range(w):
                    if c not in out:
                        x = m[ok, c].astype(np.uint64)
                        h = np.where(x > 0, (h ^ x) * np.uint64(1099511628211), h)
            rows.append(ok)
            hashes.append(h)
    return np.concatenate(hashes), np.concatenate(rows)


def _join_cell(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("name").reset_index(drop=True)
    m, n = codes(f["name"].tolist())
    home = f["home"].to_numpy(dtype=bool)
    pairs = []
    if len(f) > 1 and m.shape[1]:
        h, r = _shortened(m, n, RADIUS)
        o = np.lexsort((r, h))
        h, r = h[o], r[o]
        own = home[r]
        lo, hi = np.searchsorted(h, h[own], side="left"), np.searchsorted(h, h[own], side="right")
        q = r[own]
        for a in range(0, len(q), 100_000):
            size = (hi - lo)[a : a + 100_000]
            left = np.repeat(q[a : a + 100_000], size)
            right = r[np.repeat(lo[a : a + 100_000] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            # A pair is joined in the cell of the smaller name's home, or in the other's where that one is not at home here.
            ok = (left != right) & (np.abs(n[left] - n[right]) <= RADIUS)
            pairs.append(np.unique(left[ok] * len(f) + right[ok]))
    p = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
    x, y = p // max(len(f), 1), p % max(len(f), 1)
    d = np.concatenate([distances(m[x[a : a + 50_000]], n[x[a : a + 50_000]], m[y[a : a + 50_000]], n[y[a : a + 50_000]]) for a in range(0, len(x), 50_000)]) if len(x) else np.zeros(0)
    ok = d <= RADIUS
    name = f["name"].to_numpy(dtype=object)
    x, y, d = name[x[ok]], name[y[ok]], d[ok]
    typos = [1 if k == 2 and swapped(a, b) else int(k) for a, b, k in zip(x, y, d)]
    return pd.DataFrame({"script": f["script"].iloc[0] if len(f) else "", "a": x, "b": y, "typos": typos})


def radius_join(names: DataFrame) -> DataFrame:
    """(script, a, b, typos): every two different names of one script within RADIUS, each pair in both directions.

    names: (script, name), distinct and not null. typos is the distance, but 1 for two letters in the other order. An
    empty table gives no pairs.
    """
    seen = [r[0] for r in names.where(F.length("name") > 0).orderBy(F.xxhash64("name"), "name").limit(PIVOT_SAMPLE).select("name").collect()]
    if not seen:
        return names.sparkSession.createDataFrame([], "script string, a string, b string, typos int")
    pivots = _pivots(seen, max(1, min(MOST_PIVOTS, names.count() // NAMES_PER_PIVOT)))
    near = F.array(*[F.levenshtein(F.col("name"), F.lit(p)) for p in pivots])
    d = names.withColumn("d", near).withColumn("least", F.array_min("d")).withColumn("nearest", F.array_position("d", F.col("least")) - 1)
    cells = d.select("script", "name", "nearest", "least", F.posexplode("d").alias("cell", "far")).where(F.col("far") <= F.col("least") + 2 * RADIUS)
    cells = cells.select("script", "name", "cell", (F.col("cell") == F.col("nearest")).alias("home"))
    # As many partitions as cells: the rows are few bytes, the work on them is not.
    cells = cells.repartition(2 * len(pivots), "script", "cell")
    return cells.groupBy("script", "cell").applyInPandas(_join_cell, "script string, a string, b string, typos int")


# --- organisations ------------------------------------------------------------------------------------------------

# Words that tell the kind of an organisation, and words that tell nothing.
KINDS = {
    "university": "university universite universidad univ u جامعه الجامعه ج",
    "institute": "institut institute inst superieur sup technical tech معهد المعهد العالي العالى عالي",
    "college": "teachers teacher college coll col",
    "hochschule": "hochschule hochsch hs",
    "centre": "centre center مركز المركز بحوث البحوث للبحوث",
}
NOTHING = "of de des du zu the l la le for fur and in في مدينه م department dept departement faculty faculte letters lettres education history histoire linguistics geschichte sprachen abteilung d كليه الكليه قسم الاداب اداب التربيه التاريخ اللغه العربيه"
_WORDS = {w: k for k, ws in KINDS.items() for w in ws.split()} | dict.fromkeys(NOTHING.split(), "")
_LONG = [w for w in _WORDS if len(w) >= 2 and not (len(w) == 2 and not _WORDS[w])]
#: The kinds in the order in which they decide, where words of several are present.
_ORDER = ["hochschule", "college", "university", "centre", "institute"]


def _keyword(w: str) -> tuple[int, str]:
    """The known word that w is or is likest to, and how far it is from it."""
    if w in _WORDS:
        return 0, w
    if len(w) <= 2:
        return 0, "of"
    return min(((1 if swapped(w, x) else distance(w, x, 4), x) for x in _LONG), default=(9, ""))


def parse_org(name: str) -> tuple[str, str, str]:
    """(script, kind, place). The word least like any known one is the place, the others tell the kind."""
    t = fold(name)
    words = re.findall(r"[^\W\d_]+", t.replace("'", " ").replace("’", " "))
    script = "latin" if any("a" <= c <= "z" for c in t) else "other"
    near = [(w, *_keyword(w)) for w in words]
    rest = [(d, len(w), w) for w, d, _ in near if d > 0]
    place = max(rest)[2] if rest and max(rest)[0] >= 2 else ""
    found = {_WORDS[k] for w, d, k in near if w != place and d <= (1 if len(k) < 4 else 3)}
    kind = next((k for k in _ORDER if k in found), "")
    if kind == "hochschule" and place.endswith("er") and words and words[0] == place:
        place = place[:-2]
    return script, kind, place


@F.pandas_udf(T.StructType([T.StructField("script", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("place", T.StringType())]))
def _parse_org(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_org(x) for x in s], columns=["script", "kind", "place"])


def organisations(names: DataFrame) -> DataFrame:
    """(name, org): the organisation's key for each of the names (name, n); names without a place have none.

    A place's spelling that few names use (FEW, or a third of the other's) goes to one that more use within RADIUS.
    """
    p = cut(names.where(F.trim("name") != "").withColumn("o", _parse_org("name")).select("name", "n", "o.*").where("place <> ''"))
    places = p.groupBy("script", F.col("place").alias("name")).agg(F.sum("n").alias("n"))
    near = radius_join(places.select("script", "name"))
    n_of = lambda c: places.select("script", F.col("name").alias(c), F.col("n").alias(f"n_{c}"))
    up = near.join(n_of("a"), ["script", "a"]).join(n_of("b"), ["script", "b"])
    up = up.where(((F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))) & ((F.col("n_a") <= FEW) | (3 * F.col("n_a") <= F.col("n_b"))))
    # Of the more frequent spellings around, the most frequent.
    best = up.groupBy("script", "a").agg(F.max_by("b", F.struct("n_b", (-F.col("typos")).alias("t"), "b")).alias("b"))
    flat = best.select(F.concat_ws(":", "script", "a").alias("u"), F.concat_ws(":", "script", "b").alias("v"))
    grouped = seed_tree(flat, "u", "v").select(F.col("member_key").alias("key"), "first_key")
    k = p.withColumn("key", F.concat_ws(":", "script", "place")).join(grouped, "key", "left").withColumn("place_key", F.coalesce("first_key", "key"))
    # A name whose kind can't be told takes the place's only one.
    only = k.where("kind <> ''").groupBy("place_key").agg(F.min("kind").alias("k1"), F.max("kind").alias("k2"))
    k = k.join(only, "place_key", "left").withColumn("kind", F.when(F.col("kind") == "", F.when(F.col("k1") == F.col("k2"), F.col("k1")).otherwise("")).otherwise(F.col("kind")))
    return k.select("name", F.concat_ws(":", "place_key", "kind").alias("org"))


# --- persons ------------------------------------------------------------------------------------------------------

# Short and variant forms of given names (folded), and by-names of Arabic ones.
NICKNAMES = {
    "ted": "theodore edward", "ned": "edward", "ed": "edward", "eddie": "edward", "chris": "christopher", "fred": "frederick", "sam": "samuel", "hans": "johannes", "saeed": "said", "ahmad": "ahmed",
    "mahmud": "mahmoud", "jacquot": "jacques", "tony": "anthony", "umar": "omar", "tom": "thomas", "lola": "dolores", "khaled": "khalid", "mike": "michael", "zeinab": "zaynab",
    "pat": "patricia", "mohamed": "mohammed", "muhammad": "mohammed", "layla": "leila", "paco": "francisco", "dan": "daniel", "ebrahim": "ibrahim", "joe": "joseph", "heinz": "heinrich",
    "peggy": "margaret", "maggie": "margaret", "alex": "alexander", "sandy": "alexander", "fatma": "fatima", "nick": "nicholas", "betty": "elizabeth", "liz": "elizabeth", "kate": "katherine",
    "catherine": "katherine", "bob": "robert", "rob": "robert", "will": "william", "bill": "william", "yousef": "yusuf", "youssef": "yusuf", "hossein": "hussein", "husayn": "hussein",
    "jim": "james", "jimmy": "james", "jamie": "james", "dick": "richard", "rick": "richard", "richie": "richard", "jack": "john", "johnny": "john", "harry": "henry", "hank": "henry", "charlie": "charles", "chuck": "charles",
    "dave": "david", "steve": "stephen steven", "andy": "andrew", "greg": "gregory", "jeff": "jeffrey", "ken": "kenneth", "larry": "lawrence", "matt": "matthew", "ben": "benjamin", "phil": "philip", "tim": "timothy",
    "sue": "susan", "jenny": "jennifer", "becky": "rebecca", "debbie": "deborah", "cathy": "katherine", "nancy": "anne", "beth": "elizabeth", "lizzie": "elizabeth", "molly": "mary", "pepe": "jose", "sepp": "josef", "fritz": "friedrich",
    "klaus": "nikolaus", "toni": "anton", "nacho": "ignacio",
    "سلمان": "سليمان", "زينه": "زينب", "رشاد": "رشيد", "طاها": "طه", "ابويعقوب": "يوسف", "ابوعلي": "حسين", "ابوالوليد": "خالد", "ابوحفص": "عمر", "ابوالقاسم": "محمد", "ابوالثناء": "محمود",
    "ابواسحاق": "ابراهيم", "ابوالحسن": "علي",
}
TITLES = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms)\b\.?|ا\.\s?د\.|د\.|ا\.(?=\s?د\.)|الاستاذ|الدكتور|الاستاذه|الدكتوره)\s*")
#: A spelling of a given name can be a misspelt one of another that so many times as many mentions use, and so many at least.
GIVEN_TIMES, GIVEN_LEAST = 5, 3


def parse_person(name: str) -> tuple[str, str, str, str]:
    """(script, family, first, second): given names folded, initials as one letter, empty where there is none."""
    t = fold(name)
    script = "latin" if any("a" <= c <= "z" for c in t) else "other"
    while (m := TITLES.match(t)) and m.end() < len(t):
        t = t[m.end() :].strip()
    t = t.replace("،", ",")
    if "," in t:
        family, rest = (x.strip() for x in t.split(",", 1))
        words = rest.split()
        if script == "other":
            words = _compounds(words)
        family = family.replace(" ", "")
    else:
        words = t.split()
        if script == "other":
            words = _compounds(words)
        if len(words) > 1 and re.fullmatch(r"(?:[^\W\d_]\.){1,3}", words[-1]):
            family, words = words[0], words[1:]
        else:
            family, words = (words[-1] if words else ""), words[:-1]
    given = [x for w in words for x in ([c for c in w if c != "."] if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]?", w) else [re.sub(r"[\W_]", "", w)]) if x]
    family = re.sub(r"[\W\d_]", "", family)
    if script == "other" and len(family) > 5 and family.startswith("ال"):
        family = family[2:]
    return script, family, *(given + ["", ""])[:2]


def _compounds(words: list[str]) -> list[str]:
    out: list[str] = []
    for w in words:
        if out and out[-1] == "ابو":
            out[-1] += w
        elif out and len(out[-1]) in (2, 3, 4) and distance(out[-1], "عبد", 1) <= 1 and (distance(w, "الله", 2) <= 2 or distance(w, "الرحمن", 2) <= 2):
            out[-1] = "عبدالله" if distance(w, "الله") < distance(w, "الرحمن") else "عبدالرحمن"
        else:
            out.append(w)
    return out


_PERSON = T.StructType([T.StructField(x, T.StringType()) for x in ("script", "family", "first", "second")])


@F.pandas_udf(_PERSON)
def _parse_person(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_person(x) for x in s], columns=["script", "family", "first", "second"])


def given_names(given: DataFrame) -> DataFrame:
    """(script, g, full): for each of the given names (script, g, n) those it can stand for, joined by blanks.

    A spelling goes to the nearest ones around it (one letter apart, two from five letters on) that GIVEN_TIMES as many
    mentions use and that don't go elsewhere themselves; a rare one also to a nickname. Short forms stand for their full ones.
    """
    spark = given.sparkSession
    short = spark.createDataFrame(list(NICKNAMES.items()), "g string, means string")
    script = F.when(F.col("g").rlike("[a-z]"), "latin").otherwise("other")
    every = given.select("script", "g", "n").unionByName(short.select(script.alias("script"), "g", F.lit(0).cast("long").alias("n")))
    every = cut(every.groupBy("script", "g").agg(F.sum("n").alias("n")).join(short, "g", "left"))
    near = radius_join(every.select("script", F.col("g").alias("name")))
    side = lambda x: every.select("script", F.col("g").alias(x), F.col("n").alias(f"n_{x}"), F.col("means").alias(f"means_{x}"))
    up = near.join(side("a"), ["script", "a"]).join(side("b"), ["script", "b"]).where((F.col("n_a") > 0) & F.col("means_a").isNull() & (F.col("typos") <= F.when(F.length("a") <= 4, 1).otherwise(2)))
    up = cut(up.where(((F.col("n_b") >= GIVEN_LEAST) & (GIVEN_TIMES * F.col("n_a") <= F.col("n_b"))) | (F.col("means_b").isNotNull() & (F.col("n_a") <= FEW))))
    up = up.join(up.select("script", F.col("a").alias("b")).distinct(), ["script", "b"], "left_anti")
    least = up.groupBy("script", "a").agg(F.min("typos").alias("typos"))
    to = up.join(least, ["script", "a", "typos"]).select("script", F.col("a").alias("g"), F.explode(F.split(F.coalesce("means_b", "b"), " ")).alias("w"))
    to = to.groupBy("script", "g").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("w"))
    return every.where("n > 0").join(to, ["script", "g"], "left").select("script", "g", F.coalesce("w", "means", "g").alias("full"))


def agree(a: str, b: str) -> bool:
    """Whether two resolved given names can be one person's; an empty one agrees with any."""
    if not a or not b:
        return True
    x, y = a.split(), b.split()
    if len(a) == 1 or len(b) == 1:
        return bool({w[0] for w in x} & {w[0] for w in y})
    return bool(set(x) & set(y))


def _weight(f: str, s: str) -> int:
    """How much the given names tell."""
    w = lambda g: 0 if not g else 1 if len(g) == 1 else 3 if " " in g else 4
    return 10 * w(f) + w(s)


def _persons(f: pd.DataFrame) -> pd.DataFrame:
    """One family name's forms: the fullest first, each joins the one person it agrees with; with several it stays alone."""
    script, family = f["script"].iloc[0], f["family"].iloc[0]
    rows = [(-_weight(a, b), -n, first, second, a, b) for first, second, n, a, b in zip(f["first"].tolist(), f["second"].tolist(), f["n"].tolist(), f["g1"].tolist(), f["g2"].tolist())]
    people: list[list] = []
    who = []
    rows.sort()
    for *_, a, b in rows:
        fits = [k for k, p in enumerate(people) if agree(a, p[0]) and agree(b, p[1])]
        same = [k for k in fits if people[k][:2] == [a, b]]
        if same or len(fits) == 1:
            k = (same or fits)[0]
            if len(people[k][1]) < 2 and len(b) > 1:
                people[k][1] = b
            who.append(k)
        else:
            people.append([a, b, len(fits) > 1])
            who.append(len(people) - 1)
    out = [(script, family, r[2], r[3], -r[1], k, *people[k]) for r, k in zip(rows, who)]
    return pd.DataFrame(out, columns=["script", "family", "first", "second", "n", "person", "g1", "g2", "lone"])


@F.pandas_udf(T.IntegerType())
def _fit_pair(a1: pd.Series, a2: pd.Series, b1: pd.Series, b2: pd.Series, typos: pd.Series) -> pd.Series:
    """0: no; else the more the better."""
    out = []
    for p, q, r, s, t in zip(a1, a2, b1, b2, typos):
        whole = len(p) > 1 and len(r) > 1 and len(q) > 1 and len(s) > 1
        ok = agree(p, r) and agree(q, s) and (whole if t > 1 else bool(p and r))
        out.append(0 if not ok else (10 if whole else 5) + (3 - t))
    return pd.Series(out, dtype="int32")


def persons(mentions: DataFrame) -> DataFrame:
    """(draw_id, person): a key for the person each mention (draw_id BIGINT unique, authors) names; none for blank names."""
    m = cut(mentions.where(F.trim("authors") != "").withColumn("p", _parse_person("authors")).select("draw_id", "p.*").where("family <> ''"))
    given = m.select("script", F.explode(F.array("first", "second")).alias("g")).where(F.length("g") > 1)
    counts = given.groupBy("script", "g").agg(F.count("*").alias("n"))
    full = cut(given_names(counts))
    forms = m.groupBy("script", "family", "first", "second").agg(F.count("*").alias("n"))
    for name, g in (("first", "g1"), ("second", "g2")):
        forms = forms.join(full.select("script", F.col("g").alias(name), F.col("full").alias(g)), ["script", name], "left").withColumn(g, F.coalesce(g, name))
    forms = forms.repartition(tasks(m.sparkSession), "script", "family")
    p = forms.groupBy("script", "family").applyInPandas(_persons, "script string, family string, first string, second string, n long, person int, g1 string, g2 string, lone boolean")
    p = cut(p.withColumn("pid", F.concat_ws("|", "script", "family", F.col("person").cast("string"))))
    people = p.groupBy("script", "family", "pid").agg(F.sum("n").alias("n"), F.first("g1").alias("g1"), F.first("g2").alias("g2"), F.max("lone").alias("lone"))
    near = radius_join(p.select("script", F.col("family").alias("name")).distinct())
    size = p.groupBy("script", "family").agg(F.sum("n").alias("fn"))
    side = lambda x: people.join(size, ["script", "family"]).select("script", F.col("family").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("pid", "n", "g1", "g2", "lone", "fn")])
    c = near.join(side("a"), ["script", "a"]).join(side("b"), ["script", "b"]).where("not lone_a and not lone_b and (fn_b > fn_a or (fn_b = fn_a and b < a))")
    c = c.withColumn("fit", _fit_pair("g1_a", "g2_a", "g1_b", "g2_b", "typos")).where("fit > 0")
    # A person under a rarer family name joins the best one under a more frequent name, unless two there fit equally well.
    w = Window.partitionBy("pid_a").orderBy(F.desc("fit"), F.desc("n_b"), "pid_b")
    c = c.withColumn("k", F.row_number().over(w)).withColumn("ties", F.count("*").over(Window.partitionBy("pid_a", "b", "fit"))).where("k = 1 and ties = 1")
    joined = seed_tree(c, "pid_a", "pid_b").select(F.col("member_key").alias("pid"), "first_key")
    key = p.join(joined, "pid", "left").select("script", "family", "first", "second", F.coalesce("first_key", "pid").alias("person"))
    return m.join(key, ["script", "family", "first", "second"]).select("draw_id", "person")


def _pairs(rows: DataFrame, group: str, key: str, kind: str) -> DataFrame:
    a, b = rows.select(group, F.col(key).alias("id_a")), rows.select(group, F.col(key).alias("id_b"))
    return a.join(b, group).where("id_a < id_b").select(F.lit(kind).alias("kind"), "id_a", "id_b")


def p3_found(spark, root: str) -> DataFrame:
    v = table(spark, root, "institution_variants").select("variant_id", F.col("variant").alias("name"))
    a = table(spark, root, "affiliations").select("aff_id", F.col("orgname").alias("name")).where(F.col("name").isNotNull())
    names = v.select("name").unionByName(a.select("name").distinct()).where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))
    org = cut(organisations(names))
    of_variant = cut(v.join(org, "name").select("variant_id", "org"))
    first = of_variant.groupBy("org").agg(F.min("variant_id").alias("id_a"))
    of_aff = a.join(org.join(first, "org").select("name", "id_a"), "name").select(F.lit("affiliation").alias("kind"), "id_a", F.col("aff_id").alias("id_b"))
    of_person = cut(persons(table(spark, root, "meta_draw").select("draw_id", "authors")))
    return _pairs(of_variant, "org", "variant_id", "institution").unionByName(of_aff).unionByName(_pairs(of_person, "person", "draw_id", "person"))


def p3_places(spark, root: str) -> DataFrame:
    """The radius join itself, on the places of the organisation variants."""
    v = table(spark, root, "institution_variants").where(F.trim("variant") != "").select(_parse_org("variant").alias("o")).select("o.script", F.col("o.place").alias("name")).where("name <> ''").distinct()
    return radius_join(v).where("a < b")


QUERIES = {"p3_found": p3_found, "p3_places": p3_places}
ORACLE = {}
