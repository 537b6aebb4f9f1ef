"""Range joins: points in intervals, overlapping intervals, boxes. Ranges are dealt into bins, which join by equality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.kernels import iou

BIN = 64


def _bins(lo: str, hi: str, size: int):
    return F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor((F.greatest(F.col(hi), F.col(lo) + 1) - 1) / size)))


def containing(points: DataFrame, spans: DataFrame, on: list[str], at: str, lo: str, hi: str, keep: bool = False, size: int = BIN) -> DataFrame:
    """Points with the spans (lo up to but without hi) that hold them. keep: points in none stay. Null bounds hold nothing."""
    s = spans.where(F.col(hi) > F.col(lo)).withColumn("__bin", _bins(lo, hi, size))
    p = points.withColumn("__bin", F.floor(F.col(at) / size))
    cond = [p[c] == s[c] for c in on] + [p["__bin"] == s["__bin"], p[at] >= s[lo], p[at] < s[hi]]
    return p.join(s, cond, "left" if keep else "inner").select(*[p[c] for c in points.columns], *[s[c] for c in spans.columns if c not in on and c not in points.columns])


def overlapping(a: DataFrame, b: DataFrame, on: list[str], size: int = BIN) -> DataFrame:
    """Pairs of rows of a and b, both with (lo, hi, id) and the columns `on`, whose intervals overlap; each pair once."""
    x = a.select(*on, F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("id").alias("id_a")).where("hi_a > lo_a").withColumn("__bin", _bins("lo_a", "hi_a", size))
    y = b.select(*on, F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("id").alias("id_b")).where("hi_b > lo_b").withColumn("__bin", _bins("lo_b", "hi_b", size))
    first = F.greatest(F.floor(F.col("lo_a") / size), F.floor(F.col("lo_b") / size)) == F.col("__bin")
    return x.join(y, [*on, "__bin"]).where("lo_a < hi_b and lo_b < hi_a").where(first).select(*on, "id_a", "id_b")


def _match(gold: pd.DataFrame, pred: pd.DataFrame) -> pd.DataFrame:
    from quire.functions.edit import distance

    def sim(a: str, b: str) -> float:
        return 1 - distance(a, b) / max(len(a), len(b), 1)

    g, p = gold.to_dict("records"), pred.to_dict("records")
    scored = []
    for i, x in enumerate(g):
        for j, y in enumerate(p):
            boxed = x["box"] is not None and y["box"] is not None
            v = iou(tuple(x["box"]), tuple(y["box"])) if boxed else sim(x["text"] or "", y["text"] or "")
            if v >= (0.3 if boxed else 0.4):
                scored.append((-v, i, j))
    used_i, used_j, out = set(), set(), []
    for v, i, j in sorted(scored):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((g[i]["page_id"], g[i]["id"], p[j]["id"], round(-v, 6)))
    return pd.DataFrame(out, columns=["page_id", "gold", "pred", "score"])


def match_lines(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(page_id, gold, pred, score): lines of a page paired best first, by box (0.3 at least), without boxes by text (0.4).

    gold, pred: (page_id, id, box ARRAY<DOUBLE>, text). A page is one group, its lines are bounded by its size.
    """
    cols = ["page_id", "id", "box", "text"]
    return gold.select(*cols).groupBy("page_id").cogroup(pred.select(*[F.col(x).alias(x) for x in cols]).groupBy("page_id")).applyInPandas(_match, "page_id string, gold string, pred string, score double")


#: Boxes are near identical within a pixel at the origin and three in size; a centre may lie so far outside of a box.
NEAR_ORIGIN, NEAR_SIZE, PAD, GRID = 1, 3, 2, 100


def crosswalk(strings: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, string_id, word_id, how): which words a layout's strings are. Both: (page_id, id, x, y, w, h).

    A word whose box is nearly the string's is its only one (`box`); a string without such a one gets every word whose
    centre lies in it, padded by PAD (`centre`). Origins are rounded to cells that join by equality, a string's box is
    dealt to the squares of a grid: no pairs of a whole page are formed.
    """
    s = strings.select("page_id", F.col("id").alias("string_id"), *[F.col(c).alias(f"s{c}") for c in "xywh"])
    w = words.select("page_id", F.col("id").alias("word_id"), *[F.col(c).alias(f"w{c}") for c in "xywh"])
    cell = 2 * NEAR_ORIGIN + 1
    around = lambda c: F.array_distinct(F.transform(F.array(F.lit(-NEAR_ORIGIN), F.lit(NEAR_ORIGIN)), lambda k: F.floor((F.col(c) + k) / cell)))
    a = s.withColumn("cx", F.explode(around("sx"))).withColumn("cy", F.explode(around("sy")))
    b = w.withColumn("cx", F.floor(F.col("wx") / cell)).withColumn("cy", F.floor(F.col("wy") / cell))
    near = (F.abs(F.col("sx") - F.col("wx")) <= NEAR_ORIGIN) & (F.abs(F.col("sy") - F.col("wy")) <= NEAR_ORIGIN) & (F.abs(F.col("sw") - F.col("ww")) < NEAR_SIZE) & (F.abs(F.col("sh") - F.col("wh")) < NEAR_SIZE)
    boxed = a.join(b, ["page_id", "cx", "cy"]).where(near).groupBy("page_id", "string_id").agg(F.min("word_id").alias("word_id"))
    rest = s.join(boxed.select("page_id", "string_id"), ["page_id", "string_id"], "left_anti")
    squares = lambda lo, size: F.explode(F.sequence(F.floor((F.col(lo) - PAD) / GRID), F.floor((F.col(lo) + F.col(size) + PAD) / GRID)))
    r = rest.withColumn("gx", squares("sx", "sw")).withColumn("gy", squares("sy", "sh"))
    c = w.withColumn("mx", F.col("wx") + F.col("ww") / 2).withColumn("my", F.col("wy") + F.col("wh") / 2).withColumn("gx", F.floor(F.col("mx") / GRID)).withColumn("gy", F.floor(F.col("my") / GRID))
    inside = F.col("mx").between(F.col("sx") - PAD, F.col("sx") + F.col("sw") + PAD) & F.col("my").between(F.col("sy") - PAD, F.col("sy") + F.col("sh") + PAD)
    centred = r.join(c, ["page_id", "gx", "gy"]).where(inside).select("page_id", "string_id", "word_id").distinct()
    return boxed.withColumn("how", F.lit("box")).unionByName(centred.withColumn("how", F.lit("centre")))


def line_map(walk: DataFrame, string_lines: DataFrame, word_lines: DataFrame) -> DataFrame:
    """(page_id, line, word_line, share): each layout line's line in the engine's reading, by the votes of its words; ties to the smallest."""
    v = walk.join(string_lines, ["page_id", "string_id"]).join(word_lines, ["page_id", "word_id"]).groupBy("page_id", "line", "word_line").agg(F.count("*").alias("n"))
    return v.groupBy("page_id", "line").agg(F.min_by("word_line", F.struct((-F.col("n")).alias("n"), "word_line")).alias("word_line"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def lost_in_tables(lines: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines whose centre lies in a table but in none of its cells. All: (page_id, id, x, y, w, h), cells also have table_id."""
    c = lines.select("page_id", F.col("id").alias("line_id"), (F.col("x") + F.col("w") / 2).alias("mx"), (F.col("y") + F.col("h") / 2).alias("my"))
    holds = (F.col("mx") >= F.col("x")) & (F.col("mx") < F.col("x") + F.col("w")) & (F.col("my") >= F.col("y")) & (F.col("my") < F.col("y") + F.col("h"))
    t = c.join(tables.select("page_id", F.col("id").alias("table_id"), "x", "y", "w", "h"), "page_id").where(holds).select("page_id", "table_id", "line_id", "mx", "my")
    held = t.join(cells.select("page_id", "table_id", "x", "y", "w", "h"), ["page_id", "table_id"]).where(holds).select("page_id", "table_id", "line_id").distinct()
    return t.select("page_id", "table_id", "line_id").join(held, ["page_id", "table_id", "line_id"], "left_anti")


def notes_matched(marks: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, mark_id, note_id, where): each mark with its note. marks, notes: (doc, page, label, pos, mark_id | note_id).

    The first free note of the label on the mark's page, the k-th mark with the k-th note; marks left over take the
    document's notes left over in the same way (notes at the end), in reading order.
    """
    order = lambda d, by: d.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("page", "pos")))
    here = ["doc", "page", "label"]
    a = order(marks, here).join(order(notes, here).select("doc", "page", "label", "k", "note_id"), [*here, "k"]).select("doc", "mark_id", "note_id", F.lit("page").alias("where"))
    left_m = marks.join(a.select("doc", "mark_id"), ["doc", "mark_id"], "left_anti")
    left_n = notes.join(a.select("doc", "note_id"), ["doc", "note_id"], "left_anti")
    b = order(left_m, ["doc", "label"]).join(order(left_n, ["doc", "label"]).select("doc", "label", "k", "note_id"), ["doc", "label", "k"]).select("doc", "mark_id", "note_id", F.lit("end").alias("where"))
    return a.unionByName(b)
