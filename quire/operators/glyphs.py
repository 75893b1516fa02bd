"""Characters, ink and recognised words: sequence decoding and alignment, scripts, ink grids, admission of new readings.

What is sequential or needs an image grid runs once a page or word with numpy; the rest are expressions and folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as t
from quire.operators.layout import PAGE

# Cells of ink, what counts as dark, shares of sizes and overlaps.
CELL, DARK, BLANK, GRID, LEAST_CELLS, LEAST_INK = 4, 160, 0.0005, 16, 3, 0.03
SMALL, RAISED, TALL, ADMIT, EDGE = 0.8, 0.15, 1.5, 0.5, 1.5
SCRIPTS = "[⁰¹²³⁴-⁾ₐ-ₜ₀-₎]"


def collapse(scores: np.ndarray, classes: list[str], blank: int = 0) -> list[tuple[str, float, float]]:
    """Best class at each step, runs as one, blanks dropped: (character, mean step, mean certainty) of each."""
    best, out = scores.argmax(axis=1), []
    i = 0
    while i < len(best):
        j = i
        while j < len(best) and best[j] == best[i]:
            j += 1
        if best[i] != blank and best[i] < len(classes):
            out.append((classes[best[i]], (i + j - 1) / 2, float(scores[i:j, best[i]].mean())))
        i = j
    return out


def align(a: str, b: str) -> list[tuple[int | None, int | None]]:
    """Pairs of places by edit distance: matches and changes before deletions before insertions."""
    d = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    d[:, 0], d[0, :] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and d[i, j] == d[i - 1, j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def reconciles(read: str, word: str) -> bool:
    """Whether a reading by characters may stand for the word: the same, or near enough both ways."""
    a, b = read.strip(), word.strip()
    if a == b:
        return True
    pairs = align(b, a)
    same = sum(i is not None and j is not None and b[i] == a[j] for i, j in pairs)
    extra = sum(i is None for i, _ in pairs)
    return bool(b) and same >= len(b) - min(2, len(b) // 3) and extra <= max(2, -(-len(b) // 4))


def _aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"i": i, "j": j} for i, j in align(x or "", y or "")] for x, y in zip(a, b, strict=True)])


def aligned(a: Column, b: Column) -> Column:
    return F.pandas_udf(_aligned, "array<struct<i:int,j:int>>")(a, b)


def unicode_script(c: Column) -> Column:
    return c.rlike(f"^{SCRIPTS}\\z")


def char_sizes(chars: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """chars (page…, word, char, height): the largest height of each character on a page, of those not out of their word's
    measure; none unless two words contribute."""
    mid = chars.groupBy(*page, "word").agg(F.median("height").alias("mid"))
    key = t.fold_match(F.col("char"))
    good = chars.join(mid, [*page, "word"]).filter((F.col("height") <= F.col("mid") * TALL) & (key != "") & ~unicode_script(F.col("char")))
    words = good.groupBy(*page).agg(F.count_distinct("word").alias("n"))
    return good.groupBy(*page, key.alias("key")).agg(F.max("height").alias("height")).join(words.filter("n >= 2").drop("n"), page)


def scripts(chars: DataFrame, by: list[str]) -> DataFrame:
    """chars (by…, idx, char, y0, y1): super, sub or normal, by height and shift against the word's medians."""
    h = F.col("y1") - F.col("y0")
    mid = chars.groupBy(*by).agg(F.median(h).alias("m0"))
    inner = chars.join(mid, by).filter(h <= F.col("m0") * TALL)
    fit = inner.groupBy(*by).agg(F.median(h).alias("mh"), F.median("y1").alias("base"))
    met = chars.join(fit, by, "left")
    small = h <= F.col("mh") * SMALL
    kind = F.when(small & (F.col("base") - F.col("y1") >= F.col("mh") * RAISED), "super").when(small & (F.col("y1") - F.col("base") >= F.col("mh") * RAISED), "sub")
    return met.select(*chars.columns, F.coalesce(kind, F.lit("normal")).alias("script"))


def script_runs(marked: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring characters of one script as one fragment; blanks part them."""
    w = Window.partitionBy(*by).orderBy("idx")
    kind = F.when((F.col("script") != "normal") & (t.trim(F.col("char")) != ""), F.col("script"))
    new = marked.withColumn("kind", kind).withColumn("run", F.sum((~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int")).over(w))
    got = new.filter("kind is not null").groupBy(*by, "run", "kind").agg(F.array_sort(F.collect_list(F.struct("idx", "char"))).alias("l"))
    return got.select(*by, "kind", F.array_min(F.transform("l", lambda x: x["idx"])).alias("first"), F.array_join(F.transform("l", lambda x: x["char"]), "").alias("text"))


def ink_cells(pixels: DataFrame, by: list[str] = PAGE, cell: int = CELL, dark: int = DARK) -> DataFrame:
    """pixels (page…, x, y, luma): dark pixels by cell; sums, so a page may come in any number of parts."""
    grid = [F.floor(F.col("y") / cell).cast("int").alias("r"), F.floor(F.col("x") / cell).cast("int").alias("c")]
    return pixels.groupBy(*by, *grid).agg(F.count_if(F.col("luma") < dark).alias("ink"))


def projections(cells: DataFrame, axis: str, by: list[str] = PAGE) -> DataFrame:
    return cells.groupBy(*by, axis).agg(F.count_if(F.col("ink") > 0).alias("n"))


def mostly_blank(dark_ratio: Column, failed: Column) -> Column:
    return ~failed & (dark_ratio < BLANK)


def hole_ratio(cells: DataFrame, words: DataFrame, by: list[str] = PAGE, cell: int = CELL) -> DataFrame:
    """The share of inked cells that no word's box reaches."""
    inked = cells.filter("ink > 0")
    inside = [F.col(f"i.{k}") == F.col(f"w.{k}") for k in by]
    box = (F.col("i.c") * cell < F.col("w.x1")) & ((F.col("i.c") + 1) * cell > F.col("w.x0")) & (F.col("i.r") * cell < F.col("w.y1")) & ((F.col("i.r") + 1) * cell > F.col("w.y0"))
    missed = inked.alias("i").join(words.alias("w"), [*inside, box], "left_anti").groupBy(*by).agg(F.count("*").alias("missed"))
    total = inked.groupBy(*by).agg(F.count("*").alias("inked"))
    return total.join(missed, by, "left").select(*by, (F.coalesce("missed", F.lit(0)) / F.col("inked")).alias("hole"))


def ink_components(cells: DataFrame, by: list[str] = PAGE, least: int = LEAST_CELLS) -> DataFrame:
    """8-connected groups of inked cells of a page: (page…, r0, c0, r1, c1, cells).  A page's grid is bounded by its pixels."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        at = {(r, c): i for i, (r, c) in enumerate(zip(part["r"], part["c"], strict=True))}
        root = list(range(len(part)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (r, c), i in at.items():
            for q in ((r - 1, c - 1), (r - 1, c), (r - 1, c + 1), (r, c - 1)):
                if q in at:
                    root[find(i)] = find(at[q])
        part = part.assign(k=[find(i) for i in range(len(part))])
        got = part.groupby("k").agg(r0=("r", "min"), c0=("c", "min"), r1=("r", "max"), c1=("c", "max"), cells=("r", "size")).reset_index(drop=True)
        got = got[got["cells"] >= least].sort_values(["r0", "c0"])
        return got.assign(**{b: part[b].iloc[0] for b in by})[[*by, "r0", "c0", "r1", "c1", "cells"]]

    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "r0 int, c0 int, r1 int, c1 int, cells long"])
    return cells.filter("ink > 0").select(*by, "r", "c").groupBy(*by).applyInPandas(one, schema)


def merged_regions(regions: DataFrame, by: list[str] = PAGE, smaller: float = 0.8, iou: float = 0.35) -> DataFrame:
    """Regions of a page that overlap enough, as one box each: (page…, x0, y0, x1, y1, n), from the top."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        b = part[["x0", "y0", "x1", "y1"]].to_numpy(float)
        inter = np.prod(np.maximum(0, np.minimum(b[:, None, 2:], b[None, :, 2:]) - np.maximum(b[:, None, :2], b[None, :, :2])), axis=2)
        area = np.prod(b[:, 2:] - b[:, :2], axis=1)
        low, both = np.minimum(area[:, None], area[None, :]), area[:, None] + area[None, :] - inter
        near = (inter > 0) & ((inter >= smaller * low) | (inter >= iou * both))
        label = np.arange(len(b))
        while True:
            new = np.where(near | np.eye(len(b), dtype=bool), label[None, :], len(b)).min(axis=1)
            if (new == label).all():
                break
            label = new
        got = pd.DataFrame(b, columns=["x0", "y0", "x1", "y1"]).assign(k=label).groupby("k").agg(x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"), n=("x0", "size"))
        return got.sort_values(["y0", "x0"]).reset_index(drop=True).assign(**{c: part[c].iloc[0] for c in by})[[*by, "x0", "y0", "x1", "y1", "n"]]

    kinds = dict(regions.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "x0 double, y0 double, x1 double, y1 double, n long"])
    return regions.select(*by, "x0", "y0", "x1", "y1").groupBy(*by).applyInPandas(one, schema)


def admitted(new: DataFrame, old: DataFrame, by: list[str] = PAGE, most: float = ADMIT) -> DataFrame:
    """Words of a second reading, in order of idx, that overlap neither a word there was nor one admitted before."""
    box = ["x0", "y0", "x1", "y1"]
    kind = "array<struct<idx:int,x0:double,y0:double,x1:double,y1:double>>"
    listed = lambda df, name: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), *[F.col(c).cast("double").alias(c) for c in box]))).alias(name))
    met = listed(new, "new").join(listed(old, "old"), by, "left")
    clear = lambda x, words: ~F.exists(words, lambda w: g.overlap_of_smaller(x, w) >= most)
    fold = F.aggregate("new", F.array().cast(kind), lambda acc, x: F.when(clear(x, F.coalesce("old", F.array().cast(kind))) & clear(x, acc), F.concat(acc, F.array(x))).otherwise(acc))
    return met.select(*by, F.explode(fold).alias("w")).select(*by, "w.*")


def gate(garbage: Column, hole: Column, fragments: Column) -> Column:
    """Why a region is worth another reading, or null."""
    return F.when(garbage > 0, "garbage").when(hole >= 0.15, "hole").when((fragments >= 2) | ((fragments >= 1) & (hole >= 0.075)), "fragment")


def recognised(pages: DataFrame, model, schema: str) -> DataFrame:
    """The boundary to a recogniser: model(batch of pages) gives a frame of words; a page that fails gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return pages.mapInPandas(run, schema)
