"""Page layout: detections, words and lines assigned to regions, columns, reading order, headings, furniture.

Pages are independent: every operator keys on the page columns, so a join has an equality and a residual, never a product of
all pages.  Order-dependent choices fold over arrays sorted by an explicit index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as t

# The classes in order of their ids, and groups of them.
LABELS = (
    "paragraph_title image text number abstract content figure_title formula table table_title reference doc_title footnote header "
    "algorithm footer seal chart_title chart formula_number header_image footer_image aside_text"
).split()
FURNITURE = "header footer header_image footer_image number seal".split()
TITLES = "paragraph_title doc_title".split()
MIN_SCORE, MIN_COVER, TIE = 0.3, 0.5, 0.05
SPAN, TOLERANCE, HEADING_FONT = 0.6, 0.05, 0.95
PAGE = ["doc_id", "page"]


def label_of(class_id: Column) -> Column:
    names = F.array(*[F.lit(x) for x in LABELS])
    return F.when((class_id >= 0) & (class_id < len(LABELS)), F.get(names, class_id)).otherwise("unknown")


def is_furniture(label: Column) -> Column:
    return label.isin(FURNITURE)


def decode(values: Column, n: Column, width: Column, height: Column) -> Column:
    """struct<code, regions> of flat rows of class, score and two corners: rows that are finite and score enough, corners in
    order, cut to the page, sorted; one centre outside the page rejects the page."""
    at = lambda i, k: F.get(values, i * 6 + k)
    rows = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n),
        lambda i: F.struct(
            F.floor(at(i, 0) + 0.5).cast("int").alias("class_id"), at(i, 1).alias("score"),
            F.least(at(i, 2), at(i, 4)).alias("x0"), F.least(at(i, 3), at(i, 5)).alias("y0"), F.greatest(at(i, 2), at(i, 4)).alias("x1"), F.greatest(at(i, 3), at(i, 5)).alias("y1"),
            F.forall(F.slice(values, i * 6 + 1, F.lit(6)), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"),
        ),
    )
    good = F.filter(rows, lambda r: r["finite"] & (r["score"] >= MIN_SCORE))
    outside = F.exists(good, lambda r: ~((r["x0"] + r["x1"]) / 2).between(F.lit(0.0), width) | ~((r["y0"] + r["y1"]) / 2).between(F.lit(0.0), height))
    clip = lambda v, m: F.least(F.greatest(v, F.lit(0.0)), m)
    cut = F.transform(
        good,
        lambda r: F.struct(
            clip(r["y0"], height).alias("y0"), clip(r["x0"], width).alias("x0"), (-r["score"]).alias("minus"), r["class_id"].alias("class_id"),
            clip(r["x1"], width).alias("x1"), clip(r["y1"], height).alias("y1"),
        ),
    )
    final = F.transform(
        F.array_sort(cut),
        lambda r: F.struct(r["class_id"].alias("class_id"), label_of(r["class_id"]).alias("label"), (-r["minus"]).alias("score"), r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1")),
    )
    code = F.when(F.size(values) < n * 6, "short").when(outside, "outside").when(F.size(good) == 0, "empty").otherwise("none")
    return F.struct(code.alias("code"), F.when(code == "none", final).otherwise(F.filter(final, lambda _: F.lit(False))).alias("regions"))


def region_for(word: Column, regions: Column, least: float = MIN_COVER) -> Column:
    """The region that covers most of a word, in order of the array; a near tie goes to the higher score, then the smaller class.
    The fold is not an argmax: each candidate meets the best so far.  regions: structs with idx, class_id, score and a box."""
    area = g.area(word)
    none = F.struct(F.lit(-1).alias("idx"), F.lit(0.0).alias("score"), F.lit(0).alias("class_id"), F.lit(0.0).alias("cover"))

    def step(best: Column, r: Column) -> Column:
        cover = F.when(area > 0, g.common_area(word, r) / area).otherwise(0.0)
        tie = F.abs(cover - best["cover"]) <= TIE
        better = (r["score"] > best["score"]) | ((r["score"] == best["score"]) & (r["class_id"] < best["class_id"]))
        take = (cover > 0) & (cover >= least) & ((best["idx"] < 0) | (cover > best["cover"] + TIE) | (tie & better))
        new = F.struct(r["idx"].cast("int").alias("idx"), r["score"].cast("double").alias("score"), r["class_id"].cast("int").alias("class_id"), cover.alias("cover"))
        return F.when(take, new).otherwise(best)

    return F.aggregate(regions, none, step, lambda b: F.when(b["idx"] >= 0, b["idx"]))


def region_lists(regions: DataFrame, page: list[str] = PAGE) -> DataFrame:
    one = F.struct("idx", "class_id", "score", "x0", "y0", "x1", "y1", "label")
    return regions.groupBy(*page).agg(F.array_sort(F.collect_list(one)).alias("regions"))


def assign(words: DataFrame, regions: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """words (page…, line, word, box columns) with region (an idx or null)."""
    box = F.struct("x0", "y0", "x1", "y1")
    met = words.join(region_lists(regions, page), page, "left")
    return met.select(*words.columns, F.when(F.col("regions").isNotNull(), region_for(box, F.col("regions"))).alias("region"))


def line_votes(assigned: DataFrame, regions: DataFrame, page: list[str] = PAGE, furniture_only: bool = False) -> DataFrame:
    """(page…, line, region, label, votes, words): the region with the most of a line's words, if more than half;
    equal votes go to the higher score, then the smaller idx."""
    counted = assigned.groupBy(*page, "line", "region").agg(F.count("*").alias("votes"))
    total = assigned.groupBy(*page, "line").agg(F.count("*").alias("words"))
    named = counted.join(regions.select(*page, F.col("idx").alias("region"), "label", "score"), [*page, "region"])
    named = named.filter(is_furniture(F.col("label"))) if furniture_only else named
    met = named.join(total, [*page, "line"]).filter(F.col("votes") * 2 > F.col("words"))
    best = met.groupBy(*page, "line").agg(F.max_by(F.struct("region", "label", "votes", "words"), F.struct("votes", "score", -F.col("region"))).alias("b"))
    return best.select(*page, "line", "b.*")


def columns_of(regions: Column, width: Column, content: list[str] | None = None) -> Column:
    """The left edges of the columns of a page, in order, or null if it is not surely of several.
    regions: structs with label and a box."""
    no = lambda r: is_furniture(r["label"])
    body = F.filter(regions, lambda r: ~no(r) if content is None else r["label"].isin(content) & ~no(r))
    wide = F.filter(body, lambda r: g.size(r, "x") >= width * SPAN)
    lefts = F.array_sort(F.transform(F.filter(body, lambda r: g.size(r, "x") < width * SPAN), lambda r: r["x0"].cast("double")))
    kind = "array<struct<left:double,n:int>>"

    def step(acc: Column, x: Column) -> Column:  # the first bucket that is near enough takes it
        hit = F.filter(F.transform(acc, lambda c, i: F.when(F.abs(c["left"] - x) <= width * TOLERANCE, i)), lambda i: i.isNotNull())
        grown = F.transform(acc, lambda c, i: F.when(i == F.get(hit, 0), F.struct(F.least(c["left"], x).alias("left"), (c["n"] + 1).alias("n"))).otherwise(c))
        return F.when(F.size(hit) > 0, grown).otherwise(F.concat(acc, F.array(F.struct(x.alias("left"), F.lit(1).alias("n")))))

    solid = F.aggregate(lefts, F.array().cast(kind), step, lambda acc: F.array_sort(F.transform(F.filter(acc, lambda c: c["n"] >= 2), lambda c: c["left"])))
    apart = F.forall(F.transform(solid, lambda x, i: x - F.get(solid, i - 1)), lambda d: d.isNull() | (d > width * TOLERANCE))
    ok = (width > 0) & (F.size(body) >= 4) & (F.size(wide) <= F.size(body) * 0.5) & (F.size(lefts) >= 4) & (F.size(solid) >= 2) & apart
    return F.when(ok, solid)


def column_index(x0: Column, columns: Column) -> Column:
    """The last column that begins at or left of x0, give or take one unit; 0 without columns."""
    reached = F.filter(F.transform(columns, lambda c, i: F.when(x0 >= c - 1, i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(reached), F.lit(0))


def reading_order(regions: DataFrame, pages: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """regions with column and order; pages (page…, width)."""
    lists = region_lists(regions, page).join(pages.select(*page, "width"), page)
    cols = lists.withColumn("cols", columns_of(F.col("regions"), F.col("width")))
    each = cols.select(*page, F.explode(F.transform("regions", lambda r: F.struct(column_index(r["x0"], F.col("cols")).alias("column"), r["y0"].alias("y0"), r["x0"].alias("x0"), r["idx"].alias("idx")))).alias("k"))
    lists = each.groupBy(*page).agg(F.array_sort(F.collect_list("k")).alias("l"))
    return lists.select(*page, F.posexplode("l").alias("order", "k")).select(*page, "order", "k.idx", "k.column")


def heading_claim(first: Column, font: Column, median: Column, label: Column, ratio: float = 1.25, longest: int = 60) -> Column:
    """text, layout or null: what makes a line a heading."""
    s = t.trim(first)
    able = (s != "") & (median > 0) & (t.len16(s) <= longest)
    by_text = (font > median * ratio) & t.looks_like_heading(first)
    by_layout = F.coalesce(label.isin(TITLES), F.lit(False)) & (font >= median * ratio * HEADING_FONT)
    return F.when(able & by_text, "text").when(able & by_layout, "layout")


def heading_disposition(first: Column, font: Column, median: Column, label: Column, vetoes: list[str], ratio: float = 1.25, longest: int = 60) -> Column:
    """struct<allowed, rule>: a veto label blocks a claim by text; a title label that is large enough supports one."""
    claim = heading_claim(first, font, median, F.lit(None).cast("string"), ratio, longest)
    s = t.trim(first)
    large = (median > 0) & (s != "") & (t.len16(s) <= longest) & (font >= median * ratio * HEADING_FONT)
    veto = label.isin(vetoes) & claim.isNotNull()
    rule = F.when(veto, "layout_says_not_heading").when((label == "doc_title") & large, "layout_says_doc_title").when((label == "paragraph_title") & large, "layout_says_paragraph_title")
    return F.struct((~F.coalesce(veto, F.lit(False))).alias("allowed"), rule.alias("rule"))


def decisions(lines: DataFrame) -> DataFrame:
    """lines (…, geometry_dropped, label) with layout_dropped, agrees and preferred: layout wins where it adds furniture,
    geometry where layout says content."""
    layout = F.when(F.col("label").isNull(), None).otherwise(is_furniture(F.col("label")))
    preferred = F.when(layout.isNull(), "geometry").when(layout == F.col("geometry_dropped"), "same").when(layout, "layout").otherwise("geometry")
    return lines.withColumn("layout_dropped", layout).withColumn("agrees", layout == F.col("geometry_dropped")).withColumn("preferred", preferred)


def decision_summary(decided: DataFrame, by: list[str]) -> DataFrame:
    """Two levels: group by page, then by document, and the sums are the same."""
    return decided.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("agrees")).alias("same"),
        F.count_if(~F.col("agrees")).alias("differ"),
        F.count_if(F.col("layout_dropped") & ~F.col("geometry_dropped")).alias("layout_caught"),
        F.count_if(F.col("geometry_dropped") & ~F.coalesce("layout_dropped", F.lit(False))).alias("geometric_only"),
        F.count_if(F.col("label").isNull()).alias("uncovered"),
    )


def isolated(lines: DataFrame, page: list[str] = PAGE, least: float = 1.4, narrow: float = 0.85) -> DataFrame:
    """lines (page…, line, box, font, is_heading, column_width): whether each stands apart as furniture does."""
    a, b = lines.alias("a"), lines.alias("b")
    pair = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in page]
    both = a.join(b, [*pair, F.col("a.line") != F.col("b.line")], "left")
    box = lambda x: F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    gap = F.when(F.col("b.line").isNotNull(), g.gap(box("a"), box("b")) / F.greatest("a.font", "b.font"))
    near = both.groupBy(*[F.col(f"a.{c}") for c in [*page, "line"]]).agg(F.min(gap).alias("near"))
    met = lines.join(near, [*page, "line"])
    width = F.col("x1") - F.col("x0")
    return met.select(*page, "line", (~F.col("is_heading") & (width < F.col("column_width") * narrow) & (F.coalesce("near", F.lit(float("inf"))) >= least)).alias("isolated"))
