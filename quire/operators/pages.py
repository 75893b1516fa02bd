"""Text items of pages to lines and paragraphs, word tables to lines, and statistics of sizes and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as t
from quire.operators.layout import PAGE

# How near items are of one line, how large a gap or a change of size parts paragraphs, when a text is residue.
SAME_LINE, BREAK, FONT_STEP, ENDED = 0.6, 1.35, 1.5, 0.95
FEW_CHARS, MANY_IMAGES = 50, 3
ITEM = "array<struct<key:double,items:array<struct<x:double,idx:long,s:string,h:double>>>>"


def median(x: Column) -> Column:
    return F.coalesce(F.median(x), F.lit(0.0))


def buckets(items: Column, tolerance: float) -> Column:
    """Items (structs y, x, idx, s, h, in order of idx) by the first bucket whose first y is near enough."""

    def step(acc: Column, i: Column) -> Column:
        hit = F.get(F.filter(F.transform(acc, lambda b, k: F.when(F.abs(b["key"] - i["y"]) <= tolerance, k)), lambda k: k.isNotNull()), 0)
        own = F.struct(i["x"].cast("double").alias("x"), i["idx"].cast("long").alias("idx"), i["s"].alias("s"), i["h"].cast("double").alias("h"))
        grown = F.transform(acc, lambda b, k: F.when(k == hit, F.struct(b["key"].alias("key"), F.concat(b["items"], F.array(own)).alias("items"))).otherwise(b))
        return F.when(hit.isNotNull(), grown).otherwise(F.concat(acc, F.array(F.struct(i["y"].cast("double").alias("key"), F.array(own).alias("items")))))

    return F.aggregate(items, F.array().cast(ITEM), step)


def lines(items: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """items (page…, idx, s, x, y, h), y upward: (page…, line, y, text, font), from the top."""
    lists = items.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("idx", "y", "x", "s", "h"))).alias("l"))
    made = F.transform(
        buckets(F.col("l"), SAME_LINE),
        lambda b: F.struct(
            (-b["key"]).alias("minus"),
            t.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(b["items"]), lambda i: i["s"]), ""), f"[{t.WS}]+", " ")).alias("text"),
            F.greatest(F.array_max(F.transform(b["items"], lambda i: F.coalesce(i["h"], F.lit(0.0)))), F.lit(0.0)).alias("font"),
        ),
    )
    full = F.filter(made, lambda x: x["text"] != "")
    ordered = F.array_sort(F.transform(full, lambda x, i: F.struct(x["minus"].alias("minus"), i.alias("i"), x["text"].alias("text"), x["font"].alias("font"))))
    return lists.select(*page, F.posexplode(ordered).alias("line", "x")).select(*page, "line", (-F.col("x.minus")).alias("y"), "x.text", "x.font")


def paragraphs(made: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Lines to (page…, paragraph, text, y, font, lines): a fold, for a line's size is held against its paragraph's first."""
    by_line = Window.partitionBy(*page).orderBy("line")
    gapped = made.withColumn("gap", F.abs(F.lag("y").over(by_line) - F.col("y")))
    lists = gapped.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("line", "y", "text", "font", F.coalesce("gap", F.lit(0.0)).alias("gap")))).alias("l"), median(F.col("gap")).alias("m"))
    kind = "array<struct<text:string,y:double,font:double,lines:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        far = x["gap"] > F.when(F.col("m") > 0, F.col("m") * BREAK).otherwise(x["font"] * BREAK)
        ended = last["text"].rlike(f"[{t.SENTENCE_ENDS}]\\z") & (x["gap"] > F.col("m") * ENDED)
        new = F.struct(x["text"].alias("text"), x["y"].cast("double").alias("y"), x["font"].cast("double").alias("font"), F.lit(1).alias("lines"))
        glue = F.when(last["text"].rlike("[\\u4e00-\\u9fff]\\z"), "").otherwise(" ")
        longer = F.struct(F.concat(last["text"], glue, x["text"]).alias("text"), last["y"].alias("y"), last["font"].alias("font"), (last["lines"] + 1).alias("lines"))
        part = (F.size(acc) == 0) | far | (F.abs(x["font"] - last["font"]) > FONT_STEP) | ended
        return F.when(F.coalesce(part, F.lit(True)), F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))

    return lists.select(*page, F.posexplode(F.aggregate("l", F.array().cast(kind), step)).alias("paragraph", "p")).select(*page, "paragraph", "p.*")


def blocks(made: DataFrame, most: int = 1200, page: list[str] = PAGE) -> DataFrame:
    """Paragraphs to typed blocks of at most `most` characters: large and short ones are headings."""
    kind = F.when((F.col("font") >= 16) & (t.len16(F.col("text")) <= 80), "heading").otherwise("paragraph")
    parts = made.select(*page, "paragraph", kind.alias("type"), F.posexplode(t.pack_for_pages(F.col("text"), most)).alias("part", "content"))
    return parts


def residue(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, chars, images): whether a document is a scan: no text, or hardly any beside many images."""
    return pages.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.sum("images").alias("images"), F.count("*").alias("pages")).withColumn(
        "scanned", (F.col("chars") == 0) | ((F.col("chars") / F.col("pages") < FEW_CHARS) & (F.col("images") / F.col("pages") >= MANY_IMAGES))
    )


def dominant_font(words: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """The most common size in halves, the smaller of equals, unless the largest other one has two fifths of the words."""
    sized = words.groupBy(*page, (F.floor(F.col("font") * 2 + 0.5) / 2).alias("size")).agg(F.count("*").alias("n"))
    total = sized.groupBy(*page).agg(F.sum("n").alias("all"), F.max_by("size", F.struct("n", -F.col("size"))).alias("mode"))
    met = sized.join(total, page)
    large = F.max(F.when((F.col("n") >= F.col("all") * 0.4) & (F.col("size") > F.col("mode")), F.col("size")))
    return met.groupBy(*page).agg(F.coalesce(large, F.first("mode")).alias("font"))


def baseline(words: DataFrame, by: list[str], apart: float = 100.0) -> DataFrame:
    """Theil-Sen: the median slope of word pairs far enough apart, the median intercept, the median residual."""
    w = words.select(*by, "word", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("y"))
    a, b = w.alias("a"), w.alias("b")
    pairs = a.join(b, [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in by], F.col("a.word") < F.col("b.word"), F.abs(F.col("b.x") - F.col("a.x")) >= apart])
    slope = pairs.groupBy(*[F.col(f"a.{c}") for c in by]).agg(F.median((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("slope"))
    fit = w.join(slope, by).groupBy(*by).agg(F.first("slope").alias("slope"), F.median(F.col("y") - F.col("slope") * F.col("x")).alias("intercept"))
    off = F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))
    return w.join(fit, by).groupBy(*by).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.median(off).alias("residual"))


def furniture_lines(made: DataFrame, margin: float = 0.05, small: float = 0.85, page: list[str] = PAGE) -> DataFrame:
    """lines (page…, line, y0, y1, font, height of the page): those in a margin that are small, on pages of three lines or more."""
    per = made.groupBy(*page).agg(F.median("font").alias("mid"), F.count("*").alias("n"))
    at = (F.col("y0") + F.col("y1")) / 2
    edge = (at < F.col("height") * margin) | (at > F.col("height") * (1 - margin))
    return made.join(per, page).filter((F.col("n") >= 3) & edge & (F.col("font") < F.col("mid") * small)).select(*made.columns)


def runs(words: DataFrame, flag: str, by: list[str], order: str, least: int = 2) -> DataFrame:
    """Islands of flagged rows: (by…, run, first, last, n), n at least `least`."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = words.withColumn("_run", F.sum((~F.col(flag)).cast("int")).over(w)).filter(flag)
    return marked.groupBy(*by, F.col("_run").alias("run")).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least)


def two_columns(made: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Pages with two lines that share half their height and no width."""
    a, b = made.alias("a"), made.alias("b")
    box = lambda x: F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    pair = [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in page], F.col("a.line") < F.col("b.line")]
    return a.join(b, [*pair, g.same_line(box("a"), box("b")), g.overlap(box("a"), box("b"), "x") <= 0]).select(*[F.col(f"a.{c}") for c in page]).distinct()
