"""Recognised words of a page to lines and blocks, with the page's regions, and what a second reading may replace.

Words are (page…, word, text, confidence, font, x0, y0, x1, y1), y downward.  A page is bounded, so what depends on the order
of its lines runs once a page; everything else is expressions.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as t
from quire.operators import layout, pages
from quire.operators.layout import PAGE

# How near words of a line are, and what parts paragraphs.
SAME_LINE, GAP, GAP_FONT, FONT_STEP, ENDED, HEADING_FONT, HEADING_LONGEST = 5.0, 1.2, 1.8, 0.25, 0.95, 1.3, 80
# What a fitted base line must be; what a fragment covers; how a short chunk is told.
FULL_SIZE, LEAST_WORDS, RESIDUAL, FRAGMENT, SHORT, LONGEST = 0.9, 3, 35, 0.6, 20, 400
# List marks and sentence ends, as patterns.
NUMBERED = r"^\s*(?:\d{1,3}\s*(?:[、)）]|\.(?!\d))|[（(]\s*\d{1,3}\s*[)）])\s*\S"
ENDS, ENDS_OR_COLON = "[。！？!?.;；]$", r"[。！？!?.;；:：]\s*$"
LIST_START = r"^\s*(?:[•·▪◦*\-–—]|\(?\d+[.)、）]|[（(]\d+[)）]|[一二三四五六七八九十]+[、.)）])"
CLI_ENDS, FEW_LINES = "[。！？；：!?;:.]$", 8
CJK = "㐀-䶿一-鿿豈-﫿"
# Rows of ink that make a band, and valleys that part one.
ROW_SHARE, ROW_GAP, BAND_ROWS, SPLIT, SPLIT_FONT, SIDE, SIDE_FONT = 0.03, 1, 3, 60.0, 1.6, 24.0, 0.7
VALLEY, VALLEY_LOW, VALLEY_MARGIN, VALLEY_ROWS = 0.55, 0.75, 0.2, 2


def _kinds(df: DataFrame, cols: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in cols)


def _joined(left: str, right: str) -> str:
    right = right.strip()
    if not left or not right:
        return left or right
    a, b = left[-1], right[0]
    space = not re.match(f"[{CJK}]", a) and re.match(r"\w", a) and (re.match(r"\w", b) or b in "([{")
    return f"{left} {right}" if space else left + right


def _keyed(part: pd.DataFrame) -> list[tuple[float, pd.DataFrame]]:
    """Words by the first line, from the top, whose first word's middle is near enough."""
    mid = (part["y0"] + part["y1"]) / 2
    order = np.lexsort((part["x0"], mid))
    keys: list[float] = []
    own: list[list[int]] = []
    for i in order:
        y = float(mid.iloc[i])
        k = next((k for k in range(len(keys)) if abs(keys[k] - y) <= SAME_LINE), None)
        if k is None:
            keys.append(y)
            own.append([])
            k = len(keys) - 1
        own[k].append(int(i))
    return [(key, part.iloc[rows].sort_values("x0", kind="stable")) for key, rows in zip(keys, own, strict=True)]


def lines(words: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """(page…, line, y, text, font, confidence, words, x0, y0, x1, y1), from the top; lines without text go."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, own in _keyed(part.sort_values("word")):
            text = ""
            for w in own["text"].fillna(""):
                text = _joined(text, w)
            if text:
                out.append((key, text, own["font"].mean(), own["confidence"].mean(), own["word"].tolist(), own["x0"].min(), own["y0"].min(), own["x1"].max(), own["y1"].max()))
        out.sort(key=lambda r: r[0])
        made = pd.DataFrame(out, columns=["y", "text", "font", "confidence", "words", "x0", "y0", "x1", "y1"])
        made.insert(0, "line", np.arange(len(made)))
        for c in reversed(page):
            made.insert(0, c, part[c].iloc[0])
        return made

    schema = _kinds(words, page) + ", line int, y double, text string, font double, confidence double, words array<long>, x0 double, y0 double, x1 double, y1 double"
    return words.withColumn("word", F.col("word").cast("long")).groupBy(*page).applyInPandas(one, schema)


def labelled(made: DataFrame, regions: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """lines with the region (idx, label) that covers most of each, however little, or null."""
    a, r = made.alias("a"), regions.select(*page, "idx", "label", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    own = g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    cover = g.containment(own, g.box(F.col("rx0"), F.col("ry0"), F.col("rx1"), F.col("ry1")))
    met = a.join(r, page).withColumn("cover", cover).filter("cover > 0")
    best = met.groupBy(*page, "line").agg(F.max_by(F.struct(F.col("idx").alias("region"), "label"), F.struct("cover", -F.col("idx"))).alias("b"))
    return made.join(best.select(*page, "line", "b.region", "b.label"), [*page, "line"], "left")


def laid_out(made: DataFrame, regions: DataFrame, widths: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Lines with the regions applied: furniture goes; the rest is in the regions' reading order on pages that surely have
    columns and on which every line that is left has a region, and as it was elsewhere."""
    marked = labelled(made, regions, page).filter(~F.coalesce(layout.is_furniture(F.col("label")), F.lit(False)))
    whole = marked.groupBy(*page).agg(F.bool_and(F.col("region").isNotNull()).alias("whole"))
    columns = layout.region_lists(regions, page).join(widths, page).select(*page, layout.columns_of(F.col("regions"), F.col("width")).isNotNull().alias("columns"))
    order = layout.reading_order(regions, widths, page).select(*page, F.col("idx").alias("region"), F.col("order").alias("_order"))
    met = marked.join(whole, page).join(columns, page, "left").join(order, [*page, "region"], "left")
    key = F.when(F.col("whole") & F.coalesce("columns", F.lit(False)), F.col("_order"))
    by = Window.partitionBy(*page).orderBy(F.coalesce(key, F.lit(0)), "line")
    cols = [c for c in made.columns if c not in page and c != "line"]
    return met.select(*page, (F.row_number().over(by) - 1).alias("line"), *cols, "region", "label", (key.isNotNull()).alias("reordered"))


def _heading(s: str) -> bool:
    if len(s) > 40 or re.search("[。！？!?]$", s):
        return False
    if re.match(r"^#{1,6}\s", s) or re.match(r"(?i)^(第[一二三四五六七八九十百千\d]+[章节回卷篇部]|chapter\s+\d+|序章|后记|尾声)", s) or re.match(r"^\d+(\.\d+)*[\s、.]", s):
        return True
    return len(s) <= 30 and re.match(r"^[A-Z][A-Z\s\d\-:]{3,}$", s) is not None


def _continued(left: str, right: str) -> str:
    if re.search("[a-z][-‐]$", left) and re.match("[a-z]", right):
        return left[:-1] + right
    return left + ("" if re.search("[一-鿿]$", left) else " ") + right


def blocks(made: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Lines to (page…, block, type, content, confidence, lines): a line begins a block after a gap, at a numbered item, at
    another size unless it plainly goes on, or after a sentence's end; large short ones that read so are headings.  A label
    column, if there is one, has its say on headings."""
    labelled_ = "label" in made.columns

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line")
        rows = part.to_dict("records")
        gaps = [abs(a["y"] - b["y"]) for a, b in zip(rows, rows[1:], strict=False)]
        mid_gap, mid_font = float(np.median(gaps)) if gaps else 0.0, float(np.median(part["font"])) or 12.0
        left, right = part["x0"].min(), part["x1"].max()
        out, now, last = [], None, None

        def close() -> None:
            if now is None or not now["text"].strip():
                return
            first, font, label = now["first"].strip(), now["font"], now["label"]
            able = bool(first) and mid_font > 0 and len(first) <= HEADING_LONGEST
            large = able and font >= mid_font * HEADING_FONT * layout.HEADING_FONT
            claim = able and (font > mid_font * HEADING_FONT and _heading(now["first"]) or label in layout.TITLES and large)
            veto = label is not None and label not in layout.TITLES and able and font > mid_font * HEADING_FONT and _heading(now["first"])
            out.append(("heading" if claim and not veto else "paragraph", now["text"].strip(), int(np.floor(now["conf"] / max(1, now["words"]) + 0.5)), now["lines"]))

        for r in rows:
            gap = 0.0 if last is None else abs(last["y"] - r["y"])
            far = gap > min(max(mid_gap, r["font"]) * GAP, r["font"] * GAP_FONT)
            step = now is not None and abs(r["font"] - now["font"]) > max(r["font"], now["font"]) * FONT_STEP
            wrapped = (
                step and not re.search(ENDS_OR_COLON, last["text"]) and last["x1"] >= right - max(last["font"] * 1.2, (right - left) * 0.03) and r["x0"] <= left + r["font"] * 2
            )
            ended = now is not None and re.search(ENDS, now["text"]) and gap > r["font"] * ENDED
            n = len(r["words"])
            if now is None or re.match(NUMBERED, r["text"]) or far or step and not wrapped or ended:
                close()
                now = {"text": r["text"], "first": r["text"], "label": r.get("label"), "font": r["font"], "conf": r["confidence"] * n, "words": n, "lines": 1}
            else:
                now["text"] = _continued(now["text"], r["text"])
                now["conf"], now["words"], now["lines"] = now["conf"] + r["confidence"] * n, now["words"] + n, now["lines"] + 1
            last = r
        close()
        got = pd.DataFrame(out, columns=["type", "content", "confidence", "lines"])
        got.insert(0, "block", np.arange(len(got)))
        for c in reversed(page):
            got.insert(0, c, part[c].iloc[0])
        return got

    cols = [*page, "line", "y", "text", "font", "confidence", "words", "x0", "x1", *(["label"] if labelled_ else [])]
    return made.select(*cols).groupBy(*page).applyInPandas(one, _kinds(made, page) + ", block int, type string, content string, confidence int, lines int")


def text_chunks(s: Column) -> Column:
    """array<struct<type, content>> of a page's bare text: what blank lines part, else its lines; short pieces join the one
    before where neither is a heading and it does not end."""
    clean = t.trim(F.regexp_replace(s, "\r\n?", "\n"))
    tidy = lambda x: t.trim(F.regexp_replace(x, f"[{t.WS}]{{2,}}", " "))
    full = lambda a: F.filter(F.transform(a, tidy), lambda x: x != "")
    by_blank = full(F.transform(F.split(clean, f"\\n[{t.WS}]*\\n+"), lambda x: F.replace(x, F.lit("\n"), F.lit(" "))))

    def merged(chunks: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

        def step(acc: Column, x: Column) -> Column:
            last = acc["last"]
            short = (t.len16(last) < SHORT) | (t.len16(x) < SHORT)
            join = last.isNotNull() & ~t.looks_like_heading(last) & ~t.looks_like_heading(x) & short & (t.len16(last) + t.len16(x) <= LONGEST) & ~last.rlike("[。！？!?.;；:：]\\z")
            glue = F.coalesce(t.dehyphenate(last, x), F.concat(last, F.when(last.rlike("[\\u4e00-\\u9fff]\\z"), "").otherwise(" "), x))
            kept = F.when(last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
            return F.when(F.coalesce(join, F.lit(False)), F.struct(acc["done"].alias("done"), glue.alias("last"))).otherwise(F.struct(kept.alias("done"), x.alias("last")))

        return F.aggregate(chunks, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))

    chosen = t.let(by_blank, lambda a: F.when(F.size(a) > 1, a).otherwise(full(F.split(clean, "\n"))))
    return F.transform(t.let(chosen, merged), lambda x: F.struct(F.when(t.looks_like_heading(x), "heading").otherwise("paragraph").alias("type"), x.alias("content")))


def off_limit(main: Column) -> Column:
    """RESIDUAL hundredths of a size, rounded once: 12 * 0.35 falls short of 4.2, and a residual of 4.2 would be over it."""
    return main * RESIDUAL / 100


def tilted(words: DataFrame, by: list[str], main: Column) -> DataFrame:
    """(by…, slope, intercept): the base line of each group of words that is surely tilted: three words of full size or more
    (of any size, if fewer are), a drift beyond a line's tolerance over their span, and small residuals.
    words: as lines has them, with main as an expression of the page's size."""
    sized = words.withColumn("_main", main)
    full = sized.withColumn("_full", F.col("font") > F.col("_main") * FULL_SIZE)
    enough = full.groupBy(*by).agg(F.count_if("_full").alias("_n"))
    sample = full.join(enough, by).filter((F.col("_n") < LEAST_WORDS) | F.col("_full"))
    size = sample.groupBy(*by).agg(F.count("*").alias("n"), (F.max("x1") - F.min("x0")).alias("span"), F.first("_main").alias("main"))
    fit = pages.baseline(sample, by).join(size, by)
    sure = (F.col("main") > 0) & (F.col("n") >= LEAST_WORDS) & (F.abs("slope") * F.col("span") >= SAME_LINE) & (F.col("residual") <= off_limit(F.col("main")))
    return fit.filter(sure).select(*by, "slope", "intercept", "main")


def off_line(words: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """(by…, off): whether a word of full size stands too far from its base line."""
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    far = F.abs(mid("y0", "y1") - F.col("slope") * mid("x0", "x1") - F.col("intercept")) > off_limit(F.col("main"))
    return words.join(fits, by).groupBy(*by).agg(F.bool_or((F.col("font") > F.col("main") * FULL_SIZE) & far).alias("off"))


def word_slopes(words: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """words with the slope of their line, 0 where it is not surely tilted."""
    return words.join(fits.select(*by, "slope"), by, "left").na.fill(0.0, ["slope"])


def fragments(words: DataFrame, regions: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Words of signs alone that lie in a region: (page…, idx of the region, word)."""
    w, r = words.alias("w"), regions.alias("r")
    box = lambda x: g.box(*[F.col(f"{x}.{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (g.centre_inside(box("w"), box("r")) == 1) & (g.overlap_of_smaller(box("w"), box("r")) >= FRAGMENT)
    met = w.join(r, [*[F.col(f"w.{c}") == F.col(f"r.{c}") for c in page], t.punctuation_only(F.col("w.text")), inside])
    return met.select(*[F.col(f"w.{c}").alias(c) for c in page], F.col("r.idx").alias("idx"), F.col("w.word").alias("word"))


def replacement(region: Column, words: Column, recovered: Column) -> Column:
    """struct<kept, drops, admitted> for a region's second reading.  words: array<struct<word, text, garbage, box>>, recovered:
    array<struct<word, text, box>>, box being x0 to y1.  A word goes as garbage, as a duplicate of a new word that holds it
    and touches it, or as a fragment of signs in the region; new words come in that overlap no kept word and none before."""
    share = lambda a, b: g.overlap_of_smaller(a["box"], b["box"])

    def why(w: Column) -> Column:
        double = F.exists(recovered, lambda r: t.folded_contains(r["text"], w["text"]) & (share(w, r) > 0))
        sign = t.punctuation_only(w["text"]) & (g.overlap_of_smaller(w["box"], region) >= FRAGMENT)
        return F.when(w["garbage"], "garbage").when(double, "duplicate").when(sign, "fragment")

    judged = F.transform(words, lambda w: F.struct(w["word"].alias("word"), w["box"].alias("box"), F.when(F.size(recovered) > 0, why(w)).alias("reason")))
    kept = F.filter(judged, lambda w: w["reason"].isNull())

    def admit(free: Column) -> Column:
        none = F.filter(recovered, lambda _: F.lit(False))
        clear = lambda r, others: ~F.exists(others, lambda w: share(r, w) >= 0.5)
        return F.aggregate(recovered, none, lambda acc, r: F.when(clear(r, free) & clear(r, acc), F.concat(acc, F.array(r))).otherwise(acc))

    ids = lambda a: F.transform(a, lambda w: w["word"])
    drops = F.transform(F.filter(judged, lambda w: w["reason"].isNotNull()), lambda w: F.struct(w["word"].alias("word"), w["reason"].alias("reason")))
    return F.struct(ids(kept).alias("kept"), drops.alias("drops"), ids(t.let(kept, admit)).alias("admitted"))


def primary_line(made: DataFrame, by: list[str]) -> DataFrame:
    """(by…, line): of a cluster's lines the first that holds an equals sign, else with the most words."""
    score = F.when(F.col("text").rlike("[=＝]"), 1000).otherwise(0) + F.size("words")
    return made.groupBy(*by).agg(F.max_by("line", F.struct(score.alias("s"), -F.col("line"))).alias("line"))


def combined(made: DataFrame, by: list[str]) -> DataFrame:
    """A cluster's lines as one: (by…, words, y, font, confidence): from the top, a line that spans all others first; size and
    confidence are means over words."""
    n = F.size("words")
    tops = made.groupBy(*by).agg(F.min("y0").alias("_top"), F.max("y1").alias("_bottom"), F.count("*").alias("_lines"), F.max("y0").alias("_low"), F.min("y1").alias("_high"))
    met = made.join(tops, by)
    spans = (F.col("_lines") > 1) & (F.col("y0") <= F.col("_top")) & (F.col("y1") >= F.col("_bottom"))
    order = F.struct((~spans).alias("later"), (-F.when(spans, F.when(F.col("text").rlike("[=＝]"), 1000).otherwise(0) + n).otherwise(0)).alias("score"), "y0", "y", "line", "words")
    got = met.groupBy(*by).agg(
        F.array_sort(F.collect_list(order)).alias("l"), F.min("y0").alias("top"),
        (F.sum(F.col("font") * F.greatest(n, F.lit(1))) / F.greatest(F.sum(n), F.lit(1))).alias("font"), (F.sum(F.col("confidence") * n) / F.greatest(F.sum(n), F.lit(1))).alias("confidence"),
    )
    return got.select(*by, F.flatten(F.transform("l", lambda x: x["words"])).alias("words"), F.col("top").alias("y"), "font", "confidence")


def extent(words: DataFrame, by: list[str]) -> DataFrame:
    """(by…, x0, x1, y0, y1, width) of each line's words."""
    box = words.groupBy(*by).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return box.withColumn("width", F.col("x1") - F.col("x0"))


def widest(made: DataFrame, page: list[str] = PAGE) -> DataFrame:
    return made.groupBy(*page).agg(F.greatest(F.max(F.col("x1") - F.col("x0")), F.lit(0.0)).alias("width"))


def failures(results: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """results (by…, page, outcome, dark_ratio, message): pages by outcome, the darkest page, and the first failures."""
    failed = F.col("outcome") == "failed"
    first = F.slice(F.array_sort(F.collect_list(F.when(failed, F.struct("page", "message")))), 1, most)
    outcomes = [F.count_if(F.col("outcome") == o).alias(o) for o in ("failed", "empty", "blank")]
    return results.groupBy(*by).agg(F.count("*").alias("pages"), *outcomes, F.max(F.coalesce("dark_ratio", F.lit(0.0))).alias("darkest"), first.alias("first_failures"))


def ink_statistics(pixels: DataFrame, sizes: DataFrame, page: list[str] = PAGE, threshold: int = 250, every: int = 16) -> DataFrame:
    """pixels (page…, x, y, luma), sizes (page…, width, height): the share of dark cells and the mean brightness, over cells
    of `every` pixels; a page without size has none, a page without pixels failed."""
    cells = pixels.groupBy(*page, F.floor(F.col("x") / every).alias("cx"), F.floor(F.col("y") / every).alias("cy")).agg(F.avg("luma").alias("luma"))
    got = cells.groupBy(*page).agg((F.count_if(F.col("luma") < threshold) / F.count("*")).alias("dark_ratio"), F.avg("luma").alias("mean_luma"))
    met = sizes.join(got, page, "left")
    none = (F.coalesce(F.col("width"), F.lit(0)) <= 0) | (F.coalesce(F.col("height"), F.lit(0)) <= 0)
    return met.select(*page, F.coalesce("dark_ratio", F.lit(0.0)).alias("dark_ratio"), F.coalesce("mean_luma", F.lit(255.0)).alias("mean_luma"), (F.col("mean_luma").isNull() & ~none).alias("failed"))


def ink_bands(cells: DataFrame, areas: DataFrame, page: list[str] = PAGE, cell: int = 4) -> DataFrame:
    """cells (page…, r, c, ink) of an area, areas (page…, x0, y0, cols, rows, font): the bands of inked rows, gaps of one row
    bridged, tall ones parted at a clear valley: (page…, band, x0, y0, x1, y1)."""
    rows = cells.filter("ink > 0").groupBy(*page, "r").agg(F.count("*").cast("int").alias("n"))
    lists = rows.groupBy(*page).agg(F.map_from_entries(F.collect_list(F.struct("r", "n"))).alias("profile"))
    met = areas.join(lists, page, "left")

    def one(profile: dict | None, x0: float, y0: float, cols: int, height: int, font: float) -> list[dict]:
        n = [int((profile or {}).get(r, 0)) for r in range(height or 0)]
        least = max(2, int(np.floor((cols or 0) * ROW_SHARE + 0.5)))
        cores: list[list[int]] = []
        for r, v in enumerate(n):
            if v >= least:
                if cores and r - cores[-1][1] <= ROW_GAP + 1:
                    cores[-1][1] = r
                else:
                    cores.append([r, r])
        font = font if font and np.isfinite(font) else 0.0
        tall, side = max(SPLIT, font * SPLIT_FONT), max(SIDE, font * SIDE_FONT)
        out = []
        for s, e in cores:
            span = e - s + 1
            if span < BAND_ROWS:
                continue
            cut = None
            if span * cell >= tall and span >= BAND_ROWS * 2:
                margin = max(1, int(span * VALLEY_MARGIN))
                inside = n[s + margin : e - margin + 1]
                if len(inside) >= 3:
                    mid, low = sorted(inside)[len(inside) // 2], min(inside)
                    at = s + margin + inside.index(low)
                    a = b = at
                    while a > s and n[a - 1] <= mid * VALLEY_LOW:
                        a -= 1
                    while b < e and n[b + 1] <= mid * VALLEY_LOW:
                        b += 1
                    if mid > 0 and low <= mid * VALLEY and (at - s) * cell >= side and (e - at + 1) * cell >= side and b - a + 1 >= VALLEY_ROWS:
                        cut = y0 + (at - 1) * cell
            ends = [y0 + s * cell, *([cut] if cut is not None else []), y0 + (e + 1) * cell]
            out += [{"x0": x0, "y0": float(a), "x1": x0 + cols * cell, "y1": float(b)} for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def made(profile: pd.Series, x0: pd.Series, y0: pd.Series, cols: pd.Series, height: pd.Series, font: pd.Series) -> pd.Series:
        return pd.Series([one(dict(p) if p is not None else None, *rest) for p, *rest in zip(profile, x0, y0, cols, height, font, strict=True)])

    bands = F.pandas_udf(made, "array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = met.withColumn("bands", bands("profile", F.col("x0").cast("double"), F.col("y0").cast("double"), F.col("cols").cast("int"), F.col("rows").cast("int"), F.col("font").cast("double")))
    return got.select(*page, F.posexplode("bands").alias("band", "b")).select(*page, "band", "b.*")


def column_spans(pixels: DataFrame, by: list[str], dark: int = 160, least: int = 2) -> DataFrame:
    """pixels (by…, x, y, luma): the first and last dark row of each column with enough of them."""
    return pixels.filter(F.col("luma") < dark).groupBy(*by, "x").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")


def reflowed(made: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Lines to (page…, paragraph, text): a line goes on where the one before reaches the usual right edge, this one begins at
    the left, the leading is tight, and neither a sentence ends nor a list begins; short and several-column pages stay as lines."""
    columns = pages.two_columns(made, page).withColumn("_columns", F.lit(True))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        rows = [r for r in part.sort_values("line").to_dict("records") if r["text"].strip()]
        texts = [r["text"].strip() for r in rows]
        if len(rows) >= FEW_LINES and not part["_columns"].iloc[0]:
            rights, heights = sorted(r["x1"] for r in rows), sorted(r["y1"] - r["y0"] for r in rows)
            left, high = min(r["x0"] for r in rows), heights[len(heights) // 2] or 20
            width = max(1, rights[-1] - left)
            usual = rights[min(len(rights) - 1, int(len(rights) * 0.75))]
            texts, now = [], rows[0]["text"].strip()
            for a, b in zip(rows, rows[1:], strict=False):
                gap, nxt = b["y0"] - a["y1"], b["text"].strip()
                reaches = a["x1"] >= usual - max(high * 1.5, width * 0.03) and a["x1"] - a["x0"] >= width * 0.55
                if reaches and abs(b["x0"] - left) <= max(high * 0.8, width * 0.03) and -high * 0.5 <= gap <= high * 1.5 and not re.search(CLI_ENDS, now) and not re.match(LIST_START, b["text"]):
                    now += nxt if re.match(f"[{CJK}]", now[-1]) or re.match(f"[{CJK}]", nxt[0]) else " " + nxt
                else:
                    texts.append(now)
                    now = nxt
            texts.append(now)
        got = pd.DataFrame({"paragraph": np.arange(len(texts), dtype=np.int32), "text": texts})
        for c in reversed(page):
            got.insert(0, c, part[c].iloc[0])
        return got

    src = made.join(columns, page, "left").na.fill(False, ["_columns"]).select(*page, "line", "text", "x0", "y0", "x1", "y1", "_columns")
    return src.groupBy(*page).applyInPandas(one, _kinds(made, page) + ", paragraph int, text string")
