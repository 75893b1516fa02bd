"""Crops of a page for another reading, and measures of characters in them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as t

#: Pad of a crop (share, least), steps of a sequence in pixels, what is small, what must be covered, a crop's edge.
PAD, LEAST_PAD, STEP, SMALL, COVER, EDGE = 0.08, 2, 8, 0.8, 0.5, 1.5
#: Heights and shifts that speak for a raised small character; and what counts as dark on a page, and how a page is sampled.
FULL, SMALL_BOX, RAISED, DARK, SAMPLE = 0.6, 0.6, 0.25, 250, 16


def crop(box: Column, width: Column, height: Column, upscale: Column, most: Column, pad: float | None = PAD) -> Column:
    """struct<x, y, w, h, scale, target_w, target_h> of the crop of a box, or null if nothing of it lies in the source.
    pad: the share added at each side, or None for the box as it is."""
    x, y = F.greatest(F.lit(0), F.floor(box["x0"])), F.greatest(F.lit(0), F.floor(box["y0"]))
    w, h = F.least(F.ceil(g.size(box, "x")), width - x), F.least(F.ceil(g.size(box, "y")), height - y)
    there = (width > 0) & (height > 0) & (w >= 1) & (h >= 1)
    if pad is not None:
        p = F.greatest(F.lit(LEAST_PAD), F.floor(F.greatest(w, h) * pad + 0.5))
        px, py = F.greatest(F.lit(0), x - p), F.greatest(F.lit(0), y - p)
        x, y, w, h = px, py, F.least(w + p * 2, width - px), F.least(h + p * 2, height - py)
        there = there & (w >= 1) & (h >= 1)
    fit = F.when((most > 0) & ~F.isnan(most.cast("double")) & (most.cast("double") < float("inf")), F.sqrt(most / (w * h))).otherwise(1.0)
    scale = F.greatest(F.lit(1.0), F.least(upscale.cast("double"), fit))
    whole = lambda v: v.cast("long")
    target = lambda v: F.greatest(F.lit(1), F.floor(v * scale + 0.5)).cast("long")
    return F.when(there, F.struct(whole(x).alias("x"), whole(y).alias("y"), whole(w).alias("w"), whole(h).alias("h"), scale.alias("scale"), target(w).alias("target_w"), target(h).alias("target_h")))


def shrink(width: Column, height: Column, most: Column) -> Column:
    """The factor that keeps an image within `most` pixels."""
    return F.when((width <= 0) | (height <= 0) | (width * height <= most), 1.0).otherwise(F.sqrt(most / (width * height)))


def to_word(box: Column, origin_x: Column, origin_y: Column, upscale: Column, scale: Column) -> Column:
    """A box of a crop, in the page's measure."""
    at = lambda v, o: (o + v / upscale) / scale
    return g.box(at(box["x0"], origin_x), at(box["y0"], origin_y), at(box["x1"], origin_x), at(box["y1"], origin_y))


def steps(width: Column, step: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(width / F.when(step > 0, step).otherwise(STEP))).cast("int")


def gaps_only(chars: Column, start: Column, end: Column) -> Column:
    """All characters strictly between two places are there and not blank."""
    between = F.slice(chars, start + 2, F.greatest(end - start - 1, F.lit(0)))
    inside = F.least(end, F.size(chars)) - start - 1
    return (inside >= end - start - 1) & F.forall(between, lambda c: t.trim(F.coalesce(c, F.lit(""))) != "")


def trimmed_range(chars: Column) -> Column:
    """struct<start, end> of a list of characters without its blank ends."""
    full = F.filter(F.transform(chars, lambda c, i: F.when(t.trim(F.coalesce(c, F.lit(""))) != "", i)), lambda i: i.isNotNull())
    return F.struct(F.coalesce(F.array_min(full), F.size(chars)).alias("start"), F.coalesce(F.array_max(full) + 1, F.size(chars)).alias("end"))


def _height(y0: Column, y1: Column) -> Column:
    px = (y1 - y0).cast("double")
    return F.when(px.isNotNull() & ~F.isnan(px) & (px > 0) & (px < float("inf")), px)


def scaled_down(char: Column, y0: Column, y1: Column, full: Column) -> Column:
    """A letter or digit, not of a script of its own and not Chinese, that is lower than its kind on the page."""
    kind = (t.trim(char) != "") & ~char.rlike("^[⁰¹²³⁴-⁾ₐ-ₜ₀-₎]\\z") & ~char.rlike(f"^[{t.CJK}]\\z") & char.rlike(r"[\p{L}\p{N}]")
    return F.coalesce(kind & (full > 0) & (_height(y0, y1) / full < SMALL), F.lit(False))


def own_height_accepts(char: Column, y0: Column, y1: Column, full: Column) -> Column:
    """Nothing in a character's own height speaks against its being a script."""
    free = (t.trim(F.coalesce(char, F.lit(""))) == "") | char.rlike("^[⁰¹²³⁴-⁾ₐ-ₜ₀-₎]\\z")
    measured = _height(y0, y1)
    return F.coalesce(free, F.lit(True)) | (F.coalesce(full > 0, F.lit(False)) & (measured.isNull() | (measured / full < SMALL)))


def covered(box: Column, evidence: Column) -> Column:
    """Some box of the evidence shares half of it along both axes."""
    sound = (g.size(box, "x") > 0) & (g.size(box, "y") > 0)
    return F.coalesce(sound & F.exists(evidence, lambda e: (g.axis_coverage(box, e, "x") >= COVER) & (g.axis_coverage(box, e, "y") >= COVER)), F.lit(False))


def straddles(box: Column, crop_box: Column, words: Column, tolerance: float = EDGE) -> Column:
    """A reading at a crop's edge of a word that crosses it."""

    def at(edge: Column) -> Column:
        return F.exists(words, lambda w: (g.overlap(w, box, "x") > 0) & (w["y0"] < edge - tolerance) & (w["y1"] > edge + tolerance))

    top, bottom = crop_box["y0"], crop_box["y1"]
    return ((box["y0"] <= top + tolerance) & at(top)) | ((box["y1"] >= bottom - tolerance) & at(bottom))


def evidence_boxes(boxes: Column) -> Column:
    """Of a word's character boxes, those that are small and stand above its line: boxes is an array of boxes."""
    heights = F.transform(boxes, lambda b: g.size(b, "y"))

    def of(full: Column) -> Column:
        bottoms = F.array_sort(F.transform(F.filter(boxes, lambda b: g.size(b, "y") >= full * FULL), lambda b: b["y1"].cast("double")))
        n = F.size(bottoms)
        middle = (F.get(bottoms, F.floor((n - 1) / 2).cast("int")) + F.get(bottoms, F.floor(n / 2).cast("int"))) / 2
        return F.filter(boxes, lambda b: (g.size(b, "y") <= full * SMALL_BOX) & (b["y1"] <= middle - full * RAISED))

    none = F.filter(boxes, lambda _: F.lit(False))
    return F.when((F.size(boxes) >= 2) & (F.array_max(heights) > 0), t.let(F.array_max(heights), of)).otherwise(none)
