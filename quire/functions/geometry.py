"""Boxes {x0, y0, x1, y1} and distances between them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pads of a region (least, most, share), and of a second reading's band.
PAD_X, PAD_Y, BAND = (10, 36, 0.05), (16, 60, 0.35), (16, 0.08)


def overlap(a: Column, b: Column, axis: str) -> Column:
    """Length of the common part along an axis, at least 0."""
    return F.greatest(F.least(a[f"{axis}1"], b[f"{axis}1"]) - F.greatest(a[f"{axis}0"], b[f"{axis}0"]), F.lit(0.0))


def size(a: Column, axis: str) -> Column:
    return a[f"{axis}1"] - a[f"{axis}0"]


def area(a: Column) -> Column:
    return size(a, "x") * size(a, "y")


def common_area(a: Column, b: Column) -> Column:
    return overlap(a, b, "x") * overlap(a, b, "y")


def _ratio(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    c = common_area(a, b)
    return F.when(c > 0, _ratio(c, area(a) + area(b) - c)).otherwise(0.0)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return _ratio(common_area(a, b), F.least(area(a), area(b)))


def containment(word: Column, region: Column) -> Column:
    return _ratio(common_area(word, region), area(word))


def centre_inside(word: Column, region: Column) -> Column:
    """1 if the word's centre lies in the region, else 0; a word without area never does."""
    cx, cy = (word["x0"] + word["x1"]) / 2, (word["y0"] + word["y1"]) / 2
    inside = cx.between(region["x0"], region["x1"]) & cy.between(region["y0"], region["y1"])
    return ((size(word, "x") > 0) & (size(word, "y") > 0) & inside).cast("int")


def axis_coverage(a: Column, b: Column, axis: str) -> Column:
    return _ratio(overlap(a, b, axis), F.least(size(a, axis), size(b, axis)))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def padded(region: Column) -> Column:
    pad = lambda axis, p: F.least(F.lit(p[1]), F.greatest(F.lit(p[0]), size(region, axis) * p[2]))
    x, y = pad("x", PAD_X), pad("y", PAD_Y)
    return box(region["x0"] - x, region["y0"] - y, region["x1"] + x, region["y1"] + y)


def second_band(band: Column, width: Column) -> Column:
    """A band widened at both sides, within the page."""
    pad = F.greatest(F.lit(BAND[0]), size(band, "x") * BAND[1])
    return box(F.greatest(F.lit(0.0), band["x0"] - pad), band["y0"], F.least(width, band["x1"] + pad), band["y1"])


def gap(a: Column, b: Column, axis: str = "y") -> Column:
    """Distance along an axis, 0 if they overlap."""
    return F.greatest(F.greatest(a[f"{axis}0"], b[f"{axis}0"]) - F.least(a[f"{axis}1"], b[f"{axis}1"]), F.lit(0.0))


def same_line(a: Column, b: Column) -> Column:
    """They share half the height of the lower one, or more."""
    return axis_coverage(a, b, "y") >= 0.5


def clipped(word: Column, to: Column) -> Column:
    """The word within a box; a word outside it stays as it is."""
    inside = (overlap(word, to, "x") > 0) & (overlap(word, to, "y") > 0)
    cut = box(F.greatest(word["x0"], to["x0"]), F.greatest(word["y0"], to["y0"]), F.least(word["x1"], to["x1"]), F.least(word["y1"], to["y1"]))
    return F.when(inside, cut).otherwise(word)


def garbage(confidence: Column, font: Column, main: Column) -> Column:
    """A word read so badly, or badly and so large, that it hides something else."""
    finite = confidence.isNotNull() & ~F.isnan(confidence)
    return finite & ((confidence < 50) | ((confidence < 80) & (main > 0) & (font > main * 1.5)))


def render_scale(width: Column, height: Column, dpi: int = 200, most: int = 20_000_000) -> Column:
    """Pixels a point, so that a page keeps within `most` pixels."""
    scale = F.lit(dpi / 72)
    pixels = width * height * scale * scale
    return F.when(pixels > most, scale * F.sqrt(most / pixels)).otherwise(scale)


def page_limit(asked: Column, total: Column) -> Column:
    bad = asked.isNull() | F.isnan(asked) | (asked < 1)
    return F.when(total <= 0, 0).when(bad, total).otherwise(F.least(F.floor(asked), total)).cast("int")
