"""Files of any known format to blocks, one outcome a file: a damaged or empty file is a row with an error, and stops nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.sources import epub, markdown, plain

COLUMNS = "name string, format string, title string, block_idx int, type string, content string, level int, error string"
NOTHING = "no readable text"


def _row(df: DataFrame, **more: Column) -> DataFrame:
    cols = []
    for c in COLUMNS.split(", "):
        name, kind = c.split()
        x = more.get(name, F.col(name) if name in df.columns else F.lit(None))
        cols.append(x.cast(kind).alias(name))
    return df.select(*cols)


def read(files: DataFrame) -> DataFrame:
    """files (name, content): blocks of plain text, Markdown and EPUB; errors for the rest."""
    src = files.select("name", "content", plain.file_format(F.col("name")).alias("format"))
    texts = src.filter(F.col("format").isin("plaintext", "markdown")).withColumn("d", plain.decoded(F.col("content")))
    texts = texts.select("name", "format", F.col("d.text").alias("text"), t.title_from_file(F.col("name")).alias("title"))
    able = texts.filter(t.has_readable(F.col("text")))
    flat = plain.blocks(able.filter("format = 'plaintext'"), "name").withColumnRenamed("doc_id", "name")
    titled = flat.withColumn("title", t.title_from_file(F.col("name")))
    marked = markdown.blocks(able.filter("format = 'markdown'"), "name").withColumnRenamed("doc_id", "name")
    books = epub.books(src.filter("format = 'epub'"))
    parts = [
        _row(titled, format=F.lit("plaintext")),
        _row(marked, format=F.lit("markdown"), title=F.coalesce("title", t.title_from_file(F.col("name")))),
        _row(books, format=F.lit("epub")),
        _row(texts.filter(~t.has_readable(F.col("text"))), error=F.lit(NOTHING)),
        _row(src.filter(F.col("format").isNull()), error=F.concat(F.lit("no reader for "), t.extension(F.col("name")))),
        _row(src.filter("format = 'pdf'"), error=F.lit("needs its text items: see quire.operators.pages")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def open_failure(message: Column) -> Column:
    """A class for the message of a file that did not open: the first that fits."""
    m = F.lower(message)
    return (
        F.when(m.rlike(r"tohex|frombase64|tobase64|fromhex"), "old_engine")
        .when(m.contains("withresolvers"), "old_engine")
        .when(m.rlike("workersrc|fake worker|setting up"), "worker")
        .when(m.rlike("password|encrypted"), "password")
        .otherwise("other")
    )


def selected_pages(spec: Column, total: Column) -> Column:
    """Page numbers of a list such as `3, 7-5`: distinct, ascending, within 1 to total; a blank list is all of them; null if
    a part can't be read or nothing is left."""
    all_ = F.sequence(F.lit(1), total)
    parts = F.transform(F.filter(F.split(spec, ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p))
    bad = F.exists(parts, lambda p: ~p.rlike(r"^\d+(\s*-\s*\d+)?\z"))

    def numbers(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.regexp_extract(p, r"(\d+)\z", 1).cast("int")
        lo, hi = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), total)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    got = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))
    return F.when(F.size(parts) == 0, all_).when(~bad & (F.size(got) > 0), got)


def aligned_classes(lines: Column, classes: int) -> Column:
    """A dictionary as classes: trailing blank lines go, class 0 is blank, and the list is padded or cut to its size."""
    kept = F.aggregate(F.reverse(lines), F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) == 0) & (x == ""), acc).otherwise(F.concat(acc, F.array(x))), F.reverse)
    full = F.concat(F.array(F.lit("")), kept, F.array_repeat(F.lit(""), classes))
    return F.slice(full, 1, classes)


def hocr_boxes(source: Column) -> Column:
    """array<struct<x0, y0, x1, y1>>: the character boxes of an hOCR page; boxes without area are left out."""
    found = F.regexp_extract_all(source, F.lit(r"x_bboxes\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)"), F.lit(0))
    boxes = F.transform(found, lambda m: F.transform(F.slice(F.split(m, r"\s+"), 2, 4), lambda x: x.cast("int")))
    named = F.transform(boxes, lambda b: F.struct(b[0].alias("x0"), b[1].alias("y0"), b[2].alias("x1"), b[3].alias("y1")))
    return F.filter(named, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))


def export_gate(source: Column, schema: str, version: int, old_kind: str | None = None) -> Column:
    """struct<state, reason> of an exported structure: both its schema and its version must fit; an old kind is read with less."""
    v = F.try_parse_json(source)
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    name, number, kind = at("$.schema", "string"), at("$.schemaVersion", "double"), at("$.kind", "string")
    object_ = F.schema_of_variant(v).startswith("OBJECT")
    reason = (
        F.when(v.isNull(), "not_json").when(~object_, "not_an_object").when((name == schema) & (number == version), None)
        .when(name.isNull() & (kind == (old_kind or "")), None).when(name.isNull(), "no_schema").when(name != schema, "other_schema").otherwise("other_version")
    )
    state = F.when(reason.isNotNull(), "rejected").when(name == schema, "current").otherwise("downgraded")
    return F.struct(state.alias("state"), reason.alias("reason"))
