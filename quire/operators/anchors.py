"""Places in a text that notes are tied to: anchors by context, locators, styled segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t

#: Characters of context at each side, and how far before its old place a text is looked for first.
CONTEXT, BACK = 15, 40


def make_anchor(s: Column, start: Column, end: Column) -> Column:
    cut = lambda a, b: F.substr(s, a + 1, F.greatest(b - a, F.lit(0)))
    return F.struct(
        cut(F.greatest(F.lit(0), start - CONTEXT), start).alias("prefix"),
        cut(end, F.least(F.length(s), end + CONTEXT)).alias("suffix"),
        start.alias("offset"),
        (end - start).alias("length"),
        cut(start, end).alias("selected"),
    )


def resolve_anchor(anchor: Column, s: Column) -> Column:
    """struct<start, end> or null: at the old place, near it, anywhere, or between its context's ends."""
    text, offset = anchor["selected"], anchor["offset"]
    place = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    hit = lambda a: place(a, a + F.length(text))

    def squeezed(begin: Column) -> Column:
        between = t.let(t.find(s, anchor["suffix"], begin), lambda after: F.when(after > begin, place(begin, after)))
        return F.when(anchor["suffix"] != "", between).otherwise(place(begin, F.least(F.length(s), begin + F.length(text))))

    by_context = t.let(t.find(s, anchor["prefix"]), lambda before: F.when((anchor["prefix"] != "") & (before >= 0), t.let(before + F.length(anchor["prefix"]), squeezed)))
    anywhere = t.let(t.find(s, text), lambda at: F.when(at >= 0, hit(at)))
    near = t.let(t.find(s, text, F.greatest(F.lit(0), offset - BACK)), lambda at: F.when(at >= 0, hit(at)))
    at_old = F.when(F.substr(s, offset + 1, F.length(text)) == text, hit(offset))
    return F.when(text != "", F.coalesce(at_old, near, anywhere, by_context))


def make_locator(doc_id: Column, page: Column, block: Column, offset: Column, length: Column) -> Column:
    """doc:…[/page:n]/block:i/char:o+l; what is not known is -1 for the block, 0 for places, and no page."""
    whole = lambda x, least: F.coalesce(F.greatest(F.lit(least), x.cast("long")), F.lit(max(least, 0))).cast("string")
    page_part = F.when(page.isNull(), "").otherwise(F.concat(F.lit("/page:"), page.cast("long").cast("string")))
    block_part = F.coalesce(block.cast("long"), F.lit(-1)).cast("string")
    return F.concat(F.lit("doc:"), doc_id.cast("string"), page_part, F.lit("/block:"), block_part, F.lit("/char:"), whole(offset, 0), F.lit("+"), whole(length, 0))


def parse_locator(s: Column) -> Column:
    """struct<doc, page, block, offset, length>, or null where any part is not as it should be."""
    part = lambda name: F.regexp_extract(s, f"(?:^|/){name}:([^/]*)", 1)
    has = lambda name: s.rlike(f"(?:^|/){name}:")
    char = part("char")
    one, two = F.regexp_extract(char, r"^(\d+)", 1).cast("long"), F.regexp_extract(char, r"[+-](\d+)\z", 1)
    two = F.when(two != "", two.cast("long"))
    length = F.when(char.contains("+"), two).when(char.contains("-"), F.greatest(F.lit(0), two - one)).otherwise(F.lit(0))
    ok = s.startswith("doc:") & (part("doc") != "") & part("block").rlike(r"^\d+\z") & (~has("page") | part("page").rlike(r"^\d+\z")) & char.rlike(r"^\d+([+-]\d+)?\z")
    made = F.struct(
        part("doc").alias("doc"),
        F.when(has("page"), part("page").cast("long")).alias("page"),
        part("block").cast("long").alias("block"),
        one.alias("offset"),
        length.cast("long").alias("length"),
    )
    return F.when(ok, made)


def segments(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """texts (block_id, n), ranges (block_id, id, start, end): the stretches between all ends, each with the ids of the
    ranges that cover it, in order; neighbours with the same ids are one."""
    r = ranges.join(texts, "block_id").select("block_id", "id", F.greatest(F.lit(0), F.least("start", "n")).alias("start"), F.greatest(F.lit(0), F.least("end", "n")).alias("end")).filter("end > start")
    ends = texts.select("block_id", F.explode(F.array(F.lit(0).cast("int"), F.col("n").cast("int"))).alias("p"))
    ends = ends.union(r.select("block_id", F.explode(F.array(F.col("start").cast("int"), F.col("end").cast("int"))).alias("p"))).distinct()
    by_place = Window.partitionBy("block_id").orderBy("p")
    cut = ends.select("block_id", F.col("p").alias("s"), F.lead("p").over(by_place).alias("e")).filter("e > s")
    covered = cut.join(r.withColumnRenamed("block_id", "_b"), (F.col("block_id") == F.col("_b")) & (F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e")), "left")
    listed = covered.groupBy("block_id", "s", "e").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    order = Window.partitionBy("block_id").orderBy("s")
    new = listed.withColumn("new", (~F.col("ids").eqNullSafe(F.lag("ids").over(order))).cast("int"))
    isle = new.withColumn("isle", F.sum("new").over(order))
    return isle.groupBy("block_id", "isle").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.first("ids").alias("ids")).drop("isle")


def sliced(segs: DataFrame, start: int, end: int) -> DataFrame:
    """The part of each segment within [start, end)."""
    cut = segs.withColumn("start", F.greatest("start", F.lit(start))).withColumn("end", F.least("end", F.lit(end)))
    return cut.filter("end > start")
