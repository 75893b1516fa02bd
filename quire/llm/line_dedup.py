"""Line dedup: windows of three consecutive lines, hashed; the later occurrences of a repeated window are removed.

Lines are what newlines part, without spaces, tabs and carriage returns at their ends; blank ones do not count, and stay.
Window k of a text is its non-blank lines k, k+1, k+2.  Of equal windows the first by (doc_id, k) stays, with a null
doc_id before all others; every line that lies in any later one goes.  Fewer than three lines make no window.  Rows that
repeat a doc_id and its text are one document and fare alike.  Null texts stay null.  Empty tables give empty results.

Windows are counted with partial sums, then met with the scan by a join that adaptive execution can split, so one window
may stand in any share of the documents.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh, with_columns, written

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, th, covered): for each document that loses lines, the 0-based non-blank lines that go, in order."""
    src = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), _lines(F.col(text)).alias("l")).filter(F.size("l") >= width)
    joined = lambda k: F.array_join(F.slice(F.col("l"), k + 1, width), "\n")
    each = F.transform(F.sequence(F.lit(0), F.size("l") - width), lambda k: F.struct(k.alias("k"), F.xxhash64(joined(k)).alias("h1"), F.xxhash64(F.lit(1), joined(k)).alias("h2")))
    windows = written(src.select("id", "th", F.explode(each).alias("w")).select("id", "th", "w.k", "w.h1", "w.h2"), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "k")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).filter(~F.struct("id", "k").eqNullSafe(F.col("first")))
    lines = F.flatten(F.transform(F.collect_set("k"), lambda k: F.sequence(k, k + (width - 1))))
    return later.groupBy("id", "th").agg(F.sort_array(F.array_distinct(lines)).alias("covered"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, str, str]:
    """docs with the text as it stays and the lines that went (an empty list where none did); and the two columns' names."""
    kept, gone = fresh(docs.columns, "kept_text"), fresh(docs.columns, "gone_lines")
    found = covered(docs, doc_id, text, width)
    both = docs.join(found, docs[doc_id].eqNullSafe(found["id"]) & (F.xxhash64(docs[text]) == found["th"]), "left")
    joined = both.select(*[docs[c] for c in docs.columns], found["covered"].alias(gone))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, gones = (batch.column(batch.schema.get_field_index(c)) for c in (text, gone))
        plain = pc.is_null(gones)
        if pc.all(plain).as_py():
            return [texts]
        return [pa.array([t.as_py() if n.as_py() else without_lines(t.as_py(), g.as_py()) for t, g, n in zip(texts, gones, plain, strict=True)], pa.string())]

    out = with_columns(joined, run, [T.StructField(kept, T.StringType())])
    return out.withColumn(gone, F.coalesce(gone, F.array().cast("array<int>"))), kept, gone


def without_lines(text: str, gone: list[int]) -> str:
    """The text without those of its non-blank lines."""
    out, k, gone = [], -1, set(gone)
    for line in text.split("\n"):
        k += bool(line.strip(" \t\r"))
        if k not in gone or not line.strip(" \t\r"):
            out.append(line)
    return "\n".join(out)


def spans(lines: Column) -> Column:
    """start:end of each maximal run of an ordered list, comma-joined."""
    first = F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, i - 1) != x - 1))
    last = F.filter(lines, lambda x, i: (i == F.size(lines) - 1) | (F.get(lines, i + 1) != x + 1))
    return F.array_join(F.zip_with(first, last, lambda a, b: F.concat_ws(":", a.cast("string"), (b + 1).cast("string"))), ",")
