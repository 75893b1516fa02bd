"""Stored tables of documents, blocks, notes, progress and cached translations: what is read, listed and cleared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t


def loaded(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """documents with their blocks, in order; a document without blocks is not there."""
    each = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", *[c for c in blocks.columns if c not in ("doc_id", "block_idx")]))).alias("blocks"))
    return documents.join(each, "doc_id")


def newest(documents: DataFrame, created: str = "created") -> DataFrame:
    return documents.orderBy(F.desc(created))


def notes_of(notes: DataFrame, doc_id: object | None = None) -> DataFrame:
    """The notes of a document in order of creation; all notes, as they come, if none is named."""
    return notes if doc_id is None else notes.filter(F.col("doc_id") == F.lit(doc_id)).orderBy("created_at")


def without_note(notes: DataFrame, note_id: object) -> DataFrame:
    return notes.filter(~F.col("id").eqNullSafe(F.lit(note_id)))


def progress_of(progress: DataFrame, doc_id: object) -> DataFrame:
    """One row, or none."""
    return progress.filter(F.col("doc_id") == F.lit(doc_id))


def cleared(table: DataFrame) -> DataFrame:
    return table.limit(0)


def noted(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """The blocks that have a note."""
    return blocks.join(notes.select("block_id").distinct(), "block_id", "left_semi")


def block_index(ids: Column, block_id: Column) -> Column:
    """The place of a block in its document's list, -1 if it is not there."""
    return (F.array_position(ids, block_id) - 1).cast("int")


def page_of(page_number: Column) -> Column:
    """A positive finite page, or null."""
    x = page_number.cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), page_number)


def in_view(blocks: DataFrame, start: int, end: int, lang: str) -> DataFrame:
    """The blocks within [start, end) that still need a translation."""
    from quire.operators.documents import needs_translation

    rows = blocks.filter((F.col("block_idx") >= start) & (F.col("block_idx") < end))
    return rows.filter(needs_translation(F.col("type"), F.col("content"), F.col("translations"), F.lit(lang)))


def item_id(*parts: Column, prefix: str = "") -> Column:
    """A stable id of what names an item: the same parts give the same id on every run."""
    made = F.substr(F.sha2(F.to_json(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)])), 256), F.lit(1), F.lit(32))
    return F.concat(F.lit(prefix + "-"), made) if prefix else made


def source_language(detected: Column, text: Column, target: Column) -> Column:
    """The detector's language, else that of the characters; null if it is the target's."""
    own = F.coalesce(F.nullif(t.primary_tag(detected), F.lit("")), t.primary_tag(t.detect_language(text)))
    return F.nullif(own, t.primary_tag(target))
