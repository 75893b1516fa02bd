"""Documents built of blocks: character counts, contents, headings to jump to, caches, upserts and cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import hashes
from quire.functions import text as t


def summary(blocks: DataFrame) -> DataFrame:
    """One row a document: blocks by kind, characters without white space, language by the first blocks' text."""
    kinds = [F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("heading", "paragraph", "quote")]
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), *kinds, F.sum(t.count_chars(F.col("content"))).cast("long").alias("n_chars"))


def contents(blocks: DataFrame) -> DataFrame:
    """The table of contents: headings with text, level 1 to 6, 1 if not known."""
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)))) if "level" in blocks.columns else F.lit(1)
    title = t.trim(F.col("content"))
    return blocks.filter((F.col("type") == "heading") & (title != "")).select("doc_id", "block_idx", "block_id", title.alias("title"), level.alias("level"))


def heading_anchors(blocks: DataFrame) -> DataFrame:
    """The distinct keys that links into a document can have, each with its first block."""
    keyed = contents(blocks).withColumn("anchor", t.normalize_anchor(F.col("title")))
    return keyed.groupBy("doc_id", "anchor").agg(F.min("block_idx").alias("block_idx"))


def jump_targets(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """links (doc_id, link): the index of the first heading that each reaches, -1 for none; an empty key reaches none."""
    key = t.normalize_anchor(F.col("link"))
    to = heading_anchors(blocks).withColumnsRenamed({"doc_id": "_d", "anchor": "_a"})
    met = links.withColumn("_k", key).join(to, (F.col("doc_id") == F.col("_d")) & (F.col("_k") == F.col("_a")) & (F.col("_k") != ""), "left")
    return met.select(*links.columns, F.coalesce("block_idx", F.lit(-1)).alias("block_idx"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key by `order`; on equal order the new one."""
    cols = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(cols).withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(order, "_new")).alias("row"))
    return best.select("row.*")


def cascade(doc_ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without the rows of those documents."""
    return {k: v.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti") for k, v in tables.items()}


def cache_key(text: Column, lang: Column) -> Column:
    return F.concat_ws(":", F.lit("v2"), hashes.fnv64(text), lang)


def cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (…, text, lang) with the cached translation: the hash finds the row, the text must be the same."""
    key = cache_key(F.col("text"), F.col("lang"))
    c = cache.select(F.col("id").alias("_id"), F.col("source_text").alias("_s"), F.col("translated").alias("translated"))
    met = wanted.withColumn("_k", key).join(c, (F.col("_k") == F.col("_id")) & (F.col("text") == F.col("_s")), "left")
    return met.select(*wanted.columns, "translated")


def needs_translation(kind: Column, content: Column, translations: Column, lang: Column) -> Column:
    return ~kind.isin("code", "image") & ~F.coalesce(F.map_contains_key(translations, lang), F.lit(False)) & (F.length(t.trim(content)) >= 2)


def with_translation(translations: Column, lang: Column, text: Column) -> Column:
    return F.map_concat(F.map_filter(translations, lambda k, _: k != lang), F.create_map(lang, text))


def footnote_numbers(marks: DataFrame) -> DataFrame:
    """marks (doc_id, pos, kind, name), kind reference or definition: the number of each name, references first."""
    first = marks.groupBy("doc_id", "name").agg(F.min(F.struct((F.col("kind") != "reference").cast("int").alias("d"), "pos")).alias("f"))
    return first.select("doc_id", "name", F.row_number().over(Window.partitionBy("doc_id").orderBy("f")).alias("number"))


def merge_adjacent(parts: Column, most: int = 400) -> Column:
    """Neighbouring paragraphs become one while the first does not end a sentence and both stay within `most`.
    parts: an ordered array of struct<type, content>."""

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["type"].alias("type"), F.concat_ws(" ", last["content"], b["content"]).alias("content"))
        ok = (F.size(acc) > 0) & (last["type"] == "paragraph") & (b["type"] == "paragraph") & ~last["content"].rlike(f"[{t.SENTENCE_ENDS}]\\z") & (F.length(last["content"]) + F.length(b["content"]) <= most)
        return F.when(ok, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)


def search_annotations(annotations: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """By kind, and by text in the note, the selection or a tag, without case."""
    q = query.lower()
    has = F.lower(F.coalesce("content", F.lit(""))).contains(q) | F.lower(F.coalesce("selected_text", F.lit(""))).contains(q) | F.exists("tags", lambda x: F.lower(x).contains(q))
    return annotations.filter(has & (F.lit(True) if kind is None else F.col("type") == kind))


def exported(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown, json): the notes of each document in order of creation; a note without selection quotes its block."""
    quote = F.coalesce(F.nullif(F.col("selected_text"), F.lit("")), F.substr("block_text", F.lit(1), F.lit(200)))
    b = blocks.select("block_id", F.col("content").alias("block_text"))
    rows = annotations.join(b, "block_id", "left").withColumn("quote", quote)
    line = F.concat(F.lit("> "), F.coalesce("quote", F.lit("")), F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("content"))).otherwise(""))
    item = F.struct("created_at", "id", line.alias("line"), F.to_json(F.struct("id", "block_id", "type", "quote", "content", "tags", "created_at")).alias("json"))
    got = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return got.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("markdown"), F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["json"]), ","), F.lit("]")).alias("json"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
