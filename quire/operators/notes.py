"""Notes and where they stand: resolution in their block, repair in other blocks of the document, locators for old anchors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import anchors

#: How many other blocks of a document are looked at; how far a place must have moved that only its tail tells,
#: how near two such places are alike, and over how many characters; what each outcome says.
OTHER_BLOCKS, LEAST_MOVE, MARGIN, VERIFY = 50, 8, 2, 4
MESSAGES = {
    "exact": "found where it was",
    "repaired": "found elsewhere in its block",
    "moved": "found in another block",
    "block-missing": "its block is gone",
    "stale": "its text is gone",
    "no-anchor": "it says no place",
}


def message(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), code)


def valid_range(start: Column, end: Column, n: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= n)


def places_of(content: str, part: str) -> list[int]:
    """All places of a text, overlapping ones too."""
    out, at = [], content.find(part) if part else -1
    while at >= 0:
        out.append(at)
        at = content.find(part, at + 1)
    return out


def shift(content: str, prefix: str, tail: str, offset: int) -> int:
    """How far the place has moved where the old prefix runs into the tail: the least of all such moves, 0 if there is none."""
    moves = [p + len(prefix) - offset for p in places_of(content, prefix) if content.startswith(tail, p + len(prefix))]
    return min(moves, key=abs, default=0)


def candidates(content: str, prefix: str, tail: str, offset: int) -> dict[int, int]:
    """Start of each place that may be the note's, with its rank: 0 where prefix and tail meet as far away as they have moved,
    1 where the tail alone stands; the better rank of a place."""
    out = dict.fromkeys(places_of(content, tail), 1)
    at = offset + shift(content, prefix, tail, offset)
    if tail and prefix and at >= len(prefix) and content.startswith(prefix, at - len(prefix)) and content.startswith(tail, at):
        out[at] = 0
    return out


def pick(content: str, prefix: str, tail: str, offset: int) -> int | None:
    """The nearest place of rank 0; else the nearest of rank 1 that has moved enough, if no other that reads alike is as near."""
    found = candidates(content, prefix, tail, offset)
    near = lambda at: (abs(at - offset), at)
    strong = [at for at, rank in found.items() if rank == 0]
    if strong:
        return min(strong, key=near)
    weak = sorted((at for at, rank in found.items() if rank == 1 and abs(at - offset) >= LEAST_MOVE), key=near)
    if not weak:
        return None
    rivals = [at for at in weak[1:] if abs(abs(at - offset) - abs(weak[0] - offset)) <= MARGIN and content[at : at + VERIFY] == tail[:VERIFY]]
    return None if rivals else weak[0]


def relocated(content: Column, selected: Column, prefix: Column, offset: Column) -> Column:
    """struct<start, end, code>: where the text stands, exact or repaired; null if it is nowhere."""

    def one(c: str | None, s: str | None, p: str | None, o: int | None) -> dict | None:
        if not s or c is None or o is None:
            return None
        if c.startswith(s, int(o)):
            return {"start": int(o), "end": int(o) + len(s), "code": "exact"}
        tail = s[-anchors.CONTEXT :]
        at = pick(c, p or "", tail, int(o))
        return None if at is None else {"start": at, "end": at + len(tail), "code": "repaired"}

    def made(c: pd.Series, s: pd.Series, p: pd.Series, o: pd.Series) -> pd.DataFrame:
        none = {"start": None, "end": None, "code": None}
        got = pd.DataFrame([one(*x) or none for x in zip(c, s, p, o, strict=True)], columns=list(none))
        return got.astype({"start": "Int32", "end": "Int32"})

    got = F.pandas_udf(made, "start int, end int, code string")(content, selected, prefix, offset.cast("int"))
    return F.when(got["code"].isNotNull(), got)


def resolved(notes: DataFrame, blocks: DataFrame, elsewhere: bool = True) -> DataFrame:
    """notes (id, doc_id, block_id, anchor), blocks (doc_id, block_id, block_idx, content): the notes with code, block_idx,
    start and end.  A note that its own block loses is sought by its whole anchor in the first other blocks of its document,
    if `elsewhere`; the first block in order wins."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    b = blocks.select(F.col("doc_id").alias("_d"), F.col("block_id").alias("_b"), "block_idx", "content", F.row_number().over(order).alias("_rank"))
    own = notes.join(b, (F.col("doc_id") == F.col("_d")) & (F.col("block_id") == F.col("_b")), "left").withColumn("at", anchors.resolve_anchor(F.col("anchor"), F.col("content")))
    none = F.col("anchor").isNull() | (F.coalesce(F.col("anchor.selected"), F.lit("")) == "")
    there = F.col("at").isNotNull() & valid_range(F.col("at.start"), F.col("at.end"), F.length("content"))
    code = (
        F.when(none, "no-anchor").when(there & (F.col("at.start") == F.col("anchor.offset")), "exact")
        .when(there, "repaired").when(F.col("_b").isNull(), "block-missing").otherwise("stale")
    )
    first = own.withColumn("code", code)
    keep = [*notes.columns, "code", "block_idx", F.col("at.start").alias("start"), F.col("at.end").alias("end")]
    if not elsewhere:
        return first.select(*keep)
    lost = first.filter(F.col("code").isin("block-missing", "stale")).select(F.col("id").alias("_id"), F.col("doc_id").alias("_doc"), "anchor", F.col("_rank").alias("_own"))
    others = b.select("_d", F.col("block_idx").alias("_to"), F.col("content").alias("_there"), F.col("_rank").alias("_at"))
    near = (F.col("_at") - F.when(F.col("_own") < F.col("_at"), 1).otherwise(0)) <= OTHER_BLOCKS
    met = lost.join(others, (F.col("_doc") == F.col("_d")) & ~F.col("_at").eqNullSafe(F.col("_own")) & near)
    met = met.withColumn("_f", anchors.resolve_anchor(F.col("anchor"), F.col("_there"))).filter(F.col("_f").isNotNull() & valid_range(F.col("_f.start"), F.col("_f.end"), F.length("_there")))
    found = met.groupBy("_doc", "_id").agg(F.min_by(F.struct("_to", "_f.start", "_f.end"), "_at").alias("f"))
    out = first.join(found, (F.col("doc_id") == F.col("_doc")) & (F.col("id") == F.col("_id")), "left")
    moved = F.col("f").isNotNull()
    return out.select(
        *notes.columns,
        F.when(moved, "moved").otherwise(F.col("code")).alias("code"),
        F.when(moved, F.col("f._to")).otherwise(F.col("block_idx")).alias("block_idx"),
        F.when(moved, F.col("f.start")).otherwise(F.col("at.start")).alias("start"),
        F.when(moved, F.col("f.end")).otherwise(F.col("at.end")).alias("end"),
    )


def migrated(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The notes with a locator where their place is certain, and null where it is not; the anchor stays."""
    at = resolved(notes, blocks)
    sure = F.col("code").isin("exact", "repaired", "moved")
    locator = anchors.make_locator(F.col("doc_id"), F.lit(None).cast("long"), F.col("block_idx"), F.col("start"), F.col("end") - F.col("start"))
    return at.withColumn("locator", F.when(sure, locator))


def migration_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("doc_id").agg(F.count_if(F.col("locator").isNotNull()).alias("migrated"), F.count_if(F.col("locator").isNull()).alias("failed"))


def rebased(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """migrated notes with block, anchor and strategy as they are now; where the text is not the note's, nothing changes."""
    done = migrated(notes, blocks)
    b = blocks.select(F.col("doc_id").alias("_d"), F.col("block_idx").alias("_i"), F.col("block_id").alias("_b"), "content")
    met = done.join(b, (F.col("doc_id") == F.col("_d")) & (F.col("block_idx") == F.col("_i")), "left")
    right = F.col("locator").isNotNull() & (F.substr("content", F.col("start") + 1, F.length("anchor.selected")) == F.col("anchor.selected"))
    new = anchors.make_anchor(F.col("content"), F.col("start"), F.col("end"))
    strategy = F.when(F.col("block_id") != F.col("_b"), "rebased").otherwise(F.col("code"))
    changed = {"block_id": F.when(right, F.col("_b")).otherwise(F.col("block_id")), "anchor": F.when(right, new).otherwise(F.col("anchor"))}
    return met.select(
        *[changed.get(c, F.col(c)).alias(c) for c in notes.columns],
        F.when(right, F.col("locator")).alias("locator"), F.when(right, strategy).alias("strategy"), F.when(right, F.col("start") - F.col("anchor.offset")).alias("shifted"),
    )


def by_locator(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """notes (id, locator, selected; prefix, if they have one): the text at each locator, whether it is the note's, and where it
    has moved to within its block (start, end): exact, repaired, stale, block-missing or no-anchor."""
    p = notes.withColumn("p", anchors.parse_locator(F.col("locator")))
    b = blocks.select(F.col("doc_id").cast("string").alias("_d"), F.col("block_idx").cast("long").alias("_i"), "content")
    met = p.join(b, (F.col("p.doc") == F.col("_d")) & (F.col("p.block") == F.col("_i")), "left")
    text = F.substr("content", (F.col("p.offset") + 1).cast("int"), F.col("p.length").cast("int"))
    prefix = F.coalesce(F.col("prefix"), F.lit("")) if "prefix" in notes.columns else F.lit("")
    met = met.withColumn("_at", relocated(F.col("content"), F.col("selected"), prefix, F.col("p.offset")))
    code = F.when(F.col("p").isNull(), "no-anchor").when(F.col("_d").isNull(), "block-missing").otherwise(F.coalesce(F.col("_at.code"), F.lit("stale")))
    return met.select(*notes.columns, text.alias("text"), code.alias("code"), F.col("_at.start").alias("start"), F.col("_at.end").alias("end"))
