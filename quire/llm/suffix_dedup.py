"""Suffix-array dedup: repeated passages of `least` words or more, by a sparse suffix array.

Suffixes are retained at minimisers only: in every stretch of `least` words, the place whose first `seed` words hash least.
Equal stretches choose equal places, so no repeat is missed.  The retained suffixes of all texts are sorted by their first
`seed` words (a range partition, a word's order being that of its hash) and neighbours compared: a suffix that agrees with
neither neighbour lies in no repeat, and is dropped.  Suffixes that are alike in all that matters to them, from the first word
of the first stretch that chose them to the last word of the last, are one context from here on.

The contexts of a seed are sorted on, word by word, and extend both ways.  To the right: neighbours in that order are compared
over as many words as a stretch needs.  To the left: one word after another, the array is split by the word before, and in each
part neighbours in the same order are compared again, over one word less.  So each stretch meets the suffix that agrees with it
longest among those that agree to its left, which need not be its neighbour in the whole array; comparing with that neighbour
alone would lose repeats.  What no other suffix follows to the left goes no further.  Stretches found twice merge into spans.

A seed with more than `crowd` contexts is not held by one task: its contexts' stretches are dealt by the hash of their words,
which finds the same stretches.  Equal texts are one text throughout (their later copies are spans as a whole), so groups of
copies cost one member, and an occurrence of a context is only joined with what was found for the context.  Words, seeds and
stretches are told apart by 64-bit hashes.

Defined results: null texts, blank ones and those under `least` words have no span.  Rows that repeat an id
and its text are one document.  The first occurrence is that of the smallest doc_id (null before all), then place.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.llm.common import bounded_batches, list_array, partitions, strings, written
from quire.llm.words import NOT_SPACE, expand, hash_ranges, mix, pieces, raw, words

LEAST = 50
#: Bits for the number of stretches that choose a place, and for how far before it the first begins.
PACK = 12
BATCH_BYTES = 2 << 20
#: Contexts of one seed that a task holds; beyond it their stretches are dealt by their words.
CROWD = 4096


def anchors(hashes: np.ndarray, row: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each stretch of `least` words inside a row: its first word, the place it chooses, and that place's hash."""
    n = len(hashes)
    window = least - seed + 1
    if n < least:
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.arange(n - seed + 1)
    grams = hash_ranges(hashes, at, at + seed)
    value, place, span = grams, at, 1
    while span < window:  # leftmost least hash of [i, i + span)
        step = min(span, window - span)
        smaller = value[step:] < value[:-step]
        value, place = np.where(smaller, value[step:], value[:-step]), np.where(smaller, place[step:], place[:-step])
        span += step
    begin = np.arange(len(value))
    of = np.searchsorted(row, begin, "right") - 1
    inside = begin + least <= row[of + 1]
    return begin[inside], place[inside], grams[place[inside]]


def _retained(least: int, seed: int):
    """Rows (key, h, th, p): retained suffixes of each text.  h: the hash of the words of all stretches that chose it, the
    first beginning a words before its place m, and of a and their number nw; p: m, a and nw packed.  A task puts out equal
    texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            _, some = np.unique(batch.column(0).to_numpy(), return_index=True)
            new = [i for i in np.sort(some).tolist() if batch.column(0)[i].as_py() not in seen]
            batch = batch.take(pa.array(new, pa.int64()))
            th = batch.column(0).to_numpy()
            seen.update(th.tolist())
            data, offsets = raw(strings(batch, "t"))
            for lo, hi in pieces(offsets, BATCH_BYTES):
                w = words(data, offsets[lo : hi + 1], NOT_SPACE)
                begin, place, key = anchors(w.hashes, w.row, least, seed)
                if not len(place):
                    continue
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                nw = np.diff(np.append(first, len(place)))
                start, place, key = begin[first], place[first], key[first]
                a = place - start
                h = hash_ranges(w.hashes, start, start + nw - 1 + least) ^ mix((a << PACK | nw).astype(np.uint64))
                row = np.searchsorted(w.row, place, "right") - 1
                p = (place - w.row[row]) << (2 * PACK) | a << PACK | nw
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), pa.array(th[lo + row]), pa.array(p)], names=["key", "h", "th", "p"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes, those that agree with the one before or after, equal rows once; the first and last of a task count as
    agreeing."""
    held: pa.Table | None = None
    before: int | None = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        cols = [t.column(c).to_numpy() for c in ("key", "h", "th", "p")]
        other = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        if not other.all():
            t = t.filter(pa.array(other))
        key = t.column("key").to_numpy()
        same = np.zeros(len(key), bool)
        same[1:] |= key[1:] == key[:-1]
        same[:-1] |= key[1:] == key[:-1]
        if first:
            same[0], first = True, False
        elif before is not None and before == key[0]:
            same[0] = True
        yield from t.slice(0, len(key) - 1).filter(pa.array(same[:-1])).to_batches()
        held, before = t.slice(len(key) - 1), int(key[-2]) if len(key) > 1 else before
    if held is not None:
        yield from held.to_batches()


def _read_again(least: int, seed: int):
    """For texts with their contexts (own: m, a, nw, h, n, key, hot).  Rows (hot, key, h, th, id, m, lo, a, n, left, right, o, wh).
    Of a context that is not hot one row: left and right are the words before the suffix, backward, and those after its seed.
    Of a hot one a row a stretch: it begins at m, o before the suffix, and wh is the hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th, ids, lists = batch.column(0).to_numpy(), batch.column(1), batch.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values
            m, a, nw, h, n, key, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("m", "a", "nw", "h", "n", "key", "hot"))
            data, offsets = raw(strings(batch, "t"))
            for lo, hi in pieces(offsets, BATCH_BYTES):
                w = words(data, offsets[lo : hi + 1], NOT_SPACE)
                both, rows = expand(at[lo:hi], np.diff(at[lo : hi + 1]))
                none = np.zeros(0, np.int64)

                def made(own: np.ndarray, row: np.ndarray, begin: np.ndarray, o: np.ndarray, wh: np.ndarray, left: pa.Array, right: pa.Array, lo: int = lo) -> pa.RecordBatch:
                    ints = lambda x: pa.array(x.astype(np.int32))
                    return pa.RecordBatch.from_arrays(
                        [pa.array(hot[own].astype(bool)), pa.array(key[own]), pa.array(h[own]), pa.array(th[lo + row]), ids.take(pa.array(lo + row)), ints(begin), ints(a[own] - nw[own] + 1), ints(a[own]), pa.array(n[own]), left, right, ints(o), pa.array(wh.view(np.int64))],
                        names=["hot", "key", "h", "th", "id", "m", "lo", "a", "n", "left", "right", "o", "wh"],
                    )

                few, many = ~hot[both].astype(bool), hot[both].astype(bool)
                if few.any():
                    own, row = both[few], rows[few]
                    place, first = m[own] + w.row[row], a[own] - nw[own] + 1
                    before, i = expand(np.zeros(len(own), np.int64), a[own])
                    left = list_array(pa.array(w.hashes[place[i] - 1 - before].view(np.int64)), a[own])
                    after, i = expand(np.zeros(len(own), np.int64), least - seed - first)
                    right = list_array(pa.array(w.hashes[place[i] + seed + after].view(np.int64)), least - seed - first)
                    yield made(own, row, m[own], np.zeros(len(own)), np.zeros(len(own), np.uint64), left, right)
                if many.any():
                    begin, which = expand(m[both[many]] - a[both[many]], nw[both[many]])
                    own, row = both[many][which], rows[many][which]
                    start = begin + w.row[row]
                    empty = list_array(pa.array(none), np.zeros(len(own), np.int64))
                    yield made(own, row, begin, m[own] - begin, hash_ranges(w.hashes, start, start + least), empty, empty)

    return run


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of `width` numbers, zeros after what a list has."""
    at = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(at[0], at[-1]) - at[:-1][row]] = lists.values.to_numpy()[at[0] : at[-1]]
    return out


def extended(seed_of: np.ndarray, left: np.ndarray, right: np.ndarray, lo: np.ndarray, a: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The repeated stretches of contexts: (context, how far before the suffix it begins, whether the context has its first
    occurrence).  seed_of: equal for contexts of one seed; lo to a: how far before the suffix its stretches begin; n: how often
    the context occurs; rank: the order of first occurrences."""
    width = right.shape[1]
    array = np.lexsort((*right.T[::-1], seed_of))  # the suffix array: of each seed, by the words that follow
    part = seed_of[array]
    found: list[list[np.ndarray]] = [[], [], []]
    for o in range(width + 1):
        # parts agree on o words to the left; in each the order is that of the words to the right
        part = np.unique(part, return_inverse=True)[1]
        by_part = np.argsort(part, kind="stable")
        array, part = array[by_part], part[by_part]
        here = np.flatnonzero((lo[array] <= o) & (o <= a[array]))
        if len(here):
            row, own = array[here], part[here]
            same = (own[1:] == own[:-1]) & (right[row[1:], : width - o] == right[row[:-1], : width - o]).all(axis=1)
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            group = np.cumsum(np.concatenate([[0], ~same]))
            twice = np.add.reduceat(n[row], begin)[group] > 1
            first = np.minimum.reduceat(rank[row], begin)[group] == rank[row]
            for out, x in zip(found, (row, np.full(len(row), o), first), strict=True):
                out.append(x[twice])
        if o == width:
            break
        # one word further to the left: what is alone there and occurs once is in no longer repeat
        go = a[array] > o
        array, part = array[go], part[go]
        if not len(array):
            break
        pair = np.lexsort((left[array, o], part))
        word, own = left[array[pair], o], part[pair]
        new = np.cumsum(np.concatenate([[0], (word[1:] != word[:-1]) | (own[1:] != own[:-1])]))
        part = np.empty(len(array), np.int64)
        part[pair] = new
        go = np.bincount(new, n[array[pair]])[part] > 1
        array, part = array[go], part[go]
        if not len(array):
            break
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


CHUNK = 1 << 15


def _found(least: int, seed: int):
    """For rows of _read_again sorted by key: rows (h, th, id, m, flags), flags being the context's repeated stretches."""
    width = least - seed

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        # a context whose document comes twice is one row
        t = t.take(pa.array(np.sort(np.unique(t.column("h").to_numpy(), return_index=True)[1]))).combine_chunks()
        col = lambda c: t.column(c).chunk(0)
        order = pc.sort_indices(t, sort_keys=[("id", "ascending"), ("th", "ascending"), ("m", "ascending")], null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        seed_of = np.unique(col("key").to_numpy(), return_inverse=True)[1]
        row, o, first = extended(seed_of, _matrix(col("left"), width), _matrix(col("right"), width), *(col(c).to_numpy() for c in ("lo", "a", "n")), rank)
        by_row = np.argsort(row, kind="stable")
        row, o, first = row[by_row], o[by_row], first[by_row]
        count = np.bincount(row, minlength=t.num_rows)
        some = np.flatnonzero(count)
        flags = pa.StructArray.from_arrays([pa.array(o.astype(np.int32)), pa.array(first.astype(bool))], ["o", "own"])
        kept = t.select(["h", "th", "id", "m"]).take(pa.array(some)).append_column("flags", list_array(flags, count[some]))
        yield from kept.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0  # the last seed may go on
            if cut:
                yield from of(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield from of(pa.Table.from_batches(held))

    return run


def _flags(src: DataFrame, context: DataFrame, least: int, seed: int, crowd: int) -> DataFrame:
    """(h, th, id, m, flags) of contexts with repeated stretches, written; th, id and m are the context's first occurrence."""
    kind = src.schema["id"].dataType.simpleString()
    schema = f"h long, th long, id {kind}, m int, flags array<struct<o:int,own:boolean>>"
    many = context.groupBy("key").agg(F.count("*").alias("contexts"))
    context = written(context.join(many, "key"), "crowds")
    # a context alone in its seed is repeated as a whole, by itself
    alone = context.filter((F.col("contexts") == 1) & (F.col("n") > 1))
    whole = F.transform(F.sequence(F.col("a") - F.col("nw") + 1, F.col("a")), lambda o: F.struct(o.alias("o"), F.lit(True).alias("own")))
    alone = alone.select("h", "f.th", "f.id", "f.m", whole.alias("flags"))

    own = F.struct("f.m", "a", "nw", "h", "n", "key", (F.col("contexts") > crowd).alias("hot"))
    chosen = context.filter("contexts > 1").groupBy(F.col("f.th").alias("_t"), F.col("f.id").alias("_i")).agg(F.collect_list(own).alias("own"))
    # the same way at every size: neither side is bounded
    both = src.join(chosen.hint("merge"), (src["th"] == F.col("_t")) & src["id"].eqNullSafe(F.col("_i"))).select("th", "id", "t", "own")
    kinds = f"hot boolean, key long, h long, th long, id {kind}, m int, lo int, a int, n long, left array<long>, right array<long>, o int, wh long"
    met = written(both.mapInArrow(_read_again(least, seed), kinds), "contexts_read")
    few = met.filter("not hot").drop("hot", "o", "wh").repartition(partitions(src.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_found(least, seed), schema)
    stretches = met.filter("hot").select("h", "th", "id", F.col("m").alias("j"), "n", "o", "wh").distinct()
    place = F.struct("id", "th", "j")
    twice = written(stretches.groupBy("wh").agg(F.sum("n").alias("times"), F.min(place).alias("first")).filter("times > 1").drop("times"), "twice")
    each = stretches.join(twice, "wh")
    each = each.groupBy("h", "th", "id", (F.col("j") + F.col("o")).alias("m")).agg(F.collect_list(F.struct("o", (place == F.col("first")).alias("own"))).alias("flags"))
    out = alone.union(few).union(each.select("h", "th", "id", "m", "flags"))
    return written(out, "flags")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """One row for each document with a repeated passage: id, n_words, and two lists of spans of word places, ordered and
    apart: repeated (all that occurs elsewhere too) and later (without what occurs here first)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    seed = least // 2 + 1
    if least >= 1 << PACK:
        raise ValueError(f"least must be under {1 << PACK}")
    src = docs.select(F.xxhash64(text).alias("th"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = "key long, h long, th long, p long"
    all_ = written(src.select("th", "t").mapInArrow(_retained(least, seed), schema), "suffixes")
    order = ["key", "h", "th", "p"]
    ordered = all_.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    alike = ordered.mapInArrow(_neighbours, schema)
    bits = lambda n: F.col("p").bitwiseAND(F.lit((1 << PACK) - 1)) if not n else F.shiftright("p", n * PACK).bitwiseAND(F.lit((1 << PACK) - 1))
    copies = written(src.groupBy("th").agg(F.count("*").alias("copies"), F.min("id").alias("id")), "texts")
    alike = alike.select("key", "h", "th", F.shiftright("p", 2 * PACK).cast("int").alias("m"), bits(1).cast("int").alias("a"), bits(0).cast("int").alias("nw"))
    alike = written(alike.join(copies.drop("copies"), "th"), "alike")
    context = alike.groupBy("h").agg(F.min(F.struct("id", "th", "m")).alias("f"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("key", "a", "nw")])
    flags = _flags(src, written(context, "contexts"), least, seed, crowd)
    flags = flags.select("h", F.struct("id", "th", "m").alias("f"), "flags")
    each = alike.drop("key", "a", "nw").join(flags, "h")
    here = F.struct("id", "th", "m").eqNullSafe(F.col("f"))
    found = F.transform("flags", lambda x: F.struct((F.col("m") - x["o"]).alias("j"), (~(x["own"] & here)).alias("later")))
    each = each.select("th", F.sort_array(found).alias("s"))
    runs = each.select("th", _runs(F.transform("s", lambda x: x["j"]), least).alias("all"), _runs(F.transform(F.filter("s", lambda x: x["later"]), lambda x: x["j"]), least).alias("later"))
    spans = runs.groupBy("th").agg(*[_merged(F.sort_array(F.flatten(F.collect_list(c)))).alias(c) for c in ("all", "later")])
    texts = src.select("th", "id", F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words"))
    both = texts.join(copies.withColumnRenamed("id", "first"), "th").join(spans, "th", "left").filter(F.col("all").isNotNull() | ((F.col("copies") > 1) & (F.col("n_words") >= least)))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n_words").alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= least)
    return both.select(
        F.col("id").alias(doc_id),
        "n_words",
        F.when(copied, whole).otherwise(F.col("all")).alias("repeated"),
        F.when(copied & ~F.col("id").eqNullSafe(F.col("first")), whole).otherwise(F.coalesce("later", none)).alias("later"),
    ).distinct()


def _runs(j: Column, least: int) -> Column:
    """Spans covered by stretches that begin at the ordered places j."""

    def of(j: Column) -> Column:
        first = F.filter(j, lambda x, i: (i == 0) | (F.get(j, i - 1) < x - least))
        last = F.filter(j, lambda x, i: (i == F.size(j) - 1) | (F.get(j, i + 1) > x + least))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), (b + least).alias("b")))

    return let(j, of)  # else the list would be made anew for each of its elements


def _merged(spans: Column) -> Column:
    """Ordered spans whose ends are ordered too, merged where they meet."""

    def of(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["b"] < x["a"]))
        last = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["a"] > x["b"]))
        return F.zip_with(first, last, lambda a, b: F.struct(a["a"].alias("a"), b["b"].alias("b")))

    return let(spans, of)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of those places, and without the white space before them."""
    import re

    at = [(m.start(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", text)]
    keep, last = [], 0
    for a, b in spans:
        keep.append(text[last : at[a - 1][1] if a else 0])
        last = at[b - 1][1]
    return "".join([*keep, text[last:]])
