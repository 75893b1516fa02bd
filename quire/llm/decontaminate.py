"""Benchmark decontamination by an FM-index of each training shard.

A shard is a few MB of documents within one task.  Its text is the sequence of its words; words that no benchmark phrase
has are a break, and stretches shorter than the shortest phrase are left out, for no phrase can lie in them.  Each phrase
is searched backward through wavelet-tree ranks, its occurrences are located by sampled suffix positions, and the spans
merge into the words to remove.  No row is shuffled.  The benchmark is a query set: it is brought to the shards in blocks
of bounded size, and one pass over the documents is made for each block.

Defined results: a null or empty text has no words, no hits and is not contaminated.  An item without words has no window.
Repeated documents each get their own row.  Items that share an id count as one item with the windows of both; a null
item id is left out of the list of items, though its windows hit.  Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh, list_array, strings, with_columns
from quire.llm.fm_index import FMIndex
from quire.llm.words import ALNUM, expand, pieces, raw, run_lengths, words

WINDOW = 13
#: Bytes of benchmark text in one block, and of documents in one index.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("hit_words", T.ArrayType(SPAN)),
    ]
)


class Phrases:
    """The windows of a block of items: distinct symbol sequences, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.names = sorted({i for i, _ in items if i is not None})
        of = {x: k for k, x in enumerate(self.names)}
        texts = pa.array([t for _, t in items], pa.large_string())
        w = words(*raw(texts), ALNUM)
        self.vocabulary = np.unique(w.hashes)
        ids = np.searchsorted(self.vocabulary, w.hashes) + 1
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (name, _) in enumerate(items):
            own = ids[w.row[k] : w.row[k + 1]].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).update([of[name]] if name is not None else [])
        self.groups = []  # for each length: the patterns, and their items as offsets and values
        for n in sorted({len(p) for p in found}):
            some = sorted(p for p in found if len(p) == n)
            owners = [sorted(found[p]) for p in some]
            self.groups.append((np.array(some, np.int64), np.array([len(o) for o in owners]), np.concatenate([np.array(o, np.int64) for o in owners])))
        self.shortest = min((len(p) for p in found), default=0)
        self.symbols = len(self.vocabulary) + 1


def shard_hits(phrases: Phrases, data: np.ndarray, offsets: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """Of the rows of one shard: hit flags of the words, (row, item) pairs, and the words."""
    w = words(data, offsets, ALNUM)
    n, rows = len(w.hashes), len(offsets) - 1
    nothing = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), w
    if not n or not phrases.shortest:
        return nothing
    at = np.minimum(np.searchsorted(phrases.vocabulary, w.hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == w.hashes
    row_of = np.repeat(np.arange(rows), np.diff(w.row))
    # runs of known words inside a row
    spaced = np.zeros(n + rows, bool)
    spaced[np.arange(n) + row_of] = known
    begin, end = run_lengths(spaced)
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return nothing
    size = end - begin
    back = np.full(n + rows, -1, np.int64)
    back[np.arange(n) + row_of] = np.arange(n)
    source, run = expand(back[begin], size)
    text, place = np.zeros(len(source) + len(begin), np.int64), np.zeros(len(source) + len(begin), np.int64)
    to = np.arange(len(source)) + run
    text[to], place[to] = at[source] + 1, source
    index = FMIndex(text, phrases.symbols, sample)
    edge = np.zeros(n + 1, np.int64)
    pair_row, pair_item = [], []
    for patterns, count, owners in phrases.groups:
        lo, hi = index.search(patterns)
        some = np.flatnonzero(hi > lo)
        for part in np.array_split(some, max(1, int((hi - lo)[some].sum()) >> 20)):
            rows_, who = expand(lo[part], (hi - lo)[part])
            where = place[index.locate(rows_)]
            edge += np.bincount(where, minlength=n + 1)
            edge -= np.bincount(where + patterns.shape[1], minlength=n + 1)
            pattern = part[who]
            first = np.cumsum(count) - count
            own, of = expand(first[pattern], count[pattern])
            pairs = np.unique(row_of[where[of]] * len(phrases.names) + owners[own]) if len(own) else np.zeros(0, np.int64)
            pair_row.append(pairs // max(1, len(phrases.names)))
            pair_item.append(pairs % max(1, len(phrases.names)))
    pairs = np.unique(np.concatenate(pair_row) * max(1, len(phrases.names)) + np.concatenate(pair_item)) if pair_row else np.zeros(0, np.int64)
    return np.cumsum(edge[:-1]) > 0, pairs // max(1, len(phrases.names)), pairs % max(1, len(phrases.names)), w


def _batch(phrases: Phrases, texts: pa.Array, sample: int, before: pa.Array | None) -> pa.Array:
    data, offsets = raw(texts)
    n_words, n_hit, item_count, span_count, items, spans, wspans = [], [], [], [], [], [], []
    for lo, hi in pieces(offsets, SHARD_BYTES):
        hit, pr, pi, w = shard_hits(phrases, data, offsets[lo : hi + 1], sample)
        rows = hi - lo
        row_of = np.repeat(np.arange(rows), np.diff(w.row))
        if before is not None:  # what earlier blocks have hit
            for r in range(rows):
                for s in before[lo + r]["hit_words"].as_py():
                    hit[w.row[r] + s["start"] : w.row[r] + s["end"]] = True
        spaced = np.zeros(len(hit) + rows, bool)
        spaced[np.arange(len(hit)) + row_of] = hit
        b, e = run_lengths(spaced)
        back = np.cumsum(np.bincount(np.arange(len(hit)) + row_of, minlength=len(hit) + rows)) - 1
        b, e = back[b], back[e - 1]
        r = row_of[b] if len(b) else np.zeros(0, np.int64)
        chars = np.zeros((len(b), 2), np.int64)
        for k in np.unique(r):
            here = r == k
            count = np.cumsum((data[offsets[lo + k] : offsets[lo + k + 1]] & 0xC0) != 0x80)
            own = np.concatenate([[0], count])
            chars[here, 0], chars[here, 1] = own[w.begin[b[here]] - offsets[lo + k]], own[w.end[e[here]] - offsets[lo + k]]
        n_words.append(np.diff(w.row))
        n_hit.append(np.bincount(row_of[hit], minlength=rows))
        span_count.append(np.bincount(r, minlength=rows))
        spans.append(chars)
        wspans.append(np.stack([b - w.row[r], e + 1 - w.row[r]], axis=1) if len(b) else np.zeros((0, 2), np.int64))
        if before is not None:
            own: list[set] = [set(before[lo + k]["items"].as_py()) for k in range(rows)]
            for k, i in zip(pr.tolist(), pi.tolist(), strict=True):
                own[k].add(phrases.names[i])
            item_count.append(np.array([len(x) for x in own]))
            items += [i for x in own for i in sorted(x)]
        else:
            item_count.append(np.bincount(pr, minlength=rows))
            items += [phrases.names[i] for i in pi.tolist()]
    cat = lambda x, shape=(0,): np.concatenate(x) if x else np.zeros(shape, np.int64)
    pair = lambda x: pa.StructArray.from_arrays([pa.array(x[:, 0], pa.int32()), pa.array(x[:, 1], pa.int32())], ["start", "end"])
    return pa.StructArray.from_arrays(
        [
            pa.array(cat(n_words), pa.int64()),
            pa.array(cat(n_hit), pa.int64()),
            list_array(pa.array(items, pa.string()), cat(item_count)),
            list_array(pair(cat(spans, (0, 2))), cat(span_count)),
            list_array(pair(cat(wspans, (0, 2))), cat(span_count)),
        ],
        [f.name for f in RESULT.fields],
    )


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    some = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.col("t") != "")
    total = some.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        own = some if blocks == 1 else some.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield [(r.i, r.t) for r in own.collect()]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "decontamination",
    window: int = WINDOW,
    sample: int = 16,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with a struct: n_words, n_hit, items (ids with a window in the text, as sorted strings), spans (code points to
    remove, merged) and hit_words (the same as word positions).  The struct is named `out`, which must be a new name."""
    if fresh(docs.columns, out) != out:
        raise ValueError(f"docs has a column {out}")
    got, k = docs, 0
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        phrases = Phrases(items, window)
        earlier = out if k else None
        new = fresh(got.columns, f"{out}_{k}")

        def run(batch: pa.RecordBatch, phrases=phrases, earlier=earlier) -> list[pa.Array]:
            before = batch.column(batch.schema.get_field_index(earlier)) if earlier else None
            return [_batch(phrases, strings(batch, text), sample, before)]

        got = with_columns(got, run, [T.StructField(new, RESULT)])
        got = got.drop(out).withColumnRenamed(new, out) if k else got.withColumnRenamed(new, out)
        k += 1
    if not k:  # no item has text
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            return [_batch(Phrases([], window), strings(batch, text), sample, None)]

        got = with_columns(docs, run, [T.StructField(out, RESULT)])
    return got


def contaminated(result: str = "decontamination") -> Column:
    """A twentieth of the words, or more, is hit."""
    hit, n = F.col(f"{result}.n_hit"), F.col(f"{result}.n_words")
    return (hit > 0) & (20 * hit >= n)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (code points)."""
    keep, last = [], 0
    for a, b in spans:
        keep.append(text[last:a])
        last = b
    return "".join([*keep, text[last:]])


_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower_ascii(s: str) -> str:
    return s.translate({c: c + 32 for c in range(65, 91)})


def plain_words(s: str | None) -> list[str]:
    """The same words, by a pattern (for tests)."""
    return _WORD.findall(lower_ascii(s or ""))
