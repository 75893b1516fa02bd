"""SimHash near-duplicates, with the pigeonring principle as the filter before the Hamming check.

The 64 bits are a ring of five segments.  If two fingerprints differ in at most 4 bits, then some segment starts a chain in
which the first l segments differ in at most l * 4 / 5 bits, for every l up to 5: none in the first, at most one in the
first two, two in the first three, three in the first four.  So a candidate shares the first segment whole and, of the next
three segments cut into four pieces, one piece: these 22 or 23 bits are the join key, twenty keys a fingerprint.  Within a key
the whole chain is tested, then the Hamming distance.  Equal fingerprints are one node, and texts are read once: what follows
works on (id, fingerprint).  Within a key only a spanning forest of the links is put out, enough for the classes; a key with
more than `block` fingerprints is split into blocks, and each pair of blocks is a group.

Defined results: a null or blank text has the fingerprint zero, which links like any other.  Repeated rows share a class.
A null doc_id never is a class id unless all of the class are null.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh, partitions, strings, with_columns, written
from quire.llm.graph import components

#: Where the five segments begin, from the lowest bit; and the 64th.
RING = (0, 13, 26, 39, 52, 64)
BUDGET = 4
BLOCK = 4096
CHUNK = 1 << 15


def fingerprint(text: str, k: int = 4, seed: int = 42) -> int:
    """Unsigned; every word k-shingle counts, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - k + 1)
    stops = ends[min(k, len(words)) - 1 :]
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        h = np.array([digest(line[a : b - 1], seed) for a, b in zip(starts[i : min(n, i + CHUNK)], stops[i : i + CHUNK], strict=False)], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str, out: str, k: int = 4) -> DataFrame:
    """docs with the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        made = np.array([fingerprint(t, k) for t in strings(batch, text).to_pylist()], np.uint64)
        return [pa.array(made.view(np.int64))]

    return with_columns(docs, run, [T.StructField(out, T.LongType())])


PIECES = 4


def _keys(fp: Column) -> Column:
    """Twenty keys: for each start, the whole segment and one piece of the next three."""
    keys = []
    for i in range(5):
        a, b = RING[i], RING[i + 1]
        own = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        at = b % 64
        turned = F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, 64 - at)) if at else fp
        width = sum(RING[(i + k) % 5 + 1] - RING[(i + k) % 5] for k in (1, 2, 3))
        for piece in range(PIECES):
            lo, hi = width * piece // PIECES, width * (piece + 1) // PIECES
            part = F.shiftrightunsigned(turned, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            keys.append(F.lit((i * PIECES + piece) << 24) + F.shiftleft(own, 10) + part)
    return F.array(*[k.cast("long") for k in keys])


def chain(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """The pigeonring test of differences x, from each start segment: and the budget of the whole ring."""
    diff = np.stack([np.bitwise_count((x >> np.uint64(RING[s])) & np.uint64((1 << (RING[s + 1] - RING[s])) - 1)) for s in range(5)]).astype(np.int64)
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    at = np.broadcast_to(np.asarray(start), x.shape)
    for n in range(5):
        total += diff[(at + n) % 5, np.arange(len(x))]
        ok &= total * 5 <= (n + 1) * BUDGET
    return ok


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that join what is linked within one key, at most one fewer than the fingerprints."""
    left, links = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= BUDGET
            near[near] = chain(left[near] ^ x, start)
            links += [(x, y) for y in left[near]]
            queue += list(left[near])
            left = left[~near]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, p, q, fp), ordered: links inside each (key, p, q)."""
    few = 16

    def of(g: np.ndarray, start: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(begin, len(g)))
        big = np.repeat(size > few, size)
        for lag in range(1, min(few, int(size.max(initial=0)) or 1)):
            i = np.flatnonzero((g[lag:] == g[:-lag]) & ~big[lag:])
            if not len(i):
                break
            x = fp[i] ^ fp[i + lag]
            near = i[np.bitwise_count(x) <= BUDGET]
            near = near[chain(fp[near] ^ fp[near + lag], start[near])]
            a.append(fp[near])
            b.append(fp[near + lag])
        for s, n in zip(begin[size > few], size[size > few], strict=True):
            links = forest(np.unique(fp[s : s + n]), int(start[s]))
            if links:
                x = np.array(links, np.uint64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        cat = lambda x: pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64))
        return pa.RecordBatch.from_arrays([cat(a), cat(b)], names=["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        key, p, q = (t.column(c).to_numpy() for c in ("key", "p", "q"))
        change = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
        if not len(change):
            held = t
            continue
        n = int(change[-1]) + 1  # the last group may go on in the next batch
        g = np.concatenate([[0], np.cumsum((key[1:n] != key[: n - 1]) | (p[1:n] != p[: n - 1]) | (q[1:n] != q[: n - 1]))])
        yield of(g, key[:n] >> 26, t.column("fp").to_numpy()[:n].view(np.uint64))
        held = t.slice(n)
    if held is not None and held.num_rows:
        yield of(np.zeros(held.num_rows, np.int64), held.column("key").to_numpy() >> 26, held.column("fp").to_numpy().view(np.uint64))


def links(fps: DataFrame, fp: str, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints within 4 bits, enough of them to join every class."""
    n = partitions(fps.sparkSession)
    keyed = written(fps.select(F.col(fp).alias("fp"), F.explode(_keys(F.col(fp))).alias("key")), "keys")
    hot = keyed.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("n"))
    cold = keyed.join(hot, "key", "left_anti").select("key", F.lit(0).alias("p"), F.lit(0).alias("q"), "fp")
    dealt = keyed.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    dealt = cold.union(dealt).repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q", "fp")
    return dealt.mapInArrow(_links, "a long, b long")


def _rooted(marked: DataFrame, fp: str, least: Column, block: int) -> DataFrame:
    """(fp, root, least): of each distinct fingerprint, its class and the class's least value of `least`."""
    small = written(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(least).alias("own")), "fingerprints")
    comp = components(links(small.select("fp"), "fp", block))
    rooted = small.join(comp, small.fp == comp.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "own")
    return rooted.join(rooted.groupBy("root").agg(F.min("own").alias("least")), "root").select("fp", "root", "least")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, block: int = BLOCK, keep: list[str] | None = None) -> tuple[DataFrame, str, str, str]:
    """The columns `keep` of docs (all, if not given; with the doc_id) with the fingerprint (signed long), the class (one of
    its fingerprints) and the smallest doc_id of the class; and the three columns' names."""
    keep = docs.columns if keep is None else keep
    names: list[str] = []
    for n in ("simhash", "simhash_class", "simhash_first", "simhash_of"):
        names.append(fresh([*docs.columns, *names], n))
    fp, root, first, of = names
    marked = written(with_fingerprint(docs.select(*dict.fromkeys([*keep, doc_id, text])), text, fp, k).select(*keep, fp), "marked")
    rooted = _rooted(marked, fp, F.col(doc_id), block).select(F.col("fp").alias(of), F.col("root").alias(root), F.col("least").alias(first))
    return marked.join(rooted, F.col(fp) == F.col(of), "left").drop(of), fp, root, first


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, block: int = BLOCK) -> DataFrame:
    """One row of each class, with the columns of docs: of its smallest doc_id (null after all others), and of rows that share
    it, of the text with the smallest hash.  Rows that share both are one."""
    key = fresh(docs.columns, "simhash_key")
    own = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.xxhash64(text).cast("string")))
    fp = fresh(own.columns, "simhash")
    order = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("i"), F.col(key).alias("key"))
    marked = written(with_fingerprint(own.select(*dict.fromkeys([doc_id, text, key])), text, fp, k).select(doc_id, key, fp), "marked")
    chosen = _rooted(marked, fp, order, block).select(F.col("least.key").alias(key)).distinct()
    return own.join(chosen, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
