"""LM scoring by online logistic mixing of hashed-context bit predictors.

The model predicts a text's bytes (A-Z as a-z, then an end byte that UTF-8 never has), each as the bits of its Huffman code, so
a byte takes four or five predictions.  Predictor k knows the last k bytes and the bits so far of this byte: a context is
hashed to a line of 256 slots, its nodes of the code to slots of the line, and a slot has the counts of zeros and ones that
all training texts have there.  The tables are as large as the contexts found ask for (`slots` a gram, up to 2**MOST_BITS slots:
what is sent to every task is bounded, and only beyond some ten million contexts an order begins to mix contexts).

The predictors' logits are mixed by weights from a set that a gate picks: how many predictors have seen the context, and how
far into the byte it is.  These weights are learned online, by logistic gradient steps in small batches over every counted
gram, by its count, its own occurrence taken out of the slots first; tasks' weights are averaged.  An adaptive probability
map then refines the mixed logit given the node.  While a text is scored the mixture goes on learning: every text has its own
correction of the weights, which starts at zero and takes a gradient step after each `BLOCK` bits of it.  A text's score
depends on the model and the text alone, not on what else is in the batch.

What is counted grows with the corpus: counts of (five bytes, next byte) and of tokens, kept as tables in the shared folder.
The table of frequent tokens that goes to every task is bounded; all other tokens meet their counts in a join.

Defined results: a null text counts as empty; an empty text has one token, the end.  Repeated rows each get a row.  With
nothing to learn from, counts are zero and every bit has probability one half.  Words are told apart by 64-bit hashes.
Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bounded_batches, fresh, give_back, held_out, list_array, strings, with_columns, written
from quire.llm.words import LOWER, NOT_SPACE, U, expand, mix, pieces, raw, words

END = 0xFF
ORDERS = 6
#: Bits of a table of slots, at least and at most; slots for each distinct (context, byte).
LEAST_BITS, MOST_BITS = 16, 24
SLOTS_PER_GRAM = 2.5
DEPTHS = 8
GATES = (ORDERS + 1) * DEPTHS
FREQUENT = 1 << 18
BATCH_BYTES = 1 << 20
#: Scored at once: the more, the more contexts are equal.
SCORE_BYTES = 2 << 20
END_TOKEN = -0x61C8864680B583EB
BUCKETS = 33
#: A text's own weights: bits between two steps, and the size of a step for each bit.
BLOCK = 256
RATE = 0.003
#: Bits looked up at once, where few rows are left; and blocks of a row, at most.
GATHERED, MOST_BLOCKS = 1 << 16, 32
#: Logits are held as whole numbers of this part.
PART = 12.0


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the rows and each row's end: the five bytes before and it, as a number; and the rows' offsets."""
    at = offsets - offsets[0] + np.arange(len(offsets))
    n = int(at[-1])
    flat = np.full(ORDERS - 1 + n + 2, END, np.uint8)
    if len(data):
        inside = np.ones(n, bool)
        inside[at[1:] - 1] = False
        flat[ORDERS - 1 : ORDERS - 1 + n][inside] = LOWER[data[offsets[0] : offsets[-1]]]
    # eight bytes from each place on, of which the last two are of no use
    key = np.ndarray(n, ">u8", flat, 0, (1,)).astype(U) >> U(16)
    for since in range(ORDERS - 1):
        begin = at[:-1][np.diff(at) > since] + since
        key[begin] |= U((1 << 8 * ORDERS) - (1 << 8 * (since + 1)))  # ends, instead of the row before
    return key, at


class Code:
    """A Huffman code of the 256 bytes: size[b] bits each; its nodes and bits stand at start[b] of `node` and `bit`."""

    def __init__(self, counts: np.ndarray):
        """A byte that never occurs counts as one in 2**14, which bounds the depth."""
        heap = [(float(c) + counts.sum() / 2**14 + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}  # node or byte -> its parent and side; inner nodes from 256 on
        for inner in range(256, 511):
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y] = (inner, 0), (inner, 1)
            heapq.heappush(heap, (a + b, inner, inner))
        paths = []
        for b in range(256):
            path, at = [], b
            while at in up:
                at, side = up[at]
                path.append((510 - at, side))  # the root is node 0
            paths.append(path[::-1])
        self.size = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.node = np.array([n for p in paths for n, _ in p], np.uint8)
        self.bit = np.array([s for p in paths for _, s in p], np.int8)
        self.depth = np.array([min(d, DEPTHS - 1) for p in paths for d in range(len(p))], np.int8)

    def spelt(self, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `node` and `bit` of all bits of the bytes, and which byte each belongs to."""
        return expand(self.start[byte], self.size[byte])


def lines(key: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Where the contexts of an order begin in a table of 2**bits slots; a node's slot is this with its number exclusive-ored."""
    ctx = (key >> U(8)) & U((1 << (8 * order)) - 1)
    if order <= 1:
        return ctx.astype(np.int64) << 8
    return (mix(ctx + U(order << 48)) >> U(64 - bits)).astype(np.int64)


#: A slot's state: its counts, exactly up to 64 and in steps of an eighth of an octave beyond.
STEPS = np.unique(np.concatenate([np.arange(65), np.rint(64 * 2 ** (np.arange(1, 191) / 8))])).astype(np.float64)


def state(ones: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Zeros and ones, a byte each; counts beyond the steps keep their ratio."""
    over = np.maximum(1.0, seen / (STEPS[-1] / 2))
    ones, seen = ones / over, seen / over
    near = lambda n: np.maximum(np.searchsorted(STEPS, n * (1 + 1e-9), "right") - 1, 0).astype(np.uint16)
    return near(seen - ones) << np.uint16(8) | near(ones)


def logit(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    seen = zeros + ones
    return np.clip(np.log((ones + 0.1) / (zeros + 0.1)) * (seen / (seen + 0.5)), -10, 10)


def _logits(less: int | None = None) -> np.ndarray:
    """Of each state, in PARTs; less: a zero (0) or a one (1) is taken out first.  Unseen: -128."""
    z, o = STEPS[:, None], STEPS[None, :]
    if less is not None:
        z, o = (np.maximum(z - 1, 0), o) if less == 0 else (z, np.maximum(o - 1, 0))
    made = np.where(z + o > 0, np.rint(logit(z, o) * PART), -128).astype(np.int8)
    out = np.full((256, 256), -128, np.int8)
    out[: len(STEPS), : len(STEPS)] = made
    return out.ravel()


PLAIN, WITHOUT = _logits(), np.stack([_logits(0), _logits(1)])


def soft(v: np.ndarray) -> np.ndarray:
    return np.maximum(v, 0) + np.log1p(np.exp(-np.abs(v)))


@dataclass
class Mixer:
    """tables: states by order, or their logits in PARTs.  weights: (gates, orders).  refined: (256 nodes, buckets) logits."""

    code: Code
    bits: tuple[int, ...]
    tables: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray | None = None

    @classmethod
    def empty(cls) -> Mixer:
        bits = (8, 16, *[LEAST_BITS] * (ORDERS - 2))
        return cls(Code(np.zeros(256)), bits, [np.zeros(1 << b, np.uint16) for b in bits], np.full((GATES, ORDERS), 0.3, np.float32))

    def frozen(self) -> Mixer:
        """For scoring: the same predictors, half as large."""
        return Mixer(self.code, self.bits, [PLAIN[t] for t in self.tables], self.weights, self.refined)

    def inputs(self, key: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each bit of the keys: logits of the predictors in PARTs, (n, 8) with two empty columns; the gate; the place in
        the code; and which key it is of.  own: this very event is taken out of the counts."""
        at, of = self.code.spelt((key & U(255)).astype(np.int64))
        node, gate = self.code.node[at].astype(np.int64), self.code.depth[at].astype(np.int64)
        out = np.zeros((len(at), 8), np.int8)
        for k in range(ORDERS):
            found = self.tables[k][lines(key, k, self.bits[k])[of] ^ node]
            if own:
                found = np.where(self.code.bit[at] == 1, WITHOUT[1][found], WITHOUT[0][found])
            q = found if found.dtype == np.int8 else PLAIN[found]
            known = q != -128
            gate += known * DEPTHS
            out[:, k] = np.where(known, q, 0)
        return out, gate, at, of

    def mixed(self, q: np.ndarray, gate: np.ndarray) -> np.ndarray:
        x = np.zeros(len(q), np.float32)
        for k in range(ORDERS):
            x += (self.weights[:, k] / np.float32(PART)).astype(np.float32)[gate] * q[:, k]
        return np.clip(x, -16, 16)

    def refine(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        if self.refined is None:
            return x
        return (x + self.refined[node, np.rint(x + 16).astype(np.int64)]) / 2

    def learn(self, key: np.ndarray, count: np.ndarray, rate: float) -> None:
        """One online step of a small batch."""
        q, gate, at, of = self.inputs(key, own=True)
        w = count.astype(np.float64)[of]
        error = (self.code.bit[at] - 1 / (1 + np.exp(-self.mixed(q, gate).astype(np.float64)))) * w
        mass = np.bincount(gate, w, GATES) + 1.0
        for k in range(ORDERS):
            self.weights[:, k] += rate * np.bincount(gate, error * q[:, k] / PART, GATES) / mass

    def prepared(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct keys: where the bits of each begin; of each bit the refined logit against it; and this with the packed
        inputs against it (logits of a zero, if the bit is one), side by side so that one access finds both.  After all of
        these comes a bit that costs nothing."""
        size = self.code.size[(key & U(255)).astype(np.int64)]
        both, lo = np.zeros(int(size.sum()) + 1, np.complex128), 0
        packed, x = both.view(U)[::2], both.view(np.float32)[2::4]
        for i in range(0, len(key), 1 << 15):
            q, gate, at, _ = self.inputs(key[i : i + (1 << 15)])
            side = (1 - 2 * self.code.bit[at]).astype(np.int8)
            x[lo : lo + len(at)] = self.refine(self.mixed(q, gate), self.code.node[at]).astype(np.float32) * side
            q *= side[:, None]
            packed[lo : lo + len(at)] = q.view(U).ravel()
            lo += len(at)
        x[-1] = -60
        return np.cumsum(size) - size, x[:-1], both

    def bits_of(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits that each row of the sequences costs; at: the rows' offsets (every row has its end at least).  The first blocks
        of all rows are predicted at once, then the second ones, ..."""
        rows = len(at) - 1
        total = np.zeros(rows)
        if not len(key):
            return total
        own, which = distinct(key)
        start, _, both = self.prepared(own)
        size = self.code.size[(own & U(255)).astype(np.int64)][which]
        end = np.cumsum(size)
        # places in `both`: from one to the next, but for a byte's first bit
        spelt = np.ones(end[-1] + 1, np.int32)
        first = start[which]
        spelt[0] = first[0]
        spelt[end[:-1]] = first[1:] - first[:-1] - size[:-1] + 1
        np.cumsum(spelt, out=spelt)
        spelt[-1] = len(both) - 1
        ends = end[at[1:] - 1]
        del end, size, which, own, first, start
        begins = np.concatenate([[0], ends[:-1]])
        longest = np.argsort(begins - ends, kind="stable")
        begins, ends = begins[longest], ends[longest]
        left, delta, cost, lo = begins - ends, np.zeros((rows, 8), np.float32), np.zeros(rows), 0
        while lo < -left[0]:
            some = int(np.searchsorted(left, -lo, "left"))
            many = max(1, min(MOST_BLOCKS, GATHERED // (some * BLOCK)))
            place = (begins[:some] + lo)[:, None] + np.arange(many * BLOCK)
            np.copyto(place, len(spelt) - 1, where=place >= ends[:some, None])
            got = both[spelt[place].astype(np.intp)].reshape(some, many, BLOCK, 1)
            seen = got.view(np.int8)[..., :8].astype(np.float32)
            known = got.view(np.float32)[..., 2]
            for j in range(many):
                if j:
                    some = int(np.searchsorted(left, -lo, "left"))
                    if not some:
                        break
                own = seen[:some, j]
                y = known[:some, j] + np.matmul(own, delta[:some, :, None])[:, :, 0]
                cost[:some] += (np.maximum(y, 0) + np.log1p(np.exp(-np.abs(y)))).sum(axis=1, dtype=np.float64)
                wrong = np.tanh(y * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
                delta[:some] -= np.float32(RATE / PART**2) * np.matmul(wrong[:, None, :], own)[:, 0, :]
                lo += BLOCK
        total[longest] = cost
        return total / math.log(2)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (a few may come twice), and which each key is: a key looks at the last position that its hash has."""
    at = (mix(key) >> U(43)).astype(np.int64)
    place = np.zeros(1 << 21, np.int32)
    here = np.arange(len(key), dtype=np.int32)
    place[at] = here
    rep = place[at]
    rep = np.where(key[rep] == key, rep, here)
    own = np.flatnonzero(rep == here)
    place = np.zeros(len(key), np.int32)
    place[own] = np.arange(len(own), dtype=np.int32)
    return key[own], place[rep]


def _counted(text: str):
    """Rows (kind, key, n): tokens (0) and byte sequences (1) of a task, summed before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def merge(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held[kind]]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([c for _, c in held[kind]]), len(keys)).astype(np.int64)

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind]:
                keys, n = merge(kind)
                held[kind] = []
                for i in range(0, len(keys), 1 << 17):
                    k = keys[i : i + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + len(k)])], names=["kind", "key", "n"])

        for batch in batches:
            data, offsets = raw(strings(batch, text))
            for lo, hi in pieces(offsets, BATCH_BYTES):
                part = offsets[lo : hi + 1]
                tokens = np.append(words(data, part, NOT_SPACE).hashes.view(np.int64), np.full(hi - lo, END_TOKEN))
                for kind, keys in enumerate((tokens, sequences(data, part)[0].view(np.int64))):
                    held[kind].append(np.unique(keys, return_counts=True))
                    if len(held[kind]) % 8 == 0:
                        held[kind] = [merge(kind)]
                        if len(held[kind][0][0]) > 1 << 21:
                            yield from flush(kind)
        for kind in (0, 1):
            yield from flush(kind)
        give_back()

    return run


@dataclass
class Language:
    """What scoring needs: tables of counts, the model, and the frequent tokens."""

    tokens: DataFrame
    model: Mixer
    hot: tuple[np.ndarray, np.ndarray]
    n: int
    v: int


def _counts_of(code: Code, key: np.ndarray, n: np.ndarray, line: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ones and all, by slot."""
    ones, seen = np.zeros(size), np.zeros(size)
    for i in range(0, len(key), 1 << 16):
        at, of = code.spelt((key[i : i + (1 << 16)] & U(255)).astype(np.int64))
        slot, w = line[i : i + (1 << 16)][of] ^ code.node[at].astype(np.int64), n[i : i + (1 << 16)][of]
        seen += np.bincount(slot, w, size)
        ones += np.bincount(slot, w * code.bit[at], size)
    return ones, seen


def _regions(bits: int) -> int:
    """Parts of a table that one task each makes: of 2**18 slots, if there are so many."""
    return 1 << max(0, bits - 18)


def _tables(by: dict[int, DataFrame], code: Code, bits: tuple[int, ...]) -> dict[int, np.ndarray]:
    """States of the slots, by order.  A region of a table is made in one task: it holds whole lines, and a table's contexts
    are dealt over its regions by their hash."""
    schema = "order int, region int, key long, n long"

    def dealt(order: int):
        size = (1 << bits[order]) // _regions(bits[order])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                line = lines(batch.column(0).to_numpy().view(U), order, bits[order])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(line), order, np.int32)), pa.array((line // size).astype(np.int32)), batch.column(0), batch.column(1)], names=["order", "region", "key", "n"])

        return run

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            order, region, key, n = (batch.column(c).to_numpy() for c in range(4))
            for o, r in np.unique(np.stack([order, region]), axis=1).T.tolist():
                own = (order == o) & (region == r)
                size = (1 << bits[o]) // _regions(bits[o])
                keys = key[own].view(U)
                got = _counts_of(code, keys, n[own].astype(np.float64), lines(keys, o, bits[o]) - r * size, size)
                for total, x in zip(found.setdefault((o, r), [np.zeros(size), np.zeros(size)]), got, strict=True):
                    total += x
        for (o, r), (ones, seen) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([r], pa.int32()), pa.array([state(ones, seen).tobytes()])], names=["order", "region", "states"])

    rows = None
    for order, grams in by.items():
        own = grams.select("key", "n").mapInArrow(dealt(order), schema)
        rows = own if rows is None else rows.union(own)
    parts = written(rows.repartition("order", "region").mapInArrow(made, "order int, region int, states binary"), "slots")
    out = {k: np.zeros(1 << bits[k], np.uint16) for k in by}
    for r in parts.toLocalIterator():
        size = len(r["states"]) // 2
        out[r["order"]][r["region"] * size : (r["region"] + 1) * size] = np.frombuffer(r["states"], np.uint16)
    return out


def _weights(grams: DataFrame, model: Mixer, tasks: int, rounds: int) -> np.ndarray:
    """Online learning in every task, averaged by what each has seen."""
    sent = grams.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mixer(sent.value.code, sent.value.bits, sent.value.tables, sent.value.weights.copy())
        total, step = 0.0, 0
        for batch in batches:
            key, n = batch.column(0).to_numpy().view(U), batch.column(1).to_numpy()
            total += len(key)
            for _ in range(rounds):
                for i in range(0, len(key), 4096):
                    m.learn(key[i : i + 4096], n[i : i + 4096], 0.5 / (1 + step / 50) + 0.02)
                    step += 1
        at = np.arange(GATES * ORDERS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), total)), pa.array(m.weights.ravel().astype(np.float64) * total)], names=["at", "n", "w"])

    got = grams.select("key", "n").coalesce(tasks).mapInArrow(run, "at long, n double, w double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()
    sent.destroy()  # else each worker keeps its copy of the tables on disk
    out = model.weights.ravel().copy()
    for r in got:
        if r["n"]:
            out[r["at"]] = r["w"] / r["n"]
    return out.reshape(model.weights.shape)


def _refined(grams: DataFrame, model: Mixer, tasks: int) -> np.ndarray:
    """The adaptive map: how often the bit is one at a node where the mixed logit is so."""
    sent = grams.sparkSession.sparkContext.broadcast(model)
    size = 256 * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = sent.value, np.zeros((2, size))
        for batch in batches:
            key, n = batch.column(0).to_numpy().view(U), batch.column(1).to_numpy().astype(np.float64)
            for i in range(0, len(key), 1 << 15):
                q, gate, at, of = m.inputs(key[i : i + (1 << 15)], own=True)
                x = m.mixed(q, gate)
                slot, w = m.code.node[at].astype(np.int64) * BUCKETS + np.rint(x + 16).astype(np.int64), n[i : i + (1 << 15)][of]
                total[0] += np.bincount(slot, w * m.code.bit[at], size)
                total[1] += np.bincount(slot, w, size)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["at", "ones", "seen"])

    got = grams.select("key", "n").coalesce(tasks).mapInArrow(run, "at long, ones double, seen double").groupBy("at").agg(F.sum("ones").alias("ones"), F.sum("seen").alias("seen")).collect()
    sent.destroy()
    ones, seen = np.zeros(size), np.zeros(size)
    for r in got:
        ones[r["at"]], seen[r["at"]] = r["ones"], r["seen"]
    prior = 1 / (1 + np.exp(-(np.arange(BUCKETS) - 16.0)))
    p = (ones.reshape(256, BUCKETS) + 20 * prior) / (seen.reshape(256, BUCKETS) + 20)
    return np.log(p / (1 - p)).astype(np.float32)


def _model(grams: DataFrame, rounds: int) -> Mixer:
    """Tables of all orders, each summed from the one above it; then the weights and the map."""
    by: dict[int, DataFrame] = {ORDERS - 1: grams}
    for k in range(ORDERS - 2, 0, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        by[k] = written(by[k + 1].groupBy(shorter.alias("key")).agg(F.sum("n").alias("n")), f"grams{k}")
    pairs = by[1].toArrow()  # of two bytes: at most 2**16 rows
    key, n = pairs.column("key").to_numpy().astype(U), pairs.column("n").to_numpy().astype(np.float64)
    code = Code(np.bincount((key & U(255)).astype(np.int64), n, 256))
    rows = {k: by[k].count() for k in range(2, ORDERS)}
    bits = (8, 16, *[min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(SLOTS_PER_GRAM * rows[k] + 1)))) for k in range(2, ORDERS)])
    tables = [state(*_counts_of(code, key, n, lines(key, k, bits[k]), 1 << bits[k])) for k in (0, 1)]
    higher = _tables({k: by[k] for k in range(2, ORDERS)}, code, bits)
    tables += [higher[k] for k in range(2, ORDERS)]
    model = Mixer(code, bits, tables, Mixer.empty().weights)
    tasks = max(2, -(-rows[ORDERS - 1] // (1 << 21)))
    model.weights = _weights(grams, model, tasks, rounds)
    model.refined = _refined(grams, model, tasks)
    return model


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 2) -> Language:
    """From all rows that are not held out (crc32 of the id modulo 7 is not 2)."""
    bounded_batches(docs.sparkSession)
    train = docs.filter(~held_out(F.col(doc_id), 7)).select(F.col(text).alias("t"))
    counts = train.mapInArrow(_counted("t"), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    tokens, grams = (counts.filter(F.col("kind") == k).drop("kind") for k in (0, 1))
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the frequent tokens: all whose count is in the highest classes that together are few enough
    size = lambda n: F.floor(F.log2(n) * 8)
    classes = sorted(tokens.groupBy(size(F.col("n")).alias("k")).count().collect(), key=lambda r: -r["k"])
    total, least = 0, None
    for r in classes:
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["k"]
    top = tokens.filter(size(F.col("n")) >= least if least is not None else F.lit(False)).toArrow()
    hot_keys, hot_n = (top.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    order = np.argsort(hot_keys)
    return Language(tokens, _model(grams, rounds), (hot_keys[order], hot_n[order]), n, v)


#: Leading bits of a token's hash that its search begins with.
LEADING = 18


def index(hot: np.ndarray) -> np.ndarray:
    """Where in `hot` (sorted) the tokens of each leading bits begin."""
    bits = np.arange(-(1 << (LEADING - 1)), 1 << (LEADING - 1), dtype=np.int64)
    return np.searchsorted(hot, bits << (64 - LEADING)).astype(np.int32)


def position(hot: np.ndarray, begin: np.ndarray, token: np.ndarray) -> np.ndarray:
    """np.searchsorted(hot, token), but at most the last place; begin: the index of hot, which has a token at least."""
    last = len(hot) - 1
    i = np.minimum(begin[(token >> (64 - LEADING)) + (1 << (LEADING - 1))], last).astype(np.int64)
    rest = np.flatnonzero((hot[i] < token) & (i < last))
    while len(rest):
        i[rest] += 1
        rest = rest[(hot[i[rest]] < token[rest]) & (i[rest] < last)]
    return i


TOKEN = T.StructType([T.StructField("key", T.LongType()), T.StructField("tf", T.LongType())])
RESULT = [
    ("n_bytes", T.LongType()),
    ("n_tokens", T.LongType()),
    ("n_known", T.LongType()),
    ("log_counts", T.DoubleType()),
    ("bits", T.DoubleType()),
    ("rest", T.ArrayType(TOKEN)),
]


def score(docs: DataFrame, language: Language, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns `keep` of docs (all but the text, if not given) with n_bytes (the end counted), n_tokens, n_known,
    base_score (log10), score (log10 of the model's probability) and bits_per_byte; and the names of these columns."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast((language.model.frozen(), language.hot, index(language.hot[0])))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        model, (hot, hot_n), begin = sent.value
        data, offsets = raw(strings(batch, text))
        made = [[] for _ in range(5)]
        keys, tfs, sizes = [], [], []
        for lo, hi in pieces(offsets, SCORE_BYTES):
            part, rows = offsets[lo : hi + 1], hi - lo
            seq, at = sequences(data, part)
            bits = model.bits_of(seq, at)
            w = words(data, part, NOT_SPACE)
            row = np.append(np.repeat(np.arange(rows), np.diff(w.row)), np.arange(rows))
            token = np.append(w.hashes.view(np.int64), np.full(rows, END_TOKEN))
            i = position(hot, begin, token) if len(hot) else np.zeros(len(token), np.int64)
            known = hot[i] == token if len(hot) else np.zeros(len(token), bool)
            logs = np.zeros(len(token))
            if len(hot):
                logs[known] = np.log10(hot_n[i[known]] + 1.0)
            for m, x in zip(made, (np.diff(at), np.diff(w.row) + 1, np.bincount(row[known], minlength=rows), np.bincount(row, logs, rows), bits), strict=True):
                m.append(x)
            r, t = row[~known], token[~known]
            order = np.lexsort((t, r))
            r, t = r[order], t[order]
            first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])])) if len(r) else np.zeros(0, np.int64)
            keys.append(t[first])
            tfs.append(np.diff(np.append(first, len(r))))
            sizes.append(np.bincount(r[first], minlength=rows))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        rest = list_array(pa.StructArray.from_arrays([pa.array(cat(keys), pa.int64()), pa.array(cat(tfs), pa.int64())], ["key", "tf"]), cat(sizes))
        return [*(pa.array(cat(m), to) for m, to in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)), rest]

    names: dict[str, str] = {}
    for name in ("row", "base_score", "score", "bits_per_byte", "met_row", "met_known", "met_logs", *[n for n, _ in RESULT]):
        names[name] = fresh([*keep, *names.values(), text], name)
    row, rest = names["row"], names["rest"]
    src = docs.select(*keep, F.col(text).alias(text)) if text not in keep else docs.select(*keep)
    # the rows' numbers are fixed once they are written
    done = with_columns(src.withColumn(row, F.monotonically_increasing_id()), run, [T.StructField(names[n], t) for n, t in RESULT])
    done = written(done.select(*keep, row, *[names[n] for n, _ in RESULT]), "scores")
    sent.destroy()
    met_row, met_known, met_logs = (names[n] for n in ("met_row", "met_known", "met_logs"))
    each = done.select(F.col(row).alias("r"), F.explode(rest).alias("x")).select("r", "x.key", "x.tf")
    met = each.join(language.tokens, "key").groupBy(F.col("r").alias(met_row)).agg(F.sum("tf").alias(met_known), F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias(met_logs))
    both = done.join(met, done[row] == met[met_row], "left")
    n_tokens, norm = F.col(names["n_tokens"]), math.log10(language.n + language.v + 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = both.select(
        *[done[c] for c in keep],
        names["n_bytes"],
        names["n_tokens"],
        (F.col(names["n_known"]) + zero(met_known)).alias(names["n_known"]),
        (F.col(names["log_counts"]) + zero(met_logs) - n_tokens * norm).alias(names["base_score"]),
        (-F.col(names["bits"]) * math.log10(2)).alias(names["score"]),
        (F.col(names["bits"]) / F.col(names["n_bytes"])).alias(names["bits_per_byte"]),
    )
    return out, {n: names[n] for n in ("n_bytes", "n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
