"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a stretch of text once.  At each position its output links give every piece that ends there; each
relaxes the best score of the position.  A character that is no piece itself may be written by its bytes' pieces.  Texts are whole: where
no piece can lie across a place (a word mark after another character, for a vocabulary whose pieces have marks only in
front), the best path splits there, and so each distinct stretch is searched once for many texts.

The text as the pieces see it: one mark in front, each space a mark, nothing else changed.  A literal mark (U+2581) in the
text is written by its bytes, so decoding gives back every text exactly.  Equal scores prefer the longer last piece, found first.
Defined results: a null text gives null ids, an empty text none.  Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import fresh, list_array, with_columns

MARK = "▁"
#: Stands for a literal mark while encoding; texts hold it only if they hold lone surrogates, which UTF-8 excludes.
LITERAL = "\ud800"
#: Bytes that a task's cache of stretches may take, and what a kept stretch takes beside its own letters and ids.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 220
#: A character without a piece of its own may be written by its bytes, which costs more than any piece by this much.
BYTE_PENALTY = 10.0


class Cache:
    """The ids of stretches seen by one task, of so many bytes at most, in two generations: the older goes when the younger
    fills its half, and what is met again moves into the younger."""

    def __init__(self, most: int = CACHE_BYTES):
        self.half, self.held = most // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, stretch: str) -> bytes | None:
        got = self.young.get(stretch)
        if got is None:
            got = self.old.get(stretch)
            if got is not None:
                self.keep(stretch, got)
        return got

    def keep(self, stretch: str, ids: bytes) -> None:
        if len(stretch) > 64:
            return
        size = ENTRY_BYTES + 2 * len(stretch) + len(ids)
        if self.held + size > self.half:
            self.old, self.young, self.held = self.young, {}, 0
        self.held += size
        self.young[stretch] = ids


class PieceModel:
    """Pieces and scores; kinds as the model file numbers them (1 plain, 2 unknown, 3 control, 6 byte)."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.texts = [p for p, _, _ in pieces]
        plain = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4) and p]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.skipped = {i for i, (_, _, kind) in enumerate(pieces) if kind in (2, 3)}
        if len(self.byte_id) != 256:
            raise ValueError("the model needs a piece for each byte")
        self.byte_score = min((s for _, s, _ in plain), default=0.0) - BYTE_PENALTY
        self.single = {p for p, _, _ in plain if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s, i in plain:
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.some = bool(plain)
        self.cut = self._cuts([p for p, _, _ in plain])

    @staticmethod
    def _cuts(pieces: list[str]) -> re.Pattern | None:
        """A pattern of the stretches between places where no piece can lie across: before a mark that follows another
        character, around a character of no piece, and between a letter and a sign that never follow each other in a piece."""
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            return None
        known = {c for p in pieces for c in p} - {MARK}
        letters = {c for c in known if c.isalpha()}
        after = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if a in letters}
        signs = known - letters - after
        group = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else "(?!)"
        rest = group(known - signs)
        return re.compile(f"(?:{MARK}+|{group(known)})(?:{rest}|(?<!{group(letters)}){group(signs)})*|[^{MARK}]") if letters else None

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: 2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 6 if sp.is_byte(i) else 5 if sp.is_unused(i) else 1
        return cls([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])

    def viterbi(self, s: str) -> list[int]:
        n, least = len(s), self.byte_score
        best, size_of, id_of = [0.0] + [-1e300] * n, [0] * (n + 1), [0] * (n + 1)
        at = 0  # positions up to here have their best score
        for end, (size, score, i) in self.automaton.iter(s) if self.some else ():
            if end > at:
                for j in range(at + 1, end + 1):
                    if best[j] < best[j - 1] + least:
                        self._by_bytes(s, j, best, size_of, id_of)
                at = end
            now = best[end + 1 - size] + score
            if now > best[end + 1]:
                best[end + 1], size_of[end + 1], id_of[end + 1] = now, size, i
        for j in range(at + 1, n + 1):
            if best[j] < best[j - 1] + least:
                self._by_bytes(s, j, best, size_of, id_of)
        out, j = [], n
        while j:
            if size_of[j]:
                out.append(id_of[j])
                j -= size_of[j]
            else:
                out += [self.byte_id[b] for b in self._bytes(s[j - 1])[::-1]]
                j -= 1
        return out[::-1]

    def _bytes(self, c: str) -> bytes:
        return (MARK if c == LITERAL else c).encode()

    def _by_bytes(self, s: str, j: int, best: list[float], size_of: list[int], id_of: list[int]) -> None:
        score = best[j - 1] + self.byte_score
        if score > best[j] and s[j - 1] not in self.single:
            best[j], size_of[j] = score, 0

    def stretches(self, text: str) -> Iterable[str]:
        s = MARK + text.replace(MARK, LITERAL).replace(" ", MARK)
        return self.cut.findall(s) if self.cut else [s]

    def encoded(self, text: str, cache: Cache | None = None) -> bytes:
        """The ids as 32-bit integers, one after another."""
        if not text:
            return b""
        cache = Cache() if cache is None else cache
        out, young = [], cache.young
        for w in self.stretches(text):
            got = young.get(w)
            if got is None:
                got = cache.get(w)
                if got is None:
                    got = np.array(self.viterbi(w), np.int32).tobytes()
                    cache.keep(w, got)
                young = cache.young
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text; control and unknown pieces stand for none."""
        out = bytearray()
        for i in ids:
            b = self.id_byte.get(i)
            if b is not None:
                out.append(b)
            elif i not in self.skipped:
                out += self._plain(i)
        return out.decode("utf-8", "replace")[1:]

    def _plain(self, i: int) -> bytes:
        return self.texts[i].replace(MARK, " ").encode()

    def decoded(self, ids: np.ndarray) -> str:
        """As decode, through one table."""
        if not hasattr(self, "table"):
            self.table = [bytes([self.id_byte[i]]) if i in self.id_byte else b"" if i in self.skipped else self._plain(i) for i in range(len(self.texts))]
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]

    def decoded_all(self, lists: pa.ListArray) -> pa.Array:
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        null = lists.is_null().to_pylist()
        return pa.array([None if z else self.decoded(flat[a:b]) for a, b, z in zip(offsets[:-1], offsets[1:], null, strict=True)], pa.string())


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """Loaded once in each worker."""
    if path not in _models:
        _models[path] = PieceModel.load(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each text, and, if a name is given, the text that these ids decode to (in the same pass).
    path: a model file that every executor has."""
    for name in filter(None, (out, decoded)):
        if fresh(docs.columns, name) != name:
            raise ValueError(f"docs has a column {name}")

    def run(batch: pa.RecordBatch, cache: Cache) -> list[pa.Array]:
        texts, m = batch.column(batch.schema.get_field_index(text)), model(path)
        parts = [m.encoded(t.as_py(), cache) if t.is_valid else b"" for t in texts]
        ids = np.frombuffer(b"".join(parts), np.int32)
        made = list_array(pa.array(ids), [len(p) // 4 for p in parts])
        if texts.null_count:
            made = pa.ListArray.from_arrays(made.offsets, made.values, mask=texts.is_null())
        return [made, m.decoded_all(made)] if decoded else [made]

    fields = [T.StructField(out, T.ArrayType(T.IntegerType(), False))]
    return with_columns(docs, run, fields + ([T.StructField(decoded, T.StringType())] if decoded else []), Cache)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of each list of ids (null for null)."""
    if fresh(rows.columns, out) != out:
        raise ValueError(f"rows has a column {out}")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [model(path).decoded_all(batch.column(batch.schema.get_field_index(ids)))]

    return with_columns(rows, run, [T.StructField(out, T.StringType())])
