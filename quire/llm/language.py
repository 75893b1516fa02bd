"""Language ID by hierarchical discrimination: first the family, then one-versus-one linear SVMs within the family.

Features are hashed byte trigrams of the whole text (A-Z as a-z), as shares of all trigrams.  Families are told apart by
one-versus-rest linear SVMs, the languages of a family by one SVM a pair, with votes, ties going to the larger sum of
margins and then to the name that sorts first.  The SVMs are fitted by dual coordinate descent on a bounded sample of whole
texts: `per_language` of each language (the expected number; rows are taken by a hash of id and text), or fewer where these
would have more than `most` features, and one at least.  The driver is sent the features only, of which a text has no more
than 2**16 however long it is.  Weights are whole numbers in fixed point, so a score does not depend on how rows are batched.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text if there is nothing to
learn from.  Rows with null lang are not learned from.  Repeated rows each get a row.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh, held_out, strings, with_columns
from quire.llm.words import LOWER, pieces, raw

BITS = 16
SCALE = 20.0
FIXED = 1 << 16
BATCH_BYTES = 2 << 20
MOST_LANGUAGES = 500
#: Families of languages by code; any other code is a family "other".
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "cjk": "ja ko zh",
}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), "other")


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A code for each byte of the rows: of it and the two before it, spaces before the row's first."""
    low = LOWER[data].astype(np.uint32)
    one, two = np.full(len(low), 32, np.uint32), np.full(len(low), 32, np.uint32)
    one[1:], two[2:] = low[:-1], low[:-2]
    begin = offsets[:-1][np.diff(offsets) > 0]
    one[begin], two[begin] = 32, 32
    begin = begin[begin + 1 < len(low)] + 1
    begin = begin[~np.isin(begin, offsets)]
    two[begin] = 32
    return ((low | (one << np.uint32(8)) | (two << np.uint32(16))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a text, each once, and their shares of all."""
    data, offsets = raw(pa.array([text], pa.large_string()))
    at, count = np.unique(trigrams(data, offsets), return_counts=True)
    return at.astype(np.int64), count * (SCALE / max(1, count.sum()))


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights, the bias last, of a linear SVM with squared hinge loss, by dual coordinate descent."""
    w = np.zeros((1 << BITS) + 1)
    alpha, diag = np.zeros(len(rows)), 0.5 / c
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1 + diag * alpha[i]
            new = max(alpha[i] - g / (norm[i] + diag), 0.0)
            d = (new - alpha[i]) * y[i]
            if d:
                w[at] += d * v
                w[-1] += d
                alpha[i] = new
                worst = max(worst, abs(d))
        if worst < 1e-3:
            break
    return w


@dataclass
class LanguageModel:
    """families[f]: the sorted languages of a family; the classifiers are columns of `weights`."""

    families: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    column: dict[tuple, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> LanguageModel:
        """rows: the features of each text and their weights."""
        m, columns = cls(), []
        found = np.array(langs)
        for lang in sorted(set(langs)):
            m.families.setdefault(family(lang), []).append(lang)
        m.families = dict(sorted(m.families.items()))
        fam = np.array([family(x) for x in langs])

        def learn(key: tuple, use: np.ndarray, yes: np.ndarray) -> None:
            at = np.flatnonzero(use)
            w = fit_svm([rows[i] for i in at], np.where(yes[at], 1.0, -1.0))
            m.column[key] = len(columns)
            columns.append(np.rint(w * FIXED).astype(np.int32))

        if len(m.families) > 1:
            for f in m.families if len(m.families) > 2 else list(m.families)[:1]:
                learn(("family", f), np.ones(len(rows), bool), fam == f)
        for own in m.families.values():
            for a, b in combinations(own, 2):
                learn((a, b), (found == a) | (found == b), found == a)
        if columns:
            m.weights = np.ascontiguousarray(np.stack(columns, axis=1))
        return m

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each row (not empty), one for each classifier."""
        codes = trigrams(data, offsets)
        total = np.add.reduceat(self.weights[codes], offsets[:-1], axis=0, dtype=np.int64)
        return (total * (SCALE / np.diff(offsets))[:, None] + self.weights[-1]) / FIXED

    def predict(self, texts: pa.Array, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        data, offsets = raw(texts)
        use = letters & (np.diff(offsets) > 0)
        only = [x for own in self.families.values() for x in own]
        if not only:
            return names.tolist(), score
        if len(only) == 1:
            names[use], score[use] = only[0], 1.0
            return names.tolist(), score
        margin = np.zeros((len(texts), self.weights.shape[1]))
        for lo, hi in pieces(offsets, BATCH_BYTES):
            part = offsets[lo : hi + 1]
            some = np.flatnonzero(np.diff(part) > 0)
            if len(some):
                margin[lo + some] = self.margins(data[part[0] : part[-1]], np.append(part[some], part[-1]) - part[0])
        sure = lambda x: 1 / (1 + np.exp(-2 * np.clip(x, -300, 300)))
        fams = list(self.families)
        if len(fams) == 1:
            of = np.zeros((len(texts), 1))
        elif len(fams) == 2:
            one = margin[:, self.column["family", fams[0]]]
            of = np.stack([one, -one], axis=1)
        else:
            of = np.stack([margin[:, self.column["family", f]] for f in fams], axis=1)
        best = of.argmax(axis=1)
        for k, f in enumerate(fams):
            here, own = np.flatnonzero(use & (best == k)), self.families[f]
            p = sure(of[here, k]) if len(fams) > 1 else np.ones(len(here))
            votes, margins, sureness = (np.zeros((len(here), len(own))) for _ in range(3))
            for a, b in combinations(range(len(own)), 2):
                x = margin[here, self.column[own[a], own[b]]]
                votes[:, a] += x >= 0
                votes[:, b] += x < 0
                margins[:, a] += x
                margins[:, b] -= x
                sureness[:, a] += sure(x)
                sureness[:, b] += sure(-x)
            pick = np.array([max(range(len(own)), key=lambda j: (votes[i, j], margins[i, j], -j)) for i in range(len(here))], np.int64) if len(own) > 1 else np.zeros(len(here), np.int64)
            names[here] = np.array(own, dtype=object)[pick]
            score[here] = p * (sureness[np.arange(len(here)), pick] / (len(own) - 1) if len(own) > 1 else 1.0)
        return names.tolist(), score


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1500, most: int = 12 << 20) -> LanguageModel:
    """From rows whose id is not held out (crc32 of it modulo 4 is not 2) and whose lang is not null."""
    known = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    known = known.filter(~held_out(F.col("i"), 4) & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    whole = 1 << 30
    known = known.withColumn("o", F.pmod(F.xxhash64(F.lit("sample"), "i", "t"), F.lit(whole)))
    size = F.sum(F.least(F.octet_length("t"), F.lit(1 << BITS)))
    counts = known.groupBy("l").agg(F.count("*").alias("n"), size.alias("size"), F.min("o").alias("first")).orderBy("l").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return LanguageModel()
    share = {r["l"]: max(r["first"], min(whole, whole * per_language // r["n"], whole * most // max(1, r["size"])) - 1) for r in counts}
    last = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, weight = features(batch.column(1)[i].as_py())
                one = [pa.array([x]) for x in (at.astype(np.int32), weight)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in (0, 2, 3)], *one], names=["l", "o", "i", "at", "weight"])

    sample = known.filter(F.col("o") <= last[F.col("l")]).select("l", "t", "o", "i")
    got = sample.mapInArrow(described, "l string, o long, i string, at array<int>, weight array<double>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["o"], r["i"] or "", r["l"], len(r["at"])))
    return LanguageModel.fit([(np.array(r["at"], np.int64), np.array(r["weight"])) for r in got], [r["l"] for r in got])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the language and the score of each text; and the two columns' names."""
    has, lang = fresh(docs.columns, "has_letter"), fresh(docs.columns, "lang_pred")
    score = fresh([*docs.columns, lang], "lang_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        letters = batch.column(batch.schema.get_field_index(has)).to_numpy(zero_copy_only=False).astype(bool)
        names, scores = sent.value.predict(strings(batch, text), letters)
        return [pa.array(names, pa.string()), pa.array(scores)]

    marked = docs.withColumn(has, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    out = with_columns(marked, run, [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return out.drop(has), lang, score


def unknown(lang: str) -> Column:
    return F.col(lang) == "und"
