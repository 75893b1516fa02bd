"""From raw documents to token ids: five stages, each one operator of the llm subpackage over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate as decon
from quire.llm import language, line_dedup, pieces, simhash
from quire.llm.common import fresh, table, written
from quire.llm.queries import PIECES


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`: no letter, or no text) go.  If there is nothing to learn languages from, only those
    without a letter go."""
    model = language.learn(docs)
    if not model.families:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out, lang, _ = language.identify(docs, model)
    return out.filter(~language.unknown(lang)).select(docs.columns)


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the later occurrences of repeated three-line windows; n_chars follows.  No document goes."""
    out, kept, _ = line_dedup.dedup(docs)
    new = {"text": F.col(kept), "n_chars": F.length(kept).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else c for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, that of the smallest doc_id."""
    return simhash.representatives(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    name = fresh(docs.columns, "decontamination")
    out = decon.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), out=name)
    return out.filter(~decon.contaminated(name)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, and whether decoding gives back the text."""
    ids, back = fresh(docs.columns, "ids"), fresh(docs.columns, "decoded")
    both = pieces.encode(docs, PIECES, out=ids, decoded=back)
    return both.select(*docs.columns, ids, F.col(back).eqNullSafe(F.col("text")).alias(fresh(docs.columns, "round_trip")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: SimHash needs XXH64 and the language model is learned: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
