"""Text files: decoding, and the plain-text reader that cuts them into typed blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t

#: From this share of replacement characters on another encoding is tried.
LOSSY = 0.002
DECODED = "struct<text:string,encoding:string,lossy:boolean>"
FORMATS = {".md": "markdown", ".markdown": "markdown", ".txt": "plaintext", ".text": "plaintext", ".log": "plaintext", ".pdf": "pdf", ".epub": "epub"}


def decode_bytes(data: bytes) -> tuple[str, str, bool]:
    """By byte order mark, else UTF-8, else GB18030 if that reads better."""
    share = lambda s: s.count("�") / len(s.encode("utf-16-le")) * 2 if s else 0.0
    for mark, codec, name in ((b"\xef\xbb\xbf", "utf-8", "utf-8"), (b"\xff\xfe", "utf-16-le", "utf-16le"), (b"\xfe\xff", "utf-16-be", "utf-16be")):
        if data.startswith(mark):
            s = data[len(mark) :].decode(codec, "replace")
            return s, name, share(s) > LOSSY
    plain = data.decode("utf-8", "replace")
    if share(plain) < LOSSY:
        return plain, "utf-8", share(plain) > 0
    other = data.decode("gb18030", "replace")
    best = ("gb18030", other) if share(other) < share(plain) else ("utf-8", plain)
    return best[1], best[0], share(best[1]) > LOSSY


def _decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(bytes(b) if b is not None else b"") for b in content], columns=["text", "encoding", "lossy"], dtype=object)


def decoded(content: Column) -> Column:
    """struct<text, encoding, lossy>: encodings need Python's codecs."""
    return F.pandas_udf(_decoded, DECODED)(content)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, format, content) of the files under a path; format is null for what no reader takes."""
    src = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"[^/]*\z", 0)
    return src.select(name.alias("name"), file_format(name).alias("format"), "content")


def file_format(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), t.extension(name))


def chunks(text: Column) -> Column:
    """Paragraphs between blank lines; with fewer than two of them, the lines, if there are more; blank ones left out."""
    full = lambda a: F.filter(F.transform(a, t.trim), lambda x: x != "")

    def cut(s: Column) -> Column:
        lines = t.let(full(F.split(s, "\n")), lambda l: F.when(F.size(l) > 1, l).when(s != "", F.array(s)).otherwise(F.array().cast("array<string>")))
        return t.let(full(F.split(s, "\n{2,}")), lambda p: F.when(F.size(p) > 1, p).otherwise(lines))

    return t.let(t.trim(F.regexp_replace(t.strip_bom(text), "\r\n?", "\n")), cut)


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, block_idx, block_id, type, content) of plain texts; a text without readable blocks gives no row."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(chunks(F.coalesce(F.col(text), F.lit("")))).alias("block_idx", "raw"))
    content = t.trim(F.regexp_replace(F.regexp_replace("raw", "\n", " "), f"[{t.WS}]{{2,}}", " "))
    block_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("-b"), F.col("block_idx").cast("string"))
    return src.select("doc_id", "block_idx", block_id.alias("block_id"), t.block_type(F.col("raw")).alias("type"), content.alias("content"))
