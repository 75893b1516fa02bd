"""EPUB files: metadata, and blocks in the order of the spine.  A chapter that fails is skipped, an empty book is an error row."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.sources import html

ROW = "name string, title string, creator string, language string, block_idx int, type string, content string, level int, error string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read(data: bytes) -> tuple[dict, list[dict]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.attrib["full-path"] for e in box.iter() if _local(e.tag) == "rootfile")
    root, base = ElementTree.fromstring(z.read(opf)), posixpath.dirname(opf)
    meta = {k: next((e.text or "" for e in root.iter() if _local(e.tag) == k), "") for k in ("title", "creator", "language")}
    paths = {e.attrib.get("id"): e.attrib.get("href", "") for e in root.iter() if _local(e.tag) == "item"}
    found: list[dict] = []
    for ref in (e.attrib.get("idref") for e in root.iter() if _local(e.tag) == "itemref"):
        try:
            found += html.parse(z.read(posixpath.normpath(posixpath.join(base, unquote(paths[ref])))).decode("utf-8", "replace"))
        except (KeyError, zipfile.BadZipFile):
            continue
    return meta, found


def books(files: DataFrame) -> DataFrame:
    """files (name, content): one row a block, or one with the error."""

    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in ROW.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    meta, found = read(content.as_py() or b"")
                    rows = [{"name": name, **meta, "block_idx": i, "type": b["type"], "content": b["content"], "level": b["level"]} for i, b in enumerate(found)]
                    rows = rows or [{"name": name, **meta, "error": "no readable text"}]
                except Exception as e:  # any damage of a file is that file's error
                    rows = [{"name": name, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("name", "content").mapInArrow(run, ROW)
