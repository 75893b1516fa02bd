"""Every query that has SQL gives the SQL's rows on the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(norm(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, s) in QUERIES.items() if s])
def test_matches_sql(spark, sql, name):
    f, text = QUERIES[name]
    df = f(spark, SF)
    cols = sorted(df.columns)
    want = sql.sql(text)
    assert sorted(want.columns) == cols
    got = sorted((norm(tuple(r[c] for c in cols)) for r in df.collect()), key=str)
    assert got == sorted((norm(r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)


@pytest.mark.parametrize("name", [n for n, (_, s) in QUERIES.items() if not s])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, SF).count() > 0


def fnv(text, bits=32):
    h, prime = ((2166136261, 16777619), (14695981039346656037, 1099511628211))[bits == 64]
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[i : i + 2], "big")) * prime % (1 << bits)
    return h


def test_hashes_read_the_whole_text(spark, tmp_path):
    texts = ["x" * 300 + end for end in ("", "a", "b", "é😀")] + ["", "短" * 5000]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fnv32, r.fnv64) for r in QUERIES["hashes_of_whole_texts"][0](spark, str(tmp_path)).collect()}
    assert got == {i: (f"{fnv(t):08x}", f"{fnv(t, 64):016x}") for i, t in enumerate(texts)}
    keys = QUERIES["cache_keys"][0](spark, str(tmp_path)).collect()
    assert {r.doc_id: int(r.short, 36) for r in keys} == {i: fnv(t) for i, t in enumerate(texts)}
    assert len({r.key for r in keys}) == len(texts)


def test_page_items_are_all_words(spark, tmp_path):
    turns = [(1, 0, " ".join(f"a{i}" for i in range(130))), (1, 1, "b0 b1"), (2, 0, "c")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("page_lines", "page_paragraphs"):
        rows = QUERIES[name][0](spark, str(tmp_path)).collect()
        got = sorted(w for r in rows for v in r.asDict().values() if isinstance(v, str) for w in v.split() if w[0] in "abc" and (len(w) == 1 or w[1:].isdigit()))
        assert got == sorted(w for _, _, t in turns for w in t.split())


def test_scalars_of_every_line(spark, tmp_path):
    text = "# A heading\n50% of a + b\n" + "<" * 100 + "\nthe%20end"
    spark.createDataFrame([(1, text, "web", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.line_idx: r for r in QUERIES["line_scalars"][0](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].heading and not got[1].heading
    assert got[1].xml == "50% of a + b" and got[2].xml == "&lt;" * 100
    assert got[0].anchor == "aheading" and got[3].anchor == "theend"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
