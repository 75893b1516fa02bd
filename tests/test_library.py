"""Functions, readers and operators on small literal inputs, and against plain Python models."""

import io
import random
import re
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import hashes, registry
from quire.functions import text as t
from quire.operators import anchors, documents, evaluate, glyphs, layout, pages
from quire.sources import epub, html, markdown, plain, reader
from quire.streaming import state


@pytest.fixture(scope="module")
def value(spark):
    """The value of an expression over literals."""

    def of(expr, **cols):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(1).alias("one")])
        return df.select(expr.alias("v")).first().v

    return of


def test_text(value):
    c = F.col("x")
    assert value(t.len16(c), x="a😀") == 3
    assert value(t.trim(c), x="　﻿ a  \n") == "a"
    assert value(t.extension(c), x="A.b.TXT") == ".txt" and value(t.extension(c), x="none") == ""
    assert value(t.title_from_file(c), x="my_great-book  v1.md") == "my great book v1"
    assert value(t.block_type(c), x="# T") == "heading" and value(t.block_type(c), x="> a\n> b") == "quote" and value(t.block_type(c), x="第三章 x") == "heading"
    assert value(t.detect_language(c), x="  ") == "zh" and value(t.detect_language(c), x="か" * 21) == "ja" and value(t.detect_language(c), x="plain") == "en"
    assert value(t.normalize_anchor(c), x=" #My%20Head-ing (x)") == "myheadingx" and value(t.normalize_anchor(c), x="a+b%zz") == "a+b%zz"
    assert value(t.looks_like_heading(c), x="1.2 Scope") and not value(t.looks_like_heading(c), x="Done!")
    assert value(t.join_text(c, F.lit("b")), x="a") == "a b" and value(t.join_text(c, F.lit("b")), x="中") == "中b"
    assert value(t.dehyphenate(c, F.lit("national")), x="inter-") == "international" and value(t.dehyphenate(c, F.lit("ray")), x="X-") is None
    assert value(t.escape_latex(c), x="a_b%{c}$\\") == "a\\_b\\%\\{c\\}\\$\\backslash "
    assert value(t.inline_latex(c), x=" x_1 ") == "$x\\_1$" and value(t.inline_latex(c), x="$y$") == "$y$"
    assert value(t.fold_match(c), x="０，其 他") == "0,其他"
    assert value(t.is_subsequence(F.lit("ace"), c), x="abcde") and not value(t.is_subsequence(F.lit("aec"), c), x="abcde")
    assert value(t.richer_reading(c, F.lit("e-λax=")), x="e-x") and not value(t.richer_reading(c, F.lit("ex")), x="ex")
    assert value(t.drop_dangling_marks(c), x="a^ b_2 c_") == "a b_2 c"
    assert value(t.origin_allowed(c, F.array(F.lit("https://*.a.com"))), x="https://b.a.com") and not value(t.origin_allowed(c, F.array(F.lit("*"))), x="https://b.a.com")
    assert value(t.duration(c), x=75.0) == "1 分 15 秒" and value(t.round_half_up(c, 0), x=-2.5) == -2.0
    assert value(t.primary_tag(c), x="zh-CN") == "zh" and value(t.deepl_target(c), x="en") == "EN-US"
    assert value(t.punctuation_only(c), x="{ (") and not value(t.punctuation_only(c), x="a)")


def pack(s, most, ends, hard, tidy, whole):
    if whole and len(s) <= most:
        return [s]
    out, buf = [], ""
    strip = (lambda x: x.strip()) if tidy else (lambda x: x)
    for p in re.split(f"(?<=[{ends}])", s):
        if len(buf + p) > most and buf:
            out.append(strip(buf))
            buf = ""
        if hard and len(p) > most:
            out += [strip(p[i : i + most]) for i in range(0, len(p), most)]
        else:
            buf += p
    return [x for x in [*out, strip(buf)] if x.strip()]


def test_packing(spark):
    rnd = random.Random(3)
    rows = ["", "  ", *["".join(rnd.choice("ab .。!;\n") for _ in range(rnd.randint(1, 120))) for _ in range(80)]]
    df = spark.createDataFrame([(x,) for x in rows], "s string")
    got = df.select("s", t.pack_for_speech(F.col("s"), 20).alias("a"), t.pack_for_pages(F.col("s"), 20).alias("b"), t.pack_for_chapters(F.col("s"), 20).alias("c")).collect()
    for r in got:
        assert r.a == pack(r.s, 20, "。！？!?.;；\n", True, False, True) or len(r.s) <= 20
        assert r.b == pack(r.s, 20, "。！？!?.;；", True, True, False)
        assert r.c == pack(r.s, 20, "。！？!?.;；", False, True, False)


def test_hashes(value):
    def fnv(s, h, p, bits):
        u = s.encode("utf-16-be")
        for i in range(0, len(u), 2):
            h = ((h ^ int.from_bytes(u[i : i + 2], "big")) * p) % (1 << bits)
        return h

    for s in ("", "a", "a中😀", "x" * 300):
        assert value(hashes.fnv32(F.col("x")), x=s) == f"{fnv(s, 0x811C9DC5, 16777619, 32):08x}"
        assert value(hashes.fnv64(F.col("x")), x=s) == f"{fnv(s, 14695981039346656037, 1099511628211, 64):016x}"


def test_readers(spark, value):
    assert plain.decode_bytes("é".encode()) == ("é", "utf-8", False)
    assert plain.decode_bytes(b"\xfe\xff\x4e\x2d") == ("中", "utf-16be", False) and plain.decode_bytes(b"\xff\xfe\x2d\x4e")[1] == "utf-16le"
    assert plain.decode_bytes("中文文本".encode("gb18030"))[:2] == ("中文文本", "gb18030")
    title, blocks = markdown.parse("---\ntitle: 'T'\n---\n# H *e*\n\np **b** `c` [l](#x) [[#y|z]] ==m==\n\n> [!note] N\n> body\n\n- a\n  1. b\n- [x] c\n\n| a | b |\n|:-|-:|\n| 1 | 2 |\n\n```py\nx=1\n```\n\n$$\ny\n$$\n\n---\n![alt](i.png)\n\nSet\n===")
    assert title == "T" and [b["type"] for b in blocks] == "heading paragraph callout list table code math divider image heading".split()
    assert blocks[0]["content"] == "H e" and blocks[1]["content"] == "p b c l z m"
    assert [(s["kind"], s["href"]) for s in blocks[1]["spans"]] == [("strong", None), ("code", None), ("link", "#x"), ("wikilink", "#y"), ("mark", None)]
    assert all(blocks[1]["content"][s["start"] : s["end"]] for s in blocks[1]["spans"])
    assert [(i["text"], i["indent"], i["marker"], i["checked"]) for i in blocks[3]["items"]] == [("a", 0, "•", None), ("b", 1, "1.", None), ("c", 0, "•", True)]
    assert blocks[4]["align"] == ["left", "right"] and blocks[5]["lang"] == "py" and blocks[6]["content"] == "y"
    assert markdown.math_delimiters("\\(a\\) `\\(b\\)`\n```\n\\[c\\]\n```\n\\[d\\]") == "$a$ `\\(b\\)`\n```\n\\[c\\]\n```\n$$d$$"
    got = html.parse("<h2>A  b</h2><p>x<b>y</b></p><ul><li>1</li><li><p>2</p></li></ul><pre class='language-js'>a\n b</pre><figure><img src=u alt=w></figure><script>n</script>")
    assert [(b["type"], b["content"]) for b in got] == [("heading", "A b"), ("paragraph", "xy"), ("list", "- 1\n- 2"), ("code", "a\n b"), ("image", "w")] and got[0]["level"] == 2 and got[4]["src"] == "u"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='o/c.opf'/></rootfiles></container>")
        z.writestr("o/c.opf", "<package><metadata><title>Book</title></metadata><manifest><item id='a' href='a.html'/><item id='b' href='gone.html'/></manifest><spine><itemref idref='b'/><itemref idref='a'/></spine></package>")
        z.writestr("o/a.html", "<h1>One</h1><p>two</p>")
    assert [b["content"] for b in epub.read(data.getvalue())[1]] == ["One", "two"]
    files = spark.createDataFrame([("a.txt", b"x\n\ny"), ("b.md", b"# h"), ("c.epub", data.getvalue()), ("d.epub", b"no"), ("e.bin", b"1"), ("f.txt", b"  "), ("g.pdf", b"%")], "name string, content binary")
    rows = {}
    for r in reader.read(files).collect():
        rows.setdefault(r.name, []).append((r.content, r.error is None))
    assert sorted(rows["a.txt"]) == [("x", True), ("y", True)] and rows["b.md"] == [("h", True)] and len(rows["c.epub"]) == 2
    assert all(not rows[n][0][1] for n in ("d.epub", "e.bin", "f.txt", "g.pdf"))
    assert value(reader.selected_pages(F.col("x"), F.lit(9)), x="3, 7-5,99") == [3, 5, 6, 7] and value(reader.selected_pages(F.col("x"), F.lit(2)), x="") == [1, 2] and value(reader.selected_pages(F.col("x"), F.lit(9)), x="a") is None
    assert value(reader.aligned_classes(F.array(*map(F.lit, ["a", "b", "", ""])), 5)) == ["", "a", "b", "", ""]
    assert len(value(reader.hocr_boxes(F.col("x")), x="x_bboxes 1 2 3 4; x_bboxes 1 1 1 2")) == 1
    gate = lambda s: tuple(value(reader.export_gate(F.col("x"), "s", 2, "old"), x=s))
    assert gate('{"schema":"s","schemaVersion":2}') == ("current", None) and gate('{"kind":"old"}') == ("downgraded", None)
    assert gate('{"schema":"s","schemaVersion":3}') == ("rejected", "other_version") and gate("{")[1] == "not_json" and gate("[1]")[1] == "not_an_object"


def test_documents(spark):
    parts = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(c).alias("content")) for k, c in (("paragraph", "a"), ("paragraph", "b."), ("paragraph", "c"), ("heading", "d"))])
    assert [tuple(x) for x in spark.range(1).select(documents.merge_adjacent(parts).alias("v")).first().v] == [("paragraph", "a b."), ("paragraph", "c"), ("heading", "d")]
    blocks = plain.blocks(spark.createDataFrame([(1, "# One two\ntext\n# One-two")], "doc_id long, text string"))
    links = spark.createDataFrame([(1, "#one-two"), (1, "#nothing"), (1, "")], "doc_id long, link string")
    assert {r.link: r.block_idx for r in documents.jump_targets(links, blocks).collect()} == {"#one-two": 0, "#nothing": -1, "": -1}
    marks = spark.createDataFrame([(1, 5, "definition", "b"), (1, 2, "reference", "a"), (1, 9, "reference", "c"), (1, 1, "definition", "z")], "doc_id long, pos long, kind string, name string")
    assert {r.name: r.number for r in documents.footnote_numbers(marks).collect()} == {"a": 1, "c": 2, "z": 3, "b": 4}
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, at long, v string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 0, "d"), (3, 0, "e")], "k long, at long, v string")
    once = documents.upsert(old, new, ["k"], "at")
    assert sorted(map(tuple, once.collect())) == [(1, 1, "c"), (2, 1, "b"), (3, 0, "e")] == sorted(map(tuple, documents.upsert(once, new, ["k"], "at").collect()))
    notes = spark.createDataFrame([(1, "n1", "b1", "note", "sel", "hi", ["Tag"], "2"), (1, "n2", "b1", "mark", "", "", [], "1")], "doc_id long, id string, block_id string, type string, selected_text string, content string, tags array<string>, created_at string")
    assert documents.search_annotations(notes, "TAG", "note").count() == 1
    out = documents.exported(notes, spark.createDataFrame([("b1", "block")], "block_id string, content string")).first()
    assert out.markdown == "> block\n\n> sel\n\nhi" and out.json.startswith('[{"id":"n2"')


def test_anchors(value):
    s, text = F.col("s"), "0123456789 the stone 0123456789"
    a = anchors.make_anchor(F.lit(text), F.lit(11), F.lit(20))
    at = lambda x: (lambda r: r and tuple(r))(value(anchors.resolve_anchor(a, s), s=x))
    assert at(text) == (11, 20) and at("zz" + text) == (13, 22) and at(text.replace("stone", "st0ne")) == (11, 20)
    assert at("nothing of it") is None
    parse = lambda x: (lambda r: r and tuple(r))(value(anchors.parse_locator(F.col("x")), x=x))
    assert parse("doc:a/page:2/block:3/char:4+5") == ("a", 2, 3, 4, 5) and parse("doc:a/block:3/char:12-15") == ("a", None, 3, 12, 3) and parse("doc:a/block:3/char:7") == ("a", None, 3, 7, 0)
    assert parse("doc:a/block:-1/char:1+1") is None and parse("doc:a/block:1/char:x") is None and parse("x") is None and parse("doc:a/page:z/block:1/char:1") is None


def test_segments_cover_the_text(spark):
    rnd = random.Random(1)
    texts = [(b, rnd.randint(1, 60)) for b in range(20)]
    ranges = [(b, k, *sorted((rnd.randint(0, 70), rnd.randint(0, 70)))) for b, _ in texts for k in range(4)]
    got = anchors.segments(spark.createDataFrame(texts, "block_id int, n int"), spark.createDataFrame(ranges, "block_id int, id int, start int, end int")).collect()
    for b, n in texts:
        segs = sorted((r.start, r.end, r.ids) for r in got if r.block_id == b)
        assert segs[0][0] == 0 and segs[-1][1] == n and all(x[1] == y[0] and x[2] != y[2] for x, y in zip(segs, segs[1:], strict=False))
        for s, e, ids in segs:
            assert all(sorted(k for c, k, x, y in ranges if c == b and x <= p < y) == ids for p in range(s, e))


def test_geometry(value):
    a, b = (g.box(*map(F.lit, x)) for x in ((0, 0, 10, 10), (5, 5, 15, 15)))
    assert value(g.iou(a, b)) == 25 / 175 and value(g.overlap_of_smaller(a, b)) == 0.25 and value(g.centre_inside(a, b)) == 1 and value(g.gap(a, g.box(*map(F.lit, (0, 14, 1, 20))))) == 4
    assert tuple(value(g.padded(a))) == (-10, -16, 20, 26) and value(g.same_line(a, b)) and tuple(value(g.clipped(a, b))) == (5, 5, 10, 10)
    assert value(g.page_limit(F.lit(2.7), F.lit(9))) == 2 and value(g.page_limit(F.lit(float("nan")), F.lit(9))) == 9
    assert value(g.render_scale(F.lit(600.0), F.lit(800.0))) == 200 / 72 and value(g.render_scale(F.lit(6000.0), F.lit(8000.0))) < 1


def region_model(word, regions):
    best, cover = None, 0.0
    area = (word[2] - word[0]) * (word[3] - word[1])
    for r in regions:
        w, h = min(word[2], r["x1"]) - max(word[0], r["x0"]), min(word[3], r["y1"]) - max(word[1], r["y0"])
        if w <= 0 or h <= 0 or w * h / area < 0.5:
            continue
        c = w * h / area
        if best is None or c > cover + 0.05 or (abs(c - cover) <= 0.05 and (r["score"] > best["score"] or (r["score"] == best["score"] and r["class_id"] < best["class_id"]))):
            best, cover = r, c
    return best and best["idx"]


def test_layout(spark, value):
    rnd = random.Random(2)
    regions, words = [], []
    for p in range(15):
        for i in range(8):
            x, y = rnd.randint(0, 60), rnd.randint(0, 60)
            k = rnd.randint(0, 22)
            regions.append((1, p, i, k, layout.LABELS[k], rnd.choice([0.5, 0.7]), float(x), float(y), float(x + rnd.randint(10, 60)), float(y + rnd.randint(10, 60))))
        for i in range(20):
            x, y = rnd.randint(0, 90), rnd.randint(0, 90)
            words.append((1, p, i // 4, i, float(x), float(y), float(x + 12), float(y + 8)))
    r = spark.createDataFrame(regions, "doc_id long, page int, idx int, class_id int, label string, score double, x0 double, y0 double, x1 double, y1 double")
    w = spark.createDataFrame(words, "doc_id long, page int, line int, word int, x0 double, y0 double, x1 double, y1 double")
    names = ["doc_id", "page", "idx", "class_id", "label", "score", "x0", "y0", "x1", "y1"]
    by = {p: [dict(zip(names, x, strict=True)) for x in regions if x[1] == p] for p in range(15)}
    got = layout.assign(w, r).collect()
    assert all(x.region == region_model((x.x0, x.y0, x.x1, x.y1), by[x.page]) for x in got) and any(x.region is not None for x in got)
    flat = [2.0, 0.9, 50.0, 40.0, 10.0, 20.0, 1.0, 0.1, 0.0, 0.0, 1.0, 1.0]
    d = value(layout.decode(F.array(*map(F.lit, flat)), F.lit(2), F.lit(100.0), F.lit(100.0)))
    assert d.code == "none" and [tuple(x) for x in d.regions] == [(2, "text", 0.9, 10.0, 20.0, 50.0, 40.0)]
    assert value(layout.decode(F.array(*map(F.lit, [2.0, 0.9, 150.0, 0.0, 200.0, 9.0])), F.lit(1), F.lit(100.0), F.lit(100.0))).code == "outside"
    two = F.array(*[F.struct(F.lit("text").alias("label"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(x + 200.0).alias("x1"), F.lit(y + 9.0).alias("y1")) for x, y in ((50, 0), (52, 20), (330, 0), (331, 20))])
    assert value(layout.columns_of(two, F.lit(600.0))) == [50.0, 330.0] and value(layout.columns_of(two, F.lit(6000.0))) is None
    assert value(layout.column_index(F.lit(329.5), F.array(F.lit(50.0), F.lit(330.0)))) == 1
    claim = lambda s, font, label: value(layout.heading_claim(F.lit(s), F.lit(font), F.lit(10.0), F.lit(label)))
    assert claim("1. Scope", 13.0, None) == "text" and claim("Scope of it", 12.0, "doc_title") == "layout" and claim("Scope", 12.0, "text") is None
    assert tuple(value(layout.heading_disposition(F.lit("1. Scope"), F.lit(13.0), F.lit(10.0), F.lit("table"), ["table"]))) == (False, "layout_says_not_heading")


def test_evaluation(spark):
    box = lambda p, i, label, x: (1, p, i, label, x, 0.0, x + 10.0, 10.0)
    schema = "doc_id long, page int, idx int, label string, x0 double, y0 double, x1 double, y1 double"
    truth = spark.createDataFrame([box(1, 0, "text", 0.0), box(1, 1, "text", 2.0), box(1, 2, "table", 50.0), box(2, 0, "text", 0.0)], schema)
    pred = spark.createDataFrame([box(1, 0, "text", 1.0), box(1, 1, "text", 100.0), box(1, 2, "text", 3.0), box(2, 0, "table", 0.0)], schema)
    rows = {r.label: r for r in evaluate.by_label(truth, pred).collect()}
    assert len(rows) == len(layout.LABELS) + 1
    assert (rows["text"].tp, rows["text"].fp, rows["text"].fn) == (2, 1, 1) and rows["text"].precision == 0.6667 and rows["seal"].precision is None
    assert (rows["micro"].tp, rows["micro"].fp, rows["micro"].fn) == (2, 2, 2)
    assert tuple(evaluate.gate(evaluate.by_label(truth, pred), ["text", "seal"], 0.5, 0.5).first()) == (False, ["seal"])
    assert evaluate.by_label(truth, evaluate.scrambled(truth, "text", "table")).filter("label = 'text'").first().tp == 0
    assert evaluate.report(evaluate.by_label(truth, pred)).first().markdown.count("\n") == 25


def test_pages(spark):
    items = [(1, 1, i, s, x, y, h) for i, (s, x, y, h) in enumerate([("b", 20.0, 700.3, 10.0), ("a ", 0.0, 700.0, 10.0), ("c.", 0.0, 686.0, 10.0), ("d", 0.0, 672.0, 10.0), ("TITLE", 0.0, 640.0, 18.0), ("e", 0.0, 610.0, 10.0)])]
    made = pages.lines(spark.createDataFrame(items, "doc_id long, page int, idx int, s string, x double, y double, h double"))
    assert [r.text for r in made.orderBy("line").collect()] == ["a b", "c.", "d", "TITLE", "e"]
    got = pages.blocks(pages.paragraphs(made)).orderBy("paragraph").collect()
    assert [(r.type, r.content) for r in got] == [("paragraph", "a b c. d"), ("heading", "TITLE"), ("paragraph", "e")]


def test_glyphs(spark):
    scores = np.array([[0.1, 0.9, 0], [0.2, 0.8, 0], [0.9, 0.1, 0], [0, 0.1, 0.9]])
    assert [(c, s) for c, s, _ in glyphs.collapse(scores, ["", "a", "b"])] == [("a", 0.5), ("b", 3.0)]
    assert glyphs.align("abc", "axc") == [(0, 0), (1, 1), (2, 2)] and glyphs.align("ab", "b") == [(0, None), (1, 0)]
    assert glyphs.reconciles("abcdef", "abcxef") and not glyphs.reconciles("zz", "ab")
    cells = spark.createDataFrame([(1, 1, r, c, 1) for r, c in ((0, 0), (1, 1), (2, 2), (9, 9), (0, 5))], "doc_id long, page int, r int, c int, ink long")
    assert [(r.r0, r.c1, r.cells) for r in glyphs.ink_components(cells).collect()] == [(0, 2, 3)]
    words = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert glyphs.hole_ratio(cells, words).first().hole == 2 / 5
    regions = spark.createDataFrame([(1, 1, *map(float, b)) for b in ((0, 0, 10, 10), (1, 1, 9, 9), (8, 8, 20, 20), (0, 0, 10, 11))], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.x0, r.x1, r.n) for r in glyphs.merged_regions(regions).collect()] == [(0.0, 10.0, 3), (8.0, 20.0, 1)]
    new = spark.createDataFrame([(1, 1, i, *map(float, b)) for i, b in enumerate(((50, 0, 60, 10), (51, 0, 61, 10), (0, 0, 9, 9), (80, 0, 90, 10)))], "doc_id long, page int, idx int, x0 double, y0 double, x1 double, y1 double")
    old = words.withColumn("idx", F.lit(0))
    assert [r.idx for r in glyphs.admitted(new, old).collect()] == [0, 3]
    chars = spark.createDataFrame([(1, i, c, *map(float, y)) for i, (c, y) in enumerate((("x", (0, 10)), ("y", (0, 10)), ("z", (0, 10)), ("2", (0, 5)), ("3", (0, 5))))], "word int, idx int, char string, y0 double, y1 double")
    marked = glyphs.scripts(chars, ["word"])
    assert [(r.kind, r.first, r.text) for r in glyphs.script_runs(marked, ["word"]).collect()] == [("super", 3, "23")]


def test_registry(spark, value):
    assets = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "z", 30 << 20)], "tier string, id string, bytes long")
    have = spark.createDataFrame([("y",)], "id string")
    assert {r.tier: (r.bytes, r.code, r.blocked) for r in registry.preflight(assets, have, F.lit(5)).collect()} == {"a": (10, "insufficient-storage", True), "b": (30 << 20, "single-file-over-limit", True)}
    voices = spark.createDataFrame([(0, "v0", "en_GB", False), (1, "v1", "de-DE", True)], "idx int, name string, lang string, is_default boolean")
    pick = lambda name, lang: registry.pick_voice(voices, name, lang).first().name
    assert pick(None, "en-GB") == "v0" and pick(None, "en-US") == "v0" and pick("v1", "en-GB") == "v1" and pick(None, "fr") == "v1"
    ok, no = registry.admit_outbound(spark.createDataFrame([(1, 3.0, 10.0), (2, 3.1, 10.0), (3, None, 10.0)], "id int, area double, page_area double"))
    assert [r.id for r in ok.collect()] == [1] and sorted((r.id, r.reason) for r in no.collect()) == [(2, "too_large"), (3, "unmeasured")]
    rows = spark.createDataFrame([(1, 0, "b", "xx"), (1, 1, "a", "yyy"), (1, 2, "b", "z")], "doc_id int, pos int, label string, t string")
    assert registry.histogram(rows, ["doc_id"], "label", "pos").first().summary == "b×2、a×1"
    kept = registry.budgeted(rows, ["doc_id"], "pos", "t", 4).first()
    assert [x.t for x in kept.kept] == ["xx"] and kept.dropped == 2
    assert value(registry.same_set(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1)))) and value(registry.clamp(F.lit(float("nan")), 0, 2, 1)) == 1


def test_state(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("s", i, t0 + timedelta(minutes=m), f"e{i}") for i, m in enumerate((0, 10, 45, 50, 60, 61, 62))]
    events = spark.createDataFrame(rows, "k string, id int, ts timestamp, stage string")
    assert [r.id for r in state.last_stages(events, "k", "ts", "id").orderBy("age").collect()] == [6, 5, 4, 3, 2]
    assert sorted(r.id for r in state.trail(events, "k", "ts", "id").collect()) == [2, 3, 4, 5, 6]
    assert state.last_stage(events, "k", "ts", "id", "stage").first().stage == "e6"
    assert sorted(r.n for r in state.sessions(events, "k", "ts").collect()) == [2, 5]
    attempts = spark.createDataFrame([("a", "b1", t0, False), ("b", "b1", t0, False), ("c", "b1", t0, True)], "session string, build string, at timestamp, finished boolean")
    assert tuple(state.crashes(attempts, spark.createDataFrame([("b",)], "session string")).first())[:2] == ("b1", 1)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for again in ("one", "two"):  # a run that starts anew replaces its batches
        q = state.checkpointed(stream, str(tmp_path / "out"), str(tmp_path / again), ["k", "id"], "ts")
        q.awaitTermination()
    assert state.latest(spark.read.parquet(str(tmp_path / "out")), ["k", "id"], "ts").count() == 7
    q = state.windowed(stream, "ts", "30 minutes", "10 minutes", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [2, 2, 3]


def test_notes(spark):
    from quire.operators import notes

    blocks = spark.createDataFrame([("d", "b0", 0, "one two three"), ("d", "b1", 1, "xx four five"), ("d", "b2", 2, "six seven")], "doc_id string, block_id string, block_idx int, content string")
    place = lambda text, offset: ("", "", offset, len(text), text)
    rows = [("n1", "d", "b0", place("two", 4)), ("n2", "d", "b1", place("four", 0)), ("n3", "d", "b0", place("seven", 0)), ("n4", "d", "gone", place("nine", 0)), ("n5", "d", "b0", None), ("n6", "d", "b2", place("eight", 1))]
    src = spark.createDataFrame(rows, "id string, doc_id string, block_id string, anchor struct<prefix:string,suffix:string,offset:int,length:int,selected:string>")
    got = {r.id: (r.code, r.locator) for r in notes.migrated(src, blocks).collect()}
    assert got == {"n1": ("exact", "doc:d/block:0/char:4+3"), "n2": ("repaired", "doc:d/block:1/char:3+4"), "n3": ("moved", "doc:d/block:2/char:4+5"), "n4": ("block-missing", None), "n5": ("no-anchor", None), "n6": ("stale", None)}
    assert tuple(notes.migration_counts(notes.migrated(src, blocks)).first()) == ("d", 3, 3)
    found = notes.by_locator(spark.createDataFrame([("a", "doc:d/block:1/char:3+4", "four"), ("b", "doc:d/block:9/char:0+1", "x"), ("c", "?", "x")], "id string, locator string, selected string"), blocks)
    assert {r.id: r.code for r in found.collect()} == {"a": "exact", "b": "block-missing", "c": "no-anchor"}
