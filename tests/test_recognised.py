"""Recognised pages, crops, formulas by cases, stored tables and reports, on small cases made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import crops, piecewise
from quire.operators import notes, recognised, reports, store
from quire.streaming import state


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def boxed(x0, y0, x1, y1):
    return F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


WORD = "doc_id string, page int, word long, text string, confidence double, font double, x0 double, y0 double, x1 double, y1 double"


def page(rows, font=12.0):
    """Lines of texts to words: (text, y) or (text, y, font, x)."""
    out = []
    for r in rows:
        text, y, f, x = (*r, *(font, 0.0)[len(r) - 2 :]) if len(r) < 4 else r
        for k, w in enumerate(text.split(" ")):
            out.append(("d", 1, len(out), w, 80.0, f, x + 50.0 * k, float(y), x + 50.0 * k + 45, float(y) + f))
    return out


def test_words_to_lines_and_blocks(spark):
    rows = page([("CHAPTER ONE", 0, 20.0, 0.0), ("the river runs to the sea", 40, 12.0, 0.0), ("and on-", 54, 12.0, 0.0), ("ward.", 68, 12.0, 0.0), ("1. first thing", 82, 12.0, 0.0), ("2. second thing", 96, 12.0, 0.0)])
    rows[3] = (*rows[3][:7], rows[3][7] + 3, rows[3][8], rows[3][9] + 3)  # a little lower, the same line
    words = spark.createDataFrame(rows[::-1], WORD)
    made = recognised.lines(words)
    got = [r.text for r in made.orderBy("line").collect()]
    assert got == ["CHAPTER ONE", "the river runs to the sea", "and on-", "ward.", "1.first thing", "2.second thing"]
    b = [(r.type, r.content, r.confidence, r.lines) for r in recognised.blocks(made).orderBy("block").collect()]
    assert b == [("heading", "CHAPTER ONE", 80, 1), ("paragraph", "the river runs to the sea and onward.", 80, 3), ("paragraph", "1.first thing", 80, 1), ("paragraph", "2.second thing", 80, 1)]
    assert recognised.lines(words.limit(0)).count() == 0


def test_lines_take_regions(spark):
    words = spark.createDataFrame(page([("page head", 0), ("left one", 30), ("left two", 60), ("right one", 31, 12.0, 300.0), ("right two", 61, 12.0, 300.0)]), WORD)
    words = words.withColumn("line", F.when(F.col("y0") == 0, 0).when(F.col("x0") < 300, F.col("y0") / 30).otherwise(F.col("y0") / 30 + 10).cast("int"))
    made = recognised.extent(words, ["doc_id", "page", "line"]).withColumn("text", F.lit("x"))
    regions = spark.createDataFrame([("d", 1, i, 2, lab, 0.9, float(x), float(y), float(x) + 120, float(y) + 20) for i, (lab, x, y) in enumerate([("header", 0, 0), ("text", 0, 28), ("text", 0, 58), ("text", 300, 29), ("text", 300, 59)])], "doc_id string, page int, idx int, class_id int, label string, score double, x0 double, y0 double, x1 double, y1 double")
    widths = spark.createDataFrame([("d", 1, 600.0)], "doc_id string, page int, width double")
    got = [(r.x0, r.y0, r.reordered) for r in recognised.laid_out(made, regions, widths).orderBy("line").collect()]
    assert got == [(0.0, 30.0, True), (0.0, 60.0, True), (300.0, 31.0, True), (300.0, 61.0, True)]
    part = recognised.laid_out(made, regions.filter("idx <> 4"), widths).collect()
    assert len(part) == 4 and not any(r.reordered for r in part)


def test_text_only_pages(spark):
    chunks = lambda s: [tuple(x) for x in one(spark, recognised.text_chunks(F.lit(s)))]
    assert chunks("第一章\r\n\r\nshort\n\nand more text that is long enough to stand\n\n") == [("heading", "第一章"), ("paragraph", "short and more text that is long enough to stand")]
    assert chunks("a long enough line that does end.\nnext\nword-") == [("paragraph", "a long enough line that does end."), ("paragraph", "next word-")]
    assert chunks("  \n ") == []


def test_tilted_lines(spark):
    rows = [("l", i, 12.0, 100.0 * i, 10.0 * i, 100.0 * i + 40, 10.0 * i + 12) for i in range(5)] + [("m", i, 12.0, 100.0 * i, 5.0, 100.0 * i + 40, 17.0) for i in range(5)]
    words = spark.createDataFrame(rows, "line string, word int, font double, x0 double, y0 double, x1 double, y1 double")
    fits = recognised.tilted(words, ["line"], F.lit(12.0))
    assert [(r.line, round(r.slope, 6)) for r in fits.collect()] == [("l", 0.1)]
    assert {(r.line, round(r.slope, 6)) for r in recognised.word_slopes(words, fits, ["line"]).collect()} == {("l", 0.1), ("m", 0.0)}
    assert recognised.off_line(words, fits, ["line"]).first().off  # base line by bottoms, distance by middles


def test_tilted_lines_at_the_limit(spark):
    """Residuals of 4.2 at a size of 12 are within 35 hundredths of it, though 12 * 0.35 is less in doubles: order 14108 at sf0.1."""
    words = [(1, 177, 8), (1, 159, 5), (6, 336, 24), (1, 279, 4), (4, 471, 15), (1, 490, 4), (4, 134, 16), (2, 231, 9)]
    rows = [("l", w, 12.0, float(x), float(x + 40), float(y)) for w, x, y in words]
    made = spark.createDataFrame(rows, "line string, word int, font double, x0 double, x1 double, y1 double")
    assert [(r.line, r.slope) for r in recognised.tilted(made, ["line"], F.lit(12.0)).collect()] == [("l", 0.025)]


def test_replacement(spark):
    word = lambda i, text, bad, box: F.struct(F.lit(i).alias("word"), F.lit(text).alias("text"), F.lit(bad).alias("garbage"), boxed(*box).alias("box"))
    new = lambda i, text, box: F.struct(F.lit(i).alias("word"), F.lit(text).alias("text"), boxed(*box).alias("box"))
    words = F.array(word(1, "zz", True, (0, 0, 10, 10)), word(2, "x＝1", False, (20, 0, 40, 10)), word(3, "--", False, (50, 0, 60, 10)), word(4, "far", False, (200, 0, 230, 10)))
    found = F.array(new(10, "x = 1, y", (18, 0, 45, 10)), new(11, "other", (205, 0, 235, 10)), new(12, "again", (20, 0, 44, 10)))
    r = one(spark, recognised.replacement(boxed(0, 0, 100, 20), words, found))
    assert [tuple(d) for d in r.drops] == [(1, "garbage"), (2, "duplicate"), (3, "fragment")] and r.kept == [4] and r.admitted == [10]
    none = one(spark, recognised.replacement(boxed(0, 0, 100, 20), words, F.filter(found, lambda _: F.lit(False))))
    assert none.kept == [1, 2, 3, 4] and none.drops == [] and none.admitted == []


def test_clusters(spark):
    rows = [("c", 0, 10.0, "f(x)", 10.0, 80.0, [1], 10.0, 20.0), ("c", 1, 0.0, "a = b c", 12.0, 90.0, [2, 3, 4], 0.0, 60.0), ("c", 2, 40.0, "0", 8.0, 70.0, [5], 40.0, 50.0)]
    made = spark.createDataFrame(rows, "k string, line int, y double, text string, font double, confidence double, words array<int>, y0 double, y1 double")
    assert recognised.primary_line(made, ["k"]).first().line == 1
    r = recognised.combined(made, ["k"]).first()
    assert r.words == [2, 3, 4, 1, 5] and r.y == 0.0 and r.font == pytest.approx(54 / 5) and r.confidence == 84.0


def test_ink(spark):
    rows = [(1, r, c, 1) for r in [*range(0, 10), *range(20, 26)] for c in range(20) if r not in (4,)] + [(1, 22, 0, 5)]
    cells = spark.createDataFrame(rows, "page int, r int, c int, ink int")
    areas = spark.createDataFrame([(1, 0.0, 100.0, 20, 40, 0.0), (2, 0.0, 0.0, 20, 40, 0.0)], "page int, x0 double, y0 double, cols int, rows int, font double")
    got = [(r.y0, r.y1) for r in recognised.ink_bands(cells, areas, ["page"]).orderBy("band").collect()]
    assert got == [(100.0, 140.0), (180.0, 204.0)]
    pixels = spark.createDataFrame([(1, x, y, 0 if x < 16 else 255) for x in range(32) for y in range(16)], "page int, x int, y int, luma int")
    sizes = spark.createDataFrame([(1, 32, 16), (2, 10, 10), (3, 0, 0)], "page int, width int, height int")
    stats = {r.page: (r.dark_ratio, r.mean_luma, r.failed) for r in recognised.ink_statistics(pixels, sizes, ["page"]).collect()}
    assert stats == {1: (0.5, 127.5, False), 2: (0.0, 255.0, True), 3: (0.0, 255.0, False)}
    assert {(r.x, r.y0, r.y1) for r in recognised.column_spans(pixels, ["page"]).collect()} == {(x, 0, 15) for x in range(16)}


def test_reflow(spark):
    rows = [(1, i, f"line {i} goes on", 0.0, 20.0 * i, 200.0 if i != 4 else 60.0, 20.0 * i + 15) for i in range(9)]
    made = spark.createDataFrame(rows, "page int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    got = [r.text for r in recognised.reflowed(made, ["page"]).orderBy("paragraph").collect()]
    assert got == [" ".join(f"line {i} goes on" for i in range(5)), " ".join(f"line {i} goes on" for i in range(5, 9))]
    assert recognised.reflowed(made.filter("line < 3"), ["page"]).count() == 3
    body = reports.assembled(recognised.reflowed(made, ["page"]).withColumn("doc", F.lit(1)), ["doc"], "page", "== N ==", True, "t").first().body
    assert body.startswith("<!-- t -->\n\n== 1 ==\n\nline 0") and body.endswith("line 8 goes on\n")


def test_crops(spark):
    box = boxed(10, 10, 60, 30)
    r = one(spark, crops.crop(box, F.lit(100), F.lit(100), F.lit(3.0), F.lit(1_000_000)))
    assert tuple(r) == (6, 6, 58, 28, 3.0, 174, 84)
    assert tuple(one(spark, crops.crop(box, F.lit(100), F.lit(100), F.lit(3.0), F.lit(0), None))) == (10, 10, 50, 20, 1.0, 50, 20)
    assert one(spark, crops.crop(boxed(200, 0, 210, 9), F.lit(100), F.lit(100), F.lit(3.0), F.lit(9))) is None
    assert one(spark, crops.shrink(F.lit(20), F.lit(20), F.lit(100))) == 0.5 and one(spark, crops.shrink(F.lit(0), F.lit(20), F.lit(100))) == 1.0
    chars = F.array(*[F.lit(c) for c in (" ", "a", "b", "", "c", " ")])
    assert one(spark, crops.gaps_only(chars, F.lit(0), F.lit(3))) and not one(spark, crops.gaps_only(chars, F.lit(1), F.lit(4)))
    assert tuple(one(spark, crops.trimmed_range(chars))) == (1, 5)
    assert one(spark, crops.scaled_down(F.lit("a"), F.lit(0), F.lit(7), F.lit(10))) and not one(spark, crops.scaled_down(F.lit("中"), F.lit(0), F.lit(7), F.lit(10)))
    assert not one(spark, crops.own_height_accepts(F.lit("a"), F.lit(0), F.lit(9), F.lit(10))) and one(spark, crops.own_height_accepts(F.lit("²"), F.lit(0), F.lit(9), F.lit(None)))
    raised = one(spark, crops.evidence_boxes(F.array(boxed(0, 0, 9, 20), boxed(10, 0, 14, 8), boxed(20, 1, 29, 21))))
    assert [b.x0 for b in raised] == [10.0]
    assert one(spark, crops.covered(boxed(0, 0, 10, 10), F.array(boxed(4, 4, 12, 12)))) and not one(spark, crops.covered(boxed(0, 0, 0, 10), F.array(boxed(0, 0, 1, 10))))
    assert one(spark, crops.straddles(boxed(0, 10, 20, 14), boxed(0, 10, 100, 50), F.array(boxed(5, 0, 15, 20))))


def test_formulas_by_cases(spark):
    f = lambda c, s, *a: one(spark, c(F.lit(s), *a))
    assert [tuple(x) for x in f(piecewise.constructs, "f(x) = {0 g = {1, 2")] == [("f(x) =", "0"), ("g =", "1, 2")]
    assert f(piecewise.constructs, "so f(x) = {0") is None and f(piecewise.constructs, "f = { g {") is None
    assert f(piecewise.branch_text, "^((1, x≥0)") == "(1, x≥0)" and f(piecewise.branch_text, "otherwise") is None and f(piecewise.branch_text, "{1") is None
    assert f(piecewise.to_latex, "50% λ≥x²") == r"50\% \lambda \ge x^{2}"
    assert f(piecewise.punctuation_char, ",") and not f(piecewise.punctuation_char, "−") and not f(piecewise.punctuation_char, "-")
    assert [tuple(x) for x in f(piecewise.script_pieces, "x²⁺y₁ n_1")] == [("x", None), ("²⁺", "^{2+}"), ("y", None), ("₁", "_{1}"), (" n_1", None)]
    assert [tuple(x) for x in f(piecewise.script_pieces, "n_1+a^{bc}", True)] == [("n", None), ("_1", "_{1}"), ("+a", None), ("^{bc}", "^{bc}")]
    assert [tuple(x) for x in f(piecewise.rendered, "is $a_1$ x²")] == [("is ", None), ("$a_1$", "a_1"), (" x", None), ("²", "^{2}")]


def test_note_candidates():
    s = "one fish two fish red fish blue fish"
    assert notes.places_of("aaa", "aa") == [0, 1]
    assert notes.shift("12345one fish", "one ", "fish", 4) == 5
    assert notes.candidates(s, "two ", "fish", 4) == {4: 1, 13: 0, 22: 1, 32: 1}
    assert notes.pick(s, "two ", "fish", 4) == 13
    assert notes.pick("0123456789fish", "", "fish", 0) == 10 and notes.pick("0fish", "", "fish", 0) is None
    assert notes.pick("fish______fish", "", "fish", 5) is None  # one is too near, the other as near as it


def test_notes_by_locator(spark):
    blocks = spark.createDataFrame([("d", "b0", 0, "zz one two three four"), ("d", "b1", 1, "seven eight"), ("e", "b0", 0, "seven")], "doc_id string, block_id string, block_idx int, content string")
    src = spark.createDataFrame([("a", "doc:d/block:0/char:4+3", "two", "one ")], "id string, locator string, selected string, prefix string")
    r = notes.by_locator(src, blocks).first()
    assert (r.code, r.start, r.end) == ("repaired", 7, 10)
    rows = [("n", "d", "gone", ("", "", 0, 5, "seven"))]
    lost = spark.createDataFrame(rows, "id string, doc_id string, block_id string, anchor struct<prefix:string,suffix:string,offset:int,length:int,selected:string>")
    r = notes.rebased(lost, blocks).first()
    assert (r.block_id, r.strategy, r.locator, r.anchor.suffix) == ("b1", "rebased", "doc:d/block:1/char:0+5", " eight")
    assert notes.resolved(lost, blocks, elsewhere=False).first().code == "block-missing"


def test_store(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, created int")
    blocks = spark.createDataFrame([("a", 1, "y", "paragraph"), ("a", 0, "x", "paragraph")], "doc_id string, block_idx int, block_id string, type string")
    got = store.loaded(docs, blocks).collect()
    assert [r.doc_id for r in got] == ["a"] and [b.block_id for b in got[0].blocks] == ["x", "y"]
    assert [r.doc_id for r in store.newest(docs).collect()] == ["b", "a"]
    made = spark.createDataFrame([("n1", "a", "x", 2), ("n2", "a", "y", 1), ("n3", "b", "z", 0)], "id string, doc_id string, block_id string, created_at int")
    assert [r.id for r in store.notes_of(made, "a").collect()] == ["n2", "n1"] and store.notes_of(made).count() == 3
    assert store.without_note(made, "n2").count() == 2 and store.cleared(made).count() == 0 and store.progress_of(docs, "a").count() == 1
    assert store.noted(blocks, made).count() == 2
    assert one(spark, store.block_index(F.array(F.lit("x"), F.lit("y")), F.lit("y"))) == 1 and one(spark, store.block_index(F.array(F.lit("x")), F.lit("y"))) == -1
    assert one(spark, store.page_of(F.lit(0))) is None and one(spark, store.page_of(F.lit(3))) == 3
    assert one(spark, store.item_id(F.lit("a"), F.lit(1), prefix="doc")) == one(spark, store.item_id(F.lit("a"), F.lit(1), prefix="doc"))
    assert one(spark, store.source_language(F.lit("de-DE"), F.lit("x"), F.lit("en"))) == "de" and one(spark, store.source_language(F.lit(None).cast("string"), F.lit("plain text"), F.lit("EN"))) is None


def test_reports(spark):
    o = one(spark, reports.outcome(F.lit("inference_failed"), F.lit(3), F.lit(1), F.lit(1), F.lit("why")))
    assert (o.used, o.regions, o.detail) == (False, None, "why") and set(reports.OUTCOMES) >= {"none", "no_regions_detected"}
    changes = reports.format_changes(spark, [("old", True, "gone")], ["a", "b"], {"a": (False, "renamed")})
    assert [tuple(r) for r in changes.collect()] == [("old", True, "gone"), ("a", False, "renamed"), ("b", False, "added")] and reports.breaks(changes).first().breaking
    e = json.loads(one(spark, F.to_json(reports.envelope("s", 2, "q", None, F.lit(True), ["a"], True))))
    assert e["producer"] == {"name": "q", "version": "unknown"} and e["document"]["is_full_document"] and e["breaking"]
    assert one(spark, reports.fingerprint({"a": 1})).startswith("7:")
    assert one(spark, reports.thresholds({"a": 1, "b": 2}, F.create_map(F.lit("b"), F.lit(3.0)))) == {"a": 1.0, "b": 3.0}
    assert one(spark, reports.record(F.lit('{"a":1}'))) == '{"a":1}' and one(spark, reports.record(F.lit("[1]"))) is None and one(spark, reports.record(F.lit("{"))) is None
    line = spark.range(1).select(F.lit(1).alias("n"), F.lit(None).cast("int").alias("m")).select(reports.metrics_line("metrics", "n", "m").alias("x")).first().x
    assert line == '[metrics] {"n":1,"m":null}'
    assert one(spark, reports.benchmark_problems(F.create_map(*[F.lit(x) for x in ("name", "n", "version", " ", "source", "s", "annotatedBy", "a", "annotatedAt", "t", "pageCount", "0")]))) == ["version", "pageCount"]
    assert [len(one(spark, reports.prediction_pages(F.lit(s)))) for s in ('[{"a":1}]', '{"pages":[1,2]}', '{"predictions":[]}', "x")] == [1, 2, 0, 0]
    assert one(spark, reports.quality_tier(F.lit(False))) == "fast" and one(spark, reports.boot_noteworthy(F.lit("ok"), F.array(), F.array(F.lit("c"))))
    engines = [("deepl", True, True, "deepl"), ("deepl", False, True, "browser"), ("browser", True, False, "deepl"), ("browser", False, False, None), (None, True, False, None)]
    for configured, cloud, browser, want in engines:
        assert one(spark, reports.initial_engine(F.lit(configured).cast("string"), F.lit(cloud), F.lit(browser))) == want


def test_state(spark):
    assert one(spark, state.remaining(F.lit(2), F.lit(9), F.lit(10))) is None and one(spark, state.remaining(F.lit(4), F.lit(8), F.lit(10))) == 10.0
    none = F.lit(None).cast("int")
    assert one(spark, state.signature(F.lit(1), none, none, F.lit(0), F.lit(5))) == "1|-|0|5" and one(spark, state.signature(F.lit(1), F.lit(3), F.lit(9), F.lit(0), F.lit(5))) == "1|3/9|0|5"
    assert state.reloads(spark.createDataFrame([("s",), ("s",)], "session string")).first().reloads == 2
    items = spark.createDataFrame([("v", i, None if i % 2 else 100.0) for i in range(20)], "v string, i int, h double")
    r = state.window(items, spark.createDataFrame([("v", 430, 200)], "v string, scroll int, viewport int"), ["v"], "i", "h", 2, 120.0).first()
    assert (r["first"], r.start, r.end, r.above, r.below) == (3, 1, 8, 100.0, 1320.0)
