"""The queries over the shared tables, and SQL that gives the same rows where SQL can.

Boxes, notes and page items are made from keys of the tables by plain arithmetic, the same in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import crops, hashes, piecewise
from quire.functions import geometry as g
from quire.functions import text as t
from quire.operators import anchors, documents, evaluate, layout, pages, recognised, reports, store
from quire.sources import html, plain
from quire.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


WS = r"[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRIM = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
CHAPTER = r"(?i)^(第[一二三四五六七八九十百千\d]+[章节回卷篇部]|chapter\s+\d+|序章|后记|尾声)"
COUNT = lambda x, c: f"len(regexp_extract_all({x}, '{c}'))"

#: Blocks of documents, as SQL: paragraphs, else lines, else the whole text.
BLOCKS = f"""
d as (select doc_id, {TRIM("regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')")} as s from documents),
c as (select doc_id, s, list_filter(list_transform(string_split_regex(s, '\\n{{2,}}'), lambda x: {TRIM('x')}), lambda x: x <> '') as p,
             list_filter(list_transform(string_split(s, chr(10)), lambda x: {TRIM('x')}), lambda x: x <> '') as l from d),
r as (select doc_id, case when len(p) > 1 then p when len(l) > 1 then l when s <> '' then [s] else [] end as a from c),
u as (select doc_id, unnest(a) as raw, unnest(range(0, len(a))) as block_idx from r),
b as (select doc_id, cast(block_idx as int) as block_idx, 'doc-' || doc_id || '-b' || block_idx as block_id,
        case when regexp_matches({TRIM("string_split(raw, chr(10))[1]")}, '^#{{1,6}}{WS}+') or regexp_matches({TRIM("string_split(raw, chr(10))[1]")}, '{CHAPTER}') then 'heading'
             when len(list_filter(string_split(raw, chr(10)), lambda x: not starts_with({TRIM('x')}, '>'))) = 0 then 'quote' else 'paragraph' end as type,
        {TRIM(f"regexp_replace(replace(raw, chr(10), ' '), '{WS}{{{{2,}}}}', ' ', 'g')".replace('{{', '{').replace('}}', '}'))} as content from u)"""

LANGUAGE = f"""case when {TRIM('substr(text, 1, 2000)')} = '' then 'zh'
  when {COUNT('substr(text, 1, 2000)', '[ぁ-ヿ]')} > 20 then 'ja' when {COUNT('substr(text, 1, 2000)', '[가-힯]')} > 20 then 'ko'
  when {COUNT('substr(text, 1, 2000)', '[一-鿿]')} > {COUNT('substr(text, 1, 2000)', '[A-Za-z]')} * 0.3 then 'zh' else 'en' end"""


@query(f"with {BLOCKS} select * from b")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.blocks(_read(spark, sf_dir, "documents", "doc_id", "text"))


@query(f"""with {BLOCKS} select doc_id, count(*) as n_blocks, count(*) filter (type = 'heading') as n_heading, count(*) filter (type = 'paragraph') as n_paragraph,
 count(*) filter (type = 'quote') as n_quote, cast(sum(length(regexp_replace(content, '{WS}', '', 'g'))) as bigint) as n_chars from b group by doc_id""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.summary(plain.blocks(_read(spark, sf_dir, "documents", "doc_id", "text")))


@query(f"select lang, {LANGUAGE} as detected, count(*) as n from documents group by all")
def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "lang", "text")
    return docs.groupBy("lang", t.detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


def _packing(ends: str, most: int, cut: bool, tidy: bool, whole: bool) -> str:
    tr = TRIM if tidy else (lambda x: x)
    hard = f"list_transform(range(0, cast(ceil(length(x.s) / {most}.0) as bigint)), lambda i: {tr(f'substr(x.s, i * {most} + 1, {most})')})"
    full = f"(length(acc.buf) + length(x.s) > {most} and acc.buf <> '')"
    out = f"case when {full} then list_append(acc.out, {tr('acc.buf')}) else acc.out end"
    buf = f"case when {full} then '' else acc.buf end"
    if cut:
        out = f"case when length(x.s) > {most} then list_concat({out}, {hard}) else {out} end"
        buf = f"case when length(x.s) > {most} then {buf} else {buf} || x.s end"
    else:
        buf = f"{buf} || x.s"
    keep = f"case when length(text) <= {most} then [text] else" if whole else "case when true then"
    parts = f"list_filter(regexp_extract_all(text, '[^{ends}]*[{ends}]?'), lambda p: p <> '')"
    return f"""with f as (select doc_id, text, list_reduce(list_transform({parts}, lambda p: {{'out': cast([] as varchar[]), 'buf': '', 's': p}}),
  lambda acc, x: {{'out': {out}, 'buf': {buf}, 's': ''}}, {{'out': cast([] as varchar[]), 'buf': '', 's': ''}}) as r from documents),
 p as (select doc_id, list_filter({keep} list_append(r.out, {tr('r.buf')}) end, lambda c: {TRIM('c')} <> '') as l from f)
 select doc_id, cast(len(l) as bigint) as n, cast(coalesce(list_max(list_transform(l, lambda c: length(c))), 0) as bigint) as longest, md5(array_to_string(l, chr(1))) as digest from p"""


def _packed(docs: DataFrame, chunks) -> DataFrame:
    got = docs.select("doc_id", chunks.alias("l"))
    longest = F.coalesce(F.array_max(F.transform("l", F.length)), F.lit(0)).cast("long")
    return got.select("doc_id", F.size("l").cast("long").alias("n"), longest.alias("longest"), F.md5(F.array_join("l", "\x01")).alias("digest"))


@query(_packing("。！？!?.;；\\n", 180, True, False, True))
def speech_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(_read(spark, sf_dir, "documents", "doc_id", "text"), t.pack_for_speech(F.col("text")))


@query(_packing("。！？!?.;；", 1200, True, True, False))
def page_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(_read(spark, sf_dir, "documents", "doc_id", "text"), t.pack_for_pages(F.col("text")))


@query(_packing("。！？!?.;；", 1500, False, True, False))
def chapter_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(_read(spark, sf_dir, "documents", "doc_id", "text"), t.pack_for_chapters(F.col("text")))


SCALARS = f"""with h as (select doc_id, text, string_split(text, chr(10))[1] as line, source || '-' || lang || '_file.v1.TXT' as name from documents)
select doc_id, lower(regexp_extract(name, '\\.[^.]*$')) as ext, {TRIM("regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '[_-]+', ' ', 'g'), '" + WS + "+', ' ', 'g')")} as title,
 length(regexp_replace(line, '{WS}', '', 'g')) as chars, length(line) <= 40 and not regexp_matches(line, '[。！？!?]$') and (regexp_matches(line, '^#{{1,6}}{WS}') or regexp_matches(line, '{CHAPTER}')
   or regexp_matches(line, '^\\d+(\\.\\d+)*[\\s、.]') or (regexp_matches(line, '^[A-Z][A-Z\\s\\d\\-:]{{3,}}$') and length(line) <= 30)) as heading,
 cast({COUNT('line', '[一-鿿㐀-䶿豈-﫿]')} as int) as cjk, cast({COUNT('line', '[=<>≤≥−±×÷√{}()\\[\\]-]')} as int) as notation,
 regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g') as alnum, {TRIM('line')} <> '' and not regexp_matches(line, '[A-Za-z0-9一-鿿Ͱ-Ͽ０-９Ａ-Ｚａ-ｚ]') as punctuation,
 replace(replace(replace(replace(replace(substr(line, 1, 80), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as xml,
 substr({TRIM("regexp_replace(text, '" + WS + "+', ' ', 'g')")}, 1, 40).replace('|', '\\|') as cell,
 regexp_replace(lower({TRIM('line')}), '{WS}+|[-_`*~"''“”‘’()（）\\[\\]【】]', '', 'g') as anchor
from h where not contains(line, '%') and not contains(line, '#') and not contains(line, '+')"""


@query(SCALARS)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    h = src.select("doc_id", "text", F.element_at(F.split("text", "\n"), 1).alias("line"), F.concat("source", F.lit("-"), "lang", F.lit("_file.v1.TXT")).alias("name"))
    line, name = F.col("line"), F.col("name")
    return h.filter(~line.rlike("[%#+]")).select(
        "doc_id", t.extension(name).alias("ext"), t.title_from_file(name).alias("title"), t.count_chars(line).alias("chars"), t.looks_like_heading(line).alias("heading"),
        t.cjk_count(line).alias("cjk"), t.notation_count(line).alias("notation"), t.alnum_sequence(line).alias("alnum"), t.punctuation_only(line).alias("punctuation"),
        t.escape_xml(F.substr(line, F.lit(1), F.lit(80))).alias("xml"), t.table_cell(F.col("text")).alias("cell"), t.normalize_anchor(line).alias("anchor"),
    )


@query(None)
def line_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalars of text_scalars of every line of every text, whole; text_scalars keeps to the first lines that its SQL can express."""
    src = _read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    h = src.select("doc_id", F.concat("source", F.lit("-"), "lang", F.lit("_file.v1.TXT")).alias("name"), F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    line, name = F.col("line"), F.col("name")
    return h.select(
        "doc_id", "line_idx", t.extension(name).alias("ext"), t.title_from_file(name).alias("title"), t.count_chars(line).alias("chars"), t.looks_like_heading(line).alias("heading"),
        t.cjk_count(line).alias("cjk"), t.notation_count(line).alias("notation"), t.alnum_sequence(line).alias("alnum"), t.punctuation_only(line).alias("punctuation"),
        t.escape_xml(line).alias("xml"), t.table_cell(line).alias("cell"), t.normalize_anchor(line).alias("anchor"),
    )


MASK = "18446744073709551616"


@query(f"""with x as (select doc_id, list_transform(string_split(substr(text, 1, 60), ''), lambda c: cast(unicode(c) as hugeint)) as u from documents)
select doc_id, lower(lpad(printf('%x', cast(list_reduce(list_prepend(cast(2166136261 as hugeint), u), lambda h, c: (xor(cast(h as bigint), cast(c as bigint))::hugeint * 16777619) % 4294967296) as bigint)), 8, '0')) as fnv32 from x""")
def hashes_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", hashes.fnv32(F.substr("text", F.lit(1), F.lit(60))).alias("fnv32"))


@query(None)
def hashes_of_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hashes_of_texts keeps to the 60 characters that its SQL folds."""
    text = F.col("text")
    return _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", hashes.fnv32(text).alias("fnv32"), hashes.fnv64(text).alias("fnv64"))


@query(None)
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return docs.select("doc_id", documents.cache_key(F.col("text"), F.col("lang")).alias("key"), hashes.fnv32_base36(F.col("text")).alias("short"))


@query("""with c as (select text as s, min(conv_id) as conv_id from conversations group by text)
select w.conv_id, w.turn, c.conv_id as first_conv from conversations w left join c on w.text = c.s""")
def verified_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("lang", F.lit("en"))
    seen = talk.groupBy("text").agg(F.min("conv_id").alias("translated"))
    cache = seen.select(documents.cache_key(F.col("text"), F.lit("en")).alias("id"), F.col("text").alias("source_text"), "translated")
    return documents.cached(talk, cache).select("conv_id", "turn", F.col("translated").alias("first_conv"))


ANCHORED = """with a as (select doc_id, text, cast((doc_id * 7) % greatest(length(text) - 30, 1) as int) as s from documents),
b as (select doc_id, text, s, substr(text, s + 1, 20) as sel, 'zz ' || replace(text, '  ', ' ') as now from a),
c as (select *, case when contains(substr(now, greatest(s - 40, 0) + 1), sel) then instr(substr(now, greatest(s - 40, 0) + 1), sel) + greatest(s - 40, 0) - 1 else -1 end as near, instr(now, sel) - 1 as far from b)"""


@query(f"""{ANCHORED} select doc_id, cast(case when substr(now, s + 1, length(sel)) = sel then s when near >= 0 then near when far >= 0 then far end as int) as start,
 substr(text, greatest(0, s - 15) + 1, s - greatest(0, s - 15)) as prefix, sel as selected from c where sel <> '' and (substr(now, s + 1, length(sel)) = sel or near >= 0 or far >= 0)""")
def anchors_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    s = ((F.col("doc_id") * 7) % F.greatest(F.length("text") - 30, F.lit(1))).cast("int")
    made = docs.select("doc_id", F.col("text"), s.alias("s")).withColumn("a", anchors.make_anchor(F.col("text"), F.col("s"), F.least(F.col("s") + 20, F.length("text"))))
    now = F.concat(F.lit("zz "), F.replace("text", F.lit("  "), F.lit(" ")))
    got = made.withColumn("r", anchors.resolve_anchor(F.col("a"), now)).filter(F.col("r").isNotNull() & (F.col("a.selected") != ""))
    return got.select("doc_id", F.col("r.start").alias("start"), F.col("a.prefix").alias("prefix"), F.col("a.selected").alias("selected"))


@query("""select doc_id, 'doc:' || doc_id || case when n_chars % 3 = 0 then '' else '/page:' || (n_chars % 9) end || '/block:' || (n_chars % 17) || '/char:' || (n_chars % 101) || '+' || (n_chars % 13) as locator,
 case when n_chars % 3 = 0 then null else n_chars % 9 end as page, n_chars % 17 as block, n_chars % 101 as char_offset, n_chars % 13 as char_length from documents""")
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    made = _read(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", anchors.make_locator(F.col("doc_id"), F.when(n % 3 != 0, n % 9), n % 17, n % 101, n % 13).alias("locator"))
    p = made.withColumn("p", anchors.parse_locator(F.col("locator")))
    return p.select("doc_id", "locator", F.col("p.page").alias("page"), F.col("p.block").alias("block"), F.col("p.offset").alias("char_offset"), F.col("p.length").alias("char_length"))


NOTES = """n as (select doc_id as block_id, k as id, cast((doc_id * 13 + k * 29) % n_chars as int) as s0, cast((doc_id * 13 + k * 29) % n_chars + 10 + k * 17 as int) as e0, n_chars from documents, (select unnest(range(0, 4)) as k)),
r as (select block_id, id, s0 as s, least(e0, cast(n_chars as int)) as e from n where least(e0, n_chars) > s0)"""


@query(f"""with {NOTES}, p as (select distinct block_id, x from (select doc_id as block_id, 0 as x from documents union all select doc_id, n_chars from documents union all select block_id, s from r union all select block_id, e from r)),
c as (select * from (select block_id, x as s, lead(x) over (partition by block_id order by x) as e from p) where e > s),
v as (select c.block_id, c.s, c.e, coalesce(list(r.id order by r.id) filter (r.id is not null), []) as ids from c left join r on r.block_id = c.block_id and r.s <= c.s and r.e >= c.e group by all),
i as (select *, sum(case when ids is distinct from prev then 1 else 0 end) over (partition by block_id order by s) as isle from (select *, lag(ids) over (partition by block_id order by s) as prev from v))
select block_id, cast(min(s) as int) as "start", cast(max(e) as int) as "end", array_to_string(any_value(ids), ',') as ids from i group by block_id, isle""")
def styled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "n_chars")
    n = docs.select(F.col("doc_id").alias("block_id"), "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("id"))
    start = ((F.col("block_id") * 13 + F.col("id") * 29) % F.col("n_chars")).cast("int")
    ranges = n.select("block_id", "id", start.alias("start"), (start + 10 + F.col("id") * 17).cast("int").alias("end"))
    segs = anchors.segments(docs.select(F.col("doc_id").alias("block_id"), F.col("n_chars").cast("int").alias("n")), ranges)
    return segs.select("block_id", "start", "end", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a = [F.col("l_partkey") % 97, F.col("l_suppkey") % 89]
    b = [F.col("l_partkey") % 83, F.col("l_suppkey") % 79]
    size = lambda k: F.col("l_linenumber") * k + 20
    return li.select("l_orderkey", "l_linenumber", g.box(a[0], a[1], a[0] + size(3), a[1] + size(2)).alias("a"), g.box(b[0], b[1], b[0] + size(5), b[1] + size(4)).alias("b"))


BOXES = """with x as (select l_orderkey, l_linenumber, l_partkey % 97 as ax0, l_suppkey % 89 as ay0, l_partkey % 97 + l_linenumber * 3 + 20 as ax1, l_suppkey % 89 + l_linenumber * 2 + 20 as ay1,
 l_partkey % 83 as bx0, l_suppkey % 79 as by0, l_partkey % 83 + l_linenumber * 5 + 20 as bx1, l_suppkey % 79 + l_linenumber * 4 + 20 as by1 from lineitem),
y as (select *, greatest(0.0::double, least(ax1, bx1) - greatest(ax0, bx0)) as ox, greatest(0.0::double, least(ay1, by1) - greatest(ay0, by0)) as oy, (ax1 - ax0) * (ay1 - ay0)::double as aa, (bx1 - bx0) * (by1 - by0)::double as ba from x)"""


@query(f"""{BOXES} select l_orderkey, l_linenumber, case when ox * oy > 0 then ox * oy / (aa + ba - ox * oy) else 0.0::double end as iou, ox * oy / least(aa, ba) as smaller, ox * oy / aa as containment,
 cast((ax0 + ax1) / 2.0 between bx0 and bx1 and (ay0 + ay1) / 2.0 between by0 and by1 as int) as centre, ox / least(ax1 - ax0, bx1 - bx0) as cover_x, oy / least(ay1 - ay0, by1 - by0) as cover_y,
 greatest(0.0::double, greatest(ay0, by0) - least(ay1, by1)) as gap, oy / least(ay1 - ay0, by1 - by0) >= 0.5 as same_line, ax0 - least(36, greatest(10, (ax1 - ax0) * 0.05::double)) as pad_x0, ay1 + least(60, greatest(16, (ay1 - ay0) * 0.35::double)) as pad_y1,
 case when ox > 0 and oy > 0 then greatest(ax0, bx0) else ax0 end::double as clip_x0 from y""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _boxes(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", g.iou(a, b).alias("iou"), g.overlap_of_smaller(a, b).alias("smaller"), g.containment(a, b).alias("containment"), g.centre_inside(a, b).alias("centre"),
        g.axis_coverage(a, b, "x").alias("cover_x"), g.axis_coverage(a, b, "y").alias("cover_y"), g.gap(a, b).alias("gap"), g.same_line(a, b).alias("same_line"),
        g.padded(a)["x0"].alias("pad_x0"), g.padded(a)["y1"].alias("pad_y1"), g.clipped(a, b)["x0"].alias("clip_x0"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words and regions of pages made from orders and their lines: one page an order."""
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    page = [F.lit(1).cast("long").alias("doc_id"), F.col("l_orderkey").alias("page")]
    x, y = F.col("l_partkey") % 500, F.col("l_linenumber") * 30 + F.col("l_suppkey") % 9
    words = li.select(*page, (F.col("l_linenumber") % 3).alias("line"), F.col("l_linenumber").alias("word"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 40).cast("double").alias("x1"), (y + 12).cast("double").alias("y1"))
    k = F.col("l_partkey") % 23
    regions = li.select(
        *page, F.col("l_linenumber").alias("idx"), k.cast("int").alias("class_id"), layout.label_of(k).alias("label"), (F.col("l_quantity") / 50).alias("score"),
        (x - F.col("l_suppkey") % 60).cast("double").alias("x0"), (y - 10).cast("double").alias("y0"), (x + 30 + F.col("l_suppkey") % 200).cast("double").alias("x1"), (y + 25).cast("double").alias("y1"),
    )
    return words, regions


@query(None)
def word_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, regions = _pages(spark, sf_dir)
    return layout.assign(words, regions).select("page", "line", "word", "region")


@query(None)
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, regions = _pages(spark, sf_dir)
    return layout.line_votes(layout.assign(words, regions), regions).drop("doc_id")


@query(None)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, regions = _pages(spark, sf_dir)
    return layout.reading_order(regions, regions.select("doc_id", "page").distinct().withColumn("width", F.lit(700.0))).drop("doc_id")


@query("""with l as (select l_orderkey as page, l_linenumber as line, case when l_partkey % 4 = 0 then null else ['header', 'text', 'footer', 'table'][l_partkey % 4 + 1] end as label, l_quantity < 10 as geometry_dropped from lineitem),
d as (select *, case when label is null then null else label in ('header', 'footer', 'header_image', 'footer_image', 'number', 'seal') end as f from l)
select page, count(*) as total, count(*) filter (f = geometry_dropped) as same, count(*) filter (f <> geometry_dropped) as differ, count(*) filter (f and not geometry_dropped) as layout_caught,
 count(*) filter (geometry_dropped and not coalesce(f, false)) as geometric_only, count(*) filter (label is null) as uncovered from d group by page""")
def layout_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    names = F.array(*[F.lit(x) for x in ("header", "text", "footer", "table")])
    k = (F.col("l_partkey") % 4).cast("int")
    lines = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.when(k != 0, F.get(names, k)).alias("label"), (F.col("l_quantity") < 10).alias("geometry_dropped"))
    return layout.decision_summary(layout.decisions(lines), ["page"])


def _shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, truth = _pages(spark, sf_dir)
    move = F.col("idx") % 3 * 6
    predicted = truth.filter("(page + idx) % 7 <> 0").withColumns({c: F.col(c) + move for c in ("x0", "x1")})
    return truth, predicted


@query(None)
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_label(*_shifted(spark, sf_dir))


@query(None)
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gate(evaluate.by_label(*_shifted(spark, sf_dir)), ["text", "table", "formula"], 0.5, 0.3)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    words = talk.select(F.lit(1).cast("long").alias("doc_id"), F.col("conv_id").alias("page"), "turn", F.posexplode(F.split("text", " ")).alias("w", "s"))
    return words.select("doc_id", "page", (F.col("turn").cast("long") * (1 << 32) + F.col("w")).alias("idx"), F.concat(F.col("s"), F.lit(" ")).alias("s"), (F.col("w") * 30.0).alias("x"), (800.0 - F.col("turn") * 14 + (F.col("w") % 3) * 0.2).alias("y"), (10.0 + F.col("page") % 2).alias("h"))


@query(None)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.lines(_items(spark, sf_dir)).drop("doc_id")


@query(None)
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.blocks(pages.paragraphs(pages.lines(_items(spark, sf_dir)))).drop("doc_id")


@query("""with s as (select l_orderkey % 500 as page, floor((l_quantity / 5) * 2 + 0.5) / 2 as size, count(*) as n from lineitem group by all),
m as (select *, sum(n) over (partition by page) as total, first_value(size) over (partition by page order by n desc, size) as mode from s)
select page, coalesce(max(case when n >= total * 0.4 and size > mode then size end), any_value(mode)) as font from m group by page""")
def dominant_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")
    return pages.dominant_font(li.select((F.col("l_orderkey") % 500).alias("page"), (F.col("l_quantity") / 5).alias("font")), ["page"])


@query("""with p as (select o_custkey as doc_id, o_orderkey as page, cast(floor(o_totalprice) as bigint) % 120 as chars, o_orderkey % 7 as images from orders)
select doc_id, sum(chars)::bigint as chars, sum(images)::bigint as images, count(*) as pages, sum(chars) = 0 or (sum(chars) / count(*) < 50 and sum(images) / count(*) >= 3) as scanned from p group by doc_id""")
def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return pages.residue(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), (F.floor("o_totalprice") % 120).alias("chars"), (F.col("o_orderkey") % 7).alias("images")))


@query("""with w as (select l_orderkey as page, l_linenumber as word, l_partkey % 500 + 20.0::double as x, (l_linenumber * 3 + l_suppkey % 9)::double as y from lineitem),
s as (select a.page, median((b.y - a.y) / (b.x - a.x)) as slope from w a join w b on a.page = b.page and a.word < b.word and abs(b.x - a.x) >= 100 group by a.page),
i as (select w.page, any_value(slope) as slope, median(y - slope * x) as intercept from w join s using (page) group by w.page)
select w.page, any_value(slope) as slope, any_value(intercept) as intercept, median(abs(y - slope * x - intercept)) as residual from w join i using (page) group by w.page""")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    x = (F.col("l_partkey") % 500).cast("double")
    w = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("word"), x.alias("x0"), (x + 40).alias("x1"), (F.col("l_linenumber") * 3 + F.col("l_suppkey") % 9).cast("double").alias("y1"))
    return pages.baseline(w, ["page"])


@query("""with e as (select user_id, event_id, ts, value < 50 as low, sum(case when value < 50 then 0 else 1 end) over (partition by user_id order by event_id) as r from events)
select user_id, cast(r as bigint) as run, min(event_id) as "first", max(event_id) as "last", count(*) as n from e where low group by user_id, r having count(*) >= 2""")
def flagged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events", "user_id", "event_id", "value").withColumn("low", F.col("value") < 50)
    return pages.runs(e, "low", ["user_id"], "event_id")


@query("""select page_id, cast(len(regexp_extract_all(html, '(?i)<h[1-6][\\s>]')) as bigint) as headings, cast(len(regexp_extract_all(html, '(?i)<li[\\s>]')) as bigint) as items from pages""")
def html_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.titles(_read(spark, sf_dir, "pages", "page_id", "html"))


@query(None)
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.blocks(_read(spark, sf_dir, "pages", "page_id", "html"))


@query(None)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources import markdown

    return markdown.blocks(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "block_idx", "type", "content", F.size("spans").alias("n_spans"))


EV = "(select event_id, user_id, event_type, cast(ts as timestamp) as ts, value from events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts", "value").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"select user_id, event_id, event_type, cast(age as int) as age from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as age from {EV}) where age <= 5")
def last_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_stages(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "age")


@query(f"select user_id, event_id from (select *, max(ts) over (partition by user_id) as m from {EV}) where ts >= m - interval 30 minutes")
def stage_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.trail(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id")


@query(f"""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from {EV}),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, count(*) as n, cast(floor(min(epoch(ts))) as bigint) as "first", cast(floor(max(epoch(ts))) as bigint) as "last" from s group by user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state.sessions(_events(spark, sf_dir), "user_id", "ts")
    return s.select("user_id", "n", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last").alias("last"))


@query(f"select cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as hour, event_type, count(*) as n from {EV} group by all")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = state.windowed(_events(spark, sf_dir), "ts", "1 hour", "10 minutes", "event_type")
    return w.select(F.unix_timestamp("start").alias("hour"), "event_type", "n")


@query("select o_orderkey as page, o_orderkey % 5 = 0 or o_orderkey = (select max(o_orderkey) from orders) or o_orderkey = 1 as save from orders")
def checkpoint_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders", "o_orderkey")
    total = o.agg(F.max("o_orderkey")).first()[0]
    return o.select(F.col("o_orderkey").alias("page"), state.save_here(F.col("o_orderkey"), F.lit(total), F.col("o_orderkey")).alias("save"))


@query(f"with {BLOCKS} select doc_id, block_idx, block_id, {TRIM('content')} as title, 1 as level from b where type = 'heading' and {TRIM('content')} <> ''")
def tables_of_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.contents(plain.blocks(_read(spark, sf_dir, "documents", "doc_id", "text")))


@query("select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey")
def upserted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    return documents.upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("doc_id"))
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").withColumnRenamed("l_orderkey", "doc_id")
    return documents.cascade(gone, {"lines": li})["lines"].select(F.col("doc_id").alias("l_orderkey"), "l_linenumber")


# documents, notes and progress as stored


@query("""select d.doc_id, d.lang, count(*) as n_notes, min(l.quality) as quality from documents d join labels l on d.doc_id = l.doc_id group by d.doc_id, d.lang""")
def loaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, notes = _read(spark, sf_dir, "documents", "doc_id", "lang"), _read(spark, sf_dir, "labels", "doc_id", "quality").withColumn("block_idx", F.lit(0))
    return store.loaded(docs, notes).select("doc_id", "lang", F.size("blocks").cast("long").alias("n_notes"), F.array_min(F.transform("blocks", lambda b: b["quality"])).alias("quality"))


@query("select doc_id, n_chars from documents where doc_id in (select doc_id from labels where toxic = 1)")
def noted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "n_chars").withColumnRenamed("doc_id", "block_id")
    notes = _read(spark, sf_dir, "labels", "doc_id", "toxic").filter("toxic = 1").withColumnRenamed("doc_id", "block_id")
    return store.noted(docs, notes).withColumnRenamed("block_id", "doc_id")


@query("""with i as (select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) as k, case when l_linenumber % 3 = 0 then null else 40 + l_suppkey % 200 end::double as h from lineitem),
o as (select *, coalesce(h, 120.0) as high, coalesce(sum(coalesce(h, 120.0)) over (partition by page order by k rows between unbounded preceding and 1 preceding), 0.0) as top from i),
d as (select page, k, top, high, row_number() over (partition by page order by k) - 1 as idx from o),
v as (select page, max(case when top <= page % 400 then idx end) as first, count(*) as n, sum(high) as total, max(case when top < page % 400 + 300 then idx end) + 1 as reach from d group by page),
c as (select *, greatest(0, first - 2) as s, least(n, greatest(reach, first + 1) + 2) as e from v)
select c.page, any_value(first)::int as first, any_value(s)::int as start, any_value(e)::bigint as "end", max(case when d.idx = s then d.top end) as above, greatest(max(case when d.idx = e - 1 then total - d.top - d.high end), 0.0) as below
from c join d on d.page = c.page group by c.page""")
def virtual_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    h = F.when(F.col("l_linenumber") % 3 != 0, (40 + F.col("l_suppkey") % 200).cast("double"))
    items = li.select(F.col("l_orderkey").alias("page"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")) - 1).alias("idx"), h.alias("h"))
    views = items.select("page").distinct().withColumns({"scroll": F.col("page") % 400, "viewport": F.lit(300)})
    return state.window(items, views, ["page"], "idx", "h", buffer=2)


# crops and characters


@query(f"""{BOXES}, w as (select l_orderkey, l_linenumber, ax0 as x, ay0 as y, least(ceil(ax1 - ax0), 120 - ax0) as w, least(ceil(ay1 - ay0), 100 - ay0) as h, ax0, ay0, ax1, ay1 from x),
p as (select *, greatest(2, floor(greatest(w, h) * 0.08::double + 0.5)) as p from w where w >= 1 and h >= 1),
q as (select *, greatest(0, x - p) as px, greatest(0, y - p) as py from p),
r as (select *, least(w + p * 2, 120 - px) as pw, least(h + p * 2, 100 - py) as ph from q),
s as (select *, greatest(1.0, least(3.0, sqrt(4000 / (pw * ph)))) as scale from r)
select l_orderkey, l_linenumber, cast(px as bigint) as x, cast(py as bigint) as y, cast(pw as bigint) as w, cast(ph as bigint) as h, scale, cast(greatest(1, floor(pw * scale + 0.5)) as bigint) as target_w,
 (7 + (ax0 / 2.0)) / 4 as word_x0, cast(greatest(1, ceil((ax1 - ax0) / 8.0)) as int) as steps from s""")
def crop_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _boxes(spark, sf_dir).withColumn("c", crops.crop(F.col("a"), F.lit(120), F.lit(100), F.lit(3.0), F.lit(4000)))
    word = crops.to_word(F.col("a"), F.lit(7), F.lit(0), F.lit(2.0), F.lit(4))
    return at.filter("c is not null").select(
        "l_orderkey", "l_linenumber", "c.x", "c.y", "c.w", "c.h", "c.scale", "c.target_w", word["x0"].alias("word_x0"), crops.steps(g.size(F.col("a"), "x"), F.lit(8)).alias("steps")
    )


@query("""with b as (select l_orderkey as word, l_linenumber as i, (l_linenumber * 10)::double as x0, (l_suppkey % 9)::double as y0, (l_suppkey % 9 + 4 + l_partkey % 17)::double as y1 from lineitem),
f as (select word, max(y1 - y0) as tall, count(*) as n from b group by word), m as (select b.word, median(y1) as base from b join f using (word) where y1 - y0 >= tall * 0.6 group by b.word)
select b.word, count(*) filter (n >= 2 and y1 - y0 <= tall * 0.6 and y1 <= base - tall * 0.25) as n_raised from b join f using (word) join m using (word) group by b.word""")
def raised_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    y = F.col("l_suppkey") % 9
    box = g.box(F.col("l_linenumber") * 10, y, F.col("l_linenumber") * 10 + 8, y + 4 + F.col("l_partkey") % 17)
    words = li.groupBy(F.col("l_orderkey").alias("word")).agg(F.collect_list(box).alias("boxes"))
    return words.select("word", F.size(crops.evidence_boxes(F.col("boxes"))).cast("long").alias("n_raised"))


# recognised pages


def _read_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations' turns as a recogniser would give them: one page a conversation, one line a turn."""
    talk = _read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    words = talk.select(F.lit(1).cast("long").alias("doc_id"), F.col("conv_id").alias("page"), "turn", F.posexplode(F.split("text", " ")).alias("w", "text"))
    x, y = F.col("w") * 40.0, F.col("turn") * 20.0 + (F.col("w") % 3) * 0.5
    font = F.when(F.col("turn") % 4 == 0, 18.0).otherwise(12.0)
    return words.select(
        "doc_id", "page", (F.col("turn").cast("long") * (1 << 32) + F.col("w")).alias("word"), "text", (60.0 + F.col("w") % 40).alias("confidence"), font.alias("font"),
        x.alias("x0"), y.alias("y0"), (x + 36).alias("x1"), (y + 12).alias("y1"),
    )


@query(None)
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognised.lines(_read_words(spark, sf_dir)).drop("doc_id")


@query(None)
def recognised_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognised.blocks(recognised.lines(_read_words(spark, sf_dir))).drop("doc_id")


@query(None)
def text_only_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(recognised.text_chunks(F.col("text"))).alias("block_idx", "b")).select("doc_id", "block_idx", "b.*")


@query("""with w as (select l_orderkey as page, l_linenumber % 3 as line, min(l_partkey % 500) as x0, max(l_partkey % 500 + 40) as x1 from lineitem group by all)
select page, max(x1 - x0)::double as width from w group by page""")
def widest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, _ = _pages(spark, sf_dir)
    return recognised.widest(recognised.extent(words, ["page", "line"]), ["page"])


@query("""with w as (select l_orderkey as page, l_linenumber % 3 as line, min(l_partkey % 500) as x0, max(l_partkey % 500 + 40) as x1, min(l_linenumber * 30 + l_suppkey % 9) as y0, max(l_linenumber * 30 + l_suppkey % 9 + 12) as y1 from lineitem group by all),
r as (select l_orderkey as page, l_linenumber as idx, l_partkey % 500 - l_suppkey % 60 as x0, l_linenumber * 30 + l_suppkey % 9 - 10 as y0, l_partkey % 500 + 30 + l_suppkey % 200 as x1, l_linenumber * 30 + l_suppkey % 9 + 25 as y1 from lineitem),
c as (select w.page, line, idx, greatest(0, least(w.x1, r.x1) - greatest(w.x0, r.x0))::double * greatest(0, least(w.y1, r.y1) - greatest(w.y0, r.y0)) / ((w.x1 - w.x0) * (w.y1 - w.y0)) as cover from w join r using (page))
select page, line, arg_max(idx, (cover, -idx)) as region from c where cover > 0 group by page, line""")
def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, regions = _pages(spark, sf_dir)
    made = recognised.extent(words, ["doc_id", "page", "line"])
    return recognised.labelled(made, regions).filter("region is not null").select("page", "line", "region")


@query("""with w as (select l_orderkey as page, l_linenumber as word, (l_partkey % 500)::double as x0, (l_partkey % 500 + 40)::double as x1, (l_linenumber * 3 + l_suppkey % 9)::double as y, l_partkey % 500 + 20.0::double as x from lineitem),
s as (select a.page, median((b.y - a.y) / (b.x - a.x)) as slope from w a join w b on a.page = b.page and a.word < b.word and abs(b.x - a.x) >= 100 group by a.page),
i as (select w.page, any_value(slope) as slope, median(y - slope * x) as intercept, count(*) as n, max(x1) - min(x0) as span from w join s using (page) group by w.page),
f as (select w.page, any_value(slope) as slope, any_value(n) as n, any_value(span) as span, median(abs(y - slope * x - intercept)) as residual from w join i using (page) group by w.page)
select page, slope from f where n >= 3 and abs(slope) * span >= 5 and residual <= 4.2""")
def tilted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    x = (F.col("l_partkey") % 500).cast("double")
    w = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("word"), x.alias("x0"), (x + 40).alias("x1"), (F.col("l_linenumber") * 3 + F.col("l_suppkey") % 9).cast("double").alias("y1"), F.lit(12.0).alias("font"))
    return recognised.tilted(w, ["page"], F.lit(12.0)).select("page", "slope")


# reports


@query("""with m as (select user_id, count(*) as n, min(event_id) as page, count(*) filter (event_type = 'error') as crashes from events group by user_id)
select user_id, n || '|' || case when page % 2 = 0 then '-' else page || '/' || (page + 7) end || '|' || crashes || '|' || (n % 6) as signature, case when n >= 3 then 10.0 * page / n * (n + 9 - n) end as remaining from m""")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    m = e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("page"), F.count_if(F.col("event_type") == "error").alias("crashes"))
    page = F.when(F.col("page") % 2 != 0, F.col("page"))
    return m.select("user_id", state.signature(F.col("n"), page, F.col("page") + 7, F.col("crashes"), F.col("n") % 6).alias("signature"), state.remaining(F.col("n"), F.col("n") + 9, F.col("page") * 10.0).alias("remaining"))


@query("""with c as (select page_id, ['none', 'feature_disabled', 'inference_failed', 'no_regions_detected'][page_id % 4 + 1] as code from pages)
select page_id, code = 'none' as used, code, case when code = 'none' then page_id % 9 end as regions, case when code <> 'none' then 'x' end as detail,
 case code when 'none' then 'nothing' when 'feature_disabled' then 'switch it on' when 'inference_failed' then 'try the next page' else 'look at the detail' end as action from c""")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages", "page_id")
    code = F.get(F.array(*[F.lit(c) for c in ("none", "feature_disabled", "inference_failed", "no_regions_detected")]), (F.col("page_id") % 4).cast("int"))
    o = reports.outcome(code, F.col("page_id") % 9, F.lit(10), F.lit(20), F.lit("x"))
    return p.select("page_id", o.alias("o")).select("page_id", "o.used", "o.code", "o.regions", "o.detail", "o.action")


@query(None)
def decision_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    label = layout.label_of(F.col("l_partkey") % 23)
    made = layout.decisions(li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), label.alias("label"), (F.col("l_quantity") < 10).alias("geometry_dropped")))
    return reports.decision_table(made, ["page"], "line", ["line", "label", "geometry_dropped", "layout_dropped", "agrees", "preferred"])


@query(None)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = recognised.reflowed(recognised.lines(_read_words(spark, sf_dir)))
    return reports.assembled(made, ["doc_id"], "page", markdown=True, title="conversations")


@query(f"""with l as (select doc_id, string_split(text, chr(10))[1] as line from documents)
select doc_id, length(regexp_replace(line, '[^（(]', '', 'g')) as opens from l""")
def bracket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", piecewise.count_in(F.element_at(F.split("text", "\n"), 1), piecewise.OPENS).cast("long").alias("opens"))
