"""String functions of the document model, as Column expressions.

Offsets and lengths count UTF-16 units where the data model says so (`len16`); white space is the wide class `WS`, which
includes no-break and ideographic spaces and the byte order mark; ends are absolute (`\\z`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and word lists of the document model.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"
SENTENCE_ENDS = "。！？!?.;；"
CHAPTER = r"(?i)^(第[一二三四五六七八九十百千\d]+[章节回卷篇部]|chapter\s+\d+|序章|后记|尾声)"
NOTATION = "=<>≤≥−\\-±×÷√{}\\[\\]()"
MATH = r"[=<>+\-*/^±×÷∑∫√≤≥≠∞≈]"
READABLE = "A-Za-z0-9\\u4e00-\\u9fff\\u0370-\\u03ff\\uFF10-\\uFF19\\uFF21-\\uFF3A\\uFF41-\\uFF5A"
DEEPL = {"EN": "EN-US", "ZH": "ZH-HANS", "PT": "PT-BR"}


def len16(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def trim(s: Column) -> Column:
    return F.trim(s, F.lit(WS_CHARS))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), the value written once in the plan however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def find(s: Column, part: Column, start: Column | int = 0) -> Column:
    """Position of a non-empty part from `start` on, 0-based; -1 if absent."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.call_function("locate", part, s, start + 1) - 1


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^.]*\z", 0))


def title_from_file(name: Column) -> Column:
    s = F.regexp_replace(name, r"\.[^.]+\z", "")
    s = F.regexp_replace(s, "[_-]+", " ")
    return trim(F.regexp_replace(s, f"[{WS}]+", " "))


def strip_bom(s: Column) -> Column:
    return F.regexp_replace(s, "^\\uFEFF", "")


def replacement_ratio(s: Column) -> Column:
    """Share of U+FFFD, 0 for an empty text."""
    n = len16(s)
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(s, F.lit("\\uFFFD")) / n)


def has_readable(s: Column) -> Column:
    return F.length(F.regexp_replace(s, f"[{WS}\\uFFFD\\x00-\\x1F]", "")) > 0


def count_chars(s: Column) -> Column:
    return len16(F.regexp_replace(s, f"[{WS}]", ""))


def clean_heading(s: Column) -> Column:
    return trim(F.regexp_replace(s, f"^#{{1,6}}[{WS}]+", ""))


def block_type(s: Column) -> Column:
    """heading, quote or paragraph, by looks."""
    lines = F.split(s, "\n")
    first = trim(F.element_at(lines, 1))
    heading = first.rlike(f"^#{{1,6}}[{WS}]+") | first.rlike(CHAPTER)
    quote = F.forall(lines, lambda x: trim(x).startswith(">"))
    return F.when(heading, "heading").when(quote, "quote").otherwise("paragraph")


def detect_language(s: Column) -> Column:
    head = F.substr(s, F.lit(1), F.lit(2000))
    n = lambda c: F.regexp_count(head, F.lit(c))
    blank = F.length(trim(head)) == 0
    latin, cjk = n("[A-Za-z]"), n("[\\u4e00-\\u9fff]")
    by_script = F.when(n("[\\u3040-\\u30ff]") > 20, "ja").when(n("[\\uac00-\\ud7af]") > 20, "ko").when(cjk > latin * 0.3, "zh").otherwise("en")
    return F.when(blank, "zh").otherwise(by_script)


def primary_tag(tag: Column) -> Column:
    """The primary subtag, or null."""
    got = F.regexp_extract(F.lower(trim(tag)), r"^([a-z]{2,3})(?:[-_]|\z)", 1)
    return F.when(got != "", got)


def deepl_target(tag: Column) -> Column:
    up = F.upper(tag)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DEEPL.items() for x in kv]), up), up)


def normalize_anchor(s: Column) -> Column:
    """The key under which a heading and a link to it meet."""
    t = F.regexp_replace(trim(s), "^#", "")
    t = F.coalesce(F.try_url_decode(F.regexp_replace(t, r"\+", "%2B")), t)
    t = F.regexp_replace(F.lower(t), f"[{WS}]+", "")
    return F.regexp_replace(t, "[-_`*~\"'“”‘’()（）\\[\\]【】]", "")


def looks_like_heading(s: Column) -> Column:
    no = (len16(s) > 40) | s.rlike(r"[。！？!?]\z")
    capital = s.rlike(f"^[A-Z][A-Z{WS}\\d\\-:]{{3,}}\\z") & (len16(s) <= 30)
    yes = s.rlike(f"^#{{1,6}}[{WS}]") | s.rlike(CHAPTER) | s.rlike(f"^\\d+(\\.\\d+)*[{WS}、.]") | capital
    return ~no & yes


def cjk_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(f"[{CJK}]"))


def looks_like_prose(s: Column) -> Column:
    ends = s.rlike(f"[{SENTENCE_ENDS}]\\z")
    return (F.length(s) > 0) & ((ends & (cjk_count(s) >= 4)) | ((len16(s) >= 24) & (cjk_count(s) >= 10)))


def looks_like_math(s: Column, font: Column, main: Column) -> Column:
    shape = s.rlike(MATH) | s.rlike(r"\d") | s.rlike(r"^[\x20-\x7e]+\z") | (len16(s) <= 3)
    return (F.length(s) > 0) & (len16(s) <= 12) & shape & ((main <= 0) | (font <= main))


def join_text(left: Column, right: Column) -> Column:
    """Two recognised pieces in one line: a space only between word characters or before an opening bracket."""
    a, b = F.substr(left, F.length(left), F.lit(1)), F.substr(right, F.lit(1), F.lit(1))
    space = ~a.rlike(f"[{CJK}]") & a.rlike(r"[\p{L}\p{N}_]") & b.rlike(r"[\p{L}\p{N}_(\[{]")
    return F.when(left == "", right).when(right == "", left).when(space, F.concat_ws(" ", left, right)).otherwise(F.concat(left, right))


def dehyphenate(left: Column, right: Column) -> Column:
    """The joined word, or null where a hyphen at a line's end is no break."""
    ok = left.rlike(r"[a-z][-‐]\z") & right.rlike("^[a-z]")
    return F.when(ok, F.concat(F.substr(left, F.lit(1), F.length(left) - 1), right))


def escape_latex(s: Column) -> Column:
    for pattern, to in ((r"\\", r"\\backslash "), (r"([%&#{}])", r"\\$1"), ("_", r"\\_"), (r"\$", r"\\\$")):
        s = F.regexp_replace(s, pattern, to)
    return s


def fragment_to_latex(s: Column) -> Column:
    t = trim(s)
    return F.when(t.rlike(r"(?s)^\$.*\$\z"), t).otherwise(escape_latex(t))


def inline_latex(s: Column) -> Column:
    x = fragment_to_latex(s)
    return F.when(trim(s) == "", "").when(x.rlike(r"(?s)^\$.*\$\z"), x).otherwise(F.concat(F.lit("$"), x, F.lit("$")))


def escape_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def fold_match(s: Column) -> Column:
    """Without white space, full-width signs as plain ones: for comparing readings."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return F.translate(F.regexp_replace(s, f"[{WS}]", ""), wide, plain)


def folded_contains(s: Column, part: Column) -> Column:
    n = fold_match(part)
    return (n != "") & fold_match(s).contains(n)


def notation_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(f"[{NOTATION}]"))


def alnum_sequence(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def is_subsequence(part: Column, s: Column) -> Column:
    """The characters of part stand in s in order."""
    at = F.aggregate(F.split(s, ""), F.lit(0), lambda i, c: i + F.when(F.substr(part, i + 1, F.lit(1)) == c, 1).otherwise(0))
    return (F.length(part) == 0) | (at >= F.length(part))


def richer_reading(primary: Column, other: Column) -> Column:
    p, a = alnum_sequence(primary), alnum_sequence(other)
    return (trim(other) != "") & (other != primary) & (len16(a) >= len16(p) + 2) & is_subsequence(p, a) & (notation_count(other) >= notation_count(primary))


def punctuation_only(s: Column) -> Column:
    t = trim(s)
    return (t != "") & ~t.rlike(f"[{READABLE}]")


def default_callout_title(kind: Column) -> Column:
    return F.concat(F.upper(F.substr(kind, F.lit(1), F.lit(1))), F.substr(kind, F.lit(2), F.length(kind)))


def wikilink_target(s: Column) -> Column:
    return F.when(s.startswith("#"), s).otherwise("")


def drop_dangling_marks(s: Column) -> Column:
    return F.regexp_replace(s, r"[\^_](?![A-Za-z0-9{])", "")


def glob_to_regexp(glob: Column) -> Column:
    escaped = F.regexp_replace(glob, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit("[^.]+")), F.lit(r"\z"))


def origin_allowed(origin: Column, patterns: Column) -> Column:
    """Some pattern matches; a lone wildcard does not count, and no pattern allows nothing."""
    return F.exists(patterns, lambda p: (trim(p) != "") & (trim(p) != "*") & F.rlike(origin, glob_to_regexp(trim(p))))


def duration(seconds: Column) -> Column:
    s = F.floor(seconds + 0.5)
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"))
    return F.when(s < 60, part(s, "秒")).when(s < 3600, F.concat_ws(" ", part(minutes, "分"), part(s % 60, "秒"))).otherwise(F.concat_ws(" ", part(hours, "小时"), part(minutes % 60, "分")))


def table_cell(s: Column) -> Column:
    """One line of at most 40 characters, bars escaped."""
    flat = trim(F.regexp_replace(s, f"[{WS}]+", " "))
    return F.replace(F.substr(flat, F.lit(1), F.lit(40)), F.lit("|"), F.lit("\\|"))


def round_half_up(x: Column, places: int) -> Column:
    """As the model rounds: halves go up, also below zero; not finite is 0."""
    k = 10.0**places
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.floor(x * k + 0.5) / k)


def sentences(s: Column, ends: str = SENTENCE_ENDS) -> Column:
    return F.split(s, f"(?<=[{ends}])")


def pieces_of(s: Column, size: int) -> Column:
    n = F.greatest(F.ceil(F.length(s) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(s, i * size + 1, F.lit(size)))


def _pack(parts: Column, most: int, hard_cut: bool, tidy: bool) -> Column:
    """Greedy packing: a chunk closes when the next sentence would make it too long."""
    t = trim if tidy else (lambda x: x)
    kind = "array<string>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.length(acc["buf"]) + F.length(s) > most) & (acc["buf"] != "")
        out = F.when(full, F.concat(acc["out"], F.array(t(acc["buf"])))).otherwise(acc["out"])
        buf = F.when(full, "").otherwise(acc["buf"])
        if not hard_cut:
            return F.struct(out.alias("out"), F.concat(buf, s).alias("buf"))
        long = F.length(s) > most
        cut = F.transform(pieces_of(s, most), t)
        return F.struct(F.when(long, F.concat(out, cut)).otherwise(out).alias("out"), F.when(long, buf).otherwise(F.concat(buf, s)).alias("buf"))

    done = F.aggregate(parts, start, step, lambda acc: F.concat(acc["out"], F.array(t(acc["buf"]))))
    return F.filter(done, lambda c: trim(c) != "")


def pack_for_speech(s: Column, most: int = 180) -> Column:
    """Chunks of at most `most` characters, cut after sentences; a longer sentence is cut hard; chunks are not trimmed."""
    return F.when(F.length(s) <= most, F.array(s)).otherwise(_pack(sentences(s, SENTENCE_ENDS + "\\n"), most, True, False))


def pack_for_pages(s: Column, most: int = 1200) -> Column:
    return _pack(sentences(s), most, True, True)


def pack_for_chapters(s: Column, most: int = 1500) -> Column:
    """As for pages, but a long sentence stays whole."""
    return _pack(sentences(s), most, False, True)
