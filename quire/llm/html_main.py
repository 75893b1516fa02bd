"""Main text of web pages by a site style tree.

The DOMs of one host are merged by style: an element's place is the path of tags, classes and ids above it, numbers in names
apart.  For each place the tree keeps how its children's tag sequences vary over the pages (presentation) and how its own
text varies (content).  Both are entropies in units of the logarithm of the number of pages: 0 if all pages agree, 1 if all
differ.  Content is carried up: a place's content is the mean of all places below it, weighted by their text.  Its importance
is (1 - g) * presentation + g * content, where g = 0.9 ** (number of child sequences), so a place of one form is as important
as what it holds.  A page loses

* the places of low importance, and the single texts that stand at one place in most of a host's pages (an unnamed notice);
* the places whose text is mostly links, three a page or more (an unnamed menu);
* the places that name themselves noise.  Names that are also layout (`sidebar`, `widget`, ...) are weighed by the tree: a
  place with such a name stays if it holds the article, or half of the text of the pages that have it.

Elements that are no text by their tag (nav, footer, form, script, ...) go unweighed: in many sites what they say changes with
each page, and entropies take it for content.  The article and the main element are one place each and nothing in them is
judged by the tree.  Pages of a host with the same main text count as one, so copies prove nothing about a template.

Of what is left the articles' text is taken, else that of the main element, else all.  Character references are decoded,
white space becomes one space, blocks are joined by one space.

Counts are keyed sums with partial aggregation, so one host may hold any share of the pages; a page is met with the decisions
on its own places only.  Defined results: a null or empty html, or one without main text, gives an empty text.  A null url
counts as a host of its own name.  Repeated rows each get a row.  Broken markup is read as browsers do, roughly: unclosed
elements end with their parents, a block ends an open paragraph.  Elements deeper than DEEPEST count as their ancestor there.
Empty tables give empty results.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh, list_array, strings, with_columns, written

#: Kinds of elements, and words in classes, ids and roles that name noise.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOISE_TAGS = set("nav footer aside form head button select menu dialog object audio video canvas map datalist".split())
NOISE_WORDS = set(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie "
    "cookies crumbs disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup "
    "promo promoted related replies respond search share sharing sidebar signup skip social sponsor sponsored submenu subscribe toolbar topbar widget widgets".split()
)
#: Words that also name a page's layout, weighed by the tree; and words beside which `header` names an article's own.
LAYOUT_WORDS = set("banner header masthead nav menu notice sidebar navbar overlay toolbar topbar widget widgets".split())
OWN_HEADER = set("article content entry page post story".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|template|noscript|iframe|svg|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|hidden|style|itemprop|aria-modal)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
NUMBER = re.compile("[0-9]+")
DEEPEST = 64
ROOT = 1


@dataclass(slots=True)
class Node:
    name: str
    path: int
    up: tuple = ()  # the places above, the root first
    children: int = 0  # hash of the child tags, runs counted once
    last: str = ""
    held: list = field(default_factory=list)  # the text of the block that is open


@dataclass(slots=True)
class Place:
    up: tuple
    shape: int = 0
    words: int = 0  # hash of its own texts
    chars: int = 0  # of its own texts
    linked: int = 0  # of these, in links
    links: int = 0
    holds: bool = False  # the article or the main element


@dataclass
class Page:
    """blocks: texts by level, 2 in an article, 1 in the main element, 0 elsewhere.  places and texts: for the tree."""

    blocks: list[tuple[int, str]] = field(default_factory=list)
    places: dict[int, Place] = field(default_factory=dict)
    texts: set[tuple[int, int]] = field(default_factory=set)

    def text(self) -> str:
        for level in (2, 1, 0):
            got = " ".join(t for at, t in self.blocks if at >= level)
            if got:
                return got
        return ""


def _h(x: str | int, seed: int) -> int:
    return xxhash.xxh64_intdigest(x if isinstance(x, str) else x.to_bytes(8, "little"), seed & 0xFFFFFFFFFFFFFFFF) >> 1


def named(name: str, attrs: str, in_article: bool) -> tuple[str, str, int]:
    """What the element says of itself: noise ("tag", "word", "layout" or nothing), its mark, and its level as main text."""
    noise, mark, main = "", "", 2 if name == "article" else 1 if name == "main" else 0
    if name in NOISE_TAGS or name == "header" and not in_article:
        noise = "tag"
    for a in ATTR.finditer(attrs) if attrs else ():
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key in ("class", "id"):
            words = set(SPLIT.split(HUMP.sub(" ", value).lower()))
            value = value.lower()
            mark += f"{key}={NUMBER.sub('#', value)};"
            if not noise and name not in ("html", "body"):
                words |= set(SPLIT.split(value))
                found = NOISE_WORDS & words
                if "header" in found and (in_article or OWN_HEADER & words):
                    found.remove("header")
                if found:
                    noise = "layout" if found <= LAYOUT_WORDS else "word"
            continue
        value = value.lower()
        if key == "role" and value in ROLES or key == "hidden" and not re.search(r"(class|id|style)\s*=\s*[\"'][^\"']*hidden", attrs) or key == "style" and re.search(r"display\s*:\s*none", value):
            noise = noise or "tag"
        elif key == "role" and value == "main" or key == "itemprop" and value == "articlebody":
            main = max(main, 1)
    return noise, mark, main


ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}


def read(source: str, gone: frozenset[int] = frozenset(), kept: frozenset[int] = frozenset(), said: frozenset[tuple[int, int]] = frozenset(), style: bool = False) -> Page:
    """gone: places to leave out.  kept: places that stay although a layout word names them.  said: (place, hash of a text)
    to leave out.  style: whether to note the page's places and texts; then layout words name nothing."""
    page = Page()
    root = Node("", ROOT)
    stack, open_count = [root], {}
    skip, why, level_at = 0, "", []  # depth below which all is left out, or 0; the open articles' and mains' depths
    link = 0  # depth of the open link
    blocks = [root]  # the open elements that are not inline

    def place(node: Node) -> Place:
        got = page.places.get(node.path)
        if got is None:
            got = page.places[node.path] = Place(node.up)
        return got

    def flush() -> None:
        """The open block's text ends here."""
        node = blocks[-1]
        if not node.held:
            return
        t = " ".join("".join(node.held).split())
        node.held.clear()
        if not t:
            return
        level = level_at[-1][1] if level_at else 0
        if style:
            own = place(node)
            own.words, own.chars = _h(t, own.words), own.chars + len(t)
            if not level:
                page.texts.add((node.path, _h(t, 0)))
        if said and not level and (node.path, _h(t, 0)) in said:
            return
        page.blocks.append((level, t))

    def pop() -> None:
        nonlocal skip, link
        node = stack[-1]
        if node.name not in INLINE:
            flush()
            blocks.pop()
            if style and not skip:
                got = place(node)
                got.shape = node.children if not got.shape else _h(got.shape, node.children)
        stack.pop()
        open_count[node.name] -= 1
        while level_at and level_at[-1][0] > len(stack):
            level_at.pop()
        if skip > len(stack):
            skip = 0
        if link > len(stack):
            link = 0

    def text(s: str) -> None:
        if skip:
            return
        t = entities.unescape(s) if "&" in s else s
        blocks[-1].held.append(t)
        if style and link and not t.isspace():
            place(blocks[-1]).linked += len(t)

    pos = 0
    for m in TOKEN.finditer(source):
        if m.start() > pos:
            text(source[pos : m.start()])
        pos = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:
            if open_count.get(name):
                while stack[-1].name != name:
                    pop()
                pop()
            elif name in ("p", "br") and not skip:
                blocks[-1].held.append(" ")
            continue
        if name in VOID:
            if name in ("br", "hr") and not skip:
                blocks[-1].held.append(" ")
            continue
        if name in ENDS_P and open_count.get("p"):
            while stack[-1].name != "p":
                pop()
            pop()
        elif name in ENDS:  # such an element ends one that is open just above
            ends = ENDS[name]
            k = len(stack) - 1
            while k > 0 and stack[k].name in INLINE | {"p", *ends} and stack[k].name not in ends:
                k -= 1
            while k > 0 and stack[k].name in ends:
                k -= 1
            if k < len(stack) - 1 and stack[k + 1].name in ends:
                while len(stack) > k + 1:
                    pop()
        noise, mark, main = named(name, (m[4] or m[7] or "").strip(), any(x[1] == 2 for x in level_at))
        if main and noise == "layout":
            noise = ""
        up = blocks[-1]
        if name in INLINE:
            node = Node(name, up.path)
            if name == "a" and not skip:
                link = link or len(stack) + 1
                if style:
                    place(up).links += 1
        else:
            if not skip:
                flush()
            if level_at or len(up.up) >= DEEPEST:
                node = Node(name, up.path, up.up)
            else:
                node = Node(name, _h(f"{name} {mark}", up.path), (*up.up, up.path))
            if up.last != name:
                up.children, up.last = _h(name, up.children), name
            blocks.append(node)
        stack.append(node)
        open_count[name] = open_count.get(name, 0) + 1
        if main and skip and why == "layout" and not noise:
            skip = 0
        if main and not skip:
            if style and not level_at:
                for b in blocks:
                    place(b).holds = True
            level_at.append((len(stack), max(main, level_at[-1][1] if level_at else 0)))
        if not skip:
            if noise == "layout" and (style and not level_at or node.path in kept):
                noise = ""
            judged = node.path in gone and not level_at and name not in INLINE
            if noise or judged:
                skip, why = len(stack), noise or "style"
    if pos < len(source):
        rest = source[pos:]
        cut = re.search(r"<[a-z!/?][^>]*\Z", rest, re.I)  # a tag that never ends
        text(rest[: cut.start()] if cut else rest)
    while len(stack) > 1:
        pop()
    flush()
    return page


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


PLACE = T.StructType([*[T.StructField(n, T.LongType()) for n in ("path", "shape", "words", "chars", "linked", "links", "total")], T.StructField("holds", T.BooleanType()), T.StructField("up", T.ArrayType(T.LongType(), False))])
SAID = T.StructType([T.StructField("path", T.LongType()), T.StructField("words", T.LongType())])


def _styles(batch: pa.RecordBatch, html: str) -> list[pa.Array]:
    """Of each page: the hash of its main text, its places, and its texts outside the article."""
    main, counts, said_counts = [], [], []
    cols, holds, ups, said = [[] for _ in range(7)], [], [], ([], [])
    for s in strings(batch, html):
        page = read(s.as_py(), style=True)
        main.append(xxhash.xxh64_intdigest(page.text()) - (1 << 63))
        total = sum(p.chars for p in page.places.values())
        counts.append(len(page.places))
        for path, p in page.places.items():
            for c, v in zip(cols, (path, p.shape, p.words, p.chars, p.linked, p.links, total), strict=True):
                c.append(v)
            holds.append(p.holds)
            ups.append(p.up)
        said_counts.append(len(page.texts))
        for path, h in page.texts:
            said[0].append(path)
            said[1].append(h)
    up = list_array(pa.array([x for u in ups for x in u], pa.int64()), [len(u) for u in ups])
    places = pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(holds, pa.bool_()), up], [f.name for f in PLACE.fields])
    texts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in said], ["path", "words"])
    return [pa.array(main, pa.int64()), list_array(places, counts), list_array(texts, said_counts)]


def read_styles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, page, main, places, texts): each distinct page of a host, page being the hash of its html, written."""
    src = pages.select(host(F.col(url)).alias("host"), F.xxhash64(html).alias("page"), F.col(html).alias("html"))
    fields = [T.StructField("main", T.LongType()), T.StructField("places", T.ArrayType(PLACE)), T.StructField("texts", T.ArrayType(SAID))]
    read_ = with_columns(src, lambda b: _styles(b, "html"), fields).drop("html")
    return written(read_.dropDuplicates(["host", "page"]), "styles")


def style_tree(styles: DataFrame, g: float = 0.9) -> DataFrame:
    """(host, path, pages, presentation, content, importance, share, linked, links, holds): the merged tree of each host, one
    row a place.  share: of the text of the pages that have the place; linked: the part in links; links: how many a page.
    Of a host's pages with the same main text one stands for all: that whose hash is the least."""
    one = styles.groupBy("host", "main").agg(F.min("page").alias("page"))
    nodes = styles.join(one, ["host", "main", "page"]).select("host", F.explode("places").alias("x")).select("host", "x.*")
    sums = [F.sum(c).alias(c) for c in ("chars", "linked", "links", "total")]
    counted = written(nodes.groupBy("host", "path", "shape", "words").agg(F.count("*").alias("n"), *sums, F.max("holds").alias("holds"), F.first("up").alias("up")), "places")
    bits = F.sum(F.col("n") * F.log("n"))
    m = F.col("pages")
    entropy_ = F.when(m > 1, F.greatest(F.lit(0.0), (F.log(m) - F.col("s") / m) / F.log(m))).otherwise(1.0)
    by = {}
    for name, key in (("presentation", "shape"), ("own", "words")):
        each = counted.groupBy("host", "path", key).agg(F.sum("n").alias("n"))
        by[name] = each.groupBy("host", "path").agg(F.sum("n").alias("pages"), bits.alias("s"), F.count("*").alias("forms")).select("host", "path", "pages", "forms", entropy_.alias(name))
    own = counted.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("chars", "linked", "links", "total")], F.max("holds").alias("holds"), F.first("up").alias("up"))
    own = written(own.join(by["own"].drop("pages", "forms"), ["host", "path"]), "own")
    # what a place holds is summed into every place above it
    below = own.select("host", F.explode(F.array_distinct(F.concat(F.array("path"), "up"))).alias("path"), "chars", "linked", "links", (F.col("chars") * F.col("own")).alias("weighted"))
    below = below.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("chars", "linked", "links", "weighted")])
    tree = below.join(by["presentation"], ["host", "path"]).join(own.select("host", "path", "holds", "total"), ["host", "path"])
    part = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(empty)
    content, weight = part("weighted", "chars", 1.0), F.pow(F.lit(g), F.col("forms"))
    return tree.select(
        "host", "path", "pages", "presentation", content.alias("content"), ((1 - weight) * F.col("presentation") + weight * content).alias("importance"),
        part("chars", "total", 0.0).alias("share"), part("linked", "chars", 0.0).alias("linked"), (F.col("links") / F.col("pages")).alias("links"), "holds",
    )


def decisions(styles: DataFrame, tree: DataFrame, threshold: float, least_pages: int, menu: float = 0.7) -> DataFrame:
    """(host, page, gone, kept, said_at, said): for each distinct page what the tree says of its own places and texts, where it says anything."""
    half = F.col("share") >= 0.5
    low = (F.col("pages") >= least_pages) & (F.col("importance") < threshold) | (F.col("linked") >= menu) & (F.col("links") >= 3) & ~half
    say = tree.filter(F.col("path") != ROOT).select("host", "path", "pages", (low & ~F.col("holds")).alias("gone"), half.alias("kept"))
    pages = styles.select("host", "page", F.explode("places").alias("x")).select("host", "page", "x.path")
    places = pages.join(say.filter("gone or kept"), ["host", "path"]).groupBy("host", "page").agg(
        F.collect_list(F.when(F.col("gone"), F.col("path"))).alias("gone"), F.collect_list(F.when(F.col("kept") & ~F.col("gone"), F.col("path"))).alias("kept"))
    one = styles.groupBy("host", "main").agg(F.min("page").alias("page"))
    texts = styles.join(one, ["host", "main", "page"]).select("host", F.explode("texts").alias("x")).select("host", "x.*")
    common = texts.groupBy("host", "path", "words").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    common = common.join(tree.select("host", "path", "pages"), ["host", "path"]).filter(F.log("n") / F.log("pages") > 1 - threshold)
    said = styles.select("host", "page", F.explode("texts").alias("x")).select("host", "page", "x.*").join(common.select("host", "path", "words"), ["host", "path", "words"])
    said = said.groupBy("host", "page").agg(F.collect_list(F.struct("path", "words")).alias("said"))
    return places.join(said, ["host", "page"], "full")


def extract(pages: DataFrame, url: str = "url", html: str = "html", threshold: float = 0.2, least_pages: int = 5) -> tuple[DataFrame, str]:
    """pages with their main text; and the column's name."""
    taken = [*pages.columns]
    name = lambda n: taken.append(fresh(taken, n)) or taken[-1]
    out, at, key = name("main_text"), name("page_host"), name("page_hash")
    gone, kept, said = name("gone"), name("kept"), name("said")
    styles = read_styles(pages, url, html)
    say = written(decisions(styles, written(style_tree(styles), "tree"), threshold, least_pages), "decisions")
    say = say.select(F.col("host").alias(name("_host")), F.col("page").alias(name("_page")), F.col("gone").alias(gone), F.col("kept").alias(kept), F.col("said").alias(said))
    h, p = say.columns[:2]
    joined = pages.withColumn(at, host(F.col(url))).withColumn(key, F.xxhash64(html)).join(say, (F.col(at) == F.col(h)) & (F.col(key) == F.col(p)), "left").drop(h, p, at, key)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        of = [batch.column(batch.schema.get_field_index(c)) for c in (gone, kept, said)]
        texts = []
        for s, g, k, w in zip(strings(batch, html), *of, strict=True):
            told = [frozenset(g.as_py() or ()), frozenset(k.as_py() or ()), frozenset((x["path"], x["words"]) for x in w.as_py() or ())]
            texts.append(read(s.as_py(), *told).text())
        return [pa.array(texts, pa.string())]

    return with_columns(joined, run, [T.StructField(out, T.StringType())]).drop(gone, kept, said), out


def entropy(counts: list[int]) -> float:
    """In units of the logarithm of their sum; one page says nothing and counts as 1 (for tests)."""
    m = sum(counts)
    return -sum(c / m * math.log(c / m) for c in counts) / math.log(m) if m > 1 else 1.0
