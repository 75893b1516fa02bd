"""Chapters of HTML to blocks: headings, paragraphs, quotes, code, lists, images, in the order of the page."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "blockquote": "quote", "pre": "code", "li": "list", "figure": "image"}
BLOCK = "array<struct<type:string,content:string,level:int,lang:string,src:string>>"
VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Blocks(HTMLParser):
    """Every wanted element gets a block with all the text below it, nested ones too, but no p within an li."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.muted = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.muted += 1
        if tag == "img":
            for _, b in self.open:
                if b is not None and b["type"] == "image":
                    b["src"] = b["src"] or a.get("src") or ""
                    b["alt"] = b.get("alt") or a.get("alt") or ""
        if tag == "code" or tag == "pre":
            for _, b in self.open:
                if b is not None and b["type"] == "code" and a.get("class"):
                    b["lang"] = b["lang"] or a["class"].replace("language-", "")
        if tag in VOID:
            return
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)
        block = None
        if tag in KINDS and not (tag == "p" and any(t == "li" for t, _ in self.open)):
            block = {"type": KINDS[tag], "parts": [], "level": int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else None, "lang": a.get("class", "").replace("language-", "") if tag == "pre" else "", "src": ""}
            self.found.append(block)
        self.open.append((tag, block))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.muted = max(0, self.muted - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.muted:
            for _, b in self.open:
                if b is not None:
                    b["parts"].append(data)


def parse(source: str) -> list[dict]:
    """The blocks; neighbouring list items become one list."""
    p = _Blocks()
    p.feed(source or "")
    p.close()
    out: list[dict] = []
    for b in p.found:
        raw = "".join(b["parts"])
        text = raw.strip("\n") if b["type"] == "code" else " ".join(raw.split())
        if b["type"] == "image":
            text = b.get("alt") or text
            if not b["src"] and not text:
                continue
        elif not text.strip():
            continue
        if b["type"] == "list" and out and out[-1]["type"] == "list":
            out[-1]["content"] += f"\n- {text}"
            continue
        out.append({"type": b["type"], "content": f"- {text}" if b["type"] == "list" else text, "level": b["level"], "lang": b["lang"] or None, "src": b["src"] or None})
    return out


def _parsed(source: pd.Series) -> pd.Series:
    return source.map(parse)


def html_blocks(source: Column) -> Column:
    return F.pandas_udf(_parsed, BLOCK)(source)


def blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, block_idx, type, content, level, lang, src)."""
    return pages.select(F.col(page_id).alias("page_id"), F.posexplode(html_blocks(F.coalesce(F.col(html), F.lit("")))).alias("block_idx", "b")).select("page_id", "block_idx", "b.*")


def titles(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, headings, items): how many headings and list items a page has, natively."""
    n = lambda p: F.regexp_count(F.coalesce(F.col(html), F.lit("")), F.lit(p))
    return pages.select(F.col(page_id).alias("page_id"), n(r"(?i)<h[1-6][\s>]").cast("long").alias("headings"), n(r"(?i)<li[\s>]").cast("long").alias("items"))
