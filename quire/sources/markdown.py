"""Markdown to blocks: a line scanner for the constructs the document model keeps, with inline spans over plain text.

Read: front matter, ATX and setext headings, fences, display math, quotes and callouts, nested lists with tasks, tables, rules,
images, footnotes, paragraphs; inline strong, emphasis, strike, code, links, marks, wikilinks, math, footnote references.
Not read: reference link definitions, HTML blocks beyond the removal of tags, lazy continuation of nested quotes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:string,href:string>>"
ITEM = "array<struct<text:string,indent:int,marker:string,checked:boolean>>"
BLOCK = f"array<struct<type:string,content:string,level:int,lang:string,href:string,spans:{SPAN},items:{ITEM},align:array<string>,callout:string>>"
BULLETS = "•◦▪"
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
LIST = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])\s+(?:\[([ xX])\]\s+)?(.*)$")
CALLOUT = re.compile(r"^\[!([A-Za-z][\w-]*)\][+-]?\s*(.*)$")
INLINE = re.compile(
    r"(?P<code>(?P<tick>`+)(?P<code_text>.+?)(?P=tick)(?!`))|(?P<math>(?<!\\)\$(?!\s)(?P<math_text>[^$\n]+?)(?<!\s)\$)"
    r"|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]*)[^)]*\)|\[\^(?P<fn>[^\]\s]+)\]|\[\[(?P<wiki>[^\]|\n]+)(?:\|(?P<as>[^\]\n]+))?\]\]"
    r"|\[(?P<label>[^\]]+)\]\((?P<href>[^)\s]*)[^)]*\)|\*\*(?P<strong>.+?)\*\*|__(?P<strong2>.+?)__|~~(?P<del>.+?)~~|==(?P<mark>.+?)==|\*(?P<em>[^*\s][^*]*?)\*|(?<!\w)_(?P<em2>[^_\s][^_]*?)_(?!\w)|<br\s*/?>|</?[a-zA-Z][^>]*>",
    re.S,
)


def front_matter(s: str) -> tuple[str | None, str]:
    """The title, if it says one, and the rest."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", s, re.S)
    if not m:
        return None, s
    title = re.search(r"^title:\s*(.+?)\s*$", m[1], re.M)
    return (title[1].strip("\"'") if title else None), s[m.end() :]


def math_delimiters(s: str) -> str:
    r"""\(..\) and \[..\] as $..$ and $$..$$, outside fences and code."""
    out, fence = [], None
    for line in s.split("\n"):
        m = re.match(r"^ {0,3}(`{3,}|~{3,})", line)
        if m:
            fence = None if fence and m[1].startswith(fence) else fence or m[1][:3]
            out.append(line)
            continue
        if fence is None:
            parts = re.split(r"(`+[^`]*`+)", line)
            line = "".join(p if k % 2 else re.sub(r"(?<!\\)\\([\[\]])", "$$", re.sub(r"(?<!\\)\\([()])", "$", p)) for k, p in enumerate(parts))
        out.append(line)
    return "\n".join(out)


def inline(s: str) -> tuple[str, list[dict]]:
    """Plain text and its spans: delimiters go, nested spans stay."""
    text, spans, last = "", [], 0
    for m in INLINE.finditer(s):
        text += s[last : m.start()]
        last = m.end()
        g = m.groupdict()
        kind = next((k for k in ("code", "math", "src", "fn", "wiki", "href", "strong", "strong2", "del", "mark", "em", "em2") if g[k] is not None), None)
        at = len(text)
        if kind is None:
            text += "\n" if m[0].lower().startswith("<br") else ""
            continue
        if kind in ("code", "math"):
            text += g[f"{kind}_text"]
            own, href = kind, None
        elif kind == "src":
            text += g["alt"]
            own, href = "image", g["src"]
        elif kind == "fn":
            text += f"[{g['fn']}]"
            own, href = "fnref", g["fn"]
        elif kind == "wiki":
            text += g["as"] or g["wiki"]
            own, href = "wikilink", g["wiki"] if g["wiki"].startswith("#") else ""
        else:
            inner, below = inline(g["label"] if kind == "href" else g[kind])
            spans += [{**b, "start": b["start"] + at, "end": b["end"] + at} for b in below]
            text += inner
            own, href = {"href": "link", "strong2": "strong", "em": "emphasis", "em2": "emphasis", "del": "delete"}.get(kind, kind), g["href"]
        spans.append({"start": at, "end": len(text), "kind": own, "href": href})
    return text + s[last:], sorted(spans, key=lambda x: (x["start"], -x["end"]))


def _block(kind: str, source: str = "", **more) -> dict:
    text, spans = inline(source) if kind not in ("code", "math", "divider") else (source, None)
    return {"type": kind, "content": text, "level": None, "lang": None, "href": None, "spans": spans, "items": None, "align": None, "callout": None, **more}


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def parse(source: str) -> tuple[str | None, list[dict]]:
    title, s = front_matter((source or "").removeprefix("﻿").replace("\r\n", "\n"))
    lines, out, i = math_delimiters(s).split("\n"), [], 0
    starts = re.compile(r"^ {0,3}(#{1,6}(\s|$)|>|`{3}|~{3}|\$\$|([-*_])\s*(\3\s*){2,}$)")
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := FENCE.match(line):
            body = []
            i += 1
            while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            out.append(_block("code", "\n".join(body), lang=m[2] or None))
            i += 1
        elif line.strip().startswith("$$"):
            body = line.strip()[2:]
            while not body.rstrip().endswith("$$") and i + 1 < len(lines):
                i += 1
                body += "\n" + lines[i]
            out.append(_block("math", body.rstrip().removesuffix("$$").strip()))
            i += 1
        elif m := re.match(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
            out.append(_block("heading", m[2] or "", level=len(m[1])))
            i += 1
        elif re.match(r"^ {0,3}([-*_])\s*(?:\1\s*){2,}$", line):
            out.append(_block("divider"))
            i += 1
        elif line.lstrip().startswith(">"):
            body = []
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                body.append(re.sub(r"^\s*> ?", "", lines[i]))
                i += 1
            if m := CALLOUT.match(body[0]):
                kind = m[1].lower()
                out.append(_block("callout", "\n".join(body[1:]).strip(), callout=kind, lang=m[2].strip() or kind[:1].upper() + kind[1:]))
            else:
                out.append(_block("quote", "\n".join(body).strip()))
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
            align = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":")), "") for c in _cells(lines[i + 1])]
            rows = [_cells(line)]
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                rows.append(_cells(lines[i]))
                i += 1
            out.append(_block("table", "\n".join(" ".join(r) for r in rows), align=align))
        elif LIST.match(line):
            items: list[dict] = []
            depth: list[int] = []
            while i < len(lines) and lines[i].strip():
                m = LIST.match(lines[i])
                if m:
                    pad = len(m[1].expandtabs(4))
                    while depth and depth[-1] > pad:
                        depth.pop()
                    if not depth or depth[-1] < pad:
                        depth.append(pad)
                    k = len(depth) - 1
                    marker = f"{int(m[2][:-1])}." if m[2][0].isdigit() else BULLETS[min(k, 2)]
                    items.append({"text": inline(m[4])[0], "indent": k, "marker": marker, "checked": None if m[3] is None else m[3] != " "})
                elif items and not starts.match(lines[i]):
                    items[-1]["text"] += " " + inline(lines[i].strip())[0]
                else:
                    break
                i += 1
            out.append({**_block("list"), "content": "\n".join(f"{'  ' * x['indent']}{x['marker']} {x['text']}" for x in items), "items": items})
        elif m := re.match(r"^\[\^([^\]\s]+)\]:\s*(.*)$", line):
            out.append(_block("paragraph", m[2], lang="footnote", href=m[1]))
            i += 1
        else:
            body = [line.strip()]
            i += 1
            level = None
            while i < len(lines) and lines[i].strip() and not starts.match(lines[i]) and not LIST.match(lines[i]):
                if m := re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]):
                    level = 1 if m[1][0] == "=" else 2
                    i += 1
                    break
                body.append(lines[i].strip())
                i += 1
            joined = "\n".join(body)
            if m := re.fullmatch(r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)", joined):
                out.append({**_block("image"), "content": m[1], "href": m[2]})
            else:
                out.append(_block("heading", joined, level=level) if level else _block("paragraph", joined))
    return title, out


def _parsed(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(s) for s in source], columns=["title", "blocks"], dtype=object)


def markdown(source: Column) -> Column:
    return F.pandas_udf(_parsed, f"struct<title:string,blocks:{BLOCK}>")(source)


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, title, block_idx, type, content, level, spans, ...)."""
    return docs.select(F.col(doc_id).alias("doc_id"), markdown(F.col(text)).alias("m")).select("doc_id", "m.title", F.posexplode("m.blocks").alias("block_idx", "b")).select("doc_id", "title", "block_idx", "b.*")
