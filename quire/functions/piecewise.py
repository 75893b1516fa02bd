"""Formulas by cases, as recognised: constructs, branches and their LaTeX; and scripts in plain text, for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as t

#: What a construct and a branch look like, and how long a branch may be.
CONSTRUCT = r"([A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω]{0,3}\s*(?:\([^()\s]{0,6}\))?\s*=\s*)(\{|[≥≤><≠])"
BRANCH_HINT, PROSE_RUN, LONGEST = "[0-9λμσαβγθφ≤≥−√²^_=]", "[\\u4e00-\\u9fff]{3,}", 12
OPENS, CLOSES = "（(", "）)"
MARK = "\ue003"
#: Signs and their LaTeX.
SYMBOLS = {"µ": r"\mu ", "μ": r"\mu ", "λ": r"\lambda ", "σ": r"\sigma ", "≥": r"\ge ", "≤": r"\le ", "−": "-", "²": "^{2}"}
#: Raised and lowered characters, and what they stand for.
SUPER = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni", strict=True))
SUB = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "0123456789+-=()", strict=True))


def count_in(s: Column, chars: str) -> Column:
    return F.length(s) - F.length(F.translate(s, chars, ""))


def punctuation_char(c: Column) -> Column:
    """A punctuation sign that is none of the signs read as a minus."""
    return c.rlike(r"^\p{P}\z") & ~c.rlike("^[-−–—]\\z")


def line_text(words: Column) -> Column:
    return t.trim(F.array_join(words, ""))


def clean_branch(s: Column) -> Column:
    """A branch without the marks before it, and without brackets that open and do not close."""
    bare = F.regexp_replace(t.trim(s), "^[_^]+", "")

    def of(x: Column) -> Column:
        surplus = F.greatest(count_in(x, OPENS) - count_in(x, CLOSES), F.lit(0))
        leading = F.length(F.regexp_extract(x, "^[（(]*", 0))
        return t.trim(t.drop_dangling_marks(F.substr(x, F.least(surplus, leading) + 1)))

    return t.let(bare, of)


def branch_text(s: Column) -> Column:
    """The branch, or null if the text is none."""

    def of(x: Column) -> Column:
        good = (x != "") & (t.len16(x) <= LONGEST) & x.rlike(BRANCH_HINT) & ~x.rlike(PROSE_RUN)
        return F.when(good & ~F.contains(s, F.lit("{")), x)

    return t.let(clean_branch(s), of)


def to_latex(s: Column) -> Column:
    s = F.replace(s, F.lit("\\"), F.lit("\\backslash "))
    s = F.regexp_replace(s, r"([%&#{}$])", r"\\$1")
    for sign, latex in SYMBOLS.items():
        s = F.replace(s, F.lit(sign), F.lit(latex))
    return t.trim(F.regexp_replace(s, f"[{t.WS}]+", " "))


def constructs(s: Column) -> Column:
    """array<struct<label, after>> of `name(args) = {` and what follows each, or null unless all of the text is such."""

    def of(x: Column) -> Column:
        mark = MARK
        parts = F.split(F.regexp_replace(x, CONSTRUCT, mark + "$1" + mark + "$2" + mark), mark)  # before, then label, sign, after, ...
        n = ((F.size(parts) - 1) / 3).cast("int")
        each = F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: F.struct(t.trim(F.get(parts, i * 3 + 1)).alias("label"), t.trim(t.drop_dangling_marks(t.trim(F.get(parts, i * 3 + 3)))).alias("after"), F.get(parts, i * 3 + 2).alias("sign")),
        )
        braces = count_in(x, "{")
        whole = F.forall(each, lambda e: (e["label"] != "") & (e["after"] != ""))
        braced = (braces == 0) | ((braces == n) & F.forall(each, lambda e: e["sign"] == "{"))
        return F.when((n > 0) & (F.get(parts, 0) == "") & whole & braced, F.transform(each, lambda e: F.struct(e["label"].alias("label"), e["after"].alias("after"))))

    return t.let(t.trim(s), of)


PIECE = "array<struct<text:string,tex:string>>"


def script_pieces(s: Column, bare: bool = False) -> Column:
    """The text cut at its scripts: array<struct<text, tex>>, tex being null for plain text.  bare: x^2 and n_1 count too."""
    mark, runs = MARK, f"[{''.join(SUPER)}]+|[{''.join(SUB)}]+"
    pattern = f"({runs})" + (r"|(?<=\w)(\^(?:\{[^}]+\}|\w+)|_(?:\{[^}]+\}|\w+))" if bare else "")
    parts = F.split(F.regexp_replace(s, pattern, mark + "$0" + mark), mark)
    plain = {**SUPER, **SUB}

    def piece(x: Column, i: Column) -> Column:
        up = x.rlike(f"^[{''.join(SUPER)}]")
        spelt = F.translate(x, "".join(plain), "".join(plain.values()))
        inner = F.regexp_replace(F.substr(x, F.lit(2)), r"^\{(.*)\}\z", "$1")
        tex = F.when(x.startswith("^"), F.concat(F.lit("^{"), inner, F.lit("}"))).when(x.startswith("_"), F.concat(F.lit("_{"), inner, F.lit("}"))).otherwise(F.concat(F.when(up, "^{").otherwise("_{"), spelt, F.lit("}")))
        return F.struct(x.alias("text"), F.when(i % 2 == 1, tex).alias("tex"))

    return F.filter(F.transform(parts, piece), lambda p: p["text"] != "")


def rendered(s: Column, bare: bool = False) -> Column:
    """Formulas between dollar signs as they are, and the scripts of what is between them."""
    mark = MARK
    parts = F.split(F.regexp_replace(s, r"\$([^$]+)\$", mark + "$1" + mark), mark)
    formula = lambda x: F.array(F.struct(F.concat(F.lit("$"), x, F.lit("$")).alias("text"), x.alias("tex")))
    return F.flatten(F.transform(parts, lambda x, i: F.when(i % 2 == 1, formula(x)).otherwise(script_pieces(x, bare))))
