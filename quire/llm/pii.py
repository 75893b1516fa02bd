"""Personal data by weak supervision, with DataFrame functions only.

Candidates come from patterns: all matches of four base kinds, of which the valid ones are always spans, and wider ones
(national phone numbers, emails written with "at" and "dot", IPv6 addresses, keys and tokens), which are sought where no base
span is.  Six labelers vote on each candidate, yes, no or nothing: the base pattern, a check of structure (checksum, ranges,
mixture of characters), the form it is written in, a gazetteer (top-level domains, calling codes, issuer prefixes, known
prefixes of keys), the words before, and the characters around.  Expectation maximisation over the counts of vote patterns
estimates each labeler's reliability for each kind, without any label: a checksum that fails where all else agrees is found
unreliable in that corpus.  Its posteriors train a logistic classifier that sees none of the votes but the span and its
surroundings: form, length, the characters beside it, the kind of cue before, and the word before (hashed).  A candidate that
the classifier gives `accept` or more joins the spans.

Matches are found natively: the pattern is replaced by itself between two marks, the text is split at them, and prefix sums of
lengths in two levels give the places, so a text with many matches takes time in proportion.  Characters equal to a mark are
exchanged first for one that no pattern takes, of the same length.  The context of a match reaches back 40 characters, at
most to the match before.  Counts of (kind, votes, features) are all the driver sees: a table bounded by the number of classes.

Defined results: a null text counts as empty.  Spans of different kinds may overlap.  Repeated rows each get a row.  Empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.llm.common import fresh, written

KINDS = ("email", "ip", "card", "phone", "secret")
OPEN, CLOSE, OTHER = "", "", ""
#: Base patterns.  A match can begin only where the run of its first characters begins, or where the last match ended;
#: said so, and without giving back, each runs in time linear in the text and finds the same matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns, each with a cheap pattern that its texts must have.
WIDER = {
    "email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?[\[({]at[\])}] ?| at )[a-z0-9-]{1,63}(?:(?: ?[\[({]dot[\])}] ?| dot )[a-z0-9-]{1,63}){1,4}", r"(?i)[\[({ ]dot[\])} ]"),
    "ip": (r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:(?:[0-9A-Fa-f]{0,4}:)"),
    "phone": (r"(?<![0-9A-Za-z+.()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
    "secret": (r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,512}+(?:\.[A-Za-z0-9_-]{10,2048}+){0,2}+(?![A-Za-z0-9_+/=-])", r"[A-Za-z0-9_-]{20}"),
}
#: The gazetteers.
DOMAINS = "com net org edu gov mil int info biz io co me app dev uk de fr es it nl be ch at pl se no dk fi ie pt gr cz ru ua us ca mx br ar cl au nz jp cn kr in sg hk za eu".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30[0-5]|35|6011|64[4-9]|65|62)"
KEYS = r"^(?:sk-|pk-|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AKIA|ASIA|AIza|eyJ|ya29)"
PLAIN_USERS = "the a an is was are be it he she we they you look looked arrive arrived meet met stay stayed not only dot one here there".split()
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt|from|to|cc|or)\W{0,3}(?:\w+\W{1,2})?$",
    "ip": r"(?i)\b(?:ip|ipv[46]|addr(?:ess)?|host|server|client|peer|from|login)\W{0,3}(?:\w+\W{1,2})?$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|pan)\W{0,3}(?:\w+\W{1,2}){0,2}$",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|t[eé]l[eé]phone|telefon|tel[eé]fono)\W{0,3}(?:\w+\W{1,2}){0,2}$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|bearer|credentials?|auth|(?:api|access|private|secret|session|signing)[_ -]?key)[\"']?\s{0,3}(?:[:=]|is)?\s{0,3}[\"'`]?$",
}
AGAINST = r"(?i)\b(?:version|ver|v|isbn|issn|doi|order|invoice|ref|item|sku|part|section|chapter|page|figure|serial|build|rev|code|ean|upc)\W{0,3}(?:no\W{0,2}|number\W{0,2})?$"
AGAINST_SECRET = r"(?i)(?:commit|sha-?(?:1|256|512)|md5|checksum|hash|etag|uuid|guid|digest|rev(?:ision)?|tree|blob|id|integrity)[\"']?\W{0,4}$|[/#]$"
VOTERS = 6
#: What is taken to be known before any count: labelers tend to be right.  Its weight is this part of all candidates.
LEAN = {(True, 1): 3.0, (True, 0): 2.0, (True, -1): 0.5, (False, 1): 0.5, (False, 0): 2.0, (False, -1): 3.0}
FIRM = 0.1
LENGTHS = (8, 12, 16, 24, 40)
#: Classes of the word before, by its hash.
WORDS_BEFORE = 32
CONTEXT = 40
CHUNK = 64


def _running(lengths: Column) -> Column:
    """0 and the sums of the first 1, 2, ... numbers of a short list."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def places(lengths: Column) -> Column:
    """What stands before each number, summed: within chunks, and over the chunks' totals."""

    def of(n: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(n) - 1) / CHUNK).cast("int"))), lambda i: F.slice(n, i * CHUNK + 1, CHUNK))

        def dealt(c: Column) -> Column:
            totals = F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
            return let(_running(totals), lambda t: F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(_running(x), 1, F.size(x)), lambda y: y + F.get(t, i)))))

        return let(chunks, dealt)

    return let(lengths, of)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, a, b, before, after>>: the leftmost non-overlapping matches, with code point places and context."""
    parts = F.split(F.regexp_replace(text, pattern, OPEN + "$0" + CLOSE), OPEN)

    def of(p: Column) -> Column:
        own = F.transform(p, lambda x, i: F.length(x) - F.when(i > 0, 1).otherwise(0))
        plain = lambda x: F.replace(x, F.lit(CLOSE), F.lit(""))

        def one(x: Column, i: Column) -> Column:
            s = F.substring_index(x, CLOSE, 1)
            before = F.right(plain(F.get(p, i - 1)), F.lit(CONTEXT))
            rest = F.substr(x, F.length(s) + 2, F.lit(2))
            after = F.substr(F.concat(rest, F.when(F.length(rest) < 2, F.coalesce(F.substr(F.get(p, i + 1), F.lit(1), F.lit(2)), F.lit(""))).otherwise("")), F.lit(1), F.lit(2))
            return F.struct(s.alias("s"), F.length(s).alias("n"), before.alias("before"), plain(after).alias("after"))

        found = F.transform(p, lambda x, i: F.when(i > 0, one(x, i)))
        full = lambda m, a: F.when(m.isNotNull(), F.struct(m["s"].alias("s"), a.alias("a"), (a + m["n"]).alias("b"), m["before"].alias("before"), m["after"].alias("after")))
        return F.filter(F.zip_with(found, places(own), full), lambda x: x.isNotNull())

    return let(parts, of)


MATCH = "array<struct<s:string,a:int,b:int,before:string,after:string>>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check digit holds, of a string of digits."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    n = F.length(digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"\A(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(s))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def masked(text: Column) -> Column:
    """The text with OTHER for each character of a valid base match, kind after kind."""

    def hidden(kind: str, text: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            s = F.substring_index(x, CLOSE, 1)
            return F.when(i == 0, x).otherwise(F.concat(F.when(valid(kind, s), F.repeat(F.lit(OTHER), F.length(s))).otherwise(s), F.substr(x, F.length(s) + 2)))

        return F.array_join(F.transform(F.split(F.regexp_replace(text, BASE[kind], OPEN + "$0" + CLOSE), OPEN), one), "")

    for kind in BASE:
        text = hidden(kind, text)
    return text


def _form(kind: str, s: Column) -> Column:
    """A class of how the candidate is written, 0 to 7."""
    classes = {
        "email": [r"@", r"[\[({](?i:at)[\])}]"],
        "ip": [r"^[0-9]\.[0-9]\.[0-9]\.[0-9]\z", r"^[0-9.]+\z", r"::", r"[A-Fa-f]"],
        "card": [r"^[0-9]{16}\z", r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\z", r"^3[0-9]{14}\z|^3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5}\z", r"^[0-9]{13}\z", r"^[0-9]+\z", r"(?:^|[ -])[0-9]{1,2}(?:[ -]|\z)"],
        "phone": [r"^\+1\b", r"^\+", r"^\(", r"^[0-9]{3}-[0-9]{3}-[0-9]{4}\z"],
        "secret": [r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\z", r"^(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\z", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z", KEYS, r"[-_].*[-_]", r"(?=.*[a-z])(?=.*[A-Z])"],
    }[kind]
    out = F.lit(len(classes))
    for k in reversed(range(len(classes))):
        out = F.when(s.rlike(classes[k]), k).otherwise(out)
    return out


def _cue(kind: str, before: Column) -> Column:
    return F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST_SECRET if kind == "secret" else AGAINST), -1).otherwise(0)


def _votes(kind: str, s: Column, base: Column, form: Column, cue: Column, before: Column, after: Column) -> list[Column]:
    """1, -1 or 0 of each labeler."""
    yes_no = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    d = digits(s)
    if kind == "email":
        top = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)[\])}]?\z", 1))
        plain = F.lower(F.regexp_extract(s, r"^([A-Za-z]+) ", 1)).isin(PLAIN_USERS)
        structure = yes_no(s.rlike(r"^[A-Za-z0-9]") & ~s.rlike(r"\.\.|-\.|\.-") & ~plain, s.rlike(r"\.\.|^[.%+-]") | plain)
        gazetteer = yes_no(top.isin(DOMAINS), F.lit(True))
        written_so = yes_no(form < 2, F.lit(False))
    elif kind == "ip":
        four = s.contains(".")
        structure = yes_no(F.when(four, valid("ip", s)).otherwise(s.rlike("[0-9]") & s.rlike("[A-Fa-f]|[0-9]{3}")), F.lit(True))
        gazetteer = yes_no(F.when(four, ~s.rlike(r"^(?:0|127|255|224)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]\z")).otherwise(s.rlike(r"(?i)^(?:2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):")), form == 0)
        written_so = yes_no(form != 0, F.lit(True))
    elif kind == "card":
        structure = yes_no(valid("card", s), F.lit(True))
        gazetteer = yes_no(d.rlike(ISSUERS), d.rlike(r"^97[89][0-9]{10}\z|^1[5-9][0-9]{11}\z|^([0-9])\1+\z"))
        written_so = yes_no(form < 3, (form == 3) | (form == 5))
    elif kind == "phone":
        structure = yes_no(F.length(d).between(9, 15), F.lit(True))
        code = F.exists(F.array(*[F.lit(c) for c in CALLING]), lambda c: d.startswith(c))
        gazetteer = F.when(s.startswith("+"), yes_no(code, F.lit(True))).otherwise(yes_no(d.rlike("^[2-9][0-9]{2}[2-9]"), F.lit(True)))
        written_so = yes_no(form < 4, F.lit(False))
    else:
        # a hash of some content is written as keys are: without a cue neither form nor structure says yes
        kinds = F.size(F.array_distinct(F.split(F.substr(s, F.lit(1), F.lit(64)), "")))
        structure = yes_no(F.lit(False), kinds < 8)
        gazetteer = yes_no(s.rlike(KEYS), form == 2)
        written_so = yes_no((form == 3) | (form == 5), form == 4)
    # a free-standing candidate is no evidence, one that is part of something longer is evidence against
    around = yes_no(F.lit(False), before.rlike(r"[A-Za-z0-9/_=.-]\z") | after.rlike(r"\A[A-Za-z0-9/_=-]"))
    return [F.when(base, 1).otherwise(0), structure, written_so, gazetteer, cue, around]


def _side(c: Column) -> Column:
    """A class of a character: none or space, quote or bracket, other sign, letter or digit."""
    return F.when(c.rlike(r"\A(?:\z|\s)"), 0).when(c.rlike(r"\A[\"'`()\[\]<>{}]"), 1).when(c.rlike(r"\A[A-Za-z0-9]"), 3).otherwise(2)


FEATURES = ("form", "length", "cue", "left", "right", "word")


def _features(s: Column, form: Column, cue: Column, before: Column, after: Column) -> list[Column]:
    word = F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*\z", 1))
    length = sum(F.when(F.length(s) > m, 1).otherwise(0) for m in LENGTHS)
    left = _side(F.right(before, F.lit(1)))
    return [form, length, cue + 1, left, _side(after), F.when(word == "", WORDS_BEFORE).otherwise(F.pmod(F.xxhash64(word), F.lit(WORDS_BEFORE)).cast("int"))]


def candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with an array of structs: kind, a, b, base (a valid match of a base pattern), v (votes), f (features)."""
    src = fresh([*docs.columns, out], "clean")
    names = {k: fresh([*docs.columns, out, src], f"found_{k}") for k in range(len(BASE) + len(WIDER))}
    got = docs.withColumn(src, F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE, OTHER + OTHER))
    arrays, t = [], F.col(src)

    def described(k: int, kind: str, base: bool) -> Column:
        def one(x: Column) -> Column:
            first = F.struct(x["s"].alias("s"), x["a"].alias("a"), x["b"].alias("b"), x["before"].alias("before"), x["after"].alias("after"),
                             (valid(kind, x["s"]) if base else F.lit(False)).alias("base"), _form(kind, x["s"]).alias("form"), _cue(kind, x["before"]).alias("cue"))
            return let(first, two)

        def two(x: Column) -> Column:
            v = F.array(*[c.cast("int") for c in _votes(kind, x["s"], x["base"], x["form"], x["cue"], x["before"], x["after"])])
            f = F.array(*[c.cast("int") for c in _features(x["s"], x["form"], x["cue"], x["before"], x["after"])])
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["a"].alias("a"), x["b"].alias("b"), x["base"].alias("base"), v.alias("v"), f.alias("f"))

        return F.transform(F.col(names[k]), one)

    must = {"email": t.contains("@"), "ip": t.rlike(r"\.[0-9]++\.[0-9]"), "card": t.rlike("[0-9](?:[ -]?[0-9]){12}"), "phone": t.contains("+")}
    none = F.array().cast(MATCH)
    k = 0
    for kind in BASE:
        got = got.withColumn(names[k], F.when(must[kind], matches(t, BASE[kind])).otherwise(none))
        few = {"card": lambda x: F.length(digits(x["s"])).between(13, 19)}.get(kind)  # other digit runs are no candidates
        if few:
            got = got.withColumn(names[k], F.filter(names[k], few))
        arrays.append(described(k, kind, True))
        k += 1
    any_base = F.lit(False)
    for kind in BASE:
        any_base = any_base | must[kind]
    needed = F.lit(False)
    for _, needs in WIDER.values():
        needed = needed | t.rlike(needs)
    rest = fresh([*got.columns, *names.values()], "rest")
    got = got.withColumn(rest, F.when(~needed, F.lit("")).when(any_base, masked(t)).otherwise(t))
    for kind, (pattern, needs) in WIDER.items():
        got = got.withColumn(names[k], F.when(F.col(rest).rlike(needs), matches(F.col(rest), pattern)).otherwise(none))
        arrays.append(described(k, kind, False))
        k += 1
    return got.withColumn(out, F.concat(*arrays)).drop(src, rest, *names.values())


class SpanModel:
    """Reliabilities by expectation maximisation, and the logistic weights that their posteriors train."""

    def __init__(self, counts: dict[tuple[int, tuple[int, ...], tuple[int, ...]], int]):
        """counts: of (kind, votes, features)."""
        self.reliability: dict[int, list[dict[tuple[bool, int], float]]] = {}
        self.weights: dict[int, dict[tuple[int, int], float]] = {}
        for kind in range(len(KINDS)):
            own = sorted((v, f, c) for (k, v, f), c in counts.items() if k == kind)
            if own:
                votes = defaultdict(int)
                for v, _, c in own:
                    votes[v] += c
                p = self._em(kind, sorted(votes.items()))
                seen = defaultdict(lambda: [0.0, 0])
                for v, f, c in own:
                    seen[f][0] += c * p[v]
                    seen[f][1] += c
                self.weights[kind] = self._train([(f, x / c, c) for f, (x, c) in sorted(seen.items())])

    def _em(self, kind: int, own: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[int, ...], float]:
        """The posterior of each vote pattern."""
        total = sum(c for _, c in own)
        firm = max(1.0, total * FIRM)
        p = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in own]  # the first guess is the vote
        for _ in range(rounds):
            yes = sum(c * x for (_, c), x in zip(own, p, strict=True))
            prior = (yes + firm) / (total + 2 * firm)
            table: list[dict] = []
            for j in range(VOTERS):
                sums = defaultdict(float)
                for (v, c), x in zip(own, p, strict=True):
                    sums[True, v[j]] += c * x
                    sums[False, v[j]] += c * (1 - x)
                mass = {y: sum(sums[y, w] + firm * LEAN[y, w] for w in (-1, 0, 1)) for y in (True, False)}
                table.append({(y, w): (sums[y, w] + firm * LEAN[y, w]) / mass[y] for y in (True, False) for w in (-1, 0, 1)})
            new = []
            for v, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(t[True, w] / t[False, w]) for t, w in zip(table, v, strict=True))
                new.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
            done = max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-9
            p = new
            if done:
                break
        self.reliability[kind] = table
        return {v: x for (v, _), x in zip(own, p, strict=True)}

    @staticmethod
    def _train(own: list[tuple[tuple[int, ...], float, int]], rounds: int = 400) -> dict[tuple[int, int], float]:
        """Logistic regression on the posteriors, each feature pattern weighted by its count; (-1, 0) is the bias."""
        w: dict[tuple[int, int], float] = defaultdict(float)
        total = sum(c for *_, c in own)
        for _ in range(rounds):
            step: dict = defaultdict(float)
            for f, x, c in own:
                keys = [(-1, 0), *enumerate(f)]
                q = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w[k] for k in keys)))))
                for k in keys:
                    step[k] += c * (x - q) / total
            for k, g in step.items():
                w[k] += 2.0 * (g - 1e-4 * w[k])
        return dict(w)

    def probability(self, x: Column) -> Column:
        """Of a candidate, as an expression."""
        score = F.lit(None).cast("double")
        for kind, w in self.weights.items():
            own = F.lit(w.get((-1, 0), 0.0))
            for j in range(len(FEATURES)):
                values = sorted((v, weight) for (k, v), weight in w.items() if k == j)
                own = own + F.coalesce(F.get(F.array(*[F.lit(dict(values).get(v, 0.0)) for v in range(values[-1][0] + 1)]), x["f"][j]), F.lit(0.0))
            score = F.when(x["kind"] == kind, own).otherwise(score)
        return F.coalesce(1 / (1 + F.exp(-score)), F.lit(0.0))


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, accept: float = 0.7) -> tuple[DataFrame, str, str]:
    """The columns `keep` of docs (all but the text, if not given), the base spans and all spans, as arrays of
    struct<kind, a, b> by kind and place; and the two columns' names."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    cand = fresh(docs.columns, "candidates")
    some = written(candidates(docs, text, cand).select(*keep, cand), "candidates")
    seen = some.select(F.explode(cand).alias("x")).groupBy("x.kind", "x.v", "x.f").count().collect()
    model = SpanModel({(r["kind"], tuple(r["v"]), tuple(r["f"])): r["count"] for r in seen})
    base, spans = fresh(keep, "base_spans"), fresh(keep, "spans")
    short = lambda x: F.struct(x["kind"].alias("kind"), x["a"].alias("a"), x["b"].alias("b"))
    out = some.withColumn(base, F.array_sort(F.transform(F.filter(cand, lambda x: x["base"]), short)))
    added = F.filter(cand, lambda x: x["base"] | (model.probability(x) >= accept))
    return out.withColumn(spans, F.array_sort(F.transform(added, short))).select(*keep, base, spans), base, spans


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["a"].cast("string"), x["b"].cast("string"))), ",")
