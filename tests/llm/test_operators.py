"""Each operator against brute force or an exact property, and with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import ann, decontaminate, graph, html_main, language, line_dedup, mixing, pieces, pii, simhash, suffix_dedup
from quire.llm.queries import PIECES
from quire.llm.words import raw

WORDS = "the of and in a stone river light over under green small house walks sings cold bright old tree road".split()
rng = np.random.default_rng(5)


def prose(n, words=WORDS):
    return " ".join(rng.choice(words, n))


PASSAGE = prose(70)
TEXTS = [
    (1, prose(120) + " " + PASSAGE + " " + prose(20)),
    (2, prose(30) + " " + PASSAGE),
    (3, prose(49)),
    (4, "one two"),
    (5, ""),
    (6, None),
    (7, "w " * 130),
    (8, prose(80)),
    (9, prose(80)),
    (10, "  \n\t "),
    (None, PASSAGE + " x"),
    (11, prose(20_000)),
    (12, "日本語 текст ÉÀ " * 5),
    (12, "日本語 текст ÉÀ " * 5),
]
TEXTS += [(13, TEXTS[7][1]), (14, TEXTS[7][1])]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, simhash string, kept_text int")


def empty(docs):
    return docs.limit(0)


# 1

def brute_repeats(rows, least=50):
    rows = list(dict.fromkeys(rows))
    words = {r: (r[1] or "").encode().lower().split() for r in rows}
    by_text = defaultdict(list)
    for r in rows:
        by_text[r[1]].append(r)
    where = defaultdict(set)
    for t, rs in by_text.items():
        ids = [r[0] for r in rs if r[0] is not None]
        first = min(ids) if ids else None
        for j in range(len(words[rs[0]]) - least + 1):
            where[tuple(words[rs[0]][j : j + least])].add((first is not None, first or 0, j, t))
    merge = lambda js: [(a, b) for a, b in _merge(js, least)]
    out = {}
    for t, rs in by_text.items():
        w, all_, later = words[rs[0]], [], []
        ids = [r[0] for r in rs if r[0] is not None]
        first = min(ids) if ids else None
        for j in range(len(w) - least + 1):
            at = where[tuple(w[j : j + least])]
            if len(at) > 1:
                all_.append(j)
                if min(at, key=lambda x: x[:3]) != (first is not None, first or 0, j, t):
                    later.append(j)
        for r in rs:
            if len(rs) > 1 and len(w) >= least:
                out[r[0]] = ([(0, len(w))], merge(later) if r[0] == first else [(0, len(w))])
            elif all_:
                out[r[0]] = (merge(all_), merge(later))
    return out


def _merge(js, least):
    out = []
    for j in sorted(js):
        if out and j <= out[-1][1]:
            out[-1][1] = j + least
        else:
            out.append([j, j + least])
    return out


def test_suffix_dedup(spark, docs):
    got = {r.doc_id: ([tuple(x) for x in r.repeated], [tuple(x) for x in r.later]) for r in suffix_dedup.repeats(docs).collect()}
    assert got == brute_repeats([t for t in TEXTS if t[0] != 12])
    assert suffix_dedup.repeats(empty(docs)).count() == 0
    assert suffix_dedup.without("a b  c d", [(1, 3)]) == "a d"


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffixes_extend_both_ways(spark, crowd):
    """Few words and short stretches: every seed has many contexts that agree more to the one side or to the other."""
    own = np.random.default_rng(8)
    phrase = [" ".join(own.choice(list("abc"), 9)) for _ in range(4)]
    texts = [" ".join(" ".join([str(own.choice(phrase)), " ".join(own.choice(list("abcd"), int(own.integers(0, 6))))]) for _ in range(int(own.integers(1, 5)))) for _ in range(60)]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, None)]
    got = {r.doc_id: ([tuple(x) for x in r.repeated], [tuple(x) for x in r.later]) for r in suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), least=10, crowd=crowd).collect()}
    assert got == brute_repeats(rows, 10)


def test_anchors_are_chosen_by_content():
    h = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    row = np.array([0, 300])
    a = suffix_dedup.anchors(h, row, 50, 26)
    b = suffix_dedup.anchors(np.concatenate([h[:7], h]), np.array([0, 7, 307]), 50, 26)
    assert (a[1] + 7 == b[1]).all() and (a[0] + 7 == b[0]).all()
    assert all(s <= p <= s + 24 for s, p in zip(a[0], a[1]))


# 2

def brute_contamination(text, items):
    w, hit, found = decontaminate.plain_words(text), set(), set()
    for name, t in items:
        x = decontaminate.plain_words(t)
        for k in range(max(1, len(x) - 12) if x else 0):
            win = x[k : k + 13]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, docs, block):
    items = [(1, PASSAGE), (2, "one TWO"), (3, ""), (4, None), (5, "текст"), (2, "w w w"), (6, prose(40)), (10, PASSAGE[:200])]
    some = [t for t in TEXTS if t[0] != 11]
    out = decontaminate.decontaminate(docs.filter("doc_id is null or doc_id <> 11"), spark.createDataFrame(items, "item_id long, text string"), out="d", block_bytes=block)
    got = {(r.doc_id, r.text): (r.d.n_words, r.d.n_hit, list(r.d["items"])) for r in out.collect()}
    assert got == {(i, t): brute_contamination(t, items) for i, t in some}
    for r in out.collect():
        for s in r.d.spans:
            assert decontaminate.plain_words(r.text[s.start : s.end])
    assert out.columns == [*docs.columns, "d"]
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"), out="d").filter("d.n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty(docs), spark.createDataFrame(items, "item_id long, text string"), out="d").count() == 0


def test_fm_index():
    from quire.llm.fm_index import FMIndex, suffix_array

    for _ in range(20):
        n = int(rng.integers(2, 200))
        text = rng.integers(0, 4, n)
        text[-1] = 0
        index = FMIndex(text, 4, sample=3)
        assert sorted(suffix_array(text)) == list(range(n))
        for size in (1, 2, 3):
            for p in {tuple(rng.integers(1, 4, size)) for _ in range(5)}:
                lo, hi = index.search(np.array([p]))
                want = [i for i in range(n - size + 1) if tuple(text[i : i + size]) == p]
                assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


# 3

def brute_lines(rows, width=3):
    seen, gone = {}, {}
    lines = {r: [x.strip(" \t\r") for x in (r[1] or "").split("\n") if x.strip(" \t\r")] for r in rows}
    for r in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        gone[r] = set()
        for k in range(len(lines[r]) - width + 1):
            win = tuple(lines[r][k : k + width])
            if win in seen:
                gone[r] |= set(range(k, k + width))
            seen.setdefault(win, (r, k))
    return {r: sorted(g) for r, g in gone.items()}


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n\nb \nc\n\td\ny"), (3, None), (4, ""), (5, "q\n" * 6), (6, "a\nb"), (None, "b\nc\nd"), (7, "a\nb\nc\nd"), (7, "a\nb\nc\nd")]
    src = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, gone_lines int")
    out, kept, gone = line_dedup.dedup(src)
    assert (kept, gone) == ("kept_text", "_gone_lines")
    want = brute_lines(rows)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r[gone]) == want[r.doc_id, r.text]
        assert r[kept] == (None if r.text is None else line_dedup.without_lines(r.text, want[r.doc_id, r.text]))
    assert {r.doc_id: r[kept] for r in got}[2] == "x\n\ny"
    assert src.select(line_dedup.spans(F.array(*map(F.lit, [1, 2, 3, 7, 9, 10]))).alias("s")).first().s == "1:4,7:8,9:11"
    assert line_dedup.dedup(src.limit(0))[0].count() == 0


# 4

def test_language(spark):
    stock = {"en": WORDS, "de": "der die das und ich nicht schön straße über wald haus kalt".split(), "fr": "le la les été où garçon maison froide rivière pierre".split(), "xx": "zqx qzx xqz zzx qqz".split()}
    rows = [(i, prose(30, stock[lang]), lang) for i, lang in enumerate(sorted(stock) * 40)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 --", "fr"), (1003, prose(5000), "en"), (1004, prose(20), None), (None, prose(20), "en")]
    src = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    model = language.learn(src)
    out, name, score = language.identify(src, model)
    got = out.collect()
    assert name == "_lang_pred" and len(got) == len(rows)
    assert all(0 <= r[score] <= 1 for r in got)
    assert {r.doc_id for r in got if r[name] == "und"} == {1000, 1001, 1002}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r[name] == r.lang for r in held) >= 0.95 * len(held)
    none, n, _ = language.identify(src, language.learn(src.limit(0)))
    assert {r[n] for r in none.collect()} == {"und"}
    assert language.identify(src.limit(0), model)[0].count() == 0


def test_languages_of_long_texts(spark):
    """A language with long texts only is learned, from whole texts, within the bound on features."""
    stock = {"en": WORDS, "xx": "zqx qzx xqz zzx qqz".split()}
    rows = [(i, prose(6000 if lang == "xx" else 30, stock[lang]), lang) for i, lang in enumerate(sorted(stock) * 12)]
    src = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (12 << 20, 1):
        out, name, _ = language.identify(src, language.learn(src, most=most))
        assert all(r[name] == r.lang for r in out.collect())


def test_language_trigrams_keep_to_their_row():
    import pyarrow as pa

    from quire.llm.words import raw

    one = [language.trigrams(*raw(pa.array([t]))) for t in ("ab", "", "x", "Été")]
    both = language.trigrams(*raw(pa.array(["ab", "", "x", "Été"])))
    assert (np.concatenate(one) == both).all()


# 5

def test_neighbours(spark):
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[50:120] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (1000, [0.0] * 8), (1100, [float("nan")] * 8), (1200, [1.0, None] + [0.0] * 6), (1300, [1.0, 2.0]), (1400, []), (100, x[100].tolist())]
    src = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wanted = F.col("vec_id") % 100 == 0
    got = defaultdict(list)
    for r in ann.neighbours(src, wanted).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    assert set(got) == {0, 100, 200, 300}
    hits = 0
    for q, near in got.items():
        d = np.sqrt(np.square(y - y[q]).sum(axis=1))
        want = sorted((d[i], i) for i in range(400) if i != q)[:10]
        hits += len({i for i, _ in near} & {i for _, i in want})
        assert len(near) == 10 and near == sorted(near, key=lambda p: (p[1], p[0])) and all(math.isclose(s, d[i], abs_tol=1e-12) for i, s in near)
    assert hits >= 36
    assert [i for i, _ in got[0]] == list(range(50, 60)) and [i for i, _ in got[100]] == [0, *range(50, 59)]
    few = ann.neighbours(src.filter("vec_id in (0, 1, 2)"), wanted).collect()
    assert len(few) == 2
    assert ann.neighbours(src.limit(0), wanted).count() == 0


def test_neighbours_beside_an_outlier(spark):
    x = (np.random.default_rng(6).standard_normal((600, 8)) * 0.125).astype(np.float32)
    x[599] *= 1e8
    src = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.neighbours(src, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    y = x.astype(np.float64)
    want = {q: {i for _, i in sorted((d, i) for i, d in enumerate(np.sqrt(np.square(y - y[q]).sum(axis=1))) if i != q)[:10]} for q in range(0, 600, 100)}
    assert set(got) == set(want) and sum(len(got[q] & want[q]) for q in want) >= 54


def test_neighbours_of_the_tables_length(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(6)] + [(10, [1.0] * 4)]
    src = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.query_id for r in ann.neighbours(src, F.col("vec_id") % 10 == 0, k=2).collect()} == {0}


def test_neighbours_do_not_follow_the_number_of_tasks(spark):
    """The chunks that the graph starts from are cut at quantiles, not where tasks end."""
    x = np.random.default_rng(8).standard_normal((900, 8))
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>").mapInArrow(ann._packed, "node long, s double, z binary")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (2, 23):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append(sorted((r.u, r.v) for r in ann.start(made, 2, 100, 5).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == 900 * 5


# 6

def test_mixing(spark, docs):
    src = docs.filter("doc_id is null or doc_id <> 11")
    lang = mixing.learn(src)
    out, names = mixing.score(src, lang, keep=["doc_id", "simhash"])
    got = out.collect()
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", decontaminate.lower_ascii(t or "")), None]
    count = Counter()
    for i, t in TEXTS:
        if i != 11 and zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    assert (lang.n, lang.v) == (n, v)
    want = Counter()
    for i, t in TEXTS:
        if i != 11:
            w = tokens(t)
            want[i, len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[7].bits_per_byte < 1 and all(r.score < 0 for r in got)
    assert math.isclose(by[1].score, -by[1].bits_per_byte * by[1].n_bytes * math.log10(2))
    none = mixing.learn(src.limit(0))
    assert none.n == 0 and mixing.score(src, none, keep=["doc_id"])[0].filter("score < 0").count() == src.count()
    assert mixing.score(src.limit(0), lang, keep=["doc_id"])[0].count() == 0


def random_mixer():
    bits = (8, 16, 16, 17, 18, 18)
    tables = [mixing.state(o, o + rng.integers(0, 9, 1 << b)) for b in bits for o in [rng.integers(0, 5, 1 << b).astype(float)]]
    code = mixing.Code(rng.integers(0, 1000, 256).astype(float))
    return mixing.Mixer(code, bits, tables, rng.uniform(0, 0.5, (mixing.GATES, mixing.ORDERS)).astype(np.float32), rng.standard_normal((256, mixing.BUCKETS)).astype(np.float32))


def brute_bits(m, text):
    """The model's bits of a text, one bit after another in plain Python; weights follow after each block of bits."""
    data = [*decontaminate.lower_ascii(text).encode(), mixing.END]
    delta, held, done, total = [0.0] * 6, [0.0] * 6, 0, 0.0
    spread = lambda h: (h := (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64, h := (h ^ h >> 27) * 0x94D049BB133111EB % 2**64, h ^ h >> 31)[-1]
    for i, byte in enumerate(data):
        before = [mixing.END] * 5 + data[:i]
        for d in range(int(m.code.size[byte])):
            at = int(m.code.start[byte]) + d
            node, bit, q = int(m.code.node[at]), int(m.code.bit[at]), []
            for k in range(6):
                ctx = int.from_bytes(bytes(before[len(before) - k :]), "big")
                line = ctx << 8 if k < 2 else spread(ctx + (k << 48)) >> 64 - m.bits[k]
                q.append(int(mixing.PLAIN[m.tables[k][line ^ node]]))
            gate = min(d, 7) + 8 * sum(v != -128 for v in q)
            q = [0 if v == -128 else v / mixing.PART for v in q]
            x = max(-16.0, min(16.0, sum(float(w) * v for w, v in zip(m.weights[gate], q, strict=True))))
            x = (x + float(m.refined[node][round(x + 16)])) / 2
            x += sum(a * b for a, b in zip(delta, q, strict=True))
            total += math.log2(1 + math.exp(-x if bit else x))
            error = bit - 1 / (1 + math.exp(-x))
            held = [h + error * v for h, v in zip(held, q, strict=True)]
            done += 1
            if done % mixing.BLOCK == 0:
                delta, held = [a + mixing.RATE * h for a, h in zip(delta, held, strict=True)], [0.0] * 6
    return total


def sequences_of(texts):
    return mixing.sequences(*raw(pa.array(texts)))


def test_mixing_finds_tokens_by_their_leading_bits():
    r = np.random.default_rng(4)
    for hot in (np.unique(r.integers(-(2**63), 2**63 - 1, 5000)), np.arange(-300, 300) * 3, np.array([2**63 - 1]), np.array([-(2**63)])):
        token = np.concatenate([hot, r.integers(-(2**63), 2**63 - 1, 5000), np.arange(-1000, 1000), [2**63 - 1, -(2**63)]])
        assert (mixing.position(hot, mixing.index(hot), token) == np.minimum(np.searchsorted(hot, token), len(hot) - 1)).all()


def test_mixing_sequences_end_with_their_row():
    texts = ["", "a", "Ab", "", "É日本", "a longer text"]
    key, at = sequences_of(texts)
    want = []
    for t in texts:
        data = [mixing.END] * 5 + [*decontaminate.lower_ascii(t).encode(), mixing.END]
        want += [int.from_bytes(bytes(data[i : i + 6]), "big") for i in range(len(data) - 5)]
    assert key.tolist() == want and np.diff(at).tolist() == [len(t.encode()) + 1 for t in texts]
    data, offsets = raw(pa.array(texts))
    part, _ = mixing.sequences(data, offsets[3:])
    assert part.tolist() == want[at[3] :]


def test_mixing_against_brute_force():
    m = random_mixer()
    texts = ["", "a", prose(400), "É 日本 x" * 30, prose(60), prose(60)]
    got = m.frozen().bits_of(*sequences_of(texts))
    assert np.allclose(got, [brute_bits(m, t) for t in texts], rtol=1e-3)
    assert np.allclose(got, np.concatenate([m.bits_of(*sequences_of([t])) for t in texts]), rtol=1e-5)  # whatever else is in the batch


def test_mixing_is_a_probability():
    """Over all next bytes after a context, the probabilities add up to one."""
    m = random_mixer()
    key = (np.uint64(0x1234567890) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    start, x, _ = m.prepared(key)
    assert np.isclose(np.exp(-np.add.reduceat(np.logaddexp(0, x.astype(float)), start)).sum(), 1)


def test_mixing_counts_every_context(spark):
    """Every order's slots hold the counts of all training texts, made by hand."""
    texts = [prose(30), prose(50), "Ab a", "", None]
    m = mixing.learn(spark.createDataFrame([(i * 100, t) for i, t in enumerate(texts)], "doc_id long, text string")).model
    train = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i * 100).encode()) % 7 != 2]
    key, _ = sequences_of(train)
    for k in range(mixing.ORDERS):
        ones, seen = np.zeros(1 << m.bits[k]), np.zeros(1 << m.bits[k])
        for line, byte in zip(mixing.lines(key, k, m.bits[k]).tolist(), (key & np.uint64(255)).tolist(), strict=True):
            for at in range(m.code.start[byte], m.code.start[byte] + m.code.size[byte]):
                seen[line ^ int(m.code.node[at])] += 1
                ones[line ^ int(m.code.node[at])] += m.code.bit[at]
        assert (m.tables[k] == mixing.state(ones, seen)).all()
    learned = m.bits_of(*sequences_of(train)).sum()
    flat = mixing.Mixer(m.code, m.bits, [np.zeros_like(t) for t in m.tables], m.weights).bits_of(*sequences_of(train)).sum()
    assert learned < flat / 3


# 7

def test_pieces(spark, docs):
    odd = spark.createDataFrame([(20, "a▁b ▁ c"), (21, "\x00\n\t  x"), (22, "😀 ∑"), (23, "x" * 3000)], "doc_id long, text string")
    src = docs.select("doc_id", "text").union(odd)
    back = pieces.decode(pieces.encode(src, PIECES), PIECES).collect()
    assert len(back) == src.count()
    assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in back)
    with pytest.raises(ValueError):
        pieces.encode(src.withColumn("ids", F.lit(1)), PIECES)
    assert pieces.encode(src.limit(0), PIECES).count() == 0


def proto(fields):
    """Of a protocol buffer's bytes, or back from (number, kind, value) triples."""
    out = bytearray()

    def varint(n):
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)

    for number, kind, value in fields:
        varint(number << 3 | kind)
        if kind == 0:
            varint(value)
        elif kind == 2:
            varint(len(value))
            out += value
        else:
            out += value
    return bytes(out)


def test_pieces_agree_with_the_public_library():
    """A unigram model of some pieces, written as the library's own file: the same ids."""
    import struct

    import sentencepiece

    some = ["▁", *"abcdeé", "▁a", "ab", "bc", "abc", "▁ab", "cd", "de", "cde", "▁de", "ea", "aa", "▁aab"]
    score = {p: -float(rng.integers(1, 40)) / (1 if len(p) > 1 else 0.5) for p in some}
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, score[p], 1) for p in some]]
    rows = [(1, 2, proto([(1, 2, p.encode()), (2, 5, struct.pack("<f", s)), (3, 0, k)])) for p, s, k in pieces_]
    model = proto([*rows, (2, 2, proto([(3, 0, 1), (35, 0, 1)])), (3, 2, proto([(1, 2, b"identity"), (3, 0, 1), (4, 0, 0), (5, 0, 1)]))])
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = pieces.PieceModel(pieces_)
    for _ in range(400):
        text = "".join(rng.choice(list("aabbccddee éxß日 "), int(rng.integers(1, 25))))
        assert own.encode(text) == library.encode(text), text


def test_pieces_cache_is_bounded():
    cache = pieces.Cache(20_000)
    for i in range(5000):
        cache.keep(f"w{i}", b"1234")
        assert cache.held <= 10_000 and len(cache.young) + len(cache.old) < 100
    assert cache.get("w4999") == b"1234" and cache.get("w0") is None


def test_pieces_find_the_best_path():
    bytes_ = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    vocab = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bb", ".", "c.", "▁▁"]
    m = pieces.PieceModel([*bytes_, *[(p, -float(rng.integers(1, 30)), 1) for p in vocab]])
    score = {p: s for p, s, _ in zip(m.texts[256:], [m.automaton.get(p)[1] for p in vocab], vocab)}

    def best(s):
        b = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            b[j] = b[j - 1] + m.byte_score * len(m._bytes(s[j - 1]))
            for k in range(max(0, j - 4), j):
                if s[k:j] in score:
                    b[j] = max(b[j], b[k] + score[s[k:j]])
        return b[-1]

    for _ in range(300):
        text = "".join(rng.choice(list("ab c.▁é"), int(rng.integers(0, 14))))
        ids = m.encode(text)
        assert m.decode(ids) == text
        s = pieces.MARK + text.replace(pieces.MARK, pieces.LITERAL).replace(" ", pieces.MARK)
        if text:
            assert math.isclose(sum(m.byte_score if i < 256 else score[m.texts[i]] for i in ids), best(s))


# 8

def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, docs):
    out, fp, root, first = simhash.classes(docs)
    assert fp == "_simhash"
    got = {(r.doc_id, r.text): r for r in out.collect()}
    fps = [brute_fingerprint(t) for _, t in TEXTS]
    cls = brute_classes(fps)
    for (i, t), f, c in zip(TEXTS, fps, cls, strict=True):
        assert got[i, t][fp] & (2**64 - 1) == f
        ids = [j for (j, _), d in zip(TEXTS, cls, strict=True) if d == c and j is not None]
        assert got[i, t][first] == (min(ids) if ids else None)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(cls))
    assert simhash.classes(empty(docs))[0].count() == 0


@pytest.mark.parametrize("block", [4096, 30])
def test_simhash_links(spark, block):
    base = rng.integers(0, 1 << 63, 60)
    fps = set(base.tolist())
    for b in base[:30]:
        for _ in range(8):
            x = int(b)
            for bit in rng.integers(0, 64, int(rng.integers(1, 7))):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in fps})
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), "fp", block)
    comp = {r.node: r.root for r in graph.components(edges).collect()}
    want = brute_classes([x & (2**64 - 1) for x in fps])
    assert len({(comp.get(x, x), c) for x, c in zip(fps, want, strict=True)}) == len(set(want)) == len({comp.get(x, x) for x in fps})
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in edges.collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (13 <= len(d) <= 19 and luhn) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_pii(spark):
    rows = ["", None, "a.b@c.d_x@e.f.g", "@a@b.c", "1.2.3.4.5.6.7.8.9", "0255.1.1.1 256.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (988) 555-2485 ++1 23456789012"]
    rows += ["x@y z@w..com a@b.c.", " +1 988 555 2485 é😀 a@b.co", "9" * 5000, "a@" * 3000 + "b.c", "5 5  5-5", "call me: (988) 555-2485 or joe at example dot com", "a@b.co"]
    rows += ["".join(rng.choice(list("a1.@+- ()9é"), 60)) for _ in range(300)]
    src = spark.createDataFrame([(i % 320, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, spans int")
    out, base, spans = pii.find(src, keep=["doc_id", "spans"])
    assert spans == "_spans"
    got = out.collect()
    assert len(got) == len(rows)
    want = Counter((i % 320, tuple(brute_spans(t))) for i, t in enumerate(rows))
    assert Counter((r.doc_id, tuple((pii.KINDS[x.kind], x.a, x.b) for x in r[base])) for r in got) == want
    assert all(set(r[base]) <= set(r[spans]) for r in got)
    joined = out.select(F.sha2(pii.joined(F.col(base)), 256).alias("h"), "doc_id").filter("doc_id = 14").first().h
    assert joined == hashlib.sha256(b"email:0:6").hexdigest()
    assert pii.find(src.limit(0))[0].count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_model_learns_from_agreement():
    f, g = (1, 2, 1, 0, 0, 5), (4, 0, 0, 3, 3, 7)
    m = pii.SpanModel({(3, (1, 1, 1, 1, 0, 1), f): 500, (3, (0, 1, 1, 1, 1, 1), f): 40, (3, (0, -1, -1, -1, -1, -1), g): 300, (3, (0, 1, -1, -1, 0, -1), g): 60})
    assert m.reliability[3][1][True, 1] > m.reliability[3][1][False, 1]
    score = lambda x: sum(m.weights[3].get(k, 0.0) for k in [(-1, 0), *enumerate(x)])
    assert score(f) > 2 and score(g) < -2


def test_pii_finds_more_than_its_base(spark):
    """Planted wider spans among look-alikes: precision and recall of what the method adds."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexed = lambda n: rng.bytes(n // 2).hex()
    fails = lambda d: not brute_spans(d)
    rows, want = [], {}
    for i in range(400):
        kind = i % 10
        card = next(d for d in iter(lambda: number(16), None) if fails(d))
        planted, other = {
            0: (f"{rng.choice(['joe', 'ann', 'kim'])}{number(2)} at {rng.choice(['mail', 'post'])} dot com", None),
            1: (f"({rng.integers(2, 10)}{number(2)}) {rng.integers(2, 10)}{number(2)}-{number(4)}", None),
            2: (":".join(["2001", "0db8", *[hexed(4) for _ in range(6)]]), None),
            3: (f'"{hexed(40)}"', None),
            4: (card, None),
            5: (None, f"version {i % 7}.1.0.{i % 9} of"),
            6: (None, f"ISBN 978{number(10)}"),
            7: (None, f"commit {hexed(40)}"),
            8: (None, "we looked at it dot and went on"),
            9: (None, " ".join(number(1) for _ in range(16))),
        }[kind]
        lead = {0: "mail ", 1: "call ", 2: "from ", 3: "token = ", 4: "card "}.get(kind, "")
        text = f"{prose(4)} {lead}{planted or other} {prose(4)}"
        rows.append((i, text))
        if planted:
            a = text.index(planted)
            want[i] = (a + 1, a + len(planted) - 1) if kind == 3 else (a, a + len(planted))
    out, base, spans = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    right, wrong = 0, Counter()
    for r in out.collect():
        for x in set(r[spans]) - set(r[base]):
            hit = want.get(r.doc_id) == (x.a, x.b)
            right += hit
            if not hit:
                wrong[r.doc_id % 10, x.kind] += 1
    assert right / len(want) >= 0.9 and right / (right + wrong.total()) >= 0.9, (right, wrong, len(want))


def test_pii_of_many_matches(spark):
    text = "1.2.3.4 a@b.co " * 3000
    out, base, _ = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [(pii.KINDS[x.kind], x.a, x.b) for x in out.first()[base]] == brute_spans(text)


# 10

PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>Home</a></nav><div class='box'>Join our list</div><div id='m'><p>{0} &amp; a<b>b</b>c</p><!-- x --><p>{1}<br>end</div><aside>see</aside><footer>f</footer></body></html>"


def test_html(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(prose(9), prose(5))) for i in range(8)]
    rows += [(8, None, None), (9, "http://h.example/9", ""), (10, "x", "plain &lt;text"), (11, "http://o.example", "<p>a\n b<article><h1>T</h1>x<div class='comments'>no</div></article>"), (11, "http://o.example", "<p>only"), (12, "u", "<" * 3000 + "<p>" * 3000 + "deep")]
    src = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, low int")
    out, name = html_main.extract(src)
    got = [(r.page_id, r[name]) for r in out.collect()]
    assert out.columns == [*src.columns, name] and len(got) == len(rows)
    by = dict(got)
    for i in range(8):
        a, b = re.search(r"<p>(.*?) &amp;", rows[i][2])[1], re.search(r"--><p>(.*?)<br>", rows[i][2])[1]
        assert by[i] == f"{a} & abc {b} end"  # the branch that all pages of the host share is gone
    assert by[8] == "" and by[9] == "" and by[10] == "plain <text"
    assert sorted(t for i, t in got if i == 11) == ["T x", "only"]
    assert by[12].endswith("deep")
    assert html_main.extract(src.limit(0))[0].count() == 0


def test_html_of_copied_articles(spark):
    copy = "<nav>{0}</nav><div class='wrap'><article id='post-7'><h1>Head</h1><div class='entry'><p>Body</p><table><tr><td>cell</td></tr></table></div></article></div>"
    rows = [(i, "http://c.example/", copy.format(i)) for i in range(6)]
    rows += [(10 + i, "http://l.example/", f"<article><p>{'copied' if i < 40 else i}</p><ul><li>{'same' if i < 40 else i} item</li></ul></article>") for i in range(43)]
    rows += [(100 + i, "http://n.example/", f"<main><p>near {i}</p><section>kept by all</section></main>") for i in range(8)]
    out, name = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    by = {r.page_id: r[name] for r in out.collect()}
    assert all(by[i] == "Head Body cell" for i in range(6))
    assert by[10] == "copied same item" and by[52] == "42 42 item"
    assert all(by[100 + i] == f"near {i} kept by all" for i in range(8))


UNNAMED = (
    "<body><div class='x1'><ul><li><a href=1>{0} one</a></li><li><a href=2>{0} two</a></li><li><a href=3>{0} three</a></li></ul></div>"
    "<div class='q'><p>We keep small files on your machine.</p></div><div class='sidebar-right'><h2><a href=4>{0} title</a></h2><p>{1}</p><p>Sign up for our letter today.</p><p>{2}</p></div>"
    "<div class='sidebar'><p>{3}</p></div></body>"
)


def test_style_tree_finds_what_has_no_name(spark):
    """A menu, a notice and a repeated line without noise names, and a layout name around the text: the tree changes every page."""
    rows = [(i, "http://t.example/", UNNAMED.format(f"n{i}", prose(30), prose(20), prose(3))) for i in range(12)]
    src = spark.createDataFrame(rows, "page_id long, url string, html string")
    out, name = html_main.extract(src)
    got = {r.page_id: r[name] for r in out.collect()}
    for i, _, page in rows:
        one, two = re.findall(r"<p>(.*?)</p>", page)[1], re.findall(r"<p>(.*?)</p>", page)[3]
        assert got[i] == f"n{i} title {one} {two}"
    assert sum(got[i] != html_main.read(page).text() for i, _, page in rows) == 12


def test_style_tree_against_brute_force(spark):
    """Importance of every place, from entropies of a tree merged by hand."""

    def made(i):  # (class, own text, children)
        leaf = lambda c: (c, str(rng.choice(["same", "other", f"own {i}"])), [])
        return ("top", "", [("a", "", [leaf("l"), leaf("m")][: 1 + i % 2]), ("b", f"text {i % 3}", [leaf("n")]), leaf("c")])

    def html_of(x):
        return f"<div class={x[0]}>{x[1]}{''.join(map(html_of, x[2]))}</div>"

    trees = [made(i) for i in range(20)]
    main = {}
    rows = [(i, "http://b.example/", html_of(t)) for i, t in enumerate(trees)]
    text = lambda x: " ".join(filter(None, [x[1], *map(text, x[2])]))
    for i, t in enumerate(trees):  # one page stands for all with its main text
        main.setdefault(text(t), []).append(i)
    styles = html_main.read_styles(spark.createDataFrame(rows, "page_id long, url string, html string"))
    by_page = {r.main: min(x.page for x in styles.collect() if x.main == r.main) for r in styles.collect()}
    chosen = {r.page for r in styles.collect() if by_page[r.main] == r.page}
    hashes = {r.page_id: r.h for r in spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", F.xxhash64("html").alias("h")).collect()}
    use = {hashes[i]: t for i, t in enumerate(trees) if hashes[i] in chosen}
    assert len(use) == len(main)
    shapes, own = defaultdict(list), defaultdict(list)

    def walk(x, path):
        at = (*path, x[0])
        shapes[at].append(len(x[2]) > 0)  # all children are div: runs count once
        own[at].append(x[1])
        for y in x[2]:
            walk(y, at)

    for t in use.values():
        walk(t, ())
    content = {p: html_main.entropy(list(Counter(v).values())) for p, v in own.items()}
    chars = {p: sum(map(len, v)) for p, v in own.items()}
    want = []
    for p, v in shapes.items():
        under = [q for q in own if q[: len(p)] == p]
        total = sum(chars[q] for q in under)
        mean = sum(chars[q] * content[q] for q in under) / total if total else 1.0
        g = 0.9 ** len(set(v))
        want.append(((1 - g) * html_main.entropy(list(Counter(v).values())) + g * mean, len(v)))
    tree = html_main.style_tree(styles).filter(f"path <> {html_main.ROOT}").collect()
    assert np.allclose(sorted((r.importance, r.pages) for r in tree), sorted(want))


def test_named_noise_and_headers():
    assert html_main.read("<div class='siteHeader'>x</div><article><div class=entry-header><h1>T</h1></div><p>y <span class=ad>no</span>z</article>").text() == "T y z"
    assert html_main.read("<div class=mainNav>menu</div><p>text").text() == "text"
