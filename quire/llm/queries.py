"""The queries of this subpackage: each applies one operator to its whole table, and derives what its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh, held_out, table

#: Where the public tokenizers' files lie: a parameter.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import repeats

    found = repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        total(F.col("repeated")).alias("n_repeated"),
        total(F.col("later")).alias("n_later"),
        text(F.col("repeated")).alias("repeated"),
        text(F.col("later")).alias("later"),
    )


def op2_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontaminate import contaminated, decontaminate

    got = decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), out="d")
    return got.select(
        "doc_id",
        F.col("d.n_words").alias("n_words"),
        F.col("d.n_hit").alias("n_hit"),
        F.size("d.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("d.items", ","), 256).alias("items_sha256"),
        contaminated("d").alias("contaminated"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.line_dedup import dedup, spans

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out, kept, gone = dedup(docs)
    return out.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        spans(F.col(gone)).alias("removed"),
        F.sha2(F.col(kept).cast("binary"), 256).alias("kept_sha256"),
    )


def op4_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.language import identify, learn

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out, lang, score = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import learn, score

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    language = learn(docs)
    out, _ = score(docs, language, keep=["doc_id"])
    return out.select(
        "doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", "n_known",
        F.lit(language.n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte",
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pieces import encode

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    both = encode(docs, PIECES, out="ids", decoded="decoded")
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import classes, hexed

    out, fp, _, first = classes(table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", hexed(F.col(fp)).alias("fingerprint"), F.col(first).alias("component_id"))


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pii import KINDS, find, joined

    out, base, spans = find(table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *[count(k) for k in range(4)], F.sha2(joined(F.col(base)), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def op10_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.html_main import extract

    out, text = extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()]
    return {f.__name__: f for f in own}


LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return {
        "op2_fm_index_decontamination": f"""
with d as (select doc_id, text, {words} as w, row_number() over () as r from documents),
b as (select item_id, {words} as w from benchmark),
win as (select distinct item_id, list_slice(w, k, k + 12) as win
        from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from b where len(w) > 0)),
size as (select distinct len(win) as n from win),
occ as (select r, k, n, list_slice(w, k, k + n - 1) as win
        from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, size where len(w) >= n)),
hit as (select o.r, o.k, o.n, w.item_id from occ o join win w on o.win = w.win),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hit) group by r),
its as (select r, count(*) as n_items, string_agg(i, ',' order by i) as items
        from (select distinct r, cast(item_id as varchar) as i from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (r) left join its using (r)""",
        "op3_line_dedup": f"""
with d as (select doc_id, text, string_split(text, chr(10)) as a, {LINES} as l from documents),
w as (select doc_id, k, list_slice(l, k + 1, k + 3) as win from (select doc_id, l, unnest(range(0, len(l) - 2)) as k from d where len(l) >= 3)),
f as (select *, row_number() over (partition by win order by doc_id, k) as n from w),
c as (select distinct doc_id, unnest(range(k, k + 3)) as p from f where n > 1),
g as (select doc_id, p, p - row_number() over (partition by doc_id order by p) as isle from c),
s as (select doc_id, string_agg(a || ':' || b, ',' order by a) as removed, cast(sum(b - a) as bigint) as n_removed
      from (select doc_id, min(p) as a, max(p) + 1 as b from g group by doc_id, isle) group by doc_id),
x as (select doc_id, unnest(a) as line, unnest(range(0, len(a))) as i from d),
y as (select doc_id, line, i, trim(line, ' ' || chr(9) || chr(13)) = '' as blank,
             sum(case when trim(line, ' ' || chr(9) || chr(13)) = '' then 0 else 1 end) over (partition by doc_id order by i) - 1 as p from x),
z as (select y.doc_id, coalesce(string_agg(line, chr(10) order by i), '') as kept
      from y left join c on y.doc_id = c.doc_id and y.p = c.p where y.blank or c.p is null group by y.doc_id)
select d.doc_id, cast(len(a) as bigint) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s using (doc_id) left join z using (doc_id)""",
    }
