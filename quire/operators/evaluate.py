"""Scores of predicted regions against true ones: greedy matching, precision, recall, F1 by class, and a release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.text import round_half_up
from quire.operators.layout import LABELS, PAGE

MATCH_IOU = 0.5


def matched(truth: DataFrame, predicted: DataFrame, page: list[str] = PAGE, least: float = MATCH_IOU) -> DataFrame:
    """(page…, t, p, iou): in the order of truths, each takes the best unused prediction of its label; equal ones the first.
    A fold over the page's truths: the predictions still free are the state."""
    box = ["x0", "y0", "x1", "y1"]
    ts = truth.groupBy(*page, "label").agg(F.array_sort(F.collect_list(F.struct("idx", *box))).alias("ts"))
    ps = predicted.groupBy(*page, "label").agg(F.array_sort(F.collect_list(F.struct("idx", *box))).alias("ps"))
    met = ts.join(ps, [*page, "label"])
    kind = "array<struct<t:int,p:int,iou:double>>"

    def step(acc: Column, t: Column) -> Column:
        free = F.filter("ps", lambda p: ~F.exists(acc, lambda m: m["p"] == p["idx"]))
        scored = F.transform(free, lambda p: F.struct(g.iou(t, p).alias("iou"), (-p["idx"]).alias("minus")))
        best = F.array_max(scored)
        hit = F.struct(t["idx"].cast("int").alias("t"), (-best["minus"]).cast("int").alias("p"), best["iou"].cast("double").alias("iou"))
        return F.when(best["iou"] >= least, F.concat(acc, F.array(hit))).otherwise(acc)

    return met.select(*page, F.explode(F.aggregate("ts", F.array().cast(kind), step)).alias("m")).select(*page, "m.*")


def by_label(truth: DataFrame, predicted: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """All classes in order, and their micro average: tp, fp, fn, precision, recall, f1 (null where undefined), 4 places."""
    spark: SparkSession = truth.sparkSession
    hits = matched(truth, predicted, page).join(truth.select(*page, F.col("idx").alias("t"), "label"), [*page, "t"])
    count = lambda df, name: df.groupBy("label").agg(F.count("*").alias(name))
    names = spark.createDataFrame(list(enumerate(LABELS)), "class_id int, label string")
    rows = names.join(count(truth, "n_true"), "label", "left").join(count(predicted, "n_pred"), "label", "left").join(count(hits, "tp"), "label", "left").na.fill(0, ["n_true", "n_pred", "tp"])
    micro = rows.agg(F.lit(len(LABELS)).alias("class_id"), F.lit("micro").alias("label"), *[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp")])
    rows = rows.select("class_id", "label", "n_true", "n_pred", "tp").union(micro.select("class_id", "label", "n_true", "n_pred", "tp"))
    p, r = F.try_divide("tp", "n_pred"), F.try_divide("tp", "n_true")
    f = F.try_divide(F.lit(2.0) * F.col("tp"), F.col("n_pred") + F.col("n_true"))
    four = lambda x: F.when(x.isNotNull(), round_half_up(x, 4))
    return rows.select(
        "class_id", "label", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"),
        four(p).alias("precision"), four(r).alias("recall"), four(f).alias("f1"),
    )


def gate(scores: DataFrame, needed: list[str], precision: float, recall: float) -> DataFrame:
    """(passed, failing): of the needed classes, an undefined ratio passes, a class without predictions does not."""
    own = scores.filter(F.col("label").isin(needed))
    ok = F.coalesce(F.col("precision") >= precision, F.lit(True)) & F.coalesce(F.col("recall") >= recall, F.lit(True)) & (F.col("tp") + F.col("fp") > 0)
    return own.agg(F.bool_and(ok).alias("passed"), F.sort_array(F.collect_list(F.when(~ok, F.col("label")))).alias("failing"))


def scrambled(predicted: DataFrame, one: str, other: str) -> DataFrame:
    """A negative control: one label renamed."""
    return predicted.withColumn("label", F.when(F.col("label") == one, other).otherwise(F.col("label")))


def report(scores: DataFrame) -> DataFrame:
    """(markdown): a table in the classes' order."""
    cell = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "label", *[F.col(c).cast("string") for c in ("tp", "fp", "fn")], *[cell(c) for c in ("precision", "recall", "f1")]), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct("class_id", line.alias("line"))))
    head = "| class | tp | fp | fn | precision | recall | f1 |\n|-|-|-|-|-|-|-|\n"
    return scores.agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("markdown"))
