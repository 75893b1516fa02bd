"""What is written out: exports with their envelope, metrics lines, tables of decisions, and the text of a document's pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import registry
from quire.functions import text as t

#: Outcomes of a layout analysis: whether trying again can help, and what to look at.
OUTCOMES = {
    "none": ("the regions come from the model", "nothing"),
    "feature_disabled": ("the analysis is switched off", "switch it on"),
    "canvas_unreadable": ("the pixels cannot be read", "look at the environment"),
    "geometry_unusable": ("the image has no size", "look at the rendering"),
    "session_load_failed": ("the model could not be loaded", "look at the network, then start anew"),
    "inference_failed": ("the model failed on this page", "try the next page"),
    "model_output_missing": ("the model's outputs are not those expected", "look at the model's version"),
    "no_regions_detected": ("no region was found", "look at the detail"),
}


def outcome(code: Column, regions: Column, width: Column, height: Column, detail: Column) -> Column:
    """struct<used, code, regions, width, height, detail, meaning, action>: counts only of what was used, a detail only of what failed."""
    used = code == "none"
    said = lambda k: registry.lookup({c: v[k] for c, v in OUTCOMES.items()}, code)
    only = lambda x: F.when(used, x)
    return F.struct(
        used.alias("used"), code.alias("code"), only(regions).alias("regions"), only(width).alias("width"), only(height).alias("height"),
        F.when(~used, F.nullif(detail, F.lit(""))).alias("detail"), said(0).alias("meaning"), said(1).alias("action"),
    )


def thresholds(defaults: dict[str, float], own: Column) -> Column:
    """The defaults, and what is set over them."""
    base = F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (k, float(v))])
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False))), F.coalesce(own, F.create_map().cast("map<string,double>")))


def record(value: Column) -> Column:
    """A text that is a JSON object, or null."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return F.when(kind.startswith("OBJECT"), value)


def format_changes(spark: SparkSession, removed: list[tuple[str, bool, str]], fields: list[str], changes: dict[str, tuple[bool, str]]) -> DataFrame:
    """(field, breaking, why): fields that went, then those there are."""
    rows = [*removed, *[(f, *changes.get(f, (False, "added"))) for f in fields]]
    return spark.createDataFrame(rows, "field string, breaking boolean, why string")


def breaks(changes: DataFrame) -> DataFrame:
    return changes.agg(F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("breaking"))


def envelope(schema: str, version: int, producer: str, build: str | None, whole: Column, contract: list[str], breaking: bool) -> Column:
    """What an export says of itself."""
    return F.struct(
        F.lit(schema).alias("schema"), F.lit(version).alias("schema_version"), F.struct(F.lit(producer).alias("name"), F.lit(build or "unknown").alias("version")).alias("producer"),
        F.struct(whole.alias("is_full_document")).alias("document"), F.array(*[F.lit(x) for x in contract]).alias("contract"), F.lit(breaking).alias("breaking"),
    )


def fingerprint(contract: dict) -> Column:
    """Length and hash of a self-description's JSON."""
    from quire.functions import hashes

    text = json.dumps(contract, ensure_ascii=False, separators=(",", ":"))
    return F.concat(t.len16(F.lit(text)).cast("string"), F.lit(":"), hashes.fnv32(F.lit(text)))


def metrics_line(name: str, *cols: str) -> Column:
    """One line of JSON under a name."""
    return F.concat(F.lit(f"[{name}] "), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def decision_table(decided: DataFrame, by: list[str], order: str, cols: list[str]) -> DataFrame:
    """(by…, table): Markdown, a row a line, cells flat and short; nulls as a dash."""
    head = F.lit("| " + " | ".join(cols) + " |\n|" + "---|" * len(cols))
    cell = lambda c: F.coalesce(t.table_cell(F.col(c).cast("string")), F.lit("—"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cols]), F.lit(" |"))
    rows = decided.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("l"))
    return rows.select(*by, F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["r"]), "\n")).alias("table"))


def assembled(paragraphs: DataFrame, by: list[str], page: str, separator: str | None = None, markdown: bool = False, title: str = "") -> DataFrame:
    """(by…, body): the text of a document's pages in order.  paragraphs: (by…, page, paragraph, text); separator: N stands for the page."""
    full = paragraphs.filter(t.trim(F.col("text")) != "")
    each = full.groupBy(*by, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", t.trim(F.col("text")).alias("s")))), lambda x: x["s"]), "\n\n").alias("s"))
    number = F.col(page).cast("string")
    mark = F.regexp_replace(F.lit(separator), F.lit(r"\bN\b"), number) if separator is not None else F.concat(F.lit("<!-- page "), number, F.lit(" -->"))
    part = F.concat_ws("\n\n", *([mark] if markdown else []), F.col("s"))
    got = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), part.alias("s")))).alias("l"))
    body = t.trim(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["s"]), "\n\n"), "\n{3,}", "\n\n"))
    return got.select(*by, F.concat(F.lit(f"<!-- {title} -->\n\n" if markdown else ""), body, F.lit("\n")).alias("body"))


def benchmark_problems(fields: Column) -> Column:
    """What a benchmark's description lacks: array of names.  fields: map<string, string>."""
    names = ("name", "version", "source", "annotatedBy", "annotatedAt")
    lacking = [F.when(t.trim(F.coalesce(fields[n], F.lit(""))) == "", n) for n in names]
    count = F.when(~F.coalesce(fields["pageCount"], F.lit("")).rlike(r"^0*[1-9][0-9]*\z"), "pageCount")
    return F.filter(F.array(*lacking, count), lambda x: x.isNotNull())


def prediction_pages(text: Column) -> Column:
    """The pages of a predictions file, as an array of JSON texts: the file itself, its `pages` or its `predictions`."""
    v = F.try_parse_json(text)
    listed = lambda path: F.try_variant_get(v, path, "array<variant>")
    return F.transform(F.coalesce(listed("$"), listed("$.pages"), listed("$.predictions"), F.array().cast("array<variant>")), lambda x: F.to_json(x))


def quality_tier(has_layout_model: Column, default: str = "standard") -> Column:
    return F.when(has_layout_model, default).otherwise("fast")


def boot_noteworthy(outcome_: Column, failed: Column, cleaned: Column) -> Column:
    """failed, cleaned: arrays."""
    return F.coalesce(outcome_.isin("blocked", "error") | (F.size(failed) > 0) | (F.size(cleaned) > 0), F.lit(False))


def cloud_configured(endpoint: Column) -> Column:
    return t.trim(F.coalesce(endpoint, F.lit(""))) != ""


def initial_engine(configured: Column, cloud: Column, browser: Column) -> Column:
    """The engine that is asked for, if it can be had; the browser's, if it has one; else none."""
    asked_cloud = configured.isin("deepl", "openai") & cloud
    asked_browser = configured == "browser"
    own = F.when(browser, "browser")
    return F.when(asked_cloud, configured).when(asked_browser, F.coalesce(own, F.when(cloud, "deepl"))).otherwise(own)
