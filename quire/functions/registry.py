"""Lookups and policies that are tables: assets and caches, engines and voices, outcome codes, formats of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits.
MOST_ASSET = 25 << 20
SHARE = 0.3


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def asset_url(base: Column, path: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(base, "/+\\z", ""), path)


def cache_name(prefix: str, tier: Column, default: str) -> Column:
    return F.when(tier == default, prefix).otherwise(F.concat(F.lit(prefix + "-"), tier))


def is_cache_name(name: Column, prefix: str) -> Column:
    return (name == prefix) | name.startswith(prefix + "-")


def stale_caches(names: DataFrame, prefix: str, current: str) -> DataFrame:
    return names.filter(is_cache_name(F.col("name"), prefix) & (F.col("name") != current))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def asset_limit(override: Column) -> Column:
    good = override.isNotNull() & ~F.isnan(override) & (override > 0) & (override < float("inf"))
    return F.when(good, override).otherwise(float(MOST_ASSET))


def preflight(assets: DataFrame, have: DataFrame, free: Column, limit: Column | None = None) -> DataFrame:
    """assets (tier, id, bytes), have (id): whether a tier's missing assets may be fetched, by tier; free: bytes, or null."""
    need = assets.join(have, "id", "left_anti").groupBy("tier").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
    full = assets.select("tier").distinct().join(need, "tier", "left").na.fill(0, ["bytes", "largest"])
    code = F.when(F.col("largest") > (F.lit(MOST_ASSET) if limit is None else limit), "single-file-over-limit").when(free.isNull(), "no-storage-api").when(F.col("bytes") > free, "insufficient-storage").otherwise("ok")
    return full.select("tier", "bytes", code.alias("code"), code.isin("single-file-over-limit", "insufficient-storage").alias("blocked"))


def pick_voice(voices: DataFrame, name: str | None, lang: str) -> DataFrame:
    """voices (idx, name, lang, is_default): by exact name, exact language, language with the other separator, primary tag,
    default; the first of equals; no row if none fits."""
    low, own = F.lower(F.col("lang")), lang.lower()
    rank = (
        F.when(F.col("name") == F.lit(name), 0).when(low == own, 1).when(F.replace(low, F.lit("_"), F.lit("-")) == own.replace("_", "-"), 2)
        .when(F.split(low, "[-_]")[0] == own.replace("_", "-").split("-")[0], 3).when(F.col("is_default"), 4)
    )
    return voices.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "idx").limit(1).drop("rank")


def outbound(specs: DataFrame, settings: Column) -> DataFrame:
    """specs (path, endpoint_key, flag_key): whether each way out is enabled and has its endpoint; settings: map<string, string>."""
    full = F.coalesce(settings[F.col("endpoint_key")], F.lit("")) != ""
    on = F.coalesce(settings[F.col("flag_key")], F.lit("")) == "true"
    return specs.select("path", on.alias("enabled"), full.alias("capable"))


def admit_outbound(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """candidates (…, area, page_area): those that may be sent, and those that may not with the reason."""
    measured = (F.col("area") > 0) & (F.col("page_area") > 0)
    reason = F.when(~F.coalesce(measured, F.lit(False)), "unmeasured").when(F.col("area") / F.col("page_area") > SHARE, "too_large")
    marked = candidates.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def clamp(x: Column, low: float, high: float, nan: float) -> Column:
    return F.when(x.isNull() | F.isnan(x), nan).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def flag_on(value: Column) -> Column:
    """On, unless it says 0, false or off."""
    return ~F.coalesce(value.isin("0", "false", "off"), F.lit(False))


def codes_unique(codes: DataFrame) -> DataFrame:
    return codes.agg((F.count("code") == F.count_distinct("code")).alias("unique"))


def histogram(rows: DataFrame, by: list[str], label: str, order: str) -> DataFrame:
    """label×n of each group, in order of first appearance, joined by 、."""
    counted = rows.groupBy(*by, label).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    item = F.struct("at", F.concat(F.col(label), F.lit("×"), F.col("n").cast("string")).alias("t"))
    return counted.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "、").alias("summary"))


def budgeted(items: DataFrame, by: list[str], order: str, text: str, budget: int) -> DataFrame:
    """The longest beginning of each group's items whose texts fit a budget of characters, and how many did not."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = items.withColumn("_used", F.sum(F.length(text)).over(w))
    return total.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("_used") <= budget, F.struct(order, text)))).alias("kept"),
        F.count_if(F.col("_used") > budget).alias("dropped"),
    )
