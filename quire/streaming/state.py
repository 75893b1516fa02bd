"""State that expires: last stages, interrupted work, crash counts, checkpoints; as batch rules, and as streams.

Events have a time column of type timestamp (one without a zone is cast in the session's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How long an entry counts, how many are kept, how often a loop saves.
FRESH_MINUTES, CRASH_DAYS, HISTORY, EVERY = 30, 30, 5, 5


def fresh(at: Column, now: Column, minutes: int = FRESH_MINUTES) -> Column:
    """Not older than so many minutes; an entry without time counts."""
    return at.isNull() | (at >= now - F.expr(f"INTERVAL {minutes} MINUTES"))


def last_stages(events: DataFrame, key: str, at: str, order: str, keep: int = HISTORY) -> DataFrame:
    """The last entries of each key, the newest first."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(order))
    return events.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= keep)


def trail(events: DataFrame, key: str, at: str, order: str, minutes: int = FRESH_MINUTES) -> DataFrame:
    """Of each key, what is fresh at the time of its last entry."""
    last = events.groupBy(key).agg(F.max(at).alias("_now"))
    return events.join(last, key).filter(fresh(F.col(at), F.col("_now"), minutes)).drop("_now")


def last_stage(events: DataFrame, key: str, at: str, order: str, *cols: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(F.struct(at, *cols), F.struct(at, order)).alias("e")).select(key, "e.*")


def save_here(page: Column, total: Column, successes: Column) -> Column:
    """After the first success, every fifth page and the last."""
    return (successes == 1) | (page == total) | (page % EVERY == 0)


def crashes(attempts: DataFrame, reloads: DataFrame) -> DataFrame:
    """attempts (session, build, at, finished), reloads (session): unfinished ones without a planned reload, by build."""
    lost = attempts.filter(~F.col("finished")).join(reloads.select("session").distinct(), "session", "left_anti")
    return lost.groupBy("build").agg(F.count("*").alias("count"), F.max("at").alias("at"))


def live_crashes(record: DataFrame, now: Column, build: Column, days: int = CRASH_DAYS) -> DataFrame:
    return record.filter((F.col("build") == build) & (F.col("at") >= now - F.expr(f"INTERVAL {days} DAYS")))


def sessions(events: DataFrame, key: str, at: str, minutes: int = FRESH_MINUTES) -> DataFrame:
    """Runs of entries with gaps of at most so many minutes; the same on a stream, with a watermark."""
    made = events.groupBy(key, F.session_window(at, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return made.select(key, "first", "last", "n")


def windowed(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and keys, open to entries that come up to `late` after."""
    src = events.withWatermark(at, late) if events.isStreaming else events
    made = src.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), *keys, "n")


def once(events: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """Each key once: a queue that never takes an entry twice."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def checkpointed(pages: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """A stream of page results, kept in a folder as the latest row of each key: each batch is written under its number,
    so a batch that runs again replaces itself, and readers take the latest."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    cols = [c for c in stored.columns if c != "batch"]
    best = stored.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(order, "batch")).alias("row"))
    return best.select("row.*")


def reloads(loads: DataFrame, session: str = "session") -> DataFrame:
    """(session, reloads): how often each has been loaded, once at least."""
    return loads.groupBy(session).agg(F.greatest(F.count("*"), F.lit(1)).alias("reloads"))


def remaining(done: Column, total: Column, elapsed: Column) -> Column:
    """Time that is left at the pace so far, in the unit of `elapsed`; null until three are done."""
    return F.when(done >= 3, elapsed / done * (total - done))


def signature(reloads_: Column, page: Column, total: Column, crashes_: Column, stages: Column) -> Column:
    """What a notice was about, so that it is not shown twice."""
    stopped = F.coalesce(F.concat_ws("/", page.cast("string"), F.when(page.isNotNull(), total).cast("string")), F.lit("-"))
    return F.concat_ws("|", reloads_.cast("string"), F.when(page.isNull(), "-").otherwise(stopped), crashes_.cast("string"), stages.cast("string"))


def offsets(items: DataFrame, by: list[str], order: str, height: str, estimate: float = 120.0) -> DataFrame:
    """items with `top` and `high`: a running sum of heights, those not measured as the estimate."""
    high = F.coalesce(F.col(height).cast("double"), F.lit(estimate))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("high", high).withColumn("top", F.coalesce(F.sum("high").over(w), F.lit(0.0)))


def window(items: DataFrame, views: DataFrame, by: list[str], order: str, height: str, buffer: int = 6, estimate: float = 120.0) -> DataFrame:
    """views (by…, scroll, viewport): (by…, first, start, end, above, below): the first item in view, the range to draw with
    `buffer` more at each end, and the heights that stand for the rest.  order: 0, 1, 2, ..."""
    placed = offsets(items, by, order, height, estimate)
    met = placed.join(views, by)
    top, bottom = F.col("top"), F.col("scroll") + F.col("viewport")
    seen = met.groupBy(*by).agg(
        F.coalesce(F.max(F.when(top <= F.col("scroll"), F.col(order))), F.lit(0)).alias("first"), F.count("*").alias("n"), F.sum("high").alias("total"),
        F.coalesce(F.max(F.when(top < bottom, F.col(order))) + 1, F.lit(0)).alias("reach"),
    )
    end = F.greatest("reach", F.col("first") + 1)
    cut = seen.withColumn("start", F.greatest(F.lit(0), F.col("first") - buffer)).withColumn("end", F.least("n", end + buffer))
    edge = placed.join(cut, by).groupBy(*by).agg(F.max(F.when(F.col(order) == F.col("start"), top)).alias("above"), F.max(F.when(F.col(order) == F.col("end") - 1, F.col("total") - top - F.col("high"))).alias("below"))
    return cut.join(edge, by).select(*by, "first", "start", "end", "above", F.greatest("below", F.lit(0.0)).alias("below"))
