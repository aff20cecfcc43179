"""Signals as tables.

Long form: signal_id, n (position from 0), x. Packed form: signal_id, samples (array of double or float). Stereo: pair_id,
left, right. Images: image_id, r, c, v. Positions without a row are zero samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_long(packed: DataFrame, samples: str = "samples", key: str = "signal_id") -> DataFrame:
    """Packed to long; an empty or null signal is an error, as every operator needs one sample."""
    checked = F.when(F.coalesce(F.size(samples), F.lit(0)) > 0, F.col(samples)).otherwise(F.raise_error(F.lit("a signal is empty")))
    return packed.select(F.col(key), F.posexplode(checked).alias("n", "x")).select(key, F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"))


def to_packed(long: DataFrame, key: str = "signal_id") -> DataFrame:
    """Long to packed, for signals that fit one row; gaps become zeros."""
    rows = F.collect_list(F.struct("n", "x"))
    one = long.groupBy(key).agg(rows.alias("_r"), F.max("n").alias("_last"))
    filled = F.map_from_entries("_r")
    return one.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_last")), lambda i: F.coalesce(F.element_at(filled, i), F.lit(0.0))).alias("samples"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed signals of 64 samples: the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


#: Hours of the series of events, from the first of January 2024 on.
HOURS = 720


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long signals of HOURS samples, one for each type of event: thousands of value an hour, a row for every hour; an event outside these is an error."""
    events = table(spark, sf_dir, "events")
    hour = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")
    # Whole hundredths are summed, so the order of rows does not matter.
    sums = events.groupBy(F.col("event_type").alias("signal_id"), hour.alias("n")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(100000.0)).alias("x"))
    inside = F.when(F.col("n").between(0, HOURS - 1), F.col("n")).otherwise(F.raise_error(F.lit("an event is outside the series")).cast("long"))
    sums = sums.withColumn("n", inside)
    grid = sums.select("signal_id").distinct().select("signal_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOURS - 1).cast("long"))).alias("n"))
    return grid.join(sums, ["signal_id", "n"], "left").select("signal_id", "n", F.coalesce("x", F.lit(0.0)).alias("x"))


def stereo(left: DataFrame, right: DataFrame, key: str = "signal_id") -> DataFrame:
    """pair_id, n, left, right of two long tables with equal keys."""
    l, r = left.select(F.col(key).alias("pair_id"), "n", F.col("x").alias("left")), right.select(F.col(key).alias("pair_id"), "n", F.col("x").alias("right"))
    return l.join(r, ["pair_id", "n"])


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo signals of 64 samples: vectors 2i and 2i + 1."""
    both = to_long(vectors(spark, sf_dir))
    side = F.pmod(F.col("signal_id"), F.lit(2))
    pair = F.floor(F.col("signal_id") / 2).cast("long")
    return both.groupBy(pair.alias("pair_id"), "n").agg(F.sum(F.when(side == 0, F.col("x"))).alias("left"), F.sum(F.when(side == 1, F.col("x"))).alias("right")).where("left is not null and right is not null")


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 rows and columns: the embeddings, row by row."""
    return to_long(vectors(spark, sf_dir)).select(F.col("signal_id").alias("image_id"), F.floor(F.col("n") / 8).cast("int").alias("r"), (F.col("n") % 8).cast("int").alias("c"), F.col("x").alias("v"))


def pad_to_longest(frames: DataFrame, key: str = "signal_id") -> DataFrame:
    """Zero rows (signal_id, frame, bin, value) so that all signals have as many frames as the longest: a rectangular batch."""
    span = frames.agg(F.max("frame").alias("last"), F.max("bin").alias("top"))
    ids = frames.select(key).distinct()
    # The span is one row.
    grid = ids.join(F.broadcast(span)).select(key, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("frame"), "top").select(key, "frame", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bin"))
    return grid.join(frames.select(key, F.col("frame").cast("int").alias("frame"), F.col("bin").cast("int").alias("bin"), "value"), [key, "frame", "bin"], "left").select(key, "frame", "bin", F.coalesce("value", F.lit(0.0)).alias("value"))


def require_column(df: DataFrame, *names: str) -> None:
    from ..errors import require

    for n in names:
        require(n in df.columns, f"the table has no column {n}")


def seconds(frame: Column, hop: int, sample_rate: float) -> Column:
    """Time of a frame: it begins at 0 whether or not frames are centred."""
    return frame.cast("double") * F.lit(float(hop)) / F.lit(float(sample_rate))
