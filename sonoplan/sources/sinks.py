"""Results out of Spark: arrays, Parquet and JSON, with the parameters in the schema."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch


def with_metadata(df: DataFrame, column: str, **facts) -> DataFrame:
    """The column with facts (scales, rates, sizes) in its metadata, which Parquet keeps."""
    return df.withMetadata(column, {**df.schema[column].metadata, **facts})


def metadata(df: DataFrame, column: str) -> dict:
    return dict(df.schema[column].metadata)


def to_matrix(one_signal: DataFrame, value: str = "value", dtype: str = "float64") -> np.ndarray:
    """A (bins, frames) array of one signal's long result; for results that fit the driver."""
    kinds = {"float64": np.float64, "f64": np.float64, "double": np.float64, "float32": np.float32, "f32": np.float32, "single": np.float32}
    if dtype not in kinds:
        raise ValueError(f"unknown dtype {dtype!r}")
    rows = one_signal.select("bin", "frame", value).toArrow()
    bins, frames = rows["bin"].to_numpy(), rows["frame"].to_numpy()
    out = np.zeros((int(bins.max(initial=-1)) + 1, int(frames.max(initial=-1)) + 1), kinds[dtype])
    out[bins, frames] = rows[value].to_numpy()
    return out


def transpose(df: DataFrame) -> DataFrame:
    """Bins and frames swapped."""
    return df.withColumnsRenamed({"bin": "_b", "frame": "bin"}).withColumnRenamed("_b", "frame")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def preview(df: DataFrame, value: str = "value") -> DataFrame:
    """n, minimum, maximum, mean of a result."""
    return df.agg(F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("mean"))


def corner(df: DataFrame, key: str = "signal_id", value: str = "value", size: int = 5) -> DataFrame:
    """The first bins and frames of each signal, one row a bin: what a result shows of itself."""
    few = df.where((F.col("bin") < size) & (F.col("frame") < size))
    return few.groupBy(key, "bin").pivot("frame", list(range(size))).agg(F.first(value))


def norm(df: DataFrame, value: str = "value", order: float = 2.0) -> DataFrame:
    """norm of all values: 1 (sum of sizes), 2, inf (largest size) or another order."""
    size = F.abs(value)
    if order == float("inf"):
        return df.agg(F.max(size).alias("norm"))
    return df.agg(F.pow(F.sum(F.pow(size, F.lit(float(order)))), F.lit(1 / order)).alias("norm"))


def batch(df: DataFrame, key: str = "signal_id", pad: float | None = None, value: str = "value") -> tuple[list, np.ndarray]:
    """Keys and a (signals, bins, frames) array of a long result that fits the driver; signals of unlike lengths are an error, or padded with pad."""
    rows = df.select(key, "bin", "frame", value).toArrow()
    names = np.array(rows[key].to_pylist(), dtype=object)
    keys = sorted(set(names.tolist()))
    place = {k: n for n, k in enumerate(keys)}
    at, bins, frames = np.array([place[k] for k in names], int), rows["bin"].to_numpy(), rows["frame"].to_numpy()
    shape = len(keys), int(bins.max(initial=-1)) + 1, int(frames.max(initial=-1)) + 1
    if pad is None and len(names) != int(np.prod(shape)):
        raise DimensionMismatch(int(np.prod(shape)), len(names))
    out = np.full(shape, 0.0 if pad is None else pad)
    out[at, bins, frames] = rows[value].to_numpy()
    return keys, out


def batch_with_metadata(df: DataFrame, frequencies, hop: int, sample_rate: float, key: str = "signal_id", pad: float | None = None) -> dict:
    """The batch with its keys, frequencies, times and the range of its values in dB."""
    keys, values = batch(df, key, pad)
    power = 10 * np.log10(values + 1e-12) if values.size and (values >= 0).all() else values
    return {
        "keys": keys, "values": values, "frequencies": np.asarray(frequencies, float), "times": np.arange(values.shape[2]) * hop / sample_rate,
        "db_range": (float(power.min()), float(power.max())) if values.size else None,
    }


def describe(params) -> str:
    """A parameter object as JSON."""
    from dataclasses import asdict

    return json.dumps(asdict(params), default=str, sort_keys=True)


def parameters(kind: type, text: str):
    """The parameter object of a kind from what describe gave; nested ones, windows among them, are made of their own fields."""
    import dataclasses
    import typing

    def build(cls, raw):
        if not dataclasses.is_dataclass(cls) or not isinstance(raw, dict):
            return tuple(raw) if isinstance(raw, list) else raw
        hints = typing.get_type_hints(cls)
        return cls(**{f.name: build(hints.get(f.name), raw[f.name]) for f in dataclasses.fields(cls) if f.init and f.name in raw})

    return build(kind, json.loads(text))
