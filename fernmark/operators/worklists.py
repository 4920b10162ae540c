"""What a bulk transcoder has to do, planned as a join: outputs, steps, and which of them are there already."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernmark.functions import text


@dataclass(frozen=True)
class Target:
    """What files should be like. ``cache`` is the folder that outputs may be written to."""

    rate: int
    channels: int
    bits: int
    format: str
    bitrate: str | None = None
    codec: str | None = None
    cache: str = "cache/"

    @property
    def encoding(self) -> str:
        parts = {"wav": [self.format], "mp3": [self.format, self.bitrate], "mp4": [self.format, self.codec, self.bitrate]}[self.format]
        return f"enc({','.join(map(str, parts))})"

    @property
    def resampling(self) -> str:
        return f"resample({self.rate},{self.channels},{self.bits})"


def transcode_plan(recordings: DataFrame, files: DataFrame, target: Target, *, audio: str = "audio", rate: str = "rate", channels: str = "channels", bits: str = "bits", file: str = "audio") -> DataFrame:
    """The columns of ``recordings`` and output, resample, write, refused.

    ``output`` is the id with the operations that it needs: resampling where rate,
    channels or bits differ or aren't known, encoding where that changes anything. ``write``
    says that it isn't among ``files`` (ids, each maybe repeated), ``refused`` why it won't be
    written: a cached file never is resampled again, and nothing is written outside the cache.
    """
    fits = F.coalesce((F.col(rate) == target.rate) & (F.col(channels) == target.channels) & (F.col(bits) == target.bits), F.lit(False))
    once = F.when(fits, F.col(audio)).otherwise(text.with_operation(F.col(audio), target.resampling))
    planned = recordings.withColumn("output", text.with_operation(once, target.encoding)).withColumn("resample", ~fits)
    there = files.select(F.col(file).alias("_file")).distinct()
    met = planned.join(there, F.col("output") == F.col("_file"), "left").withColumn("write", F.col("_file").isNull())
    cached = F.col(audio).startswith(target.cache)
    why = F.when(F.col("resample") & cached, "resampled before").when(F.col("write") & ~F.col("output").startswith(target.cache), "outside the cache")
    return met.withColumn("refused", why).drop("_file")


def to_write(plan: DataFrame, audio: str = "audio") -> DataFrame:
    """output, audio and resample of the files to make: each once, from the first id of those that give it."""
    return plan.where("write AND refused IS NULL").groupBy("output").agg(F.min(F.struct(F.col(audio), F.col("resample"))).alias("f")).select("output", F.col(f"f.{audio}").alias(audio), "f.resample")
