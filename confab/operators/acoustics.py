"""Acoustic features of recordings that come in chunks: no task holds a recording."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions import signal
from confab.sources.stores import scratch


def chunked(samples: DataFrame, key: str, chunk: int) -> DataFrame:
    """key, chunk, samples: recordings (key, position, sample) cut into chunks of ``chunk`` samples in order of position, which counts from 0."""
    at = F.floor(F.col("position") / chunk).cast("long")
    cells = samples.groupBy(key, at.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("position", "sample"))).alias("s"))
    return cells.select(key, "chunk", F.transform("s", lambda x: x["sample"].cast("double")).alias("samples"))


def log_mel_features(chunks: DataFrame, key: str = "recording_id", chunk: int = 160_000, rate: int = 16_000, n_mels: int = 80, **settings) -> DataFrame:
    """key, frame, features: log-mel energies less their mean over the recording, of recordings in chunks (key,
    chunk, samples in [-1, 1]), each of ``chunk`` samples but the last.

    A chunk's last frames reach into the next one, so each chunk meets the first samples of its successor, by an
    equal join on its number. Means are a second pass: chunks give sums, which are added up a bin, and go back
    to the frames. A recording shorter than a frame has none."""
    spark, kind = chunks.sparkSession, chunks.schema[key].dataType.simpleString()
    size, hop = signal.frame_sizes(rate, **{k: v for k, v in settings.items() if k in ("frame_ms", "hop_ms")})
    if chunk < size:
        raise ValueError("a chunk must hold a frame")
    heads = chunks.select(key, (F.col("chunk") - 1).alias("chunk"), F.slice("samples", 1, size - 1).alias("more"))
    both = chunks.join(heads, [key, "chunk"], "left").select(key, "chunk", F.concat("samples", F.coalesce("more", F.array().cast("array<double>"))).alias("samples"), F.size("samples").alias("own"))
    names = [key, "frame", "energies"]

    def frames(batches):
        for batch in batches:
            for name, number, samples, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = -(-number * chunk // hop)  # frames begin at whole hops of the recording
                skip = first * hop - number * chunk
                out = signal.log_energies(np.array(samples[skip:], float), rate, n_mels, **settings)
                out = out[: max(0, -(-(own - skip) // hop))]  # those that begin in this chunk
                if len(out):
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n_mels), pa.int32()), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), batch.schema.types[0]), pa.array(first + np.arange(len(out)), pa.int64()), flat], names)

    path = scratch(spark, "log-mel")
    both.mapInArrow(frames, f"{key} {kind}, frame long, energies array<double>").write.parquet(path)
    found = spark.read.parquet(path)
    bins = found.select(key, F.posexplode("energies").alias("bin", "e")).groupBy(key, "bin").agg(F.avg("e").alias("mean"))
    means = bins.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mean"))), lambda x: x["mean"]).alias("means"))
    return found.join(means, key).select(key, "frame", F.zip_with("energies", "means", lambda e, m: e - m).alias("features"))
