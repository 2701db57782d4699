"""Datasets on disk that tell whether they are whole: data files, their checksums, and a seal written last.

An export is a folder with ``clips`` (Parquet, a folder a split), ``manifest`` (a line for each of those files: path,
length, SHA-256) and ``seal.json``, which holds the manifest's own checksum and the export's settings. The seal
comes into being by one rename after all else, so an export that was cut short has none and is refused; one
that was changed since does not agree with its manifest.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stores

LISTED = "file string, length long, sha256 string"


def unsafe_path(path: str) -> Column:
    """Whether a path leaves the folder that it is relative to, or may on some system: absolute, with a drive, a
    backslash, a control character, an empty part or one of dots; null and empty ones too."""
    p = F.coalesce(F.col(path).cast("string"), F.lit(""))
    return (p == "") | p.rlike(r"(^/|[\\\x00-\x1f\x7f]|^[A-Za-z]:|//|/$|(^|/)\.{1,2}(/|$))")


def within(root: str, path: str) -> bool:
    """Whether a folder lies below another, by their names: no part of it may go up."""
    here, base = (re.sub(r"/+", "/", re.sub(r"^file:/*", "/", x)).rstrip("/") for x in (path, root))
    return here.startswith(base + "/") and not {"..", "."} & set(here.split("/"))


def export_dataset(clips: DataFrame, path: str, root: str | None = None, **about) -> str:
    """Write ``clips`` (clip_id, split and others; ``audio_path``, if there, relative) and return the manifest's checksum.

    An existing export is refused, as are a place outside of ``root`` and clips whose ids or audio paths would
    leave the folder. The seal keeps ``about``: seeds, settings, sources."""
    spark = clips.sparkSession
    if root is not None and not within(root, path):
        raise ValueError(f"{path} is not below {root}")
    if stores._listed(spark, path):
        raise FileExistsError(f"{path} holds files already")
    named = [c for c in ("clip_id", "audio_path") if c in clips.columns]
    bad = clips.where(F.array_contains(F.array(*[unsafe_path(c) for c in named]), True)).select(*named).limit(3).collect()
    if bad:
        raise ValueError(f"paths that leave the folder: {', '.join(map(str, bad))}")
    clips.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/clips")
    _listing(spark, path).select(F.to_json(F.struct("*"))).write.text(f"{path}/manifest")
    checksum = _digest(manifest(spark, path))
    _seal(spark, path, {"manifest": checksum, "files": manifest(spark, path).count(), **about})
    return checksum


def _listing(spark: SparkSession, path: str) -> DataFrame:
    return stores.relative_checksums(spark, f"{path}/clips").where(F.col("file").endswith(".parquet"))


def _seal(spark: SparkSession, path: str, about: dict) -> None:
    context, at = stores._files(spark, path)
    fs, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    draft = at(f"{path}/.seal-{uuid.uuid4().hex}")
    out = context.create(draft, spark._jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE), gateway.new_array(fs.Options.CreateOpts, 0))
    out.write(bytearray(json.dumps(about, sort_keys=True).encode()))
    out.close()
    context.rename(draft, at(f"{path}/seal.json"), gateway.new_array(fs.Options.Rename, 0))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, length and sha256 as written at the export."""
    return spark.read.text(f"{path}/manifest").select(F.from_json("value", LISTED).alias("m")).select("m.*")


def _digest(listed: DataFrame) -> str:
    return stores.checksum_of(listed.select("file", F.concat_ws(":", F.col("length").cast("string"), "sha256").alias("sha256"))).first()[0]


def sealed(spark: SparkSession, path: str) -> dict | None:
    """What the seal says; None if the export was cut short."""
    if "seal.json" not in stores._listed(spark, path):
        return None
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/seal.json").first()[0])


def faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, fault) of what does not agree with the seal: unsealed, manifest_changed, missing, changed, unlisted."""
    seal = sealed(spark, path)
    if seal is None:
        return spark.createDataFrame([("seal.json", "unsealed")], "file string, fault string")
    listed, there = manifest(spark, path), _listing(spark, path)
    if _digest(listed) != seal["manifest"]:
        return spark.createDataFrame([("manifest", "manifest_changed")], "file string, fault string")
    both = listed.select("file", F.struct("length", "sha256").alias("was")).join(there.select("file", F.struct("length", "sha256").alias("now")), "file", "full")
    fault = F.when(F.col("was").isNull(), "unlisted").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed")
    return both.select("file", fault.alias("fault")).where("fault is not null")


def open_dataset(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The clips of an export; one that was cut short, or, if it is to be verified, changed since, is refused."""
    if sealed(spark, path) is None:
        raise ValueError(f"{path} is not a whole export")
    if verify and (bad := faults(spark, path).limit(3).collect()):
        raise ValueError(f"{path} was changed: {', '.join(f'{r.file} {r.fault}' for r in bad)}")
    return spark.read.parquet(f"{path}/clips")
