"""Stores: keyed JSON maps, manifests, recogniser output, rule packs, matrices, audio files.

All read through Spark's readers with explicit schemas, so any path that Spark can open will do.
"""

from __future__ import annotations

import io
import struct
import tempfile
import uuid
import wave

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.functions.arrow import function

RECORDINGS = "recording_id string, checksum_sha256 string, duration_seconds double, split string, acoustic_condition string, segments array<struct<segment_id:string,start:double,end:double,language:string,verbatim_text:string,entities:array<struct<term:string,category:string>>,critical_facts:array<struct<kind:string,expected_token:string,numeric_value:double,unit:string>>>>"
HYPOTHESES = "recording_id string, segments array<struct<start:double,end:double,text:string>>"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; one process alone gets a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="confab-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keyed_store(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """(key, entity columns) of a JSON object that maps keys to entities; ``entity`` is their DDL.
    An empty file is an empty store, a broken one an error."""
    read = spark.read.option("multiLine", True).option("wholetext", True).text(path)
    parsed = F.from_json("value", f"map<string,struct<{_nested(entity)}>>", {"mode": "FAILFAST"})
    return read.where(F.trim("value") != "").select(F.explode(parsed).alias("key", "e")).select("key", "e.*")


def _nested(ddl: str) -> str:
    """Top-level ``name type`` pairs as the fields of a struct."""
    out, depth = [], 0
    for part in ddl.split(","):
        if depth:
            out[-1] += "," + part
        else:
            out.append(part.strip().replace(" ", ":", 1))
        depth += part.count("<") - part.count(">")
    return ",".join(out)


# --- replaced stores ------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """Hadoop's view of the file system that ``path`` is on, and a maker of its paths."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    return fs.FileContext.getFileContext(*([fs.Path(path).toUri()] if "://" in path else []), conf), fs.Path


def _listed(spark: SparkSession, path: str) -> list[str]:
    context, at = _files(spark, path)
    if not context.util().exists(at(path)):
        return []
    return sorted(f.getPath().getName() for f in context.util().listStatus(at(path)))


def store_versions(spark: SparkSession, path: str) -> list[str]:
    """Published versions of a store, oldest first."""
    return [n for n in _listed(spark, f"{path}/published") if not n.startswith((".", "_"))]


def write_store(df: DataFrame, path: str, keep: int = 2) -> str:
    """Replace a store, all of it or nothing, and return the version.

    Rows go to a folder of their own, which readers do not know until it is whole. A small file that
    names the folder then gets the version's number by one rename that refuses an existing target.
    A write that fails leaves the store as it was, so ``df`` may be read from the store itself. Of
    two writers of one version the second gets an error. All but the last ``keep`` versions are
    removed afterwards, with what failed writes before them left; a reader of a version that old has
    to begin again."""
    spark = df.sparkSession
    old = store_versions(spark, path)
    version = f"{int(old[-1]) + 1 if old else 0:020d}"
    folder = f"{version}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/data/{folder}")
    _publish(spark, path, version, folder)
    if len(old) >= keep:
        _clean(spark, path, [*old, version][-keep])
    return version


def _publish(spark: SparkSession, path: str, version: str, folder: str) -> None:
    context, at = _files(spark, path)
    fs, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    context.mkdir(at(f"{path}/published"), None, True)
    pointer = at(f"{path}/published/.{folder}")
    out = context.create(pointer, spark._jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE), gateway.new_array(fs.Options.CreateOpts, 0))
    out.write(bytearray(folder.encode()))
    out.close()
    try:
        context.rename(pointer, at(f"{path}/published/{version}"), gateway.new_array(fs.Options.Rename, 0))
    except Exception as e:
        raise RuntimeError(f"version {version} of {path} was written by another") from e


def _clean(spark: SparkSession, path: str, first: str) -> None:
    """Remove versions before ``first``, and folders of writes that never became one of them."""
    context, at = _files(spark, path)
    for part in ("published", "data"):
        for name in _listed(spark, f"{path}/{part}"):
            if name.lstrip(".").split("-")[0] < first:
                context.delete(at(f"{path}/{part}/{name}"), True)


def read_store(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The rows of a store's last published version, or of a given one."""
    known = store_versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no version {version or ''} of a store at {path}")
    folder = spark.read.text(f"{path}/published/{version or known[-1]}").first()[0]
    return spark.read.parquet(f"{path}/data/{folder}")


# --- files of the engine's inputs -----------------------------------------------------


def gold_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"recordings array<struct<{_nested(RECORDINGS)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("recordings").alias("r")).select("r.*")


def hypothesis_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"hypotheses array<struct<{_nested(HYPOTHESES)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("hypotheses").alias("h")).select("h.*")


def manifest_segments(recordings: DataFrame) -> DataFrame:
    """A row a gold segment: recording_id, acoustic_condition, idx, segment_id, start_s, end_s, language, verbatim_text, entities, critical_facts."""
    s = recordings.select("recording_id", "acoustic_condition", F.posexplode("segments").alias("idx", "s"))
    return s.select("recording_id", "acoustic_condition", "idx", "s.segment_id", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.language", "s.verbatim_text", "s.entities", "s.critical_facts")


def hypothesis_segments(hypotheses: DataFrame) -> DataFrame:
    s = hypotheses.select("recording_id", F.posexplode("segments").alias("idx", "s"))
    return s.select("recording_id", "idx", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.text")


def recogniser_segments(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Segments of a recogniser's JSON (times in ms, tokens with probabilities): path, id, idx,
    start_s, end_s, text, mean_prob, mean_logprob. Control tokens, written in brackets, do not count.

    A file is one document, or, with ``lines``, has one a line, told apart by their ``id``: then few files hold many and are split over tasks."""
    token = "array<struct<text:string,p:double>>"
    schema = f"id string, transcription array<struct<offsets:struct<`from`:double,`to`:double>,text:string,tokens:{token}>>"
    raw = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    s = raw.select(F.col("_metadata.file_path").alias("path"), "id", F.posexplode("transcription").alias("idx", "s"))
    p = F.transform(F.filter("s.tokens", lambda t: ~t["text"].rlike(r"^\[.*\]$") & t["p"].isNotNull()), lambda t: t["p"])
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))
    return s.select("path", "id", "idx", (F.col("s.offsets.from") / 1000).alias("start_s"), (F.col("s.offsets.to") / 1000).alias("end_s"), F.trim("s.text").alias("text"), mean(p).alias("mean_prob"), mean(F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-10))))).alias("mean_logprob"))


def recogniser_violations(segments: DataFrame, key: str = "path") -> DataFrame:
    """(key, idx, rule) of a recogniser's segments that cannot be used: times that are missing, infinite
    or below zero, end before they start, or start before the segment before them."""
    before = F.lag("start_s").over(Window.partitionBy(key).orderBy("idx"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    rules = F.array(F.when(bad("start_s") | bad("end_s"), "not_finite"), F.when(F.col("start_s") < 0, "negative"), F.when(F.col("end_s") < F.col("start_s"), "ends_before_start"), F.when(F.col("start_s") < F.col("before"), "goes_back"))
    return segments.withColumn("before", before).select(key, "idx", F.explode(F.array_compact(rules)).alias("rule"))


def rule_packs(spark: SparkSession, packaged: list[str], local: str | None = None) -> DataFrame:
    """Rules of packs (a JSON object with language, version, rules each): rule_id, language, variants,
    canonical, action, version, approval, priority, pack. Later folders and local rules have a higher priority."""
    rule = "array<struct<id:string,language:string,variants:array<string>,match:string,canonical:string,replacement:string,action:string,version:string,approval:string,status:string>>"
    out = None
    for priority, path in enumerate([*packaged, *([local] if local else [])]):
        raw = spark.read.schema(f"language string, version string, rules {rule}").option("multiLine", True).option("mode", "FAILFAST").json(path)
        r = raw.select("language", "version", F.col("_metadata.file_path").alias("pack"), F.explode("rules").alias("r"))
        variants = F.coalesce("r.variants", F.filter(F.split("r.match", r"\|"), lambda v: v != ""))
        part = r.select(
            F.col("r.id").alias("rule_id"), F.coalesce("r.language", "language", F.lit("ro")).alias("language"), variants.alias("variants"), F.coalesce("r.canonical", "r.replacement", F.lit("")).alias("canonical"),
            F.coalesce("r.action", F.lit("safe_replace")).alias("action"), F.coalesce("r.version", "version", F.lit("1.0.0")).alias("version"),
            F.coalesce("r.approval", F.when(F.col("r.status") == "disabled", "rolled_back").otherwise("approved")).alias("approval"), F.lit(priority).alias("priority"), "pack",
        )
        out = part if out is None else out.unionByName(part)
    return out


def minutes_store(spark: SparkSession, path: str, entity: str, lines: bool = False) -> DataFrame:
    """Minutes from one dump or from a map keyed by meeting: (key or null, entity columns). A file is one of them,
    or, with ``lines``, has one a line."""
    read = spark.read.option("wholetext", not lines).text(path).where(F.trim("value") != "")
    single = F.from_json("value", f"struct<{_nested(entity)}>")
    one = F.get_json_object("value", "$.decisions").isNotNull() | F.get_json_object("value", "$.summary_ro").isNotNull()
    a = read.where(one).select(F.lit(None).cast("string").alias("key"), single.alias("e")).select("key", "e.*")
    b = read.where(~one).select(F.explode(F.from_json("value", f"map<string,struct<{_nested(entity)}>>", {"mode": "FAILFAST"})).alias("key", "e")).select("key", "e.*")
    return a.unionByName(b)


def schema_violations(answers: DataFrame, schema: str, column: str = "answer") -> DataFrame:
    """(answer_id, rule) of model answers that are no JSON or not of the schema."""
    corrupt = F.from_json(column, f"struct<{_nested(schema)},_bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return answers.withColumn("__p", corrupt).where(F.col("__p").isNull() | F.col("__p._bad").isNotNull()).select("answer_id", F.lit("not_of_schema").alias("rule"))


# --- files ----------------------------------------------------------------------------


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def relative_checksums(spark: SparkSession, path: str) -> DataFrame:
    """file (path below ``path``, with slashes), length and sha256 of every file below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return file_checksums(spark, path).select(F.expr(f"substring(path, {len(base) + 2})").alias("file"), "length", "sha256")


def checksum_of(listed: DataFrame) -> DataFrame:
    """One checksum (sha256) of a list of files (file, sha256): they are dealt to 256 lists by a hash of their
    path, each list has a checksum, and these have one. No task holds all files."""
    each = listed.select(F.concat_ws(":", "file", "sha256").alias("x"), F.substring(F.md5("file"), 1, 2).alias("b"))
    of_list = each.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("d"))
    return of_list.agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("all")).select(F.sha2(F.array_join(F.transform("all", lambda v: v["d"]), "\n"), 256).alias("sha256"))


def folder_checksum(spark: SparkSession, path: str) -> DataFrame:
    """One checksum of a folder from its files' relative paths and checksums."""
    return checksum_of(relative_checksums(spark, path))


def audio_kind(content="content") -> Column:
    """wav, mp3, ogg, flac, webm, m4a by the first bytes; null for anything else."""
    h = F.hex(F.substring(content, 1, 12))
    wav = h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645")
    return F.when(wav, "wav").when(h.startswith("494433") | h.startswith("FFFB") | h.startswith("FFF3") | h.startswith("FFF2"), "mp3").when(h.startswith("4F676753"), "ogg").when(h.startswith("664C6143"), "flac").when(h.startswith("1A45DFA3"), "webm").when(F.substring(h, 9, 8) == "66747970", "m4a")


@function("struct<rate:int,channels:int,frames:bigint,samples:array<float>>")
def wav_samples(content: pa.Array) -> pa.Array:
    """16-bit PCM in [-1, 1], the mean of its channels; null for what is no such file."""
    import numpy as np

    out = []
    for raw in content.to_pylist():
        try:
            with wave.open(io.BytesIO(raw or b"")) as w:
                if w.getsampwidth() != 2:
                    raise wave.Error("not 16 bit")
                rate, n, frames = w.getframerate(), w.getnchannels(), w.getnframes()
                x = np.frombuffer(w.readframes(frames), "<i2").reshape(-1, n).mean(axis=1) / 32768.0
            out.append({"rate": rate, "channels": n, "frames": frames, "samples": x.astype(np.float32)})
        except (wave.Error, EOFError, struct.error, ValueError):
            out.append(None)
    return pa.array(out, pa.struct([("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("samples", pa.list_(pa.float32()))]))


def recordings(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """path, samples of every WAV file of the given rate; files of other rates are left out."""
    some = files(spark, path).where(audio_kind() == "wav").select("path", wav_samples("content").alias("w"))
    return some.where(F.col("w.rate") == rate).select("path", "w.frames", "w.samples")


def vector_digests(vectors: DataFrame) -> DataFrame:
    """Per meeting its number of vectors (meeting_id, idx, vector) and the checksum of their values in
    order: each vector is hashed where it is, so a meeting's digests are gathered, not its vectors."""
    own = F.sha2(F.array_join(F.transform("vector", lambda x: F.format_string("%.6f", x.cast("double"))), ","), 256)
    each = vectors.select("meeting_id", F.struct("idx", own.alias("d")).alias("r"))
    return each.groupBy("meeting_id").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["d"]), ","), 256).alias("sha256"))


def cached_vectors(vectors: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Vectors of meetings whose sidecar (meeting_id, rows, sha256) they still agree with."""
    good = vector_digests(vectors).join(sidecar, ["meeting_id", "rows", "sha256"], "left_semi").select("meeting_id")
    return vectors.join(good, "meeting_id", "left_semi")
