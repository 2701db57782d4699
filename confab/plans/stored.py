"""Queries on stores: each writes rows of a table in a store's own format to the shared folder, and
reads them back through the engine's reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions.arrow import function
from confab.operators import evaluation as E
from confab.sources import datasets
from confab.sources import stores as R

from . import tables as t
from .registry import query


def _written(frame, label: str) -> str:
    """One column of texts as files, a partition each."""
    path = R.scratch(frame.sparkSession, label)
    frame.write.text(path)
    return path


def _one_file(frame, label: str, opening: str, closing: str) -> str:
    """Texts of few rows (one column) as one file, with commas between."""
    return _written(frame.agg(F.concat(F.lit(opening), F.array_join(F.array_sort(F.collect_list(frame.columns[0])), ","), F.lit(closing)).alias("value")).coalesce(1), label)


@query("select n_nationkey::varchar as key, n_name as name, n_regionkey::bigint as region from nation")
def keyed_store_scan(spark, sf):
    n = t.table(spark, sf, "nation").select(F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('":'), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))).alias("value"))
    return R.keyed_store(spark, _one_file(n, "keyed", "{", "}"), "name string, region bigint")


@query("select o_orderkey, o_orderstatus as status from orders where o_orderkey % 2 = 1")
def store_replaced(spark, sf):
    """The second write replaces the first, from which it reads, as a whole."""
    o, path = t.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), R.scratch(spark, "store")
    R.write_store(o, path)
    R.write_store(R.read_store(spark, path).where("o_orderkey % 2 = 1"), path)
    return R.read_store(spark, path)


@query("select vec_id % 40 as meeting_id, vec_id as idx from embeddings where vec_id % 40 % 4 >= 2")
def vector_cache(spark, sf):
    """A sidecar with a wrong count for every fourth meeting, and a wrong checksum for the next."""
    v = t.voices(spark, sf).select(F.col("cluster_id").alias("meeting_id"), F.col("vec_id").alias("idx"), "vector")
    k = F.col("meeting_id") % 4
    sidecar = R.vector_digests(v).withColumns({"rows": F.when(k == 0, F.col("rows") + 1).otherwise(F.col("rows")), "sha256": F.when(k == 1, F.lit("old")).otherwise(F.col("sha256"))})
    return R.cached_vectors(v, sidecar).select("meeting_id", "idx")


_ASR = "(select conv_id, turn, turn * 2e0 as start_s, turn * 2e0 + case when turn = 3 then -1 else 1 end as end_s, 0.5e0 + (turn % 5) / 10e0 as p from conversations)"


def _recognised(spark, sf):
    """A recogniser's document of each conversation, one a line: ms offsets, and tokens of which one is a control token."""
    token = lambda text, p: F.struct(F.lit(text).alias("text"), p.alias("p"))
    p = 0.5 + (F.col("turn") % 5) / 10.0
    c = t.table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") * 2000).alias("from"), (F.col("turn") * 2000 + F.when(F.col("turn") == 3, -1000).otherwise(1000)).alias("to"), F.array(token("[_BEG_]", F.lit(1.0)), token(" a", p), token(" b", p)).alias("tokens"))
    one = F.struct("turn", F.struct("from", "to").alias("offsets"), F.format_string(" turn %d", "turn").alias("text"), "tokens")
    files = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("s")).select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.transform("s", lambda x: x.dropFields("turn")).alias("transcription"))).alias("value"))
    return R.recogniser_segments(spark, _written(files, "recogniser"), lines=True).withColumn("conv_id", F.col("id").cast("long"))


@query(f"select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, start_s, end_s, 'turn ' || turn as text, round(p, 9) as mean_prob, round(ln(p), 9) as mean_logprob from {_ASR}")
def recogniser_json(spark, sf):
    s = _recognised(spark, sf)
    return s.select("conv_id", "idx", "start_s", "end_s", "text", F.round("mean_prob", 9).alias("mean_prob"), F.round("mean_logprob", 9).alias("mean_logprob"))


@query(f"select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, 'ends_before_start' as rule from {_ASR} qualify turn = 3")
def recogniser_violations(spark, sf):
    return R.recogniser_violations(_recognised(spark, sf), "conv_id")


_SPLIT = "case when c_custkey % 3 = 0 then 'dev' else 'test' end"


@query("select 'r' || c_custkey as recording_id, 'beyond_recording' as rule from customer where c_custkey % 5 = 0 union all select 'r' || c_custkey, 'ends_before_start' from customer where c_custkey % 7 = 0 union all select 'r' || c_custkey, 'checksum_in_two_splits' from customer where c_custkey // 2 in (select c_custkey // 2 from customer group by 1 having count(distinct c_custkey % 3 = 0) > 1)")
def gold_manifest_violations(spark, sf):
    """Recordings in files of many; two share a checksum, some of them over splits."""
    k = F.col("c_custkey")
    seg = F.struct(F.lit("s").alias("segment_id"), F.when(k % 7 == 0, 3.0).otherwise(1.0).alias("start"), F.when(k % 7 == 0, 2.0).when(k % 5 == 0, 30.0).otherwise(2.0).alias("end"), F.lit("ro").alias("language"), F.lit("x").alias("verbatim_text"))
    seg = F.when((k % 5 == 0) & (k % 7 == 0), F.array(seg, F.struct(F.lit("t").alias("segment_id"), F.lit(3.0).alias("start"), F.lit(30.0).alias("end"), F.lit("ro").alias("language"), F.lit("x").alias("verbatim_text")))).otherwise(F.array(seg))
    r = F.struct(F.format_string("r%d", k).alias("recording_id"), F.sha2(F.floor(k / 2).cast("string"), 256).alias("checksum_sha256"), F.lit(10.0).alias("duration_seconds"), F.when(k % 3 == 0, "dev").otherwise("test").alias("split"), F.lit("clean").alias("acoustic_condition"), seg.alias("segments"))
    rows = t.table(spark, sf, "customer").select(r.alias("r"), (k % 16).alias("file")).groupBy("file").agg(F.collect_list("r").alias("recordings"))
    path = R.scratch(spark, "manifest")
    rows.select(F.to_json(F.struct("recordings")).alias("value"), "file").write.partitionBy("file").text(path)
    return E.manifest_violations(R.gold_manifest(spark, path))


@query("select o_orderkey::varchar as key, 'decision ' || o_orderkey as decision from orders where o_orderkey % 9 <> 0 union all select null, 'decision ' || o_orderkey from orders where o_orderkey % 9 = 0")
def minutes_dumps(spark, sf):
    """Most minutes stand in maps by meeting, some are dumps of one meeting."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.array(F.format_string("decision %d", k)).alias("decisions")))
    m = t.table(spark, sf, "orders").select(F.when(k % 9 == 0, body).otherwise(F.format_string('{"%d": %s}', k, body)).alias("value"), (k % 500).alias("part"), k)
    one = m.where("o_orderkey % 9 = 0").select("value")
    maps = m.where("o_orderkey % 9 <> 0").groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "value"))), lambda x: F.regexp_replace(x["value"], r"^\{|\}$", "")), ","), F.lit("}")).alias("value")).select("value")
    path = _written(one.unionByName(maps), "minutes")
    got = R.minutes_store(spark, path, "decisions array<string>", lines=True)
    return got.select("key", F.explode("decisions").alias("decision"))


@query("select r_regionkey::int as region, sha256(r_name || chr(10)) as sha256, length(r_name) + 1 as length from region")
def file_checksums(spark, sf):
    path = R.scratch(spark, "files")
    t.table(spark, sf, "region").select(F.col("r_name").alias("value"), F.col("r_regionkey").alias("region")).write.partitionBy("region").text(path)
    return R.file_checksums(spark, path).where(F.col("path").endswith(".txt")).select(F.regexp_extract("path", r"region=(\d+)", 1).cast("int").alias("region"), "sha256", "length")


def _named_files(frame, label: str) -> str:
    """Texts (name, value) as files of these names."""
    path = R.scratch(frame.sparkSession, label)

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(value.encode())
            yield batch

    frame.select("name", "value").mapInArrow(write, "name string, value string").count()
    return path


@query("with f as (select 'd' || p_partkey % 5 || '/f' || p_partkey % 50 || '.txt' as file, string_agg(p_name, chr(10) order by p_partkey) as value from part group by p_partkey % 50, p_partkey % 5), l as (select substr(md5(file), 1, 2) as b, sha256(string_agg(file || ':' || sha256(value), chr(10) order by file || ':' || sha256(value))) as d from f group by 1) select sha256(string_agg(d, chr(10) order by b)) as sha256 from l")
def folder_checksums(spark, sf):
    p = t.table(spark, sf, "part").groupBy((F.col("p_partkey") % 5).alias("d"), (F.col("p_partkey") % 50).alias("f")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    rows = p.select(F.format_string("d%d/f%d.txt", "d", "f").alias("name"), F.array_join(F.transform("x", lambda v: v["p_name"]), "\n").alias("value"))
    return R.folder_checksum(spark, _named_files(rows, "folder"))


@query("select 'c' || event_id as clip_id, case event_id % 3 when 0 then 'train' when 1 then 'dev' else 'test' end as split, event_type as label from events")
def dataset_export(spark, sf):
    """Exported with a manifest and a seal, verified, and read back."""
    clips = t.table(spark, sf, "events").select(F.format_string("c%d", "event_id").alias("clip_id"), F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.col("event_id") % 3 + 1).cast("int")).alias("split"), F.col("event_type").alias("label"))
    path = R.scratch(spark, "dataset")
    datasets.export_dataset(clips, path, seed=42)
    return datasets.open_dataset(spark, path).select("clip_id", "split", "label")


@query("select p_partkey, case p_partkey % 6 when 0 then 'wav' when 1 then 'mp3' when 2 then 'ogg' when 3 then 'flac' when 4 then 'm4a' end as kind from part")
def audio_kinds(spark, sf):
    heads = F.array(*[F.lit(x) for x in ("524946460000000057415645", "494433040000000000000000", "4F6767530002000000000000", "664C61430000002200000000", "00000020667479704D344120", "524946460000000041564920")])
    return t.table(spark, sf, "part").select("p_partkey", R.audio_kind(F.unhex(F.element_at(heads, (F.col("p_partkey") % 6 + 1).cast("int")))).alias("kind"))


@function("binary")
def _wav(values):
    """A second of one constant level in two channels, the second silent."""
    import io
    import wave

    import numpy as np
    import pyarrow as pa

    out = []
    for v in values.to_pylist():
        raw = io.BytesIO()
        with wave.open(raw, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes(np.repeat(np.array([[v, 0]], "<i2"), 1600, axis=0).tobytes())
        out.append(raw.getvalue())
    return pa.array(out, pa.binary())


@query("select p_partkey, 1600::bigint as frames, round(p_partkey % 1000 * 16 / 2 / 32768e0, 6) as level from part")
def wav_levels(spark, sf):
    """Channels are averaged, so half of the one level."""
    w = R.wav_samples(_wav((F.col("p_partkey") % 1000 * 16).cast("int")))
    p = t.table(spark, sf, "part").select("p_partkey", w.alias("w"))
    return p.select("p_partkey", "w.frames", F.round(F.element_at("w.samples", 800).cast("double"), 6).alias("level"))


@query("select o_orderkey as answer_id, 'not_of_schema' as rule from orders where o_orderkey % 3 <> 0")
def answer_violations(spark, sf):
    k = F.col("o_orderkey")
    answer = F.when(k % 3 == 0, F.format_string('{"items": [{"text": "t %d", "idx": [1]}]}', k)).when(k % 3 == 1, "no json").otherwise('{"items": [{"text": "t", "idx": ["x"]}]}')
    return R.schema_violations(t.table(spark, sf, "orders").select(k.alias("answer_id"), answer.alias("answer")), "items array<struct<text:string,idx:array<int>>>")
