"""Stores and files, streams, relational operators on odd rows."""

import hashlib
import json
import struct
import tempfile
import wave

import pytest
from pyspark.sql import functions as F

from confab.operators import context, delivery, evaluation, learning, meetings, minutes, segments, translation, voices
from confab.sources import datasets, stores
from confab.streaming import streams


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def put(folder, name, value):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return path


# --- stores ---------------------------------------------------------------------------


def test_keyed_store(spark, folder):
    path = put(folder, "m.json", {"a": {"title": "Ședință", "tags": ["x"]}, "b": {"title": None, "tags": []}})
    got = stores.keyed_store(spark, path, "title string, tags array<string>").orderBy("key").collect()
    assert [(r.key, r.title, r.tags) for r in got] == [("a", "Ședință", ["x"]), ("b", None, [])]
    assert stores.keyed_store(spark, put(folder, "e.json", ""), "title string").count() == 0
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        stores.keyed_store(spark, put(folder, "bad.json", "{broken"), "title string").collect()


def test_store_round_trip(spark, folder):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for _ in range(2):
        stores.write_store(df, f"{folder}/s")
    assert stores.read_store(spark, f"{folder}/s").collect() == df.collect()
    with pytest.raises(FileNotFoundError):
        stores.read_store(spark, f"{folder}/none")


def test_a_failed_write_leaves_the_store(spark, folder):
    """The second write fails in its last rows: readers see the first, and a third write goes through."""
    path, rows = f"{folder}/s", spark.range(100)
    stores.write_store(rows, path)
    broken = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        stores.write_store(broken, path)
    assert stores.read_store(spark, path).count() == 100 and len(stores.store_versions(spark, path)) == 1
    stores.write_store(stores.read_store(spark, path).where("id < 50"), path)
    assert stores.read_store(spark, path).count() == 50


def test_store_versions_are_kept_and_removed(spark, folder):
    path = f"{folder}/s"
    names = [stores.write_store(spark.range(n), path, keep=2) for n in range(1, 6)]
    assert stores.store_versions(spark, path) == names[-2:]
    assert [stores.read_store(spark, path, v).count() for v in names[-2:]] == [4, 5]
    with pytest.raises(FileNotFoundError):
        stores.read_store(spark, path, names[0])
    assert len(stores._listed(spark, f"{path}/data")) == 2


def test_two_writers_of_one_version(spark, folder):
    path = f"{folder}/s"
    stores.write_store(spark.range(3), path)
    version = f"{1:020d}"
    for k in "ab":
        spark.range(7 if k == "a" else 9).write.parquet(f"{path}/data/{version}-{k}")
    stores._publish(spark, path, version, f"{version}-a")
    with pytest.raises(RuntimeError, match="another"):
        stores._publish(spark, path, version, f"{version}-b")
    assert stores.read_store(spark, path).count() == 7


def test_dealing_runs_nothing(spark, folder):
    """Rows of a shuffle above are read once, by the action alone."""
    from confab.functions import arrow

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(count, "id long").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    out = arrow.dealt(df)
    assert seen.value == 0
    assert out.count() == 7 and seen.value == 1000


MANIFEST = {"recordings": [
    {"recording_id": "r1", "checksum_sha256": "c1", "duration_seconds": 10.0, "split": "train", "acoustic_condition": "clean",
     "segments": [{"segment_id": "s1", "start": 5.0, "end": 6.0, "language": "ro", "verbatim_text": "unu doi", "entities": [], "critical_facts": []}, {"segment_id": "s2", "start": 3.0, "end": 4.0, "language": "ru", "verbatim_text": "три", "entities": [], "critical_facts": []}]},
    {"recording_id": "r2", "checksum_sha256": "c1", "duration_seconds": 1.0, "split": "test", "acoustic_condition": "noisy", "segments": [{"segment_id": "s3", "start": 0.0, "end": 2.0, "language": "en", "verbatim_text": "", "entities": [], "critical_facts": []}]},
]}


def test_manifests(spark, folder):
    gold = stores.gold_manifest(spark, put(folder, "g.json", MANIFEST))
    assert {tuple(r) for r in evaluation.manifest_violations(gold).collect()} == {("r1", "start_goes_back"), ("r1", "checksum_in_two_splits"), ("r2", "checksum_in_two_splits"), ("r2", "beyond_recording")}
    hyp = stores.hypothesis_set(spark, put(folder, "h.json", {"hypotheses": [{"recording_id": "r1", "segments": [{"start": 3.0, "end": 4.0, "text": " trei "}, {"start": 5.0, "end": 6.0, "text": "unu doi"}]}]}))
    pairs = evaluation.recording_pairs(stores.manifest_segments(gold), stores.hypothesis_segments(hyp))
    assert {r.recording_id: (r.reference, r.hypothesis) for r in pairs.collect()} == {"r1": ("unu doi три", "trei unu doi"), "r2": ("", "")}
    by_time = evaluation.language_errors(stores.manifest_segments(gold), stores.hypothesis_segments(hyp))
    assert {r.language: (r.s, r.d, r.i, r.n) for r in by_time.collect()} == {"ro": (0, 0, 0, 2), "ru": (1, 0, 0, 1), "en": (0, 0, 0, 0)}
    whole = evaluation.language_errors(stores.manifest_segments(gold), stores.hypothesis_segments(hyp), whole_recording=True)
    assert {r.language: (r.s, r.d, r.i, r.n) for r in whole.collect()}["ro"] == (0, 0, 1, 2)


def test_recogniser_output(spark, folder):
    path = put(folder, "w.json", {"transcription": [{"offsets": {"from": 500, "to": 1500}, "text": " salut", "tokens": [{"text": "[_BEG_]", "p": 0.1}, {"text": " salut", "p": 0.5}]}, {"offsets": {"from": 1500, "to": 2000}, "text": "", "tokens": []}]})
    got = stores.recogniser_segments(spark, path).orderBy("idx").collect()
    assert [(r.start_s, r.end_s, r.text, r.mean_prob) for r in got] == [(0.5, 1.5, "salut", 0.5), (1.5, 2.0, "", None)] and got[0].mean_logprob == pytest.approx(-0.6931, abs=1e-3)


def test_rule_packs(spark, folder):
    a = put(folder, "a.json", {"language": "ro", "version": "2", "rules": [{"id": "x", "variants": ["u"], "canonical": "v"}, {"id": "y", "match": "p|q", "replacement": "r", "status": "disabled"}]})
    b = put(folder, "b.json", {"version": "local", "rules": [{"id": "x", "variants": ["u"], "canonical": "w", "language": "ru"}]})
    rules = learning.effective_rules(stores.rule_packs(spark, [a], b))
    assert {r.rule_id: (r.canonical, r.language, r.version, r.approval, r.variants) for r in rules.collect()} == {"x": ("w", "ru", "local", "approved", ["u"]), "y": ("r", "ro", "2", "rolled_back", ["p", "q"])}


def test_minutes_and_answers(spark, folder):
    one, many = put(folder, "one.json", {"decisions": ["a"]}), put(folder, "many.json", {"m1": {"decisions": ["b"]}})
    assert [tuple(r) for r in stores.minutes_store(spark, one, "decisions array<string>").collect()] == [(None, ["a"])]
    assert [tuple(r) for r in stores.minutes_store(spark, many, "decisions array<string>").collect()] == [("m1", ["b"])]
    answers = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None), (4, '{"a": "x"}')], "answer_id int, answer string")
    assert sorted(r.answer_id for r in stores.schema_violations(answers, "a int").collect()) == [2, 3, 4]


def test_audio_files(spark, folder):
    for name, rate in (("a.wav", 16_000), ("b.wav", 8_000)):
        with wave.open(f"{folder}/{name}", "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(struct.pack("<4h", 16384, 0, -32768, -32768))
    put(folder, "c.txt", "OggS but text")
    got = stores.recordings(spark, folder).collect()
    assert [(r.frames, r.samples) for r in got] == [(2, [0.25, -1.0])]
    kinds = {r.path.rsplit("/", 1)[1]: r.k for r in stores.files(spark, folder).select("path", stores.audio_kind().alias("k")).collect()}
    assert kinds == {"a.wav": "wav", "b.wav": "wav", "c.txt": "ogg"}
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in stores.file_checksums(spark, folder).collect()}
    assert sums["c.txt"] == hashlib.sha256(b"OggS but text").hexdigest()
    lists = {}
    for n in sorted(sums):
        lists.setdefault(hashlib.md5(n.encode()).hexdigest()[:2], []).append(f"{n}:{sums[n]}")
    digests = [hashlib.sha256("\n".join(lists[b]).encode()).hexdigest() for b in sorted(lists)]
    assert stores.folder_checksum(spark, folder).first().sha256 == hashlib.sha256("\n".join(digests).encode()).hexdigest()


CLIPS = "clip_id string, split string, audio_path string, label string"


def exported(spark, folder):
    clips = spark.createDataFrame([(f"c{k}", ("train", "dev", "test")[k % 3], f"audio/c{k}.wav", "x") for k in range(30)], CLIPS)
    datasets.export_dataset(clips.repartition(3), f"{folder}/d", root=folder, seed=42)
    return clips, f"{folder}/d"


def test_dataset_round_trip(spark, folder):
    clips, path = exported(spark, folder)
    got = datasets.open_dataset(spark, path)
    assert sorted(map(tuple, got.select(*clips.columns).collect())) == sorted(map(tuple, clips.collect()))
    assert datasets.sealed(spark, path)["seed"] == 42 and datasets.faults(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        datasets.export_dataset(clips, path)


def test_changed_and_partial_exports_are_refused(spark, folder):
    import shutil
    from pathlib import Path

    _, whole = exported(spark, folder)
    parts = sorted(Path(whole).glob("clips/*/*.parquet"))

    def copy(name):
        shutil.copytree(whole, f"{folder}/{name}")
        return f"{folder}/{name}", Path(f"{folder}/{name}") / parts[0].relative_to(whole)

    path, part = copy("changed")
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert [r.fault for r in datasets.faults(spark, path).collect()] == ["changed"]
    path, part = copy("missing")
    part.unlink()
    assert [r.fault for r in datasets.faults(spark, path).collect()] == ["missing"]
    path, part = copy("unlisted")
    shutil.copy(part, part.with_name("more.parquet"))
    assert [r.fault for r in datasets.faults(spark, path).collect()] == ["unlisted"]
    path, _ = copy("manifest")
    line = next(f for f in Path(path).glob("manifest/*.txt") if f.read_text())
    line.write_text(line.read_text().replace('"length":', '"length":1'))
    (line.parent / f".{line.name}.crc").unlink(missing_ok=True)
    assert [r.fault for r in datasets.faults(spark, path).collect()] == ["manifest_changed"]
    for name in ("changed", "missing", "unlisted", "manifest"):
        with pytest.raises(ValueError, match="changed"):
            datasets.open_dataset(spark, f"{folder}/{name}")
    path, _ = copy("partial")
    Path(path, "seal.json").unlink()
    with pytest.raises(ValueError, match="whole"):
        datasets.open_dataset(spark, path)
    assert [r.fault for r in datasets.faults(spark, path).collect()] == ["unsealed"]


@pytest.mark.parametrize("path", ["/etc/x", "../x", "a/../../x", "a\\b", "c:\\x", "", None, "a//b", "a/", "./x", "a\x00"])
def test_paths_that_leave_the_folder_are_refused(spark, folder, path):
    clips = spark.createDataFrame([("c1", "train", "audio/c1.wav", "x"), ("c2", "dev", path, "x")], CLIPS)
    with pytest.raises(ValueError, match="leave"):
        datasets.export_dataset(clips, f"{folder}/d")
    assert not stores._listed(spark, f"{folder}/d")


def test_exports_stay_below_their_root(spark, folder):
    clips = spark.createDataFrame([("c1", "train", "a.wav", "x")], CLIPS)
    for path in (f"{folder}/../d", "/tmp", folder, f"{folder}x/d"):
        with pytest.raises(ValueError, match="below"):
            datasets.export_dataset(clips, path, root=folder)


# --- streams --------------------------------------------------------------------------


def test_stream_windows_agree_with_batch(spark, sf_dir, folder):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{folder}/in")
    for k, (job, mode) in enumerate(((streams.windowed, "complete"), (lambda e: streams.windowed(e, "1 day", "6 hours"), "complete"))):
        q = job(spark.readStream.schema(events.schema).parquet(f"{folder}/in")).writeStream.format("memory").queryName(f"w{k}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        key = lambda rows: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in rows)
        assert key(spark.table(f"w{k}").collect()) == key(job(events).collect())


def test_stream_sessions_and_repeats(spark, sf_dir, folder):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    q = streams.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("sessions").collect()) == sorted(streams.sessions(events).collect())
    q = streams.submitted_once(stream.select("ts", F.col("event_type").alias("job_key")), "60 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 5


OPS = "queue string, job_id string, seq long, op string, ts timestamp"


def played(spark, folder, batches, name, depth=2, lease="10 minutes"):
    """Verdicts by seq of ops that come batch by batch, the stream stopped and restarted after each."""
    import datetime

    streams.with_rocksdb(spark)
    out = []
    for k, rows in enumerate(batches):
        at = [(*r[:4], datetime.datetime(2024, 1, 1, 0, r[4])) for r in rows]
        spark.createDataFrame(at, OPS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(OPS).parquet(f"{folder}/in")
        q = streams.admitted(stream, depth, lease, "1 minute").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        out.append({(r.seq, r.verdict): r.job_id for r in spark.read.schema(streams.QUEUE).parquet(f"{folder}/out").collect()})
    return out


def test_job_queue(spark, folder):
    rows = [("q", "a", 1, "submit", 0), ("q", "a", 2, "submit", 0), ("q", None, 3, "claim", 1), ("q", "b", 4, "submit", 1), ("q", "c", 5, "submit", 1), ("q", "a", 6, "delete", 2), ("q", "b", 7, "delete", 2), ("q", None, 8, "claim", 2), ("q", "a", 9, "finish", 3), ("q", "a", 10, "finish", 3), ("q", "a", 11, "submit", 3), ("q", "a", 12, "delete", 3), ("q", "a", 13, "submit", 3), ("p", "a", 14, "submit", 4), ("p", None, 15, "restart", 4), ("p", "z", 16, "delete", 4)]
    (got,) = played(spark, folder, [rows], "one")
    verdicts = {seq: v for seq, v in got}
    assert verdicts == {1: "queued", 2: "repeated", 3: "claimed", 4: "queued", 5: "rejected", 6: "refused", 7: "refused", 8: "busy", 9: "finished", 10: "unknown", 11: "repeated", 12: "deleted", 13: "queued", 14: "queued", 15: "idle", 16: "unknown"}


def test_a_queue_goes_on_after_a_restart(spark, folder):
    """The running job of a stopped stream has failed at the restart op; those that waited are claimed in order."""
    first = [("q", "a", 1, "submit", 0), ("q", "b", 2, "submit", 0), ("q", None, 3, "claim", 1)]
    second = [("q", None, 4, "restart", 2), ("q", "a", 5, "submit", 2), ("q", None, 6, "claim", 3), ("q", "b", 7, "finish", 4), ("q", None, 8, "claim", 4)]
    got = played(spark, folder, [first, second], "restart")[-1]
    assert got == {(1, "queued"): "a", (2, "queued"): "b", (3, "claimed"): "a", (4, "interrupted"): "a", (5, "repeated"): "a", (6, "claimed"): "b", (7, "finished"): "b", (8, "idle"): None}


def test_leases_run_out(spark, folder):
    """By the next op of the queue, and by a timer once the watermark has passed."""
    first = [("q", "a", 1, "submit", 0), ("q", "b", 2, "submit", 0), ("q", None, 3, "claim", 1), ("q", None, 4, "claim", 12), ("p", "x", 5, "submit", 13)]
    second = [("p", "y", 6, "submit", 40)]
    one, two = played(spark, folder, [first, second], "lease")
    assert one[3, "expired"] == "a" and one[4, "claimed"] == "b" and (4, "expired") not in one
    assert two[4, "expired"] == "b"


CHANGES = "event_id long, seq long, v string, checksum string, created_at string"


def test_projection_follows_its_batches(spark, folder):
    """A batch gives rows for the events it changes alone; late, repeated and missed versions come out as in one upsert."""
    streams.with_rocksdb(spark)
    batches = [
        [(1, 1, "a", "c1", "t1"), (2, 1, "x", None, "t1"), (3, 1, "y", "c3", "t1")],
        [(1, 3, "b", None, "t3")],
        [(2, 2, None, "c2", "t2"), (2, 1, "x", None, "t1"), (4, 9, "new", None, None)],
        [(1, 2, "late", "c2", "t2"), (1, 0, "first", None, "t0"), (3, 1, "y", "c3", "t1")],
    ]
    sizes = []
    for rows in batches:
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(CHANGES).parquet(f"{folder}/in")
        streams.kept_up(streams.projected(stream, kept=("checksum",), first=("created_at",)), f"{folder}/out", f"{folder}/cp").awaitTermination()
        sizes.append(spark.read.parquet(f"{folder}/out").count())
    assert sizes == [3, 4, 6, 7]
    got = streams.current(spark.read.parquet(f"{folder}/out").drop("batch")).drop("version").select("event_id", "seq", "v", "checksum", "created_at")
    every = spark.createDataFrame([r for rows in batches for r in rows], CHANGES)
    want = learning.upserted(every, kept=("checksum",), first=("created_at",)).select("event_id", "v", "checksum", "created_at")
    assert sorted(map(tuple, got.drop("seq").collect())) == sorted(map(tuple, want.collect()))
    assert {r.event_id: (r.v, r.checksum, r.created_at) for r in got.collect()} == {1: ("b", "c2", "t0"), 2: (None, "c2", "t1"), 3: ("y", "c3", "t1"), 4: ("new", None, None)}


def test_outbox(spark, folder):
    spark.range(4).coalesce(1).write.parquet(f"{folder}/in")
    streams.outbox(spark.readStream.schema("id long").parquet(f"{folder}/in"), f"{folder}/box", f"{folder}/cp2").awaitTermination()
    assert spark.read.parquet(f"{folder}/box").count() == 4


# --- odd rows -------------------------------------------------------------------------

SEGMENT = "meeting_id long, segment_id string, idx int, start_s double, end_s double, speech_seconds double, speaker string, cluster_id string, text string, language string, avg_logprob double, compression_ratio double, no_speech_prob double, attribution_state string, confirmed_display_name string, printable_name boolean, spans array<string>, speaker_id string"


def test_segments_on_odd_rows(spark):
    rows = [(1, "a", 0, 0.0, 1.0, 1.0, "Speaker 1", "c", None, None, None, None, None, "anonymous", None, None, None, None), (1, "a", 0, 0.0, 1.0, 1.0, "Speaker 1", "c", "", "und", -9.0, 1.0, 0.0, "odd", "n", False, None, "p"), (None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SEGMENT)
    for empty in (False, True):
        s = df.limit(0) if empty else df
        n = s.count()
        assert s.select(segments.garbage_reason(), segments.review_flag(["x"]), segments.display_speaker()).count() == n
        for f in (segments.attribution_violations, segments.migrated_attribution, segments.human_attributed, segments.indexed_lines, segments.transcript_stats, segments.run_statistics, segments.speech_share, segments.dominant_label, segments.language_histogram, minutes.attribution_legend, lambda x: minutes.label_map(x, "ro"), voices.cluster_view, minutes.heuristic_items):
            assert f(s).collect() is not None
        assert segments.indexed_lines(s).count() == n
    assert {r.rule for r in segments.attribution_violations(df).collect()} == {"unknown_state", "name_without_decision"}


def test_grounding_on_odd_rows(spark):
    claims = spark.createDataFrame([(1, "Unu DOI, trei patru"), (2, None), (3, "!!"), (4, "doi"), (1, "unu doi trei patru"), (5, "doi trei")], "claim_id long, claim string")
    texts = spark.createDataFrame([(1, "zero unu doi trei\npatru cinci"), (2, None), (3, "doidoi"), (4, "doi")], "text_id long, text string")
    assert {tuple(r) for r in minutes.grounded_claims(claims, texts).collect()} == {(1, 1), (4, 1), (4, 4), (5, 1)}
    assert minutes.grounded_claims(claims.limit(0), texts).count() == 0 and minutes.grounded_claims(claims, texts.limit(0)).count() == 0


def test_voices_on_odd_rows(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.0, 0.0]), (2, "c", [3.0, 4.0])], "cluster_id long, vec_id string, vector array<double>")
    c = {r.cluster_id: r.centroid for r in voices.centroids(v, ["cluster_id"]).collect()}
    assert c[2] == pytest.approx([0.6, 0.8]) and voices.centroids(v.limit(0), ["cluster_id"]).count() == 0
    assert {r.cluster_id: r.cohesion for r in voices.cohesion(v.where("vec_id <> 'b'"), ["cluster_id"]).collect()} == {1: None, 2: None}
    clusters = voices.centroids(v, ["cluster_id"])
    prints = spark.createDataFrame([(7, 70, [1.0, 0.0]), (8, 80, [0.6, 0.8]), (8, 81, [0.0, 1.0])], "person_id long, voiceprint_id long, vector array<double>")
    few = voices.candidates(voices.scored(clusters, prints)).collect()
    many = voices.candidates(voices.scored(clusters, prints, max_bytes=100)).collect()
    assert sorted(few) == sorted(many) and len(few) == 4
    assert voices.candidates(voices.scored(clusters, prints.limit(0))).count() == 0


def test_delivery_on_odd_rows(spark):
    d = spark.createDataFrame([(1, 1, "x", "failed", None, None), (1, 1, "y", "failed", None, None), (1, 2, "z", "dispatched", None, None), (1, 3, "w", "failed", None, None)], "meeting_id long, revision int, delivery_id string, status string, created_at timestamp, sent_at timestamp")
    assert sorted(r.delivery_id for r in delivery.collapsed(d).collect()) == ["w", "z"] and delivery.collapsed(d.limit(0)).count() == 0
    e = spark.createDataFrame([([" A@x.org", "a@x.org", None, "no"],), (None,)], "e array<string>")
    assert [r.a for r in e.select(delivery.addresses("e").alias("a")).collect()] == [["a@x.org"], []]


def test_empty_tables(spark):
    m = spark.createDataFrame([], "meeting_id long, title string, scheduled_at timestamp_ntz, created_at timestamp_ntz, review_status string, department string, agenda string")
    i = spark.createDataFrame([], "meeting_id long, item_id string, kind string, status string, owner string, category string, severity string, text string")
    assert meetings.dashboard(m, i, "2001-01-01").first().meetings == 0
    assert {r.decisions for r in meetings.category_counts(i).collect()} == {0}
    assert meetings.owner_workload(i).count() == 0 and context.title_terms(m).count() == 0
    r = spark.createDataFrame([], "meeting_id long, pos int, item_id string, translated string")
    assert translation.joined_back(i, r).count() == 0
