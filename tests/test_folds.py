"""Order-dependent operators against worked examples and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from confab.operators import evaluation, folds, intervals, learning, linkage, minutes, voices


def spans(windows):
    return [(w[0][0], w[-1][1]) for w in windows]


@pytest.mark.parametrize(
    "regions, want",
    [
        ([(0, 6), (6.5, 7.3), (8, 13)], [(0, 7.3), (8, 13)]),
        ([(0, 11), (11.5, 12.3)], [(0, 12.3)]),
        ([(0, 0.8), (1.2, 7)], [(0, 7)]),
        ([(k * 3.5, k * 3.5 + 3) for k in range(8)], [(0, 10), (10.5, 20.5), (21, 27.5)]),
        ([(0, 1), (1.3, 19)], [(0, 19)]),
        ([(0, 1), (1.3, 21)], [(0, 1), (1.3, 21)]),
        ([(0, 3), (8, 11)], [(0, 3), (8, 11)]),
        ([(0, 28)], [(0, 28)]),
        ([(100, 104), (104.6, 111), (112, 130), (130.3, 131), (140, 141.2)], [(100, 111), (112, 131), (140, 141.2)]),
    ],
)
def test_pack(regions, want):
    assert spans(folds.pack(regions)) == want


def test_pack_takes_pieces_in_order():
    """A region that starts inside one over the cap comes before the later pieces of that one."""
    assert folds.pack([(0, 28.4), (4.1, 5.5), (30, 31)]) == [[(0, 14.2), (4.1, 5.5)], [(14.2, 28.4), (30, 31)]]


def test_pack_cuts_long_regions():
    got = spans(folds.pack([(10, 75)]))
    assert len(got) == 3 and got[0][0] == 10 and got[-1][1] == 75 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    with pytest.raises(ValueError):
        folds.pack([], shortest=5, target=1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 40), st.floats(0.01, 6)), max_size=25))
def test_pack_covers_every_region_once(steps):
    at, regions = 0.0, []
    for length, gap in steps:
        regions.append((round(at, 3), round(at + length, 3)))
        at += length + gap
    regions = [r for r in regions if r[1] > r[0]]
    packed = folds.pack(regions)
    assert [p for w in packed for p in w] == [p for r in regions for p in folds.cut_equally(*r, 28.0)]
    assert all(w[-1][1] - w[0][0] <= 28.001 for w in packed)


def test_merge_by_energy():
    assert folds.merge_by_energy([(0, 1), (1.2, 2), (3, 4)]) == [(0, 2), (3, 4)]
    assert folds.merge_by_energy([(0, 11), (11.2, 13)]) == [(0, 11), (11.2, 13)]
    assert folds.merge_by_energy([(0, 25)]) == [(0, 8.333), (8.333, 16.667), (16.667, 25.0)]


def test_hysteresis():
    p = [0.1] * 20 + [0.9] * 30 + [0.4] * 10 + [0.9] * 10 + [0.1] * 40
    got = folds.speech_regions(p)
    assert len(got) == 1 and got[0] == (round(20 * 0.032 - 0.2, 3), round(70 * 0.032 + 0.2, 3))
    assert folds.speech_regions([0.1] * 10) == [] and folds.speech_regions([]) == []
    assert folds.speech_regions([0.9] * 3 + [0.0] * 30) == []
    assert len(folds.speech_regions([0.9] * 1300)) == 3


def test_chunks():
    got = folds.chunk_lines([20] * 20, set(), 100, 45)
    assert len(got) == 6 and got[0] == (0, 0, 4) and got[1] == (3, 5, 7)
    assert [(a, c) for a, _, c in folds.chunk_lines([10] * 9, {0, 3, 6}, 50, 0)] == [(0, 2), (3, 5), (6, 8)]
    assert folds.chunk_lines([10] * 9, {0, 1}, 50, 0)[0] == (0, 0, 4)
    assert folds.chunk_lines([500], set(), 100, 10) == [(0, 0, 0)] and folds.chunk_lines([], set()) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=30), st.sets(st.integers(0, 29)), st.integers(20, 100), st.integers(0, 40))
def test_chunks_take_every_line_fresh_once(costs, turns, budget, overlap):
    got = folds.chunk_lines(costs, turns, budget, overlap)
    assert [i for _, fresh, last in got for i in range(fresh, last + 1)] == list(range(len(costs)))
    assert all(sum(costs[a : c + 1]) <= budget or a == b == c for a, b, c in got)


def item(text, evidence, chunk=None, **more):
    return {"text": text, "evidence": evidence, "chunk": chunk, "priority": None, "owner": None, "deadline": None, "speakers": []} | more


def test_merge_items():
    a, b = item("verify the plan", [6], 0, priority="low"), item("verify the whole plan", [6, 7], 1, priority="high", owner="S2", deadline="Friday")
    (m,) = folds.merge_in_order([a, b])
    assert m["evidence"] == [6, 7] and m["text"] == b["text"] and m["priority"] == "high" and (m["owner"], m["deadline"]) == ("S2", "Friday")
    same = [item("order a new stent for room three", [k], c) for c, k in enumerate((4, 16, 40))]
    assert [x["evidence"] for x in folds.merge_in_order(same)] == [[4, 16], [40]]
    assert len(folds.merge_in_order([item("one thing", [3], 0), item("quite another", [3], 0)])) == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["alpha beta", "alpha betas", "gamma"]), st.sets(st.integers(0, 30), min_size=1, max_size=3), st.integers(0, 2)), max_size=8))
def test_merge_keeps_all_evidence(rows):
    out = folds.merge_in_order([item(t, sorted(e), c) for t, e, c in rows])
    assert {i for x in out for i in x["evidence"]} == {i for _, e, _ in rows for i in e}


def test_folds_in_spark(spark):
    w = spark.createDataFrame([(1, k, float(k * 10), k * 10 + d, x) for k, (d, x) in enumerate([(2.0, "ro"), (5.0, "ru"), (3.0, "en"), (1.0, "en"), (9.0, "ro")])], "meeting_id long, window int, start_s double, end_s double, language string")
    assert [r.language for r in folds.inherited_languages(w).orderBy("window").collect()] == ["ro", "ru", "ru", "ru", "ro"]
    s = spark.createDataFrame([(1, "a", 0.0, 5.0, "A"), (1, "b", 4.0, 8.0, "B"), (1, "c", 7.0, 9.0, "B"), (1, "d", 8.9, 9.02, "A")], "meeting_id long, segment_id string, start_s double, end_s double, speaker string")
    assert {r.segment_id: (r.start_s, r.end_s) for r in folds.repaired_overlaps(s).collect()} == {"a": (0.0, 4.5), "b": (4.5, 8.0), "c": (7.0, 9.0), "d": (8.9, 9.02)}
    c = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.95), (1, 1, 1, 0.8), (1, 1, 0, 0.7)], "meeting_id long, gold int, pred int, ratio double")
    assert sorted((r.gold, r.pred) for r in folds.greedy_pairs(c).collect()) == [(0, 1), (1, 0)]


# --- voices ---------------------------------------------------------------------------


def test_average_linkage():
    rng = np.random.default_rng(0)
    a = rng.normal(size=16)
    x = np.concatenate((a + 0.05 * rng.normal(size=(6, 16)), -a + 0.05 * rng.normal(size=(5, 16))))
    assert voices.average_linkage(x, 0.45).tolist() == [0] * 6 + [1] * 5
    assert set(voices.average_linkage(x, 2.0)) == {0} and voices.average_linkage(x, -1.0).tolist() == list(range(11))
    assert voices.average_linkage(x, -1.0, max_clusters=2).max() == 1 and len(voices.average_linkage(np.zeros((0, 3)))) == 0


def brute_linkage(x, stop):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        d, a, b = min((round(float(np.mean([1 - unit[i] @ unit[j] for i in g for j in h])), 12), a, b) for a, g in enumerate(groups) for b, h in enumerate(groups) if a < b)
        if d > stop:
            break
        groups[a] += groups.pop(b)
        groups.sort(key=min)
    label = {i: k for k, g in enumerate(sorted(groups, key=min)) for i in g}
    return [label[i] for i in range(len(x))]


@pytest.mark.parametrize("seed", range(5))
def test_average_linkage_by_brute_force(seed):
    x = np.random.default_rng(seed).normal(size=(14, 4))
    assert voices.average_linkage(x, 0.6).tolist() == brute_linkage(x, 0.6)


def test_two_means():
    a, b = np.eye(4)[[0] * 3], np.eye(4)[[1] * 3]
    half, cosine = voices.two_means(np.concatenate((a, b)))
    assert half.tolist() == [0, 0, 0, 1, 1, 1] and cosine == pytest.approx(0.0)
    assert voices.two_means(a[:1])[1] == 1.0


def test_diagnostics(spark):
    rows = [(1, 0, k, k, 0.0, 2.0, [1.0, 0.0] if k < 3 else [0.0, 1.0]) for k in range(6)] + [(1, 1, k, k, 0.0, 2.0, [1.0, 0.0]) for k in range(6, 10)] + [(1, 2, k, 9, 0.0, 2.0, [1.0, 0.0]) for k in range(10, 12)]
    w = spark.createDataFrame(rows, "meeting_id long, label long, window long, region long, start_s double, end_s double, vector array<double>")
    assert {r.label: (r.mixed, r.short) for r in linkage.diagnosed(w).collect()} == {0: (True, False), 1: (False, False), 2: (False, True)}


# --- intervals ------------------------------------------------------------------------


def test_region_intersection(spark):
    def cut(regions, segments):
        r = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(regions)], "meeting_id long, region_id long, start_s double, end_s double")
        s = spark.createDataFrame([(1, float(a), float(b)) for a, b in segments], "meeting_id long, start_s double, end_s double")
        got = sorted((x.start_s, x.end_s, x.inside) for x in intervals.regions_in_segments(r, s).collect())
        return [(a, b) for a, b, i in got if i], sum(b - a for a, b, i in got if not i)

    pieces, outside = cut([(1, 13), (20, 21)], [(1, 5), (5.3, 9), (9.3, 12.5)])
    assert pieces == [(1, 5), (5.3, 9), (9.3, 12.5)] and outside == pytest.approx(2.1)
    assert cut([(0, 10)], [(0, 6), (5, 10)])[0] == [(0, 5), (5, 6), (6, 10)]


def test_equal_parts(spark):
    r = spark.createDataFrame([(1, 0.0, 20.0), (2, 0.0, 0.2), (3, 5.0, 5.0)], "meeting_id long, start_s double, end_s double")
    assert [(x.meeting_id, x.part) for x in intervals.equal_parts(r, 8.0, 0.3).orderBy("part").collect()] == [(1, 0), (1, 1), (1, 2)]


def test_sliding(spark):
    r = spark.createDataFrame([(1, 0.0, 4.0), (2, 0.0, 1.0), (3, 0.0, 1.5)], "meeting_id long, start_s double, end_s double")
    got = sorted((x.meeting_id, x.w_start, x.w_end) for x in intervals.sliding(r).collect())
    assert got == [(1, 0.0, 1.5), (1, 0.75, 2.25), (1, 1.5, 3.0), (1, 2.25, 3.75), (1, 3.0, 4.0), (2, 0.0, 1.0), (3, 0.0, 1.5), (3, 0.75, 1.5)]


# --- labels, names and rules ----------------------------------------------------------


@pytest.mark.parametrize("text, labels", [("S3 a propus, S1 nu", [3, 1]), ("nivel L5-S1", []), ("zgomotele S1, S2 și S3", []), ("galop S3", []), ("S2,5 mg", []), ("zgomote cardiace S1", []), ("stadiul bolii, S2 a zis", [2]), ("Speaker 2 și S12", [2, 12]), ("S1 zgomotos", []), ("We discussed S2 first", [2]), ("S3 discussed it", [3]), ("murmur department S2", [2]), ("murmur also S2", [2]), ("galop S1, dar S2", [2]), ("discul de S1", []), ("nivel L5-S2, S3", []), (None, [])])
def test_speaker_labels(text, labels):
    assert [int(m[2]) for m in minutes.speaker_labels(text)] == labels


def test_rendering_is_idempotent_and_reversible(spark):
    from pyspark.sql import functions as F

    names = F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array(F.lit("Dr. Ion Popescu"), F.lit("Vorbitorul 2")))
    row = spark.createDataFrame([("S1 cu S2 la L5-S1 și S30",)], "t string").select(minutes.rendered("t", names).alias("a"), minutes.rendered(minutes.rendered("t", names), names).alias("b"), minutes.stored_form(minutes.rendered("t", names), names).alias("c")).first()
    assert row.a == "Dr. Ion Popescu cu Vorbitorul 2 la L5-S1 și S30" == row.b and row.c == "S1 cu S2 la L5-S1 și S30"


def test_grounded_labels(spark):
    rows = [("S7 spune", ["S7", "Speaker 2"], ["S2", "S1"], "S2"), ("S1 spune", ["s1"], ["S1"], "S1"), ("S9", None, [], None)]
    df = spark.createDataFrame(rows, "t string, s array<string>, a array<string>, f string")
    got = [tuple(r.g) for r in df.select(minutes.grounded_labels("t", "s", "a", "f").alias("g")).collect()]
    assert got == [("S2 spune", ["S2"], True), ("S1 spune", ["S1"], False), ("S9", [], False)]


def test_owners(spark):
    a = spark.createDataFrame([(1, "a", "doctorul Popesku", None, "va face doctorul Popesku"), (1, "b", "Vasile", None, "spune Ana"), (1, "c", "noi", "S3", "noi"), (1, "d", "Zinaida", None, "Zinaida vine"), (1, "e", None, "Speaker 1", "")], "meeting_id long, item_id string, mention string, owner_label string, cited_text string")
    who = spark.createDataFrame([(1, 0, "Dr. Ion Popescu"), (1, 1, "Ana Popescu")], "meeting_id long, pos int, name string")
    got = {r.item_id: (r.owner, r.owner_source) for r in minutes.resolved_owners(a, who).collect()}
    assert got == {"a": ("Dr. Ion Popescu", "roster"), "b": ("Unassigned", "unassigned"), "c": ("Speaker 3", "speaker"), "d": ("Zinaida", "mention"), "e": ("Unassigned", "unassigned")}


def test_names_in_prose(spark):
    assert minutes.capitalised_runs("Azi a venit Ion Popescu. Maine pleaca dr. Rusu") == ["Ion Popescu", "Rusu"]
    p = spark.createDataFrame([("x", "a venit Ion Popescu aici")], "item_id string, text string")
    k = spark.createDataFrame([("ion",)], "word string")
    assert [r.token for r in minutes.unknown_names(p, k).collect()] == ["Popescu"]
    from pyspark.sql import functions as F

    m = F.map_from_arrays(F.array(F.lit("Ion"), F.lit("Ion Popescu")), F.array(F.lit("X"), F.lit("Y")))
    assert p.select(minutes.anonymised("text", m).alias("t")).first().t == "a venit Y aici"


def test_mining(spark):
    rows = [(1, 1, "r1", "la felcer azi", "la asistent medical azi"), (2, 2, "r2", "un felcer bun", "un asistent medical bun"), (3, 2, "r2", "un spital bun", "un spital rau mare")]
    e = spark.createDataFrame([(*r[:3], "ro", r[3], None, r[4]) for r in rows], "event_id long, meeting_id long, reviewer string, language string, raw_text string, previous_text string, new_text string")
    (got,) = learning.mined_rules(e).collect()
    assert (got.variant, got.canonical, got.occurrences, got.meetings, got.reviewers, got.is_safe, got.contradictory) == ("felcer", "asistent medical", 2, 2, 2, True, False)
    assert got.contexts == ["la felcer azi", "un felcer bun"] and got.rule_id == learning.mined_rules(e).first().rule_id


def test_splits():
    assert learning.shuffled_split([]) == {} and learning.shuffled_split(["a"]) == {"a": "train"} and sorted(learning.shuffled_split(["a", "b"]).values()) == ["test", "train"]
    for n in range(3, 30):
        got = learning.shuffled_split(list(range(n)))
        assert set(got.values()) >= {"train", "test"} and got == learning.shuffled_split(list(range(n)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 100, 10_000])
def test_exact_shares(spark, n):
    """As many groups a split as a seeded shuffle gives, none in two; from few cells of the histogram or many."""
    from collections import Counter

    want = Counter(learning.shuffled_split(list(range(n))).values())
    rows = spark.range(3 * n).select((F.col("id") % n).alias("g"))
    for bits in (4, 16):
        got = learning.exact_split(rows, "g", bits=bits).distinct().collect()
        assert Counter(r.split for r in got) == want and len(got) == n
    assert {tuple(r) for r in learning.exact_split(rows, "g", seed=7).distinct().collect()} != {tuple(r) for r in got} or n < 100


def test_exact_shares_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "clash"), (None, "x"), ("a", "x")], "g string, split string")
    got = learning.exact_split(rows, "g").collect()
    assert len({r.split for r in got if r.g is None}) == 1 and len(got) == 3
    assert learning.exact_split(rows.limit(0), "g").collect() == []


def test_registry(spark):
    acts = [("a", "register", None, None), ("a", "approve", "r", None), ("a", "evaluate", "r", True), ("a", "approve", "x", None), ("a", "approve", "r", None), ("a", "activate", None, None),
            ("b", "register", None, None), ("b", "evaluate", "q", True), ("b", "approve", "q", None), ("b", "activate", None, None)]
    def play(rows):
        df = spark.createDataFrame([("cpu", i, k, *r) for k, (i, *r) in enumerate(rows)], "runtime string, artifact_id string, seq int, action string, report string, passed boolean")
        return {r.artifact_id: (r.status, r.previous_id) for r in learning.registry(df).collect()}

    assert play(acts[:4]) == {"a": ("evaluated", None)}
    assert play(acts) == {"a": ("retired", None), "b": ("active", "a")}
    assert play([*acts, ("b", "rollback", None, None)]) == {"a": ("active", None), "b": ("retired", "a")}


# --- evaluation -----------------------------------------------------------------------


REPORT = "corpus_wer double, difference_upper double, critical_fact_errors int, silence_hallucinations int, entity_precision double, entity_recall double, rtf double"


@pytest.mark.parametrize("wer, upper, ro, status", [(0.110, -0.004, 0.1, "pass"), (0.118, -0.004, 0.1, "fail"), (0.110, 0.002, 0.1, "fail"), (0.110, -0.004, 0.130, "fail"), (0.110, None, 0.1, "insufficient_evidence"), (None, -0.004, 0.1, "insufficient_evidence")])
def test_release_gate(spark, wer, upper, ro, status):
    b = spark.createDataFrame([(0.120, None, 0, 0, None, None, None)], REPORT)
    c = spark.createDataFrame([(wer, upper, 0, 0, None, None, None)], REPORT)
    langs = spark.createDataFrame([("ro", 0.120, ro), ("ru", 0.2, None)], "language string, baseline_wer double, candidate_wer double")
    assert evaluation.release_gate(b, c, langs).first().status == status
    assert evaluation.release_gate(b, c, langs, strict=True).first().status != "pass"


def test_bootstrap(spark):
    r = spark.createDataFrame([(k, 10, 100, 5) for k in range(50)], "recording_id long, edits int, words int, edits_b int")
    got = evaluation.bootstrap(r, 100).first()
    assert got.mean_wer == pytest.approx(0.1) and got.lower == pytest.approx(0.1) and got.difference_upper == pytest.approx(-0.05)
    assert got == evaluation.bootstrap(r, 100).first()
    mixed = spark.createDataFrame([(k, k % 20, 100) for k in range(200)], "recording_id long, edits int, words int")
    got = evaluation.bootstrap(mixed, 300).first()
    assert got.lower < 0.095 < got.upper and got.upper - got.lower < 0.03


def test_draws_are_as_many_as_rows():
    """Buckets get binomial shares that add up, whatever their sizes, and spread as draws one by one do."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 40, 16)
    ends, n = np.cumsum(sizes), int(sizes.sum())
    draws = np.array([evaluation.split_draws(np.full(4000, n), k, ends, 7) for k in range(16)])
    assert (draws.sum(axis=0) == n).all() and (draws[sizes == 0] == 0).all()
    assert draws.mean(axis=1) == pytest.approx(sizes, abs=0.6)
    assert draws.var(axis=1) == pytest.approx(sizes * (1 - sizes / n), rel=0.12, abs=0.1)
    # within a bucket: a row's count over the resamples is binomial too
    values = np.eye(25, dtype=np.int64)
    counts = evaluation.bucket_sums(np.full(4000, 25), 3, values, 7)
    assert (counts.sum(axis=0) == 25).all() and counts.mean(axis=1) == pytest.approx(np.ones(25), abs=0.08)
    assert counts.var(axis=1) == pytest.approx(np.full(25, 0.96), abs=0.12)


def test_bootstrap_over_buckets(spark):
    """Many buckets or one: as wide an interval, and the same again from other partitions."""
    rows = [(k, k % 20, 100) for k in range(400)]
    r = spark.createDataFrame(rows, "recording_id long, edits int, words int")
    one, many = evaluation.bootstrap(r, 1000).first(), evaluation.bootstrap(r, 1000, leaf=20).first()
    assert many == evaluation.bootstrap(r.repartition(7), 1000, leaf=20).first()
    sigma = float(np.std([k % 20 / 100 for k in range(400)]) / 20)
    for got in (one, many):
        assert got.mean_wer == pytest.approx(0.095, abs=0.002) and got.upper - got.lower == pytest.approx(2 * 1.96 * sigma, rel=0.12)
    nothing = evaluation.bootstrap(r.limit(0)).first()
    assert tuple(nothing) == (0.0, 0.0, 0.0)
    wordless = spark.createDataFrame([(1, 3, 0)], "recording_id long, edits int, words int")
    assert tuple(evaluation.bootstrap(wordless).first()) == (0.0, 0.0, 0.0)


def test_error_counts(spark):
    p = spark.createDataFrame([("Medwark azi", "metwark azi"), ("", "ceva rău"), (None, None)], "reference string, hypothesis string")
    got = [(r.s, r.d, r.i, r.n, r.cs, r.ci, r.cn) for r in evaluation.error_counts(p).collect()]
    assert got == [(1, 0, 0, 2, 1, 0, 10), (0, 0, 2, 0, 0, 7, 0), (0, 0, 0, 0, 0, 0, 0)]


def test_scorecard(spark):
    gold = spark.createDataFrame([(1, 0, "închide secția", [4, 5], "Ana"), (1, 1, "cumpără stent", [6], None)], "meeting_id long, pos int, text string, evidence array<int>, owner string")
    pred = spark.createDataFrame([(1, 0, "inchide sectia", [5], "ana"), (1, 1, "altceva", [6], None), (2, 0, "x", [1], None)], "meeting_id long, pos int, text string, evidence array<int>, owner string")
    got = {r.meeting_id: (r.matched, tuple(r.score), r.owner_accuracy) for r in evaluation.scorecard(gold, pred).collect()}
    assert got == {1: (1, (0.5, 0.5, 0.5), 1.0), 2: (0, (0.0, 1.0, 0.0), None)}


@pytest.mark.parametrize("parts", [1, 7])
def test_overlaps_are_summed_in_one_order(spark, tmp_path, parts):
    """Shares at a half of the last digit, as SQL has them, however the turns are dealt."""
    from oracle import connect, difference

    from confab.plans.catalogue import ORACLES, QUERIES

    turns = {429: [255, 1020, 206, 227, 189, 1747, 164, 910], 19055: [316, 346, 248, 353, 369, 595]}
    rows = [(m, k, "user", "x" * n) for m, ns in turns.items() for k, n in enumerate(ns)]
    (tmp_path / "plain").mkdir()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().to_parquet(tmp_path / "plain/conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts).write.parquet(f"{tmp_path}/dealt/conversations.parquet")
    con = connect(tmp_path / "plain")
    con.execute("set threads=1")
    assert difference(QUERIES["interval_overlap_label"](spark, f"{tmp_path}/dealt"), con, ORACLES["interval_overlap_label"]) is None
