"""Pieces, fill-in-middle and importance resampling, each against its plain form."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from confab.llm import common, fill_middle, pieces, queries, resampling
from confab.llm.common import documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   a  b", "▁", "▁▁x ▁", "a\x00b", "ﬁ①́ é 中文字 ゼ梦", "😀" * 50, " " * 5000 + "x", "the" * 700, "ngong" * 500, "a" * 3000, "\n \n \n" * 300, "<s></s><unk><0x41> ⁇ ", "x" * 20 + " \t\n ", "a<P>b", "<S", "M> <M>"]


def ids_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("long_run", [256, 4])
def test_merge_rounds_give_the_librarys_ids(library, monkeypatch, long_run):
    """Rounds, queue and both: texts that tie, overlap, and form pieces that overtake others."""
    monkeypatch.setattr(pieces, "LONG_RUN", long_run)
    rnd, own = random.Random(3), pieces.Pieces(MODEL)
    texts = ODD + ["".join(rnd.choice("aabtheniong  \n▁éß中😀Qx0_-") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts += ["".join(rnd.choice("theinongreadmor▁ "[: 15 + 2 * (k % 2)]) for _ in range(1500)) for k in range(8)]
    got = own.encode(texts)
    assert [ids_of(g) for g in got] == library.encode(texts, add_bos=True, add_eos=True)
    assert own.decode(got) == [library.decode(ids_of(g)) for g in got]
    bare = own.encode(texts[:30], bos=False, eos=False)
    assert [ids_of(g) for g in bare] == library.encode(texts[:30])


def test_words_that_no_longer_fit_are_merged_again(library, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_WORDS", 5)
    own, texts = pieces.Pieces(MODEL), [f"word{k} other{k % 3} and{k % 2}" for k in range(40)]
    for k in range(0, 40, 4):
        assert [ids_of(g) for g in own.encode(texts[k : k + 4])] == library.encode(texts[k : k + 4], add_bos=True, add_eos=True)
    assert len(own.words) <= 20


def test_decoding_any_ids(library):
    """Ids that no text has: bytes that are no UTF-8, unknown pieces, pieces in any order."""
    rnd, own = random.Random(4), pieces.Pieces(MODEL)
    rows = [[rnd.choice((0, rnd.randrange(3, 600), rnd.randrange(3, 32000))) for _ in range(rnd.randint(0, 25))] for _ in range(800)]
    assert own.decode([np.array(r, "<u4").tobytes() for r in rows]) == [library.decode(r) for r in rows]
    with pytest.raises(ValueError):
        own.decode([np.array([40_000], "<u4").tobytes()])


def test_megabytes_without_a_space(library):
    rnd, own = random.Random(5), pieces.Pieces(MODEL)
    for text in ("".join(rnd.choice("theinongreadmorABCDE09+/") for _ in range(300_000)), "thein" * 60_000, " " * 100_000):
        assert ids_of(own.encode([text])[0]) == library.encode(text, add_bos=True, add_eos=True)


def test_pieces_of_whole_table(spark, sf_dir, library):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: r for r in queries.op11_pieces(spark, sf_dir).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert got[r.doc_id][1:] == want


def test_pieces_as_operators(spark):
    rows = [(1, "two words"), (None, None), (1, "two words"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit("clash")).withColumn("length", F.lit(1))
    tokens = pieces.encode(docs, MODEL)
    assert sorted(((r.doc_id, r.text) for r in pieces.decode(tokens, MODEL).collect()), key=repr) == sorted([(1, "two words"), (1, "two words"), (2, ""), (None, "")], key=repr)
    assert pieces.round_trip(docs.limit(0), MODEL).collect() == []
    assert sorted(r.n_tokens for r in pieces.round_trip(docs, MODEL).collect())[:2] == [2, 2]


# --- fill in the middle ---------------------------------------------------------------


def cut_plainly(doc_id, text, seed=42, rate=50):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_middles_of_odd_texts(spark):
    """Each text under many ids, so that all forms and cuts occur, the empty parts among them."""
    rows = [(i, t) for i in range(40) for t in ODD] + [(None, "a b c"), (7, None), (None, None), (5, "x y"), (5, "x y"), (5, "x z")] + [(i, "word " * 20_000) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("form", F.lit("")).withColumn("n", F.lit("clash"))
    got = fill_middle.restore(fill_middle.transform(docs)).collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter(cut_plainly(i, t) for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digest(docs.limit(0)).collect() == []


def test_middles_with_other_settings(spark, sf_dir):
    docs = documents(spark, sf_dir)
    forms = Counter(r.form for r in fill_middle.transform(docs, rate=100, spm_rate=0).collect())
    assert forms["psm"] > 150 and not forms["spm"]
    assert Counter(r.form for r in fill_middle.transform(docs, rate=0).collect()) == {"plain": docs.count()}


def test_middles_of_a_row_repeated_often(spark, monkeypatch):
    rows = [(4, f"a repeated text {k}") for k in range(3)] * 40
    monkeypatch.setattr(fill_middle, "spread_join", functools.partial(common.spread_join, most=5))
    got = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), rate=100).collect()
    assert Counter(tuple(r) for r in got) == Counter(cut_plainly(i, t, rate=100) for i, t in rows)


def test_units_are_shuffled_once(spark, sf_dir):
    plan = fill_middle.offsets(fill_middle.plans(documents(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # one of them is reused when the query runs


# --- importance resampling ------------------------------------------------------------


def resampled_plainly(docs, target, percent=10, max_n=1, buckets=10_000, least=20, seed=2024):
    def words(t):
        return [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]

    def features(ws):
        return [" ".join(ws[i : i + n]) for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(bucket(f) for _, x in rows for f in features(words(x))) for rows in (docs, [(0, x) for x in target]))
    s_all, t_all = float(s.total()), float(t.total())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    out = []
    for doc, text in docs:
        ws = words(text)
        fs = features(ws)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(fs), weight, score, len(ws) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(fit[: percent * len(fit) // 100])]
    return Counter(drawn) + Counter((*r[:4], None) for r in out if not r[4]) + Counter((*r[:4], None) for r in fit[len(drawn) :])


@pytest.mark.parametrize("settings", [{}, {"run_rows": 7, "fan_in": 3, "range_rows": 5}, {"run_rows": 1000, "fan_in": 2, "range_rows": 1}])
def test_draws_of_whole_table(spark, sf_dir, settings):
    """With one run a partition, and with many small runs, levels and ranges."""
    docs, bench = documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")
    got = resampling.resample(docs.repartition(3), bench, **settings).collect()
    want = resampled_plainly([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert Counter(tuple(r) for r in got) == want
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(1 for k in want if k[4]) + 1))


@pytest.mark.parametrize("percent, max_n", [(10, 1), (50, 2), (100, 1), (0, 1)])
def test_draws_of_odd_rows(spark, percent, max_n):
    """Ties, one row repeated as a third of all, null ids and texts, short texts."""
    rnd, vocabulary = random.Random(6), [f"w{k}" for k in range(30)] + ["É", "中文"]
    rows = [(k % 40, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40)))) for k in range(120)]
    rows += [(3, "the same twenty words " * 6)] * 60 + [(None, "null id words here " * 6)] * 5 + [(None, None), (9, None), (9, ""), (9, "Short One")]
    target = ["w1 w2 w3 中文 null", None, ""]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0)).repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, bench, percent=percent, max_n=max_n, buckets=50, run_rows=10, fan_in=2, range_rows=4).collect()
    assert Counter(tuple(r) for r in got) == resampled_plainly(rows, target, percent, max_n, 50)


def test_draws_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [tuple(r)[4] for r in resampling.resample(one, none).collect()] == [None]


def test_tournament_against_sorting(tmp_path):
    from pyarrow import fs

    rnd = np.random.default_rng(7)
    for n in (1, 2, 3, 7, 16):
        runs = []
        for k in range(n):
            size = int(rnd.integers(0, 3000))
            run = resampling.sorted_run(*(rnd.integers(0, 4, size) for _ in range(4)), rnd.integers(-20, 20, size))
            (tmp_path / f"{n}-{k}").write_bytes(run.tobytes())
            runs += [(-r[0], *r[1:5]) for r in run.tolist() for _ in range(r[5])]
        for highest in (None, 5, -100):
            cursors = [resampling.Cursor(fs.LocalFileSystem(), str(tmp_path / f"{n}-{k}"), highest) for k in range(n)]
            got = [key for key, copies in resampling.tournament(cursors) for _ in range(copies)]
            assert got == sorted(r for r in runs if highest is None or -r[0] <= highest)


def test_ranges_cover_the_draw():
    histogram = [(9, 3), (7, 10), (4, 1), (3, 1), (-2, 6)]
    assert resampling.ranges(histogram, 15, 4) == [(9, 7, 0, 13), (4, 3, 13, 2)]
    assert resampling.ranges(histogram, 12, 100) == [(9, 7, 0, 12)]
    assert resampling.ranges(histogram, 21, 1)[-1] == (-2, -2, 15, 6)
