"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_documents import WORD, brute_components, brute_contamination, brute_fingerprint, brute_stats

from pyspark.sql import Row

import corpus_pipeline
from confab.llm import mixing
from confab.llm.common import documents, materialize


def plain_lines(text):
    """(line, its normal form, words) of each line."""
    for line in text.split("\n"):
        words = bytes(48 if 49 <= c <= 57 else c for c in line.encode().lower()).split()
        yield line, b" ".join(words), len(words)


def brute_quality(rows, min_docs=10, min_share=0.001):
    lines = {r.doc_id: Counter() for r in rows}
    for r in rows:
        for _, line, n in plain_lines(r.text or ""):
            if n:
                lines[r.doc_id][line] += n
    hosts = Counter(r.source for r in rows)

    def above(of):
        held = {}
        for r in rows:
            for line in of[r.doc_id]:
                held.setdefault((r.source, line), set()).add(frozenset(lines[r.doc_id]) if r.doc_id not in same else same[r.doc_id])
        return {k for k, who in held.items() if len(who) >= max(min_docs, min_share * hosts[k[0]])}

    same = {}
    once = above(lines)
    some = {r.doc_id: [x for x in lines[r.doc_id] if (r.source, x) in once] for r in rows}
    for r in rows:
        n = sum(lines[r.doc_id].values())
        if some[r.doc_id] and n - sum(lines[r.doc_id][x] for x in some[r.doc_id]) <= 0.05 * n:
            same[r.doc_id] = ("near", frozenset(some[r.doc_id]))
    frequent = above(some)
    for r in rows:
        n, _, _, _, repeat = brute_stats(r.text)
        left = n - sum(k for x, k in lines[r.doc_id].items() if (r.source, x) in frequent)
        if n >= 20 and 100 * repeat <= 30 * n and left >= 0.3 * n:
            text = "\n".join(line for line, x, _ in plain_lines(r.text) if (r.source, x) not in frequent)
            yield Row(**r.asDict() | {"text": text, "n_chars": r.n_chars if text == r.text else len(text)})


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "decontaminate", "mix", "tokens"]
    docs, kept = documents(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = materialize(stage(spark, docs, sf_dir), name)
        if name != "tokens":
            assert kept[name].columns == docs.columns
            docs = kept[name]
    rows = {n: k.collect() for n, k in kept.items()}
    want = list(brute_quality(documents(spark, sf_dir).collect()))
    assert sorted(rows["quality"]) == sorted(want)
    component = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in want])
    want = [r for r in want if component[r.doc_id] == r.doc_id]
    assert sorted(rows["near_copies"]) == sorted(want)
    items = [(r.item_id, r.text) for r in documents(spark, sf_dir, "benchmark").collect()]
    want = [r for r in want if not brute_contamination(r.text, items)[4]]
    assert sorted(rows["decontaminate"]) == sorted(want)
    size = Counter()
    for r in want:
        size[r.source] += len(WORD.findall(r.text))
    sources = sorted(size)
    goal = dict(zip(sources, mixing.targets([size[s] for s in sources], [(1, 2, 3)[i % 3] for i in range(len(sources))])))
    taken = Counter()
    texts = {r.doc_id: r.text for r in want}
    for r in rows["mix"]:
        taken[r.source] += len(WORD.findall(r.text))
        assert r.text in texts[r.doc_id]
    assert all(abs(taken[s] - goal[s]) <= 3 for s in sources)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter()
    for r in rows["mix"]:
        x = np.array(whole.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        ids[r.doc_id, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows["tokens"]) == ids
    at = 0
    for r in sorted(rows["tokens"], key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__ as entry

    assert sorted(entry.queries()["pipeline"](spark, sf_dir).columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


def test_finished_stages_are_removed(spark, sf_dir):
    """After a run the shared folder holds no stage's rows nor tables, only what its result is read from."""
    from pathlib import Path

    from confab.llm.common import shared_dir

    base = Path(shared_dir(spark).removeprefix("file://"))
    before = set(base.iterdir())
    tokens = corpus_pipeline.run(spark, sf_dir)
    left = {p.name.rsplit("-", 1)[0] for p in set(base.iterdir()) - before}
    assert left == {"tokens", "token-manifest"} and tokens.count() > 0


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, repeated rows, empty and long texts, clashing columns and empty tables pass every stage."""
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, long, "en", "a", 1, "k"), (1, long, "en", "a", 1, "k"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "k"), (None, "some words " * 3 + " ".join("abcdefghijklmnopqrstuvwxyz"), None, None, None, None), (4, " \n\t ", "en", "b", 3, "k")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    for docs, most in ((odd, 2), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
            assert docs.columns == odd.columns
        assert len({r.doc_id for r in docs.collect()}) == most
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
