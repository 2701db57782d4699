"""Evaluation: error rates of speech recognition by slice, confidence, gates, and scorecards
of extraction. A measure without a denominator is null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions import arrow
from confab.functions import text as T


def ratio(a, b) -> Column:
    return F.when(b > 0, a / b)


def error_counts(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Pairs with word edits s, d, i, reference words n, and character edits cs, cd, ci, cn. Null texts are empty."""
    chars = lambda c: F.filter(F.split(F.replace(T.scoring_form(c), F.lit(" "), F.lit("")), ""), lambda x: x != "")
    out = arrow.dealt(pairs).withColumns({"__w": arrow.token_edits(T.scoring_words(reference), T.scoring_words(hypothesis)), "__c": arrow.token_edits(chars(reference), chars(hypothesis)), "n": F.size(T.scoring_words(reference)).cast("long"), "cn": F.size(chars(reference)).cast("long")})
    kinds = ("substitutions", "deletions", "insertions")
    return out.withColumns({n: F.col(f"__w.{k}") for n, k in zip(("s", "d", "i"), kinds)} | {n: F.col(f"__c.{k}") for n, k in zip(("cs", "cd", "ci"), kinds)}).drop("__w", "__c")


def word_error_rate(s="s", d="d", i="i", n="n") -> Column:
    """1 where nothing should have been said and something was."""
    return F.when(F.col(n) > 0, (F.col(s) + F.col(d) + F.col(i)) / F.col(n)).otherwise(F.when(F.col(i) > 0, 1.0).otherwise(0.0))


def joined_texts(segments: DataFrame, key: str, text: str) -> DataFrame:
    """A recording's texts by idx, trimmed, one space between them; empty ones are left out."""
    kept = segments.select(key, "idx", F.trim(F.coalesce(text, F.lit(""))).alias("t")).where("t <> ''")
    return kept.groupBy(key).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"])).alias("text"))


def recording_pairs(gold: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Recordings with reference and hypothesis; a recording without a hypothesis has an empty one."""
    ref = joined_texts(gold, "recording_id", "verbatim_text").withColumnRenamed("text", "reference")
    hyp = joined_texts(hypotheses, "recording_id", "text").withColumnRenamed("text", "hypothesis")
    every = gold.select("recording_id", "acoustic_condition").distinct()
    out = every.join(ref, "recording_id", "left").join(hyp, "recording_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("reference", "hypothesis")})


def error_slices(counts: DataFrame, by: list[str]) -> DataFrame:
    """Error rates of all and of every slice by ``by``: edits are sums, so one rollup gives them all."""
    sums = counts.rollup(*by).agg(*[F.sum(c).alias(c) for c in ("s", "d", "i", "n", "cs", "cd", "ci", "cn")], F.count("*").alias("rows"))
    return sums.withColumns({"wer": ratio(F.col("s") + F.col("d") + F.col("i"), F.col("n")), "cer": ratio(F.col("cs") + F.col("cd") + F.col("ci"), F.col("cn"))})


def language_errors(gold: DataFrame, hypotheses: DataFrame, whole_recording: bool = False) -> DataFrame:
    """Edits by language of the gold segments. Each segment meets the hypothesis segments that
    overlap it; with ``whole_recording``, all that was heard in its recording."""
    if whole_recording:
        pairs = gold.join(joined_texts(hypotheses, "recording_id", "text").withColumnRenamed("text", "hypothesis"), "recording_id", "left")
    else:
        from confab.operators.intervals import overlap_join

        a = gold.select("recording_id", "segment_id", F.col("start_s").alias("a_start"), F.col("end_s").alias("a_end"))
        b = hypotheses.select("recording_id", "idx", "text", F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"))
        # each hypothesis goes to the gold segment it overlaps most
        best = overlap_join(a, b, "recording_id").groupBy("recording_id", "idx").agg(F.max_by("segment_id", F.struct("overlap_s", "segment_id")).alias("segment_id"), F.first("text").alias("text"))
        heard = joined_texts(best.withColumn("segment", F.concat_ws("\x1f", "recording_id", "segment_id")), "segment", "text").withColumnRenamed("text", "hypothesis")
        pairs = gold.withColumn("segment", F.concat_ws("\x1f", "recording_id", "segment_id")).join(heard, "segment", "left")
    counts = error_counts(pairs.withColumn("reference", F.col("verbatim_text")))
    return counts.groupBy("language").agg(*[F.sum(c).alias(c) for c in ("s", "d", "i", "n")]).withColumn("wer", ratio(F.col("s") + F.col("d") + F.col("i"), F.col("n")))


def silence_insertions(pairs: DataFrame) -> DataFrame:
    return pairs.where(T.scoring_form("reference") == "").agg(F.coalesce(F.sum(F.size(T.scoring_words("hypothesis"))), F.lit(0)).cast("long").alias("silence_insertions"))


def critical_errors(segments: DataFrame) -> DataFrame:
    """Per segment (language, reference, hypothesis, facts: array of kind, token): dropped
    negations, and negations and doses that the facts name and the hypothesis lacks."""
    heard = T.scoring_words("hypothesis")
    ref = T.scoring_words("reference")
    missing = F.filter("facts", lambda f: ((f["kind"] == "negation") & F.array_contains(ref, F.lower(f["token"])) & ~F.array_contains(heard, F.lower(f["token"]))) | ((f["kind"] == "dosage") & ~F.contains(T.scoring_form("hypothesis"), F.lower(f["token"]))))
    auto = T.negation_dropped("reference", "hypothesis", "language")
    return segments.withColumn("critical_errors", (F.when(auto, 1).otherwise(0) + F.coalesce(F.size(missing), F.lit(0))).cast("long"))


def entity_recall(entities: DataFrame) -> DataFrame:
    """entities: term, hypothesis."""
    some = entities.where(T.scoring_form("term") != "").withColumn("hit", T.entity_hit("term", "hypothesis"))
    return some.agg(F.count_if("hit").alias("found"), F.count("*").alias("entities")).withColumn("recall", ratio(F.col("found"), F.col("entities")))


def draw_hash(recording) -> Column:
    """28 bits of a recording's id, the start of its random numbers."""
    return F.conv(F.substring(F.md5(F.col(recording).cast("string")), 1, 7), 16, 10).cast("long")


_PRIME = (1 << 31) - 1


def split_draws(draws: np.ndarray, bucket: int, ends: np.ndarray, seed: int) -> np.ndarray:
    """How many of each resample's draws fall to a bucket, of a power of two of them, when ``ends`` are
    the running sums of their rows: down a tree of halves, each seeded binomial given the count above it.
    All buckets of a node draw the same, so theirs add up to the node's."""
    lo, hi, node = 0, len(ends), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        begin = int(ends[lo - 1]) if lo else 0
        left, all_ = int(ends[mid - 1]) - begin, int(ends[hi - 1]) - begin
        share = np.random.default_rng([seed, node]).binomial(draws, left / all_ if all_ else 0.0)
        node *= 2
        if bucket < mid:
            draws, hi = share, mid
        else:
            draws, lo, node = draws - share, mid, node + 1
    return draws


def _fifth(u: np.ndarray) -> np.ndarray:
    """The fifth power modulo the prime, which permutes the numbers below it."""
    square = u * u % _PRIME
    return square * square % _PRIME * u % _PRIME


def bucket_sums(draws: np.ndarray, bucket: int, values: np.ndarray, seed: int) -> np.ndarray:
    """Sums of a bucket's ``values`` (a column each) over its draws of each resample, with replacement."""
    rows, at = values.shape[1], np.arange(len(draws))
    lots = (at * 48_271 + seed * 69_621 + bucket * 40_014) % _PRIME
    out = np.zeros((len(values), len(draws)), np.int64)
    for a in range(0, len(draws), 64):  # some resamples at a time
        n = draws[a : a + 64]
        b = np.repeat(at[a : a + 64], n)
        j = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n)
        u = _fifth(((j + 1) * 16_807 + lots[b]) % _PRIME)
        row = _fifth((u * 39_373 + lots[b]) % _PRIME) * rows // _PRIME
        for k, v in enumerate(values):
            np.add.at(out[k], b, v[row])
    return out


def bootstrap(recordings: DataFrame, resamples: int = 1000, seed: int = 42, leaf: int = 4_096) -> DataFrame:
    """Mean and 95 % interval of the error rate over resamples of whole recordings
    (recording_id, edits, words): as many draws with replacement as there are recordings.

    Recordings are dealt to buckets by a hash. Seeded binomials down a tree of the buckets say how many
    draws of each resample a bucket gets, exactly as if all were drawn one by one; a bucket draws its own,
    of about ``leaf`` rows at most. A task adds up its buckets for all resamples at once, so one row a resample
    and task is shuffled. Bounds are those at the places int(0.025 n) and int(0.975 n) of the sorted rates. With a
    second system's ``edits_b`` the difference of both on the same draws is given too."""
    two = "edits_b" in recordings.columns
    picked = recordings.select(draw_hash("recording_id").alias("h"), F.col("recording_id").cast("string").alias("id"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(name) for c, name in (("edits", "edits"), ("words", "words"), ("edits_b" if two else "edits", "edits_b"))))
    total = picked.count()
    bits = 0 if total <= leaf else min(20, (4 * total // (3 * leaf)).bit_length())
    placed = picked.withColumn("bucket", F.shiftright("h", 28 - bits).cast("int"))
    sizes = np.zeros(1 << bits, np.int64)
    for r in placed.groupBy("bucket").agg(F.count("*").alias("n")).collect():  # at most a row for every 3/4 leaf, and 2**20
        sizes[r.bucket] = r.n
    ends = np.cumsum(sizes)
    ddl = "b long, edits long, words long, edits_b long"

    def draw(batches):
        sums, at, held = np.zeros((3, resamples), np.int64), None, []

        def drawn():
            values = np.array(held, np.int64).T
            return bucket_sums(split_draws(np.full(resamples, total), at, ends, seed), at, values, seed)

        for batch in batches:
            for bucket, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != at and held:
                    sums += drawn()
                    held = []
                at = bucket
                held.append(row)
        if held:
            sums += drawn()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), *map(pa.array, sums)], ["b", "edits", "words", "edits_b"])

    dealt = placed.repartition("bucket").sortWithinPartitions("bucket", "h", "id", "edits", "words", "edits_b")
    sums = dealt.select("bucket", "edits", "words", "edits_b").mapInArrow(draw, ddl).groupBy("b").agg(*[F.sum(c).alias(c) for c in ("edits", "words", "edits_b")])
    rate = lambda c: F.when(F.col("words") > 0, F.col(c) / F.col("words")).otherwise(0.0)
    rates = sums.select(rate("edits").alias("wer"), rate("edits_b").alias("wer_b"))
    place = lambda values, share: F.coalesce(F.get(F.array_sort(F.collect_list(values)), F.lit(int(share * resamples))), F.lit(0.0))
    out = [F.coalesce(F.avg("wer"), F.lit(0.0)).alias("mean_wer"), place(F.col("wer"), 0.025).alias("lower"), place(F.col("wer"), 0.975).alias("upper")]
    if two:
        out.append(place(F.col("wer_b") - F.col("wer"), 0.975).alias("difference_upper"))
    return rates.agg(*out)


def prf(tp, predicted, gold) -> Column:
    """struct(p, r, f1): precision without predictions is 1 if there was nothing to find, recall of nothing is 1."""
    p = F.when(predicted > 0, tp / predicted).otherwise(F.when(gold == 0, 1.0).otherwise(0.0))
    r = F.when(gold > 0, tp / gold).otherwise(F.lit(1.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.struct(p.alias("p"), r.alias("r"), f.alias("f1"))


def item_candidates(gold: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """(meeting_id, gold, pred, ratio) of items (meeting_id, pos, text, evidence) that share a line and read alike."""
    g = gold.select("meeting_id", F.col("pos").alias("gold"), F.col("text").alias("gt"), F.explode("evidence").alias("line"))
    p = pred.select("meeting_id", F.col("pos").alias("pred"), F.col("text").alias("pt"), F.explode("evidence").alias("line"))
    pairs = g.join(p, ["meeting_id", "line"]).select("meeting_id", "gold", "pred", "gt", "pt").distinct()
    bare = pairs.withColumns({"gt": arrow.bare_text("gt"), "pt": arrow.bare_text("pt")})
    # a ratio is at most twice the shorter text over both
    some = bare.where(2 * F.least(F.length("gt"), F.length("pt")) >= least * (F.length("gt") + F.length("pt")))
    return some.withColumn("ratio", arrow.similarity("gt", "pt")).where(F.col("ratio") >= least).select("meeting_id", "gold", "pred", "ratio")


def scorecard(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per meeting: matched, predicted and gold items with precision, recall and F1, and of matched items the share with the right owner."""
    from confab.operators.folds import greedy_pairs

    pairs = greedy_pairs(item_candidates(gold, pred))
    owners = pairs.join(gold.select("meeting_id", F.col("pos").alias("gold"), F.col("owner").alias("go")), ["meeting_id", "gold"]).join(pred.select("meeting_id", F.col("pos").alias("pred"), F.col("owner").alias("po")), ["meeting_id", "pred"])
    same = arrow.bare_text("go") == arrow.bare_text("po")
    m = owners.groupBy("meeting_id").agg(F.count("*").alias("matched"), F.count_if(F.col("go").isNotNull()).alias("owned"), F.count_if(F.col("go").isNotNull() & same).alias("owner_hits"))
    n = lambda df, name: df.groupBy("meeting_id").agg(F.count("*").alias(name))
    every = gold.select("meeting_id").unionByName(pred.select("meeting_id")).distinct()
    out = every.join(n(gold, "gold"), "meeting_id", "left").join(n(pred, "predicted"), "meeting_id", "left").join(m, "meeting_id", "left")
    out = out.fillna(0, ["gold", "predicted", "matched", "owned", "owner_hits"])
    return out.select("meeting_id", "matched", "predicted", "gold", prf(F.col("matched"), F.col("predicted"), F.col("gold")).alias("score"), ratio(F.col("owner_hits"), F.col("owned")).alias("owner_accuracy"))


def extraction_measures(gold: DataFrame, pred: DataFrame, pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Over all meetings: fabrication (share of predicted items no gold item matches), deadline recall (of
    matched gold items with a deadline, those predicted with the same) and evidence validity (share of the
    predicted items' cited lines that the transcript (meeting_id, idx) has).

    gold and pred: meeting_id, pos, evidence, deadline; pairs: meeting_id, gold, pred."""
    hit = pairs.select("meeting_id", F.col("pred").alias("pos"), F.lit(True).alias("hit")).distinct()
    made = pred.join(hit, ["meeting_id", "pos"], "left").agg(F.count("*").alias("predicted"), F.count_if(F.col("hit").isNull()).alias("unmatched"))
    due = pairs.join(gold.select("meeting_id", F.col("pos").alias("gold"), F.col("deadline").alias("gd")), ["meeting_id", "gold"]).join(pred.select("meeting_id", F.col("pos").alias("pred"), F.col("deadline").alias("pd")), ["meeting_id", "pred"])
    due = due.agg(F.count_if(F.col("gd").isNotNull()).alias("due"), F.count_if(F.col("gd") == F.col("pd")).alias("due_hits"))
    cited = pred.select("meeting_id", F.explode("evidence").alias("idx")).join(segments.select("meeting_id", F.col("idx").cast("int").alias("idx"), F.lit(True).alias("there")).distinct(), ["meeting_id", "idx"], "left")
    cited = cited.agg(F.count("*").alias("cited"), F.count_if("there").alias("valid"))
    every = made.crossJoin(due).crossJoin(cited)  # one row each
    return every.select(ratio(F.col("unmatched"), F.col("predicted")).alias("fabrication"), ratio(F.col("due_hits"), F.col("due")).alias("deadline_recall"), ratio(F.col("valid"), F.col("cited")).alias("evidence_validity"))


def false_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Share of proposal lines (meeting_id, line) that decisions (meeting_id, evidence) cite."""
    cited = decisions.select("meeting_id", F.explode("evidence").alias("line")).distinct().withColumn("hit", F.lit(True))
    both = proposals.join(cited, ["meeting_id", "line"], "left")
    return both.agg(F.count_if("hit").alias("cited"), F.count("*").alias("proposals")).withColumn("rate", ratio(F.col("cited"), F.col("proposals")))


GATES = ("relative_wer_improvement", "paired_bootstrap_ci", "no_language_regression", "critical_fact_errors", "silence_hallucinations", "entity_recognition", "latency_rtf")


def release_gate(baseline: DataFrame, candidate: DataFrame, languages: DataFrame, strict: bool = False) -> DataFrame:
    """status and failed (array of gates) of a candidate against a baseline.

    Both have one row: corpus_wer, difference_upper, critical_fact_errors, silence_hallucinations,
    entity_precision, entity_recall, rtf. languages: language, baseline_wer, candidate_wer.
    Missing word error rates or intervals are ``insufficient_evidence``; missing counts are 0,
    missing entity measures 1, a missing speed passes. ``strict`` also asks for every language."""
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in baseline.columns])
    c = candidate.select(*[F.col(x).alias(f"c_{x}") for x in candidate.columns])
    worse = F.col("candidate_wer") > F.col("baseline_wer") + 1e-6
    lost = worse | (F.col("candidate_wer").isNull() if strict else F.lit(False))
    langs = languages.agg(F.coalesce(F.bool_or(F.coalesce(lost, F.lit(False))), F.lit(False)).alias("regressed"))
    both = b.crossJoin(c).crossJoin(langs)  # one row each

    def or_else(name, other):
        return F.coalesce(f"b_{name}", F.lit(other)), F.coalesce(f"c_{name}", F.lit(other))

    gain = F.when(F.col("b_corpus_wer") > 0, (F.col("b_corpus_wer") - F.col("c_corpus_wer")) / F.col("b_corpus_wer")).otherwise(F.lit(0.0))
    crit, hall = or_else("critical_fact_errors", 0), or_else("silence_hallucinations", 0)
    prec, rec = or_else("entity_precision", 1.0), or_else("entity_recall", 1.0)
    passed = (
        gain >= 0.05, F.coalesce(F.col("c_difference_upper") < 0.0, F.lit(False)), ~F.col("regressed"), crit[1] <= crit[0], hall[1] <= hall[0],
        (prec[1] >= prec[0] - 1e-6) & (rec[1] >= rec[0] - 1e-6), F.coalesce(F.col("c_rtf") <= F.col("b_rtf") * 1.20, F.lit(True)),
    )
    failed = F.array_compact(F.array(*[F.when(~p, n) for n, p in zip(GATES, passed, strict=True)]))
    missing = F.col("b_corpus_wer").isNull() | F.col("c_corpus_wer").isNull() | F.col("c_difference_upper").isNull()
    return both.select(F.when(missing, "insufficient_evidence").when(F.size(failed) == 0, "pass").otherwise("fail").alias("status"), F.array_join(failed, ",").alias("failed"), F.round(gain, 4).alias("relative_improvement"))


def report_delta(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, baseline, candidate, delta, relative) of two reports (metric, value)."""
    both = baseline.withColumnRenamed("value", "baseline").join(candidate.withColumnRenamed("value", "candidate"), "metric", "full")
    delta = F.col("candidate") - F.col("baseline")
    return both.select("metric", "baseline", "candidate", delta.alias("delta"), F.when(F.col("baseline") != 0, delta / F.col("baseline")).alias("relative"))


def manifest_violations(recordings: DataFrame) -> DataFrame:
    """(recording_id, rule) of a gold manifest: repeated ids, one checksum in two splits, times
    that go back, end before they start or run beyond the recording."""
    from pyspark.sql import Window

    ids = recordings.groupBy("recording_id").agg(F.count("*").alias("n")).where("n > 1").select("recording_id", F.lit("repeated_id").alias("rule"))
    leak = recordings.select("checksum_sha256", "split").distinct().groupBy("checksum_sha256").agg(F.count("*").alias("n")).where("n > 1")
    splits = recordings.join(leak, "checksum_sha256", "left_semi").select("recording_id", F.lit("checksum_in_two_splits").alias("rule"))
    s = recordings.select("recording_id", "duration_seconds", F.posexplode("segments").alias("pos", "seg")).select("recording_id", "duration_seconds", "pos", F.col("seg.start").alias("a"), F.col("seg.end").alias("b"))
    before = F.lag("a").over(Window.partitionBy("recording_id").orderBy("pos"))
    rules = F.array_compact(F.array(F.when(F.col("a") < F.col("before"), "start_goes_back"), F.when(F.col("b") < F.col("a"), "ends_before_start"), F.when(F.col("b") > F.col("duration_seconds") + 0.5, "beyond_recording")))
    times = s.withColumn("before", before).select("recording_id", F.explode(rules).alias("rule"))
    return ids.unionByName(splits).unionByName(times).distinct()
