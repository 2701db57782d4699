"""Voices: clusters of embeddings, voiceprints, and who a cluster may be.

Voiceprints are few next to segments (people are enrolled by hand), yet their size is not
taken on trust. ``nearest`` compares by blocks of both sides and gives what can be among the
best. ``scored``, for few prints, gives every pair: they are broadcast only up to ``max_bytes``
of vectors; beyond that, it meets them in a join of blocks of that size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions import vectors as V

MIN_SCORE, MIN_MARGIN = 0.50, 0.08


# --- voiceprints ----------------------------------------------------------------------


def consent_in_effect() -> Column:
    return F.col("consent_given") & F.col("consent_withdrawn_at").isNull()


def eligible_voiceprints(people: DataFrame, voiceprints: DataFrame, space: str) -> DataFrame:
    """Active prints in the space of active people who agree."""
    who = people.where(F.col("is_active") & consent_in_effect()).select("person_id", "full_name")
    return voiceprints.where(F.col("is_active") & (F.col("space_id") == space)).join(who, "person_id")


def skipped_people(people: DataFrame, voiceprints: DataFrame, space: str) -> DataFrame:
    """(person_id, reason) of active people with prints, none of which may be compared."""
    sums = voiceprints.groupBy("person_id").agg(F.count("*").alias("prints"), F.count_if(F.col("is_active") & (F.col("space_id") == space)).alias("usable"))
    both = people.where("is_active").join(sums, "person_id")
    reason = F.when(~consent_in_effect(), "no_consent").when(F.col("usable") == 0, "needs_reenrollment")
    return both.select("person_id", reason.alias("reason")).where("reason is not null")


def enrollment_state(people: DataFrame, voiceprints: DataFrame, space: str) -> DataFrame:
    sums = voiceprints.groupBy("person_id").agg(F.max(F.col("is_active") & (F.col("space_id") == space)).alias("here"), F.max("is_active").alias("any_active"))
    state = F.when(F.col("here"), "enrolled").when(F.col("any_active"), "needs_reenrollment").otherwise("not_enrolled")
    return people.join(sums, "person_id", "left").select("person_id", state.alias("state"))


def latest_voiceprint(voiceprints: DataFrame) -> DataFrame:
    return voiceprints.groupBy("person_id").agg(F.max_by("voiceprint_id", F.struct("enrolled_at", "voiceprint_id")).alias("voiceprint_id"), F.max("enrolled_at").alias("enrolled_at"))


def centroids(vectors: DataFrame, by: list[str], weight: Column | None = None, vector: str = "vector", unit_length: bool = True) -> DataFrame:
    """Weighted mean vector of each group, of length 1. Sums are kept a dimension, so they
    are pre-aggregated before the shuffle and no group is gathered."""
    weighed = vectors.withColumn("__w", F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0))
    cells = weighed.select(*by, "__w", F.posexplode(V.as_double(vector)).alias("__at", "__x"))
    sums = cells.groupBy(*by, "__at").agg((F.sum(F.col("__x") * F.col("__w")) / F.greatest(F.sum("__w"), F.lit(1e-9))).alias("__x"))
    mean = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__x"))), lambda c: c["__x"]).alias("mean"))
    return mean.select(*by, (V.unit("mean") if unit_length else F.col("mean")).alias("centroid"))


def cohesion(vectors: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """Mean cosine of all pairs of a group; null for fewer than two vectors.

    No pairs are made: for unit vectors the pairs' sum is (|sum|^2 - n) / 2."""
    cells = vectors.select(*by, F.posexplode(V.unit(vector)).alias("__at", "__x"))
    sums = cells.groupBy(*by, "__at").agg(F.sum("__x").alias("__s"))
    squared = sums.groupBy(*by).agg(F.sum(F.col("__s") * F.col("__s")).alias("__q"))
    n = vectors.groupBy(*by).agg(F.count("*").alias("samples"))
    mean = F.when(F.col("samples") > 1, (F.col("__q") - F.col("samples")) / (F.col("samples") * (F.col("samples") - 1)))
    return n.join(squared, by).select(*by, "samples", mean.alias("cohesion"))


def built_voiceprints(samples: DataFrame, min_samples: int = 2, min_speech: float = 20.0, min_cohesion: float = 0.55) -> DataFrame:
    """A person's print from samples (person_id, vector, speech_s); active if there is enough of one voice."""
    sums = samples.groupBy("person_id").agg(F.sum("speech_s").alias("speech_s"))
    out = centroids(samples, ["person_id"]).join(cohesion(samples, ["person_id"]), "person_id").join(sums, "person_id")
    active = (F.col("samples") >= min_samples) & (F.col("speech_s") >= min_speech) & (F.coalesce("cohesion", F.lit(0.0)) >= min_cohesion)
    return out.select("person_id", F.col("centroid").alias("vector"), "samples", "speech_s", "cohesion", active.alias("is_active"))


def sample_verdict() -> Column:
    """struct(verdict, reasons) of an enrollment sample from speech_s, dbfs, clipped (share) and second_share."""
    short, quiet, loud = F.col("speech_s") < 4.0, F.col("dbfs") < -45.0, F.col("dbfs") > -6.0
    clipped = F.col("clipped") > 0.02
    level = short | quiet | loud | clipped
    two = ~level & (F.coalesce("second_share", F.lit(0.0)) >= 0.30)
    bad = level | two
    brief, faint = ~bad & (F.col("speech_s") < 10.0), ~bad & (F.col("dbfs") < -35.0)
    verdict = F.when(bad, "reject").when(brief | faint, "usable").otherwise("good")
    names = ((short, "too_short"), (quiet, "too_quiet"), (loud, "too_loud"), (clipped, "clipped"), (two, "two_voices"), (brief, "short"), (faint, "quiet"))
    return F.struct(verdict.alias("verdict"), F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in names])), ",").alias("reasons"))


# --- matching -------------------------------------------------------------------------


def scored(clusters: DataFrame, prints: DataFrame, max_bytes: int = 64_000_000) -> DataFrame:
    """Every cluster (cluster_id, centroid) against every print (person_id, voiceprint_id, vector).

    A stated query set against all prints, so it is all pairs by meaning. Prints over the
    broadcast bound are dealt to blocks that each cluster visits."""
    size = prints.agg(F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= max_bytes:
        pairs = clusters.crossJoin(F.broadcast(prints))
    else:
        blocks = -(-size // max_bytes)
        left = clusters.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = left.join(prints.withColumn("__block", F.pmod(F.xxhash64("voiceprint_id"), F.lit(blocks).cast("long"))), "__block").drop("__block")
    return pairs.withColumn("score", V.cosine("centroid", "vector"))


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as columns of a matrix, short ones filled up with zeros, and their lengths."""
    n = pc.list_value_length(vectors).to_numpy()
    out = np.zeros((len(n), n.max(initial=0)))
    out[np.arange(out.shape[1]) < n[:, None]] = pc.list_flatten(vectors).to_numpy()
    return np.ascontiguousarray(out.T), n


def _cosines(dots: np.ndarray, la: np.ndarray, lb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """``V.cosine`` from dot products, lengths and sizes; size 0 is a vector that is null or holds nulls.
    For null, which vectors of unlike size have, stands -2, below all others."""
    with np.errstate(all="ignore"):
        n = la * lb
        return np.where((n <= 0) | (na == 0) | (nb == 0), 0.0, np.where(na == nb, dots / n, -2.0))


def nearest(clusters: DataFrame, prints: DataFrame, k: int = 1, by: str | None = "person_id", id: str = "voiceprint_id", but_itself: bool = False, block: int = 8192, least: int = 512, asked: int = 16384) -> DataFrame:
    """Every cluster (cluster_id, centroid) against every print (vector, ``id`` and others): the rows, with
    their score, that can be among the ``k`` of a value of ``by`` with the highest scores, ties to the least
    ``id``, also after rounding of scores to 9 digits or more. ``but_itself`` leaves out a print whose id is the cluster's.

    All pairs by meaning, so both sides are dealt to blocks, and each pair of blocks is a group that one matrix product
    looks through; what it leaves is scored again, summed in the order of ``V.cosine``, so that equal vectors have equal
    scores. Each block gives ``k`` rows or few more, whatever the copies in it."""
    usable = lambda v: F.when(F.col(v).isNull() | F.exists(V.as_double(v), lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(V.as_double(v))
    rows = prints.count()
    # blocks are smaller where rows are few, so that all cores have some
    p = -(-rows // min(block, max(least, -(-rows // 64)))) or 1
    q = -(-clusters.count() // asked) or 1
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = clusters.select("cluster_id", usable("centroid").alias("__v"), deal("cluster_id", q).alias("__q"), every(p).alias("__p"))
    right = prints.withColumns({"__v": usable("vector"), "__p": deal(id, p), "__q": every(q)}).drop("vector")
    carried = [c for c in prints.columns if c != "vector"]
    schema = clusters.select("cluster_id", F.lit(None).cast("double").alias("score")).schema
    schema = type(schema)([schema["cluster_id"], *(prints.schema[c] for c in carried), schema["score"]])

    def look(low: pa.Table, high: pa.Table) -> pa.Table:
        at = pa.chunked_array([np.zeros(len(high), np.int64)]) if by is None else pc.fill_null(pc.rank(high[by], sort_keys="ascending", tiebreaker="dense").cast("int64"), 0)
        high = high.append_column("__at", at).sort_by([("__at", "ascending"), (id, "ascending")])
        group = high["__at"].to_numpy()
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        (a, na), (b, nb) = _matrix(low["__v"]), _matrix(high["__v"])
        dims = min(len(a), len(b))
        la, lb = (np.sqrt(sum((x * x for x in m), np.zeros(m.shape[1]))) for m in (a, b))
        mine, others = low["cluster_id"].to_numpy(), high[id].to_numpy()
        found = []
        strip = max(1, 2_000_000 // max(1, len(high)))
        for s in range(0, len(low) if len(high) else 0, strip):
            e = slice(s, s + strip)
            c = _cosines(a[:dims, e].T @ b[:dims], la[e, None], lb, na[e, None], nb)
            # as in Spark, nothing is above not a number
            c[np.isnan(c)] = np.inf
            if but_itself:
                own = mine[e, None] == others
                c[own] = -np.inf
            if k == 1:
                kth = np.maximum.reduceat(c, first, axis=1)
            else:
                ends = np.r_[first[1:], len(group)]
                kth = np.stack([np.partition(c[:, f:t], -k, axis=1)[:, -k] if t - f > k else np.full(len(c), -np.inf) for f, t in zip(first, ends)], axis=1)
            may = c >= np.repeat(kth - 1e-8, np.diff(np.r_[first, len(group)]), axis=1)
            i, j = np.nonzero(may & ~own if but_itself else may)
            i += s
            dots = np.zeros(len(i))
            for x, y in zip(a[:dims], b[:dims]):
                dots += x[i] * y[j]
            score = _cosines(dots, la[i], lb[j], na[i], nb[j])
            # of copies, with one score, the k of least id; j is in order of id
            order = np.lexsort((j, score, group[j], i))
            i, j, score = i[order], j[order], score[order]
            new = np.r_[True, (np.diff(i) != 0) | (np.diff(group[j]) != 0) | (score[1:] != score[:-1])][: len(i)]
            place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
            keep = place < k
            found.append((i[keep], j[keep], score[keep]))
        i, j, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        high = high.select(carried).take(j)
        return pa.table([low["cluster_id"].take(pa.array(i)), *high.columns, pa.array(score, mask=score == -2)], names=["cluster_id", *carried, "score"])

    return left.groupBy("__q", "__p").cogroup(right.groupBy("__q", "__p")).applyInArrow(look, schema)


def fused(pairs: DataFrame, exemplars: DataFrame, clusters: DataFrame, **settings) -> DataFrame:
    """``pairs`` with their prints' samples (voiceprint_id, exemplar_id, vector) in the score: half the
    best sample's, 0.3 of the print's, 0.2 of the mean of the best three, never below the print's own."""
    each = nearest(clusters, exemplars.select("voiceprint_id", "exemplar_id", "vector"), 3, "voiceprint_id", "exemplar_id", **settings).select("cluster_id", "voiceprint_id", "score")
    w = Window.partitionBy("cluster_id", "voiceprint_id").orderBy(F.desc("score"))
    best = each.withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("cluster_id", "voiceprint_id").agg(F.collect_list("score").alias("__samples"))
    both = pairs.join(best, ["cluster_id", "voiceprint_id"], "left")
    return both.withColumn("score", V.fused_score(F.col("score"), F.coalesce("__samples", F.array().cast("array<double>")))).drop("__samples")


def candidates(pairs: DataFrame, digits: int = 4) -> DataFrame:
    """Per cluster its people by their best print: rank, score, margin and band. The first one's
    margin is to the second (or to 0), the others' to the first. Ties go by name, if there is a
    full_name, then by id."""
    name = F.col("full_name") if "full_name" in pairs.columns else F.lit("")
    best = pairs.groupBy("cluster_id", "person_id").agg(F.max("score").alias("score"), F.max_by("voiceprint_id", F.struct("score", -F.col("voiceprint_id"))).alias("voiceprint_id"), F.min(name).alias("__name"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "__name", "person_id")
    top = F.first("score").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rank = F.row_number().over(w)
    margin = F.when(rank == 1, F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).otherwise(F.col("score") - top)
    return best.select("cluster_id", "person_id", "voiceprint_id", rank.alias("rank"), F.round("score", digits).alias("score"), F.round(margin, digits).alias("margin"), V.band("score").alias("band"))


def without_rejected(found: DataFrame, rejected: DataFrame) -> DataFrame:
    return found.join(rejected, ["cluster_id", "person_id"], "left_anti")


def suggestions(found: DataFrame, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The one person a reviewer may be asked about, of clusters that have one."""
    return found.where((F.col("rank") == 1) & (F.col("score") >= min_score) & (F.col("margin") >= min_margin) & (F.col("band") != "no_match"))


def merge_suggestions(suggested: DataFrame) -> DataFrame:
    """(person_id, clusters) of people suggested for several clusters: the list, not its pairs."""
    return suggested.groupBy("person_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters")).where(F.size("clusters") > 1)


def merge_pairs(suggested: DataFrame) -> DataFrame:
    """The pairs of ``merge_suggestions`` (meeting_id, cluster_id, person_id): clusters of one meeting, so a handful a person."""
    a = suggested.select("meeting_id", "person_id", F.col("cluster_id").alias("a"))
    return a.join(suggested.select("meeting_id", "person_id", F.col("cluster_id").alias("b")), ["meeting_id", "person_id"]).where("a < b")


def cluster_mode(segments: DataFrame) -> DataFrame:
    """Per meeting and label the cluster that most of its segments have, the first by name on ties."""
    n = segments.where("cluster_id is not null").groupBy("meeting_id", "speaker", "cluster_id").agg(F.count("*").alias("n"))
    return n.groupBy("meeting_id", "speaker").agg(F.min_by("cluster_id", F.struct(-F.col("n"), "cluster_id")).alias("cluster_id"))


def vote_ratio(segments: DataFrame) -> DataFrame:
    """Per cluster and person: votes of segments (cluster_id, person_id or null) and their share."""
    votes = segments.groupBy("cluster_id", "person_id").agg(F.count("*").alias("votes"))
    all_votes = F.sum("votes").over(Window.partitionBy("cluster_id"))
    return votes.select("cluster_id", "person_id", "votes", all_votes.alias("total"), F.round(F.col("votes") / all_votes, 3).alias("ratio")).where("person_id is not null")


def nearest_centroid(vectors: DataFrame, centers: DataFrame, **settings) -> DataFrame:
    """vec_id and the label of the nearest centre (label, centroid), the least label on ties."""
    pairs = scored(vectors.select("vec_id", F.col("vector").alias("centroid")), centers.select("label", F.col("label").alias("voiceprint_id"), F.col("centroid").alias("vector")), **settings)
    return pairs.groupBy("vec_id").agg(F.max_by("label", F.struct(F.round("score", 12), -F.col("label"))).alias("label"))


def two_voice_share(windows: DataFrame, least: float = 0.30) -> DataFrame:
    """Per sample the second cluster's share of the speech (sample_id, label, seconds), and whether it says two voices."""
    sums = windows.groupBy("sample_id", "label").agg(F.sum("seconds").alias("s"))
    w = Window.partitionBy("sample_id").orderBy(F.desc("s"), "label")
    ranked = sums.select("sample_id", F.row_number().over(w).alias("r"), (F.col("s") / F.sum("s").over(Window.partitionBy("sample_id"))).alias("share"))
    return ranked.groupBy("sample_id").agg(F.coalesce(F.max(F.when(F.col("r") == 2, F.col("share"))), F.lit(0.0)).alias("second_share")).withColumn("two_voices", F.col("second_share") >= least)


def lowest_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """The turns of each cluster (cluster_id, segment_id, start_s, score) that fit it worst."""
    w = Window.partitionBy("cluster_id").orderBy("score", "start_s", "segment_id")
    return turns.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_view(segments: DataFrame, printable: float = 2.0) -> DataFrame:
    """Per cluster: speech, turns, printable turns and its state, the most decided of its segments'."""
    order = F.create_map(*[F.lit(x) for kv in (("corrected", 3), ("confirmed", 2), ("suggested", 1), ("anonymous", 0)) for x in kv])
    out = segments.groupBy("meeting_id", "cluster_id").agg(F.sum("speech_seconds").alias("seconds"), F.count("*").alias("turns"), F.count_if(F.col("speech_seconds") >= printable).alias("printable"), F.max_by("attribution_state", F.coalesce(order[F.col("attribution_state")], F.lit(-1))).alias("state"))
    return out.withColumns({"seconds": F.round("seconds", 2), "unprintable": F.col("turns") - F.col("printable")})


def blocking_reasons(clusters: DataFrame, diagnostics: DataFrame, segments: DataFrame) -> DataFrame:
    """Why a cluster cannot be confirmed in bulk, as an array; empty if it can."""
    crossing = segments.where(F.contains(F.coalesce("flag_reason", F.lit("")), F.lit("speaker_change"))).groupBy("cluster_id").agg(F.count("*").alias("__n"))
    both = clusters.join(diagnostics.withColumn("__known", F.lit(True)), "cluster_id", "left").join(crossing, "cluster_id", "left")
    reasons = F.array(F.when(F.col("__known").isNull(), "no_diagnostics"), F.when(F.col("mixed"), "mixed"), F.when(F.col("short"), "short"), F.when(F.col("__n") > 0, F.concat(F.lit("straddling:"), F.col("__n").cast("string"))))
    return both.select("cluster_id", F.array_compact(reasons).alias("reasons"))


def rematched(segments: DataFrame, people: DataFrame, prints: DataFrame, rejected: DataFrame, space: str) -> DataFrame:
    """New suggestions from kept vectors (cluster_id, vector, speech_seconds, attribution_state):
    decided clusters and rejected people are left out."""
    decided = segments.where(F.col("attribution_state").isin("confirmed", "corrected")).select("cluster_id").distinct()
    free = segments.join(decided, "cluster_id", "left_anti")
    center = centroids(free, ["cluster_id"], F.greatest(F.col("speech_seconds"), F.lit(1e-3)))
    usable = eligible_voiceprints(people, prints, space).select("person_id", "full_name", "voiceprint_id", "vector")
    pairs = without_rejected(scored(center, usable), rejected)
    return suggestions(candidates(pairs))


# --- clustering of one meeting --------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n < 1e-12, 1.0, n)


def average_linkage(vectors: np.ndarray, stop: float = 0.45, max_clusters: int | None = None) -> np.ndarray:
    """Labels by average-linkage clustering on cosine distance, numbered by first member.

    A cluster's mean distance to another is 1 - (sum of one . sum of the other) / (sizes), so
    clusters are held as sums of unit vectors and their distances as one matrix of products;
    a merge adds two of its rows. The closest pair merges first, of equals that with the lowest
    first members, until all are further apart than ``stop``. With ``max_clusters``, merging
    goes on beyond ``stop`` while there are more."""
    return linked(_unit(np.asarray(vectors, np.float64)), np.ones(len(vectors)), stop, max_clusters)


def linked(totals: np.ndarray, sizes: np.ndarray, stop: float, max_clusters: int | None = None) -> np.ndarray:
    """As ``average_linkage``, from clusters given by their sums of unit vectors and their sizes."""
    n = len(totals)
    if n == 0:
        return np.zeros(0, np.int64)
    products, size = totals @ totals.T, sizes.astype(np.float64)
    alive, label = np.ones(n, bool), np.arange(n)

    def nearest(a):
        """The nearest later cluster of ``a``, the first on ties."""
        gap = np.where(alive[a + 1 :], np.round(1.0 - products[a, a + 1 :] / (size[a] * size[a + 1 :]), 12), np.inf)
        k = int(np.argmin(gap)) if len(gap) else 0
        return (gap[k], a + 1 + k) if len(gap) else (np.inf, a)

    # each cluster's nearest later one; a merge changes few of them, so a step costs n, not n^2
    found = [nearest(a) for a in range(n)]
    least, where = np.array([x for x, _ in found]), np.array([k for _, k in found])
    left = n
    while left > 1:
        a = int(np.argmin(least))
        b = int(where[a])
        if least[a] == np.inf or least[a] > stop and (max_clusters is None or left <= max_clusters):
            break
        products[a] += products[b]
        products[:, a] += products[:, b]
        size[a] += size[b]
        alive[b], label[label == b] = False, a
        least[b] = np.inf
        left -= 1
        new = np.round(1.0 - products[:, a] / (size * size[a]), 12)
        for i in range(n) if n < 64 else np.flatnonzero(alive[:b] & ((where[:b] == a) | (where[:b] == b) | (np.arange(b) == a) | (new[:b] <= least[:b]))):
            if alive[i]:
                least[i], where[i] = nearest(i)
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first, kind="stable"), kind="stable")[inverse]


def two_means(vectors: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Two halves around the two members furthest apart, and the cosine of the halves' centres."""
    x = _unit(np.asarray(vectors, np.float64))
    if len(x) < 2:
        return np.zeros(len(x), np.int64), 1.0
    best, pair = np.inf, (0, 1)
    for at in range(0, len(x), 256):  # the furthest pair, some rows at a time
        near = np.round(x[at : at + 256] @ x.T, 12)
        near[np.arange(len(x))[None, :] <= np.arange(at, at + len(near))[:, None]] = np.inf
        k = int(np.argmin(near))
        if near.flat[k] < best:
            best, pair = near.flat[k], (at + k // len(x), k % len(x))
    centers = x[list(pair)]
    half = np.full(len(x), -1)
    for _ in range(rounds):
        new = (x @ centers[1] > x @ centers[0]).astype(np.int64)
        if (new == half).all():
            break
        half = new
        centers = np.array([_unit(x[half == k].mean(axis=0, keepdims=True))[0] if (half == k).any() else centers[k] for k in (0, 1)])
    if len(set(half.tolist())) < 2:
        return half, 1.0
    return half, float(centers[0] @ centers[1])


def assigned_speakers(segments: DataFrame, windows: DataFrame, straddle: float = 0.30) -> DataFrame:
    """Segments with the cluster that speaks most in them (the nearest one in silence), numbered by
    first appearance, their speech, and whether two clusters each hold ``straddle`` of it."""
    from confab.operators import intervals, segments as S

    label = intervals.overlap_labels(segments, windows)
    silent = segments.join(label.select("meeting_id", "segment_id"), ["meeting_id", "segment_id"], "left_anti")
    points = silent.select("meeting_id", F.col("segment_id").alias("point_id"), ((F.col("start_s") + F.col("end_s")) / 2).alias("at_s"))
    near = intervals.nearest_interval(points, windows.select("meeting_id", F.col("window").alias("interval_id"), "start_s", "end_s"))
    borrowed = near.join(windows.select("meeting_id", F.col("window").alias("interval_id"), "label"), ["meeting_id", "interval_id"]).select("meeting_id", F.col("point_id").alias("segment_id"), "label", F.lit(0.0).alias("speech_s"), F.lit(0.0).alias("share"), F.lit(0.0).alias("second_share"))
    every = segments.join(label.unionByName(borrowed), ["meeting_id", "segment_id"])
    names = S.numbered_clusters(every, "label").select("meeting_id", "label", F.col("speaker").alias("new_speaker"), F.col("cluster_id").alias("new_cluster"))
    flagged = (F.col("second_share") >= straddle) & (F.col("share") >= straddle)
    return every.join(names, ["meeting_id", "label"]).select("meeting_id", "segment_id", F.col("new_speaker").alias("speaker"), F.col("new_cluster").alias("cluster_id"), F.round("speech_s", 3).alias("speech_seconds"), flagged.alias("straddles"))
