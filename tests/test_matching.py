"""Voices are compared by blocks: what a block leaves out cannot be among the nearest."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.operators import voices
from confab.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def voiced(spark):
    """Clusters and prints of 7 people: copies, their own vectors, zeros, nulls, other sizes and no numbers."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).tolist()
    x[40:120] = [x[7]] * 80
    x[3], x[30], x[31], x[60], x[61] = [0.0] * 5, None, [1.0, None, 2.0, 3.0, 4.0], [1.0, 2.0], [float("nan")] * 5
    prints = spark.createDataFrame([(int(rng.integers(7)) if k % 50 else None, k, v) for k, v in enumerate(x)], "person_id long, voiceprint_id long, vector array<double>")
    return prints.where("voiceprint_id % 3 = 0").select(F.col("voiceprint_id").alias("cluster_id"), F.col("vector").alias("centroid")), prints


@pytest.mark.parametrize("by, k, block, asked", [("person_id", 1, 8192, 16384), ("person_id", 3, 40, 30), (None, 3, 17, 16384), (None, 1, 500, 9), ("voiceprint_id", 1, 60, 60)])
def test_nearest_of_all_pairs(spark, voiced, by, k, block, asked):
    clusters, prints = voiced
    w = Window.partitionBy("cluster_id", *[by] if by else []).orderBy(F.desc(F.round("score", 12)), "voiceprint_id")
    first = lambda pairs: sorted(map(repr, pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("cluster_id", "person_id", "voiceprint_id", "score", "rank").collect()))
    for itself in (False, True):
        every = voices.scored(clusters, prints).where("cluster_id <> voiceprint_id" if itself else "true")
        found = voices.nearest(clusters, prints, k, by, but_itself=itself, block=block, least=1, asked=asked)
        assert first(found) == first(every)
    assert voices.nearest(clusters, prints.limit(0), k, by).count() == 0 == voices.nearest(clusters.limit(0), prints, k, by).count()


def test_copies_are_not_carried_along(spark):
    prints = spark.range(3000).selectExpr("id % 2 as person_id", "id as voiceprint_id", "array(1d, 2d) as vector")
    found = voices.nearest(prints.where("voiceprint_id < 200").selectExpr("voiceprint_id as cluster_id", "vector as centroid"), prints, 3)
    assert found.count() == 200 * 2 * 3 * 6  # 6 blocks


@pytest.mark.parametrize("name", ["cosine_topk", "fused_candidates", "match_margin_band", "merge_pairs", "merge_suggestions", "picked_suggestions"])
def test_pairs_are_no_rows(spark, sf_dir, name):
    """No row is made of each pair, whose cosine is then summed element by element."""
    assert "zip_with" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
