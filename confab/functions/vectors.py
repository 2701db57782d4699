"""Vector functions over array<double> or array<float> columns, in the JVM.

Vectors are cast to double before any sum. A zero vector has cosine 0 with everything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """``a`` over its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 1e-12, F.transform(as_double(a), lambda x: x / n)).otherwise(as_double(a))


def cosine(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def band(score) -> Column:
    """strong from 0.80, moderate from 0.65, weak from 0.50, else no_match."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 0.80, "strong").when(s >= 0.65, "moderate").when(s >= 0.50, "weak").otherwise("no_match")


def fused_score(raw: Column, similarities: Column) -> Column:
    """A voiceprint's cosine and those of its samples: half the best, 0.3 of the print's, 0.2
    of the mean of the best three, never below the print's own. No samples: the print's."""
    best = F.slice(F.sort_array(similarities, asc=False), 1, 3)
    mixed = 0.5 * F.array_max(similarities) + 0.3 * raw + 0.2 * total(best) / F.size(best)
    return F.when(F.size(similarities) > 0, F.greatest(raw, mixed)).otherwise(raw)


def rms_dbfs(samples) -> Column:
    """Level of a signal in [-1, 1], not below -120 dBFS; an empty one has the least."""
    s = as_double(samples)
    mean = F.when(F.size(s) > 0, total(F.transform(s, lambda x: x * x)) / F.size(s)).otherwise(F.lit(0.0))
    return 20.0 * F.log10(F.greatest(F.sqrt(mean), F.lit(1e-6)))
