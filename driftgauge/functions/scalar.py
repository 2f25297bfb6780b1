"""Row-level functions as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability clamps used by the entropy, logit and correction formulas.
ENTROPY_CLAMP = 1e-6
CORRECTION_CLAMP = 1e-5


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.least(F.greatest(x, low), high)


def entropy(p: Column) -> Column:
    """Binary entropy with the probability clamped away from 0 and 1."""
    q = clip(p, ENTROPY_CLAMP, 1 - ENTROPY_CLAMP)
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def behaviour_entropy(p: Column) -> Column:
    """Entropy with 1e-9 inside the logarithms and no clamp."""
    return -(p * F.log(p + 1e-9) + (1 - p) * F.log(1 - p + 1e-9))


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def logit(p: Column, clamp: float = ENTROPY_CLAMP) -> Column:
    q = clip(p, clamp, 1 - clamp)
    return F.log(q / (1 - q))


def sigmoid(x: Column, limit: float | None = None) -> Column:
    x = clip(x, -limit, limit) if limit is not None else x
    return 1 / (1 + F.exp(-x))


def linear_score(weights: Sequence[float], features: Sequence[Column], bias: float) -> Column:
    z = F.lit(float(bias))
    for w, x in zip(weights, features):
        z = z + F.lit(float(w)) * x
    return sigmoid(z)


def calibrated(p: Column, temperature: Column, bias: Column) -> Column:
    return sigmoid((logit(p) + bias) / temperature)


def recentred(x: Column, run_mean: Column, run_std: Column, src_mean: Column, src_std: Column,
              strength: Column) -> Column:
    """Blend a value with its re-centred form; `strength` is clipped to [0, 1]."""
    a = clip(strength, 0, 1)
    moved = (x - run_mean) / F.greatest(run_std, F.lit(1e-3)) * src_std + src_mean
    return F.when(a > 0, (1 - a) * x + a * moved).otherwise(x)


def corrected(p: Column, delta: Column, row_delta: Column) -> Column:
    """Shift a probability in logit space by a batch delta and a row delta."""
    moved = sigmoid(logit(p, CORRECTION_CLAMP) + delta + row_delta)
    return clip(moved, CORRECTION_CLAMP, 1 - CORRECTION_CLAMP)


def predicted(p: Column, threshold: Column | float = 0.5) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (p >= clip(t, 0.05, 0.95)).cast("int")


def nonconformity(p: Column, y: Column) -> Column:
    q = clip(p, ENTROPY_CLAMP, 1 - ENTROPY_CLAMP)
    hit = 1 - F.greatest(q, 1 - q)
    wrong = (q >= 0.5).cast("int") != y
    return F.when(y.isNotNull() & wrong, F.lit(1.0)).otherwise(hit)


def interval_half_width(alpha: Column, conf: Column) -> Column:
    return alpha + (1 - conf) * 0.5


def drift_l1(temperature: Column, bias: Column, strength: Column) -> Column:
    return F.abs(temperature - 1) + F.abs(bias) + strength


def drift_l2(temperature: Column, bias: Column, other_squares: Column) -> Column:
    return F.sqrt(other_squares + bias * bias + (temperature - 1) * (temperature - 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with 1e-6 added to each norm."""
    return dot(a, b) / ((norm(a) + 1e-6) * (norm(b) + 1e-6))


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def blended(feature_part: Column, behaviour_part: Column | None) -> Column:
    """40 % feature measure and 60 % behaviour measure, or the feature measure alone."""
    if behaviour_part is None:
        return feature_part
    return F.when(behaviour_part.isNull(), feature_part).otherwise(0.40 * feature_part + 0.60 * behaviour_part)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n <= 1e-8, a).otherwise(F.transform(a, lambda x: x / n))


def squashed(a: Column) -> Column:
    """tanh of a vector scaled by 2.5 times its root mean square."""
    scale = F.sqrt(dot(a, a) / F.size(a)) + 1e-6
    return F.transform(a, lambda x: F.tanh(x / (2.5 * scale)))


def regime_embedding(*parts: Column) -> Column:
    return unit(F.concat(*[squashed(p) for p in parts]))


def mixed_embedding(embedding: Column, behaviour: Column) -> Column:
    """40 % unit embedding and 60 % behaviour vector brought to the same scale, unit length."""
    target = 1 / F.sqrt(F.size(embedding).cast("double"))
    scale = F.sqrt(dot(behaviour, behaviour) / F.size(behaviour)) + 1e-6
    left = F.transform(embedding, lambda x: 0.40 * x)
    right = F.transform(behaviour, lambda x: 0.60 * x * (target / scale))
    return unit(F.concat(left, right))


def pooled(a: Column, width: int, chunks: int = 6) -> Column:
    """Means of `chunks` slices of a vector of known width; the first slices are one longer."""
    base, extra = divmod(width, chunks)
    out, start = [], 1
    for i in range(chunks):
        size = base + (1 if i < extra else 0)
        out.append(mean_of(F.slice(a, start, size)) if size else F.lit(None).cast("double"))
        start += size
    return F.array(*out)


def segment_of(p: Column, z: Column) -> Column:
    """Probability band (0.10, 0.35) plus 3 when the mean of the first six standardized features is >= 0."""
    band = F.when(p < 0.10, 0).when(p < 0.35, 1).otherwise(2)
    return (band + F.when(mean_of(F.slice(z, 1, 6)) >= 0, 3).otherwise(0)).cast("int")


def segment_of_twelve(p: Column, progress: Column, novelty: Column, novelty_median: Column) -> Column:
    band = F.when(p < 0.08, 0).when(p < 0.25, 1).when(p < 0.55, 2).otherwise(3)
    raw = band + F.when(novelty >= novelty_median, 4).otherwise(0) + F.when(progress >= 0.55, 8).otherwise(0)
    return F.least(raw, F.lit(11)).cast("int")


def standardized(x: Sequence[Column], mean: Column, var: Column) -> Column:
    return F.array(*[
        (c - F.element_at(mean, i + 1)) / F.sqrt(F.element_at(var, i + 1) + 1e-6) for i, c in enumerate(x)
    ])


def rank_vector(z: Column, p: Column, segment: Column, segments: int = 6) -> Column:
    """Standardized features, logit, confidence and the one-hot segment."""
    q = clip(p, CORRECTION_CLAMP, 1 - CORRECTION_CLAMP)
    hot = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)),
                      lambda i: F.when(i == segment, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.concat(z, F.array(F.log(q / (1 - q)), F.greatest(q, 1 - q)), hot)


def rank_delta(vector: Column, weights: Column, bias: Column, reference_rate: Column,
               recurrence: Column, similarity: Column) -> Column:
    """Row delta: linear score, regime gate when a regime is known, clip to 0.50, off for common positives."""
    raw = dot(vector, weights) + bias
    gate = clip(0.55 + 0.25 * recurrence + 0.20 * similarity, 0.40, 1.10)
    gated = raw * F.coalesce(gate, F.lit(1.0))
    return F.when(reference_rate >= 0.20, F.lit(0.0)).otherwise(clip(gated, -0.50, 0.50))


def schema_fingerprint(width: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("dim="), width.cast("string")), 256), 1, 8)


def reasons(*parts: Column) -> Column:
    """Reason codes joined by ';', nulls left out."""
    return F.concat_ws(";", *parts)
