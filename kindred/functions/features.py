"""Row-wise pair features and statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.text import tokens

Z95 = 1.959963984540054  # the 0.975 quantile of the normal distribution


def word_jaccard(clean1: Column, clean2: Column) -> Column:
    """Set similarity of the tokens of two clean texts; 1.0 if both are empty."""
    a, b = tokens(clean1), tokens(clean2)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def length_features(n1: Column, n2: Column) -> dict[str, Column]:
    """len_ratio (smaller over larger, the larger floored at 1), abs_len_diff, len_sum of two token counts."""
    ratio = F.least(n1, n2) / F.greatest(n1, n2, F.lit(1))
    return {"len_ratio": ratio, "abs_len_diff": F.abs(n1 - n2).cast("double"), "len_sum": (n1 + n2).cast("double")}


def lexical_features(clean1: Column, clean2: Column) -> dict[str, Column]:
    n1, n2 = F.size(tokens(clean1)), F.size(tokens(clean2))
    return {"jaccard": word_jaccard(clean1, clean2)} | length_features(n1, n2)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalised(a: Column) -> Column:
    """The vector divided by max(norm, 1e-12)."""
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / length)


def dense_features(a: Column, b: Column) -> dict[str, Column]:
    """cos (0 if a norm is 0), l2 and mean absolute difference of two vectors."""
    lengths = norm(a) * norm(b)
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return {
        "cos": F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths),
        "l2": F.sqrt(_sum(F.transform(diff, lambda x: x * x))),
        "mad": F.when(F.size(a) == 0, F.lit(0.0)).otherwise(_sum(F.transform(diff, F.abs)) / F.size(a)),
    }


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """95 % interval of a rate; null without trials, exact 0 and 1 at the extremes."""
    n = trials.cast("double")
    p = successes / n
    z2 = Z95 * Z95
    center = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low = F.when(successes == 0, 0.0).otherwise(F.greatest(center - half, F.lit(0.0)))
    high = F.when(successes == trials, 1.0).otherwise(F.least(center + half, F.lit(1.0)))
    return F.when(trials >= 1, low), F.when(trials >= 1, high)


def named_values(names: list[str]) -> Column:
    """Feature columns of a row as a map from name to value."""
    return F.create_map(*[part for n in names for part in (F.lit(n), F.col(n).cast("double"))])
