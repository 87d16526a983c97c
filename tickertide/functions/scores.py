"""Score columns: parsing, softmax, spreads, signs and hit flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickertide.functions.text import is_blank


def clamp(col: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Clamp and keep null (``greatest``/``least`` alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def parse_score(response: Column) -> Column:
    """Last number in a model response, clamped to [-1, 1]; null where there is none."""
    numbers = F.regexp_extract_all(response, F.lit(r"(-?\d+\.?\d*)"), F.lit(1))
    return clamp(F.try_element_at(numbers, F.lit(-1)).try_cast("double"))


def prob_score(logits: Column, labels: list[str], text: Column | None = None) -> Column:
    """P(positive) - P(negative) from the softmax of class logits; a blank text scores 0.

    ``labels`` names every class in the order of the logits.
    """
    names = [label.lower() for label in labels]
    cells = [F.get(logits, F.lit(i)) for i in range(len(names))]
    top = F.array_max(logits)
    weights = [F.exp(cell - top) for cell in cells]
    total = reduce(lambda a, b: a + b, weights)

    def prob(label: str) -> Column:
        at = [i for i, name in enumerate(names) if name == label]
        return weights[at[-1]] / total if at else F.lit(0.0)

    score = clamp(prob("positive") - prob("negative"))
    return score if text is None else F.when(is_blank(text), F.lit(0.0)).otherwise(score)


def _present(cols: tuple[Column, ...]) -> Column:
    return F.filter(F.array(*cols), lambda x: x.isNotNull())


def _mean(values: Column) -> Column:
    return F.try_divide(
        F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values).cast("double")
    )


def row_mean(*cols: Column) -> Column:
    """Mean over the columns of a row, nulls skipped; null where all are null."""
    return _mean(_present(cols))


def llm_spread(*cols: Column) -> Column:
    """Sample standard deviation over the columns of a row, nulls skipped; null below two values."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    mean = F.try_divide(total, n.cast("double"))
    squares = reduce(
        lambda a, b: a + b, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols]
    )
    return F.when(n >= 2, F.sqrt(F.try_divide(squares, (n - 1).cast("double"))))


def model_deltas(df: DataFrame, base: str, others: dict[str, str]) -> DataFrame:
    """Add ``<name> = other - base`` for every ``name: other``, their absolute sum and signed mean.

    Sum and mean are null as soon as one delta is null.
    """
    df = df.withColumns({name: F.col(col) - F.col(base) for name, col in others.items()})
    deltas = [F.col(name) for name in others]
    return df.withColumns(
        {
            "delta_sum": reduce(lambda a, b: a + b, [F.abs(d) for d in deltas]),
            "delta_mean_signed": reduce(lambda a, b: a + b, deltas) / F.lit(float(len(deltas))),
        }
    )


def hit_flag(sentiment: Column, ret: Column, strict: bool = False) -> Column:
    """1 where sentiment and return have the same sign, else 0.

    Zero or missing values count as a miss and stay in the denominator; ``strict`` turns
    rows with a missing value into null instead.
    """
    same = ((sentiment > 0) & (ret > 0)) | ((sentiment < 0) & (ret < 0))
    flag = F.coalesce(same, F.lit(False)).cast("int")
    return F.when(sentiment.isNotNull() & ret.isNotNull(), flag) if strict else flag


def signs_differ(a: Column, b: Column) -> Column:
    """True where the signs differ; a missing value differs from everything."""
    return ~F.coalesce(F.signum(a) == F.signum(b), F.lit(False))


def quintile_label(bucket: Column) -> Column:
    return F.concat(F.lit("Q"), bucket.cast("string"))


def bool_to_int(col: Column) -> Column:
    return col.cast("int")


def no_nan(col: Column) -> Column:
    """NaN to null.  Spark treats NaN as a value, and one NaN would poison every mean."""
    return F.nanvl(col, F.lit(None).cast("double"))
