"""Correlations, exact quantile buckets, hit rates and stage counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickertide.functions.scores import clamp, hit_flag, no_nan, quintile_label
from tickertide.functions.text import sql_value
from tickertide.operators.daily import sentiment_change
from tickertide.schemas import HORIZON_LABELS, RETURN_COLUMNS
from tickertide.session import cut_lineage


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null for a constant column or below two pairs.

    The built-in ``corr`` raises a division error on constant columns in ANSI mode.
    """
    divisor = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return clamp(F.try_divide(F.regr_sxy(y, x), divisor))


def _label(col: str) -> str:
    return HORIZON_LABELS.get(col, col)


def _cells(df: DataFrame, ids: list[str], cells: list[dict[str, str]]) -> DataFrame:
    """Unfold each row to one row per cell, whose columns are given as SQL expressions.

    Grouping by the cell's labels afterwards keeps one small aggregate however many cells
    there are, and every task reduces its rows to one per group before the shuffle.
    """
    structs = [
        "named_struct(" + ", ".join(f"'{name}', {expr}" for name, expr in cell.items()) + ")"
        for cell in cells
    ]
    return df.selectExpr(*ids, f"inline(array({', '.join(structs)}))")


def _complete(table: DataFrame, grid: list[tuple], names: list[str]) -> DataFrame:
    """Exactly the rows of a small ``grid``; one without data gets nulls."""
    schema = ", ".join(f"{n} string" for n in names)
    return table.sparkSession.createDataFrame(grid, schema).join(table, names, "left")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs as (x, y, r) rows, from one pass over half of the matrix."""
    cells = [
        {"x": sql_value(x), "y": sql_value(y), "a": f"`{x}`", "b": f"`{y}`"}
        for x, y in combinations_with_replacement(cols, 2)
    ]
    half = _cells(df, [], cells).groupBy("x", "y").agg(safe_corr(F.col("a"), F.col("b")).alias("r"))
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y", "r"))).otherwise(
        F.array(F.struct("x", "y", "r"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    )
    return _complete(half.select(F.inline(both)), [(x, y) for x in cols for y in cols], ["x", "y"])


def corr_by_ticker(
    aligned: DataFrame,
    sent_cols: list[str],
    ret_cols: list[str] = RETURN_COLUMNS,
    tickers: list[str] | None = None,
) -> DataFrame:
    """Per ticker, model and horizon: correlation of sentiment and return."""
    rows = aligned if tickers is None else aligned.where(F.col("ticker").isin(tickers))
    grid = [(s, r) for s in sent_cols for r in ret_cols]
    cells = [
        {"model": sql_value(s), "horizon": sql_value(_label(r)), "a": f"`{s}`", "b": f"`{r}`"}
        for s, r in grid
    ]
    names = ["ticker", "model", "horizon"]
    table = (
        _cells(rows, ["ticker"], cells)
        .groupBy(*names)
        .agg(safe_corr(F.col("a"), F.col("b")).alias("r"))
    )
    if tickers is None:
        return table
    return _complete(table, [(t, s, _label(r)) for t in tickers for s, r in grid], names)


def corr_delta_block(
    aligned: DataFrame, ret_cols: list[str], delta_cols: list[str]
) -> DataFrame:
    """Horizons against disagreement features over all tickers, as (horizon, feature, r) rows."""
    grid = [(r, d) for r in ret_cols for d in delta_cols]
    cells = [
        {"horizon": sql_value(_label(r)), "feature": sql_value(d), "a": f"`{d}`", "b": f"`{r}`"}
        for r, d in grid
    ]
    names = ["horizon", "feature"]
    table = _cells(aligned, [], cells).groupBy(*names).agg(safe_corr(F.col("a"), F.col("b")).alias("r"))
    return _complete(table, [(_label(r), d) for r, d in grid], names)


# Bits of a value's image that one pass counts.
DIGIT = 16
# Values of one digit are read, not counted on, once no more rows than this share it.
SPAN_ROWS = 4096


def _image(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros have one."""
    bits = (values + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def _value(image: int) -> float:
    """The double of an image; images beyond the infinities give these."""
    sign = 1 << 63
    bits = image ^ sign if image & sign else image ^ ((1 << 64) - 1)
    value = float(np.array([bits], dtype=np.uint64).view(np.float64)[0])
    return value if value == value else float("inf" if image & sign else "-inf")


def _digit_counts(values: DataFrame, prefixes: list[int], shift: int) -> dict[int, np.ndarray]:
    """For each prefix of images how many rows have each next digit, by one pass.

    A task sends at most 65,536 numbers for each prefix, and that is also what reaches the driver.
    """
    size = 1 << DIGIT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(prefixes), size), dtype=np.int64)
        for batch in batches:
            image = _image(batch.column(0).to_numpy(zero_copy_only=False))
            digit = ((image >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
            # Shifting by all 64 bits isn't defined.
            high = (image >> np.uint64(shift)) >> np.uint64(DIGIT)
            for k, prefix in enumerate(prefixes):
                totals[k] += np.bincount(digit[high == np.uint64(prefix)], minlength=size)
        place = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place // size), pa.array(place % size), pa.array(totals.ravel()[place])],
            names=["k", "digit", "n"],
        )

    counted = values.mapInArrow(count, "k long, digit long, n long").groupBy("k", "digit").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    out = np.zeros((len(prefixes), size), dtype=np.int64)
    out[found["k"].to_numpy(), found["digit"].to_numpy()] = found["n"].to_numpy()
    return dict(zip(prefixes, out))


def _ranked(values: DataFrame, ranks_of: Callable[[int], list[int]]) -> tuple[int, dict[int, float]]:
    """Number of rows of column ``x``, and its values at the places that ``ranks_of`` names for it.

    Radix selection: each pass fixes 16 more bits of all wanted values together, so four passes
    do for any number of rows and any distribution; fewer once what is left can be read.
    """
    # Per rank: the bits found so far, and how many rows lie below them.
    at: dict[int, tuple[int, int]] = {}
    shift, total, rows = 64, 0, {}
    while shift and (shift == 64 or max(rows.values()) > SPAN_ROWS):
        shift -= DIGIT
        counts = _digit_counts(values, sorted({p for p, _ in at.values()}) or [0], shift)
        if not at:
            total = int(counts[0].sum())
            if not total:
                return 0, {}
            at = {rank: (0, 0) for rank in ranks_of(total)}
        for rank, (prefix, below) in at.items():
            upto = np.cumsum(counts[prefix])
            digit = int(np.searchsorted(upto, rank - below, side="right"))
            rows[rank] = int(counts[prefix][digit])
            at[rank] = ((prefix << DIGIT) + digit, below + int(upto[digit]) - rows[rank])
    if not shift:
        return total, {rank: _value(prefix) for rank, (prefix, _) in at.items()}
    spans = {p: (_value(p << shift), _value(((p + 1) << shift) - 1)) for p, _ in at.values()}
    inside = reduce(lambda a, b: a | b, [F.col("x").between(F.lit(lo), F.lit(hi)) for lo, hi in spans.values()])
    # At most SPAN_ROWS rows for each rank.
    left = np.sort(values.where(inside).toArrow()["x"].to_numpy() + 0.0)
    found = {}
    for rank, (prefix, below) in at.items():
        found[rank] = float(left[np.searchsorted(left, spans[prefix][0]) + rank - below])
    return total, found


def _number(value: float) -> str:
    return f"double('{value!r}')"


def quantile_edges(df: DataFrame, col: str, q: int = 5) -> list[float]:
    """Inner edges of ``q`` equal buckets, exact with linear interpolation.

    The built-in exact percentile holds all distinct values in one task.  Here the column is
    written once, and its values at the edges' ranks are found by radix selection: at most four
    passes over eight bytes a row, in which no task ranks rows.

    Like ``approxQuantile`` this runs at once; each pass returns a bounded table of counts.
    """
    values = df.select(no_nan(F.col(col)).cast("double").alias("x")).where(F.col("x").isNotNull())

    def places(total: int) -> list[tuple[int, int]]:
        # Ranks, in whole numbers, of the two values each edge lies between.
        return [divmod(k * (total - 1), q) for k in range(1, q)]

    def ranks(total: int) -> list[int]:
        return sorted({r for low, rest in places(total) for r in (low, low + (rest > 0))})

    total, at = _ranked(cut_lineage(values, "column"), ranks)

    def edge(low: int, rest: int) -> float:
        start, end = at[low], at[low + (rest > 0)]
        # Between equal infinities there is no difference to take a share of.
        return start if start == end else start + (end - start) * (rest / q)

    return [edge(*place) for place in places(total)] if total else []


def bucketed(df: DataFrame, col: str, q: int = 5, strict: bool = False) -> DataFrame:
    """Add ``quintile`` 1..q by the global quantiles of ``col``; rows without a value are left out.

    A bucket takes in its upper edge, so equal values share one (unlike ``ntile``).
    ``strict`` raises where edges coincide.
    """
    edges = quantile_edges(df, col, q)
    if strict:
        row = df.agg(F.min(no_nan(F.col(col))).alias("lo"), F.max(no_nan(F.col(col))).alias("hi")).first()
        ends = [row.lo, *edges, row.hi]
        if len(set(ends)) < len(ends):
            raise ValueError(f"bucket edges of {col} are not unique: {ends}")
    place = " + ".join(["1"] + [f"int({_number(e)} < _value)" for e in edges])
    return (
        df.withColumn("_value", no_nan(F.col(col)))
        .where("_value is not null")
        .withColumn("quintile", F.expr(place))
        .drop("_value")
    )


def _bucket_means(rows: DataFrame, cols: list[str]) -> DataFrame:
    return (
        rows.groupBy("quintile")
        .agg(*[F.avg(c).alias(c) for c in cols])
        .withColumn("label", quintile_label(F.col("quintile")))
        .select("quintile", "label", *cols)
    )


def quintile_excess(
    daily_q: DataFrame, sent_col: str, excess_cols: list[str], q: int = 5, strict: bool = False
) -> DataFrame:
    """Mean excess returns per bucket of the sentiment level.

    ``daily_q`` is read twice; materialise it first where it is costly.
    """
    rows = daily_q.select(sent_col, *excess_cols)
    return _bucket_means(bucketed(rows, sent_col, q, strict), excess_cols)


def quintile_change(
    daily_q: DataFrame, sent_col: str, excess_cols: list[str], q: int = 5, strict: bool = False
) -> DataFrame:
    """Mean excess returns per bucket of the sentiment's change to the ticker's previous row."""
    rows = sentiment_change(daily_q.select("ticker", "date", sent_col, *excess_cols), sent_col, "change")
    return _bucket_means(bucketed(rows.drop("ticker", "date"), "change", q, strict), excess_cols)


def hit_rate_overall(
    daily_q: DataFrame, sent_col: str, ret_cols: list[str] = RETURN_COLUMNS, strict: bool = False
) -> DataFrame:
    """Share of rows whose return has the sign of the sentiment, per horizon."""
    cells = [{"horizon": sql_value(_label(r)), "s": f"`{sent_col}`", "r": f"`{r}`"} for r in ret_cols]
    hit = hit_flag(F.col("s"), F.col("r"), strict)
    table = _cells(daily_q, [], cells).groupBy("horizon").agg(F.avg(hit).alias("hit_rate"))
    return _complete(table, [(_label(r),) for r in ret_cols], ["horizon"])


def hit_rate_by_ticker(
    daily_q: DataFrame,
    sent_cols: list[str],
    ret_cols: list[str] = RETURN_COLUMNS,
    tickers: list[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Hit rates per (ticker, model, horizon)."""
    rows = daily_q if tickers is None else daily_q.where(F.col("ticker").isin(tickers))
    grid = [(s, r) for s in sent_cols for r in ret_cols]
    cells = [
        {"model": sql_value(s), "horizon": sql_value(_label(r)), "s": f"`{s}`", "r": f"`{r}`"}
        for s, r in grid
    ]
    names = ["ticker", "model", "horizon"]
    hit = hit_flag(F.col("s"), F.col("r"), strict)
    table = _cells(rows, ["ticker"], cells).groupBy(*names).agg(F.avg(hit).alias("hit_rate"))
    if tickers is None:
        return table
    return _complete(table, [(t, s, _label(r)) for t in tickers for s, r in grid], names)


def stage_counts(named_stages: dict[str, DataFrame]) -> DataFrame:
    """Rows per named stage, as (stage, rows)."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
        for name, df in named_stages.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


def source_counts(before: DataFrame, after: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source before and after deduplication, in one aggregate."""
    sides = before.select(source, F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(source, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return sides.groupBy(source).agg(
        F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after")
    )
