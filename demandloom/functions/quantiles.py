"""Exact quantiles without holding a whole column in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions.expr import null_if_nan

# Values that are gathered for a wanted rank; the bracket around it is narrowed until it holds no more.
BUFFER_ROWS = 20_000
SKETCH_ACCURACY = 10_000
# Bracket half-width in shares of the rows: twice the error of the sketch.
PAD = 2.0 / SKETCH_ACCURACY


@dataclass
class _Rank:
    """The search for the value with ``k`` values before it in sorted order."""

    column: str
    k: int
    size: int  # rows still in the bracket
    skipped: int = 0  # rows below the bracket
    low: float | None = None  # the bracket is between these, without them
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        v, out = F.col(self.column), F.col(self.column).isNotNull()
        if self.low is not None:
            out = out & (v > self.low)
        if self.high is not None:
            out = out & (v < self.high)
        return out

    def marks(self) -> Column:
        share = (self.k - self.skipped + 0.5) / self.size
        ends = F.array(F.lit(max(0.0, share - PAD)), F.lit(min(1.0, share + PAD)))
        return F.percentile_approx(F.when(self.inside(), F.col(self.column)), ends, SKETCH_ACCURACY)

    def narrow(self, a: float, b: float, less: int, mid: int, at_a: int, at_b: int) -> None:
        """Go to the part that holds the rank: below ``a``, at ``a``, between, at ``b``, or above ``b``.

        ``a`` and ``b`` are values of the bracket and each part is without them, so it is always
        smaller than the bracket, however often a value occurs.
        """
        if self.k < self.skipped + less:
            self.high, self.size = a, less
        elif self.k >= self.skipped + less + mid:
            self.low, self.skipped, self.size = b, self.skipped + less + mid, self.size - less - mid
        elif a == b or self.k < self.skipped + less + at_a:
            self.value = a
        elif self.k >= self.skipped + less + mid - at_b:
            self.value = b
        else:
            self.low, self.high = a, b
            self.skipped, self.size = self.skipped + less + at_a, mid - at_a - at_b


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    buffer_rows: int = BUFFER_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, as ``{column: [value, ...]}``.

    ``percentile`` merges all distinct values of a column into one buffer. Instead the ranks next to
    each quantile are bracketed, all of them in the same scans: a pass sketches the rows still in each
    bracket and counts the rows below it, so a bracket shrinks by the sketch accuracy per pass, until
    it holds at most ``buffer_rows``. Two passes reach from 10^11 rows to some ten thousand, and only
    those are gathered.
    """
    names = {f"v{i}": c for i, c in enumerate(columns)}
    narrow = df.select(*[null_if_nan(df, c).cast("double").alias(v) for v, c in names.items()])
    counts = narrow.agg(*[F.count(v).alias(v) for v in names]).first()
    result: dict[str, list[float | None]]
    ranks: dict[tuple[str, int], _Rank] = {}
    result = {names[v]: [None] * len(probabilities) for v in names if not counts[v]}
    positions = {v: [p * (counts[v] - 1) for p in probabilities] for v in names if counts[v]}
    for v, places in positions.items():
        for place in places:
            for k in (math.floor(place), math.ceil(place)):
                ranks.setdefault((v, k), _Rank(v, k, counts[v]))
    _search(narrow, list(ranks.values()), buffer_rows)
    for v, places in positions.items():
        result[names[v]] = []
        for place in places:
            a, b = ranks[v, math.floor(place)].value, ranks[v, math.ceil(place)].value
            result[names[v]].append(a + (b - a) * (place - math.floor(place)))
    return result


def _search(values: DataFrame, ranks: list[_Rank], buffer_rows: int) -> None:
    """Fill in the value of every rank."""
    while open_ranks := [r for r in ranks if r.value is None and r.size > buffer_rows]:
        ends = values.agg(*[r.marks().alias(f"m{i}") for i, r in enumerate(open_ranks)]).first()
        parts = []
        for i, r in enumerate(open_ranks):
            (a, b), v = ends[f"m{i}"], F.col(r.column)
            parts += [
                F.count_if(r.inside() & (v < a)).alias(f"less{i}"),
                F.count_if(r.inside() & (v >= a) & (v <= b)).alias(f"mid{i}"),
                F.count_if(r.inside() & (v == a)).alias(f"low{i}"),
                F.count_if(r.inside() & (v == b)).alias(f"high{i}"),
            ]
        sizes = values.agg(*parts).first()
        for i, r in enumerate(open_ranks):
            r.narrow(*ends[f"m{i}"], *(sizes[f"{part}{i}"] for part in ("less", "mid", "low", "high")))
    left = [r for r in ranks if r.value is None]
    if not left:
        return
    # one row per distinct value of each rank's bracket, which is short
    cells = F.array_compact(
        F.array(*[F.when(r.inside(), F.struct(F.lit(i).alias("i"), F.col(r.column).alias("v"))) for i, r in enumerate(left)])
    )
    ladder = values.select(F.inline(cells)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    seen = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    need = F.get(F.array(*[F.lit(r.k - r.skipped) for r in left]), F.col("i"))
    found = ladder.withColumn("seen", seen).filter(F.col("seen") > need).groupBy("i").agg(F.min("v").alias("v"))
    for row in found.collect():
        left[row["i"]].value = row["v"]
