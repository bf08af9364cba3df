"""Exact quantiles of many columns, without a sort and without a big group.

``percentile`` keeps every distinct value of a column in one task. Here a
mergeable sketch first brackets each wanted rank; one grouped count then gives
the number of rows in each stretch between the bracket ends and, inside a
bracket, the few values themselves. A bracket holds about one row in three
hundred whatever the distribution, so a few rounds do for any size, and a
value that repeats is settled by its count alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.operators import sketches
from scrubline.operators.columns import batches, number

MAX_LISTED = 10_000  # most rows expected in a stretch whose values are listed


class _Search:
    """Where the wanted ranks of one column lie.

    ``edges`` cut the column into stretches. Stretch ``2 i`` holds the values
    strictly between edges ``i - 1`` and ``i``, stretch ``2 i + 1`` those equal
    to edge ``i``. ``open`` holds the stretches with ranks still wanted, each
    with its size and the shares of its rows at which they lie.
    """

    def __init__(self, name: str, probs: Sequence[float], n: int | None):
        self.name, self.probs, self.n = name, list(probs), n
        self.edges: list[float] = []
        self.listed: set[int] = set()
        self.found: dict[int, float] = {}
        self.places: dict[int, tuple[int, int]] = {}  # rank: values below the one found, values equal to it
        self.open = {0: (n, [float(p) for p in probs])}
        if n is not None:
            self.start(n)

    def start(self, n: int) -> None:
        self.n = n
        self.ranks = sorted({k for p in self.probs if n for k in self.around(p)})
        self.open = {0: (n, self.open[0][1])} if n else {}
        self.listed = {0} if n <= MAX_LISTED else set()

    def around(self, p: float) -> tuple[int, int]:
        k = floor(p * (self.n - 1))
        return k, min(k + 1, self.n - 1)

    def inside(self, stretch: int) -> Column:
        """The column where it lies in an even stretch, else NULL."""
        c, i = number(self.name), stretch // 2
        if i > 0:
            c = F.when(c > self.edges[i - 1], c)
        if i < len(self.edges):
            c = F.when(c < self.edges[i], c)
        return c

    def add_brackets(self, ends: dict[int, list[float]]) -> None:
        """New edges around the open ranks of each sketched stretch."""
        self.edges = sorted(set(self.edges).union(*ends.values()))
        for stretch, points in ends.items():
            if 4 * sketches.SLACK * self.open[stretch][0] > MAX_LISTED:
                continue
            for low, high in zip(points[::2], points[1::2]):
                a, b = bisect_left(self.edges, low), bisect_left(self.edges, high)
                self.listed |= {2 * i for i in range(a + 1, b + 1)}

    def code(self, c: Column) -> Column:
        """Stretch number of a value."""
        out = F.lit(0)
        for e in self.edges:
            out = out + F.when(c > e, 2).when(c == e, 1).otherwise(0)
        return out

    def settle(self, cells: list) -> None:
        """Take the values found; keep the stretches still to be cut."""
        self.open = {}
        for stretch, value, n, below in cells:
            hits = [k for k in self.ranks if k not in self.found and below <= k < below + n]
            if stretch % 2:
                value = self.edges[stretch // 2]
            if value is not None:
                self.found.update(dict.fromkeys(hits, value))
                self.places.update(dict.fromkeys(hits, (below, n)))
            elif hits:
                self.open[stretch] = (n, [(k - below) / max(n - 1, 1) for k in hits])
        self.listed = {s for s, (n, _) in self.open.items() if n <= MAX_LISTED}

    def quantile(self, p: float) -> float | None:
        if not self.n:
            return None
        at = p * (self.n - 1)
        low, high = (self.found[k] for k in self.around(p))
        return low + (high - low) * (at - floor(at))


def _bracket(df: DataFrame, searches: list[_Search]) -> None:
    """Sketch the stretches too long to list; the first round also counts the values."""
    uncounted = [s for s in searches if s.n is None]
    wanted, owners = [], []
    for s in searches:
        for stretch, (_, shares) in s.open.items():
            if stretch not in s.listed:
                points = [q for p in shares for q in (max(0.0, p - sketches.SLACK), min(1.0, p + sketches.SLACK))]
                wanted.append((s.inside(stretch), points))
                owners.append((s, stretch))
    if not wanted:
        return
    values, counts = sketches.sketch_quantiles(df, wanted, [number(s.name) for s in uncounted])
    for s, n in zip(uncounted, counts):
        s.start(n)
    for s in searches:
        ends = {stretch: v for (o, stretch), v in zip(owners, values) if o is s and stretch in s.open}
        if ends and 0 not in s.listed:
            s.add_brackets(ends)


def _count_stretches(df: DataFrame, searches: list[_Search]) -> DataFrame:
    """The stretches and listed values in which a wanted rank lies.

    The running count is over stretches and listed values only, per column.
    """
    cells = [F.struct(F.lit(i).alias("tag"), number(s.name).alias("value")) for i, s in enumerate(searches)]
    tag, value = F.col("tag"), F.col("value")
    stretch, listed, ranks = F.when(tag < 0, 0), F.lit(False), F.when(tag < 0, F.array(F.lit(0).cast("bigint")))
    for i, s in enumerate(searches):
        stretch = stretch.when(tag == i, s.code(value))
        ranks = ranks.when(tag == i, F.array(*[F.lit(k).cast("bigint") for k in s.ranks]))
        if s.listed:
            listed = listed | ((tag == i) & F.col("stretch").isin(*sorted(s.listed)))
    in_order = Window.partitionBy("tag").orderBy("stretch", "value")
    return (
        df.select(F.inline(F.array(*cells)))
        .where(value.isNotNull())
        .withColumn("stretch", stretch)
        .withColumn("value", F.when(listed, value))
        .groupBy("tag", "stretch", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("below", F.sum("n").over(in_order) - F.col("n"))
        .where(F.exists(ranks, lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("n"))))
    )


def _run(df: DataFrame, searches: list[_Search]) -> None:
    while todo := [s for s in searches if s.open]:
        _bracket(df, todo)
        todo = [s for s in todo if s.open]
        if not todo:
            break
        cells = _count_stretches(df, todo).collect()  # one or two rows per wanted rank
        for i, s in enumerate(todo):
            s.settle([(r.stretch, r.value, r.n, r.below) for r in cells if r.tag == i])


def order_statistics(
    df: DataFrame, ranks: dict[str, Sequence[int]], counts: dict[str, int], batch: int = 16
) -> dict[str, dict[int, tuple[float, int, int]]]:
    """Per column and rank (from 0): the value as double, how many lie below it, how many equal it."""
    result = {}
    for some in batches(list(ranks), batch):
        searches = []
        for c in some:
            s = _Search(c, [k / max(counts[c] - 1, 1) for k in ranks[c]], counts[c])
            s.ranks = sorted(set(ranks[c]))
            searches.append(s)
        _run(df, searches)
        result.update({s.name: {k: (s.found[k], *s.places[k]) for k in s.ranks} for s in searches})
    return result


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    counts: dict[str, int] | None = None,
    batch: int = 16,
) -> dict[str, dict[float, float | None]]:
    """Quantiles with linear interpolation, NULL and NaN left out.

    ``counts`` (non-null values per column) spares short columns the sketch.
    """
    result: dict[str, dict[float, float | None]] = {}
    for some in batches(list(cols), batch):
        searches = [_Search(c, probs, counts[c] if counts else None) for c in some]
        _run(df, searches)
        result.update({s.name: {p: s.quantile(p) for p in probs} for s in searches})
    return result


def medians(df: DataFrame, cols: Sequence[str], counts: dict[str, int] | None = None):
    return {c: q[0.5] for c, q in exact_quantiles(df, cols, [0.5], counts).items()}
