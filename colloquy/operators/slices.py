"""Running values over the ordered rows of a key, in two levels, so that one huge meeting is no single task.

A key's rows are cut into time slices (``cut``). Each slice is scanned alone; what a slice passes on (its largest end, how many
runs began in it, its last row) is one row, and those few rows are scanned by key; the result of that scan is joined
back to the slices. A meeting of a million turns is then dealt by slice over all cores, and the only rows of a
key that meet in one task are one for each slice. Every slice is shuffled once, by ``cut``.

Slices must follow the order of the scan: it has to begin with the column that was cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The column that ``cut`` adds.
SLICE = "_slice"
_UPTO = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def cut(df: DataFrame, keys: Sequence[str], at: str, slice_ms: int) -> DataFrame:
    """``df`` dealt by key and slice of ``slice_ms`` of the column ``at``."""
    if slice_ms <= 0:
        raise ValueError("slices need a positive length")
    return df.withColumn(SLICE, F.floor(F.col(at) / slice_ms)).repartition(*keys, SLICE)


class Scan:
    """Running values to compute together; each method adds a column ``name``. Columns are read within slices and passed on
    from slice to slice as described there."""

    def __init__(self, keys: Sequence[str], order: Sequence[str | Column]):
        self.keys, self.order = list(keys), [F.col(c) if isinstance(c, str) else c for c in order]
        self._parts: list[tuple[str, Column, Column, Column, Callable[[Column, Column], Column]]] = []
        self._own = Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)
        self._slices = Window.partitionBy(*self.keys).orderBy(SLICE)

    def max_before(self, name: str, value: Column) -> Scan:
        """The largest value of earlier rows; null for the first."""
        within, carry = F.max(value).over(self._own.rowsBetween(*_BEFORE)), F.max(f"_{name}").over(self._slices.rowsBetween(*_BEFORE))
        self._parts.append((name, within, F.max(value), carry, lambda own, before: F.greatest(own, before)))
        return self

    def sum_upto(self, name: str, value: Column) -> Scan:
        """The sum of values up to this row."""
        within, carry = F.sum(value).over(self._own.rowsBetween(*_UPTO)), F.sum(f"_{name}").over(self._slices.rowsBetween(*_BEFORE))
        self._parts.append((name, within, F.sum(value), carry, lambda own, before: F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))))
        return self

    def last_before(self, name: str, value: Column) -> Scan:
        """The value of the row before, null or not; null for the first."""
        return self._neighbour(name, value, F.lag, F.max_by)

    def next_after(self, name: str, value: Column) -> Scan:
        """The value of the next row; null for the last."""
        return self._neighbour(name, value, F.lead, F.min_by)

    def _neighbour(self, name: str, value: Column, step: Callable, pick: Callable) -> Scan:
        there = F.struct(value.alias("v"))  # so that a null value is told from no row
        carry = step(f"_{name}").over(self._slices)
        self._parts.append((name, step(there).over(self._own), pick(there, F.struct(*self.order)), carry, lambda own, far: F.coalesce(own, far)["v"]))
        return self

    def over(self, df: DataFrame) -> DataFrame:
        """``df``, dealt by ``cut``, with the columns."""
        totals = df.groupBy(*self.keys, SLICE).agg(*(total.alias(f"_{name}") for name, _, total, _, _ in self._parts))
        carried = totals.select(*(F.col(k).alias(f"_{k}_") for k in (*self.keys, SLICE)), *(carry.alias(f"_{name}_before") for name, _, _, carry, _ in self._parts))
        own = df.select("*", *(within.alias(f"_{name}") for name, within, _, _, _ in self._parts))
        same = F.lit(True)
        for k in (*self.keys, SLICE):
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
        joined = own.join(carried, same, "left")
        return joined.select(*df.columns, *(together(F.col(f"_{name}"), F.col(f"_{name}_before")).alias(name) for name, _, _, _, together in self._parts))
