"""Ordered work over session logs without one task per session.

Numbering, look-behind and running totals need the rows of a session in log
order. A window over ``session_id`` puts a session into one task, which is
right while sessions are bounded and wrong when one session holds a third of
the table. :class:`LogOrder` covers both: with ``rows_per_slice`` set, rows
are windowed within ``(session, seq div rows_per_slice)`` slices, and what a
slice must know of its neighbours is computed from one summary row per slice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrace.operators.joins import join_by
from shelltrace.session import cut_lineage, write_through

# Sessions up to this many rows are ordered in a single window.
MAX_WINDOW_ROWS = 1_000_000
ROWS_PER_SLICE = 65_536

_SLICE, _NUMBER, _HASH = "_slice", "_number", "_slice_hash"
_OVERALL = {"total": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Before:
    """A value carried into a slice from the other slices of its session.

    ``how``: ``sum`` of the preceding slices, ``last`` non-null value of the
    preceding slices, ``next`` non-null value of the following slices,
    ``total`` / ``min`` / ``max`` over all slices of the session, ``own``: the
    slice's value itself, or ``suffix``: the last ``length`` characters of the
    preceding slices' non-empty texts. ``given`` makes a slice's value from the
    one aggregated and from what is carried under the names before.
    """

    value: Column
    how: str
    length: int = 0
    given: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class LogOrder:
    """Rows of each ``keys`` group in ``seq`` order.

    ``seq`` must be a non-negative integer, unique within a group.
    """

    keys: tuple[str, ...] = ("session_id",)
    seq: str = "seq"
    rows_per_slice: int | None = None
    gathered: bool = False

    @property
    def sliced(self) -> bool:
        return self.rows_per_slice is not None

    @property
    def group(self) -> list[str]:
        """Columns whose groups are ordered within one task."""
        if self.gathered:
            return [_HASH, _SLICE]
        return [*self.keys, _SLICE] if self.sliced else [*self.keys]

    def by(self, seq: str) -> LogOrder:
        """The same strategy over another sequence column."""
        return replace(self, seq=seq)

    def start(self, df: DataFrame) -> DataFrame:
        """Assign slices."""
        if not self.sliced:
            return df
        return df.withColumn(
            _SLICE, F.expr(f"{self.seq} div {self.rows_per_slice}")
        )

    def gather(self, df: DataFrame) -> tuple[DataFrame, LogOrder]:
        """Assign slices and shuffle by them once, for all that is done in slices.

        A slice is a struct of its keys and number here. It is never null, and
        equal to one with the same nulls, so windows, groups and joins by slice
        need rows partitioned in one way only. Its hash decides most comparisons
        of a sort, which are slow on structs. Follow with ``carry_over``.
        """
        if not self.sliced:
            return df, self
        order = replace(self, gathered=True)
        number = F.expr(f"{self.seq} div {self.rows_per_slice}").alias(_NUMBER)
        df = df.withColumn(_SLICE, F.struct(*self.keys, number))
        df = df.withColumn(_HASH, F.xxhash64(_SLICE))
        return df.repartition(*order.group), order

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop(_HASH, _SLICE)

    def rows(self):
        """Window over the rows of a group, in order."""
        return W.partitionBy(*self.group).orderBy(self.seq)

    def so_far(self):
        return self.rows().rowsBetween(W.unboundedPreceding, W.currentRow)

    def before(self):
        return self.rows().rowsBetween(W.unboundedPreceding, -1)

    def after(self):
        """The rows after the current one, nearest last."""
        return (
            W.partitionBy(*self.group)
            .orderBy(F.desc(self.seq))
            .rowsBetween(W.unboundedPreceding, -1)
        )

    def carry(self, df: DataFrame, **values: Before) -> DataFrame:
        """Add one column per value, as known from the other slices."""
        if not self.sliced:
            return self._carry_in_window(df, values)
        df = cut_lineage(df)
        carried = self._across(self._summary(df, values), values, self.keys, _SLICE)
        return join_by(df, carried.select(*self.group, *values), self.group)

    def carry_over(self, df: DataFrame, **values: Before) -> DataFrame:
        """As ``carry``, for rows just gathered: lineage is not cut.

        The summary reads the rows' shuffle if it takes all their columns; the
        keys are taken from the slice.
        """
        keys = {k: F.col(f"{_SLICE}.{k}") for k in self.keys}
        df = df.drop(*keys)
        # As columns of their own, all windows share one shuffle.
        place = {**keys, _NUMBER: F.col(f"{_SLICE}.{_NUMBER}")}
        summary = self._summary(df, values).withColumns(place)
        carried = self._across(summary, values, self.keys, _NUMBER)
        return df.join(carried.select(*self.group, *values), self.group).withColumns(keys)

    def _summary(self, df: DataFrame, values: dict[str, Before]) -> DataFrame:
        return df.groupBy(*self.group).agg(
            *[v.value.alias(f"_of{name}") for name, v in values.items()]
        )

    def _across(
        self, carried: DataFrame, values: dict[str, Before], keys, number: str
    ) -> DataFrame:
        """The summary with what is known from the other slices."""
        slices = W.partitionBy(*keys).orderBy(number)
        earlier = slices.rowsBetween(W.unboundedPreceding, -1)
        # The following rows, as the preceding ones in reverse: a frame that
        # ends at the last row is evaluated anew for every row.
        later = (
            W.partitionBy(*keys)
            .orderBy(F.desc(number))
            .rowsBetween(W.unboundedPreceding, -1)
        )
        all_slices = W.partitionBy(*keys)

        def across(c: Column, v: Before) -> Column:
            if v.how == "own":
                return c
            if v.how == "sum":
                return F.coalesce(F.sum(c).over(earlier), F.lit(0))
            if v.how == "last":
                return F.last(c, ignorenulls=True).over(earlier)
            if v.how == "next":
                return F.last(c, ignorenulls=True).over(later)
            if v.how == "suffix":
                # Each of the preceding texts adds at least one character.
                return suffix_before(c, slices, v.length)
            return _OVERALL[v.how](c).over(all_slices)

        for name, v in values.items():
            if v.given:
                carried = carried.withColumn(f"_of{name}", v.given(F.col(f"_of{name}")))
            carried = carried.withColumn(name, across(F.col(f"_of{name}"), v))
        return carried

    def _carry_in_window(self, df: DataFrame, values: dict[str, Before]) -> DataFrame:
        # In order, although order is of no account, to share the rows' sort.
        whole = self.rows().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        outside = [n for n, v in values.items() if v.how in ("last", "next")]
        types = (
            df.groupBy(*self.keys)
            .agg(*[values[n].value.alias(n) for n in outside])
            .schema
            if outside
            else None
        )
        columns = {}
        for name, v in values.items():
            if v.how == "sum":
                columns[name] = F.lit(0).cast("long")
            elif v.how == "suffix":
                columns[name] = F.lit("")
            elif v.how in ("last", "next"):
                columns[name] = F.lit(None).cast(types[name].dataType)
            else:
                columns[name] = v.value.over(whole)
        return df.withColumns(columns)


def suffix_before(text: Column, window, length: int) -> Column:
    """Last ``length`` characters of the preceding non-empty texts."""
    earlier = [F.lag(text, n).over(window) for n in range(length, 0, -1)]
    return F.right(F.concat_ws("", *earlier), F.lit(length))


def choose_order(
    df: DataFrame,
    keys: tuple[str, ...] = ("session_id",),
    seq: str = "seq",
    max_window_rows: int = MAX_WINDOW_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> LogOrder:
    """One window per group when every group is bounded, else slices.

    Counts rows per group; only the key columns are scanned.
    """
    oversized = df.groupBy(*keys).count().where(F.col("count") > max_window_rows)
    return LogOrder(keys, seq, None if oversized.isEmpty() else rows_per_slice)


def number_rows(df: DataFrame, order: LogOrder, name: str) -> DataFrame:
    """Zero-based position of each row in its group, as column ``name``."""
    df = order.carry(order.start(df), _before=Before(F.count(F.lit(1)), "sum"))
    position = F.row_number().over(order.rows()) - 1 + F.col("_before")
    return order.finish(df.withColumn(name, position.cast("long")).drop("_before"))


def first_rows(df: DataFrame, order: LogOrder, n: int) -> DataFrame:
    """The first ``n`` rows of each group.

    Rows beyond the first ``n`` of a slice are dropped before they are shuffled
    where Spark recognises a limit by group, and before anything is carried.
    """
    df = order.start(df)
    place = F.row_number().over(order.rows())
    first = df.withColumn("_place", place).where(F.col("_place") <= n)
    if order.sliced:
        # A slice that lost rows has at least n before the slices after it.
        first = order.carry(first, _before=Before(F.count(F.lit(1)), "sum"))
        first = first.where(F.col("_place") + F.col("_before") <= n).drop("_before")
    return order.finish(first.drop("_place"))


def assemble(
    df: DataFrame,
    order: LogOrder,
    text: str,
    max_part_bytes: int | None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Concatenate ``text`` per group in order, as ``(keys, part, text)``.

    A document longer than ``max_part_bytes`` comes in several parts, in
    ``part`` order; joined they are the document. Pass ``None`` where the
    number of rows per group is bounded, which saves the running length.
    ``keep`` names columns with one value per group.
    """
    in_order = F.expr(f"listagg({text}, '') within group (order by {order.seq})")
    df = df.select(*order.keys, order.seq, text, *keep)
    kept = [F.max(c).alias(c) for c in keep]
    if max_part_bytes is None:
        return df.groupBy(*order.keys).agg(
            F.lit(0).cast("long").alias("part"), in_order.alias(text), *kept
        )
    rows = df.withColumn("_size", F.octet_length(text).cast("long"))
    if order.sliced:
        # Only lengths are added up in order; the texts meet their part once.
        df = write_through(df, "texts")
        place = [*order.keys, order.seq]
        rows = df.select(*place, F.octet_length(text).cast("long").alias("_size"))
    rows = order.carry(order.start(rows), _before=Before(F.sum("_size"), "sum"))
    offset = F.sum("_size").over(order.so_far()) - F.col("_size") + F.col("_before")
    rows = rows.withColumn("part", F.floor(offset / max_part_bytes).cast("long"))
    if order.sliced:
        rows = join_by(df, rows.select(*place, "part"), place)
    return rows.groupBy(*order.keys, "part").agg(in_order.alias(text), *kept)


# Folds whose state resets cannot be written as window functions. A fold over
# few states is an array of end states, one per start state; arrays compose. Of
# the lists folded here none is long, as every step copies what it appends to.


def fold_path(items: Column, start: Column, step) -> Column:
    """States before each item and after the last; ``step(state, item)``."""
    return F.aggregate(
        items,
        F.array(start.cast("int")),
        lambda path, item: F.concat(
            path, F.array(step(F.element_at(path, -1), item).cast("int"))
        ),
    )


def fold_ends(items: Column, n_states: int, step) -> Column:
    """The end state for each of the start states ``0..n_states - 1``."""
    return F.aggregate(
        items,
        F.array(*[F.lit(i) for i in range(n_states)]),
        lambda states, item: F.transform(states, lambda s: step(s, item).cast("int")),
    )


def _compose(ends: Column) -> Column:
    """One array for a list of them, in order."""
    return F.aggregate(
        F.slice(ends, F.lit(2), F.size(ends)),
        F.get(ends, F.lit(0)),
        lambda so_far, end: F.transform(so_far, lambda s: F.get(end, s)),
    )


def _walk(ends: Column, start: Column) -> Column:
    """States before each of a list of arrays, and after the last."""
    return fold_path(ends, start, lambda state, end: F.get(end, state))


SLICES_PER_SPAN = 256


def start_states(
    slices: DataFrame, keys: tuple[str, ...], slice_col: str, ends: str
) -> DataFrame:
    """State at the start of each slice: ``(keys, slice, state, end_state)``.

    ``ends`` holds a slice's end state per start state; ``end_state`` is the
    state after the group's last slice. Slices are first composed in spans of
    ``SLICES_PER_SPAN``, so a group meets one row per span.
    """
    listed = F.sort_array(F.collect_list(F.struct(slice_col, ends))).alias("_s")
    spans = slices.withColumn(
        "_span", F.floor(F.col(slice_col) / SLICES_PER_SPAN)
    )
    spans = spans.groupBy(*keys, "_span").agg(listed)
    composed = spans.select(*keys, "_span", _compose(F.col(f"_s.{ends}")).alias("_e"))
    walked = (
        composed.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_span", "_e"))).alias("_p"))
        .withColumn("_states", _walk(F.col("_p._e"), F.lit(0)))
        .select(
            *keys,
            F.element_at("_states", -1).alias("end_state"),
            F.posexplode("_p._span").alias("_i", "_span"),
            "_states",
        )
        .select(
            *keys,
            "_span",
            F.get("_states", F.col("_i")).alias("_start"),
            "end_state",
        )
    )
    return (
        join_by(spans, walked, (*keys, "_span"))
        .withColumn("_states", _walk(F.col(f"_s.{ends}"), F.col("_start")))
        .select(
            *keys,
            "end_state",
            F.posexplode(f"_s.{slice_col}").alias("_i", slice_col),
            "_states",
        )
        .select(
            *keys,
            slice_col,
            F.get("_states", F.col("_i")).alias("state"),
            "end_state",
        )
    )
