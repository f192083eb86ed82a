"""Ordered rows per key, for windows and folds that survive one hot key.

Most operators walk the segments of one media in order.  The plain plan is a window
partitioned by ``media_id``: one shuffle, and Catalyst shares it between consecutive
steps.  That plan puts a whole media in one task, which fails when one media holds a
large share of all rows.  ``arrange`` therefore measures the largest group first (a
column-pruned count) and

* below ``limit`` rows keeps the plain plan;
* above it range-partitions all rows by key *and* order, numbers them, and cuts every
  group into chunks of ``limit`` rows.  Running values are computed per chunk and joined
  with a carry from the chunks before; neighbours are found through rows copied over the
  chunk edge; folds pass a small state from chunk to chunk.

Both plans give the same rows.  ``_pos`` (0-based, dense per group) is always present.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.session import materialise

LIMIT_SETTING = "spark.cuesheet.maxGroupRows"
DEFAULT_LIMIT = 1_000_000
POS = "_pos"
CHUNK = "_chunk"
_ORDINAL_BITS = 33  # low bits of monotonically_increasing_id


@dataclass(frozen=True)
class Ordered:
    """A frame whose rows carry their position within ``keys``."""

    df: DataFrame
    keys: tuple[str, ...]
    chunked: bool
    limit: int

    @property
    def group(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else [*self.keys]

    def of(self, df: DataFrame) -> "Ordered":
        """The same arrangement over a frame with the same rows and order."""
        return replace(self, df=df)

    def select(self, *cols: Column | str) -> "Ordered":
        return self.of(self.df.select(*self.group, POS, *cols))

    def with_columns(self, cols: dict[str, Column]) -> "Ordered":
        return self.of(self.df.withColumns(cols))

    def plain(self) -> DataFrame:
        return self.df.drop(POS, CHUNK)

    def local(
        self, cols: dict[str, Callable[[WindowSpec], Column]], *, before: int = 0, after: int = 0
    ) -> "Ordered":
        """Window columns that look at most ``before``/``after`` rows away."""
        w = Window.partitionBy(*self.group).orderBy(POS)
        df = self.df
        if self.chunked and (before or after):
            df = self._with_edges(before, after)
        else:
            df = df.withColumn("_edge", F.lit(False)) if self.chunked else df
        df = df.withColumns({name: make(w) for name, make in cols.items()})
        if self.chunked:
            df = df.filter(~F.col("_edge")).drop("_edge")
        return self.of(df)

    def _with_edges(self, before: int, after: int) -> DataFrame:
        """Copy the last ``before`` rows of a chunk into the next, the first ``after`` into the one before."""
        offset = F.col(POS) % F.lit(self.limit)
        targets = F.array_compact(
            F.array(
                F.struct(F.col(CHUNK).alias("to"), F.lit(False).alias("edge")),
                F.when(
                    offset >= self.limit - before,
                    F.struct((F.col(CHUNK) + 1).alias("to"), F.lit(True).alias("edge")),
                ),
                F.when(
                    (offset < after) & (F.col(CHUNK) > 0),
                    F.struct((F.col(CHUNK) - 1).alias("to"), F.lit(True).alias("edge")),
                ),
            )
        )
        return (
            self.df.withColumn("_t", F.explode(targets))
            .withColumn(CHUNK, F.col("_t.to"))
            .withColumn("_edge", F.col("_t.edge"))
            .drop("_t")
        )

    def running(self, cols: dict[str, tuple[str, Column]], *, reverse: bool = False) -> "Ordered":
        """Running values from the first row of the group up to this one.

        ``cols`` maps a name to (kind, expression); kind is ``sum``, ``max``, ``min`` or
        ``last`` (the last non-null value).  ``reverse`` walks from the end.
        """
        along = F.desc(POS) if reverse else F.asc(POS)
        w = Window.partitionBy(*self.group).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        if not self.chunked:
            return self.with_columns({n: _total(kind, e).over(w) for n, (kind, e) in cols.items()})
        held = self.df.withColumns({f"_in_{n}": e for n, (_, e) in cols.items()})
        place = -F.col(POS) if reverse else F.col(POS)
        totals = held.groupBy(*self.group).agg(
            *[
                (
                    F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), place))
                    if kind == "last"
                    else _total(kind, F.col(f"_in_{n}"))
                ).alias(f"_tot_{n}")
                for n, (kind, _) in cols.items()
            ]
        )
        chunk_order = F.desc(CHUNK) if reverse else F.asc(CHUNK)
        cw = Window.partitionBy(*self.keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *self.group, *[_total(kind, F.col(f"_tot_{n}")).over(cw).alias(f"_carry_{n}") for n, (kind, _) in cols.items()]
        )
        here = held.withColumns({f"_here_{n}": _total(kind, F.col(f"_in_{n}")).over(w) for n, (kind, _) in cols.items()})
        joined = here.join(carry, self.group, "left")
        joined = joined.withColumns(
            {n: _combine(kind, F.col(f"_carry_{n}"), F.col(f"_here_{n}")) for n, (kind, _) in cols.items()}
        )
        helpers = [f"{p}{n}" for n in cols for p in ("_in_", "_here_", "_carry_")]
        return self.of(joined.drop(*helpers))

    def fold(
        self,
        name: str,
        inputs: dict[str, Column],
        step: Callable[..., tuple[int, int]],
        states: int,
    ) -> "Ordered":
        """Add an INT column from a left-to-right walk with a small integer state.

        ``step(state, *inputs) -> (state, value)``; state 0 is the start of a group and
        every state is below ``states``.  Rows stream through the task in order, so no
        group is held in memory.  For chunked groups each chunk is first reduced to the
        table "state at entry -> state at exit", the tables are chained, and the chunks
        are then walked independently from their true entry state.
        """
        args = [f"_arg{i}" for i in range(len(inputs))]
        held = self.df.withColumns(dict(zip(args, inputs.values())))
        every = self.limit if self.chunked else 0
        if self.chunked:
            keys = list(self.keys)
            narrow = held.select(*self.group, POS, *args).withColumn(
                "_last", F.lead(POS).over(Window.partitionBy(*self.group).orderBy(POS)).isNull()
            )
            table_schema = T.StructType(
                [*(held.schema[k] for k in self.group), T.StructField("table", T.ArrayType(T.IntegerType()))]
            )
            tables = _in_order(narrow, self.group, POS).mapInArrow(
                _exit_tables(step, args, self.group, states, every), table_schema
            )
            tables = tables.withColumn("_first", F.col(CHUNK) == 0)
            entry_schema = T.StructType([*(held.schema[k] for k in self.group), T.StructField("_entry", T.IntegerType())])
            entries = _in_order(tables, keys, CHUNK).mapInArrow(_entry_states(self.group), entry_schema)
            held = held.join(entries, self.group, "left")
        else:
            held = held.withColumn("_entry", F.lit(0))
        schema = T.StructType([*held.schema.fields, T.StructField(name, T.IntegerType())])
        out = _in_order(held, self.group, POS).mapInArrow(_walk(step, args, every), schema)
        return self.of(out.drop(*args, "_entry"))


def arrange(
    df: DataFrame,
    keys: Iterable[str] = ("media_id",),
    order: Iterable[str] = ("idx",),
    *,
    like: Ordered | None = None,
    limit: int | None = None,
) -> Ordered:
    """Number the rows of each key in ``order`` (which must be unique within the key).

    ``like`` is an arrangement these rows were derived from with a bounded number of rows
    each: its measurement is reused instead of counting again.
    """
    keys, order = tuple(keys), tuple(order)
    df = df.drop(POS, CHUNK)
    limit = limit or (like.limit if like else int(df.sparkSession.conf.get(LIMIT_SETTING, str(DEFAULT_LIMIT))))
    if like is not None and not like.chunked:
        hot, total = False, 0
    else:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
        hot = (largest or 0) > limit
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*order)
        return Ordered(df.withColumn(POS, F.row_number().over(w).cast("bigint") - 1), keys, False, limit)

    # The order is unique, so range partitions stay balanced however hot one key is.
    parts = max(2, math.ceil(total / limit))
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = materialise(ranged.withColumn("_slot", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_slot", _ORDINAL_BITS))
    runs = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_from"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = (
        ranged.join(runs, [*keys, "_part"])
        .withColumn(POS, F.col("_base") + F.col("_slot") - F.col("_from"))
        .withColumn(CHUNK, F.expr(f"{POS} div {limit}"))
        .drop("_slot", "_part", "_from", "_base")
    )
    return Ordered(placed, keys, True, limit)


def as_ordered(rows: DataFrame | Ordered, order: Sequence[str] = ("idx",), keys: Sequence[str] = ("media_id",)) -> Ordered:
    return rows if isinstance(rows, Ordered) else arrange(rows, keys, order)


def _total(kind: str, e: Column) -> Column:
    if kind == "last":
        return F.last(e, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](e)


def _combine(kind: str, carry: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
    if kind == "last":
        return F.coalesce(here, carry)
    return (F.greatest if kind == "max" else F.least)(carry, here)


def _in_order(df: DataFrame, group: list[str], order: str) -> DataFrame:
    return df.repartition(*group).sortWithinPartitions(*group, order)


def _walk(step, args, every):
    def run(batches):
        import pyarrow as pa

        state = 0
        for batch in batches:
            columns = [batch.column(a).to_pylist() for a in args]
            positions = batch.column(POS).to_pylist()
            entries = batch.column("_entry").to_pylist()
            values = []
            for pos, entry, *row in zip(positions, entries, *columns):
                if pos == 0 or (every and pos % every == 0):
                    state = entry
                state, value = step(state, *row)
                values.append(value)
            arrays = [*batch.columns, pa.array(values, pa.int32())]
            names = [*batch.schema.names, "value"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _exit_tables(step, args, group, states, every):
    def run(batches):
        import pyarrow as pa

        alive: dict[int, list[int]] = {}
        for batch in batches:
            columns = [batch.column(a).to_pylist() for a in args]
            keys = list(zip(*[batch.column(g).to_pylist() for g in group]))
            positions = batch.column(POS).to_pylist()
            lasts = batch.column("_last").to_pylist()
            done = []
            for key, pos, last, *row in zip(keys, positions, lasts, *columns):
                if pos % every == 0:
                    alive = {s: [s] for s in range(states)}
                moved: dict[int, list[int]] = {}
                for state, origins in alive.items():
                    after, _ = step(state, *row)
                    moved.setdefault(after, []).extend(origins)
                alive = moved
                if last:
                    table = [0] * states
                    for state, origins in alive.items():
                        for origin in origins:
                            table[origin] = state
                    done.append((*key, table))
            if done:
                parts = list(zip(*done))
                arrays = [pa.array(p, batch.schema.field(g).type) for p, g in zip(parts, group)]
                arrays.append(pa.array(parts[-1], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*group, "table"])

    return run


def _entry_states(group):
    def run(batches):
        import pyarrow as pa

        state = 0
        for batch in batches:
            out = []
            for table, first in zip(batch.column("table").to_pylist(), batch.column("_first").to_pylist()):
                if first:
                    state = 0
                out.append(state)
                state = table[state]
            arrays = [*(batch.column(g) for g in group), pa.array(out, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*group, "_entry"])

    return run
