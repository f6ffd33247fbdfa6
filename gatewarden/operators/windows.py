"""Look-back windows per key: every row sees the rows of its key not older than the window, and itself.

The lower bound is inclusive. Rows of equal time are ordered by ``seq``: a row does not see those after
it. Keys are cut into blocks of time that overlap by the longest window (the halo), so a key with a third
of all rows is spread over tasks; all windows of a key share the one exchange by (key, block).

Sums and distinct counts come from a sweep: each row puts its values in at its time and takes them out
when the window has passed, and one running sum over these marks, in order, gives all of a key's windows
at once. So no row looks at its window again, and the cost does not depend on how full windows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewarden.workspace import shuffle_width

BLOCK, HALO = "__block", "__halo"


def blocked(df: DataFrame, key: str, halo_ms: int, block_ms: int | None = None) -> DataFrame:
    """Rows with a key and a time, each in its block and, if the next block can see it, there as halo."""
    size = max(block_ms or 8 * halo_ms, halo_ms, 1)
    own = F.floor(F.col("ts") / size)
    reaches = F.floor((F.col("ts") + halo_ms) / size)
    return (
        df.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
        .withColumn(BLOCK, F.explode(F.sequence(own, reaches)))
        .withColumn(HALO, F.col(BLOCK) != F.floor(F.col("ts") / size))
        .repartition(shuffle_width(df.sparkSession), F.col(key), F.col(BLOCK))  # the work is per row, not per byte, so small partitions are not joined
    )


def unblocked(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(BLOCK, HALO)


def first_seen(key: str, value: str, window_ms: int) -> Column:
    """Whether the value did not occur in the window before this row."""
    before = F.lag("ts").over(Window.partitionBy(key, BLOCK, value).orderBy("ts", "seq"))
    return before.isNull() | (before < F.col("ts") - window_ms)


def with_windows(df: DataFrame, key: str, sums: dict[str, tuple[Column, int]], distinct: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds sums (name: value, window) and distinct counts (name: column, window) in one sweep.

    Null values add nothing. Columns of the row travel with the mark at its own time only.
    """
    for value in dict.fromkeys(v for v, _ in distinct.values()):
        mine = Window.partitionBy(key, BLOCK, value).orderBy("ts", "seq")
        df = df.withColumn(f"__before_{value}", F.lag("ts").over(mine)).withColumn(f"__after_{value}", F.lead("ts").over(mine))
    entering, leaving = {}, {}
    for name, (value, window) in sums.items():
        entering[name] = F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))
        leaving.setdefault(window, {})[name] = -entering[name]
    for name, (value, window) in distinct.items():
        there, before, after = F.col(value).isNotNull(), F.col(f"__before_{value}"), F.col(f"__after_{value}")
        enters = there & (before.isNull() | (before < F.col("ts") - window))
        leaves = there & (after.isNull() | (after > F.col("ts") + window))
        entering[name] = F.when(enters, 1).otherwise(0).cast("bigint")
        leaving.setdefault(window, {})[name] = F.when(leaves, -1).otherwise(0).cast("bigint")
    names = list(entering)
    kept = [c for c in df.columns if not c.startswith(("__before_", "__after_"))]
    row = F.struct(*[F.col(c) for c in kept])
    nothing = F.when(F.lit(False), row)
    zero = F.lit(0).cast("bigint")
    marks = [F.struct(F.col("ts").alias("t"), F.col("seq").cast("bigint").alias("s"), *[entering[n].alias(n) for n in names], row.alias("row"))]
    for window, parts in leaving.items():
        marks.append(F.struct((F.col("ts") + window + 1).alias("t"), F.lit(-1).cast("bigint").alias("s"), *[parts.get(n, zero).alias(n) for n in names], nothing.alias("row")))
    swept = df.select(F.col(key).alias("__key"), F.col(BLOCK).alias("__b"), F.explode(F.array(*marks)).alias("m"))
    # marks that change nothing are not sorted
    swept = swept.where(F.col("m.row").isNotNull() | F.greatest(*[F.abs(F.col(f"m.{n}")) for n in names], zero).cast("boolean"))
    order = Window.partitionBy("__key", "__b").orderBy("m.t", "m.s").rowsBetween(Window.unboundedPreceding, 0)
    return swept.select("m.row", *[F.sum(f"m.{n}").over(order).alias(f"__out_{n}") for n in names]).where("row is not null").select("row.*", *[F.col(f"__out_{n}").alias(n) for n in names])


def with_distinct(df: DataFrame, key: str, value: str, window_ms: int, out: str) -> DataFrame:
    """Adds the number of distinct values in the window; null values do not count."""
    return with_windows(df, key, {}, {out: (value, window_ms)})


def regular_cadence(key: str, window_ms: int, drift_ms: int, n: int = 4) -> Column:
    """Whether the last ``n`` rows lie in the window at nearly equal gaps, none of them zero."""
    order = Window.partitionBy(key, BLOCK).orderBy("ts", "seq")
    at = [F.col("ts")] + [F.lag("ts", i).over(order) for i in range(1, n)]
    gaps = [at[i] - at[i + 1] for i in range(n - 1)]
    regular = (at[-1] >= F.col("ts") - window_ms) & (F.greatest(*gaps) - F.least(*gaps) <= drift_ms) & (F.least(*gaps) > 0)
    return F.coalesce(regular, F.lit(False))


def codes(t: pa.Table, c: str) -> np.ndarray:
    """A column's values; numbers for its texts, equal for equal ones, if it is encoded."""
    col = t[c].unify_dictionaries()
    return np.concatenate([x.indices.to_numpy() for x in col.chunks]) if pa.types.is_dictionary(col.type) else col.to_numpy()


def key_changes(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Whether the row after each row but the last has another key."""
    return np.any([(x := codes(t, k))[1:] != x[:-1] for k in keys], axis=0)


def whole_keys(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = 1 << 17) -> Iterator[pa.Table]:
    """The sorted rows in tables that end with a key; of ``least`` rows or more, but for the last. Texts are encoded."""
    held, want = None, least
    for batch in batches:
        part = pa.Table.from_batches([batch])
        for i, f in enumerate(part.schema):
            if pa.types.is_string(f.type) or pa.types.is_large_string(f.type):
                part = part.set_column(i, f.name, part[f.name].dictionary_encode())
        held = pa.concat_tables([held, part]) if held else part
        if held.num_rows < want:
            continue
        cut = int(np.flatnonzero(np.append(True, key_changes(held, keys)))[-1])
        if cut:
            yield held.slice(0, cut)
        held = held.slice(cut)
        want = max(least, 2 * held.num_rows)
    if held:
        yield held
