"""Ordered work that stays bounded per task when one key holds a large share of the rows.

A window partitioned by a key sends all rows of the key to one task.  That is the right plan
for ordinary keys.  For keys with more than ``CHUNK_ROWS`` rows the functions below cut the
ordered rows of the key into chunks with exact row offsets and give each chunk the few
neighbouring rows its frames reach into, so the result is the same and no task sees more
than about one chunk.

Rows of one (key, order value) pair that are too many for a task are cut at approximate quantiles of
the tie-break columns, in their order: NULL first, then numbers, infinities and NaN as a window sorts
them, texts and binary values by their bytes from where those of a slot first differ.  Rows that agree in
all tie-break columns stand in no order, and are dealt by a hash of the row.  The number of passes has a
bound that does not depend on the values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gameline.operators.positions import positions
from gameline.session import cut

CHUNK_ROWS = 4_000_000
PIECES = 64
PASSES_A_KEY = 2
TEXT_BYTES = 6
TEXT_PASSES = 32

Build = Callable[[WindowSpec], dict[str, Column]]


def same(names: Sequence[str], renamed: Sequence[str]) -> Column:
    """NULL-safe equality of two column lists."""
    cond = F.lit(True)
    for a, b in zip(names, renamed):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def _keyed(df: DataFrame, keys: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """Rename the key columns so that the frame can be joined back to its own source."""
    renamed = [f"{prefix}{i}" for i in range(len(keys))]
    rest = [c for c in df.columns if c not in keys]
    return df.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], *rest), renamed


def by_heat(df: DataFrame, keys: Sequence[str], ordinary: Callable[[DataFrame], DataFrame],
            hot: Callable[[DataFrame], DataFrame], max_rows: int = CHUNK_ROWS,
            bound: DataFrame | None = None) -> DataFrame:
    """Run ``ordinary`` on the rows of keys with up to ``max_rows`` rows and ``hot`` on the rest.

    ``bound`` is an optional cheaper frame to count in: it has the key columns and at least as many
    rows per key as ``df``, such as the table ``df`` was joined from.

    One small job decides: it reads the key columns only and brings back a yes or no.  Without
    hot keys the plan is ``ordinary`` alone, so chained operators keep short plans.
    """
    counted = df if bound is None else bound
    found = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    if found.isEmpty():
        return ordinary(df)
    found, renamed = _keyed(found.select(*keys), keys, "_hot")
    cond = same(keys, renamed)
    # the hot rows are read several times, so they are written once where the cluster has a folder for it
    return ordinary(df.join(found, cond, "left_anti")).unionByName(
        hot(cut(df.join(found, cond, "left_semi"))))


def _numbers(c: Column, kind: T.DataType) -> list[Column] | None:
    """Doubles that ascend, not strictly, with a column's values and together tell them apart; none for other types."""
    if isinstance(kind, T.LongType):
        return [F.shiftright(c, 32).cast("double"), c.bitwiseAND(0xFFFFFFFF).cast("double")]
    if isinstance(kind, T.BooleanType):
        return [c.cast("int").cast("double")]
    if isinstance(kind, T.DecimalType):
        exact, out = T.DecimalType(min(38, kind.precision + 1), kind.scale), []
        for _ in range(3):  # what a double leaves of a decimal fits into two more
            out.append(c.cast("double"))
            c = c.cast(exact) - c.cast("double").cast(exact)
        return out
    if isinstance(kind, T.NumericType):
        return [c.cast("double")]
    if isinstance(kind, T.DateType):
        return [F.unix_date(c).cast("double")]
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(c).cast("double")]
    return None


def _full(binned: DataFrame, place: Sequence[str], slot_rows: int) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """The slots that hold too many rows, and those rows; nothing where there are none."""
    full = binned.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slot_rows).drop("_n")
    full, renamed = _keyed(cut(full), place, "_full")
    return None if full.isEmpty() else (binned.join(full, same(place, renamed), "left_semi"), full, renamed)


def _cut_at(binned: DataFrame, crowded: DataFrame, place: Sequence[str], x: Column, given: Sequence[str] = ()) -> DataFrame:
    """Append to the path of crowded rows which of up to ``PIECES`` ranges of ``x`` they are in, NULL first and NaN last.

    ``given`` are columns of ``crowded``, one value for each place, that ``x`` is made of.
    """
    points = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
    number = F.when(~F.isnan(x), x)
    found = F.coalesce(F.percentile_approx(number, points, F.lit(1000)), F.array().cast("array<double>"))
    # a value that fills whole ranges gets one of its own: the next number begins another
    ends = F.array_sort(F.array_distinct(F.concat(found, F.transform(found, lambda p: p + 1))))
    points_of = crowded.groupBy(*place).agg(ends.alias("_points"), *[F.first(c).alias(c) for c in given])
    points_of, renamed = _keyed(cut(points_of), place, "_full")
    part = (F.when(x.isNull(), F.lit(-1)).when(F.isnan(x), F.lit(2 * PIECES))
            .otherwise(F.size(F.filter("_points", lambda p: p <= x))))
    deeper = F.concat("_bin", F.array(part.cast("bigint")))
    return (binned.join(points_of, same(place, renamed), "left")
            .withColumn("_bin", F.when(F.col("_points").isNotNull(), deeper).otherwise(F.col("_bin")))
            .drop("_points", *renamed, *given))


def _cut_bytes(binned: DataFrame, place: Sequence[str], name: str, slot_rows: int) -> DataFrame:
    """Cut crowded slots by the bytes of a text or binary column.

    The smallest and the largest value of a slot begin alike as far as all its values do, so the bytes after
    that decide; a slot whose values are all equal is left.
    """
    data = F.col(name).cast("binary")
    for _ in range(TEXT_PASSES):
        found = _full(binned, place, slot_rows)
        if found is None:
            return binned
        crowded = found[0].withColumn("_hex", F.hex(data))
        low, high = F.min("_hex"), F.max("_hex")
        differs = F.array_position(F.zip_with(F.split(low, ""), F.split(high, ""), lambda a, b: ~a.eqNullSafe(b)), True)
        begins = F.when(differs > 0, F.floor((differs - 1) / 2).cast("int") + 1).when(F.count("_hex") < F.count(F.lit(1)), F.lit(1))
        starts, renamed = _keyed(cut(crowded.groupBy(*place).agg(begins.alias("_from"), F.count("_hex").alias("_texts"))
                                     .where(F.col("_from").isNotNull() & (F.col("_texts") > 0)).drop("_texts")), place, "_start")
        if starts.isEmpty():
            return binned
        crowded = crowded.drop("_hex").join(starts, same(place, renamed)).drop(*renamed)
        some = F.substring(data, F.col("_from"), F.lit(TEXT_BYTES))
        # six bytes as a number, then how many there are: a text sorts before its own continuation
        x = (F.conv(F.rpad(F.hex(some), 2 * TEXT_BYTES, "0"), 16, 10).cast("long") * 8 + F.octet_length(some)).cast("double")
        binned = _cut_at(binned, crowded, place, x, ["_from"])
    return binned


def _slots(rows: DataFrame, keys: Sequence[str], order: str, seq: Sequence[str],
           slot_rows: int) -> DataFrame:
    """Add ``_bin``: the path of value ranges of the tie-break columns that holds the row, empty where none is needed.

    A (keys, order) pair with more than ``slot_rows`` rows is cut into ranges of the first tie-break column, a range
    that is still too full is cut once more, then by the next column.  Rows that agree in all of them are
    dealt by a hash.  Paths sort like the rows they hold.
    """
    place = [*keys, order, "_bin"]
    binned = rows.withColumn("_bin", F.array().cast("array<bigint>"))
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    for name in [*seq, None]:
        kind = rows.schema[name].dataType if name else None
        if isinstance(kind, (T.StringType, T.BinaryType)):
            binned = _cut_bytes(binned, place, name, slot_rows)
            continue
        numbers = _numbers(F.col(name), kind) if name else [F.xxhash64(*[F.col(c) for c in plain]).cast("double")]
        if numbers is None:
            return binned  # a type whose order is not known here
        for x in [n for n in numbers for _ in range(PASSES_A_KEY)]:
            found = _full(binned, place, slot_rows)
            if found is None:
                return binned
            binned = _cut_at(binned, found[0], place, x)
    return binned


def with_frames(df: DataFrame, keys: Sequence[str], order: str, seq: Sequence[str], build: Build,
                lookback: int = 0, lookahead: int = 0, chunk_rows: int = CHUNK_ROWS,
                bound: DataFrame | None = None) -> DataFrame:
    """Add window columns whose frames reach at most ``lookback`` rows back and ``lookahead`` forward.

    ``build`` gets the window (partitioned by the key, ordered by ``order`` then ``seq``) and
    returns the new columns.  ``order`` + ``seq`` should be unique per key.
    """

    def ordinary(rows: DataFrame) -> DataFrame:
        return rows.withColumns(build(Window.partitionBy(*keys).orderBy(order, *seq)))

    def hot(rows: DataFrame) -> DataFrame:
        binned = _slots(rows, keys, order, seq, max(1, chunk_rows // 4))
        place = [*keys, order, "_bin"]
        w = Window.partitionBy(*keys).orderBy(order, "_bin")
        slots = (binned.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
                 .withColumn("_end", F.sum("_n").over(w))
                 .withColumn("_start", F.col("_end") - F.col("_n"))
                 .withColumn("_piece", F.floor(F.col("_start") / F.lit(chunk_rows)))
                 .withColumn("_chunk", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_piece"))))
        # every slot has a row, so the slots that reach into a chunk are within this many slots of it
        near = F.struct("_start", "_end", "_chunk")
        slots = (slots
                 .withColumn("_next", F.collect_list(near).over(w.rowsBetween(1, max(lookback, 1))))
                 .withColumn("_prev", F.collect_list(near).over(w.rowsBetween(-max(lookahead, 1), -1)))
                 .withColumn("_last", F.array_max(F.transform(
                     F.filter("_next", lambda s: s["_start"] < F.col("_end") + lookback),
                     lambda s: s["_chunk"])))
                 .withColumn("_first", F.array_min(F.transform(
                     F.filter("_prev", lambda s: s["_end"] > F.col("_start") - lookahead),
                     lambda s: s["_chunk"])))
                 .select(*place, "_chunk",
                         F.sequence(F.coalesce("_first", "_chunk"), F.coalesce("_last", "_chunk")).alias("_into")))
        slots, renamed = _keyed(slots, place, "_slot")
        copies = (binned.join(slots, same(place, renamed))
                  .drop("_bin", *renamed)
                  .withColumn("_into", F.explode("_into")))
        framed = copies.withColumns(build(Window.partitionBy(*keys, "_into").orderBy(order, *seq)))
        return framed.where(F.col("_into") == F.col("_chunk")).drop("_into", "_chunk")

    return by_heat(df, keys, ordinary, hot, chunk_rows, bound)


def running_totals(df: DataFrame, keys: Sequence[str], order: str, seq: Sequence[str],
                   sums: dict[str, str], ordinal: str = "ordinal",
                   slot_rows: int = CHUNK_ROWS // 4) -> DataFrame:
    """Inclusive running sums and a 1-based row number in (order, seq) order, for each key or overall.

    Sums are taken per (key, order value) first, so the only window that sees a whole key runs over those
    totals: one row per order value plus one per ``slot_rows`` rows.  Without keys the whole table is
    numbered by a two-level scan.
    """
    if not keys:
        plain = [F.col(f.name) for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        return positions(df, [order, *seq, F.xxhash64(*plain)], ordinal, sums=sums)
    binned = _slots(df, keys, order, seq, slot_rows)
    place = [*keys, order, "_bin"]
    totals = {f"_t{i}": F.coalesce(F.sum(c), F.lit(0)) for i, c in enumerate(sums.values())}
    slots = binned.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in totals.items()])
    w = (Window.partitionBy(*keys).orderBy(order, "_bin")
         .rowsBetween(Window.unboundedPreceding, -1))
    before = {f"_b{n}": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in ["_n", *totals]}
    slots, renamed = _keyed(slots.withColumns(before).drop("_n", *totals), place, "_slot")
    joined = binned.join(slots, same(place, renamed))
    inside = Window.partitionBy(*renamed).orderBy(*seq)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = {ordinal: F.col("_b_n") + F.row_number().over(inside)}
    for i, (name, source) in enumerate(sums.items()):
        out[name] = F.col(f"_b_t{i}") + F.coalesce(F.sum(source).over(so_far), F.lit(0))
    return joined.withColumns(out).drop("_bin", *renamed, *before)
