"""Order-sensitive operators that never put a whole group into one task.

A plain ``Window.orderBy`` sends every row of its partition to one task, which
is fatal for a global order or for a key that holds a third of the data. Here
the rows are range-partitioned by (keys, order); each slice is scanned on its
own, and the slices are stitched together by a table with one row per
(slice, key), whose size depends on the number of partitions and not on the
data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantgauge.session import cut_lineage

SLICE = "_slice"

# Groups up to this many rows keep all their values when a percentile is taken;
# above it a sketch first narrows the values down (see ``percentiles``).
SMALL_GROUP = 20_000
SKETCH_ACCURACY = 10_000
BRACKET = 0.002


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Range-partition by (keys, order) and number the slices.

    The result is written to the shared folder: the slice numbers come from a
    sampled range partitioning, and both readers of them must see the same ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def _stitch(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the per-slice carry back by (slice, keys), null keys included."""
    right = carry.select(
        F.col(SLICE).alias("_r_slice"),
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in carry.columns if c != SLICE and c not in keys],
    )
    on = F.col(SLICE) == F.col("_r_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    if not keys:
        right = F.broadcast(right)  # one row per slice
    return rows.join(right, on, "inner").drop("_r_slice", *[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column | str],
    slice_by: Column | None = None,
) -> DataFrame:
    """Add ``before_<name>`` and ``total_<name>`` for each named measure.

    ``before_`` is the sum over the rows of the same key that come strictly
    earlier; (keys, order) must identify a row. ``slice_by`` may give a slice
    that is already known to follow the order and to be even (such as the
    leading digits of a hash): then nothing has to be materialised.
    """
    measures = {n: (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    rows = df.withColumns({f"_m_{n}": c for n, c in measures.items()})
    rows = sliced(rows, keys, order) if slice_by is None else rows.withColumn(SLICE, slice_by)

    earlier = Window.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_m_{n}").over(earlier), F.lit(0)) for n in measures})

    per_slice = rows.groupBy(SLICE, *keys).agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in measures])
    whole = Window.partitionBy(*keys)
    up_to = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(
        SLICE,
        *keys,
        *[F.coalesce(F.sum(f"_s_{n}").over(up_to), F.lit(0)).alias(f"_c_{n}") for n in measures],
        *[F.sum(f"_s_{n}").over(whole).alias(f"total_{n}") for n in measures],
    )
    out = _stitch(inside, carry, keys)
    out = out.withColumns({f"before_{n}": F.col(f"_in_{n}") + F.col(f"_c_{n}") for n in measures})
    return out.drop(SLICE, *[f"_{p}_{n}" for p in ("m", "in", "c") for n in measures])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "row_index") -> DataFrame:
    """0-based position within each key, and ``total_rows``."""
    out = running(df, keys, order, {"rows": F.lit(1).cast("long")})
    return out.withColumnRenamed("before_rows", name)


def mid_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | None = None,
    rank: str = "rank",
    bounded: bool = False,
) -> DataFrame:
    """Ranks with average ties, one row per (keys, value).

    Equal values are counted before anything is ordered, so a value that holds
    a third of the rows is one row here. ``bounded`` says the caller has checked
    that every key has few enough rows for an ordinary window.
    Columns: keys, value, <rank>, ties.
    """
    ties = F.sum(weight) if weight else F.count(F.lit(1))
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(ties.alias("ties"))
    if bounded:
        w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before_n", F.coalesce(F.sum("ties").over(w), F.lit(0)))
    else:
        hist = running(hist, keys, [value], {"n": "ties"})
    return hist.select(*keys, value, "ties", (F.col("before_n") + (F.col("ties") + 1) / F.lit(2.0)).alias(rank))


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key.

    Pass one sketches where each percentile must lie; pass two keeps only the
    values in that narrow bracket and counts everything else, so a group of any
    size shuffles a fraction of a percent of its values. The sketch's rank error
    (1/accuracy) is far smaller than the bracket, which makes the result exact.
    Columns: keys, n, then one per entry of ``probs``.
    """
    names = sorted(probs, key=lambda n: probs[n])
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    marks = []
    for name in names:
        marks += [max(0.0, probs[name] - BRACKET), min(1.0, probs[name] + BRACKET)]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", marks, SKETCH_ACCURACY).alias("_marks"),
    )
    if keys:
        right = sketch.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_n", "_marks")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        rows = rows.join(right, on, "inner").drop(*[f"_r_{k}" for k in keys])
        n_col, marks_col = F.col("_n"), F.col("_marks")
    else:
        both = sketch.select(F.struct("_n", "_marks")).scalar()
        n_col, marks_col = both["_n"], both["_marks"]

    keep_all = n_col <= SMALL_GROUP
    kept = keep_all
    zone = F.lit(0)
    for j in range(len(names)):
        low, high = marks_col[2 * j], marks_col[2 * j + 1]
        kept = kept | F.col("_v").between(low, high)
        zone = zone + (F.col("_v") >= low).cast("int") + (F.col("_v") > high).cast("int")
    zoned = rows.select(
        *keys,
        F.when(keep_all, 0).otherwise(zone).alias("_zone"),
        F.when(kept, F.col("_v")).alias("_v"),
    )
    hist = zoned.groupBy(*keys, "_zone", "_v").agg(F.count(F.lit(1)).alias("_k"))
    walked = running(hist, keys, ["_zone", "_v"], {"k": "_k"})

    last = F.col("total_k") - 1
    picks = []
    for name in names:
        at = last * F.lit(float(probs[name]))
        for tag, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("before_k") <= place) & (place < F.col("before_k") + F.col("_k"))
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{tag}_{name}"))
    found = walked.groupBy(*keys).agg(F.max("total_k").alias("n"), *picks)
    out = []
    for name in names:
        at = (F.col("n") - 1) * F.lit(float(probs[name]))
        part = at - F.floor(at)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * part).alias(name))
    return found.select(*keys, "n", *out)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column, None if all null.

    Like :func:`percentiles` with the column name as key, but the sketches of all
    columns come out of one plain aggregate: a row of marks that becomes literals.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    marks = [0.5 - BRACKET, 0.5 + BRACKET]
    sketch = df.agg(
        *[F.count(v).alias(f"n_{i}") for i, v in enumerate(values.values())],
        *[F.percentile_approx(v, marks, SKETCH_ACCURACY).alias(f"m_{i}") for i, v in enumerate(values.values())],
    ).first()
    entries = []
    for i, (c, v) in enumerate(values.items()):
        if not sketch[f"n_{i}"]:
            continue
        zone, kept = F.lit(0), v
        if sketch[f"n_{i}"] > SMALL_GROUP:
            low, high = sketch[f"m_{i}"]
            zone = (v >= low).cast("int") + (v > high).cast("int")
            kept = F.when(v.between(low, high), v)
        entries.append(F.when(v.isNotNull(), F.struct(F.lit(c).alias("name"), zone.alias("zone"), kept.alias("v"))))
    if not entries:
        return {c: None for c in columns}
    rows = df.select(F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull()).select("e.*")
    hist = rows.groupBy("name", "zone", "v").agg(F.count(F.lit(1)).alias("k"))
    walked = running(hist, ["name"], ["zone", "v"], {"k": "k"})
    last = F.col("total_k") - 1

    def at(place):
        return F.max(F.when((F.col("before_k") <= place) & (place < F.col("before_k") + F.col("k")), F.col("v")))

    half = last * F.lit(0.5)
    found = walked.groupBy("name").agg(((at(F.floor(half)) + at(F.ceil(half))) / 2.0).alias("median")).collect()
    by_name = {row["name"]: row["median"] for row in found}  # one row per column
    return {c: by_name.get(c) for c in columns}


def filled(df: DataFrame, row_key: Sequence[str], value: str, default) -> DataFrame:
    """Last known value in ``row_key`` order, else the next one, else ``default``.

    Only the order key and the value are sorted, and only the rows that lacked a
    value are joined back. ``row_key`` must identify a row.
    """
    narrow = sliced(df.select(*row_key, value), [], list(row_key))
    back = Window.partitionBy(SLICE).orderBy(*row_key).rowsBetween(Window.unboundedPreceding, 0)
    inside = narrow.withColumn("_prev", F.last(value, ignorenulls=True).over(back)).where(F.col(value).isNull())
    key = F.struct(*row_key)
    known = F.col(value).isNotNull()
    ends = narrow.groupBy(SLICE).agg(
        F.max_by(F.when(known, F.col(value)), F.when(known, key)).alias("_last"),
        F.min_by(F.when(known, F.col(value)), F.when(known, key)).alias("_first"),
    )
    slices = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    carry = ends.select(SLICE, F.last("_last", ignorenulls=True).over(slices).alias("_c_prev"))
    # what a forward fill leaves open comes before every known value, so the first one fills it
    first = ends.agg(F.min_by("_first", F.when(F.col("_first").isNotNull(), F.col(SLICE)))).scalar()
    gaps = _stitch(inside, carry, []).select(
        *[F.col(k).alias(f"_r_{k}") for k in row_key], F.coalesce(F.col("_prev"), F.col("_c_prev"), first).alias("_fill")
    )
    return patched(df, row_key, value, gaps, F.coalesce(F.col("_fill"), F.lit(default).cast(df.schema[value].dataType)))


def patched(df: DataFrame, row_key: Sequence[str], value: str, gaps: DataFrame, fill: Column) -> DataFrame:
    """Put ``fill`` where ``value`` is null. ``gaps`` has one row per such row, its key
    prefixed with _r_. Rows that have a value never move; only the others are joined."""
    on = F.lit(True)
    for k in row_key:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    lacking = df.where(F.col(value).isNull()).join(gaps, on, "left").withColumn(value, fill).select(*df.columns)
    return df.where(F.col(value).isNotNull()).unionByName(lacking)
