"""Joins and windows over time: last reading before a moment, points inside spans, sums over
the time just passed.

None of them sorts a whole key in one task: rows are range-partitioned by (keys, time) and
slices are stitched by one row per slice and key, or rows meet in bins of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantgauge.operators.bounds import row_count
from plantgauge.operators.prefix import SLICE, _stitch, numbered, running, sliced
from plantgauge.session import cut_lineage

# widths of the bins grow by this factor from level to level; a span takes so many bins at most
LEVEL_FACTOR = 4
LEVELS = 15
# cells of a node, and nodes of one of the next level
NODE_FACTOR = 16


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, values: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """Every row of ``left`` with the ``values`` (and ``right_time``) of the last row of ``right``
    that has the same keys and a time not after its own.

    One sort of both tables by (keys, time) and one pass; the last reading of a slice is
    carried into the next ones, so a key that holds a third of the rows is cut like any other.
    Of several rows of ``right`` at one time the one greatest in ``tie``, then in ``values``,
    counts; null values are values. Left rows with a null key or time, or without an earlier reading,
    are kept with nulls. Right rows with a null key or time are left out.
    """
    keys = list(keys)
    known = F.struct(F.col(right_time), *[F.col(t) for t in tie], *[F.col(v) for v in values])
    fields = [f"_f{i}" for i in range(1 + len(tie) + len(values))]
    kind = right.select(known.alias("k")).schema["k"].dataType
    named = "struct<" + ",".join(f"{n}:{f.dataType.simpleString()}" for n, f in zip(fields, kind.fields)) + ">"
    usable = lambda df, at: df.where(F.col(at).isNotNull()).dropna(subset=keys)
    names = left.columns
    moments = left.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_left"), *keys, F.col(time).alias("_t"))
    whole = F.col("_t").isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    readings = usable(right, right_time).select(
        F.lit(None).cast(moments.schema["_left"].dataType).alias("_left"), *keys, F.col(right_time).alias("_t"),
        known.cast(named).alias("_known"),
    )
    both = moments.where(whole).withColumn("_known", F.lit(None).cast(named)).unionByName(readings)
    both = sliced(both.withColumn("_asks", F.col("_left").isNotNull()), keys, ["_t"])
    # at one time readings come first, the greatest of them last
    upto = Window.partitionBy(SLICE, *keys).orderBy("_t", "_asks", F.col("_known").asc_nulls_last())
    inside = both.withColumn(
        "_in", F.last("_known", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    last = F.max(F.when(~F.col("_asks"), F.struct("_t", "_known")))
    per_slice = both.groupBy(SLICE, *keys).agg(last.alias("_last"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    carry = per_slice.select(SLICE, *keys, F.last("_last._known", ignorenulls=True).over(before).alias("_carried"))
    found = _stitch(inside.where("_asks"), carry, keys).select("_left", F.coalesce("_in", "_carried").alias("_known"))
    out = found.unionByName(moments.where(~F.coalesce(whole, F.lit(False))).select("_left", F.lit(None).cast(named).alias("_known")))
    picked = [F.col(f"_known._f{1 + len(tie) + i}").alias(v) for i, v in enumerate(values)]
    return out.select("_left.*", F.col("_known._f0").alias(right_time), *picked)


def level_of(length: Column, width: int) -> Column:
    """The level of bins at which a span of ``length`` microseconds takes at most ``LEVEL_FACTOR`` + 1."""
    steps = F.log(F.greatest(length / float(width * LEVEL_FACTOR), F.lit(1.0))) / F.log(F.lit(float(LEVEL_FACTOR)))
    return F.least(F.lit(LEVELS), F.ceil(steps)).cast("int")


def micros(moment: str) -> Column:
    return F.unix_micros(F.col(moment).cast("timestamp"))


def bin_start(moment: Column, wide: Column) -> Column:
    return moment - F.pmod(moment, wide)


def points_in_spans(
    points: DataFrame, spans: DataFrame, time: str, start: str, end: str, keys: Sequence[str] = (), width: int = 600
) -> DataFrame:
    """Pairs of a span and a point with the same keys and start <= time < end; all columns of both,
    names must differ but for the keys.

    A span takes a few bins of the level that suits its length, a point one bin of every level
    that occurs, so both meet in exactly one bin and by an equality join: a bin with many rows
    is split by adaptive execution, a long span costs no more bins than a short one. Null keys
    or times and spans that do not end after their start meet nothing.
    """
    keys = list(keys)
    base = width * 1_000_000
    first, last = micros(start), micros(end) - 1
    cut = spans.where(F.col(start) < F.col(end)).withColumn("_level", level_of(last - first, base))
    wide = (F.lit(base) * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("_level"))).cast("long")
    binned = cut.withColumn("_bin", F.explode(F.sequence(bin_start(first, wide), bin_start(last, wide), wide)))
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())  # LEVELS + 1 at most
    at = [
        F.struct(F.lit(n).alias("_level"), bin_start(micros(time), F.lit(base * LEVEL_FACTOR**n)).alias("_bin"))
        for n in levels or [0]
    ]
    spread = points.where(F.col(time).isNotNull()).withColumn("_at", F.explode(F.array(*at)))
    spread = spread.withColumns({"_level": F.col("_at._level"), "_bin": F.col("_at._bin")}).drop("_at")
    met = spread.join(binned, [*keys, "_level", "_bin"])
    return met.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_level", "_bin")


def span_totals(points: DataFrame, spans: DataFrame, time: str, start: str, end: str, item: str, value: str) -> DataFrame:
    """The columns of ``spans`` with n, items and total over the points with start <= time < end:
    their number, their distinct ``item`` and the sum of ``value``. Spans without a point are left out.

    Pairs of a span and a point are never listed. The moments where spans start or end cut time into
    cells; ``NODE_FACTOR`` cells make a node, as many nodes one of the next level. A span is a few
    nodes of each level, a point lies in one. An item counts in a span with its first point there,
    whose previous cell is before the span, so per node one running count over the previous
    cells answers all spans. A span that stands in several rows counts its points as often, its items once.
    """
    names = spans.columns
    held = spans.where(F.col(start) < F.col(end)).groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    held = cut_lineage(held.withColumn("_span", F.monotonically_increasing_id()))
    bounds = held.select(F.explode(F.array(micros(start), micros(end))).alias("_at")).distinct()
    bounds = cut_lineage(numbered(bounds, [], ["_at"], "_cell").select("_at", "_cell"))
    cells = row_count(bounds)
    levels = 1
    while NODE_FACTOR**levels < cells:
        levels += 1

    timed = points.where(F.col(time).isNotNull()).select(
        micros(time).alias("_t"), F.col(item).alias("_item"), F.col(value).cast("double").alias("_value")
    )
    placed = as_of(timed, bounds, [], "_t", "_at", ["_cell"]).where(F.col("_cell").isNotNull())
    entries = placed.groupBy("_item", "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_value").alias("_known"), F.sum("_value").alias("_total")
    )
    entries = sliced(entries, ["_item"], ["_cell"])
    inside = entries.withColumn("_in", F.lag("_cell").over(Window.partitionBy(SLICE, "_item").orderBy("_cell")))
    before = Window.partitionBy("_item").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    last = entries.groupBy(SLICE, "_item").agg(F.max("_cell").alias("_last"))
    carry = last.select(SLICE, "_item", F.last("_last").over(before).alias("_carried"))
    entries = _stitch(inside, carry, ["_item"]).withColumn("_from", F.coalesce("_in", "_carried", F.lit(-1).cast("long")))

    first, stop = (bounds.withColumnsRenamed({"_at": f"_at{c}", "_cell": f"_{c}"}) for c in "ab")
    asks = held.select("_span", micros(start).alias("_ata"), micros(end).alias("_atb")).join(first, "_ata").join(stop, "_atb")
    nothing = F.array().cast("array<bigint>")

    def at_level(level):
        return lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin"))

    nodes = []
    for level in range(levels):
        unit = NODE_FACTOR**level

        def ends(size):
            return F.ceil(F.col("_a") / size).cast("long"), F.floor(F.col("_b") / size).cast("long")

        def some(low, high):
            return F.when(low < high, F.sequence(low, high - 1)).otherwise(nothing)

        low, high = ends(unit)
        bins = some(low, high)
        if level + 1 < levels:  # what the next level covers is left out
            up_low, up_high = (c * NODE_FACTOR for c in ends(unit * NODE_FACTOR))
            bins = F.when(up_low < up_high, F.concat(some(low, up_low), some(up_high, high))).otherwise(bins)
        nodes.append(F.transform(bins, at_level(level)))
    measures = {"_first": "long", "_n": "long", "_known": "long", "_total": "double"}
    asks = asks.select("_span", F.col("_a").alias("_from"), F.explode(F.concat(*nodes)).alias("_node")).select(
        "_node.*", "_from", F.lit(0).cast("long").alias("_tie"), "_span", *[F.lit(0).cast(k).alias(m) for m, k in measures.items()]
    )
    own = F.array(*[
        F.struct(F.lit(level).alias("level"), F.floor(F.col("_cell") / NODE_FACTOR**level).cast("long").alias("bin"))
        for level in range(levels)
    ])
    met = entries.select(
        F.explode(own).alias("_node"), "_from", F.abs(F.xxhash64("_item", "_cell") % 1_000_000).alias("_tie"),
        F.col("_item").isNotNull().cast("long").alias("_first"), "_n", "_known", F.coalesce("_total", F.lit(0.0)).alias("_total"),
    ).select("_node.*", "_from", (F.col("_tie") + 1).alias("_tie"), F.lit(None).cast("long").alias("_span"), *measures)
    # at one cell a span comes before the points that follow a point of that cell
    walked = running(asks.unionByName(met), ["level", "bin"], ["_from", "_tie"], {m: m for m in measures})
    sums = walked.where(F.col("_span").isNotNull()).groupBy("_span").agg(
        F.sum("total__n").alias("_n"), F.sum("before__first").alias("items"), F.sum("total__known").alias("_known"),
        F.sum("total__total").alias("_total"),
    )
    out = sums.where(F.col("_n") > 0).join(held, "_span")
    total = F.when(F.col("_known") > 0, F.col("_total") * F.col("_copies"))
    return out.select(*names, (F.col("_n") * F.col("_copies")).alias("n"), "items", total.alias("total"))


def rolling_sums(df: DataFrame, keys: Sequence[str], time: str, width: str, sums: dict[str, Column | str]) -> DataFrame:
    """keys, time and, per distinct moment of a key, the sums over (time - width, time].

    Rows are added up per (keys, time) first. A rolling sum is the running sum now less the one
    at the last moment that has left the window, found by an as-of join: the width of the window
    costs nothing and no key is sorted in one task. Sums of integers are exact. Rows
    with a null key or time are left out. ``width`` is an interval such as ``'6 hours'``.
    """
    keys = list(keys)
    measures = {n: (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    rows = df.where(F.col(time).isNotNull()).dropna(subset=keys)
    per_moment = rows.groupBy(*keys, time).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in measures.items()])
    walked = running(per_moment, keys, [time], {n: n for n in measures})
    upto = walked.select(*keys, time, *[(F.col(f"before_{n}") + F.col(n)).alias(f"_upto_{n}") for n in measures])
    asks = upto.withColumn("_gone", F.col(time) - F.expr(f"INTERVAL {width}"))
    past = upto.select(*keys, F.col(time).alias("_past"), *[F.col(f"_upto_{n}").alias(f"_past_{n}") for n in measures])
    met = as_of(asks, past, keys, "_gone", "_past", [f"_past_{n}" for n in measures])
    return met.select(
        *keys, time, *[(F.col(f"_upto_{n}") - F.coalesce(F.col(f"_past_{n}"), F.lit(0))).alias(n) for n in measures]
    )
