"""Nearest-neighbour novelty and anomaly scores.

Distances are matrix products inside Arrow batches. A bank whose size has been
checked is sent to every executor and the queries never move. A larger one is
cut into cells around pivots, and cells of a class are packed into parcels of bounded
size; a query visits only the parcels with a cell that the triangle inequality cannot
rule out, each meeting of a parcel and a chunk of its visitors keeps the k best, and the
bests are merged. Both ways are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantgauge import fixed_values as fv
from plantgauge.functions import draws, vectors
from plantgauge.operators.prefix import percentiles
from plantgauge.operators.splits import hash_sample
from plantgauge.session import cut_lineage

BANK_BYTES = 64 * 1024 * 1024  # as doubles, on every executor
BLOCK_ROWS = 4096
PARCEL_ROWS = 4096  # of the bank, and visitors that meet it in one group; each side is copied once per PARCEL_ROWS of the other
PIVOTS = 64


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scale to [0, 1]; a constant column gives 0."""
    ends = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    width = ends["high"] - ends["low"]
    return df.withColumn(name, F.when(width > 0, (F.col(column) - ends["low"]) / width).otherwise(0.0))


def fits_broadcast(bank: DataFrame, vec: str) -> tuple[bool, int]:
    """(small enough to send everywhere, number of rows)."""
    n, width = bank.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    return n * (width or 0) * 8 <= BANK_BYTES, n


def _nearest(k: int, cosine: bool):
    """A function (queries, bank) -> the k smallest distances per query, unordered.

    Candidates are ranked by |a|^2 + |b|^2 - 2ab about the bank's mean; the distances
    of the k kept are taken again by difference, free of cancellation.
    """

    def nearest(q, b):
        import numpy as np

        k_eff = min(k, len(b))
        out = np.empty((len(q), k_eff))
        width = max(1, b.shape[1] if b.ndim == 2 else 1)
        rows = max(1, min(1_000_000 // max(1, len(b)), 1_000_000 // (max(1, k_eff) * width)))  # bounds both matrices
        if not cosine:
            middle = b.mean(axis=0)
            q, b = q - middle, b - middle
        b_sq = (b * b).sum(axis=1)
        for i in range(0, len(q), rows):
            part = q[i : i + rows]
            dots = part @ b.T
            if cosine:
                d = 1.0 - dots
                out[i : i + rows] = d if k_eff == len(b) else np.partition(d, k_eff - 1, axis=1)[:, :k_eff]
                continue
            d = b_sq[None, :] - 2.0 * dots
            kept = np.argpartition(d, k_eff - 1, axis=1)[:, :k_eff] if k_eff < len(b) else np.tile(np.arange(len(b)), (len(part), 1))
            gap = part[:, None, :] - b[kept]
            out[i : i + rows] = np.sqrt((gap * gap).sum(axis=2))
        return out

    return nearest


def _matrix(unit: bool):
    def matrix(column):
        import numpy as np

        m = np.array(column.tolist(), dtype="float64")
        if unit and len(m):
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)
        return m

    return matrix


def _by_broadcast(queries: DataFrame, bank: DataFrame, cosine: bool, k: int, closest_only: bool = False) -> DataFrame:
    """queries: id, vec; bank: class, vec (checked to be small). -> id, class, distance,
    for every class or only for the closest one; nothing is shuffled."""
    pdf = bank.toPandas()
    matrix, nearest = _matrix(cosine), _nearest(k, cosine)
    sides = {c: matrix(g["vec"]) for c, g in pdf.groupby("class")}
    sent = queries.sparkSession.sparkContext.broadcast(sides)
    kind = queries.schema["id"].dataType.simpleString()

    def score(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if len(pdf) == 0:
                continue
            q, ids = matrix(pdf["vec"]), pdf["id"].values
            each = {c: nearest(q, b).mean(axis=1) for c, b in sorted(sent.value.items())}
            if closest_only:
                names, d = list(each), np.column_stack(list(each.values()))
                best = np.round(d, 9).argmin(axis=1)
                yield pd.DataFrame({"id": ids, "class": [names[i] for i in best], "distance": d.min(axis=1)})
            else:
                for c, d in each.items():
                    yield pd.DataFrame({"id": ids, "class": c, "distance": d})

    return queries.mapInPandas(score, f"id {kind}, class string, distance double")


def _by_blocks(queries: DataFrame, bank: DataFrame, cosine: bool, k: int, block_rows: int) -> DataFrame:
    """Like :func:`_by_broadcast` for a bank of any size; bank also has its id. Within a
    group ``block_rows`` rows of the bank are compared at a time."""
    matrix, nearest = _matrix(cosine), _nearest(k, cosine)
    bank = cut_lineage(bank)
    pivots = matrix(hash_sample(bank, "id", PIVOTS).toPandas()["vec"])  # PIVOTS rows
    kind = queries.schema["id"].dataType.simpleString()
    bank_kind = bank.schema["id"].dataType.simpleString()

    middle = pivots.mean(axis=0) if len(pivots) else 0.0
    pivots = pivots - middle
    farthest = float((pivots * pivots).sum(axis=1).max()) ** 0.5 if len(pivots) else 0.0

    def slack(m):
        """What rounding can take from a distance to a pivot, for each row."""
        return 1e-7 * ((((m - middle) ** 2).sum(axis=1)) ** 0.5 + farthest) + 1e-9

    def to_pivots(m):
        import numpy as np

        m = m - middle
        sq = (m * m).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (m @ pivots.T)
        return np.sqrt(np.maximum(sq, 0.0))

    def to_cells(batches):
        for pdf in batches:
            d = to_pivots(matrix(pdf["vec"])) if len(pdf) else None
            if d is not None:
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), reach=d.min(axis=1))

    celled = cut_lineage(
        bank.mapInPandas(to_cells, f"id {bank_kind}, class string, vec array<double>, cell int, reach double")
    )
    # one row per class and pivot
    cells = celled.groupBy("class", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius"))
    table: dict[str, list] = {}
    for row in sorted(cells.collect(), key=lambda r: (r["class"], r["cell"])):
        table.setdefault(row["class"], []).append((row["cell"], row["n"], row["radius"]))
    packed = []  # class, cell, first parcel, number of parcels: small cells share one, a large one has several
    for c, rows in table.items():
        parcel, filled = 0, 0
        for cell, n, _ in rows:
            own = -(-n // PARCEL_ROWS)
            if filled and filled + n > PARCEL_ROWS:
                parcel, filled = parcel + 1, 0
            packed.append((c, cell, parcel, own))
            parcel, filled = (parcel + own, 0) if own > 1 else (parcel, filled + n)
    places = {(c, cell): (parcel, own) for c, cell, parcel, own in packed}

    def visits(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if len(pdf) == 0:
                continue
            m = matrix(pdf["vec"])
            d, loose = to_pivots(m), slack(m)
            for c, rows in table.items():
                ids = np.array([r[0] for r in rows])
                sizes = np.array([r[1] for r in rows])
                radius = np.array([r[2] for r in rows])
                near, far = d[:, ids] - radius, d[:, ids] + radius
                # the k-th neighbour is no farther than the reach of the closest cells that hold k rows
                order = np.argsort(far, axis=1)
                held = np.cumsum(sizes[order], axis=1)
                full = held >= k
                first = full.argmax(axis=1)
                bound = np.take_along_axis(far, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]
                bound = np.where(full.any(axis=1), bound, np.inf)
                asked = near <= bound[:, None] * (1 + 1e-9) + loose[:, None]
                own = [places[c, r[0]] for r in rows]
                wanted = np.zeros((len(pdf), max(p + n for p, n in own)), dtype=bool)
                for j, (parcel, n) in enumerate(own):
                    wanted[:, parcel : parcel + n] |= asked[:, [j]]
                for parcel in range(wanted.shape[1]):
                    hit = np.nonzero(wanted[:, parcel])[0]
                    yield pd.DataFrame(
                        {"id": pdf["id"].values[hit], "vec": pdf["vec"].values[hit], "class": c, "parcel": np.int32(parcel)}
                    )

    going = cut_lineage(queries.mapInPandas(visits, f"id {kind}, vec array<double>, class string, parcel int"))
    spark = queries.sparkSession
    packing = spark.createDataFrame(packed, "class string, cell int, parcel int, own int")  # one row per class and pivot
    parts = celled.join(F.broadcast(packing), ["class", "cell"]).withColumn(
        "parcel", (F.col("parcel") + F.pmod(F.xxhash64("id"), F.col("own"))).cast("int")
    )
    block = ["class", "parcel"]
    visitors = going.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / PARCEL_ROWS).alias("chunks"))
    visitors = F.broadcast(visitors)  # one row per parcel
    left = going.join(visitors, block).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")))
    right = parts.join(visitors, block).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    )

    def best(q, b):
        import numpy as np
        import pandas as pd

        if len(q) == 0 or len(b) == 0:
            return pd.DataFrame({"id": [], "class": [], "nearest": []})
        asks, d = matrix(q["vec"]), None
        for i in range(0, len(b), block_rows):
            more = nearest(asks, matrix(b["vec"].iloc[i : i + block_rows]))
            d = more if d is None else np.hstack([d, more])
            if d.shape[1] > k:
                d = np.partition(d, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"id": q["id"].values, "class": q["class"].values, "nearest": list(d)})

    keys = [*block, "chunk"]
    found = (
        left.select("id", "vec", *keys)
        .groupBy(*keys)
        .cogroup(right.select("vec", *keys).groupBy(*keys))
        .applyInPandas(best, f"id {kind}, class string, nearest array<double>")
    )
    each = found.select("id", "class", F.explode("nearest").alias("d"))
    w = Window.partitionBy("id", "class").orderBy("d")  # k rows from each visited block
    top = each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy("id", "class").agg(F.avg("d").alias("distance"))


def class_distances(
    queries: DataFrame, bank: DataFrame, k: int = fv.NEIGHBOURS, cosine: bool = True,
    block_rows: int = BLOCK_ROWS, force_blocks: bool = False, closest_only: bool = False,
) -> DataFrame:
    """Mean distance to the k nearest rows of each class: id, class, distance.

    ``queries`` has id, vec; ``bank`` has id, class, vec. A class with fewer than
    k rows uses all of them. ``closest_only`` keeps the class with the least distance.
    """
    q = queries.select("id", vectors.doubles(F.col("vec")).alias("vec"))
    b = bank.select("id", F.col("class").cast("string").alias("class"), vectors.doubles(F.col("vec")).alias("vec"))
    small, n = (False, 1) if force_blocks else fits_broadcast(b, "vec")
    if n == 0:
        return q.select("id", F.lit(None).cast("string").alias("class"), F.lit(None).cast("double").alias("distance")).limit(0)
    if small:
        return _by_broadcast(q, b.select("class", "vec"), cosine, k, closest_only)
    each = _by_blocks(q, b, cosine, k, block_rows)
    if not closest_only:
        return each
    best = F.min_by(F.struct("class", "distance"), F.struct(F.round("distance", 9), F.col("class")))
    return each.groupBy("id").agg(best.alias("b")).select("id", "b.*")


def novelty_scores(queries: DataFrame, bank: DataFrame, k: int = fv.NEIGHBOURS, **how) -> DataFrame:
    """Least class distance per query: id, novelty_score, nearest_class."""
    found = class_distances(queries, bank, k, True, closest_only=True, **how)
    return found.select("id", F.col("distance").alias("novelty_score"), F.col("class").alias("nearest_class"))


def reference_bank(rows: DataFrame, size: int = fv.BANK_ROWS, seed: int = 42) -> DataFrame:
    """At most ``size`` rows (id, vec) drawn by hash; the limit is the operator's own."""
    return hash_sample(rows, "id", size, seed)


def bank_scores(patches: DataFrame, bank: DataFrame, **how) -> DataFrame:
    """Euclidean distance of each patch (id, vec) to the nearest bank row."""
    one_class = bank.select("id", F.lit("bank").alias("class"), "vec")
    return class_distances(patches, one_class, 1, False, **how).select("id", F.col("distance").alias("anomaly_score"))


def unit_scores(scores: DataFrame, unit: str) -> DataFrame:
    """A unit is as anomalous as its worst patch."""
    return scores.groupBy(unit).agg(F.max("anomaly_score").alias("anomaly_score"))


def held_out_scores(distances: DataFrame, held: Sequence[str], class_col: str = "class") -> DataFrame:
    """held_out_class, id, novelty_score: the least distance to any class but the one held out.

    One row per id and class of ``distances`` is all it takes: the bank is searched once,
    however many classes are held out. An id whose only class is held out has no score.
    """
    near = distances.groupBy("id").agg(F.collect_list(F.struct("distance", class_col)).alias("near"))  # one entry per class
    rows = near.select("id", "near", F.explode(F.array(*[F.lit(h) for h in held])).alias("held_out_class"))
    rest = F.filter("near", lambda e: e[class_col] != F.col("held_out_class"))
    return rows.select("held_out_class", "id", F.array_min(F.transform(rest, lambda e: e["distance"])).alias("novelty_score"))


def score_threshold(scores: DataFrame, column: str, level: float, when_empty: float) -> DataFrame:
    """One row: threshold (exact percentile), mean and max of the scores."""
    found = percentiles(scores, [], column, {"threshold": level})
    return scores.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.max(column).alias("max")).select(
        F.coalesce(found.select("threshold").scalar(), F.lit(when_empty)).alias("threshold"), "n", "mean", "max"
    )


def above_threshold(scores: DataFrame, column: str, threshold: DataFrame | float, name: str) -> DataFrame:
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold.select("threshold").scalar()
    return scores.withColumn(name, F.col(column) > limit)


def random_projection(df: DataFrame, vec: str, width: int, out_width: int, seed: int = 42) -> DataFrame:
    """Project to ``out_width`` dimensions with a fixed N(0, 1)/sqrt(out_width) matrix.

    Each task derives the matrix from md5 draws, so every task has the same one.
    """

    def draw(*parts):
        import hashlib

        text = "|".join(str(p) for p in parts)
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0

    def project(batches):
        import numpy as np

        weights = np.array(
            [
                [
                    math.sqrt(-2.0 * math.log(1.0 - draw(seed, i, j, "a"))) * math.cos(2.0 * math.pi * draw(seed, i, j, "b"))
                    for j in range(out_width)
                ]
                for i in range(width)
            ]
        ) / math.sqrt(out_width)
        for pdf in batches:
            if len(pdf):
                m = np.array(pdf[vec].tolist(), dtype="float64")
                pdf[vec] = list(m @ weights)
            yield pdf

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != vec)
    return df.select(*[c for c in df.columns if c != vec], vectors.doubles(F.col(vec)).alias(vec)).mapInPandas(
        project, f"{fields}, {vec} array<double>"
    )


# ---- conditions on vectors -------------------------------------------------


def perturbations(v: Column, key: Column) -> list[tuple[str, Column]]:
    """The robustness conditions, as operations on one vector."""
    quarter = F.floor(F.size(v) / 4).cast("int")
    return [
        ("baseline", v),
        ("bright_0.6", vectors.scaled(v, 0.6)),
        ("bright_1.4", vectors.scaled(v, 1.4)),
        ("contrast_0.6", vectors.contrasted(v, 0.6)),
        ("contrast_1.4", vectors.contrasted(v, 1.4)),
        ("rot_90", vectors.rotated(v, quarter)),
        ("rot_180", vectors.rotated(v, quarter * 2)),
        ("hflip", F.reverse(v)),
        ("blur_1", vectors.smoothed(v, 1)),
        ("blur_2", vectors.smoothed(v, 2)),
        ("noise_10", vectors.noisy(v, key, 10.0 / 255.0, "noise_10")),
        ("noise_25", vectors.noisy(v, key, 25.0 / 255.0, "noise_25")),
    ]


def perturbed(df: DataFrame, vec: str, id_col: str) -> DataFrame:
    """Every row under every condition: adds ``condition``, replaces the vector."""
    v = vectors.doubles(F.col(vec))
    options = F.array(
        *[F.struct(F.lit(n).alias("condition"), c.alias("vector")) for n, c in perturbations(v, F.col(id_col))]
    )
    others = [c for c in df.columns if c != vec]
    return df.select(*others, F.explode(options).alias("_o")).select(
        *others, F.col("_o.condition").alias("condition"), F.col("_o.vector").alias(vec)
    )


def augmented(df: DataFrame, vec: str, id_col: str, seed: int = 42) -> DataFrame:
    """One random copy per row: brightness and contrast in [0.6, 1.4], a quarter-turn,
    and flip, blur and noise each for half of the rows; all drawn from the row's id."""
    key = F.col(id_col)

    def draw(tag):
        return draws.uniform(key, seed, tag)

    v = vectors.doubles(F.col(vec))
    v = vectors.scaled(v, F.lit(0.6) + F.lit(0.8) * draw("bright"))
    v = vectors.contrasted(v, F.lit(0.6) + F.lit(0.8) * draw("contrast"))
    turn = F.floor(draw("turn") * 4).cast("int")
    out = df.withColumn(vec, v)
    quarter = F.floor(F.size(vec) / 4).cast("int")
    out = out.withColumn(vec, vectors.rotated(F.col(vec), turn * quarter))
    out = out.withColumn(vec, F.when(draw("flip") > 0.5, F.reverse(vec)).otherwise(F.col(vec)))
    out = out.withColumn(vec, F.when(draw("blur") > 0.5, vectors.smoothed(F.col(vec), 1)).otherwise(F.col(vec)))
    sigma = (F.lit(5.0) + F.lit(20.0) * draw("sigma")) / 255.0
    return out.withColumn(vec, F.when(draw("noisy") > 0.5, vectors.noisy(F.col(vec), key, sigma)).otherwise(F.col(vec)))
