import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantgauge.operators import neighbors, splits


def frame(spark, m, **cols):
    pdf = pd.DataFrame({"id": range(len(m)), "vec": [list(map(float, v)) for v in m], **cols})
    return spark.createDataFrame(pdf)


def brute(q, b, classes, k, cosine):
    out = {}
    if cosine:
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        b = b / np.linalg.norm(b, axis=1, keepdims=True)
        d = 1 - q @ b.T
    else:
        d = np.sqrt(((q[:, None, :] - b[None]) ** 2).sum(-1))
    for c in sorted(set(classes)):
        own = np.sort(d[:, np.array(classes) == c], axis=1)[:, :k]
        for i, v in enumerate(own.mean(axis=1)):
            out[(i, c)] = v
    return out


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("blocks", [False, True])
def test_class_distances_match_brute_force(spark, cosine, blocks):
    """A class with a third of the bank in one tight clump, a tiny class, and spread ones."""
    rng = np.random.RandomState(4)
    clump = rng.normal(size=8) + 0.01 * rng.normal(size=(150, 8))
    bank = np.vstack([clump, rng.normal(size=(280, 8)) + 2, rng.normal(size=(3, 8)) - 3])
    classes = ["hot"] * 150 + ["wide"] * 280 + ["tiny"] * 3
    q = np.vstack([rng.normal(size=(60, 8)), clump[:20] + 0.001])
    got = neighbors.class_distances(
        frame(spark, q), frame(spark, bank, **{"class": classes}), 5, cosine, block_rows=32, force_blocks=blocks
    ).toPandas()
    want = brute(q, bank, classes, 5, cosine)
    assert len(got) == len(want)
    for r in got.itertuples():
        assert r.distance == pytest.approx(want[(r.id, r._2)], abs=1e-7)


def test_large_bank_takes_the_block_way(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BANK_BYTES", 100)
    rng = np.random.RandomState(1)
    bank, q = rng.normal(size=(80, 4)), rng.normal(size=(10, 4))
    got = neighbors.novelty_scores(frame(spark, q), frame(spark, bank, **{"class": ["a"] * 80})).toPandas()
    want = brute(q, bank, ["a"] * 80, 5, True)
    assert all(r.novelty_score == pytest.approx(want[(r.id, "a")], abs=1e-7) for r in got.itertuples())


def test_known_and_novel(spark):
    rng = np.random.RandomState(0)
    axes = np.eye(16)
    bank = np.vstack([axes[i] + 0.05 * rng.normal(size=(20, 16)) for i in range(3)])
    classes = [c for c in "abc" for _ in range(20)]
    q = np.vstack([axes[0] + 0.05 * rng.normal(size=16), axes[4]])
    got = neighbors.novelty_scores(frame(spark, q), frame(spark, bank, **{"class": classes}), 3).orderBy("id").collect()
    assert got[0]["novelty_score"] < 0.20 and got[0]["nearest_class"] == "a" and got[1]["novelty_score"] > 0.80


def test_threshold_flags_about_five_percent(spark):
    rng = np.random.RandomState(3)
    bank, val = rng.normal(size=(50, 32)), rng.normal(size=(100, 32))
    scores = neighbors.novelty_scores(frame(spark, val), frame(spark, bank, **{"class": ["a"] * 50}))
    limit = neighbors.score_threshold(scores, "novelty_score", 0.95, 0.5)
    flagged = neighbors.above_threshold(scores, "novelty_score", limit, "novel").where("novel").count()
    assert abs(flagged / 100 - 0.05) <= 0.03


def test_defaults_when_there_is_nothing(spark):
    none = spark.createDataFrame([], "novelty_score double")
    assert neighbors.score_threshold(none, "novelty_score", 0.95, 0.5).first()["threshold"] == 0.5
    empty = spark.createDataFrame([], "id long, class string, vec array<double>")
    assert neighbors.class_distances(frame(spark, np.eye(2)), empty).count() == 0


def test_unit_is_as_anomalous_as_its_worst_patch(spark):
    df = spark.createDataFrame([("u", 1.0), ("u", 3.0), ("w", 2.0)], "unit string, anomaly_score double")
    assert {r["unit"]: r["anomaly_score"] for r in neighbors.unit_scores(df, "unit").collect()} == {"u": 3.0, "w": 2.0}


def test_projection_is_fixed_and_linear(spark):
    m = np.vstack([np.eye(6), np.ones((1, 6))])
    got = neighbors.random_projection(frame(spark, m).repartition(3), "vec", 6, 4).orderBy("id").toPandas()["vec"]
    out = np.array(got.tolist())
    assert out.shape == (7, 4) and np.allclose(out[:6].sum(axis=0), out[6])


def test_perturbations(spark):
    m = np.arange(8.0)[None]
    rows = {r["condition"]: r["vec"] for r in neighbors.perturbed(frame(spark, m), "vec", "id").collect()}
    assert len(rows) == 12 and rows["baseline"] == list(m[0]) and rows["hflip"] == list(m[0][::-1])
    assert rows["rot_90"] == [2, 3, 4, 5, 6, 7, 0, 1] and rows["contrast_0.6"][0] == pytest.approx(3.5 - 3.5 * 0.6)
    assert rows["blur_1"] == pytest.approx([0.5, 1, 2, 3, 4, 5, 6, 6.5]) and rows["blur_2"][0] == pytest.approx(1.0)
    a, b = (neighbors.augmented(frame(spark, m), "vec", "id").first()["vec"] for _ in range(2))
    assert a == b and len(a) == 8


def test_min_max(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [r["s"] for r in neighbors.min_max(df, "a", "s").collect()] == [0.0, 1.0]
    assert {r["s"] for r in neighbors.min_max(df, "b", "s").collect()} == {0.0}


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "rare") for i in range(600)], "id int, c string")
    rows = splits.stratified_split(df, "id", "c")
    counts = {(r["c"], r["split"]): r["count"] for r in rows.groupBy("c", "split").count().collect()}
    assert counts == {("hot", "train"): 240, ("hot", "val"): 80, ("hot", "test"): 80,
                      ("rare", "train"): 120, ("rare", "val"): 40, ("rare", "test"): 40}
    again = splits.stratified_split(df.repartition(7), "id", "c")
    assert rows.exceptAll(again).count() == 0 and splits.overlap(rows, "id").count() == 0
    slim = splits.dev_slice(rows, "id", "c", {"train": 5, "val": 2, "test": 2})
    assert slim.count() == 18


def test_group_split_keeps_batches_whole(spark):
    df = spark.createDataFrame([(i, f"B{i % 12}") for i in range(240)], "id int, b string")
    rows = splits.group_split(df, "b", "id")
    assert splits.overlap(rows, "b").count() == 0 and {r[0] for r in rows.select("split").distinct().collect()} == {"train", "test"}
    single = splits.group_split(df.withColumn("b", F.lit("B0")), "b", "id")
    assert {r[0] for r in single.select("split").distinct().collect()} == {"train", "test"}


@pytest.mark.parametrize("blocks", [False, True])
def test_distances_of_an_offset_bank(spark, blocks):
    """Vectors near 1000: a bank row is at distance 0 from itself."""
    import numpy as np

    m = 1000.0 + np.random.default_rng(1).random((60, 8))
    bank = spark.createDataFrame([(i, "a", [float(x) for x in v]) for i, v in enumerate(m)], "id int, class string, vec array<double>")
    got = neighbors.class_distances(bank.select("id", "vec"), bank, k=1, cosine=False, block_rows=10, force_blocks=blocks).collect()
    assert len(got) == 60 and max(r["distance"] for r in got) < 1e-9


def test_group_split_always_holds_out_a_group(spark):
    for n in range(3, 9):
        for prefix in ("B", "B1", "B2"):
            df = spark.createDataFrame([(i, f"{prefix}{i % n:03d}", int(i % n >= n - 2)) for i in range(8 * n)], "id int, b string, y int")
            rows = splits.group_split(df, "b", "id", F.col("y")).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("b").alias("g")).collect()
            sizes = {r["split"]: (r["n"], r["g"]) for r in rows}
            assert sizes["test"][1] == -(-n // min(5, n)) and sizes["train"][1] == n - sizes["test"][1]


def test_group_split_spreads_the_label(spark):
    df = spark.createDataFrame([(i, f"B{i % 40}", int(i % 40 < 10)) for i in range(400)], "id int, b string, y int")
    share = {r["split"]: r["s"] for r in splits.group_split(df, "b", "id", F.col("y")).groupBy("split").agg(F.avg("y").alias("s")).collect()}
    assert abs(share["test"] - share["train"]) < 0.05


def test_hash_sample_is_stable(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "id int")
    a = [r["id"] for r in splits.hash_sample(df, "id", 4).collect()]
    b = [r["id"] for r in splits.hash_sample(df.repartition(9), "id", 4).collect()]
    assert a == b and len(set(a)) == 4


def test_bank_is_the_smallest_hashes(spark):
    df = frame(spark, np.arange(500.0)[:, None])
    bank = sorted(r["id"] for r in neighbors.reference_bank(df, 60).collect())
    every = df.orderBy(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("42"))), "id").limit(60)
    assert bank == sorted(r["id"] for r in every.collect())
    assert neighbors.reference_bank(df, 1000).count() == 500


def test_held_out_scores(spark):
    rows = [("a", "p", 0.3), ("a", "q", 0.1), ("a", "normal", 0.2), ("b", "p", 0.5)]
    out = neighbors.held_out_scores(spark.createDataFrame(rows, "id string, class string, distance double"), ["p", "q"]).collect()
    assert {(r["held_out_class"], r["id"]): r["novelty_score"] for r in out} == {
        ("p", "a"): 0.1, ("q", "a"): 0.2, ("p", "b"): None, ("q", "b"): 0.5,
    }


def test_blocked_search_copies_neither_side_per_block(spark, monkeypatch):
    """Small blocks are cut inside a group: a query travels once per parcel of a class, not once
    per cell and block, and large and shared parcels give the same distances."""
    rng = np.random.default_rng(6)
    bank, asked = rng.normal(size=(300, 6)), rng.normal(size=(50, 6))
    classes = ["ab"[i % 5 == 0] for i in range(300)]
    sent = []
    settle = neighbors.cut_lineage
    monkeypatch.setattr(neighbors, "cut_lineage", lambda df: sent.append(settle(df)) or sent[-1])

    def found():
        sent.clear()
        out = neighbors.class_distances(
            frame(spark, asked), frame(spark, bank, **{"class": classes}), 5, False, block_rows=4, force_blocks=True
        )
        return {(r["id"], r["class"]): r["distance"] for r in out.collect()}, [d for d in sent if "parcel" in d.columns][0].count()

    one, moved = found()
    assert moved == 50 * 2
    monkeypatch.setattr(neighbors, "PARCEL_ROWS", 7)
    two, _ = found()
    d = np.sqrt(((asked[:, None] - bank[None]) ** 2).sum(axis=2))
    for c in "ab":
        mine = np.sort(d[:, [i for i, x in enumerate(classes) if x == c]], axis=1)[:, :5].mean(axis=1)
        assert [one[i, c] for i in range(50)] == pytest.approx(list(mine)) and [two[i, c] for i in range(50)] == pytest.approx(list(mine))
