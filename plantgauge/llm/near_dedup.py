"""Near duplicates by ProbMinHash signatures, banding and verification.

Each distinct shingle of five words is an element of weight one, however often it
stands in the document, as the classes are decided on sets. Elements arrive in
exponential (Poisson) processes with their weight as rate; every arrival falls into
one register, which keeps the earliest. An element stops as soon as its next arrival
is later than every register. With equal weights the share of equal registers
estimates the plain Jaccard similarity of two documents.

Bands of registers put documents into buckets. Equal texts are one node. In each
bucket the smallest, the largest and then the most typical node (fewest shingles of
its own) are compared with all others and components are formed. Documents with too
many shingles of their own to have a partner are put aside. What buckets then still
hold apart meets by an exact prefix join: of two sets with Jaccard similarity 0.8, the
globally rarest shingles of each, as many as may lie outside the other, must meet. So documents
that only share a common passage never meet, a link between different texts is lost only
with their bands, and a group of n similar texts costs about 3n comparisons a band. A
comparison is first made on signatures and then exactly, on the shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from plantgauge.llm.common import chunks, in_arrow, keeps_names, stored, whole_text
from plantgauge.llm.components import components
from plantgauge.llm.wordhash import mix, shingle_hashes, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 7
REGISTERS = BANDS * BAND_ROWS
# a pair whose signatures agree in fewer registers is no candidate: 0.8 less six
# deviations of the estimate
LEAST_AGREE = int(REGISTERS * (SIMILARITY - 6 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5))


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False)


def distinct_elements(shingles: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, text), in order of the texts."""
    order = np.lexsort((shingles, text))
    s, t = shingles[order], text[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return s[first], t[first]


def prob_min_hash(shingles: np.ndarray, text: np.ndarray, weights: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n_texts x registers, 16 bits of the earliest element each);
    texts without elements get zeros."""
    time = np.full(n_texts * registers, np.inf)
    owner = np.zeros(n_texts * registers, dtype=np.uint64)
    element, doc, rate = shingles, text.astype(np.int64), weights
    clock = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        u = mix(element + np.uint64((2 * turn * 0x9E3779B97F4A7C15) % 2**64))
        clock = clock - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
        slot = doc * registers + (mix(u ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, slot, clock)
        won = time[slot] == clock
        owner[slot[won]] = element[won]
        latest = time.reshape(n_texts, registers).max(axis=1)
        on = clock < latest[doc]
        element, doc, rate, clock = element[on], doc[on], rate[on], clock[on]
    return (mix(owner) >> np.uint64(48)).astype(np.uint16).reshape(n_texts, registers)


def signatures(df: DataFrame) -> DataFrame:
    """(node, signature binary) of rows (node, text) with at least one word."""

    def sign(batches):
        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1)
            for a, b in chunks(byte_lengths(texts), 1_500_000):
                block = [t.lower() for t in texts.slice(a, b - a).to_pylist()]
                words, bounds = word_hashes(block)
                s, t, _ = shingle_hashes(words, bounds, SHINGLE_WORDS)
                s, t = distinct_elements(s, t)
                sig = prob_min_hash(s, t, np.ones(len(s)), len(block))
                some = np.diff(bounds) > 0
                rows = [sig[i].tobytes() if some[i] else None for i in range(len(block))]
                yield pa.RecordBatch.from_arrays([nodes.slice(a, b - a), pa.array(rows, pa.binary())], names=["node", "signature"])

    return in_arrow(df.select("node", "text"), sign, "node binary, signature binary").where("signature is not null")


def agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough registers."""

    def agree(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                held = np.flatnonzero((x == y).sum(axis=1) >= LEAST_AGREE)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), batch.column(1).take(pa.array(held))], names=["a", "b"])

    left = sigs.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    right = sigs.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    return in_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), agree, "a binary, b binary")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets of shingles have the wanted Jaccard similarity."""

    def exact(batches):
        for whole in batches:
            for at, end in chunks(byte_lengths(whole.column(2)) + byte_lengths(whole.column(3)), 1_500_000):
                batch = whole.slice(at, end - at)
                block = [t.lower() for i in (2, 3) for t in batch.column(i).to_pylist()]
                words, bounds = word_hashes(block)
                s, t, _ = shingle_hashes(words, bounds, SHINGLE_WORDS)
                s, t = distinct_elements(s, t)
                cut = np.searchsorted(t, np.arange(len(block) + 1))
                n, keep = batch.num_rows, []
                for i in range(n):
                    x, y = s[cut[i] : cut[i + 1]], s[cut[n + i] : cut[n + i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9 and both:
                        keep.append(i)
                held = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(held), batch.column(1).take(held)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return in_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), exact, "a binary, b binary")


def with_node(df: DataFrame, text: str) -> DataFrame:
    """(node, text): the 128-bit digest stands for a text."""
    whole = whole_text(text)
    return df.select(F.unhex(F.md5(whole)).alias("node"), whole.alias("text"))


def near_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """(node, label) of the digests of texts that have a near duplicate: the
    smallest digest of their component."""
    rows = with_node(df, text)
    sigs = stored(signatures(rows).dropDuplicates(["node"]), "signatures")
    width = 2 * BAND_ROWS
    bands = sigs.select(
        "node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * width + 1, F.lit(width))))).alias("band")
    )
    shared = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    buckets = stored(bands.join(shared, "band"), "buckets")
    stars = buckets.select(F.explode(F.array("low", "high")).alias("a"), F.col("node").alias("b")).where("a <> b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    candidates = stored(agreeing(stars, sigs), "pairs")
    wanted = buckets.select("node").distinct()
    texts = stored(rows.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")
    links = stored(similar(candidates, texts), "links")

    # what a bucket still holds apart, without documents that cannot have a partner
    labels = components(links)
    apart = still_apart(buckets.select("band", "node"), labels)
    shingles = stored(shingle_rows(texts.join(apart.select("node").distinct(), "node", "left_semi")), "shingles")
    apart = stored(apart.join(own_shares(shingles), "node"), "apart")
    typical = apart.groupBy("band").agg(F.min(F.struct((F.col("alone") / F.col("size")).alias("own"), "node")).alias("c")).select("band", F.col("c.node").alias("c"))
    again = apart.join(typical, "band").where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    again = stored(again.join(stars, ["a", "b"], "left_anti"), "pairs")
    links = stored(links.unionByName(similar(stored(agreeing(again, sigs), "pairs"), texts)), "links")

    labels = components(links, start=labels)
    rest = stored(still_apart(apart.drop("label"), labels).select("node", "label", "alone", "size").distinct(), "apart")
    pairs = stored(prefix_pairs(shingles, rest).join(stars.unionByName(again), ["a", "b"], "left_anti"), "pairs")
    more = stored(similar(stored(agreeing(pairs, sigs), "pairs"), texts), "links")
    return components(links.unionByName(more), start=labels) if more.limit(1).count() else labels


def still_apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, label) of the buckets whose nodes are in several components."""
    apart = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = apart.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("band")
    return apart.join(mixed, "band", "left_semi")


def shingle_rows(texts: DataFrame) -> DataFrame:
    """(node, shingle, size) of the distinct shingles of each text; ``size`` is their number."""

    def explode(batches):
        for batch in batches:
            for a, b in chunks(byte_lengths(batch.column(1)), 1_500_000):
                words, bounds = word_hashes([t.lower() for t in batch.column(1).slice(a, b - a).to_pylist()])
                s, t, _ = shingle_hashes(words, bounds, SHINGLE_WORDS)
                s, t = distinct_elements(s, t)
                sizes = np.bincount(t, minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + t)), pa.array(s.view(np.int64)), pa.array(sizes[t].astype(np.int32))], names=["node", "shingle", "size"]
                )

    return in_arrow(texts.select("node", "text"), explode, "node binary, shingle long, size int")


def own_shares(shingles: DataFrame) -> DataFrame:
    """(node, size, alone): a document's shingles, and those that no other of these
    documents has, where they do not rule out a partner: a document similar to
    another by 0.8 shares at least 0.8 of its own shingles."""
    alone = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sizes = shingles.groupBy("node").agg(F.first("size").alias("size"))
    shares = sizes.join(alone, "node", "left").select("node", "size", F.coalesce("alone", F.lit(0)).alias("alone"))
    return shares.where(F.col("alone") <= (1 - SIMILARITY) * F.col("size") + 1e-9)


def prefix_pairs(shingles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b), a < b, of the ``nodes`` (node, label, alone, size) with different labels that can
    have the wanted similarity.

    All shingles are ordered by how many nodes have them. A set of n shares at least 0.8 n
    with a similar one, so one of its first n - ceil(0.8 n) + 1 shingles is shared, and at the first
    shared one the rest of both sets must still hold what is needed. Shingles that only one
    component has make no pair, and those that stand once only take their places.
    """
    rows = shingles.join(nodes, ["node", "size"])
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    rows = rows.join(counts.where("n > 1"), "shingle")
    # places by the order (n, shingle) within a set; those that stand once come first
    single = F.col("size") - F.count(F.lit(1)).over(W.partitionBy("node"))
    place = single + F.row_number().over(W.partitionBy("node").orderBy("n", "shingle")) - 1
    prefix = F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1
    heads = rows.withColumn("place", place).where((F.col("place") < prefix) & (F.col("low") < F.col("high")))
    heads = stored(heads.select("shingle", "node", "label", "size", "alone", "place"), "prefixes")
    one, two = (heads.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "size", "alone", "place")]) for x in ("a", "b"))
    needed = (F.col("size_a") + F.col("size_b")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    # shingles of its own stay outside what two documents share, and inside their union
    can = [(F.col(f"size_{x}") - F.col(f"alone_{x}")) >= SIMILARITY * (F.col(f"size_{x}") + F.col(f"alone_{y}")) - 1e-9 for x, y in ("ab", "ba")]
    met = one.join(two, "shingle").where((F.col("label_a") < F.col("label_b")) & can[0] & can[1] & (left >= needed))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, class_id, class_size, kept): the smallest key of each row's class, the
    rows of the class, and whether the row has that key.

    A class is a component under near duplication: Jaccard similarity of the sets
    of five-word shingles (lower case, split at white space; fewer words make one
    shingle) of 0.8 or more. Equal texts share a class, null being the empty text
    and all empty texts one class. A class all of whose keys are null has a null
    class_id. Repeated rows share a class and are kept or not together. An empty
    table gives an empty result.
    """
    rows = df.select(F.col(key).alias("_n_key"), F.unhex(F.md5(whole_text(text))).alias("node"))
    labels = near_groups(df, text)
    labelled = rows.join(labels, "node", "left").select("_n_key", F.coalesce("label", "node").alias("label"))
    classes = labelled.groupBy("label").agg(F.min("_n_key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return labelled.join(classes, "label").select(
        F.col("_n_key").alias(key), "class_id", "class_size", F.col("_n_key").eqNullSafe(F.col("class_id")).alias("kept")
    )


@keeps_names("_n_")
def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with one row of each class: the smallest key (null last), and of
    repeated rows one. A null text is the empty text, and all empty texts are one class;
    an empty table stays empty. Columns stay as they are."""
    nodes = df.withColumn("_n_node", F.unhex(F.md5(whole_text(text))))
    labels = near_groups(df, text)
    labelled = nodes.select(F.col("_n_node").alias("node"), F.col(key).alias("k")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "node")).alias("one"))
    first = first.select(F.col("one.node").alias("_n_node"), F.col("one.k").alias("_n_k"))
    kept = nodes.join(first, "_n_node").where(F.col(key).eqNullSafe(F.col("_n_k")))
    return kept.dropDuplicates(["_n_node", "_n_k"]).select(*df.columns)
