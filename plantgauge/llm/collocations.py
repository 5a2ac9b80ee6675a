"""Collocations by set-oriented mining: relations of sorted occurrences, one per phrase length.

The relation of length k holds (piece, position, group) of every occurrence of a frequent
phrase of k words, sorted, stored as one row per block of a text. Neighbouring positions of a
piece are consecutive in it, so the merge join of the relation with itself shifted by one
position is one pass over sorted rows: it gives the occurrences of length k + 1 as pairs
(group of the first k words, group of the last k). They are counted, frequent pairs become the
groups of length k + 1, and a semi-join with them leaves the next relation. Groups are
numbered, so pairs of numbers stand for phrases exactly.

The semi-join is a look-up in a broadcast of the groups while their counted number is small,
else a shuffled join; both give the same relation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from plantgauge.llm.common import chunks, ship_package, stored, whole_text
from plantgauge.operators.bounds import row_count, small_side
from plantgauge.operators.prefix import numbered

LONGEST = 5
LEAST = 100
TOP = 2000
NO_LANG = "und"

# words and groups that may be broadcast (a word takes some 100 bytes in a worker, a group 8)
WORD_ROWS = 200_000
GROUP_ROWS = 2_000_000
# distinct words or pairs that one task adds up before it passes them on
COUNTED = 300_000
PAIRS = 700_000
# bytes of a block of a text, and positions of one batch of a relation
BLOCK_BYTES = 1 << 20
BATCH = 1 << 19

BREAK = b"\xff"  # no byte of UTF-8
BYTES = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))

RELATION = "block long, own int, at array<int>, gid array<long>"


def blocks(text: str, ahead: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, own) of each block of a text: words in order with ``BREAK`` between pieces.
    The first ``own`` places belong to the block, up to ``ahead`` more follow them so that
    phrases which begin in the block are whole."""
    data = text.encode().translate(BYTES).replace(BREAK, b" " + BREAK + b" ")
    held, start = [], 0
    while start < len(data):
        cut = data.find(b" ", start + BLOCK_BYTES)
        cut = len(data) if cut < 0 else cut
        held += data[start:cut].split()
        start = cut
        if start < len(data) and len(held) > ahead:
            yield held, len(held) - ahead
            held = held[len(held) - ahead :]
    if held:
        yield held, len(held)


def named_texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))
    return docs.select(lang.alias("lang"), whole_text().alias("text"))


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word, n of the frequent words, and one row per lang with a null word and the
    number of all words."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows():
            for lang, words in held.items():
                words.pop(BREAK, None)
                names = [None, *(w.decode() for w in words)]
                figures = [words.total(), *words.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(figures, pa.int64())],
                    schema=schema,
                )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = held.setdefault(lang, Counter())
                for words, n in blocks(text.as_py(), 0):
                    own.update(words)
                if sum(map(len, held.values())) > COUNTED:
                    yield from rows()
                    held.clear()
        yield from rows()

    sums = named_texts(docs).mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("word").isNull() | (F.col("n") >= least))


def list_column(values: np.ndarray, sizes: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.asarray(sizes, dtype=np.int64)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def relation_batch(numbers, owns, sizes, at, gid) -> pa.RecordBatch:
    columns = [
        pa.array(numbers, pa.int64()), pa.array(owns, pa.int32()),
        list_column(at, sizes, pa.int32()), list_column(gid, sizes, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "own", "at", "gid"])


def gathered(flat: DataFrame) -> DataFrame:
    """A relation from rows (block, own, at, gid); a block has a bounded number of them."""
    rows = flat.groupBy("block", "own").agg(F.sort_array(F.collect_list(F.struct("at", "gid"))).alias("e"))
    return rows.select("block", "own", F.col("e.at").alias("at"), F.col("e.gid").alias("gid"))


def first_relation(docs: DataFrame, words: DataFrame, n_words: int, ahead: int) -> DataFrame:
    """The occurrences of the frequent words (gid, lang, word)."""
    texts = named_texts(docs)

    def numbers():
        task = TaskContext.get()
        at = (task.partitionId() if task else 0) << 33
        while True:
            yield at
            at += 1

    if n_words <= WORD_ROWS:
        known: dict[str, dict[bytes, int]] = {}
        for r in words.select("lang", "word", "gid").collect():  # counted above
            known.setdefault(r["lang"], {})[r["word"].encode()] = r["gid"]
        table = docs.sparkSession.sparkContext.broadcast(known)

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = numbers()

            def rows(ids, owns, sizes):
                ids = np.array(ids, dtype=np.int64)
                sizes = np.array(sizes)
                starts = np.cumsum(sizes) - sizes
                kept = np.flatnonzero(ids >= 0)
                row = np.searchsorted(starts, kept, side="right") - 1
                return relation_batch(
                    [next(number) for _ in owns], owns, np.bincount(row, minlength=len(sizes)), kept - starts[row], ids[kept]
                )

            ids, owns, sizes = [], [], []
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                    get = table.value.get(lang, {}).get
                    for found, own in blocks(text.as_py(), ahead):
                        ids.extend(map(get, found, repeat(-1)))
                        owns.append(own)
                        sizes.append(len(found))
                        if len(ids) > BATCH:
                            yield rows(ids, owns, sizes)
                            ids, owns, sizes = [], [], []
            if ids:
                yield rows(ids, owns, sizes)

        return texts.mapInArrow(looked_up, RELATION)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for found, own in blocks(text.as_py(), ahead):
                    n = next(number)
                    places = [i for i, w in enumerate(found) if w != BREAK]
                    size = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([n] * size, pa.int64()), pa.array([own] * size, pa.int32()), pa.array(places, pa.int32()),
                            pa.array([lang] * size, pa.string()), pa.array([found[i].decode() for i in places], pa.string()),
                        ],
                        names=["block", "own", "at", "lang", "word"],
                    )

    flat = texts.mapInArrow(spelt, "block long, own int, at int, lang string, word string")
    return gathered(flat.join(words.select("gid", "lang", "word"), ["lang", "word"]).select("block", "own", "at", "gid"))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a relation in parts of about ``BATCH`` occurrences."""
    for batch in batches:
        for a, b in chunks(np.diff(batch.column("at").offsets.to_numpy()), BATCH):
            yield batch.slice(a, b - a)


def adjacent(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge join of a batch of the relation with itself one position on: row, position,
    group there and group at the next position of the same piece."""
    at_lists, gid_lists = batch.column("at"), batch.column("gid")
    offsets = at_lists.offsets.to_numpy()
    at = at_lists.values.to_numpy()[offsets[0] : offsets[-1]]
    gid = gid_lists.values.to_numpy()[gid_lists.offsets[0].as_py() : gid_lists.offsets[-1].as_py()]
    offsets = offsets - offsets[0]
    meets = at[1:] == at[:-1] + 1
    ends = offsets[1:-1]
    ends = ends[(ends > 0) & (ends < len(at))]
    meets[ends - 1] = False  # the next entry is another block
    first = np.flatnonzero(meets)
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, at[first], gid[first], gid[first + 1]


def summed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and their sums of ``n``."""
    if not len(left):
        return left, right, n
    top = int(right.max()) + 1
    if int(left.max()) < (1 << 62) // top:
        key = left * top + right
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
    else:  # too many groups for one number
        order = np.lexsort((right, left))
        new = (np.diff(left[order], prepend=-1) != 0) | (np.diff(right[order], prepend=-1) != 0)
    starts = np.flatnonzero(new)
    return left[order[starts]], right[order[starts]], np.add.reduceat(n[order], starts)


def pair_counts(relation: DataFrame, least: int) -> DataFrame:
    """l, r, n of every pair of neighbouring groups that occurs ``least`` times."""
    schema = pa.schema([("l", pa.int64()), ("r", pa.int64()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, merged = [], 0, 0

        def merge():
            return summed(*(np.concatenate(c) for c in zip(*held)))

        def out(columns):
            for i in range(0, len(columns[0]), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + BATCH], pa.int64()) for c in columns], schema=schema)

        for batch in cut(batches):
            row, at, left, right = adjacent(batch)
            own = batch.column("own").to_numpy()[row]
            left, right = left[at < own], right[at < own]
            held.append((left, right, np.ones(len(left), dtype=np.int64)))
            size += len(left)
            if size > 2 * merged + PAIRS:
                held = [merge()]
                size = merged = len(held[0][0])
                if merged > PAIRS:
                    yield from out(held[0])
                    held, size, merged = [], 0, 0
        if held:
            yield from out(merge())

    sums = relation.mapInArrow(counted, "l long, r long, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= least)


def next_relation(relation: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """The occurrences of the groups (gid, l, r), numbered in the order of (l, r)."""
    if n_groups <= GROUP_ROWS:
        found = groups.select("l", "r", "gid").toPandas().sort_values("gid")  # counted above
        left, right = found["l"].to_numpy(), found["r"].to_numpy()
        firsts, starts = np.unique(left, return_index=True)
        top = int(right.max(initial=0)) + 1
        table = relation.sparkSession.sparkContext.broadcast((firsts, np.searchsorted(firsts, left) * top + right, top))

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, keys, top = table.value
            for batch in cut(batches):
                row, at, left, right = adjacent(batch)
                if len(keys) and len(left):
                    place = np.minimum(np.searchsorted(firsts, left), len(firsts) - 1)
                    key = place * top + right
                    gid = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    kept = (keys[gid] == key) & (firsts[place] == left) & (right < top)
                    row, at, gid = row[kept], at[kept], gid[kept]
                else:
                    row = at = gid = np.zeros(0, dtype=np.int64)
                sizes = np.bincount(row, minlength=batch.num_rows)
                rows = relation_batch(batch.column("block"), batch.column("own"), sizes, at, gid)
                yield rows.filter(pa.array(sizes > 1))  # a lone occurrence has no neighbour to be joined with

        return relation.mapInArrow(looked_up, RELATION)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            row, at, left, right = adjacent(batch)
            block, own = (batch.column(c).to_numpy()[row] for c in ("block", "own"))
            columns = [pa.array(block, pa.int64()), pa.array(own, pa.int32()), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["block", "own", "at", "l", "r"]
            )

    flat = relation.mapInArrow(paired, "block long, own int, at int, l long, r long")
    return gathered(flat.join(groups.select("gid", "l", "r"), ["l", "r"]).select("block", "own", "at", "gid"))


def frequent_groups(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """Totals (lang, total) and, per phrase length, a table gid, lang, phrase, last, n, pre,
    suf (counts of the first and of the last 1, 2, ... words), and l, r from two words on."""
    ship_package(docs.sparkSession)
    counts = stored(word_counts(docs, least), "word_counts")
    totals = counts.where(F.col("word").isNull()).select("lang", F.col("n").alias("total"))
    words = numbered(counts.where(F.col("word").isNotNull()), [], ["lang", "word"], "gid").drop("total_rows")
    words = stored(words.withColumn("gid", F.col("gid").cast("long")), "words")
    none = F.array().cast("array<long>")
    levels = [words.select("gid", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("pre"), none.alias("suf"))]
    relation = stored(first_relation(docs, words, row_count(words), longest - 1), "occurrences")
    for k in range(2, longest + 1):
        pairs = stored(pair_counts(relation, least), "pairs")
        groups = numbered(pairs, [], ["l", "r"], "gid").drop("total_rows")
        groups = stored(groups.withColumn("gid", F.col("gid").cast("long")), "groups")
        before = levels[-1]
        head = before.select(F.col("gid").alias("l"), "lang", F.col("phrase").alias("head"), F.col("n").alias("head_n"), "pre")
        tail = before.select(F.col("gid").alias("r"), "last", F.col("n").alias("tail_n"), "suf")
        level = groups.join(head, "l").join(tail, "r").select(
            "gid", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "n",
            F.concat("pre", F.array("head_n")).alias("pre"), F.concat("suf", F.array("tail_n")).alias("suf"), "l", "r",
        )
        levels.append(stored(level, "phrases"))
        if k < longest:
            relation = stored(next_relation(relation, groups, row_count(groups)), "occurrences")
    return totals, levels


def scored(level: DataFrame, words: int) -> DataFrame:
    """Adds ``cut``: score, first words, l and r of the lowest-scoring cut; needs ``total``.

    Decimals of 38 digits hold the products exactly for phrases of up to 10^15 and corpora of
    up to 10^18 occurrences.
    """
    whole = f"cast({1000} as decimal(4,0)) * cast(n as decimal(16,0)) * cast(total as decimal(18,0))"

    def cut(k):
        left, right = f"pre[{k - 1}]", f"suf[{words - k - 1}]"
        parts = f"(cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))"
        return f"struct(({whole}) div {parts} as score, {k} as k, {left} as l, {right} as r)"

    return level.withColumn("cut", F.expr(f"array_min(array({', '.join(cut(k) for k in range(1, words))}))"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every lang.

    ``docs`` has text and lang; a null text is empty, a null lang is ``und``. Repeated rows
    count each, equal scores and counts are ranked by phrase. Texts without a frequent phrase
    or an empty table give no row. Other columns play no part.
    """
    totals, levels = frequent_groups(docs, longest, least)
    found = None
    for words in range(2, longest + 1):
        level = levels[words - 1]
        if words < longest:  # as frequent within one word more
            more = levels[words]
            wider = more.select(F.col("l").alias("gid"), "n").unionByName(more.select(F.col("r").alias("gid"), "n"))
            level = level.join(wider.distinct(), ["gid", "n"], "left_anti")
        rows = scored(level.join(small_side(totals), "lang"), words).select(
            "lang", "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
            F.col("total").alias("n"), F.col("cut.score").alias("score"),
        )
        found = rows if found is None else found.unionByName(rows)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(spread))).orderBy(*best)
    first = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
