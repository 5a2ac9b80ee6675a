"""Exact removal of long repeated byte strings.

Every string of ``WIDTH`` bytes is anchored at the least hashed gram of ``GRAM``
bytes in it, so equal strings have equal anchors at equal offsets. All strings of
one anchor place form a range, one row per about 170 bytes. Rows of equal anchor
grams are compared by refinement, each round a grouped count:

1. ranges whose whole text repeats are repeated throughout; anchors that stand
   only once are dropped;
2. the other ranges are cut into bins of ``BIN`` offsets. What all strings of a bin
   share must repeat, or none does; if all that they cover repeats, all do;
3. what is left between the two, the edges of repeats, is compared string by string.

One text stands for each distinct range, bin or cover, so copies cost nothing more,
and no group meets in one task: the rounds are hash aggregates and joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantgauge.llm.common import chunks, stored, whole_text
from plantgauge.llm.wordhash import _LETTER, mix, powers

WIDTH = 400
GRAM = 64
BIN = 16
SPAN = WIDTH - GRAM + 1
CHUNK_BYTES = 400_000
LOW = np.uint64((1 << 24) - 1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LETTER[data] * up[: len(data)])])


def string_hash(sums: np.ndarray, start, end) -> np.ndarray:
    """Hashes of data[start:end], independent of the place."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + np.asarray(end - start).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Ranges of a block of texts (bytes of all, bounds of each): text, first and
    last start, anchor place (all within the text), anchor hash, range hash."""
    empty = (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    if len(data) < WIDTH:
        return empty
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = string_hash(sums, at, at + GRAM)
    # least hash, the rightmost on ties; places are packed relative to their piece
    starts = len(gram) - SPAN + 1
    place = np.empty(starts, dtype=np.int64)
    piece = int(LOW) + 2 - SPAN
    for a in range(0, starts, piece):
        own = gram[a : a + piece + SPAN - 1]
        low, size = (own & ~LOW) | (LOW - np.arange(len(own), dtype=np.uint64)), 1
        while size * 2 <= SPAN:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
        place[a : a + piece] = a + (LOW - (low & LOW)).astype(np.int64)
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - WIDTH + 1, 0))
    count = np.maximum(lengths - WIDTH + 1, 0)
    start = offsets[:-1][text] + (np.arange(len(text)) - (np.cumsum(count) - count)[text])
    if not len(start):
        return empty
    place = place[start]
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(new[1:], len(start)) - 1
    s, e, p, t = start[new], start[last], place[new], text[new]
    own = string_hash(sums, s, e + WIDTH)
    own = mix(own + (p - s).astype(np.uint64))
    base = offsets[:-1][t]
    return t, s - base, e - base, p - base, gram[p], own


def blocks_of(batch: pa.RecordBatch, at: int):
    """(first row, last row, bytes, bounds) of bounded blocks of a binary column."""
    column = batch.column(at)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    for a, b in chunks(np.diff(offsets), CHUNK_BYTES):
        yield a, b, whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def ranges_of(rows: DataFrame) -> DataFrame:
    """(node, s, e, p, anchor, own) of rows (node, data)."""

    def cut(batches):
        for batch in batches:
            nodes = batch.column(0)
            for a, b, data, offsets in blocks_of(batch, 1):
                t, s, e, p, anchor, own = anchors(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [nodes.take(pa.array(a + t)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(p.astype(np.int32)), signed(anchor), signed(own)],
                    names=["node", "s", "e", "p", "anchor", "own"],
                )

    return rows.mapInArrow(cut, "node binary, s int, e int, p int, anchor long, own long")


def lists(column, names):
    """A list-of-struct Arrow column as (row, field arrays)."""
    flat = column.flatten()
    sizes = np.diff(np.asarray(column.offsets))
    return np.repeat(np.arange(len(column)), sizes), [np.asarray(flat.field(n)) for n in names]


def bins_of(rows: DataFrame) -> DataFrame:
    """(core, cover, node, lo, hi, p, single) of rows (node, data, ranges): per bin of
    offsets, the hash of what its strings share and of all they cover."""

    def cut(batches):
        for batch in batches:
            row, (s, e, p, single) = lists(batch.column(2), ["s", "e", "p", "single"])
            for a, b, data, offsets in blocks_of(batch, 1):
                mine = np.flatnonzero((row >= a) & (row < b))
                if not len(mine):
                    continue
                s_, e_, p_ = s[mine].astype(np.int64), e[mine].astype(np.int64), p[mine].astype(np.int64)
                low, high = (p_ - e_) // BIN, (p_ - s_) // BIN  # bins of offsets p - start
                n = high - low + 1
                which = np.repeat(np.arange(len(mine)), n)
                d0 = (low[which] + (np.arange(len(which)) - (np.cumsum(n) - n)[which])) * BIN
                lo, hi = np.maximum(s_[which], p_[which] - d0 - BIN + 1), np.minimum(e_[which], p_[which] - d0)
                base, sums = offsets[:-1][row[mine][which] - a], prefix_sums(data)
                place = p_[which] + base
                core = mix(string_hash(sums, place - d0, place + WIDTH - d0 - BIN + 1) + d0.astype(np.uint64))
                cover = mix(string_hash(sums, lo + base, hi + base + WIDTH) + (p_[which] - lo).astype(np.uint64) * np.uint64(3) + core)
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(core), signed(cover), batch.column(0).take(pa.array(row[mine][which])), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                        pa.array(p_[which].astype(np.int32)), pa.array(single[mine][which].astype(bool)),
                    ],
                    names=["core", "cover", "node", "lo", "hi", "p", "single"],
                )

    return rows.mapInArrow(cut, "core long, cover long, node binary, lo int, hi int, p int, single boolean")


def strings_of(rows: DataFrame) -> DataFrame:
    """(core, string, node, at, single) of rows (node, data, bins): every single string. Equal
    strings share the core of their bin, so two 64-bit hashes tell strings apart."""

    def cut(batches):
        for batch in batches:
            row, (lo, hi, p, single, core) = lists(batch.column(2), ["lo", "hi", "p", "single", "core"])
            for a, b, data, offsets in blocks_of(batch, 1):
                mine = np.flatnonzero((row >= a) & (row < b))
                if not len(mine):
                    continue
                n = (hi[mine] - lo[mine] + 1).astype(np.int64)
                which = np.repeat(mine, n)
                at = lo[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
                start = at + offsets[:-1][row[which] - a]
                h = mix(string_hash(prefix_sums(data), start, start + WIDTH) + (p[which] - at).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(core[which]), signed(h), batch.column(0).take(pa.array(row[which])), pa.array(at.astype(np.int32)),
                        pa.array(single[which].astype(bool)),
                    ],
                    names=["core", "string", "node", "at", "single"],
                )

    return rows.mapInArrow(cut, "core long, string long, node binary, at int, single boolean")


def repeated_runs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, runs) with the starts of repeated strings of each distinct text as
    runs (lo, hi), and the texts (node, data) they belong to."""
    ranges = stored(ranges_of(rows), "ranges")
    contexts = ranges.groupBy("anchor", "own").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "s", "e", "p")).alias("one"))
    groups = contexts.groupBy("anchor").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    contexts = stored(contexts.join(groups, "anchor").drop("all"), "contexts")
    same = contexts.where("n > 1").select("anchor", "own")
    runs = stored(ranges.join(same, ["anchor", "own"], "left_semi").select("node", F.col("s").alias("lo"), F.col("e").alias("hi")).distinct(), "runs")
    open_ = contexts.where("kinds > 1").select("one.*", (F.col("n") == 1).alias("single"))
    by_text = stored(open_.groupBy("node").agg(F.collect_list(F.struct("s", "e", "p", "single")).alias("ranges")), "open")
    wanted = by_text.select("node").unionByName(runs.select("node")).distinct()
    texts = stored(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("data").alias("data")), "texts")

    bins = stored(bins_of(texts.join(by_text, "node").select("node", "data", "ranges")), "bins")
    covers = bins.groupBy("core", "cover").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "lo", "hi", "p", "single")).alias("one")
    )
    cores = covers.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"))
    covers = stored(covers.join(cores, "core"), "covers")
    more = bins.join(covers.where("n > 1").select("core", "cover"), ["core", "cover"], "left_semi").where("single").select("node", "lo", "hi")
    edges = covers.where("kinds > 1").select("core", "one.node", "one.lo", "one.hi", "one.p", (F.col("one.single") & (F.col("n") == 1)).alias("single"))
    edges = edges.groupBy("node").agg(F.collect_list(F.struct("lo", "hi", "p", "single", "core")).alias("bins"))
    strings = stored(strings_of(texts.join(edges, "node").select("node", "data", "bins")), "strings")
    twice = strings.groupBy("core", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "string")
    last = strings.join(twice, ["core", "string"], "left_semi").where("single").select("node", F.col("at").alias("lo"), F.col("at").alias("hi"))
    every = runs.unionByName(more).unionByName(last)
    return every.groupBy("node").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), texts


def covered(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by strings starting in the given runs."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64) + WIDTH)
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def drop_repeated_strings(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans (long), kept_sha256 (string) and
    kept_text (string: what remains; a character cut in half is left out).

    Each byte covered by a string of WIDTH bytes that also starts anywhere else in
    the table, same document included, is removed, judged on the input. A null text
    is empty; texts below WIDTH bytes lose nothing; a text that stands in several
    rows loses all its bytes in each. An empty table stays empty. Columns of these
    names are replaced, any others are kept. Strings are told apart by two 64-bit hashes.
    """
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    whole = whole_text(text)
    data = F.encode(whole, "UTF-8")
    carried = [c for c in df.columns if c not in own]
    # the caller's columns travel as one, so that no name can clash
    rows = df.select(
        F.unhex(F.md5(data)).alias("node"), F.length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("whole"),
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), whole.alias("text"),
    )
    runs, texts = repeated_runs(rows.select("node", F.encode("text", "UTF-8").alias("data")))

    def cut(batches):
        for batch in batches:
            row, (lo, hi) = lists(batch.column(2), ["lo", "hi"])
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            removed, spans, digests, kept = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                mine = slice(bounds[i], bounds[i + 1])
                start, end = covered(lo[mine], hi[mine])
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(t)]
                pieces = [t[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)]
                rest = b"".join(pieces)
                removed.append(len(t) - len(rest))
                spans.append(len(start))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append("".join(p.decode("utf-8", "ignore") for p in pieces))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                names=["node", "removed", "spans", "digest", "rest"],
            )

    cuts = texts.join(runs, "node").select("node", "data", "runs").mapInArrow(cut, "node binary, removed long, spans long, digest string, rest string")
    return rows.join(cuts, "node", "left").select(
        "row.*",
        "n_bytes",
        F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("digest", "whole").alias("kept_sha256"),
        F.coalesce("rest", "text").alias("kept_text"),
    )

