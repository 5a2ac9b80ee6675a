"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages; a passage is a TF-IDF vector over the words of
the benchmark items. A distributed randomised SVD of all passages (random test
matrix, range by A'A, small eigenproblem, SVD of what is left) gives the latent
space. Every window of every document that could hold an item is compared with
all items by latent cosine. The rank is far below the number of items, so some items
are hardly in that space: windows that hold as many of an item's rarest words as a
leak must hold are candidates too, whatever their cosine, and no leak is lost.
Candidates are checked by longest common subsequence of words and by the item's
answer words, its rarest ones.

Three passes over the documents: passage frequencies, range, search.
What is summed over the corpus is a vocabulary-sized table per partition, added
up in two levels by key. The items are the stated query set: they are taken in
blocks of ``BLOCK_ITEMS``, so what a task receives is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from plantgauge.llm.common import chunks, in_arrow, keeps_names, stored, whole_text
from plantgauge.llm.wordhash import word_hashes

BLOCK_ITEMS = 2_000
# words of a step, of a passage (in steps)
STEP, PASSAGE = 8, 4
RANK, OVERSAMPLE = 96, 16
# the weight of a word is its IDF less this, or the least weight
IDF_FLOOR, LEAST_WEIGHT = 3.0, 0.1
# a window is a candidate with this latent cosine and this share of the item's
# own projection
COSINE, PROJECTION = 0.65, 0.6
# a leak shares so much of the item in order, or somewhat less and half its answer
SHARE, LESS_SHARE, ANSWER = 0.8, 0.6, 0.5
CHUNK_BYTES = 300_000
SLICE = 4096


class Items:
    """One block of benchmark items: hashed words, vocabulary, lengths in steps."""

    def __init__(self, ids: list, texts: list[str]):
        words, bounds = word_hashes([t.lower() for t in texts], at_marks=True)
        self.ids = [i for i, n in zip(ids, np.diff(bounds)) if n]
        self.words = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
        self.lists = [w.tolist() for w in self.words]
        self.sets = [frozenset(w) for w in self.lists]
        self.vocabulary = np.unique(words)
        self.steps = np.array([-(-len(w) // STEP) + 1 for w in self.words], dtype=np.int64)


def index_in(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word in the sorted vocabulary, -1 where it is none."""
    if not len(vocabulary):
        return np.full(len(words), -1)
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == words, at, -1)


def places(vocabulary: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Index in a part of the vocabulary of each of its words, and of none (the last), -1 if not there."""
    return np.append(index_in(part, vocabulary), -1)


def steps_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every step of STEP words, and the first step of each text."""
    n = -(-np.diff(bounds) // STEP)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    return bounds[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * STEP, first


def passages_of(bounds: np.ndarray) -> np.ndarray:
    """First word of every passage."""
    size = STEP * PASSAGE
    n = -(-np.diff(bounds) // size)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    return bounds[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * size


def blocks_of(batches, at: int = 0):
    """(texts in lower case, words, bounds) of bounded blocks."""
    for batch in batches:
        column = batch.column(at)
        sizes = [len(t) for t in column.to_pylist()]
        for a, b in chunks(sizes, CHUNK_BYTES):
            words, bounds = word_hashes([t.lower() for t in column.slice(a, b - a).to_pylist()], at_marks=True)
            yield a, b, batch, words, bounds


def summed(rows: DataFrame, fold, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all partitions of the tables ``fold(blocks)`` makes of each."""

    def table(batches):
        total = np.zeros(shape)
        fold(total, blocks_of(batches))
        flat = total.ravel()
        part = TaskContext.get().partitionId()
        cuts = range(0, len(flat), SLICE)
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array(list(range(len(cuts))), pa.int32()), "salt": pa.array([part % 32] * len(cuts), pa.int32()), "data": pa.array([flat[i : i + SLICE].tobytes() for i in cuts], pa.binary())}
        )

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for data in group.column("data"):
            total = total + np.frombuffer(data.as_py(), dtype=np.float64)
        return pa.table({"slice": group.column("slice").slice(0, 1), "salt": group.column("salt").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    kind = "slice int, salt int, data binary"
    parts = in_arrow(rows, table, kind).groupBy("slice", "salt").applyInArrow(add, kind).groupBy("slice").applyInArrow(add, kind).collect()
    out = np.zeros(int(np.prod(shape)))
    for r in parts:
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(r["data"]) // 8] = np.frombuffer(r["data"], dtype=np.float64)
    return out.reshape(shape)


def segment_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows between starts; every segment has a row."""
    return np.add.reduceat(rows, starts, axis=0) if len(starts) else np.zeros((0,) + rows.shape[1:])


def gathered(at: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of table rows over the known words of each segment: the known words,
    the number of the sum each belongs to, the segment of each sum, the sums."""
    held = np.flatnonzero(at >= 0)
    segment = np.searchsorted(starts, held, side="right") - 1
    at = at[held]
    change = np.flatnonzero(np.diff(segment, prepend=-1))
    counts = np.diff(np.append(change, len(at)))
    # segments are short: the longest first, one word of each at a time
    order = np.argsort(-counts, kind="stable")
    first, n = change[order], counts[order]
    ordered = table[at[first]]
    for k in range(1, int(counts.max(initial=0))):
        more = np.searchsorted(-n, -k)
        ordered[:more] += table[at[first[:more] + k]]
    sums = np.empty_like(ordered)
    sums[order] = ordered
    return at, np.repeat(np.arange(len(change)), counts), segment[change], sums


class Latent:
    """The weighted words, the latent basis, and each item's answer words.

    A word counts with its IDF over all passages less IDF_FLOOR; words below that
    count only if they are among an item's rarest third, so every item has some.
    """

    def __init__(self, docs: DataFrame, items: Items, seed: int = 1):
        rows, every = docs.select("_d_text"), items.vocabulary
        size = len(every)

        def frequencies(total, blocks):
            for _, _, _, words, bounds in blocks:
                at, starts = index_in(every, words), passages_of(bounds)
                held = np.flatnonzero(at >= 0)
                passage = np.searchsorted(starts, held, side="right") - 1
                pairs = np.unique(passage * (size + 1) + at[held]) % (size + 1)
                total[:size] += np.bincount(pairs, minlength=size)[:size]
                total[size] += len(starts)

        counts = summed(rows, frequencies, (size + 1,))
        idf = np.log((1 + counts[size]) / (1 + counts[:size]))
        rare = answer_words(items, idf)
        self.answers = [frozenset(x.tolist()) for x in rare]
        self.lists = [Postings(rare, [-(-len(x) // 2) for x in rare]), Postings(*needed_words(items, idf))]
        active = (idf > IDF_FLOOR + LEAST_WEIGHT) | np.isin(every, np.concatenate(rare))
        self.vocabulary = vocabulary = every[active]
        self.places = [places(every, part) for part in (vocabulary, *(p.words for p in self.lists))]
        weight = np.maximum(idf[active] - IDF_FLOOR, LEAST_WEIGHT).astype(np.float32)
        width = min(RANK + OVERSAMPLE, len(vocabulary))
        test = np.random.default_rng(seed).standard_normal((len(vocabulary), width)).astype(np.float32)
        spread = test * weight[:, None]

        def ranges(total, blocks):
            for _, _, _, words, bounds in blocks:
                at, passage, _, sums = gathered(index_in(vocabulary, words), passages_of(bounds), spread)
                if len(at):
                    order = np.argsort(at, kind="stable")
                    change = np.flatnonzero(np.diff(at[order], prepend=-1))
                    total[at[order][change]] += segment_sums(sums[passage[order]], change)

        # A'A is close to Y (T'Y)^-1 Y' for Y = A'A T: the small problem needs no pass
        sample = summed(rows, ranges, test.shape) * weight[:, None]
        values, turn = np.linalg.eigh((test.T @ sample + sample.T @ test) / 2)
        firm = values > 1e-6 * max(values.max(initial=0), 1e-12)
        basis, singular, _ = np.linalg.svd(sample @ turn[:, firm] / np.sqrt(values[firm]), full_matrices=False)
        self.singular, self.basis = singular[:RANK], basis[:, :RANK].astype(np.float32)
        self.project = self.basis * weight[:, None]
        at = [index_in(vocabulary, w) for w in items.words]
        self.items = np.stack([self.project[x[x >= 0]].sum(axis=0) for x in at]).astype(np.float32)
        self.norms = np.sqrt((self.items * self.items).sum(axis=1))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = where.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def answer_words(items: Items, idf: np.ndarray) -> list[np.ndarray]:
    """The rarest third of each item's distinct words."""
    out = []
    for words in items.words:
        own = np.unique(words)
        rare = own[np.argsort(-idf[np.searchsorted(items.vocabulary, own)], kind="stable")]
        out.append(rare[: max(1, len(own) // 3)])
    return out


def needed_words(items: Items, idf: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """The rarest words of each item, and how many of their places a text with SHARE
    of the item's words must hold: all but those it may miss."""
    out, least = [], []
    for words in items.words:
        missed = len(words) - int(np.ceil(SHARE * len(words) - 1e-9))
        rare = words[np.argsort(-idf[np.searchsorted(items.vocabulary, words)], kind="stable")][: 2 * missed + 2]
        out.append(np.unique(rare))
        least.append(len(rare) - missed)
    return out, least


class Postings:
    """The items of each listed word, and how many hits each item needs."""

    def __init__(self, lists: list[np.ndarray], least: list[int]):
        words, item = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(words, kind="stable")
        self.words, self.first = np.unique(words[order], return_index=True)
        self.item, self.first, self.least = item[order], np.append(self.first, len(words)), np.array(least)

    def windows(self, at: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, first and last step of every run of hits that is enough for the
        item and fits in the item's steps; ``at`` numbers the listed words of a block."""
        held = np.flatnonzero(at >= 0)
        n = (self.first[1:] - self.first[:-1])[at[held]]
        which = np.repeat(np.arange(len(held)), n)
        item = self.item[self.first[at[held]][which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]]
        step = (np.searchsorted(starts, held, side="right") - 1)[which]
        order = np.argsort(item * (len(starts) + 1) + step, kind="stable")
        item, step = item[order], step[order]
        end = np.arange(len(item)) + self.least[item] - 1
        inside = np.flatnonzero(end < len(item))
        end = end[inside]
        good = (item[end] == item[inside]) & (step[end] - step[inside] < steps[item[inside]])
        return item[inside][good], step[inside][good], step[end][good]


def search(words: np.ndarray, bounds: np.ndarray, items: Items, latent: Latent) -> dict:
    """{(text, item): (lcs share, answer share, cosine)} of the leaks in a block."""
    vectors, norms, answers = latent.items, latent.norms, latent.answers
    starts, first = steps_of(bounds)
    if not len(starts):
        return {}
    known = index_in(items.vocabulary, words)
    weighted, *listed = (place[known] for place in latent.places)
    _, _, step, vector = gathered(weighted, starts, latent.project)
    dense = np.zeros((len(starts) + 1, vectors.shape[1]))
    dense[step] = vector
    reach = np.zeros(len(starts) + 1)
    reach[step + 1] = np.sqrt((vector * vector).sum(axis=1))
    reach = np.cumsum(reach)

    def window_vectors(low, high):
        """Sums of the steps of windows; the last row of ``dense`` is zero."""
        out = np.zeros((len(low), vectors.shape[1]))
        for k in range(int((high - low).max(initial=0))):
            out += dense[np.where(low + k < high, low + k, len(starts))]
        return out.astype(np.float32)

    before = np.searchsorted(step, np.arange(len(starts) + 1))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last_step, last_word = first[1:][text], bounds[1:][text]
    best: dict = {}
    runs = [np.concatenate(x) for x in zip(*(p.windows(at, starts, items.steps) for p, at in zip(latent.lists, listed)))]
    inner = text[runs[1]] == text[runs[2]]
    runs = [x[inner] for x in runs]
    for length in np.unique(items.steps):
        mine = np.flatnonzero(items.steps == length)
        low = np.arange(len(starts))
        # the last windows of a text are shorter; one that a longer window holds is left out
        full = (low + length <= last_step) | (low == first[:-1][text])
        low = low[full]
        high = np.minimum(low + length, last_step[low])
        # a window is no longer than its steps put end to end: most are too short for any item
        strong = np.flatnonzero(reach[high] - reach[low] >= PROJECTION * norms[mine].min() - 1e-4)
        # item vectors are scaled so that an item's own projection is 1; a window's projections
        # are the sums of those of its steps
        shares = np.zeros((len(mine), len(step) + 1))
        shares[:, 1:] = (vectors[mine] / np.maximum(norms[mine], 1e-6)[:, None] ** 2) @ vector.T
        shares = np.cumsum(shares, axis=1)
        share_of = np.take(shares, before[high[strong]], axis=1)
        share_of -= np.take(shares, before[low[strong]], axis=1)
        near = np.divmod(np.flatnonzero(share_of >= PROJECTION), max(len(strong), 1))[::-1]
        some, which = np.unique(near[0], return_inverse=True)
        size = np.sqrt((window_vectors(low[strong[some]], high[strong[some]]) ** 2).sum(axis=1))[which]
        cosine = share_of[near[1], near[0]] * norms[mine][near[1]] / np.maximum(size, 1e-6)
        hit = np.flatnonzero(cosine >= COSINE)
        # windows that hold a run of hits, those at the ends of a text cut short
        own = items.steps[runs[0]] == length
        item, one, last = (x[own] for x in runs)
        begin = first[:-1][text[one]]
        lowest = np.maximum(begin, np.minimum(last - length + 1, last_step[one] - length))
        highest = np.maximum(lowest, np.minimum(one, last_step[one] - length))
        n = highest - lowest + 1
        which = np.repeat(np.arange(len(n)), n)
        held = np.searchsorted(low, lowest[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which])
        pairs = np.unique(np.concatenate([strong[near[0][hit]] * len(mine) + near[1][hit], held * len(mine) + np.searchsorted(mine, item[which])]))
        at, of = pairs // max(len(mine), 1), pairs % max(len(mine), 1)
        window = window_vectors(low[at], high[at])
        size = np.maximum(np.sqrt((window**2).sum(axis=1)), 1e-6)
        angles = (window * vectors[mine][of]).sum(axis=1) / np.maximum(norms[mine][of], 1e-6) / size
        for w, i, angle in zip(at, of, angles):
            item = int(mine[i])
            a, b = starts[low[w]], min(starts[low[w]] + length * STEP, last_word[low[w]])
            passage = words[a:b]
            there = set(passage.tolist())
            answer = len(answers[item] & there) / len(answers[item])
            # words of the item that the passage holds bound what it holds in order
            least = LESS_SHARE if answer >= ANSWER else SHARE
            n_item = len(items.words[item])
            if (n_item - len(items.sets[item] - there)) / n_item < least or sum(map(there.__contains__, items.lists[item])) / n_item < least:
                continue
            share = common_subsequence(items.words[item], passage) / n_item
            if share >= SHARE or share >= LESS_SHARE and answer >= ANSWER:
                key = (int(text[low[w]]), item)
                value = (share, answer, float(angle))
                if value > best.get(key, (0.0, 0.0, 0.0)):
                    best[key] = value
    return best


LEAKS = "array<struct<item:long,lcs_share:double,answer_share:double,cosine:double>>"


@keeps_names("_d_")
def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items found in each whole text, each
    with the share of its words in common order, of its answer words, and the
    latent cosine of the best window.

    Null and empty texts, and items without words, give no leaks; items with a null
    id are left out. Rows are independent, so repeated rows get equal results; an
    empty table stays empty. A column named leaks is replaced.
    """
    listed = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), whole_text(item_text).alias("text")).distinct()
    n = listed.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    rows = docs.drop("leaks").withColumn("_d_text", whole_text(text)).withColumn("leaks", F.array().cast(LEAKS))
    plain = docs.select(whole_text(text).alias("_d_text"))
    for block in range(blocks):
        # blocks by hash hold BLOCK_ITEMS items on average
        held = sorted(listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect())
        items = Items([r["item"] for r in held], [r["text"] for r in held])
        if items.ids:
            # every block reads the plain documents; what earlier blocks found is written between
            rows = _with_leaks(rows, items, Latent(plain, items))
            rows = stored(rows, "leaks") if block + 1 < blocks else rows
    return rows.drop("_d_text")


def _with_leaks(rows: DataFrame, items: Items, latent: Latent) -> DataFrame:
    names = rows.columns
    text_at, leaks_at = names.index("_d_text"), names.index("leaks")
    kind = pa.list_(pa.struct([("item", pa.int64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64()), ("cosine", pa.float64())]))
    schema = T.StructType(rows.schema.fields)

    def leaks(batches):
        for a, b, batch, words, bounds in blocks_of(batches, text_at):
            out = batch.column(leaks_at).slice(a, b - a).to_pylist()
            for (row, i), (share, answer, cosine) in sorted(search(words, bounds, items, latent).items()):
                out[row] = out[row] + [{"item": items.ids[i], "lcs_share": share, "answer_share": answer, "cosine": cosine}]
            columns = [pa.array(out, kind) if c == leaks_at else batch.column(c).slice(a, b - a) for c in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(rows, leaks, schema)
