"""Spelling variants: words one edit apart, met through pairs of trie nodes.

The distinct words are sorted and their prefixes numbered as nodes of a trie, and again for
the reversed words. A word with position i skipped is then the integer pair (node of what
comes before, node of what comes after), as is a word with a gap before position i. Two words
share a skip pair if they differ by one replaced code point; a skip pair equals a gap pair if
the second word is the first without that code point. A pair holds at most one word per
letter, so its group is bounded by the alphabet.

Both tries are numbered slice by slice of a range-partitioned sort. Nodes that reach across
the bounds of slices are named by the slice they begin in and their depth, which follows from
the first and last word of every slice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plantgauge.llm.common import chunks, ship_package, stored, whole_text
from plantgauge.operators.prefix import SLICE, sliced

LEAST_LENGTH = 6
LEAST_COUNT = 5
# a form is so many times as frequent as its variant
FORM_FACTOR = 5
# one occurrence in so many is misspelt by its hash (a rule of the counted words, see ``respelt``)
MISSPELT = 199
# distinct words that one task counts before it passes them on
COUNTED = 300_000

# letters are single bytes of Latin-1: A-Z in lower case, a-z and U+00C0 to U+00FF as they are
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z in lower case, as Latin-1 bytes (one per code point)."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def respelt(run: bytes, crc: int, every: int) -> bytes:
    """The run, with one code point deleted if ``every`` divides the crc32 of its
    occurrence; ``crc`` is that of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, every: int = MISSPELT) -> DataFrame:
    """word, n: occurrences of every word of at least ``least_length`` code points.

    Each task adds up its words and passes them on whenever it holds ``COUNTED`` of them.
    """
    ship_package(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows():
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                own = Counter(w for w in runs_of(text.as_py()) if len(w) >= least_length)
                crc = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                for run, n in own.items():
                    word = respelt(run, crc, every)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > COUNTED:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    text = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))
    return text.mapInArrow(counted, schema_ddl(schema)).groupBy("word").agg(F.sum("n").alias("n"))


def schema_ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def slice_bounds(ends: list[tuple[int, str, str]]) -> dict[int, tuple[str, str, list[tuple[int, int]]]]:
    """Per slice, from (slice, first word, last word) of all: the prefix its first word shares
    with the slice before, the one its last word shares with the next, and runs (depth up to
    which, slice the node begins in) for the former."""
    ends = sorted(ends)
    common = [0] + [shared(a[2], b[1]) for a, b in zip(ends, ends[1:])] + [0]
    out, runs = {}, []
    for k, (name, first, last) in enumerate(ends):
        left = common[k]
        if k:
            before, start, end = ends[k - 1]
            # nodes that all words of the slice before have in common may begin earlier still
            through = min(common[k - 1], shared(start, end), left)
            kept, upto = [], 0
            for depth, owner in runs:
                if upto < through:
                    kept.append((min(depth, through), owner))
                    upto = min(depth, through)
            runs = kept + ([(left, before)] if left > through else [])
        out[name] = (first[:left], last[: common[k + 1]], runs)
    return out


def trie_nodes(words: DataFrame, key: str, carry: str) -> DataFrame:
    """<carry>, ``at`` (a number in the order of ``key``) and ``path`` (node of each prefix of
    the key, the empty one first). Keys must be distinct strings; ``carry`` is a column.

    The driver sees the first and last key of every slice, cut to what neighbours share.
    """
    cut = sliced(words.select(F.col(key).alias("key"), F.col(carry).alias("carry")), [], ["key"])
    ends = cut.groupBy(SLICE).agg(F.min("key"), F.max("key")).collect()  # one row per slice
    bounds = slice_bounds([tuple(r) for r in ends])
    kind = words.schema[carry].dataType.simpleString()
    carried = pa.int64() if kind == "bigint" else pa.string()
    schema = pa.schema([(carry, carried), ("at", pa.int64()), ("path", pa.list_(pa.int64()))])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, path, node, place = "", [0], 0, 0
        first = last = None
        for batch in batches:
            keys, slices = batch.column("key").to_pylist(), batch.column(SLICE).to_pylist()
            if keys and first is None:
                name = slices[0]
                first, last, runs = bounds[name]
                owners = [owner for (depth, owner), (start, _) in zip(runs, [(0, 0), *runs]) for _ in range(start, depth)]
            for a, b in chunks([len(k) + 1 for k in keys], 1 << 18):
                paths, ats = [], []
                for word in keys[a:b]:
                    keep = shared(previous, word)
                    left, right = shared(word, first), shared(word, last)
                    path = path[: keep + 1]
                    for depth in range(keep + 1, len(word) + 1):
                        if depth <= left:
                            path.append(-(owners[depth - 1] << 40 | depth))
                        elif depth <= right:
                            path.append(-(name << 40 | depth))
                        else:
                            node += 1
                            path.append(name << 40 | node)
                    paths.append(path)
                    ats.append(name << 40 | place)
                    place += 1
                    previous = word
                columns = [batch.column("carry").slice(a, b - a), pa.array(ats, pa.int64()), pa.array(paths, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return cut.sortWithinPartitions("key").mapInArrow(numbered, schema_ddl(schema))


def node_pairs(paths: DataFrame) -> DataFrame:
    """p, q, at, n, skip, sole: every skip and gap of every word (at, n, word, path, back).

    ``sole`` is false for a skip whose code point equals the one before it: skipping either
    gives the same string, which then counts once.
    """
    size = F.length("word")

    def entry(p, q, skip, sole):
        return F.struct(F.get("path", p).alias("p"), F.get("back", q).alias("q"), F.lit(skip).alias("skip"), sole.alias("sole"))

    letters = F.split("word", "")
    same = lambda i: (i > 0) & (F.get("_letters", i) == F.get("_letters", i - 1))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: entry(i, size - 1 - i, True, ~same(i)))
    gaps = F.transform(F.sequence(F.lit(0), size), lambda i: entry(i, size - i, False, F.lit(True)))
    rows = paths.withColumn("_letters", letters)
    return rows.select("at", "n", F.explode(F.concat(skips, gaps)).alias("e")).select("at", "n", "e.*")


def neighbours(pairs: DataFrame) -> DataFrame:
    """at, n_near, best (n and negative place of the most frequent near word).

    One exchange brings skips and gaps of a pair together: at most one skip per letter and
    one gap, so nothing is multiplied; each word only gets the count and the best of the others.
    """
    group = W.partitionBy("p", "q")
    me = F.struct("n", (-F.col("at")).alias("place"))
    skip, sole = F.col("skip"), F.col("sole")
    ordered = group.orderBy(F.desc("skip"), F.desc("n"), "at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = pairs.select(
        "at", "skip", "sole", me.alias("me"),
        F.count_if(skip).over(group).alias("skips"),
        F.count_if(skip & sole).over(group).alias("soles"),
        F.max(F.when(~skip, me)).over(group).alias("gap"),
        F.max(F.when(skip & sole, me)).over(group).alias("sole_best"),
        F.nth_value(F.when(skip, me), 1).over(ordered).alias("one"),
        F.nth_value(F.when(skip, me), 2).over(ordered).alias("two"),
    )
    other = F.when(F.col("one") == F.col("me"), F.col("two")).otherwise(F.col("one"))
    shorter = F.when(sole, F.col("gap"))
    near = F.when(skip, F.col("skips") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("soles"))
    best = F.when(skip, F.greatest(other, shorter)).otherwise(F.col("sole_best"))
    return met.select("at", near.alias("near"), best.alias("best")).groupBy("at").agg(
        F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best")
    )


def followed(links: DataFrame) -> DataFrame:
    """at, to: the last word of the chain from each link (at, to).

    Every round doubles the links followed; as a form is ``FORM_FACTOR`` times as frequent,
    chains are short (27 links for counts of 64 bits).
    """
    while True:
        ahead = links.select(F.col("at").alias("to"), F.col("to").alias("beyond"))
        step = stored(
            links.join(ahead, "to", "left")
            .select("at", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")),
            "roots",
        )
        links = step.select("at", "to")
        if step.where("moved").isEmpty():
            return links


def spelling_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = MISSPELT
) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) of every frequent word of ``docs``
    (doc_id, text).

    A null text has no words, a null doc_id counts as an empty one in the hash, repeated rows
    count each. Equally frequent near words: the smallest in code-point order is the form.
    Texts without a frequent word, or an empty table, give an empty result. Other columns of
    ``docs`` play no part.
    """
    words = stored(word_counts(docs, least_length, every).where(F.col("n") >= least_count), "words")
    ahead = stored(trie_nodes(words, "word", "word"), "trie")
    paths = stored(ahead.join(words, "word").join(reversed_nodes(ahead), "at"), "paths")
    counted = paths.select("at", "word", "n").join(neighbours(node_pairs(paths)), "at")
    linked = F.col("best.n") >= FORM_FACTOR * F.col("n")
    told = stored(
        counted.select(
            "at", "word", "n", "n_near",
            F.when(linked, -F.col("best.place")).alias("to"), F.when(linked, F.col("best.n")).alias("form_n"),
        ),
        "near",
    )
    names = told.select("at", "word")
    roots = followed(told.where(F.col("to").isNotNull()).select("at", "to"))
    forms = told.where(F.col("to").isNotNull()).select("at", "to")
    named = (
        forms.join(names.select(F.col("at").alias("to"), F.col("word").alias("form")), "to").select("at", "form")
        .join(
            roots.join(names.select(F.col("at").alias("to"), F.col("word").alias("root")), "to").select("at", "root"), "at"
        )
    )
    return told.join(named, "at", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def reversed_nodes(ahead: DataFrame) -> DataFrame:
    """at, back: node of each suffix of the word, the empty one first."""
    rows = ahead.select(F.reverse("word").alias("key"), F.col("at").alias("owner"))
    return trie_nodes(rows, "key", "owner").select(F.col("owner").alias("at"), F.col("path").alias("back"))
