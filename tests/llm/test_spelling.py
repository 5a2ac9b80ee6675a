"""Spelling variants against brute force on small tables, and their edge cases."""

import collections
import random
import re
import zlib

import pytest

from plantgauge.llm import spelling

DOCS = "doc_id long, text string, word string, n long, at long, path string, p long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "x", 3) for i, t in rows], DOCS)


def brute_counts(rows, least=6, every=199):
    out = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, least=5):
    words = {w: n for w, n in counts.items() if n >= least}
    form, out = {}, []
    for w, n in words.items():
        met = [o for o in words if near(w, o)]
        best = min(met, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out.append([w, form[w], None, n, len(met), words[best] if form[w] else None])
    for row in out:
        at = row[0]
        while form[at]:
            at = form[at]
        row[2] = at
    return sorted(map(tuple, out), key=repr)


def settled(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def crowded(seed, letters="ab", sizes=(6, 7, 8), words=260):
    """Many words one edit apart, of very different counts."""
    rng = random.Random(seed)
    bag = []
    for _ in range(words):
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        bag += [w] * rng.choice([1, 4, 5, 6, 30, 150, 800])
    rng.shuffle(bag)
    return [(i, " ".join(bag[i::9])) for i in range(9)]


@pytest.mark.parametrize("letters,seed", [("ab", 1), ("abÀéÿ", 2), ("aé", 3)])
def test_crowded_words(spark, letters, seed):
    rows = crowded(seed, letters)
    counts = brute_counts(rows)
    assert settled(spelling.spelling_variants(make(spark, rows))) == brute(counts)


def test_counts_and_hash(spark):
    rows = crowded(4, "abcdefgh", (5, 6, 7), 900) + [
        (77, "ABCDEF ÀBCDEF àbcdef abcµdef abcĀdef x_abcdef1abcdef abcdefé"), (None, "abcdef " * 9), (5, None), (6, ""), (6, "z" * 50_000),
        (78, "漢字abcdef漢字 \U0001f600abcdef"),
    ]
    for every in (199, 3):
        got = {r["word"]: r["n"] for r in spelling.word_counts(make(spark, rows), every=every).collect()}
        assert got == dict(brute_counts(rows, every=every))


def test_flushed_counts(spark, monkeypatch):
    rows = crowded(5, "abc")
    want = dict(brute_counts(rows))
    monkeypatch.setattr(spelling, "COUNTED", 3)
    assert {r["word"]: r["n"] for r in spelling.word_counts(make(spark, rows)).collect()} == want


def test_chain_of_forms(spark):
    text = ["abcdefghij"] * 5 + ["abcdefghi"] * 25 + ["abcdefgh"] * 125 + ["abcdefg"] * 625 + ["abcdef"] * 3125
    out = {r["word"]: r for r in spelling.spelling_variants(make(spark, [(1, " ".join(text))]), every=10**12).collect()}
    assert {r["root"] for r in out.values()} == {"abcdef"}
    assert out["abcdefghij"]["form"] == "abcdefghi" and out["abcdef"]["form"] is None
    assert out["abcdefgh"]["n_near"] == 2 and out["abcdefg"]["form_n"] == 3125


def test_ties_repeats_and_long_words(spark):
    long = "ab" * 5000
    text = ["aabbcc"] * 5 + ["aabbc"] * 9 + ["aabbccc"] * 25 + ["aaabbcc"] * 25 + [long] * 5 + [long + "b"] * 5 + [long[1:]] * 25
    rows = [(1, " ".join(text))]
    got = settled(spelling.spelling_variants(make(spark, rows), every=10**12))
    assert got == brute(brute_counts(rows, every=10**12))
    assert [r[1] for r in got if r[0] == "aabbcc"] == ["aaabbcc"]


def test_no_words(spark):
    assert settled(spelling.spelling_variants(make(spark, []))) == []
    assert settled(spelling.spelling_variants(make(spark, [(1, None), (2, ""), (3, "short words only here")]))) == []


def test_nodes_follow_prefixes_over_slices(spark):
    """Equal prefixes have equal nodes and different ones different nodes, however the order is cut."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(500)} | {"b" * 12, "b" * 12 + "a"})
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "key string, owner long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = spelling.trie_nodes(rows, "key", "owner").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    node = {}
    for r in out:
        w = words[r["owner"]]
        assert len(r["path"]) == len(w) + 1
        for i, n in enumerate(r["path"]):
            assert node.setdefault(w[:i], n) == n
    assert len(set(node.values())) == len(node)
    assert [r["owner"] for r in sorted(out, key=lambda r: r["at"])] == list(range(len(words)))


def test_slice_bounds():
    ends = [(0, "aaa", "aab"), (2, "aabc", "aabd"), (3, "aabe", "aacx"), (5, "aacy", "b")]
    assert spelling.slice_bounds(ends) == {
        0: ("", "aab", []), 2: ("aab", "aab", [(3, 0)]), 3: ("aab", "aac", [(3, 0)]), 5: ("aac", "", [(2, 0), (3, 3)]),
    }
