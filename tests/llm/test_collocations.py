"""Collocations against brute force on small tables, both ways of the semi-join, edge cases."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantgauge.llm import collocations as col

DOCS = "doc_id long, text string, lang string, gid long, l long, word string, block long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "x", 3) for i, (t, lang) in enumerate(rows)], DOCS)


def brute(rows, longest=5, least=100, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang or "und", tuple(ws[i : i + m])] += 1
    cand = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    inside = collections.Counter()
    for (lang, ws), n in cand.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                key = lang, ws[i : i + m]
                inside[key] = max(inside[key], n)
    out = collections.defaultdict(list)
    for (lang, ws), a in cand.items():
        if inside[lang, ws] >= a:
            continue
        score, _, l, r = min(
            (1000 * a * total[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))
        )
        out[lang].append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def settled(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def texts(seed, docs=60, words=90):
    rng = random.Random(seed)
    bag = ["the", "Of", "a", "new", "york", "City", "é", "Él", "x y", "\x1cz", "漢", "san", "francisco"]
    out = []
    for _ in range(docs):
        ws = []
        while len(ws) < words:
            ws += rng.choice([["new", "York", "city", "hall"], ["a", "b", "C", "d", "e", "f"], ["of", "the"], ["la", "la", "la"], [rng.choice(bag)], [rng.choice(bag), rng.choice(bag)]])
        marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", " ; ", "\x0b"]
        out.append(("".join(w + rng.choice(marks) for w in ws), rng.choice(["en", "en", "fr", None])))
    return out


EDGES = [(None, "en"), ("", "de"), (" \t ", "xx"), ("...", None), ("one", "zz"), ("x " * 300, "rep"), ("a b " * 120, "und")]


def test_brute(spark):
    rows = texts(1) + EDGES
    want = brute(rows, least=20)
    assert {len(w[2].split(" ")) for w in want} == {2, 3, 4, 5}
    assert settled(col.collocations(make(spark, rows), least=20)) == want


def test_top_and_ties(spark):
    rows = texts(2) + [("p q. r s. t u. " * 40, "tie")]
    got = settled(col.collocations(make(spark, rows), least=20, top=7))
    assert got == brute(rows, least=20, top=7)
    assert [g[2] for g in got if g[0] == "tie"] == ["p q", "r s", "t u"]


def test_shuffled_semi_join(spark, monkeypatch):
    rows = texts(3) + EDGES
    want = brute(rows, least=20)
    monkeypatch.setattr(col, "WORD_ROWS", 0)
    monkeypatch.setattr(col, "GROUP_ROWS", 0)
    assert settled(col.collocations(make(spark, rows), least=20)) == want


def test_mixed_semi_joins_and_flushes(spark, monkeypatch):
    rows = texts(4) + EDGES
    want = brute(rows, least=20)
    monkeypatch.setattr(col, "GROUP_ROWS", 40)
    monkeypatch.setattr(col, "COUNTED", 5)
    monkeypatch.setattr(col, "PAIRS", 10)
    monkeypatch.setattr(col, "BATCH", 50)
    assert settled(col.collocations(make(spark, rows), least=20)) == want


def test_long_text_in_blocks(spark, monkeypatch):
    rows = [(" ".join(t for t, _ in texts(5, 40)), "en"), ("la " * 500, "fr")] + EDGES
    want = brute(rows, least=20)
    monkeypatch.setattr(col, "BLOCK_BYTES", 37)
    assert settled(col.collocations(make(spark, rows), least=20)) == want


def test_blocks_own_every_word_once():
    text = "one two, three four five.six " * 50
    words = [w for w, own in col.blocks(text, 4) for w in w[:own]]
    col_small = col.BLOCK_BYTES
    try:
        col.BLOCK_BYTES = 11
        assert [w for ws, own in col.blocks(text, 4) for w in ws[:own]] == words
    finally:
        col.BLOCK_BYTES = col_small


def test_empty_and_rare(spark):
    assert settled(col.collocations(make(spark, []))) == []
    assert settled(col.collocations(make(spark, EDGES[:5]))) == []


def test_sums_of_pairs_that_do_not_fit_one_number():
    left = np.array([1 << 50, 3, 1 << 50, 3], dtype=np.int64)
    right = np.array([1 << 40, 2, 1 << 40, 1], dtype=np.int64)
    got = [c.tolist() for c in col.summed(left, right, np.array([1, 1, 5, 1]))]
    assert got == [[3, 3, 1 << 50], [1, 2, 1 << 40], [1, 1, 6]]


def test_scores_beyond_64_bits(spark):
    a, l, r, n = 3 * 10**14, 7 * 10**14, 5 * 10**15, 9 * 10**17
    level = spark.createDataFrame([(a, n, [l], [r])], "n long, total long, pre array<long>, suf array<long>")
    cut = col.scored(level, 2).first()["cut"]
    assert cut["score"] == 1000 * a * n // (l * r) and (cut["l"], cut["r"]) == (l, r)
