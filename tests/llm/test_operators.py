"""The operators on small tables against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, n_words long, shard int, leaks string, pii string"


def make(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", -1, 7, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


EDGES = [None, "", " ", "\n\n", "word", "a b c d", "x" * 5000, "é" * 300, prose(60, 1), prose(60, 1)]


# --- quality rules -------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_base_figures(spark):
    from plantgauge.llm.quality_rules import quality_rules

    texts = EDGES + ["a b c d e " * 5, "one two three four five six\n" * 4, "#$ | | |\tx\x0by\r\nz", prose(300, 2) + "\n" + prose(40, 2), "k " * 4 + prose(100, 3) + " k k k k"]
    out = quality_rules(make(spark, texts)).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert all(not (r["base_failed"] and r["kept"]) for r in out)


def test_quality_lines_decide(spark):
    from plantgauge.llm.quality_rules import quality_rules

    clean = "This is a sentence of a clean text with its own words.\nAnother line follows it, and it ends well."
    menu = "Home\nProducts\nAbout\nJobs\nNews\nTeam\nPress\nContact\nHelp\nLegal\nOne short line."
    notice = clean + "\nThis site uses cookies, click here."
    rows = {r["doc_id"]: r for r in quality_rules(make(spark, [clean, menu, notice])).collect()}
    assert rows[0]["kept"] and rows[0]["clean_text"] == clean
    assert not rows[1]["kept"] and rows[1]["kept_words"] == 3
    assert rows[2]["kept"] and rows[2]["clean_text"] == clean


# --- sharding ------------------------------------------------------------------------


@pytest.mark.parametrize("n,shards", [(0, 4), (1, 4), (103, 10), (1000, 40)])
def test_shards_are_exact(spark, n, shards):
    from plantgauge.llm.sharding import hypergeometric_shards

    df = spark.range(n).withColumn("shard", F.lit("old")).repartition(5)
    rows = hypergeometric_shards(df, shards, seed=3).collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shard_blocks(spark, monkeypatch):
    from plantgauge.llm import sharding

    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)
    rows = sharding.hypergeometric_shards(spark.range(1000), 7, seed=1).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append((r["slot"], r["id"]))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    # the order in a shard is not the order of the source
    assert all([i for _, i in sorted(v)] != sorted(i for _, i in v) for v in by.values())


def test_communication_matrix_sums():
    from plantgauge.llm.sharding import communication_matrix

    matrix, sizes = communication_matrix([5, 0, 17, 100], 6, seed=2)
    assert matrix.sum(axis=1).tolist() == [5, 0, 17, 100]
    assert matrix.sum(axis=0).tolist() == sizes.tolist() and sizes.max() - sizes.min() <= 1


# --- license scan --------------------------------------------------------------------


def brute_phrases(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    hits = [(i, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark):
    from plantgauge.llm.license_scan import license_scan

    texts = EDGES + [
        "Released under the MIT License.", "x\nLicensed under CC BY-NC 4.0.\ny", "the GNU General\nPublic License and MIT license, Apache-License",
        "licensed under nc by", "All rights reserved.", "mit licenses", "MİT License", "permission is hereby granted to no one",
    ]
    docs, blocks = license_scan(make(spark, texts))
    got = {r["doc_id"]: r for r in docs.collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_phrases(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[len(EDGES) + 1]["labels"] == "cc-by-nc" and got[len(EDGES) + 1]["score"] == 1
    assert got[len(EDGES) + 3]["labels"] == "" and got[len(EDGES) + 4]["labels"] == "reserved"
    assert {r["block"] for r in blocks.collect() if r["doc_id"] == len(EDGES) + 1} >= {"Licensed under CC BY-NC 4.0."}


def test_license_join_finds_every_block(spark):
    """All (block, template) pairs over the threshold, against all pairs."""
    from plantgauge.llm.license_scan import license_scan, needed, template_tokens

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    templates = [(f"t{i}", " ".join(rng.sample(words, rng.randint(3, 8)))) for i in range(12)]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(5)) for _ in range(40)]
    _, blocks = license_scan(make(spark, texts), templates=templates, threshold=0.7)
    got = {(r["doc_id"], r["block"], r["template"]) for r in blocks.collect()}
    want = {
        (d, line, i)
        for d, t in enumerate(texts)
        for line in [*t.split("\n"), t]
        for i, _, ws in template_tokens(templates)
        if len(set(ws) & set(line.split())) >= needed(len(ws), 0.7)
    }
    assert got == want


# --- personal data -------------------------------------------------------------------


def test_personal_data_spans(spark):
    from plantgauge.llm.pii import find_personal_data, redact

    text = 'mail a.b@c.de or x@y, ip 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111, call +1 (555) 010-9999, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" é@x.org'
    more = [f'Some words here token = "{hashlib.sha1(bytes([i])).hexdigest()}" and so on.' for i in range(20)]
    rows = {r["doc_id"]: r for r in find_personal_data(make(spark, EDGES + [text] + more)).collect()}
    spans = [(x["kind"], text[x["start"] : x["end"]]) for x in rows[len(EDGES)]["pii"]]
    assert spans[:4] == [("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    assert ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff") in spans
    assert all(not rows[i]["pii"] for i in range(8))
    out = {r["doc_id"]: r["text"] for r in redact(make(spark, EDGES + [text] + more)).collect()}
    assert out[len(EDGES)].startswith("mail <email> or x@y, ip <ip> and 999.1.1.1, card <card>, call <phone>") and out[0] is None


def test_email_scan_equals_pattern():
    from plantgauge.llm.pii import emails

    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("ab@@..-_ é") for _ in range(rng.randint(0, 25)))
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert list(emails(t)) == want, t


def test_ip_scan_equals_pattern():
    from plantgauge.llm.pii import IP

    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("12.. 9") for _ in range(rng.randint(0, 25)))
        assert [m.span() for m in IP.finditer(t)] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)]


def test_reliabilities_by_em():
    """Three labelers of known quality: EM ranks them and recovers the classes."""
    from plantgauge.llm.pii import estimate_reliabilities

    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < q, y, ~y) * 2 - 1 for q in (0.95, 0.8, 0.6)], axis=1)
    p = estimate_reliabilities(votes, np.zeros(4000, dtype=int), np.ones(4000))
    assert ((p > 0.5) == y).mean() > 0.93


# --- pieces --------------------------------------------------------------------------


def test_pieces_equal_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    from plantgauge.llm.sentencepieces import decode_documents, default_model, encode_documents

    texts = EDGES + ["  two  spaces ", "tab\tand\nline", "Übergröße naïve ☃ \U0001f600", "<s> </s>", prose(200, 4), "https://a.b/c_d?e=1&f=2", "aaaa" * 40]
    df = encode_documents(make(spark, texts))
    rows = {r["doc_id"]: r for r in df.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for i, t in enumerate(texts):
        assert rows[i]["token_ids"] == sp.encode(t or "") and rows[i]["round_trip"] and rows[i]["n_tokens"] == len(rows[i]["token_ids"])
    back = {r["doc_id"]: r["back"] for r in decode_documents(df, out="back").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_unigram_viterbi():
    """Best score over all segmentations."""
    from plantgauge.llm.sentencepieces import Pieces

    m = Pieces.__new__(Pieces)
    m.score = {"a": -2.0, "b": -2.5, "ab": -3.0, "abc": -9.0, "c": -1.0, "bc": -2.2, "cab": -4.0}
    m.id = {p: i for i, p in enumerate(m.score)}
    m.bpe, m.longest, m.bytes, m.unknown = False, 3, {}, 99

    def best(w):
        if not w:
            return 0.0
        return max((m.score[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in m.score), default=-1e9)

    words = ["", "a", "abc", "abcab", "cabab", "bcab", "aabbcc"]
    out = m.encode_words([w for w in words if w])
    names = list(m.score)
    for w in words[1:]:
        assert "".join(names[i] for i in out[w]) == w and abs(sum(m.score[names[i]] for i in out[w]) - best(w)) < 1e-9


# --- near duplicates -----------------------------------------------------------------


def edited(text, every, seed):
    rng = random.Random(seed)
    return " ".join("zz" + str(rng.random()) if rng.random() < 1 / every else w for w in text.split())


def brute_classes(texts):
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or (both and both >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    from plantgauge.llm.near_dedup import drop_near_duplicates, near_duplicates

    texts = EDGES + ["A b C d", prose(3, 9)]
    for g in range(6):
        base = prose(150, 10 + g)
        texts += [base] + [edited(base, 60 + 40 * k, 100 * g + k) for k in range(6)]
    df = make(spark, texts)
    got = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_of_unequal_repetition(spark):
    """How often a part is repeated plays no role: the sets of shingles decide."""
    from plantgauge.llm.near_dedup import LEAST_AGREE, REGISTERS, near_duplicates, signatures, with_node

    texts = []
    for g in range(12):
        base, part = prose(110, 300 + g), prose(54, 400 + g)
        texts += [f"{base} {part} {part}", f"{edited(base, 110, g)}" + f" {part}" * 30]
    df = make(spark, texts)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(want)
    # signatures estimate the similarity of the sets, not of the counts
    sigs = {bytes(r["node"]): np.frombuffer(r["signature"], dtype=np.uint16) for r in signatures(with_node(df, "text")).collect()}
    for i in range(0, len(texts), 2):
        if want[i] == want[i + 1]:
            x, y = (sigs[hashlib.md5(t.encode()).digest()] for t in texts[i : i + 2])
            assert (x == y).sum() >= LEAST_AGREE and (x == y).mean() > 0.8 - 4 * (0.16 / REGISTERS) ** 0.5


def test_near_duplicates_without_rows_or_keys(spark):
    from plantgauge.llm.near_dedup import drop_near_duplicates, near_duplicates

    assert near_duplicates(make(spark, [])).count() == 0
    same = make(spark, ["a b c d e f", "a b c d e f", None, None], ids=[None, None, 5, 5])
    rows = [(r["doc_id"], r["class_id"], r["class_size"]) for r in near_duplicates(same).collect()]
    assert sorted(rows, key=str) == [(5, 5, 2), (5, 5, 2), (None, None, 2), (None, None, 2)]
    assert drop_near_duplicates(same).count() == 2


def test_prob_min_hash_estimates():
    """Equal registers estimate the probability Jaccard similarity."""
    from plantgauge.llm.near_dedup import prob_min_hash

    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2**63, 300, dtype=np.uint64)
    wa, wb = np.r_[rng.random(200) + 0.5, np.zeros(100)], np.r_[np.zeros(50), rng.random(250) + 0.5]
    wb[60:200] = wa[60:200]
    both = (wa > 0) & (wb > 0)
    want = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in np.flatnonzero(both))
    els = np.concatenate([ids[wa > 0], ids[wb > 0]])
    doc = np.r_[np.zeros((wa > 0).sum(), int), np.ones((wb > 0).sum(), int)]
    sig = prob_min_hash(els, doc, np.r_[wa[wa > 0], wb[wb > 0]], 2, registers=4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


# --- decontamination -----------------------------------------------------------------


def test_leaks(spark):
    from plantgauge.llm.decontaminate import find_leaks

    items = [prose(n, 50 + n) for n in (15, 24, 40, 60)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, ""), (10, None)], "item_id long, text string")
    w = items[2].split()
    paraphrase = " ".join(x for k, x in enumerate(w) if k % 8)
    texts = EDGES + [prose(200, 7) + " " + items[0] + " " + prose(90, 8), items[1].upper(), prose(33, 11) + "\n" + paraphrase + ".", items[3], items[3], prose(500, 12)]
    rows = {r["doc_id"]: [x["item"] for x in r["leaks"]] for r in find_leaks(make(spark, texts), bench).collect()}
    n = len(EDGES)
    assert {k: v for k, v in rows.items() if v} == {n: [0], n + 1: [1], n + 2: [2], n + 3: [3], n + 4: [3]}
    assert find_leaks(make(spark, []), bench).count() == 0
    assert find_leaks(make(spark, texts), bench.limit(0)).where(F.size("leaks") > 0).count() == 0


def brute_leaks(items, latent, texts):
    """{(text, item)} of all windows and all items, without any gate."""
    from plantgauge.llm import decontaminate as d

    at = np.full((len(items.words), max(map(len, items.words))), len(items.vocabulary))
    for i, w in enumerate(items.words):
        at[i, : len(w)] = np.searchsorted(items.vocabulary, w)
    lengths, found = np.array([len(w) for w in items.words]), set()
    for t, words in enumerate(texts):
        for size in np.unique(items.steps):
            for a in range(max(1, -(-len(words) // d.STEP) - size + 1)):
                passage = words[a * d.STEP : (a + size) * d.STEP]
                there = np.append(np.isin(items.vocabulary, passage), False)
                for i in np.flatnonzero((items.steps == size) & (there[at].sum(axis=1) >= d.LESS_SHARE * lengths - 1e-9)):
                    answer = len(latent.answers[i].intersection(passage.tolist())) / len(latent.answers[i])
                    if d.common_subsequence(items.words[i], passage) / lengths[i] >= (d.LESS_SHARE if answer >= d.ANSWER else d.SHARE):
                        found.add((t, int(i)))
    return found


def test_leaks_of_a_full_block_equal_brute_force(spark):
    """Verbatim items, items without most of their rarest words, and short ones; as
    many items as a block holds, so that the latent rank is far below them."""
    from plantgauge.llm import decontaminate as d

    rng = random.Random(12)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(6000)]
    word = lambda: names[min(int(rng.paretovariate(0.6)) - 1, 5999) if rng.random() < 0.7 else rng.randrange(6000)]
    benchmark = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(d.BLOCK_ITEMS)]
    items = d.Items(list(range(len(benchmark))), benchmark)
    noise = lambda n: [word() for _ in range(n)]
    texts = [" ".join(noise(40) + benchmark[rng.randrange(len(benchmark))].split() + noise(40)) for _ in range(60)]
    counts = collections.Counter(w for t in texts + benchmark for w in set(t.split()))
    for i in range(60, 90):  # a seventh of the words replaced, the rarest first
        w = benchmark[i].split()
        rare = sorted(set(w), key=lambda x: (counts[x], x))[: len(w) // 7]
        texts.append(" ".join(noise(30) + [f"zz{k}" if x in rare else x for k, x in enumerate(w)] + noise(30)))
    docs = spark.createDataFrame([(t,) for t in texts], "_d_text string")
    latent = d.Latent(docs, items)
    words, bounds = d.word_hashes(texts, at_marks=True)
    got = set(d.search(words, bounds, items, latent))
    want = brute_leaks(items, latent, [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
    assert got == want and len(want) >= 80


def test_leak_without_its_answer(spark):
    """SHARE of the words in order is a leak, whatever the answer words."""
    from plantgauge.llm.decontaminate import find_leaks

    items = [" ".join(f"i{k}w{j}" for j in range(42)) if k else prose(42, 77) for k in range(4)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[0].split()
    common = prose(3000, 77)  # the item's words stand in many passages but for eight
    rare = [3, 8, 13, 18, 23, 28, 33, 38]
    for k in rare:
        w[k] = f"own{k}"
    items[0] = " ".join(w)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    changed = [f"other{k}" if k in rare else x for k, x in enumerate(w)]
    texts = [common, prose(40, 78) + " " + " ".join(changed) + " " + prose(40, 79)]
    rows = {r["doc_id"]: r["leaks"] for r in find_leaks(make(spark, texts), bench).collect()}
    assert [x["item"] for x in rows[1]] == [0] and rows[1][0]["lcs_share"] >= 0.8


def test_common_subsequence():
    from plantgauge.llm.decontaminate import common_subsequence

    rng = random.Random(4)
    for _ in range(200):
        a, b = [[rng.randint(0, 5) for _ in range(rng.randint(1, 15))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_subsequence(np.array(a), np.array(b)) == t[-1][-1]


# --- html ----------------------------------------------------------------------------


def page(i, named=True, extra=""):
    art = ("<article>", "</article>") if named else ("<div>", "</div>")
    body = "".join(f"<p>{prose(40 + k, i * 7 + k)}.</p>" for k in range(4))
    return (
        f"<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>More</a></li></ul></nav>"
        f"<div class='ad'>Buy this now</div>{art[0]}<h1>Title {i} &amp; more</h1>{body}<div class='promo'>Advert {i}</div><p>Last\n  words&nbsp;here.{extra}{art[1]}"
        f"<div id='comments'><p>Great read, said a reader.</p></div><footer>&copy; site</footer></body></html>"
    )


def test_articles(spark):
    from plantgauge.llm.html_extract import extract_articles

    sources = [page(i) for i in range(30)] + [None, "", "plain < text", "<p>unclosed <b>bold", "<div" * 50, page(3), page(99, named=False)]
    rows = spark.createDataFrame([(i, s, "u") for i, s in enumerate(sources)], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract_articles(rows).collect()}
    want = "\n\n".join([f"Title 3 & more"] + [f"{prose(40 + k, 21 + k)}." for k in range(4)] + ["Last words here."])
    assert got[3] == want and got[35] == want and got[30] == "" and got[31] == ""
    for k in range(4):  # an unnamed article is found by its density
        assert prose(40 + k, 99 * 7 + k) in got[36]
    assert "Home" not in got[36]


@pytest.mark.parametrize("name", ["head", "button", "select", "object"])
def test_elements_without_end_tags(name):
    """An element that is not closed does not take the article after it along; a
    closed one is left out, nested ones too."""
    from plantgauge.llm.html_extract import Page

    text = lambda s: " ".join("".join(p for _, _, p in Page(s).pieces).split())
    start = "<head><meta x><title>T</title>" if name == "head" else f"<body><{name}>gone"
    assert text(f"<html>{start}<div><h1>Top</h1><p>The article.</p></div>").endswith("Top" + "The article.")
    if name != "head":
        assert text(f"<div><{name}>a<{name}>b</{name}>c</{name}><p>kept</p></div>") == "kept"
        assert text(f"<div><{name}>a<p>b</p></{name}><p>kept</p></div>") == "kept"
    assert text("<head><title>T</title> <style>x</style></head><body>kept") == "kept"


def test_training_pages_are_named(spark, monkeypatch):
    """Where few pages name an article, the limit counts only those."""
    from plantgauge.llm import html_extract

    monkeypatch.setattr(html_extract, "TRAIN_PAGES", 6)
    sources = ["<div><p>plain %d</p></div>" % i for i in range(60)] + [page(i) for i in range(6)]
    rows = spark.createDataFrame([(s,) for s in sources], "html string")
    want = 2 * sum(len(html_extract.Page(s).tag) for s in sources[60:])
    assert html_extract.training_nodes(rows, "html").count() == want


def test_decoding_never_contradicts():
    from plantgauge.llm.html_extract import decode

    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        p, w = rng.random(n), rng.random(n)
        states = decode(parent, p, w)
        assert all(states[i] >= states[parent[i]] for i in range(1, n))
        score = lambda s: sum((w[i] + 0.05) * np.log(p[i] if s[i] == 1 else 1 - p[i]) for i in range(n))
        import itertools

        best = max(score(s) for s in itertools.product(range(3), repeat=n) if all(s[i] >= s[parent[i]] for i in range(1, n)))
        assert abs(score(states) - best) < 1e-9


# --- repeated strings ----------------------------------------------------------------


def brute_strings(texts):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(t[q : q + 400] for t in data for q in range(len(t) - 399))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for q in range(len(t) - 399):
            if count[t[q : q + 400]] > 1:
                gone[q : q + 400] = True
        rest = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def test_repeated_strings_equal_brute_force(spark):
    from plantgauge.llm.repeated_strings import drop_repeated_strings

    a, b = prose(120, 20), prose(90, 21)
    texts = EDGES + [
        a, a[:401] + "Q" + b, "R" + b[50:460], prose(30, 22) + a[100:510] + "é" + a[100:505], "ab" * 600, "x" * 399, "x" * 400, b[:399], b[:400] + "!",
        prose(400, 23), prose(400, 23)[:1500] + "??" + prose(400, 23)[1490:],
    ]
    rows = {r["doc_id"]: r for r in drop_repeated_strings(make(spark, texts)).collect()}
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in rows.items()}
    assert [got[i] for i in range(len(texts))] == brute_strings(texts)
    for i, r in rows.items():
        assert r["lang"] == "en" and r["text"] == texts[i]
        if r["n_spans"] == 0:
            assert r["kept_text"] == (texts[i] or "")
        elif "é" not in texts[i]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert drop_repeated_strings(make(spark, [])).count() == 0


def test_repeated_strings_with_names_of_their_own(spark):
    """Columns called like the operator's inner ones are kept as they are; halved characters go."""
    from plantgauge.llm.repeated_strings import drop_repeated_strings

    same = "é" * 300
    names = ["node", "removed", "spans", "digest", "rest", "whole", "row", "data"]
    rows = [(1, "a" + same, *names), (2, "bb" + same[:250], *names), (3, None, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = {r["doc_id"]: r for r in drop_repeated_strings(df).collect()}
    assert all(r[n] == n for r in out.values() for n in names)
    assert out[1]["kept_text"] == "a" and out[2]["kept_text"] == "bb" and out[3]["kept_text"] == ""


def test_places_past_the_packed_bits(monkeypatch):
    """Texts longer than a packed place are walked in pieces: equal parts far apart
    keep equal anchors and windows."""
    from plantgauge.llm import near_passages, repeated_strings

    a = np.frombuffer(prose(900, 60).encode(), dtype=np.uint8)
    b = np.frombuffer(prose(900, 61).encode(), dtype=np.uint8)
    data = np.concatenate([a, b, a])
    offsets = np.array([0, len(data)])
    want = repeated_strings.anchors(data, offsets)
    h = np.random.default_rng(5).permutation(3000).astype(np.uint64) << np.uint64(40)
    bounds = np.array([0, 1700, 3000])
    windows = near_passages.compact_windows(h, bounds)
    for module in (repeated_strings, near_passages):
        monkeypatch.setattr(module, "LOW", np.uint64((1 << 10) - 1))
    for got, whole in ((repeated_strings.anchors(data, offsets), want), (near_passages.compact_windows(h, bounds), windows)):
        assert all((x == y).all() for x, y in zip(got, whole))


# --- passages ------------------------------------------------------------------------


def test_near_passages(spark):
    from plantgauge.llm.near_passages import near_passages

    shared, other = prose(60, 30), prose(80, 31)
    near = shared.split()
    near[30] = "changed"
    texts = EDGES[:8] + [
        prose(100, 32) + " " + shared + " " + prose(70, 33), shared + " " + prose(200, 34), prose(20, 35) + " " + " ".join(near), prose(300, 36),
        other, other, prose(49, 37), prose(49, 37),
    ]
    rows = near_passages(make(spark, texts)).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["start_word"], r["end_word"], r["class_id"]))
    assert set(by) == {8, 9, 10, 12, 13}
    assert any(a <= 100 and b >= 160 and c == 8 for a, b, c in by[8]) and any(a == 0 and b >= 60 and c == 8 for a, b, c in by[9])
    assert {c for _, _, c in by[10]} == {8} and by[12] == by[13] == [(0, 80, 12)]
    assert near_passages(make(spark, [])).count() == 0


def test_compact_windows_hold_every_stretch():
    """Each stretch of at least LEAST tokens lies in exactly one window around its
    least token."""
    from plantgauge.llm.near_passages import LEAST, compact_windows

    h = np.random.default_rng(2).permutation(200).astype(np.uint64) << np.uint64(30)
    text, l, c, r = compact_windows(h, np.array([0, 120, 200]))
    for t, (a, b) in enumerate(((0, 120), (120, 200))):
        for i in range(b - a):
            for j in range(i + LEAST - 1, b - a):
                least = int(np.argmin(h[a + i : a + j + 1])) + i
                held = [k for k in range(len(c)) if text[k] == t and l[k] <= i and j <= r[k] and i <= c[k] <= j]
                assert [int(c[k]) for k in held] == [least]


@pytest.mark.parametrize("n,inserted,cut", [(104, 9, 0), (104, 14, 0), (200, 25, 0), (300, 40, 0), (80, 8, 0), (104, 0, 9), (60, 0, 1), (200, 14, 8)])
def test_passage_with_insertion_or_deletion(n, inserted, cut):
    """Both whole passages are found, though one side has far more unmatched tokens."""
    from plantgauge.llm.near_passages import LEAST, best_stretch

    x = np.random.default_rng(n).permutation(10_000)[: n - 4].astype(np.uint64)
    half = len(x) // 2
    gap = np.arange(20_000, 20_000 + inserted + 4 if inserted else 20_000 + 4).astype(np.uint64)
    y = np.concatenate([x[:half], gap, x[half + cut + 4 if cut else half + 4 :]])
    both = len(np.intersect1d(x, y))
    assert both >= 0.8 * len(np.union1d(x, y))
    after = len(x) - 3
    for c in (3, after):
        d = int(np.flatnonzero(y == x[c])[0])
        a, b, lo, hi = best_stretch(x, y, 0, c, len(x) - 1, 0, d, len(y) - 1)
        assert (a, b) == (0, len(x) + 4) and (lo, hi) == (0, len(y) + 4)


def test_stretches_against_brute_force():
    """A stretch pair is found exactly if any around the token qualifies."""
    from plantgauge.llm import near_passages as m

    rng = random.Random(8)
    found = 0
    for _ in range(60):
        x = [rng.randint(0, 10**6) for _ in range(rng.randint(50, 62))]
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            at, k = rng.randrange(len(y)), rng.randint(1, 4)
            y[at : at + rng.choice([0, 0, k])] = [rng.randint(2 * 10**6, 3 * 10**6) for _ in range(rng.choice([0, k]))]
        c = rng.randrange(len(x))
        if x[c] not in y:
            continue
        d = y.index(x[c])

        def jaccard(a, b):
            return len(a & b) / len(a | b)

        any_ = any(
            jaccard(set(x[i : j + 1]), set(y[k : n + 1])) >= 0.8
            for i in range(min(c, len(x) - m.LEAST) + 1) for j in range(max(c, i + m.LEAST - 1), len(x))
            for k in range(min(d, len(y) - m.LEAST) + 1) for n in range(max(d, k + m.LEAST - 1), len(y))
        )
        got = m.best_stretch(np.array(x, dtype=np.uint64), np.array(y, dtype=np.uint64), 0, c, len(x) - 1, 0, d, len(y) - 1)
        assert (got is not None) == any_
        found += any_
    assert 5 < found < 60


def test_window_pairs_without_a_passage_are_told_before_alignment():
    """No window pair that holds a passage is given up, repeated tokens or not; one whose
    shared tokens stand outside the other window is."""
    from plantgauge.llm.near_passages import Pair, passages_within

    rng = random.Random(12)
    found = 0
    for round_ in range(150):
        x = [rng.randint(0, 10**6) for _ in range(rng.randint(50, 70))]
        if round_ % 2:  # a line that repeats
            x[20:40] = (x[20:25] * 4)[:20]
        y = list(x)
        for _ in range(rng.randint(0, 7)):
            y[rng.randrange(len(y))] = rng.randint(2 * 10**6, 3 * 10**6)
        c = rng.randrange(len(x))
        if x[c] != y[c]:
            continue
        pair = Pair(np.array(x, dtype=np.uint64), np.array(y, dtype=np.uint64))
        row = (0, c, len(x) - 1, 0, c, len(y) - 1)
        got = pair.best(*row)
        found += got is not None
        assert got is None or not pair.hopeless(*row)
        assert passages_within(*pair.sides, np.array([row])) == ([got] if got else [])
    assert found > 40
    x = np.arange(200, dtype=np.uint64)
    y = np.concatenate([x[100:], np.arange(300, 349, dtype=np.uint64), x[50:51], np.arange(400, 449, dtype=np.uint64), x[:50]])
    pair = Pair(x, y)
    assert pair.hopeless(0, 50, 99, 100, 149, 198) and not pair.hopeless(100, 150, 199, 0, 50, 99)


def test_sums_of_known_words_per_segment():
    """Rows of known words are summed per segment, whatever its length; segments without any are
    left out. Places carry an index into a part of a vocabulary, and -1."""
    from plantgauge.llm.decontaminate import gathered, index_in, places

    rng = np.random.default_rng(4)
    vocabulary = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    part = vocabulary[::3]
    words = np.concatenate([rng.choice(vocabulary, 500), rng.integers(0, 2**63, 200, dtype=np.uint64)])[rng.permutation(700)]
    at = places(vocabulary, part)[index_in(vocabulary, words)]
    assert (at == index_in(part, words)).all()
    starts = np.array([0, 1, 40, 41, 42, 300, 690])
    table = rng.standard_normal((len(part), 5))
    known, number, segment, sums = gathered(at, starts, table)
    ends = np.append(starts[1:], len(words))
    want = {i: table[at[a:b][at[a:b] >= 0]].sum(axis=0) for i, (a, b) in enumerate(zip(starts, ends)) if (at[a:b] >= 0).any()}
    assert list(want) == segment.tolist() and np.allclose(sums, list(want.values()))
    assert (known == at[at >= 0]).all() and len(number) == len(known)


def test_encoded_words_tell_whether_their_tokens_come_back():
    """Ids and verdict of each word come from its prefix; a character without a piece or bytes
    spells something else."""
    import sentencepiece

    from plantgauge.llm.sentencepieces import MARK, Pieces, default_model

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    m = Pieces(default_model())
    texts = ["wonder", "wonderful", "won", "x9f3k", "\u4e2d\u6587", "\U0001f600a", "", "naïve"]
    words = {w: t for t in texts for w in m.words(t)}
    got = dict(m.encoded(words))
    for w, t in words.items():
        assert np.frombuffer(got[w][0], dtype=np.int32).tolist() == sp.encode(t) and got[w][1]
    bare = Pieces(default_model())
    bare.bytes, bare.byte_of = {}, {}
    got = dict(bare.encoded([MARK + "won", MARK + "won\U00012000", MARK + "won\U00012000s"]))
    assert [back for _, back in got.values()] == [True, False, False]


def test_passages_of_a_group_without_its_ends(spark):
    """Edited copies of a phrase meet though the smallest and largest text of each
    key, which hold only a piece of it, verify with none; recall against brute force."""
    from plantgauge.llm.near_passages import near_passages

    rng = random.Random(3)
    texts, families = [], []
    for g in range(40):
        words = [f"w{g}x{i}" for i in range(60)]
        new = lambda n: [f"n{rng.random()}" for _ in range(n)]
        one, two = list(words), list(words)
        one[30] = new(1)[0]
        families.append((len(texts), len(texts) + 1))
        texts += [" ".join(new(20) + w + new(20)) for w in (one, two)]
        # pieces too short to be a passage, in many texts: they are the ends of key groups
        for k in range(0, 60, 20):
            texts += [" ".join(new(20) + words[k : k + 30] + new(20)) for _ in range(4)]
    rows = near_passages(make(spark, texts)).collect()
    classes = collections.defaultdict(set)
    for r in rows:
        classes[r["doc_id"]].add(r["class_id"])
    met = sum(bool(classes[a] & classes[b]) for a, b in families)
    assert met >= 0.96 * len(families), met
    assert set(classes) <= {i for f in families for i in f}


def test_prefix_pairs_equal_brute_force(spark):
    """Every pair of sets with the wanted similarity and different labels meets; pairs that only
    share what all sets have do not."""
    from plantgauge.llm.near_dedup import SIMILARITY, own_shares, prefix_pairs

    rng = random.Random(40)
    sets = []
    for _ in range(12):
        base = rng.sample(range(1000), rng.randint(1, 60))
        sets += [set(base)] + [set(base) - set(rng.sample(base, rng.randint(0, len(base) // 5))) | set(rng.sample(range(1000), rng.randint(0, len(base) // 6))) for _ in range(4)]
    common = set(range(2000, 2040))
    sets += [common | set(rng.sample(range(3000, 900_000), 18)) for _ in range(15)]
    label = lambda i: bytes([i % 7])
    rows = [(bytes([i]), s, len(x)) for i, x in enumerate(sets) for s in x]
    shingles = spark.createDataFrame(rows, "node binary, shingle long, size int")
    nodes = own_shares(shingles).join(spark.createDataFrame([(bytes([i]), label(i)) for i in range(len(sets))], "node binary, label binary"), "node")
    got = {(r["a"][0], r["b"][0]) for r in prefix_pairs(shingles, nodes).collect()}
    near = lambda x, y: len(x & y) >= SIMILARITY * len(x | y) - 1e-9
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if label(i) != label(j) and near(sets[i], sets[j])}
    assert want and want <= got
    assert not any(i >= 60 and j >= 60 for i, j in got - want)


def test_columns_of_the_caller_are_kept(spark):
    """Names that operators use inside stay the caller's, wherever they stand."""
    from plantgauge.llm.decontaminate import find_leaks
    from plantgauge.llm.html_extract import extract_articles
    from plantgauge.llm.near_dedup import drop_near_duplicates
    from plantgauge.llm.pii import find_personal_data, redact
    from plantgauge.llm.quality_rules import quality_rules
    from plantgauge.llm.sentencepieces import encode_documents
    from plantgauge.llm.sharding import hypergeometric_shards

    names = ["_d_text", "_h_html", "_p_text", "_q_text", "_Q_w", "_s_text", "_hg_part", "_hg_bounds", "_n_node", "pii"]
    texts = [prose(40, 50), "mail me at a.b@c.org", None, ""]
    df = spark.createDataFrame(
        [(*names[:5], i, t, *names[5:]) for i, t in enumerate(texts)],
        ", ".join([*(f"{n} string" for n in names[:5]), "doc_id long", "text string", *(f"{n} string" for n in names[5:])]),
    )
    bench = spark.createDataFrame([(1, prose(40, 50))], "item_id long, text string")
    made = [
        find_leaks(df, bench), quality_rules(df), encode_documents(df), hypergeometric_shards(df, 3), drop_near_duplicates(df), redact(df),
        find_personal_data(df.drop("pii")), extract_articles(df.withColumnRenamed("text", "html")),
    ]
    for out in made:
        kept = [n for n in names if n in out.columns or n != "pii"]
        for r in out.collect():
            assert all(r[n] == n for n in kept if n != "pii" or isinstance(r[n], str)), out.columns
    assert {r["doc_id"]: r["text"] for r in redact(df).collect()} == {0: texts[0], 1: "mail me at <email>", 2: None, 3: ""}
    assert redact(df).first()["pii"] == "pii"


def test_broken_tags_end_with_the_page():
    """An unclosed quote or tag takes the rest of the page with it, in linear time."""
    import time

    from plantgauge.llm.html_extract import Page, prior

    def article(source):
        page = Page(source)
        return page.article(prior(page.features()))

    assert article('<body><article><p>Before it.</p><p class="x>Hello world.</p></article>') == "Before it."
    assert article("<article><p title=it's>It's here.</p><p a='x>y' b=\"c>d\">Next, it's fine.</p></article>") == "It's here.\n\nNext, it's fine."
    assert article("<article><p>One.</p><p>Two <b") == "One.\n\nTwo"
    assert article("<article><p>a < b and 3 <4.</p></article>") == "a < b and 3 <4."
    for part in ('<p a="', "<!", "<a b=c", "<script '", "<p x='\"", "<!--"):
        begin = time.perf_counter()
        Page(part * 100_000)
        assert time.perf_counter() - begin < 5


def test_added_candidates_touch_nothing_taken():
    from plantgauge.llm.pii import BASE, added_candidates, base_spans

    rng = random.Random(60)
    bits = ["Mr. John Smith", "123-45-6789", "a@b.co", "+1 555 123 4567", "4111 1111 1111 1111", "10.0.0.1", "word", "DE89370400440532013000", "(555) 123-4567"]
    for _ in range(20):
        text = " ".join(rng.choice(bits) for _ in range(60))
        base = base_spans(text)
        more = added_candidates(text, base)
        assert all(k >= len(BASE) for k, _, _ in more)
        taken = [(s, e) for _, s, e in base] + [(s, e) for _, s, e in more]
        for i, (s, e) in enumerate(taken[len(base) :]):
            others = taken[: len(base)] + taken[len(base) : len(base) + i]
            assert not any(a < e and s < b for a, b in others)


def test_redaction_takes_one_worker_a_task(spark):
    """Spans are found and replaced in one pass; two chained passes hold two workers each."""
    from plantgauge.llm.pii import N_FEATURES, find_personal_data, redact

    texts = ["mail me at a@b.co or b@c.org, +1 555 123 4567", None, "", "nothing", "10.0.0.1 and Dr. Ann Lee"]
    df = make(spark, texts)
    weights = np.ones(N_FEATURES + 1)
    out = redact(df, weights=weights)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    spans = {r["doc_id"]: sorted(r["pii"], key=lambda x: (x["start"], -x["end"])) for r in find_personal_data(df, weights=weights).collect()}
    for r in out.collect():
        want, low, t = "", 0, texts[r["doc_id"]]
        for x in spans[r["doc_id"]]:
            if x["start"] >= low:
                want, low = want + t[low : x["start"]] + f"<{x['kind']}>", x["end"]
        assert r["text"] == (None if t is None else want + t[low:])
    assert any(spans.values()) and out.schema == df.schema


def test_piece_borders_are_told_without_merging_both_tokens(monkeypatch):
    import random

    from plantgauge.llm.sentencepieces import Pieces, default_model

    model, draw = Pieces(default_model()), random.Random(5)
    names = [p for p in list(model.id)[:8000] if model.merge(p) == [p]]
    pairs = [(draw.choice(names + ["é", "中"]), draw.choice(names)) for _ in range(3000)]
    cuts = [(p[:k], p[k:]) for p in names[:3000] for k in range(1, len(p)) if p[:k] in model.id and p[k:] in model.id]
    pairs += [(a, b) for a, b in cuts if model.merge(a) == [a]]
    want = [model.merge(a + b) == [a, b] for a, b in pairs]
    monkeypatch.setattr(model, "merge", None)
    assert [model.follows(a, b) for a, b in pairs] == want and any(want) and not all(want)


def test_words_met_again_stay_when_the_memo_is_full(monkeypatch):
    from plantgauge.llm import sentencepieces
    from plantgauge.llm.sentencepieces import Pieces, default_model, encode_texts

    monkeypatch.setattr(sentencepieces, "MEMO_WORDS", 4)
    model, memo, misspelt, seen = Pieces(default_model()), {}, {"long gone"}, []
    encoded = model.encoded
    monkeypatch.setattr(model, "encoded", lambda words: (seen.append(set(words)), encoded(words))[1])
    encode_texts(model, ["one two three"], memo, misspelt)
    ids, good = encode_texts(model, ["one four five"], memo, misspelt)
    assert seen[1] == {"▁four", "▁five"} and set(memo) == {"▁one", "▁four", "▁five"} and not misspelt
    assert good == [True] and ids == encode_texts(model, ["one four five"], {}, set())[0]


def test_ids_of_every_text_are_decoded(spark, monkeypatch):
    """F4 of round 4: the query decodes the token ids of each row, so ids that were changed do not come back."""
    pytest.importorskip("sentencepiece")
    from plantgauge.llm import catalog, sentencepieces

    texts = ["some words here", "other words there", "", None, "☃ and▁mark"]
    monkeypatch.setattr(catalog, "table", lambda *_: make(spark, texts))
    query = lambda: {r["doc_id"]: r["round_trip"] for r in catalog.QUERIES["op5_sentencepiece"](spark, "").collect()}
    assert query() == dict.fromkeys(range(5), True)

    decode = sentencepieces.decode_documents
    turned = F.when(F.col("doc_id") == 1, F.reverse("token_ids")).otherwise(F.col("token_ids"))
    monkeypatch.setattr(sentencepieces, "decode_documents", lambda df, *a, **k: decode(df.withColumn("token_ids", turned), *a, **k))
    assert query() == {0: True, 1: False, 2: True, 3: True, 4: True}


def test_ids_are_decoded_together_as_alone():
    pytest.importorskip("sentencepiece")
    import pyarrow as pa

    from plantgauge.llm.sentencepieces import MARK, Pieces, default_model

    m, rng = Pieces(default_model()), np.random.default_rng(4)
    high = [0, 300, len(m.text)]
    lists = [rng.integers(0, high[1 + k % 2], rng.integers(0, 12)).tolist() for k in range(600)]
    lists += [None, [], [m.bytes[b] for b in MARK.encode()], [m.bytes[32], m.bytes[32]], [0, 1, 2], [m.id[MARK]] * 2]
    want = [m.decode(x or []) for x in lists]
    for size in (1, 9, len(lists)):
        parts = [m.decode_all(pa.array(lists[a : a + size], pa.list_(pa.int32()))) for a in range(0, len(lists), size)]
        assert [t for p in parts for t in p.to_pylist()] == want
    assert m.decode_all(pa.array([], pa.list_(pa.int32()))).to_pylist() == []
    with pytest.raises(IndexError):
        m.decode_all(pa.array([[len(m.text)]], pa.list_(pa.int32())))


def test_a_line_of_many_unlike_texts_makes_no_pairs(spark, monkeypatch):
    """F1 of round 4: texts that share a line too short for a passage are not paired in the last join; one that
    holds a passage of another beside the line still is found."""
    from plantgauge.llm import near_passages as m

    line, rng = prose(40, 900), random.Random(31)
    unlike = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    texts = [f"{unlike(50)} {line} {unlike(50)}" for _ in range(60)]
    left = unlike(12)
    texts += [f"{unlike(50)} {line} {left} {unlike(50)}" for _ in range(4)]
    seen, aligned = [], m.aligned
    monkeypatch.setattr(m, "aligned", lambda pairs, t: (seen.append(pairs.select("a", "b").distinct().count()), aligned(pairs, t))[1])
    rows = m.near_passages(make(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == {60, 61, 62, 63} and len({r["class_id"] for r in rows}) == 1
    assert all(r["end_word"] - r["start_word"] >= 52 for r in rows)
    # all pairs of the 64 texts would be 2,016
    assert len(seen) == 3 and seen[2] <= 6


def test_windows_that_may_hold_a_passage(spark):
    """Against brute force: windows are dropped only if no text of another label shares enough around their token."""
    from plantgauge.llm import near_passages as m

    tokens = lambda t: next(iter(m.blocks_of([t])))[1]
    parts = [prose(60, 910 + i) for i in range(6)]
    texts = [" ".join(parts[j] for j in order) for order in ((0, 1), (2, 1), (0, 3), (4, 5), (5, 5, 2))]
    labels = [b"A", b"A", None, None, b"B"]
    windows = [(i, 0, c, len(tokens(t)) - 1) for i, t in enumerate(texts) for c in range(0, len(tokens(t)), 9)]
    node = lambda i: bytes([i])
    given = spark.createDataFrame([(node(i), l, c, r, labels[i]) for i, l, c, r in windows], "node binary, l int, c int, r int, label binary")
    rows = spark.createDataFrame([(node(i), t) for i, t in enumerate(texts)], "node binary, text string")
    kept = {(r["node"][0], r["c"]) for r in m.possible(given, rows).collect()}
    want, owner = set(), [x or node(i) for i, x in enumerate(labels)]
    for i, l, c, r in windows:
        own = tokens(texts[i])
        others = {int(t) for j, x in enumerate(texts) if owner[j] != owner[i] for t in tokens(x)}
        for a in range(l, c + 1):
            for b in range(max(c + 1, a + m.LEAST), r + 2):
                held = {int(t) for t in own[a:b]}
                if 5 * len(held & others) >= 4 * len(held):
                    want.add((i, c))
    assert want <= kept and (3, 0) not in kept and len(kept) < len(windows)


def test_a_text_of_many_pairs_is_cut_once_and_shuffles_go(spark, tmp_path, monkeypatch):
    """F1 of round 4: a text in the middle of many pairs is cut into tokens once a task; a write that frees its
    shuffle files leaves the setting as it was."""
    from plantgauge.llm import near_passages as m
    from plantgauge.llm.common import FREE_SHUFFLES, stored

    blocks_of = m.blocks_of
    texts = [prose(90, 77) + f" tail{i}" for i in range(6)]
    rows = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "node binary, text string")
    windows = m.windows_of(rows).select("key", "node", "l", "c", "r")
    held, frame = {}, type(rows)
    run = frame.mapInArrow

    def caught(self, function, schema, *a, **k):
        """Runs the step here too, where calls can be counted."""
        if "a_from" in str(schema):
            import pyarrow as pa

            table = self.coalesce(1).toArrow()
            counted = []
            monkeypatch.setattr(m, "blocks_of", lambda t: (counted.append(len(t)), blocks_of(t))[1])
            out = pa.Table.from_batches(list(function(table.to_batches())))
            held.update(texts=sum(counted), rows=table.num_rows, found=out.num_rows)
            monkeypatch.setattr(m, "blocks_of", blocks_of)
        return run(self, function, schema, *a, **k)

    monkeypatch.setattr(frame, "mapInArrow", caught)
    pairs = m.paired(windows, windows, ["key"])
    m.verified(pairs, rows)
    assert held["rows"] == 30 and held["found"] >= 30 and held["texts"] == 6

    before = spark.conf.get(FREE_SHUFFLES)
    monkeypatch.setattr("plantgauge.llm.common.fresh_folder", lambda _, name: str(tmp_path / name))
    out = stored(rows.groupBy("text").count(), "freed", free=True)
    assert out.count() == 6 and spark.conf.get(FREE_SHUFFLES) == before


def test_window_lists_stand_for_all_their_pairs(spark):
    """F1 of round 4: lists of windows give the passages that their window pairs give."""
    from plantgauge.llm import near_passages as m

    texts = [" ".join([prose(30, 501)] * 4 + [prose(20, 502 + i)]) for i in range(3)] + [prose(60, 510)]
    rows = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "node binary, text string")
    windows = m.windows_of(rows).select("key", "node", "l", "c", "r")
    one = m.paired(windows, windows, ["key"]).where("a < b")
    each = windows.groupBy("key", "node").agg(F.collect_set(F.struct("l", "c", "r")).alias("w"))
    x, y = (each.select("key", F.col("node").alias(n), F.col("w").alias(w)) for n, w in ("ap", "bq"))
    many = x.join(y, "key").where("a < b")
    assert many.count() < one.count()
    order = lambda df: sorted(tuple(r) for r in df.collect())
    got = order(m.verified_groups(many.select("a", "b", "p", "q"), rows))
    assert got == order(m.verified(one, rows)) and len(got) >= 3
