import random
import re
from collections import Counter

import numpy as np
import pytest

from aerolith.llm import ngram_join as j
from aerolith.operators.components import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, root, links = [grams(t) for _, t in rows], list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for a, (i, _) in enumerate(rows):
        ids = [x for x in (low.get(find(a)), i) if x is not None]
        low[find(a)] = min(ids) if ids else None
    return sorted((rows[a][0] is None, rows[a][0] or 0, str(low[find(a)]), links[a]) for a in range(len(rows)))


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, str(r.class_id), r.n_links) for r in df.collect())


def texts(seed=1, near=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    for _ in range(near):  # a group of near copies, some of them under the threshold of each other
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    out += [" ".join(base).upper() + "!", "  ", "", None, "one two", "One, two", "two one", "solo", "é é é é é é", "x " * 5000, "x " * 4999, " ".join(rng.choice(words) for _ in range(15_000))]
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [rows[3], rows[3], (None, out[5]), (None, "nobody else has this very text here"), (None, None)]


@pytest.mark.parametrize("block,bits", [(256, 1 << 27), (16, 0)])
def test_like_brute_force(spark, monkeypatch, block, bits):
    monkeypatch.setattr(j, "BLOCK_TEXTS", block)
    monkeypatch.setattr(j, "MOST_BITS", bits)  # 0: texts are joined without a filter
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, links int").repartition(3)
    assert found(j.ngram_join(df)) == brute(rows)


def test_keeps_one_of_each_class(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    kept = j.keep_one(df)
    assert kept.columns == df.columns
    want = {r[1] for r in brute(rows) if not r[0] and str(r[1]) == r[2]}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(j.ngram_join(empty)) == [] and j.keep_one(empty).count() == 0


def test_recall_bound():
    d = j.stop_depth()
    assert d < j.DEEP and 1 - (1 - 0.8**d) ** j.TREES >= j.TARGET_RECALL > 1 - (1 - 0.8 ** (d + 1)) ** j.TREES


def test_lowest_similarity_of_a_different_set():
    for n in range(1, 30):
        all_ = [c / (n + m - c) for m in range(1, 60) for c in range(min(n, m) + 1) if not c == n == m and 5 * c >= 4 * (n + m - c)]
        assert j.lowest_similarity(n) == (min(all_) if all_ else None)
    leave = j.stop_depths(j.THRESHOLD, j.TREES, j.TARGET_RECALL)
    assert leave[:4] == [None] * 4 and leave[7] > j.stop_depth() == leave[4] == leave[64]


def test_short_texts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_TEXTS", 4)
    rng = random.Random(8)
    base = [[f"w{i}x{k}" for k in range(rng.randint(5, 16))] for i in range(25)]
    rows = []
    for w in base:
        for _ in range(rng.randint(1, 12)):
            cut = rng.randint(0, 2)
            rows.append((len(rows), " ".join(w[: len(w) - cut] if rng.random() < 0.5 else w + [f"e{rng.randint(0, 2)}"] * cut)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(j.ngram_join(df)) == brute(rows)


def test_a_chain_of_candidates_is_no_class(spark):
    """Texts that share much with the next one, but less than the threshold: candidates in plenty, hardly a class."""
    words = [f"w{k}" for k in range(2_000)]
    rows = [(i, " ".join(words[14 * i : 14 * i + 60])) for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(j.ngram_join(df)) == brute(rows) and all(x[3] == 0 for x in found(j.ngram_join(df)))


def test_compare_is_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(40)]
    got = j.compare(sets, sets, (4, 5))
    want = [[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert got.tolist() == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_filter_has_all_keys_and_few_others(spark):
    h, bits = np.random.default_rng(5).integers(-(2**63), 2**63, 2000), 1 << 14
    marks = j.bloom_filter(spark.createDataFrame([(int(x),) for x in h[:1000]], "h long").repartition(3), bits)
    has = np.unpackbits(marks, bitorder="little").astype(bool)
    passes = np.all([has[p.astype(np.int64)] for p in j.places(h, bits)], axis=0)
    assert passes[:1000].all() and passes[1000:].sum() < 20
