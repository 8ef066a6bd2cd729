import random
import re

import numpy as np
import pytest
import xxhash

from aerolith.llm import simhash as s


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    every = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in every]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows, radius=4):
    """Every pair of documents compared."""
    fp = [plain_fingerprint(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                at[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    low = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return sorted(((d, f"{fp[i]:016x}", low[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def documents():
    rng = random.Random(4)
    words = [f"Wört{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 4, 40, 400])))) for i in range(120)]
    for i in range(120, 300):
        t = rng.choice(rows[:120])[1].split()
        if rng.random() < 0.8:
            t[rng.randrange(len(t))] = "other"
        rows.append((rng.choice([i, None]), rng.choice([" ", "\n\t"]).join(t).swapcase()))
    return rows + [(900, ""), (901, None), (902, " \x0b "), (7, rows[7][1]), (7, "same id, another text"), (903, "\x1cno space\xa0here"), (904, "many words " * 30_000)]


def test_like_all_pairs(spark):
    rows = documents()
    df = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, df.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("most, at_once", [(8, 64), (40, 5_000)])
def test_crowded_prefixes_are_extended_and_cut(spark, monkeypatch, most, at_once):
    monkeypatch.setattr(s, "MOST_ROWS", most)
    monkeypatch.setattr(s, "MEAN_ROWS", most)
    rng = np.random.default_rng(most)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    x = [int(c) for c in centre]
    for c in centre.tolist():
        x += [c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(12)]
    x += rng.integers(0, 2**63, 20, dtype=np.uint64).tolist()
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in sorted(set(x))], "fp long")
    links = s.near_fingerprints(nodes, len(set(x)), 4).collect()
    u = np.array(sorted(set(x)), np.uint64)
    near = np.bitwise_count(u[:, None] ^ u) <= 4
    want = s.joined(len(u), *np.nonzero(np.triu(near, 1)))
    place = {int(v.view(np.int64)): i for i, v in enumerate(u)}
    a, b = (np.array([place[r[k]] for r in links], np.int64) for k in (0, 1))
    assert np.array_equal(s.joined(len(u), a, b), want)


@pytest.mark.parametrize("mix, at_once", [(s.MIX, 10**9), (s.MIX, 500), (np.uint64(1 << 20), 10**9), (np.uint64(1 << 40), 10**9)])
def test_meetings_are_all_near_pairs(monkeypatch, mix, at_once):
    """Also where the mix brings different variants together (a factor that loses bits)."""
    monkeypatch.setattr(s, "MIX", mix)
    monkeypatch.setattr(s, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(6) for _ in range(3)]))
    a, b = s.meetings(x, np.full(len(x), 2), 64, 4)
    near = np.triu(np.bitwise_count(x[:, None] ^ x) <= 4, 1)
    assert near[np.minimum(a, b), np.maximum(a, b)].all()
    assert np.array_equal(s.joined(len(x), a, b), s.joined(len(x), *np.nonzero(near)))


def test_other_radius_no_rows_and_clashing_columns(spark):
    rows = documents()[:60]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp long, component string")
    assert sorted(map(tuple, s.near_duplicates(df, radius=3).collect()), key=str) == plain(rows, 3)
    assert s.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        s.near_duplicates(df, radius=20)
