import math
import random
import re
from collections import Counter

import numpy as np

from aerolith.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words string"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n)


def prose(rng, n, letters="etaoinshr"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    texts = [(prose(rng, rng.randint(30, 200)), "en") for _ in range(200)] + [(prose(rng, rng.randint(30, 200), "äöüßxyz"), "de") for _ in range(60)]
    texts += [("a b c d e " * 5, "en"), ("x\ny\nx\n\n\n \n \nx", "en"), ("# one ## * $% &|<>", None), (None, None), ("", "fr"), ("  \t ", "de"), ("é" * 3, "fr"),
              ("w " * 9, "en"), ("w " * 10, "en"), ("one two three four five six\none two three four five seven eight nine ten eleven", "en"), ("z" * 40_000, "en"), ("", "en"), (None, "en"), (prose(rng, 20_000), "en")]
    return [(i, t, lang, "x") for i, (t, lang) in enumerate(texts + texts[:2])] + [(None, "some words", "en", None)]


def test_counts_like_brute_force_and_defined_verdicts(spark):
    rows = corpus()
    got = q.quality(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert tuple(r[k] for k in (*q.MEASURES, "base_failed")) == brute(text[r.doc_id]), r
        assert not (r.kept and r.base_failed)
    prose_kept = [r.kept for r in got if r.doc_id is not None and r.doc_id < 260]
    assert sum(prose_kept) > 0.97 * len(prose_kept)


def test_empty_table(spark):
    assert q.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_band_rejects_gibberish_and_keeps_mixed_languages(spark):
    rng = random.Random(5)
    rows = corpus() + [(1000, prose(rng, 100, "qwzvjkpQWZ#%"), "en", ""), (1001, prose(rng, 60) + " " + prose(rng, 60, "äöüßxyz"), "en", "")]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in q.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept[1000] == (False, False) and kept[1001] == (False, True)


def kneser_ney(texts):
    """Log-probability of each n-gram (a tuple of symbols) by its definition, in plain dictionaries."""
    def symbols(t):
        return [int(q.ASCII[ord(c)]) if ord(c) < 128 else 128 + ord(c) % (4096 - 128) for c in t]

    top = Counter()
    for t in texts:
        s = [0] * (q.ORDER - 1) + symbols(t)
        top.update(tuple(s[i : i + q.ORDER]) for i in range(len(t)))
    of = {q.ORDER: top}
    for k in range(q.ORDER - 1, 0, -1):
        of[k] = Counter(g[1:] for g in of[k + 1])
    p = {(): 1 / (len(of[1]) + 1)}
    for k in range(1, q.ORDER + 1):
        n = [0, *(sum(c == j for c in of[k].values()) for j in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [0, *(min(max(j - (j + 1) * y * n[j + 1] / n[j] if n[j] and n[j + 1] else 0.5 * j, 0), j) for j in (1, 2, 3))]
        if k > 1:
            d[1] = 1.0
        total, free = Counter(), Counter()
        for g, c in of[k].items():
            total[g[:-1]] += c
            free[g[:-1]] += d[min(c, 3)]
        p |= {g: (c - d[min(c, 3)] + free[g[:-1]] * p[g[1:]]) / total[g[:-1]] for g, c in of[k].items()}
    return {g: (top[g], math.log(p[g])) for g in top}


def test_model_like_its_definition(spark):
    rng = random.Random(4)
    texts = {1: [prose(rng, 200, "abcdé"), "", "b", "ab " * 30], 2: [prose(rng, 150, "xyzабв"), "日本 語"]}
    rows = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "slot int, text_ string").repartition(3)
    got = {r.key % (1 << 64): (r.n, r.logp) for r in q.fit_model(rows).collect()}
    want = {}
    for k, ts in [*texts.items(), (q.ALL, texts[1] + texts[2])]:
        for g, v in kneser_ney(ts).items():
            want[k << 12 * q.ORDER | sum(x << 12 * i for i, x in enumerate(reversed(g)))] = v
    assert got.keys() == want.keys()
    assert all(got[k][0] == v[0] and math.isclose(got[k][1], v[1], rel_tol=1e-5, abs_tol=1e-6) for k, v in want.items())


def test_a_part_of_texts_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from aerolith.llm.common import small_batches

    texts = pa.RecordBatch.from_pydict({"text_": ["some plain words " * 50] * 4000})
    part = next(small_batches([texts], "text_", q.BATCH_BYTES)).column("text_").to_pylist()
    tracemalloc.start()
    g, n = q.grams(part)
    _ = [q.HashArrays(np.unique(g), np.zeros(len(np.unique(g)))).find(k) for k in (g, g | q.language_key(q.ALL))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


def test_hash_arrays():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**63), 2**63, 5000))
    table = q.HashArrays(keys[::2], np.arange(len(keys[::2])))
    assert np.array_equal(table.find(keys[::2]), np.arange(len(keys[::2]))) and np.isnan(table.find(keys[1::2])).all()
    assert np.isnan(q.HashArrays(keys[:0], keys[:0]).find(keys)).all()


def test_head_and_join_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    rows = lambda: sorted(((r.doc_id is None, r.doc_id, r.kept, None if r.perplexity is None else round(r.perplexity, 4)) for r in q.quality(df).collect()), key=repr)
    want = rows()
    for head in (1000, 0):
        monkeypatch.setattr(q, "HEAD", head)
        assert rows() == want


def test_many_languages_have_models_of_their_own(spark):
    rng = random.Random(6)
    rows = [(1000 * k + i, prose(rng, 80, "".join(chr(0x400 + 9 * k + j) for j in range(9))), f"l{k}", "") for k in range(20) for i in range(40)]
    rows += [(99_000 + k, prose(rng, 80, "".join(chr(0x400 + rng.randrange(180)) for _ in range(40))), f"l{k}", "") for k in range(20)]
    kept = {r.doc_id: r.kept for r in q.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(v for k, v in kept.items() if k < 99_000) > 0.97 * 800 and not any(v for k, v in kept.items() if k >= 99_000)


def test_lone_long_gibberish_and_an_octave_of_it_set_no_band(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(60, 200)), "en", "") for i in range(1500)]
    rows += [(2000, prose(rng, 3000, "qwzvjkpQWZetaoinshr"), "en", ""), (2001, prose(rng, 3000), "en", ""), (2002, prose(rng, 6000), "en", "")]
    rows += [(3000 + i, prose(rng, 15, "qwzvjkpQWZetaoinshr"), "en", "") for i in range(40)] + [(4000 + i, prose(rng, 15), "en", "") for i in range(20)]
    got = {r.doc_id: r for r in q.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not got[2000].kept and got[2001].kept and got[2002].kept
    assert sum(got[i].kept for i in range(4000, 4020)) >= 19 and sum(got[i].kept for i in range(1500)) > 0.97 * 1500
    # the bounds are no wider where most texts of a length are junk
    assert got[3000].upper / got[3000].lower < 2
