import hashlib
import re

from aerolith.llm.decontamination import digest, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, items string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    out = {}
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, itext in items:
            iw = words(itext)
            if item is None or not iw:
                continue
            n = min(size, len(iw))
            for i in range(len(iw) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == iw[i : i + n]:
                        hit.update(range(j, j + n))
                        ids.add(str(item))
        out.setdefault(doc_id, []).append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return {k: sorted(v) for k, v in out.items()}


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "only four words here"), (3, "solo"),
         (4, ""), (5, None), (None, "alpha beta"), (6, "b b b b b b b b b b b b"), (7, "Élan été naïve"), (8, "only four words here")]
LONG = "filler " * 3000 + "ALPHA, beta; gamma delta epsilon zeta eta theta iota kappa" + " tail" * 3000
TEXTS = [(1, "x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu y"), (2, "only four"), (3, "words here only four words here"),
         (4, None), (5, ""), (6, "...!"), (7, "b " * 25), (8, "solo solo x solo"), (9, LONG), (10, "élan été naïve"), (11, "Élan été naïve Élan été naïve"),
         (12, "beta gamma delta epsilon zeta eta theta iota kappa"), (13, "only four"), (13, "only four"), (None, "solo"), (14, "here")]


def rows(df):
    out = {}
    for r in digest(df).collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    return {k: sorted(v) for k, v in out.items()}


def test_like_brute_force_in_one_block_or_several(spark):
    docs = spark.createDataFrame([(a, b, "en", "clash") for a, b in TEXTS], DOCS)
    items = spark.createDataFrame([(a, b, None) for a, b in ITEMS], "item_id long, text string, doc_id long")
    want = brute(TEXTS, ITEMS)
    assert rows(find_contamination(docs, items)) == want
    assert rows(find_contamination(docs, items, block_windows=40)) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows(find_contamination(docs, items)) == brute([(1, "a b")], [])
    assert rows(find_contamination(docs.limit(0), items)) == {}


def test_items_without_id_are_hit(spark):
    docs = spark.createDataFrame([(1, "x secret answer y"), (2, "x answer secret y"), (3, "x secret answer only four words here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "secret answer"), (2, "only four words here")], "item_id long, text string")
    for options in ({}, {"block_windows": 4}):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in digest(find_contamination(docs, items, **options)).collect()}
        assert got == {1: (2, 0, True), 2: (0, 0, False), 3: (6, 1, True)}
