import random
import zlib

import numpy as np

from aerolith.llm.toxicity import Machine, Terms, informative, labelled_sample, toxicity

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"


def corpus(n=900):
    """Toxic only where an insult and a group come together; either alone is common."""
    rng = random.Random(2)
    filler = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(80)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(filler) for _ in range(15)]
        insult, group = rng.random() < 0.45, rng.random() < 0.45
        words += ["nasty"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(insult and group)))
    return rows, labels


def test_learns_pairs_on_held_out_rows(spark):
    rows, labels = corpus()
    extra = [(2000, None, ""), (2001, "", ""), (2002, "MARTIANS! " + "w " * 60_000 + "nasty", ""), (None, "nasty", ""), (2003, "unknown words", ""), (2003, "unknown words", "")]
    noisy = labels + [(0, 1, None), (None, 0, 1), (9999, 1, 1), (5, 0, labels[5][2])]
    out = toxicity(spark.createDataFrame(rows + extra, DOCS).repartition(3), spark.createDataFrame(noisy, LABELS)).collect()
    assert len(out) == len(rows) + len(extra)
    got = {r.doc_id: r for r in out}
    label = {i: y for i, _, y in labels}
    held = [r for r in out if r.held_out and r.doc_id in label]
    assert {r.doc_id for r in held} == {i for i in label if zlib.crc32(str(i).encode()) % 4 == 2} and not got[None].held_out
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert got[2000].score == got[2001].score and got[2002].predicted == 1 and got[None].score < got[2002].score


def test_label_never_seen_or_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "")], DOCS)
    assert toxicity(docs, spark.createDataFrame([], LABELS)).first().predicted == 0
    assert toxicity(docs, spark.createDataFrame([(1, 0, 0)], LABELS)).first().score < 0.01
    assert toxicity(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_raw_score_is_the_sum_over_pairs():
    m = Machine(np.arange(5), 0.25)
    m.w = np.arange(5) / 10
    row = [0, 2, 4]
    pairs = sum(m.v[a] @ m.v[b] for a in row for b in row if a < b)
    assert np.allclose(m.raw([row, []])[0], [0.25 + m.w[row].sum() + pairs, 0.25])


def test_statistic_and_memory():
    s = informative(np.array([50, 10, 0]), np.array([0, 90, 100]), 50, 450)
    assert s[0] > 200 and abs(s[1]) < 1e-9 and s[2] > 10
    assert Terms().of("B b, B") == Terms().of("b")


def test_one_id_on_many_rows_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(4, f"text {k % 3}") for k in range(500)] + [(5, None), (6, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, 100, "doc_id", "text", "toxic").collect()
    assert len(got) <= 2 and all(tuple(r) in {("text 0", 1), ("", 0)} for r in got)
