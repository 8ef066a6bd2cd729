import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as c  # noqa: E402
import test_decontamination as leaks  # noqa: E402
import test_mixing as mixes  # noqa: E402
import test_ngram_join as copies  # noqa: E402
import test_quality as rules  # noqa: E402

from aerolith.llm.mixing import PERIOD  # noqa: E402
from aerolith.llm.quality import quality  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    item = "nine brave sailors crossed the wide river before the morning bell rang twice"
    texts = [rules.prose(rng, rng.randint(20, 120)) for _ in range(150)]
    texts += [texts[3], texts[3].upper(), " ".join(texts[5].split()[:-1]), "same words " * 20, "too short", None, "", item, texts[7] + " " + item, rules.prose(rng, 90, "qwzvjkpQWZ#%")]
    return [(i, t, "en", rng.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)], [(1, item), (2, "unrelated few words")]


def expected(spark, rows, items):
    """Each stage in plain Python; only the language model's verdicts come from its operator, which has tests of its own."""
    verdict = {r.doc_id: r for r in quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(verdict[r[0]].base_failed == rules.brute(r[1])[-1] for r in rows)
    rows = [r for r in rows if verdict[r[0]].kept]
    low = {x[1]: x[2] for x in copies.brute([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if low[r[0]] == str(r[0])]
    hit = {k: v[0][-1] for k, v in leaks.brute([(r[0], r[1]) for r in rows], items).items()}
    rows = [r for r in rows if not hit[r[0]]]
    key = lambda s: "null" if s is None else f"={s}"
    signed = lambda i: (h := xxhash.xxh64(str(i).encode(), seed=42).intdigest()) - (h >> 63 << 64)
    by, buckets = {}, max(c.mix.__globals__["LEAST_GROUPS"], len(rows) // 20_000)
    for r in sorted(rows, key=lambda r: ((signed(r[0]) >> 20) % buckets, signed(r[0]), r[0])):
        by.setdefault(key(r[3]), []).append(r)
    order = mixes.simulate({s: len(v) for s, v in by.items()}, {s: len(v) ** 0.5 for s, v in by.items()}, 16, PERIOD)
    rows = [r for s, block in order for r in by[s][16 * block : 16 * block + 16]]
    library, start, out = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for r in rows:
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 0]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_stages_like_plain_python(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(r) for r in c.run(spark, str(tmp_path)).orderBy("start").collect()]
    want = expected(spark, rows, items)
    assert got == want
    ids = {g[0] for g in got}
    assert len({3, 150, 151} & ids) == 1 and not {153, 154, 155, 156, 157, 158, 159} & ids and len(ids) > 130


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a few words " * 5, "en", "s", 1), (None, None, None, None, None), (1, "a few words " * 5, "en", "s", 1)], DOCS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0)):
        for name, stage in c.STAGES[:-1]:
            assert stage(spark, rows, str(tmp_path)).columns == docs.columns, name


def test_verdicts_go_by_row_where_ids_are_missing_or_shared(spark, tmp_path):
    rng = random.Random(4)
    item = "nine brave sailors crossed the wide river before the morning bell rang twice"
    good = [rules.prose(rng, 60) for _ in range(40)]
    rows = [(None if k < 20 else 7, t, "en", "s", 1) for k, t in enumerate(good)]
    bad = [(i, t, "en", "s", 1) for i in (None, 7) for t in ("too short", rules.prose(rng, 60) + " " + item)]
    copies_ = [(None, good[1], "en", "s", 1), (None, good[2].upper(), "en", "s", 1), (3, good[3], "en", "s", 1), (7, good[21], "en", "s", 1)]
    spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows + bad + copies_, DOCS).repartition(3)
    stages = dict(c.STAGES)
    docs = stages["quality rules"](spark, docs, str(tmp_path))
    assert sum(r.text == "too short" for r in docs.collect()) == 0 and docs.count() >= 40
    stages["n-gram Jaccard join"](spark, spark.createDataFrame(rows + bad[1::2] + copies_, DOCS), str(tmp_path)).write.parquet(str(tmp_path / "joined"))
    docs = spark.read.parquet(str(tmp_path / "joined"))
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({t.lower() for _, t in left}) == len(left) and (3, good[3]) in left and (None, good[3]) not in left
    docs = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert {r.text.lower() for r in docs.collect()} == set(good)


def test_the_rest_works_without_this_subpackage():
    code = "import sys; sys.modules['aerolith.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True, timeout=120)


def test_columns_named_like_those_in_use(spark, tmp_path):
    """The stages' own column names, in other letters too, on documents that have them."""
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["gone_key", "ROW_ID", "text_key", "id_", "key", "block", "slot", "node", "row", "position", "bucket", "number"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"{DOCS}, {', '.join(f'{n} int' for n in names)}")
    plain = spark.createDataFrame(rows, DOCS)
    for _, stage in c.STAGES[:4]:
        ids = sorted(r.doc_id for r in stage(spark, plain, str(tmp_path)).collect())
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == ids and ids
