import pytest

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from aerolith.llm.token_counts import count_tokens, whole_tokens  # noqa: E402

TEXTS = [None, "", " ", "  ", "a", "a b", "a  b", " a", "a ", "a   ", "x\ny z", "\n \n", "tab\t a", "▁", "a▁b", "▁▁a b▁", "<s> </s> <unk> a", "ｆｕｌｌ ａ", "é é", "日本語 テキスト", " a  ", "🙂 🙂🙂", "word " * 5000, "x" * 3000, "<0x0A> a", "a\r\nb"]


def test_like_the_library_on_whole_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(1, "", 0)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096), t[:40]


def test_whole_tokens_are_proven(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    whole = whole_tokens(model)
    assert len(whole) > 10_000 and all(len(model.encode(w)) == 1 for w in list(whole)[::97])


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), P.path("piece_bpe_32k.model")).count() == 0


def test_memory_is_bounded_by_characters(monkeypatch):
    from aerolith.llm import token_counts as t

    monkeypatch.setattr(t, "REMEMBERED_CHARS", 2_000)
    counts = t.Counts(P.path("piece_bpe_32k.model"))
    texts = [chr(0x4E00 + i % 5_000) * 3_000 for i in range(40)] + [" ".join(f"x{i}y{k}z" for k in range(60)) for i in range(40)]
    for x in texts:
        assert counts.of(x) == len(counts.model.encode(x))
        assert sum(map(len, counts.keys() - counts.whole.keys())) < 2_000 + t.LONGEST


def test_null_ids(spark):
    rows = [(None, "a b"), (None, None)]
    assert sorted(r.n_tokens for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()) == [0, 2]
