import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from aerolith.llm import token_output as o  # noqa: E402
from aerolith.llm.range_coder import CorruptBlock, carry, decode, encode  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
TEXTS = ["plain words here", None, "", " ", "a", "a  b", " lead", "trail ", "x\ny z", "\n\n a", "tab\t b", "it's we'll 'd", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>", "nul\0 byte", "é ü 日本語 テ", "🙂 🙂", "nbsp  x y", "　 wide",
         "1 2 33 4,5", "word " * 9000 + "end", "x" * 5000, "a\r\nb c", "a \n b", "...", "!? !?"]


@pytest.mark.parametrize("ids,block", [([], 8), ([5], 8), ([0] * 1000, 64), (list(range(3000)), 256), ([7, 8, 9] * 500 + [2**29 - 1], 100)])
def test_round_trip(ids, block):
    header, blocks = encode(np.array(ids, np.uint32), block)
    assert decode(header, blocks).tolist() == ids
    for i in range(len(blocks)):
        assert decode(header, blocks, [i]).tolist() == ids[i * block : (i + 1) * block]


def test_random_round_trip_and_size():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 60_000), 50_256).astype(np.uint32)
    header, blocks = encode(ids, 1024)
    assert np.array_equal(decode(header, blocks), ids)
    assert len(header) + sum(map(len, blocks)) < 0.6 * 2 * len(ids)


def test_damage_is_found():
    header, blocks = encode(np.arange(2000, dtype=np.uint32) % 50, 500)
    blocks[2] = blocks[2][:20] + bytes([blocks[2][20] ^ 1]) + blocks[2][21:]
    with pytest.raises(CorruptBlock):
        decode(header, blocks)
    assert len(decode(header, blocks, [0, 1, 3])) == 1500


def test_like_the_library(spark, monkeypatch):
    monkeypatch.setattr(o, "SEGMENT_IDS", 5000)
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = [(i * 3 % 101, t, "clash") for i, t in enumerate(TEXTS)] + [(500, "same id b", ""), (500, "same id a", ""), (None, "no id", "")]
    got = o.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3), PATH).orderBy("start").collect()
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(o, "REMEMBERED", 3)
    pieces, library = o.Pieces(PATH), tokenizers.Tokenizer.from_file(PATH)
    for texts in (["a b c d e", "f g h"], ["x y", "a b"], []):
        ids, n = pieces.encode(pa.array(texts, pa.string()), 0)
        assert ids.tolist() == [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 0]] and len(n) == len(texts)


def test_pieces_of_two_batches_stay_when_memory_is_full(monkeypatch):
    monkeypatch.setattr(o, "REMEMBERED", 20)
    pieces, library = o.Pieces(PATH), tokenizers.Tokenizer.from_file(PATH)
    for texts in (["often one two three four five six", "seven eight nine ten"], ["often übermäßig again. " * 3] + [f"x{i} y" for i in range(10)], ["z often"]):
        ids, _ = pieces.encode(pa.array(texts, pa.string()), 0)
        assert ids.tolist() == [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 0]]
    assert "often" in pieces.index and " seven" not in pieces.index
    merged = []
    monkeypatch.setattr(pieces, "merge", merged.append)
    pieces.find(["often"])
    assert not merged


def test_many_words_are_merged_in_one_call(monkeypatch):
    pieces, library = o.Pieces(PATH), tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(5)
    words = [" " + "".join(rng.choice("abcdeéßñöжя") for _ in range(rng.randint(1, 9))) for _ in range(30_000)]
    words = list(dict.fromkeys(words + [" " + w[1:3] for w in words] + [w[1:] for w in words[:50]]))
    calls = []
    monkeypatch.setattr(pieces, "words", type("Counted", (), {"encode_batch_fast": lambda self, x, words=pieces.words, **k: calls.append(1) or words.encode_batch_fast(x, **k)})())
    at = pieces.find(words)
    want = [x.ids for x in library.encode_batch(words, add_special_tokens=False)]
    assert 0 < len(calls) < 10 and pieces.count[at].tolist() == [len(x) for x in want] and pieces.gather(at).tolist() == [i for x in want for i in x]


def test_a_process_keeps_what_one_operator_needs():
    """Workers live on from stage to stage: what encoding remembers isn't there beside another stage's memory."""
    from aerolith.llm import common

    first = common.kept_in_process("a", lambda: [1])
    assert common.kept_in_process("a", lambda: [2]) is first
    assert common.kept_in_process("b", lambda: [3]) == [3] and list(common._KEPT) == ["b"]
    common.let_go()
    assert not common._KEPT


def test_carries_of_many_blocks():
    out = np.array([5, 0xFFFFFFFF, 0xFFFFFFFF, 7, 1, 2, 0xFFFFFFFF, 9], np.uint32)
    carry(out, np.array([3, 6]))
    assert out.tolist() == [6, 0, 0, 7, 1, 3, 0xFFFFFFFF, 9]


def test_odd_texts_like_the_library():
    rng = random.Random(3)
    bits = ["a", "word", "Ab", "9", "42", ".", ",", "!", "'s", " ", " ", "\n", "\t", "\r\n", "é", "日本", "\u00a0", "\u3000", "²", "🙂", "<|endoftext|>", "\0", "-", "\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    library = tokenizers.Tokenizer.from_file(PATH)
    ids, n = o.Pieces(PATH).encode(pa.array(texts), 0)
    want = [[*x.ids, 0] for x in library.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_lists_are_checked(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "files")
    o.write_token_files(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), path, PATH)
    spark.read.parquet(path).withColumn("n_tokens", F.reverse("n_tokens")).write.parquet(path + "2")
    with pytest.raises(Exception, match="documents of a segment"):
        o.read_documents(spark, path + "2").collect()


def test_empty_table(spark):
    assert o.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def most_traced(f):
    """What f returns, and the most bytes that it had at a time."""
    import tracemalloc

    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_coder_needs_little_beside_ids_and_code():
    ids = np.minimum(np.random.default_rng(4).zipf(1.2, 2_000_000), 50_256).astype(np.uint32)
    (header, blocks), most = most_traced(lambda: encode(ids, 1024))
    assert most < 12 * len(ids) and np.array_equal(decode(header, blocks), ids)


def test_many_blocks_go_in_groups(monkeypatch):
    from aerolith.llm import range_coder

    ids = np.minimum(np.random.default_rng(4).zipf(1.2, 10_000), 50_256).astype(np.uint32)
    want = encode(ids, 130)
    monkeypatch.setattr(range_coder, "LANES", 7)
    assert encode(ids, 130) == want and np.array_equal(decode(*want), ids)
    assert np.array_equal(decode(*want, list(range(len(want[1])))[::-1])[-130:], ids[:130])


def test_ids_of_many_pieces_are_joined_in_little_memory():
    pieces = o.Pieces(PATH)
    at = np.resize(pieces.find([" word", " another", "日本語"]), 1_000_000)
    got, most = most_traced(lambda: pieces.gather(at))
    assert most < got.nbytes + 12 * len(at) and np.array_equal(got[: len(got) // 3], pieces.gather(at[: len(at) // 3])[: len(got) // 3])
