import random
import re

import pytest

from aerolith.llm import secret_scan as s

SCHEMA = "doc_id long, text string, source string, candidate string, f_length int"
HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in s.CODE_WORDS], "word string")


def scanned(spark, words, texts, **options):
    rows = [(i, t, "src", "x", 1) for i, t in texts]
    return s.scan(spark.createDataFrame(rows, SCHEMA), dictionary=words, **options).collect()


def test_candidates_and_neighbours(spark):
    rows = spark.createDataFrame([(1, f'set token = "{HEX}"### and x'), (2, f"API_KEY={HEX};z"), (3, "https://example.com/a/b/c.html"), (4, "short words only"), (5, f"{HEX},{HEX}")], "id_ long, text_ string")
    got = {(r.id_, r.place): r for r in s.candidates(rows, "id_").collect()}
    assert {k: r.candidate for k, r in got.items()} == {(1, 3 << 31): HEX, (2, 0): HEX, (3, 0): "https://example.com/a/b/c.html", (5, 0): HEX, (5, 1): HEX}
    assert "token" in got[1, 3 << 31].before and got[1, 3 << 31].after == "and x" and "API_KEY" in got[2, 0].before


def test_many_candidates_in_a_word_have_places_of_their_own(spark):
    word = ",".join(f"{HEX}{i:05d}" for i in range(1500))
    rows = spark.createDataFrame([(1, f"x {word} " + " ".join(f"{HEX}{i:05d}" for i in range(20_000)))], "id_ long, text_ string")
    got = s.candidates(rows, "id_").collect()
    assert len(got) == len({r.place for r in got}) == len({r.candidate for r in got}) + 1500 == 21_500


def test_features_like_plain_python(spark, words):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcXYZ0123456789_+/=.-getTokenUser") for _ in range(rng.randint(16, 60))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t, "tests/a" if i % 2 else "src") for i, t in enumerate(texts)], "id_ long, text_ string, path_ string")
    for r in s.described(s.candidates(rows, "id_", "path_"), words).collect():
        x = r.candidate
        kinds = re.findall("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", x)
        known = sum(len(w) for w in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{3,}", x) if w.lower() in s.CODE_WORDS)
        want = {"f_length": len(x), "f_changes": (len(kinds) - 1) / len(x), "f_digits": sum(c.isdigit() for c in x) / len(x), "f_upper": sum(c.isupper() for c in x) / len(x), "f_lower": sum(c.islower() for c in x) / len(x),
                "f_different": len(set(x)) / min(len(x), 32), "f_longest_letters": max(map(len, re.findall("[a-z]+|[A-Z]+", x)), default=0), "f_slashes": x.count("/"), "f_test_path": r.path_ == "tests/a", "f_dictionary": known / len(x)}
        assert all(abs(r[k] - v) < 1e-9 for k, v in want.items()), (x, want)


def test_forest_tells_secrets_from_other_findings(spark, words):
    secret = [f'of the token = "{HEX}" is', "AKIA" + "Q7X2M9ZK4L8P1R5T", f"api_key: {HEX[:32]}", "client_secret=Zk8vQ2mX9pL4tR7wB1nC6yH3jF5d", "Authorization: Bearer " + "aZ3kQ9vX2mL8pT5wR1nB7yC4jH6d" * 2]
    plain = [f"commit {HEX} of the tree", "https://www.site.com/path/to/page.html", "/usr/local/lib/module/file.py", "getUserSessionConnectionHandler", "password: YOUR_SECRET_KEY_HERE", "-" * 40, "api_key=xxxxxxxxxxxxxxxxxxxxxxxx", "id 123e4567-e89b-42d3-a456-426614174000"]
    got = scanned(spark, words, list(enumerate(secret + plain)))
    found = {r.doc_id for r in got if r.is_secret}
    assert found == set(range(len(secret)))


def test_held_out_findings(spark, words):
    rows = s.labelled_findings(spark, 1500, seed=99).withColumnsRenamed({"secret": "label", "path": "source"}).withColumn("doc_id", s.F.monotonically_increasing_id())
    got = s.scan(rows, dictionary=words).join(rows, "doc_id").selectExpr("avg(cast(is_secret = (label = 1) as int)) right", "avg(case when label = 1 then cast(is_secret as int) end) recall").first()
    assert got["right"] > 0.93 and got["recall"] > 0.93


def test_defined_cases(spark, words):
    long = "w " * 100_000 + f'secret="{HEX}"'
    got = scanned(spark, words, [(1, None), (2, ""), (3, long), (4, f"token={HEX}"), (4, f"token={HEX}"), (None, f"token={HEX}")])
    assert sorted((str(r.doc_id), r.is_secret) for r in got) == [("3", True), ("4", True), ("4", True), ("None", True)]
    assert scanned(spark, words, []) == []


def test_without_labels_of_both_kinds_everything_is_a_secret(spark, words):
    findings = spark.createDataFrame([(f"commit {HEX}", 0)], "text string, secret int")
    assert [r.score for r in scanned(spark, words, [(1, f"commit {HEX}")], findings=findings)] == [1.0]


def test_dictionary_counts_documents(spark):
    texts = spark.createDataFrame([(t,) for t in ["often Seen often", "seen often", None, "seen ab"]], "text_ string").na.fill("")
    got = {r.word for r in s.dictionary_of(texts, 0.7).collect()}
    assert "seen" in got and "often" not in got and "token" in got
