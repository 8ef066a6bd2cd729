"""Secret scans with a random forest against false positives, in DataFrame functions and Spark ML only.

Candidates are long runs of the characters of keys (at least ``SHORTEST``), wherever they stand in a text. Each is
described by its length, its kinds of characters and the changes between them, how much of it is words of a dictionary,
whether it looks like a path or address, whether its source's path speaks of tests, and the words beside it. A random
forest trained on labelled findings then says whether it is a secret.

Labelled findings are a table (text, secret, and optionally a path); each of its texts' candidates gets its label.
``labelled_findings`` makes such a table from rules: formats of keys, tokens and passwords on one side; commit ids,
checksums, identifiers, paths, addresses, embedded files, numbers and placeholders on the other. The dictionary is a
table of words; by default those in a share of ``WORD_SHARE`` of the scanned table's documents, and ``CODE_WORDS``.

Null texts have no candidates; repeated rows give their candidates repeatedly; other columns are ignored. If all
findings have one label, or there are none, no forest is fitted and every candidate counts as a secret.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SHORTEST, WORD_SHARE = 16, 0.002
CANDIDATE = f"[A-Za-z0-9_+/=.:%@~-]{{{SHORTEST},}}"
SPACE = r"[\x20\x09-\x0D]+"
CODE_WORDS = (
    "access account action address admin alpha and api app array async auth background base beta blob block body branch browser buffer build bundle button bytes cache call card change check child class click client"
    " code color column com commit common config connection const container content context control copy core count create css current data database date debug default delete demo dev digest display dist doc document"
    " domain edit element email enable end entry env error event example export factory false feature field file filter first font for form format from function get git global group handler hash header height here hidden"
    " home host html http https icon image img import index info init input insert int internal item java javascript json key label language last layout left lib library line link list load local lock login long main"
    " manager map master max media menu message meta method min mobile mode model module mouse name net new next node not null number object off old open option order org output package page param parent password path"
    " php plugin png point position post prefix primary private process product profile project property public query queue read record ref release remote remove request resource response result return right root row"
    " save script search secret select server service session set setting share size source src start state static status stop storage store str stream string style sub submit sync system table tag target template test"
    " text the this thread time title token tool top true type undefined update upload uri url user usr util value version view web width window with word wrapper write www xml your"
).split()
SECRET_WORDS = r"(?i)(secret|token|passw|passwd|pwd|credential|auth|bearer|api.?key|access.?key|private|apikey|_key|signing|licen[cs]e.?key|client.?id)"
PLAIN_WORDS = r"(?i)(commit|sha|md5|checksum|digest|hash|integrity|uuid|guid|revision|etag|fingerprint|merge|parent|blob|tree|version|build|trace|request|session.?name|example|sample|dummy|placeholder|order|invoice|card|phone|isbn|file|path|url|href|src|image|class|font)"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|demo|docs?/)"


def candidates(texts: DataFrame, *keep: str) -> DataFrame:
    """A row for each candidate of each text_: it, its place (number of its word * 2 ** 31 + number in the word), what is
    before it in its word and the words beside it. Only these leave a text, so that the work is linear in its length."""
    # a lambda's variable holds the words, so that they are split once
    def near(words, i, *steps):
        return F.concat_ws(" ", *(F.coalesce(F.substring(F.get(words, i + k), -24 if k < 0 else 1, 24), F.lit("")) for k in steps))

    def described_words(words):
        one = lambda w, i: F.when((F.length(w) >= SHORTEST) & w.rlike(CANDIDATE), F.struct(i.alias("i"), w.alias("word"), near(words, i, -3, -2, -1).alias("before"), near(words, i, 1, 2).alias("after")))
        return F.filter(F.transform(words, one), lambda x: x.isNotNull())

    rows = texts.where(F.col("text_").rlike(CANDIDATE)).select(*keep, F.explode(F.get(F.transform(F.array(F.split("text_", SPACE)), described_words), F.lit(0))).alias("w"))
    both = f"(.{{0,24}}?)({CANDIDATE})"
    parts = F.arrays_zip(F.regexp_extract_all("w.word", F.lit(both), 1).alias("lead"), F.regexp_extract_all("w.word", F.lit(both), 2).alias("found"))
    found = rows.select(*keep, "w.i", "w.before", "w.after", F.posexplode(parts).alias("n", "part")).select("*", "part.*")
    # NAME=value and name:value hold the candidate after the sign; the name goes to the words before it
    cut = r"^([A-Za-z][A-Za-z0-9_.-]*)[=:](?!//)(.{8,})$"
    name, value = F.regexp_extract("found", cut, 1), F.regexp_extract("found", cut, 2)
    trimmed = F.regexp_replace(F.when(name != "", value).otherwise(F.col("found")), r"^[.:%@~=+-]+|[.:%@~-]+$", "")
    place = F.col("i").cast("long") * (1 << 31) + F.col("n")
    inside = (F.col("n") > 0) | (F.col("lead") != "")
    return found.select(*keep, place.alias("place"), trimmed.alias("candidate"), F.concat_ws(" ", "before", "lead", name).alias("before"), "after", inside.cast("int").alias("inside")).where("length(candidate) >= 8")


def runs(pattern: str) -> Column:
    return F.size(F.regexp_extract_all("candidate", F.lit(pattern), 0))


def letters(pattern: str) -> Column:
    """How many characters of the candidate are of a kind."""
    return F.length(F.regexp_replace("candidate", f"[^{pattern}]", ""))


FEATURES = {
    "f_length": lambda: F.length("candidate"),
    "f_changes": lambda: (runs("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+") - 1) / F.length("candidate"),
    "f_inner_changes": lambda: runs("[a-z][A-Z0-9]|[0-9][A-Za-z]|[A-Z]{2}[a-z0-9]") / F.length("candidate"),
    "f_digits": lambda: letters("0-9") / F.length("candidate"),
    "f_upper": lambda: letters("A-Z") / F.length("candidate"),
    "f_lower": lambda: letters("a-z") / F.length("candidate"),
    "f_other": lambda: letters("_+/=.:%@~-") / F.length("candidate"),
    "f_different": lambda: F.size(F.array_distinct(F.split("candidate", ""))) / F.least(F.length("candidate"), F.lit(32)),
    "f_longest_letters": lambda: F.coalesce(F.array_max(F.transform(F.regexp_extract_all("candidate", F.lit("[a-z]+|[A-Z]+"), 0), F.length)), F.lit(0)),
    "f_vowels": lambda: letters("aeiouAEIOU") / F.greatest(letters("A-Za-z"), F.lit(1)),
    "f_hex": lambda: F.col("candidate").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
    "f_uuid": lambda: F.col("candidate").rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").cast("int"),
    "f_known_prefix": lambda: F.col("candidate").rlike("^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk[-_]|pk_|rk_|xox[abprs]-|eyJ|SG\\.|ya29\\.|npm_|pypi-)").cast("int"),
    "f_slashes": lambda: letters("/"),
    "f_dots": lambda: letters("."),
    "f_separators": lambda: letters("_-"),
    "f_address": lambda: F.col("candidate").rlike("(?i)(?:[a-z]+://|www\\.|@[a-z0-9-]+\\.|^/|^\\.{0,2}/|\\.(?:com|org|net|html?|js|css|png|jpe?g|py|json|xml|txt|md|java|go|c)\\b)").cast("int"),
    "f_test_path": lambda: F.coalesce(F.col("path_").rlike(TEST_PATH), F.lit(False)).cast("int"),
    "f_secret_word": lambda: F.col("before").rlike(SECRET_WORDS).cast("int"),
    "f_plain_word": lambda: F.col("before").rlike(PLAIN_WORDS).cast("int"),
    "f_sign_before": lambda: F.col("before").rlike("[=:][\\s\"']*$").cast("int"),
    "f_quote_before": lambda: F.col("before").rlike("[\"'`][A-Za-z_]*$").cast("int"),
    "f_word_after": lambda: F.col("after").rlike("^[a-z]+ ").cast("int"),
    "f_inside": lambda: F.col("inside"),
}


def described(found: DataFrame, dictionary: DataFrame, *key: str) -> DataFrame:
    """Adds the features. key tells rows apart where they differ; the candidate's words are looked up once each."""
    parts = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), 0)).alias("part"))
    parts = parts.select("candidate", F.lower("part").alias("word"))
    covered = parts.join(dictionary, "word", "left_semi").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    out = found.join(covered, "candidate", "left").withColumns({k: f().cast("double") for k, f in FEATURES.items()})
    return out.withColumn("f_dictionary", F.coalesce(F.col("covered"), F.lit(0)) / F.length("candidate")).drop("covered")


def dictionary_of(texts: DataFrame, share: float = WORD_SHARE) -> DataFrame:
    """Words of 3 to 14 small letters that such a share of all documents have, two at least, and CODE_WORDS."""
    min_docs = max(2, math.ceil(share * texts.count()))
    words = texts.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text_"), r"[^a-z]+"), lambda w: F.length(w).between(3, 14)))).alias("word"))
    often = words.groupBy("word").count().where(F.col("count") >= min_docs).select("word")
    return often.unionByName(texts.sparkSession.createDataFrame([(w,) for w in CODE_WORDS], "word string")).distinct()


def labelled_findings(spark: SparkSession, rows: int = 6000, seed: int = 17) -> DataFrame:
    """text, secret (0/1), path: so many findings made from rules, the same for the same seed."""
    h = lambda k: f"sha2(concat('{seed}-{k}-', id), 512)"
    b64 = lambda k, n: f"substring(regexp_replace(base64(unhex({h(k)})), '[+/=]', 'x'), 1, {n})"
    pick = lambda k, *of: f"element_at(array({', '.join(repr(x) for x in of)}), cast(pmod(xxhash64(id, {seed}, '{k}'), {len(of)}) + 1 as int))"
    word = lambda k: pick(k, *CODE_WORDS)
    filler = lambda k: pick(k, "the of and this", "on was that is", "de la que un", "in der die das", "for it be with", "")
    sign, quote = pick("sign", " = ", "=", ": ", " := "), pick("quote", '"', "", '"')
    name = pick("name", "token", "api_key", "secret", "password", "AUTH_TOKEN", "client_secret", "access_token", "apikey", "SECRET_KEY", "passwd", "private_key", "credentials")
    value = lambda v: f"concat({name}, {sign}, {quote}, {v}, {quote})"
    mixed = f"concat({b64('mix', 10)}, {pick('mark', '_', '-', '+', '.')}, {b64('mix2', 12)})"
    secrets = [
        value(f"substring({h('a')}, 1, 40)"), value(f"substring({h('b')}, 1, 40)"), value(f"substring({h('b')}, 1, 32)"), value(f"substring({h('c')}, 1, 64)"), value(b64("d", 40)), value(b64("e", 24)), value(mixed),
        f"concat('AKIA', upper(substring({b64('f', 30)}, 1, 16)))", f"concat({filler('x')}, ' ghp_', {b64('g', 36)})", f"concat('sk_live_', {b64('i', 24)})", f"concat('Authorization: Bearer ', {b64('j', 48)})", f"concat('xoxb-', substring({h('k')}, 1, 12), '-', {b64('k', 24)})",
        f"concat('postgres://user:', {b64('l', 20)}, '@db.internal')",
    ]
    plain = [
        f"concat('commit ', substring({h('m')}, 1, 40))", f"concat('merge of ', substring({h('n')}, 1, 40), ' into main')", f"concat('sha256: ', substring({h('o')}, 1, 64))", f"concat('md5 checksum ', substring({h('p')}, 1, 32))", f"concat('integrity=\"sha512-', base64(unhex({h('q')})), '\"')",
        f"concat('id ', substring({h('r')}, 1, 8), '-', substring({h('r')}, 9, 4), '-4', substring({h('r')}, 13, 3), '-a', substring({h('r')}, 17, 3), '-', substring({h('r')}, 21, 12))",
        f"concat({word('w1')}, initcap({word('w2')}), initcap({word('w3')}), initcap({word('w4')}))", f"concat({word('w1')}, '_', {word('w2')}, '_', {word('w3')}, '_', {word('w4')})", f"upper(concat({word('w1')}, '_', {word('w2')}, '_', {word('w5')}, '_', {word('w3')}))",
        f"concat('/usr/', {word('w1')}, '/', {word('w2')}, '/', {word('w3')}, '.py')", f"concat('https://www.', {word('w1')}, {word('w2')}, '.com/', {word('w3')}, '/', {word('w4')}, '.html')", f"concat({word('w1')}, '.', {word('w2')}, '@', {word('w3')}, '.example.com')",
        f"concat('data:image/png;base64,', base64(unhex({h('s')})))", f"concat({name}, {sign}, 'YOUR_', upper({word('w1')}), '_', upper({word('w2')}), '_HERE')", f"concat({name}, {sign}, repeat({pick('rep', 'x', '*', 'X', '0', 'a')}, 24))", f"repeat({pick('line', '-', '=', '_', '.', '~')}, 32)",
        f"concat({filler('y')}, ' ', substring(regexp_replace({h('t')}, '[a-f]', '7'), 1, 16 + pmod(id, 8)))", f"concat({name}, {sign}, {word('w1')}, '_', {word('w2')}, '.', {word('w3')}, '_', {word('w4')})", f"concat({word('w1')}, {word('w2')}, {word('w3')}, {word('w4')}, {word('w5')})",
        f"concat('version ', pmod(id, 9), '.', pmod(id, 31), '.', pmod(id, 77), '-alpha.', pmod(id * 7, 999983))", f"concat('trace ', substring({h('u')}, 1, 32), ' ', substring({h('u')}, 33, 16))",
        f"concat({name}, {sign}, 'process.env.', upper({word('w1')}), '_', upper({word('w2')}))", f"concat('class=\"', {word('w1')}, '-', {word('w2')}, '--', {word('w3')}, '-', {word('w4')}, '\"')",
    ]
    out = spark.range(rows).withColumn("secret", (F.col("id") % 2).cast("int"))
    kinds = lambda of: f"element_at(array({', '.join(of)}), cast(pmod(id div 2, {len(of)}) + 1 as int))"
    body = F.expr(f"CASE WHEN secret = 1 THEN {kinds(secrets)} ELSE {kinds(plain)} END")
    return out.withColumn("body", body).select(F.concat_ws(" ", F.expr(filler("u")), "body", F.expr(filler("v"))).alias("text"), "secret", F.expr(pick("path", "src/app", "config/prod", "web", "src0", "tests/unit")).alias("path"))


def fit_forest(findings: DataFrame, dictionary: DataFrame, trees: int = 40, depth: int = 9, seed: int = 5):
    """The forest and the assembler of its inputs; None unless there are findings of both labels."""
    path = F.col("path") if "path" in findings.columns else F.lit(None).cast("string")
    texts = findings.where(F.col("secret").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text_"), (F.col("secret") > 0).cast("double").alias("label"), path.alias("path_"))
    columns = [*FEATURES, "f_dictionary"]
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(stored(described(candidates(texts, "label", "path_"), dictionary).select("label", *columns), "findings"))
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3).fit(rows)


def scan(docs: DataFrame, *, findings: DataFrame | None = None, dictionary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, place (word number * 2 ** 31 + number in the word), candidate, score, is_secret."""
    spark = docs.sparkSession
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"), path.alias("path_"))
    dictionary = stored(dictionary.select("word").distinct() if dictionary is not None else dictionary_of(texts), "dictionary")
    forest = fit_forest(labelled_findings(spark) if findings is None else findings, dictionary)
    columns = [*FEATURES, "f_dictionary"]
    found = described(stored(candidates(texts, "id_", "path_"), "candidates"), dictionary)
    if forest is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        scored = forest.transform(VectorAssembler(inputCols=columns, outputCol="features").transform(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("id_").alias(id_col), "place", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
