"""Quality rules: plain counts of each text, and the perplexity of its characters under a language model.

The model is an interpolated modified Kneser-Ney model of order ``ORDER`` over characters, one for each language and one
for all languages together. Spark counts the n-grams of all documents (a task sends partial counts), and works out the
orders' counts, discounts and probabilities by groups and joins, so that the model has all n-grams of all languages and
passes through no single machine. As every text judged has been counted, an n-gram that occurs once is the text's own: above
order 1 the discount of a count of 1 is the whole, so that a text doesn't vouch for itself. ASCII letters, punctuation,
digits and white space have symbols of their own, and so have all characters below U+0F80; others are hashed to these
``2 ** BITS`` symbols. An n-gram and its language make one key of 64 bits.

The entries with the highest counts, ``HEAD`` at most, are sent to all tasks as sorted arrays of hashed keys; what isn't
among them is looked up by a join, exactly, so that the split shows in no result. A document may change its language: a run
of ``RUN`` characters that the model of all languages expects by ``FOREIGN`` a character more than its own language's is in
another one. A document is judged by its other runs; if these are fewer, by the runs in other languages alone, under the
model of all languages, as one of the documents for which that holds. (Gibberish is as unexpected in the one as in the other.)

A language's median log-perplexity comes from all its documents that pass the plain rules. Its band reaches ``width``
spreads to either side; the spread is the median deviation among documents of the language, of a length within the same
power of two (an octave), or the language's typical deviation at that length if that is larger. An octave of fewer than
``ENOUGH`` documents has the spread of the next shorter one that has them, as longer texts deviate no more; and no octave's
spread is above the language's median deviation (raised by the square root of how much shorter than usual it is), so that
neither a lone document nor an octave full of junk sets its own band. A language of fewer documents takes the pooled
deviations of all. A null language, and those beyond the ``LANGUAGES`` with most documents, are one language.

Nulls and texts without words have no counts and fail; ties can't arise; repeated rows count and come back repeatedly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, null_to_empty, ship, small_batches, stored

ORDER, BITS = 3, 12
#: A key has 16 bits for its language; 0 is for null and the rarest, the last one for all languages.
LANGUAGES, ALL = 65_534, 65_535
HEAD = 1 << 21
#: A task sends its counts when it has met so many n-grams.
TASK_GRAMS = 1_000_000
RUN, FOREIGN = 32, 0.1
#: Documents that an octave or a language needs for a spread of its own.
ENOUGH = 30
#: A text has fewer than 2 ** 31 bytes.
MAX_OCTAVE = 31
#: Texts are worked on in parts of about so many bytes; a byte takes some 150 while it is worked on.
BATCH_BYTES = 400_000
SPACE = b" \t\n\r\x0b\x0c"
MARKS = b"#*$%&|<>"


def _symbols() -> np.ndarray:
    """Symbols of the ASCII characters: 0 white space, letters, one for digits, punctuation, one for the others."""
    out, punctuation = np.full(128, 86, np.int64), 54
    for c in range(128):
        if chr(c).isalpha():
            out[c] = (c - 96) if c >= 97 else (c - 64 + 26)
        elif 48 <= c <= 57:
            out[c] = 53
        elif c in SPACE:
            out[c] = 0
        elif 33 <= c <= 126:
            out[c], punctuation = punctuation, punctuation + 1
    return out


ASCII = _symbols()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """An n-gram for each character (before the first come spaces), and the number of characters of each text."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    n = np.array([len(r) >> 2 for r in raw], np.int64)
    code = np.frombuffer(b"".join(raw), np.uint32)
    s = np.where(code < 128, ASCII[np.minimum(code, 127)], 128 + code % np.uint32((1 << BITS) - 128))
    at = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)  # place in the own text
    out = s.copy()
    for back in range(1, ORDER):
        out[back:] |= np.where(at[back:] >= back, s[:-back], 0) << BITS * back
    return out, n


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def language_key(language: np.ndarray | int):
    return np.asarray(language, np.uint64).__lshift__(np.uint64(BITS * ORDER)).view(np.int64)


def languages(docs: DataFrame, lang_col: str) -> DataFrame:
    """lang, slot: a number for each of the languages with most documents. No more rows than LANGUAGES."""
    rows = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    return docs.sparkSession.createDataFrame([(r[0], k + 1) for k, r in enumerate(rows)], "lang string, slot int")


def count_grams(rows: DataFrame) -> DataFrame:
    """key, n over all rows (slot, text_), by language and of all languages."""

    def run(batches):
        held: list = []

        def flush():
            keys, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            keys, at = np.unique(keys, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, n).astype(np.int64))], ["key", "n"])

        let_go()
        for b in small_batches(batches, "text_", BATCH_BYTES):
            g, n = grams(b.column("text_").to_pylist())
            if len(g):
                held.append(np.unique(g | np.repeat(language_key(b.column("slot").to_numpy()), n), return_counts=True))
                if sum(len(k) for k, _ in held) > TASK_GRAMS:
                    yield flush()
        if held:
            yield flush()

    counts = rows.select("slot", "text_").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stored(counts, "grams")
    every = counts.groupBy(F.col("key").bitwiseAND(F.lit((1 << BITS * ORDER) - 1)).bitwiseOR(F.lit(signed(ALL << BITS * ORDER))).alias("key")).agg(F.sum("n").alias("n"))
    return counts.unionByName(every)


def shorter(key: str, k: int) -> Column:
    """The last k symbols of a key, with its language."""
    return F.col(key).bitwiseAND(F.lit(signed((0xFFFF << BITS * ORDER) | ((1 << BITS * k) - 1))))


def discounts(t: DataFrame, order: int) -> DataFrame:
    """lang and the modified Kneser-Ney discounts d1, d2, d3 of counts of 1, 2 and more; whole for 1 above order 1.
    A row for each language, LANGUAGES + 2 at most."""
    n = t.groupBy("lang").agg(*(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
    d = lambda k: F.least(F.greatest(F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.5 * k), F.lit(0.0)), F.lit(float(k)))
    return n.select("lang", (d(1) if order == 1 else F.lit(1.0)).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def fit_model(rows: DataFrame) -> DataFrame:
    """key, n, logp of all n-grams of the rows (slot, text_), as a table."""
    counts = stored(count_grams(rows), "counts")
    # an order's counts are how many different symbols come before it
    of = {ORDER: counts.select("key", F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        of[k] = of[k + 1].groupBy(shorter("key", k).alias("key")).agg(F.count("*").alias("c"))
    lower = None
    for k in range(1, ORDER + 1):
        t = of[k].withColumn("lang", F.shiftrightunsigned("key", BITS * ORDER).cast("int"))
        context = F.struct("lang", F.shiftright(F.col("key").bitwiseAND(F.lit((1 << BITS * ORDER) - 1)), BITS))
        t = t.join(F.broadcast(discounts(t, k)), "lang").withColumns({"d": F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")), "context": F.xxhash64(context) if k > 1 else F.col("lang").cast("long")})
        sums = t.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("free"), F.count("*").alias("types"))
        t = t.join(sums, "context")
        if k == 1:
            below = 1.0 / (F.col("types") + 1)
        else:
            t, below = t.withColumn("suffix", shorter("key", k - 1)).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix"), F.col("below")
        lower = stored(t.select("key", "c", ((F.col("c") - F.col("d") + F.col("free") * below) / F.col("total")).alias("p")), f"order-{k}")
    return lower.select("key", F.col("c").alias("n"), F.log("p").cast("float").alias("logp"))


def mixed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64-bit keys."""
    x = keys.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class HashArrays:
    """Values by key: hashed keys in order, and where those with the same first bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mixed(keys)
        order = np.argsort(h)
        self.hash, self.value = h[order], values[order].astype(np.float32)
        self.bits = max(1, len(h).bit_length())
        self.start = np.searchsorted(self.hash >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        out = np.full(len(keys), np.nan, np.float32)
        x = mixed(keys)
        first = (x >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[first], self.start[first + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.hash[here] == x[left]
            out[left[hit]] = self.value[here[hit]]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < end[left]]
        return out


def split_model(model: DataFrame) -> tuple[HashArrays, DataFrame | None]:
    """The entries with the highest counts, HEAD at most, and the others as a table (key, logp), None if there are none."""
    level = F.floor(8 * F.log2("n")).cast("int")  # a few hundred levels
    sizes = model.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, room = 1 << 30, HEAD
    for r in sizes:
        if r["count"] > room:
            break
        least, room = r.level, room - r["count"]
    got = model.where(level >= least).select("key", "logp").toArrow()  # HEAD rows at most
    head = HashArrays(got.column("key").to_numpy(), got.column("logp").to_numpy())
    whole = sum(r["count"] for r in sizes) == got.num_rows
    return head, None if whole else model.where(level < least).select("key", "logp")


MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def base_counts(texts: list[str], size: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a batch."""
    n_words, n_symbols, n_dup, word_chars, hashes = [], [], [], [], []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        words = raw.split()
        n_words.append(len(words))
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        n_symbols.append(len(raw) - len(raw.translate(None, MARKS)))
        word_chars.append(len(t) - sum(t.count(chr(c)) for c in SPACE))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        n_dup.append(len(lines) - len(set(lines)))
    n = np.array(n_words, np.int64)
    h = np.concatenate([*hashes, np.zeros(0, np.int64)]).view(np.uint64)
    end = np.cumsum(n)
    repeat = np.zeros(len(n), np.int64)
    if len(h) >= size:
        own = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        g = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            x = h[k : k + len(g)] * MIX[k % len(MIX)]
            g = (g ^ x ^ (x >> np.uint64(29))) * MIX[(k + 1) % len(MIX)]
        g ^= own[: len(g)] * MIX[0]
        at = np.flatnonzero(own[: len(g)] == own[size - 1 :])
        order = at[np.argsort(g[at])]
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        step = np.zeros(len(h) + 1, np.int64)
        found = order[twice]
        step[found] += 1
        step -= np.bincount(found + size, minlength=len(step))
        covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
        repeat = covered[end] - covered[end - n]
    return {"n_words": n, "word_chars": np.array(word_chars, np.int64), "n_symbols": np.array(n_symbols, np.int64), "n_dup_lines": np.array(n_dup, np.int64), "n_repeat_words": repeat}


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OPEN = "array<struct<length:int,own:double,every:double,own_keys:array<long>,every_keys:array<long>>>"
PARTS = ("n_own", "own", "n_other", "other")


def measure(rows: DataFrame, head: HashArrays) -> DataFrame:
    """id_, slot, the counts; characters and log-probability of the runs in the own and in another language that the head
    holds whole; and the other runs with what of them the head lacks (rest)."""
    sent = rows.sparkSession.sparkContext.broadcast(head)
    open_type = pa.list_(pa.struct([("length", pa.int32()), ("own", pa.float64()), ("every", pa.float64()), ("own_keys", pa.list_(pa.int64())), ("every_keys", pa.list_(pa.int64()))]))

    def run(batches):
        let_go()
        for b in small_batches(batches, "text_", BATCH_BYTES):
            texts, slot = b.column("text_").to_pylist(), b.column("slot").to_numpy()
            base = base_counts(texts)
            g, n = grams(texts)
            end, runs = np.cumsum(n), -(-n // RUN)
            first = np.repeat(end - n, runs) + RUN * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
            doc = np.repeat(np.arange(len(texts)), runs)
            keys = g | np.repeat(language_key(slot), n), g | language_key(ALL)
            found = [sent.value.find(k) for k in keys]
            lacks = [np.isnan(x) for x in found]
            sums = [np.add.reduceat(np.where(m, 0, x), first, dtype=np.float64) if len(first) else np.zeros(0) for x, m in zip(found, lacks)]
            broken = np.add.reduceat(lacks[0] | lacks[1], first, dtype=np.int64) > 0 if len(first) else np.zeros(0, bool)
            length = np.diff(np.append(first, len(g)))
            other = sums[1] - sums[0] > FOREIGN * length
            parts = [np.bincount(doc[m], x[m], len(texts)).astype(float) for m, s in ((~broken & ~other, sums[0]), (~broken & other, sums[1])) for x in (length, s)]
            rest: list = [[] for _ in texts]
            for r in np.flatnonzero(broken).tolist():
                part = slice(first[r], first[r + 1] if r + 1 < len(first) else len(g))
                rest[doc[r]].append({"length": length[r], "own": sums[0][r], "every": sums[1][r], "own_keys": keys[0][part][lacks[0][part]].tolist(), "every_keys": keys[1][part][lacks[1][part]].tolist()})
            yield pa.RecordBatch.from_arrays([b.column("id_"), b.column("slot"), *(pa.array(base[k]) for k in MEASURES), *map(pa.array, parts), pa.array(rest, open_type)], ["id_", "slot", *MEASURES, *PARTS, "rest"])

    kind = rows.schema["id_"].dataType.simpleString()
    return rows.mapInArrow(run, f"id_ {kind}, slot int, {', '.join(f'{k} long' for k in MEASURES)}, {', '.join(f'{k} double' for k in PARTS)}, rest {OPEN}")


def completed(found: DataFrame, tail: DataFrame) -> DataFrame:
    """Adds to the scores what the tail says of the runs that the head lacked a part of. Rows have a number (row_)."""
    runs = found.select("row_", F.posexplode("rest").alias("run", "r")).select("row_", "run", "r.*")
    tagged = lambda keys, own: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(own).alias("is_own")))
    keys = F.concat(tagged("own_keys", True), tagged("every_keys", False))
    parts = runs.select("row_", "run", F.explode(keys).alias("k")).select("row_", "run", "k.*").join(tail, "key")
    parts = parts.groupBy("row_", "run").agg(F.sum(F.when(F.col("is_own"), F.col("logp"))).alias("a"), F.sum(F.when(~F.col("is_own"), F.col("logp"))).alias("b"))
    runs = runs.join(parts, ["row_", "run"], "left").select("row_", "length", (F.col("own") + F.coalesce("a", F.lit(0.0))).alias("own"), (F.col("every") + F.coalesce("b", F.lit(0.0))).alias("every"))
    other = F.col("every") - F.col("own") > FOREIGN * F.col("length")
    more = runs.groupBy("row_").agg(*(F.sum(F.when(m, F.col(c)).otherwise(0.0)).alias(f"more_{k}") for k, m, c in zip(PARTS, (~other, ~other, other, other), ("length", "own", "length", "every"))))
    return found.join(more, "row_", "left").select(*(c for c in found.columns if c not in PARTS), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0))).alias(c) for c in PARTS))


def median(x):
    """Median of positive values to four digits: exact counts of boundedly many values, the same in whatever order rows come."""
    return F.percentile(F.exp(F.round(F.log(F.greatest(x, F.lit(1e-9))), 4)), 0.5)


def spreads(near: list, typical: dict) -> list[tuple]:
    """own, octave, near, scale for all octaves of each language. near: rows own, octave, docs, near. typical: rows docs,
    near, length, scale by own, and of all documents by None."""
    by = {(r.own, r.octave): r for r in near}
    out = []
    for own in {r.own for r in near}:
        of = typical[own] if typical[own].docs >= ENOUGH else typical[None]
        usual, last = int(np.log2(max(of.length, 1.0))), None
        for octave in range(MAX_OCTAVE + 1):
            most = of.near * 2 ** (max(0, usual - octave) / 2)
            here = by.get((own, octave))
            if here is not None and here.docs >= ENOUGH:
                last = min(here.near, most)
            out.append((own, octave, float(most if last is None else min(last, most)), float(of.scale)))
    return out


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 10, max_repeat_percent: int = 20, width: float = 6.0) -> DataFrame:
    """One row per document: id, the counts, base_failed, perplexity, its band (lower, upper) and kept."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(lang_col).cast("string").alias("lang"), null_to_empty(text_col).alias("text_"))
    rows = rows.join(F.broadcast(languages(docs, lang_col)), "lang", "left").select("id_", F.coalesce("slot", F.lit(0)).alias("slot"), "text_")
    head, tail = split_model(fit_model(rows))
    found = measure(rows, head).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    if tail is not None:
        found = completed(stored(found.withColumn("row_", F.monotonically_increasing_id()), "open"), tail).drop("row_")
    by_own = F.col("n_own") >= F.col("n_other")
    found = found.withColumns({"n": F.greatest("n_own", "n_other"), "log": F.when(by_own, F.col("own")).otherwise(F.col("other")), "slot": F.when(by_own, F.col("slot")).otherwise(ALL)})
    found = stored(found.withColumn("log_ppl", F.when(F.col("n") > 0, -F.col("log") / F.col("n"))).drop("rest", "log", *PARTS), "quality")
    good = found.where(~F.col("base_failed") & (F.col("n") > 0))
    middles = good.groupBy("slot").agg(median(F.col("log_ppl")).alias("expected"))  # a row for each language
    found = stored(found.join(F.broadcast(middles), "slot", "left").withColumn("octave", F.floor(F.log2(F.greatest("n", F.lit(1.0)))).cast("int")), "expected")
    off = F.abs(F.col("log_ppl") - F.col("expected"))
    good = found.where(~F.col("base_failed") & (F.col("n") > 0)).withColumn("own", F.col("slot"))
    # no more rows than languages times octaves of a length
    near = good.groupBy("own", "octave").agg(F.count("*").alias("docs"), median(off).alias("near")).collect()
    # grouped by all languages and, once more, by none: own is null in the pooled row, and in no other
    typical = {r.own: r for r in good.rollup("own").agg(F.count("*").alias("docs"), median(off).alias("near"), median(F.col("n")).alias("length"), median(off * F.sqrt("n")).alias("scale")).collect()}
    octaves = spark.createDataFrame(spreads(near, typical), "slot int, octave int, near double, scale double")
    out = found.join(F.broadcast(octaves), ["slot", "octave"], "left")
    reach = width * F.greatest("near", F.col("scale") / F.sqrt(F.greatest("n", F.lit(1.0))))
    out = out.withColumns({"lo": F.col("expected") - reach, "hi": F.col("expected") + reach})
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lo"), F.col("hi")), F.lit(True))
    return out.select(F.col("id_").alias(id_col), *MEASURES, "base_failed", F.exp("log_ppl").alias("perplexity"), F.exp("lo").alias("lower"), F.exp("hi").alias("upper"), kept.alias("kept"))
