"""Line dedup by log templates, in DataFrame functions only.

Lines are parsed by a tree of fixed depth, as log messages are. Runs of digits count as equal, and so do runs of white
space. The first level of the tree is the number of tokens, the next levels are the first ``LEADING`` tokens, where any
token with a digit is a variable field. In a leaf, a token that stands at its place in ``min_docs`` documents or more is
constant there; every other is a variable field. A line's template is its constant tokens at their places; a leaf may
have many. The leading tokens, which are equal in a leaf anyhow, are no evidence: a template counts only if ``SAME`` of
the other places are constant, and ``LEAST`` of them at least, so that sentences with a common beginning don't follow one.
Templates that recur in ``min_docs`` documents or more are dropped, that is, all lines that follow them; so are lines
that recur in ``min_docs`` documents by themselves, whatever their length.

Documents of equal text count once, so that copies alone make nothing recur. Texts are told apart by 128 bits, lines and
templates by 64-bit hashes. Only distinct lines of leaves that recur are taken apart into tokens. A very common line is
counted by partial sums, and its rows are dealt over ``SALTS`` when they meet the lines to drop.

Null texts are empty; blank lines stay and are not counted. Repeated rows come back repeatedly. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, null_to_empty, stored

LEADING, SAME, LEAST = 3, (3, 5), 3
SALTS = 16
TEXT = ("t1", "t2")


def masked_lines(text: str = "text_") -> Column:
    """Lines of a text, runs of digits and of white space made equal."""
    masked = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.split(masked, "\n")


def n_tokens(line: str = "line") -> Column:
    return F.length(line) - F.length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1


def leaf_of(line: str = "line") -> Column:
    lead = F.substring_index(line, " ", LEADING)
    return F.xxhash64(n_tokens(line), F.regexp_replace(lead, "[^ ]*0[^ ]*", "<*>"))


def line_templates(rows: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The lines (t1, t2, line_no, leaf, line_hash), and the line_hash of all lines to drop. rows: t1, t2, text_."""
    lines = rows.select(*TEXT, F.posexplode(masked_lines()).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    lines = stored(lines.select(*TEXT, "line_no", n_tokens().alias("length"), leaf_of().alias("leaf"), F.xxhash64("line").alias("line_hash")), "lines")
    docs = lines.select("leaf", "length", "line_hash", *TEXT).distinct().groupBy("leaf", "length", "line_hash").agg(F.count("*").alias("docs"))
    docs = stored(docs, "line-counts")
    whole = docs.where(F.col("docs") >= min_docs).select("line_hash")
    leaves = docs.where(F.col("length") >= LEADING + LEAST).groupBy("leaf").agg(F.sum("docs").alias("in_docs"), F.count("*").alias("variants"))
    leaves = leaves.where((F.col("in_docs") >= min_docs) & (F.col("variants") > 1)).select("leaf")

    # tokens of the distinct lines of these leaves; a leaf has lines of one length only
    texts = rows.select(F.explode(F.array_distinct(masked_lines())).alias("line")).withColumn("line", F.trim("line")).where(n_tokens() >= LEADING + LEAST)
    texts = texts.withColumn("leaf", leaf_of()).join(leaves, "leaf", "left_semi").withColumn("line_hash", F.xxhash64("line")).dropDuplicates(["line_hash"])
    parts = texts.join(docs, ["leaf", "line_hash"]).select("leaf", "line_hash", "docs", "length", F.posexplode(F.split("line", " ")).alias("place", "token")).where(F.col("place") >= LEADING)
    parts = stored(parts, "line-tokens")
    constant = parts.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "place", "token")
    held = parts.join(constant, ["leaf", "place", "token"]).groupBy("leaf", "line_hash", "length").agg(F.count("*").alias("held"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("constants"))
    enough = (F.col("held") >= LEAST) & (F.col("held") * SAME[1] >= (F.col("length") - LEADING) * SAME[0])
    follow = stored(held.where(enough).select("line_hash", F.xxhash64("leaf", "constants").alias("template")), "followers")
    recurring = lines.select("line_hash", *TEXT).join(follow, "line_hash").select("template", *TEXT).distinct().groupBy("template").agg(F.count("*").alias("docs"))
    recurring = recurring.where(F.col("docs") >= min_docs)
    dropped = stored(whole.unionByName(follow.join(recurring, "template").select("line_hash")).distinct(), "dropped-lines")
    for t in (docs, parts, follow):
        discard(t)
    return lines, dropped


def drop_recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5) -> DataFrame:
    """One row per document: id, n_lines (not blank), n_dropped, text (the lines that stay)."""
    rows = docs.select(F.col(id_col).alias("id_"), null_to_empty(text_col).alias("text_"))
    rows = rows.withColumns({"t1": F.xxhash64("text_"), "t2": F.xxhash64("text_", F.lit(1))})
    lines, dropped = line_templates(rows, min_docs)
    dropped = dropped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = lines.withColumn("salt", F.pmod("t1", F.lit(SALTS)).cast("int")).join(dropped, ["line_hash", "salt"])
    gone = met.groupBy(*TEXT).agg(F.collect_set("line_no").alias("gone"))  # no more numbers than the text has lines
    out = rows.join(gone, list(TEXT), "left")
    split, gone = F.split("text_", "\n"), F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    left = F.when(F.size(gone) == 0, F.col("text_")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    n_lines = F.size(F.filter(split, lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    return out.select(F.col("id_").alias(id_col), n_lines.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), left.alias("text"))


def oracle_sql(min_docs: int = 5) -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 k AS (SELECT row_number() OVER () AS t, text FROM (SELECT DISTINCT text FROM d)),
 m AS (SELECT t, string_split(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)) AS parts FROM k),
 l0 AS (SELECT t, trim(unnest(parts), ' ') AS line, generate_subscripts(parts, 1) AS line_no FROM m),
 l AS (SELECT t, line, line_no FROM l0 WHERE line <> ''),
 docs0 AS (SELECT line, count(DISTINCT t) AS docs FROM l GROUP BY line),
 docs AS (SELECT line, docs, string_split(line, ' ') AS tokens, len(string_split(line, ' ')) AS length,
   [CASE WHEN contains(coalesce(string_split(line, ' ')[i], ''), '0') THEN '<*>' ELSE coalesce(string_split(line, ' ')[i], '') END FOR i IN [1, 2, 3]] AS lead FROM docs0),
 leaves AS (SELECT length, lead FROM docs WHERE length >= {LEADING + LEAST} GROUP BY ALL HAVING sum(docs) >= {min_docs} AND count(*) > 1),
 parts0 AS (SELECT line, length, lead, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM docs JOIN leaves USING (length, lead)),
 parts AS (SELECT * FROM parts0 WHERE place > {LEADING}),
 constant AS (SELECT length, lead, place, token FROM parts GROUP BY ALL HAVING sum(docs) >= {min_docs}),
 held AS (SELECT line, length, lead, count(*) AS held, list({{'place': place, 'token': token}} ORDER BY place) AS constants FROM parts JOIN constant USING (length, lead, place, token) GROUP BY line, length, lead),
 follow AS (SELECT line, length, lead, constants FROM held WHERE held >= {LEAST} AND held * {SAME[1]} >= (length - {LEADING}) * {SAME[0]}),
 recurring AS (SELECT length, lead, constants FROM l JOIN follow USING (line) GROUP BY ALL HAVING count(DISTINCT t) >= {min_docs}),
 dropped AS (SELECT line FROM docs WHERE docs >= {min_docs} UNION SELECT line FROM follow JOIN recurring USING (length, lead, constants)),
 gone AS (SELECT k.text, list(line_no) AS gone FROM l JOIN dropped USING (line) JOIN k USING (t) GROUP BY ALL)
SELECT d.doc_id, len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
 CASE WHEN gone IS NULL THEN d.text ELSE coalesce(array_to_string([string_split(d.text, chr(10))[i] FOR i IN generate_series(1, len(string_split(d.text, chr(10)))) IF NOT list_contains(gone, i)], chr(10)), '') END AS text
FROM d LEFT JOIN gone ON d.text = gone.text
"""
