from aerolith.llm.line_dedup import drop_recurring_lines

SCHEMA = "doc_id long, text string, line_hash string, docs int"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in drop_recurring_lines(df, **options).collect()), key=repr)


def test_variable_fields_are_generalised(spark):
    rows = [(i, f"Page {i} printed on May {i + 3}\n{chr(97 + i) * 2} own words of {chr(97 + i) * 3} here\nSent by user {'abcdefgh'[i]}x from the web site") for i in range(8)]
    got = run(spark, rows)
    assert got == sorted([(i, 3, 2, rows[i][1].split("\n")[1]) for i in range(8)], key=repr)


def test_leaves_of_different_lines_stay(spark):
    rows = [(i, f"the of and {' '.join(chr(97 + (i * 7 + k) % 26) * 2 for k in range(9))}") for i in range(10)]
    assert run(spark, rows) == sorted([(i, 1, 0, t) for i, t in rows], key=repr)


def test_two_templates_in_a_leaf(spark):
    names = "anna boris carl dora emil fritz gerda hugo ida jan".split()
    rows = [(i, f"New session opened by {'user' if i < 5 else 'admin'} {n} from the web") for i, n in enumerate(names)]
    assert all(r[1:] == (1, 1, "") for r in run(spark, rows))
    assert all(r[2] == 1 for r in run(spark, rows[:4] + rows[5:9]))  # the word before the name is variable, too
    assert all(r[2] == 0 for r in run(spark, rows[:4]))


def test_sentences_with_a_common_beginning_stay(spark):
    towns = "Rome Paris Oslo Bern Wien Riga Kiel".split()
    rows = [(i, f"the dog went to {t}\nWas he that {t}. Ster.") for i, t in enumerate(towns)]
    assert run(spark, rows) == sorted([(i, 2, 0, t) for i, t in rows], key=repr)


def test_defined_cases(spark):
    long = "\n".join(f"line number one {'q' * k} of its own" for k in range(3000))
    same = "Licensed under the terms\n\n  \nLicensed under the terms"
    rows = [(i, f"{same}\n{chr(97 + i)}") for i in range(5)] + [(0, f"{same}\na")]
    rows += [(10, None), (11, ""), (12, "\n\n"), (13, long), (None, f"{same}\nz"), (None, None), (14, "  Licensed under  the terms  \nx")]
    got = dict((r[0], r[1:]) for r in run(spark, rows) if r[0] is not None)
    assert got[0] == (3, 2, "\n  \na") and got[10] == (0, 0, "") and got[11] == (0, 0, "") and got[12] == (0, 0, "\n\n")
    assert got[13][0] == 3000 and got[14] == (2, 1, "x")
    assert len(run(spark, rows)) == len(rows) and run(spark, []) == []


def test_copies_and_repeats_in_a_document_count_once(spark):
    rows = [(i, "some line of text\nsome line of text") for i in range(6)] + [(2, "some line of text")]
    assert all(r[2] == 0 for r in run(spark, rows, min_docs=3))
    assert all(r[2] > 0 for r in run(spark, rows, min_docs=2))
