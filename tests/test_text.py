from datetime import date

from quarry.functions import dates, markdown


def test_dates():
    assert dates.extract_dates("on 2026-02-03, Q3 2025 and 3 March 2024") == [("2026-02-03",) * 2, ("2025-07-01", "2025-09-30"), ("2024-03-03",) * 2]
    assert dates.extract_dates("13/02/2026") == [("2026-02-13",) * 2]
    assert len(dates.extract_dates("03/02/2026")) == 2
    assert dates.extract_dates("03/02/2026", near=date(2026, 1, 1)) == [("2026-02-03",) * 2]
    assert dates.extract_dates("2026-02-30") == [] and dates.extract_dates("may 4", default_year=2020) == []
    assert dates.posted_date("no date", "report_20250102.pdf", date(2020, 1, 1))[0] == "2025-01-02"


def test_question_dates():
    now = date(2026, 11, 26)
    assert dates.question_ranges("last 2 months", now) == [(20261001, 20261126)]
    assert dates.question_ranges("this week", now) == [(20261123, 20261129)]
    assert dates.question_ranges("last quarter", now) == [(20260701, 20260930)]
    assert dates.question_ranges("on 4 May", now, [2024, 2025]) == [(20250504,) * 2, (20240504,) * 2]
    assert dates.question_ranges("sales in FY 2023", now) == [(20230101, 20231231)]
    assert dates.question_ranges("cost $2023", now) == []


def test_markdown():
    assert markdown.infer_structure("Title\n\nSome text that\nwraps here.\n1) one") == "## Title\n\nSome text that wraps here.\n\n1. one"
    assert markdown.linearise_tables("Item | Price\nTea | 3") == "Item | Price\nTea — Price: 3"
    assert markdown.html_to_markdown("<body><nav>x</nav><h1>A</h1><p>b <b>c</b></p><ul><li>d</li><li>e</li></ul><table><tr><td>f</td><td>1</td></tr></table></body>") == "# A\n\nb c\n\n- d\n- e\n\nf | 1"
    assert [p for p, _ in markdown.sections("# A\n\ntext\n\n## B\n\n- item\n\n# C")] == [["A"], ["A", "B"], ["A", "B", "- item"], ["C"]]


def test_structured_chunks_keep_every_word_once():
    import random

    from quarry.operators.chunking import structured_chunks

    rng = random.Random(3)
    for _ in range(50):
        parts = [rng.choice(["# H one", "## H two", "- item one two", "a | 1\nb | 2", " ".join(rng.choices(["word.", "other", "third"], k=rng.randint(1, 90)))]) for _ in range(rng.randint(1, 12))]
        md = "\n\n".join(parts)
        got = structured_chunks(md, 30)
        own = [c["text"].split()[c["start_index"] - c["end_index"] :] for c in got]  # but for a split table's header
        assert [w for x in own for w in x] == md.split()
        assert [c["start_index"] for c in got] == [0, *(c["end_index"] for c in got[:-1])]
        assert all(len(x) <= 30 for x in own)


def test_match_label_rounds_the_binary_value(spark):
    import random

    from pyspark.sql import functions as F
    from quarry.functions.text import match_label

    rng = random.Random(5)
    values = [0.0625, 0.1875, 0.0005, 1.0005, 0.1235, 0.9995, 0.99951, -0.0625, -0.0001, -0.0, 0.0, 1e-300, 4503599627370495.5, 2.0**61, 123456789.0625, float("inf"), float("-inf")]
    values += [k / 16 for k in range(1, 200)] + [k / 10000 for k in range(5, 20000, 10)] + [rng.random() * 10 ** rng.randint(-6, 12) for _ in range(2000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double")
    got = {r["i"]: r["l"] for r in rows.select("i", match_label(F.col("i"), F.array().cast("array<string>"), F.col("v")).alias("l")).collect()}
    assert [got[i] for i in range(len(values))] == [f"score: {v:.3f}" for v in values] and got[len(values)] is None
