import pytest
from quarry.plans import registry

from oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.SQL[name], SF)


def test_weight_zero_equals_lane_absent(spark):
    from quarry.operators.retrieval import fuse

    one = [(0, "vector", 0, 1.0, k, r) for r, k in enumerate("abc", 1)]
    cols = "query_id int, lane string, lane_no int, weight double, key string, rank int"
    off = [(0, "hyde", 1, 0.0, k, r) for r, k in enumerate("cxa", 1)]
    a = fuse(spark.createDataFrame(one, cols)).select("key", "score", "position").collect()
    assert sorted(a) == sorted(fuse(spark.createDataFrame(one + off, cols)).select("key", "score", "position").collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["wording_leak", "candidate_checks"])
def test_texts_are_cut_once_a_row(spark, name):
    assert "array_contains(split(" not in _plan(registry.QUERIES[name](spark, SF))


def test_ngrams_copy_no_text(spark):
    assert "slice(" not in _plan(registry.QUERIES["snippet_containment"](spark, SF))


@pytest.mark.parametrize("name", ["evidence_location", "evidence_depth", "scored_questions"])
def test_question_set_is_made_once(spark, name):
    assert not any("benchmark" in f for f in registry.QUERIES[name](spark, SF).inputFiles())


def test_locate_short_and_missing_snippets(spark):
    from quarry.operators.evaluation import locate

    docs = spark.createDataFrame([(1, "One, two THREE four five six seven eight nine."), (2, "two three"), (3, None), (4, "twothree")], "doc_id int, text string")
    items = spark.createDataFrame([("a", "two three"), ("b", "one two three four five six seven eight nine"), ("c", "nine"), ("d", "!"), ("e", None), ("f", "two three four five six seven eight ten")], "item_id string, text string")
    assert sorted(map(tuple, locate(docs, items).collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]
    assert locate(docs, items.limit(0)).collect() == [] and locate(docs, items.where("item_id IN ('d', 'e')")).collect() == []


def test_leak_ratio_of_repeats_and_nulls(spark):
    from pyspark.sql import functions as F
    from quarry.operators.evaluation import drop_reason, leak_ratio

    rows = spark.createDataFrame([(1, "red red blue the", "A red car"), (2, "the a", "x"), (3, "red", None), (4, "red", ""), (5, None, "red")], "i int, q string, c string")
    got = {r["i"]: r["x"] for r in rows.select("i", leak_ratio(F.col("q"), F.col("c")).alias("x")).collect()}
    assert got == {1: 2 / 3, 2: 1.0, 3: 0.0, 4: 0.0, 5: None}
    why = spark.createDataFrame([(1, "blue", "Red car", "a red  CAR"), (2, "red car", "red", "a red car"), (3, "blue", "", "a"), (4, "blue", "ed", "red")], "i int, q string, s string, c string")
    assert [r[1] for r in why.select("i", drop_reason(F.col("q"), F.col("s"), F.col("c"))).orderBy("i").collect()] == [None, "wording-leak", "snippet-not-found", "snippet-not-found"]


def test_evidence_depth_equals_every_prefix(spark):
    import random

    from quarry.operators.evaluation import evidence_depth

    rng = random.Random(9)
    passages, questions, want = [], [], {}
    for i in range(150):
        n = rng.randint(1, 9)
        own = sorted((r, c, " ".join(rng.choices("abcd-", k=rng.randint(0, 4)))) for r, c in zip(rng.sample(range(1, 15), n), rng.sample(range(10), n), strict=True))
        snippet = " ".join(rng.choices("abcd", k=rng.randint(1, 6)))
        questions.append((i, "f", snippet))
        passages += [(i, r, "f", c, t) for r, c, t in own] + [(i, 1, "g", 0, snippet)]
        for k in range(1, n + 1):
            runs, have = [], {c: t.replace("-", " ").split() for _, c, t in own[:k]}
            for c in sorted(have):
                if c - 1 in have:
                    runs[-1] += have[c]
                else:
                    runs.append(list(have[c]))
            if any(f" {snippet} " in f" {' '.join(r)} " for r in runs):
                want[i] = own[k - 1][0]
                break
    df = evidence_depth(spark.createDataFrame(passages, "query_id int, rank int, file_path string, chunk_index int, text string"), spark.createDataFrame(questions, "id int, sourceFile string, answerSnippet string"))
    assert {r["id"]: r["depth"] for r in df.collect()} == want
    assert _plan(df).count("Join ") == 1  # no join of a question's passages with its depths
