import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from quarry import jobs
from quarry.functions import dates, prompts
from quarry.operators import chunking, evaluation, indexing, retrieval
from quarry.settings import FIXED_DEFAULTS, advanced_number, as_applied, evaluation_settings, indexing_settings, resolve, resource_problems
from quarry.sources import questions
from quarry.store import ChunkStore, RunLock
from quarry.streaming.ingest import ingest


@pytest.fixture
def settings():
    from dataclasses import replace

    return replace(FIXED_DEFAULTS, chunk_size=40, retrieval_threshold=0.05, model="hash")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# Tea\n\nTea was bought on 2024-05-04 for three coins.\n\n## Cups\n\nCups are kept in the blue cupboard of the kitchen.")
    (root / "sub" / "b.txt").write_text("Coffee\n\nCoffee beans are roasted in the morning by the baker.")
    (root / "skip.md").write_text("not this")
    (root / "empty.html").write_text("<body></body>")
    return root


def test_index_ask_evaluate(spark, folder, tmp_path, settings):
    from dataclasses import replace

    settings = replace(settings, exclude=("skip.md",))
    out = str(tmp_path / "store")
    one = jobs.index(spark, str(folder), out, settings)
    assert (one["new_files"], one["failed"], one["excluded"], one["deleted"]) == (2, 1, 1, 0) and one["reasons"] == {"html.empty": 1}
    store = ChunkStore(spark, out)
    stats = store.stats().first()
    assert stats["unique_files"] == 2 and stats["total_chunks"] >= 2 and store.manifest()["dimensions"] == 64
    assert store.catalog().where("day = 20240504").count() >= 1
    two = jobs.index(spark, str(folder), out, settings)
    assert (two["skipped"], two["new_files"], two["updated"], two["failed"]) == (2, 0, 0, 1)
    (folder / "a.md").write_text("# Tea\n\nTea is sold out.")
    (folder / "sub" / "b.txt").unlink()
    three = jobs.index(spark, str(folder), out, settings)
    assert (three["updated"], three["deleted"]) == (1, 1) and three["deleted_paths"][0].endswith("b.txt")
    assert "coins" not in " ".join(r["text"] for r in store.chunks().collect()) and store.chunks().select("file_path").distinct().count() == 1
    assert json.loads((tmp_path / "store" / "failure-report.json").read_text())["reasons"] == {"html.empty": 1}
    store.vacuum()
    assert store.chunks().count() >= 1
    q = spark.createDataFrame([("q-1", "Is Tea sold out?", "a.md", "Tea is sold out"), ("q-2", "where?", "gone.md", "x"), ("q-3", "cups?", "a.md", "blue cupboard")], "id string, question string, sourceFile string, answerSnippet string")
    report = jobs.run_evaluation(store, q, str(folder), settings, today=date(2026, 1, 1))
    assert [(r["id"], r["reason"], r["hit"]) for r in report["questions"]] == [("q-1", None, True), ("q-2", "file-not-indexed", False), ("q-3", "evidence-not-in-index", False)]
    assert report["metrics"]["hit_rate"] == 1.0 and "Final hit rate" in jobs.metrics_table(report["metrics"])
    with pytest.raises(ValueError, match="built with hash"):
        jobs.ask(store, q.select(F.col("id").alias("query_id"), "question"), replace(settings, model="other"))
    assert store.plan_format(True, "hash") == ("structured-1", False) and store.plan_format(False, "hash")[1]
    assert store.format_message(True) is None and "standard" in store.format_message(False)
    jobs.reindex_file(spark, str(folder), "a.md", out, settings)
    assert store.has_file(store.inventory().first()["file_hash"]) and not store.has_file("none")
    store.delete_hashes(store.inventory().select("file_hash"))
    assert store.chunks().count() == 0 and store.check_model("other", 3) is None and store.manifest() is None


def test_store_writes_only_touched_buckets(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=8)
    rows = spark.range(40).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("f"), F.col("id") % 10).alias("file_path"), F.concat(F.lit("h"), F.col("id") % 10).alias("file_hash"), F.lit(0).alias("chunk_index"), F.lit("t").alias("text"))
    store.upsert(rows)
    before = store._state()
    store.upsert(rows.where("file_path = 'f3'").limit(1))
    after = store._state()
    assert store.chunks().count() == 37 and sum(before[b] != after[b] for b in before) == 1
    store.delete_hashes(spark.createDataFrame([("h1",), ("zz",)], "file_hash string"))
    assert store.chunks().count() == 33 and store.listed().columns.count("vector") == 0
    with RunLock(), pytest.raises(RuntimeError):
        RunLock().__enter__()


def test_streaming_ingestion_reads_each_file_once(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    (src / "a.txt").write_text("one two three")
    ingest(spark, str(src), out, ckpt, 2, 0).awaitTermination()
    (src / "b.txt").write_text("four")
    ingest(spark, str(src), out, ckpt, 2, 0).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["four", "one two", "three"]


def test_dates_as_written():
    iso = lambda text, **k: dates.extract_dates(text, **k)
    for text in ("2026/2/3", "2026-2-3", "on 2026-02-03,"):
        assert iso(text) == [("2026-02-03",) * 2]
    assert iso("3-Mar-24") == [("2024-03-03",) * 2] and iso("3-Mar-75") == [("1975-03-03",) * 2]
    assert iso("v1.2026-02-03 2026-02-031 $3/4/2024 3/4/2024%") == [] and iso("costs 5 may rise", default_year=2020) == []
    assert iso("May 5", default_year=2020) == [("2020-05-05",) * 2] and iso("q3 2025") == [("2025-07-01", "2025-09-30")]
    now = date(2026, 11, 26)
    assert dates.question_ranges("01/12/2026", now) == [(20261201, 20261201)]
    assert dates.question_ranges("what on 4 May?", now) == [(20260504, 20260504)]
    assert dates.question_ranges("on May 31", now, [2023, 2024]) == [(20240531, 20240531), (20230531, 20230531)]
    assert dates.question_ranges("version 2021 of FY2023 and 2022 dollars", now) == [(20230101, 20231231)]


def test_chunks_by_budget_and_headers():
    md = "# A\n\n## B on 3 March 2024\n\nSome text here.\n\n## C\n\nMore words follow now.\n\n" + "\n".join(["Item | Price"] + [f"Thing {i} | {i}" for i in range(30)])
    got = chunking.structured_chunks(md, 40, "f.md", ("2024-01-01", "2024-01-01"))
    assert got[0]["context_header"].startswith("[File: f.md | Posted: 2024-01-01 | Section: A > B on 3 March 2024") and "2024-03-03" in got[0]["context_header"]
    tables = [c for c in got if "Thing" in c["text"]]
    assert len(tables) > 1 and all(c["text"].split("\n")[0] == "Item | Price" or "Item | Price" in c["text"] for c in tables)
    assert [c["start_index"] for c in got] == [0, *(c["end_index"] for c in got[:-1])]
    half = chunking.structured_chunks(md, 40, count_tokens=lambda t: 2 * len(t.split()))
    assert len(half) > len(chunking.structured_chunks(md, 40))
    assert chunking.structured_chunks("") == []


def test_questions_and_prompts(spark, tmp_path):
    path = tmp_path / "q.json"
    good = {"version": 1, "questions": [{"id": "a", "question": "q", "sourceFile": "f", "answerSnippet": "s"}]}
    path.write_text(json.dumps(good))
    assert questions.load_question_set(spark, str(path)).count() == 1
    for bad in ({"version": 2, "questions": []}, {"version": 1}, {"version": 1, "questions": good["questions"] * 2}, {"version": 1, "questions": [{"id": "a", "question": " "}]}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            questions.load_question_set(spark, str(path))
    assert prompts.normalise_template(" ").count("{{") == 2 and prompts.normalise_template("x") == "{{rag_context}}\n\nx\n\nUser Query:\n\n{{user_query}}"
    assert prompts.draft_for("q", lambda p: " draft ") == "draft" and prompts.draft_for(" ", str) is None and prompts.draft_for("q", lambda p: 1 / 0) is None
    chunks = spark.createDataFrame([("f", k, f"word{k} " * 50 + "the fact is here") for k in range(4)] + [("g", 9, "short")], "file_path string, key int, text string")
    answers = lambda prompt, attempt: json.dumps({"question": "Which colour?" if attempt or "word2" in prompt else "fact here", "answerSnippet": "the fact is here" if "word3" not in prompt else "no such thing"})
    rows, dropped = evaluation.generate_questions(chunks, answers, 42, 10)
    assert rows.count() == 3 and [r["id"] for r in rows.collect()] == ["q-001", "q-002", "q-003"] and dropped == {"snippet-not-found": 1}


def test_settings():
    assert resolve({"retrieval_limit": 9}).retrieval_limit == 5 and resolve({"retrieval_limit": 9, "advanced": True, "depth": "high", "exclude": "a\n#b"}).exclude == ("a",)
    assert advanced_number(99, "retrieval_limit") == 5 and advanced_number(7.0, "retrieval_limit") == 7 and advanced_number("7", "bm25_k1") == 1.2
    assert evaluation_settings({"QUARRY_CHUNK_SIZE": "256"}).chunk_size == 256
    for env in ({"QUARRY_CHUNK_SIZE": "1"}, {"QUARRY_WEIGHT_DATE": "-1"}, {"QUARRY_RETRIEVAL_DEPTH": "x"}, {"QUARRY_BM25_K1": "a"}, {"QUARRY_RETRIEVAL_LIMIT": "2.5"}):
        with pytest.raises(ValueError):
            evaluation_settings(env)
    assert indexing_settings({"QUARRY_ENABLE_OCR": "yes", "QUARRY_CHUNK_SIZE": "7"}).chunk_size == 7 and not indexing_settings({"QUARRY_ENABLE_OCR": "yes"}).enable_ocr
    low = as_applied(resolve({"depth": "low"}))
    assert (low.weight_keyword, low.weight_hyde, low.neighbour_chunks) == (0, 0, 0)
    assert [x[0] for x in resource_problems(0.5, 1.0)] == ["error", "warning"] and [x[0] for x in resource_problems(5, 0.2, True)] == ["warning", "warning"]


def test_neighbours_inherit_and_stay_with_candidates(spark):
    winners = spark.createDataFrame([(1, 1, "f", 3, 0.9), (1, 2, "f", 5, 0.5)], "query_id int, winner_rank int, file_path string, chunk_index int, score double")
    candidates = spark.createDataFrame([(1, "f", 4), (1, "f", 3), (1, "f", 5), (2, "f", 2)], "query_id int, file_path string, chunk_index int")
    got = retrieval.neighbours(winners, candidates).orderBy("position").collect()
    assert [(r["chunk_index"], r["score"], r["position"]) for r in got] == [(3, 0.9, 1), (4, 0.9, 2), (5, 0.5, 3)]


def test_vector_topk_ties_nulls_and_blocks(spark, monkeypatch):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(50)] + [(60, None), (61, [0.0, 0.0]), (None, [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "key long, vector array<double>").repartition(3)
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, -1.0]), ("n", None)], "query_id string, vector array<double>")
    for pack, most in ((1024, 1 << 20), (4, 0)):
        monkeypatch.setattr(retrieval, "PACK", pack)
        monkeypatch.setattr(retrieval, "MAX_BROADCAST_BYTES", most)
        got = sorted((r["query_id"], r["rank"], r["key"], r["score"]) for r in retrieval.vector_topk(chunks, q, 3, 0.6).collect())
        assert got == [("a", 1, 1, 1.0), ("a", 2, 3, 1.0), ("a", 3, 5, 1.0)]
    assert indexing.changed(spark.createDataFrame([(0, 1, 0)], "updated int, new_files int, deleted int")).first()[0]


def test_report_and_commands(spark, folder, tmp_path, capsys):
    from quarry import cli, report

    docs = spark.createDataFrame([(1, "# A\n\n## B\n\n#### C\n\na | 1\nb | 2\n\nText.\n\nalone | x\n\n" + "word " * 60), (2, None), (3, "")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in report.structure_report(docs, 40, 10).collect()}
    assert tuple(rows[1][c] for c in report.COUNTS) == (1, 1, 1, 1, 2, 1) and rows[1]["legacy_chunks"] >= 2 and rows[1]["structured_chunks"] >= 2
    assert rows[2]["legacy_chunks"] == rows[3]["structured_chunks"] == 0
    total = report.totals(report.structure_report(docs, 40, 10)).first()
    assert total["documents"] == 3 and total["fill_percent"] > 0
    cli.main(["report", str(folder)])
    assert json.loads(capsys.readouterr().out)["failed"] == 1
    assert not cli.path_ignored(str(tmp_path / "q.json"))


def test_drafts_are_kept_by_model_and_id(spark, tmp_path):
    from quarry.sources.drafts import drafts_name, with_drafts
    from quarry.store import JsonFiles

    files, name = JsonFiles(str(tmp_path)), drafts_name("q.json", "a/b model")
    q = spark.createDataFrame([("1", "one"), ("2", "zwei"), ("3", " ")], "id string, question string")
    asked = []
    answer = lambda prompt: asked.append(prompt) or ("" if "zwei" in prompt else "draft")
    rows, counts = with_drafts(q, files, name, "m", answer)
    assert name == "q.drafts.a-b-model.json" and counts == {"hits": 0, "misses": 3}
    assert {r["id"]: r["draft"] for r in rows.collect()} == {"1": "draft", "2": None, "3": None}
    assert with_drafts(q, files, name, "m", answer)[1] == {"hits": 1, "misses": 2}
    assert with_drafts(q, files, name, "other", answer)[1]["hits"] == 0 and with_drafts(q, files, name, "m", answer, regenerate=True)[1]["hits"] == 0


def test_a_boost_that_has_no_plan_is_left_out(spark):
    from quarry.operators.retrieve import Options, retrieve

    chunks = spark.createDataFrame([(1, "f", 0, "tea cups", [1.0, 0.0])], "key long, file_path string, chunk_index int, text string, vector array<double>")
    q = spark.createDataFrame([(7, "tea", [1.0, 0.1])], "query_id long, question string, vector array<double>")
    broken = spark.createDataFrame([(1,)], "nothing int")
    with pytest.warns(UserWarning, match="left out"):
        rows = retrieve(chunks, q, Options(), broken, broken).collect()
    assert [(r["key"], r["lanes"]) for r in rows] == [(1, ["vector", "keyword"])]


def test_best_chunks_of_a_block_stay_few():
    import numpy as np

    rng = np.random.default_rng(3)
    chunks, q = rng.integers(-2, 3, (3000, 3)).astype(float), rng.integers(-2, 3, (5, 3)) + 0.5
    best = retrieval.Best(q, 4, 1.0)
    keys = rng.permutation(3000)
    for i in range(0, 3000, 100):
        best.add(keys[i : i + 100], chunks[i : i + 100])
        assert best.fresh <= 2 * 4 * len(q) and sum(len(x) for x, _, _ in best.parts) <= 3 * 4 * len(q)
    i, s, k = best.kept()
    want = [sorted((-round(float(a @ b), 12), key) for b, key in zip(chunks, keys.tolist(), strict=True) if a @ b >= 1)[:4] for a in q]
    assert [[(-float(x), int(y)) for n, x, y in zip(i, s, k, strict=True) if n == at] for at in range(len(q))] == want


def test_vector_topk_of_many_parts(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 4))
    chunks = spark.createDataFrame([(f"k{i:03}", x.tolist()) for i, x in enumerate(v)], "key string, vector array<double>")
    q = chunks.where("key < 'k020'").selectExpr("key AS query_id", "CAST(vector AS array<float>) AS vector")
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 6)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    query = v[:20].astype(np.float32).astype(float)
    scores = np.round(query / np.linalg.norm(query, axis=1, keepdims=True) @ unit.T, 12)
    want = {(f"k{i:03}", f"k{k:03}") for i in range(20) for k in np.lexsort((np.arange(400), -scores[i]))[:7] if scores[i, k] >= 0.1}
    rows = retrieval.vector_topk(chunks, q, 7, 0.1).collect()
    assert {(r["query_id"], r["key"]) for r in rows} == want and len(rows) == len(want)


def test_dated_boost_lists_candidates_only(spark, monkeypatch):
    from quarry.operators import retrieve

    chunks = spark.createDataFrame([(i, f"f{i // 4}", i % 4, f"text {i}", [1.0, i / 10]) for i in range(40)], "key int, file_path string, chunk_index int, text string, vector array<double>")
    q = spark.createDataFrame([(1, "text 3", [1.0, 0.0]), (2, None, [0.0, 1.0])], "query_id int, question string, vector array<double>")
    days = chunks.selectExpr("key", "20240101 + key % 2 AS day")
    ranges = spark.createDataFrame([(1, 20240101, 20240101), (2, 20240101, 20240102), (2, 20240102, 20240103)], "query_id int, start_day int, end_day int")
    seen, of = [], retrieve.boosts

    def spy(lanes, chunks, questions, dated, o):
        seen.append((dated.count(), lanes.count()))
        return of(lanes, chunks, questions, dated, o)

    monkeypatch.setattr(retrieve, "boosts", spy)
    o = retrieve.Options(limit=3, threshold=0.0, candidates=8)
    rows = retrieve.retrieve(chunks, q, o, ranges, days).collect()
    retrieve.diagnostic_pool(chunks, q, 8, o, ranges, days).collect()
    assert seen == [(4 + 8, 16)] * 2  # the chunks that have a day in a range are 60
    assert {(r["query_id"], r["key"]) for r in rows if "date" in r["lanes"]} >= {(1, 0), (2, 39)} and all(r["text"] == f"text {r['key']}" for r in rows)


def test_chunks_are_made_for_few_documents_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", "# A 3 May 2024\n\n" + "word other. " * (i % 5 * 30) if i % 6 else None) for i in range(40)], "doc_id string, text string").coalesce(1)
    whole = sorted(map(tuple, chunking.chunk_documents(docs, 40).collect()))
    assert len(whole) > 40 and {r[0] for r in whole} == {f"d{i}" for i in range(40) if i % 6}
    monkeypatch.setattr(chunking, "BATCH", 3)
    assert sorted(map(tuple, chunking.chunk_documents(docs, 40).collect())) == whole


def test_no_date_rule_reads_a_text_without_digits(monkeypatch):
    from quarry.functions import dates

    for rule in ("_ISO", "_NUMERIC", "_QUARTER", "_DAY_MONTH", "_MONTH_DAY", "_MONTH_YEAR"):
        monkeypatch.setattr(dates, rule, None)
    assert dates.extract_dates("In May, or the third of march: ٣ May") == [] and dates.day_month_order("none") is None
