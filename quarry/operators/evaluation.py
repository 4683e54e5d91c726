"""Retrieval evaluation as joins, windows and conditional aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import QUESTION_STOP, contains_normal, normalise, once, words

GRAM, LEAK_LIMIT, MIN_WORDS, ATTEMPTS = 8, 0.7, 40, 2


def locate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the normalised snippet occurs in whole words: equi-join on the snippet's first
    word n-gram, then an exact test, instead of every pair. Snippets of fewer words join on their own length.

    Only n-gram hashes meet; the text joins its own hits afterwards, so it doesn't ride beside each n-gram."""
    want = items.select("item_id", normalise(F.col("text")).alias("s")).where("s <> ''").withColumn("w", F.split("s", " ")).withColumn("n", F.least(F.lit(GRAM), F.size("w")))
    have = docs.select("doc_id", normalise(F.col("text")).alias("t"))
    lengths = sorted(r["n"] for r in want.select("n").distinct().collect())  # at most eight
    # words are taken one by one: in a lambda, slice copies the whole text for every n-gram
    gram = lambda i, n: F.xxhash64(*[F.get("w", i + j) for j in range(n)])
    none = F.array().cast("array<bigint>")
    grams = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: gram(i, n))).otherwise(none)
    want = want.withColumn("g", F.coalesce(F.lit(None).cast("bigint"), *[F.when(F.col("n") == n, gram(F.lit(0), n)) for n in lengths])).select("item_id", "s", "g")
    every = F.flatten(F.array(*map(grams, lengths))) if len(lengths) > 1 else grams(lengths[0]) if lengths else none
    hashes = have.withColumn("w", F.split("t", " ")).select("doc_id", F.explode_outer(every).alias("g"))  # explode would have them made twice, for a filter on their number
    near = hashes.join(want.select("item_id", "g"), "g").select("doc_id", "item_id").distinct()
    pairs = near.join(want.select("item_id", "s"), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    return pairs.where(contains_normal(normalise(F.col("text")), F.col("s"))).select("doc_id", "item_id")


def leak_ratio(question: Column, chunk: Column, stop: list[str] = QUESTION_STOP) -> Column:
    """Share of the question's meaningful words that the chunk has; repeats count, none at all is 1 (FLT-7)."""
    return _share(question, normalise(chunk), stop)


def _share(question: Column, chunk: Column, stop: list[str]) -> Column:
    """leak_ratio of a normalised chunk. Its words are made once a row, not once for every word of the question."""
    words_of = F.filter(F.split(normalise(question), " "), lambda w: (F.length(w) > 1) & ~w.isin(stop))
    repeats = lambda q, both: F.size(F.filter(q, lambda w: F.array_contains(both, w)))
    share = lambda q: once(F.array_intersect(q, F.split(chunk, " ")), lambda both: repeats(q, both)) / F.size(q)
    return once(words_of, lambda q: F.when(F.size(q) == 0, 1.0).otherwise(share(q)))


def is_leak(question: Column, chunk: Column, limit: float = LEAK_LIMIT) -> Column:
    return leak_ratio(question, chunk) > limit


def parsed_answer(raw: Column) -> Column:
    """STRUCT(question, answerSnippet) of a generated answer, trimmed; null unless both are strings with text (FLT-8)."""
    # a string that isn't quoted in the JSON is of another type
    both = F.from_json(raw, "question string, answerSnippet string", {"mode": "PERMISSIVE"})
    is_text = lambda k: raw.rlike(rf'"{k}"\s*:\s*"')
    q, a = F.trim(both["question"]), F.trim(both["answerSnippet"])
    return F.when(is_text("question") & is_text("answerSnippet") & (q != "") & (a != ""), F.struct(q.alias("question"), a.alias("answerSnippet")))


def drop_reason(question: Column, snippet: Column, chunk: Column, limit: float = LEAK_LIMIT) -> Column:
    """Why a candidate is dropped, null if it stays: the snippet is looked for before the wording (FLT-8)."""
    reason = lambda c, s: F.when(~contains_normal(c, s), "snippet-not-found").when(_share(question, c, QUESTION_STOP) > limit, "wording-leak")
    return once(normalise(chunk), lambda c: once(normalise(snippet), lambda s: reason(c, s)))


def question_problems(questions: DataFrame) -> DataFrame:
    """(id, problem) of every broken rule of a question set: text in each field, ids unique (SRC-15)."""
    fields = ["id", "question", "sourceFile", "answerSnippet"]
    blank = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"{c} is empty")) for c in fields]))
    empty = questions.select("id", F.explode(blank).alias("problem"))
    twice = questions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND id IS NOT NULL").select("id", F.lit("id occurs twice").alias("problem"))
    return empty.union(twice)


def file_words(chunks: DataFrame) -> DataFrame:
    """chunks(file_path, chunk_index, start_index, end_index, text) to (file_path, text): every file's normalised words once (WIN-4).

    The words that earlier chunks cover are skipped before normalising, since offsets count raw words."""
    order = Window.partitionBy("file_path").orderBy(F.coalesce("start_index", "chunk_index"), "chunk_index")
    covered = F.max("end_index").over(order.rowsBetween(Window.unboundedPreceding, -1))
    raw = words(F.col("text"))
    skip = F.when(F.col("start_index").isNull() | F.col("covered").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.size(raw), F.col("covered") - F.col("start_index")))).cast("int")
    rows = chunks.withColumn("covered", covered).withColumn("own", normalise(F.array_join(F.slice(raw, skip + 1, F.greatest(F.size(raw), F.lit(1))), " ")))
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("start_index", "chunk_index").alias("at"), "chunk_index", "own")))
    return rows.groupBy("file_path").agg(F.array_join(F.filter(parts["own"], lambda x: x != ""), " ").alias("text"))


def evidence_location(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(id, sourceFile, answerSnippet) to (id, found): whether the snippet stands in the rebuilt file (JOIN-12)."""
    named = chunks.join(questions.select(F.col("sourceFile").alias("file_path")).distinct(), "file_path", "left_semi")
    rows = questions.join(file_words(named), F.col("file_path") == F.col("sourceFile"), "left")
    return rows.select("id", contains_normal(F.coalesce("text", F.lit("")), normalise(F.col("answerSnippet"))).alias("found"))


def evidence_depth(passages: DataFrame, questions: DataFrame) -> DataFrame:
    """passages(query_id, rank, file_path, chunk_index, text), questions(id, sourceFile, answerSnippet) to (id, depth).

    The least number of first passages whose runs hold the evidence (WIN-5). Passages of other files
    add nothing. The evidence stands in some consecutive chunks, and a prefix holds it once it has all
    of them: from every chunk on, as many chunks are tried as the longest snippet can reach."""
    own = passages.join(questions, (F.col("query_id") == F.col("id")) & (F.col("file_path") == F.col("sourceFile")))
    own = own.select("query_id", "rank", "file_path", "chunk_index", F.coalesce(normalise(F.col("text")), F.lit("")).alias("t"), normalise(F.col("answerSnippet")).alias("s")).where("s <> ''")
    n_words = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, " "))).cast("long")
    most = questions.agg(F.max(n_words(normalise(F.col("answerSnippet"))))).first()[0] or 0
    by = ["query_id", "file_path", "s"]
    own = own.groupBy(*by, "chunk_index").agg(F.min(F.struct("rank", "t")).alias("x")).select(*by, "chunk_index", "x.*")
    own = own.withColumn("island", F.col("chunk_index") - F.row_number().over(Window.partitionBy(*by).orderBy("chunk_index")))
    run = Window.partitionBy(*by, "island")
    own = own.withColumn("upto", F.sum(n_words(F.col("t"))).over(run.orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("after", F.lead(F.struct("rank", "t")).over(run.orderBy("chunk_index")))
    near = F.collect_list(F.struct("chunk_index", "rank", "t", "after")).over(run.orderBy("upto").rangeBetween(0, most))
    own = own.withColumn("near", F.array_sort(F.filter(near, lambda x: x["chunk_index"] >= F.col("chunk_index"))))  # chunks without words stand together
    span = F.concat(F.transform("near", lambda x: F.struct(x["rank"].alias("rank"), x["t"].alias("t"))), F.array_compact(F.array(F.get("near", F.size("near") - 1)["after"])))
    rank = own.schema["rank"].dataType
    start = F.struct(F.lit(" ").alias("t"), F.lit(None).cast(rank).alias("top"), F.lit(None).cast(rank).alias("found"))

    def step(a, x):
        t, top = F.concat(a["t"], F.when(x["t"] == "", "").otherwise(F.concat(x["t"], F.lit(" ")))), F.greatest(a["top"], x["rank"])
        return F.struct(t.alias("t"), top.alias("top"), F.coalesce(a["found"], F.when(F.instr(t, F.concat(F.lit(" "), F.col("s"), F.lit(" "))) > 0, top)).alias("found"))

    return own.groupBy(F.col("query_id").alias("id")).agg(F.min(F.aggregate(span, start, step, lambda a: a["found"])).alias("depth")).where("depth IS NOT NULL")


def score_questions(questions: DataFrame, passages: DataFrame, pool: DataFrame, indexed: DataFrame, located: DataFrame) -> DataFrame:
    """One row a question: id, reason (null if scored), scored, hit, right_file, pool_rank, returned (JOIN-13).

    indexed(file_path) has the files of the store, located(id, found) where evidence was looked for."""
    n = passages.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("returned"), F.collect_set("file_path").alias("files"))
    hit = evidence_depth(passages, questions).select("id", F.lit(True).alias("hit"))
    depth = evidence_depth(pool, questions).select("id", F.col("depth").alias("pool_rank"))
    there = indexed.select(F.col("file_path").alias("sourceFile"), F.lit(True).alias("there")).distinct()
    rows = questions.join(there, "sourceFile", "left")
    for t in (n, hit, depth, located):
        rows = rows.join(t, "id", "left")
    reason = F.when(F.col("there").isNull(), "file-not-indexed").when(~F.col("found"), "evidence-not-in-index")
    rows = rows.withColumn("reason", reason)
    scored = F.col("reason").isNull()
    got = scored & F.coalesce("hit", F.lit(False))
    return rows.select("id", "reason", scored.alias("scored"), got.alias("hit"), (scored & F.coalesce(F.array_contains("files", F.col("sourceFile")), F.lit(False))).alias("right_file"), F.when(scored, F.col("pool_rank")).alias("pool_rank"), F.coalesce("returned", F.lit(0)).cast("long").alias("returned"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by, p): the value of the nearest rank, from counts of distinct values, so no task holds a group's rows (AGG-6)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("p"))
    total = F.sum("c").over(Window.partitionBy(*by))
    return counts.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") >= F.ceil(share * F.col("total"))).groupBy(*by).agg(F.min("p").alias("p"))


def metrics(results: DataFrame) -> DataFrame:
    """results(scored, hit, right_file, pool_rank[, reason, returned]) to one row (AGG-7); no scored question gives rates of null."""
    s, hit = F.col("scored"), F.col("hit")
    n, hits, wrong = F.count_if(s), F.count_if(s & hit), F.count_if(s & F.col("right_file") & ~hit)
    rate = lambda c: c / F.nullif(n, F.lit(0))
    pooled = s & F.col("pool_rank").isNotNull()
    extra = []
    if "reason" in results.columns:
        extra = [F.count_if(F.col("reason") == k).alias(k.replace("-", "_")) for k in ("file-not-indexed", "evidence-not-in-index")]
    if "returned" in results.columns:
        extra.append(F.avg(F.when(s, F.col("returned"))).alias("mean_returned"))
    return results.agg(
        n.alias("scored"), F.count_if(~s).alias("unscorable"), hits.alias("hits"), rate(hits).alias("hit_rate"), rate(F.count_if(pooled)).alias("pool_hit_rate"), rate(F.count_if(pooled & ~hit)).alias("filter_loss"),
        rate(wrong).alias("right_file_wrong_passage"), (hits / F.nullif(hits + wrong, F.lit(0))).alias("passage_accuracy"), (hits + wrong).alias("right_file_returned"),
        F.median(F.when(s, F.col("pool_rank"))).alias("median_pool_rank"), F.avg(F.when(s, F.coalesce(1 / F.col("pool_rank"), F.lit(0.0)))).alias("mrr"), *extra,
    )


def latencies(timings: DataFrame) -> DataFrame:
    """timings(stage, ms) of scored questions to (stage, median, p95)."""
    return timings.groupBy("stage").agg(F.median("ms").alias("median")).join(nearest_rank(timings, ["stage"], "ms", 0.95).withColumnRenamed("p", "p95"), "stage")


def round_robin(chunks: DataFrame, seed: int, n: int, min_words: int = 0) -> DataFrame:
    """chunks(file_path, key[, text]): one chunk of each file in turn, files and chunks in seeded order (WIN-6).

    Chunks of fewer than min_words words are left out (FLT-9)."""
    if min_words:
        chunks = chunks.where(F.size(words(F.col("text"))) >= min_words)
    mix = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
    turn = F.row_number().over(Window.partitionBy("file_path").orderBy(mix(F.col("key")), "key"))
    return chunks.withColumn("turn", turn).orderBy("turn", mix(F.col("file_path")), "file_path").limit(n)


def generate_questions(chunks: DataFrame, answer: Callable[[str, int], str], seed: int, n: int, limit: float = LEAK_LIMIT) -> tuple[DataFrame, dict[str, int]]:
    """A question set of at most n rows and the count of the last reasons of what was dropped (AGG-12, ORC-9).

    chunks(file_path, key, text) are sampled in turn; answer(prompt, attempt) is called on the driver, at
    most ATTEMPTS times a chunk, and its answers are checked in one plan an attempt."""
    spark = chunks.sparkSession
    todo = round_robin(chunks, seed, n, MIN_WORDS).select("file_path", "key", "text").collect()  # n rows
    kept, reasons = {}, {}
    for attempt in range(ATTEMPTS):
        raw = [(str(r["key"]), r["file_path"], r["text"], answer(question_prompt(r["text"], attempt), attempt)) for r in todo if str(r["key"]) not in kept]
        if not raw:
            break
        rows = spark.createDataFrame(raw, "key string, sourceFile string, text string, raw string").withColumn("qa", parsed_answer(F.col("raw")))
        reason = F.when(F.col("qa").isNull(), "generation-failed").otherwise(drop_reason(F.col("qa.question"), F.col("qa.answerSnippet"), F.col("text"), limit))
        for r in rows.select("key", "sourceFile", "qa.*", reason.alias("reason")).collect():
            if r["reason"] is None:
                kept[r["key"]] = (r["question"], r["sourceFile"], r["answerSnippet"])
                reasons.pop(r["key"], None)
            else:
                reasons[r["key"]] = r["reason"]
    order = [str(r["key"]) for r in todo if str(r["key"]) in kept]
    counts = {k: list(reasons.values()).count(k) for k in sorted(set(reasons.values()))}
    return spark.createDataFrame([(f"q-{i:03}", *kept[k]) for i, k in enumerate(order, 1)], "id string, question string, sourceFile string, answerSnippet string"), counts


def question_prompt(chunk: str, attempt: int) -> str:
    """What a generator is asked for a chunk; a later attempt says why (TXT-28)."""
    again = "\n\nThe previous answer was rejected. Copy the snippet exactly from the passage, and word the question differently from it." if attempt else ""
    return (
        "Write a test question for a document search system.\n\nPick one specific fact of the passage below and return JSON with\n"
        '- "answerSnippet": one or two sentences copied word for word from the passage that hold the fact;\n'
        '- "question": what a person who has not read the passage would ask to find the fact, in other words than the passage.\n\n'
        f'Passage:\n"""\n{chunk}\n"""{again}'
    )
