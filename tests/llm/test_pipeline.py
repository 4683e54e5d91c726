import hashlib
import math
import re
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from quarry.llm import op4_language, op6_simhash, op9_mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("clash"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    odd = [(None, f"Ein Satz und dann {item} und mehr.", "de", None), (None, "Ein ganz anderer, sauberer Text ohne Tadel.", "de", None), (10**6, None, None, "x"), (10**6 + 1, "", "en", "x"), (10**6 + 2, "1234 5678", None, "x")]
    more = spark.createDataFrame([(i, t, lang, s, 0, "clash") for i, t, lang, s in odd], rows.schema)
    return rows.union(more).cache()


def plain(df):
    return Counter(tuple(r) for r in df.select(*P.COLUMNS).collect())


def test_language_stage(spark, docs):
    got = plain(P.language(spark, docs, SF))
    said = op4_language.predict(docs, op4_language.train(op4_language.sample(docs))).collect()
    assert got == Counter(tuple(r[c] for c in P.COLUMNS) for r in said if not r["rejected"])
    assert not any(t in (None, "", "1234 5678") for _, t, *_ in got)
    clean = [r for r in docs.collect() if r["text"] and len(r["text"]) > 80 and r["lang"]]
    assert sum(got[tuple(r[c] for c in P.COLUMNS)] > 0 for r in clean) >= 0.995 * len(clean)


def test_near_dedup_stage_against_brute_force(spark, docs):
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    sets = [set(op6_simhash.shingles(r["text"], 5).tolist()) for r in rows]
    fps = [op6_simhash.fingerprint(r["text"], 5) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 3 or (common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)):
                a, b = root(i), root(j)
                if rows[a]["doc_id"] > rows[b]["doc_id"]:
                    a, b = b, a
                parent[b] = a
    want = Counter(tuple(rows[i][c] for c in P.COLUMNS) for i in range(len(rows)) if root(i) == i) + Counter(tuple(r[c] for c in P.COLUMNS) for r in docs.collect() if r["doc_id"] is None)
    assert plain(P.near_dedup(spark, docs, SF)) == want and sum(want.values()) < docs.count()


def test_decontaminate_stage_against_brute_force(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))
    want = Counter(tuple(r[c] for c in P.COLUMNS) for r in docs.collect() if not dirty(r["text"]))
    got = plain(P.decontaminate(spark, docs, SF))
    assert got == want and sum(t[0] is None for t in got) == 1


def test_mix_stage(spark, docs):
    have = docs.where("doc_id IS NOT NULL")
    got = plain(P.mix(spark, have, SF))
    times = {r["doc_id"]: r["times"] for r in op9_mix.mix(have).collect()}
    assert got == +Counter({tuple(r[c] for c in P.COLUMNS): times[r["doc_id"]] for r in have.collect()})
    taken, target = Counter(), {}
    for r in op9_mix.mix(have).join(have.select(F.col("doc_id"), "source"), "doc_id").collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]) for s in target if s != "x")


def test_shards_stage(spark, docs):
    def place(key):
        cost = lambda i: -math.log((int(hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1))
        return min(range(24), key=cost)

    rows = P.shards(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    assert all(r["shard"] == place(r["doc_id"]) for r in rows)


def test_whole_pipeline(spark):
    out = P.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "shard", "slot"} <= set(out.columns)
    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "shards"]


def test_empty_table_passes_every_stage(spark, docs):
    none = docs.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0, name
