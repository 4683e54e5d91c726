import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import op4_language, op5_pii, op7_shards, op9_mix, op10_decon

from oracle import same

SF, BIG = "/root/testdata/sf0.001", 2**53


def test_decon_sql(spark):
    same(op10_decon.op10_decon(spark, SF), op10_decon.SQL, SF)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_decon_rows_that_share_an_id(spark, monkeypatch, limit):
    monkeypatch.setattr(op10_decon, "MAX_BROADCAST_BYTES", limit)
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(None, f"x {item} y"), (None, "a clean text"), (BIG + 1, f"{item} {item}"), (BIG + 1, "one two three"), (3, None), (4, "Solo!"), (4, "Solo!"), (5, "z " * 30_000 + item)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, toks string, row int")
    bench = spark.createDataFrame([("b", item), ("a", item), ("s", "solo"), (None, "three"), ("n", None), ("e", " ")], "item_id string, text string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in op10_decon.decontaminate(df, bench).collect()))
    assert got == sorted([(0, 14, 12, 2, True), (0, 3, 0, 0, False), (BIG + 1, 24, 24, 2, True), (BIG + 1, 3, 1, 0, True), (3, 0, 0, 0, False), (4, 1, 1, 1, True), (4, 1, 1, 1, True), (5, 30_012, 12, 2, True)])
    assert op10_decon.decontaminate(df.limit(0), bench).count() == 0
    assert op10_decon.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0


def test_proximity_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [rng.choices(vocabulary, k=rng.choice([4, 20, 37, 60])) for _ in range(12)]
    docs = [rng.choices(vocabulary, k=rng.randint(0, 120)) for _ in range(40)]
    for d in docs[:15]:  # a passage with words replaced, put in or in another order
        part = list(rng.choice(items))
        for i in range(0, len(part), 5):
            part[i] = "new"
        d[10:10] = part if rng.random() < 0.7 else sorted(part)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{i}", " ".join(w)) for i, w in enumerate(items)], "item_id string, text string")
    count = Counter(w for d in docs for w in d)
    want = set()
    for k, item in enumerate(items):
        for s in range(0, max(len(item) - 20 + 9, 0) + 1, 10):
            rare = {w for n, w in sorted({(count[w], w) for w in item[s : s + 20]})[:8] if True}
            if len(rare) < 5:
                continue
            for i, d in enumerate(docs):
                for p, w in enumerate(d):
                    near = {x for x in d[p : p + 30] if x in rare}
                    if w in rare and len(near) >= 5:
                        want.add((i, f"i{k}", s, p, len(near)))
    got = {(r["doc_id"], r["item_id"], r["s"], r["lo"], r["n_terms"]) for r in op10_decon.proximity(df, bench).collect()}
    assert got == want and len({x[0] for x in want}) >= 8


def test_language_rejects_noise_and_keeps_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op4_language.train(op4_language.sample(docs))
    rng = random.Random(1)
    noise = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(200)), "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(300)), "qqqq zzzz xxxx kkkk " * 20, "#### 0000 ----"]
    frame = spark.createDataFrame([(i, t, "s", 0.5, True) for i, t in enumerate(noise)], "doc_id long, text string, lang_pred string, score double, rejected boolean")
    assert [r["rejected"] for r in op4_language.predict(frame, model).collect()] == [True] * 4
    kept = op4_language.predict(docs.where("lang IS NOT NULL AND length(text) > 100"), model)
    n, bad = kept.count(), kept.where("rejected").count()
    assert bad <= 0.005 * n


def test_language_sample_is_bounded_and_odd_rows(spark):
    rows = [(i, f"some words of english number {i}", "en") for i in range(3000)] + [(None, None, "en"), (7, "12", "de"), (BIG + 1, "Tür", None), (9, "x" * 10**6, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op4_language.sample(docs, per_lang=100)
    assert 50 <= len(got[got["lang"] == "en"]) <= 150 and set(got["lang"]) <= {"en", "de"}
    model = op4_language.train(got)
    out = {r["doc_id"]: r for r in op4_language.predict(docs.where("doc_id IS NULL OR doc_id > 2999 OR doc_id IN (7, 9)"), model).collect()}
    assert out[None]["lang_pred"] == "und" and out[BIG + 1]["lang_pred"] in ("en", "de")
    none = op4_language.train(op4_language.sample(docs.limit(0)))
    assert {r["lang_pred"] for r in op4_language.predict(docs.limit(3), none).collect()} == {"und"}


def flagged_terms(texts, disclosure, smoothing=1.0):
    terms, entities = [], []
    for t in texts:
        spans = op5_pii.base_spans(t or "")
        terms.append({w.lower() for w in re.findall(r"[^\W\d_]{3,}", op5_pii.blanked(t or "", spans))})
        entities.append({f"{k}:{t[a:b].lower()}" for k, a, b in spans})
    n, nt, ne = len(texts), Counter(w for s in terms for w in s), Counter(e for s in entities for e in s)
    both = Counter((e, w) for s, es in zip(terms, entities, strict=True) for e in es for w in s)
    return {w for (e, w), k in both.items() if ne[e] < n and math.log2((k + smoothing * ne[e] / n) / (nt[w] + smoothing) / (ne[e] / n)) >= -disclosure * math.log2(ne[e] / n)}


def test_pii_terms_against_brute_force_both_ways(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"Name{chr(97 + i)}ü" for i in range(12)]
    texts = []
    for _ in range(150):
        p = rng.randrange(30)
        own = [names[p], f"p{p}@x.org"] if p < 12 and rng.random() < 0.9 else [rng.choice(names)] if rng.random() < 0.1 else []
        texts.append(" ".join([*own, *rng.choices(["und", "so", "weiter", "haus"], k=6), rng.choice(["", "1.2.3.4"])]))
    texts += [None, "", "nameaü " * 3]
    want = flagged_terms(texts, 0.6)
    assert 0 < len(want) <= 12
    docs = spark.createDataFrame([(BIG + i if i % 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    spans = []
    for t in texts:
        t = t or ""
        base = op5_pii.base_spans(t)
        rest = op5_pii.blanked(t, base)
        spans.append(op5_pii.joined(base + [("term", *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", rest) if m.group().lower() in want]))
    expected = sorted((BIG + i if i % 5 else 0, s) for i, s in enumerate(spans))
    monkeypatch.setattr(op5_pii, "FLUSH", 7)
    for limit in (1 << 20, 0):
        assert sorted((r["doc_id"] or 0, r["spans"]) for r in op5_pii.sanitise(docs, 0.6, max_bytes=limit).collect()) == expected


@pytest.mark.parametrize("text", ["1" * 200_000, "1." * 100_000, "+1 " * 60_000, "a@" * 100_000, "a" * 200_000 + "@", "@" + "a" * 200_000, "4111 1111 1111 1111 " * 10_000, "1.2.3.4 " * 25_000])
def test_pii_takes_linear_time(text):
    began = time.process_time()
    op5_pii.sanitised(text, frozenset(["term"]))
    assert time.process_time() - began < 4


def test_shards_recomputed(spark):
    docs = spark.createDataFrame([(BIG + 1, "a", 1), (None, "é", 2), (None, None, 3), (5, "", 4), *[(i, "same", 5) for i in range(10, 400)], (10, "same", 6), (10, "x" * 10**6, 7)], "doc_id long, text string, shard int")
    weights = [1.0, 2.0, 0.5, 1.0]

    def cost(key, i, w):
        draw = int(hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16)
        return -math.log((draw + 1) / (2**52 + 1)) / w

    place = lambda key, ws: min(range(len(ws)), key=lambda i: cost(key, i, ws[i]))
    rows = op7_shards.shard(docs, weights, bucket_rows=10).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["shard"] == place(r["doc_id"], weights) and r["grown_shard"] == place(r["doc_id"], [*weights, 1.0])
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is None} == {(8, 0), (10, zlib.crc32("é".encode()))}
    assert op7_shards.shard(docs.limit(0), weights).count() == 0


def test_targets_share_what_is_left():
    rng = random.Random(2)
    for _ in range(200):
        totals = [(f"s{i}", rng.randint(0, 1000)) for i in range(rng.randint(1, 8))] + ([(None, rng.randint(1, 50))] if rng.random() < 0.5 else [])
        got = op9_mix.targets(totals)
        order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
        cap, fixed = {s: 2.0 * n for s, n in totals}, {}
        while True:  # round by round, as the rule says
            free = [s for s in cap if s not in fixed]
            left = 1.5 * sum(n for _, n in totals) - sum(fixed.values())
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            if not (over := [s for s in free if share[s] > cap[s] + 1e-9]):
                break
            fixed |= {s: cap[s] for s in over}
        want = fixed | share
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)
    began = time.process_time()
    assert len(op9_mix.targets([(f"s{i}", i % 100) for i in range(50_000)])) == 50_000 and time.process_time() - began < 5


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, None, None), (BIG + 1, "word " * 50_000, None), (4, "", "s"), *[(i, "tie tie", "t") for i in range(5, 40)]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = op9_mix.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(got, key=str) == sorted(op9_mix.mix(docs.orderBy(F.desc("doc_id"))).collect(), key=str)
    assert op9_mix.mix(docs.limit(0)).count() == 0


def test_fit_deviation_of_large_budgets():
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(5, 20_000, 900))
    counts = rng.integers(1, 400, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.1, 0.37, 0.8):
        budget = int(total * share)
        k = op9_mix.fit(lengths, counts, budget)
        assert (k >= 0).all() and (k <= counts).all() and abs(int((k * lengths).sum()) - budget) <= 1
