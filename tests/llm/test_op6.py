import numpy as np
from quarry.llm import common, op6_simhash


def closure(fps):
    """Smallest member of each point's component: points within 3 bits agree in one of four 16-bit parts."""
    parent = np.arange(len(fps))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for part in range(0, 64, 16):
        key = (fps >> np.uint64(part)) & np.uint64(0xFFFF)
        order = np.argsort(key, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            for i in group:
                for j in group[(group > i) & (np.bitwise_count(fps[group] ^ fps[i]) <= 3)]:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return fps[[root(i) for i in range(len(fps))]]


def dense_set(n, rng):
    far = rng.integers(0, 2**64, n, np.uint64)
    near = [far[: n // 20] ^ (np.uint64(1) << rng.integers(0, 64, n // 20).astype(np.uint64)) for _ in range(2)]
    ball = far[0] ^ (np.uint64(1) << rng.integers(0, 64, (4, 3000)).astype(np.uint64)).sum(0, dtype=np.uint64)
    half = (far[1] & np.uint64(0xFFFFFFFF)) | (rng.integers(0, 2**16, 3000).astype(np.uint64) << np.uint64(40))
    return np.unique(np.concatenate([far, *near, ball, half]))


def test_links_of_many_with_a_dense_region(spark):
    fps = dense_set(90_000, np.random.default_rng(7))
    signed = np.sort(fps.view(np.int64))
    df = common.stored(spark.createDataFrame([(int(x),) for x in signed], "fp long"), "test")
    star = {r["a"]: r["b"] for r in op6_simhash.components(op6_simhash.links(df, len(fps), most=1500)).collect()}
    want = closure(fps)
    lowest = {}
    for f, w in zip(fps.view(np.int64).tolist(), want.tolist(), strict=True):
        lowest[w] = min(f, lowest.get(w, f))
    assert {f: star.get(f, f) for f in signed.tolist()} == {f: lowest[w] for f, w in zip(fps.view(np.int64).tolist(), want.tolist(), strict=True)}


def test_walk_equals_stars(monkeypatch):
    fps = dense_set(1000, np.random.default_rng(3))
    want = dict(zip(fps.tolist(), closure(fps).tolist(), strict=True))
    for f in (lambda out: op6_simhash.walk(fps, 3, out), lambda out: op6_simhash.stars(fps, op6_simhash.HALVES[0], 3, out)):
        out = []
        f(out)
        for own, low in out:
            assert len({want[int(x)] for x in own}) == 1
            assert (low == own.min()).all()


def test_hot_keys_join_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 3, k) for k in range(100)], "k long, v long")
    table = rows.groupBy("k").agg({"*": "count"}).toDF("k", "rows").withColumnRenamed("rows", "n").selectExpr("k", "k * 10 AS x", "n AS rows")
    got = sorted(tuple(r) for r in common.by_key(rows, table, "k", 100).select("k", "v", "x").collect())
    assert got == sorted((r["k"], r["v"], r["k"] * 10) for r in rows.collect())


def test_passages_too_rare_for_the_sample_make_few_pairs(spark, monkeypatch):
    """400 documents, each with 3 of 30 passages that 40 documents share, and 20 near copies: all links, from few pairs."""
    rng, pairs, stored = np.random.default_rng(11), [], op6_simhash.stored
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passages = [words(40) for _ in range(30)]
    texts = [words(100) + sum((passages[(i + k * (1 + i // 30)) % 30] for k in range(3)), []) + words(100) for i in range(400)]
    texts += [t[:50] + ["changed"] + t[51:-5] for t in texts[::20]]
    sets = [set(op6_simhash.shingles(" ".join(t), 5).tolist()) for t in texts]
    fps = [op6_simhash.fingerprint(" ".join(t), 5) for t in texts]
    want = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) or (fps[a] ^ fps[b]).bit_count() <= 3:
                old, new = max(want[a], want[b]), min(want[a], want[b])
                want = [new if x == old else x for x in want]

    def counted(df, name):
        out = stored(df, name)
        pairs.extend([out.count()] if name == "simhash-pairs" else [])
        return out

    monkeypatch.setattr(op6_simhash, "COMMON_FROM", 10)
    monkeypatch.setattr(op6_simhash, "stored", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op6_simhash.similar_documents(docs).collect()}
    assert got == dict(enumerate(want)) and sum(i != w for i, w in enumerate(want)) >= 20
    assert sum(pairs) <= 2 * len(texts), pairs


def test_whole_sets_are_made_for_likely_pairs_only(spark, monkeypatch):
    """20 pairs of texts 0.7 alike and 2 near copies: only the copies' whole shingle sets are stored."""
    rng, whole, stored = np.random.default_rng(5), [], op6_simhash.stored
    base = [[f"w{x}" for x in rng.integers(0, 10**9, 200)] for _ in range(22)]
    other = [t[:164] + [f"v{x}" for x in rng.integers(0, 10**9, 36)] for t in base[:20]] + [t[:-2] for t in base[20:]]

    def seen(df, name):
        out = stored(df, name)
        whole.extend(r["doc_id"] for r in out.collect() if name == "simhash-sets" and "array<bigint>" in dict(out.dtypes).values())
        return out

    monkeypatch.setattr(op6_simhash, "stored", seen)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(base + other)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op6_simhash.similar_documents(docs).collect()}
    assert got == {i: i - 22 if i in (42, 43) else i for i in range(44)}
    assert set(whole) <= {20, 21, 42, 43}
