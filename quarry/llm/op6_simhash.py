"""SimHash near duplicates, linked exactly with vantage-point trees.

Two fingerprints within 3 bits differ in at most 1 bit in one of their halves. Each half has a
vantage-point tree, fitted on about SAMPLE fingerprints, that routes the distinct fingerprints by
the Hamming distance of that half; a fingerprint within the half's radius of a node's boundary
also goes to the inner shard, so every close pair meets in one shard. A shard over MOST rows is
split again, round by round, at a vantage point of its own and by the distances of all its rows.
Inside a task the tree goes on, prunes branches by the triangle inequality, checks all 64 bits and
returns stars of the local components, never all pairs. A set that no vantage point divides (a
ball of a few bits) is walked from neighbour to neighbour, which removes what it reaches. Components
come from large-star/small-star rounds; the rows of hot vertices don't shuffle. Null and wordless
texts have fingerprint zero; repeated rows share a class; an empty table gives none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, discard, read, small_batches, stored

SIMILARITY, COMMON_FROM, COMMON, BLOCK, MAX_BROADCAST = 0.8, 8192, 100_000, 1024, 200_000
LONG, RAISED, ROUNDS = 8, 1 << 20, 8
RADIUS, WIDTH, SAMPLE, TASK, MOST, LEAF, WORTH = 3, 3, 65536, 4096, 1 << 20, 128, 0.85
HALVES, ALL = (0xFFFFFFFF, 0xFFFFFFFF00000000), 0xFFFFFFFFFFFFFFFF


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of all shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)] if w else []
    one = xxhash.xxh64_intdigest
    return np.array([one(g, 42) for g in grams], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    return folded(shingles(text, width))


def folded(grams: np.ndarray) -> int:
    h = grams.astype(">u8")
    if not len(h):
        return 0
    bits = np.zeros(64, np.int64)
    n = 0
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * bits > n).view(">i8")[0])


def split(points: np.ndarray, mask: int, radius: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Vantage point, boundary and both sides, the inner one with its overlap; None if that leaves over WORTH of all pairs."""
    v = points[len(points) // 2]
    d = np.bitwise_count((points ^ v) & np.uint64(mask))
    mu = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
    inner, outer = points[d <= mu + radius], points[d > mu]
    return (int(v), mu, inner, outer) if len(inner) ** 2 + len(outer) ** 2 <= WORTH * len(points) ** 2 else None


def plant(points: np.ndarray, most: float, mask: int, radius: int, leaf: Iterator[int]) -> tuple | int:
    """A node (vantage point, boundary, inner, outer) or the name of a leaf, of about `most` sample points."""
    parts = split(points, mask, radius) if len(points) > max(most, 2) else None
    if not parts:
        return next(leaf)
    v, mu, inner, outer = parts
    return v, mu, plant(inner, most, mask, radius, leaf), plant(outer, most, mask, radius, leaf)


def route(node: tuple | int, points: np.ndarray, at: np.ndarray, mask: int, radius: int, out: list) -> None:
    if not len(at):
        return
    if isinstance(node, int):
        out.append((at, np.full(len(at), node, np.int64)))
        return
    v, mu, inner, outer = node
    d = np.bitwise_count((points[at] ^ np.uint64(v)) & np.uint64(mask))
    route(inner, points, at[d <= mu + radius], mask, radius, out)
    route(outer, points, at[d > mu], mask, radius, out)


def walk(points: np.ndarray, radius: int, out: list) -> None:
    """Appends (member, smallest of its local component) arrays; memory grows with the points, not with their pairs."""
    rest = points
    while len(rest):
        own, front = [], rest[:1]
        rest = rest[1:]
        while len(front):
            own.append(front)
            new = []
            for i in range(0, len(front), 64):
                if not len(rest):
                    break
                near = np.zeros(len(rest), bool)
                for k in range(0, len(rest), 1 << 14):
                    near[k : k + (1 << 14)] = (np.bitwise_count(rest[k : k + (1 << 14), None] ^ front[None, i : i + 64]) <= radius).any(1)
                new.append(rest[near])
                rest = rest[~near]
            front = np.concatenate(new) if new else rest[:0]
        own = np.concatenate(own)
        if len(own) > 1:
            out.append((own, np.full(len(own), own.min())))


def stars(points: np.ndarray, mask: int, radius: int, out: list) -> None:
    """As walk, by a vantage-point tree."""
    if len(points) > LEAF:
        parts = split(points, mask, radius // 2) or split(points, ALL, radius)
        if parts:
            stars(parts[2], mask, radius, out)
            stars(parts[3], mask, radius, out)
        else:
            walk(points, radius, out)
        return
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    todo = near.sum(1) > 1
    for i in np.flatnonzero(todo):
        if not todo[i]:
            continue
        seen = np.zeros(len(points), bool)
        front = np.array([i])
        seen[i] = True
        while len(front):
            new = near[front].any(0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
        todo &= ~seen
        own = points[seen]
        out.append((own, np.full(len(own), own.min())))


def local_links(pdf: pd.DataFrame, radius: int = RADIUS) -> pd.DataFrame:
    points, out = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64)), []
    stars(points, HALVES[int(pdf["half"].iloc[0])], radius, out)
    if not out:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).query("a != b").drop_duplicates()


def split_large(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """rows(shard, half, fp) with every shard over `most` rows split, until it isn't or no boundary is worth it.

    A round takes one vantage point and the median distance a large shard, by the half or, where that
    leaves over WORTH of all pairs, by all bits. The large shards' own rows, one each, are sent to
    all executors: at most the number of rows / `most` of them."""
    signed = [m - (1 << 64) if m >> 63 else m for m in HALVES]
    stuck, turn = None, 0
    while True:
        n = F.count(F.lit(1))
        large = rows.groupBy("shard", "half").agg(n.alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(turn))).alias("v")).where(F.col("n") > most)
        if stuck is not None:
            large = large.join(F.broadcast(stuck), "shard", "left_anti")
        large = stored(large, "simhash-large")
        if large.isEmpty():
            return rows
        off = F.col("fp").bitwiseXOR(F.col("v"))
        mask = F.when(F.col("half") == 0, F.lit(signed[0])).otherwise(F.lit(signed[1]))
        far = rows.join(F.broadcast(large), ["shard", "half"]).withColumn("d0", F.bit_count(off.bitwiseAND(mask))).withColumn("d1", F.bit_count(off))
        mid = far.groupBy("shard").agg(*[F.percentile_approx(f"d{k}", 0.5).alias(f"mu{k}") for k in (0, 1)])
        r = (radius // 2, radius)
        sides = [F.count_if(F.col(f"d{k}") <= F.col(f"mu{k}") + r[k]).alias(f"in{k}") for k in (0, 1)] + [F.count_if(F.col(f"d{k}") > F.col(f"mu{k}")).alias(f"out{k}") for k in (0, 1)]
        good = [F.pow(f"in{k}", 2) + F.pow(f"out{k}", 2) <= WORTH * F.pow("n", 2) for k in (0, 1)]
        plan = far.join(F.broadcast(mid), "shard").groupBy("shard", "v", "n", "mu0", "mu1").agg(*sides).withColumn("by", F.when(good[0], 0).when(good[1], 1))
        plan = stored(plan.select("shard", "v", "by", F.when(good[0], F.col("mu0")).otherwise(F.col("mu1")).alias("mu")), "simhash-plan")
        none = plan.where("by IS NULL").select("shard")
        stuck = none if stuck is None else stuck.union(none)
        rows = rows.join(F.broadcast(plan.where("by IS NOT NULL")), "shard", "left")
        d = F.when(F.col("by") == 0, F.bit_count(off.bitwiseAND(mask))).otherwise(F.bit_count(off))
        inner = F.when(d <= F.col("mu") + F.when(F.col("by") == 0, r[0]).otherwise(r[1]), F.xxhash64("shard", F.lit(2 * turn)))
        outer = F.when(d > F.col("mu"), F.xxhash64("shard", F.lit(2 * turn + 1)))
        to = F.when(F.col("by").isNull(), F.array("shard")).otherwise(F.array_compact(F.array(inner, outer)))
        rows, turn = stored(rows.select(F.explode(to).alias("shard"), "half", "fp"), "simhash-shards"), turn + 1


def links(fps: DataFrame, n: int, radius: int = RADIUS, task: int = TASK, most: int = MOST) -> DataFrame:
    """Links (a > b) between n distinct fingerprints whose closure is that of all pairs within the radius."""
    share = min(1.0, SAMPLE / max(1, n))
    pick = np.array([r[0] for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(share * (1 << 40))).select("fp").collect()], np.int64).view(np.uint64)
    pick = pick[np.argsort(pick * np.uint64(0x9E3779B97F4A7C15))]
    leaf = task * len(pick) / max(1, n)
    trees = [plant(pick, leaf, m, radius // 2, itertools.count(i, 2)) for i, m in enumerate(HALVES)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            points = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for half, (tree, mask) in enumerate(zip(trees, HALVES, strict=True)):
                out: list = []
                route(tree, points, np.arange(len(points)), mask, radius // 2, out)
                if out:
                    at, name = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pd.DataFrame({"shard": name, "half": np.full(len(at), half, np.int32), "fp": points[at].view(np.int64)})

    rows = stored(fps.select("fp").mapInPandas(deal, "shard long, half int, fp long"), "simhash-shards")
    rows = split_large(rows, radius, most)
    return rows.groupBy("shard", "half").applyInPandas(lambda p: local_links(p, radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every linked vertex but the smallest of its component, and that one."""
    edges, last = stored(edges, "cc"), None
    state = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    now = edges.agg(*state).first()
    while now != last:
        last = now
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("rows")).select("a", F.least("a", "m").alias("m"), "rows")
        large = by_key(both.where("b > a"), low, "a", now[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stored(large, "cc-large")
        before = edges
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows"))
        small = by_key(large, low, "a", now[0]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m").toDF("a", "b"))
        edges = stored(small.distinct(), "cc")
        discard(before, large)
        now = edges.agg(*state).first()
    return edges


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows(doc_id, fp, ...), stored, with the component_id of each fingerprint."""
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    n_rows, n_fps = rows.count(), fps.count()
    star = components(links(fps, n_fps, radius))
    roots = fps.join(star.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    of = by_key(roots, least, "root", n_fps).select("fp", "component_id", F.col("n").alias("rows"))
    return by_key(rows, of, "fp", n_rows)


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed), component_id."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return classes(stored(docs.select("doc_id", fp_of("text").alias("fp")), "simhash"), radius).select("doc_id", "fp", "component_id")


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about COMMON_FROM documents share, sorted, and about how many of all share them: an order only, so a sample does."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 128):
                sets = [np.unique(shingles(t, width)) for t in pdf["text"].iloc[i : i + 128]]
                yield pd.DataFrame({"g": np.concatenate(sets).view(np.int64)})

    step = max(1, docs.count() // COMMON_FROM)
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    most = part.select("text").mapInPandas(grams, "g long").groupBy("g").count().where("count > 2").orderBy(F.desc("count"), "g").limit(COMMON).collect()
    g, n = np.array([r[0] for r in most], np.int64).view(np.uint64), np.array([r[1] * step for r in most], np.int64)
    order = np.argsort(g)
    return g[order], n[order]


def rarest_first(grams: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(common):
        return grams
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    return grams[np.lexsort((grams, np.where(common[at] == grams, counts[at], 0)))]


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Of distinct shingles as many of the rarest as two sets of the similarity need to have one in common."""
    n = len(grams)
    return rarest_first(grams, common, counts)[: n - math.ceil(similarity * n - 1e-9) + 1]


def shorter_lists(docs: DataFrame, chosen: DataFrame, sets: DataFrame, common: np.ndarray, counts: np.ndarray, width: int, similarity: float) -> DataFrame:
    """chosen(doc_id, n, first, c), stored, with other prefixes where a list of theirs has LONG documents or more.

    A passage that some documents in a million share is too rare for the sample: its shingles count as
    rare, lead the prefixes, and the pairs in their lists grow with the square of the input. So each
    round the shingles of long lists (the RAISED longest) rank by the length of their list, and the
    documents that list them get prefixes in the new order. Another document's prefix stays as it is
    in that order, since shingles only move back: the order is one for all, and no pair is lost. After
    the first round only the lists of the prefixes drawn last are counted."""
    n, last = F.count(F.lit(1)), None
    for _ in range(ROUNDS):

        def unknown(batches: Iterator[pd.DataFrame], common: np.ndarray = common) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[~np.isin(pdf["g"].to_numpy(np.int64).view(np.uint64), common)]

        def redraw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), 256):
                    own = [np.unique(shingles(t, width)) for t in pdf["text"].iloc[i : i + 256]]
                    yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[i : i + 256], "n": [len(g) for g in own], "first": [prefix(g, common, counts, similarity).view(np.int64) for g in own]})

        lists = chosen.select("doc_id", "c", F.explode("first").alias("g"))
        recent = lists if last is None else lists.join(small(last), F.col("doc_id") == F.col("k"), "left_semi")
        long = recent.groupBy("g").agg(n.alias("rows"), (F.min("c") < F.max("c")).alias("mixed")).where(F.col("mixed") & (F.col("rows") >= LONG)).select("g", "rows")
        long = stored(long.mapInPandas(unknown, "g long, rows long").orderBy(F.desc("rows"), "g").limit(RAISED), "simhash-long")
        new = long.toArrow()
        if last is not None:
            discard(last)
        if not new.num_rows:
            discard(long)
            return chosen
        ids = stored(lists.join(small(long), "g", "left_semi").select(F.col("doc_id").alias("k")).distinct(), "simhash-ids")
        common = np.concatenate([common, new["g"].to_numpy().view(np.uint64)])
        counts = np.concatenate([counts, new["rows"].to_numpy()])
        order = np.argsort(common)
        common, counts = common[order], counts[order]
        drawn = docs.select("doc_id", "text").join(small(ids), F.col("doc_id") == F.col("k"), "left_semi").mapInPandas(redraw, "doc_id long, n int, first array<long>")
        drawn = drawn.join(sets.select("doc_id", "c"), "doc_id").select("doc_id", "n", "first", "c")
        before = chosen
        chosen = stored(chosen.join(small(ids), F.col("doc_id") == F.col("k"), "left_anti").select("doc_id", "n", "first", "c").union(drawn), "simhash-first")
        discard(before, long)
        last = ids
    discard(last)
    return chosen


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def could_reach(similarity: float, n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles whose first common one is at i and j can have the similarity."""
    sizes = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    return sizes & (F.least(n - i, m - j) >= similarity / (1 + similarity) * (n + m) - 1e-6)


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id: linked fingerprints, and all texts whose shingle sets have the Jaccard similarity.

    Fingerprints within RADIUS bits are linked first. Then one document of each distinct shingle set
    is listed under the shingles of its prefix: in one order for all, rarest first, two sets of the
    similarity share a shingle among the first n - ceil(similarity * n) + 1 of each. Pairs in one
    list that are not linked yet are compared by whole sets: first each with the list's smallest id,
    which links most copies, then all that are still apart, long lists block by block. Rows without
    a doc_id are left out; repeated rows give one; texts without words are one class."""
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL")
    common, counts = common_shingles(docs, width)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                rows = []
                for d, t in zip(pdf["doc_id"].iloc[i : i + 256], pdf["text"].iloc[i : i + 256], strict=True):
                    grams = shingles(t, width)
                    own = np.unique(grams)
                    rows.append((d, folded(grams), len(own), xxhash.xxh3_128_digest(own.tobytes()), prefix(own, common, counts, similarity).view(np.int64)))
                yield pd.DataFrame(rows, columns=["doc_id", "fp", "n", "h", "first"])

    def gram_sets(batches: Iterator[pd.DataFrame], short: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 128):
                part = pdf.iloc[i : i + 128]
                own = [np.unique(shingles(t, width)) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n": [len(g) for g in own], "g": [np.unique(g.astype(np.uint16)).view(np.int16) if short else g.view(np.int64) for g in own]})

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs(a, b, ca, cb) the links ca, cb of those with the similarity."""
        pairs = stored(pairs.distinct(), "simhash-pairs")

        def beside(pairs: DataFrame, short: bool) -> tuple[DataFrame, DataFrame]:
            """pairs with na, nb and the sets ga, gb, and the stored table of the sets."""
            ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "simhash-ids")
            texts = docs.select("doc_id", "text").join(small(ids), F.col("doc_id") == F.col("k"), "left_semi")
            sets = stored(texts.mapInPandas(lambda x: gram_sets(x, short), f"doc_id long, n int, g array<{'short' if short else 'long'}>"), "simhash-sets")
            discard(ids)
            for side in ("a", "b"):
                pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("g").alias(f"g{side}")), side)
            return pairs, sets

        # two bytes a shingle first: shared ones are at most the shared values and those that fell together.
        # Whole sets, four times as large, are made for the likely pairs only
        both, sets = beside(pairs, True)
        lost = lambda x: F.col(f"n{x}") - F.size(f"g{x}")
        shared = F.size(F.array_intersect("ga", "gb"))
        most = F.least(shared + F.least(lost("a"), lost("b")), F.col("na"), F.col("nb"))
        likely = stored(both.where(most >= similarity * (F.col("na") + F.col("nb") - most) - 1e-9).select("a", "b", "ca", "cb"), "simhash-likely")
        discard(pairs, sets)
        both, sets = beside(likely, False)
        near = both.where(shared >= similarity * (F.col("na") + F.col("nb") - shared))
        out = stored(near.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), name)
        discard(sets, likely)
        return out

    drawn = stored(docs.select("doc_id", "text").mapInPandas(sketch, "doc_id long, fp long, n int, h binary, first array<long>"), "simhash")
    rows = stored(classes(drawn.select("doc_id", "fp", "h")).select("doc_id", "h", "component_id").distinct(), "simhash-classes")
    # equal sets: one document stands for them, and their classes are linked
    sets = stored(rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min("component_id").alias("c")), "simhash-distinct")
    links0 = stored(rows.select("h", "component_id").distinct().join(sets, "h").where("component_id > c").select(F.col("component_id").alias("a"), F.col("c").alias("b")).distinct(), "simhash-equal")
    chosen = stored(drawn.select("doc_id", "n", "first").join(sets.select("doc_id", "c"), "doc_id"), "simhash-first")
    discard(drawn)
    chosen = shorter_lists(docs, chosen, sets, common, counts, width, similarity)
    lists = chosen.select("doc_id", "n", "c", F.posexplode("first").alias("i", "g"))
    mixed = F.min("c") < F.max("c")
    kept = stored(lists.groupBy("g").agg(mixed.alias("mixed")).where("mixed").select("g"), "simhash-lists")
    lists = stored(lists.join(small(kept), "g"), "simhash-postings")
    discard(chosen, kept)

    x = F.col("x")
    heads = lists.groupBy("g").agg(F.min(F.struct("doc_id", "n", "i", "c")).alias("x"))
    pairs = lists.join(heads, "g").where((F.col("c") != x["c"]) & could_reach(similarity, F.col("n"), F.col("i"), x["n"], x["i"]))
    links1 = links0.union(alike(pairs.select(x["doc_id"].alias("a"), F.col("doc_id").alias("b"), x["c"].alias("ca"), F.col("c").alias("cb")), "simhash-near1"))

    star = components(links1).select(F.col("a").alias("c"), F.col("b").alias("root"))
    lists = lists.join(small(star), "c", "left").withColumn("c", F.coalesce("root", "c")).drop("root")
    size = F.count(F.lit(1))
    sizes = lists.groupBy("g").agg(mixed.alias("mixed"), F.when(size <= BLOCK, 1).otherwise(F.ceil(2 * size / BLOCK)).cast("int").alias("k")).where("mixed").drop("mixed")
    lists = lists.join(sizes, "g").withColumn("p", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    lists = lists.withColumn("o", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("k") - 2))))
    lists = lists.withColumn("o", F.when(F.col("k") > 1, F.col("o") + (F.col("o") >= F.col("p")).cast("int")).otherwise(0))
    lists = stored(lists.select("g", F.least("p", "o").alias("u"), F.greatest("p", "o").alias("v"), "doc_id", "n", "i", "c"), "simhash-blocks")
    y = lists.select("g", "u", "v", *[F.col(k).alias(f"{k}2") for k in ("doc_id", "n", "i", "c")])
    pairs = lists.join(y, ["g", "u", "v"]).where((F.col("doc_id") < F.col("doc_id2")) & (F.col("c") != F.col("c2")) & could_reach(similarity, F.col("n"), F.col("i"), F.col("n2"), F.col("i2")))
    links2 = alike(pairs.select(F.col("doc_id").alias("a"), F.col("doc_id2").alias("b"), F.col("c").alias("ca"), F.col("c2").alias("cb")), "simhash-near2")

    star = components(links1.union(links2).distinct()).select(F.col("a").alias("component_id"), F.col("b").alias("root"))
    return rows.select("doc_id", "component_id").distinct().join(star, "component_id", "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
