"""Retrieval operators over batches of queries: every plan is partitioned by query_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACK, CHUNK_PARTS, QUERY_ROWS, QUERY_PARTS = 1024, 8, 4096, 16
MAX_BROADCAST_BYTES = 64 << 20  # of query vectors that a task gets


class Best:
    """The best `limit` chunks so far of each of a block of queries; ties by key."""

    def __init__(self, queries: np.ndarray, limit: int, threshold: float) -> None:
        self.queries, self.limit, self.threshold = queries, limit, threshold
        self.cut = np.full(len(queries), threshold)  # what a chunk must reach
        self.parts: list[tuple] = []  # (query, score, key) of candidates
        self.fresh = 0

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        s = self.queries @ vectors.T
        near = 1e-11  # more than rounding moves a score
        at = s >= self.cut[:, None] - near
        if len(keys) > self.limit and np.count_nonzero(at) > self.limit * len(s):
            at &= s >= np.partition(s, -self.limit, axis=1)[:, -self.limit, None] - near
        i, j = np.nonzero(at)
        if len(i):
            self.parts.append((i, np.round(s[i, j], 12), keys[j]))
            self.fresh += len(i)
        if self.fresh > 2 * self.limit * len(s):
            self.kept()

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, int), np.empty(0), np.empty(0, int)
        i, s, k = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((k, -s, i))
        i, s, k = i[order], s[order], k[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        use = (place < self.limit) & (s >= self.threshold)
        full = use & (place == self.limit - 1)
        self.cut[i[full]] = s[full]
        self.parts, self.fresh = [(i[use], s[use], k[use])], 0
        return self.parts[0]


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a length, their vectors of length 1)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    norm = np.linalg.norm(m, axis=1)
    use = norm > 0
    return use, m[use] / norm[use, None]


def vector_topk(chunks: DataFrame, queries: DataFrame, limit: int, threshold: float) -> DataFrame:
    """chunks(key, vector) x queries(query_id, vector): exact cosine to 12 digits, threshold inclusive, ties by key (TOP-1, FLT-3).

    The chunks are dealt into CHUNK_PARTS parts, the queries by QUERY_ROWS into at most QUERY_PARTS (more
    if a part took over MAX_BROADCAST_BYTES), and each pair of parts is one task: it holds its queries with
    their best `limit` chunks so far, while the chunks stream past in blocks of a matrix product. So the
    work is all pairs, but the rows that leave the tasks are CHUNK_PARTS x limit a query."""
    kinds = [x.schema[k].dataType.simpleString() for x, k in ((queries, "query_id"), (chunks, "key"))]
    q = queries.where("query_id IS NOT NULL AND size(vector) > 0")
    c = chunks.where("key IS NOT NULL AND size(vector) > 0")
    vector = F.col("vector") if q.schema["vector"].dataType == c.schema["vector"].dataType else F.col("vector").cast("array<double>")
    n, numbers = q.agg(F.count(F.lit(1)), F.sum(F.size("vector"))).first()
    parts = max(1, min(n, max(min(QUERY_PARTS, -(-n // QUERY_ROWS)), -(-8 * (numbers or 0) // max(1, MAX_BROADCAST_BYTES)))))
    part = lambda k, n: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(F.lit(0).alias("side"), part("query_id", parts).alias("a"), every(CHUNK_PARTS).alias("b"), "query_id", F.lit(None).cast(kinds[1]).alias("key"), vector.alias("vector"))
    c = c.select(F.lit(1).alias("side"), every(parts).alias("a"), part("key", CHUNK_PARTS).alias("b"), F.lit(None).cast(kinds[0]).alias("query_id"), "key", vector.alias("vector"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blocks, kind = [], None, None
        for batch in batches:
            n = np.count_nonzero(batch.column("side").to_numpy() == 0)  # the queries come first
            if n:
                use, vectors = unit_vectors(batch.column("vector").slice(0, n))
                ids.append((batch.column("query_id").slice(0, n).filter(pa.array(use)), vectors))
            if n == len(batch) or not ids:
                continue
            if blocks is None:
                names, m, kind = pa.concat_arrays([x for x, _ in ids]), np.concatenate([v for _, v in ids]), batch.schema.field("key").type
                blocks = [(names.slice(i, PACK), Best(m[i : i + PACK], limit, threshold)) for i in range(0, len(m), PACK)]
            use, vectors = unit_vectors(batch.column("vector").slice(n))
            keys = batch.column("key").slice(n).to_numpy(zero_copy_only=False)[use]
            keys = np.asarray(keys.tolist()) if keys.dtype == object else keys
            for i in range(0, len(keys), PACK):
                for _, b in blocks:
                    b.add(keys[i : i + PACK], vectors[i : i + PACK])
        for names, b in blocks or []:
            i, s, k = b.kept()
            if len(i):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(k, kind), pa.array(s)], ["query_id", "key", "score"])

    dealt = q.union(c).repartitionById(parts * CHUNK_PARTS, F.col("a") * CHUNK_PARTS + F.col("b")).sortWithinPartitions("side")
    pairs = dealt.select("side", "query_id", "key", "vector").mapInArrow(best, f"query_id {kinds[0]}, key {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit)


def fuse(lanes: DataFrame, k: int = 60) -> DataFrame:
    """lanes(query_id, lane, lane_no, weight, key, rank): weighted reciprocal ranks, ties by first seen (AGG-4)."""
    used = lanes.where("weight > 0")
    out = used.groupBy("query_id", "key").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.min(F.struct("lane_no", "rank")).alias("first"), F.array_sort(F.collect_set(F.struct("lane_no", "lane"))).alias("l"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "key")
    return out.select("query_id", "key", "score", F.col("l.lane").alias("lanes"), F.row_number().over(order).alias("position"))


def relevance_cut(passages: DataFrame, keep: float) -> DataFrame:
    """Keeps the first passage and those within a share of the best (FLT-4)."""
    value = F.coalesce("similarity", "score")
    top = F.max(value).over(Window.partitionBy("query_id"))
    return passages.withColumn("_top", top).where((F.lit(keep) <= 0) | (F.col("_top") <= 0) | (F.col("rank") == 1) | (value >= keep * F.col("_top"))).drop("_top")


def fit_budget(passages: DataFrame, budget: int, at_least: int = 1) -> DataFrame:
    """Longest prefix within the token budget, never fewer than at_least (TOP-7)."""
    cum = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return passages.withColumn("cum_tokens", cum).where((F.col("cum_tokens") <= budget) | (F.col("rank") <= at_least))


def prompt_order(passages: DataFrame, n: int) -> DataFrame:
    """The first n passages, the best one last (TOP-6)."""
    last = F.max("rank").over(Window.partitionBy("query_id"))
    return passages.where(F.col("rank") <= n).withColumn("prompt_position", last - F.col("rank") + 1)


def bm25(candidates: DataFrame, terms: DataFrame, k1: float = 1.2, b: float = 0.0) -> DataFrame:
    """candidates(query_id, key, tokens), terms(query_id, term): candidate-local statistics (AGG-3).

    Term counts are made in the row that holds the tokens, so neither tokens nor texts shuffle, and
    a query of many candidates is no single task's."""
    own = candidates.select("query_id", "key", F.size("tokens").alias("len"), "tokens")
    totals = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    # explode would have Spark cut the tokens of all texts into a filter below the joins that made the candidates
    hits = own.select("query_id", "key", "len", F.explode_outer("tokens").alias("term")).join(terms.distinct(), ["query_id", "term"])
    tf = hits.groupBy("query_id", "key", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    tf = tf.join(df, ["query_id", "term"]).join(totals, "query_id")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return tf.groupBy("query_id", "key").agg(F.sum(score).alias("score")).where("score > 0")


def neighbours(winners: DataFrame, candidates: DataFrame, reach: int = 1) -> DataFrame:
    """winners(query_id, winner_rank, file_path, chunk_index, ...) with those candidates beside them that are no winners (JOIN-11).

    The best winner that reaches a neighbour claims it and gives it all its other columns;
    position is the order of winners, each among its own neighbours in the file's order."""
    gone = [x for x in ("query_id",) if x in candidates.columns]
    rest = [c for c in winners.columns if c not in ("query_id", "winner_rank", "file_path", "chunk_index")]
    near = winners.withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("at", F.col("chunk_index") + F.col("offset"))
    there = candidates.select(*gone, "file_path", F.col("chunk_index").alias("at")).distinct().withColumn("_there", F.lit(True))
    near = near.join(there, [*gone, "file_path", "at"], "left").where("_there OR offset = 0")
    first = F.row_number().over(Window.partitionBy("query_id", "file_path", "at").orderBy(F.when(F.col("offset") == 0, 0).otherwise(1), "winner_rank"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("winner_rank", "offset"))
    return near.withColumn("_r", first).where("_r = 1").select("query_id", "file_path", F.col("at").alias("chunk_index"), "winner_rank", "offset", *rest, order.alias("position"))


def adjacent_runs(passages: DataFrame) -> DataFrame:
    """Runs of consecutive chunks of a file, text joined, best rank first (WIN-2)."""
    w = Window.partitionBy("query_id", "file_path").orderBy("chunk_index")
    rows = passages.dropDuplicates(["query_id", "file_path", "chunk_index"]).withColumn("island", F.col("chunk_index") - F.row_number().over(w))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return rows.groupBy("query_id", "file_path", "island").agg(F.array_join(parts["text"], " ").alias("text"), F.min("rank").alias("first_position"), F.count(F.lit(1)).alias("n_chunks")).drop("island")


def trim_overlap(chunks: DataFrame, by: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Drops the words that a chunk repeats from the one before it (WIN-3)."""
    w = Window.partitionBy(*by).orderBy("chunk_index")
    toks = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    over = F.when(F.lag("chunk_index").over(w) == F.col("chunk_index") - 1, F.lag("end_index").over(w) - F.col("start_index"))
    rows = chunks.withColumn("_o", over).withColumn("_w", toks)
    cut = (F.col("_o") > 0) & (F.col("_o") < F.size("_w"))
    return rows.withColumn("text", F.when(cut, F.array_join(F.slice("_w", F.col("_o").cast("int") + 1, F.size("_w")), " ")).otherwise(F.col("text"))).drop("_o", "_w")


def lane_counts(passages: DataFrame) -> DataFrame:
    """passages(query_id, lanes): how many passages each lane had a part in (AGG-5)."""
    has = lambda lane: F.count_if(F.array_contains("lanes", lane)).alias(lane)
    return passages.groupBy("query_id").agg(*map(has, ("vector", "hyde", "keyword", "date")))


def dated_among(candidates: DataFrame, catalog: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query_id, key) of the candidates(query_id, key) that dated_chunks has, without the dated chunks of a query that are no candidates."""
    own = candidates.join(ranges.where("start_day <= end_day"), "query_id").join(catalog, "key")
    return own.where(F.col("day").between(F.col("start_day"), F.col("end_day"))).select("query_id", "key").distinct()


def dated_chunks(catalog: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query_id, key) of the chunks one of whose days, as YYYYMMDD, lies in a range of the query; joined by year (JOIN-7)."""
    year = lambda c: F.floor(F.col(c) / 10000).cast("int")
    years = ranges.where("start_day <= end_day").withColumn("year", F.explode(F.sequence(year("start_day"), year("end_day"))))
    hit = catalog.withColumn("year", year("day")).join(years, "year").where(F.col("day").between(F.col("start_day"), F.col("end_day")))
    return hit.select("query_id", "key").distinct()
