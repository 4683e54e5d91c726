"""Language ID by nearest centroid over normalised TF-IDF character n-grams.

Training takes about SAMPLE labelled rows (chosen by hash) of each of the LANGS most frequent
languages, a documented bound; their n-gram counts are made on the executors, from whole texts, so
the driver gets at most DIM counts a row however long the text is. Each language gets up to
CENTROIDS spherical k-means centroids; a text goes to the language of the centroid of highest cosine
and is rejected when that cosine is under the centroid's floor: the REJECT quantile of its own
training texts' cosines, times MARGIN. A null, empty or letterless text is `und` with score 0 and
rejected; ties go to the first language by name; without training rows everything is `und`. Whole
texts are read. Every column is kept, but for columns named lang_pred, score or rejected, which are
replaced; repeated rows repeat the result; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

DIM, SAMPLE, LANGS, CENTROIDS, ROUNDS, REJECT, MARGIN = 1 << 14, 1000, 200, 4, 8, 0.005, 0.8


def counts(text: str) -> np.ndarray:
    """How often each hashed 1-, 2- and 3-gram occurs."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c < 65) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 128)), np.uint32(32), c)
    two = c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(40503)
    three = two[:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
    h = np.concatenate([c[c != 32] * np.uint32(374761393), two, three])
    return np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(18), minlength=DIM)


def vector(text: str) -> np.ndarray:
    return np.log1p(counts(text).astype(np.float32))


def packed(text: str) -> bytes:
    """The vector's places and values that aren't zero."""
    v = vector(text)
    at = np.flatnonzero(v)
    return struct.pack("<I", len(at)) + at.astype("<u2").tobytes() + v[at].astype("<f4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    return np.frombuffer(data, "<u2", n, 4), np.frombuffer(data, "<f4", n, 4 + 2 * n)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)


def train(rows: pd.DataFrame, k: int = CENTROIDS) -> dict:
    """A model of rows(lang, h, v): v is packed."""
    rows = rows.sort_values(["lang", "h"])
    if not len(rows):
        return {"langs": [], "idf": np.ones(DIM, np.float32), "centroids": np.zeros((0, DIM), np.float32), "floor": []}
    seen = np.zeros(DIM, np.int64)
    for v in rows["v"]:
        seen[unpacked(v)[0]] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
    langs, cents, floor = [], [], []
    for lang in sorted(rows["lang"].unique()):  # only one language's vectors are held whole at once
        packs = rows.loc[rows["lang"] == lang, "v"]
        own = np.zeros((len(packs), DIM), np.float32)
        for i, v in enumerate(packs):
            at, values = unpacked(v)
            own[i, at] = values
        own = unit(own * idf)
        c = own[np.linspace(0, len(own) - 1, min(k, len(own))).astype(int)]
        for _ in range(ROUNDS):
            near = (own @ c.T).argmax(1)
            c = unit(np.stack([own[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))]))
        cos = own @ c.T
        near = cos.argmax(1)
        langs += [lang] * len(c)
        cents.append(c)
        floor += [MARGIN * float(np.quantile(cos[near == i, i], REJECT)) if (near == i).any() else 0.0 for i in range(len(c))]
    return {"langs": langs, "idf": idf, "centroids": np.concatenate(cents).astype(np.float32), "floor": floor}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Every column of docs, lang_pred, score and rejected."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for t in batch:
                if not model["langs"] or not has_letter(t):
                    out.append(("und", 0.0, True))
                    continue
                cos = model["centroids"] @ unit(vector(t) * model["idf"])
                i = int(cos.argmax())
                out.append((model["langs"][i], float(min(1.0, max(0.0, cos[i]))), bool(cos[i] < model["floor"][i])))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return docs.select(*rest, label("text").alias("_label")).select(*rest, "_label.*")


def sample(docs: DataFrame, per_lang: int = SAMPLE, langs: int = LANGS) -> pd.DataFrame:
    """(lang, h, v) of about per_lang rows, never over 1.5 times as many, of each of the most frequent languages."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    often = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()
    if not often:
        return pd.DataFrame({"lang": [], "h": [], "v": []})

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([packed(t) if has_letter(t) else None for t in texts], dtype=object)

    share = F.create_map(*[F.lit(x) for r in often for x in (r["lang"], int((1 << 40) * min(1.0, per_lang / r["count"])))])
    h = F.xxhash64("doc_id", "text")
    chosen = rows.withColumn("h", h).where(F.pmod("h", F.lit(1 << 40)) < share[F.col("lang")]).select("lang", "h", pack("text").alias("v")).where("v IS NOT NULL").toPandas()
    return chosen.sort_values(["lang", "h"]).groupby("lang").head(per_lang * 3 // 2)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(sample(docs)))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", "score", "rejected")
