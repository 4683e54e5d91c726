"""The chunk store: Parquet in buckets of files, with a state file that says which folders count.

A change writes the buckets it touches into a folder of its own and then replaces the state, so
readers see all of it or nothing, and a run that dies leaves the store as it was (SNK-1..4, INC-3, 4)."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from functools import cached_property

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import indexing

SCHEMA = (
    "key string, file_path string, file_name string, file_hash string, chunk_index int, text string, vector array<double>, context_header string, "
    "section_path string, posted_date string, dates string, start_index int, end_index int"
)
SHARD_ROWS, BUCKETS, MANIFEST_VERSION, CATALOG_VERSION = 10_000, 64, 1, 1
STRUCTURED, LEGACY = "structured-1", "legacy"


def prefix_convention(model: str) -> str:
    return "nomic" if "nomic-embed" in model.lower() else "none"


class JsonFiles:
    """Small JSON files beside the data, on any file system that pyarrow reaches."""

    def __init__(self, root: str):
        self.root = root if "://" in root else f"file://{os.path.abspath(root)}"

    @cached_property
    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def read(self, name: str) -> dict | None:
        """None where the file is missing or no JSON object."""
        store, base = self._store
        try:
            with store.open_input_stream(f"{base}/{name}") as f:
                out = json.loads(f.read().decode())
        except (OSError, ValueError):
            return None
        return out if isinstance(out, dict) else None

    def write(self, name: str, value: dict) -> None:
        store, base = self._store
        store.create_dir(os.path.dirname(f"{base}/{name}"))
        tmp = f"{base}/.{uuid.uuid4().hex}"
        with store.open_output_stream(tmp) as f:
            f.write(json.dumps(value, ensure_ascii=False, indent=1).encode())
        store.move(tmp, f"{base}/{name}")

    def write_new(self, name: str, value: dict) -> None:
        """As write, but an existing file is an error (SNK-7)."""
        store, base = self._store
        if store.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.root}/{name}")
        self.write(name, value)

    def delete(self, name: str) -> None:
        store, base = self._store
        if store.get_file_info(f"{base}/{name}").type == fs.FileType.File:
            store.delete_file(f"{base}/{name}")


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.files = spark, JsonFiles(root)
        state = self.files.read("state.json")
        self.n_buckets = state["n_buckets"] if state else buckets

    def _state(self) -> dict[str, str]:
        return (self.files.read("state.json") or {"folders": {}})["folders"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("file_path"), F.lit(self.n_buckets)).cast("int")

    def _load(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.files.root}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def chunks(self) -> DataFrame:
        return self._load(self._state())

    def listed(self) -> DataFrame:
        """Chunks that have a path and a text, without vectors (FLT-1)."""
        return self.chunks().where("file_path IS NOT NULL AND text IS NOT NULL").drop("vector")

    def _replace(self, touched: list[int], rows: DataFrame) -> None:
        """The touched buckets become these rows."""
        folder = uuid.uuid4().hex
        path = f"{self.files.root}/data/{folder}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.option("maxRecordsPerFile", SHARD_ROWS).partitionBy("bucket").parquet(path)
        store, base = fs.FileSystem.from_uri(path)
        there = {x.base_name.removeprefix("bucket=") for x in store.get_file_info(fs.FileSelector(base)) if x.base_name.startswith("bucket=")}
        state = {b: f for b, f in self._state().items() if int(b) not in touched} | dict.fromkeys(there, folder)
        self.files.write("state.json", {"n_buckets": self.n_buckets, "folders": state})

    def upsert(self, new: DataFrame, gone: DataFrame | None = None) -> None:
        """Puts the chunks in the place of all earlier ones of their files, and of those of gone(file_path)."""
        new = self._typed(new)
        paths = new.select("file_path").distinct()
        paths = paths.union(gone.select("file_path")).distinct() if gone is not None else paths
        touched = [r[0] for r in paths.select(self._bucket().alias("b")).distinct().collect()]  # at most n_buckets
        if touched:
            old = self._load({b: f for b, f in self._state().items() if int(b) in touched})
            self._replace(touched, old.join(paths, "file_path", "left_anti").select(*new.columns).unionByName(new))

    def _typed(self, rows: DataFrame) -> DataFrame:
        kinds = [x.rsplit(" ", 1) for x in SCHEMA.split(", ")]
        return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])

    def delete_hashes(self, hashes: DataFrame) -> None:
        """Removes every chunk of hashes(file_hash), all in one pass (SNK-2)."""
        hashes = hashes.select("file_hash").distinct()
        hit = self.chunks().join(hashes, "file_hash", "left_semi").select(self._bucket().alias("b")).distinct()
        if touched := [r[0] for r in hit.collect()]:
            self._replace(touched, self._typed(self._load({b: f for b, f in self._state().items() if int(b) in touched}).join(hashes, "file_hash", "left_anti")))

    def stats(self) -> DataFrame:
        """total_chunks, unique_files: distinct hashes that aren't empty (AGG-1)."""
        return self.chunks().agg(F.count(F.lit(1)).alias("total_chunks"), F.countDistinct(F.nullif("file_hash", F.lit(""))).alias("unique_files"))

    def inventory(self) -> DataFrame:
        """(file_path, file_hash), distinct (AGG-2)."""
        return self.chunks().select("file_path", "file_hash").distinct()

    def has_file(self, file_hash: str) -> bool:
        return not self.chunks().where(F.col("file_hash") == file_hash).limit(1).isEmpty()

    def vacuum(self) -> None:
        """Deletes folders that the state doesn't name; not while others read."""
        store, base = fs.FileSystem.from_uri(f"{self.files.root}/data")
        keep = set(self._state().values())
        for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if x.base_name not in keep:
                store.delete_dir(x.path)

    # the manifest says how the vectors were made
    def manifest(self) -> dict | None:
        """None if missing or invalid; an unknown format is legacy, an unknown prefix none (SRC-18)."""
        m = self.files.read("manifest.json")
        if not m or not isinstance(m.get("model"), str) or not m["model"] or not isinstance(m.get("dimensions"), int) or m["dimensions"] < 1:
            return None
        return m | {"format": m.get("format") if m.get("format") == STRUCTURED else LEGACY, "prefixes": m.get("prefixes") if m.get("prefixes") == "nomic" else "none"}

    def sync_manifest(self, model: str, dimensions: int, structured: bool = True) -> None:
        """Writes the manifest, or deletes it where the store is empty (SNK-3)."""
        if self.chunks().isEmpty():
            self.files.delete("manifest.json")
        else:
            self.files.write("manifest.json", {"version": MANIFEST_VERSION, "model": model, "dimensions": dimensions, "format": STRUCTURED if structured else LEGACY, "prefixes": prefix_convention(model)})

    def check_model(self, model: str, dimensions: int) -> str | None:
        """Why this store can't be searched with the model, or None (FLT-11)."""
        if self.chunks().isEmpty():
            self.files.delete("manifest.json")
            return None
        m, wanted = self.manifest(), prefix_convention(model)
        if m is None:
            return "the index has no manifest, so its texts were embedded without prefixes, which this model expects; reindex" if wanted != "none" else None
        if m["model"] != model:
            return f"the index was built with {m['model']}, the settings name {model}; reindex or change the setting"
        if m["prefixes"] != wanted:
            return f"the index was built with prefixes {m['prefixes']}, {model} expects {wanted}; reindex"
        return f"the index holds vectors of length {m['dimensions']}, {model} returns {dimensions}; reindex" if m["dimensions"] != dimensions else None

    def plan_format(self, structured: bool, model: str) -> tuple[str, bool]:
        """(format, whether files must be rebuilt): if the format, the prefixes or the model changed (INC-2)."""
        wanted = STRUCTURED if structured else LEGACY
        if self.chunks().isEmpty():
            return wanted, False
        m = self.manifest() or {}
        return wanted, (m.get("format", LEGACY), m.get("prefixes", "none"), m.get("model", model)) != (wanted, prefix_convention(model), model)

    def format_message(self, structured: bool) -> str | None:
        """What a change of format asks for; chunks without a manifest are legacy (FLT-12)."""
        m = self.manifest()
        if m is None and self.chunks().isEmpty():
            return None
        have, wanted = (m or {}).get("format", LEGACY), STRUCTURED if structured else LEGACY
        return None if have == wanted else f"Reindex required to {'switch back to standard' if wanted == LEGACY else 'apply structured'} indexing."

    # the catalog of days is derived from the chunks
    def save_catalog(self) -> None:
        folder = f"catalog-{uuid.uuid4().hex}"
        indexing.catalog(self.chunks()).write.parquet(f"{self.files.root}/{folder}")
        self.files.write("catalog.json", {"version": CATALOG_VERSION, "chunks": self.chunks().count(), "folder": folder})

    def catalog(self) -> DataFrame:
        """The saved (key, day), or a plan over the chunks if none fits their count (SRC-19, INC-5)."""
        c = self.files.read("catalog.json")
        if c and c.get("version") == CATALOG_VERSION and c.get("chunks") == self.chunks().count():
            return self.spark.read.schema("key string, day int").parquet(f"{self.files.root}/{c['folder']}")
        return indexing.catalog(self.chunks())

    # failures are events: the last one of a path counts
    def record_failures(self, rows: DataFrame) -> None:
        """rows(file_path, file_hash, reason); a null reason clears the path (SNK-5)."""
        rows.select("file_path", "file_hash", "reason", F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(f"{self.files.root}/failures")

    def failures(self) -> DataFrame:
        kind = "file_path string, file_hash string, reason string, at long"
        store, base = fs.FileSystem.from_uri(f"{self.files.root}/failures")
        there = store.get_file_info(base).type == fs.FileType.Directory
        return indexing.last_failures(self.spark.read.schema(kind).parquet(f"{self.files.root}/failures") if there else self.spark.createDataFrame([], kind))

    def write_failure_report(self, summary: dict, results: DataFrame) -> None:
        """The summary and the count of each reason as JSON (SNK-6, AGG-8)."""
        counts = {r["reason"]: r["n"] for r in reason_counts(results).collect()}  # one row a reason
        self.files.write("failure-report.json", summary | {"reasons": counts})


def reason_counts(results: DataFrame) -> DataFrame:
    return results.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


class RunLock:
    """One indexing run a process (INC-7)."""

    _lock = threading.Lock()

    def __enter__(self):
        if not self._lock.acquire(blocking=False):
            raise RuntimeError("an indexing run is already under way")
        return self

    def __exit__(self, *_):
        self._lock.release()
