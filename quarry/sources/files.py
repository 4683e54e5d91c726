"""Folder scan: binaryFile with an extension registry and exclude globs (SRC-1..3)."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported extensions by kind.
GROUPS = {
    "html": "htm html xhtml".split(), "markdown": "md markdown mdown mdx mkd mkdn".split(), "text": "txt text".split(), "pdf": ["pdf"], "epub": ["epub"],
    "image": "bmp jpg jpeg png".split(), "archive": ["rar"], "pptx": ["pptx"], "docx": ["docx"],
}
EXTENSIONS = sorted(e for es in GROUPS.values() for e in es)


def exclude_patterns(text: str | None, separator: str = "\n") -> list[str]:
    """One glob a line (or between separators), without blank ones and comments."""
    return [p for x in re.split(r"\r?\n", (text or "").replace(separator, "\n")) if (p := x.strip()) and not p.startswith("#")]


def _braces(glob: str) -> list[str]:
    """A glob's alternatives: {a,b} written out."""
    m = re.search(r"\{([^{}]*,[^{}]*)\}", glob)
    return [y for x in m[1].split(",") for y in _braces(glob[: m.start()] + x + glob[m.end() :])] if m else [glob]


def glob_regex(glob: str) -> str:
    """The regular expression of a path glob: * and ? stay within a name, ** spans folders, [...] is a class."""
    out, parts = [], glob.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        piece, k = "", 0
        while k < len(part):
            c = part[k]
            end = part.find("]", k + 2)
            if c == "*":
                piece += "[^/]*"
                while k + 1 < len(part) and part[k + 1] == "*":
                    k += 1
            elif c == "?":
                piece += "[^/]"
            elif c == "[" and end > 0:
                inner = part[k + 1 : end]
                piece += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
                k = end
            else:
                piece += re.escape(c)
            k += 1
        out.append(piece if last else piece + "/")
    return "".join(out)


def excluded_by(relative: Column, patterns: list[str]) -> Column:
    """The first pattern that matches the whole relative path, or the base name if it has no slash; null if none does."""
    base = F.element_at(F.split(relative, "/"), -1)
    hits = []
    for p in patterns:
        posix = p.replace("\\", "/")
        regex = "|".join(f"(?:{glob_regex(g)})" for g in _braces(posix))
        hits.append(F.when((relative if "/" in posix else base).rlike(f"^(?:{regex})$"), F.lit(p)))
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def scan(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """path, relative_path, file_name, extension, size, mtime, excluded_by: supported files, without their contents.

    Names are filtered while files are listed; a missing root is an error, files that go meanwhile are
    skipped. `with_content` reads what is left."""
    if "://" not in root and not os.path.isdir(root):
        raise FileNotFoundError(f"the documents folder {root} doesn't exist or can't be read")
    either = lambda e: "".join(f"[{c}{c.upper()}]" for c in e)
    names = "*.{" + ",".join(map(either, EXTENSIONS)) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).option("ignoreMissingFiles", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    base = re.sub(r"^\w+:/+", "/", root).rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^\w+:/+", "/")
    relative = F.when(plain.startswith(base), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(name)
    df = df.select("path", relative.alias("relative_path"), name.alias("file_name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return df.withColumn("excluded_by", excluded_by(F.col("relative_path"), list(exclude)))


def with_content(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """files with content and file_hash. Spark's reader reads every file of the folder and the join keeps the listed ones;
    a file of over 2 GB fails it."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root).select("path", "content")
    return read.join(files, "path").withColumn("file_hash", F.sha2("content", 256))


def size_estimate(files: DataFrame, samples: int = 100) -> DataFrame:
    """(files, bytes): the mean size of up to `samples` files times their number (AGG-14)."""
    some = files.select("size").limit(samples).agg(F.avg("size").alias("mean"))
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(some).select("files", F.coalesce(F.col("mean") * F.col("files"), F.lit(0.0)).cast("long").alias("bytes"))
