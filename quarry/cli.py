"""Commands: index a folder, report its structure, generate a question set, evaluate (ORC-10).

python -m quarry.cli index DOCS STORE [--rebuild]
python -m quarry.cli report DOCS
python -m quarry.cli generate STORE QUESTIONS --answers FILE
python -m quarry.cli evaluate DOCS STORE QUESTIONS
Settings come from QUARRY_* variables."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import subprocess
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import jobs, report
from .operators import evaluation
from .settings import evaluation_settings, generation_settings, indexing_settings, resource_problems
from .sources import documents, files, questions
from .store import ChunkStore, JsonFiles


def path_ignored(path: str) -> bool:
    """Whether git ignores the path; not, where git can't say (ORC-14)."""
    try:
        return subprocess.run(["git", "check-ignore", "-q", path], cwd=os.path.dirname(os.path.abspath(path)) or ".", capture_output=True, timeout=10).returncode == 0
    except (OSError, subprocess.SubprocessError):
        return False


def check_machine(folder: str) -> None:
    """Stops where disk or memory won't do, and says what is short."""
    free = shutil.disk_usage(folder if os.path.isdir(folder) else ".").free / 1e9
    memory = os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") / 1e9 if hasattr(os, "sysconf") else 99.0
    problems = resource_problems(free, memory, sys.platform == "darwin")
    for level, text in problems:
        print(f"{level}: {text}", file=sys.stderr)
    if any(level == "error" for level, _ in problems):
        raise SystemExit(1)


def index(spark: SparkSession, a: argparse.Namespace) -> dict:
    check_machine(os.path.dirname(os.path.abspath(a.store)))
    return jobs.index(spark, a.docs, a.store, indexing_settings(os.environ), mode="rebuild" if a.rebuild else "changed")


def structure(spark: SparkSession, a: argparse.Namespace) -> dict:
    s = indexing_settings(os.environ)
    listed = files.scan(spark, a.docs, s.exclude).where("excluded_by IS NULL")
    parsed = documents.parse_files(files.with_content(spark, listed, a.docs))
    rows = report.structure_report(parsed.where("text IS NOT NULL").select(F.col("path").alias("doc_id"), "file_name", "mtime", "text"), s.chunk_size, s.chunk_overlap)
    return report.totals(rows).first().asDict() | {"failed": parsed.where("text IS NULL").count()}


def generate(spark: SparkSession, a: argparse.Namespace, answer: Callable[[str, int], str] | None = None) -> dict:
    """The answers come from a function, or from a file with one JSON answer a line, asked for in turn."""
    g = generation_settings(os.environ)
    if answer is None:
        with open(a.answers) as f:
            lines = iter(f.read().splitlines())
        answer = lambda prompt, attempt: next(lines, "")
    rows, dropped = evaluation.generate_questions(ChunkStore(spark, a.store).listed().select("file_path", "key", "text"), answer, int(g["seed"]), int(g["count"]), g["leak_limit"])
    if not path_ignored(a.questions):
        print(f"note: git would take up {a.questions}, which quotes the documents", file=sys.stderr)
    folder, name = os.path.split(os.path.abspath(a.questions))
    JsonFiles(folder).write_new(name, {"version": questions.VERSION, "generator": g, "questions": [r.asDict() for r in rows.collect()]})
    return {"questions": rows.count(), "dropped": dropped}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> str:
    found = jobs.run_evaluation(ChunkStore(spark, a.store), questions.load_question_set(spark, a.questions), a.docs, evaluation_settings(os.environ))
    return jobs.metrics_table(found["metrics"])


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(required=True)
    for name, run, places in (("index", index, ("docs", "store")), ("report", structure, ("docs",)), ("generate", generate, ("store", "questions")), ("evaluate", evaluate, ("docs", "store", "questions"))):
        p = sub.add_parser(name)
        for x in places:
            p.add_argument(x)
        p.set_defaults(run=run)
        if name == "index":
            p.add_argument("--rebuild", action="store_true")
        if name == "generate":
            p.add_argument("--answers", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    out = a.run(spark, a)
    print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=1))


if __name__ == "__main__":
    main()
