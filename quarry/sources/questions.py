"""Question sets: a JSON file, and papers with annotated questions turned into one (SRC-15, SRC-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import question_problems

FIELDS = "id string, question string, sourceFile string, answerSnippet string"
VERSION = 1


def load_question_set(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a file of version 1; every broken rule is named in one error."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"version int, questions array<struct<{FIELDS.replace(' string', ':string')}>>").alias("x")).select("x.*").collect()
    if len(raw) != 1 or raw[0]["version"] != VERSION:
        raise ValueError(f"{path} is no question set of version {VERSION}")
    if raw[0]["questions"] is None:
        raise ValueError(f"{path} has no array of questions")
    rows = spark.createDataFrame([tuple(q) for q in raw[0]["questions"]], FIELDS)
    if problems := question_problems(rows).orderBy("id", "problem").limit(20).collect():
        raise ValueError(f"{path}: " + "; ".join(f"question {p['id']}: {p['problem']}" for p in problems))
    return rows


def _kept(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def paper_text(title: Column, abstract: Column, sections: Column) -> Column:
    """A paper as Markdown: its title, abstract and sections, with a blank line after each part."""
    part = lambda head, body: F.concat(F.when(_kept(head) != "", F.concat(F.lit("## "), _kept(head), F.lit("\n\n"))).otherwise(""), body)
    joined = lambda xs: F.concat_ws("", F.transform(F.filter(xs, lambda p: _kept(p) != ""), lambda p: F.concat(_kept(p), F.lit("\n\n"))))
    about = F.when(_kept(abstract) != "", F.concat(F.lit("## Abstract\n\n"), _kept(abstract), F.lit("\n\n"))).otherwise("")
    body = F.concat_ws("", F.transform(sections, lambda s: part(s["section_name"], joined(s["paragraphs"]))))
    whole = F.concat(F.lit("# "), F.coalesce(title, F.lit("Untitled")), F.lit("\n\n"), about, body)
    return F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n"))


def chosen_papers(papers: DataFrame, limit: int) -> DataFrame:
    """The first papers by id, so a smaller number is a prefix of a larger one (TOP-8); id, body, qas."""
    first = papers.orderBy("id").limit(limit)
    return first.select("id", paper_text(F.col("title"), F.col("abstract"), F.col("full_text")).alias("body"), "qas")


def paper_questions(papers: DataFrame, limit: int) -> DataFrame:
    """id, question, sourceFile, answerSnippet: the longest text evidence of the first answer that has one, if it stands in the paper.

    Unanswerable ones and figures are passed over; of equally long evidence the first counts."""
    rows = chosen_papers(papers, limit).select("id", "body", F.posexplode("qas").alias("at", "qa"))
    text = lambda a: F.filter(a["evidence"], lambda e: (F.trim(e) != "") & ~e.startswith("FLOAT SELECTED"))
    usable = F.filter("qa.answers", lambda a: ~F.coalesce(a["unanswerable"], F.lit(False)) & (F.size(text(a)) > 0))
    rows = rows.select("id", "body", "at", F.col("qa.question_id").alias("question_id"), F.col("qa.question").alias("question"), text(F.get(usable, F.lit(0))).alias("evidence")).where("evidence IS NOT NULL")
    longest = F.array_max(F.transform("evidence", lambda e, i: F.struct(F.length(e).alias("n"), (-i).alias("i"), e.alias("e"))))["e"]
    rows = rows.withColumn("answerSnippet", longest).where(F.contains("body", "answerSnippet"))
    return rows.select(F.coalesce("question_id", F.concat_ws("-", "id", "at")).alias("id"), "question", F.concat("id", F.lit(".txt")).alias("sourceFile"), "answerSnippet")
