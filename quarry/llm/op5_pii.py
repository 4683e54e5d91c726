"""Personal data: exact base spans, and terms that give protected entities away.

Co-occurrence is counted over whole documents, all of them: a term is flagged, at each of its
occurrences in any document, when the smoothed pointwise mutual information with some entity
reaches DISCLOSURE of the entity's information content. The sanitised text has a kind in place of
each base span and a class of words (by its letters' case) in place of each term. Flagged terms of
up to MAX_BYTES are sent to all executors; more are joined with the documents' terms instead.

Null text is empty; repeated rows repeat the result; ids of any type, nulls included, and other
columns are left to Spark; every pattern takes time in proportion to the text; an empty table gives
an empty result. Term spans come after the base kinds.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

DISCLOSURE, SMOOTHING, MAX_BYTES, FLUSH = 0.95, 1.0, 32 << 20, 200_000
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits: the run's start would have matched before
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # the local part is the run before the sign, so one look back replaces a scan from every start
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its base spans blank, at the same positions."""
    out, last = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if b > last:
            a = max(a, last)
            out += [text[last:a], " " * (b - a)]
            last = b
    return "".join(out) + text[last:] if out else text


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping base spans as its kind and each term as a broader class."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= last:
            word = text[a:b]
            label = kind if kind != "term" else "acronym" if word.isupper() else "name" if word[0].isupper() else "word"
            out += [text[last:a], f"[{label.upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def terms_of(rest: str) -> set[str]:
    return set(map(str.lower, set(WORD.findall(rest))))


def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with a term (entity null), with an entity (term null) and with both, added up by batch, some FLUSH counts at a time."""

    def rows(counts: Counter) -> pd.DataFrame:
        out = pd.DataFrame([(e, t, n) for (e, t), n in counts.items()], columns=["entity", "term", "n"])
        counts.clear()
        return out

    for pdf in batches:
        counts: Counter = Counter()
        for text in pdf["text"]:
            spans = base_spans(text or "")
            terms = terms_of(blanked(text or "", spans))
            counts.update([(None, t) for t in terms])
            for e in {f"{k}:{text[a:b].lower()}" for k, a, b in spans}:
                counts.update([(e, None), *((e, t) for t in terms)])
                if len(counts) > FLUSH:
                    yield rows(counts)
        if counts:
            yield rows(counts)


def disclosing(docs: DataFrame, disclosure: float, smoothing: float) -> DataFrame:
    """The terms that give an entity away.

    The share of a term's documents that hold the entity is drawn towards the entity's share p of all
    documents by `smoothing` documents: (both + smoothing * p) / (nt + smoothing). A term discloses
    where log2(share / p) >= disclosure * log2(1 / p)."""
    n_docs = float(max(1, docs.count()))
    counts = stored(docs.select("text").mapInPandas(count, "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n")), "pii-counts")
    entities = counts.where("entity IS NOT NULL AND term IS NULL").select("entity", (F.col("n") / n_docs).alias("p")).where("p < 1")
    terms = counts.where("entity IS NULL").select("term", F.col("n").alias("nt"))
    pairs = counts.where("entity IS NOT NULL AND term IS NOT NULL").select("entity", "term", F.col("n").alias("both"))

    def enough(nt: Column) -> Column:
        return F.log2((F.col("both") + smoothing * F.col("p")) / (nt + smoothing) / F.col("p")) >= -disclosure * F.log2("p")

    # a term has at least as many documents as the pair, so most pairs are out before the join
    pairs = pairs.join(entities, "entity").where(enough(F.col("both")))
    return pairs.join(terms, "term").where(enough(F.col("nt"))).select("term").distinct()


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, sanitised string"


def sanitised(text: str | None, flagged: frozenset[str]) -> tuple:
    """The columns of FIELDS for one text."""
    text = text or ""
    spans = base_spans(text)
    terms: list[tuple[str, int, int]] = []
    if flagged:
        rest = blanked(text, spans)
        if found := flagged & terms_of(rest):
            terms = [("term", *m.span()) for m in WORD.finditer(rest) if m.group().lower() in found]
    n = Counter(s[0] for s in spans)
    return *(n[k] for k in KINDS), hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + terms), masked(text, spans + terms)


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, smoothing: float = SMOOTHING, max_bytes: int = MAX_BYTES) -> DataFrame:
    flagged = stored(disclosing(docs, disclosure, smoothing), "pii-terms")
    names = [x.split()[0] for x in FIELDS.split(", ")]
    if (flagged.select(F.sum(F.octet_length("term") + 80)).first()[0] or 0) <= max_bytes:
        every = frozenset(r[0] for r in flagged.collect())

        @F.pandas_udf(FIELDS)
        def scan(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([sanitised(t, every) for t in texts], columns=names)

        return docs.select("doc_id", scan("text").alias("_found")).select("doc_id", "_found.*")

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(terms_of(blanked(t or "", base_spans(t or "")))) for t in texts], dtype=object)

    @F.pandas_udf(FIELDS)
    def scan_own(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sanitised(t, frozenset(() if o is None else o)) for t, o in zip(texts, own, strict=True)], columns=names)

    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "pii-rows")
    own = rows.select("row", F.explode(terms("text")).alias("term")).join(flagged, "term").groupBy("row").agg(F.collect_list("term").alias("own"))
    return rows.join(own, "row", "left").select("doc_id", scan_own("text", "own").alias("_found")).select("doc_id", "_found.*")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(read(spark, sf_dir, "documents")).drop("sanitised")
