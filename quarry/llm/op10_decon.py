"""Benchmark decontamination with a positional inverted index (DataFrame functions only).

Documents and items are cut into words once and stored under a row key of their own, so rows that
share an id, or have none, stay apart. Corpus counts of the test terms order them; of every 10-word
window the three rarest are indexed: the index holds (term, document, position) for each of their
occurrences and is written to the shared folder. Phrases come from the rarest list: its positions,
less the term's offset, are intersected with the second and the third list so adjusted, and what
is left is compared with the words of the document. Proximity matches come from the same kind of
index: of every 20 words of an item (stepping by 10) the 8 rarest terms, 5 of which must occur
within 30 words of a document, in any order.

Null or wordless texts and items never match; an item of fewer than 10 words is one window; a null
item_id hits words but is no item; repeated rows repeat the result, each from its own text; empty
tables give none; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

WIDTH, MAX_BROADCAST_BYTES = 10, 32 << 20
SEGMENT, STEP, RARE, LEAST, SPAN = 20, 10, 8, 5, 30
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UP, LOW))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")


def tokenised(df: DataFrame, key: str) -> DataFrame:
    """row, key, toks, n_words; stored, which fixes the row keys."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(df["text"]).alias("toks"))
    return stored(rows.withColumn("n_words", F.size("toks").cast("long")), "decon-tokens")


def small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its rows take at most MAX_BROADCAST_BYTES in memory."""
    text = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    size = df.select(F.sum(sum(text, F.lit(32 + 16 * len(df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df


def ordered_terms(tokens: DataFrame, items: DataFrame) -> DataFrame:
    """item, toks, ranked: of every item with words, its places as (documents' count of the term, term, place)."""
    vocabulary = stored(items.select(F.explode("toks").alias("term")).distinct(), "decon-vocabulary")
    counts = tokens.select(F.explode("toks").alias("term")).join(small(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    places = items.select(F.col("row").alias("item"), F.posexplode("toks").alias("j", "term")).join(small(stored(counts, "decon-counts")), "term", "left")
    ranked = places.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("places"))
    ranked = ranked.select("item", F.transform("places", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term"), x["j"].alias("j"))).alias("ranked"))
    return stored(ranked, "decon-ranked")


def index(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, row, pos) of every occurrence of the stored terms(term, t)."""
    found = tokens.select("row", F.posexplode("toks").alias("pos", "term")).join(small(terms), "term")
    return stored(found.select("t", "row", "pos"), "decon-index")


def numbered(terms: DataFrame) -> DataFrame:
    return stored(terms.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "decon-terms")


def matches(tokens: DataFrame, items: DataFrame, ranked: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row, item, lo, hi): every occurrence of a window, as word positions of the document, inclusive."""
    n = F.size("ranked")
    w = F.least(n, F.lit(width))
    plan = ranked.select("item", "ranked", w.alias("w"), F.explode(F.sequence(F.lit(0), n - w)).alias("s"))
    plan = plan.select("item", "s", "w", F.array_sort(F.slice("ranked", F.col("s") + 1, F.col("w"))).alias("r"))
    # a term that the corpus lacks cannot match, nor can its windows
    plan = plan.where(F.col("r")[0]["n"] > 0)
    at = lambda k: F.coalesce(F.get("r", F.lit(k)), F.col("r")[0])
    plan = stored(plan.select("item", "s", "w", *[at(k)[x].alias(f"{x}{k}") for k in range(3) for x in ("term", "j")]), "decon-plan")
    terms = numbered(plan.select(F.explode(F.array("term0", "term1", "term2")).alias("term")))
    for k in range(3):
        plan = plan.join(small(terms.select(F.col("term").alias(f"term{k}"), F.col("t").alias(f"t{k}"))), f"term{k}").drop(f"term{k}")
    plan = stored(plan, "decon-plan")
    postings = index(tokens, terms)

    def also(found: DataFrame, k: int) -> DataFrame:
        """Of found(row, d, ...) what the k-th list has at its place, too."""
        own = postings.select(F.col("t").alias(f"t{k}"), F.col("row"), F.col("pos").alias("p"))
        return found.withColumn("p", F.col("d") + F.col(f"j{k}")).join(own, [f"t{k}", "row", "p"], "left_semi").drop("p")

    pairs = stored(plan.select("item", "t0", "j0", "t1", "j1").distinct(), "decon-pairs")
    found = postings.withColumnRenamed("t", "t0").join(small(pairs), "t0").select("row", "item", "j0", "j1", "t1", (F.col("pos") - F.col("j0")).alias("d"))
    found = stored(also(found, 1).select("row", "item", "j0", "j1", "d"), "decon-both")
    found = found.join(small(plan.select("item", "s", "w", "j0", "j1", "j2", "t2")), ["item", "j0", "j1"]).where(F.col("d") + F.col("s") >= 0)
    found = stored(also(found, 2).select("row", "item", "s", "w", "d").distinct(), "decon-found")
    wanted = found.select("row").distinct()
    texts = tokens.select("row", "toks").join(small(stored(wanted, "decon-rows")), "row", "left_semi")
    whole = small(stored(items.select(F.col("row").alias("item"), F.concat_ws(" ", "toks").alias("own")), "decon-items"))
    near = found.join(whole, "item").join(texts, "row")
    lo = F.col("d") + F.col("s")
    equal = F.concat_ws(" ", F.slice("toks", lo + 1, F.col("w"))) == F.concat_ws(" ", F.slice(F.split("own", " "), F.col("s") + 1, F.col("w")))
    return near.where(equal).select("row", "item", lo.alias("lo"), (lo + F.col("w") - 1).alias("hi"))


def near_matches(tokens: DataFrame, ranked: DataFrame, segment: int = SEGMENT, step: int = STEP, rare: int = RARE, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """(row, item, s, lo, hi, n_terms): places where `least` of the `rare` rarest distinct terms of the item's words from s on stand within `span` words.

    Items of fewer than `least` distinct terms have none. lo is the first word of a place, hi its
    last term's; overlapping places are all returned."""
    n = F.size("ranked")
    cuts = ranked.select("item", "ranked", F.explode(F.sequence(F.lit(0), F.greatest(n - segment + step - 1, F.lit(0)), F.lit(step))).alias("s"))
    own = F.transform(F.slice("ranked", F.col("s") + 1, segment), lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term")))
    cuts = cuts.select("item", "s", F.slice(F.array_sort(F.array_distinct(own)), 1, rare).alias("r")).where(F.size("r") >= least)
    plan = stored(cuts.select("item", "s", F.explode("r").alias("r")).where(F.col("r")["n"] > 0).select("item", "s", F.col("r")["term"].alias("term")), "near-plan")
    terms = numbered(plan)
    plan = stored(plan.join(small(terms), "term").select("t", "item", "s"), "near-plan")
    postings = index(tokens, terms)
    # the lists of a segment meet in the documents that have enough of its terms
    some = postings.select("t", "row").distinct().join(small(plan), "t").groupBy("item", "s", "row").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).drop("k")
    some = stored(some, "near-rows")
    places = postings.join(small(plan), "t").join(some, ["item", "s", "row"])
    ahead = Window.partitionBy("item", "s", "row").orderBy("pos").rangeBetween(0, span - 1)
    places = places.select("row", "item", "s", F.col("pos").alias("lo"), F.max("pos").over(ahead).alias("hi"), F.size(F.collect_set("t").over(ahead)).cast("long").alias("n_terms"))
    return places.where(F.col("n_terms") >= least)


def hits(tokens: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """(row, n_hit, items) of every document with a match."""
    found = stored(found.distinct(), "decon-runs")
    over = Window.partitionBy("row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "lo", "hi").distinct().withColumn("seen", F.coalesce(F.max("hi").over(over), F.lit(-1)))
    n_hit = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.col("seen") + 1) + 1)).cast("long").alias("n_hit"))
    names = small(stored(items.select(F.col("row").alias("item"), F.col("key").cast("string").alias("name")), "decon-names"))
    own = found.select("row", "item").distinct().join(names, "item").groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("items"))
    return n_hit.join(own, "row")


def contaminated(docs: DataFrame, bench: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(row, key, n_words, n_hit, items): every row of docs; items null where no window occurs."""
    tokens, items = tokenised(docs, key), tokenised(bench, "item_id").where("n_words > 0")
    found = hits(tokens, items, matches(tokens, items, ordered_terms(tokens, items), width))
    return tokens.select("row", "key", "n_words").join(found, "row", "left")


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    out = contaminated(docs, bench, "doc_id", width)
    return out.select(
        F.col("key").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def proximity(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, s, lo, hi, n_terms) of the proximity matches, phrases among them."""
    tokens, items = tokenised(docs, "doc_id"), tokenised(bench, "item_id").where("n_words > 0")
    found = near_matches(tokens, ordered_terms(tokens, items))
    names = items.select(F.col("row").alias("item"), F.col("key").alias("item_id"))
    return found.join(tokens.select("row", F.col("key").alias("doc_id")), "row").join(names, "item").select("doc_id", "item_id", "s", "lo", "hi", "n_terms")


def op10_decon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n, array_to_string(list_slice(w, s + 1, s + {WIDTH}), ' ') AS t
        FROM (SELECT *, unnest(range(0, greatest(len(w) - {WIDTH - 1}, 1))) AS s FROM b WHERE len(w) > 0)),
here AS (SELECT r, s, n, array_to_string(list_slice(w, s + 1, s + n), ' ') AS t FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, s, n, item_id FROM here JOIN win USING (t, n)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
