"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that keyword scoring leaves out.
STOP = (
    "a an and are as at be but by can did do does for from had has have he her his how i if in into is it its me my "
    "of on or our she so some than that the their them then there these they this to was we were what when where which who why "
    "will with would you your"
).split()
# The words that the wording check leaves out.
QUESTION_STOP = "a an and are as at be by did do does for from had has have how in is it its of on or over that the their this to was were what when where which who why with".split()


def normalise(text: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, trimmed (FLT-5)."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once a row: an expression that stands in a lambda or in several places is computed again each time."""
    return F.transform(F.array(value), then)[0]


def contains_normal(text: Column, snippet: Column) -> Column:
    """Whole-word containment of a text by another, both normalised; an empty one is never contained."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (snippet != "") & (F.instr(pad(text), pad(snippet)) > 0)


def contains_snippet(text: Column, snippet: Column) -> Column:
    """Whole-word containment (FLT-6); an empty snippet is never contained."""
    return once(normalise(snippet), lambda s: contains_normal(normalise(text), s))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def markdown_plain(md: Column) -> Column:
    """Heading and list markers off (TXT-3)."""
    return F.regexp_replace(F.regexp_replace(md, r"(?m)^#{1,6}[ \t]+", ""), r"(?m)^[ \t]*-[ \t]+", "")


def keyword_terms(text: Column) -> Column:
    """Keyword tokens with one suffix rule (TXT-15)."""
    raw = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(STOP))

    def trim(t: Column) -> Column:
        n, cut = F.length(t), lambda k: F.substring(t, F.lit(1), F.length(t) - k)
        rules = F.when(t.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        for ending, least, k in (("ing", 4, 3), ("ed", 3, 2), ("es", 3, 2)):
            rules = rules.when(t.endswith(ending) & (n > least), cut(k))
        return rules.when(t.endswith("s") & ~t.endswith("ss") & (n > 3), cut(1)).otherwise(t)

    return F.transform(raw, trim)


def context_header(file: Column, posted: Column, section: Column, dates: Column | None = None) -> Column:
    """Bracketed header without its empty parts; empty if all are (TXT-14). dates: an array of strings."""
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    listed = [] if dates is None else [part("Dates", F.array_join(dates, ", "))]
    inner = F.concat_ws(" | ", part("File", file), part("Posted", posted), part("Section", section), *listed)
    return F.when(inner == "", "").otherwise(F.concat(F.lit("["), inner, F.lit("]")))


def normalise_markdown(md: Column) -> Column:
    """Authored Markdown to the shared form, rule by rule in a fixed order (TXT-2)."""
    # What each rule finds and leaves.
    rules = [
        (r"\r\n?", "\n"), (r"(?s)```.*?```", ""), (r"`([^`]+)`", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^[ \t]{0,3}>[ \t]?", ""), (r"(?m)^[ \t]{0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$", ""), (r"(?m)^([ \t]*)[*+]([ \t]+)", "$1-$2"),
        (r"(\*\*|__)(.+?)\1", "$2"), (r"(?<![\w*])\*(?!\s)(.+?)(?<!\s)\*(?![\w*])", "$1"), (r"(?<!\w)_(?!\s)(.+?)(?<!\s)_(?!\w)", "$1"),
        (r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$\n?", ""),
    ]
    for found, left in rules:
        md = F.regexp_replace(md, found, left)
    row = r"^[ \t]*\|(.*)\|[ \t]*$"
    cells = lambda x: F.array_join(F.transform(F.split(F.regexp_extract(x, row, 1), r"\|"), lambda c: F.trim(c)), " | ")
    md = F.array_join(F.transform(F.split(md, "\n"), lambda x: F.when(x.rlike(row), cells(x)).otherwise(x)), "\n")
    for found, left in ((r"<[^>]+>", " "), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        md = F.regexp_replace(md, found, left)
    return md


def summarise_error(message: Column) -> Column:
    """One line of an error without stack, box drawing and a leading `Error`, at most 160 characters (SRC-13)."""
    line = F.regexp_replace(F.coalesce(message, F.lit("")), r"(?s)(?:</>\s*STACK TRACE|\n\s*at\s).*$", "")
    line = F.regexp_replace(F.regexp_replace(line, "[\u2500-\u257f]", " "), r"^\s*Error\b", " ")
    line = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(line == "", "unknown error").when(F.length(line) > 160, F.concat(F.substring(line, 1, 159), F.lit("\u2026"))).otherwise(line)


def relative_path(root: str, path: Column) -> Column:
    """The path below the root with forward slashes; null outside the root (FLT-10)."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    inner = F.when(posix.startswith(base), F.substring(posix, F.lit(len(base) + 1), F.length(posix)))
    return F.when(inner.rlike(r"^(?:\.\.(?:/|$)|/|[A-Za-z]:)") | (inner == ""), None).otherwise(inner)


def chunk_key(shard: Column, chunk_id: Column) -> Column:
    return F.concat_ws("/", shard, chunk_id)


def prefixed(model: str, text: Column, side: str) -> Column:
    """The text as a model that tells documents from queries wants it embedded (TXT-23)."""
    if "nomic-embed" not in model.lower():
        return text
    return F.concat(F.lit({"document": "search_document: ", "query": "search_query: "}[side]), text)


def finite_vector(raw: Column) -> Column:
    """array<double>, or an error on a null, NaN or infinite value (TXT-22, SUB-30)."""
    v = raw.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("an embedding holds a value that isn't finite")).cast("array<double>")).otherwise(v)


def rendered(header: Column, text: Column) -> Column:
    """A passage as the prompt shows it (TXT-24)."""
    return F.concat_ws("\n", F.nullif(header, F.lit("")), text)


def shortened(text: Column, lines: int = 3, chars: int = 400) -> Column:
    """The first lines that aren't blank, with an ellipsis where that isn't all (TXT-25)."""
    full = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    cut = F.substring(F.array_join(F.slice(full, 1, lines), "\n"), 1, chars)
    return F.when((F.size(full) > lines) | (F.length(text) > F.length(cut)), F.concat(F.rtrim(cut), F.lit("\u2026"))).otherwise(cut)


def three_decimals(x: Column) -> Column:
    """Three decimals of the exact binary value, an exact tie to the even digit, as printf has it; format_string rounds the shortest decimal form up."""
    x = x.cast("double")
    whole = F.floor(F.abs(x))
    part = F.abs(x) - whole.cast("double")
    n = F.floor(part * 1000)
    # 125 x part less the tie's (2n + 1) / 16, in two halves of few bits, so that no step but the last one rounds
    high = F.floor(part * 2**26).cast("double") / 2**26
    over = (high * 125 - (n * 2 + 1) / F.lit(16.0)) + (part - high) * 125
    n = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    shown = F.concat(sign, (whole + F.when(n == 1000, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    return F.when(F.abs(x) < 2.0**62, shown).when(x.isNotNull(), F.replace(F.lower(F.format_string("%.3f", x)), F.lit("infinity"), F.lit("inf")))


def match_label(position: Column, lanes: Column, score: Column) -> Column:
    """How a passage was found (TXT-26)."""
    # The names of the lanes.
    names = F.create_map(*[F.lit(x) for x in ("vector", "meaning", "hyde", "likely wording", "keyword", "keywords", "date", "dates")])
    via = F.array_join(F.transform(lanes, lambda x: F.coalesce(names[x], x)), ", ")
    return F.when(F.size(F.coalesce(lanes, F.array())) == 0, F.concat(F.lit("score: "), three_decimals(score))).otherwise(F.concat(F.lit("match #"), position.cast("string"), F.lit(" via "), via))
