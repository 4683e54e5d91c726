"""Date extraction from text and questions; one source for driver calls and batch UDFs (TXT-16..21)."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DIGIT = re.compile(r"\d", re.A)  # every kind of date has one
# How each kind of date is written, in the order the rules are tried.
_ISO = re.compile(r"(?<![\w./-])(?P<y>\d{4})[-/](?P<m>\d{1,2})[-/](?P<d>\d{1,2})(?![\w%]|[./-]\d)", re.A)
_COMPACT = re.compile(r"(?<!\d)(?P<y>(?:19|20)\d{2})(?P<m>\d{2})(?P<d>\d{2})(?!\d)", re.A)
_NUMERIC = re.compile(r"(?<![\w./$-])(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?![\w%]|[./-]\d)", re.A)
_QUARTER = re.compile(r"(?<!\w)(?:Q([1-4])[\s-]*(\d{4})|(\d{4})[\s-]*Q([1-4]))(?!\w)", re.I | re.A)
_DAY_MONTH = re.compile(rf"(?<!\w)(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+(?P<month>{_MONTH})\.?(?:,?\s+(?P<y>\d{{4}})|-(?P<yy>\d{{2}}))?(?!\w)", re.I | re.A)
_MONTH_DAY = re.compile(rf"(?<!\w)(?P<month>{_MONTH})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(?P<y>\d{{4}}))?(?P<yy>(?!))?(?!\w)", re.I | re.A)
_MONTH_YEAR = re.compile(rf"(?<!\w)(?P<month>{_MONTH})\.?,?\s+(?P<y>\d{{4}})(?!\w)", re.I | re.A)
_BARE_DAY_MONTH = re.compile(rf"(?<!\w)(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+(?P<month>{_MONTH})\.?(?![\s-]*\d{{4}})(?!\w)", re.I | re.A)
_BARE_MONTH_DAY = re.compile(rf"(?<!\w)(?P<month>{_MONTH})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?![,\s]*\d{{4}})(?!\w)", re.I | re.A)
_BARE_YEAR = re.compile(r"(?<![\w.$-])(?:fy\s*|fiscal\s+(?:year\s+)?)?((?:19|20)\d{2})(?![\w.%-])", re.I | re.A)
_MONEY_BEFORE = re.compile(r"(?:\$|usd|eur|gbp|versions?)\s*$", re.I)
_MONEY_AFTER = re.compile(r"\s*(?:dollars|usd|eur|euros|gbp|pounds)\b", re.I)
AMBIGUOUS_DAYS, POSTED_WORDS = 45, 300

Range = tuple[str, str]


def day(y: int, m: int, d: int) -> Range | None:
    try:
        return (iso := date(y, m, d).isoformat(), iso)
    except ValueError:
        return None


def month_range(y: int, m: int) -> Range:
    return f"{y:04}-{m:02}-01", f"{y:04}-{m:02}-{calendar.monthrange(y, m)[1]:02}"


def quarter_range(y: int, q: int) -> Range:
    return month_range(y, 3 * q - 2)[0], month_range(y, 3 * q)[1]


def resolve_numeric(a: int, b: int, y: int, order: str | None = None, near: date | None = None) -> list[Range]:
    """Readings of a/b/y: invalid ones drop out; then the document's order, then the one within 45 days, else both."""
    both = {"dmy": day(y, b, a), "mdy": day(y, a, b)}
    valid = {k: v for k, v in both.items() if v}
    if len(set(valid.values())) < 2:
        return list(dict.fromkeys(valid.values()))
    if order in valid:
        return [valid[order]]
    if near:
        close = [v for v in valid.values() if abs((date.fromisoformat(v[0]) - near).days) <= AMBIGUOUS_DAYS]
        if len(close) == 1:
            return close
    return list(valid.values())


def day_month_order(text: str) -> str | None:
    seen = set()
    for m in _NUMERIC.finditer(text) if _DIGIT.search(text) else ():
        a, b = int(m[1]), int(m[3])
        if a > 12 >= b:
            seen.add("dmy")
        elif b > 12 >= a:
            seen.add("mdy")
    return seen.pop() if len(seen) == 1 else None


def _month_of(m: re.Match) -> int:
    return MONTHS.index(m["month"][:3].lower()) + 1


def extract_dates(text: str, default_year: int | None = None, order: str | None = None, near: date | None = None, file_name: bool = False) -> list[Range]:
    """Ranges in text order without repeats; an earlier rule's span excludes later rules."""
    if not _DIGIT.search(text):
        return []

    def whole(m: re.Match) -> list[Range | None]:
        return [day(int(m["y"]), int(m["m"]), int(m["d"]))]

    def named(m: re.Match) -> list[Range | None]:
        if m["y"] or m["yy"]:
            year = int(m["y"]) if m["y"] else int(m["yy"]) + (2000 if int(m["yy"]) < 70 else 1900)
        else:  # a month without a year counts only if it is written with a capital
            year = default_year if m["month"][0].isupper() else None
        return [day(year, _month_of(m), int(m["d"]))] if year else []

    rules = [
        (_ISO, whole),
        (_COMPACT, whole if file_name else None),
        (_NUMERIC, lambda m: resolve_numeric(int(m[1]), int(m[3]), int(m[4]), order, near)),
        (_QUARTER, lambda m: [quarter_range(int(m[2] or m[3]), int(m[1] or m[4]))]),
        (_DAY_MONTH, named),
        (_MONTH_DAY, named),
        (_MONTH_YEAR, lambda m: [month_range(int(m["y"]), _month_of(m))] if int(m["y"]) else []),
    ]
    taken: list[tuple[int, int, list[Range]]] = []
    for pattern, read in rules:
        for m in pattern.finditer(text) if read else ():
            if all(m.end() <= a or b <= m.start() for a, b, _ in taken) and (ranges := [r for r in read(m) if r]):
                taken.append((m.start(), m.end(), ranges))
    return list(dict.fromkeys(r for _, _, ranges in sorted(taken) for r in ranges))


def posted_date(text: str, name: str, mtime: date) -> Range:
    """First date of the first 300 words, else of the base name, else the file's day."""
    order = day_month_order(text)
    head, base = " ".join(text.split()[:POSTED_WORDS]), re.sub(r"_+", " ", re.sub(r"\.[^.]+$", "", name))
    first = extract_dates(head, order=order, near=mtime) or extract_dates(base, order=order, near=mtime, file_name=True)
    return first[0] if first else (mtime.isoformat(), mtime.isoformat())


def format_range(r: Range) -> str:
    return r[0] if r[0] == r[1] else f"{r[0]}\u2013{r[1]}"


def question_ranges(question: str, now: date, years: list[int] = ()) -> list[tuple[int, int]]:
    """Day ranges (YYYYMMDD) a question names: relative phrase, full dates, yearless day and month, bare years."""
    number = lambda d: d.year * 10000 + d.month * 100 + d.day
    q = question.lower()
    if m := re.search(r"\b(?:past|last)\s+(\d{1,3})\s+(day|week|month)s?\b", q):
        n = int(m[1])
        if m[2] == "month":
            k = now.year * 12 + now.month - 1 - (n - 1)
            return [(number(date(k // 12, k % 12 + 1, 1)), number(now))]
        return [(number(now - timedelta(days=(n if m[2] == "day" else 7 * n) - 1)), number(now))]
    if re.search(r"\btoday\b", q):
        return [(number(now),) * 2]
    if re.search(r"\byesterday\b", q):
        return [(number(now - timedelta(days=1)),) * 2]
    if m := re.search(r"\b(this|last)\s+(week|month|quarter|year)\b", q):
        back = int(m[1] == "last")
        if m[2] == "week":
            start = now - timedelta(days=now.weekday() + 7 * back)
            return [(number(start), number(start + timedelta(days=6)))]
        size = {"month": 1, "quarter": 3, "year": 12}[m[2]]
        k = (now.year * 12 + now.month - 1) // size * size - size * back
        end = k + size - 1
        return [(number(date(k // 12, k % 12 + 1, 1)), number(date(end // 12, end % 12 + 1, calendar.monthrange(end // 12, end % 12 + 1)[1])))]
    plain = lambda r: (int(r[0].replace("-", "")), int(r[1].replace("-", "")))
    if full := extract_dates(question, near=now):
        return [plain(r) for r in full]
    if (m := _BARE_DAY_MONTH.search(question) or _BARE_MONTH_DAY.search(question)) and (got := [plain(r) for y in sorted(years or [now.year], reverse=True) if (r := day(y, _month_of(m), int(m["d"])))]):
        return got
    bare = {int(m[1]) for m in _BARE_YEAR.finditer(question) if not _MONEY_BEFORE.search(question[: m.start()].rstrip()) and not _MONEY_AFTER.match(question, m.end())}
    return [(y * 10000 + 101, y * 10000 + 1231) for y in sorted(bare, reverse=True)]
