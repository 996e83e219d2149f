"""Dates in questions, paths and note bodies.

A question's period comes from an ordered table of readings; each reading is a pattern and
a function of its match. The first reading whose function yields a period decides. All are
pure functions of (text, today); batches go through pandas UDFs.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Period = tuple[date, date]

# --- fixed values: words and patterns that decide results ---
YEAR_WORDS = {"一昨年": 2, "再来年": -2, "来年": -1, "去年": 1, "昨年": 1, "今年": 0}
SEASONS = "春|夏|秋|冬|お正月|正月|年末年始|年始|年末(?!調整)"
TAIL_SEASONS = "末年始|末(?!調整)|始(?![めま])"
HOLIDAYS = "お正月|正月|年末年始|年始(?![めま])|年末(?!調整)"
QUARTER = "[Qq]([1-4])(?![A-Za-z0-9_])|第([1-4])四半期"
ERAS = {"令和": ("R", 2018), "平成": ("H", 1988), "昭和": ("S", 1925), "大正": ("T", 1911)}
WEEKDAYS = "月火水木金土日"
DATE_QUESTION = "いつ|何月|何日|何年|年前|月前|去年|昨年|先月|先週|いつから|いつまで"
DIARY_WORDS = "昨日 今日 本日 一昨日 おととい 先週 今週 先月 今月 最近 正月 お正月 年末 年始 去年 昨年 今年 四半期 令和 平成 昭和 大正".split()
FULL_DATES = [
    r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)",
    r"(?<!\d)(\d{4})年(?:の)?(\d{1,2})月(\d{1,2})日",
    r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)",
]
PATH_DAYS = [
    r"(\d{4})-(\d{1,2})-(\d{1,2})",
    r"(\d{4})/(\d{1,2})/(\d{1,2})",
    r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)",
    r"(\d{4})_(\d{1,2})_(\d{1,2})",
    r"(\d{4})\.(\d{1,2})\.(\d{1,2})",
    r"(\d{4})年(\d{1,2})月(\d{1,2})日",
]
PATH_MONTHS = [r"(?<!\d)(\d{4})-(\d{1,2})(?!\d|-\d)", r"(\d{4})年(\d{1,2})月(?!\d)", r"(?<!\d)(\d{4})(\d{2})(?!\d)"]
YAML_KEYS = "date|created|published|updated|日付|作成日|記録日"
LABELS = "初回訪問日|訪問日|来訪日|日付|date|created|published|updated|作成日|記録日|イベント日|visited"
JP_LABELS = "初回訪問日|訪問日|来訪日|日付|作成日|記録日|イベント日|読了|読了日|鑑賞日|視聴日|開催日|実施日"
FIRST_YEAR = 1990
# --- end of fixed values ---

_A = re.ASCII
_REL = "(一昨年|再来年|来年|去年|昨年|今年)"
_IN_YEAR = f"{SEASONS}|(?<=年)(?:{TAIL_SEASONS})"


def make(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except (ValueError, OverflowError):
        return None


def valid_day(y, m, d, today: date, future: bool = True) -> date | None:
    """A real day between 1990 and the end of today's year, or not after today."""
    found = make(int(y), int(m), int(d))
    if not found or not FIRST_YEAR <= found.year <= today.year:
        return None
    return found if future or found <= today else None


def _month(y: int, m: int, today: date | None = None) -> Period | None:
    first = make(y, m, 1)
    if not first:
        return None
    last = first.replace(day=calendar.monthrange(y, m)[1])
    return first, min(last, today) if today else last


def _year(y: int, today: date) -> Period | None:
    first = make(y, 1, 1)
    return first and (first, today if y == today.year else date(y, 12, 31))


def _quarter(q: int, y: int, today: date) -> Period | None:
    first, last = make(y, 3 * q - 2, 1), _month(y, 3 * q)
    return (first, min(last[1], today)) if first and last else None


def _season(name: str, y: int, today: date) -> Period | None:
    spans = {"春": ((0, 3, 1), (0, 5, 31)), "夏": ((0, 6, 1), (0, 8, 31)), "秋": ((0, 9, 1), (0, 11, 30)), "冬": ((0, 12, 1), (1, 2, 0))}
    spans |= dict.fromkeys(("正月", "お正月", "年始", "始"), ((0, 1, 1), (0, 1, 7)))
    spans |= dict.fromkeys(("年末", "末"), ((0, 12, 25), (0, 12, 31)))
    spans |= dict.fromkeys(("年末年始", "末年始"), ((0, 12, 25), (1, 1, 7)))
    if name not in spans or not 1 <= y <= 9998:
        return None
    ends = [date(y + dy, m, d or calendar.monthrange(y + dy, m)[1]) for dy, m, d in spans[name]]
    return ends[0], min(ends[1], today)


def year_offset(text: str) -> int | None:
    """Years back from this year of the first year word that fits, in the order of YEAR_WORDS."""
    return next((n for w, n in YEAR_WORDS.items() if w in text), None)


def era_year(text: str) -> tuple[int, int] | None:
    """The year of the first era, and where its mention ends."""
    for name, (letter, base) in ERAS.items():
        if m := re.search(rf"(?:{name}|(?<![A-Za-z0-9_]){letter})([1-9]\d?|元)年", text, re.I | _A):
            return base + (1 if m[1] == "元" else int(m[1])), m.end()
    return None


def _from_era(text: str, today: date) -> Period | None:
    if not (found := era_year(text)):
        return None
    y, rest = found[0], text[found[1] :]
    if m := re.match(r"(?:の)?(\d{1,2})月(\d{1,2})日", rest, _A):
        d = make(y, int(m[1]), int(m[2]))
        return d and (d, d)
    if m := re.match(f"(?:の)?({SEASONS})|({TAIL_SEASONS})", rest):
        return _season(m[1] or m[2], y, today)
    if m := re.match(f"(?:の)?(?:{QUARTER})", rest):
        return _quarter(int(m[1] or m[2]), y, today)
    if m := re.match(r"(?:の)?(\d{1,2})月", rest, _A):
        return _month(y, int(m[1]), today)
    return _year(y, today)


def _from_quarter(text: str, today: date) -> Period | None:
    if m := re.search(rf"(一昨年|再来年|来年|去年|昨年|今年|\d{{4}}年|(?<!\d)\d{{4}}(?=[Qq]))(?:の)?(?:{QUARTER})", text, _A):
        back = year_offset(m[1])
        return _quarter(int(m[2] or m[3]), today.year - back if back is not None else int(m[1].rstrip("年")), today)
    if m := re.search(rf"(?<![A-Za-z_])[Qq]([1-4])(?![A-Za-z0-9_])|第([1-4])四半期", text):
        return _quarter(int(m[1] or m[2]), today.year - (year_offset(text) or 0), today)
    return None


def _from_full(text: str, today: date) -> Period | None:
    days = (valid_day(*m.groups(), today) for p in FULL_DATES for m in re.finditer(p, text, _A))
    found = next(filter(None, days), None)
    return found and (found, found)


def _relative_month(m: re.Match, today: date) -> Period | None:
    y = today.year - year_offset(m[1])
    if m[3]:
        d = make(y, int(m[2]), int(m[3]))
        return d and (d, d)
    return _month(y, int(m[2]), today)


def _relative(text: str, today: date) -> Period | None:
    back = year_offset(text)
    if back is not None:
        y = today.year - back
        return (date(y, 1, 1), today) if not back else (date(y, 1, 1), date(y, 12, 31))
    before = today.replace(day=1) - timedelta(days=1)
    if "先月" in text:
        return before.replace(day=1), before
    return (today.replace(day=1), today) if "今月" in text else None


#: Patterned readings, tried in this order between quarters and relative words.
_READINGS: list[tuple[str, Callable[[re.Match, date], Period | None]]] = [
    (r"(\d+)\s*年[前まえ]の(\d{1,2})月", lambda m, t: _month(t.year - int(m[1]), int(m[2]))),
    (rf"(\d+)\s*年[前まえ](?:の)?({SEASONS})", lambda m, t: _season(m[2], t.year - int(m[1]), t)),
    (r"(\d{4})年(?:の)?(\d{1,2})月", lambda m, t: _month(int(m[1]), int(m[2]), t)),
    (rf"{_REL}(?:の)?(\d{{1,2}})月(?:(\d{{1,2}})日)?", _relative_month),
    (rf"{_REL}(?:の)?({_IN_YEAR})", lambda m, t: _season(m[2], t.year - year_offset(m[1]), t)),
    (rf"(\d{{4}})年(?:の)?({_IN_YEAR})", lambda m, t: _season(m[2], int(m[1]), t)),
]


def _readings(text: str, today: date) -> Iterator[Period | None]:
    yield _from_full(text, today)
    yield _from_era(text, today)
    yield _from_quarter(text, today)
    ago = re.search(_READINGS[0][0], text, _A)
    for i, (pattern, read) in enumerate(_READINGS):
        if i == 1 and ago:
            continue  # a month that many years ago, even an impossible one, leaves no season
        m = ago if i == 0 else re.search(pattern, text, _A)
        yield read(m, today) if m else None
    yield _relative(text, today)
    m = re.search(r"(\d{4})年(?!\d)", text, _A)
    yield _year(int(m[1]), today) if m else None


def _unchecked(text: str, today: date) -> Period | None:
    return next(filter(None, _readings(text, today)), None)


def resolve_period(text: str, today: date) -> Period | None:
    """(start, end) of the period a question names; none if it starts after today."""
    found = _unchecked(text, today)
    return found if found and found[0] <= today else None


def _days(first: date, last: date) -> list[date]:
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def _weekday(text: str, today: date) -> list[date] | None:
    monday = today - timedelta(days=today.weekday())
    for word, start in (("先週", monday - timedelta(days=7)), ("今週", monday)):
        if m := re.search(f"{word}(?:の)?([{WEEKDAYS}])(?:曜日?)?", text):
            day = start + timedelta(days=WEEKDAYS.index(m[1]))
            if word == "先週" or day <= today:
                return [day]
    return None


def _worded_days(text: str, today: date) -> list[date] | None:
    monday = today - timedelta(days=today.weekday())
    ends = today.replace(day=1) - timedelta(days=1)
    holiday = re.search(HOLIDAYS, text)
    table: list[tuple[tuple[str, ...], Callable[[], list[date]]]] = [
        (("一昨日", "おととい"), lambda: [today - timedelta(days=2)]),
        (("昨日",), lambda: [today - timedelta(days=1)]),
        (("今日", "本日"), lambda: [today]),
        (("今週",), lambda: _days(monday, today)[::-1]),
        (("先週",), lambda: _days(monday - timedelta(days=7), monday - timedelta(days=1))),
        (("今月",), lambda: _days(today.replace(day=1), today)),
        (("先月",), lambda: _days(ends.replace(day=1), ends)),
    ]
    for words, days in table:
        if any(w in text for w in words):
            return days()
    if holiday:
        back, era = year_offset(text), era_year(text)
        ago = re.search(rf"(\d+)\s*年[前まえ](?:の)?({SEASONS})", text, _A)
        named = re.search(r"(\d{4})年(?!\d)", text, _A)
        if back is not None:
            y = today.year - back
        elif era:
            y = era[0]
        elif ago:
            y = today.year - int(ago[1])
        elif named:
            y = int(named[1])
        else:
            y = today.year - (holiday[0] in ("年末", "年末年始") and today < date(today.year, 12, 25))
        span = _season(holiday[0], y, today)
        return _days(*span) if span else []
    return [today - timedelta(days=i) for i in range(15)] if "最近" in text else None


def _numbered_days(text: str, today: date) -> list[date]:
    def year(m: int, d: int) -> int:
        back = year_offset(text)
        return today.year - (back if back is not None else (m, d) > (today.month, today.day))

    if m := re.search(r"(\d{1,2})月(\d{1,2})日", text, _A):
        found = make(year(int(m[1]), int(m[2])), int(m[1]), int(m[2]))
        return [found] if found else []
    if m := re.search(r"(\d{1,2})月", text, _A):
        span = _month(year(int(m[1]), 1), int(m[1]), today)
        return _days(*span) if span else []
    return []


def resolve_days(text: str, today: date) -> list[date]:
    """The days a question names, none after today."""
    span = _unchecked(text, today)
    if span and span[0] > today:
        return []
    if m := re.search(r"(\d+)\s*日[前まえ]", text, _A):
        found = [today - timedelta(days=min(int(m[1]), today.toordinal() - 1))]
    elif m := re.search(r"(\d{4})[./](\d{1,2})[./](\d{1,2})", text, _A):
        day = make(*map(int, m.groups()))
        found = [day] if day else []
    else:
        found = next((x for x in (_weekday(text, today), _worded_days(text, today)) if x is not None), None)
        if found is None:
            found = _numbered_days(text, today)
    return [d for d in found if d <= today]


def is_date_question(text: str) -> bool:
    return bool(re.search(DATE_QUESTION, text))


def is_diary_question(text: str) -> bool:
    patterns = (r"\d{1,2}月", r"\d+\s*日[前まえ]", f"[先今]週(?:の)?[{WEEKDAYS}]", r"(?<![A-Za-z_])[Qq][1-4](?![A-Za-z0-9_])|第[1-4]四半期", r"\d{4}[./]\d{1,2}[./]\d{1,2}")
    return any(w in text for w in DIARY_WORDS) or any(re.search(p, text, _A) for p in patterns) or era_year(text) is not None


def date_from_path(path: str, today: date) -> date | None:
    """The first match of each pattern is tried, days before months; a month is its first day."""
    for patterns, day in ((PATH_DAYS, None), (PATH_MONTHS, "1")):
        for p in patterns:
            m = re.search(p, path, _A)
            if m and (found := valid_day(*m.groups(), *([day] if day else []), today)):
                return found
    return None


def date_from_content(text: str, today: date) -> date | None:
    """Front matter, labelled lines, body, then headings; every match is tried in turn."""
    from .markdown import headings

    def first(pattern: str, where: str, flags: int = 0) -> date | None:
        days = (valid_day(m[1], m[2], (m[3] if m.re.groups > 2 else None) or 1, today, future=False) for m in re.finditer(pattern, where, flags | _A))
        return next(filter(None, days), None)

    lines = text.splitlines()
    if lines and lines[0].strip() == "---":
        for line in lines[1:]:
            if line.strip() in ("---", "..."):
                break
            found = first(rf"""^(?:{YAML_KEYS})\s*:\s*['"]?(\d{{4}})[/.-](\d{{1,2}})[/.-](\d{{1,2}})""", line.strip(), re.I)
            if found:
                return found
    tried = [
        (rf"(?:{LABELS})[：:]\s*(\d{{4}})[/.-](\d{{1,2}})[/.-](\d{{1,2}})", re.I),
        (rf"^\s*(?:[-*+]\s+)?(?:{JP_LABELS})[：:]\s*(\d{{4}})年(\d{{1,2}})月(?:(\d{{1,2}})日)?", re.M),
        (r"(?<!\d)(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})(?!\d)", 0),
    ]
    for pattern, flags in tried:
        if found := first(pattern, text, flags):
            return found
    month = None
    for h in headings(text):
        m = re.search(r"(\d{4})年(\d{1,2})月(\d{1,2})日", h, _A)
        if m and (found := valid_day(*m.groups(), today, future=False)):
            return found
        m = re.search(r"(\d{4})年(\d{1,2})月(?!\d)", h, _A)
        if m and not month:
            month = valid_day(m[1], m[2], 1, today, future=False)
    return month


def period_of(text: Column, as_of: Column) -> Column:
    """struct<start:date,end:date> of each question, as of its own day."""

    @F.pandas_udf("start date, end date")
    def run(t: pd.Series, day: pd.Series) -> pd.DataFrame:
        got = [(resolve_period(a, b) if a and b else None) or (None, None) for a, b in zip(t, day)]
        return pd.DataFrame(got, columns=["start", "end"])

    return run(text, as_of)


def days_of(text: Column, as_of: Column) -> Column:
    @F.pandas_udf("array<date>")
    def run(t: pd.Series, day: pd.Series) -> pd.Series:
        return pd.Series([resolve_days(a, b) if a and b else [] for a, b in zip(t, day)])

    return run(text, as_of)


def document_date(path: Column, content: Column, as_of: Column) -> Column:
    """The path's date, else the content's."""

    @F.pandas_udf("date")
    def run(p: pd.Series, c: pd.Series, day: pd.Series) -> pd.Series:
        return pd.Series([date_from_path(a or "", t) or date_from_content(b or "", t) for a, b, t in zip(p, c, day)], dtype=object)

    return run(path, content, as_of)
