"""Spoken forms of the numbers and dates that a rewrite turns into words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English number words.
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = [(10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (10**3, "thousand")]
QUARTERS = {"1": "first", "2": "second", "3": "third", "4": "fourth"}
# End of fixed values.


def number_words(n: int) -> str:
    """Cardinal words, with "and" before the last two digits: two thousand and twenty-four."""
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (f"-{ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{ONES[n // 100]} hundred" + (f" and {number_words(n % 100)}" if n % 100 else "")
    size, name = next(s for s in SCALES if n >= s[0])
    rest = n % size
    return f"{number_words(n // size)} {name}" + (f"{' and' if rest < 100 else ''} {number_words(rest)}" if rest else "")


def decimal_words(text: str) -> str:
    whole, _, part = text.replace(",", "").strip(".").partition(".")
    return number_words(int(whole or 0)) + (" point " + " ".join(ONES[int(d)] for d in part) if part else "")


def year_words(year: int) -> list[str]:
    """As a year is read, and as a number; 2000 is two thousand."""
    high, low = divmod(year, 100)
    if low == 0:
        read = number_words(year) if high % 10 == 0 else f"{number_words(high)} hundred"
    else:
        read = f"{number_words(high)} {'oh ' if low < 10 else ''}{number_words(low)}"
    return [read, number_words(year)]


def forms_of(entity: str) -> list[str]:
    """The entity itself and every way in which its figures may be said."""
    text = entity.strip()
    out = [text]
    if m := re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*%", text):
        out.append(decimal_words(m[1]) + " percent")
    elif m := re.fullmatch(r"\$([0-9][0-9,]*(?:\.[0-9]+)?)[.,]*", text):
        out += [decimal_words(m[1]) + " dollars", decimal_words(m[1])]
    elif m := re.fullmatch(r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(billion|million|trillion|thousand)", text):
        out.append(f"{decimal_words(m[1])} {m[2].lower()}")
    elif m := re.fullmatch(r"(?i)Q([1-4])\s*([0-9]{2,4})?", text):
        quarter = f"{QUARTERS[m[1]]} quarter"
        years = year_words(int(m[2]) if len(m[2]) == 4 else 2000 + int(m[2])) if m[2] and len(m[2]) != 3 else []
        out += [f"{quarter} of {y}" for y in years] + [f"{quarter} {y}" for y in years] + [quarter]
    elif m := re.fullmatch(r"(?i)FY\s*([0-9]{2}|[0-9]{4})", text):
        out += [f"fiscal year {y}" for y in year_words(int(m[1]) if len(m[1]) == 4 else 2000 + int(m[1]))]
    elif re.fullmatch(r"[0-9]{4}", text):
        out += year_words(int(text))
    return list(dict.fromkeys(out + [f.replace("-", " ") for f in out[1:]]))


def _all_forms(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in values:
        known = {v: forms_of(v) for v in s.dropna().unique()}
        yield s.map(lambda v: known.get(v, []))


def spoken_forms(values: Column | str) -> Column:
    """Column of entities -> their accepted forms; null gives none.  Each distinct value of a batch is worked once."""
    return F.pandas_udf(_all_forms, T.ArrayType(T.StringType()))(values)
