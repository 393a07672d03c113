"""Phrase leg: the tightest window of query terms, and snippets around it.

These fold over token positions and run as Arrow-batched functions, on the rerank set only (30 rows a query).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from loomery.config import CONFIG, STOP_WORDS

#: Types are objects, as this module is imported by workers, which cannot parse type strings.
WINDOW_TYPE = StructType([StructField("phrase", DoubleType()), StructField("first", IntegerType()), StructField("stop", IntegerType())])
_STOP = frozenset(STOP_WORDS)
_RUN = re.compile(r"[a-zA-Z0-9.+/\-]+")
_WORD = re.compile(r"[a-z]{5,}")


def stem(t: str) -> str:
    """The stem rules of :func:`loomery.functions.text.stem`, for one token."""
    n = len(t)
    if not _WORD.fullmatch(t):
        return t
    for tail, least, cut, add in (("ies", 6, 3, "y"), ("sses", 5, 2, ""), ("shes", 5, 2, ""), ("ches", 5, 2, ""), ("ing", 7, 3, ""), ("ed", 6, 2, ""), ("es", 6, 1, "")):
        if n >= least and t.endswith(tail):
            return t[: n - cut] + add
    return t[:-1] if t.endswith("s") and not t.endswith("ss") else t


def run_terms(run: str) -> tuple[str, ...]:
    """The terms of what stands between two separators, as :func:`loomery.functions.text.tokenize` has them."""
    clean = run.strip(".-/+")
    parts = [p for p in re.split(r"[.\-/]", clean) if len(p) > 1]
    return tuple(stem(form) for form in ([clean, *parts] if len(parts) > 1 else [clean]) if len(form) > 1 and form not in _STOP)


def positions(text: str | None) -> list[tuple[str, int, int]]:
    """(term, start, end) of every search term; the parts of a compound share its span."""
    out = []
    for m in _RUN.finditer(text or ""):
        bare = m[0].lstrip(".-/+")
        start = m.end() - len(bare)
        clean = bare.rstrip(".-/+").lower()
        if not clean:
            continue
        parts = [p for p in re.split(r"[.\-/]", clean) if len(p) > 1]
        for form in [clean, *parts] if len(parts) > 1 else [clean]:
            if len(form) > 1 and form not in _STOP:
                out.append((stem(form), start, start + len(clean)))
    return out


def best_window(text: str | None, terms: list[str]) -> tuple[float, int, int] | None:
    """(score, first, end) of the window with the largest (distinct / wanted)^2 * distinct / span; the first of equals.

    Windows reach back over at most 4 * wanted + 24 hits. None with fewer than two terms or no hit.
    """
    wanted = set(terms)
    if len(wanted) < 2:
        return None
    hits = [(i, t, a, b) for i, (t, a, b) in enumerate(positions(text)) if t in wanted]
    reach, best = 4 * len(wanted) + 24, None
    for r, (at, _, _, end) in enumerate(hits):
        seen: set[str] = set()
        for left in range(r, max(-1, r - reach), -1):
            i, t, start, _ = hits[left]
            seen.add(t)
            share = len(seen) / len(wanted)
            score = share * share * len(seen) / (at - i + 1)
            if best is None or score > best[0]:
                best = (score, start, end)
    return best


@F.pandas_udf(WINDOW_TYPE)
def phrase_window(text: pd.Series, terms: pd.Series) -> pd.DataFrame:
    rows = [best_window(t, list(q) if q is not None else []) for t, q in zip(text, terms)]
    return pd.DataFrame([r or (0.0, None, None) for r in rows], columns=["phrase", "first", "stop"]).astype({"phrase": float, "first": "Int32", "stop": "Int32"})


def cut_around(text: str | None, first: int, stop: int, limit: int = CONFIG.snippet_chars) -> str:
    """``limit`` characters centred on a match, from a sentence start nearby if there is one, cut at words."""
    s = text or ""
    if len(s) <= limit:
        return re.sub(r"\s+", " ", s).strip()
    begin = first if stop - first >= limit else max(0, first - (limit - (stop - first)) // 2)
    begin = min(begin, max(0, len(s) - limit)) if stop - first < limit else begin
    lead = max(0, begin - 120)
    mark = max(s.rfind(p, lead, begin) for p in (". ", "! ", "? ", "\n"))
    if mark >= lead and mark >= 0 and begin - (mark + 1) < 120 and mark + 1 < first:
        begin = mark + 1
    end = min(len(s), begin + limit)
    cut = s[begin:end]
    if begin > 0:
        cut = re.sub(r"^\S*\s", "", cut)
    if end < len(s):
        cut = re.sub(r"\s\S*$", "", cut)
    return ("…" if begin > 0 else "") + re.sub(r"\s+", " ", cut).strip() + ("…" if end < len(s) else "")


@F.pandas_udf(StringType())
def snippet_around(text: pd.Series, first: pd.Series, stop: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut_around(t, 0 if pd.isna(a) else int(a), 0 if pd.isna(b) else int(b)) for t, a, b in zip(text, first, stop)], dtype=object)


def phrase(text: Column, terms: Column) -> Column:
    return phrase_window(text, terms)
