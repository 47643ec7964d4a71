"""Arrow-batched functions for what no built-in expresses: Unicode forms and fuzzy scores."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC form; null stays null."""
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def nfkd_ascii(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, lower case, multiplication signs as x."""
    bare = lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower().replace("×", "x")
    return s.map(bare, na_action="ignore")


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Comparison form: NFKC, white space to single blanks, case folded (sharp s becomes ss)."""
    return s.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).split()).casefold(), na_action="ignore")


def _ratio(a: str, b: str) -> float:
    return 100 * SequenceMatcher(None, a, b, autojunk=False).ratio()


def _tokens(a: str) -> list[str]:
    return sorted(re.findall(r"\w+", a))


def similarity(a: str, b: str) -> float:
    """0 to 100: the best of a plain ratio and, scaled down, of token and partial ratios.

    An approximation of the weighted ratio of common fuzzy-matching libraries; exact
    parity near a cut-off is not claimed.
    """
    if not a or not b:
        return 0.0
    best = _ratio(a, b)
    long, short = max(len(a), len(b)), min(len(a), len(b))
    ta, tb = _tokens(a), _tokens(b)
    common = [t for t in ta if t in tb]
    sort_ratio = _ratio(" ".join(ta), " ".join(tb))
    base = " ".join(common)
    set_ratio = max(_ratio(base, " ".join(ta)), _ratio(base, " ".join(tb))) if common else 0.0
    if long < 1.5 * short:
        return max(best, 0.95 * sort_ratio, 0.95 * set_ratio)
    scale = 0.9 if long < 8 * short else 0.6
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    part = max(_ratio(s, t[i : i + len(s)]) for i in range(len(t) - len(s) + 1))
    return max(best, scale * part, 0.95 * scale * max(sort_ratio, set_ratio))


def fuzzy_best(aliases: list[tuple[str, str]], cutoff: float):
    """A function of a normalised value: struct(canonical, score) of the best alias, the first of equals."""

    @F.pandas_udf(StructType([StructField("canonical", StringType()), StructField("score", DoubleType())]))
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[str | None, float | None]] = {}

        def of(v: str | None) -> tuple[str | None, float | None]:
            if not v:
                return None, None
            if v not in seen:
                top: tuple[str | None, float | None] = (None, None)
                for alias, canonical in aliases:
                    s = similarity(v, alias)
                    if s >= cutoff and (top[1] is None or s > top[1]):
                        top = (canonical, s)
                if len(seen) > 100_000:
                    seen.clear()
                seen[v] = top
            return seen[v]

        for s in batches:
            yield pd.DataFrame([of(v if isinstance(v, str) else None) for v in s], columns=["canonical", "score"])

    return best
