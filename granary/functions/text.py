"""Scalar text functions: normal forms, key terms, overlap, timestamps, name similarity."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STOP = """about above after again against all also and any are because been before being below between both but can could did does doing down during each few for
from further had has have having her here hers him his how into its itself just more most not now off once only other our out over own same she should some such than that
the their them then there these they this those through too under until very was were what when where which while who whom why will with would you your yours""".split()
MIN_TERM = 3


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def fold(c: Column | str) -> Column:
    """NFKC, then case folding. Python sees only the texts that aren't ASCII; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    ascii_only = c.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(ascii_only, F.lower(c)).otherwise(_fold(F.when(~ascii_only, c)))


def normalize(c: Column | str) -> Column:
    """``fold`` without white space around."""
    return F.regexp_replace(fold(c), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def normalize_spaces(c: Column | str) -> Column:
    """``normalize`` with every run of white space as one space."""
    return F.regexp_replace(normalize(c), r"(?U)[\s\x1c-\x1f]+", " ")


def key_terms(c: Column | str) -> Column:
    """Sorted distinct runs of ASCII letters and digits of the folded text, of MIN_TERM at least and not in STOP; null for null."""
    found = F.regexp_extract_all(fold(c), F.lit("([a-z0-9]{%d,})" % MIN_TERM), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP])))


def found_terms(terms: Column, folded_text: Column) -> Column:
    """The terms that are substrings of an already folded text; a null text has none."""
    hay = F.coalesce(folded_text, F.lit(""))
    return F.filter(terms, lambda t: F.contains(hay, t))


def overlap_recall(terms: Column, found: Column) -> Column:
    return F.when(F.size(terms) > 0, F.size(found) / F.size(terms)).otherwise(F.lit(0.0))


_CUT = {"second": (19, ""), "minute": (16, ":00"), "hour": (13, ":00:00"), "day": (10, "T00:00:00")}


def round_iso(c: Column | str, resolution: str = "second") -> Column:
    """An ISO time cut to ``resolution`` in its own offset, as text. Null for null; other text than ISO raises when evaluated."""
    if resolution not in _CUT:
        raise ValueError(f"resolution must be one of {list(_CUT)}")
    c = F.col(c) if isinstance(c, str) else c
    good = c.rlike(r"\A\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?\z")
    keep, rest = _CUT[resolution]
    offset = F.regexp_extract(c, r"(Z|[+-]\d\d:\d\d)\z", 1)
    cut = F.concat(F.replace(F.substring(c, 1, keep), F.lit(" "), F.lit("T")), F.lit(rest), offset)
    return F.when(c.isNull(), None).when(good, cut).otherwise(F.raise_error(F.concat(F.lit("no ISO time: "), c)).cast("string"))


def _indel(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over the sum of the lengths, by bit-parallel rows."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        u = row & where.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100 of two texts as sets of words: 100 where one set holds the other, 0 where one is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    score = _indel(with_x, with_y)
    return max(score, _indel(both, with_x), _indel(both, with_y)) if both else score


SENTENCE = re.compile(r"[^.!?]+[.!?]*")
#: The same cut in SQL; blank pieces are no sentences.
SENTENCE_PATTERN = "([^.!?]+[.!?]*)"


def sentences(c: Column | str) -> Column:
    """The sentences of a text, trimmed, without blank ones; null for null."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(SENTENCE_PATTERN), F.lit(1)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
