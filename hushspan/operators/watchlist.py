"""User-defined terms, matched as whole words without regard to case."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from hushspan.functions import arrays as A
from hushspan.functions.rules import CLOSE, OPEN
from hushspan.kinds import SPAN_TYPE, SPANS_TYPE
from hushspan.operators.scan import _CLEAN, computed, with_scan_columns

# Length of a valid term in bytes.
MIN_BYTES, MAX_BYTES = 2, 120
# Terms of one alternation; a longer list becomes several, tried one after the other at a place.
TERMS_PER_GROUP = 200


def clean_terms(setting: str | list[str] | None) -> list[str]:
    """Valid terms, longest first.  A setting that is not a JSON list of texts gives none."""
    return sort_terms(setting)[0]


def rejected_terms(setting: str | list[str] | None) -> list[str]:
    """Terms of a setting that are too short or too long to be valid."""
    return sort_terms(setting)[1]


def sort_terms(setting: str | list[str] | None) -> tuple[list[str], list[str]]:
    """(valid, rejected) terms of a setting; any number of them is taken."""
    if isinstance(setting, str):
        try:
            setting = json.loads(setting)
        except ValueError:
            return [], []
    if not isinstance(setting, list) or not all(isinstance(t, str) for t in setting):
        return [], []
    terms = [t.strip() for t in setting]
    valid = [t for t in terms if MIN_BYTES <= len(t.encode()) <= MAX_BYTES]
    return sorted(valid, key=lambda t: -len(t.encode())), [t for t in terms if t not in valid]


def _escape(term: str) -> str:
    return re.sub(r"([^0-9A-Za-z\u0080-\U0010ffff])", r"\\\1", term)


def watchlist_sql(terms: list[str], text: str) -> str:
    """Spans of the terms as array<SPAN_TYPE>; needs the helper columns of `with_scan_columns`."""
    if not terms:
        return f"cast(array() as {SPANS_TYPE})"
    # A group for each leading part of the list keeps the alternations short and the order of the terms.
    parts = [terms[i:i + TERMS_PER_GROUP] for i in range(0, len(terms), TERMS_PER_GROUP)]
    body = "|".join(rf"(?=[{''.join(sorted({_escape(c) for t in part for c in (t[0].lower(), t[0].upper())}))}])"
                    rf"(?:{'|'.join(_escape(t) for t in part)})" for part in parts)
    firsts = "".join(sorted({_escape(t[0]) for t in terms}))
    pattern = rf"(?iU)(?=[{firsts}])(\b(?:{body})\b)" if not any(
        re.match(r"\W", t) for t in terms) else rf"(?iU)(\b(?:{body})\b)"
    tagged = f"regexp_replace({_CLEAN}, {A.lit(pattern)}, '{OPEN}$1{CLOSE}')"

    def step(st: str, piece: str) -> tuple[str, str]:
        raw = f"if({_CLEAN} = {text}, {piece}, substr({text}, {st}.pos + 1, length({piece})))"
        span = (f"named_struct('start', {st}.pos, 'end', {st}.pos + length({piece}), 'kind', 'CUSTOM',"
                f" 'raw', {raw}, 'alias', '', 'confidence', cast(1.0 as float))")
        return (f"named_struct('pos', {st}.pos + length({piece}), 'odd', NOT {st}.odd)",
                f"if({st}.odd, array({span}), cast(array() as array<{SPAN_TYPE}>))")
    return A.let(tagged, lambda t: (
        f"if(contains({t}, '{OPEN}'), "
        + A.running(f"split({t}, '[{OPEN}{CLOSE}]')", "named_struct('pos', 0, 'odd', false)", step,
                    SPAN_TYPE)
        + f", cast(array() as {SPANS_TYPE}))"))


def detect_watchlist(df: DataFrame, setting, text: str = "text", out: str = "spans") -> DataFrame:
    """Add the spans of all the user's valid terms; one pattern literal holds them."""
    columns = df.columns
    df = with_scan_columns(df, text)
    found = f"coalesce({watchlist_sql(clean_terms(setting), text)}, cast(array() as {SPANS_TYPE}))"
    return computed(df, out, found).select(*[c for c in columns if c != out], out)
