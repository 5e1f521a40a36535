"""JSON as language models write it: extraction, repair and strict reading.

The kernel works on tokens: whole strings, brackets, commas, white space, other characters. Column versions are Arrow-batched
UDFs; Spark's own readers coerce types and accept trailing text, which these must not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A fenced block, and a value in single quotes after a key.
FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```")
SINGLE_QUOTED = re.compile(r"\"([^\"]+)\":\s*'([^']*)'")
#: An escaped character outside of a string hides it from the structure, as does a string; the last string may be open.
TOKEN = re.compile(r'"(?:[^"\\]|\\[\s\S])*(?:"|\\?\Z)|\\[\s\S]|[\[\]{},]|\s+|[^\s"\\\[\]{},]+|\\')
BLANK = " \t\n\r"


def _structure(text: str, start: int = 0) -> Iterator[tuple[int, str]]:
    """(place, token) from ``start`` on."""
    for m in TOKEN.finditer(text, start):
        yield m.start(), m.group()


def unmatched(text: str, opening: str, closing: str) -> int:
    """How many brackets stay open, at least 0."""
    tokens = [t for _, t in _structure(text)]
    return max(0, tokens.count(opening) - tokens.count(closing))


def matching(text: str, start: int, opening: str, closing: str) -> int:
    """The place of the bracket that closes the one at ``start``, or -1."""
    depth = 0
    for place, token in _structure(text, start):
        depth += (token == opening) - (token == closing)
        if token == closing and depth == 0:
            return place
    return -1


def extract(text: str, prefer: str = "array") -> str:
    """The JSON in a reply: from a fenced block if there is one; the first array, else the first object; closed if cut off.

    ``prefer='object'`` looks for an object first, which a judge's reply wants.
    """
    fenced = FENCE.search(text)
    text = (fenced.group(1) if fenced else text).strip()
    kinds = [("[", "]"), ("{", "}")]
    for opening, closing in kinds if prefer == "array" else kinds[::-1]:
        start = text.find(opening)
        if start < 0:
            continue
        end = matching(text, start, opening, closing)
        if end >= 0:
            return text[start : end + 1]
        if text.rfind('"') > start:
            rest = text[start:].rstrip(" \n\t,")
            return rest + (closing if opening == "[" else closing * unmatched(rest, opening, closing))
    return text


def sanitize(text: str) -> str:
    """Double quotes for values in single ones, and escapes for raw line ends inside strings."""
    text = SINGLE_QUOTED.sub(lambda m: '"{}": "{}"'.format(m.group(1), m.group(2).replace('"', '\\"')), text)
    return "".join(re.sub(r"(\\[\s\S])|\r\n|\n|\r", lambda m: m.group(1) or "\\n", t) if t[0] == '"' else t for _, t in _structure(text))


def repair(text: str, prefer: str = "array") -> str:
    """Extracted and sanitised, without superfluous commas and with the missing ones between values."""
    out: list[str] = []
    previous = ""  # the last token that is not white space
    for _, token in _structure(sanitize(extract(text, prefer))):
        if token[0] in BLANK:
            out.append(token)
            continue
        value_before = previous[:1] in ('"', "}", "]")
        if token == "," and previous == ",":
            continue
        if token in ("]", "}") and previous == ",":
            out.pop(max(k for k, t in enumerate(out) if t == ","))
        elif token[0] in '"[{' and value_before:
            out.append(",")
        out.append(token)
        previous = token
    return "".join(out)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def load(text: str):
    """Strict JSON: no NaN, nothing after the value."""
    return json.loads(text, parse_constant=_no_constant)


def array_length(text: str) -> int | None:
    """The number of elements if the text is a JSON array, else None."""
    try:
        value = load(text)
    except (ValueError, RecursionError):
        return None
    return len(value) if isinstance(value, list) else None


def string_array(text: str, least: int = 0) -> list[str] | None:
    """The trimmed, non-blank elements of a JSON array of strings if there are ``least`` of them, else None."""
    try:
        value = load(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, list) or not all(x is None or isinstance(x, str) for x in value):
        return None
    kept = [x.strip() for x in value if x and x.strip()]
    return kept if len(kept) >= least else None


def plain_array(text: str) -> list[str] | None:
    """The elements of a JSON array of strings as they are; what is tried where ``string_array`` fails."""
    try:
        value = load(text)
    except (ValueError, RecursionError):
        return None
    return ["" if x is None else x for x in value] if isinstance(value, list) and all(x is None or isinstance(x, str) for x in value) else None


def _field(entry: dict, name: str):
    """A field by its name, case ignored if there is none in the exact case; the last of several counts."""
    if name in entry:
        return entry[name]
    found = [v for k, v in entry.items() if k.lower() == name]
    return found[-1] if found else None


def judge_scores(text: str) -> dict[str, tuple[int, str]] | None:
    """{criterion: (score, reasoning)} by strict types: a score is an integer, missing ones are 0; None if the text is no such object."""
    try:
        value = load(text)
    except (ValueError, RecursionError):
        return None
    if value is None:
        return {}
    if not isinstance(value, dict):
        return None
    out = {}
    for name, entry in value.items():
        if entry is None:
            out[name] = (0, "")
            continue
        if not isinstance(entry, dict):
            return None
        score, reasoning = _field(entry, "score"), _field(entry, "reasoning")
        if isinstance(score, bool) or not isinstance(score, int | None) or not isinstance(reasoning, str | None):
            return None
        out[name] = (score or 0, reasoning or "")
    return out


def parse_judge(reply: str, prefer: str = "array") -> tuple[int, dict[str, tuple[int, str]]] | None:
    """(number of the way, scores) by the first of four ways that succeeds.

    Sanitised; repaired; repaired twice, sanitised between; and last whatever complete value begins the repaired text, if it has
    a score at all.
    """
    taken = extract(reply, prefer)
    if (scores := judge_scores(sanitize(taken))) is not None:
        return 1, scores
    once = repair(taken, prefer)
    if (scores := judge_scores(once)) is not None:
        return 2, scores
    if (scores := judge_scores(repair(sanitize(once), prefer))) is not None:
        return 3, scores
    scores = judge_scores(leading_value(sanitize(once)))
    return (4, scores) if scores else None


def leading_value(text: str) -> str:
    """The JSON value that the text begins with; what follows is left out."""
    start = len(text) - len(text.lstrip(BLANK))
    try:
        return text[start : json.JSONDecoder(parse_constant=_no_constant).raw_decode(text, start)[1]]
    except (ValueError, RecursionError):
        return text


def _text_udf(function):
    return F.pandas_udf(lambda s: s.map(function, na_action="ignore"), T.StringType(), F.PandasUDFType.SCALAR)


extract_json = _text_udf(extract)
sanitize_json = _text_udf(sanitize)
repair_json = _text_udf(repair)


def open_brackets(opening: str, closing: str):
    """A UDF that counts the brackets which stay open."""
    return F.pandas_udf(lambda s: s.map(lambda t: unmatched(t, opening, closing), na_action="ignore").astype("Int64"), T.LongType(), F.PandasUDFType.SCALAR)


def closing_bracket(opening: str, closing: str):
    """A UDF that gives the place, from 0, of the bracket that closes the text's first one, -1 if none does or there is no such bracket."""

    def place(text: str) -> int:
        start = text.find(opening)
        return matching(text, start, opening, closing) if start >= 0 else -1

    return F.pandas_udf(lambda s: s.map(place, na_action="ignore").astype("Int64"), T.LongType(), F.PandasUDFType.SCALAR)


json_array_size = F.pandas_udf(lambda s: s.map(array_length, na_action="ignore").astype("Int64"), T.LongType(), F.PandasUDFType.SCALAR)


def strings_of(least: int = 0):
    """A UDF that reads an array of strings, repaired if need be, or plainly if too few are left."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def read(s: pd.Series) -> pd.Series:
        def one(text: str) -> list[str] | None:
            fixed = repair(text)
            found = string_array(fixed, least)
            return found if found is not None else plain_array(fixed)

        return s.map(one, na_action="ignore")

    return read


JUDGED = "struct<strategy:int,scores:map<string,struct<score:int,reasoning:string>>>"


def judge_udf(prefer: str = "array"):
    """A UDF from a judge's reply to struct(strategy, scores), null where no way succeeds."""

    @F.udf(JUDGED, useArrow=True)
    def read(reply: str):
        parsed = None if reply is None else parse_judge(reply, prefer)
        return None if parsed is None else (parsed[0], {k: v for k, v in parsed[1].items()})

    return read
