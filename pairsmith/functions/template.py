"""Prompt templates, compiled once on the driver to a Column expression.

``{{.Name}}`` gives a field, ``{{if .Name}}...{{else}}...{{end}}`` a part where the field is neither empty, zero, false nor null.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)
FIELD = re.compile(r"\.([A-Za-z_]\w*)\Z")
# Directives that no template may have.
FORBIDDEN = ("call", "define", "template", "block")


class TemplateError(ValueError):
    """The template cannot be compiled."""


@lru_cache(maxsize=1024)
def parse(text: str) -> tuple:
    """A tree of ('text', s), ('field', name) and ('if', name, then, else)."""
    root: list = []
    stack: list[tuple[str, list, list]] = []
    current, at = root, 0
    for m in TAG.finditer(text):
        if m.start() > at:
            current.append(("text", _plain(text[at : m.start()])))
        at, tag = m.end(), m.group(1)
        word = tag.split(None, 1)[0] if tag else ""
        if word in FORBIDDEN:
            raise TemplateError(f"directive {word} is not allowed")
        if word == "if":
            field = FIELD.match(tag[2:].strip())
            if not field:
                raise TemplateError(f"bad condition: {tag}")
            stack.append((field.group(1), current, []))
            current = stack[-1][2]
        elif word == "else":
            if not stack:
                raise TemplateError("else without if")
            name, outer, then = stack[-1]
            current = []
            stack[-1] = (name, outer, (then, current))
        elif word == "end":
            if not stack:
                raise TemplateError("end without if")
            name, outer, parts = stack.pop()
            then, other = parts if isinstance(parts, tuple) else (parts, [])
            outer.append(("if", name, tuple(then), tuple(other)))
            current = outer
        elif field := FIELD.match(tag):
            current.append(("field", field.group(1)))
        else:
            raise TemplateError(f"unknown tag: {tag}")
    if stack:
        raise TemplateError("if without end")
    if at < len(text):
        current.append(("text", _plain(text[at:])))
    return tuple(root)


def names(text: str) -> set[str]:
    """The fields that a template has, in conditions too."""

    def of(parts: tuple) -> set[str]:
        own = {p[1] for p in parts if p[0] != "text"}
        return own.union(*(of(p[2]) | of(p[3]) for p in parts if p[0] == "if"))

    return of(parse(text))


def _plain(text: str) -> str:
    if "{{" in text:
        raise TemplateError("unclosed braces")
    return text


def _truth(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(~text.isin("", "0", "0.0", "false"), F.lit(False))


def render(text: str, fields: dict[str, Column]) -> Column:
    """The template over columns; a field that is not among them is an error here, not in the tasks."""

    def build(parts: tuple) -> Column:
        out = []
        for part in parts:
            if part[0] == "text":
                out.append(F.lit(part[1]))
                continue
            if part[1] not in fields:
                raise TemplateError(f"no field {part[1]}")
            if part[0] == "field":
                out.append(F.coalesce(fields[part[1]].cast("string"), F.lit("")))
            else:
                out.append(F.when(_truth(fields[part[1]]), build(part[2])).otherwise(build(part[3])))
        return F.concat(*out) if out else F.lit("")

    return build(parse(text))
