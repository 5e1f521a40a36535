"""Text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags that enclose reasoning, case ignored.
THINK = r"(?i)<think(?:ing)?>([\s\S]*?)</think(?:ing)?>"
THINK_CHINESE = r"(?i)<思考>([\s\S]*?)</思考>"

# A reply is cut where the earliest of these begins.
META_PHRASES = (
    "we don't want too many lines",
    "sure! let's start over",
    "let's start over",
    "i realize i wrote a confusing mixture of flows",
    "i realize i wrote a confusing mixture",
    "i'll rewrite and incorporate all",
)


#: Unicode's white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utrim(text: Column) -> Column:
    """Trim all Unicode white space from both ends; Spark's own trim takes spaces only. What lies between is not looked at."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(utrim(text) == "", F.lit(True))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def has_think(text: Column) -> Column:
    """Whether the text holds an enclosed block of reasoning."""
    return text.rlike(THINK) | text.rlike(THINK_CHINESE)


def think_content(text: Column) -> Column:
    """The trimmed contents of all blocks, Latin tags before Chinese ones, a blank line between; empty without any."""
    blocks = F.concat(F.regexp_extract_all(text, F.lit(THINK), F.lit(1)), F.regexp_extract_all(text, F.lit(THINK_CHINESE), F.lit(1)))
    return F.array_join(F.transform(blocks, utrim), "\n\n")


def without_think(text: Column) -> Column:
    """The text without its blocks, trimmed."""
    return utrim(F.regexp_replace(F.regexp_replace(text, THINK, ""), THINK_CHINESE, ""))


def split_think(text: Column) -> Column:
    """struct(think, answer)."""
    return F.struct(think_content(text).alias("think"), without_think(text).alias("answer"))


def wrap_think(reasoning: Column) -> Column:
    """The reasoning in tags on lines of their own; empty for none."""
    return F.when(F.coalesce(reasoning, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>")))


def combine_reasoning(reasoning: Column, content: Column) -> Column:
    """Enclosed reasoning, a blank line, the content; the content alone without reasoning."""
    return F.when(F.coalesce(reasoning, F.lit("")) == "", content).otherwise(F.concat(wrap_think(reasoning), F.lit("\n\n"), content))


def _any_case(phrase: str) -> str:
    """A pattern of the phrase, case ignored as simple case folding has it: of other letters than A-Z two fold to one of these."""
    folds = {"s": "[s\u017f]", "k": "[k\u212a]"}
    return "".join(folds.get(c) or (c if c.isalnum() or c == " " else "\\" + c) for c in phrase)


META = f"(?i)(?:{'|'.join(_any_case(p) for p in META_PHRASES)})[\\s\\S]*"


def clean_meta(text: Column) -> Column:
    """Cut a reply where it begins to talk about itself, unless nothing would be left; a blank text stays as it is."""
    cut = lambda t: F.when(t == "", text).otherwise(F.coalesce(F.nullif(utrim(F.regexp_replace(t, META, "")), F.lit("")), t))
    return let(utrim(text), cut)


def truncate(text: Column, most: int) -> Column:
    """The first ``most`` characters and an ellipsis, if there are more."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def has_control_characters(text: Column) -> Column:
    """Control characters other than line feed, tab and carriage return."""
    return text.rlike(r"[\p{Cc}&&[^\n\t\r]]")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return let(text, lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(p)) for p in phrases)))


def first_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """The first of the phrases, in their order, that the text contains."""
    return let(text, lambda t: F.coalesce(*(F.when(F.contains(t, F.lit(p)), F.lit(p)) for p in phrases)))
