"""String columns: word counts, tagged answers, verdicts and assistant spans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Unicode whitespace class lacks the four separators U+001C..U+001F.
SPACE = r"[\s\x1C-\x1F]"

# Every whitespace character, as the class above has them.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def quote(text: str) -> str:
    """A Java regex that matches ``text`` literally."""
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", text)


def word_count(text: Column) -> Column:
    """Words between single spaces: an empty text has one, two spaces enclose one.

    Counted from byte lengths, so no array of words is built.
    """
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return spaces.cast("long") + 1


def tag_content(
    text: Column,
    tag: str | None = None,
    pair: tuple[str, str] | None = None,
    strict: bool = True,
) -> Column:
    """First text between ``<tag>`` and ``</tag>`` (or the ``pair``), trimmed.

    Case is ignored and the text may span lines. Where nothing is found, or only an
    empty text, the result is ``''`` if ``strict`` and the whole input otherwise.
    """
    if tag is None and pair is None:
        raise ValueError("give a tag or a pair of delimiters")
    left, right = pair or (f"<{tag}>", f"</{tag}>")
    pattern = f"(?isU){quote(left)}{SPACE}*(.*?){SPACE}*{quote(right)}"
    default = F.when(text.isNotNull(), F.lit("")) if strict else text
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), default)


def rule_verdict(text: Column) -> Column:
    """A rule's printed answer: only ``true`` in the answer tag passes."""
    return F.coalesce(F.lower(tag_content(text, "answer")) == "true", F.lit(False))


def judge_verdict(text: Column) -> Column:
    """A judge's reply: no reply passes, otherwise only ``yes`` in the answer tag passes."""
    return F.when(text.isNull(), F.lit(True)).otherwise(
        F.lower(tag_content(text, "answer")) == "yes"
    )
