"""Cleaning and normalisation as column functions.

The cleaner and its steps run in Arrow batches: a chain of Java regular expressions over the same texts takes many times as
long (README). Short rewrites that one expression holds stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sentria.functions.arrow import column_function
from sentria.kernel import cleaning
from sentria.kernel.cleaning import ZERO_WIDTH, clean
from sentria.runtime import ship

_WHITE = r"\s\x1c-\x1f\x85\xa0  -     　"
_CLOSING = r"[\"'”’»)\]}」』】）》›]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _step(kernel: Callable[[str], str], c: Column | str) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return column_function(lambda t: kernel(t) if t else t, "string")(_col(c))


def clean_text(c: Column | str, doc_type: str | None = None, language: str = "en") -> Column:
    """The whole cleaner: line breaks, markup, quotes, dot leaders, missing blanks. Null stays null, empty stays empty."""
    return _step(lambda t: clean(t, doc_type, language), c)


def escapes(c: Column | str) -> Column:
    """Written line breaks become line breaks."""
    return _step(cleaning.unescape, c)


def strip_tags(c: Column | str) -> Column:
    """Without markup tags, plain and escaped."""
    return _step(cleaning.strip_tags, c)


def drop_repeats(c: Column | str) -> Column:
    return _step(cleaning.drop_repeats, c)


def plain_quotes(c: Column | str) -> Column:
    return F.replace(F.translate(_col(c), "`", "'"), F.lit("''"), F.lit('"'))


def strip_zero_width(c: Column | str) -> Column:
    """Without zero-width signs in the white space at either end; those inside words stay."""
    c = _col(c)
    edge = f"[{_WHITE}{ZERO_WIDTH}]"
    head = F.regexp_extract(c, rf"\A({edge}*)", 1)
    body = F.substring(c, F.length(head) + 1, F.length(c))
    core = F.regexp_replace(body, rf"{edge}+\z", "")
    tail = F.substring(body, F.length(core) + 1, F.length(body))
    bare = lambda x: F.translate(x, ZERO_WIDTH, "")
    return F.concat(bare(head), core, bare(tail))


def terminal_mark(c: Column | str, language: str = "en") -> Column:
    """The sentence mark of the language that a text ends with, closers aside; null if it ends without one."""
    from sentria import registry

    marks = "".join(sorted(registry.profile(language).marks))
    found = F.regexp_extract(_col(c), rf"([{re.escape(marks)}])(?:{_CLOSING}|[{_WHITE}{ZERO_WIDTH}])*\z", 1)
    return F.nullif(found, F.lit(""))


def hard_lines(c: Column | str) -> Column:
    """Pieces between line breaks, without empty ones."""
    return F.filter(F.split(_col(c), "[\r\n]", -1), lambda x: x != "")
