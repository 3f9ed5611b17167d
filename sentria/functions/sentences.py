"""Column functions over texts: one Arrow-batched kernel call a row, no shuffle, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sentria import registry
from sentria.functions.arrow import SPANS, column_function
from sentria.functions.clean import clean_text
from sentria.kernel import cleaning, scores, segment
from sentria.kernel.profiles import Profile
from sentria.options import SPLIT_MODES, InvalidConfigurationError, Options
from sentria.runtime import ship

LOOKAHEAD = f"struct<segments:{SPANS},should_wait_for_more:boolean>"


def _spans(text: str | None, p: Profile, mode: str) -> tuple[str, list]:
    return text or "", segment.spans(text, p, mode)


def _lookahead(text: str | None, p: Profile, mode: str) -> tuple[tuple, bool]:
    found, waits = segment.lookahead(text, p, mode)
    return (text or "", found), waits


#: Kernel functions of (text, profile, mode) and what they return.
KERNELS: dict[str, tuple[Callable, str]] = {
    "sentences": (segment.sentences, "array<string>"),
    "sentence_spans": (_spans, SPANS),
    "should_wait": (segment.waits, "boolean"),
    "sentences_lookahead": (_lookahead, LOOKAHEAD),
    "protected_periods": (segment.protected, "array<int>"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _applied(name: str, text: Column | str, language: str | Profile | Column, mode: str) -> Column:
    """A column of kernel results; ``language`` may be a code, a profile, or a column of codes."""
    Options(split_mode=mode)
    kernel, returns = KERNELS[name]
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    if isinstance(language, Column):
        if returns.startswith("struct"):
            raise InvalidConfigurationError("a struct result needs one language for the whole column")
        known = dict(registry.LANGUAGE_CODES)
        return column_function(lambda text, code: kernel(text, known[code], mode) if code in known else None, returns)(_col(text), language)
    chosen = registry.profile(language)
    return column_function(lambda text: kernel(text, chosen, mode), returns)(_col(text))


def sentences(text: Column | str, language: str | Profile | Column = "en", mode: str = "balanced") -> Column:
    """The sentences of a text; null and empty texts have none. Rows of an unknown language code are null."""
    return _applied("sentences", text, language, mode)


def sentence_spans(text: Column | str, language: str | Profile | Column = "en", mode: str = "balanced") -> Column:
    """Contiguous spans (sent, start, end in code points) that tile the text."""
    return _applied("sentence_spans", text, language, mode)


def sentences_clean(text: Column | str, language: str = "en", mode: str = "balanced", doc_type: str | None = None) -> Column:
    """Sentences of the cleaned text, in one call."""
    Options(language, True, doc_type, mode)
    chosen = registry.profile(language)
    return column_function(lambda t: segment.sentences(cleaning.clean(t, doc_type, language), chosen, mode), "array<string>")(_col(text))


def should_wait(text: Column | str, language: str | Profile | Column = "en", mode: str = "balanced") -> Column:
    """Whether more text could move the last boundary."""
    return _applied("should_wait", text, language, mode)


def sentences_lookahead(text: Column | str, language: str | Profile = "en", mode: str = "balanced") -> Column:
    """Spans and the verdict of :func:`should_wait`; the text is read once."""
    return _applied("sentences_lookahead", text, language, mode)


def protected_periods(text: Column | str, language: str | Profile | Column = "en", mode: str = "balanced") -> Column:
    """Places of the periods that end no sentence, for debugging."""
    return _applied("protected_periods", text, language, mode)


def register(spark: SparkSession) -> None:
    """SQL functions; arguments in brackets may be left out.

    ``sentences``, ``sentence_spans``, ``should_wait``, ``sentences_lookahead``, ``protected_periods`` and ``sentences_clean``
    (text[, language[, mode]]); ``clean_text`` (text[, language[, doc_type]]); ``strip_zero_width`` (text); ``terminal_punct``
    (text[, language]); ``boundary_f1`` (pred, gold); the table function ``explode_sentences`` (text[, language[, mode]]).
    Rows of an unknown language or mode are null, and have no sentences in the table function.
    """
    ship(spark)
    known = dict(registry.LANGUAGE_CODES)

    def by_language(kernel: Callable) -> Callable:
        def run(text: str | None, code: str = "en", mode: str = "balanced"):
            return kernel(text, known[code], mode) if code in known and mode in SPLIT_MODES else None

        return run

    for name, (kernel, returns) in KERNELS.items():
        if not returns.startswith("struct"):
            spark.udf.register(name, column_function(by_language(kernel), returns))
    waiting = lambda text, code="en", mode="balanced": _lookahead(text, known[code], mode) if code in known and mode in SPLIT_MODES else (None, None)
    spark.udf.register("sentences_lookahead", column_function(waiting, LOOKAHEAD))
    spark.udf.register("sentences_clean", column_function(by_language(lambda t, p, mode: segment.sentences(cleaning.clean(t, None, p.code), p, mode)), "array<string>"))
    spark.udf.register("clean_text", column_function(lambda t, code="en", doc_type=None: cleaning.clean(t, doc_type, code) if code in known and doc_type in (None, "pdf") else None, "string"))
    spark.udf.register("strip_zero_width", column_function(cleaning.strip_zero_width, "string"))
    spark.udf.register("terminal_punct", column_function(lambda t, code="en": cleaning.terminal_mark(t, known[code].marks) if code in known else None, "string"))
    spark.udf.register("boundary_f1", column_function(scores.boundary_f1, "double"))

    @F.udtf(returnType="sent_id int, sent string, start int, end int")
    class ExplodeSentences:
        def eval(self, text: str, code: str = "en", mode: str = "balanced"):
            if code in known and mode in SPLIT_MODES:
                for i, (a, b) in enumerate(segment.spans(text, known[code], mode)):
                    yield i, text[a:b], a, b

    spark.udtf.register("explode_sentences", ExplodeSentences)


__all__ = ["clean_text", "protected_periods", "register", "sentence_spans", "sentences", "sentences_clean", "sentences_lookahead", "should_wait"]
