"""Language registry of the driver. Profiles travel to executors by value, inside a function's closure."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

from pyspark.sql import DataFrame, SparkSession

from sentria.kernel.profiles import BUILT_IN, Profile
from sentria.options import InvalidConfigurationError, UnknownLanguageError


class LanguageCodes(MutableMapping):
    """Code to profile, with the whole protocol of a dictionary."""

    def __init__(self, items: dict[str, Profile] | None = None) -> None:
        self._items = dict(BUILT_IN if items is None else items)

    def __getitem__(self, code: str) -> Profile:
        return self._items[code]

    def __setitem__(self, code: str, profile: Profile) -> None:
        if not isinstance(profile, Profile):
            raise InvalidConfigurationError("a language is registered as a Profile")
        self._items[code] = profile

    def __delitem__(self, code: str) -> None:
        del self._items[code]

    def __iter__(self) -> Iterator[str]:
        return iter(self._items)

    def __len__(self) -> int:
        return len(self._items)

    def __or__(self, other) -> LanguageCodes:
        return LanguageCodes(self._items | dict(other))

    def __ror__(self, other) -> LanguageCodes:
        return LanguageCodes(dict(other) | self._items)

    def copy(self) -> LanguageCodes:
        return LanguageCodes(self._items)


LANGUAGE_CODES = LanguageCodes()


def profile(code: str | Profile) -> Profile:
    if isinstance(code, Profile):
        return code
    if code not in LANGUAGE_CODES:
        raise UnknownLanguageError(f"unknown language {code!r}; known: {', '.join(list_languages())}")
    return LANGUAGE_CODES[code]


def register_language(code: str, new: Profile) -> None:
    LANGUAGE_CODES[code] = new


def unregister_language(code: str) -> None:
    if code not in LANGUAGE_CODES:
        raise UnknownLanguageError(f"unknown language {code!r}")
    del LANGUAGE_CODES[code]


def list_languages() -> list[str]:
    return sorted(LANGUAGE_CODES)


def languages(spark: SparkSession) -> DataFrame:
    """The registry as a dimension table."""
    rows = [(c, p.family, sorted(p.marks)) for c, p in sorted(LANGUAGE_CODES.items())]
    return spark.createDataFrame(rows, "code string, family string, terminals array<string>")


def lexicon(spark: SparkSession) -> DataFrame:
    """Abbreviations by language and class."""
    rows = [(c, w, w in p.before_name, w in p.before_number) for c, p in sorted(LANGUAGE_CODES.items()) for w in sorted(p.short | p.before_name | p.before_number)]
    return spark.createDataFrame(rows, "lang string, abbr string, is_prepositive boolean, is_number boolean")
