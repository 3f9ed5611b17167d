"""Validated options and the error hierarchy; everything is checked on the driver, before a plan runs."""

from __future__ import annotations

from dataclasses import dataclass

SPLIT_MODES = ("conservative", "balanced", "aggressive")
BUFFERING_MODES = ("conservative", "balanced", "aggressive")


class SegmentationError(Exception):
    """Any error of this library."""


class InvalidConfigurationError(SegmentationError, ValueError):
    """An option has a value it must not have."""


class UnknownLanguageError(SegmentationError, ValueError):
    """No language is registered under a code."""


@dataclass(frozen=True)
class Options:
    language: str = "en"
    clean: bool = False
    doc_type: str | None = None
    split_mode: str = "balanced"

    def __post_init__(self) -> None:
        if self.split_mode not in SPLIT_MODES:
            raise InvalidConfigurationError(f"split_mode must be one of {', '.join(SPLIT_MODES)}")
        if self.doc_type not in (None, "pdf"):
            raise InvalidConfigurationError("doc_type must be None or 'pdf'")
        if self.doc_type == "pdf" and not self.clean:
            raise InvalidConfigurationError("doc_type='pdf' needs clean=True")


def check_buffering(mode: str, max_buffer_size: int | None) -> None:
    if mode not in BUFFERING_MODES:
        raise InvalidConfigurationError(f"buffering_mode must be one of {', '.join(BUFFERING_MODES)}")
    if max_buffer_size is not None and max_buffer_size <= 0:
        raise InvalidConfigurationError("max_buffer_size must be positive or None")
