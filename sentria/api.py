"""The API for single texts: segmenters without a cluster, with the kernel that the column functions use."""

from __future__ import annotations

from dataclasses import dataclass

from sentria import registry
from sentria.kernel import segment
from sentria.kernel.cleaning import clean
from sentria.options import InvalidConfigurationError, Options, check_buffering

_CLUSTER = frozenset(".!?")


@dataclass(frozen=True)
class TextSpan:
    sent: str
    start: int
    end: int


@dataclass(frozen=True)
class SegmentLookahead:
    segments: list
    should_wait_for_more: bool


class Segmenter:
    def __init__(self, language: str = "en", clean: bool = False, doc_type: str | None = None, split_mode: str = "balanced") -> None:
        self.options = Options(language if isinstance(language, str) else language.code, clean, doc_type, split_mode)
        self.profile = registry.profile(language)

    list_languages = staticmethod(registry.list_languages)

    def _text(self, text: str | None) -> str:
        o = self.options
        return (clean(text, o.doc_type, o.language) if o.clean else text) or ""

    def segment(self, text: str | None) -> list[str]:
        return segment.sentences(self._text(text), self.profile, self.options.split_mode)

    def segment_spans(self, text: str | None) -> list[TextSpan]:
        if self.options.clean:
            raise InvalidConfigurationError("spans need the text as it is: clean=False")
        return [TextSpan(text[a:b], a, b) for a, b in segment.spans(text, self.profile, self.options.split_mode)]

    def segment_clean(self, text: str | None) -> list[str]:
        return segment.sentences(clean(text, self.options.doc_type, self.options.language), self.profile, self.options.split_mode)

    def should_wait_for_more(self, text: str | None) -> bool:
        return segment.waits(self._text(text), self.profile, self.options.split_mode)

    def segment_with_lookahead(self, text: str | None) -> SegmentLookahead:
        text = self._text(text)
        found, waits = segment.lookahead(text, self.profile, self.options.split_mode)
        return SegmentLookahead(segment.shown(text, found), waits)

    def segment_spans_with_lookahead(self, text: str | None) -> SegmentLookahead:
        if self.options.clean:
            raise InvalidConfigurationError("spans need the text as it is: clean=False")
        found, waits = segment.lookahead(text, self.profile, self.options.split_mode)
        return SegmentLookahead([TextSpan(text[a:b], a, b) for a, b in found], waits)


@dataclass
class StreamState:
    """What a stream keeps: the tail that is not yet emitted, and how many places came before it."""

    buffer: str = ""
    offset: int = 0
    wait: bool = False


def advance(state: StreamState, delta: str | None, profile, mode: str = "balanced", buffering: str = "conservative", most: int | None = None) -> list[TextSpan]:
    """Add text to a stream; the spans that have become stable, with offsets in the whole stream."""
    out: list[TextSpan] = []
    if delta:
        state.buffer += delta
        found, state.wait = segment.lookahead(state.buffer, profile, mode)
        cut = 0
        for i, (a, b) in enumerate(found):
            last = i == len(found) - 1
            if not last and b < len(state.buffer) and state.buffer[b - 1] in _CLUSTER and state.buffer[b] in _CLUSTER:
                break
            if last and (segment.terminal(state.buffer[a:b].rstrip(), profile) is None or buffering != "aggressive" and state.wait):
                break
            out.append(TextSpan(state.buffer[a:b], state.offset + a, state.offset + b))
            cut = b
        state.buffer, state.offset = state.buffer[cut:], state.offset + cut
    if most is not None and len(state.buffer) > most:
        out += finish(state, profile, mode)
    return out


def finish(state: StreamState, profile, mode: str = "balanced") -> list[TextSpan]:
    """Everything that is left of a stream; offsets go on."""
    out = [TextSpan(state.buffer[a:b], state.offset + a, state.offset + b) for a, b in segment.spans(state.buffer, profile, mode)]
    state.offset += len(state.buffer)
    state.buffer, state.wait = "", False
    return out


class StreamSegmenter:
    def __init__(self, language: str = "en", clean: bool = False, char_span: bool = False, split_mode: str = "balanced", buffering_mode: str = "conservative", max_buffer_size: int | None = None) -> None:
        if clean:
            raise InvalidConfigurationError("a stream cannot be cleaned: clean the text before streaming it")
        check_buffering(buffering_mode, max_buffer_size)
        self.options = Options(language, split_mode=split_mode)
        self.profile = registry.profile(language)
        self.char_span, self.buffering_mode, self.max_buffer_size = char_span, buffering_mode, max_buffer_size
        self.reset()

    def reset(self) -> None:
        self.state, self._done = StreamState(), []

    def _shown(self, spans: list[TextSpan]) -> list:
        if self.char_span:
            return spans
        bare = (s.sent.strip().strip(segment.ZERO_WIDTH).strip() for s in spans)
        return [x for x in bare if x]

    def feed(self, delta: str | None) -> list | None:
        out = advance(self.state, delta, self.profile, self.options.split_mode, self.buffering_mode)
        self._done += out
        if self.max_buffer_size is not None and len(self.state.buffer) > self.max_buffer_size:
            spans, self._done = self._done + finish(self.state, self.profile, self.options.split_mode), []
            return self._shown(spans)
        return None

    def get_completed_sentences(self) -> list:
        out, self._done = self._done, []
        return self._shown(out)

    def pending_text(self) -> str:
        return self.state.buffer

    def is_complete(self) -> bool:
        return not self.state.buffer.strip() or not self.state.wait

    def flush(self) -> list:
        out = self._done + finish(self.state, self.profile, self.options.split_mode)
        self.reset()
        return self._shown(out)
