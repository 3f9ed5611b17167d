"""The kernel's contracts and golden sentences."""

from __future__ import annotations

import random

import pytest

from sentria.api import Segmenter, StreamSegmenter, TextSpan
from sentria.kernel import segment
from sentria.kernel.profiles import BUILT_IN
from sentria.options import InvalidConfigurationError, SegmentationError, UnknownLanguageError
from sentria.registry import LANGUAGE_CODES, list_languages, register_language, unregister_language

# Published golden sentences.
GOLDEN = [
    ("en", "Hello World. My name is Jonas.", ["Hello World.", "My name is Jonas."]),
    ("en", "My name is Jonas E. Smith. He left.", ["My name is Jonas E. Smith.", "He left."]),
    ("en", "Please turn to p. 55. Then read.", ["Please turn to p. 55.", "Then read."]),
    ("en", "I work for the U.S. Government in Virginia.", ["I work for the U.S. Government in Virginia."]),
    ("en", "I live in the U.S. How about you?", ["I live in the U.S.", "How about you?"]),
    ("en", "Hello?! Is that you? It costs $3.50.", ["Hello?!", "Is that you?", "It costs $3.50."]),
    ("en", '"This is great." She left.', ['"This is great."', "She left."]),
    ("en", "1. The first item 2. The second item", ["1. The first item", "2. The second item"]),
    ("en", "He said yes...  They went.", ["He said yes...", "They went."]),
    ("en", "Use a format, e.g. JSON. It works.", ["Use a format, e.g. JSON.", "It works."]),
    ("de", "Er kam am 3. Mai. Es war z. B. kalt.", ["Er kam am 3. Mai.", "Es war z. B. kalt."]),
    ("es", "El Sr. García llegó. ¿Qué tal?", ["El Sr. García llegó.", "¿Qué tal?"]),
    ("hi", "सच हो। झूठ हो! क्या?", ["सच हो।", "झूठ हो!", "क्या?"]),
    ("zh", "他说：“好。”我们走了。然后回家。", ["他说：“好。”", "我们走了。", "然后回家。"]),
]


@pytest.mark.parametrize(("code", "text", "expected"), GOLDEN)
def test_golden(code, text, expected):
    assert Segmenter(code).segment(text) == expected


@pytest.mark.parametrize("code", sorted(BUILT_IN))
def test_spans_tile_any_text(code):
    r = random.Random(code)
    signs = "ab AB.!?\"'()[]«»“”„12 \n\r​　。！「」…,;:-—I.é ß😀"
    for _ in range(150):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 60)))
        for mode in segment.MODES:
            found = segment.spans(text, BUILT_IN[code], mode)
            assert "".join(text[a:b] for a, b in found) == text
            assert all(x[1] == y[0] for x, y in zip(found, found[1:], strict=False))
            bare = [x for x in (text[a:b].strip().strip(segment.ZERO_WIDTH).strip() for a, b in found) if x]
            assert segment.sentences(text, BUILT_IN[code], mode) == bare


@pytest.mark.parametrize(("code", "letter"), [("en", "a"), ("es", "y"), ("fr", "é"), ("en_legal", "a"), ("en_es_zh", "a")])
def test_spaced_small_letters_end_before_a_word(code, letter):
    head = f"Word {letter}. {letter}. {letter}."
    for mode in segment.MODES:
        for tail in ("Orat orat.", "orat orat."):
            assert segment.sentences(f"{head} {tail}", BUILT_IN[code], mode) == [head, tail]
    assert segment.sentences("ABTrade s. r. o. Bratislava.", BUILT_IN["sk"]) == ["ABTrade s. r. o. Bratislava."]


def test_empty_and_null():
    for text in (None, ""):
        assert Segmenter().segment(text) == [] and Segmenter().segment_spans(text) == []


def test_modes_move_ambiguous_boundaries_only():
    text = "Wait... She left."
    assert len(Segmenter(split_mode="conservative").segment(text)) == 1
    assert len(Segmenter().segment(text)) == 2
    assert len(Segmenter(split_mode="aggressive").segment("Wow! amazing things happen.")) == 2
    assert len(Segmenter().segment("Wow! amazing things happen.")) == 1


def test_options_are_checked_eagerly():
    with pytest.raises(InvalidConfigurationError):
        Segmenter(split_mode="wild")
    with pytest.raises(InvalidConfigurationError):
        Segmenter(doc_type="pdf")
    with pytest.raises(UnknownLanguageError) as e:
        Segmenter("xx")
    assert isinstance(e.value, SegmentationError) and isinstance(e.value, ValueError)
    with pytest.raises(InvalidConfigurationError):
        StreamSegmenter(clean=True)


def test_registry_takes_custom_profiles():
    assert len(list_languages()) == 26
    register_language("own", BUILT_IN["en"].with_abbreviations(["frobn"]))
    try:
        assert Segmenter("own").segment("See frobn. it works.") == ["See frobn. it works."]
        assert "own" in LANGUAGE_CODES and LANGUAGE_CODES.get("nope") is None and len(LANGUAGE_CODES | {}) == 27
    finally:
        unregister_language("own")
    assert "own" not in list_languages()


def test_lookahead():
    s = Segmenter()
    assert s.should_wait_for_more("I visited the U.S.")
    assert s.should_wait_for_more("An unfinished")
    assert not s.should_wait_for_more("Done!")


def test_stream_equals_batch():
    text = "Mr. Smith went. He said \"Stop.\" Then left... What? It is 3.14 here. Ok?! Yes."
    s = StreamSegmenter()
    s.feed(text)
    assert s.get_completed_sentences() + s.flush() == Segmenter().segment(text)
    s = StreamSegmenter(char_span=True)
    out = []
    for word in text.split(" "):
        s.feed(word + " ")
        out += s.get_completed_sentences()
    out += s.flush()
    assert "".join(x.sent for x in out) == text + " "
    assert all(isinstance(x, TextSpan) for x in out) and all(a.end == b.start for a, b in zip(out, out[1:], strict=False))


def test_stream_overflow_keeps_offsets():
    s = StreamSegmenter(char_span=True, max_buffer_size=10)
    first = s.feed("no mark in this text")
    assert [x.start for x in first] == [0] and s.pending_text() == ""
    s.feed("more")
    assert s.flush()[0].start == 20


def test_long_lines_stay_linear():
    import time

    began = time.process_time()
    segment.spans("word " * 20000 + ".", BUILT_IN["en"])
    segment.spans("a.b " * 25000, BUILT_IN["en"])
    segment.spans("One two. " * 80000, BUILT_IN["en"])
    segment.spans("(" * 40000 + "x. Y" + ")" * 40000, BUILT_IN["en"])
    assert time.process_time() - began < 8
