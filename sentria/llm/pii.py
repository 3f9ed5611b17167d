"""Operator 10: personal data by fixed patterns and a semi-Markov conditional random field.

The four base kinds are matched by pattern and always stay. The field adds spans that the patterns miss: addresses written
with words for signs, numbers without a country code, cards with other separators. Its segments are whole candidate
entities of bounded length, scored by whole-span features (shape, digit counts, checks, words before); everything
between is background. Dynamic programming over segments of at most MOST_PIECES pieces chooses boundaries and kinds
jointly. Weights are learned here on generated lines with known spans: they maximise the conditional likelihood of the right segmentation,
whose normaliser and expected features come from forward and backward sums over all segmentations.

Defined results: a null or empty text holds nothing (the hash of the empty string, an empty list); rows are kept one by
one; a span is found however long the text is, as regions without digits or signs cannot hold one.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.tokens import column_groups, forget
from sentria.runtime import read_table, ship, spread

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that pass its check, by start and kind."""
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        # the sign is in neither class, so the leftmost start is the run of name characters before it
        begin = max(last, m.start() - len(_LOCAL_BACK.match(text[max(last, m.start() - 4096) : m.start()][::-1])[0]))
        if m.start() - begin >= 4096:
            begin = max(last, m.start() - len(_LOCAL_BACK.match(text[last : m.start()][::-1])[0]))
        if begin < m.start():
            out.append((begin, m.end(), "email"))
            last = m.end()
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the field -------------------------------------------------------------------------------------------------

#: Pieces of a region, and the most of them that one entity may hold.
_PIECE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?=\s{0,3}[(\[{<]?\s{0,3}(?:at|arroba|chez|AT|At)\b)|[0-9]+|[^\W\d_]+|[^\w\s]|_|\s+")
MOST_PIECES = 24
_AT = re.compile(r"(?i)[(\[{<]\s*(?:at|arroba|chez)\s*[)\]}>]|\s(?:at|arroba)\s(?=\S+\s+(?:dot|punto|punkt|point)\s)")
#: Signs and words of a written-out address may stand up to three blanks apart.
_WORDY_MAIL = re.compile(r"(?i)[a-z0-9._%+-]+\s{0,3}[(\[{<]?\s{0,3}(?:at|arroba|chez|@)\s{0,3}[)\]}>]?\s{0,3}[a-z0-9-]+(?:\s{0,3}[(\[{<]?\s{0,3}(?:\.|dot|punto|punkt|point)\s{0,3}[)\]}>]?\s{0,3}[a-z0-9-]+)+")
_NUMBER_RUN = re.compile(r"[+(]?[0-9][0-9 ()./\-]*[0-9]")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CUES = {
    "email": ("email", "e-mail", "mail", "correo", "courriel", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "karte", "tarjeta", "carte", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "teléfono", "téléphone", "whatsapp", "dial"),
}
_CUE_KIND = {w: k for k, ws in _CUES.items() for w in ws}
_BEFORE = re.compile(r"[^\W\d_][\w-]*")


def _features(text: str, begin: int, end: int, kind: str, cue: str) -> list[str]:
    s = text[begin:end]
    digits = _DIGIT.findall(s)
    n = len(digits)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", re.sub(r"\s+", " ", s)))
    out = [f"{kind}|bias", f"{kind}|digits={n if n < 20 else 20}", f"{kind}|shape={shape[:24]}", f"{kind}|cue={cue}", f"{kind}|groups={min(shape.count('9'), 8)}"]
    if kind == "card":
        out.append(f"card|luhn={n >= 14 and luhn(''.join(digits))}")
    if kind == "ip":
        parts = s.split(".")
        out.append(f"ip|quad={len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}")
    if kind == "email":
        out.append(f"email|wordy={bool(_WORDY_MAIL.fullmatch(s))}")
        out.append(f"email|bracket={bool(re.search('[(<{[]', s))}")
    if kind == "phone":
        out.append(f"phone|plausible={7 <= n <= 15}")
        out.append(f"phone|mixed={len(set(re.findall('[ ().-]', s)))}")
    inside_left = begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "._@")
    inside_right = end < len(text) and (text[end].isalnum() or text[end] == "@")
    out.append(f"{kind}|cut={inside_left}{inside_right}")
    return out


def regions(text: str, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Stretches of text[begin:end] that can hold an entity: around number runs of at least 7 digits, and around written-out addresses."""
    found = []
    end = len(text) if end is None else end
    if _DIGIT.search(text, begin, end):
        found += [(m.start(), m.end()) for m in _NUMBER_RUN.finditer(text, begin, end) if m.end() - m.start() >= 7 and len(_DIGIT.findall(m[0])) >= 7]
    lowered = text[begin:end].lower()
    if any(w in lowered for w in ("(at)", "[at]", "{at}", "<at>", " at ", "arroba", "chez")):
        for m in _AT.finditer(text, begin, end):
            name_end = m.start()
            while name_end > begin and name_end > m.start() - 3 and text[name_end - 1].isspace():
                name_end -= 1
            left = name_end
            while left > begin and text[left - 1] in _NAME:
                left -= 1
            if left < name_end and (x := _WORDY_MAIL.match(text, left, end)) and x.end() > m.end():
                found.append((x.start(), x.end()))
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _cue(text: str, begin: int) -> str:
    words = _BEFORE.findall(text[max(0, begin - 24) : begin].lower())
    for w in reversed(words[-2:]):
        if w in _CUE_KIND:
            return _CUE_KIND[w]
    return "none"


def candidates(text: str, begin: int, end: int) -> tuple[int, list[tuple[int, int, Span, list[str]]]]:
    """Number of pieces of a region, and its candidate segments: (first piece, piece after, span, features), by their end."""
    pieces = [(m.start(), m.end()) for m in _PIECE.finditer(text, begin, end)]
    cue = _cue(text, begin)
    out = []
    for j in range(1, len(pieces) + 1):
        if not text[pieces[j - 1][1] - 1].isalnum():
            continue
        for i in range(max(0, j - MOST_PIECES), j):
            a, b = pieces[i][0], pieces[j - 1][1]
            if b - a >= 7 and (text[a].isalnum() or text[a] in "+("):
                out += [(i, j, (a, b, kind), _features(text, a, b, kind, cue)) for kind in KINDS]
    return len(pieces), out


def decode(text: str, begin: int, end: int, weights: dict[str, float]) -> list[Span]:
    """The best segmentation of one region: semi-Markov Viterbi, entities of bounded length, background pieces score 0."""
    n, segments = candidates(text, begin, end)
    best: list[float] = [0.0]
    back: list[tuple[int, Span | None]] = [(0, None)]
    at = 0
    for j in range(1, n + 1):
        score, step = best[j - 1], (j - 1, None)
        while at < len(segments) and segments[at][1] == j:
            i, _, span, features = segments[at]
            s = best[i] + sum(weights.get(f, 0.0) for f in features)
            if s > score:
                score, step = s, (i, span)
            at += 1
        best.append(score)
        back.append(step)
    out, j = [], n
    while j:
        j, span = back[j]
        if span:
            out.append(span)
    return out[::-1]


def marginals(n: int, segments: list[tuple[int, int]], scores: list[float]) -> tuple[float, list[float]]:
    """The log of the sum over all segmentations, and each segment's probability, by forward and backward sums.

    ``segments`` are (first piece, piece after), by their end.
    """
    def added(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for x, (i, j) in enumerate(segments):
        ending[j].append(x)
        starting[i].append(x)
    forward = [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = added([forward[j - 1], *(forward[segments[x][0]] + scores[x] for x in ending[j])])
    backward = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        backward[i] = added([backward[i + 1], *(backward[segments[x][1]] + scores[x] for x in starting[i])])
    return forward[n], [math.exp(forward[i] + scores[x] + backward[j] - forward[n]) for x, (i, j) in enumerate(segments)]


def _example(r: random.Random) -> tuple[str, list[Span]]:
    """A generated line, and its spans."""
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    parts, spans = [" ".join(word() for _ in range(r.randint(0, 5))), " "], []

    def put(s: str, kind: str | None = None) -> None:
        at = sum(map(len, parts))
        if kind:
            spans.append((at, at + len(s), kind))
        parts.append(s)

    def card(sep: str, groups: tuple[int, ...]) -> str:
        n = d(sum(groups) - 1)
        n += next(c for c in "0123456789" if luhn(n + c))
        out, at = [], 0
        for g in groups:
            out.append(n[at : at + g])
            at += g
        return sep.join(out)

    case = r.randrange(12)
    cue = lambda k: put(r.choice(_CUES[k]) + r.choice((" ", ": "))) if r.random() < 0.7 else None
    if case == 0:
        cue("email")
        at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", ".")))
        put(f"{word()}{r.choice(('.', '_', ''))}{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr'))}", "email")
    elif case == 1:
        cue("card")
        put(card(r.choice((".", "/", "  ")), (4, 4, 4, 4)), "card")
    elif case in (2, 3):
        put(r.choice(_CUES["phone"]) + r.choice((" ", ": ")))
        put(r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)}/{d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(6)}")), "phone")
    elif case == 4:
        put(f"({d(3)}) {d(3)}-{d(4)}", "phone")
    elif case == 5:
        put(d(16 if r.random() < 0.7 else r.choice((9, 11, 13, 20))))  # a number that names nothing
    elif case == 6:
        put(f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {d(2)}{d(2)}")
    elif case == 7:
        put(".".join(str(r.randint(0, 255)) for _ in range(4)))  # the base pattern has it
    elif case == 8:
        put(f"{word()} at {word()} {word()}")
    elif case == 9:
        put(f"{d(2)}/{d(2)}/{d(4)}")
    elif case == 10:
        put(f"{d(3)}.{d(3)}.{d(3)}" if r.random() < 0.5 else f"{d(1)},{d(3)},{d(3)}")
    else:
        put("".join(r.choice("0123456789abcdef") for _ in range(40)))
    put(" " + " ".join(word() for _ in range(r.randint(0, 4))))
    return "".join(parts), spans


@lru_cache(maxsize=2)
def learned_weights(examples: int = 1500, passes: int = 4, seed: int = 7, rate: float = 0.5, ridge: float = 1e-4) -> dict[str, float]:
    """Weights of the largest conditional likelihood over generated lines, by gradient steps of adaptive size."""
    r = random.Random(seed)
    cases = []
    for _ in range(examples):
        text, spans = _example(r)
        for a, b in regions(text):
            n, segments = candidates(text, a, b)
            gold = {s for s in spans if a <= s[0] and s[1] <= b}
            if gold <= {x[2] for x in segments}:
                cases.append((n, [(i, j) for i, j, _, _ in segments], [x[3] for x in segments], [float(x[2] in gold) for x in segments]))
    w: dict[str, float] = {}
    square: dict[str, float] = {}
    for _ in range(passes):
        for n, places, features, gold in cases:
            scores = [sum(w.get(f, 0.0) for f in fs) for fs in features]
            slope: dict[str, float] = {}
            for fs, p, g in zip(features, marginals(n, places, scores)[1], gold, strict=True):
                if abs(g - p) > 1e-4:
                    for f in fs:
                        slope[f] = slope.get(f, 0.0) + g - p
            for f, v in slope.items():
                v -= ridge * w.get(f, 0.0)
                square[f] = square.get(f, 0.0) + v * v
                w[f] = w.get(f, 0.0) + rate * v / math.sqrt(square[f] + 1e-8)
    return w


def find_spans(text: str | None, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those of the field that overlap none of them.

    A region that holds base spans is cut at them, and what stands between is searched again.
    """
    if not text:
        return [], []
    base = base_spans(text)
    extra = []
    taken = sorted((a, b) for a, b, _ in base)
    first = 0
    for a, b in regions(text):
        while first < len(taken) and taken[first][1] <= a:
            first += 1
        at, i, parts = a, first, []
        while i < len(taken) and taken[i][0] < b:
            x, y = taken[i]
            if y > at:
                parts += regions(text, at, x) if x > at else []
                at = y
            i += 1
        parts += [(a, b)] if at == a else regions(text, at, b) if at < b else []
        for x, y in parts:
            extra += decode(text, x, y, weights)
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans their union, by the first kind."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    spans = sorted(spans)
    while i < len(spans):
        a, b, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256 and spans, for each row of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    weights = learned_weights()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [find_spans(t, weights) for t in texts]
            columns = {"doc_id": pa.array(keys, pa.int64())}
            for kind in KINDS:
                columns[f"n_{kind}"] = pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            columns["spans"] = pa.array([_joined(spans) for _, spans in found], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with found spans masked in ``text``; ``n_chars`` follows where it exists."""
    ship(docs.sparkSession)
    weights = learned_weights()
    place = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        import pyarrow as pa

        forget()
        for batch in batches:
            for a, b in column_groups(batch.column(place), 1_000_000):
                part = batch.slice(a, b - a)
                texts = part.column(place).to_pylist()
                new = [masked(t, find_spans(t, weights)[1]) for t in texts]
                columns = list(part.columns)
                columns[place] = pa.array(new, part.schema.field(place).type)
                if length is not None:
                    columns[length] = pa.array([o if x == t else len(x) for t, x, o in zip(texts, new, columns[length].to_pylist(), strict=True)], part.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spread(read_table(spark, sf_dir, "documents")))
