"""Operator 2: toxicity by a learned lexicon, Levenshtein automata and context windows.

Lexicon: words, and beginnings of words, whose share of toxic documents among labelled training rows is far above the
usual one. The lexicon stands in a trie; a word is run through the automaton that accepts everything within one edit
of a trie path, determinised step by step, so most words die after a few letters. Each hit is weighed by the
words around it: other hits near by raise it, and hits inside quotation marks or beside words of reporting in a quotation are summed on
their own. A logistic model over these sums gives the score. As labelled texts hold few quotations, the model also learns from GENERATED
clean sample texts to which a quotation of lexicon words was added: so it weighs quoted terms by what they say about a text.

Only rows with crc32(doc_id as text) mod 3 <> 1 are learned from, and of those at most SAMPLE labelled rows (half of them
toxic while there are enough; the weights are corrected for that). Everything else reads all rows.

Defined results: a null or empty text has no hit and gets the score of such texts; rows with a null doc_id are scored and
count as not held out; rows are kept one by one; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.tokens import column_groups, forget
from sentria.runtime import materialize, read_table, release, ship, spread

SAMPLE = 8000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)
WINDOW = 8
#: Toxic documents of the sample that a term must be in, and its least likelihood ratio (twice the logarithm): of ten thousand words one gets there by chance.
LEAST_DOCUMENTS, LEAST_RATIO = 4, 15.0
GENERATED = 400
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_QUOTES = "\"“”„«»‹›‘’'`"
_REPORT = frozenset("said says say called calls call wrote writes quote quoted quotes quoting word words term terms reported stated dijo llamó palabra sagte nannte wort zitat dit disait mot appelé".split())
_ADDRESS = frozenset("you your you're u ur youre du dich dir euch tu te toi vous usted tú".split())
_PLAIN = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "€": "e"})
FEATURES = ("bias", "word", "word_share", "start", "start_share", "quoted", "reported", "address", "any")
#: A misspelled term counts as so much of a term; terms whose misspellings are ordinary words of clean documents have none.
NEAR = 0.8


def bare(token: str) -> str:
    """A white-space token in lower case, without signs at its ends."""
    return _EDGE.sub("", token.lower())


@dataclass
class Automaton:
    """Accepts words within one edit of a lexicon word; a state is a set of (trie node, edits), found lazily."""

    terms: list[str]
    edits: int = 1
    least: int = 5
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: set[int] = field(default_factory=set)
    states: list[frozenset] = field(default_factory=list)
    index: dict[frozenset, int] = field(default_factory=dict)
    moves: list[dict[str, int]] = field(default_factory=list)
    accepts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        for term in self.terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends.add(node)
        self.root = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        stack = list(pairs)
        while stack:  # skipping a letter of the term is an edit
            node, e = stack.pop()
            if best.get(node, 9) <= e:
                continue
            best[node] = e
            if e < self.edits:
                stack += [(n, e + 1) for n in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.accepts.append(min((e for n, e in key if n in self.ends), default=-1))
        return self.index[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.states[state]:
            nxt = self.children[node].get(c)
            if nxt is not None:
                out.add((nxt, e))
            if e < self.edits:
                out.add((node, e + 1))  # an added letter
                out |= {(n, e + 1) for n in self.children[node].values()}  # another letter
        to = self._state(out) if out else -1
        self.moves[state][c] = to
        return to

    def distance(self, word: str) -> int:
        """0 or 1 edits, or -1."""
        state = self.root
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return -1
        return self.accepts[state]


@dataclass
class Lexicon:
    words: dict[str, float]
    starts: dict[str, float]
    near: frozenset[str] | None = None

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """Finds lexicon hits among tokens; harmless tokens are remembered."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.near = Automaton([w for w in lexicon.words if len(w) >= 5 and (lexicon.near is None or w in lexicon.near)])
        self.lengths = sorted({len(s) for s in lexicon.starts})
        self.known: dict[str, tuple[str, float] | None] = {}

    def kind(self, token: str) -> tuple[str, float] | None:
        word = bare(token)
        lex = self.lexicon
        if word in lex.words:
            return "word", lex.words[word]
        for n in reversed(self.lengths):
            if len(word) >= n and word[:n] in lex.starts:
                return "start", lex.starts[word[:n]]
        plain = _EDGE.sub("", token.lower().translate(_PLAIN))
        if plain != word and plain in lex.words:
            return "near", NEAR
        collapsed = re.sub(r"(.)\1{2,}", r"\1", plain)
        if collapsed != plain and collapsed in lex.words:
            return "near", NEAR
        squeezed = re.sub(r"[\W_]", "", plain)
        if squeezed != plain and squeezed in lex.words:
            return "near", NEAR
        if len(plain) >= 5 and self.near.distance(plain) >= 0:
            return "near", NEAR
        return None

    def hits(self, tokens: list[str]) -> list[tuple[int, str, float]]:
        known = self.known
        fresh = [t for t in set(tokens) if t not in known]
        for t in fresh:
            known[t] = self.kind(t)
        marked = {t for t in set(tokens) if known[t]}
        out = [(i, *known[t]) for i, t in enumerate(tokens) if t in marked] if marked else []
        if len(known) > 100_000:
            known.clear()
        return out

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        hits = self.hits(tokens)
        total = dict.fromkeys(("word", "start"), 0.0)
        quoted = told = address = direct = 0.0
        places = [i for i, _, _ in hits]
        for k, (i, kind, weight) in enumerate(hits):
            window = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            context = {bare(t) for t in window}
            raw = tokens[i]
            near_hits = (k > 0 and i - places[k - 1] <= WINDOW) + (k + 1 < len(places) and places[k + 1] - i <= WINDOW)
            weight *= 1.0 + 0.25 * near_hits
            if raw[0] in _QUOTES and raw[-1].strip(".,;:!?")[-1:] in tuple(_QUOTES) or self._inside_quotes(tokens, i):
                quoted += weight
                told += weight * bool(context & _REPORT)
            else:
                total["start" if kind == "start" else "word"] += weight
                address += bool(context & _ADDRESS)
                direct += 1
        n = max(len(tokens), 1)
        out = [1.0]
        for kind in ("word", "start"):
            out += [math.log1p(total[kind]), min(1.0, 20 * total[kind] / n)]
        return [*out, math.log1p(quoted), math.log1p(told), math.log1p(address), float(direct > 0)]

    @staticmethod
    def _inside_quotes(tokens: list[str], i: int) -> bool:
        """Whether a quotation opens shortly before and closes shortly after."""
        opened = any(t[0] in "\"“„«‹‘" and t[-1:] not in "\"”»›’" for t in tokens[max(0, i - WINDOW) : i + 1])
        closed = any(t.rstrip(".,;:!?")[-1:] in tuple("\"”“»›’") for t in tokens[i : i + WINDOW + 1])
        return opened and closed


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]

    def score(self, features: list[float]) -> float:
        if not self.weights:
            return 0.0
        z = sum(w * x for w, x in zip(self.weights, features, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _lexicon(sample: DataFrame, n1: int, n0: int) -> Lexicon:
    """Terms by document counts in the sample; counted by Spark, only terms that pass the test come back."""
    token = F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+")))
    words = sample.select("toxic", "row", token.alias("token")).select("toxic", "row", F.regexp_replace("token", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word")).where("length(word) >= 3").distinct()
    parts = words.select("toxic", "row", F.explode(F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("start")), *[F.struct(F.substring("word", 1, n).alias("term"), F.lit(True).alias("start")) for n in PREFIXES])).alias("t"), F.length("word").alias("len")).select("toxic", "row", "t.*", "len")
    parts = parts.where("not start or length(term) < len").select("toxic", "row", "term", "start").distinct()
    counted = parts.groupBy("term", "start").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    odds = F.log(((F.col("c1") + 0.3) / n1) / ((F.col("c0") + 0.3) / max(n0, 1)))
    share = (F.col("c1") + F.col("c0")) / (n1 + n0)
    ratio = 2 * (F.col("c1") * F.log(F.col("c1") / n1 / share) + F.when(F.col("c0") > 0, F.col("c0") * F.log(F.col("c0") / max(n0, 1) / share)).otherwise(0.0))
    # a term stands for toxicity if nearly only toxic documents have it, and chance does not explain that
    found = counted.where(f"c1 >= {LEAST_DOCUMENTS}").withColumn("odds", odds).where(F.col("odds") >= 3.0).where(ratio >= LEAST_RATIO).orderBy(F.desc("odds"), "term", "start").collect()
    words_, starts = {}, {}
    counts = {r["term"]: r["c1"] for r in found if not r["start"]}
    for r in found:
        if not r["start"]:
            words_[r["term"]] = min(1.0, r["odds"] / 6)
    for r in sorted(found, key=lambda r: len(r["term"])):
        term = r["term"]
        # a beginning must stand for more than one word of the lexicon
        alone = max((c for w, c in counts.items() if w.startswith(term)), default=0)
        if r["start"] and sum(w.startswith(term) for w in counts) >= 2 and r["c1"] >= 1.5 * alone and not any(term[:n] in starts for n in PREFIXES if n < len(term)):
            starts[term] = min(1.0, r["odds"] / 6)
    # words that a beginning covers need no entry of their own; rare others would only fit the sample
    words_ = {w: x for w, x in words_.items() if not any(w[:n] in starts for n in PREFIXES if n < len(w))}
    return Lexicon(words_, starts)


def _one_edit(a: str, b: str) -> bool:
    """Whether one edit at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the intercept is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + shrink * w
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled training rows, chosen by a hash of their id."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(Lexicon({}, {}), [])
    take1 = min(sizes[1], max(most // 2, most - sizes[0]))
    take0 = min(sizes[0], most - take1)
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order).limit(take1).union(known.where("toxic = 0").orderBy(order).limit(take0))
    ids = spark.createDataFrame(chosen.collect(), "doc_id long, toxic int")  # at most `most` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = materialize(texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "row"), "toxicity-sample")
    sizes_ = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes_) < 2:
        release(sample)
        return Model(Lexicon({}, {}), [])
    lexicon = _lexicon(sample, sizes_[1], sizes_[0])

    def misspelled(batches):
        import pyarrow as pa

        matcher = lexicon.matcher()
        for batch in batches:
            found = [{bare(t) for i, kind, _ in matcher.hits(tokens) if kind == "near" for t in (tokens[i],)} for tokens in ((x or "").split() for x in batch.column(1).to_pylist())]
            rows = [(y, w) for y, ws in zip(batch.column(0).to_pylist(), found, strict=True) for w in sorted(ws)]
            yield pa.RecordBatch.from_pydict({"toxic": pa.array([y for y, _ in rows], pa.int32()), "word": pa.array([w for _, w in rows], pa.string())})

    near = sample.select("toxic", "text").mapInArrow(misspelled, "toxic int, word string").groupBy("word").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    ordinary = [r["word"] for r in near.where("c0 > 0 and c0 * 4 >= c1").collect()]  # words of at most `most` documents
    lexicon.near = frozenset(t for t in lexicon.words if len(t) >= 5 and not any(_one_edit(t, w) for w in ordinary))

    def run(batches):
        import pyarrow as pa

        matcher = lexicon.matcher()
        for batch in batches:
            rows = [matcher.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(0), "x": pa.array(rows, pa.list_(pa.float64()))})

    got = sample.select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").collect()
    clean = [r["text"] for r in sample.where("toxic = 0").orderBy("row").limit(GENERATED).select(F.substring("text", 1, 2000).alias("text")).collect()]
    release(sample)
    quotes = [lexicon.matcher().features(t) for t in quotations(clean, sorted(lexicon.words) or sorted(lexicon.starts))]
    x = np.array([r["x"] for r in got] + quotes)
    y = np.array([float(r["toxic"]) for r in got] + [0.0] * len(quotes))
    share = sizes[1] / (sizes[0] + sizes[1])
    real = y[: len(got)]
    weight = np.concatenate([np.where(real == 1, share / real.mean(), (1 - share) / (1 - real.mean())), np.full(len(quotes), 1.0)])
    return Model(lexicon, _logistic(x, y, weight).tolist())


def quotations(texts: list[str], terms: list[str]) -> list[str]:
    """The texts with a quotation of terms in each: reported, or between quotation marks alone."""
    frames = ("%s They said “%s” in a letter.", "%s The word \"%s\" was used.", "%s «%s» was heard.", "“%s” is a quoted term. %s")
    out = []
    for k, text in enumerate(texts if terms else []):
        said = " ".join(terms[(3 * k + 7 * i) % len(terms)] for i in range(1 + k % 3))
        frame = frames[k % len(frames)]
        out.append(frame % ((said, text) if frame[0] == "“" else (text, said)))
    return out


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted, for each row of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        matcher = model.lexicon.matcher()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": keys, "held_out": batch.column(1), "score": pa.array([model.score(matcher.features(t)) for t in texts], pa.float64())})

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    model = train(docs, labels)
    ship(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        forget()
        matcher = model.lexicon.matcher()
        for batch in batches:
            flags = []
            for a, b in column_groups(batch.column(place)):
                flags += [model.score(matcher.features(t)) < THRESHOLD for t in batch.column(place).slice(a, b - a).to_pylist()]
            yield batch.filter(pa.array(flags, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    return score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))
