"""Sentence boundaries in SQL, word by word, for prose in the Latin script.

Written apart from the kernel: a text is cut at white space, and each word decides from itself, the white space behind it and the next word
whether a sentence ends. Quotations, lists and other constructs that the tables' prose lacks are not expressed.
"""

from __future__ import annotations

from sentria import registry

_CODES = ("en", "de", "es", "fr")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) or "''"


def _words(field: str) -> str:
    """Whether the word is in a list of the row's language."""
    return "(" + " OR ".join(f"(lang = '{code}' AND low IN ({_list(getattr(registry.LANGUAGE_CODES[code], field))}))" for code in _CODES) + ")"


def sentence_rows(source: str, mode: str = "balanced", name: str = "sentence_rows") -> str:
    """Common table expressions that end in ``name(key, sent_id, sent, start, end)``; ``source`` selects key, text and lang."""
    upper = "[A-ZÀ-ÖØ-ÞŒŸ]"
    lower = "[a-zß-öø-ÿœ]"
    conservative, aggressive = mode == "conservative", mode == "aggressive"
    return f"""
src AS (SELECT key, coalesce(text, '') AS text, lang FROM ({source})),
cut AS (SELECT key, lang, regexp_extract_all(text, '^[ \\t\\r\\n]+|[^ \\t\\r\\n]+[ \\t\\r\\n]*') AS w FROM src),
tok AS (SELECT key, lang, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS piece FROM cut),
part AS (SELECT key, lang, i, piece, rtrim(piece, chr(32) || chr(9) || chr(10) || chr(13)) AS word, regexp_matches(piece, '[\\r\\n]') AS breaks FROM tok),
near AS (
  SELECT *, lead(word) OVER (PARTITION BY key ORDER BY i) AS next, lag(word) OVER (PARTITION BY key ORDER BY i) AS before,
    coalesce(lag(breaks) OVER (PARTITION BY key ORDER BY i), true) AS opens, regexp_extract(word, '[.!?]+$') AS run,
    regexp_replace(regexp_extract(regexp_replace(word, '[.!?]+$', ''), '[^"“”„«»()\\[\\]{{}}]*$'), '^[''’‘/,;:–—-]+', '') AS bare FROM part),
kind AS (SELECT *, lower(bare) AS low, coalesce(regexp_replace(next, '^["''“‘«(\\[{{_]+', ''), '') AS follows FROM near),
named AS (SELECT *, follows SIMILAR TO '{upper}.*' AS capital, follows SIMILAR TO '{lower}.*' AS small, follows SIMILAR TO '[0-9].*' AS digit,
    CASE WHEN regexp_matches(bare, '^{upper}$') AND NOT {_words('before_name')} THEN 'initial' WHEN {_words('before_name')} THEN 'title'
      WHEN {_words('before_number')} THEN 'number' WHEN {_words('short')} THEN 'short' ELSE '' END AS form FROM kind),
judged AS (SELECT *, CASE
    WHEN run = '' OR next IS NULL THEN false
    WHEN run IN ('!', '?') THEN {'true' if aggressive else "run = '?' OR NOT regexp_matches(follows, '^[a-z]')"}
    WHEN run <> '.' THEN (length(run) < 3 AND run <> '..') OR capital
    WHEN regexp_matches(bare, '[0-9]$') THEN NOT (opens AND regexp_matches(bare, '^[0-9]{{1,2}}$')) AND NOT (lang = 'de' AND regexp_matches(bare, '^-?[1-9]?[0-9]$'))
    WHEN lang = 'de' AND regexp_matches(bare, '^{lower}$') THEN false
    WHEN regexp_matches(bare, '^({upper}|{lower})$') AND regexp_matches(next, '^({upper}|{lower})[.](,|$)') AND (regexp_matches(bare, '^{lower}$') OR capital) THEN false
    WHEN form = '' THEN true
    WHEN form = 'title' THEN {"low = 'st' AND capital" if aggressive else 'false'}
    WHEN form = 'initial' THEN lang = 'en' AND bare = 'I' AND capital AND NOT opens AND NOT regexp_matches(coalesce(before, ''), '^{upper}')
    WHEN form = 'number' AND (digit OR next LIKE '(%' OR regexp_matches(follows, '^[IVXLCDM]+$')) THEN false
    WHEN form = 'number' AND capital THEN {'false' if conservative else 'true'}
    WHEN lang = 'de' THEN false
    WHEN capital THEN true
    ELSE NOT (small OR digit OR follows LIKE '§%' OR follows LIKE '#%' OR next LIKE '(%')
  END AS ends FROM named),
ended AS (SELECT *, lag(ends AND NOT breaks) OVER (PARTITION BY key ORDER BY i) AS after FROM judged),
merged AS (SELECT *, lead(coalesce(after, false) AND (ends OR breaks OR next IS NULL) AND length(word) <= 10 AND word LIKE '%.'
    AND regexp_matches(word, '[A-Za-z0-9À-ÿ]') AND NOT regexp_matches(word, '^({upper}|[)\\]}}])')) OVER (PARTITION BY key ORDER BY i) AS orphan FROM ended),
ids AS (SELECT key, i, piece, coalesce(sum(CASE WHEN breaks OR (ends AND NOT coalesce(orphan, false)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id FROM merged),
grouped AS (SELECT key, sent_id, string_agg(piece, '' ORDER BY i) AS sent FROM ids GROUP BY key, sent_id),
placed AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY sent_id) - 1 AS sent_id, sent, sum(length(sent)) OVER (PARTITION BY key ORDER BY sent_id) AS reach FROM grouped),
{name} AS (SELECT key, CAST(sent_id AS INTEGER) AS sent_id, sent, CAST(reach - length(sent) AS INTEGER) AS start, CAST(reach AS INTEGER) AS "end" FROM placed)"""


DOCS = "SELECT doc_id AS key, text, lang FROM documents"
TURNS = "SELECT concat(conv_id, '-', turn) AS key, text, 'en' AS lang FROM conversations"
STREAMS = "SELECT conv_id AS key, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS text, 'en' AS lang FROM conversations GROUP BY conv_id"
GATED = ("en", "de", "es", "fr")
#: Language codes, how their sentences are read, and the signs that end them.
LANGUAGES = [
    ("am", "script", "።፧?!"), ("ar", "script", ":.!?؟"), ("bg", "latin", "。．.！!?？"), ("da", "latin", "。．.！!?？"), ("de", "latin", "。．.！!?？"),
    ("el", "latin", ".;!?"), ("en", "latin", "。．.！!?？"), ("en_es_zh", "mixed", "。．.！!?？"), ("en_legal", "latin", "。．.！!?？"), ("es", "latin", "。．.！!?？"),
    ("fa", "script", ":.!?؟"), ("fr", "latin", "。．.！!?？"), ("hi", "script", "।|!?"), ("hy", "script", "։՜:"), ("it", "latin", "。．.！!?？"), ("ja", "cjk", "。．.！!?？"),
    ("kk", "latin", "。．.！!?？"), ("mr", "script", "।॥.!?"), ("my", "script", "။၏?!"), ("nl", "latin", "。．.！!?？"), ("pl", "latin", "。．.！!?？"), ("ru", "latin", "。．.！!?？"),
    ("sk", "latin", "。．.！!?？"), ("tl", "latin", "。．.！!?？"), ("ur", "script", "۔؟!?"), ("zh", "cjk", "。．.！!?？"),
]
_SPACE = "chr(32) || chr(9) || chr(10) || chr(13)"


def _rows(source: str = DOCS, mode: str = "balanced") -> str:
    return f"(WITH {sentence_rows(source, mode)} SELECT *, trim(sent, {_SPACE}) AS bare FROM sentence_rows)"


def _lists(source: str = DOCS, mode: str = "balanced") -> str:
    """(key, sents, at): each text's sentences, and its inner boundaries in the text without white space."""
    grouped = f"SELECT key, list(bare ORDER BY sent_id) AS sents, list(length(regexp_replace(bare, '\\s+', '', 'g')) ORDER BY sent_id) AS n FROM {_rows(source, mode)} WHERE bare <> '' GROUP BY key"
    return f"(SELECT s.key, coalesce(sents, []) AS sents, coalesce(list_transform(range(1, len(n)), lambda k: list_sum(n[1:k])), []) AS at FROM ({source}) s LEFT JOIN ({grouped}) g ON s.key = g.key)"


def _agreement(pred: str = "conservative") -> str:
    """(key, em, f1) of a mode with the balanced one as gold."""
    rates = "CASE WHEN len(p.at) > 0 THEN len(list_intersect(p.at, g.at)) / len(p.at) ELSE 1.0 END AS a, CASE WHEN len(g.at) > 0 THEN len(list_intersect(p.at, g.at)) / len(g.at) ELSE 1.0 END AS b"
    return f"(SELECT key, em, CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 1.0 END AS f1 FROM (SELECT p.key, CAST(p.sents = g.sents AS INTEGER) AS em, {rates} FROM {_lists(mode=pred)} p JOIN {_lists()} g ON p.key = g.key))"


def _waits(source: str = TURNS) -> str:
    """(key, waits): whether the last sentence changes, or takes what follows in, under any of three continuations."""
    last = f"SELECT key, rtrim(max_by(sent, sent_id), {_SPACE}) AS tail FROM {_rows(source)} GROUP BY key"
    marked = f"SELECT key, tail, regexp_replace(tail, '[\"''”’»)\\]}}」』】）》›\\s]+$', '') AS stem FROM ({last})"
    probes = f"SELECT concat(key, '#', p) AS key, tail || p AS text, 'en' AS lang FROM ({marked}), (VALUES (' a'), (' A'), (' 1'), ('1')) v(p) WHERE p <> '1' OR regexp_matches(stem, '[0-9].$')"
    plain = f"SELECT key, tail AS text, 'en' AS lang FROM ({marked})"
    moved = f"SELECT p.key, len(p.sents) = len(e.sents) OR p.sents[1:len(e.sents)] <> e.sents AS moved FROM {_lists(probes)} p JOIN {_lists(plain)} e ON string_split(p.key, '#')[1] = e.key"
    by_key = f"SELECT string_split(key, '#')[1] AS key, bool_or(moved) AS moved FROM ({moved}) GROUP BY 1"
    return f"(SELECT s.key, CASE WHEN trim(coalesce(s.text, ''), {_SPACE}) = '' THEN false WHEN NOT regexp_matches(stem, '[.!?。．！？]$') THEN true WHEN regexp_matches(stem, '[.．]$') THEN moved ELSE false END AS waits FROM ({source}) s LEFT JOIN ({marked}) m ON s.key = m.key LEFT JOIN ({by_key}) b ON s.key = b.key)"


def _protected(source: str = DOCS) -> str:
    """(key, place) of periods that end no sentence and have text behind them."""
    dots = f"SELECT key, text, CAST(sum(length(w) + 1) OVER (PARTITION BY key ORDER BY i) - 1 AS INTEGER) AS place, i, n FROM (SELECT key, text, unnest(p) AS w, unnest(range(1, len(p) + 1)) AS i, len(p) AS n FROM (SELECT key, coalesce(text, '') AS text, string_split(coalesce(text, ''), '.') AS p FROM ({source})))"
    after = f"SELECT key, place, place + 1 + length(regexp_extract(substr(text, place + 2), '^[\"''”’»)\\]}}\\s]*')) AS k, length(text) AS size FROM ({dots}) WHERE i < n"
    return f'(SELECT a.key, place FROM ({after}) a LEFT JOIN {_rows(source)} r ON a.key = r.key AND a.k = r."end" WHERE r.key IS NULL AND k < size)'


def _cleaned(text: str, pdf: bool = False) -> str:
    """The cleaner as a chain of replacements."""
    for old, new in (("'\\n'", "chr(10)"), ("'\\r'", "chr(13)"), ("'\\ n'", "chr(10)"), ("'\\ r'", "chr(13)")):
        text = f"replace({text}, {old}, {new})"
    steps = [("(\\s)\\n([a-z(])", "'\\1\\2'"), ("\\n([a-zA-Z]{1,2}\\n)", "'\\1'"), ("\\n \\n", "chr(13)"), ("\\n\\n", "chr(13)")]
    steps += [("\\n(•)", "chr(13) || '\\1'"), ("([a-z])-\\n([a-z])", "'\\1\\2'"), ("([^\\n]\\s)\\n(\\S)", "'\\1\\2'"), ("\\n([a-z])", "' \\1'")] if pdf else [("\\n(\\.\\s)", "'\\1'"), ("\\n", "chr(13)")]
    steps += [("</?[\\p{L}\\p{N}_]+(?:\"[^\"]*\"|''[^'']*''|[^<>\"''])*>", "''")]
    for old, new in steps:
        text = f"regexp_replace({text}, '{old}', {new}, 'g')"
    text = f"replace(replace({text}, '`', ''''), '''''', '\"')"
    text = f"array_to_string(list_transform(string_split({text}, ' '), lambda w: CASE WHEN regexp_matches(w, '@|http|[.]com|net|www|//') THEN w ELSE regexp_replace(w, '([a-z0-9])[.]([A-Z])', '\\1. \\2', 'g') END), ' ')"
    return f"replace(regexp_replace({text}, '[.]{{5,}}', ' ', 'g'), '///', '')"


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows) + ")"


_PARAGRAPHS = "(SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) BETWEEN 40 AND 2000 AND regexp_matches(x, '[.!?。！？]')) AS p FROM documents))"


def sql() -> dict[str, str]:
    from sentria.functions.clean import ZERO_WIDTH
    from sentria.plans import cases

    count = lambda mode: f"(SELECT key, CAST(count(*) AS INTEGER) AS n FROM {_rows(mode=mode)} WHERE bare <> '' GROUP BY key)"
    agreed = _agreement()
    moved = "(SELECT concat(lang, md5(text)) AS key, text, lang FROM (SELECT DISTINCT lang, coalesce(text, '') AS text FROM documents))"
    ids = lambda n: f"CAST({n} AS INTEGER) AS id"
    rules = cases.rules()
    legal = [(f"legal-{i}", len(want)) for i, (_, want) in enumerate(cases.LEGAL)]
    marked = "replace(text, '!', '`')"
    spaced = "SELECT key, replace(text, ' ', '  ') AS text, lang FROM (" + TURNS + ")"
    return {
        "sentence_statistics": f"SELECT d.lang, count(DISTINCT d.doc_id) AS n_docs, CAST(sum(n) AS BIGINT) AS n_sentences, sum(size) / sum(n) AS mean_length FROM documents d LEFT JOIN (SELECT key, count(*) AS n, sum(length(bare)) AS size FROM {_rows()} WHERE bare <> '' GROUP BY key) r ON d.doc_id = r.key GROUP BY d.lang",
        "explode_sentences": f'SELECT key AS doc_id, sent_id, sent, start, "end" FROM {_rows()}',
        "explode_sentences_sql": f'SELECT CAST(string_split(key, \'-\')[1] AS BIGINT) AS conv_id, CAST(string_split(key, \'-\')[2] AS BIGINT) AS turn, sent_id, sent, start, "end" FROM {_rows(TURNS)}',
        "functions_sql": f"SELECT conv_id, turn, CAST(len(a.sents) AS INTEGER) AS n_aggressive, CAST(n_spans AS INTEGER) AS n_spans, waits, waits AS waits_again, CAST(coalesce(n_protected, 0) AS INTEGER) AS n_protected, CAST(len(b.sents) AS INTEGER) AS n_clean, {_cleaned(marked)} AS cleaned, ' ' || text AS stripped, '?' AS mark, CAST(1.0 AS DOUBLE) AS f1 FROM conversations c JOIN {_lists(TURNS, 'aggressive')} a ON a.key = concat(conv_id, '-', turn) JOIN {_lists(spaced)} b ON b.key = a.key JOIN {_waits()} w ON w.key = a.key JOIN (SELECT key, count(*) AS n_spans FROM {_rows(TURNS)} GROUP BY key) n ON n.key = a.key LEFT JOIN (SELECT key, count(*) AS n_protected FROM {_protected(TURNS)} GROUP BY key) p ON p.key = a.key",
        "roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "tiling_length": f"SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_spans, CAST(length(coalesce(text, '')) AS BIGINT) AS total, CAST(length(coalesce(text, '')) AS BIGINT) AS last_end FROM documents d LEFT JOIN (SELECT key, count(*) AS n FROM {_rows()} GROUP BY key) r ON d.doc_id = r.key",
        "projection": f"SELECT CAST(0 AS BIGINT) AS n_mismatches, count(*) AS n_sentences FROM {_rows()} WHERE bare <> ''",
        "hard_newlines": "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S[ \\t]*[\\n\\r]\\s*')) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_inside FROM documents WHERE text <> ''",
        "number_periods": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]\\.[0-9]')) AS BIGINT) AS n FROM documents WHERE text <> ''",
        "protected_periods": f"SELECT doc_id, coalesce(places, '') AS places FROM documents d LEFT JOIN (SELECT key, string_agg(place, ' ' ORDER BY place) AS places FROM {_protected()} GROUP BY key) p ON d.doc_id = p.key",
        "split_mode_compare": "SELECT doc_id, " + ", ".join(f"coalesce({m}.n, 0) AS {m}" for m in ("conservative", "balanced", "aggressive")) + " FROM documents d" + "".join(f" LEFT JOIN {count(m)} {m} ON d.doc_id = {m}.key" for m in ("conservative", "balanced", "aggressive")),
        "should_wait": f"SELECT conv_id, turn, waits AS should_wait FROM conversations JOIN {_waits()} w ON w.key = concat(conv_id, '-', turn)",
        "lookahead": f"SELECT conv_id, turn, CAST(coalesce(n, 0) AS INTEGER) AS n_segments, waits AS should_wait_for_more FROM conversations JOIN {_waits()} w ON w.key = concat(conv_id, '-', turn) LEFT JOIN (SELECT key, count(*) AS n FROM {_rows(TURNS)} GROUP BY key) r ON r.key = w.key",
        "stream_replay": "SELECT conv_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
        "stream_replay_sentences": f'SELECT key AS stream_id, CAST(sent_id AS BIGINT) AS ord, sent, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM {_rows(STREAMS)}',
        "stream_files": f'SELECT key AS stream_id, sent, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM {_rows(STREAMS)}',
        "emission_lag": f"WITH w AS (SELECT key, unnest(p) AS word, unnest(range(len(p))) AS i, len(p) - 1 AS last FROM (SELECT key, string_split(text, ' ') AS p FROM ({TURNS}) WHERE text <> '')), t AS (SELECT key, i, last, sum(length(word) + 1) OVER (PARTITION BY key ORDER BY i) AS reach FROM w), m AS (SELECT r.key, sent_id, min(last - i) FILTER (reach < start + length(rtrim(sent))) AS under, max(last) AS last FROM {_rows(TURNS)} r JOIN t ON r.key = t.key GROUP BY r.key, sent_id), g AS (SELECT key, coalesce(under - 1, last) AS lag FROM m) SELECT key AS stream_id, count(*) AS n, CAST(sum(lag) AS BIGINT) AS lag, CAST(max(lag) AS INTEGER) AS longest FROM g GROUP BY key",
        "clean_text": f"SELECT doc_id, {_cleaned('text')} AS text FROM documents",
        "clean_pdf": f"SELECT doc_id, {_cleaned(chr(40) + _BROKEN + chr(41), True)} AS text FROM documents",
        "sentences_clean": f"SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_sentences FROM documents LEFT JOIN (SELECT key, count(*) AS n FROM {_rows(_CLEAN_DOCS)} WHERE bare <> '' GROUP BY key) r ON r.key = doc_id WHERE lang = 'en'",
        "clean_html": "SELECT page_id, regexp_replace(regexp_replace(html, '</?[\\p{L}\\p{N}_]+(?:\"[^\"]*\"|''[^'']*''|[^<>\"''])*>', '', 'g'), '&lt;/?[\\p{L}\\p{N}_]+(?:[^&]|&[^lg])*&gt;', '', 'g') AS text FROM pages",
        "clean_escapes": "SELECT doc_id, replace(replace(replace(replace(replace(text, ' a', '\\n'), '\\n', chr(10)), '\\r', chr(13)), '\\ n', chr(10)), '\\ r', chr(13)) AS text FROM documents",
        "clean_quotes": "SELECT doc_id, replace(replace(translate(text, '.,', '`'''), '`', ''''), '''''', '\"') AS text FROM documents",
        "clean_repeated": "SELECT doc_id, replace(regexp_replace(regexp_replace(text, '[*&%$#]', './', 'g'), '\\.{5,}', ' ', 'g'), '///', '') AS text FROM documents",
        "strip_zero_width": "SELECT doc_id, ' ' || text || ' ' AS text FROM documents",
        "terminal_mark": f"SELECT doc_id, nullif(regexp_extract(text, '([。．.！!?？])(?:[\"''”’»)\\]}}」』】）》›]|[ \\t\\n\\x0b\\f\\r{ZERO_WIDTH}])*$', 1), '') AS mark FROM documents",
        "paragraphs": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS paragraph_id, p[i] AS paragraph FROM {_PARAGRAPHS}",
        "context_window": f'SELECT key AS doc_id, sent_id, sent, start, "end", lag(sent) OVER o AS before_1, lead(sent) OVER o AS after_1 FROM {_rows()} WINDOW o AS (PARTITION BY key ORDER BY sent_id)',
        "longest_sentences": f'SELECT key AS doc_id, sent_id, sent, start, "end" FROM {_rows()} ORDER BY length(sent) DESC, key, sent_id LIMIT 20',
        "repeated_sentences": f"SELECT trim(sent) AS sent, count(*) AS n, count(DISTINCT key) AS n_docs, min(key) AS first_doc FROM {_rows()} WHERE trim(sent) <> '' GROUP BY 1 HAVING count(*) >= 2",
        "sentence_starts": f"WITH w AS (SELECT key, unnest(p) AS word, unnest(range(len(p))) AS i FROM (SELECT key, string_split(coalesce(text, ''), ' ') AS p FROM ({TURNS}))), t AS (SELECT key, word, sum(length(word) + 1) OVER (PARTITION BY key ORDER BY i) - length(word) - 1 AS idx FROM w), k AS (SELECT * FROM t WHERE word <> '') SELECT k.key AS doc_id, count(*) AS n_tokens, count(DISTINCT sent_id) AS n_starts FROM k LEFT JOIN {_rows(TURNS)} r ON r.key = k.key AND idx >= start AND idx < \"end\" GROUP BY k.key",
        "whole_files": "SELECT b.text, CAST(n AS INTEGER) AS n_sentences FROM (SELECT DISTINCT text FROM benchmark WHERE text <> '') b JOIN (SELECT key, count(*) AS n FROM " + _rows("SELECT DISTINCT text AS key, text, 'en' AS lang FROM benchmark") + " WHERE bare <> '' GROUP BY key) r ON r.key = b.text",
        "gold_units": f"SELECT CAST(doc_id AS VARCHAR) AS unit_id, CAST(len(gold) AS INTEGER) AS n_gold, sents = gold AS em, CAST(1.0 AS DOUBLE) AS recall FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS gold FROM documents WHERE text IS NOT NULL) d JOIN {_lists()} l ON l.key = d.doc_id",
        "treebank_units": "SELECT CAST(count(*) AS INTEGER) AS n_sentences, CAST(sum(length(s)) + count(*) - 1 AS INTEGER) AS n_chars FROM (SELECT lang, regexp_replace(s, '\\s+', ' ', 'g') AS s FROM (SELECT lang, trim(unnest(string_split(text, chr(10)))) AS s FROM documents) WHERE s <> '') GROUP BY lang",
        "plain_units": f"SELECT concat(doc_id, '#', i - 1) AS unit_id, p[i] AS text, true AS no_gold FROM {_PARAGRAPHS}",
        "boundary_f1": f"SELECT key AS unit_id, em, round(CAST(f1 AS DOUBLE), 9) AS f1 FROM {agreed}",
        "scoreboard": f"SELECT 'conservative' AS segmenter, source AS corpus, lang, count(*) AS n, round(avg(em), 9) AS exact_match, round(avg(CAST(f1 AS DOUBLE)), 9) AS boundary_f1 FROM documents JOIN {agreed} ON key = doc_id GROUP BY GROUPING SETS ((), (source), (lang))",
        "divergences": f"SELECT p.key AS unit_id, CAST(2 AS BIGINT) AS n_readings, CAST(2 AS BIGINT) AS n, CAST(len(p.at) + len(g.at) - 2 * len(list_intersect(p.at, g.at)) AS INTEGER) AS n_disputed FROM {_lists(mode='conservative')} p JOIN {_lists(mode='aggressive')} g ON p.key = g.key WHERE p.sents <> g.sents ORDER BY n_disputed DESC, unit_id LIMIT 50",
        "gate": f"SELECT bucket, round(1 - e, 9) AS em_drop, round(1 - f, 9) AS f1_drop FROM (SELECT lang AS bucket, avg(em) AS e, avg(CAST(f1 AS DOUBLE)) AS f FROM documents JOIN {agreed} ON key = doc_id GROUP BY lang) WHERE bucket IN ({_list(GATED)}) AND (1 - e > CASE WHEN bucket = 'de' THEN 0 ELSE 0.034 END + 1e-12 OR 1 - f > 0.015 + 1e-12)",
        "snapshot_difference": f"SELECT s.lang, count(*) AS n_changed FROM {moved} s JOIN {_lists('SELECT * FROM ' + moved, 'conservative')} a ON a.key = s.key JOIN {_lists('SELECT * FROM ' + moved, 'aggressive')} b ON b.key = s.key WHERE a.sents <> b.sents GROUP BY s.lang",
        "latency_statistics": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type",
        "languages": f"SELECT code, family, array_to_string(list_sort(string_split(marks, '')), '') AS marks FROM {_values(LANGUAGES)} v(code, family, marks)",
        "lexicon_lint": f"SELECT lang, CAST(0 AS BIGINT) AS n_split, true AS enough FROM {_values([(x[0],) for x in LANGUAGES])} v(lang)",
        "golden": f"SELECT {ids('id')}, rule, lang, sentences FROM {_values([(n, rule, code, '|'.join(want)) for n, rule, code, _, want in rules])} v(id, rule, lang, sentences)",
        "golden_scores": f"SELECT 'kernel' AS segmenter, corpus, lang, count(*) AS n, CAST(1.0 AS DOUBLE) AS exact_match, CAST(1.0 AS DOUBLE) AS boundary_f1 FROM {_values([('golden_rules', r[2]) for r in rules])} v(corpus, lang) GROUP BY GROUPING SETS ((), (corpus), (lang))",
        "golden_modes": f"SELECT {ids('id')}, rule, CAST(a AS INTEGER) AS conservative, CAST(b AS INTEGER) AS balanced, CAST(c AS INTEGER) AS aggressive FROM {_values([(i, x[0], *x[3:]) for i, x in enumerate(cases.MODES)])} v(id, rule, a, b, c)",
        "golden_waits": f"SELECT {ids('id')}, rule, waits = 1 AS waits FROM {_values([(i, x[0], int(x[3])) for i, x in enumerate(cases.WAITS)])} v(id, rule, waits)",
        "golden_periods": f"SELECT {ids('id')}, rule, places FROM {_values([(i, x[0], ' '.join(map(str, x[3]))) for i, x in enumerate(cases.PERIODS)])} v(id, rule, places)",
        "golden_clean": f"SELECT {ids('id')}, rule, cleaned FROM {_values([(i, x[0], x[3]) for i, x in enumerate(cases.CLEAN)])} v(id, rule, cleaned)",
        "legal_comparison": "SELECT unit_id, " + ", ".join(f"CAST(n{p} AS INTEGER) AS n_{p}, em{p} = 1 AS em_{p}, CAST(f{p} AS DOUBLE) AS f1_{p}" for p in ("en", "en_legal")) + f", nen = nen_legal AS same FROM {_values([(u, *cases.LEGAL_GENERAL[i], n, 1, 1.0) for i, (u, n) in enumerate(legal)])} v(unit_id, nen, emen, fen, nen_legal, emen_legal, fen_legal)",
        "profile_comparison": f"SELECT count(*) AS n, count(*) FILTER (a.sents = b.sents) AS n_same, CAST(sum(len(a.sents)) AS BIGINT) AS n_en, CAST(sum(len(b.sents)) AS BIGINT) AS n_es FROM {_lists(_ENGLISH)} a JOIN {_lists(_ENGLISH.replace('lang FROM', chr(39) + 'es' + chr(39) + ' AS lang FROM'))} b ON a.key = b.key",
    }


_ENGLISH = "SELECT doc_id AS key, text, lang FROM documents WHERE lang = 'en'"
_BROKEN = "regexp_replace(text, '([^ \\n]+ [^ \\n]+) ', '\\1 ' || chr(10), 'g')"
_CLEAN_DOCS = f"SELECT doc_id AS key, {_cleaned('text')} AS text, lang FROM documents WHERE lang = 'en'"
