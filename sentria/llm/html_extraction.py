"""Operator 6: main text of web pages by deducing each host's template from equivalence classes.

A page becomes a sequence of tokens: whole text blocks, and the elements around them, each told apart by the path of elements it stands
in. A token's occurrence vector holds its number of occurrences on each page of the host; tokens with one vector form an
equivalence class. Vectors are compared by an order-free hash that is summed over pages, so a host's pages are never
gathered, however many it has; copies of one page count as one page.

A class on every page of the host, or on half of the pages with at least three tokens, is a candidate if it holds text. A second
pass over the pages tests it: it is ordered if a page shows its tokens as whole repeats of one order, the same on all pages, and it nests if
every other class's repeats lie between two of its tokens or around it; of two classes that cross, the one of fewer tokens
fails. Classes that pass on nine tenths of their pages are the template, nested as they stand; what lies between their tokens are its
slots, and the slots' text is extracted, in ``article`` and ``main`` too. A page that holds only template text keeps it.
Pages with ``article`` or ``main`` name the element that holds the article themselves. Elements whose kind or class says menu, header, footer,
sidebar, notice, advert, form, script, style or comment hold no article text.

Defined results: null html is empty html, with empty text; a null url belongs to the host of no name; rows are kept one
by one; a host of one page has no template, and its pages are read by their elements alone; unfinished tags at
the end are no text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.tokens import text_groups
from sentria.runtime import materialize, read_table, release, ship, spread

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title|object|select)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s>/]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s>/]*+)([^>]*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul head".split())
_BOILER = frozenset("nav footer aside form menu dialog button fieldset head input label".split())
_BOILER_CLASS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar sidenav footer header masthead cookie cookies consent gdpr notice notification alert newsletter subscribe subscription comment comments reply replies disqus related recommended share sharing social breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar login signup search hidden".split())
#: Words that say nothing beside those of _BOILER_CLASS: a class is boilerplate if all its words are in either list.
_NEUTRAL = frozenset("site page top bottom main global left right primary secondary box block bar list section area container content wrapper inner outer post posts article articles link links item items row col column form button buttons icon text group user unit slot zone js is has no".split())
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_ROOT = frozenset(("article", "main"))
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")
Block = tuple[tuple[str, ...], str, bool, bool]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _host():
    """:func:`host_of` as a column."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _names(attributes: str) -> tuple[str, frozenset[str], bool]:
    """The element's class mark for its path, its class words, and whether it is boilerplate by role or hidden."""
    classes, words, boiler = "", set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "role":
            boiler |= value in _BOILER_ROLE
        elif key == "hidden" or key == "aria-hidden":
            boiler |= value in ("", "true", "hidden")
        else:
            classes += "." + re.sub(r"[0-9]+", "0", value)
            for name in value.split():
                parts = [x for x in re.split(r"[_-]+|[0-9]+", name) if x]
                # "article-header" is an article's, "site-header" is not
                if parts and all(x in _BOILER_CLASS or x in _NEUTRAL for x in parts) and not (parts[0] in ("article", "post", "content", "text") and len(parts) > 1):
                    words.update(parts)
    return classes, frozenset(words), boiler


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order: element path, text, whether in an article element, whether in boilerplate."""
    page = page or ""
    if cut := _UNFINISHED.search(page, max(0, len(page) - 4096)):
        page = page[: cut.start()]
    out: list[Block] = []
    stack: list[tuple[str, str, int, bool]] = []  # name, mark, boilerplate elements so far, in an article element
    text: list[str] = []
    names: dict[str, tuple[str, frozenset[str], bool]] = {}

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split()) if text else ""
        text.clear()
        if joined:
            out.append((tuple(s[1] for s in stack if s[0] in _BLOCK), joined, bool(stack) and stack[-1][3], bool(stack) and stack[-1][2] > 0))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            if m[1]:
                text.append(" ")
            continue
        name = name.lower()
        closing = m[2] or m[5]
        if name in _VOID:
            if name == "hr":
                flush()
            else:
                text.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        attributes = m[4] if m[3] else m[7]
        if attributes.rstrip().endswith("/") and name not in _BLOCK:
            continue
        if name in _BLOCK:  # a block element ends an open paragraph, and an item the one before
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == name and name in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCK:
                    break
        if attributes not in names:
            names[attributes] = _names(attributes) if attributes.strip() else ("", frozenset(), False)
        mark, words, boiler = names[attributes]
        depth, inside = (stack[-1][2], stack[-1][3]) if stack else (0, False)
        boiler |= name in _BOILER or name == "header" and not inside or name not in ("html", "body") and bool(words & _BOILER_CLASS)
        if name in _ROOT and not boiler and not inside:
            depth, inside = 0, True
        stack.append((name, name + mark, depth + boiler, inside))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def _hash(*parts: str) -> int:
    import zlib

    raw = "\0".join(parts).encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 31) ^ zlib.adler32(raw) ^ len(raw)


def page_sequence(page: str | None) -> tuple[list[int], set[int]]:
    """A page's tokens in order: for each text block its path's elements and the block; and which of them are text blocks."""
    out: list[int] = []
    texts: set[int] = set()
    paths: dict[tuple[str, ...], list[int]] = {}
    for path, text, _, _ in blocks(page):
        if path not in paths:
            paths[path] = [_hash("path", *path[:n]) for n in range(1, len(path) + 1)]
        key = _hash("text", *path, text)
        texts.add(key)
        out += [*paths[path], key]
    return out, texts


def page_tokens(page: str | None) -> tuple[Counter, set[int]]:
    """Occurrences of a page's tokens, and which of them are text blocks."""
    sequence, texts = page_sequence(page)
    return Counter(sequence), texts


def class_orders(sequence: list[int], member: dict[int, tuple[int, int]]) -> dict[int, int]:
    """A hash of each class's order on one page, or 0 if the class is out of order or crosses a larger one.

    ``member`` maps a token to its class and the class's size.
    """
    seen: dict[int, list[int]] = {}
    sizes: dict[int, int] = {}
    for t in sequence:
        if t in member:
            seen.setdefault(member[t][0], []).append(t)
            sizes[member[t][0]] = member[t][1]
    out: dict[int, int] = {}
    place: dict[int, int] = {}
    for c, own in seen.items():
        m = len(set(own))
        ordered = len(own) % m == 0 and all(own[i] == own[i - m] for i in range(m, len(own)))
        out[c] = hash(tuple(own[:m])) | 1 if ordered else 0
        place.update({t: i for i, t in enumerate(own[:m])} if ordered else {})
    # repeats open and close like brackets
    length = {c: len(set(own)) for c, own in seen.items()}
    open_: list[int] = []
    for t in sequence:
        c = member[t][0] if t in member else None
        if c is None or not out[c] or length[c] == 1:
            continue
        if place[t] == 0:
            open_.append(c)
            continue
        while out[c] and open_ and open_[-1] != c:
            loser = min(c, open_[-1], key=lambda x: (sizes[x], x))
            out[loser] = 0
            open_ = [x for x in open_ if x != loser]
        if out[c] and place[t] == length[c] - 1 and open_:
            open_.pop()
    return out


def deduce_templates(pages: DataFrame, least_pages: int = 3, least_share: float = 0.5, least_class: int = 3, least_valid: float = 0.9) -> DataFrame:
    """Templates as rows (host, text_tokens): the hashes of template text.

    Pages are counted by content: c copies of one page weigh 1 / c each. A class is a candidate if it is on every page,
    or on ``least_share`` of them with at least ``least_class`` tokens; text that several articles share is a class of its own. It is the
    template's if its order and nesting hold on ``least_valid`` of its pages.

    Two partial aggregations over (host, token); a row per host remains, with the tokens of at least ``least_share`` of
    its pages, which are fewer than the tokens of 1 / least_share pages.
    """
    ship(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        mask = (1 << 61) - 1
        for batch in batches:
            urls, htmls, salts, copies = (batch.column(i).to_pylist() for i in range(4))
            for a, b in text_groups(htmls):
                sums: dict[tuple[str, int], list[int]] = {}
                for url, page, salt, n_copies in zip(urls[a:b], htmls[a:b], salts[a:b], copies[a:b], strict=True):
                    host = host_of(url)
                    counts, own = page_tokens(page)
                    weight = 1 / n_copies
                    sums.setdefault((host, 0), [0, 0, 0])[0] += weight
                    for key, n in counts.items():
                        row = sums.setdefault((host, key), [0, 0, key in own])
                        row[0] += weight
                        row[1] = (row[1] + hash((salt, n)) % mask) % mask  # the occurrence vector's hash
                keys = list(sums)
                columns = list(zip(*sums.values(), strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in keys], pa.string()), "token": pa.array([k for _, k in keys], pa.int64())} | {"n_pages": pa.array(columns[0], pa.float64()), "vector": pa.array(columns[1], pa.int64()), "is_text": pa.array([bool(x) for x in columns[2]], pa.bool_())})

    content = F.md5(F.coalesce("html", F.lit("")))
    copied = materialize(pages.select(_host().alias("host"), content.alias("content")).groupBy("host", "content").agg(F.count("*").alias("copies")).where("copies > 1"), "copied-pages")
    copied_table = copied
    if copied.count() <= BROADCAST_COPIES:
        copied = F.broadcast(copied)
    named = pages.select("url", "html", _host().alias("host"), content.alias("content")).join(copied, ["host", "content"], "left")
    salted = named.select("url", "html", F.xxhash64("content").alias("salt"), F.coalesce("copies", F.lit(1)).alias("copies"))
    seen = salted.mapInArrow(run, "host string, token long, n_pages double, vector long, is_text boolean")
    tokens = materialize(seen.groupBy("host", "token").agg(F.sum("n_pages").alias("n_pages"), (F.sum(F.col("vector").cast("decimal(38,0)")) % ((1 << 61) - 1)).cast("long").alias("vector"), F.max("is_text").alias("is_text")), "page-tokens")
    hosts = tokens.where("token = 0").select("host", F.col("n_pages").alias("all_pages"))
    kept = tokens.where(f"token <> 0 and n_pages > {least_pages} - 1e-6").join(hosts, "host").where(F.col("n_pages") > least_share * F.col("all_pages") - 1e-6)
    # equivalence classes: tokens of one occurrence vector; large enough ones are the template's
    sizes = kept.groupBy("host", "vector").agg(F.count("*").alias("size"))
    members = kept.join(sizes, ["host", "vector"]).withColumn("template", (F.col("size") >= least_class) | (F.col("n_pages") > F.col("all_pages") - 1e-6))
    members = materialize(members.where("template").select("host", "vector", "token", "size", "is_text"), "classes")
    texts = members.where("is_text").select("host", "vector").distinct()
    candidates = materialize(members.join(texts, ["host", "vector"]).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "vector", "size"))).alias("classes")), "candidates")

    def test(rows):
        """(host, class, order) and the pages' weight, from rows of (host, html, copies, classes)."""
        import pyarrow as pa

        sums: dict[tuple, float] = {}
        for host, page, n_copies, member in rows:
            if member:
                for c, order in class_orders(page_sequence(page)[0], member).items():
                    sums[host, c, order] = sums.get((host, c, order), 0.0) + 1 / n_copies
        keys = list(sums)
        return pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in keys], pa.string()), "vector": pa.array([k[1] for k in keys], pa.int64()), "order": pa.array([k[2] for k in keys], pa.int64()), "weight": pa.array([sums[k] for k in keys], pa.float64())})

    plain = named.select("html", "host", F.coalesce("copies", F.lit(1)).alias("copies"))
    judged = with_hosts(plain, candidates, "classes", lambda classes: {x["token"]: (x["vector"], x["size"]) for x in classes}, lambda rows, batch: test((host, page, n, member) for (page, host, n), member in rows), "host string, vector long, order long, weight double")
    orders = judged.groupBy("host", "vector", "order").agg(F.sum("weight").alias("weight"))
    valid = orders.groupBy("host", "vector").agg(F.max(F.when(F.col("order") != 0, F.col("weight"))).alias("held"), F.sum("weight").alias("all")).where(F.col("held") >= least_valid * F.col("all") - 1e-9)
    found = materialize(members.where("is_text").join(valid.select("host", "vector"), ["host", "vector"]).groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("text_tokens")), "templates")
    release(copied_table, tokens, members, candidates)
    return found


def with_hosts(rows: DataFrame, by_host: DataFrame, column: str, prepare, run, schema: str) -> DataFrame:
    """``run(rows, batch)`` over batches of ``rows``, whose column ``host`` finds its entry of ``by_host``, made by ``prepare`` once a task.

    Small tables are broadcast; others meet the rows in a join by host, which adaptive execution splits where a host is hot.
    """
    spark = rows.sparkSession
    size = by_host.agg(F.coalesce(F.sum(F.size(column) * 24 + F.length("host") + 64), F.lit(0))).first()[0]
    place = rows.columns.index("host")
    if size <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast({r["host"]: r[column] for r in by_host.collect()})

        def broadcast_run(batches):
            made: dict = {}
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                out = []
                for row in zip(*columns, strict=True):
                    if row[place] not in made:
                        made[row[place]] = prepare(sent.value.get(row[place]) or [])
                    out.append((row, made[row[place]]))
                yield run(out, batch)

        return rows.mapInArrow(broadcast_run, schema)

    def joined_run(batches):
        for batch in batches:
            made: dict = {}
            out = []
            for *row, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[place] not in made:
                    made[row[place]] = prepare(entry or [])
                out.append((tuple(row), made[row[place]]))
            yield run(out, batch)

    return rows.join(by_host.select("host", column), "host", "left").select(*rows.columns, column).mapInArrow(joined_run, schema)


def main_text(page: str | None, template_text: frozenset[int] = frozenset()) -> str:
    """The article's blocks, joined by line feeds."""
    found = blocks(page)
    rooted = [b for b in found if b[2]]
    plain = [(path, text) for path, text, _, boiler in rooted or found if not boiler]
    # a page of template text alone is a copy of others: its text stays
    kept = [x for x in plain if _hash("text", *x[0], x[1]) not in template_text] or plain
    return "\n".join(text for _, text in kept)


#: Counts of up to so many repeated pages are broadcast.
BROADCAST_COPIES = 200_000
#: Templates of up to so many bytes are broadcast; beyond, pages are joined with them by host.
BROADCAST_BYTES = 32 << 20


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, for each row of ``pages(page_id, url, html)``."""
    ship(pages.sparkSession)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    templates = deduce_templates(plain)

    def emit(rows, batch):
        import pyarrow as pa

        texts = [main_text(row[2], known) for row, known in rows]
        return pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return with_hosts(plain.withColumn("host", _host()), templates, "text_tokens", frozenset, emit, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(read_table(spark, sf_dir, "pages")))
