"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from sentria import runtime
from sentria.llm import binary_output, decontamination, html_extraction, license_scan, near_dedup, packing, pii, substring_dedup, toxicity, vector_search
from sentria.llm.tokens import PieceEncoder, vocabulary

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def docs(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    base = [prose(r, r.randint(1, 120)) for _ in range(30)]
    passage = prose(r, 60)
    texts = list(enumerate(base))
    for i in range(30, 45):  # near copies of one text, exact copies of another
        w = base[7].split() if i < 38 else base[9].split()
        if i < 38:
            for _ in range(i - 29):
                w[r.randrange(len(w))] = prose(r, 1)
        texts.append((i, " ".join(w)))
    texts += [(50, prose(r, 20) + " " + passage), (51, passage + " " + prose(r, 9)), (52, None), (53, ""), (54, "  \n "), (55, prose(r, 3000)), (55, base[3]), (56, base[3].upper()), (None, base[4]), (57, "two words"), (58, "two words")]
    return texts


# ---- 1

def test_decontamination_against_brute_force(spark, corpus):
    r = random.Random(9)
    items = [(1, corpus[5][1]), (2, " ".join((corpus[8][1] or "").split()[3:15])), (3, "two words"), (4, None), (5, ""), (1, corpus[5][1]), (None, corpus[9][1]), (7, prose(r, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs(spark, corpus)
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())

    def brute(text):
        w, hit, ids = split(text), set(), set()
        for item, t in items:
            x = split(t)
            n = min(10, len(x))
            for q in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[q : q + n]:
                        hit |= set(range(p, p + n))
                        ids.add("null" if item is None else str(item))
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    wanted = sorted(((i, *brute(t)) for i, t in corpus), key=str)
    for limit in (1 << 20, 0):  # broadcast, and joined
        assert sorted((tuple(x) for x in decontamination.find_contamination(table, bench, limit).collect()), key=str) == wanted
    kept = decontamination.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x[0]) for x in wanted if not x[5])
    assert decontamination.find_contamination(table.limit(0), bench).count() == 0
    assert not any(x.contaminated for x in decontamination.find_contamination(table, bench.limit(0)).collect())


def test_large_benchmarks_drop_the_same_rows(spark):
    r = random.Random(12)
    item, clean = prose(r, 20), [prose(r, 30) for _ in range(3)]
    bad = clean[0] + " " + item
    rows = [(1, clean[0]), (1, bad), (None, clean[1]), (None, bad), (2, bad), (3, clean[2]), (3, clean[2]), (4, None), (5, "")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (1 << 20, 0):  # broadcast, and joined
        kept = decontamination.drop_contaminated(docs(spark, rows), bench, limit)
        assert kept.columns == docs(spark, rows).columns
        assert sorted((str(x.doc_id), str(x.text)) for x in kept.collect()) == sorted((str(i), str(t)) for i, t in rows if t != bad)


# ---- 2

def test_toxicity(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = prose(r, r.randint(10, 60)).split()
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["idiotic", "worthless", "pathetic"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    table, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(table, known, most=300)
    got = {x.doc_id: x for x in toxicity.score_toxicity(table, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert all(got[i].predicted == labels[i][2] for i in held)
    odd = docs(spark, [(1, None), (2, ""), (None, "you are pathetic, worthless and idiotic"), (4, "w0rthless pathetc worthles idiotic idiotic " + prose(r, 5)), (5, "x" * 100_000)])
    scores = {x.doc_id: x.predicted for x in toxicity.score_toxicity(odd, model).collect()}
    assert scores == {1: 0, 2: 0, None: 1, 4: 1, 5: 0}
    # quoted or reported terms are no abuse; the same words said are
    said = [f"{prose(r, 30)} {t} {prose(r, 4)} {u} {prose(r, 6)} {t}" for t, u in (("idiotic", "worthless"), ("pathetic", "idiotic"))]
    told = [f"{prose(r, 30)} She wrote “{t} {u}” once. {prose(r, 6)}" for t, u in (("idiotic", "worthless"), ("pathetic", "idiotic"))]
    told += [f'{prose(r, 20)} the word "{t}" is meant {prose(r, 9)}' for t in ("idiotic", "worthless", "pathetic")]
    quoting = docs(spark, [*enumerate(said), *enumerate(told, 100)])
    assert {x.doc_id: x.predicted for x in toxicity.score_toxicity(quoting, model).collect()} == {0: 1, 1: 1} | dict.fromkeys(range(100, 105), 0)
    # repeated rows and ties score alike; an empty table has no row
    again = toxicity.score_toxicity(docs(spark, [rows[0], rows[0], (9999, rows[0][1])]), model).collect()
    assert len(again) == 3 and len({x.score for x in again}) == 1 and toxicity.score_toxicity(table.limit(0), model).count() == 0
    assert toxicity.drop_toxic(table, known).columns == table.columns
    assert toxicity.train(table, known.where("toxic = 0")).score([0.0]) == 0.0


def test_automaton_is_the_edit_distance():
    r = random.Random(1)
    terms = ["idiot", "scum", "clown"]
    a = toxicity.Automaton(terms)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "a", "o", "cl"])
        word = "".join(w)
        best = min(distance(word, t) for t in terms)
        assert a.distance(word) == (best if best <= 1 else -1)


# ---- 3

def test_license_scan_against_brute_force(spark, corpus):
    r = random.Random(5)
    rows = [*corpus]
    for k, (_, text) in enumerate(license_scan.TEMPLATES):
        w = text.split()
        if len(w) > 15:
            w[len(w) // 2] = "changed"  # one word of a long notice
        rows.append((100 + k, prose(r, 40) + "\n" + " ".join(w) + ".\n" + prose(r, 30)))
    rows += [(200, "licensed under nothing at all, the license software"), (201, "license " * 200)]
    got = {x.doc_id: x for x in license_scan.scan(docs(spark, rows)).collect()}
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i, t in rows:
        if i in (None, 55):
            continue
        w, names, first = words(t), set(), None
        for name, text in license_scan.TEMPLATES:
            x = grams(words(text))
            size = license_scan._size(len(words(text)))
            stride = license_scan._stride(size)
            for at in range(0, len(w), stride):
                if 100 * len(grams(w[at : at + size + stride]) & x) >= 80 * len(x):
                    names.add(name)
                    first = at if first is None else min(first, at)
        assert (got[i].licenses, got[i].n_licenses, got[i].first_word) == (",".join(sorted(names)), len(names), first)
    assert license_scan.scan(docs(spark, rows[:3]), []).count() == 3
    assert license_scan.scan(docs(spark, rows).limit(0)).count() == 0


# ---- 4

def brute_components(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return sets


def test_near_dedup_against_brute_force(spark, corpus):
    rows = [x for x in corpus if x[0] not in (None, 55)]
    sets = {i: s[0] for i, s in brute_components(rows, 4).items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    wanted = sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)
    for small in (near_dedup.SMALL, 1):  # small buckets directly, and every bucket by prefixes
        assert sorted(tuple(x) for x in near_dedup.near_duplicates(docs(spark, rows), small=small).collect()) == wanted


def test_near_dedup_odd_rows(spark, corpus):
    table = docs(spark, corpus)
    got = near_dedup.near_duplicates(table).collect()
    assert len(got) == len(corpus)
    assert all(x.kept and x.component_id is None for x in got if x.doc_id is None)
    assert all(x.kept and x.n_shingles == 0 for x in got if x.doc_id in (52, 53, 54))
    kept = near_dedup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    ids = [x.doc_id for x in kept.collect()]
    assert len(ids) == len(set(ids)) and {52, 53, 54, None} <= set(ids) and 58 not in ids
    assert near_dedup.near_duplicates(table.limit(0)).count() == 0


def test_near_dedup_keeps_different_texts_of_one_doc_id(spark):
    r = random.Random(13)
    a, b, c = (prose(r, 40) for _ in range(3))
    # doc_id 7 holds two unrelated texts, each with a near copy; doc_id 8 two unrelated texts without any
    rows = [(7, a), (7, b), (21, a + " more"), (22, b + " more"), (8, c), (8, prose(r, 40)), (8, c), (9, ""), (9, "")]
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs(spark, rows)).collect())
    assert got == [(7, 37, 7), (7, 37, 7), (8, 37, 8), (8, 37, 8), (8, 37, 8), (9, 0, 9), (9, 0, 9), (21, 38, 7), (22, 38, 7)]
    kept = [(x.doc_id, x.text) for x in near_dedup.drop_near_duplicates(docs(spark, rows)).collect()]
    assert sorted(kept) == sorted([rows[0], rows[1], rows[4], rows[5], rows[7], rows[8]])


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    common, own = r.integers(0, 1 << 62, 800, dtype=np.uint64), r.integers(0, 1 << 62, 200, dtype=np.uint64)
    a, b = near_dedup.sketches([np.unique(np.concatenate([common, own[:100]])), np.unique(np.concatenate([common, own[100:]])), ], 200)
    assert abs((a == b).mean() - 0.8) < 0.12
    assert (near_dedup.sketches([np.array([5], dtype=np.uint64)], 50) < np.iinfo(np.uint64).max).all()


# ---- 5

def test_packing(spark, corpus):
    table = docs(spark, corpus)
    encoder = PieceEncoder(vocabulary())
    for capacity, padding in ((64, 2), (1024, 8)):
        pieces = packing.pack(table, capacity=capacity, most_padding=padding).collect()
        tokens = sorted(len(encoder.encode_many([t or ""])[0]) // 4 + 1 for _, t in corpus)
        assert sum(p.length for p in pieces) == sum(tokens)
        by = {}
        for p in pieces:
            by.setdefault(p.sequence_id, []).append(p)
        waste = 0
        for ps in by.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at and p.length > 0
                at += p.length
            assert at <= capacity
            waste += 0 if at & (at - 1) == 0 else capacity - at
        assert waste <= 0.02 * sum(tokens)
        unique = {i: t for i, t in corpus if i not in (None, 55)}
        for i, t in unique.items():
            raw = encoder.encode_many([t or ""])[0] + b"\0\0\0\0"
            own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
            assert [p.start for p in own] == list(np.cumsum([0, *[p.length for p in own[:-1]]]))
            assert all(zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 and p.doc_tokens == len(raw) // 4 for p in own)
    assert packing.pack(table.limit(0)).count() == 0


def test_cutting_stock_never_overdraws():
    r = random.Random(2)
    for _ in range(5):
        demand = {k: r.randint(0, 30) for k in r.sample(range(1, 65), 40)}
        chosen, left = packing.plan(demand, 64, 3)
        used = {}
        for pattern, times in chosen:
            assert 61 <= sum(k * n for k, n in pattern.items()) <= 64
            for k, n in pattern.items():
                used[k] = used.get(k, 0) + n * times
        assert all(used.get(k, 0) + left.get(k, 0) == v for k, v in demand.items())
    value, pattern = packing.best_pattern(np.array([3.0, 4.0]), np.array([3, 5]), 11)
    assert (value, pattern) == (10.0, {3: 2, 5: 1})
    solved = packing.solve({5: 30, 3: 20}, 8)
    assert abs(sum(v for _, v in solved) - 30) < 1e-6


# ---- 6

def test_html_extraction(spark):
    page = '<html><head><title>T &amp</title><script>var a="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One\n two<br><p>Three&nbsp;four <em>five</em></p><form>Name</form><div class="comments">Reader says</div></article><footer>&copy; x</footer><p'
    r = random.Random(8)
    rows = [(1, "http://a.org/1", page), (2, None, None), (3, "http://a.org/3", ""), (None, "x", "<p>a &lt; b<p>c &am"), (1, "http://a.org/1", page)]
    wanted = {1: "A & B\nOne two\nThree four five", 2: "", 3: "", None: "a < b\nc &am"}
    for k in range(12):  # a host without article elements: its template tells
        t = [prose(r, 12), prose(r, 40)]
        rows.append((100 + k, f"https://b.org/{k}", f"<body><div id=x1><span>Home</span> <span>About</span></div><div><div id=c><h2>{t[0]}</h2><p>{t[1]}</p></div></div><div id=z>Imprint of the firm</div></body>"))
        wanted[100 + k] = "\n".join(t)
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extraction.extract(table).collect()
    assert len(got) == len(rows) and all(x.text == wanted[x.page_id] and x.n_chars == len(x.text) for x in got)
    limit, html_extraction.BROADCAST_BYTES = html_extraction.BROADCAST_BYTES, -1
    try:
        assert sorted(str(x) for x in html_extraction.extract(table).collect()) == sorted(map(str, got))
    finally:
        html_extraction.BROADCAST_BYTES = limit
    assert html_extraction.extract(table.limit(0)).count() == 0


def test_html_templates_are_classes_of_distinct_pages(spark):
    r = random.Random(15)
    rows, wanted = [], {}
    shared, paragraph = prose(r, 40), prose(r, 30)
    def add(host, body, text):
        rows.append((len(rows), f"https://{host}/{len(rows)}", f"<body><div id=top>Home About</div>{body}<div id=end>Imprint</div></body>"))
        wanted[len(rows) - 1] = text
    for k in range(12):
        own = prose(r, 40)
        if k % 2:  # half of a host's pages are copies
            add("copies.org", f"<div id=c><p>{shared}</p></div>", shared)
        else:
            add("copies.org", f"<div id=c><p>{own}</p></div>", own)
        # two thirds of the pages share a real paragraph
        add("shared.org", f"<div id=c><p>{own}</p>" + (f"<blockquote>{paragraph}</blockquote>" if k % 3 else "") + "</div>", own + (f"\n{paragraph}" if k % 3 else ""))
        # template text inside the article element
        add("inside.org", f"<article><p>{own}</p><p>Read on in our shop</p></article>", own)
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_extraction.extract(table).collect()}
    assert {i: (got[i], t) for i, t in wanted.items() if got[i] != t} == {}


def test_html_text_outside_the_largest_container_stays(spark):
    r = random.Random(16)
    rows, wanted = [], {}
    for k in range(8):
        title, lead, body, last = prose(r, 6), prose(r, 10), prose(r, 80), prose(r, 8)
        rows.append((k, f"https://post.org/{k}", f"<body><div id=top>Home</div><div id=post><h1>{title}</h1><p>{lead}</p><div class=body><p>{body}</p></div></div><p>{last}</p></body>"))
        wanted[k] = "\n".join((title, lead, body, last))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_extraction.extract(table).collect()} == wanted


def test_classes_must_be_ordered_and_nest():
    member = {t: (1, 3) for t in (1, 2, 3)} | {t: (2, 2) for t in (8, 9)}
    orders = html_extraction.class_orders
    assert orders([1, 8, 50, 9, 2, 3], member)[1] and orders([1, 8, 50, 9, 2, 3], member)[2]  # nested in a slot
    assert orders([1, 8, 9, 8, 9, 2, 3], member)[2] == orders([8, 9, 1, 2, 3], member)[2] != 0  # repeats, and beside it
    crossed = orders([1, 8, 2, 9, 3], member)
    assert crossed[1] and crossed[2] == 0  # the smaller of two that cross fails
    assert orders([1, 3, 2, 1, 2, 3], member)[1] == 0 and orders([1, 2, 3, 1], member)[1] == 0
    assert orders([2, 1, 3], member)[1] not in (0, orders([1, 2, 3], member)[1])  # another order on another page
    assert orders([], member) == {}


def test_templates_against_brute_force(spark):
    """Classes of whole occurrence vectors, gathered; a host whose menu is shuffled on every page has no such class."""
    r = random.Random(31)
    rows = []
    for k in range(14):
        menu = ["Home", "News", "Shop", "Help"]
        r.shuffle(menu)
        own = "".join(f"<p>{prose(r, 12)}</p>" for _ in range(r.randint(1, 4)))
        some = "<div id=s><b>Seen</b><p>Also</p><i>Liked</i></div>" if k % 4 else ""
        rows.append((k, "https://kept.org/a", f"<div id=m><p>Home</p><p>News</p></div><div id=c>{own}</div>{some}<div id=f>End</div>"))
        rows.append((100 + k, "https://mixed.org/a", "".join(f"<div id=m>{x}</div>" for x in menu) + f"<div id=c>{own}</div>"))
    rows += [(500, "https://mixed.org/b", ""), (501, None, None), (502, "https://long.org/a", "<p>" + "word " * 200000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.host: set(x.text_tokens) for x in html_extraction.deduce_templates(table).collect()}
    for host in ("kept.org", "mixed.org"):
        pages = sorted({h or "" for _, u, h in rows if html_extraction.host_of(u) == host})
        counts = [html_extraction.page_tokens(h) for h in pages]
        texts = set().union(*(t for _, t in counts))
        classes = {}
        for t in set().union(*(c for c, _ in counts)):
            classes.setdefault(tuple(c[t] for c, _ in counts), set()).add(t)
        wanted = set()
        picked = [x for x in ((sum(n > 0 for n in v), own) for v, own in classes.items()) if x[0] >= 3 and (x[0] == len(pages) or x[0] >= 0.5 * len(pages) and len(x[1]) >= 3) and x[1] & texts]
        member = {t: (i, len(own)) for i, (_, own) in enumerate(picked) for t in own}
        for i, (_, own) in enumerate(picked):
            seen = [html_extraction.class_orders(html_extraction.page_sequence(h)[0], member).get(i) for h in pages]
            seen = [x for x in seen if x is not None]
            if max(sum(x == y for y in seen) for x in seen if x) >= 0.9 * len(seen) if any(seen) else False:
                wanted |= own & texts
        assert got.get(host, set()) == wanted
    assert got.get("kept.org") and not got.get("mixed.org")
    text = {x.page_id: x.text for x in html_extraction.extract(table).collect()}
    assert all("Home" not in text[k] and "Liked" not in text[k] for k in range(14)) and all("Shop" in text[100 + k] for k in range(14))
    assert len(text[502]) == 5 * 200000 - 1


def test_html_names_inside_an_article(spark):
    page = '<article><div class="article-header"><h1>Title</h1></div><p>Body</p><section class="related-work">Work</section><p class="social-history">Past</p><div class="related-posts">More</div><div class="site-footer top">X</div></article>'
    assert html_extraction.main_text(page) == "Title\nBody\nWork\nPast"


# ---- 7

def test_vector_search_against_brute_force(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(700, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)] + [(0, [float(x) for x in v[0]]), (900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [None] * 8), (None, [1.0] * 8), (905, [float(x) for x in v[5]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    ids = np.array([*range(700), 905])
    x = np.concatenate([v, v[5:6]]).astype(float)
    queries = table.where("vec_id % 100 = 0")
    exact = vector_search.search(vector_search.build_index(table, shard_rows=200), queries, factor=1.0, block_rows=4).collect()
    for q in range(0, 700, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        got = sorted((y.rank, y.vec_id, y.score) for y in exact if y.query_id == q)
        assert [g[1] for g in got] == ids[order].tolist() and [g[0] for g in got] == list(range(1, 11))
        assert np.allclose([g[2] for g in got], d[order])
    near = {(y.query_id, y.vec_id) for y in vector_search.search(vector_search.build_index(table, shard_rows=200), queries).collect()}
    assert len(near & {(y.query_id, y.vec_id) for y in exact}) >= 0.9 * len(exact)
    assert vector_search.search(vector_search.build_index(table.limit(0)), queries).count() == 0
    # many cells, split ones, and the same answers
    small = vector_search.build_index(table, shard_rows=20, cell_rows=40)
    assert len(small.cells[8][0]) > 10 and small.shards.count() > len(small.cells[8][0])
    again = vector_search.search(small, queries, factor=1.0, block_rows=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, exact))


def test_cells_and_trees_prune_clustered_vectors():
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16))
    v = (centres[r.integers(0, 40, 4000)] + 0.1 * r.normal(size=(4000, 16))).astype(np.float32).astype(float)
    ids = np.arange(4000)
    tree = vector_search.VantageTree.build(ids, v)
    asked = v[::100]
    exact = tree.search(asked, ids[::100], 10, 1.0)[0]
    assert tree.scored < 0.2 * len(asked) * len(v)
    d = np.sort(np.sqrt(((asked[:, None] - v[None]) ** 2).sum(axis=2)), axis=1)[:, 1:11]
    assert np.allclose(exact, d)
    pivots = v[:60]
    cell = vector_search._distances(v, pivots)
    radii = np.array([cell[cell.argmin(axis=1) == c, c].max() for c in range(60)])
    open_ = vector_search.open_cells(asked, pivots, radii, exact[:, -1], 1.0)
    own = cell[::100].argmin(axis=1)
    near = np.argsort(np.sqrt(((asked[:, None] - v[None]) ** 2).sum(axis=2)), axis=1)[:, 1:11]
    assert all(open_[q, c] or c == own[q] for q in range(len(asked)) for c in cell[near[q]].argmin(axis=1))
    assert open_.mean() < 0.2
    assert vector_search.tuned_factor(ids, v) <= 1.0


# ---- 8

def covered(rows):
    """Per doc_id the places that its rows cover."""
    out = {}
    for x in rows:
        out.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    return out


def test_substring_dedup_finds_every_long_exact_passage(spark, corpus):
    r = random.Random(21)
    inside = prose(r, 55)
    texts = [*[x for x in corpus if x[0] != 55], (60, f"{inside} {prose(r, 5)} {inside}"), (61, base := prose(r, 70)), (61, prose(r, 60)), (62, f"{prose(r, 3)} {base}"), (63, base), (64, corpus[9][1]), (65, f"{prose(r, 8)} {base}" + f" {prose(r, 4)} {base}" * 2), (66, "again " * 300), (67, f"{prose(r, 9)} " + "again " * 120)]
    got = substring_dedup.repeated_passages(docs(spark, texts)).collect()
    words = [(i, re.findall("[0-9a-z]+", (t or "").lower())) for i, t in texts if i is not None]
    classes = {}
    for i, w in words:
        classes.setdefault(tuple(w), set()).add(i)
    holders = {}
    for w in classes:
        for k in range(len(w) - 49):
            holders.setdefault(w[k : k + 50], set()).add(w)
    cover = covered(got)
    pairs = {(x.doc_id, x.other_id) for x in got}
    exact = set()
    for w, ids in classes.items():
        places = {p for k in range(len(w) - 49) if len(holders[w[k : k + 50]]) > 1 for p in range(k, k + 50)}
        assert places <= cover.get(min(ids), set())  # every holder, every place
        exact |= ids if places or len(w) >= 50 and len(ids) > 1 else set()
        if len(w) >= 50 and len(ids) > 1:
            assert all(any(i == a and b in ids for a, b in pairs) for i in ids)
    assert sum({x.doc_id, x.other_id} == {66, 67} for x in got) < 30
    assert {x.doc_id for x in got} >= exact and 60 not in cover
    by_id = {}
    for i, w in words:
        by_id.setdefault(i, []).append(w)
    for x in got:  # positions hold what they claim
        pieces = [(" ".join(u[x.start : x.end]), " ".join(v[x.other_start : x.other_end])) for u in by_id[x.doc_id] for v in by_id[x.other_id]]
        assert x.identity >= 0.8 and x.n_words >= 50 and (x.identity < 1 or any(a == b for a, b in pieces))
    assert {(x.other_id, x.doc_id) for x in got if x.kind == "passage"} == {(x.doc_id, x.other_id) for x in got if x.kind == "passage"}
    passage = next(x for x in got if (x.doc_id, x.other_id) == (51, 50))
    assert passage.n_words == 60 and (passage.start, passage.end, passage.other_start) == (0, 60, 20) and passage.identity == 1.0
    assert substring_dedup.repeated_passages(docs(spark, texts).limit(0)).count() == 0


def test_substring_dedup_of_frequent_lines(spark):
    r = random.Random(14)
    rows = []
    for k in range(6):  # passages of two 28-word lines, each line also in ten texts without the other
        x, y = prose(r, 28), prose(r, 28)
        for line in (x, y):
            rows += [(1000 + len(rows) + i, f"{prose(r, 30)} {line} {prose(r, 30)}") for i in range(10)]
        rows += [(i, f"{prose(r, 30)} {x} {y} {prose(r, 30)}") for i in (2 * k, 2 * k + 1)]
    got = {(x.doc_id, x.other_id): x for x in substring_dedup.repeated_passages(docs(spark, rows)).collect()}
    assert set(got) == {x for k in range(6) for x in ((2 * k + 1, 2 * k), (2 * k, 2 * k + 1))}
    assert all((x.start, x.end, x.n_words, x.identity) == (30, 86, 56, 1.0) for x in got.values())


def test_substring_dedup_aligns_pairs_with_one_seed(spark):
    r = random.Random(31)
    rows = []
    for k in range(40):  # a pair each with a passage in which every sixth word is changed
        base = prose(r, 72).split()
        other = [f"z{k}z{i}" if i % 6 == 5 else x for i, x in enumerate(base)]
        rows += [(2 * k, f"{prose(r, 40)} {' '.join(base)} {prose(r, 40)}"), (2 * k + 1, f"{prose(r, 90)} {' '.join(other)} {prose(r, 20)}")]
    want = set()
    for (i, x), (j, y) in zip(rows[::2], rows[1::2], strict=True):
        w = substring_dedup.Words([x, y], substring_dedup.ALNUM)
        grams, inside = w.grams(substring_dedup.GRAM)
        at = substring_dedup.winnow(grams, inside, w.doc, substring_dedup.GRAM, substring_dedup.WINDOW)
        seeds = [[(int(grams[p]), int(p - w.first[d])) for p in at if w.doc[p] == d] for d in (0, 1)]
        if any(g == h and abs(p - q) == 50 for g, p in seeds[0] for h, q in seeds[1]):
            want |= {(i, j), (j, i)}
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert len(want) > 20 and {(x.doc_id, x.other_id) for x in got} == want
    assert all(x.n_words >= 50 and x.identity >= 0.8 for x in got)


def test_context_of_a_seed_loses_no_passage():
    r = random.Random(32)
    c, gram, told = substring_dedup.CONTEXT, substring_dedup.GRAM, []
    for _ in range(300):
        share, n = r.choice((4, 5, 6, 8, 12)), r.choice((30, 49, 50, 56, 64, 90, 200))
        base = prose(r, n).split()
        other = [x if i % share else r.choice(([], [x, "new"], ["new"])) for i, x in enumerate(base)]
        other = [y for x in other for y in ([x] if isinstance(x, str) else x)]
        a, b = ([*prose(r, r.choice((0, 3, 100))).split(), *x, *prose(r, r.choice((0, 3, 100))).split()] for x in (base, other))
        for p in range(len(a) - gram):
            q = next((q for q in range(len(b) - gram + 1) if b[q : q + gram] == a[p : p + gram]), None)
            if q is not None:
                break
        else:
            continue
        (u, v), (x, y) = ((max(0, z - c), min(len(t), z + gram + c)) for z, t in ((p, a), (q, b)))
        may = substring_dedup.may_hold(a[u:v], p - u, (u == 0, v == len(a)), b[x:y], q - x, (x == 0, y == len(b)))
        holds = bool(substring_dedup.passages(a, b, [(p, q)], []))
        told.append((may, holds))
        assert may or not holds
    assert {x for x, _ in told} == {True, False} and any(x for _, x in told)


def test_substring_dedup_moves_texts_packed_and_once(spark, monkeypatch):
    r = random.Random(33)
    shared, line = prose(r, 300), prose(r, 16)  # every 16 words hold a seed
    rows = [(i, f"{prose(r, 40)} {shared} {prose(r, 40)}") for i in range(4)] + [(i, f"{prose(r, 300)} {line} {prose(r, 300)}") for i in range(4, 8)]
    plans, sizes, own = {}, {}, substring_dedup.materialize

    def materialize(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        out = own(df, name)
        if name == "texts":
            sizes.update({x[0]: len(x["words"]) for x in out.collect()})
        return out

    monkeypatch.setattr(substring_dedup, "materialize", materialize)
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {x.doc_id for x in got} == {0, 1, 2, 3} and all(x.n_words >= 300 for x in got)
    assert all("Exchange" not in plans[name] for name in ("windows", "contexts"))  # both are read off the texts where they are
    assert len(sizes) == 8 and sum(sizes.values()) < 0.6 * sum(len(t) for _, t in rows)


def test_substring_dedup_frees_the_shuffles_of_its_steps(spark):
    r = random.Random(35)
    shared = prose(r, 60)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+", disk.getAllFiles().mkString(" ")))
    before = files()
    substring_dedup.repeated_passages(docs(spark, [(i, f"{prose(r, 9)} {shared}") for i in range(4)]))
    end = time.time() + 10
    while not files() <= before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(runtime.SHUFFLE_CLEANUP, None) in (None, "false")


def test_packed_words_are_the_words():
    for t in ("Ab é1 X--y\n\tz 日本 a\x7fb\x85q \xa0 w'", "", "...", "A" * 500 + "\0b"):
        assert substring_dedup.unpack(substring_dedup.pack(t)).split() == re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())


def test_common_words_and_winnowed_grams_as_defined():
    r = random.Random(34)
    for _ in range(200):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert substring_dedup._common(a, b) == table[-1][-1]
        n, w = r.randint(0, 40), r.choice((1, 2, 5, 12))
        grams = np.array([r.randint(0, 9) for _ in range(n)], dtype=np.uint64)
        doc = np.array(sorted(r.randint(0, 2) for _ in range(n)), dtype=np.int64)
        inside = np.array([r.random() < 0.9 for _ in range(n)], dtype=bool)
        windows = [range(i, i + w) for i in range(n - w + 1) if inside[i] and inside[i + w - 1] and doc[i] == doc[i + w - 1]]
        want = sorted({j for x in windows for j in x if grams[j] == min(grams[k] for k in x)})
        assert substring_dedup.winnow(grams, inside, doc, 5, w).tolist() == want


def test_exact_runs_survive_unlike_neighbours():
    r = random.Random(8)
    run, a, b = prose(r, 52).split(), prose(r, 60).split(), prose(r, 60).split()
    tail = prose(r, 6).split()
    left, right = [*run, *a[:38], *tail], [*run, *b[:38], *tail]
    for starts in ([(i, i) for i in range(3)], []):
        found = substring_dedup.passages(left, right, [(0, 0), (20, 20), (47, 47), (90, 90)], starts)
        assert any(x[0] == 0 and 52 <= x[1] <= 56 for x in found)


def test_chains_are_collinear():
    chains = substring_dedup.chain([(0, 0), (5, 5), (10, 10), (3, 50), (12, 2)])
    assert chains[0] == [(0, 0), (5, 5), (10, 10)]


# ---- 9

def test_token_files_round_trip(spark, corpus, tmp_path):
    table = docs(spark, corpus)
    manifest = binary_output.write_shards(table, f"file://{tmp_path}/ids", vocabulary(), shard_tokens=500)
    got = binary_output.read_shards(manifest, f"file://{tmp_path}/ids").collect()
    encoder = PieceEncoder(vocabulary())
    raw = sorted(((i, encoder.encode_many([t or ""])[0] + b"\0\0\0\0") for i, t in corpus), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_crc32) for x in got) == sorted((str(i), len(b) // 4, zlib.crc32(b)) for i, b in raw)
    ordered = sorted(got, key=lambda x: x.start)
    assert [x.doc_id for x in ordered] == [i for i, _ in raw]
    assert [x.start for x in ordered] == list(np.cumsum([0, *[x.n_tokens for x in ordered[:-1]]]))
    assert manifest.count() > 1
    assert binary_output.token_id_output(table.limit(0)).count() == 0


def test_elias_fano():
    r = random.Random(6)
    for n in (0, 1, 5, 300):
        for top in (1, 50, 10**6, 2**40):
            values = np.array(sorted(r.randint(0, top) for _ in range(n)), dtype=np.uint64)
            x = binary_output.EliasFano.from_bytes(binary_output.EliasFano.encode(values).to_bytes())
            assert x.decode().tolist() == values.tolist()
            assert [x.select(i) for i in range(n)] == values.tolist()
    with pytest.raises(ValueError):
        binary_output.ShardReader(binary_output.build_shard([1], [b"\1\0\0\0"])[:-1] + b"x")


def test_encoder_equals_the_library():
    r = random.Random(1)
    e = PieceEncoder(vocabulary(), cache_limit=200, part_limit=100)
    signs = "ab éß.,'\n\n\t  1²_*#$日 \x1c"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|> a", "\0 x", "it's", ""]
    for at in range(0, len(texts), 100):
        assert [e._direct(t) for t in texts[at : at + 100]] == e.encode_many(texts[at : at + 100])


# ---- 10

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for n, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_base_spans_against_brute_force():
    r = random.Random(7)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (918) 555-3922", "+49 30 1", "a@b@c.com", ".", " ", "é", "9", "-", "a@b.co.x@y.com", "12.34.56.78.90"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in pii.base_spans(text)) == brute_base(text)


def test_pii_rows(spark):
    rows = [(1, None), (2, ""), (None, "mail a@b.co now"), (4, "call (415) 555-2671 or jane (at) mail (dot) org"), (5, "z" * 50_000 + " 10.0.0.1"), (5, "plain text, year 2020")]
    got = pii.personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(x.doc_id, x.n_ip): x for x in got}
    assert by[1, 0].spans == "" and by[1, 0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[None, 0].spans == "email:5:11" and by[5, 1].spans == "ip:50001:50009" and by[5, 0].spans == ""
    assert by[4, 0].spans == "phone:5:19,email:23:47" and by[4, 0].n_phone == 0
    masked = pii.mask_personal_data(docs(spark, rows))
    assert masked.columns == docs(spark, rows).columns
    assert {x.text for x in masked.collect() if x.doc_id in (None, 4)} == {"mail [EMAIL] now", "call [PHONE] or [EMAIL]"}
    assert pii.personal_data(docs(spark, rows).limit(0)).count() == 0


def test_pii_beside_a_base_span():
    weights = pii.learned_weights()
    for text in ("4111 1111 1111 1111 / (555) 987-6543", "10.0.0.1 (555) 987-6543", "(555) 987-6543 / 10.0.0.1 / (415) 555-2671"):
        base, spans = pii.find_spans(text, weights)
        assert len(base) == 1 and set(base) <= set(spans)
        for phone in re.findall(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", text):
            assert (text.index(phone), text.index(phone) + len(phone), "phone") in spans
        assert not re.search("[0-9]", pii.masked(text, spans))


# ---- names that clash

def test_marginals_against_all_segmentations():
    r = random.Random(6)
    for _ in range(30):
        n = r.randint(1, 6)
        segments = sorted({(i, j) for _ in range(8) for i in [r.randrange(n)] for j in [r.randint(i + 1, n)]}, key=lambda x: (x[1], x[0]))
        scores = [r.uniform(-2, 2) for _ in segments]
        weights = {}

        def walk(at, chosen, total):
            if at == n:
                weights[tuple(chosen)] = np.exp(total)
                return
            walk(at + 1, chosen, total)  # background
            for x, (i, j) in enumerate(segments):
                if i == at:
                    walk(j, [*chosen, x], total + scores[x])

        walk(0, [], 0.0)
        log_sum, found = pii.marginals(n, segments, scores)
        whole = sum(weights.values())
        assert abs(log_sum - np.log(whole)) < 1e-9
        assert all(abs(p - sum(v for c, v in weights.items() if x in c) / whole) < 1e-9 for x, p in enumerate(found))


def test_pii_on_generated_lines_held_out():
    r = random.Random(99)
    w = pii.learned_weights()
    right = wrong = missed = 0
    for _ in range(400):
        text, spans = pii._example(r)
        base = pii.base_spans(text)
        if not base:  # others are the base patterns' own
            got = set(pii.find_spans(text, w)[1])
            right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert right >= 0.95 * (right + wrong) and right >= 0.95 * (right + missed)


def test_clashing_columns_of_every_operator(spark, corpus):
    r = random.Random(12)
    texts = [x for x in corpus if x[0] != 55][:40]
    clash = ", node string, key string, print string, token string, host string, score string, held_out string, k1 string, bucket string, cell string, dim string"
    values = ["x"] * 11
    plain = docs(spark, texts)
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *values) for i, t in texts], SCHEMA + clash)
    bench = spark.createDataFrame([(1, texts[3][1], "x")], "item_id long, text string, key string")
    labels = spark.createDataFrame([(i, 1, i % 2, "x") for i, _ in texts if i is not None], "doc_id long, quality int, toxic int, row string")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(decontamination.find_contamination(table, bench)) == rows(decontamination.find_contamination(plain, bench.drop("key")))
    model = toxicity.train(table, labels)
    assert rows(toxicity.score_toxicity(table, model)) == rows(toxicity.score_toxicity(plain, model))
    assert sorted((str(x.doc_id), x.start, x.length) for x in packing.pack(table).collect() if x.length == 1024) == sorted((str(x.doc_id), x.start, x.length) for x in packing.pack(plain).collect() if x.length == 1024)
    assert rows(binary_output.token_id_output(table)) == rows(binary_output.token_id_output(plain))
    pages = [(k, f"http://a.org/{k}", f"<p>{prose(r, 5)}</p>", *values) for k in range(5)]
    web = spark.createDataFrame(pages, "page_id long, url string, html string" + clash)
    assert rows(html_extraction.extract(web)) == rows(html_extraction.extract(web.select("page_id", "url", "html")))
    vectors = spark.createDataFrame([(k, [float(k), 1.0], *values) for k in range(200)], "vec_id long, embedding array<float>" + clash)
    found = [rows(vector_search.search(vector_search.build_index(v), v.where("vec_id % 100 = 0"))) for v in (vectors, vectors.select("vec_id", "embedding"))]
    assert found[0] == found[1] and len(found[0]) == 20
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, [1.0, 2.0, 3.0]), (100, [1.0, 2.0]), (200, [9.0])], "vec_id long, embedding array<float>")
    got = vector_search.search(vector_search.build_index(mixed), mixed.where("vec_id % 100 = 0")).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == [(100, 1, 1, 0.0), (100, 2, 2, 0.5)]


def test_extra_columns_do_not_matter(spark, corpus):
    table = docs(spark, corpus[:10], SCHEMA)
    for name in ("key", "node", "n", "rep", "label", "band", "component", "score", "bucket", "length", "text_key", "print"):
        table = table.withColumn(name, table["doc_id"])
    assert near_dedup.near_duplicates(table).count() == 10
    assert near_dedup.drop_near_duplicates(table).columns == table.columns
    assert pii.mask_personal_data(table).columns == table.columns
    assert license_scan.scan(table).count() == 10
    assert substring_dedup.repeated_passages(table).count() == 0
