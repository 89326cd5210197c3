import hashlib
import itertools
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import op3_packing, op5_html, op6_sharding, op7_decontaminate, op9_chat

# --- packing


def test_boundaries_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        lengths = sorted(rng.sample(range(40), rng.randint(1, 8)))
        counts, k = [rng.randint(1, 9) for _ in lengths], rng.randint(1, 4)
        cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))
        best = min(cost((*s, lengths[-1])) for r in range(k) for s in itertools.combinations(lengths[:-1], min(r, len(lengths) - 1)))
        got = op3_packing.boundaries(np.array(lengths), np.array(counts), k)
        assert cost(got) == best and len(got) <= k
    assert op3_packing.boundaries(np.array([]), np.array([])) == []


def check_packing(rows, docs, max_length, budget):
    """Every token once, whole batches but for the last of a bucket."""
    tokens = defaultdict(list)
    for r in rows:
        tokens[r.doc_id].append((r.start_token, r.n_tokens))
        assert r.n_tokens <= r.bucket_length and r.padding == r.bucket_length - r.n_tokens and r.n_tokens <= max_length
    for d, n in docs.items():
        spans = sorted(tokens[d])
        assert spans[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(spans, spans[1:])) and sum(k for _, k in spans) == n
    by = defaultdict(list)
    for r in rows:
        by[r.bucket_length, r.batch].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    for length, batches in itertools.groupby(sorted(by), key=lambda x: x[0]):
        batches, fit = [b for _, b in batches], max(1, budget // max(1, length))
        assert batches == list(range(len(batches))) and all(len(by[length, b]) == fit for b in batches[:-1]) and len(by[length, batches[-1]]) <= fit


def test_packing_of_counts(spark, monkeypatch):
    monkeypatch.setattr(op3_packing, "GROUP_PIECES", 40)
    rng = random.Random(2)
    docs = {k: rng.choice([0, 1, 5, 17, 64, 65, 200, rng.randint(0, 300)]) for k in range(400)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, n_tokens long")
    rows = op3_packing.pack(op3_packing.pieces_of(df, 64), 64, 5, 256).collect()
    check_packing(rows, docs, 64, 256)
    assert sum(r.padding for r in rows) < 0.15 * sum(r.bucket_length for r in rows)


def test_packing_query(spark, small):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(op3_packing.vocabulary_path(), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=op3_packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check_packing(op3_packing.op3_packing(spark, small).collect(), docs, op3_packing.MAX_LENGTH, op3_packing.TOKEN_BUDGET)


def test_packing_odd(spark, odd):
    rows = op3_packing.pack_documents(odd).collect()
    assert len({(r.doc_id, r.bucket_length, r.batch, r.slot) for r in rows}) == len(rows) >= 9
    assert [r.n_tokens for r in rows if r.doc_id == 2] == [0] and sum(r.doc_id == 1 for r in rows) == 2
    assert sum(r.n_tokens for r in rows if r.doc_id == 4) > op3_packing.MAX_LENGTH
    assert op3_packing.pack_documents(odd.limit(0)).count() == 0


def test_white_space_runs_count_as_the_pattern_has_them():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(op3_packing.vocabulary_path(), "rb"))}
    count = op3_packing.counter(ranks)
    plain = tiktoken.Encoding("t", pat_str=op3_packing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(6)
    for _ in range(60):
        parts = ["".join(rng.choices(" \n\t\u00a0\u2003\x85\r", k=rng.choice([1, 2, 998, 1_000, 1_001, 1_500, 3_000]))) for _ in range(rng.randint(1, 4))]
        words = [rng.choice(["", "a", "it's", "!?", "12", "\x1c", "\u200b", "x 's"]) for _ in range(len(parts) + 1)]
        text = "".join(w + p for w, p in zip(words, parts)) + words[-1]
        assert count(text) == len(plain(text))
    for text in (" " * 1_000_000, "a" + " " * 1_000_000 + "b", "\n" * 1_000_000 + " x"):
        assert count(text) >= 900_000 // max(map(len, (t for t in ranks if not t.strip())))


def test_packing_of_long_runs(spark):
    texts = [" " * 1_000_000, "x" + "\n" * 1_000_000 + "y", "a" * 1_000_000, "!" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in op3_packing.pack_documents(docs).collect()} == {0, 1, 2, 3}


# --- html

P = "A paragraph with quite some words in it, so that it counts as text. "
PAGES = {
    "article": (f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>T &amp; t</h1><p>{P}<p>b<br>c</p></article><footer>f</footer>", f"T & t\n{P.strip()}\nb\nc"),
    "divs": (f"<body><div id=header><a href=/>Site</a></div><div class='wrap with-sidebar'><div class=content><p>{P * 2}</p><p>tail <a href=x>link</a></p></div><div class=sidebar><a href=1>One</a> <a href=2>Two</a></div></div><div id=comments><p>{P * 9}</p></div></body>", f"{(P * 2).strip()}\ntail link"),
    "notice": (f"<body><div class='cookie-notice'><p>{P}</p></div><main><p>{P}</p><aside>{P}</aside><p>end</p></main><form><input><p>Sign up</p></form></body>", f"{P.strip()}\nend"),
    "space": ("<body><p>a \n\t b&nbsp;c</p><script>var t='</p>';</script><p>&#233;&lt;x&gt;</p></body>", "a b c\né<x>"),
    "unclosed": (f"<body><article><p><b>{P}<br><p>two<p>three</article>", f"{P.strip()}\ntwo\nthree"),
    "cut off": (f"<body><article><p>{P}</p><p>half &am", f"{P.strip()}\nhalf &am"),
    "list": (f"<body><main><p>{P}</p><ul><li>one<li>two <i>b</i></ul></main></body>", f"{P.strip()}\none\ntwo b"),
    "comment node": (f"<body><article><!-- <p>no</p> --><p>{P}</p></article></body>", P.strip()),
    "header inside": (f"<body><header>site</header><article><header><h1>Title</h1></header><p>{P}</p></article></body>", f"Title\n{P.strip()}"),
    "plain": ("just text &amp; more", "just text & more"),
    "nothing": ("<nav>x</nav>", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert op5_html.main_text(PAGES[name][0]) == PAGES[name][1]


SLUGS = (
    "<h2 id='related-work'>a</h2><section id='discussion'><p>b</p></section><h2 id='legal-form'>c</h2><p id='comment-on-method'>d</p><h3 id='search-results'>e</h3>"
    "<div id='menu-of-the-day'><p>f</p></div><div id='recommendations'><p class='notice'>g <span class='ad'>h</span></p></div>"
    "<p>i <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <label>j</label></p><section class='social-history'>k</section><p><object>l</object><canvas>m</canvas></p>"
)
SLUG_TEXT = "a\nb\nc\nd\ne\nf\ng h\ni x=1 j\nk\nlm"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_slugs_in_an_article_are_kept(tag):
    cut = "<div class='ad'>no</div><div class='share-buttons'>no</div><ul class='tags'><li>no</ul><div id='sidebar'>no</div><form><label>no</label></form>"
    assert op5_html.main_text(f"<body><div id='site-footer'>no</div><{tag}><p>{P}</p>{SLUGS}{cut}</{tag}></body>") == f"{P.strip()}\n{SLUG_TEXT}"


def test_slugs_without_an_article():
    page = f"<body><div id='content'><p>{P * 3}</p><h2 id='legal'>a</h2><section id='discussion'><p>b</p></section><h2 id='related-work'>c</h2><p>{P * 3}</p></div><div class='cookie-notice'><p>{P * 9}</p></div></body>"
    assert op5_html.main_text(page) == f"{(P * 3).strip()}\na\nb\nc\n{(P * 3).strip()}"


@pytest.mark.parametrize("parts", [(6, 5), (5, 6), (6, 1, 5)])
def test_article_split_over_siblings(parts):
    texts = [[f"{i}.{k} {'a link-free paragraph ' * 5}".strip()[:100] for k in range(n)] for i, n in enumerate(parts)]
    sections = [f"<h2>Part {i}</h2><section>{''.join(f'<p>{t}</p>' for t in part)}</section>" for i, part in enumerate(texts)]
    want = "\n".join(t.strip() for i, part in enumerate(texts) for t in [f"Part {i}", *part])
    links = "".join(f"<a href=/{k}>Link number {k}</a> " for k in range(9))
    assert op5_html.main_text(f"<body><div id=story>{''.join(sections)}</div></body>") == want
    assert op5_html.main_text(f"<body><div>{links}</div>{''.join(sections)}<div>{links}</div></body>") == want


def test_one_container_beside_links_stays_alone():
    links = "".join(f"<a href=/{k}>Link number {k}</a> " for k in range(9))
    assert op5_html.main_text(f"<body><div>{links}</div><div>{f'<p>{P}</p>' * 9}</div><div>{links}</div></body>") == "\n".join([P.strip()] * 9)


def test_bare_text_beside_a_container():
    assert op5_html.main_text(f"<body><div>{P * 9}<br>{P * 9}<div><p>{P}</p><p>{P}</p></div></div></body>").count(P.strip()) == 20


def test_deep_page_does_not_overflow():
    assert op5_html.main_text("<body>" + "<div>" * 20_000 + P + "</div>" * 20_000) == P.strip()


def test_many_unclosed_tags_are_linear():
    assert op5_html.main_text("<body><article>" + "<p><b>x y" * 20_000).count("\n") == 19_999


HOSTILE = {
    "open quote": lambda n: "<body><p>x</p>" + "<a " * n + '"',
    "quoted ends": lambda n: '<a ">" ' * n + "'",
    "items in divs": lambda n: "<div>" * n + "<li>x" * n,
    "cells in divs": lambda n: "<div>" * n + "<td>x" * n,
    "ends of nothing": lambda n: "<div>" * n + "</x>" * n,
    "headers": lambda n: "<div>" * n + "<header>x</header>" * n,
    "rules in inline": lambda n: "<b>" * n + "<hr>" * n,
    "nested": lambda n: "<body>" + "<div>" * n + "x" + "</div>" * n,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_linear(name):
    """Ten times the page of the size at which time in proportion to its square took seconds."""
    began = time.perf_counter()
    op5_html.main_text(HOSTILE[name](80_000))
    assert time.perf_counter() - began < 25


def test_an_open_quote_hides_no_text():
    assert op5_html.main_text(f"<body><article><p>{P}</p><a href=\"x>y</a><p>{P}</p><p title='it>z</p></article>") == f"{P.strip()}\ny\n{P.strip()}\nz"


def soup(rng):
    """A page of divs without telling tags or names, and its main text."""
    sentence = lambda: " ".join(rng.choices(["river", "stone", "walks", "under", "a", "the", "long", "bridge", "quietly"], k=rng.randint(8, 30))) + "."
    links = lambda n: "".join(f"<li><a href=/{rng.randint(1, 99)}>{' '.join(rng.choices(['News', 'Shop', 'Cars', 'Home', 'More'], k=rng.randint(1, 3)))}</a></li>" for _ in range(n))
    paragraphs = [" ".join(sentence() for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 9))]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f"<body><div class=a1><ul>{links(rng.randint(5, 30))}</ul></div><div class=b2>{body}</div><div class=c3><ul>{links(rng.randint(5, 40))}</ul></div><div class=d4><a href=/x>About us</a> <a href=/y>Jobs</a></div></body>"
    return page, "\n".join(paragraphs)


def test_density_decides_where_no_tag_tells(monkeypatch):
    rng = random.Random(7)
    pages = [soup(rng) for _ in range(100)]
    assert sum(op5_html.main_text(p) == t for p, t in pages) >= 98
    monkeypatch.setattr(op5_html, "composite_density", lambda node, share: float(node.chars > 0))
    assert sum(op5_html.main_text(p) == t for p, t in pages) <= 2


def test_counts_and_densities_equal_brute_force():
    """By the definition, one node at a time."""
    import math
    import re
    from html import unescape

    rng = random.Random(8)

    def inner(n):
        return [c for c in n.children if isinstance(c, op5_html.Node) and not c.dropped]

    def text(n):
        return "".join(text(c) if isinstance(c, op5_html.Node) else re.sub(r"\s", "", unescape(c)) for c in n.children if isinstance(c, str) or not c.dropped)

    def below(n):
        return [x for c in inner(n) for x in (c, *below(c))]

    def linked(n):
        return len(text(n)) if n.tag == "a" else sum(map(linked, inner(n)))

    def density(n, body):
        c, lc = len(text(n)), linked(n)
        if not c:
            return 0.0
        t, lt = max(1, sum(x.tag not in ("br", "wbr") for x in below(n))), max(1, sum(x.tag == "a" for x in below(n)))
        base = math.log(max(math.e, c / max(1, c - lc) * lc + linked(body) / max(1, len(text(body))) * c + math.e))
        return c / t * max(0.0, math.log(c / max(1, lc) * t / lt)) / max(1.0, base)

    for _ in range(150):
        page = "<body>" + "".join(rng.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "some text ", "x &amp; y", "<br>", "<section>", "</section>", "<nav>n</nav>"]) for _ in range(rng.randint(1, 60)))
        root = op5_html.parse(page)
        nodes = op5_html.measure(root)
        body = next(n for n in nodes if n.tag == "body")
        for n in nodes:
            assert math.isclose(n.density, density(n, body)) and math.isclose(n.total, sum(density(c, body) for c in inner(n)))
        best = max([body, *below(body)], key=lambda n: n.total)
        chosen, path = op5_html.content(root), [best if best.total > 0 else body]
        while path[-1] is not body:
            path.append(path[-1].parent)
        threshold = min(n.density for n in path)
        up = chosen
        for n in path[1:]:  # what is chosen covers all nodes above the threshold that hang on the path
            reaching = [c for c in inner(n) if c not in path and c.chars and c.density >= threshold]
            for c in reaching:
                up = c
                while up is not None and up is not chosen:
                    up = up.parent
                assert up is chosen


def test_pages_query(spark, small, folder):
    import re
    from html import unescape

    got = {r.page_id: r for r in op5_html.op5_html_extract(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|br|h1)>", body)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>x"), (3, "v", "")], "page_id long, url string, html string")
    rows = op5_html.op5_html_extract(spark, folder(pages=odd)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in rows) == [("1", "", 0), ("1", "", 0), ("3", "", 0), ("None", "x", 1)]
    assert op5_html.op5_html_extract(spark, folder(pages=odd.limit(0))).count() == 0


# --- sharding


def test_table_is_balanced_and_stable():
    names = [f"s{k}" for k in range(50)]
    full = op6_sharding.lookup_table(names, 5_003)
    counts = Counter(full.tolist())
    assert set(counts) == set(range(50)) and max(counts.values()) - min(counts.values()) <= 1
    less = op6_sharding.lookup_table(names[:-1], 5_003)
    assert (full != less)[full != 49].mean() < 0.1
    assert (op6_sharding.lookup_table(names, 5_003) == full).all()
    for bad in ((names, 5_000), (names, 47), (["a", "a"], 5)):
        with pytest.raises(ValueError):
            op6_sharding.lookup_table(*bad)


def test_turns_are_taken_in_order():
    """A naive filling with explicit preference lists."""
    names, size = ["a", "b", "c"], 13
    prefer = []
    for n in names:
        o, s = op6_sharding._digest(n, "offset") % size, op6_sharding._digest(n, "skip") % (size - 1) + 1
        prefer.append([(o + k * s) % size for k in range(size)])
    table, turn = [None] * size, 0
    while None in table:
        k = turn % 3
        table[next(s for s in prefer[k] if table[s] is None)] = k
        turn += 1
    assert op6_sharding.lookup_table(names, size).tolist() == table


def test_place(spark, odd):
    names = ["a", "b", "c"]
    table = op6_sharding.lookup_table(names, 101)
    rows = op6_sharding.place(odd.withColumn("shard", F.lit("old")), "doc_id", names, 101).collect()
    assert len(rows) == 9
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert r.slot == slot and r.shard == table[slot]
    assert op6_sharding.place(odd.limit(0), "doc_id", names, 101).count() == 0


# --- decontamination


def brute_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 14))]) for _ in range(2))
        score, first, end = op7_decontaminate.smith_waterman(a, b)
        assert score == brute_align(a.tolist(), b.tolist())
        assert brute_align(a.tolist(), b[first:end].tolist()) == score


def test_planted_passages(spark, folder):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3_000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = {k: text(rng.randint(12, 60)) for k in range(30)}
    docs, held = [], set()
    for d in range(300):
        body = text(rng.randint(0, 300))
        if d % 3 == 0:
            k = rng.randrange(30)
            copy = [w for w in items[k].split() if rng.random() > 0.06]
            copy = [rng.choice(words) if rng.random() < 0.06 else w for w in copy]
            body += " " + " ".join(copy).upper() + ". " + text(40)
            held.add((d, k))
        elif d % 3 == 1:  # a short run of an item is no copy
            body += " " + " ".join(items[d % 30].split()[:3]) + " " + text(20)
        docs.append((d, body))
    sf = folder(documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in op7_decontaminate.op7_decontaminate(spark, sf).collect()}
    assert len(held - got) <= 1 and not got - held


def test_recall_with_a_fifth_of_the_words_edited(spark):
    """Each word of a copy is replaced, dropped or doubled by another with a chance of a fifth."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 9))) for _ in range(5_000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(rng.randint(15, 60))) for k in range(100)]

    def copy(item):
        out = []
        for w in item.split():
            kind = rng.choice("rdi") if rng.random() < 0.2 else ""
            out += {"": [w], "r": [rng.choice(words)], "d": [], "i": [w, rng.choice(words)]}[kind]
        return " ".join(out)

    docs = [(d, f"{text(100)} {copy(items[d % 100][1])} {text(100)}" if d < 400 else text(250)) for d in range(800)]
    got = {(r.doc_id, r.item_id) for r in op7_decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    ).collect()}
    held = {(d, d % 100) for d in range(400)}
    assert len(got & held) >= 0.97 * len(held) and not got - held


def test_one_block_is_held_at_a_time(spark, small, monkeypatch):
    """The driver is asked for the next block only when the matches of the one before are written."""
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    monkeypatch.setattr(op7_decontaminate, "BLOCK_WORDS", 300)
    live, most, made = set(), [0], type(spark.sparkContext).broadcast

    def broadcast(context, value):
        b = made(context, value)
        if isinstance(value, op7_decontaminate.Block):
            live.add(id(b))
            most[0] = max(most[0], len(live))
            gone = b.destroy
            b.destroy = lambda: (live.discard(id(b)), gone())
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    assert op7_decontaminate.contaminated(docs, bench).count() and most[0] == 1 and not live


def test_blocks_give_the_same(spark, small, monkeypatch):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    whole = sorted((r.doc_id, r.item_id) for r in op7_decontaminate.contaminated(docs, bench).collect())
    monkeypatch.setattr(op7_decontaminate, "BLOCK_WORDS", 300)
    assert whole and sorted((r.doc_id, r.item_id) for r in op7_decontaminate.contaminated(docs, bench).collect()) == whole
    clean = {r.doc_id for r in op7_decontaminate.keep_clean(docs, bench).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, _ in whole}


def test_exact_copies_equal_brute_force(spark, small):
    docs = [(r.doc_id, op7_decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, op7_decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    joined = [(d, f" {' '.join(w)} ") for d, w in docs]
    exact = {(d, i) for i, w in items for d, t in joined if f" {' '.join(w)} " in t}
    got = {(r.doc_id, r.item_id): r for r in op7_decontaminate.op7_decontaminate(spark, small).collect()}
    assert exact <= set(got) and all(got[x].score == 1.0 for x in exact)


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a normal text about nothing in particular"), (3, "a normal text about nothing in particular"), (None, "two words")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in op7_decontaminate.contaminated(odd, bench).collect()) == [(1, 3)] * 4
    kept = op7_decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 7
    assert op7_decontaminate.contaminated(odd, bench.limit(0)).count() == 0 and op7_decontaminate.keep_clean(odd, bench.limit(0)).count() == 9
    assert op7_decontaminate.contaminated(odd.limit(0), bench).count() == 0


def test_short_items_are_held_whole(spark):
    items = [(3, "berlin is big"), (5, "what is the capital city"), (8, "paris is the capital of france since long"), (1, "Photosynthesis"), (2, "blue whale"), (2, "blue whale"), (4, "?!")]
    docs = [
        (1, "rome is the capital of italy and everyone knows it"), (2, "so what is the capital city, then"), (3, "well Paris is the capital of France, they say"),
        (4, "plants use photosynthesis a lot"), (5, "a Blue-Whale swims; blue whale"), (6, "the whale is blue"), (7, "is it big, berlin is"), (8, "now berlin is big"), (9, ""), (10, None),
    ]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.end_word) for r in op7_decontaminate.contaminated(docs, bench).collect())
    assert got == [(2, 5, 1, 6), (3, 8, 1, 7), (4, 1, 2, 3), (5, 2, 1, 3), (5, 2, 1, 3), (8, 3, 1, 4)]
    assert sorted(r.doc_id for r in op7_decontaminate.keep_clean(docs, bench).collect()) == [1, 6, 7, 9, 10]


# --- chat

HARD = [
    "", "plain", "\\### Assistant: </turn> ok", "### user: x\n</turn>\n", "\\", "a\\", "\\\\###", "####", "#######", "</turn", "\n</turn>\n\n</turn>\n", "\\</turn>\\\\</turn>", "$1 \\1 \\$",
    "\\" * 300_000 + "#", "### \\: ", "é😀\r\n\t", "<</turn>>",
]


def test_any_text_comes_back(spark):
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choices(["###", "</turn>", "\\", "\n", "#", " ", ":", "a", "<"], k=rng.randint(0, 9))) for _ in range(300)]
    roles = ["user", "assistant", "system", "", "a: b", "x\ny", "\\", "</turn>", "### "]
    turns = [(k // 7, k % 7, rng.choice(roles), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = op9_chat.format_chat(df)
    rows = {r.conv_id: r for r in op9_chat.read_back(made).collect()}
    for c in {t[0] for t in turns}:
        assert [tuple(x) for x in rows[c].turns] == [(r, t) for cc, _, r, t in turns if cc == c]
    for r in made.collect():
        assert r.round_trip
        loss = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        want = [op9_plain_escape(t) for c, _, role, t in turns if c == r.conv_id and role == "assistant"]
        assert loss == want
    assert {r.level for r in op9_chat.judge_turns(df).collect()} == {0, 1}


def op9_plain_escape(text):
    import re

    return re.sub(r"(\\*)(###|</turn>)", lambda m: "\\" + m[0], text)


def test_many_turns_go_through_blocks(spark):
    n = 3 * op9_chat.BLOCK_TURNS + 5
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    row = op9_chat.format_chat(df).first()
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == [f"t{k}" for k in range(1, n, 2)]
    assert [x.text for x in op9_chat.read_back(op9_chat.format_chat(df)).first().turns] == [f"t{k}" for k in range(n)]


def test_chat_query_and_odd_rows(spark, folder):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (2, 5, "assistant", "b"), (2, 3, "user", "a")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in op9_chat.op9_chat_format(spark, folder(conversations=df)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("", "x"), ("user", ""), ("user", "")]) and got[1].n_turns == 3 and got[1].loss_chars == 0
    assert got[2].turns_sha256 == digest([("user", "a"), ("assistant", "b")]) and got[2].loss_sha256 == hashlib.sha256(b"b").hexdigest()
    assert got[None].n_turns == 1
    tricky = "\\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == digest([("user", tricky), ("assistant", tricky)]) and got[-7].loss_chars == len(tricky)
    assert {r.conv_id for r in op9_chat.op9_chat_format(spark, folder(conversations=df.limit(0))).collect()} == {-7}


def test_chat_query_reads_the_mask(spark, folder, monkeypatch):
    texts = ["\ufeffé😀 ### x", "", "a\\", "</turn> \\###", "ü"]
    rows = [(1, k, "assistant" if k % 2 else "user", texts[k % 5]) for k in range(2 * op9_chat.BLOCK_TURNS + 9)]
    sf = folder(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    loss = "".join(t for _, _, role, t in rows if role == "assistant")
    got = lambda: {r.conv_id: r for r in op9_chat.op9_chat_format(spark, sf).collect()}[1]
    assert got().loss_chars == len(loss) and got().loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    made = op9_chat.format_chat
    off = lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"))
    monkeypatch.setattr(op9_chat, "format_chat", lambda turns: made(turns).withColumn("loss_spans", F.transform("loss_spans", off)))
    assert got().loss_sha256 != hashlib.sha256(loss.encode()).hexdigest()
