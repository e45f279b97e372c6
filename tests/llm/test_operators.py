"""Each corpus operator against brute force, and on nulls, empties, repeats and clashes."""

import collections
import hashlib
import html.parser
import io
import math
import os
import random
import re
import threading
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from chronoplane.llm import chat, counting, dedup, extraction, graph, mixing, packing, quality, search, shared, sharding, warc
from chronoplane.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, row string, k string"
WORDS = "the of and to in that with alpha beta gamma delta river stone cloud table window".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(seed=0, n=90):
    """Documents with copies, near copies, nulls, empties, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randrange(55, 160))
        if i % 9 == 1:
            text = rows[-1][1]
        if i % 9 == 2:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((i, text, ["en", "de", None][i % 3], ["s1", "s2", "s10", None][i % 4], "r", "k"))
    return rows + [(n, None, "en", "s1", None, None), (n + 1, "", "en", "s2", None, None), (n + 2, " \n\t", None, None, None, None), (n + 3, "one two", "de", "s1", None, None), rows[5], rows[5], (None, prose(rng, 60), "en", "s1", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


# shared pieces


def test_scopes_of_two_threads_are_apart(spark):
    """The scope that ends first removes its own tables only."""
    gate, made = threading.Barrier(2), {}

    def run(name, waits):
        with shared.passing(spark):
            made[name] = shared.materialize(spark.range(3), name)
            gate.wait(60)
            if waits:
                gate.wait(60)
                made["rows"] = made[name].count()
        if not waits:
            gate.wait(60)

    threads = [threading.Thread(target=run, args=x) for x in (("first", False), ("second", True))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert made["rows"] == 3


@pytest.mark.parametrize("uri, path", [("file:///a/b", "/a/b"), ("/a/b", "/a/b"), ("file:/a/b", "/a/b"), ("dbfs:/a/b", "/dbfs/a/b")])
def test_local_paths_by_any_name(uri, path):
    assert shared.filesystem(uri)[1] == path


# near-duplicates


def multiset(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [multiset(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            shared, total = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if 5 * shared >= 4 * total:
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    return groups


def test_near_duplicates_equal_brute_force(docs):
    out = dedup.near_duplicates(docs).collect()
    want = collections.Counter()
    for ids in brute_classes(documents()).values():
        known = [i for i in ids if i is not None]
        want.update((i, min(known) if known else None, len(ids)) for i in ids)
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in out) == want
    kept = collections.Counter(r.class_id for r in out if r.kept)
    assert set(kept.values()) == {1} and sum(kept.values()) == len(brute_classes(documents()))


def test_deduplicate_keeps_one_row_of_each_class(docs):
    out = dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert out.count() == len(brute_classes(documents()))


def test_near_duplicates_of_nothing(spark):
    assert dedup.near_duplicates(empty(spark)).isEmpty() and dedup.deduplicate(empty(spark)).isEmpty()


def test_signatures_are_unbiased_for_weighted_similarity():
    errors = []
    for k in range(60):
        a = "a b c d e f g " * (20 + k % 7) + " ".join(map(str, range(200))) + f" z{k}"
        b = "a b c d e f g " * (9 + k % 11) + " ".join(map(str, range(2 * k, 200)))
        s = dedup.signatures(2, *dedup.windows([a, b]))
        x, y = multiset(a), multiset(b)
        errors.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.02


def test_large_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 300)
    monkeypatch.setattr(dedup, "BATCH", 1000)
    rng = random.Random(3)
    base = prose(rng, 120).split(" ")
    rows = []
    for i in range(40):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own), "en", "s", None, None))
    out = dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {i: min(ids) for ids in brute_classes(rows).values() for i in ids}
    assert {r.doc_id: r.class_id for r in out} == want


def test_repeated_rows_of_a_text_are_compared_once(spark):
    rng = random.Random(8)
    a = prose(rng, 120).split(" ")
    b = a[:60] + ["other"] + a[61:]
    rows = [(1, " ".join(a), "en", "s", None, None)] * 400 + [(2, " ".join(b), "en", "s", None, None)] * 300 + [(3, prose(rng, 90), "en", "s", None, None)]
    out = dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in out) == {(1, 1, 700): 400, (2, 1, 700): 300, (3, 3, 1): 1}


def test_near_duplicates_with_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    a = prose(rng, 150_000).split(" ")
    b = [*a[:70_000], "other", *a[70_001:]]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, prose(rng, 60)), (4, "w " * 200_000)]
    table = spark.createDataFrame([(*r, "x", 1, "y", b"z", 2) for r in rows], "doc_id long, text string, digest string, uid long, label string, node binary, rep int")
    assert {r.doc_id: r.class_id for r in dedup.near_duplicates(table).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sorted(r.doc_id for r in dedup.deduplicate(table).select("doc_id", "uid").collect()) == [1, 3, 4]


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "u long, v long")
    out = {r.node: r.root for r in graph.components(edges).collect()}
    assert out == {**{i: 0 for i in range(1, 61)}, 200: 100}


# extraction

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/a>Home</a></nav><div class="cookie-notice">We use cookies &amp; more</div>
<article><h1>A  title</h1><p>First &amp; foremost<br>text, <b>bold</b> and a <a href=x>link</a> in it.</p><script>var t="</p>";</script><p>Short.</p><div class=ad>Buy now</div><!-- no --></article>
<section id="comments"><p>Nice post, thank you for all of it.</p></section><aside>Side</aside><form>Mail <input></form><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert extraction.main_text(PAGE) == "A title\n\nFirst & foremost text, bold and a link in it.\n\nShort."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a &lt;b&gt;</p", "a <b>"), ("<scr", ""), ("<!-- x", ""), ("<p>1 < 2</p>", "1 < 2"), ("<script>x", "")])
def test_broken_pages(page, text):
    assert extraction.main_text(page) == text


def test_pages_without_article_tags_follow_the_rules():
    long = "This is one of the paragraphs that are long enough to be judged by the rules on their own, since they have more than two hundred characters and many of the words that are frequent in all texts of this language."
    links = "".join(f"<li><a href=/{i}>Another page of this site number {i}</a></li>" for i in range(5))
    page = f"<body><ul>{links}</ul><div><h2>Heading</h2><p>{long}</p><p>Short one.</p><p>{long}</p></div><ul>{links}</ul></body>"
    assert extraction.main_text(page) == f"Heading\n\n{long}\n\nShort one.\n\n{long}"


LONG = "This is one of the paragraphs that are long enough to be judged by the rules on their own, since they have more than two hundred characters and many of the words that are frequent in all texts of this language."
WRAPPERS = ["div class='site-content has-sidebar'", "div class='layout no-sidebar'", "div class='elementor-widget elementor-widget-text-editor'", "form id=aspnetForm", "div class='page sidebar'", "div id=search"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_names_of_wrappers_do_not_drop_the_text(wrapper, inner):
    page = f"<body><div class=comments><p>{LONG}</p></div><{wrapper}><{inner}><h1>Title</h1><p>{LONG}</p></{inner}><div class=sidebar><p>Aside {LONG}</p></div><aside>{LONG}</aside></{wrapper.split()[0]}></body>"
    want = f"Title\n\n{LONG}"
    if inner == "div":
        page = page.replace(f"<p>{LONG}</p></div><div class=sidebar>", f"<p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>")
        want += f"\n\n{LONG}"
    assert extraction.main_text(page) == want


@pytest.mark.parametrize("name", ["entry-header", "article-header", "post__header"])
def test_heading_wrappers_stay(name):
    for tag in ("div", "header"):
        head = f"<{tag} class={name}><h1>Title</h1></{tag}>"
        assert extraction.main_text(f"<article>{head}<p>{LONG}</p></article>") == f"Title\n\n{LONG}"
        assert extraction.main_text(f"{head}<article><p>{LONG}</p></article>") == f"Title\n\n{LONG}"


def test_names_still_drop_what_is_beside_the_text():
    for out in ("div class=sidebar", "div class=elementor-widget-nav-menu", "div class=related", "form", "aside", "header", "div class=widget"):
        tag = out.split()[0]
        card = f"<{out}><article><p>Card {LONG}</p></article></{tag}>"
        assert extraction.main_text(f"{card}<article><p>{LONG}</p></article>") == LONG
        assert extraction.main_text(f"<{out}><p>Card {LONG}</p></{tag}><p>{LONG}</p><p>{LONG}</p>") == f"{LONG}\n\n{LONG}"


def test_headings_above_long_lists_and_at_the_end_stay():
    items = [f"Item {i}" for i in range(7)]
    page = f"<body><div><h2>Above</h2><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><p>{LONG}</p><h2>Last</h2><p>Short.</p><p>Tail.</p></div></body>"
    assert extraction.main_text(page) == "\n\n".join(["Above", *items, LONG, "Last", "Short.", "Tail."])
    links = "<ul><li><a href=/x>Another page of this site</a></li></ul>"
    assert extraction.main_text(f"<body><p>{LONG}</p><h2>More pages</h2>{links}</body>") == LONG


UNLISTED = [
    "Вчера в городском саду прошло большое собрание жителей, на котором обсуждали строительство нового моста через реку.",
    "昨天下午，来自全市各个区的居民聚集在中央公园，讨论新桥的建设计划，并向市政府提出了许多具体的意见和建议，希望工程早日完成。",
    "Wczoraj mieszkańcy miasta spotkali się w parku, żeby omówić budowę nowego mostu oraz remont starych dróg w okolicy.",
    "Gisteren kwamen veel inwoners bijeen om te praten over de bouw van een nieuwe brug en het herstel van oude wegen.",
]


@pytest.mark.parametrize("text", UNLISTED)
def test_pages_without_article_tags_in_unlisted_languages(text):
    links = "".join(f"<li><a href=/{i}>{text[:40]}</a></li>" for i in range(5))
    page = f"<body><ul>{links}</ul><div><h2>{text[:9]}</h2><p>{text}</p><p>{text[:20]}</p><p>{text * 3}</p></div><ul>{links}</ul></body>"
    assert extraction.main_text(page) == "\n\n".join(x.strip() for x in (text[:9], text, text[:20], text * 3))


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</section>" * 40_000, "<svg/>" * 100_000, "<p class=ad>" * 40_000, "<article><header>" * 20_000 + "</footer>" * 20_000, "<a href='" * 40_000])
def test_long_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    extraction.main_text(page)
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize(
    "body, want",
    [
        (f'<article><p>{LONG}</p><p class="ad-free">{LONG}</p></article>', [LONG, LONG]),
        (f'<article><p>{LONG}</p><p class="related-work">{LONG}</p></article>', [LONG, LONG]),
        (f'<article><p>{LONG}</p><h2 id="search">Search algorithms</h2><p>{LONG}</p></article>', [LONG, "Search algorithms", LONG]),
        (f'<article><p>{LONG}</p><section id="related-work"><h2>Related work</h2><p>{LONG}</p></section></article>', [LONG, "Related work", LONG]),
        (f'<main><p>{LONG}</p><section id="menu"><p>{LONG}</p></section></main>', [LONG, LONG]),
        (f'<h1 class="page-header">Title</h1><p>{LONG}</p><p>{LONG}</p>', ["Title", LONG, LONG]),
        (f"<article><p>{LONG}</p><p hidden>{LONG}</p></article>", [LONG]),
        (f'<article><p>{LONG}</p><div style="display : NONE"><p>{LONG}</p></div></article>', [LONG]),
        (f'<article><p>{LONG} <span style="visibility:hidden">no <span>one</span> sees</span></p></article>', [LONG]),
        (f"<article><p><span hidden>{LONG}</p></article>", [LONG]),
        (f'<article><p title="hidden, display:none" data-hidden="1">{LONG}</p></article>', [LONG]),
        # A menu, shares and short lines under a suspect name go by the rules; comments, adverts and lists of articles by their names.
        (f'<main><p>{LONG}</p><div class="menu"><ul><li><a href="x">One</a></li><li>Two</li></ul></div><p>{LONG}</p></main>', [LONG, LONG]),
        (f'<article><p>{LONG}</p><div class="post-comments"><p>{LONG}</p></div><div class="ad"><p>{LONG}</p></div><div class="related-posts"><p>{LONG}</p></div></article>', [LONG]),
    ],
)
def test_names_need_support_in_an_article_and_hidden_text_goes(body, want):
    assert extraction.main_text(f"<body>{body}</body>") == "\n\n".join(want)


def test_ties_between_neighbours():
    """Equally near a good and a bad block, an article's short block stays, another one goes."""
    bad = '<p><a href="x">' + "link " * 30 + "</a></p>"
    for tag, kept in (("article", True), ("div", False)):
        page = f"<body><{tag}><p>{LONG}</p><p>Short.</p>{bad}</{tag}></body>"
        assert extraction.main_text(page) == (f"{LONG}\n\nShort." if kept else LONG)


class Reader(html.parser.HTMLParser):
    """An article's blocks by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.handle_data(" " if tag == "br" else "")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_tables_pages_read_by_another_parser():
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    for page in pages:
        reader = Reader()
        reader.feed(page or "")
        assert extraction.main_text(page) == "\n\n".join(t for b in reader.blocks if (t := " ".join(b.split())))


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    clashing = extraction.extract(pages.selectExpr("*", "1 AS text", "2 AS n_chars"))
    assert clashing.columns == ["page_id", "url", "text", "n_chars"] and clashing.count() == pages.count()
    out = extraction.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, len(extraction.main_text(PAGE))), (1, len(extraction.main_text(PAGE)))]
    assert extraction.extract(empty(spark, "page_id long, url string, html string")).isEmpty()


# tokens, counts, packing


def test_ids_equal_the_library():
    own, rng = Encoder(PATH), random.Random(1)
    letters = list("ab C1é'  \n\t.,s'll\x0b\xa0ü中<|>") + ["<|endoftext|>", "😀", "́", "ŉ", "ß"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        assert own.ids(text) == own.by_library(text), repr(text)


def test_long_runs_have_the_ids_of_the_library():
    own = Encoder(PATH)
    for text in (" " * 300_000 + "a", "\n " * 200_000, "ab" * 100_000, "1" * 100_000):
        assert own.ids(text) == own.by_library(text)


def test_token_counts_equal_the_library(docs):
    library = Tokenizer.from_file(PATH)
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in documents())
    out = counting.token_counts(docs, PATH, limit=100).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in out)


def test_the_broadcast_table_is_of_the_corpus_and_changes_no_count(spark, docs, monkeypatch):
    table = counting.frequent_lengths(docs, PATH).unpacked()
    library = Tokenizer.from_file(PATH)
    pieces = collections.Counter(p for r in documents() for p in Encoder(PATH).pieces(r[1] or ""))
    assert set(table) == {p for p, n in pieces.items() if n > 1} and all(n == len(library.encode(p, add_special_tokens=False).ids) for p, n in table.items())
    monkeypatch.setattr(counting, "FREQUENT", 5)
    assert set(counting.frequent_lengths(docs, PATH).unpacked()) == {p for p, _ in sorted(pieces.items(), key=lambda x: (-x[1], x[0].encode()))[:5]}
    rows = [(1, "word  two " * 60_000, "x"), (2, None, "y"), (3, "", "z"), (4, "a<|endoftext|>b", "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert {r.doc_id: r.n_tokens for r in counting.token_counts(odd, PATH).collect()} == want
    assert counting.token_counts(empty(spark), PATH).isEmpty()


def test_sentencepiece_counts(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = counting.token_counts(spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.n_tokens > 0 for r in out} == {1: True, 2: False}


def test_packing_places_every_id_once(spark, docs):
    long = (1000, prose(random.Random(9), 3000), "en", "s1", None, None)
    both = docs.unionByName(spark.createDataFrame([long], SCHEMA)).repartition(5)
    library = Tokenizer.from_file(PATH)
    want = {}
    for r in [*documents(), long]:
        want[r[0]] = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
    sequences = packing.pack(both, PATH).cache()
    rows = packing.pieces(sequences).collect()
    covered = collections.defaultdict(list)
    for p in rows:
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(want[p.doc_id]) and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        covered[p.doc_id] += range(p.start, p.start + p.length)
    times = collections.Counter(r[0] for r in [*documents(), long])
    assert all(collections.Counter(covered[d]) == collections.Counter({i: times[d] for i in range(len(ids))}) for d, ids in want.items())
    placed = collections.defaultdict(list)
    for p in rows:
        placed[p.sequence_id] += range(p.offset, p.offset + p.length)
    assert all(sorted(x) == list(range(len(x))) and len(x) <= packing.WINDOW for x in placed.values())
    assert sum(len(x) < packing.WINDOW for x in placed.values()) <= 1
    assert packing.pack(empty(spark), PATH).isEmpty()


# chat


def test_chats_read_back(spark):
    rows = [(1, 1, "assistant", "b <|im_end|> <\\|x"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, ""), (None, None, "assistant\n<|", "é"), (1, 0, "user", "a")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", chat.F.lit(1))
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(chats, PATH), PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 4 and out[1].turns_sha256 == sha("user\na\nuser\na\nassistant\nb <|im_end|> <\\|x\nassistant\n\n")
    assert out[1].loss_sha256 == sha("b <|im_end|> <\\|x") and out[1].loss_chars == len("b <|im_end|> <\\|x")
    assert out[2].loss_chars == 0 and out[None].turns_sha256 == sha("assistant\n<|\né\n")
    assert chat.format_chats(empty(spark, "conv_id long, turn long, role string, text string"), PATH).isEmpty()


def test_escaping_is_reversible_and_hides_control_strings():
    for text in ("<|im_start|>", "<\\|", "<\\\\|a", "<<|", "a<b|c", "<|", "\\<|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    for role in ("a\nb", "a\\n", "\\", "<|\n<\\|"):
        assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)


# sharding


def test_shards_are_even_and_keep_copies_together(spark, docs):
    out = sharding.shard(docs, 4).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    counts = [len(by[s]) for s in range(4)]
    assert max(counts) - min(counts) <= 1 and all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    rows = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in documents())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == rows
    shards = collections.defaultdict(set)
    for r in out:
        shards[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for (_, size), s in shards.items() if size > 1)


def test_a_text_larger_than_a_shard_is_split(spark):
    out = sharding.shard(spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(60)], "doc_id long, text string"), 6).collect()
    counts = collections.Counter(r.shard for r in out)
    assert set(counts.values()) == {10}
    crc = zlib.crc32(b"same")
    assert len({r.shard for r in out if r.text_crc32 == crc}) <= 6
    assert sharding.shard(empty(spark)).isEmpty()


@pytest.mark.parametrize("sizes", [[2] * 160, [8] * 50, [8] * 20 + [1] * 160, [40] * 5 + [3] * 40, [1, 2, 3, 4, 5, 6, 7] * 12])
def test_linked_documents_are_cut_no_more_than_they_must_be(spark, sizes):
    rows = [(i, f"text {g}") for g, n in enumerate(sizes) for i in range(n)]
    clash = "doc_id long, text string, g int, n int, label int, shard int, uid int"
    out = sharding.shard(spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, (_, t) in enumerate(rows)], clash).repartition(4)).collect()
    counts = collections.Counter(r.shard for r in out)
    assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    held = collections.defaultdict(set)
    for r in out:
        held[r.text_crc32].add(r.shard)
    split = sum(len(x) > 1 for x in held.values())
    quota = sharding.quotas(len(rows), 16)
    # Brute force: greedy whole placement, larger first, into the fullest shard that has room.
    room, least = sorted(quota, reverse=True), 0
    for n in sorted((n for n in sizes if n > 1), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            least += 1
            for _ in range(n):
                room[max(range(16), key=lambda k: room[k])] -= 1
    assert split <= max(least, 2)


# search


def brute_top(rows, k, every):
    usable = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in usable:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in usable if c != q)
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "TILE_CANDIDATES", 2)
    monkeypatch.setattr(search, "FAN_IN", 2)
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-3, 4) / 8 for _ in range(5)]) for i in range(70)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, []), (None, [0.1] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", search.F.lit(0)).repartition(4)
    got = {tuple(r) for r in search.top_k(df, 5, 6).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, 6, 5)


def test_top_k_of_little_and_large(spark):
    kind = "vec_id long, embedding array<double>"
    assert search.top_k(empty(spark, kind)).isEmpty() and search.top_k(spark.createDataFrame([(0, [1.0])], kind)).isEmpty()
    rows = [(0, [3e7, 1.0]), (1, [2e7, 1.0]), (2, [2e7, 1.0]), (3, [-1e7, 5.0])]
    got = {tuple(r) for r in search.top_k(spark.createDataFrame(rows, kind), 2, 3).collect()}
    assert got == brute_top(rows, 3, 2)


def test_scores_beyond_64_bits_are_cut(spark):
    rows = [(0, [1e300, 1.0]), (1, [1.7e308, 0.0]), (2, [3e20, 2.0]), (3, [-1e300, 0.0]), (4, [0.0, 3.0])]
    got = [tuple(r) for r in search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1), (0, 3, 4, 3 * 64 * 64), (0, 4, 3, 1 - 2**63)]


# mixing


def test_targets_are_met_and_capped(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(5, 60)), "en", s, None, None) for i, s in enumerate(["a"] * 150 + ["b"] * 60 + ["c"] * 20 + [None] * 5)] + [(999, None, "en", "a", None, None), (998, " ", "en", "zero", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = mixing.mix_report(df).collect()
    source = {r[0]: r[3] for r in rows}
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    weights = {s: [1, 2, 3][i % 3] for i, s in enumerate(sorted(x for x in sizes if x) + [None])}
    targets, open_ = {}, dict(weights)
    left = sum(sizes.values())
    while True:
        level = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if level[s] > 3 * sizes[s]]
        if not over:
            targets |= level
            break
        for s in over:
            targets[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            del open_[s]
    taken = collections.Counter()
    for r in out:
        assert r.size == len(words(dict((x[0], x[1]) for x in rows)[r.doc_id])) and 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        assert r.target == pytest.approx(targets[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(taken[s] == pytest.approx(targets[s], abs=12) for s in sizes)
    again = mixing.mix_report(df.repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_repeated_rows_are_taken_one_by_one(spark):
    text = prose(random.Random(6), 10)
    rows = [(None, text, "en", "a", None, None)] * 1000 + [(7, text, "en", "b", None, None)] * 300 + [(7, prose(random.Random(7), 10), "en", "b", None, None)] * 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = mixing.mix_report(df).collect()
    taken = collections.Counter()
    for r in out:
        taken[r.source_size, r.target] += r.taken
        assert r.taken <= 3 * r.size
    assert len(out) == 1500 and len(taken) == 2
    for (_, target), words_taken in taken.items():
        assert abs(words_taken - target) <= 10
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and 10 * mixed.count() == sum(taken.values())
    again = [sorted((r.text for r in x.collect())) for x in (mixed, mixing.mix(df.repartition(2)))]
    assert again[0] == again[1]


def test_mix_with_clashing_columns_and_a_very_long_text(spark):
    rows = [(i, prose(random.Random(i), 30), "s", 1, 2.0, 3, "x", 4) for i in range(50)] + [(99, "w " * 300_000, "t", 1, 2.0, 3, "x", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double, lam int, k string, place int")
    assert {r.doc_id: r.size for r in mixing.mix_report(df).collect()}[99] == 300_000
    assert mixing.mix(df).columns == df.columns


def test_mix_of_nothing(spark):
    assert mixing.mix_report(empty(spark)).isEmpty() and mixing.mix(empty(spark)).isEmpty()


# archives


def test_archives_round_trip(spark):
    big, other = "<p>é" + "x" * 1200, "<p>" + "y" * 1500
    rows = [(1, "http://a", big, 0), (5, "http://b", big, 0), (3, None, big, 0), (2, "u v", "small", 0), (4, "w", "small", 0), (6, "n", None, 0), (7, "o", other, 0), (7, "o", other, 0), (None, "p", other, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first long").repartition(3)
    out = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    refers = {1: 5, 3: 5}
    want = collections.Counter((r[0], len((r[2] or "").encode()), sha(r[2]), "revisit" if r[0] in refers else "response", refers.get(r[0])) for r in rows)
    assert out == want
    assert warc.round_trip(empty(spark, "page_id long, url string, html string")).isEmpty()


def test_an_archive_is_read_in_pieces(spark, tmp_path, monkeypatch):
    import gzip
    import resource

    monkeypatch.setattr(warc, "CHUNK", 1 << 16)
    body = b"x" * 1_000_000
    record = b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    raw = io.BytesIO()
    with gzip.GzipFile(fileobj=raw, mode="wb") as out:
        for _ in range(300):
            out.write(record)
    raw.seek(0)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(r == record for r in warc.split_records(warc._inflate(raw))) == 300
    # 300 MB went by.
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
    two = io.BytesIO(gzip.compress(b"ab" * 100_000) + gzip.compress(b"c" * 10))
    assert b"".join(warc._inflate(two)) == b"ab" * 100_000 + b"c" * 10


def test_normaliser_writes_a_member_per_record():
    records = [f"WARC/1.0\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n" for n in (0, 5, 70_000)]
    stream = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = stream.compress(b"".join(records)) + stream.flush()
    found = list(warc.split_records(warc._inflate(io.BytesIO(whole))))
    assert found == records and [zlib.decompress(warc._member(r), 31) for r in found] == records
    with pytest.raises(ValueError, match="cut off"):
        list(warc.split_records(iter([records[1][:-6]])))


# quality


def brute_counts(text):
    w = words(text)
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered), failed


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "a b c a b c", "x " * 80, "l1 é\nl1 é\n\nl2 #|\n", "\x0b\x1c\xa0a b"] + [r[1] for r in documents(6, 20)] + ["a a a " + prose(rng, 70) + "\n" + "same line here\n" * 4]
    df = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(2)
    for r in quality.quality_report(df).collect():
        assert tuple(r)[1:7] == brute_counts(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_ordinary_texts_stay(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(60, 300)), "en", "s", "", "") for i in range(150)]
    # A long text, one with a repeated line, and one with a few symbols are ordinary.
    rows += [(150, prose(rng, 420), "en", "s", "", ""), (151, prose(rng, 20) + ("\n" + prose(rng, 9)) * 2 + "\n" + prose(rng, 30), "en", "s", "", ""), (152, "costs 5$ " + prose(rng, 90), "en", "s", "", "")]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(rng, 100).split()), "en", "s", "", "") for i in range(12)]
    rows += [(2000, " ".join(w + w for w in prose(rng, 100).split()), "en", "s", "", "")]
    rows += [(2001, "\n".join(x for i in range(60) for x in ([prose(rng, 3)] if i % 10 == 0 else []) + [f"line{i % 7}"] * 9), "en", "s", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    report = quality.quality_report(df).collect()
    kept = {r.doc_id for r in report if r.kept}
    assert kept == set(range(153))
    out = quality.quality_filter(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept
    assert quality.quality_report(empty(spark)).isEmpty() and quality.quality_filter(empty(spark)).isEmpty()


def test_small_groups_are_judged_by_the_next_wider_estimate(spark):
    rng = random.Random(9)
    junk = lambda n: " ".join(w + "***" for w in prose(rng, n).split())
    rows = [(i, prose(rng, rng.randrange(60, 300)), "en", "s", "", "") for i in range(100)]
    # A source of 2 rows, a language of 2 rows, and both null.
    rows += [(200, prose(rng, 80), "en", "t", "", ""), (201, junk(80), "en", "t", "", ""), (202, prose(rng, 80), "de", "u", "", ""), (203, junk(80), "de", "u", "", ""), (204, junk(90), None, None, "", ""), (205, prose(rng, 90), None, None, "", "")]
    kept = {r.doc_id for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect() if r.kept}
    assert kept == {*range(100), 200, 202, 205}
    few = spark.createDataFrame(rows[:10] + rows[-4:], SCHEMA)
    assert {r.doc_id for r in quality.quality_report(few).collect() if r.kept} == {*range(10), 202, 205}


def test_quality_with_clashing_columns_and_a_very_long_text(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, 100), "en", "s", 1, "x", 2.0, 3, "y") for i in range(70)] + [(99, prose(rng, 200_000), "en", "s", 1, "x", 2.0, 3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, g string, x0 double, w int, kept string")
    out = quality.quality_filter(df)
    # In a source of equal lengths the long text is an outlier.
    assert out.columns == df.columns and out.count() == 70
    assert {r.doc_id: r.n_words for r in quality.quality_report(df).collect()}[99] == 200_000


def test_a_text_is_judged_by_the_scatter_of_its_own_source(spark):
    """What is ten deviations off in a tight source is ordinary in a wide one."""
    rng = random.Random(12)
    word = lambda: rng.choice("bcdfghkl") + "".join(rng.choice("aeioumnr") for _ in range(rng.randrange(5, 10)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randrange(196, 205)), "en", "tight", "", "") for i in range(400)]
    rows += [(1000 + i, text(int(math.exp(rng.gauss(6, 0.8))) + 60), "en", "wide", "", "") for i in range(400)]
    long = text(1500)
    rows += [(5000, long, "en", "tight", "", ""), (5001, long, "en", "wide", "", "")]
    kept = {r.doc_id for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect() if r.kept}
    assert 5000 not in kept and 5001 in kept and len(kept) >= 0.99 * len(rows)


def test_the_verdict_is_no_cutoff_on_one_count(spark):
    """Texts go whose every count, alone, lies within what others of their source show."""
    rng = random.Random(13)
    fresh = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, fresh(int(math.exp(rng.uniform(4.2, 7)))), "en", "s", "", "") for i in range(300)]
    few = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(90)]
    odd = " ".join(rng.sample(few, 90) + rng.sample(few, 90) + rng.sample(few, 90) + rng.sample(few, 90) + rng.sample(few, 90) + rng.sample(few, 90))
    df = spark.createDataFrame([*rows, (999, odd, "en", "s", "", "")], SCHEMA)
    report = {r.doc_id: r for r in quality.quality_report(df).collect()}
    assert not report[999].kept and not report[999].base_failed and sum(r.kept for r in report.values()) >= 298
    counts = {r.doc_id: r for r in quality.text_counts(df).collect()}
    for c in ("n_words", "word_chars", "n_marks", "n_distinct", "n_symbols", "n_dup_lines"):
        others = [r[c] for i, r in counts.items() if report[i].kept]
        assert min(others) <= counts[999][c] <= max(others)


def test_copies_do_not_tighten_a_group(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randrange(60, 300)), "en", "s", "", "") for i in range(100)]
    rows += [(1000 + i, rows[7][1], "en", "s", "", "") for i in range(900)]
    report = quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.kept for r in report) >= 998


def brute_estimate(x):
    """The least-determinant estimate of three starts, in numpy, on distinct vectors."""
    x = np.unique(x, axis=0)
    least = np.array(quality.LEAST) * quality.GRID
    lower = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]

    def model(rows):
        low = np.linalg.cholesky(quality.CONSISTENCY * np.cov(rows.T, ddof=0))
        assert (np.diag(low) > least).all()
        return rows.mean(axis=0), np.linalg.inv(low), np.prod(np.diag(low))

    centre = lower(x)
    spread = np.maximum(1.4826 * lower(np.abs(x - centre)), least)
    pulled = np.clip(x, centre - np.floor(2 * spread), centre + np.floor(2 * spread))
    best = None
    for mean, factor, _ in [(centre, np.diag(1 / spread), None), model(x), model(pulled)]:
        det = np.inf
        while True:
            bins = np.floor(quality.BINS_PER_OCTAVE * np.log2((((x - mean) @ factor.T) ** 2).sum(axis=1) + 2.0**-10))
            near = x[bins <= np.sort(bins)[int(np.ceil(quality.SUPPORT * len(x))) - 1]]
            new = model(near)
            if not new[2] < (1 - quality.FALL) * det:
                break
            mean, factor, det = new
        if best is None or det < best[2]:
            best = mean, factor, det
    return best


def test_fit_agrees_with_numpy(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(60, 400)), "en", "s", "", "") for i in range(160)] + [(500 + i, " ".join(w + "#" for w in prose(rng, 60 + i).split()), "en", "s", "", "") for i in range(30)]
    counts = quality.text_counts(spark.createDataFrame(rows, SCHEMA)).drop("text")
    counts = quality.materialize(counts, "t")
    vectors = quality.materialize(quality._vectors(counts), "v")
    x = np.array([[r[f"x{j}"] for j in range(quality.P)] for r in vectors.collect()], float)
    _, models = quality.fit(vectors)
    m = models.first()
    mean, factor, _ = brute_estimate(x)
    assert [m[f"m{j}"] for j in range(quality.P)] == pytest.approx(mean, rel=1e-9)
    assert [m[f"i{i}{j}"] for i in range(quality.P) for j in range(i + 1)] == pytest.approx([factor[i, j] for i in range(quality.P) for j in range(i + 1)], rel=1e-6, abs=1e-12)


# pipeline


def test_pipeline_runs_all_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(60, 200)), "en", f"s{i % 3}", "", "") for i in range(120)]
    rows += [(500, rows[0][1], "en", "s0", "", ""), (501, "too short", "en", "s0", "", ""), (502, None, None, None, "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {p.doc_id for r in out for p in r.pieces}
    assert ids <= set(range(120)) and len(ids) > 60
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)


def test_pipeline_stages_equal_brute_force(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = documents(13, 150)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}

    def keep(df, name):
        seen[name] = materialized(df, name)
        return seen[name]

    materialized = corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", keep)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    after = {name: collections.Counter(tuple(r) for r in df.collect()) for name, df in seen.items()}
    # The texts are drawn alike, so the base rules alone reject.
    good = [r for r in rows if not brute_counts(r[1])[-1]]
    assert after["quality_rules"] == collections.Counter(good)
    classes = collections.Counter()
    where = {}
    for n, ids in enumerate(brute_classes(good).values()):
        known = [i for i in ids if i is not None]
        classes[n] += 1
        where |= {i: n for i in ids}
    assert not after["near_dedup"] - collections.Counter(good)
    assert collections.Counter(where[r[0]] for r in after["near_dedup"].elements()) == classes
    report = {r.doc_id: r.taken // r.size for r in mixing.mix_report(seen["near_dedup"]).collect()}
    assert after["source_mix"] == collections.Counter({r: report[r[0]] for r in after["near_dedup"] if report[r[0]]})
    library = Tokenizer.from_file(PATH)
    size = collections.Counter()
    for r in out:
        for p in r.pieces:
            size[p.doc_id] += p.length
    want = collections.Counter()
    for r, n in after["source_mix"].items():
        want[r[0]] += n * (len(library.encode(r[1], add_special_tokens=False).ids) + 1)
    assert size == want
