"""Pages, archives and conversations against brute force, and on odd rows."""

import hashlib
import itertools
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.llm import chat_format, html_text, warc
from confab.llm.common import documents, new_path

# --- main text ------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="home">
<header><h2>Site name</h2></header><nav><ul><li><a href=x>Menu</a><li>More</ul></nav>
<div id="cookie-notice">We use cookies</div><div class='ad banner'>Buy <b>now</b></div>
<article class="post"><header><h1>A &amp; B&nbsp;title</h1></header><p>First<br>line of
  <i>text</i> &lt;x&gt; &#233;&#x41;<p>Second <a href="y>z">link</a></p><ul><li>one<li>two</ul>
<form><input name=q>Search</form><aside>Related</aside><!-- <p>gone</p> --><div class="comments"><p>Reader says</p></div></article>
<footer>Foot</footer></body></html>"""


def test_article_text():
    kept = [t for t, verdict in html_text.judged_blocks(PAGE) if verdict == "keep"]
    assert kept == ["A & B title", "First line of text <x> éA", "Second link", "one", "two"]


@pytest.mark.parametrize(
    "page, text",
    [
        (None, []), ("", []), ("plain words", ["plain words"]), ("<p>a<p>b", ["a", "b"]), ("<main><p>x</p></main><footer>f</footer>", ["x"]),
        ("<body><nav>m</nav><p>only</p></body>", ["only"]), ("<article><p>cut off", ["cut off"]), ("<article></article><p>rest</p>", ["rest"]),
        ("<article><p>a</p></article><article><p>b</p></article>", ["a", "b"]), ("<p>a</div>b<b>c", ["a", "bc"]), ("<article><noscript>n</noscript><textarea>t</textarea><p>k</p></article>", ["k"]),
    ],
)
def test_odd_pages(page, text):
    assert [t for t, verdict in html_text.judged_blocks(page) if verdict != "drop"] == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body class='single has-sidebar'><nav>m</nav><p>x</p></body>", ["x"]), ("<body class='sidebar'><main class='menu'><p>x</p></main></body>", ["x"]),
        ("<div class='content no-sidebar'><article class='post comments-open'><p>x</p></article></div>", ["x"]),
        ("<p>o</p><div class='social'><article><p>x</p><div class='comments'>c</div></article></div>", ["o", "x"]),
        ("<div class='sidebar'>s</div><article><p>x</p><div class='comments'>c</div></article>", ["x"]), ("<div class='widget'><p>x</p><div class='menu'>m</div></div>", ["x"]),
    ],
)
def test_class_words_empty_no_page(page, text):
    assert [t for t, verdict in html_text.judged_blocks(page) if verdict != "drop"] == text


def test_copies_of_a_page_are_no_evidence(spark):
    text = " ".join(f"w{i}" for i in range(40))
    pages = [(i, f"http://h.example/{i}", f"<p>{text}</p>") for i in range(5)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert [r.text for r in html_text.main_text(frame).collect()] == [text] * 5


def brute_lengths(tokens, pages, k, least):
    best = [0] * len(tokens)
    for n in range(least, len(tokens) + 1):
        found = defaultdict(set)
        for i in range(len(tokens) - n + 1):
            found[tuple(tokens[i : i + n])].add(pages[i])
        for i in range(len(tokens) - n + 1):
            best[i] = n if len(found[tuple(tokens[i : i + n])]) >= k else best[i]
    return best


@pytest.mark.parametrize("seed", range(12))
def test_shared_lengths_of_the_suffix_array(seed):
    rng = np.random.default_rng(seed)
    tokens, pages = [], []
    for k in range(int(rng.integers(1, 10))):
        own = rng.integers(0, rng.integers(1, 4), rng.integers(0, 20)).tolist()
        tokens += [*own, -1 - k]
        pages += [k] * (len(own) + 1)
    for least, k in itertools.product((1, 2, 3, 5, 8), (1, 2, 3, 5)):
        array, lcp = html_text.suffix_array(np.array(tokens), least)
        assert [tokens[i:] for i in array] == sorted(tokens[i:] for i in array)
        got = np.zeros(len(tokens), int)
        got[array] = html_text.shared_lengths(array, lcp, np.array(pages), k, least)
        want = brute_lengths(tokens, pages, k, least)
        assert k == 1 or got.tolist() == want


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html class='no-js menu-open'><p>x</p>", ["x"]), ("<div class='page-with-sidebar'><p>x</p></div>", ["x"]), ("<article><p class='market-share'>x</p></article>", ["x"]),
        ("<article data-class='menu'>x</article>", ["x"]), ("<p title=it's>First</p><p>Second isn't", ["First", "Second isn't"]), ("<article><p hidden>h</p><p style='display: none'>n</p>x</article>", ["x"]),
        (f"<article><p>{'long ' * 40}</p></article><article><h2><a href=x>Other</a></h2></article>", [("long " * 40).strip()]), ("<article>x<article>a comment</article></article>", ["x"]),
        ("<div><a>One</a></div><div><a>Two</a></div><div><a>Three</a></div><p>x <a>y</a></p>", ["x y"]), ("<div class='cookie-notice'>c</div><div id=main-menu>m</div><p>x</p>", ["x"]), ("a < b <3 </ > &lt;c", ["a < b <3 <c"]), ("<p>x</p><a href='", ["x"]), ("<p>x<!-- <p>y", ["x"]),
    ],
)
def test_markup_that_is_easily_misread(page, text):
    assert [t for t, verdict in html_text.judged_blocks(page) if verdict != "drop"] == text


@pytest.mark.parametrize("piece", ["<a b='c' ", "<a b='", "<!--", '<p title="', "<div></p>", "<", "<svg>", "</", "<script>", "<a   ", "&#x", "<li>x", "<div class=menu>"])
def test_a_megabyte_of_broken_markup(piece):
    began = time.process_time()
    html_text.judged_blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 10


@pytest.mark.parametrize(
    "page, text",
    [
        # an article in main is no comment, and what main holds beside it stays
        ("<main><h1>Title</h1><article><p>x</p></article></main>", ["Title", "x"]), ("<main><p>Lead</p><article><p>x</p></article></main><footer>f</footer>", ["Lead", "x"]),
        ("<main><article><header><h1>T</h1></header><p>x</p></article><div class='reader-comments'>c</div></main>", ["T", "x"]), ("<main><article><p>x</p><article>a comment</article></article></main>", ["x"]),
        ("<main><article><p>x</p></article><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></main>", ["x"]), ("<div role=main><p>x</p></div>", ["x"]),
        # a slash at the end of a value closes nothing, nor does any in HTML's elements
        ("<article><p>x</p><aside data-u=/a/>Ad</aside><p>y</p></article>", ["x", "y"]), ("<nav data-x=/top/>Menu</nav><p>x</p>", ["x"]), ("<p>x</p><script src=/js/app/>var code;</script><p>y</p>", ["x", "y"]),
        ("<nav/>Menu</nav><p>x</p>", ["x"]), ("<article><p/>x<svg/><p>y</p></article>", ["x", "y"]), ("<article><svg><path d='M0'/><text>no</text></svg><p>x</p></article>", ["x"]),
        # a short article is an article
        (f"<article><p>{'long ' * 40}</p></article><article><p>short</p></article>", [("long " * 40).strip(), "short"]),
        # names of furniture with numbers, humps and layout, and names of an article's own parts
        *((f"<article><p>x</p><div class='{c}'>no</div></article>", ["x"]) for c in ("comment-body", "reader-comments", "user-reviews", "ad-slot-top-728x90", "adslot", "sticky-ad-unit", "promo-code-list", "newsletter-box-2", "relatedPosts", "cookieConsent", "x share-buttons")),
        *((f"<article><p>x</p><div {a}>yes</div></article>", ["x", "yes"]) for a in ("id='notice'", "class='article-form'", "class='market-share'", "id='related'", "class='formula'", "class='adventure'", "class='header'")),
        # links alone are the text of a page of links
        ("<div><a>One</a></div><div><a>Two</a></div><div><a>Three</a></div>", ["One", "Two", "Three"]),
    ],
)
def test_layouts_and_names(page, text):
    assert [t for t, verdict in html_text.judged_blocks(page) if verdict != "drop"] == text


class Plain:
    """What a page's reader sees, by the library's own parser, outside elements that are no text."""

    def __new__(cls, page, skip=("nav", "footer", "aside", "form", "script", "style", "title")):
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            out, depth, parts = (), 0, None

            def handle_starttag(self, tag, attrs):
                self.depth += tag in skip
                self.cut(tag)

            def handle_endtag(self, tag):
                self.cut(tag)
                self.depth -= tag in skip

            def handle_data(self, data):
                if not self.depth:
                    self.parts = [*(self.parts or []), data]

            def cut(self, tag):
                if tag in ("p", "div", "h1", "main", "article", "section", "li", "ul", *skip):
                    words = "".join(self.parts or []).split()
                    self.out = (*self.out, " ".join(words)) if words else self.out
                    self.parts = None

        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.cut("p")
        return reader.out


def test_a_table_of_main_layouts(spark):
    """Pages with a title and lead beside the article and template lines in main and body: the array
    takes the lines, and what is left is what a plain parser finds less the lines."""
    rng = random.Random(8)
    lines = [words_of(rng, 10) for _ in range(3)]
    rows, want = [], {}
    for i in range(45):
        own = [words_of(rng, rng.randint(3, 25)) for _ in range(4)]
        article = f"<article><p>{own[2]}</p><p>{own[3]} <a href=/x/>{own[0]}</a></p></article>"
        page = (
            f"<body><nav>menu {i}</nav><main><h1>{own[0]}</h1><p>{own[1]}</p>{article}<div>{lines[0]}</div><div>{lines[1]} {i}</div></main><footer>foot {i}</footer>",
            f"<body><script src=/a/>x</script><main><div>{lines[0]}</div><p>{own[1]}</p>{article}</main><aside data-u=/x/>ad {i}</aside>",
            f"<body><div>{lines[2]}</div><p>{own[0]}</p><p>{own[1]}</p><p>{own[2]}</p><div>{lines[1]}</div><form>name</form>",
        )[i % 3]
        rows.append((i, f"http://h.example/{i}", page))
        want[i] = [t for t in Plain(page) if not any(x in t for x in lines)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(frame).collect()}
    assert {i: r.text.split("\n\n") for i, r in got.items()} == want
    assert {i: r.n_boilerplate for i, r in got.items()} == {i: (2, 1, 2)[i % 3] for i in range(45)}


def words_of(rng, k):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(k))


@pytest.mark.parametrize("chunk", [1_000_000, 60])
def test_a_template_inside_articles_goes_and_quotes_stay(spark, chunk):
    rng = random.Random(5)
    line, quote = words_of(rng, 12), words_of(rng, 30)
    own = [words_of(rng, 40) for _ in range(30)]
    body = lambda i: f"<article><p>{own[i]}</p>{f'<p>{quote}</p>' if i < 8 else ''}<div>{line}</div></article><div>{line}</div>"
    frame = spark.createDataFrame([(i, "http://h.example/", body(i)) for i in range(30)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(frame, chunk_tokens=chunk).collect()}
    for i in range(30):
        assert got[i].text == own[i] + (f"\n\n{quote}" if i < 8 else "")
        assert (got[i].n_blocks, got[i].n_boilerplate) == (1 + (i < 8), 1)


@pytest.mark.parametrize("chunk, bound", [(1_000_000, 1_000_000), (40, 1_000_000), (40, 0)])
def test_boilerplate_of_a_host(spark, chunk, bound):
    """Pages without an article: text that a host repeats goes, however its stream is cut."""
    rng = random.Random(2)
    words = lambda k: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(k))
    top, bottom = words(12), words(9)
    own = [words(20) for _ in range(6)]
    pages = [(i, f"http://h.example/{i}", f"<div>{top}</div><p>{own[i]}</p><div>{bottom} {i}</div>") for i in range(6)]
    pages += [(9, "http://other.example/", f"<div>{top}</div><p>{own[0]}</p>"), (9, "http://other.example/", f"<div>{top}</div><p>{own[0]}</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in html_text.main_text(frame, chunk_tokens=chunk, max_broadcast=bound).collect()]
    assert sorted(got) == sorted([(i, own[i]) for i in range(6)] + [(9, f"{top}\n\n{own[0]}")] * 2)


def test_pages_on_odd_rows(spark):
    rows = [(1, None, None), (None, "x", "<p>a</p>"), (2, "u", ""), (1, None, None)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.main_text(frame).collect()) == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_whole_table_of_pages(spark, sf_dir):
    """The table's pages have one article each; its paragraphs are found by plain splitting."""
    import html
    import re

    for r in html_text.main_text(documents(spark, sf_dir, "pages")).join(documents(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article[^>]*>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h\d|ul|ol|li|div|blockquote|pre|table|tr|td)\b[^>]*>", body)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br[^>]*>", " ", p))).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in want if p) and r.n_chars == len(r.text)


# --- archives -------------------------------------------------------------------------


def test_archive_round_trip(spark, sf_dir):
    pages = documents(spark, sf_dir, "pages")
    path = new_path(spark, "warc-test")
    manifest = warc.write_archives(pages, path, file_bytes=20_000)
    records = warc.read_records(spark, path, manifest, with_body=True)
    assert manifest.count() > 1 and records.count() == 3 * pages.count()
    captures = {r.page_id: r for r in warc.assemble(records).collect()}
    for r in pages.collect():
        c = captures[r.page_id]
        assert c.response.uri == r.url and bytes(c.request.body).startswith(f"GET {r.url} ".encode())
        if c.response.kind == "response":
            assert bytes(c.response.body) == (r.html or "").encode() and c.response.digest == hashlib.sha256((r.html or "").encode()).hexdigest()


def test_revisits_on_odd_rows(spark):
    big = "x" * 100
    rows = [(3, "u", big), (1, "u\r\nX: y", big), (1, "u", big), (7, None, big), (None, "n", "é" * 50), (5, "a", None), (6, "a", ""), (4, "s", "short"), (2, "s", "short"), (8, "s", "é" * 50)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.capture_digest(frame).collect())
    want = [(3, 100, "revisit", 1), (1, 100, "response", None), (1, 100, "response", None), (7, 100, "revisit", 1), (None, 100, "revisit", 8), (5, 0, "response", None), (6, 0, "response", None), (4, 5, "response", None), (2, 5, "response", None), (8, 100, "response", None)]
    assert got == Counter(want)
    assert got == Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.capture_digest(frame, max_broadcast=-1).collect())
    assert warc.capture_digest(frame.limit(0)).count() == 0


# --- conversations --------------------------------------------------------------------


def brute_repair(turns):
    """Least cost over all roles of all turns, by trying them all."""
    best = None
    for roles in itertools.product(range(3), repeat=len(turns)):
        state, cost = chat_format.START, 0
        for role, t in zip(roles, turns):
            if (state, role) not in chat_format.STEPS:
                cost = None
                break
            cost += chat_format.STEPS[state, role][0] * chat_format._SCALE + t[role]
            state = role + 1
        if cost is not None:
            cost += chat_format.final_cost(state)
            best = min(best, (cost, roles)) if best else (cost, roles)
    return [r + 1 for r in best[1]]


@pytest.mark.parametrize("seed", range(30))
def test_repair_is_of_least_cost(seed):
    rng = random.Random(seed)
    rows = [(1, k, rng.choice(["user", "assistant", "system", "bot", "??", None]), str(rng.random())) for k in range(rng.randrange(1, 8))]
    turns = [chat_format.turn_costs(*r) for r in rows]
    want = brute_repair(turns)
    assert chat_format.solve(turns, chat_format.START) == want
    # pieces with their matrices give what the whole gives
    cuts = sorted({0, len(turns), *(rng.randrange(len(turns) + 1) for _ in range(2))})
    pieces = [turns[a:b] for a, b in zip(cuts, cuts[1:])]
    ways = chat_format.chain([chat_format.matrix(p) for p in pieces])
    assert [s for p, (entry, leave) in zip(pieces, ways) for s in chat_format.solve(p, entry, leave)] == want


def rendered(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.conv_id].append((r.pos, r.fragment))
    return {c: "".join(f for _, f in sorted(x)) for c, x in out.items()}


def test_rendered_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "assistant", "late"), (3, 0, "user", "a"), (3, 1, "user", "b"), (3, 2, "gpt", "c <|im_end|>"),
        (4, 0, "system", "only"), (5, 0, None, None), (None, 0, "user", "x"), (None, 0, "user", "x"),
    ]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    got = chat_format.format_chats(frame).collect()
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert rendered(got) == {
        1: turn("user", "hi") + turn("assistant", "hello"), 2: turn("user", "") + turn("assistant", "late"), 3: turn("user", "a\n\nb") + turn("assistant", "c <| im_end|>"),
        4: turn("system", "only") + turn("user", ""), 5: turn("user", ""), None: turn("user", "x\n\nx"),
    }
    assert sum(r.action != "insert" for r in got) == len(rows)
    for size in (1, 1_000_000):
        parts = defaultdict(str)
        for r in sorted(chat_format.render_chats(frame, part_chars=size).collect(), key=lambda r: (r.conv_id or 0, r.pos)):
            parts[r.conv_id] += r.text
        assert parts == rendered(got)
    assert chat_format.format_chats(frame.limit(0)).count() == 0 and chat_format.render_chats(frame.limit(0)).count() == 0


def test_long_conversations_over_partitions(spark):
    rng = random.Random(9)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "user", "x"]), f"{c}-{k}") for c, n in ((1, 700), (2, 3), (3, 400)) for k in range(n)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = chat_format.format_chats(frame.repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        states = chat_format.solve([chat_format.turn_costs(*r) for r in own], chat_format.START)
        want = chat_format.render(own, chat_format.START, states, True, 0)
        assert sorted(tuple(r)[:7] for r in got if r.conv_id == conv) == sorted(want) or [tuple(r) for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.pos)] == want


def test_every_conversation_of_the_table(spark, sf_dir):
    turns = documents(spark, sf_dir, "conversations")
    got = chat_format.format_chats(turns).collect()
    assert sum(r.action != "insert" for r in got) == turns.count()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(len(rows)))
        roles = [k for k, _ in itertools.groupby(r.role for r in rows)]
        roles = roles[1:] if roles[0] == "system" else roles
        assert all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))
    assert {r.conv_id for r in turns.select("conv_id").where(F.col("conv_id").isNotNull()).collect()} <= set(by)
