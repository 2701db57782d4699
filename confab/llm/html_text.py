"""Main text of web pages, by a suffix array over each host's pages, and markup.

Markup: a page is read by the states of the HTML tokenizer and cut into blocks, each inside
or outside an article (or, on pages without one, the main element), and each in page
furniture or not. Elements, roles and hidden ones tell for sure: menus, headers, footers,
asides, forms. A class or id only hints: a name hints if one of its words is a word of
furniture and all others are such words, words of layout or numbers (cookie-notice, reader-comments,
ad-slot-top-728x90; not market-share or has-sidebar); words that an article may use for its own
parts (notice, share, search) hint by class alone there. An article within an article is a
reader's comment or a teaser, which hints too; an article within main is not. Hints never
leave a page without text: the blocks under the fewest of them stay. Of several articles
those whose text is all in links are teasers.

Suffix array: the words of all blocks, each page ended by a mark of its own, are
concatenated per host; suffixes are sorted by prefix doubling, and from the lengths that
neighbours share follows, for every position, the longest substring that starts there and
stands on at least so many distinct pages. A block is repeated if such substrings of
``min_tokens`` words or more cover at least ``cover`` of its words. What markup leaves open
(pages without article or main; what main holds beside an article) goes if it is repeated on ``min_pages``
pages and ``min_share`` of the host's, or, beside other text, stands in a run of three or more blocks
that are links alone.
What an article holds goes only if it is repeated on ``article_share`` of the host's pages,
``article_pages`` at least, and if such blocks are less than half of the article: so a
template's lines go, and quoted or copied passages stay. Pages of a host with equal words are
one page, whatever their ids.

A host of more than ``chunk_tokens`` words is dealt to chunks by pages. What stands on a
share of the host's pages stands on that share of the pages of one chunk at least, so each
chunk names its substrings of ``min_tokens`` words that do; these few are then counted over
all the host's pages, and the covered words follow from them: the same words that one array
would give, as a longer repeat is covered by its shorter ones. So no task holds a host.

Edge cases: null html is empty; its text is empty. Repeated pages, under one id or many,
count once as evidence, and each has its own row. Unclosed, misnested or cut-off markup is
read to the end in linear time; a tag cut off by the page's end is no text. Null urls are
one host. Near copies of a page on one host are evidence each. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_schema, materialize, slices, spread_join, table

# HTML element names by role.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption".split())
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "svg", "object", "canvas", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
#: Words that mark page furniture in class or id names.
MARKS = set("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr popup modal overlay newsletter newsletters subscribe subscription signup login sharing social trending comments commentlist commenters disqus adslot adunit replies widget widgets toolbar pagination pager copyright skip teaser teasers".split())
#: Words that mark furniture too, but that an article may use as the name of a part of it.
SOFT = set("notice notices search share related recommended recommendations comment respond reply reviews disclaimer".split())
#: Words that mark furniture outside an article, but may head one.
HEADS = {"header", "head", "top"}
#: Words of layout, which say nothing but may stand beside a mark.
LAYOUT = set("top reader readers user users customer visitor body sticky fixed code id div sm md lg xl x site page main global left right upper lower bottom box block wrapper wrap container area list section slot unit bar panel item items link links button buttons btn inner outer group row col column content primary secondary post posts article articles text more icons follow us policy module region zone".split())
#: Elements that class or id never mark.
WHOLE = {"html", "body", "main"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SKIP, _ATTR, _EQUALS, _BARE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def tag_end(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of the tag whose name ends at ``at``, where it ends (-1 if the page ends in it), and
    whether a slash that is no part of a value stands before its end."""
    attrs: dict[str, str] = {}
    if page[at : at + 1] == ">":
        return attrs, at + 1, False
    while True:
        skipped = _SKIP.match(page, at)
        at = skipped.end()
        if at >= len(page):
            return attrs, -1, False
        if page[at] == ">":
            return attrs, at + 1, skipped[0].endswith("/")
        m = _ATTR.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        if m := _EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                close = page.find(quote, at + 1)
                if close < 0:
                    return attrs, -1, False
                value, at = page[at + 1 : close], close + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        attrs.setdefault(name, value)


def marked(token: str, marks: set[str]) -> bool:
    """Whether a class or id is made of furniture's words, one at least, and words of layout."""
    words = set(_WORDS.findall(token.lower()))
    if not words & marks:
        words = set(_WORDS.findall(_HUMPS.sub("-", token).lower()))
    return bool(words & marks) and words <= marks | LAYOUT


def furniture(name: str, attrs: dict[str, str], in_body: bool, in_article: bool) -> str:
    """sure, by element, role or hiding; hint, by class or id; or nothing. ``in_body`` is inside an article or main."""
    if name in FURNITURE or name == "header" and not in_body:
        return "sure"
    nested = "hint" if name == "article" and in_article else ""
    if not attrs:
        return nested
    if "hidden" in attrs or _HIDDEN.search(attrs.get("style", "")):
        return "sure" if name not in WHOLE else ""
    if set(_WORDS.findall(attrs.get("role", "").lower())) & ROLES and name not in WHOLE:
        return "sure"
    if name in WHOLE:
        return ""
    marks = MARKS | SOFT if in_body else MARKS | SOFT | HEADS
    if any(marked(token, marks) for token in attrs.get("class", "").split()):
        return "hint"
    return "hint" if any(marked(token, MARKS if in_body else marks) for token in attrs.get("id", "").split()) else nested


def blocks(page: str) -> list[tuple[str, str, int, int, int, float]]:
    """(text, place, article, sure, hints, linked) of each block with text: place is article,
    main or other, article the number of the outermost article, sure and hints the furniture
    around it, linked the share of its text in links."""
    out: list[tuple] = []
    stack: list[tuple[str, str]] = []  # block elements, and inline ones that are furniture
    depth: Counter = Counter()  # how often each name is in the stack
    text: list[str] = []
    article = mains = sure = hints = linked = 0
    link = False

    def say(piece: str):
        nonlocal linked
        if "&" in piece:
            piece = html.unescape(piece)
        text.append(piece)
        if link:
            linked += len("".join(piece.split()))

    def flush():
        nonlocal linked
        words = "".join(text).split()
        text.clear()
        if words:
            place = "article" if depth["article"] else "main" if mains else "other"
            out.append((" ".join(words), place, article if depth["article"] else 0, sure, hints, linked / sum(map(len, words))))
        linked = 0

    def pop():
        nonlocal mains, sure, hints
        name, flag = stack.pop()
        depth[name] -= 1
        mains -= name == "main"
        sure -= flag == "sure"
        hints -= flag == "hint"

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        after = page[start + 1 : start + 2]
        if after in ("!", "?") and after:
            close = page.find("-->", start + 2) if page.startswith("<!--", start) else page.find(">", start)
            at = end if close < 0 else close + (3 if page.startswith("<!--", start) else 1)
            continue
        closing = after == "/"
        m = _NAME.match(page, start + 1 + closing)
        if m is None:
            if closing:
                close = page.find(">", start)
                at = end if close < 0 else close + 1
            else:
                say("<")
                at = start + 1
            continue
        name = m[0].lower()
        attrs, at, slash = tag_end(page, m.end())
        if at < 0:
            break
        # HTML's own elements do not close themselves
        whole = slash and not closing and (name in ("svg", "math") or depth["svg"] > 0)
        if name in RAW:
            if not closing and not whole:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = page.find(">", close.end()) + 1 or end if close else end
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            link = not closing and not whole
        block = name in BLOCK
        if block:
            flush()
        if name in VOID:
            continue
        if closing:
            if depth[name]:
                flush()
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if stack and (block and stack[-1][0] == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name):
            pop()
        flag = furniture(name, attrs, depth["article"] + mains > 0, depth["article"] > 0)
        if flag:
            flush()
        if (block or flag) and not whole:
            article += name == "article" and not depth["article"]
            stack.append((name, flag))
            depth[name] += 1
            mains += name == "main"
            sure += flag == "sure"
            hints += flag == "hint"
    flush()
    return out


def judged_blocks(page: str | None) -> list[tuple[str, str]]:
    """(text, verdict) of each block: keep, drop, or open where markup does not tell."""
    found = blocks(page or "")
    least: dict[str, int] = {}  # the fewest hints around a block of each place that is surely no furniture
    weight: Counter = Counter()  # characters outside links of each article
    for text, place, article, sure, hints, linked in found:
        if not sure:
            least[place] = min(hints, least.get(place, hints))
            weight[article] += (place == "article") * len(text) * (1 - linked)
    said = any(w > 0 for k, w in weight.items() if k)
    body = next((p for p in ("article", "main") if least.get(p) == 0), None) or next((p for p in ("article", "main") if p in least), None)
    few = min((least[p] for p in (body,) if p in least), default=0)
    # what main holds beside an article may be its title or lead; where even the article's own
    # blocks have hints, the rest of the page may be the text
    rest = {"main": few, "article": few, "other": least.get("other", 0) if body is None else 0 if few else -1}
    out = []
    for text, place, article, sure, hints, linked in found:
        if sure:
            verdict = "drop"
        elif place == body and hints <= few:
            verdict = "keep" if not article or weight[article] > 0 or not said else "drop"
        else:
            verdict = "open" if hints <= rest[place] and place != body else "drop"
        out.append((text, verdict))
    # runs of open blocks that are links alone
    lone = [v == "open" and x[5] > 0.99 for x, (_, v) in zip(found, out, strict=True)]
    if any(v != "drop" and not alone for (_, v), alone in zip(out, lone, strict=True)):
        run = 0
        for k, alone in enumerate([*lone, False]):
            if not alone and run >= 3:
                out[k - run : k] = [(t, "drop") for t, _ in out[k - run : k]]
            run = run + 1 if alone else 0
    return out


# --- suffix array ---------------------------------------------------------------------


def suffix_array(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share ``least`` tokens with another one, sorted, and how many tokens
    each shares with the one before it.

    Prefix doubling: a rank is the number of suffixes that are smaller by their first tokens,
    and each round ranks those that still tie by twice as many. Suffixes that no longer tie
    drop out, so text without repeats costs log2(least) rounds. All rounds' ranks are kept, as
    equal ranks tell equal substrings: shared lengths are read off from the longest round down."""
    n = len(tokens)
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    levels, width, live, found = [rank.astype(np.int32)], 1, np.flatnonzero(counts[inverse] > 1), None
    while len(live):
        if found is None and 2 * width > least:
            found = live
        after = np.where(live + width < n, rank[np.minimum(live + width, n - 1)], -1)
        order = np.lexsort((after, rank[live]))
        r, a = rank[live][order], after[order]
        at = np.arange(len(r))
        fresh = np.concatenate(([True], r[1:] != r[:-1]))
        head = fresh | np.concatenate(([True], a[1:] != a[:-1]))
        new = r + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[live[order]] = new
        levels.append(rank.astype(np.int32))
        width *= 2
        alone = head & np.concatenate((head[1:], [True]))
        live = np.sort(live[order[~alone]])
    if found is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    array = found[np.argsort(rank[found])]
    left, right, lcp = array[:-1], array[1:], np.zeros(max(0, len(array) - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = left + lcp, right + lcp
        ok = (i < n) & (j < n)
        same = ok & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        lcp += same * (1 << k)
    return array, np.concatenate((np.zeros(min(1, len(array)), np.int64), lcp))


def shared_lengths(array: np.ndarray, lcp: np.ndarray, pages: np.ndarray, k: int, least: int) -> np.ndarray:
    """For each suffix of the array the longest prefix that ``k`` distinct pages share, 0 if under ``least``.

    The smallest windows of the array with ``k`` pages are found with two ends that only move
    on; a window shares the least length within it. A suffix has the best of the windows it is
    in, or what it shares with a neighbour that has more."""
    n, page, common = len(array), pages[array].tolist(), lcp.tolist()
    windows: list[tuple[int, int, int]] = []
    low: deque = deque()  # places of the window's least lengths, increasing
    seen: Counter = Counter()
    start = distinct = 0
    for end in range(n):
        if common[end] < least:
            start, distinct = end, 0
            seen.clear()
            low.clear()
        else:
            while low and common[low[-1]] >= common[end]:
                low.pop()
            low.append(end)
        distinct += not seen[page[end]]
        seen[page[end]] += 1
        while distinct >= k:
            while low and low[0] <= start:
                low.popleft()
            if not low:  # one page is enough
                break
            windows.append((start, end, common[low[0]]))
            seen[page[start]] -= 1
            distinct -= not seen[page[start]]
            start += 1
    out, best, at = [0] * n, deque(), 0
    for s in range(n):
        while at < len(windows) and windows[at][0] <= s:
            while best and best[-1][2] <= windows[at][2]:
                best.pop()
            best.append(windows[at])
            at += 1
        while best and best[0][1] < s:
            best.popleft()
        out[s] = max(best[0][2] if best else 0, min(out[s - 1], common[s]) if s else 0)
    for s in range(n - 2, -1, -1):
        out[s] = max(out[s], min(out[s + 1], common[s + 1]))
    return np.where(np.array(out) >= least, out, 0).astype(np.int64)


def covered_tokens(array: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` positions is inside a substring."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, array, lengths > 0)
    np.add.at(steps, array + lengths, -(lengths > 0).astype(np.int64))
    return np.cumsum(steps)[:-1] > 0


def covered_blocks(owner: np.ndarray, hit: np.ndarray, cover: float) -> list[int]:
    """The blocks, numbered from 0 in ``owner``, that are covered."""
    if not hit.any():
        return []
    return np.flatnonzero(np.bincount(owner, hit) >= cover * np.maximum(np.bincount(owner), 1)).tolist()


_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` tokens from each position that has so many."""
    own = tokens.astype(np.int64).view(np.uint64)
    out = np.zeros(max(0, len(own) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ own[k : k + len(out)]) * _MIX
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


# --- pages ----------------------------------------------------------------------------


def with_host(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def content_of(found: list[tuple[str, str]]) -> bytes:
    digest = xxhash.xxh3_128()
    for text, _ in found:
        digest.update(text.lower().encode("utf-8", "replace") + b"\n")
    return digest.digest()


STREAM = "host string, n long, content binary, copies long, tokens array<int>, sizes array<int>, open array<int>"
EVIDENCE = "host string, content binary, copies long, repeated array<int>, common array<int>, gram long"
COVERS = "host string, content binary, copies long, repeated array<int>, common array<int>"


class WordHashes(dict):
    """31-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word) >> 1
        return h


def list_values(column: pa.ListArray):
    """The lists of a column as numpy arrays; nulls are empty."""
    values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for a, b, ok in zip(edges[:-1], edges[1:], valid, strict=True):
        yield values[a : b if ok else a]


def host_streams(placed: DataFrame) -> DataFrame:
    """Of pages (host, n, html): content (a hash of the page's words), how many copies of it the
    task has met, the hashes of its words, how many each block has, and which blocks are open. A
    task passes a content on once."""
    schema = ddl_schema(STREAM)

    def scan(batches):
        copies: Counter = Counter()
        known = WordHashes()
        for part in slices(batches):
            rows = []
            for host, n, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found = judged_blocks(page)
                content = content_of(found)
                copies[host, n, content] += 1
                if copies[host, n, content] == 1:
                    words = [text.lower().split() for text, _ in found]
                    rows.append((host, n, content, 1, [known[w] for x in words for w in x], list(map(len, words)), [k for k, (_, v) in enumerate(found) if v == "open"]))
            yield table(schema, zip(*rows, strict=True) if rows else [[]] * 7)
        more = [(*key, c - 1) for key, c in copies.items() if c > 1]
        for at in range(0, len(more), 4096):
            some = list(zip(*more[at : at + 4096], strict=True))
            yield table(schema, [*some, *[[None] * len(some[0])] * 3])

    return placed.select("host", "n", "html").mapInArrow(scan, STREAM)


def verdict_rows(host, content, copies, sizes, open_, hit, often, cover) -> list[tuple]:
    """The row of a page if the array has a say on it: its open blocks that are repeated, and its other blocks that are common."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    repeated = sorted(set(covered_blocks(owner, hit, cover)) & set(open_))
    common = sorted(set(covered_blocks(owner, often, cover)) - set(open_))
    return [(host, content, copies, repeated, common)] if repeated or common else []


def host_grams(host: str, tokens, n: int) -> np.ndarray:
    return gram_hashes(np.asarray(tokens, np.int64), n) ^ np.int64(xxhash.xxh64_intdigest(host) - (1 << 63))


class Limits:
    """How many of a host's pages must share what is boilerplate: (for open blocks, for an article's)."""

    def __init__(self, min_pages: int, min_share: float, article_pages: int, article_share: float):
        self.rules = ((min_pages, min_share), (article_pages, article_share))

    def of(self, pages: int) -> tuple[int, int]:
        return tuple(max(least, int(np.ceil(share * pages))) for least, share in self.rules)

    def columns(self, pages):
        return [F.greatest(F.lit(least), F.ceil(F.lit(share) * pages)) for least, share in self.rules]


def repeats(pages: DataFrame, min_tokens: int = 8, min_pages: int = 3, min_share: float = 0.002, article_pages: int = 10, article_share: float = 0.5, chunk_tokens: int = 2_000_000, cover: float = 0.5, max_broadcast: int = 1_000_000) -> DataFrame:
    """(host, content, copies, repeated, common): of pages (host, html) the open blocks that are
    repeated, and the other blocks that are common, each content once; only pages that have any."""
    limits = Limits(min_pages, min_share, article_pages, article_share)
    hosts = pages.groupBy("host").agg(F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("chars"))
    # a token and its markup are about 8 characters
    large = materialize(hosts.where(F.col("chars") > 8 * chunk_tokens).select("host", F.ceil(F.col("chars") / (8 * chunk_tokens)).cast("long").alias("n")), "html-large")
    several = not large.isEmpty()
    few = large.count() <= max_broadcast // 10
    placed = pages.join(F.broadcast(large) if few else large, "host", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    streams = host_streams(placed.where("n = 1")).withColumn("chunk", F.lit(0).cast("long"))
    if several:
        # read more than once below
        sums = [F.sum("copies").alias("copies"), *[F.max(c).alias(c) for c in ("tokens", "sizes", "open")]]
        own = materialize(host_streams(placed.where("n > 1")).groupBy("host", "n", "content").agg(*sums), "html-streams")
        streams = streams.unionByName(own.withColumn("chunk", F.pmod(F.xxhash64("content"), F.col("n"))))
    schema = ddl_schema(EVIDENCE)

    def evidence(host, n, own):
        """Rows of one chunk from its contents: [content, copies, tokens, sizes, open]."""
        if n > 1:
            grams = [np.unique(host_grams(host, x[2], min_tokens)) for x in own]
            values, pages_of = np.unique(np.concatenate(grams), return_counts=True)
            share = min(min_share, article_share)
            yield host, None, len(own), None, None, None
            for g in values[pages_of >= share * len(own)].tolist():
                yield host, None, None, None, None, g
            return
        # each page ends with a mark of its own, so that no substring runs over pages
        stream = np.concatenate([np.append(np.asarray(x[2], np.int64), -1 - k) for k, x in enumerate(own)])
        lengths = np.array([len(x[2]) for x in own])
        page = np.repeat(np.arange(len(own)), lengths + 1)
        array, lcp = suffix_array(stream, min_tokens)
        hit, often = (covered_tokens(array, shared_lengths(array, lcp, page, k, min_tokens), len(stream)) for k in limits.of(len(own)))
        for (content, copies, _, sizes, open_), size, end in zip(own, lengths, np.cumsum(lengths + 1), strict=True):
            at = slice(end - 1 - size, end - 1)
            for row in verdict_rows(host, content, copies, sizes, open_, hit[at], often[at], cover):
                yield *row, None

    def arrays(batches):
        at, own, ready = None, [], []
        for part in slices(batches):
            cells = [list_values(c) if k == 4 else c.to_pylist() for k, c in enumerate(part.columns)]
            for host, n, content, copies, tokens, sizes, open_, chunk in zip(*cells, strict=True):
                if at is not None and at != (host, n, chunk):
                    ready += evidence(*at[:2], own)
                    own = []
                at = (host, n, chunk)
                if own and own[-1][0] == content:
                    own[-1][1] += copies
                    if sizes is not None:
                        own[-1][2:] = [tokens.copy(), sizes, open_]
                else:
                    own.append([content, copies, tokens.copy(), sizes or [], open_ or []])
                if len(ready) > 4096:
                    yield table(schema, zip(*ready, strict=True))
                    ready = []
        if own:
            ready += evidence(*at[:2], own)
        if ready:
            yield table(schema, zip(*ready, strict=True))

    sorted_ = streams.repartition("host", "chunk").sortWithinPartitions("host", "n", "chunk", "content")
    found = materialize(sorted_.mapInArrow(arrays, EVIDENCE), "html-evidence")
    whole = found.where("content is not null").select("host", "content", "copies", "repeated", "common")
    if not several:
        return whole
    # hosts of several chunks: the pages of what a chunk named are counted over all chunks
    named = materialize(found.where("gram is not null").select("gram", F.lit(True).alias("hit"), F.lit(False).alias("often")).distinct(), "html-named")
    totals = found.where("content is null and gram is null").groupBy("host").agg(F.sum("copies").alias("pages"))
    counts = _positions(own, named, min_tokens, max_broadcast).select("host", F.explode(F.array_distinct("grams")).alias("gram")).groupBy("host", "gram").agg(F.count("*").alias("k")).join(totals, "host")
    for_open, for_article = limits.columns(F.col("pages"))
    known = materialize(counts.select("gram", (F.col("k") >= for_open).alias("hit"), (F.col("k") >= for_article).alias("often")).where("hit or often"), "html-known")
    out = ddl_schema(COVERS)

    def covers(batches):
        for part in slices(batches):
            rows = []
            for host, content, copies, sizes, open_, hit, often in zip(*(c.to_pylist() for c in part.columns), strict=True):
                hits = (covered_tokens(np.asarray(x, np.int64), np.full(len(x), min_tokens), sum(sizes)) for x in (hit, often))
                rows += verdict_rows(host, content, copies, sizes, open_, *hits, cover)
            if rows:
                yield table(out, zip(*rows, strict=True))

    return whole.unionByName(_positions(own, known, min_tokens, max_broadcast).drop("grams").mapInArrow(covers, COVERS))


def _positions(streams: DataFrame, grams: DataFrame, n: int, max_broadcast: int) -> DataFrame:
    """Streams with the positions of their substrings of ``n`` words that are in ``grams`` (gram,
    hit, often), of those marked hit and of those marked often, and the hashes of them all; streams
    without any are left out. Up to ``max_broadcast`` hashes are sent to the tasks, more are joined."""
    names = ["host", "content", "copies", "sizes", "open"]
    ddl = "host string, content binary, copies long, sizes array<int>, open array<int>, hit array<int>, often array<int>, grams array<long>"
    schema = ddl_schema(ddl)
    few = grams.count() <= max_broadcast
    wanted = None
    if few:
        rows = sorted((r.gram, r.hit, r.often) for r in grams.collect())
        wanted = streams.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), *(np.array([r[k] for r in rows], bool) for k in (1, 2))))

    def find(batches):
        for part in slices(batches):
            rows = []
            cells = [list_values(c) if k == 5 else c.to_pylist() for k, c in enumerate(part.columns)]
            for *facts, tokens in zip(*cells, strict=True):
                got = host_grams(facts[0], tokens, n)
                if wanted is None:
                    rows.append((*facts, range(len(got)), [], got.tolist()))
                    continue
                known, hit, often = wanted.value
                if len(known) and len(got):
                    k = np.minimum(np.searchsorted(known, got), len(known) - 1)
                    at = np.flatnonzero(known[k] == got)
                    if len(at):
                        rows.append((*facts, at[hit[k[at]]].tolist(), at[often[k[at]]].tolist(), got[at].tolist()))
            if rows:
                yield table(schema, zip(*rows, strict=True))

    found = streams.select(*names, "tokens").mapInArrow(find, ddl)
    if few:
        return found
    each = found.select("host", "content", F.explode(F.arrays_zip("hit", "grams")).alias("x")).select("host", "content", F.col("x.hit").alias("at"), F.col("x.grams").alias("gram"))
    kept = each.join(grams, "gram").groupBy("host", "content").agg(F.collect_list(F.when(F.col("hit"), F.col("at"))).alias("hit"), F.collect_list(F.when(F.col("often"), F.col("at"))).alias("often"), F.collect_list("gram").alias("grams"))
    return streams.select(*names).join(kept, ["host", "content"])


def main_text(pages: DataFrame, **settings) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_blocks (kept) and n_boilerplate (blocks that
    markup would have kept and the suffix array took)."""
    pages = with_host(pages)
    covered = materialize(repeats(pages, **settings), "html-covered")
    ddl = "page_id long, url string, host string, content binary, texts array<string>, verdicts array<string>"
    schema = ddl_schema(ddl)

    def extract(batches):
        for part in slices(batches):
            rows = []
            for page_id, url, page, host in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found = judged_blocks(page)
                rows.append((page_id, url, host, content_of(found), [t if v != "drop" else "" for t, v in found], [v for _, v in found]))
            yield table(schema, zip(*rows, strict=True))

    both = spread_join(pages.mapInArrow(extract, ddl), covered, ["host", "content"], "copies", "page_id")
    none = F.array().cast("array<int>")
    at = lambda i, name: F.array_contains(F.coalesce(name, none), i)
    words = lambda keep: F.aggregate(F.transform("texts", lambda t, i: F.when(keep(i), F.length(t)).otherwise(0)), F.lit(0), lambda a, b: a + b)
    verdict = lambda i: F.get("verdicts", i)
    kept = lambda i: verdict(i) == "keep"
    # a template is less than half of an article
    some = F.col("common").isNotNull() & (2 * words(lambda i: kept(i) & at(i, "common")) < words(kept))
    both = both.withColumn("some", some)
    gone = lambda i: (verdict(i) == "open") & at(i, "repeated") | kept(i) & F.col("some") & at(i, "common")
    left = both.withColumn("left", F.filter("texts", lambda t, i: (verdict(i) != "drop") & ~gone(i)))
    text = F.array_join("left", "\n\n")
    lost = F.size(F.filter("verdicts", lambda v: v != "drop")) - F.size("left")
    out = left.select("page_id", "url", text.alias("text"), F.size("left").cast("long").alias("n_blocks"), lost.cast("long").alias("n_boilerplate"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_boilerplate")
