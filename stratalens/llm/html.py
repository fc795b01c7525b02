"""Main text of web pages: structure and a suffix array of every host decide together.

A page is cut into blocks of text in page order. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left out by their elements, roles and
names. A class counts by whole names on any element, an id on containers only. Neither leaves out
an element that holds the main element, nor one that holds an article unless an article stands
elsewhere or the rest has at least as much text (comments and teasers can be articles too). An
article named as a comment, reply or teaser is left out like any such element.

All pages of a host then go through its suffix array: the token streams of its distinct pages
(equal streams are one page) stand one after another with a mark of its own between two, their
suffixes are sorted by prefixes of growing length, and where RUN tokens or more agree between suffixes of
PAGES or more pages, the run is repeated. Order beyond RUN tokens does not change what is covered,
so sorting ends there. What the two say together:

* a page that marks its main part (main, article, role=main): that part, whole, since the same
  text on several pages is theirs nonetheless. Of several articles the longest stays; another one
  goes if it is mostly repeated runs (teasers that stand on many pages) or a fraction of its length;
* any other page: its blocks without the tokens that repeated runs cover; unique runs stay.

A host is dealt to shards by the hash of a page's tokens, as many as its bytes need, so a host with a third
of all pages is no single task's work. Shards of one host exchange the fingerprints of their
runs, in slices, so that pages of different shards count together.

Null or empty html: empty text. Null url: its own host "". Every input row gives one row, repeated
ones too; an empty table gives none. Time is linear in a page, whatever its nesting. Only page_id,
url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, join_small, stored

RUN, PAGES = 8, 3
#: Bytes of html that a shard of a host holds.
SHARD_BYTES = 8 << 20
#: Shards whose fingerprints meet in one slice of the exchange.
PER_SLICE = 16
#: An article of this share of the longest one's characters, or less, is a teaser.
TEASER = 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[/!?a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|<[/!?a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is not markup, up to their end tag.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_OUT = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "object", "audio", "video", "canvas"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
_NAME = r"(?:ad|advert[a-z]*|sponsor[a-z]*|promo|promos|promotion[a-z]*|banner|cookie|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|menu|nav|navbar|navigation|breadcrumb|pagination|pager|sidebar|widget|footer|masthead|topbar|site-?header|page-?header|comment|disqus|replies|respond|share|sharing|social|related|recommend[a-z]*|toc)s?"
#: Parts that place or hold what such a name says; with any other part (has-sidebar, promo-free, share-price) a name says something else.
_PLACE = r"(?:wrap|wrapper|container|holder|box|bar|area|section|block|panel|pane|list|item|link|button|btn|icon|group|row|column|col|inner|outer|top|bottom|left|right|side|primary|secondary|main|global|mega|sub|dropdown|site|page|post|entry|article|user|reader|email|media|header|head|title|form|slot|unit|zone|frame|story|stories|news|tool|law|info|mobile|desktop|sticky|fixed|floating|small|large|this|\d+(?:x\d+)?)s?"
_NAMES = re.compile(rf"(?:^|\s)(?:{_PLACE}[_-]+)*{_NAME}(?:[_-]+(?:{_NAME}|{_PLACE}))*(?=$|\s)", re.I)
#: Elements that hold others; ids of other ones (headings, paragraphs) are link targets.
_HOLDS = {"div", "section", "ul", "ol", "dl", "table", "tbody", "tr", "td", "figure", "details", "center", "span", "iframe"}
#: What makes an article another one than the page's.
_OTHER = re.compile(r"(?:^|\s)(?:(?:user|reader|post|article|blog|thread)[_-])?(?:comment|reply|replies|response|teaser|related|recommended|promo|sponsored|advert|ad)s?(?:[_-](?:item|body|card|box|entry|post|\d+))*(?=$|\s)", re.I)
_CLOSES_P = _BLOCK - {"body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_ROLE_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)


def _unwanted(name: str, rest: str) -> int:
    """2: out by element, role or attribute; 1: by class or id; 0: wanted."""
    if name in _OUT:
        return 2
    if not rest or rest.isspace():
        return 0
    named = 0
    for m in _ATTR.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "article":
            if key == "class" and _OTHER.search(value):
                named = 1
        elif (key == "class" or key == "id" and name in _HOLDS) and name not in ("html", "body", "main") and _NAMES.search(value):
            named = 1
    return named


@dataclass
class Page:
    """A page's wanted blocks in order; of each, whether it is in the main part, and its outermost article there (0: none)."""

    marked: bool = False
    texts: list[str] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    article: list[int] = field(default_factory=list)
    #: Characters in articles, or None without one.
    in_articles: int | None = None
    #: Starts of elements left out by class or id that hold a main element, an article.
    main_in: set[int] = field(default_factory=set)
    article_in: set[int] = field(default_factory=set)

    def chars(self) -> int:
        return sum(len(t) for t, m in zip(self.texts, self.main, strict=True) if m or not self.marked)


def parse(page: str | None) -> Page:
    """The page's blocks without unwanted elements."""
    found = _parse(page, set())
    main_in = found.main_in
    if main_in:
        found = _parse(page, main_in)
    if found.article_in and found.in_articles is None:
        other = _parse(page, main_in | found.article_in)
        if (other.in_articles or 0) > found.chars():
            return other
    return found


def choose(page: Page, covered: np.ndarray | None = None) -> list[str]:
    """The blocks of the text; covered: for every token of the page's stream, whether a repeated run covers it."""
    ends = np.cumsum([0, *(len(t.split()) for t in page.texts)])
    share = lambda at: covered[at].mean() if covered is not None and len(at) else 0.0
    if page.marked:
        size, tokens = Counter(), {}
        for k, (text, a) in enumerate(zip(page.texts, page.article, strict=True)):
            if a:
                size[a] += len(text)
                tokens.setdefault(a, []).append(np.arange(ends[k], ends[k + 1]))
        longest = max(size, key=lambda a: (size[a], -a), default=0)
        out = {a for a in size if a != longest and (size[a] <= TEASER * size[longest] or share(np.concatenate(tokens[a])) >= 0.5)}
        return [t for t, m, a in zip(page.texts, page.main, page.article, strict=True) if m and a not in out]
    if covered is None or not covered.any():
        return page.texts
    out = []
    for k, text in enumerate(page.texts):
        gone = covered[ends[k] : ends[k + 1]]
        if not gone.any():
            out.append(text)
        elif not gone.all():
            out.append(" ".join(w for w, g in zip(text.split(), gone, strict=True) if not g))
    return out


def blocks(page: str | None) -> tuple[bool, list[str]]:
    """(whether the main part is marked, the text blocks of it or else of the page), by structure alone."""
    found = parse(page)
    return found.marked, choose(found)


def _parse(page: str | None, kept: set[int]) -> Page:
    """Elements that start at `kept` are not left out by class or id."""
    out = Page()
    text: list[str] = []
    stack: list[str] = []
    opened: Counter[str] = Counter()  # open elements by name
    blocks_at: list[int] = []  # depths of open block elements
    p_at: list[int] = []  # depths of open paragraphs
    out_at, main_at = 0, 0  # depths at which an unwanted and the main element opened
    hard_at, article_at, number = 0, 0, 0
    named: list[tuple[int, int]] = []  # depth and start of open elements left out by class or id
    raw = ""

    def flush():
        if text:
            if block := _SPACE.sub(" ", references.unescape("".join(text))).strip():
                out.texts.append(block)
                out.main.append(main_at > 0)
                out.article.append(number if article_at else 0)
                if article_at:
                    out.in_articles += len(block)
            text.clear()

    def pop() -> str:
        nonlocal out_at, main_at, hard_at, article_at
        depth, last = len(stack), stack.pop()
        opened[last] -= 1
        if blocks_at and blocks_at[-1] == depth:
            blocks_at.pop()
        if p_at and p_at[-1] == depth:
            p_at.pop()
        if named and named[-1][0] == depth:
            named.pop()
        out_at, main_at, hard_at, article_at = (0 if x == depth else x for x in (out_at, main_at, hard_at, article_at))
        return last

    for m in _TOKEN.finditer(page or ""):
        token = m[0]
        if raw:
            if token[:2] == "</" and (t := _TAG.match(token)) and t[2].lower() == raw:
                raw = ""
            continue
        if token[0] != "<" or token == "<":
            if not out_at:
                text.append(token)
            continue
        t = _TAG.match(token)
        if not t:
            if token.startswith("<![CDATA[") and not out_at:
                text.append(references.escape(token[9:].removesuffix("]]>")))
            continue
        end, name, rest = t[1], t[2].lower(), t[3]
        if name in _RAW:
            if not end and not rest.endswith("/"):
                raw = name
            continue
        if name == "br":
            if not out_at:
                text.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if name in _VOID:
            continue
        if end:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        # a block ends an open paragraph, unless a block, an unwanted or the main element stands between
        if name in _CLOSES_P and p_at and blocks_at[-1] == p_at[-1] and p_at[-1] >= out_at and p_at[-1] > main_at:
            at = p_at[-1]
            while len(stack) >= at:
                pop()
        stack.append(name)
        opened[name] += 1
        if name in _BLOCK:
            blocks_at.append(len(stack))
        if name == "p":
            p_at.append(len(stack))
        if hard_at:
            continue
        is_main = name == "main" or "main" in rest and _ROLE_MAIN.search(rest) is not None
        why = _unwanted(name, rest)
        if why == 2:
            hard_at = len(stack)
            out_at = out_at or hard_at
        elif why and not is_main and m.start() not in kept:
            named.append((len(stack), m.start()))
            out_at = out_at or len(stack)
        elif is_main or name == "article":
            if out_at:
                (out.main_in if is_main else out.article_in).update(start for _, start in named)
                continue
            if not main_at:
                main_at, out.marked = len(stack), True
            if name == "article" and not article_at:
                article_at, out.in_articles, number = len(stack), out.in_articles or 0, number + 1
    flush()
    return out


_P = np.random.default_rng(20_240_811).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """Maps a word to its 64-bit hash, a task's words at most."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def stream(texts: list[str], words: Words) -> np.ndarray:
    """The token hashes of a page's blocks."""
    own = [w for t in texts for w in t.split()]
    return np.fromiter(map(words.__getitem__, own), np.uint64, len(own))


@dataclass
class HostArray:
    """The suffix array of some pages' streams, sorted to `run` tokens.

    at, page: a suffix's place in the concatenation and its page, in the order of the array;
    group: equal where `run` tokens agree, for suffixes that are as long.
    """

    starts: np.ndarray
    text: np.ndarray
    at: np.ndarray
    page: np.ndarray
    group: np.ndarray

    @classmethod
    def build(cls, streams: list[np.ndarray], run: int = RUN) -> "HostArray":
        starts = np.cumsum([0, *(len(x) + 1 for x in streams)])
        text = np.concatenate([y for x in streams for y in (x, np.zeros(1, np.uint64))]) if streams else np.zeros(0, np.uint64)
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) if n else np.zeros(0, np.int64)
        marks = starts[1:] - 1
        rank[marks] = n + np.arange(len(marks))  # a mark of its own after every page
        bits = int(2 * n + 2).bit_length()
        width, most = 1, max(2, 63 // bits)
        while width < run:
            # as many neighbouring ranks as a number holds, the last ones overlapping where less is wanted
            steps = [min(k * width, run - width) for k in range(1, most) if (k - 1) * width < run - width]
            packed = rank + 1
            for step in steps:
                ahead = np.zeros(n, np.int64)
                ahead[: max(0, n - step)] = rank[step:] + 1
                packed = (packed << bits) | ahead
            rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
            width += steps[-1]
        page = np.repeat(np.arange(len(streams)), np.diff(starts))
        left = starts[page + 1] - 1 - np.arange(n) if n else np.zeros(0, np.int64)
        full = np.flatnonzero(left >= run)
        order = full[np.argsort(rank[full], kind="stable")]
        return cls(starts, text, order, page[order], rank[order])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(for every suffix of the array its group's number, for every group how many pages it stands on)."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.diff(self.group, prepend=-1) != 0
        number = np.cumsum(new) - 1
        # pages ascend within a group, since suffixes of equal rank keep their order
        other = new | (np.diff(self.page, prepend=-1) != 0)
        return number, np.bincount(number[other])

    def fingerprints(self, run: int = RUN) -> np.ndarray:
        """A 64-bit fingerprint of every group's `run` tokens, the same in any array."""
        first = self.at[np.flatnonzero(np.diff(self.group, prepend=-1) != 0)]
        total = np.zeros(len(first), np.uint64)
        for k in range(run):
            total += self.text[first + k] * _P[k]
        return _mix(total)

    def covered(self, repeated: np.ndarray, run: int = RUN) -> list[np.ndarray]:
        """For every page, which tokens the groups marked in `repeated` cover."""
        number, _ = self.groups()
        edge = np.zeros(len(self.text) + run + 1, np.int64)
        at = self.at[repeated[number]] if len(number) else self.at
        np.add.at(edge, at, 1)
        np.add.at(edge, at + run, -1)
        inside = np.cumsum(edge) > 0
        return [inside[a : b - 1] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]


_PARSED = "of long, page_id long, url string, host string, shard long, marked boolean, texts array<string>, main array<boolean>, article array<int>, seen binary, part int"
_OUTPUT = "page_id long, url string, text string, n_chars long, repeated_tokens long"


def _parsed(pages: DataFrame) -> DataFrame:
    """Of pages (of: shards of the host, page_id, url, host, html) a row each: its blocks, and its shard by the hash of its tokens."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(x.as_py()) for x in b.column(4)]
            hashes = [xxhash.xxh3_64_intdigest("\n".join(" ".join(f.texts).split())) for f in found]
            shard = [h % n for h, n in zip(hashes, b.column(0).to_pylist(), strict=True)]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(shard, pa.int64()), pa.array([f.marked for f in found]), pa.array([f.texts for f in found], pa.list_(pa.string())), pa.array([f.main for f in found], pa.list_(pa.bool_())), pa.array([f.article for f in found], pa.list_(pa.int32())), pa.nulls(n, pa.binary()), pa.array([1] * n, pa.int32())],
                [x.split()[0] for x in _PARSED.split(", ")],
            )

    return in_arrow(pages, rows, _PARSED)


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """(host, shard, rows) of sorted rows."""
    key, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if (r["host"], r["shard"]) != key:
                if held:
                    yield (*key, held)
                key, held = (r["host"], r["shard"]), []
            held.append(r)
    if held:
        yield (*key, held)


def _array_of(rows: list[dict], words: Words) -> tuple[HostArray, list[int]]:
    """The array of the distinct streams of rows, and each row's number there."""
    numbers: dict[bytes, int] = {}
    streams, own = [], []
    for r in rows:
        s = stream(r["texts"], words)
        k = numbers.setdefault(s.tobytes(), len(streams))
        if k == len(streams):
            streams.append(s)
        own.append(k)
    return HostArray.build(streams), own


def _exchange(parsed: DataFrame, run: int, pages: int) -> DataFrame:
    """(host, shard, seen): fingerprints of a shard's runs that its host's shards together have on `pages` pages or more."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for host, shard, rows in _shards(batches):
            array, _ = _array_of(rows, words)
            counts, prints = np.minimum(array.groups()[1], pages), array.fingerprints(run)
            of = -(-rows[0]["of"] // PER_SLICE)
            for k in range(of):
                mine = prints % np.uint64(of) == k
                order = np.argsort(prints[mine])
                yield pa.RecordBatch.from_pydict({"host": [host], "slice": [k], "shard": [shard], "prints": pa.array([prints[mine][order].tobytes()], pa.binary()), "counts": pa.array([counts[mine][order].astype(np.uint8).tobytes()], pa.binary())})

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            prints = [np.frombuffer(r["prints"], np.uint64) for r in held]
            both, place = np.unique(np.concatenate(prints), return_inverse=True)
            n = np.bincount(place, np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in held]).astype(float), len(both))
            many = both[n >= pages]
            for r, p in zip(held, prints, strict=True):
                yield pa.RecordBatch.from_pydict({"host": [r["host"]], "shard": [r["shard"]], "seen": pa.array([p[np.isin(p, many)].tobytes()], pa.binary())})

        for b in batches:
            for r in b.to_pylist():
                if (r["host"], r["slice"]) != key:
                    if held:
                        yield from done()
                    key, held = (r["host"], r["slice"]), []
                held.append(r)
        if held:
            yield from done()

    sliced = in_arrow(parsed.repartition("host", "shard").sortWithinPartitions("host", "shard"), emit, "host string, slice long, shard long, prints binary, counts binary")
    return in_arrow(sliced.repartition("host", "slice").sortWithinPartitions("host", "slice", "shard"), merge, "host string, shard long, seen binary")


def main_text(pages: DataFrame, run: int = RUN, on_pages: int = PAGES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of (page_id, url, html): page_id, url, text, n_chars (code points), repeated_tokens (tokens of its blocks within repeated runs)."""
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    sizes = d.groupBy("host").agg(F.sum(F.octet_length("html")).alias("n")).where(F.col("n") > shard_bytes)
    # hosts of several shards: at most the table's bytes / shard_bytes rows
    large = stored(sizes.select("host", F.ceil(F.col("n") / shard_bytes).cast("long").alias("of")), "hosts")
    dealt = join_small(d, large, ["host"]).select(F.coalesce("of", F.lit(1)).alias("of"), "page_id", "url", "host", "html")
    parsed = _parsed(dealt)
    shared = stored(_exchange(_parsed(dealt.where("of > 1")), run, on_pages), "runs")
    none = {"array<string>": F.array().cast("array<string>"), "array<boolean>": F.array().cast("array<boolean>"), "array<int>": F.array().cast("array<int>")}
    names = [x.split(" ", 1) for x in _PARSED.split(", ")]
    extra = shared.withColumn("part", F.lit(0)).select(*[(F.col(c) if c in ("host", "shard", "seen", "part") else none.get(t, F.lit(None)).cast(t)).alias(c) for c, t in names])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for _, _, rows in _shards(batches):
            seen = [np.frombuffer(r["seen"], np.uint64) for r in rows if not r["part"]]
            rows = [r for r in rows if r["part"]]
            array, own = _array_of(rows, words)
            repeated = array.groups()[1] >= on_pages
            if seen:
                repeated |= np.isin(array.fingerprints(run), np.concatenate(seen))
            covered = array.covered(repeated, run)
            for lo in range(0, len(rows), 500):
                part = rows[lo : lo + 500]
                texts = ["\n".join(choose(Page(r["marked"], r["texts"], r["main"], r["article"]), covered[k])) for r, k in zip(part, own[lo:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in part], pa.int64()), pa.array([r["url"] for r in part], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([int(covered[k].sum()) for k in own[lo : lo + 500]], pa.int64())], [x.split()[0] for x in _OUTPUT.split(", ")])

    together = parsed.unionByName(extra).repartition("host", "shard").sortWithinPartitions("host", "shard", "part")
    return in_arrow(together, write, _OUTPUT)
