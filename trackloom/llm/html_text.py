"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a row of tokens: runs of words and tags. Words of plain text score positive; link words, words within parts
that are never content (menus, adverts, forms, ...) and tags score negative. One linear scan finds the contiguous run of
tokens with the highest sum; ties go to the earlier start, then the shorter run. The weights are log odds counted on
labelled pages: `TRAINING_PAGES` invented pages (a documented bound, fixed seed) whose content is known; what a tag costs
on top, so that all tags stay negative, and the weight of a word are those of `COSTS` and `WORD_WEIGHTS` under which the
scan finds the content of these pages best.

The region found is taken to the borders of its blocks. If its words are a share of `MOSTLY` of those in the innermost container that
holds it all, or in the article or main element around that, its borders are moved to that element's: a short last
paragraph behind a table is then not lost. Of the region, everything but the parts that are never content is returned:
character references decoded, white space within a block as one space, blocks by line feeds.

Parts are never content by their element, by being hidden, or by a class, id, role or label that names them as a whole
(`MARKED`). Such a name does not count on an element that holds the page's heading or article and most of its words, unless
it speaks of comments or adverts.

Each page is handled alone and whole, in time linear in its length, without a shuffle.

Defined results
* null, empty or wordless html: an empty text. Cut-off pages: open elements end with the page; a tag cut off says nothing.
* very long pages, tags or values: read whole. Repeated rows: each on its own. Empty table: an empty result.
* further columns do not matter; null url stays null.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, with_fields

TRAINING_PAGES = 160
SEED = 11
MOSTLY = 0.5
COSTS = (0.05, 0.2, 0.5, 1.0, 2.0)
WORD_WEIGHTS = (0.5, 1.0, 2.0)

#: A comment, an element's tag, any other markup, or text. In a tag a quoted value after = may hold anything; a quote that is never closed is a
#: character like others. Each kind of quote can stay unclosed but once, so that reading is linear.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)

#: Elements whose content is no markup, elements without content, elements that break the flow of text, elements that are
#: never content, and words in class, id or role that mark such parts.
RAW = frozenset("script style textarea iframe title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
NEVER = frozenset("nav aside footer form button select option head menu dialog fieldset input label noscript template svg math object canvas".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners sponsor sponsored sponsors promo promotion nav navbar "
    "navigation menu menus sidebar sidebars aside footer foot masthead cookie cookies consent gdpr notice notices alert alerts popup modal "
    "overlay newsletter subscribe subscription signup share sharing social related recommended recommendations breadcrumb breadcrumbs comment comments "
    "commentlist disqus reply replies respond responses login search searchbox widget widgets toolbar pagination pager copyright legal "
    "complementary contentinfo header topbar".split()
)
#: Of these, words that hold for an article of its own and for an element of any size.
COMMENTS = frozenset("comment comments commentlist reply replies respond responses ad ads advert promo related".split())
#: Words that may stand beside those in one class or id, as in site-footer.
BESIDE = frozenset("site page global left right top bottom box bar block list area wrapper wrap container inner section widget primary secondary main".split())
#: Elements that a page's own text is in, which no name but those of COMMENTS hides.
SPARED = frozenset("html body main article".split())
#: Text blocks, whose class or id names what they say.
UNMARKED = frozenset("p h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main div section td body html center blockquote".split())
#: What a page calls its own: elements that tell a wrapper from a part.
OWN = frozenset("article main h1".split())
ENDS_ITSELF = frozenset("p li tr td th dt dd option".split())
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}

HARD, NAMED, COMMENT = 1, 2, 3


def _mark(tag: str, attrs: str) -> int:
    """HARD for a hidden element, NAMED for one that is named as a part that is never content, COMMENT for one named after comments or adverts, else 0."""
    if tag in ("html", "body"):
        return 0
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if tag not in SPARED and (name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and _NO_DISPLAY.search(value)):
            return HARD
        if tag not in UNMARKED and name in ("class", "id", "role", "aria-label"):
            for token in [value] if name == "aria-label" else value.split():
                parts = {x for x in re.split(r"[^a-z0-9]+", token) if x}
                if parts & COMMENTS and parts <= MARKED | BESIDE:
                    return COMMENT
                if tag not in SPARED and parts & MARKED and parts <= MARKED | BESIDE:
                    return NAMED
    return 0


class Page:
    """The tokens of a page, kinds +1 for words and -1 for a tag, with the element and the block that each stands in, and its elements in
    the order in which they open."""

    def __init__(self, source: str):
        self.kinds: list[int] = []
        self.names: list[str] = []
        self.texts: list[str] = []
        self.counts: list[int] = []
        self.linked: list[bool] = []
        self.blocks: list[int] = []
        self.holders: list[int] = []
        self.tags, self.parents, self.marks = ["html"], [0], [0]
        self._read(source)
        self._judge()

    def _add(self, kind, name, text, count, block, holder, linked):
        self.kinds.append(kind)
        self.names.append(name)
        self.texts.append(text)
        self.counts.append(count)
        self.linked.append(linked)
        self.blocks.append(block)
        self.holders.append(holder)

    def _read(self, source: str) -> None:
        stack = [0]  # numbers of open elements
        open_tags: Counter = Counter()
        block = links = at = 0
        tags = self.tags

        def pop() -> None:
            nonlocal links
            tag = tags[stack.pop()]
            open_tags[tag] -= 1
            links -= tag == "a"

        while at < len(source):
            m = _TOKEN.match(source, at)
            at = m.end()
            text = m["text"]
            if text is not None:
                words = len(text.split())
                if words:
                    self._add(1, "", text, words, block, stack[-1], links > 0)
                elif self.kinds and self.kinds[-1] == 1:
                    self.texts[-1] += " "
                else:
                    self._add(1, "", " ", 0, block, stack[-1], links > 0)
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag, attrs = tag.lower(), m["attrs"]
            if tag in RAW:
                if not m["close"]:
                    end = _ENDS[tag].search(source, at)
                    at = end.end() if end else len(source)
                continue
            if tag in BLOCK:
                block += 1
            if m["close"]:
                if open_tags[tag]:
                    while tags[stack[-1]] != tag:
                        pop()
                    pop()
                self._add(-1, "/" + tag, "", 0, block, stack[-1], links > 0)
                continue
            if tag == "br":
                self._add(1, "", " ", 0, block, stack[-1], links > 0)
            drawn = tag in ("svg", "math") or open_tags["svg"] or open_tags["math"]
            if tag in VOID or drawn and attrs.rstrip().endswith("/"):
                self._add(-1, tag, "", 0, block, stack[-1], links > 0)
                continue
            if tag in ENDS_ITSELF and open_tags[tag]:
                # a new one ends the last one of the same container
                for k in range(len(stack) - 1, -1, -1):
                    if tags[stack[k]] == tag:
                        while len(stack) > k:
                            pop()
                        break
                    if tags[stack[k]] in CONTAINERS or tags[stack[k]] in ("ul", "ol", "table", "dl", "select"):
                        break
            mark = HARD if tag in NEVER else _mark(tag, attrs) if attrs else 0
            if tag == "header" and not (open_tags["article"] or open_tags["main"] or open_tags["section"]):
                mark = HARD
            self.parents.append(stack[-1])
            self.marks.append(mark)
            tags.append(tag)
            stack.append(len(tags) - 1)
            open_tags[tag] += 1
            links += tag == "a"
            self._add(-1, tag, "", 0, block, stack[-1], links > 0)

    def _judge(self) -> None:
        """Which elements are never content, and how many words of the others each element holds."""
        n, parents, marks = len(self.tags), self.parents, self.marks
        hard, words, owns = [False] * n, [0] * n, [False] * n
        for e in range(1, n):
            hard[e] = hard[parents[e]] or marks[e] == HARD
            owns[e] = self.tags[e] in OWN and not hard[e] and not marks[e]
        for e, count in zip(self.holders, self.counts):
            if not hard[e]:
                words[e] += count
        for e in range(n - 1, 0, -1):  # an element opens after the one that it is in
            words[parents[e]] += words[e]
            owns[parents[e]] = owns[parents[e]] or owns[e]
        off = [False] * n
        for e in range(1, n):
            named = marks[e] == COMMENT or marks[e] == NAMED and not (owns[e] and 2 * words[e] > words[0])
            off[e] = off[parents[e]] or hard[e] or named
        self.never = [off[e] for e in self.holders]
        sums = [0] * n
        for e, count in zip(self.holders, self.counts):
            if not off[e]:
                sums[e] += count
        for e in range(n - 1, 0, -1):
            sums[parents[e]] += sums[e]
        self.sums = sums

    def scores(self, weights: dict[str, float]) -> list[float]:
        plain, link, never, other = weights["w"], weights["wa"], weights["wn"], weights["?"]
        out = []
        for kind, name, count, off, linked in zip(self.kinds, self.names, self.counts, self.never, self.linked):
            if kind > 0:
                out.append(count * (never if off else link if linked else plain))
            else:
                out.append(weights.get(name, other))
        return out

    def region(self, weights: dict[str, float]) -> tuple[int, int] | None:
        """First token and last + 1 of the best run."""
        best, found, total, start = 0.0, None, 0.0, 0
        for i, s in enumerate(self.scores(weights)):
            if total <= 0:
                total, start = 0.0, i
            total += s
            if total > best:
                best, found = total, (start, i + 1)
        return found

    def _path(self, token: int) -> list[int]:
        """The containers that a token is in, the outermost first."""
        path, e = [], self.holders[token]
        while e:
            if self.tags[e] in CONTAINERS:
                path.append(e)
            e = self.parents[e]
        return [0, *path[::-1]]

    def _inside(self, element: int) -> list[int]:
        """Tokens inside an element."""
        inside = [False] * len(self.tags)
        inside[element] = True
        for e in range(element + 1, len(inside)):
            inside[e] = inside[self.parents[e]]
        return [i for i, e in enumerate(self.holders) if inside[e]]

    def chosen(self, weights: dict[str, float], snap: bool = True) -> list[int]:
        """The tokens that are returned; without `snap` the region at the borders of its blocks."""
        found = self.region(weights)
        picked = [i for i in range(*found) if self.counts[i] and not self.never[i]] if found else []
        if not picked:
            return []
        if snap:
            around = [a for a, b in zip(self._path(picked[0]), self._path(picked[-1])) if a == b]
            words = sum(self.counts[i] for i in picked)
            full = [e for e in around if words >= MOSTLY * self.sums[e]]
            named = [e for e in full if self.tags[e] in ("article", "main")]
            if named or around[-1] in full:
                return [i for i in self._inside(named[-1] if named else around[-1]) if not self.never[i]]
        first, last = self.blocks[picked[0]], self.blocks[picked[-1]]
        return [i for i in range(len(self.kinds)) if first <= self.blocks[i] <= last and not self.never[i]]

    def main_text(self, weights: dict[str, float], snap: bool = True) -> str:
        blocks: dict[int, list[str]] = {}
        for i in self.chosen(weights, snap):
            if self.kinds[i] > 0:
                blocks.setdefault(self.blocks[i], []).append(self.texts[i])
        lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n".join(x for x in lines if x)


def _training_page(rng: random.Random) -> str:
    """An invented page; the words of its content, and no others, begin with q."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    run = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    good = lambda a, b: " ".join("q" + word() for _ in range(rng.randint(a, b)))
    links = lambda n: "".join(f"<li><a href='/{word()}'>{run(1, 3)}</a></li>" for _ in range(n))
    holder = rng.choice(("article", "main", "div", "section"))
    body = f"<h1>{good(2, 9)}</h1>"
    for _ in range(rng.choice((1, 1, 2, 4, 8, 12))):
        part, kind = good(4, 70), rng.random()
        if kind < 0.1:
            part = f"<ul>{''.join(f'<li>{good(4, 15)}</li>' for _ in range(rng.randint(2, 4)))}</ul>"
        elif kind < 0.2:
            part = f"<p>{good(3, 9)} <a href='#'>{good(1, 2)}</a> {part}</p>"
        elif kind < 0.25:
            part = f"<h2>{good(1, 5)}</h2><p>{part}</p>"
        elif kind < 0.3:
            part = f"<table><tr><th>{good(1, 2)}</th><td>{good(1, 4)}</td></tr></table><p>{part}</p>"
        else:
            part = rng.choice((f"<p>{part}</p>", f"<p>{part}", f"<p><b>{good(2, 5)}</b> {part}<br></p>", f"<blockquote>{part}</blockquote>", f"<div>{part}</div>"))
        body += part
        if rng.random() < 0.1:
            body += f"<div class='ad'>{run(3, 20)}</div>"
    before = rng.choice(("", f"<header><a href='/'>{run(1, 2)}</a></header>")) + f"<nav><ul>{links(rng.randint(4, 9))}</ul></nav>"
    before += rng.choice(("", f"<div>{run(2, 8)}</div>", f"<table><tr><td><a href='#'>{run(1, 3)}</a></td></tr></table>", f"<div><ul>{links(5)}</ul></div>"))
    after = rng.choice((f"<aside><h3>{run(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul></aside>", f"<div><h3>{run(1, 3)}</h3><ul>{links(rng.randint(3, 8))}</ul></div>", ""))
    after += rng.choice(("", f"<form><input><button>{word()}</button></form>", f"<div id='comments'><p>{run(5, 90)}</p></div>"))
    after += "".join(f"<div><span>{run(1, 2)}</span><a href='#'>{run(1, 2)}</a><p>{run(2, 9)}</p></div>" for _ in range(rng.choice((0, 0, 1, 4))))
    after += f"<footer>&copy; {run(2, 8)}</footer>"
    return f"<html><head><title>{run(2, 5)}</title></head><body>{before}<{holder}>{body}</{holder}>{after}</body></html>"


def _marked_words(page: Page) -> list[bool]:
    return [count > 0 and text.split()[0].startswith("q") for text, count in zip(page.texts, page.counts)]


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> dict[str, float]:
    """Weights: w plain word, wa link word, wn word of a part that is never content, each tag (closing with /), ? any other tag."""
    rng = random.Random(seed)
    inside, outside, read = Counter(), Counter(), []
    for _ in range(pages):
        page = Page(_training_page(rng))
        good = _marked_words(page)
        own = [i for i, g in enumerate(good) if g]
        for i, (kind, name, count) in enumerate(zip(page.kinds, page.names, page.counts)):
            key = name if kind < 0 else "wn" if page.never[i] else "wa" if page.linked[i] else "w"
            (inside if own[0] <= i <= own[-1] else outside)[key] += count if kind > 0 else 1
        read.append((page, good))
    both = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {k: math.log((inside[k] + 1) / both[0]) - math.log((outside[k] + 1) / both[1]) for k in set(inside) | set(outside)}
    most = max(v for k, v in odds.items() if k not in ("w", "wa", "wn"))
    best, kept = -1.0, {}
    for cost in COSTS:
        for unit in WORD_WEIGHTS:
            tags = {k: v - most - cost for k, v in odds.items() if k not in ("w", "wa", "wn")}
            weights = tags | {"w": unit * max(odds["w"], 0.1), "wa": min(odds["wa"], -0.1), "wn": min(odds["wn"], -0.1), "?": -most - cost}
            right = found = wanted = 0
            for page, good in read:
                picked = set(page.chosen(weights, snap=False))
                for i, count in enumerate(page.counts):
                    right += count * (good[i] and i in picked)
                    found += count * (i in picked)
                    wanted += count * good[i]
            score = 2 * right / max(1, found + wanted)
            if score > best + 1e-12:
                best, kept = score, weights
    return kept


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns, text and n_chars, a row a page."""
    import pandas as pd

    sent = pages.sparkSession.sparkContext.broadcast(trained())
    schema = with_fields(pages.select(*[F.col(f"`{c}`") for c in keep]).schema, "text string, n_chars bigint")

    def run(frames):
        for frame in frames:
            texts = [Page(x).main_text(sent.value) if x else "" for x in frame["_html"]]
            out = frame[list(keep)].copy()
            out["text"] = texts
            out["n_chars"] = pd.Series([len(t) for t in texts], index=frame.index, dtype="int64")
            yield out

    return pages.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_html")).mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))
