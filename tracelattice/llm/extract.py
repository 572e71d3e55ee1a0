"""Main text of web pages as the maximum-scoring run of a page's token sequence.

A page becomes a sequence of words and tags. Words score positive and tags negative, by log-likelihood ratios of being
inside or outside the content, learned from labelled pages: those that mark one element as their content. A linear scan finds
the contiguous region of the highest sum. Tags without a word between them score once, as the worst of them, and inside the one
element that a page marks as its content they do not count. Elements that are never content (menus, footers, hidden ones, by tag or
attribute) are left out. Others are named like that (adverts, widgets, forms) but may be wrappers: they are left out unless they
hold most words of what is around them, comments unless they hold nearly all; words of elements whose name only has such a part
score negative. A page that would be left without text is read again without regard to such names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.llm.common import hash_sample, map_rows

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|select)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|/|=|$)", re.I)
UNTIL = re.compile(r"(?:^|\s)hidden\s*=\s*[\"']?until", re.I)
STYLED = re.compile(r"(?<![\w-])(?:style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"'>]*)(?<![\w-])display\s*:\s*none|aria-hidden\s*=\s*[\"']?true)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul title".split()
)
NEVER = frozenset("head nav footer aside menu dialog button title".split())
CONTENT = frozenset(("article", "main"))
FRAME = frozenset("html head body article main nav header footer aside".split())
NOISE = frozenset(
    "nav navbar navigation menu sidebar aside ad ads adbox advert adverts advertisement sponsor sponsored promo promotion banner cookie"
    " cookies consent gdpr notice notices alert footer comment comments commentlist reply replies discussion disqus respond share sharing"
    " social related recommended recommendations newsletter subscribe subscription signup breadcrumb breadcrumbs popup modal overlay widget"
    " toolbar pagination pager login search masthead topbar complementary contentinfo feedback reactions".split()
)
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
COMMENTS = frozenset("comment comments commentlist reply replies discussion disqus respond".split())
SAMPLE_PAGES = 2000
MOST, NEARLY_ALL = 0.5, 0.97  # shares of words from which a wrapper is told by its size
TRUSTED = 0.1  # least share of words of an element that a page marks as its content
BOUNDARY = -2.0  # least score of tags between two words that do not frame a page
DEFAULT = {"word": 1.0, "link": -0.5}


class Page:
    """Tokens of a page and, per token, whether it lies in noise and in marked content."""

    def __init__(self, source: str):
        self.kind: list[str] = []  # 'word', 'link' (a word inside a link) or a tag's name
        self.text: list[str | None] = []
        self.block: list[int] = []
        opened: list[list] = []  # name, first token, kind of noise, is content
        names: Counter = Counter()
        spans: list[tuple[int, int, str, bool, str]] = []
        block = 0

        def close(to: int) -> None:
            while len(opened) > to:
                name, first, noise, content = opened.pop()
                names[name] -= 1
                spans.append((first, len(self.kind), noise, content, name))

        for m in TOKEN.finditer(source):
            if m["text"] is not None:
                piece = m["text"]
                link = "link" if names["a"] > 0 else "word"
                words = html.unescape(piece).split() if "&" in piece else piece.split()
                glued = bool(self.text and self.text[-1] is not None and not piece[:1].isspace())
                for i, w in enumerate(words):
                    self.add(link, ("" if glued and i == 0 else " ") + w, block)
                if not words or piece[-1:].isspace():
                    self.add("", " ", block)
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCKS or tag == "br":
                if tag == "br":
                    self.add("", " ", block)
                else:
                    block += 1
            if m["close"]:
                if names[tag] > 0:
                    at = len(opened) - 1
                    while opened[at][0] != tag:
                        at -= 1
                    self.add(tag, None, block)
                    close(at)
                else:
                    self.add(tag, None, block)
                continue
            if tag in BLOCKS and opened and opened[-1][0] == "p":
                close(len(opened) - 1)
            if tag in IMPLIED and opened and opened[-1][0] in IMPLIED[tag]:
                close(len(opened) - 1)
            first = len(self.kind)
            self.add(tag, None, block)
            if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCKS:
                continue
            opened.append([tag, first, noise_kind(tag, m["attrs"]), tag in CONTENT or "articlebody" in m["attrs"].lower()])
            names[tag] += 1
        rest = [(o[0], o[1], o[3]) for o in opened]
        close(0)
        unclosed = {(f, n) for n, f, _ in rest}
        self.mark(spans, unclosed)

    def add(self, kind: str, text: str | None, block: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.block.append(block)

    def mark(self, spans, unclosed) -> None:
        n = len(self.kind)
        self.spans, self.unclosed = spans, unclosed
        self.contents = [(s, e) for s, e, _, c, _ in spans if c]
        headings = [(s, e) for s, e, _, _, name in spans if re.fullmatch(r"h[1-6]", name)]
        never = [0] * (n + 1)
        for s, e, kind, _, name in spans:
            inside, holds = self.around(s, e)
            if name == "header" and not holds:
                for a, b in gaps(s, e, [(a, b) for a, b in headings if inside and s <= a and b <= e]):
                    never[a] += 1
                    never[b] -= 1
            elif kind == "never" and not holds and not ((s, name) in unclosed and name not in NEVER):
                never[s] += 1
                never[e] -= 1
        self.never = [v > 0 for v in accumulate(never[:-1])]
        outer = [c for c in self.contents if not any(o != c and o[0] <= c[0] and c[1] <= o[1] for o in self.contents)]
        self.content = outer[0] if len(outer) == 1 else None
        self.words = [0, *accumulate(k in ("word", "link") and not v for k, v in zip(self.kind, self.never))]
        self.by_names()

    def around(self, s: int, e: int) -> tuple[tuple[int, int] | None, bool]:
        """The smallest marked content around a span, and whether the span holds one itself."""
        outside = [c for c in self.contents if c[0] <= s and e <= c[1]]
        return min(outside, key=lambda c: c[1] - c[0], default=None), any(s <= a and b <= e for a, b in self.contents)

    def by_names(self, names: bool = True) -> None:
        """Which tokens are noise, and which are doubtful: what is never content, comments and, with `names`, elements by their names."""
        n = len(self.kind)
        noise, weak = [0] * (n + 1), [0] * (n + 1)
        for s, e, kind, _, name in self.spans:
            if kind in ("", "never") or (s, name) in self.unclosed or not names and kind != "comment":
                continue
            inside, holds = self.around(s, e)
            lo, hi = inside or (0, n)
            around = self.words[hi] - self.words[lo]
            if holds or self.words[e] - self.words[s] >= (NEARLY_ALL if kind == "comment" else MOST) * around:
                continue
            to = weak if kind == "part" else noise
            to[s] += 1
            to[e] -= 1
        self.noise = [v > 0 or w for v, w in zip(accumulate(noise[:-1]), self.never)]
        self.weak = [v > 0 for v in accumulate(weak[:-1])]


def gaps(s: int, e: int, kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], s
    for a, b in sorted(kept):
        out.append((at, a))
        at = max(at, b)
    return [*out, (at, e)]


def noise_kind(tag: str, attrs: str) -> str:
    """`never` content, by tag or hidden; `comment`, a name with such a part; `name`, one all of whose parts are noise, or a form;
    `part`, one with such a part; or empty."""
    if tag in NEVER:
        return "never"
    kind = "name" if tag == "form" else ""
    if not attrs or tag in ("html", "body", "article", "main"):
        return kind
    if STYLED.search(attrs) or HIDDEN.search(QUOTED.sub("=x", attrs)) and not UNTIL.search(attrs):
        return "never"
    found = {kind}
    for m in ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = {p.lower() for p in PART.findall(name)} | {name.lower()}
            if name == "hidden":
                return "never"
            if not COMMENTS.isdisjoint(parts):
                found.add("comment")
            elif name.lower() in NOISE or parts - {name.lower()} and NOISE.issuperset(parts - {name.lower()}):
                found.add("name")
            elif not NOISE.isdisjoint(parts):
                found.add("part")
    return next(k for k in ("comment", "name", "part", "") if k in found)


def learned_counts(source: str) -> Counter:
    """How often each kind of token occurs inside ('+') and outside ('-') the marked content of a labelled page."""
    page, out = Page(source), Counter()
    if page.content:
        lo, hi = page.content[0] + 1, page.content[1] - 1
        for i, k in enumerate(page.kind):
            if k:
                out[("+" if lo <= i < hi and not page.noise[i] else "-") + k] += 1
    return out


def fit_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-likelihood ratio of every kind of token, from the `sample_pages` pages of smallest hash that mark their content.

    Words are held positive, tags negative. Tags inside a text weigh -3 at least, as the sample may lack articles with lists or
    links; tags that frame a page weigh fourfold. Without labelled pages words score 1 and tags -1.
    """
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)\\b|articleBody"))
    sample = hash_sample(marked.select("page_id", "html"), sample_pages, "page_id", "html").select("html")

    def count(c):
        total: Counter = Counter()
        for h in c["html"]:
            total.update(learned_counts(h.decode()))
        return {"kind": list(total), "n": list(total.values())}

    rows = map_rows(sample, count, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()  # the kinds of tokens of the sample
    n = {r.kind: r.n for r in rows}
    inside, outside = (sum(v for k, v in n.items() if k[0] == s) for s in "+-")
    if not inside or not outside:
        return dict(DEFAULT)
    out = {}
    for k in {k[1:] for k in n}:
        ratio = math.log((n.get("+" + k, 0) + 0.5) / (inside + 1)) - math.log((n.get("-" + k, 0) + 0.5) / (outside + 1))
        out[k] = max(0.05, ratio) if k == "word" else max(-3.0, ratio) if k == "link" else 4 * min(-0.05, ratio) if k in FRAME else max(-3.0, min(-0.05, ratio))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous range of the largest sum (the first and shortest such); empty if none is positive."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, lo, hi = total, start, i + 1
    return lo, hi


def token_scores(page: Page, weights: dict[str, float]) -> list[float]:
    """The score of every token. Noise scores nothing; tags without a word between them score together as the worst of them. If a
    page marks one element as content that holds a share of its words, words outside score negative and tags inside nothing."""
    word, link = weights.get("word", 1.0), weights.get("link", -0.5)
    bad, lo, hi = -max(0.5, word), 0, 0
    if page.content and page.words[page.content[1]] - page.words[page.content[0]] >= max(1, TRUSTED * page.words[-1]):
        lo, hi = page.content
    scores, worst = [], 0.0
    for i, (k, noise, weak) in enumerate(zip(page.kind, page.noise, page.weak)):
        inside = lo <= i < hi
        if noise or not k:
            scores.append(0.0)
        elif k in ("word", "link"):
            plain = word if k == "word" else max(link, 0.05) if inside else link
            scores.append(bad if weak or hi and not inside else plain)
            worst = 0.0
        elif inside:
            scores.append(0.0)
        else:
            s = weights.get(k, -1.0)
            s = s if k in FRAME else max(s, BOUNDARY)
            scores.append(min(0.0, s - worst))
            worst = min(s, worst)
    return scores


def main_text(source: str, weights: dict[str, float]) -> str:
    """The main text of one page, blocks joined by two line breaks."""
    page = Page(source)
    text = run_text(page, weights)
    if not text and page.words[-1]:
        page.by_names(False)
        text = run_text(page, weights)
    return text


def run_text(page: Page, weights: dict[str, float]) -> str:
    lo, hi = best_run(token_scores(page, weights))
    blocks: dict[int, list[str]] = {}
    for i in range(lo, hi):
        if page.text[i] is not None and not page.noise[i]:
            blocks.setdefault(page.block[i], []).append(page.text[i])
    done = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(b for b in done if b)


def extract_pages(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of `pages` (page_id, url, html).

    Null and empty pages, and pages without a positive run, have an empty text. Whole pages are read, however long; repeated
    rows give repeated results; other columns are left aside; an empty table gives an empty one.
    """

    def rows(c):
        texts = [main_text(h.decode(), weights) for h in c["html"]]
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return map_rows(source, rows, "page_id long, url string, text string, n_chars long")
