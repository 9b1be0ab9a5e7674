"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A page is parsed into its block elements. Each gets features: text and link density of the
element and its subtree, groups of attribute and tag tokens of itself and its ancestors, depth,
position and the statistics of its siblings. Boosted trees give each element the probability
that its own text, or for a container what stands in it, belongs to the article. Decoding chooses, for the whole tree at once, a role
for each element: *around* (may hold article and other parts), *article*, or *other*. Below
*other* there is only *other*, below *article* never *around*, so no choice contradicts an
ancestor's; a bottom-up pass finds the best roles, a top-down pass reads them off.

The trees are fitted on a bounded sample of pages (``sample_pages``, by hash of the id). Seeds are
pages that mark their article by an element of that meaning; every sampled article also is set
into varied frames (containers, menus, side columns, notices, adverts, forms, reader comments,
all filled with text of the sampled pages), where the labels are known by construction.

Null and empty pages have the empty text. Rows that repeat, or have a null id, are answered each.
Unclosed or cut-off markup is read as far as it goes. An empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import texts

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody
td tfoot th thead tr ul""".split())
SILENT = frozenset("head script style noscript template iframe svg object select option button canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
# what may stand in a head; anything else ends it, as its end tag may be left out
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# a start tag of the first kind ends an open element of the second kinds
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl td th div section article body html main aside nav footer header form object template button select".split())

GROUPS = {
    "content": "article main content post entry story text body articlebody prose page blog news paragraph".split(),
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pager pagination toc tabs topbar skip".split(),
    "footer": "footer foot copyright colophon bottom legal".split(),
    "header": "header masthead banner logo brand branding site top hero".split(),
    "side": "sidebar side aside rail widget widgets secondary complementary column".split(),
    "ad": "ad ads adv advert advertisement adverts adsense sponsor sponsored promo promotion promoted affiliate commercial".split(),
    "notice": "cookie cookies consent notice notification gdpr alert popup modal overlay dialog toast paywall warning disclaimer".split(),
    "form": "form search login signin signup register subscribe subscription newsletter contact input".split(),
    "comment": "comment comments commentlist reply replies respond response responses disqus discussion thread feedback reader review reviews".split(),
    "share": "share sharing social follow facebook twitter tweet tools toolbar meta byline tags tag author".split(),
    "related": "related recommended recommendations more popular trending latest teaser teasers next previous links".split(),
}
_GROUP = {w: 1 << i for i, ws in enumerate(GROUPS.values()) for w in ws}
_TAG_GROUP = {"article": 1, "main": 1, "nav": 2, "menu": 2, "footer": 4, "header": 8, "aside": 16, "dialog": 64, "form": 128,
              "fieldset": 128}
N_GROUPS = len(GROUPS)
_KINDS = [{"p"}, {f"h{i}" for i in range(1, 7)}, {"li", "dt", "dd"}, {"td", "th", "tr"}, {"pre", "blockquote", "figcaption"},
          {"ul", "ol", "dl", "menu"}, {"article", "main"}]
N_FEATURES = 16 + len(_KINDS) + 2 * N_GROUPS

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
_ATTRS = re.compile(r"""(?:class|id|role|itemprop|aria-label|data-role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCT = re.compile(r"[.,;:!?]")
_TRUE = "data-true"


def _groups(tag: str, attrs: str) -> int:
    g = _TAG_GROUP.get(tag, 0)
    if attrs:
        for m in _ATTRS.finditer(attrs):
            for part in _PART.findall(m[1]):
                g |= _GROUP.get(part.lower(), 0)
    return g


class Page:
    """The block elements of a page (parents before children) and its text pieces in order."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.group, self.depth = ["#root"], [-1], [0], [0]
        self.pieces: list[tuple[int, int, str, bool]] = []  # block number, element, text, in a link
        self.marked: set[int] = set()
        self._parse(source or "")

    def _parse(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones stand for their block
        block = at = links = silent = 0
        n = len(s)
        while at < n:
            m = _MARKUP.search(s, at)
            stop = m.start() if m else n
            if stack[-1][0] == "head" and (s[at:stop].strip() or m and m[2] and not m[1] and m[2].lower() not in HEAD):
                stack.pop()
                silent -= 1
            if stop > at and not silent:
                self.pieces.append((block, stack[-1][1], _html.unescape(s[at:stop]), links > 0))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag
                              or (tag not in BLOCKS and stack[i][0] in BLOCKS)), 0)
                if not where or stack[where][0] != tag:
                    continue
                for name, _ in stack[where:]:
                    links -= name == "a"
                    silent -= name in SILENT
                    block += name in BLOCKS
                del stack[where:]
                continue
            if tag in VOID:
                if tag == "br" and not silent:
                    self.pieces.append((block, stack[-1][1], " ", False))
                block += tag == "hr"
                continue
            if tag == "xmp":  # shown as it stands, markup and all
                end = re.compile(r"</xmp\b[^>]*>?", re.I).search(s, at)
                if not silent:
                    self.pieces.append((block + 1, stack[-1][1], s[at:end.start() if end else n], links > 0))
                block += 2
                at = end.end() if end else n
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(s, at)
                at = end.end() if end else n
                continue
            closes = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else None)
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        for name, _ in stack[i:]:
                            links -= name == "a"
                            silent -= name in SILENT
                            block += name in BLOCKS
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPES:
                        break
            attrs = m[3] or ""
            node = stack[-1][1]
            g = _groups(tag, attrs)
            if tag in BLOCKS or g & ~1:
                self.tag.append(tag)
                self.parent.append(node)
                self.group.append(g)
                self.depth.append(self.depth[node] + 1)
                node = len(self.tag) - 1
                block += tag in BLOCKS
                if _TRUE in attrs:
                    self.marked.add(node)
            if attrs.rstrip().endswith("/") and tag not in BLOCKS:
                continue
            links += tag == "a"
            silent += tag in SILENT
            stack.append((tag, node))

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, linked, punct, first = [0] * n, [0] * n, [0] * n, [-1] * n
        offset = 0
        for _, node, text, link in self.pieces:
            size = len(text.strip())
            if not size:
                continue
            if first[node] < 0:
                first[node] = offset
            offset += size
            own[node] += size
            if link:
                linked[node] += size
            punct[node] += len(_PUNCT.findall(text))
        sub, sublink, tags, above = own[:], linked[:], [1] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            sub[p] += sub[i]
            sublink[p] += sublink[i]
            tags[p] += tags[i]
            children[p].append(i)
            if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                first[p] = first[i]
        # what an element's role weighs: its own text, or for a container what stands in it
        self.own, self.sub = own, sub
        self.weight = np.where(np.array(own) > 0, np.sqrt(own), 0.15 * np.sqrt(sub))
        total = max(offset, 1)
        prev, nxt, mates, mean = [0] * n, [0] * n, [0] * n, [0.0] * n
        for c in children:
            if c:
                c.reverse()
                avg = sum(sub[i] for i in c) / len(c)
                for k, i in enumerate(c):
                    mates[i], mean[i] = len(c), avg
                    prev[i] = sub[c[k - 1]] if k else 0
                    nxt[i] = sub[c[k + 1]] if k + 1 < len(c) else 0
        out = np.zeros((n, N_FEATURES))
        f = np.array([own, sub, mean, prev, nxt], float)
        out[:, :5] = np.log1p(f).T
        up = np.maximum(self.parent, 0)
        sub_, link_ = f[1], np.array(sublink, float)
        out[:, 5] = link_ / np.maximum(sub_, 1)
        out[:, 6] = np.array(linked) / np.maximum(f[0], 1)
        out[:, 7] = np.log1p(sub_ / np.array(tags))
        out[:, 8] = self.depth
        out[:, 9] = np.maximum(first, 0) / total
        out[:, 10] = sub_ / total
        out[:, 11] = mates
        out[:, 12] = out[up, 5]
        out[:, 13] = out[up, 10]
        out[:, 14] = np.array(punct) / np.maximum(f[0], 1)
        out[:, 15] = np.log1p([len(c) for c in children])
        for j, kind in enumerate(_KINDS):
            out[:, 16 + j] = [t in kind for t in self.tag]
        for i in range(1, n):
            above[i] = above[self.parent[i]] | self.group[self.parent[i]]
        bits = 1 << np.arange(N_GROUPS)
        out[:, -2 * N_GROUPS:-N_GROUPS] = (np.array(self.group)[:, None] & bits) > 0
        out[:, -N_GROUPS:] = (np.array(above)[:, None] & bits) > 0
        return out

    def held(self, share: float = 0.8) -> np.ndarray:
        """Marked elements, and containers with at least ``share`` of their text in marked ones."""
        got = [self.own[i] if i in self.marked else 0 for i in range(len(self.tag))]
        for i in range(len(self.tag) - 1, 0, -1):
            got[self.parent[i]] += got[i]
        y = np.array([g >= share * t and t > 0 for g, t in zip(got, self.sub)])
        own = np.array(self.own) > 0
        y[own] = [i in self.marked for i in np.flatnonzero(own)]
        return y

    def decode(self, p: np.ndarray, enter: float = 1.0, leave: float = 3.0) -> list[int]:
        """The best role of each element: 2 article, 1 other, 0 around."""
        n = len(self.tag)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        w = self.weight
        yes, no = (w * np.log(p)).tolist(), (w * np.log1p(-p)).tolist()
        article, other, around = yes[:], no[:], no[:]
        for i in range(n - 1, 0, -1):
            q = self.parent[i]
            article[q] += max(article[i], other[i] - leave)
            other[q] += other[i]
            around[q] += max(article[i] - enter, other[i], around[i])
        role = [0] * n
        for i in range(1, n):
            up = role[self.parent[i]]
            if up == 1:
                role[i] = 1
            elif up == 2:
                role[i] = 2 if article[i] >= other[i] - leave else 1
            else:
                best = max(article[i] - enter, other[i], around[i])
                role[i] = 2 if article[i] - enter == best else 1 if other[i] == best else 0
        return role

    def text(self, role: list[int]) -> str:
        out: list[list[str]] = []
        last = None
        for block, node, text, _ in self.pieces:
            if role[node] == 2:
                if block != last:
                    out.append([])
                    last = block
                out[-1].append(text)
        lines = (" ".join("".join(b).split()) for b in out)
        return "\n".join(x for x in lines if x)


# --- boosted trees ---------------------------------------------------------------------------


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(len(y), self.base)
        size = 2 ** (self.depth + 1) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth + 1):
                lo, width = 2 ** level - 1, 2 ** level
                here = node - lo
                gs = np.bincount(here, g, width)
                hs = np.bincount(here, h, width)
                value[lo:lo + width] = gs / (hs + self.ridge)
                if level == self.depth:
                    break
                best = np.full(width, 1e-3)
                for j, cuts in enumerate(self.cuts):
                    if not len(cuts):
                        continue
                    cell = here * self.bins + b[:, j]
                    gl = np.bincount(cell, g, width * self.bins).reshape(width, -1).cumsum(1)[:, :-1]
                    hl = np.bincount(cell, h, width * self.bins).reshape(width, -1).cumsum(1)[:, :-1]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = (gl ** 2 / (hl + self.ridge) + gr ** 2 / (hr + self.ridge)
                            - (gs ** 2 / (hs + self.ridge))[:, None])
                    gain[(hl < 1e-2) | (hr < 1e-2)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    for i in np.flatnonzero(top > best):
                        best[i], feature[lo + i], cut[lo + i] = top[i], j, k[i]
                f = feature[node]
                right = (f >= 0) & (b[np.arange(len(y)), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            # an element without a split goes left all the way, with its own value
            for i in range(size // 2):
                if feature[i] < 0:
                    value[2 * i + 1] = value[2 * i + 2] = value[i]
            self.trees.append((feature, cut, value * self.rate))
            margin += self.rate * value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        rows, margin = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (b[rows, np.maximum(f, 0)] > cut[node]))
            margin += value[node]
        return 1 / (1 + np.exp(-margin))


# --- training pages --------------------------------------------------------------------------


def seed_roles(page: Page) -> list[int] | None:
    """The article by the elements' meaning, where a page says it: inside article or main, and not
    in a part of another kind. None where it doesn't."""
    if not any(t in ("article", "main") for t in page.tag):
        return None
    inside = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        up = inside[page.parent[i]]
        bad = page.group[i] & ~1 and page.tag[i] not in ("article", "main")
        inside[i] = 1 if up == 1 or bad else 2 if up == 2 or page.tag[i] in ("article", "main") else 0
    return inside


def _frame(rng: random.Random, blocks: list[str], prose: list[str], crumbs: list[str]) -> str:
    """A page around the article ``blocks``, each marked, with other parts from the pools."""
    esc = _html.escape

    def some(words: list[str]) -> str:
        return esc(rng.choice(words))

    def name(*options: str) -> str:
        return rng.choice(["class", "id"]) + f'="{rng.choice(options)}"'

    def link() -> str:
        return f'<a href="/{rng.randrange(999)}">{some(crumbs)}</a>'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
        return rng.choice([f"<nav><ul>{items}</ul></nav>", f"<div {name('menu', 'navbar', 'nav-top')}><ul>{items}</ul></div>",
                           f"<ul {name('menu', 'breadcrumbs', 'pagination')}>{items}</ul>",
                           f"<nav>{''.join(link() for _ in range(5))}</nav>"])

    def advert() -> str:
        body = some(prose) if rng.random() < 0.6 else link()
        return rng.choice([f"<div {name('ad', 'ads', 'advert', 'sponsored', 'promo-box', 'banner-ad')}>{body}</div>",
                           f"<aside {name('ad', 'promo')}><p>{body}</p></aside>"])

    def notice() -> str:
        return f"<div {name('cookie-notice', 'cookie-consent', 'notice', 'gdpr', 'alert', 'newsletter-popup')}><p>{some(prose)}</p><button>OK</button></div>"

    def side() -> str:
        inner = "".join(rng.choice([f"<p>{some(prose)}</p>", f"<li>{link()}</li>", f"<h3>{some(crumbs)}</h3>"]) for _ in range(rng.randint(2, 6)))
        return rng.choice([f"<aside>{inner}</aside>", f"<div {name('sidebar', 'side', 'widget', 'related', 'recommended')}>{inner}</div>",
                           f"<section {name('related', 'more', 'popular')}>{inner}</section>"])

    def form() -> str:
        return rng.choice([f"<form><label>{some(crumbs)}</label><input><p>{some(prose)}</p></form>",
                           f"<div {name('search', 'login', 'subscribe', 'newsletter')}><p>{some(prose)}</p><input></div>"])

    def comments() -> str:
        inner = "".join(rng.choice([f"<div {name('comment', 'reply')}><p>{some(prose)}</p></div>", f"<li><b>{some(crumbs)}</b><p>{some(prose)}</p></li>"])
                        for _ in range(rng.randint(1, 5)))
        return rng.choice([f"<section {name('comments', 'responses', 'discussion')}><h2>{some(crumbs)}</h2>{inner}</section>",
                           f"<div {name('comments', 'comment-list', 'disqus_thread', 'reader-comments')}>{inner}</div>",
                           f"<ol {name('commentlist', 'comments')}>{inner}</ol>"])

    def maybe(p: float, make) -> str:
        return make() if rng.random() < p else ""

    def body() -> str:
        out = []
        for k, b in enumerate(blocks):
            tag = rng.choice(["h1", "h1", "h2"]) if k == 0 else rng.choices(["p", "li", "blockquote", "h2", "div"], [20, 1, 1, 1, 2])[0]
            out.append(f"<{tag} {_TRUE}>{esc(b)}</{tag}>")
            if rng.random() < 0.06:
                out.append(rng.choice([advert, side, form])())
        return "".join(out)

    inner = body() + maybe(0.15, comments) + maybe(0.1, form) + maybe(0.1, side)
    if rng.random() < 0.3:
        inner = maybe(0.5, lambda: f"<div {name('meta', 'byline', 'share')}>{some(crumbs)}</div>") + f"<div>{inner}</div>"
    main = rng.choice([f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
                       f"<div {name('content', 'post', 'entry-content', 'story', 'article-body', 'main')}>{inner}</div>",
                       f"<div>{inner}</div>", f"<section>{inner}</section>", f"<table><tr><td>{inner}</td></tr></table>"])
    head = rng.choice(["", f"<header><h1>{some(crumbs)}</h1>{maybe(0.5, menu)}</header>",
                       f"<div {name('header', 'masthead', 'topbar')}><p>{some(crumbs)}</p></div>"])
    foot = rng.choice([f"<footer>&copy; {some(crumbs)} &middot; {some(prose)}</footer>", f"<div {name('footer', 'copyright')}><p>{some(prose)}</p></div>", ""])
    parts = [maybe(0.25, notice), head, maybe(0.8, menu), maybe(0.4, advert), maybe(0.3, side), main, maybe(0.35, comments),
             maybe(0.3, side), maybe(0.2, form), maybe(0.3, advert), foot, maybe(0.15, notice)]
    page = "".join(parts)
    if rng.random() < 0.4:
        page = f'<div class="{rng.choice(["wrap", "container", "outer"])}">{page}</div>'
    return f"<html><head><title>{some(crumbs)}</title></head><body>{page}</body></html>"


def train(pages: list[str], frames: int = 4, seed: int = 11) -> Boosted:
    """Trees from sampled pages and their framed articles."""
    rng = random.Random(seed)
    parsed = [Page(p) for p in pages]
    roles = [seed_roles(p) for p in parsed]
    xs, ys, ws, articles, prose, crumbs = [], [], [], [], [], []
    for page, role in zip(parsed, roles):
        x = page.features()
        if role is None:
            continue
        page.marked = {i for i, r in enumerate(role) if r == 2 and page.own[i]}
        xs.append(x)
        ys.append(page.held())
        ws.append(page.weight)
        article = [b for b in page.text(role).split("\n") if b]
        rest = page.text([2 if r != 2 else 1 for r in role]).split("\n")
        articles.append(article)
        prose += [b for b in rest + article if len(b) >= 40]
        crumbs += [b for b in rest if 0 < len(b) < 40]
    if not articles:
        articles = [[b for b in p.text([2] * len(p.tag)).split("\n") if b] for p in parsed]
        prose = [b for a in articles for b in a if len(b) >= 40]
    articles = [a for a in articles if a]
    prose, crumbs = prose or ["A line of text, as pages have."], crumbs or ["Home", "News"]
    for blocks in articles or [prose]:
        for _ in range(frames):
            page = Page(_frame(rng, blocks[:rng.choice([1, 2, 4, 60, 60])], prose, crumbs))
            xs.append(page.features())
            ys.append(page.held())
            ws.append(page.weight)
    x, y, w = np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws).astype(float)
    told = w > 0
    return Boosted().fit(x[told], y[told], w[told] / w[told].mean())


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = 400) -> Boosted:
    """The trees from a sample of about ``sample_pages`` pages, by hash of the id: that bounds what
    comes to the driver."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).where("html <> ''")
    share = min(1.0, sample_pages / max(rows.count(), 1))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return train(some.select("id", "html").distinct().orderBy("id", "html").toArrow().column("html").to_pylist())


SCHEMA = "id bigint, url string, text string, n_blocks int"


def extract_page(model: Boosted, sources: list[str | None]) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    features = [p.features() for p in pages]
    prob = model.predict(np.concatenate(features))
    cuts = np.cumsum([len(f) for f in features])[:-1]
    return [page.text(page.decode(p)) for page, p in zip(pages, np.split(prob, cuts))]


def extract(pages: DataFrame, model: Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_blocks) for every row of ``pages``: one narrow map over whole pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # rounds x nodes, bounded

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, values in texts(batch.column(2), 256):
                got = extract_page(shared.value, values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(got)), batch.column(1).slice(start, len(got)), pa.array(got, pa.string()),
                     pa.array([t.count("\n") + 1 if t else 0 for t in got], pa.int32())], ["id", "url", "text", "n_blocks"])

    return pages.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{url_col}` as string) url",
                            f"`{html_col}` html").mapInArrow(run, SCHEMA)
