"""Main text of HTML by flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. A block has its word count and link density, those
of its neighbours and of the container that holds it, and what encloses it (content or boilerplate elements,
telling names, headings, list items). A name tells little where its element holds most of the page, or the
page's heading or article: the share of the page's words under the innermost named element is the feature,
not the name itself, and a name with other words in it, or with a word such as "no" or "with" before it, is at
most a weak one. A decision tree, grown on the small labelled table that ``labelled_pages`` makes from
hand-written rules, says which blocks are main text.

Results for odd input: null html is empty and has an empty text; markup that is never closed lasts to
the end of the page; pages of any length are read whole, in one task that holds a few times the page;
repeated rows give equal texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, table

#: Elements whose content is never text of the page.
_DROPPED = "script|style|title|noscript|template|textarea|select|iframe|svg|object|canvas|audio|video|button|math"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_DROPPED})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?][^>]*>|<[/!?a-zA-Z][^>]*\Z", re.S | re.I)
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table thead tbody tfoot tr td th caption section article blockquote pre nav header footer aside form hr dl dt dd figure figcaption main body html head address fieldset legend details summary center menu dialog label option".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids: of what is hardly ever main text, of what may be either, of plain structure, and of what takes the meaning from a name.
_STRONG = re.compile(r"ads?|adv|advert\w*|adsense|sponsor\w*|promo(?:s|tions?|ted)?|sidebars?|comments?|commentlist|discussions?|disqus|repl(?:y|ies)|respond|footers?|masthead|nav|navbar|navigation|menus?|menubar|breadcrumbs?|cookies?|consent|gdpr|popups?|modals?|newsletters?|subscri\w*|shar(?:e|es|ing|ebar)|social|socials|related|recommend\w*|widgets?|toolbar|paginat\w*|pager|login|signup")
_WEAK = re.compile(r"banners?|notices?|alerts?|copyright|legal|disclaimer|search\w*|skip\w*|tags?|metadata|byline")
_PLAIN = frozenset("wrapper wrap container box block area section list item items inner outer content left right top bottom main primary secondary site page global post posts article articles user users reader readers slot unit bar links link icons icon buttons button media follow form text body header title more news panel col column row group holder zone module fixed sticky desktop mobile us side log sign pop up in thread count".split())
_VOIDING = frozenset("no not non with without has hide hides".split())
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Lines of ownership, if short.
_NOTICE = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_content", "in_boiler", "weak_name", "heading", "item", "notice", "name_share", "name_holds", "container_share", "container_links", "page_has_content")
#: Elements that hold text of one piece; what encloses them is their container.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li tr td th caption dt dd pre blockquote figcaption label option legend summary address center".split())
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)")


def name_strength(value: str) -> tuple[bool, bool]:
    """Whether a class or id has a strong name, and whether a weak one."""
    strong = weak = False
    for token in value.split():
        parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", token)]
        if not parts or parts[0] in _VOIDING:
            continue
        telling = [bool(_STRONG.fullmatch(x)) for x in parts]
        if _STRONG.fullmatch("".join(parts)) or any(telling) and all(t or x in _PLAIN or x.isdigit() or _WEAK.fullmatch(x) for t, x in zip(telling, parts)):
            strong = True
        elif any(telling) or any(_WEAK.fullmatch(x) for x in parts):
            weak = True
    return strong, weak


def _marks(tag: str, attributes: str, in_content: bool) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate by its tag, role or style, has a weak name, and has a strong one."""
    boiler, strong, weak = tag in _BOILER_TAGS or (tag == "header" and not in_content), False, False
    if not attributes or tag in ("body", "html"):
        return boiler, weak, strong
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name in ("class", "id"):
            found = name_strength(value)
            strong, weak = strong or found[0], weak or found[1]
        boiler |= name == "role" and value.lower() in _BOILER_ROLES or name == "style" and bool(re.search(r"display\s*:\s*none", value)) or name == "aria-hidden" and value == "true"
    return boiler or bool(_HIDDEN.search(attributes)), weak, strong


class _Open:
    """The open elements: how many are content, boilerplate or weakly named, and the words, links and content of every element."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[bool, ...], int]] = []
        self.counts = [0, 0, 0]
        # By element, the page itself first: words, words in links, whether it holds an article or the heading; open containers and strongly named ones.
        self.words, self.linked, self.holds = [0], [0], [False]
        self.containers, self.named = [0], [-1]

    def push(self, tag: str, marks: tuple[bool, ...], strong: bool = False) -> None:
        """``marks``: content, boilerplate, weak name."""
        at = len(self.words)
        self.words.append(0)
        self.linked.append(0)
        self.holds.append(marks[0] or tag == "h1")
        self.stack.append((tag, marks, at))
        self.counts = [c + m for c, m in zip(self.counts, marks)]
        self.containers.append(self.containers[-1] if tag in _LEAVES or tag not in _BLOCKS else at)
        self.named.append(at if strong else self.named[-1])

    def pop(self) -> str:
        tag, marks, at = self.stack.pop()
        self.counts = [c - m for c, m in zip(self.counts, marks)]
        self.containers.pop()
        self.named.pop()
        above = self.stack[-1][2] if self.stack else 0
        self.words[above] += self.words[at]
        self.linked[above] += self.linked[at]
        self.holds[above] |= self.holds[at]
        return tag

    def add(self, words: int, linked: int) -> None:
        at = self.stack[-1][2] if self.stack else 0
        self.words[at] += words
        self.linked[at] += linked

    def last(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def clear_forms(self) -> None:
        """A form around the whole content is no boilerplate."""
        if self.counts[1] and all(tag == "form" for tag, marks, _ in self.stack if marks[1]):
            self.stack = [(tag, (marks[0], False, marks[2]), at) for tag, marks, at in self.stack]
            self.counts[1] = 0


def text_blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of the flat blocks in page order, and their features."""
    texts, rows, places, parts, linked = [], [], [], [], []
    open_, in_link = _Open(), False
    heading = item = any_content = False

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = len(text.split())
            in_links = len(html.unescape(" ".join(linked)).split())
            texts.append(text)
            rows.append((n, min(1.0, in_links / n), *(c > 0 for c in open_.counts), heading, item, n < 30 and bool(_NOTICE.search(text))))
            places.append((open_.named[-1], open_.containers[-1]))
            open_.add(n, min(n, in_links))
        parts, linked = [], []

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), m[2] == "/"
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag not in _BLOCKS:
            boiler, weak, strong = _marks(tag, m[4], open_.counts[0] > 0) if tag not in _VOID and not closing and m[4] else (False, False, False)
            if boiler or weak or strong:
                flush()
                open_.push(tag, (False, boiler, weak), strong)
            elif closing and open_.last() == tag:
                flush()
                open_.pop()
            continue
        flush()
        in_link = False
        if closing:
            if any(tag == name for name, *_ in open_.stack):
                while open_.pop() != tag:
                    pass
            heading, item = False, False
            continue
        if tag in _VOID:
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_.last() == tag:
            open_.pop()
        is_content = tag in _CONTENT_TAGS or bool(m[4] and re.search(r"role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articleBody", m[4], re.I))
        boiler, weak, strong = _marks(tag, m[4], open_.counts[0] > 0 or is_content)
        if is_content and not boiler:
            open_.clear_forms()
        open_.push(tag, (is_content, boiler, weak), strong)
        any_content |= is_content
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        item = tag in ("li", "td", "th", "dt", "dd", "option")
    parts.append(page[at:])
    flush()
    while open_.stack:
        open_.pop()
    if not rows:
        return [], np.zeros((0, len(FEATURES)))
    own, (named, container) = np.array(rows, np.float64), np.array(places).T
    words, in_links, holds = np.array(open_.words, np.float64), np.array(open_.linked), np.array(open_.holds)
    around = np.stack([np.where(named < 0, 2.0, words[named] / words[0]), (named >= 0) & holds[named], words[container] / words[0], in_links[container] / words[container], np.full(len(own), any_content)], axis=1)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1, :2]]), np.concatenate([own[1:, :2], edge])
    return texts, np.concatenate([own[:, :2], before, after, own[:, 2:], around], axis=1)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 3):
    """A CART by Gini impurity: (feature, threshold, left, right), or the share of main text at a leaf."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= least) & (len(y) - cut >= least)]
        if len(cut):
            left, right = t[cut - 1] / cut, (t[-1] - t[cut - 1]) / (len(y) - cut)
            impurity = cut * left * (1 - left) + (len(y) - cut) * right * (1 - right)
            i = int(np.argmin(impurity))
            if best is None or impurity[i] < best[0] - 1e-9:
                best = (impurity[i], f, (v[cut[i] - 1] + v[cut[i]]) / 2)
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-9:
        return float(y.mean())
    side = x[:, best[1]] <= best[2]
    return best[1], best[2], grow_tree(x[side], y[side], depth - 1, least), grow_tree(x[~side], y[~side], depth - 1, least)


def predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree >= 0.5)
    f, threshold, low, high = tree
    side = x[:, f] <= threshold
    out = np.zeros(len(x), bool)
    out[side], out[~side] = predict(low, x[side]), predict(high, x[~side])
    return out


_WORDS = "the committee met for three hours on tuesday and agreed after much debate that a bridge should be repaired before winter while engineers warned in spring of two piers losing ground to their river so every report was read aloud".split()


def labelled_pages(pages: int = 3000, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Labelled pages: the markup, and for each of its blocks whether it is main text (1) or not (0).

    Hand-written rules: runs of headings, paragraphs, quotes, lists and tables are main text, with lines of one
    link among them; menus, rows of links, adverts, notices, footers, sidebars, forms, shares and readers'
    comments are not. Half of the pages have no telling elements. Main text now and then has a name that could
    be either, or stands with most of the page in a wrapper whose name would tell of something else.
    """
    rng = random.Random(seed)
    few = lambda a, b: " ".join(rng.choice(_WORDS) for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", "!", "?", ""])
    link = lambda a=1, b=3: f"<a href='/{rng.randint(1, 99)}'>{few(a, b)}</a>"

    def run(semantic: bool) -> list[tuple[str, list[int]]]:
        """Blocks of main text."""
        out = [(f"<h1>{few(2, 9)}</h1>", [1])] if rng.random() < 0.8 else []
        for _ in range(rng.randint(0 if semantic else 2, 9)):
            kind = rng.random()
            if kind < 0.45:
                out.append((f"<p>{few(18, 90)}</p>", [1]))
            elif kind < 0.65:
                out.append((f"<p>{few(1, 9)}</p>", [1]))
            elif kind < 0.71:
                out.append((f"<p>{few(8, 40)} {link()} {few(4, 20)}</p>", [1]))
            elif kind < 0.72:  # prose with many links in it
                out.append((f"<p>{' '.join(f'{few(5, 12)} {link()}' for _ in range(rng.randint(3, 9)))}</p>", [1]))
            elif kind < 0.73:
                out.append((f"<p>{few(1, 2)} {link(1, 4)} {few(0, 2)}</p>", [1]))
            elif kind < 0.75:
                out += [(rng.choice(["<p>{}</p>", "{}"]).format(few(12, 60)), [1]), (f"<p>{link(1, 6)}</p>", [1]), (f"<p>{few(2, 60)}</p>", [1])]
            elif kind < 0.8:
                out.append((f"<blockquote>{few(3, 30)}</blockquote>", [1]))
            elif kind < 0.85:
                out.append((f"<h2>{few(1, 6)}</h2>", [1]))
            elif kind < 0.9:
                out.append(("<ul>" + "".join(f"<li>{few(1, 12)}</li>" for _ in range(3)) + "</ul>", [1] * 3))
            elif kind < 0.94:
                out.append((f"<table><tr><td>{few(1, 3)}</td><td>{few(1, 3)}</td></tr></table>", [1] * 2))
            elif kind < 0.97:
                out.append((f"<div class='{rng.choice(['legal', 'notice', 'search-results', 'tags-explained'])}'><p>{few(18, 60)}</p></div>", [1]))
            else:
                out.append((f"<p id='search-party'>{few(6, 40)}</p>", [1]))
            if rng.random() < 0.12:  # within the main text, but none of it
                name = rng.choice(["comments", "user-discussion", "share", "newsletter", "related", "ad-slot", "sidebar"])
                inner = [(f"<p>{few(2, 50)}</p>", [0]) for _ in range(rng.randint(1, 3))]
                out += [(f"<div class='{name}'>" + "".join(x for x, _ in inner) + "</div>", [0] * len(inner))]
            if rng.random() < 0.06:  # a heading of links
                n = rng.randint(2, 6)
                out.append((f"<h3>{few(1, 3)}</h3><ul>{''.join(f'<li>{link()}</li>' for _ in range(n))}</ul>", [0] * (n + 1)))
            if rng.random() < 0.08:
                inner_tag = rng.choice(["aside", "form", "nav", "footer"])
                out.append((f"<{inner_tag}>{few(1, 30)}</{inner_tag}>", [0]))
            if rng.random() < 0.12:
                out.append((f"<p>{' '.join(link() for _ in range(rng.randint(5, 12)))}</p>", [0]))
            if rng.random() < 0.04:  # a name with other words in it
                out.append((f"<div class='{rng.choice(['social-history', 'comments-on-the-law', 'naval-menus', 'footer-of-the-hill'])}'><p>{few(4, 60)}</p></div>", [1]))
            if rng.random() < 0.03:
                out.append((f"<p>{few(10, 30)} Copyright {few(20, 40)}</p>", [1]))
            if semantic and rng.random() < 0.05:  # within an article it is the article's
                out.append((f"<p>{rng.choice(['All rights reserved.', f'Copyright 2020 {few(1, 3)}', f'© {few(1, 4)} All rights reserved.'])}</p>", [1]))
        if not out or not semantic and not any(len(x.split()) > 16 for x, _ in out):
            out.append((f"<p>{few(18, 60)}</p>", [1]))
        return out

    def menu() -> tuple[str, list[int]]:
        n = rng.randint(3, 8)
        return (f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(n))}</ul>", [0] * n) if rng.random() < 0.6 else (f"<div>{' '.join(link() for _ in range(n))}</div>", [0])

    def outside(semantic: bool, last: bool) -> list[tuple[str, list[int]]]:
        """Blocks beside the main text: of pages without telling elements, such as rows of links and names tell."""
        menu_markup, marks = menu()
        some = [(f"<nav>{menu_markup}</nav>" if semantic else menu_markup, marks)]
        name = rng.choice(["ad", "cookie-notice", "sidebar", "footer", "social", "promo"])
        if rng.random() < 0.6:
            some.append((f"<div class='{name}'>{few(3, 40)}</div>", [0]))
        if rng.random() < 0.4 and not last:
            more, zeros = menu()
            some.append((f"<div>{few(1, 3)}</div>{more}", [0, *zeros]) if rng.random() < 0.5 else (f"{more}<div>{few(1, 3)}</div>", [*zeros, 0]))
        for _ in range(rng.choice([0, 1, 1, 2]) if semantic else 0):
            some.append(rng.choice([(f"<aside><h3>{few(1, 3)}</h3><p>{few(10, 60)}</p></aside>", [0, 0]), (f"<footer>{few(4, 30)}</footer>", [0]), (f"<footer>&copy; {few(4, 30)}</footer>", [0]), (f"<form><p>{few(2, 20)}</p></form>", [0]), (f"<div>{few(3, 40)}</div>", [0])]))
        if rng.random() < 0.3:
            some.append((f"<div class='{rng.choice(['legal', 'copyright', 'notice', 'banner'])}'>{few(3, 12)}</div>", [0]))
        if last and rng.random() < 0.35:
            mark = rng.choice(["Copyright 2020", "© 2019", "(c) 2021", "Copyright ©"])
            some.append((rng.choice(["<div>{}</div>", "<p>{}</p>", "{}<br>"]).format(f"{mark} {few(1, 4)} {rng.choice(['All rights reserved.', ''])}"), [0]))
        if last and rng.random() < 0.25:  # more words than the article may have
            n = rng.randint(2, 8)
            some.append((f"<section class='{rng.choice(['comments', 'comment-list', 'related-posts', 'sidebar', 'user-comments'])}'>{''.join(f'<p>{few(1, rng.choice([4, 50]))}</p>' for _ in range(n))}</section>", [0] * n))
        rng.shuffle(some)
        return some

    misleading = ["page no-sidebar", "layout sidebar-right", "main with-sidebar", "widget-content", "comments-on-the-law", "nav-left", "has-menu", "sidebar-layout menu", "social-page", "footer-fixed"]
    made = []
    for i in range(pages):
        semantic = i % 2 == 0
        inside = run(semantic)
        if semantic and rng.random() < 0.15:
            inside = [(f"<{(t := rng.choice(['h1', 'p']))}>{few(1, 9)}</{t}>", [1]) for _ in range(rng.randint(1, 2))]
        body, marks = "".join(x for x, _ in inside), [m for _, ms in inside for m in ms]
        tag = rng.choice(["article", "main"]) if semantic else "div"
        before, after = (outside(semantic, last) if rng.random() < 0.65 else [] for last in (False, True))
        wrap = rng.random()
        if wrap < 0.1 and sum(marks) == len(marks):  # the article's own element is misnamed; it is most of the page
            open_, before, after = f"<{tag} class='{rng.choice(misleading)}'>", [], after if len(body.split()) > 400 else []
        else:
            open_ = f"<{tag}>"
        whole = "".join(x for x, _ in before), f"{open_}{body}</{tag}>", "".join(x for x, _ in after)
        if 0.1 <= wrap < 0.2 and (semantic or "<h1>" in body):  # what tells is within
            name = rng.choice(misleading)
            page = f"<div class='{name}'>{''.join(whole)}</div>" if rng.random() < 0.5 else f"{whole[0]}<div class='{name}'>{whole[1]}</div>{whole[2]}"
        else:
            page = "".join(whole)
        made.append((page, [m for _, ms in before for m in ms] + marks + [m for _, ms in after for m in ms]))
    return made


@lru_cache(maxsize=1)
def trained_tree():
    xs, ys = [], []
    for page, marks in labelled_pages():
        texts, x = text_blocks(page)
        if len(marks) != len(texts):
            raise ValueError(f"{len(texts)} blocks, {len(marks)} labels: {texts}")
        xs.append(x)
        ys.append(marks)
    return grow_tree(np.concatenate(xs), np.concatenate(ys))


def used_features(tree) -> set[str]:
    return set() if isinstance(tree, float) else {FEATURES[tree[0]]} | used_features(tree[2]) | used_features(tree[3])


def main_text(page: str, tree=None) -> str:
    texts, x = text_blocks(page)
    return "\n".join(t for t, keep in zip(texts, predict(tree or trained_tree(), x)) if keep)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` and text, the main text of each page."""
    tree = trained_tree()
    rows = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("_raw"))
    return map_columns(rows, keep, "text string", lambda batch: [[main_text(raw.decode("utf-8", "replace"), tree) for raw in batch.column("_raw").to_pylist()]])


def op3_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
