"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text that no block-level tag interrupts. Each block has features of its
ancestors (tag names, words of class, id and role) and of its text (length, share of text in links, punctuation,
neighbours' lengths). A two-label chain (text of the article or not) is trained by maximum likelihood on labelled
pages and decoded by Viterbi. ``labelled_pages`` writes the training pages: layouts of many kinds with invented words,
in which the elements of the article carry the label as an attribute that no feature reads.

Scripts, styles, templates, frames, fields, comments of the markup and the document's head are no text; formulas, drawings and what stands in for scripts
or objects are blocks like others. Character references are decoded, white
space inside a block (line breaks too) becomes one space, blocks are trimmed and joined by one newline in page order.

A null or empty page gives an empty text, and so does a page without article blocks. Unclosed and stray tags are
tolerated; a tag that never ends runs to the next ``<``. Pages of any length are read whole. Repeated rows are treated each
for itself; other columns are not read.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe".split())
#: Elements that end when one of the second set begins.
ENDS = {
    "p": BLOCK - {"button", "label", "option"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "head": {"body"},
}
SECTIONS = ("article", "main", "section", "nav", "aside")
_ENDED_BY = {tag: [t for t, by in ENDS.items() if tag in by] for tag in BLOCK}
#: An element that opened further out than these is not closed from inside them.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "li", "div", "section", "article", "blockquote"}}
#: A quoted value may hold < and > if what follows its end can follow a value; otherwise the quote was never closed.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^><=]++|=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|"[^"<>]*+"|'[^'<>]*+')|=)*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    """An open element. ``fresh`` are the features that it has and none around it has, so a path's features are those of its elements, each once."""

    __slots__ = ("tag", "parent", "fresh", "own", "label", "score")

    def __init__(self, tag: str, parent: Element | None, fresh: tuple[str, ...], label: int):
        self.tag, self.parent, self.fresh, self.label = tag, parent, fresh, label
        self.own: str = tag if tag in BLOCK else parent.own if parent else "none"
        self.score: tuple[float, float] | None = None

    def features(self) -> list[str]:
        """Of the whole path."""
        out, at = [], self
        while at:
            out += at.fresh
            at = at.parent
        return out

    def scored(self, weights: dict[str, tuple[float, float]]) -> tuple[float, float]:
        """The sum of the weights of the path's features, worked out once for each element."""
        todo, at = [], self
        while at and at.score is None:
            todo.append(at)
            at = at.parent
        e0, e1 = at.score if at else (0.0, 0.0)
        for at in reversed(todo):
            for f in at.fresh:
                if (w := weights.get(f)) is not None:
                    e0, e1 = e0 + w[0], e1 + w[1]
            at.score = (e0, e1)
        return e0, e1


class Block:
    __slots__ = ("text", "linked", "at", "label")

    def __init__(self, text: str, linked: int, at: Element | None, label: int):
        self.text, self.linked, self.at, self.label = text, linked, at, label


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks that have text, in page order."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[Element] = []
    parts: list[str] = []
    linked, links = 0, 0
    opened: dict[str, list[int]] = {}  # where in the stack each tag is
    on_path: set[str] = set()

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, stack[-1] if stack else None, stack[-1].label if stack else 0))
            parts, linked = [], 0

    def close(depth: int) -> None:
        nonlocal links
        if any(s.tag in BLOCK for s in stack[depth:]):
            flush()
        for s in stack[depth:]:
            opened[s.tag].pop()
            on_path.difference_update(s.fresh)
        links = len(opened.get("a", ()))
        del stack[depth:]

    def innermost(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    at, lower = 0, None
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                close(opened[tag][-1])
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if tag in BLOCK:
                flush()
            if not m[0].endswith("/>"):
                if lower is None:
                    lower = page.lower() if len(page.lower()) == len(page) else page
                end = lower.find(f"</{tag}", at)
                at = len(page) if end < 0 else end
                stop = page.find(">", at)
                at = len(page) if stop < 0 else stop + 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            depth = innermost(_ENDED_BY[tag])
            if depth >= 0 and depth > innermost(SECTIONS) and depth > innermost(WALLS.get(tag, ())):
                close(depth)
        if tag in VOID or m[0].endswith("/>"):
            continue
        words, label = [], stack[-1].label if stack else 0
        if "=" in m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-main":
                    label = int(value == "1")
                else:
                    words += [w.lower() for w in _PART.findall(value)]
        own = dict.fromkeys([f"tag {tag}", *(f"word {w}" for w in words), *(f"start {w[:k]}" for w in words for k in (4, 6) if len(w) > k)])
        fresh = tuple(f for f in own if f not in on_path)
        on_path.update(fresh)
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, stack[-1] if stack else None, fresh, label))
        links = len(opened.get("a", ()))
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has, of its text and of its ancestors."""
    return [f + (b.at.features() if b.at else []) for b, f in zip(blocks, text_features(blocks), strict=True)]


def text_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that are not its ancestors'."""
    out = []
    sizes = [len(b.text.split()) for b in blocks]
    long = sum(n >= 12 for n in sizes)
    for i, b in enumerate(blocks):
        n, f = sizes[i], ["any"]
        f.append(f"own {b.at.own if b.at else 'none'}")
        f.append("size " + str(min(6, n.bit_length())))
        share = b.linked / max(1, len(b.text))
        f.append("linked " + ("none" if share == 0 else "some" if share < 0.5 else "most"))
        f.append("end " + ("stop" if b.text[-1] in ".!?…\"”'" else "colon" if b.text[-1] == ":" else "open"))
        if "©" in b.text:
            f.append("copyright")
        if n >= 12 and share < 0.3:
            f.append("prose")
        for d in (-1, 1):
            if 0 <= i + d < len(blocks):
                f.append(f"near {d} " + ("long" if sizes[i + d] >= 12 else "short"))
            else:
                f.append(f"near {d} edge")
        f.append("page " + ("short" if long <= 1 else "long"))
        out.append(f)
    return out


# --- labelled pages -----------------------------------------------------------------------------------------------

_SYLLABLES = "the er in on re an ou ti ra lo mi ka ent ing sch ei un que la de es ción para mento ado pro kri von tal".split()
#: What the parts of a page that are not the article are called: (tags, words of class and id).
_PARTS = {
    "menu": ("nav div ul menu", "nav navbar menu navigation topnav main-nav site-nav breadcrumb breadcrumbs pagination pager tabs links skip toc-menu"),
    "header": ("header div", "header site-header masthead topbar page-header branding logo hero-banner"),
    "footer": ("footer div", "footer site-footer page-footer bottom colophon copyright legal foot imprint credits"),
    "sidebar": ("aside div section", "sidebar side-bar aside widget widgets rail right-column secondary related related-posts popular recommended more-stories archive tags tag-cloud trending latest"),
    "notice": ("div section aside dialog p", "notice cookie cookie-banner cookies consent gdpr alert message privacy-notice warning banner popup modal overlay subscribe-notice paywall announcement disclaimer"),
    "advert": ("div aside section ins iframe p", "ad ads advert advertisement adsense ad-slot sponsor sponsored promo promotion promoted commercial partner banner-ad outbrain taboola"),
    "form": ("form div section fieldset", "form search search-box searchform login signin newsletter subscribe signup contact-form poll feedback"),
    "comments": ("section div ol ul aside", "comments comment comment-list comment-body comment-thread replies reply respond discussion disqus user-comments reader-comments responses reviews"),
    "share": ("div ul", "share social sharing share-buttons follow social-links print tools toolbar meta-links"),
}
_ARTICLE = ("article main div section", "article content main post post-content entry entry-content article-body story story-body text body-text page-content prose main-content hentry single")


def labelled_pages(n: int = 500, seed: int = 7, unknown_names: bool = False) -> list[str]:
    """Invented pages in which ``data-main`` marks the elements of the article (1) and what is not (0).

    unknown_names: class names and ids are invented words that say nothing, other ones on each page.
    """
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))

    def words(a: int, b: int) -> str:
        k = r.randint(a, b)
        sep = r.choice([" ", " ", " ", " ", " | ", "!! ", "### ", "&amp;&amp; "])
        return sep.join(word() for _ in range(k))

    def sentence(a: int = 3, b: int = 14) -> str:
        return words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 9])))

    def attributes(names: str) -> str:
        if r.random() < 0.3:
            return ""
        name = r.choice(names.split())
        if r.random() < 0.25:
            name += r.choice([" box", " wrap", "-1", " col-md-4", " clearfix", "-inner", "__item"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def links(k: int) -> str:
        kind = r.randint(0, 3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(k)) + "</ul>"
        if kind == 1:
            return " ".join(link(words(1, 2)) for _ in range(k))
        if kind == 2:
            return "".join(f"<p>{link(words(2, 8))}</p>" for _ in range(k))
        return "<ul>" + "".join(f"<li>{link(words(1, 3))}" for _ in range(k)) + "</ul>"

    def wrapped(kind: str, inner: str) -> str:
        tags, names = _PARTS[kind]
        tag = r.choice(tags.split())
        if tag == "iframe" or (tag in ("p", "ul", "ol", "menu") and "<" in inner):
            tag = "div"
        attribute = attributes(names)
        if tag in ("div", "section", "p", "ul", "ol") and not attribute:
            attribute = f' class="{r.choice(names.split())}"'
        return f'<{tag}{attribute} data-main="0">{inner}</{tag}>'

    def part(kind: str) -> str:
        if kind == "menu":
            return wrapped(kind, links(r.randint(2, 9)))
        if kind == "header":
            return wrapped(kind, r.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{sentence(2, 7)}</p>", link(words(1, 3)), f"<div>{words(1, 5)}</div>"]) + r.choice(["", f"<p>{sentence(2, 9)}</p>", links(4)]))
        if kind == "footer":
            return wrapped(kind, r.choice([f"&copy; {words(1, 4)} &middot; {sentence(2, 12)}", f"<p>&copy; {words(2, 5)}</p>{links(3)}", f"<p>{paragraph()}</p>", links(5), sentence(3, 12)]))
        if kind == "sidebar":
            return wrapped(kind, r.choice([f"<h3>{words(1, 3)}</h3>", f"<h2>{words(1, 3)}</h2>", ""]) + r.choice([links(r.randint(2, 7)), f"<p>{paragraph()}</p>", f"<div>{sentence(4, 20)}</div>", sentence(4, 20)]))
        if kind in ("notice", "advert"):
            return wrapped(kind, r.choice([sentence(3, 16), f"<p>{paragraph()}</p>", f"<p>{sentence(4, 14)}</p><button>{words(1, 2)}</button>", f"{sentence(3, 9)} {link(words(1, 3))}", f"<div>{paragraph()}</div>"]))
        if kind == "form":
            return wrapped(kind, f"<form>{r.choice(['<label>' + words(1, 4) + '</label>', sentence(3, 12), '<p>' + sentence(4, 15) + '</p>', ''])}<input name=q>{r.choice(['<select><option>' + words(1, 2) + '<option>' + words(1, 2) + '</select>', ''])}<button>{words(1, 2)}</button></form>")
        if kind == "comments":
            one = lambda: r.choice(["<div class=\"comment\">{}</div>", "<li>{}</li>", "<article class=\"comment\">{}</article>", "<div>{}</div>"]).format(f"{r.choice(['<b>' + words(1, 2) + '</b>', '<h4>' + words(1, 3) + '</h4>', ''])}<p>{paragraph()}</p>")
            return wrapped(kind, r.choice(["<h3>" + words(1, 3) + "</h3>", ""]) + "".join(one() for _ in range(r.randint(1, 5))))
        return wrapped(kind, links(r.randint(2, 5)))

    def article() -> str:
        body = [f"<h1>{words(3, 12)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.2:
            body.append(f'<p class="{r.choice("byline author meta date".split())}">{words(2, 5)}</p>')
        for _ in range(r.choice([1, 1, 2, 4, 7, 12])):
            kind = r.random()
            if kind < 0.62:
                text = paragraph()
                if r.random() < 0.2:
                    text += " " + link(words(1, 4)) + " " + sentence()
                body.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p>{}<br></p>"]).format(text))
            elif kind < 0.7:
                body.append(f"<h{(h := r.randint(2, 4))}>{words(1, 6)}</h{h}>")
            elif kind < 0.78:
                body.append("<ul>" + "".join(f"<li>{sentence(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.83:
                body.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(paragraph())}</blockquote>")
            elif kind < 0.87:
                body.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.9:
                body.append(f"<pre>{words(4, 20)}</pre>")
            elif kind < 0.93:
                body.append(f"<figure><img src=x><figcaption>{sentence(3, 10)}</figcaption></figure>")
            else:
                body.append(part(r.choice("advert share notice form sidebar".split())))
        tags, names = _ARTICLE
        tag, inner = r.choice(tags.split()), "".join(body)
        out = f'<{tag}{attributes(names)} data-main="1">{inner}</{tag}>'
        if r.random() < 0.3:
            out = f"<{r.choice(['main', 'div'])}{attributes('main content container page wrapper')}>{out}"
        return out

    pages = []
    for _ in range(n):
        before = [part(k) for k in r.sample("menu header notice advert form sidebar".split(), r.randint(0, 4))]
        after = [part(k) for k in r.sample("comments sidebar share advert form menu notice".split(), r.randint(0, 4))]
        if r.random() < 0.8:
            after.append(part("footer"))
        title = f"<title>{words(2, 9)}</title>" if r.random() < 0.9 else ""
        page = f"<!DOCTYPE html><html><head data-main=\"0\">{title}<style>p{{}}</style></head><body>{''.join(before)}{article()}{''.join(after)}</body></html>"
        if unknown_names:
            called: dict[str, str] = {}
            page = re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="{" ".join(called.setdefault(w, "x" + word() + word()) for w in m[2].split())}"', page)
        pages.append(page)
    return pages


# --- the chain ----------------------------------------------------------------------------------------------------


def expectations(e: np.ndarray, live: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains side by side: label marginals, sums of pair marginals, log partition values.

    e: (chains, places, 2) scores of labels; live: which places a chain has; move: scores of neighbouring labels.
    """
    top = lambda x, axis: np.logaddexp.reduce(x, axis)
    longest = e.shape[1]
    a, b = e.copy(), np.zeros_like(e)
    for t in range(1, longest):
        a[:, t] = np.where(live[:, t, None], e[:, t] + top(a[:, t - 1, :, None] + move, 1), a[:, t - 1])
    for t in range(longest - 2, -1, -1):
        b[:, t] = np.where(live[:, t + 1, None], top(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
    z = top(a[:, -1], 1)
    p = np.exp(a + b - z[:, None, None]) * live[..., None]
    both = live[:, 1:] & live[:, :-1]
    q = np.exp(a[:, :-1, :, None] + move + (e + b)[:, 1:, None, :] - z[:, None, None, None])[both].sum(0)
    return p, q, z


def train(pages: list[str], steps: int = 150, decay: float = 0.02) -> dict:
    """Maximum likelihood with a Gaussian prior; all pages are run through forward-backward side by side."""
    seqs = [b for p in pages if (b := leaf_blocks(p))]
    seqs.sort(key=len, reverse=True)
    named = [features(s) for s in seqs]
    seen: dict[str, int] = {}
    for f in (f for s in named for b in s for f in b):
        seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, k in seen.items() if k >= 3))}
    n, longest = len(seqs), max(map(len, seqs), default=0)
    cell, col = [], []
    gold = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, s in enumerate(named):
        for t, fs in enumerate(s):
            gold[i, t], live[i, t] = seqs[i][t].label, True
            for f in fs:
                if f in index:
                    cell.append(i * longest + t)
                    col.append(index[f])
    cell, col = np.array(cell, np.int64), np.array(col, np.int64)
    w, move = np.zeros((len(index), 2)), np.zeros((2, 2))
    truth = np.eye(2)[gold] * live[..., None]
    pairs = np.zeros((2, 2))
    both = live[:, 1:] & live[:, :-1]
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, steps + 1):
        e = np.stack([np.bincount(cell, w[col, y], n * longest) for y in (0, 1)], 1).reshape(n, longest, 2)
        p, q, _ = expectations(e, live, move)
        d = (p - truth).reshape(-1, 2)
        gw = np.stack([np.bincount(col, d[cell, y], len(index)) for y in (0, 1)], 1) + decay * w
        gm = q - pairs + decay * move
        for k, (x, g) in enumerate(((w, gw), (move, gm))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"weights": {f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, "move": move.tolist()}


def viterbi(model: dict, named: list[list[str]], above: list[tuple[float, float]] | None = None) -> list[int]:
    """The likeliest labels of a page's blocks, from the names of their features; above: sums of weights that come on top of these."""
    weights, move = model["weights"], model["move"]
    s0 = s1 = 0.0
    back: list[tuple[int, int]] = []
    for t, fs in enumerate(named):
        e0, e1 = above[t] if above else (0.0, 0.0)
        for f in fs:
            if (w := weights.get(f)) is not None:
                e0 += w[0]
                e1 += w[1]
        if t:
            a0, b0, a1, b1 = s0 + move[0][0], s1 + move[1][0], s0 + move[0][1], s1 + move[1][1]
            back.append((int(b0 > a0), int(b1 > a1)))
            s0, s1 = e0 + max(a0, b0), e1 + max(a1, b1)
        else:
            s0, s1 = e0, e1
    if not named:
        return []
    y = int(s1 > s0)
    out = [y]
    for pair in reversed(back):
        out.append(y := pair[y])
    return out[::-1]


def main_text(model: dict, page: str | None) -> str:
    blocks = leaf_blocks(page)
    above = [b.at.scored(model["weights"]) if b.at else (0.0, 0.0) for b in blocks]
    return "\n".join(b.text for b, y in zip(blocks, viterbi(model, text_features(blocks), above), strict=True) if y)


@functools.cache
def default_model() -> dict:
    """The model of the module's own labelled pages, trained once for each process that asks."""
    return train(labelled_pages())


def extract(pages: DataFrame, model: dict | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, text) of each page; without a model one is trained on the labelled pages."""
    model = model or default_model()
    names = ["id", *(f"k{i}" for i in range(len(keep))), "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 200):
                part = b.slice(lo, 200)
                texts = pa.array((main_text(model, x.as_py()) for x in part[len(keep) + 1]), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*names[:-1], "text"])

    frame = pages.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).cast("string").alias("html"))
    out = frame.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'id' else 'string'}" for n in [*names[:-1], "text"]))
    return out.toDF(id_col, *keep, "text")
