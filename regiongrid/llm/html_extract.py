"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

The page is scanned into leaf blocks: runs of text between block boundaries, each
with the tags and the class, id and role words of its ancestors. A two-label CRF
(text of the article or not) with ancestor and text features and transition
weights is trained on labelled pages and decoded by Viterbi. Text features are
length, links, sentence ends, those of the neighbours, the place among headings, and
whether the block lies in the element that holds most running text, so pages whose
names say nothing are read as well. The labelled pages are built from site layouts by
a seeded generator (``labelled_pages``), part of them with meaningless names; callers
may train on their own.

Defined results: null and empty html give an empty text; repeated rows give equal
rows; an empty table gives an empty table; broken markup is read as far as it
goes; other columns, whatever their names, are ignored. Whole pages are read, nothing
is capped; a very long page takes some ten times its bytes of memory.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td textarea tfoot th thead title tr ul iframe object video audio canvas svg template noscript".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script noscript style title head template xmp iframe noembed noframes svg object select textarea".split())
ENDS_P = BLOCKS - {"button", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "select"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article section div body main aside nav td th blockquote form fieldset".split())


# Usual names of page parts in class and id attributes.
OUTSIDE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar links",
    "header": "header masthead banner top logo brand",
    "footer": "footer bottom copyright legal colophon",
    "aside": "sidebar aside widget related recommended trending popular",
    "div": "ad ads advert advertisement sponsor sponsored promo cookie consent notice alert popup modal banner newsletter subscribe share social tags byline meta pagination gdpr",
    "form": "form login search signup subscribe contact",
    "section": "comments comment commentlist comment-list replies reply discussion disqus disqus_thread utterances giscus reviews respond responses feedback guestbook",
}
REMARK = "comment reply response review remark"
INSIDE = "content article post entry story body main text page single"
NEUTRAL = "wrapper wrap container row col col-8 col-md-9 inner outer site layout grid box section region center left right primary block area"
STEMS = "comment nav menu foot side widget relat cookie consent advert sponsor promo newsletter subscri share social login search breadcrumb banner article content entry discuss disqus repl review respon feedback".split()


def _stems(word: str) -> list[str]:
    return [f"stem={x}" for x in STEMS if x in word]


Block = tuple[str, tuple[str, ...], float, tuple[int, ...]]


def leaf_blocks(page: str | None) -> list[Block]:
    """(text, ancestor features, share of link text, numbers of the ancestors) of the leaf blocks in page order."""
    page = page or ""
    lower = page.lower() if "<" in page else ""
    if len(lower) != len(page):  # some capitals change length
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), page)
    stack: list[tuple[str, tuple[str, ...], int]] = []
    out: list[Block] = []
    texts: list[str] = []
    linked = hidden = number = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = SPACE.sub(" ", "".join(texts)).strip()
            if text:
                out.append((text, tuple(f for _, fs, _ in stack for f in fs), min(1.0, linked / len(text)), tuple(n for _, _, n in stack)))
            texts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal hidden
        if any(tag in BLOCKS for tag, _, _ in stack[depth:]):
            flush()
        for tag, _, _ in stack[depth:]:
            hidden -= tag in UNSEEN
        del stack[depth:]

    def close(names, fences=frozenset()) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                pop_to(depth)
                return
            if stack[depth][0] in fences:
                return

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            text = entities.unescape(text)
            texts.append(text)
            if any(tag == "a" for tag, _, _ in stack):
                linked += len(text)

    at = 0
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        m = TOKEN.match(page, begin)
        if m is None:
            if begin + 1 < len(page) and (page[begin + 1].isalpha() or page[begin + 1] == "/"):
                end = page.find(">", begin)  # a tag with a stray quote
                at = len(page) if end < 0 else end + 1
            else:
                add("<")
                at = begin + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" or tag in SIBLINGS:
                close({tag}, FENCES - {tag})
            else:
                close({tag})
            if tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            if not hidden:
                texts.append("\n")
            continue
        if tag in ENDS_P:
            close({"p"}, FENCES)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], FENCES - SIBLINGS[tag])
        if tag in BLOCKS:
            flush()
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        features = [f"tag={tag}"]
        for a in ATTRIBUTE.finditer(m[3]):
            for w in NAME.findall((a[2] or a[3] or a[4] or "").lower()):
                features += [f"word={w}", *_stems(w)]
        number += 1
        stack.append((tag, tuple(features), number))
        hidden += tag in UNSEEN
        if tag in RAW:
            end = lower.find(f"</{tag}", at)
            end = len(page) if end < 0 else end
            if tag not in UNSEEN:
                add(page[at:end])
            at = end
    flush()
    return out


def densest(blocks: list[Block]) -> tuple[int, int]:
    """Numbers of the element that holds most running text, and of its parent.

    Sentences count for the element around their block, and half for the next one.
    """
    held: dict[int, float] = {}
    above: dict[int, int] = {}
    for text, _, linked, chain in blocks:
        words = text.count(" ") + 1
        if linked < 0.3 and len(chain) > 2 and (words > 20 or words > 5 and text[-1] in ".!?"):
            held[chain[-2]] = held.get(chain[-2], 0) + words
            held[chain[-3]] = held.get(chain[-3], 0) + words / 2
            above[chain[-2]] = chain[-3]
            above.setdefault(chain[-3], chain[-4] if len(chain) > 3 else -1)
    best = max(held, key=held.get, default=-1)
    return best, above.get(best, -1)


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold of each block."""
    best, parent = densest(blocks)
    lengths = [min(6, (b[0].count(" ") + 1).bit_length()) for b in blocks]
    links = [int(b[2] * 3) for b in blocks]
    head = next((i for i, b in enumerate(blocks) if "tag=h1" in b[1]), -1)
    out = []
    for i, (text, ancestors, linked, chain) in enumerate(blocks):
        elements: list[list[str]] = []  # tag and names of the ancestors that make blocks
        for f in ancestors:
            if f.startswith("tag="):
                elements.append([f[4:]])
            elif f.startswith("word="):
                elements[-1].append(f[5:])
        elements = [e for e in elements if e[0] in BLOCKS and e[0] not in ("html", "body")]
        leaf = elements[-1][0] if elements else ""
        fs = set(ancestors) | {"bias", f"leaf={leaf}", f"words={lengths[i]}", f"linked={links[i]}", f"leaf={leaf},words={lengths[i]}"}
        if len(elements) > 1:
            above = elements[-2]
            fs |= {f"path={above[0]}>{leaf}", f"path={above[0]}{'.' * (len(above) > 1)}>{leaf}"}
        fs |= {f"top={e[0]}{'.' * (len(e) > 1)}" for e in elements[:1]} | {f"plain={e[0]}" for e in elements if len(e) == 1}
        where = "none" if best < 0 else "in" if best in chain else "by" if parent in chain else "out"
        sentence = text[-1] in ".!?"
        fs |= {f"dense={where}", f"dense={where},leaf={leaf}", f"dense={where},words={lengths[i]},{sentence}"}
        fs.add("head=none" if head < 0 else f"head={'at' if i == head else 'after' if i > head else 'before'}")
        fs.add(f"before={lengths[i - 1]},{links[i - 1]}" if i else "first")
        fs.add(f"next={lengths[i + 1]},{links[i + 1]}" if i + 1 < len(blocks) else "last")
        if "©" in text or "copyright" in text.lower():
            fs.add("rights")
        if sentence:
            fs.add("sentence")
        out.append(sorted(fs))
    return out


class Crf:
    """Weights of two labels (0 boilerplate, 1 article) and of their transitions."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.t = np.zeros((2, 2))

    def potentials(self, rows: list[list[str]]) -> np.ndarray:
        index = self.index
        return np.array([self.w[[index[f] for f in fs if f in index]].sum(0) for fs in rows])

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest label sequence (Viterbi)."""
        if not rows:
            return []
        p, t = self.potentials(rows).tolist(), self.t.tolist()
        best, back = p[0], []
        for q in p[1:]:
            step = [0 if best[0] + t[0][y] >= best[1] + t[1][y] else 1 for y in (0, 1)]
            best = [best[step[y]] + t[step[y]][y] + q[y] for y in (0, 1)]
            back.append(step)
        y = int(best[1] > best[0])
        out = [y]
        for step in reversed(back):
            y = step[y]
            out.append(y)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 16, rate: float = 0.3, decay: float = 1e-4) -> Crf:
        """Stochastic ascent (AdaGrad) of the conditional log-likelihood."""
        for rows, _ in pages:
            for fs in rows:
                for f in fs:
                    self.index.setdefault(f, len(self.index))
        self.w = np.zeros((len(self.index), 2))
        seen_w, seen_t = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        coded = []
        for rows, y in pages:
            if rows:
                flat = np.array([self.index[f] for fs in rows for f in fs])
                size = np.array([len(fs) for fs in rows])
                coded.append((flat, np.cumsum(size) - size, np.repeat(np.arange(len(rows)), size), *np.unique(flat, return_inverse=True), np.array(y)))
        order = random.Random(3)
        for _ in range(epochs):
            order.shuffle(coded)
            for flat, starts, owner, own, place, y in coded:
                share, moves = marginals(np.add.reduceat(self.w[flat], starts), self.t)
                g = -moves - decay * self.t
                np.add.at(g, (y[:-1], y[1:]), 1)
                seen_t += g * g
                self.t += rate * g / np.sqrt(seen_t)
                error = (y == 0) - share[:, 0]
                e = np.bincount(place, weights=error[owner], minlength=len(own))
                g = np.stack([e, -e], 1) - decay * self.w[own]
                seen_w[own] += g * g
                self.w[own] += rate * g / np.sqrt(seen_w[own])
        return self


def marginals(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels of each block, and expected numbers of the transitions, by forward and backward sums."""
    e = np.exp(p - p.max(1, keepdims=True)).tolist()
    (t00, t01), (t10, t11) = np.exp(t).tolist()
    a0, a1 = e[0]
    forward = [(a0 / (a0 + a1), a1 / (a0 + a1))]
    for e0, e1 in e[1:]:
        a0, a1 = forward[-1]
        a0, a1 = (a0 * t00 + a1 * t10) * e0, (a0 * t01 + a1 * t11) * e1
        forward.append((a0 / (a0 + a1), a1 / (a0 + a1)))
    b0 = b1 = 1.0
    share, moves = [], [0.0] * 4
    for k in range(len(e) - 1, -1, -1):
        a0, a1 = forward[k]
        share.append((a0 * b0 / (a0 * b0 + a1 * b1), a1 * b1 / (a0 * b0 + a1 * b1)))
        if k:
            a0, a1 = forward[k - 1]
            c0, c1 = e[k][0] * b0, e[k][1] * b1
            x = (a0 * t00 * c0, a0 * t01 * c1, a1 * t10 * c0, a1 * t11 * c1)
            total = sum(x)
            moves = [m + v / total for m, v in zip(moves, x, strict=True)]
            b0, b1 = t00 * c0 + t01 * c1, t10 * c0 + t11 * c1
            b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    return np.array(share[::-1]), np.array(moves).reshape(2, 2)


def labelled_pages(number: int = 1200, seed: int = 5) -> list[tuple[list[list[str]], list[int]]]:
    """Feature rows and labels of generated pages.

    Text of the article is marked by a character of the private-use area, which
    is stripped from the blocks before the features are taken.
    """
    r, mark = random.Random(seed), "\ue000"
    pages = []

    def word() -> str:
        return "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    def words(low: int, high: int) -> str:
        text = " ".join(word() for _ in range(r.randint(low, high)))
        style = r.random()
        if style < 0.1:
            return text.upper() + r.choice(["", "!!", "."])
        if style < 0.25:
            return text + r.choice(["", " 2024", " | more", " $$$", ":"])
        return text.capitalize() + r.choice([".", ".", ".", "", "?"])

    def named(names: str, plain: float = 0.25) -> str:
        """A class or id, at times one that says nothing."""
        if r.random() < 0.1:
            return ""
        name = r.choice(names.split()) if r.random() >= plain else r.choice([*NEUTRAL.split(), word(), f"{word()}-{r.randint(1, 12)}"])
        return f' {r.choice(["class", "id"])}="{name}{r.choice(["", "", "-box", "-wrap", " block", "-2"])}"'

    def wrapped(inner: str, most: int = 2) -> str:
        for _ in range(r.randint(0, most)):
            inner = f"<div{named(NEUTRAL, 0.4)}>{inner}</div>"
        return inner

    def part(kind: str) -> str:
        tag = r.choice([kind, kind, "div"])
        own = tag not in ("div", "section")
        attribute = "" if own and r.random() < 0.5 else named(OUTSIDE[kind], 0.5 if own or kind in ("nav", "footer") else 0.1)
        if kind in ("nav", "aside"):
            items = "".join(f'<li><a href="#">{words(1, 7 if kind == "aside" else 4)}</a></li>' for _ in range(r.randint(2, 9)))
            inner = (f"<h3>{words(1, 3)}</h3>" if r.random() < 0.4 else "") + f"<ul>{items}</ul>" + (f"<p>{words(4, 25)}</p>" if kind == "aside" and r.random() < 0.3 else "")
        elif kind == "header":
            inner = r.choice([f'<a href="#">{words(1, 3)}</a>', words(1, 8), f"<h2>{words(1, 4)}</h2><p>{words(2, 9)}</p>"]) + (part("nav") if r.random() < 0.3 else "")
        elif kind == "footer":
            inner = f"&copy; {words(1, 4)} &middot; {words(2, 12)}" if r.random() < 0.7 else f"<p>{words(3, 15)}</p>"
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button><p>{words(2, 10)}</p>"
        elif kind == "section":
            each = lambda: r.choice([f'<a href="#">{words(1, 2)}</a><p>{words(3, 60)}</p>', f"<b>{words(1, 2)}</b> {words(3, 40)}", f"<p>{words(3, 60)}</p><p>{words(2, 30)}</p>"])
            item, many = r.choice(["li", "div", "div", "article"]), r.randint(1, 7)
            inner = "".join(f"<{item}{named(REMARK, 0.1) or ' class=comment'}>{each()}</{item}>" for _ in range(many))
            inner = f"<h3>{r.choice([words(1, 3), f'{many} comments', 'Comments', 'Kommentare', 'Commentaires', 'Comentarios'])}</h3>" * r.randint(0, 1) + (f"<{r.choice(['ol', 'ul'])}{attribute}>{inner}</ol></ul>" if item == "li" else inner)
        else:
            inner = words(1, 30) if r.random() < 0.6 else f"<p>{words(1, 30)}</p><p>{words(1, 30)}</p>"
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def body() -> str:
        parts = []
        if r.random() < 0.85:
            title = f"<h1>{mark}{words(1, 14)}</h1>"
            parts.append(r.choice([title, title, title, f"<header{named('entry header post title', 0.3)}>{title}</header>", f"{title}<div{named('byline meta date author posted', 0)}>{words(2, 6)}</div>"]))
        short = r.random() < 0.1  # nothing but a few words anywhere
        for _ in range(r.randint(1, 18)):
            tag = r.choice(["p"] * 9 + ["h2", "h3", "ul", "ol", "blockquote", "pre", "table", "figure", "div"])
            text = f"{mark}{words(1, 5 if short else 120 if tag == 'p' else 60 if tag == 'div' else 14)}"
            if r.random() < 0.15:
                text = text.replace(" ", r.choice(["<br>", " <b>", ' <a href="#">x</a> ']), 1)
            items = f"<li>{text}</li><li>{mark}{words(1, 20)}</li>"
            inner = {"ul": items, "ol": items, "table": f"<tr><td>{text}</td><td>{mark}{words(1, 9)}</td></tr>", "blockquote": r.choice([text, f"<p>{text}</p>"]), "figure": f"<img><figcaption>{text}</figcaption>"}
            parts.append(f"<{tag}>{inner.get(tag, text)}</{tag}>")
            if r.random() < 0.06:
                parts.append(part(r.choice(["div", "aside", "div", "nav", "form"])))
        if r.random() < 0.15:
            parts = [f"<{r.choice(['div', 'section'])}{named(INSIDE, 0.4)}>", *parts, "</div></section>"]
        if r.random() < 0.25:
            parts.append(part(r.choice(["section", "section", "div", "aside", "form"])))
        return "".join(parts)

    for _ in range(number):
        form = r.random()
        text = body()
        if form < 0.35:
            text = f"<article{named(INSIDE) if r.random() < 0.4 else ''}>{text}</article>"
        elif form < 0.45:
            text = f"<main>{text}</main>"
        elif form < 0.55:
            text = f"<main{named(INSIDE) if r.random() < 0.4 else ''}><article>{text}</article>{part('section') if r.random() < 0.2 else ''}</main>"
        elif form < 0.75:
            text = f"<{(tag := r.choice(['div', 'div', 'section']))}{named(INSIDE, 0.15)}>{text}</{tag}>"
        else:  # nothing names it
            text = f"<div{named(NEUTRAL, 0.3)}>{text}</div>"
        if r.random() < 0.2:
            text = wrapped(text, 1) + part("aside")
        elif r.random() < 0.1:
            text = part("aside") + wrapped(text, 1)
        if form >= 0.55 or r.random() < 0.3:
            text = wrapped(text, 3)
        kinds = [k for k in OUTSIDE for _ in range(r.choice([0, 1, 1, 2]))]
        r.shuffle(kinds)
        at = r.randint(0, len(kinds))
        before = [part(k) for k in kinds[:at] if k not in ("footer", "section")]
        after = [part(k) for k in kinds[at:]] + ([part("footer")] if r.random() < 0.8 else [])
        page = "".join(wrapped(x, 1) if r.random() < 0.15 else x for x in [*before, text, *after])
        page = f"<html><head><title>{words(2, 9)}</title></head><body>{wrapped(page, 2) if r.random() < 0.3 else page}</body></html>"
        blocks, labels = [], []
        for text, *rest in leaf_blocks(page):
            labels.append(int(mark in text))
            blocks.append((text.replace(mark, "") or "x", *rest))
        pages.append((features_of(blocks), labels))
    return pages


_default: list[Crf] = []


def default_model() -> Crf:
    """The CRF trained on the generated pages, once a process; deterministic."""
    if not _default:
        _default.append(Crf().fit(labelled_pages()))
    return _default[0]


def main_text(page: str | None, model: Crf | None = None) -> str:
    """The article's blocks, joined by one space."""
    blocks = leaf_blocks(page)
    labels = (model or default_model()).decode(features_of(blocks))
    return " ".join(b[0] for b, y in zip(blocks, labels, strict=True) if y)


class _Extract:
    def __init__(self, model: Crf):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), self.model) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return map_arrow(pages.select("page_id", "url", "html"),
        _Extract(model or default_model()), "page_id long, url string, text string, n_chars long"
    )
