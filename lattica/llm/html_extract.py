"""Main text of web pages by a tree-structured graphical model over the DOM (operator 9).

Every element and text of a page is a node with a hidden label, content or not. Edges join parent and child:
their potential is the chance of the child's label given the parent's, by the child's tag and whether it is named. A node's own evidence
is how much likelier its observations (words of class, id and role; length, links and sentence ends of its text)
are under one label than under the other. Sum-product messages run once up the tree and once down it; their
product is the exact marginal of each text, and texts that are content with a chance of ``KEEP`` are kept.

All numbers are counted from labelled pages. These are made by ``labelled_pages``: pages of many layouts whose
main article is known (whole, or in sections and containers of many names), with menus, headers, footers, sidebars,
notices, adverts, forms and comments around and inside it. The name of a part counts by its last known word, a role
of the ARIA landmarks as the element that it stands for. The number of pages is a parameter; the corpus is not
sampled. Pages are made and counted in the workers, in blocks with seeds of their own, and a driver process keeps the
model; what executors get are two small tables of logarithms.

Names lower a chance but do not decide that a page has nothing to say: where headings at most are kept of a page that
has a main one (h1), it is judged again without its names.

Defined cases: a null or empty page, or one without content, gives an empty text; a page without elements, but for
those inside a line, is one block; broken markup is mended, never refused; very long pages take time in proportion to their nodes; repeated rows are extracted each; extra columns
pass through, but for those with the names of results.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lattica.functions.dom import BLOCK, TEXT, Dom, parse_dom
from lattica.llm.common import bounded_batches, read

TRAINING_PAGES, PAGES_A_BLOCK = 2000, 125
#: The chance from which a text is kept: to lose content counts three times what it counts to keep something else.
KEEP = 0.25
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose text is never shown as part of an article, whatever the model says.
NEVER = frozenset("head title script style noscript template iframe object select option button textarea svg".split())
#: Elements inside a line; they take their parent's label.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())

#: Landmark roles and the elements that have them by themselves.
ROLES = {"banner": "header", "complementary": "aside", "contentinfo": "footer", "form": "form", "main": "main", "navigation": "nav", "search": "form", "article": "article"}

#: Elements that every page has once; their kind says nothing of the page.
ONCE = frozenset(("html", "head", "body"))
LISTS = frozenset(("ul", "ol", "menu", "dl"))

_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_SENTENCE_END = re.compile(r"[.!?]")


def head_word(name: str) -> str:
    """The word that says what a compound name is, the last that the training names: of ``widget-title`` it is
    ``title``, of ``disqus_thread`` ``disqus``; none if no word is among them."""
    words = _WORD.findall(_HUMP.sub(r"\1-\2", name).lower())
    return next((w for w in reversed(words) if w in KNOWN_WORDS), "")


def head_words(dom: Dom, node: int) -> list[str]:
    """The head words of an element's class, id and role."""
    if not dom.data[node]:
        return []
    attrs = dom.attributes(node)
    names = " ".join((attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""))).split()
    return [w for w in dict.fromkeys(map(head_word, names)) if w]


def kinds(dom: Dom) -> list[str]:
    """The tag of each node, or that of the element whose landmark role it has."""
    out = list(dom.tag)
    for node, tag in enumerate(dom.tag):
        if tag[0] != "#" and tag not in ONCE and "role" in dom.data[node]:
            out[node] = ROLES.get(dom.attributes(node).get("role", "").strip().lower(), tag)
    return out


def edge_kinds(dom: Dom, named: bool = True) -> list[str]:
    """What each node's edge to its parent depends on: its tag, and whether it is named with a known word."""
    out = []
    for node, tag in enumerate(kinds(dom)):
        if tag in INLINE:
            out.append("#inline")
        else:
            out.append(f"{tag}+" if named and tag[0] != "#" and head_words(dom, node) else tag)
    return out


def link_lists(dom: Dom) -> list[bool]:
    """For each node whether it is a list more than half of whose text is links."""
    n = len(dom.tag)
    linked, chars, in_links = [False] * n, [0] * n, [0] * n
    for node, tag in enumerate(dom.tag):
        up = dom.parent[node]
        linked[node] = tag == "a" or (up >= 0 and linked[up])
        if tag == TEXT:
            chars[node] = len(dom.data[node].strip())
            in_links[node] = chars[node] * linked[node]
    for node in range(n - 1, 0, -1):  # children come after their parents
        chars[dom.parent[node]] += chars[node]
        in_links[dom.parent[node]] += in_links[node]
    return [tag in LISTS and 2 * in_links[node] > chars[node] for node, tag in enumerate(dom.tag)]


def observations(dom: Dom, named: bool = True) -> list[list[str]]:
    """What is seen of each node: attribute words of elements, if ``named``; length, links and sentence ends of texts.

    The items of a list of links say much the same, so they are seen once, at the list.
    """
    seen: list[list[str]] = []
    linked: list[bool] = []
    listed: list[bool] = []
    links = link_lists(dom)
    for node, tag in enumerate(kinds(dom)):
        up = dom.parent[node]
        linked.append(tag == "a" or (up >= 0 and linked[up]))
        listed.append(links[node] or (up >= 0 and listed[up]))
        found: list[str] = []
        if tag == TEXT:
            text = dom.data[node]
            size = len(text.split())
            if size and not listed[node]:
                found.append(f"words:{min(size.bit_length(), 7)}")
                found.append(f"link:{linked[node]}")
                found.append(f"ends:{bool(_SENTENCE_END.search(text))}")
        elif tag[0] != "#" and tag not in INLINE and not listed[up]:
            if tag not in ONCE:
                found.append(f"tag:{tag}")
            if tag in LISTS:
                found.append(f"links:{links[node]}")
            if named:
                found += [f"name:{w}" for w in head_words(dom, node)]
        seen.append(found)
    return seen


@dataclass
class Model:
    """``edge[tag]``: log chances of the child's label (columns) by the parent's (rows); ``own``: log likelihoods by label."""

    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    own: dict[str, tuple[float, float]]

    def edges(self, dom: Dom, named: bool = True) -> list[tuple[tuple[float, float], tuple[float, float]]]:
        usual = {False: self.edge["div"], True: self.edge["div+"]}
        return [self.edge.get(kind, usual[kind[-1] == "+"]) for kind in edge_kinds(dom, named)]

    def marginals(self, dom: Dom, named: bool = True) -> list[float]:
        """The chance that each node is content; without what names say, if not ``named``."""
        n = len(dom.tag)
        edges = self.edges(dom, named)
        not_, yes = [0.0] * n, [0.0] * n  # own evidence and the messages from below
        for node, found in enumerate(observations(dom, named)):
            for x in found:
                if x in self.own:
                    a, b = self.own[x]
                    not_[node] += a
                    yes[node] += b
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for node in range(n - 1, 0, -1):  # children come after their parents
            if dom.tag[node] in NEVER:
                continue  # says nothing of what is around it
            (e00, e01), (e10, e11) = edges[node]
            a, b = not_[node], yes[node]
            message = (_add(e00 + a, e01 + b), _add(e10 + a, e11 + b))
            up[node] = message
            parent = dom.parent[node]
            not_[parent] += message[0]
            yes[parent] += message[1]
        down: list[tuple[float, float]] = [(math.log(0.98), math.log(0.02))] * n
        out = [0.0] * n
        for node in range(n):
            if node:
                parent = dom.parent[node]
                (e00, e01), (e10, e11) = edges[node]
                # the parent's belief without what this child said
                a = down[parent][0] + not_[parent] - up[node][0]
                b = down[parent][1] + yes[parent] - up[node][1]
                top = max(a, b)
                a, b = a - top, b - top
                down[node] = (_add(a + e00, b + e10), _add(a + e01, b + e11))
            gap = down[node][0] + not_[node] - down[node][1] - yes[node]
            out[node] = 1 / (1 + math.exp(min(gap, 700.0)))
        return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b - a > -40 else a


def counted(pages: list[tuple[str, str]]) -> Counter:
    """Counts over pages ``(html, mark)``: an element with the attribute ``mark="1"`` or ``"0"`` sets the label of what it
    holds. Keys are ``(what, key, label, label)``: edges by the parent's and the child's label, observations and the
    nodes that have one of a kind by the node's."""
    out: Counter = Counter()
    for html, mark in pages:
        dom = parse_dom(html)
        label, kinds_ = [0] * len(dom.tag), edge_kinds(dom)
        for node, tag in enumerate(dom.tag):
            if not node:
                continue
            parent = dom.parent[node]
            label[node] = label[parent]
            if tag[0] != "#" and mark in dom.data[node]:
                label[node] = int(dom.attributes(node)[mark])
            out["edge", kinds_[node], label[parent], label[node]] += 1
        for found, y in zip(observations(dom), label):
            for kind in {x.partition(":")[0] for x in found}:
                out["total", kind, y, y] += 1
            for x in found:
                out["own", x, y, y] += 1
    return out


def model_of(counts: dict[tuple[str, str, int, int], int], smooth: float = 0.5) -> Model:
    edge, own, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    tables = {"edge": edge, "own": own, "total": total}
    for (what, key, a, b), n in counts.items():
        tables[what][key][a, b] += n
    edges = {}
    for tag in {*edge, "div", "div+"}:
        c = edge[tag]
        rows = []
        for y in (0, 1):
            both = c[y, 0] + c[y, 1] + 2 * smooth
            rows.append((math.log((c[y, 0] + smooth) / both), math.log((c[y, 1] + smooth) / both)))
        edges[tag] = (rows[0], rows[1])
    return Model(edges, {x: tuple(math.log((c[y, y] + smooth) / (total[x.partition(":")[0]][y, y] + 2 * smooth)) for y in (0, 1)) for x, c in own.items()})


def train(pages: list[tuple[str, str]], smooth: float = 0.5) -> Model:
    """A model from pages at hand (see ``counted``)."""
    return model_of(counted(pages), smooth)


_models: dict[tuple[int, int], Model] = {}


def trained(spark: SparkSession, count: int = 0, seed: int = 9) -> Model:
    """The model of ``labelled_pages``, made and counted in the workers: the driver gets a number a key of a table
    that is bounded by the words and tags of the layouts. Kept for the driver's life."""
    count = count or TRAINING_PAGES
    if (count, seed) not in _models:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: Counter = Counter()
                for block in batch.column(0).to_pylist():
                    found += counted(page_block(block, count, seed))
                keys = list(found)
                yield pa.record_batch(
                    [*(pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))), pa.array([found[k] for k in keys], pa.int64())],
                    ["what", "key", "a", "b", "n"],
                )

        blocks = -(-count // PAGES_A_BLOCK)
        rows = spark.range(0, blocks, 1, blocks).mapInArrow(run, "what string, key string, a int, b int, n long").groupBy("what", "key", "a", "b").agg(F.sum("n").alias("n"))
        _models[count, seed] = model_of({(r["what"], r["key"], r["a"], r["b"]): r["n"] for r in rows.collect()})
    return _models[count, seed]


# --- labelled pages --------------------------------------------------------------------------------------

#: Names that pages give to the parts of a layout.
CONTENT_NAMES = "article content main post entry story body text page-content article-body post-content entry-content main-content blog-post articleBody".split()
ASIDE_NAMES = {
    "nav": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs pagination".split(),
    "header": "header masthead site-header banner top logo branding".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside widget widgets related related-posts recommended toc tags".split(),
    "notice": "cookie cookie-notice cmp consent notice alert gdpr popup modal overlay newsletter subscribe paywall".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsense".split(),
    "share": "share social sharing social-links follow".split(),
    "comments": "comments comment comment-list comments-area replies reply respond discussion disqus reviews review".split(),
    "form": "form search search-form login signup contact-form subscribe-form".split(),
}
#: Layouts that hold the article without saying so.
PLAIN_NAMES = "wrapper container row col inner outer site page box block section grid layout wrap area left right primary".split()
#: Parts of an article.
PART_NAMES = "title headline heading intro lead summary text paragraph chapter part figure image caption gallery quote table highlight note step references meta byline author date dateline".split()
KNOWN_WORDS = frozenset(w for names in (CONTENT_NAMES, PART_NAMES, *ASIDE_NAMES.values()) for n in names for w in _WORD.findall(_HUMP.sub(r"\1-\2", n).lower()))
KNOWN_WORDS -= frozenset(PLAIN_NAMES)
_MARK = "data-label"


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 9) -> list[tuple[str, str]]:
    """Pages of many layouts with a known main article; the same for the same seed."""
    return [p for block in range(-(-count // PAGES_A_BLOCK)) for p in page_block(block, count, seed)]


def page_block(number: int, count: int = TRAINING_PAGES, seed: int = 9) -> list[tuple[str, str]]:
    """One block of them, with a seed of its own."""
    rng = random.Random(f"{seed}:{number}")

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("aeiounrstlkmdp") for _ in range(rng.randint(2, 9))) for _ in range(n))

    def sentences(n: int) -> str:
        return " ".join(words(rng.choice((1, 2, 3, 5, 8, 12, 18))).capitalize() + rng.choice("....!?") for _ in range(n))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{words(1)}">{words(rng.randint(1, 3))}</a></li>' for _ in range(n))

    def named(names: list[str], chance: float = 0.8) -> str:
        if rng.random() > chance:
            return ""
        return f' {rng.choice(("class", "class", "id"))}="{" ".join(rng.sample(names, rng.choice((1, 1, 2))))}"'

    def short(n: int) -> str:
        return " ".join(words(rng.choice((1, 2, 3, 4, 5, 7, 9))).capitalize() + rng.choice("....!?") for _ in range(n))

    def heading(n: int) -> str:
        tag = f"h{rng.randint(2, 5)}"
        return f"<{tag}>{words(rng.randint(1, n))}</{tag}>"

    def aside(kind: str, inside: bool) -> str:
        mark = f' {_MARK}="0"'
        own = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"]}
        own |= {"comments": ["section", "div", "ol"], "form": ["form", "form", "div"]}
        tag = rng.choice(own.get(kind, ["div", "div", "section", "p"]))
        # An element that says nothing by its tag must say it by its name.
        name = named(ASIDE_NAMES[kind], 0.5 if tag in ("nav", "header", "footer", "aside", "form") and not inside else 1.0)
        if kind == "nav":
            body = links(rng.randint(3, 9)) if tag == "ul" else f"<ul>{links(rng.randint(3, 9))}</ul>"
        elif kind == "form":
            body = f"<label>{words(2)}</label><input><button>{words(1)}</button><p>{short(1)}</p>"
        elif kind == "comments":
            body = heading(2) + "".join(
                f"<{'li' if tag == 'ol' else 'div'}{named(ASIDE_NAMES[kind])}><b>{words(1)}</b><p>{sentences(rng.randint(1, 4))}</p></{'li' if tag == 'ol' else 'div'}>"
                for _ in range(rng.randint(1, 5))
            )
        elif kind == "share":
            body = "".join(f'<a href="#">{words(1)}</a> ' for _ in range(3))
        elif kind == "aside":
            body = heading(2) * rng.randint(0, 1) + rng.choice((f"<ul>{links(4)}</ul>", f"<p>{short(rng.randint(1, 3))}</p>"))
        elif kind == "header":
            body = rng.choice((f'<a href="/">{words(2)}</a>', f"<h1>{words(3)}</h1><p>{words(5)}</p>", f"{words(4)}"))
        else:
            body = rng.choice((short(rng.randint(1, 3)), f"<p>{short(1)}</p>", f"&copy; {words(3)} {rng.randint(1990, 2026)} &middot; {short(1)}", f"{words(3)}<br>{words(2)}"))
        return f"<{tag}{name}{mark}>{body}</{tag}>"

    def block() -> str:
        draw = rng.random()
        if draw < 0.02:
            return f"<{(t := rng.choice(('div', 'p')))} class=\"{rng.choice(('meta', 'byline', 'entry-meta', 'author', 'post-date'))}\">{words(3)}</{t}>"
        if draw < 0.72:
            text = sentences(rng.choice((1, 1, 2, 4, 8)))
            if rng.random() < 0.25:
                text = f"<b>{text}</b>" if rng.random() < 0.5 else f'{text} <a href="/x">{words(2)}</a> {sentences(1)}'
            if para != "p":
                return f"<{para}>{text}</{para}>"
            return f"<p>{text}</p>" if rng.random() < 0.8 else f"<p>{text}<br>{sentences(1)}"
        if draw < 0.82:
            return f"<h{(n := rng.choice((2, 2, 3, 3, 4, 5, 6)))}>{words(rng.randint(1, 6))}</h{n}>"
        if draw < 0.88:
            tag = rng.choice(("ul", "ol", "dl"))
            if tag == "dl":
                return "<dl>" + "".join(f"<dt>{words(2)}</dt><dd>{sentences(1)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"
            return f"<{tag}>" + "".join(f"<li>{rng.choice((sentences, words))(rng.randint(1, 3))}</li>" for _ in range(rng.randint(2, 5))) + f"</{tag}>"
        if draw < 0.91:
            return f"<blockquote><p>{sentences(2)}</p></blockquote>"
        if draw < 0.94:
            top = f"<caption>{words(3)}</caption>" * rng.randint(0, 1) + f"<tr><th>{words(1)}</th><th>{words(1)}</th></tr>" * rng.randint(0, 1)
            rows = "".join(f"<tr><td>{words(1)}</td><td>{sentences(1)}</td></tr>" for _ in range(3))
            return f"<table>{top}{rows}</table>" if rng.random() < 0.5 else f"<table><tbody>{top}{rows}</tbody></table>"
        if draw < 0.96:
            return f"<pre>{words(6)}</pre>"
        if draw < 0.98:
            return f"<figure><img><figcaption>{sentences(1)}</figcaption></figure>"
        return f"<div>{sentences(3)}</div>"

    para = "p"

    def part(depth: int) -> str:
        """A run of an article's blocks in a container of its own, which may be named and may hold others."""
        inner = [f"<h{(n := rng.randint(2, 4))}>{words(rng.randint(1, 6))}</h{n}>"] * (rng.random() < 0.6)
        inner += [part(depth - 1) if depth and rng.random() < 0.2 else block() for _ in range(rng.choice((1, 2, 3, 5)))]
        if rng.random() < 0.3:
            inner.append(f"<ul>{links(rng.randint(2, 5))}</ul>")
        tag = rng.choice(("section", "section", "div", "div", "div", "details", "figure", "center"))
        draw = rng.random()
        if draw < 0.35:
            name = ""
        elif draw < 0.8:
            name = named([*PART_NAMES, *PLAIN_NAMES, *CONTENT_NAMES], 1.0)
        else:  # a compound whose last word says that it is a part of the text
            first = rng.choice([*CONTENT_NAMES, *(n for names in ASIDE_NAMES.values() for n in names)])
            name = f' class="{first}-{rng.choice(PART_NAMES)}"'
        if tag == "details":
            inner.insert(0, f"<summary>{words(rng.randint(1, 5))}</summary>")
        return f"<{tag}{name}>{''.join(inner)}</{tag}>"

    pages = []
    for _ in range(min(PAGES_A_BLOCK, count - number * PAGES_A_BLOCK)):
        para = rng.choice(("p",) * 7 + ("div",))  # what a page's paragraphs are made of; ``block`` reads it
        title = f"<h1>{words(rng.randint(1, 9))}</h1>"
        if rng.random() < 0.25:
            title = f"<header{named(['entry-title', 'headline', 'title'], 0.5)}>{title}</header>"
        share = rng.choice((0.0, 0.0, 0.3, 1.0))  # of the blocks that stand in containers
        blocks = [title] * (rng.random() < 0.85) + [part(2) if rng.random() < share else block() for _ in range(rng.choice((1, 2, 4, 8, 16)))]
        if rng.random() < 0.08:
            blocks.append(f"<ul>{links(rng.randint(2, 6))}</ul>")
        for kind in ("advert", "share", "form", "notice", "aside", "comments"):
            if rng.random() < 0.25:
                blocks.insert(rng.randint(0, len(blocks)), aside(kind, True))
        draw = rng.random()
        if draw < 0.3:
            tag, name = "article", named(CONTENT_NAMES, 0.3)
        elif draw < 0.45:
            tag, name = "main", named(CONTENT_NAMES, 0.3)
        elif draw < 0.62:
            tag, name = rng.choice(("div", "div", "section", "td")), named(CONTENT_NAMES, 1.0)
        else:
            tag, name = "div", named(PLAIN_NAMES, 0.7)
        bare = draw > 0.86  # no container but the body
        body = "".join(blocks) if bare else f'<{tag}{name} {_MARK}="1">{"".join(blocks)}</{tag}>'
        if tag == "article" and rng.random() < 0.4:  # in a main that holds more beside it
            more = "".join(aside(k, True) for k in ("comments", "aside", "share") if rng.random() < 0.3)
            body = f'<main {_MARK}="1">{body}{more}</main>'
        if tag == "td":
            beside = f'<td{named(ASIDE_NAMES["nav"] + ASIDE_NAMES["aside"], 1.0)} {_MARK}="0"><ul>{links(5)}</ul></td>'
            beside = rng.choice(("", beside, beside.replace("<ul>", "").replace("</ul>", "").replace("<li>", "").replace("</li>", "<br>")))
            body = f"<table><tr>{beside}{body}</tr></table>"
        elif not bare and rng.random() < 0.3:  # beside columns of other things
            body = f"<div{named(PLAIN_NAMES)}>{body}{aside(rng.choice(('aside', 'nav', 'advert')), False)}</div>"
        for _ in range(0 if bare else rng.choice((0, 0, 1, 2))):
            body = f"<div{named(PLAIN_NAMES)}>{body}</div>"
        before = [aside(k, False) for k in ("header", "nav", "notice", "advert", "form") if rng.random() < 0.6]
        after = [aside(k, False) for k in ("comments", "aside", "share", "advert", "footer") if rng.random() < 0.6]
        head = f"<head><title>{words(4)}</title><script>{words(2)}</script></head>"
        pages.append((f"<!DOCTYPE html><html>{head}<body{f' {_MARK}="1"' * bare}>{''.join(before)}{body}{''.join(after)}</body></html>", _MARK))
    return pages


# --- extraction --------------------------------------------------------------------------------------------


def content_chances(dom: Dom, model: Model) -> list[float]:
    """The chance that each node is content; without names where with them a page with an h1 keeps headings at most."""
    if all(tag[0] == "#" or tag in INLINE or tag in ONCE or tag in NEVER for tag in dom.tag):
        return [1.0] * len(dom.tag)
    aside = [False] * len(dom.tag)  # never shown, or in a heading
    texts = []
    for node, tag in enumerate(dom.tag):
        aside[node] = tag in NEVER or tag in HEADINGS or (node > 0 and aside[dom.parent[node]])
        if tag == TEXT and not aside[node] and dom.data[node].strip():
            texts.append(node)
    chance = model.marginals(dom)
    if texts and "h1" in dom.tag and not any(chance[node] >= KEEP for node in texts):
        plain = model.marginals(dom, named=False)
        if any(plain[node] >= KEEP for node in texts):
            return plain
    return chance


def main_text(html: str | None, model: Model) -> str:
    """Blocks of content in page order, one a line."""
    if not html:
        return ""
    dom = parse_dom(html)
    chance = content_chances(dom, model)
    holder = [0] * len(dom.tag)  # the block that each node's text belongs to
    blocks: list[list[str]] = []
    hidden = [False] * len(dom.tag)
    last = -1
    for node, tag in enumerate(dom.tag):
        parent = dom.parent[node]
        if node:
            hidden[node] = hidden[parent] or tag in NEVER
            holder[node] = node if tag in BLOCK else holder[parent]
        if tag == "br":
            if blocks and last == holder[node]:
                blocks[-1].append(" ")
        elif tag == TEXT:
            if hidden[node] or chance[node] < KEEP:
                continue
            if last == holder[node]:
                blocks[-1].append(dom.data[node])
            elif dom.data[node].strip():
                blocks.append([dom.data[node]])
                last = holder[node]
        elif tag in BLOCK:
            last = -1
    return "\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def extract_main_text(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points); columns with these names give way."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained(pages.sparkSession))  # bounded by the training pages
    bounded_batches(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    pages = pages.select(*(F.col(f"`{c}`") for c in names))
    place = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:  # of bounded bytes
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(html.as_py(), sent.value) for html in batch.column(place)]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.record_batch([*batch.columns, *made], [*names, "text", "n_chars"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())]))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(read(spark, sf_dir, "pages", "page_id", "url", "html")).drop("html")


#: For pages of the layout that the driver's have: one article, of h1 and p.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<br>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS bs FROM a),
c AS (SELECT page_id, url, list_transform(bs, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS bs FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(bs, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
