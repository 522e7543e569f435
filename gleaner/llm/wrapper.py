"""HTML extraction by wrapper induction: what same-host pages share is template, what varies is content.

A page becomes a tree of its block elements; siblings of one tag and class are one node (a list of paragraphs is a slot
that repeats; of sections only those that hold the same kind of elements), so among siblings a label occurs once. A host's wrapper is induced from all its pages: the most frequent
tree is the host's model, every other tree is aligned with it by simple tree matching (the largest order-preserving match
of equal-labelled nodes from the root down), and each slot of the model gathers evidence over the aligned pages: how many
have it, whether its texts are all one, its characters and how many of them lie in links.

The slot with the most text outside links is the host's main slot and the section around it the content. Slots in an
article or main come first, however much text there is elsewhere, and that element is the section: what it holds is
content but for other articles, what by its name is a menu, header, footer, sidebar, advert, form or reader comments, and
text that is the same at its slot on `least` pages or more while the main slot varies (copies of one article stay whole)
and lies in no paragraph, heading or list; a name that may be an article's own (related, notice, menu) needs the pages'
word: text of all pages, or links. Without an article or main the pages' evidence decides: texts that are all one, links,
sections of little text. Of what is outside such a section, headings of their own text before it belong to it. Applying a wrapper parses the page again, aligns its tree and returns the
text of the slots that are content. A node that the model lacks goes with the nearest one around it that it has, and by
its own name.

A host of fewer than `least` pages, and a page whose content section has no text, have a wrapper of the page alone.

Cases: a null page is empty, a page without text gives the empty text; pages without a host share one wrapper; repeated
rows are pages; unclosed elements end where HTML implies it or with their parent, stray end tags are passed over; of a tag
without an end the rest is dropped, a quote without an end ends with its tag.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._shared import written

#: Bytes of all wrappers together up to which they are sent to every task.
BROADCAST_BYTES = 8 << 20

_BLOCK = frozenset("html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside blockquote pre figure figcaption form fieldset address details summary hgroup center menu search".split())
#: Never content, whatever the evidence: no text of a page, or forms.
_DROPPED = frozenset("head form script style noscript template iframe audio video canvas datalist title".split())
#: Element names that say template.
_NAMED_TEMPLATE = frozenset("nav aside footer menu search dialog".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that say template where they are all of a class, id or role (with digits and dashes between).
_FURNITURE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside rail widget notice notices alert cookie cookies consent gdpr privacy popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus replies respond pagination pager toolbar copyright contentinfo complementary list box bar links area section container wrapper block".split()
)
#: Those of them that name what is never content, wherever it stands.
_NEVER = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored comment comments disqus replies respond nav navbar navigation breadcrumb breadcrumbs sidebar cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing pagination pager toolbar footer masthead".split())
_NEUTRAL = frozenset("list box bar links area section container wrapper block".split())
#: Elements that hold the text of a section, and are none.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hgroup details summary address".split())
#: Elements whose text is an article's own though every page has the same: headings of a recipe, a closing line.
_OWN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption summary".split())
#: What a section holds directly, by the highest of its kinds: nothing, sections, lists, text.
_KINDS = ("", "s", "l", "t")
_HEADINGS = frozenset("h1 h2 h3 hgroup".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALL = frozenset("ul ol dl table div section article main body".split())
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def _names(attributes: str) -> tuple[str, int]:
    """The class as a label, and whether class, id or role say template: 1, or 2 where they name what is never content."""
    label, furniture = "", 0
    for m in _NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "class":
            label = _DIGITS.sub("0", " ".join(value.split()))
        for name in value.split():
            words = set(_WORD.findall(name))
            if words - _NEUTRAL and words <= _FURNITURE:
                furniture = max(furniture, 2 if words & _NEVER else 1)
    return label, furniture


class Page:
    """blocks: (node, text, characters in links) in page order. Nodes: labels ("*" before one that says template, "**" before
    one that names what is never content), parents,
    and whether they are dropped."""

    def __init__(self, html: str):
        self.labels, self.parents, self.dropped = ["#"], [-1], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.html, self.last, self.quoted = html, html.rfind(">"), True
        self.children: dict[tuple[int, str], int] = {}
        self.stack: list[tuple[str, int]] = [("#", 0)]
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.link, self.linked = False, 0
        self._parse()
        self._flush()
        self._merge()

    def _flush(self) -> None:
        if self.text:
            if words := "".join(self.text).split():
                self.blocks.append((self.stack[-1][1], " ".join(words), self.linked))
            self.text.clear()
        self.linked = 0

    def _say(self, piece: str) -> None:
        if not self.dropped[self.stack[-1][1]]:
            self.text.append(unescape(piece) if "&" in piece else piece)
            if self.link:
                self.linked += len(piece)

    def _pop(self, k: int) -> None:
        if any(tag in _BLOCK for tag, _ in self.stack[k:]):
            self._flush()
        for tag, _ in self.stack[k:]:
            self.open[tag] -= 1
        del self.stack[k:]

    def _tag_end(self, at: int) -> tuple[str, int]:
        """The attributes of a tag whose name ends at `at`, and the place behind it."""
        if self.quoted:
            if m := _ATTRIBUTES.match(self.html, at):
                return m[1], m.end()
            self.quoted = False  # a quote without an end: from here on, tags end at the next >
        end = self.html.find(">", at)
        return self.html[at:end], end + 1

    def _parse(self) -> None:
        html, at = self.html, 0
        while (i := html.find("<", at)) >= 0:
            if i > at:
                self._say(html[at:i])
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                if end < 0:
                    return
                at = end + 3
                continue
            m = _OPEN.match(html, i)
            if m is None and html[i + 1 : i + 2] not in ("!", "?"):
                self._say("<")
                at = i + 1
                continue
            if i > self.last:
                return  # no tag ends any more
            if m is None:
                at = html.find(">", i) + 1
                continue
            attributes, at = self._tag_end(m.end())
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in _VOID:
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._say(" ")
            else:
                at = self._start(tag, attributes, at)
        if at < len(html):
            self._say(html[at:])

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if not self.open.get(tag):
            if tag in _BLOCK:
                self._flush()
            return
        stack, k = self.stack, len(self.stack) - 1
        while stack[k][0] != tag:
            if stack[k][0] in ("article", "main", "body") and tag not in ("body", "html", "article", "main"):
                self._flush()
                return  # a stray end tag doesn't close the article
            k -= 1
        self._pop(k)

    def _start(self, tag: str, attributes: str, at: int) -> int:
        """Enters an element; returns the place behind its tag, or behind the whole of one whose content is no markup."""
        if tag == "a":
            self.link = True
        label, furniture = _names(attributes) if attributes else ("", 0)
        block, stack = tag in _BLOCK, self.stack
        if not block and tag not in _DROPPED and tag not in _RAW:
            return at  # inline
        if block:
            self._flush()
            if stack[-1][0] == "p":
                self._pop(len(stack) - 1)
            elif tag in _CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _CLOSES[tag]:
                        self._pop(k)
                        break
                    if stack[k][0] in _WALL:
                        break
        up = stack[-1][1]
        furniture = 0 if tag in ("html", "body", "article", "main", *_HEADINGS) else furniture
        name = "*" * furniture + (f"{tag}.{label}" if label else tag)
        node = self.children.get((up, name)) if tag in _TEXTUAL else None
        if node is None:
            node = self.children[up, name] = len(self.labels)
            self.labels.append(name)
            self.parents.append(up)
            self.dropped.append(self.dropped[up] or tag in _DROPPED)
        if tag in _RAW:
            m = re.compile(f"</{tag}", re.I).search(self.html, at)
            if tag not in _DROPPED:
                self._say(self.html[at : m.start() if m else len(self.html)])
            close = self.html.find(">", m.end()) if m else -1
            return len(self.html) if close < 0 else close + 1
        if attributes.endswith("/") and not block:
            return at
        stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1
        return at

    def _merge(self) -> None:
        """Makes one node of siblings of one label; of sections of one tag and class, only those that hold the same kind of
        elements (text, lists, sections or none)."""
        kinds, times = [0] * len(self.labels), Counter(zip(self.parents, self.labels, strict=True))
        for up, label in zip(self.parents[1:], self.labels[1:], strict=True):
            tag = label.lstrip("*").split(".", 1)[0]
            kinds[up] |= 1 if tag not in _TEXTUAL else 2 if tag in ("ul", "ol", "dl", "li") else 4
        of, known = [0] * len(self.labels), {}
        labels, parents = ["#"], [-1]
        for k in range(1, len(self.labels)):
            label, up = self.labels[k], of[self.parents[k]]
            if times[self.parents[k], label] > 1:
                label += "~" + (_KINDS[kinds[k].bit_length()])
            node = known.setdefault((up, label), len(labels))
            if node == len(labels):
                labels.append(label)
                parents.append(up)
            of[k] = node
        self.labels, self.parents = labels, parents
        self.blocks = [(of[n], t, linked) for n, t, linked in self.blocks]

    def tree(self) -> str:
        """The tree as text: a line of depth and label for each node, in the order of first sight within each parent."""
        below: list[list[int]] = [[] for _ in self.labels]
        for n, up in enumerate(self.parents[1:], 1):
            below[up].append(n)
        out, self.order = [], []
        todo = [(0, 0)]
        while todo:
            n, depth = todo.pop()
            out.append(f"{depth} {self.labels[n]}")
            self.order.append(n)
            todo += [(c, depth + 1) for c in reversed(below[n])]
        return "\n".join(out)


def _nodes(tree: str) -> tuple[list[str], list[int]]:
    """Label and parent of each node."""
    labels, parents, line = [], [], []
    for k, x in enumerate(tree.split("\n")):
        depth, label = x.split(" ", 1)
        labels.append(label)
        del line[int(depth) :]
        parents.append(line[-1] if line else -1)
        line.append(k)
    return labels, parents


def _below(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for k, up in enumerate(parents[1:], 1):
        out[up].append(k)
    return out


def _heaviest(pairs: list[tuple[int, int]], weight: dict[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """Of pairs in the order of their first member, those of most weight whose second members ascend, too."""
    if all(x[1] < y[1] for x, y in pairwise(pairs)):
        return sum(weight[a] for a, _ in pairs), pairs
    ends: list[int] = []  # second members, ascending, with ascending totals
    best: list[tuple[int, int]] = []  # total, index
    back = [-1] * len(pairs)
    for i, (a, b) in enumerate(pairs):
        k = bisect_left(ends, b)
        total = weight[a]
        if k:
            total, back[i] = total + best[k - 1][0], best[k - 1][1]
        if k and best[k - 1][0] >= total:
            continue
        stop = k
        while stop < len(ends) and best[stop][0] <= total:
            stop += 1
        ends[k:stop], best[k:stop] = [b], [(total, i)]
    total, i = best[-1]
    used = []
    while i >= 0:
        used.append(pairs[i])
        i = back[i]
    return total, used[::-1]


def aligned(tree: str, model: str) -> list[int]:
    """The model's node of each node of tree, by simple tree matching; -1 where it has none.

    A label occurs once among siblings, so a node can only match the one of equal path, and the order of siblings is what is
    left to decide: bottom up, the children used are those of most weight that are in one order in both trees.
    """
    labels, parents = _nodes(tree)
    if tree == model:
        return list(range(len(labels)))
    other, over = _nodes(model)
    named = {(up, label): k for k, (up, label) in enumerate(zip(over, other, strict=True))}
    found = [-1] * len(labels)
    found[0] = 0 if labels[0] == other[0] else -1
    for a in range(1, len(labels)):
        if found[parents[a]] >= 0:
            found[a] = named.get((found[parents[a]], labels[a]), -1)
    below, weight, used = _below(parents), {}, {}
    for a in range(len(labels) - 1, -1, -1):  # children before their parents
        if found[a] >= 0:
            total, used[a] = _heaviest([(c, found[c]) for c in below[a] if found[c] >= 0], weight)
            weight[a] = total + 1
    out = [-1] * len(labels)
    todo = [(0, found[0])] if found[0] >= 0 else []
    while todo:
        a, b = todo.pop()
        out[a] = b
        todo += used[a]
    return out


def says_template(label: str) -> bool:
    return label[0] == "*" or tag_of(label) in _NAMED_TEMPLATE


def never(label: str) -> bool:
    """Whether an element's name says what is no part of an article, wherever it stands."""
    return label[:2] == "**" or tag_of(label) in _NAMED_TEMPLATE


def tag_of(label: str) -> str:
    return label.lstrip("*").split("~", 1)[0].split(".", 1)[0]


def decide(labels: list[str], parents: list[int], n: list[int], constant: list[bool], chars: list[int], links: list[int], least: int) -> list[bool]:
    """Which nodes of a model are content, by the evidence of the pages that have them."""
    size = len(labels)
    tags = [tag_of(x) for x in labels]
    text = [c - k for c, k in zip(chars, links, strict=True)]
    named, article = [False] * size, [False] * size  # it or a node around it says template, or is an article
    for k in range(1, size):
        named[k] = named[parents[k]] or says_template(labels[k])
        article[k] = article[parents[k]] or tags[k] in ("article", "main")
    mass, all_chars, all_links = list(text), list(chars), list(links)
    one = [c or not x for c, x in zip(constant, chars, strict=True)]  # all that is in it is the same on every page
    for k in range(size - 1, 0, -1):
        for whole in (mass, all_chars, all_links):
            whole[parents[k]] += whole[k]
        one[parents[k]] &= one[k]
    # an article or main that holds text has the main slot, however much text there is elsewhere
    main = max(range(size), key=lambda k: (text[k] > 0, not named[k], article[k], text[k], -k))
    if text[main] <= 0:
        main = max(range(size), key=lambda k: (chars[k], -k))
    around = [main]
    while parents[around[-1]] >= 0:
        around.append(parents[around[-1]])
    section = next((k for k in around if tags[k] == "article"), next((k for k in around if tags[k] == "main"), -1))
    bounded = section >= 0
    if not bounded:
        section = next(k for k in around if tags[k] not in _TEXTUAL)
    on_path = set(around)
    varies = not constant[main]
    headed = [False] * size  # it or a node around it is a page's header
    keep, inside = [False] * size, [False] * size
    for k in range(size):
        headed[k] = k > 0 and (headed[parents[k]] or "head" in labels[k] and tags[k] not in _HEADINGS)
        known = n[k] >= least and varies
        same = constant[k] and known and chars[k] > 0 and not (bounded and tags[k] in _OWN)
        inside[k] = k == section or k > 0 and inside[parents[k]]
        if not inside[k]:
            # a heading before the section
            keep[k] = not bounded and k < section and tags[k] in _HEADINGS and not (named[k] or headed[k] or same)
        elif k in on_path:
            keep[k] = not same
        else:
            inside[k] &= not (tags[k] == "article" or never(labels[k]))
            linked = all_links[k] > 0.5 * all_chars[k]
            if bounded:
                # a name that may be an article's own needs the pages' word: a text of all pages, or links
                inside[k] &= not (says_template(labels[k]) and (linked or known and one[k]))
            else:
                # no element tells the article: sections of little text and lists of links are no part of it
                little = mass[k] < 0.3 * mass[section]
                inside[k] &= not (little and (says_template(labels[k]) or tags[k] not in _TEXTUAL or linked))
            keep[k] = inside[k] and not same
    return keep


_SEEN = "host string, tree string, n long, low array<long>, high array<long>, chars array<long>, links array<long>"


def _evidence(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node: the hash of its texts, their characters, and those in links."""
    own, chars, links = (np.zeros(len(page.labels), np.int64) for _ in range(3))
    for node, text, linked in page.blocks:
        own[node] = hash_text(text, int(own[node]))
        chars[node] += len(text)
        links[node] += min(linked, len(text))
    return own, chars, links


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, by host and tree: the pages, and every node's least and greatest hash of its texts, and its sums."""
    for rb in batches:
        found: dict[tuple[str, str], list] = {}
        for host, html in zip(rb.column("host").to_pylist(), rb.column("html").to_pylist(), strict=True):
            page = Page(html)
            tree = page.tree()
            own, chars, links = (x[page.order] for x in _evidence(page))
            at = found.setdefault((host, tree), [0, own, own, 0, 0])
            at[:] = at[0] + 1, np.minimum(at[1], own), np.maximum(at[2], own), at[3] + chars, at[4] + links
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), pa.array([v[0] for v in found.values()], pa.int64()), *[pa.array([v[i].tolist() for v in found.values()], pa.list_(pa.int64())) for i in (1, 2, 3, 4)]], names=["host", "tree", "n", "low", "high", "chars", "links"])


def hash_text(text: str, before: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text, seed=before & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


_SLOT = ("host", "model", "slot", "n", "low", "high", "chars", "links")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The evidence of each tree's nodes for the slots of the host's model."""
    for rb in batches:
        rows = []
        for host, tree, model, n, *lists in zip(*(rb.column(c).to_pylist() for c in ("host", "tree", "model", "n", "low", "high", "chars", "links")), strict=True):
            rows += [(host, model, slot, n, *x) for slot, *x in zip(aligned(tree, model), *lists, strict=True) if slot >= 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), *[pa.int64()] * 6))], names=list(_SLOT))


def _decided(least: int):
    """(host, model, keep) of hosts (host, model, and lists by slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keep = []
            for model, slots, n, low, high, chars, links in zip(*(rb.column(c).to_pylist() for c in ("model", "slots", "n", "low", "high", "chars", "links")), strict=True):
                labels, parents = _nodes(model)
                of = dict(zip(slots, range(len(slots)), strict=True))
                have = [of.get(k) for k in range(len(labels))]
                lists = [[0 if i is None else x[i] for i in have] for x in (n, chars, links)]
                keep.append(decide(labels, parents, lists[0], [i is None or low[i] == high[i] for i in have], lists[1], lists[2], least))
            yield pa.RecordBatch.from_arrays([rb.column("host"), rb.column("model"), pa.array(keep, pa.list_(pa.bool_()))], names=["host", "model", "keep"])

    return run


def alone(page: Page, tree: str) -> list[bool]:
    """The content nodes of a page by itself, in the order of its tree."""
    _, chars, links = (x[page.order].tolist() for x in _evidence(page))
    labels, parents = _nodes(tree)
    return decide(labels, parents, [1] * len(labels), [False] * len(labels), chars, links, 2)


def content(page: Page, model: str | None, keep: list[bool] | None, known: dict | None = None) -> str:
    """The text of a page's content slots by its host's wrapper, or by itself where that finds none."""
    tree = page.tree()
    if model and keep:
        kept = None if known is None else known.get((tree, model))
        if kept is None:
            labels, parents = _nodes(tree)
            kept, bounded = [], []
            for k, slot in enumerate(aligned(tree, model)):
                bounded.append(k > 0 and (bounded[parents[k]] or tag_of(labels[k]) in ("article", "main")))
                odd = never(labels[k]) or not bounded[k] and says_template(labels[k])
                kept.append(keep[slot] if slot >= 0 else k > 0 and kept[parents[k]] and not odd)
            if known is not None and len(tree) < 1 << 14:
                if len(known) >= 2048:
                    known.clear()
                known[tree, model] = kept
        at = {node: k for node, k in zip(page.order, kept, strict=True)}
        blocks = [t for n, t, _ in page.blocks if at[n]]
        if blocks:
            return "\n\n".join(blocks)
    if not page.blocks:
        return ""
    at = dict(zip(page.order, alone(page, tree), strict=True))
    return "\n\n".join(t for n, t, _ in page.blocks if at[n])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for rb in batches:
        texts, size = [], 0
        first = 0
        pages = [rb.column(c) for c in ("page_id", "url")]

        def out(first: int, texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in pages), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])  # noqa: B023

        for k, (html, model, keep) in enumerate(zip(*(rb.column(c).to_pylist() for c in ("html", "model", "keep")), strict=True)):
            texts.append(content(Page(html), model, keep, known))
            size += len(texts[-1])
            if size > 8 << 20:
                yield out(first, texts)
                first, texts, size = k + 1, [], 0
        yield out(first, texts)


def wrappers(pages: DataFrame, least: int = 3) -> DataFrame:
    """(host, model, keep) induced from all pages (host, html) of the hosts that have at least `least`: the most frequent
    tree, and which of its nodes are content."""
    seen = pages.select("host", "html").mapInArrow(_seen, _SEEN)
    lists = ("low", "high", "chars", "links")
    seen = seen.select("host", "tree", "n", F.posexplode(F.arrays_zip(*lists)).alias("node", "x"))
    seen = seen.groupBy("host", "tree", "node").agg(F.sum("n").alias("n"), F.min("x.low").alias("low"), F.max("x.high").alias("high"), *[F.sum(f"x.{c}").alias(c) for c in lists[2:]])
    seen = written(seen, "seen")  # else pages are parsed again for each use
    trees = seen.where("node = 0").groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("model"), F.sum("n").alias("pages")).where(F.col("pages") >= least)
    seen = seen.groupBy("host", "tree").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("node", *lists))).alias("x"))
    slots = seen.join(trees.drop("pages"), "host").select("host", "tree", "model", "n", *[F.col(f"x.{c}").alias(c) for c in lists])
    slots = slots.mapInArrow(_slots, "host string, model string, slot long, n long, low long, high long, chars long, links long")
    slots = slots.groupBy("host", "model", "slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in lists[2:]])
    whole = slots.groupBy("host", "model").agg(F.sort_array(F.collect_list(F.struct("slot", "n", *lists))).alias("x"))
    whole = whole.select("host", "model", F.col("x.slot").alias("slots"), F.col("x.n").alias("n"), *[F.col(f"x.{c}").alias(c) for c in lists])
    return whole.mapInArrow(_decided(least), "host string, model string, keep array<boolean>")


def main_text(pages: DataFrame, least: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    found = written(wrappers(rows, least), "wrappers")
    size = found.agg(F.sum(F.length("host") + F.length("model") + F.size("keep") + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    return rows.join(found, "host", "left").select("page_id", "url", "html", "model", "keep").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
