"""Main-text extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page is a tree of element and text tokens. Its wrapper is the same tree with runs of like
siblings folded into repeated groups. Two wrappers of a host are aligned child by child:
a mismatch is resolved by looking ahead on both sides for the token that fits next, what is
passed over becomes optional, and texts that differ become slots. Wrappers are folded
within each task, then merged per host in two steps, so a host with most pages is merged
in pieces. A text slot keeps its texts with the pages that held them, as the lowest hashes of
distinct pages; a text that nearly all of a host's pages have in the same place (the elements
around it, with their classes) is template, also as a member of a repeated group. Where a host
has more distinct pages than a slot keeps hashes, its wrapper proposes what is on about half of
them, and these texts are counted over all distinct pages.

The main text is what is left without the host's template. Tags and classes are hints: where
there is an article (or main) element, nothing outside it is main text, and a text inside needs
more pages to count as template; menus, headers, footers, sidebars, notices, adverts, forms and
comments are left out on any number of pages.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.plans.sizing import broadcast_if_small
from tidemark.session import settle

#: A quote inside a tag opens a value right after an equals sign only.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
#: Elements that end where one of the others starts, up to the nearest element that holds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HOLDS = frozenset("html body article main section div td th li ul ol table blockquote nav aside header footer form".split())
#: What is no main text, by tag, role, and word of a class or id.
DROP_TAGS = frozenset("head script style noscript template iframe nav footer aside form button select textarea input menu dialog svg object "
                      "canvas audio video title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb "
                       "breadcrumbs header masthead footer sidebar aside comment comments reply replies disqus discussion cookie cookies consent "
                       "gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
                       "widget toolbar pager pagination search form skip".split())
MAIN = frozenset({"article", "main"})
#: Listed words that name parts of texts as well. On an element inside an article they are no ground to drop it,
#: but its texts are template on as few pages as outside.
PART_WORDS = frozenset("discussion form header masthead menu nav navigation banner notice notices alert search social related recommended consent "
                       "reply replies skip".split())
#: Of these, whole classes of plain containers that name furniture wherever they are.
PART_CLASSES = PART_WORDS - frozenset("discussion form header masthead".split())
PLAIN = frozenset("div ul ol dl p span".split())
#: What may stand beside a listed word in a class of furniture ("comment-list", "share-buttons").
FURNITURE = frozenset("area bar block box button buttons container content group item items link links list section wrap wrapper".split())
#: Elements of a text that often have its words as an id: these need as many pages as any text of an article.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p section blockquote pre figure table".split())
#: With one of these, a class that says header is the heading of a text.
TEXT_WORDS = frozenset("article entry post content story body text title".split())
#: Elements that hold unlike things side by side.
CONTAINERS = frozenset("div section span article aside header footer form fieldset".split())
#: Elements inside an article that go when all their texts are template.
UNITS = frozenset("div section article aside header footer form fieldset ul ol dl details".split())
#: Levels of the tree; the texts of deeper elements stand beside each other on the last one.
MAX_DEPTH = 100
MAX_PERIOD = 3
#: Page hashes kept per text and per host, lowest first: with fewer distinct pages counts are exact, else what the wrapper proposes is counted over all pages.
SAMPLE = 64
#: Texts a slot keeps over pages beside those on many of them: those on most pages, the newest of equals.
SLOT_TEXTS = 64
#: A slot keeps every text until it has seen so many pages, then every text on this share of them, however many there are.
SLOT_PAGES = 16
SLOT_SHARE = 0.45
#: A template text is on this share of a host's distinct pages, and on so many of them.
NEARLY_ALL = 0.9
LEAST_PAGES = 2
#: Inside article and main, where a few near copies would look like template.
LEAST_PAGES_IN_MAIN = 8


class Node:
    """An element (``sig``: tag and class words) or, with ``sig`` None, a text."""

    __slots__ = ("sig", "tag", "dropped", "children", "text", "hint", "inside")

    def __init__(self, sig, tag="", dropped=False, text=None, hint=False, inside=False):
        self.sig, self.tag, self.dropped, self.text, self.hint, self.inside = sig, tag, dropped, text, hint, inside
        self.children: list[Node] = []


def _furniture(name: str) -> bool:
    """Whether a whole class (or id of a plain container) inside an article names what is no text: listed words alone, or with words of furniture."""
    parts = set(re.findall(r"[a-z]+", name))
    return not parts.isdisjoint(DROP_WORDS - PART_WORDS) and parts <= DROP_WORDS | FURNITURE


def _hinted(name: str) -> bool:
    """The same for words that name parts of texts as well: ground to drop a group of links."""
    parts = set(re.findall(r"[a-z]+", name))
    return not parts.isdisjoint(PART_WORDS) and parts <= DROP_WORDS | FURNITURE


def parse(page: str | None) -> Node:
    """Tree of a page. Missing, crossed and surplus end tags are mended.

    The tree has MAX_DEPTH levels: deeper elements are empty and their texts follow them, but
    what is inside a dropped element stays out at any depth.
    """
    root = Node("", "")
    stack, at, page = [root], 0, page or ""
    names_open: Counter = Counter()
    match, end = TOKEN.match, len(page)

    def leave(i):
        for n in stack[i:]:
            names_open[n.tag] -= 1
        if i >= MAX_DEPTH and any(n.tag not in INLINE for n in stack[i:]):
            stack[i - 1].children.append(Node("", "div"))  # ends a block on the last level
        del stack[i:]

    while at < end:
        found = match(page, at)
        raw, at = found.group(), found.end()
        if raw[0] != "<" or raw == "<":
            last = stack[-1].children
            if last and last[-1].sig is None:
                last[-1].text += raw
            else:
                last.append(Node(None, text=raw))
            continue
        if raw[1] in "!?":
            continue
        if raw[1] == "/":
            tag = TAG.match(raw).group(1).lower()
            for i in range(len(stack) - 1, 0, -1) if names_open[tag] else ():
                if stack[i].tag == tag:
                    leave(i)
                    break
                if tag in INLINE and stack[i].tag in HOLDS:
                    break
            continue
        if raw[-1] != ">":
            break  # the page ends inside a tag
        tag = TAG.match(raw).group(1).lower()
        if tag in CLOSES:
            ended, holders = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in holders:
                    break
                if stack[i].tag in ended:
                    leave(i)
                    break
        elif tag not in INLINE:
            for i in range(len(stack) - 1, 0, -1) if names_open["p"] else ():
                if stack[i].tag == "p":
                    leave(i)
                    break
                if stack[i].tag in HOLDS:
                    break
        words, names, classes, role, hidden = [], [], [], "", False
        inside = stack[-1].inside
        if len(raw) > len(tag) + 2:
            for name, a, b, c in ATTRIBUTE.findall(raw, len(tag) + 1):
                name, value = name.lower(), (a or b or c).lower()
                if name == "role":
                    role = value.strip()
                elif name in ("class", "id"):
                    words += re.findall(r"[a-z]+", value)
                    classes += value.split() if name == "class" else []
                    if name == "class" or tag in ("div", "ul", "ol"):
                        names += value.split()
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and NOT_SHOWN.search(value):
                    hidden = True
        if inside:
            said = "section" not in names and any(map(_furniture, names)) or tag in PLAIN and not PART_CLASSES.isdisjoint(classes)
        else:
            said = DROP_WORDS.intersection(words) if tag not in ("html", "body", "main") else ()
            if said and not TEXT_WORDS.isdisjoint(words):
                said -= {"header"}
        dropped = tag in DROP_TAGS or role in DROP_ROLES or bool(said) or hidden or tag == "header" and not inside
        if role == "main":
            tag = "main"
        node = Node(".".join([tag, *dict.fromkeys(words)]), tag, dropped, None, any(map(_hinted, names)), inside or tag in MAIN)
        stack[-1].children.append(node)
        if tag in VOID or raw.endswith("/>") and tag not in HOLDS and tag != "p":
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            if close is None:
                break
            node.children.append(Node(None, text=page[at:close.start()]))
            at = page.find(">", close.start()) + 1 or end
            continue
        if len(stack) >= MAX_DEPTH:
            # Its texts go to the element on the last level, those of a dropped one nowhere.
            deep = Node(node.sig, tag, dropped, None, node.hint, node.inside)
            deep.children = [] if dropped else stack[-1].children
            node = deep
        names_open[tag] += 1
        stack.append(node)
    return root


# Wrappers: ["t", {hash: pages}], ["e", sig, [items]] and groups ["g", [items]]; an item is [node, optional, repeated].


def _key(item) -> str:
    node = item[0]
    return "#" if node[0] == "t" else node[1] if node[0] == "e" else "(" + " ".join(map(_key, node[1])) + ")"


def _run_key(item) -> str:
    """What makes neighbours members of one repeated group: for plain containers the whole shape, else the token."""
    return _shape(item[0]) if item[0][0] == "e" and item[0][1].split(".")[0] in CONTAINERS else _key(item)


def _shape(node) -> str:
    return "#" if node[0] == "t" else (node[1] if node[0] == "e" else "") + "(" + " ".join(_shape(i[0]) for i in node[-1]) + ")"


def _merge_pages(a: list, b: list) -> list:
    return a if a == b else sorted({*a, *b})[:SAMPLE]


def _merge_texts(a: dict, b: dict) -> dict:
    """Texts of both slots, in ``a``. Slots of one page are not cut, so each text of it is counted."""
    for key, pages in b.items():
        a[key] = _merge_pages(a[key], pages) if key in a else pages
    if len(a) <= SLOT_TEXTS:
        return a
    seen = min(SAMPLE, len(set().union(*a.values())))
    if seen < SLOT_PAGES:
        return a
    ranked = sorted(a, key=lambda k: (-len(a[k]), k not in b, k))
    return {k: a[k] for i, k in enumerate(ranked) if i < SLOT_TEXTS or len(a[k]) >= SLOT_SHARE * seen}


def _merge_node(a, b):
    if a[0] == "t":
        return ["t", _merge_texts(a[1], b[1])]
    if a[0] == "e":
        return ["e", a[1], align(a[2], b[2])]
    return ["g", align(a[1], b[1])]


def _merge_item(a, b):
    return [_merge_node(a[0], b[0]), a[1] or b[1], a[2] or b[2]]


def fold(items: list) -> list:
    """Runs of equal tokens, or of equal groups of up to ``MAX_PERIOD`` tokens, become one repeated item."""
    for period in range(1, MAX_PERIOD + 1):
        keys, out, i = [_run_key(x) for x in items], [], 0
        while i < len(items):
            n = 1
            while keys[i:i + period] == keys[i + n * period:i + (n + 1) * period] and len(keys) >= i + (n + 1) * period:
                n += 1
            if n == 1:
                out.append(items[i])
                i += 1
                continue
            head = items[i:i + period]
            for k in range(1, n):
                head = [_merge_item(x, y) for x, y in zip(head, items[i + k * period:i + (k + 1) * period])]
            out.append([head[0][0], head[0][1], True] if period == 1 else [["g", head], False, True])
            i += n * period
        items = out
    return items


def align(a: list, b: list) -> list:
    """One item list that both lists match."""
    keys_a, keys_b = [_key(x) for x in a], [_key(x) for x in b]
    if keys_a == keys_b:
        return [_merge_item(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    where_a: dict[str, list[int]] = {}
    where_b: dict[str, list[int]] = {}
    for where, keys in ((where_a, keys_a), (where_b, keys_b)):
        for n in range(len(keys) - 1, -1, -1):  # lowest last, so passed places are popped off the end
            where.setdefault(keys[n], []).append(n)

    def ahead(where, key, start):
        places = where.get(key, [])
        while places and places[-1] < start:
            places.pop()
        return places[-1] if places else None

    while i < len(a) and j < len(b):
        if keys_a[i] == keys_b[j]:
            out.append(_merge_item(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        in_a, in_b = ahead(where_a, keys_b[j], i), ahead(where_b, keys_a[i], j)
        if in_a is not None and (in_b is None or in_a - i <= in_b - j):
            out += [[x[0], True, x[2]] for x in a[i:in_a]]
            i = in_a
        elif in_b is not None:
            out += [[x[0], True, x[2]] for x in b[j:in_b]]
            j = in_b
        else:
            out += [[a[i][0], True, a[i][2]], [b[j][0], True, b[j][2]]]
            i, j = i + 1, j + 1
    return fold(out + [[x[0], True, x[2]] for x in [*a[i:], *b[j:]]])


def page_hash(root: Node) -> int:
    """Hash of a page's main text by tags and classes: pages that differ in scripts or menus alone are one page."""
    return xxhash.xxh64_intdigest(main_text(root).encode("utf-8", "surrogatepass")) >> 11


def infer(node: Node, page: int = 0, held: set | None = None, place: int = 0):
    """The wrapper of one page, whose hash is ``page``; ``held`` receives the keys of its placed texts."""
    items, place = [], 0 if held is None else _below(place, node.sig)
    for child in node.children:
        if child.sig is not None:
            items.append([infer(child, page, held, place), False, False])
        elif not child.text.isspace():
            key = _text_key(child.text)
            items.append([["t", {key: [page]}], False, False])
            if held is not None:
                held.add(_placed(place, key))
    return ["e", node.sig, fold(items)]


def _text_key(text: str) -> str:
    return xxhash.xxh64_hexdigest(" ".join(html.unescape(text).split()).encode("utf-8", "surrogatepass"))


def _below(place: int, sig: str) -> int:
    """Hash of the elements from the root down to one named ``sig`` in ``place``."""
    return xxhash.xxh64_intdigest(sig, seed=place)


def _placed(place: int, key: str) -> int:
    """Hash of a text in its place, as a signed number."""
    return xxhash.xxh64_intdigest(key, seed=place) - (1 << 63)


def template_texts(wrapper, pages: list[int], share: float = NEARLY_ALL) -> list[int]:
    """Keys of the placed texts that nearly all pages of the host have; ``pages`` are its page hashes, or the lowest of them."""
    held: dict = {}
    stack, sample = [(wrapper, 0, False)], set(pages)
    while stack:
        node, place, inside = stack.pop()
        if node[0] == "t":
            for key, on in node[1].items():
                at = _placed(place, key), inside
                held[at] = _merge_pages(held[at], on) if at in held else on
        elif node[0] == "g":
            stack += [(i[0], place, inside) for i in node[1]]
        else:
            tag, *words = node[1].split(".")
            place, inside = _below(place, node[1]), tag in MAIN or inside and (tag in TEXT_TAGS or PART_WORDS.isdisjoint(words))
            stack += [(i[0], place, inside) for i in node[2]]
    return sorted(k for (k, inside), on in held.items() if len(on) >= (LEAST_PAGES_IN_MAIN if inside else LEAST_PAGES)
                  and len(sample.intersection(on)) >= share * len(sample))


def expression(wrapper) -> str:
    """The wrapper as a regular expression over tokens, for people."""
    if wrapper[0] == "t":
        return "TEXT" if len(wrapper[1]) > 1 else "'=" + next(iter(wrapper[1]))[:6] + "'"
    inner = " ".join(expression(n) if not (o or r) else f"({expression(n)}){'*' if o and r else '+' if r else '?'}" for n, o, r in wrapper[-1])
    return inner if wrapper[0] == "g" else f"<{wrapper[1]}> {inner} </>" if inner else f"<{wrapper[1]}/>"


def _fixed(main: Node, place: int, template: frozenset) -> set[int]:
    """Containers below a main element that go (by ``id``): all their texts are template, or they are hinted groups of links."""
    out: set[int] = set()

    def look(node, place, linked):
        """(texts, of them template, of them in links) below a node."""
        texts = fixed = links = 0
        for child in node.children:
            if child.sig is None:
                if not child.text.isspace():
                    texts, links = texts + 1, links + linked
                    fixed += bool(template) and _placed(place, _text_key(child.text)) in template
            elif not child.dropped:
                t, f, k = look(child, _below(place, child.sig) if template else 0, linked or child.tag == "a")
                if t and (child.tag in UNITS and f == t or child.hint and k == t > 1):
                    out.add(id(child))
                texts, fixed, links = texts + t, fixed + f, links + k
        return texts, fixed, links

    look(main, _below(place, main.sig) if template else 0, False)
    return out


def main_text(root: Node, template: frozenset = frozenset()) -> str:
    """Blocks of main text, white space inside a block as one space, joined by line ends. ``template`` has keys of placed texts.

    Inside article and main whole containers of template texts go, elsewhere each such text.
    """
    below = _below if template else lambda place, sig: 0
    mains, stack = [], [(root, 0)]
    while stack:
        node, place = stack.pop()
        if node.sig is None or node.dropped:
            continue
        if node.tag in MAIN:
            mains.append((node, place))
        else:
            place = below(place, node.sig)
            stack += [(c, place) for c in reversed(node.children)]
    blocks, current = [], []

    def close():
        text = " ".join(html.unescape("".join(current)).split())
        if text:
            blocks.append(text)
        current.clear()

    gone = set().union(*(_fixed(m, place, template) for m, place in mains))
    work: list = list(reversed(mains or [(root, 0)]))
    while work:
        node, place = work.pop()
        if node is None:
            close()
        elif node.sig is None:
            if mains or not template or _placed(place, _text_key(node.text)) not in template:
                current.append(node.text)
        elif not node.dropped and id(node) not in gone:
            if node.tag in ("br", "wbr", "img"):
                current.append(" " if node.tag == "br" else "")
                continue
            place = below(place, node.sig)
            if node.tag not in INLINE:
                close()
                work.append((None, 0))
            work += [(c, place) for c in reversed(node.children)]
    close()
    return "\n".join(blocks)


HOSTS_HELD = 1000


def host_of(url: str):
    """Host of a URL, in lower case without a port; empty for none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _merge_rows(key_fields: list[str]):
    def run(key, table):
        merged, pages = None, []
        for text, own in sorted(zip(table["wrapper"].to_pylist(), table["pages"].to_pylist())):
            wrapper, pages = json.loads(text), _merge_pages(pages, own)
            merged = wrapper if merged is None else _merge_node(merged, wrapper)
        columns = {f: pa.array([k.as_py()], k.type) for f, k in zip(key_fields, key)}
        return pa.table({**columns, "pages": pa.array([pages], pa.list_(pa.int64())), "wrapper": pa.array([json.dumps(merged)], pa.string())})

    return run


def _read_pages(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, pages, wrapper, page, texts), settled: rows with a wrapper fold pages of a host, those with ``texts`` have the placed texts of one page.

    A task holds at most HOSTS_HELD wrappers.
    """
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))

    def run(batches):
        held: dict = {}
        names = ["host", "pages", "wrapper", "page", "texts"]

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([p for p, _ in held.values()], pa.list_(pa.int64())),
                                              pa.array([json.dumps(w) for _, w in held.values()], pa.string()),
                                              pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.list_(pa.int64()))], names=names)
            held.clear()

        for batch in batches:
            hashes, placed = [], []
            for host, html_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root, texts = parse(html_text), set()
                page = page_hash(root)
                wrapper = infer(root, page, texts)
                hashes.append(page)
                placed.append(sorted(texts))
                if host in held:
                    own, merged = held[host]
                    held[host] = _merge_pages(own, [page]), _merge_node(merged, wrapper)
                else:
                    held[host] = [page], wrapper
                if len(held) > HOSTS_HELD:
                    yield from flush()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.string()), pa.array(hashes, pa.int64()),
                                              pa.array(placed, pa.list_(pa.int64()))], names=names)
        if held:
            yield from flush()

    return settle(rows.mapInArrow(run, "host string, pages array<bigint>, wrapper string, page bigint, texts array<bigint>"), "pages")


def _merge_wrappers(read: DataFrame, salts: int = 16) -> DataFrame:
    """(host, pages, wrapper): one wrapper per host, as JSON, with the lowest hashes of its distinct pages."""
    partial = read.filter("wrapper IS NOT NULL").select("host", "pages", "wrapper").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).cast("int"))
    step = partial.groupBy("host", "salt").applyInArrow(_merge_rows(["host", "salt"]), "host string, salt int, pages array<bigint>, wrapper string")
    return step.groupBy("host").applyInArrow(_merge_rows(["host"]), "host string, pages array<bigint>, wrapper string")


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 16) -> DataFrame:
    """(host, pages, wrapper): one wrapper per host, as JSON, with the lowest hashes of its distinct pages."""
    return _merge_wrappers(_read_pages(pages, url_col, html_col), salts)


def _counted(read: DataFrame, proposed: DataFrame) -> DataFrame:
    """(host, template): of the texts proposed for a host (host, template) those that nearly all its distinct pages have, by counting them all."""
    seen = read.filter("page IS NOT NULL").join(broadcast_if_small(proposed), "host").select("host", "page", F.array_intersect("texts", "template").alias("hits"))
    # copies of a page go before their texts are told apart; a text is on a distinct page if any copy has it
    each = settle(seen.dropDuplicates(["host", "page", "hits"]), "hits")
    sizes = each.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    found = each.select("host", "page", F.explode("hits").alias("text")).distinct().groupBy("host", "text").agg(F.count(F.lit(1)).alias("on"))
    return (found.join(sizes, "host").filter(F.col("on") >= F.lit(NEARLY_ALL) * F.col("n"))
            .groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("template")))  # no more than the wrapper proposes


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) per row: the main text and its length in code points.

    A null or empty page, and one without main text, gives an empty text. Pages without a
    URL form one host. Repeated rows each give a row. The wrappers' template texts are
    broadcast when counted small, else joined on the host.
    """
    read = _read_pages(pages, url_col, html_col)

    def texts_of(batches):
        for batch in batches:
            own = batch.column(1).to_pylist()
            keys = [template_texts(json.loads(w), p, NEARLY_ALL if len(p) < SAMPLE else SLOT_SHARE) for p, w in zip(own, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) < SAMPLE for p in own], pa.bool_()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["host", "sure", "template"])

    proposed = settle(_merge_wrappers(read).mapInArrow(texts_of, "host string, sure boolean, template array<bigint>").filter("size(template) > 0"), "proposed")
    templates = (proposed.filter("sure").select("host", "template").unionByName(_counted(read, proposed.filter("NOT sure").select("host", "template")))
                 .withColumnRenamed("host", "h"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    joined = rows.join(broadcast_if_small(templates), F.col("host") == F.col("h"), "left").select("id", "url", "html", "template")
    schema = T.StructType([T.StructField(id_col, joined.schema["id"].dataType), T.StructField(url_col, joined.schema["url"].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(parse(page), frozenset(template or ())) for page, template in
                     zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(run, schema)
