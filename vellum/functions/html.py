"""The one HTML boundary: a document becomes a span table, and all that follows are column expressions over it.

Every text stands in it once, as an array of pieces. An element is a row of the table with the range of pieces below it, so
that elements within elements share their texts; a judge cuts the slices that it reads. Time and memory of a parse grow with
the document, however its tags are nested. A document that can't be parsed is a row with an error and no elements.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from vellum.functions import rules, shares, text

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
_RAW = frozenset(("script", "style"))
_HEADS = frozenset(("h2", "h3"))
_TAG = re.compile(r"<[^>]+>")
#: Words in a title for further reading at most.
_TITLE_WORDS = max(len(t.split()) for t in rules.COMPLEMENTARY_TITLES)
#: Characters that a document may give out as source of links and calls to action; nested ones repeat what they hold.
MOST_SOURCE = 64 << 20


class _Tree(HTMLParser):
    """Elements in document order. An end tag closes the nearest open element of its name, or nothing; nothing else is closed early."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.open: list[int] = []
        self.names: Counter[str] = Counter()
        #: Texts, stripped, and the ranges of them that elements hold.
        self.texts: list[str] = []
        self.spans: list[list[int]] = []
        #: What was read, in order, for elements whose source is asked for: their source is a range of it.
        self.source: list[str] = []
        self.sources: list[list[int]] = []
        self.buffer: list[str] = []
        self.hidden = 0

    def settle(self) -> None:
        data = "".join(self.buffer)
        self.buffer.clear()
        if data:
            self.source.append(data if self.open and self.elements[self.open[-1]]["tag"] in _RAW else _escaped(data))
        data = data.strip()
        if data and not self.hidden:
            self.texts.append(html.unescape(data))

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_comment(self, data: str) -> None:
        self.settle()
        self.source.append(f"<!--{data}-->")

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.settle()
        # Of attributes that repeat, the last counts.
        found = {k: v or "" for k, v in attrs}
        pos = len(self.elements)
        classes = " ".join(found["class"].split()) if "class" in found else None
        self.elements.append({
            "pos": pos, "last": pos, "parent": self.open[-1] if self.open else -1, "tag": tag,
            "href": found.get("href"), "target": found.get("target"), "rel": " ".join(found["rel"].split()) if "rel" in found else None,
            "classes": classes, "styled": "style" in found, "first": 0, "end": 0, "further": None, "html": None,
        })
        self.spans.append([len(self.texts), len(self.texts)])
        self.sources.append([len(self.source), len(self.source) + 1])
        listed = {k: " ".join(v.split()) if k in ("class", "rel") else v for k, v in found.items()}
        self.source.append("".join(("<", tag, *(f" {k}={_quoted(v)}" for k, v in listed.items()), "/>" if tag in _VOID else ">")))
        if tag not in _VOID:
            self.open.append(pos)
            self.names[tag] += 1
            self.hidden += tag in _HIDDEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.settle()
        if self.names[tag]:
            while self.shut() != tag:
                pass

    def shut(self) -> str:
        i = self.open.pop()
        self.elements[i]["last"] = len(self.elements) - 1
        self.spans[i][1] = len(self.texts)
        tag = self.elements[i]["tag"]
        self.source.append(f"</{tag}>")
        self.sources[i][1] = len(self.source)
        self.names[tag] -= 1
        self.hidden -= tag in _HIDDEN
        return tag

    def end(self) -> None:
        self.close()
        self.settle()
        while self.open:
            self.shut()
        #: Texts that have words, each a piece, and for each text the number of pieces before it.
        self.pieces, self.before = [], [0]
        self.at: list[int] = []
        for i, t in enumerate(self.texts):
            words = t.split()
            if words:
                self.pieces.append(" ".join(words))
                self.at.append(i)
            self.before.append(len(self.pieces))

    def complementary(self, pos: int) -> bool:
        """Whether an element's text is a title for further reading; only few pieces are looked at, however many it holds."""
        a, b = (self.before[x] for x in self.spans[pos])
        if not 0 < b - a <= _TITLE_WORDS or self.at[b - 1] - self.at[a] >= _TITLE_WORDS:
            return False
        return " ".join(self.texts[self.at[a] : self.at[b - 1] + 1]).strip().lower() in rules.COMPLEMENTARY_TITLES

    def plain(self, pos: int) -> str:
        """Text of an element, its strings stripped and joined."""
        return " ".join(self.texts[slice(*self.spans[pos])])

    def finish(self) -> dict:
        self.end()
        further, given = False, 0
        for e, (a, b), (c, d) in zip(self.elements, self.spans, self.sources, strict=True):
            e["first"], e["end"] = self.before[a], self.before[b]
            if e["tag"] in _HEADS:
                further = self.complementary(e["pos"])
            elif e["tag"] == "a":
                e["further"] = further
            if e["tag"] == "a" or (e["tag"] == "p" and "cta" in (e["classes"] or "").split()):
                e["html"] = "".join(self.source[c:d])
                given += len(e["html"])
                if given > MOST_SOURCE:
                    raise OverflowError("links or calls to action within one another")
        root = next((e["pos"] for e in self.elements if e["tag"] == "body"), -1)
        return {"error": None, "pieces": self.pieces, "root": root, "elements": self.elements, "sections": self.sections()}

    def sections(self) -> list[dict]:
        """What follows each h2 among its siblings, up to the next h2 among them: places of h3 headings and of blocks that have a text."""
        current: dict[int, list[int]] = {}
        found = []
        for e in self.elements:
            if e["tag"] == "h2":
                current[e["parent"]] = members = []
                found.append({"pos": e["pos"], "members": members})
            elif e["parent"] in current and e["end"] > e["first"] and (e["tag"] == "h3" or e["tag"] in rules.TEXT_BLOCKS):
                current[e["parent"]].append(e["pos"])
        return found


def _escaped(data: str) -> str:
    return data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _quoted(value: str) -> str:
    """An attribute's value in double quotes; in single ones if only it holds double ones."""
    value = _escaped(value)
    return f"'{value}'" if '"' in value and "'" not in value else '"' + value.replace('"', "&quot;") + '"'


class _Reading(_Tree):
    """Also the source without its tags, piece by piece, so that elements can be taken out of it."""

    def __init__(self):
        super().__init__()
        self.bare: list[str] = []
        self.places: list[list[int]] = []

    def settle(self) -> None:
        data = "".join(self.buffer)
        if data:
            raw = self.open and self.elements[self.open[-1]]["tag"] in _RAW
            self.bare.append(html.unescape(_TAG.sub(" ", data)) if raw else data)
        super().settle()

    def handle_comment(self, data: str) -> None:
        super().handle_comment(data)
        self.bare.append(_TAG.sub(" ", f"<!--{data}-->"))

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        self.places.append([len(self.bare), len(self.bare) + 1])
        self.bare.append(" ")

    def shut(self) -> str:
        i = self.open[-1]
        self.bare.append(" ")
        self.places[i][1] = len(self.bare)
        return super().shut()

    def lasting(self) -> str:
        """The text without sections for further reading: their heading and the sibling elements after it up to the next h2 or h3; bare text stays."""
        below = defaultdict(list)
        for e in self.elements:
            below[e["parent"]].append(e)
        gone = bytearray(len(self.bare))
        for siblings in below.values():
            inside = False
            for e in siblings:
                if e["tag"] in _HEADS:
                    inside = self.complementary(e["pos"])
                if inside:
                    a, b = self.places[e["pos"]]
                    gone[a:b] = b"\1" * (b - a)
        return " ".join("".join(p for p, out in zip(self.bare, gone, strict=True) if not out).split())


def reading(content: str) -> tuple[str, list[str]]:
    """The text without sections for further reading, and the texts of all links; raises what the parser raises."""
    tree = _Reading()
    tree.feed(content)
    tree.end()
    return tree.lasting(), [tree.plain(e["pos"]) for e in tree.elements if e["tag"] == "a"]


def failure(e: Exception) -> str:
    return f"html_parse_error:{type(e).__name__}"


def tokenize(content: str) -> dict:
    """The span table of a document; one that the parser rejects is a table of nothing, with an error."""
    tree = _Tree()
    try:
        tree.feed(content)
        return tree.finish()
    except Exception as e:  # noqa: BLE001 - whatever a document makes the parser raise concerns its row alone
        return {"error": failure(e), "pieces": [], "root": -1, "elements": [], "sections": []}


_KIND = pa.struct([
    ("error", pa.string()), ("pieces", pa.list_(pa.string())), ("root", pa.int32()),
    ("elements", pa.list_(pa.struct([("pos", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("href", pa.string()), ("target", pa.string()), ("rel", pa.string()), ("classes", pa.string()), ("styled", pa.bool_()), ("first", pa.int32()), ("end", pa.int32()), ("further", pa.bool_()), ("html", pa.string())]))),
    ("sections", pa.list_(pa.struct([("pos", pa.int32()), ("members", pa.list_(pa.int32()))]))),
])


@F.arrow_udf(from_arrow_type(_KIND))
def parse(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """content -> its span table: error, pieces of text, place of the body (or -1), elements in document order, sections of its h2 headings."""
    return shares.served(lambda found: pa.array([tokenize(c or "") for c in found.to_pylist()], _KIND), contents)


# Filters over its result, such as those that explode() implies, would else move below it and parse every document again.
parse = parse.asNondeterministic()


def body(page: Column) -> Column:
    """All text."""
    return F.array_join(page["pieces"], " ")


def text_of(page: Column, element: Column) -> Column:
    """The text below an element."""
    return F.array_join(F.slice(page["pieces"], element["first"] + 1, element["end"] - element["first"]), " ")


def _filled(element: Column) -> Column:
    return element["end"] > element["first"]


def sections(page: Column) -> Column:
    """Structs of h2, h3_headings, text (of h3 headings and blocks) and blocks of the sections."""
    at = lambda pos: F.get(page["elements"], pos)
    cut = lambda members: F.transform(members, lambda m: text_of(page, at(m)))
    heads = lambda s: F.filter(s["members"], lambda m: at(m)["tag"] == "h3")
    blocks = lambda s: F.filter(s["members"], lambda m: at(m)["tag"] != "h3")
    return F.transform(page["sections"], lambda s: F.struct(
        text_of(page, at(s["pos"])).alias("h2"), cut(heads(s)).alias("h3_headings"), F.array_join(cut(s["members"]), " ").alias("text"), F.array_join(cut(blocks(s)), " ").alias("blocks"),
    ))


def named(page: Column, tags: tuple[str, ...]) -> Column:
    return F.filter(page["elements"], lambda e: e["tag"].isin(*tags))


def children(page: Column, parent: Column) -> Column:
    return F.filter(page["elements"], lambda e: e["parent"] == parent)


def texts(page: Column, elements: Column) -> Column:
    return F.transform(elements, lambda e: text_of(page, e))


def headings(page: Column, tags: tuple[str, ...], empty: bool = True) -> Column:
    """Structs of index (from 0), level and text of the headings in order; empty ones only if asked for."""
    found = named(page, tags)
    found = found if empty else F.filter(found, _filled)
    return F.transform(found, lambda e, i: F.struct(i.alias("index"), e["tag"].alias("level"), text_of(page, e).alias("text")))


def introduction(page: Column, parent: Column, blocks: tuple[str, ...]) -> Column:
    """Text of the blocks right below the parent that come before the first h2 there."""
    below = children(page, parent)
    first = F.array_min(F.transform(F.filter(below, lambda e: e["tag"] == "h2"), lambda e: e["pos"]))
    kept = F.filter(below, lambda e: (first.isNull() | (e["pos"] < first)) & e["tag"].isin(*blocks) & _filled(e))
    return F.array_join(texts(page, kept), " ")


def conclusion(found: Column, excluded: tuple[str, ...], folded: bool = False) -> Column:
    """Text of the section titled so, else of the last whose title isn't excluded, else of the last; titles are compared in lower case or folded."""
    title = lambda s: text.fold_plain(s["h2"]) if folded else F.lower(F.trim(s["h2"]))
    explicit = F.filter(found, lambda s: title(s) == "conclusion")
    kept = F.filter(found, lambda s: ~title(s).isin(*excluded))
    return F.coalesce(F.get(explicit, F.lit(0))["blocks"], F.try_element_at(kept, F.lit(-1))["blocks"], F.try_element_at(found, F.lit(-1))["blocks"], F.lit(""))


def used_tags(page: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(page["elements"], lambda e: e["tag"])))


def has(page: Column, tag: str) -> Column:
    return F.exists(page["elements"], lambda e: e["tag"] == tag)


def styled_outside_tables(page: Column, tables: tuple[str, ...]) -> Column:
    return F.exists(page["elements"], lambda e: e["styled"] & ~e["tag"].isin(*tables))


def cta_signals(page: Column, complementary: tuple[str, ...]) -> Column:
    """Calls to action among the elements right below the root: paragraphs of class cta, and what surrounds them."""
    below = F.transform(children(page, page["root"]), lambda e, i: F.struct(i.alias("index"), e.alias("e")))
    classes = lambda e: F.split(F.coalesce(e["classes"], F.lit("")), " ")
    cta = F.filter(below, lambda x: (x["e"]["tag"] == "p") & F.array_contains(classes(x["e"]), "cta"))
    strong = lambda e: F.filter(page["elements"], lambda s: (s["tag"] == "strong") & (s["pos"] > e["pos"]) & (s["pos"] <= e["last"]))

    def block(x: Column) -> Column:
        first = F.get(strong(x["e"]), F.lit(0))
        return F.struct(
            x["index"].alias("index"), x["e"]["html"].alias("html"), text_of(page, x["e"]).alias("text"), x["e"]["tag"].alias("tag_name"), classes(x["e"]).alias("classes"),
            first.isNotNull().alias("has_strong"), F.when(first.isNotNull(), text_of(page, first)).alias("strong_text"),
        )

    at = lambda *titles: F.transform(F.filter(below, lambda x: x["e"]["tag"].isin("h2", "h3", "h4") & F.lower(text_of(page, x["e"])).isin(*titles)), lambda x: x["index"])
    further, key = at(*complementary), at("corrigé du quiz")
    return F.struct(
        F.size(below).alias("top_level_tag_count"), F.transform(cta, block).alias("cta_blocks"), F.size(cta).alias("cta_count"),
        F.transform(cta, lambda x: text_of(page, x["e"])).alias("cta_texts"), (F.size(cta) > 0).alias("has_cta"),
        (F.size(further) > 0).alias("has_complementary_reading"), further.alias("complementary_indexes"),
        (F.size(key) > 0).alias("has_quiz_correction"), key.alias("quiz_key_indexes"),
    )
