"""Forward conversion of small documents, against target trees written by hand."""

import json

import pytest

from docweft.operators import diagnostics, forward
from docweft.plans.session import kept_in_place as saved
from docweft.sources.nodes import flatten


def t(value):
    return {"type": "text", "value": value}


def para(*children, **more):
    return {"type": "paragraph", "children": list(children), **more}


def S(s):
    return {"t": "Str", "c": s}


SP, NO = {"t": "Space"}, ["", [], []]


def P(*xs):
    return {"t": "Para", "c": list(xs)}


def cell(value, **more):
    return {"type": "table_cell", "children": [t(value)] if value else [], **more}


def out_cell(value, align="AlignDefault", rows=1, cols=1):
    return [NO, {"t": align}, rows, cols, [{"t": "Plain", "c": [S(value)]}] if value else []]


def block_cell(blocks, rows=1, cols=1, attr=NO):
    return [attr, {"t": "AlignDefault"}, rows, cols, blocks]


def item(blocks, **more):
    return {"type": "list_item", "children": blocks, **more}


def lst(*items, tight=True):
    return {"type": "list", "ordered": False, "tight": tight, "items": [item(x) for x in items]}


def row(*cells, marked=False):
    cells = [item(x, **({"attrs": {"keyValues": {"header-row": ""}}} if marked and not i else {})) for i, x in enumerate(cells)]
    return item([{"type": "list", "ordered": False, "tight": True, "items": cells}])


def box(*rows, **more):
    return {"type": "admonition", "kind": "list-table", "children": [{"type": "list", "ordered": False, "tight": True, "items": list(rows)}], **more}


def note(label, *blocks):
    return {"type": "footnote", "label": label, "children": list(blocks)}


def ref(label):
    return {"type": "footnote_ref", "id": label}


def cite():
    return {"type": "citation_group", "raw": "@k", "items": [{"key": "k"}]}


def cited(n):
    return {"t": "Cite", "c": [[{"citationId": "k", "citationPrefix": [], "citationSuffix": [], "citationMode": {"t": "NormalCitation"}, "citationNoteNum": n, "citationHash": 0}], [S("@k")]]}


def N_(*blocks):
    return {"t": "Note", "c": list(blocks)}


DEEP = 2500
CASES = {
    "text": ([para(t("a  b c"), t("d"))], [P(S("a"), SP, S("b"), SP, S("cd"))]),
    "emphasis": ([para({"type": "emphasis", "children": [{"type": "strong", "children": [t("x")]}]}, {"type": "soft_break"})], [P({"t": "Emph", "c": [{"t": "Strong", "c": [S("x")]}]}, {"t": "SoftBreak"})]),
    "heading": ([{"type": "heading", "level": 2, "attrs": {"id": "h", "classes": ["c"], "keyValues": {"k": "v"}}, "children": [t("T")]}], [{"t": "Header", "c": [2, ["h", ["c"], [["k", "v"]]], [S("T")]]}]),
    "code": ([{"type": "code_block", "lang": "py", "content": 'a "q"\nb', "attrs": {"classes": ["n"]}}], [{"t": "CodeBlock", "c": [["", ["py", "n"], []], 'a "q"\nb']}]),
    "wrapped": ([para(t("x"), attrs={"id": "p"})], [{"t": "Div", "c": [["p", [], []], [P(S("x"))]]}]),
    "list": (
        [{"type": "list", "tight": True, "items": [{"type": "list_item", "children": [para(t("a"))]}, {"type": "list_item", "checked": True, "children": [para(t("b"))]}, {"type": "list_item", "checked": False, "children": [{"type": "block_quote", "children": [para(t("q"))]}]}]}],
        [{"t": "BulletList", "c": [[{"t": "Plain", "c": [S("a")]}], [{"t": "Plain", "c": [S("☒"), SP, S("b")]}], [{"t": "Plain", "c": [S("☐"), SP]}, {"t": "BlockQuote", "c": [P(S("q"))]}]]}],
    ),
    "ordered": ([{"type": "list", "ordered": True, "start": 3, "olType": "a", "delim": ")", "items": [{"type": "list_item", "children": [para(t("a"))]}]}], [{"t": "OrderedList", "c": [[3, {"t": "LowerAlpha"}, {"t": "OneParen"}], [[P(S("a"))]]]}]),
    "definitions": (
        [{"type": "definition_list", "items": [{"type": "definition_term", "children": [t("a")]}, {"type": "definition_term", "children": [t("b")]}, {"type": "definition_description", "children": [para(t("x"))]}, {"type": "definition_term", "children": [t("c")]}]}],
        [{"t": "DefinitionList", "c": [[[S("a"), {"t": "LineBreak"}, S("b")], [[P(S("x"))]]], [[S("c")], []]]}],
    ),
    "quotes": (
        [para({"type": "smart_punctuation", "kind": "left_double_quote", "glyph": "“"}, t("a "), {"type": "smart_punctuation", "kind": "right_single_quote", "glyph": "’"}, {"type": "smart_punctuation", "kind": "right_double_quote", "glyph": "”"}, {"type": "smart_punctuation", "kind": "em_dash", "value": "--"})],
        [P({"t": "Quoted", "c": [{"t": "DoubleQuote"}, [S("a"), SP, S("’")]]}, S("—"))],
    ),
    "references": (
        [{"type": "heading", "children": [t("My "), {"type": "emphasis", "children": [t("head")]}]}, para({"type": "heading_ref", "target": "my-head"}, t(" "), {"type": "heading_ref", "target": "none"}, {"type": "link", "ref": "my head", "rawRef": "[my head][]", "children": [t("my head")]})],
        [
            {"t": "Header", "c": [1, NO, [S("My"), SP, {"t": "Emph", "c": [S("head")]}]]},
            P({"t": "Link", "c": [["", ["crossref"], []], [S("My"), SP, {"t": "Emph", "c": [S("head")]}], ["#my-head", ""]]}, SP, {"t": "Link", "c": [["", ["crossref", "unresolved"], []], [S("none")], ["#none", ""]]}, {"t": "Link", "c": [NO, [S("my"), SP, S("head")], ["#My-head", ""]]}),
        ],
    ),
    "notes": (
        [para({"type": "footnote_ref", "id": "n"}, {"type": "footnote_ref", "id": "m"}, {"type": "inline_footnote", "inline": [t("i")]}), {"type": "footnote", "label": "n", "children": [para(t("note"))]}],
        [P({"t": "Note", "c": [P(S("note"))]}, S("[^m]"), {"t": "Note", "c": [P(S("i"))]})],
    ),
    "citation": (
        [para({"type": "inline_footnote", "inline": [t("i")]}, {"type": "citation_group", "raw": "[see @k, p. 3]", "items": [{"key": "k", "prefix": [t("see")], "locator": [t("p. 3")], "locatorLabel": "page"}, {"key": "z", "suppressAuthor": True}]})],
        [P({"t": "Note", "c": [P(S("i"))]}, {"t": "Cite", "c": [[
            {"citationId": "k", "citationPrefix": [S("see")], "citationSuffix": [S(","), SP, S("p."), SP, S("3")], "citationMode": {"t": "NormalCitation"}, "citationNoteNum": 2, "citationHash": 0},
            {"citationId": "z", "citationPrefix": [], "citationSuffix": [], "citationMode": {"t": "SuppressAuthor"}, "citationNoteNum": 2, "citationHash": 0},
        ], [S("[see"), SP, S("@k,"), SP, S("p."), SP, S("3]")]]})],
    ),
    "figure": (
        [{"type": "figure", "attrs": {"id": "f"}, "target": {"type": "image", "src": "i.png", "alt": "A"}, "caption": [t("Fig "), {"type": "caption_number"}, t(": x")]}, para({"type": "heading_ref", "target": "f"})],
        [
            {"t": "Figure", "c": [["f", [], []], [None, [{"t": "Plain", "c": [S("Fig"), SP, S("1:"), SP, S("x")]}]], [{"t": "Plain", "c": [{"t": "Image", "c": [NO, [S("A")], ["i.png", ""]]}]}]]},
            P({"t": "Link", "c": [NO, [S("Fig"), SP, S("1")], ["#f", ""]]}),
        ],
    ),
    "table": (
        [{"type": "table", "columns": [{"align": "right"}], "rows": [
            {"type": "table_row", "cells": [cell("a", header=True), cell("b", header=True)]},
            {"type": "table_row", "cells": [cell("c"), cell("", span="colspan")]},
            {"type": "table_row", "cells": [cell("e", header=True), cell("f")]},
            {"type": "table_row", "cells": [cell("", span="rowspan", header=True)]},
        ]}],
        [{"t": "Table", "c": [NO, [None, []], [[{"t": "AlignRight"}, {"t": "ColWidthDefault"}], [{"t": "AlignDefault"}, {"t": "ColWidthDefault"}]],
            [NO, [[NO, [out_cell("a"), out_cell("b")]]]],
            [[NO, 0, [], [[NO, [out_cell("c", cols=2)]]]], [NO, 1, [], [[NO, [out_cell("e", rows=2), out_cell("f")]], [NO, [out_cell("")]]]]],
            [NO, []]]}],
    ),
    "lines": ([{"type": "line_block", "children": [para(t("a"), {"type": "hard_break"}, t("b")), para(t("c"))]}], [{"t": "LineBlock", "c": [[S("a")], [S("b")], [], [S("c")]]}]),
    "spans": (
        [para({"type": "span", "attrs": {"classes": ["smallcaps"]}, "children": [t("x")]}, {"type": "symbol", "name": "sun"}, {"type": "symbol", "name": "no"}, {"type": "mention", "user": "u"}, {"type": "math", "display": True, "content": "\\x"})],
        [P({"t": "SmallCaps", "c": [S("x")]}, S("☼"), {"t": "Span", "c": [["", ["symbol"], [["data-symbol", "no"]]], [S(":no:")]]}, {"t": "Span", "c": [["", ["mention"], [["data-user", "u"]]], [S("@u")]]}, {"t": "Math", "c": [{"t": "DisplayMath"}, "\\x"]})],
    ),
    "unknown": ([{"type": "zzz", "value": "v w"}, para({"type": "comment", "content": "gone"}, t("x"))], [P(S("v"), SP, S("w")), P(S("x"))]),
    "empty": ([], []),
    "nested notes": (
        [para({"type": "footnote_ref", "id": "a"}), {"type": "footnote", "label": "a", "children": [para(t("x"), {"type": "footnote_ref", "id": "b"})]}, {"type": "footnote", "label": "b", "children": [para(t("y"), {"type": "heading_ref", "target": "H"})]}, {"type": "footnote", "label": "a", "children": []}, {"type": "heading", "children": [t("H")]}],
        [P({"t": "Note", "c": [P(S("x"), {"t": "Note", "c": [P(S("y"), {"t": "Link", "c": [["", ["crossref"], []], [S("H")], ["#H", ""]]})]})]}), {"t": "Header", "c": [1, NO, [S("H")]]}],
    ),
    "circles": (
        [para({"type": "footnote_ref", "id": "a"}), {"type": "footnote", "label": "a", "children": [para(t("x"), {"type": "footnote_ref", "id": "b"})]}, {"type": "footnote", "label": "b", "children": [para({"type": "footnote_ref", "id": "a"})]}],
        [P({"t": "Note", "c": [P(S("x[^b]"))]})],
    ),
    "crossed headings": (
        [{"type": "heading", "attrs": {"id": "Top"}, "children": [t("a "), {"type": "heading_ref", "target": "Top"}]}, {"type": "heading", "attrs": {"id": "top"}, "children": [t("b")]}, para({"type": "heading_ref", "target": "TOP"}), para({"type": "heading_ref", "target": "tOp"})],
        [{"t": "Header", "c": [1, ["Top", [], []], [S("a"), SP, {"t": "Link", "c": [["", ["crossref"], []], [S("a"), SP], ["#Top", ""]]}]]}, {"t": "Header", "c": [1, ["top", [], []], [S("b")]]}]
        + [P({"t": "Link", "c": [["", ["crossref"], []], [S("b")], [f"#{x}", ""]]}) for x in ("TOP", "tOp")],
    ),
    "broken links": (
        [para({"type": "link", "ref": "r", "rawRef": "[te\nxt][r]", "children": [t("text")]}, {"type": "image", "ref": "s", "src": "", "alt": "al t"}, {"type": "link", "ref": "q", "href": "", "children": [t("kept")]})],
        [P(S("[te"), {"t": "SoftBreak"}, S("xt][r]al"), SP, S("tkept"))],
    ),
    "panels": (
        [{"type": "figure_group", "attrs": {"id": "g"}, "caption": [t("Plate "), {"type": "caption_number"}], "children": [
            {"type": "figure", "attrs": {"id": "p"}, "target": {"type": "image", "src": "a", "alt": ""}, "caption": [t("n "), {"type": "caption_number"}]}, {"type": "figure", "attrs": {"id": "q"}, "target": {"type": "block_quote", "children": [para(t("z"))]}}, para(t("stray"))]},
         para({"type": "heading_ref", "target": "g"}, {"type": "heading_ref", "target": "q"})],
        [{"t": "Figure", "c": [["g", [], []], [None, [{"t": "Plain", "c": [S("Plate"), SP, S("1")]}]], [
            {"t": "Figure", "c": [["p", [], []], [None, [{"t": "Plain", "c": [S("n"), SP, S("#")]}]], [{"t": "Plain", "c": [{"t": "Image", "c": [NO, [], ["a", ""]]}]}]]}, {"t": "Figure", "c": [["q", [], []], [None, []], [{"t": "BlockQuote", "c": [P(S("z"))]}]]}, P(S("stray"))]]},
         P({"t": "Link", "c": [NO, [S("Plate"), SP, S("1")], ["#g", ""]]}, {"t": "Link", "c": [["", ["crossref"], []], [S("Plate"), SP, S("1b")], ["#q", ""]]})],
    ),
    "figured table": (
        [{"type": "figure", "attrs": {"id": "f"}, "shortCaption": [t("s")], "caption": [t("c")], "target": {"type": "table", "attrs": {"id": "t", "keyValues": {"widths": "1", "k": "v"}}, "caption": [t("own")], "rows": [{"type": "table_row", "cells": [cell("a")]}]}}, {"type": "figure", "caption": [t("none")]}],
        [{"t": "Table", "c": [["t", [], [["k", "v"]]], [[S("s")], [{"t": "Plain", "c": [S("c")]}]], [[{"t": "AlignDefault"}, {"t": "ColWidthDefault"}]], [NO, []], [[NO, 0, [], [[NO, [out_cell("a")]]]]], [NO, []]]}],
    ),
    "row groups": (
        [{"type": "table", "rowGroups": {"headRows": 1, "bodies": [{"headRows": 1, "bodyRows": 1, "rowHeadColumns": 1, "attrs": {"id": "b"}}, {"headRows": 0, "bodyRows": 0}], "footRows": 1}, "caption": [], "rows": [{"type": "table_row", "cells": [cell(x, align="left")]} for x in "hijk"]}],
        [{"t": "Table", "c": [NO, [None, []], [[{"t": "AlignLeft"}, {"t": "ColWidthDefault"}]], [NO, [[NO, [out_cell("h")]]]], [[["b", [], []], 1, [[NO, [out_cell("i", "AlignLeft")]]], [[NO, [out_cell("j", "AlignLeft")]]]], [NO, 0, [], []]], [NO, [[NO, [out_cell("k", "AlignLeft")]]]]]}],
    ),
    "misfit groups": ([{"type": "table", "rowGroups": {"headRows": 2, "bodies": [], "footRows": 0}, "rows": [{"type": "table_row", "cells": [cell("a", header=True)]}]}], [{"t": "Table", "c": [NO, [None, []], [[{"t": "AlignDefault"}, {"t": "ColWidthDefault"}]], [NO, [[NO, [out_cell("a")]]]], [[NO, 0, [], []]], [NO, []]]}]),
    "admonition": (
        [{"type": "admonition", "kind": "tip", "title": [t("T")], "label": "L", "attrs": {"classes": ["x"]}, "children": [para(t("b"))]}, {"type": "div", "label": "M", "children": []}, {"type": "div", "attrs": {"classes": ["line-block"]}, "children": [para(t("v"), {"type": "soft_break"}, t("w"))]}],
        [{"t": "Div", "c": [["", ["admonition", "tip", "x"], []], [P({"t": "Strong", "c": [S("T")]}), P({"t": "Strong", "c": [S("L")]}), P(S("b"))]]}, {"t": "Div", "c": [NO, [P({"t": "Strong", "c": [S("M")]})]]}, {"t": "LineBlock", "c": [[S("v")], [S("w")]]}],
    ),
    "old forms": (
        [{"type": "definition_list", "items": [{"terms": [[t("a")]], "definitions": [[para(t("x"))]]}, {"terms": [[t("b")]], "definitions": []}]}, para({"type": "footnote", "inline": [t("i")]}, {"type": "critic-comment", "text": "c"}, {"type": "heading_ref", "target": "z", "resolvedText": "old"})],
        [{"t": "DefinitionList", "c": [[[S("a")], [[P(S("x"))]]], [[S("b")], []]]}, P({"t": "Note", "c": [P(S("i"))]}, {"t": "Span", "c": [["", ["comment-annotation"], []], [S("c")]]}, {"t": "Link", "c": [["", ["crossref", "unresolved"], []], [S("z")], ["#z", ""]]})],
    ),
    "integral": (
        [para({"type": "citation_group", "mode": "integral", "raw": "[+@k]", "items": [{"key": "k", "suffix": [t("x")]}, {"key": "l", "suppressAuthor": True}]})],
        [P({"t": "Cite", "c": [[{"citationId": "k", "citationPrefix": [], "citationSuffix": [SP, S("x")], "citationMode": {"t": "AuthorInText"}, "citationNoteNum": 1, "citationHash": 0}, {"citationId": "l", "citationPrefix": [], "citationSuffix": [], "citationMode": {"t": "SuppressAuthor"}, "citationNoteNum": 1, "citationHash": 0}], [S("[+@k]")]]})],
    ),
    "links": (
        [para({"type": "autolink", "href": "mailto:a@b", "attrs": {"classes": ["x"]}}, {"type": "image", "src": "s", "title": "T", "alt": "a b", "attrs": {"id": "i"}}, {"type": "link", "href": "u", "title": "t", "children": [{"type": "code", "value": "c"}]}), {"type": "image", "src": "s", "alt": ""}],
        [P({"t": "Link", "c": [["", ["email", "x"], []], [S("mailto:a@b")], ["mailto:a@b", ""]]}, {"t": "Image", "c": [["i", [], []], [S("a"), SP, S("b")], ["s", "T"]]}, {"t": "Link", "c": [NO, [{"t": "Code", "c": [NO, "c"]}], ["u", "t"]]}), P({"t": "Image", "c": [NO, [], ["s", ""]]})],
    ),
    "list table": (
        [box(row([para(t("H1"))], [para(t("<"))]), row([para(t("a"))], [lst([para(t("x"))], [para(t("y"))])]), row([para(t("^"))], [para(t("p")), para(t("q"))]), row([para(t("m"))], [para(t("n"))], marked=True), row([para(t("s"))], []),
             title=[t("My cap")], attrs={"id": "T", "classes": ["k"], "keyValues": {"header-rows": "1", "footer-rows": "", "header-cols": "3", "aligns": "left, right", "widths": "25,x", "own": "v"}})],
        [{"t": "Table", "c": [["T", ["k"], [["own", "v"]]], [None, [{"t": "Plain", "c": [S("My"), SP, S("cap")]}]], [[{"t": "AlignLeft"}, {"t": "ColWidth", "c": 0.25}], [{"t": "AlignRight"}, {"t": "ColWidthDefault"}]],
            [NO, [[NO, [block_cell([P(S("H1"))], cols=2)]]]],
            [[NO, 2, [], [[NO, [block_cell([P(S("a"))], rows=2), block_cell([{"t": "BulletList", "c": [[{"t": "Plain", "c": [S("x")]}], [{"t": "Plain", "c": [S("y")]}]]}])]], [NO, [block_cell([P(S("p")), P(S("q"))])]]]],
             [NO, 2, [[NO, [block_cell([P(S("m"))], attr=["", [], [["header-row", ""]]]), block_cell([P(S("n"))])]]], []]],
            [NO, [[NO, [block_cell([P(S("s"))]), block_cell([])]]]]]}],
    ),
    "list table without rows": ([box()], [{"t": "Table", "c": [NO, [None, []], [], [NO, []], [[NO, 0, [], []]], [NO, []]]}]),
    "list table, clipped": (
        [box(row([para(t("h"))], [para(t("<")), para(t("x"))]), row([para(t("^"))]), attrs={"keyValues": {"header-rows": "1 of two"}})],
        [{"t": "Table", "c": [NO, [None, []], [[{"t": "AlignDefault"}, {"t": "ColWidthDefault"}]] * 2, [NO, [[NO, [block_cell([P(S("h"))]), block_cell([P(S("<")), P(S("x"))])]]]], [[NO, 0, [], [[NO, [block_cell([P(S("^"))])]]]]], [NO, []]]}],
    ),
    "no list table": ([box(row([para(t("a"))]), item([para(t("b"))]))], [{"t": "Div", "c": [["", ["admonition", "list-table"], []], [{"t": "BulletList", "c": [[{"t": "BulletList", "c": [[{"t": "Plain", "c": [S("a")]}]]}], [{"t": "Plain", "c": [S("b")]}]]}]]}]),
    "boxes": (
        [{"type": "list", "tight": True, "items": [
            item([{"type": "image", "src": "u", "alt": "i"}], checked=True), item([{"type": "comment", "content": "c"}, para(t("a"))], checked=True), item([para(t("b"), attrs={"id": "p"})], checked=False), item([{"type": "zzz", "value": "z"}], checked=False),
            item([], checked=True), item([para(t("d")), para(t("e"))], checked=True)]}],
        [{"t": "BulletList", "c": [
            [P(S("☒"), SP, {"t": "Image", "c": [NO, [S("i")], ["u", ""]]})], [{"t": "Plain", "c": [S("☒"), SP, S("a")]}], [{"t": "Plain", "c": [S("☐"), SP]}, {"t": "Div", "c": [["p", [], []], [{"t": "Plain", "c": [S("b")]}]]}], [P(S("☐"), SP, S("z"))],
            [{"t": "Plain", "c": [S("☒"), SP]}], [{"t": "Plain", "c": [S("☒"), SP, S("d")]}, {"t": "Plain", "c": [S("e")]}]]}],
    ),
    "cited in notes": (
        [para(cite(), ref("a"), cite(), ref("b"), ref("a"), cite()), note("a", para(cite(), ref("c"), cite())), note("b", para(cite())), note("c", para({"type": "inline_footnote", "inline": [cite()]}, cite()))],
        [P(cited(1), N_(P(cited(1), N_(P(N_(P(cited(1))), cited(2))), cited(3))), cited(4), N_(P(cited(4))), N_(P(cited(5), N_(P(N_(P(cited(5))), cited(6))), cited(7))), cited(8))],
    ),
    "extensions": (
        [para({"type": "inline_extension", "name": "k", "content": [t("e")]}, {"type": "inline_extension", "name": "l", "content": "f g"}, {"type": "substitution", "oldText": "o", "newText": "n"}, {"type": "abbreviation", "abbr": "ab", "expansion": "long"}, {"type": "literal_inline", "content": "a  b"}, {"type": "raw_inline", "format": "html", "content": "<i>"}, {"type": "escaped_text", "value": "*"})],
        [P({"t": "Span", "c": [["", ["ext-k"], []], [S("e")]]}, {"t": "Span", "c": [["", ["ext-l"], []], [S("f"), SP, S("g")]]}, {"t": "Span", "c": [["", ["substitution"], []], [{"t": "Span", "c": [["", ["deletion"], []], [S("o")]]}, S("→"), {"t": "Span", "c": [["", ["insertion"], []], [S("n")]]}]]},
           {"t": "Span", "c": [["", ["abbr"], [["title", "long"]]], [S("ab")]]}, S("a"), SP, SP, S("b"), {"t": "RawInline", "c": ["html", "<i>"]}, S("*"))],
    ),
}


#: One document each that is no document after all.
BAD = {
    "level": '{"type":"heading","level":"two","children":[]}', "start": '{"type":"list","ordered":true,"start":[1],"items":[]}', "id": '{"type":"paragraph","attrs":{"id":5},"children":[]}', "classes": '{"type":"paragraph","attrs":{"classes":"x"},"children":[]}',
    "values": '{"type":"paragraph","attrs":{"classes":[["x"]]},"children":[]}', "too deep": '{"type":"block_quote","children":[' * 100_000 + "]}" * 100_000,
}


def json_of(depth):
    return '{"type":"document","children":[' + '{"type":"block_quote","children":[' * depth + json.dumps(para(t("x"))) + "]}" * depth + "]}"


@pytest.fixture(scope="module")
def converted(spark):
    rows = [(name, json.dumps({"type": "document", "children": children})) for name, (children, _) in CASES.items()]
    rows += [("broken", "{"), ("other", '{"type": "text"}'), ("null", None), *(((k, f'{{"type":"document","children":[{v}]}}')) for k, v in BAD.items())]
    rows += [("deep", json_of(DEEP))]
    nodes, errors = flatten(spark.createDataFrame(rows, "doc string, ast string"))
    found = {r.doc: r.json if r.doc == "deep" else json.loads(r.json) for r in forward.convert(nodes, {"sun": "☼"}).collect()}
    return nodes, found, {r.doc for r in errors.collect()}


@pytest.mark.parametrize("name", CASES)
def test_document(converted, name):
    assert converted[1][name]["blocks"] == CASES[name][1]


def test_what_is_no_document_is_reported(converted):
    assert converted[2] == {"broken", "other", "null", *BAD}
    assert converted[1].keys() == {*CASES, "deep"}


def test_depth_is_no_limit(converted):
    inner = '{"t":"Para","c":[{"t":"Str","c":"x"}]}'
    assert converted[1]["deep"].endswith('"blocks":[' + '{"t":"BlockQuote","c":[' * DEEP + inner + "]}" * DEEP + "]}")


def test_warnings(converted):
    ready = forward.resolved(converted[0], {"sun": "☼"})[0]
    got = {(r.doc, r.code) for r in forward.warnings(ready).collect()}
    assert got == {
        ("references", "crossref-unresolved"), ("notes", "reference-unresolved"), ("citation", "citation-locator-flattened"), ("table", "table-groups-normalized"),
        ("spans", "symbol-unresolved"), ("unknown", "unknown-carve-block"), ("unknown", "comment-dropped"), ("broken links", "reference-unresolved"), ("misfit groups", "table-groups-normalized"),
        ("old forms", "crossref-unresolved"), ("integral", "citation-mode-normalized"), ("extensions", "inline-extension-degraded"),
        ("no list table", "list-table-structure-degraded"), ("list table, clipped", "list-table-rowspan-clipped"), ("boxes", "comment-dropped"), ("boxes", "unknown-carve-block"),
    }
    kept = {(r.doc, r.code) for r in forward.warnings(ready, roundtrip=True).collect()}
    assert kept == {x for x in got if x[1] not in ("comment-dropped", "unknown-carve-block", "citation-locator-flattened")}
    assert diagnostics.classify(ready.limit(0).selectExpr("'comment: x' AS m"), "m", "d", strict=True).count() == 0


def test_span_warnings(spark):
    rows = [{"type": "table_row", "cells": [cell("a", header=True), cell("", span="colspan", header=True, attrs={"id": "x"})]}, {"type": "table_row", "cells": [cell("", span="colspan"), cell("", span="rowspan")]}]
    docs = [("t", json.dumps({"type": "document", "children": [{"type": "table", "rows": rows}]})), ("u", json.dumps({"type": "document", "children": [{"type": "table", "rows": [{"type": "table_row", "cells": [cell("", span="rowspan")]}]}]}))]
    nodes, _ = flatten(spark.createDataFrame(docs, "doc string, ast string"))
    got = {(r.doc, r.code, r.details.row, r.details.column) for r in forward.warnings(forward.resolved(nodes)[0]).collect()}
    assert got == {
        ("t", "table-continuation-attributes-dropped", 1, 2), ("t", "table-colspan-origin-missing", 2, 1), ("t", "table-rowspan-clipped", 2, 2), ("u", "table-rowspan-origin-missing", 1, 1),
    }


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_what_is_saved_is_packed(spark, tmp_path):
    """A conversion keeps its nodes several times: a few bytes for each, as columns, and not whole rows."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    context.setCheckpointDir(f"file://{tmp_path}")
    try:
        rows = [row(*[[para(t(str(i + j))), para(t("x"))] for j in range(20)]) for i in range(100)]
        docs = [(f"d{i}", json.dumps({"type": "document", "children": [box(*rows)]})) for i in range(4)]
        nodes, _ = flatten(spark.createDataFrame(docs, "doc string, ast string"))
        assert {r.json[:30] for r in forward.convert(nodes).select("json").collect()} == {'{"pandoc-api-version":[1,23,1]'}
        size = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
        assert size < 150 * nodes.count()
    finally:
        if folder:
            context.setCheckpointDir(folder)


def test_pieces_join_nothing_that_is_not_there(spark):
    rows = [{"type": "table_row", "cells": [cell("a"), cell("b")]}]
    nodes, _ = flatten(spark.createDataFrame([("t", json.dumps({"type": "document", "children": [{"type": "table", "rows": rows}]}))], "doc string, ast string"))
    made = forward.pieces(saved(forward.resolved(nodes)[0]))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("ring", [False, True])
def test_notes_in_notes_take_no_rounds(spark, ring):
    """As many jobs for notes 30 deep as for notes 3 deep, in a chain or in a ring."""

    def documents(depth):
        ref = lambda i: {"type": "footnote_ref", "id": str(i)}
        notes = [note(str(i), para(t(f"n{i}"), *([ref((i + 1) % depth)] if ring or i + 1 < depth else []))) for i in range(depth)]
        return spark.createDataFrame([("d", json.dumps({"type": "document", "children": [para(ref(0)), *notes]}))], "doc string, ast string")

    nodes = {depth: flatten(documents(depth))[0] for depth in (3, 30)}
    found, jobs = {}, {}
    for depth, rows in nodes.items():
        jobs[depth] = jobs_of(spark, f"notes {depth} {ring}", lambda rows=rows, depth=depth: found.update({depth: forward.convert(rows).collect()[0].json}))
    assert jobs[3] == jobs[30]
    for depth, text in found.items():
        assert text.count('"Note"') == (1 if ring else depth) and text.count("[^") == int(ring)


def test_circles():
    from docweft.operators.resolve import circles

    assert sorted(circles([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (6, 1), (7, 8)])) == [(1, 2), (2, 3), (3, 1), (4, 5), (5, 4), (6, 6)]
    deep = [(i, i + 1) for i in range(50_000)]
    assert circles(deep) == [] and circles([*deep, (50_000, 0)]) == [*deep, (50_000, 0)]


def test_each_node_is_read_once():
    from docweft.sources import nodes as N

    asked = []
    tree = {"type": "document", "children": [box(row([para(t("a"))], [para(t("b")), para(t("c"))]))]}
    rows = N.tree_rows(tree, lambda node, kind: asked.append(kind) or N.exchange_parts(node, kind))
    assert len(asked) == len(rows) == 13
