"""Block trees: paths, section numbers, bibliographies a section, captions at any depth, rendering; linear nested sections."""

import random

import pytest

from foliospark.docs import blocks, fences, tree

SCHEMA = "document int, pos int, kind string, level int, id string, classes array<string>, text string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def sections(levels, unnumbered=()):
    return [(1, i, "Header", lv, f"h{i}", ["unnumbered"] if i in unnumbered else [], f"T{i} @k{i}") for i, lv in enumerate(levels)]


def test_paths_from_depths(spark):
    rows = [(1, i, d, f"b{i}") for i, d in enumerate([0, 1, 1, 2, 0, 1, 0])] + [(2, 0, 0, "x")]
    got = {(r["document"], r["text"]): r["path"] for r in tree.from_depths(frame(spark, rows, "document int, pos int, depth int, text string")).collect()}
    assert got == {(1, "b0"): [1], (1, "b1"): [1, 1], (1, "b2"): [1, 2], (1, "b3"): [1, 2, 1], (1, "b4"): [2], (1, "b5"): [2, 1], (1, "b6"): [3], (2, "x"): [1]}


def bibliography(spark, rows, level, title=None, keys=range(60)):
    references = spark.createDataFrame([(f"k{i}", f"entry {i}") for i in keys], "key string, entry string")
    out = sorted(tree.with_bibliographies(frame(spark, rows), references, level, title).collect(), key=lambda r: (r["document"], r["path"]))
    return [(r["id"] or r["text"], r["path"]) if r["kind"] != "Para" else (r["text"], r["path"]) for r in out if r["document"] == 1]


def test_bibliographies_of_level_one(spark):
    rows = [(1, -1, "Para", 0, None, [], "@k50 before"), *sections([1, 2, 1, 3])]
    assert bibliography(spark, rows, 1) == [("@k50 before", [1]), ("h0", [2]), ("h1", [3]), ("refs-1", [4]), ("entry 0", [4, 1]), ("entry 1", [4, 2]), ("h2", [5]), ("h3", [6]), ("refs-2", [7]), ("entry 2", [7, 1]), ("entry 3", [7, 2])]


def test_sections_above_get_their_own_blocks_and_deeper_ones_are_untouched(spark):
    rows = [*sections([1, 2, 3, 2, 1, 3, 2], unnumbered=(3,)), (1, 7, "Div", 0, "refs", [], "old"), (1, 8, "Header", 2, "bibliography", [], "old")]
    got = bibliography(spark, rows, 2, "Works")
    heads = [x for x, p in got if len(p) == 1]
    assert heads == ["h0", "bibliography-1", "refs-1", "h1", "h2", "bibliography-1.1", "refs-1.1", "h3", "bibliography-x3", "refs-x3", "h4", "bibliography-2", "refs-2", "h5", "h6", "bibliography-2.1", "refs-2.1"]
    entries = [(x, heads[p[0] - 1]) for x, p in got if len(p) == 2]
    assert entries == [("entry 0", "refs-1"), ("entry 1", "refs-1.1"), ("entry 2", "refs-1.1"), ("entry 3", "refs-x3"), ("entry 4", "refs-2"), ("entry 6", "refs-2.1")]
    made = tree.with_bibliographies(frame(spark, rows), spark.createDataFrame([("k1", "e")], "key string, entry string"), 2, "Works").filter("id LIKE 'bib%'").collect()
    assert [(r["level"], r["text"], r["kind"]) for r in made] == [(3, "Works", "Header")]
    assert [x for x, _ in bibliography(spark, rows, 2, keys=[])] == [f"h{i}" for i in range(7)]
    assert bibliography(spark, sections([2, 1]), 1)[1:3] == [("h1", [2]), ("refs-1", [3])]


def test_captions_at_any_depth(spark):
    rows = [
        ([1], "Div", ""), ([1, 1], "Div", ""), ([1, 1, 1], "Figure", ""), ([1, 1, 1, 1], "Caption", ""), ([1, 1, 1, 1, 1], "Plain", "Figura 3: a"), ([1, 1, 1, 1, 2], "Plain", "b"), ([1, 1, 1, 2], "Plain", "Figura 9: body"),
        ([2], "Figure", "Figura 1:  one"), ([2, 1], "Figure", "Figura 2: inner"), ([3], "Figure", "no label"), ([4], "Para", "Figura 5: text"), ([5], "Figure", None),
    ]
    own = spark.createDataFrame([(d, p, k, t) for d in (1, 2) for p, k, t in rows], "document int, path array<int>, kind string, text string")
    got = {(r["document"], tuple(r["path"])): (r["label"], r["rest"]) for r in tree.bold_captions(own).collect()}
    want = {(1, 1, 1): ("Figura 3:", "a b"), (2,): ("Figura 1:", "one")}
    assert got == {(d, tuple(p)): want.get(tuple(p), (None, None)) for d in (1, 2) for p, _, _ in rows}


def test_rendering(spark):
    rows = [(1, [1], "Div", "a", ["x", "y"], None), (1, [1, 1], "Para", None, [], "p & q"), (1, [1, 2], "Div", None, None, ""), (1, [1, 2, 1], "Para", 'i"', [], "r"), (1, [2], "Para", None, [], "s"), (2, [1], "Div", None, [], ""), (2, [1, 1], "Para", None, [], "t")]
    own = spark.createDataFrame(rows, "document int, path array<int>, kind string, id string, classes array<string>, text string")
    got = {r["document"]: r["xml"] for r in tree.rendered(own).collect()}
    assert got == {1: '<div id="a" class="x y"><para>p &amp; q</para><div><para id="i&quot;">r</para></div></div><para>s</para>', 2: "<div><para>t</para></div>"}


def test_nested_sections_as_a_stack(spark):
    rng = random.Random(4)
    rows = [(d, i, rng.choice(["Header", "Para"]), rng.randint(1, 5), None, [], f"t{i}") for d in range(30) for i in range(rng.randint(1, 25))]
    want = {}
    for d in range(30):
        out, stack = "", []
        for _, _, kind, level, _, _, text in [r for r in rows if r[0] == d]:
            if kind == "Header":
                while stack and stack[-1] >= level:
                    stack.pop()
                    out += "</sec>"
                stack.append(level)
                out += f'<sec sec-type="level{level}"><title>{text}</title>'
            else:
                out += f"<p>{text}</p>"
        want[d] = out + "</sec>" * len(stack)
    assert {r["document"]: r["jats"] for r in blocks.nested_sections(frame(spark, rows)).collect()} == want


TEMPLATES = [
    ("box", '<b id="{{id}}">{{contenido}}</b>', None, None, "any"), ("figure", "<f>{{caption}}|{{contenido}}|{{more}}</f>", "::: {.fig #fig-id}", "caption, id", "body"),
    ("none", None, None, None, None), ("back", "<k>{{contenido}}</k>", "::: back", "", "back"),
]
CASES = [
    ('::: box id="1"\nx\n:::', '<b id="1">x</b>', []),
    ("a\n::: box\nx\n:::\nb\n:::: {.box #q k=v}\ny\n::::\nc", 'a\n<b id="{{id}}">x</b>\nb\n<b id="q">y</b>\nc', []),
    ('::: {.fig #f caption="C {{more}}"}\n::: box\nin\n:::\nout\n:::', '<f>C {{more}}|<b id="{{id}}">in</b>\nout|{{more}}</f>', []),
    ("::: figure\n::: box\nx\n:::\n:::", '::: figure\n<b id="{{id}}">x</b>\n:::', [(0, "figure", "missing")]),
    ("::: box\n::: box\nx\n:::\ntail", '::: box\n<b id="{{id}}">x</b>\ntail', [(0, "box", "unclosed")]),
    (":::\n::: nope\nx\n:::\n:::", ":::\n::: nope\nx\n:::\n:::", [(1, "nope", "unknown")]),
    ("::: back\nx\n:::\n::: none\ny\n:::", "::: back\nx\n:::\n::: none\ny\n:::", [(0, "back", "context"), (3, "none", "unknown")]),
    ("::: box contenido=no\r\nz\r\n:::\r\nend", '<b id="{{id}}">z\r</b>\nend', []),
    ("::: box\n:::", '<b id="{{id}}"></b>', []),
    ("text ::: box", "text ::: box", []), ("", "", []), (None, None, []),
]


@pytest.mark.parametrize("named", [True, False])
def test_fences(spark, named):
    templates = spark.createDataFrame(TEMPLATES, "name string, template string, opening string, required string, context string")
    own = spark.createDataFrame([(i, t, "body") for i, (t, _, _) in enumerate(CASES)], "document int, text string, place string").repartition(2)
    got = {r["document"]: r for r in fences.expanded(own, templates, context="place" if named else None).collect()}
    for i, (_, text, problems) in enumerate(CASES):
        if not named and any(w == "context" for _, _, w in problems):
            text, problems = "<k>x</k>\n::: none\ny\n:::", problems[1:]
        assert got[i]["text"] == text and [tuple(p) for p in got[i]["problems"]] == problems, CASES[i]
    assert fences.expanded(own.limit(0), templates).count() == 0


def test_fence_rows(spark):
    own = spark.createDataFrame([(1, "::: a x=1 x=2\n::: {.b #i}\n::: c\n:::\n:::\n::: d\n:::"), (2, None), (3, "")], "document int, text string")
    got = [(r["name"], r["first"], r["last"], r["level"], r["parent"], r["attributes"]) for r in fences.fence_rows(own, "document", "text").orderBy("first").collect()]
    assert got == [("a", 0, None, 1, None, {"x": "2"}), ("b", 1, 4, 1, None, {"id": "i"}), ("c", 2, 3, 2, 1, {}), ("d", 5, 6, 1, None, {})]
