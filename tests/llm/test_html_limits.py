"""Pages that would flood or hold up a task, and what a page shows, by hand and against a plain renderer."""

import random
import time

import pytest

from quillbar.llm import html

LARGE = {
    "spans": "<table>" + "<tr><td rowspan=0 colspan=1000>x" * 2000 + "</table>",
    "stairs": "<table>" + "<tr><td rowspan=0 colspan=1000>x" * 8000,
    "open comment": "a<!-- b" * 150_000,
    "open comments": "<!--" * 250_000,
    "open tags": "<a " * 300_000,
    "open ends": "</a" * 300_000,
    "open declarations": "<!doctype " * 100_000,
    "open sections": "<![CDATA[" * 100_000,
    "open instructions": "<?x" * 300_000,
    "open textarea": "<textarea>" + "</texta" * 100_000,
    "references": "&amp" * 200_000,
}


@pytest.mark.parametrize("name", LARGE)
def test_large_pages_are_read_in_time(name):
    began = time.time()
    out = html.extract(LARGE[name])
    assert time.time() - began < 10 and len(out) <= 4 * len(LARGE[name])


SHOWN = [
    ("a<!-- b", "a"),
    ("a<!-- b --!>c", "ac"),
    ("a<!-->b<!--->c", "abc"),
    ('<div style="visibility:hidden"><input value=secret></div>ok', "ok"),
    ("<textarea>&lt;b&gt; <i>x</i></textarea>z", "<b> <i>x</i>\nz"),
    ("<xmp><b>&lt;</b></xmp>z", "<b>&lt;</b>z"),
    ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<ol type=a start=26><li>a<li>b</ol>", "z. a\naa. b"),
    ("<ol type=I start=3><li>a<li type=1>b</ol>", "III. a\n4. b"),
    ("<ol start=-1><li>a<li>b<li>c</ol>", "-1. a\n0. b\n1. c"),
    ("<table><tr><td>字符<td>x<tr><td>ab<td>y</table>", "字符 | x\nab   | y"),
    ("<table><tr><td colspan=3>ab<td>x<tr><td>c<td><td><td>y</table>", "ab | x\nc  | y"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("a < b <c d", "a < b"),
]


@pytest.mark.parametrize("page, text", SHOWN)
def test_what_is_shown(page, text):
    assert html.extract(page) == text


def random_tree(rnd, depth):
    """(html, lines) of blocks; lines by plain recursion."""
    kind = rnd.choice(["p", "ul", "ol", "table", "hidden", "div", "comment"]) if depth else "p"
    word = lambda: rnd.choice(["one", "two", "three", "Größe"]) + str(rnd.randrange(90))
    if kind == "p":
        a, b = word(), word()
        return f"<p>{a}  <b>{b}</b>", [[f"{a} {b}"]]
    if kind == "hidden":
        return f"<div hidden>{random_tree(rnd, depth - 1)[0]}</div>", []
    if kind == "comment":
        return f"<!-- {word()} -->", []
    if kind == "div":
        parts = [random_tree(rnd, depth - 1) for _ in range(rnd.randrange(1, 4))]
        return "<div>" + "".join(h for h, _ in parts) + "</div>", [x for _, lines in parts for x in lines]
    if kind in ("ul", "ol"):
        items = [word() for _ in range(rnd.randrange(1, 4))]
        return f"<{kind}>" + "".join(f"<li>{x}" for x in items) + f"</{kind}>", [["- " + x if kind == "ul" else f"{i + 1}. {x}" for i, x in enumerate(items)]]
    rows = [[word() for _ in range(rnd.randrange(1, 4))] for _ in range(rnd.randrange(1, 4))]
    width = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(3)]
    lines = [" | ".join(x.ljust(width[c]) for c, x in enumerate(r)).rstrip() for r in rows]
    return "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in rows) + "</table>", [lines]


@pytest.mark.parametrize("seed", range(60))
def test_random_trees_equal_a_plain_renderer(seed):
    rnd = random.Random(seed)
    parts = [random_tree(rnd, 3) for _ in range(6)]
    blocks = [x for _, lines in parts for x in lines]
    assert html.extract("".join(h for h, _ in parts)) == "\n\n".join("\n".join(b) for b in blocks)
