"""Extraction of main text: everyday markup that misleads, and the ratios against a plain statement of them."""

import random

import numpy as np
import pytest

from rillstone.llm import html_text

TEXT = "Some long text, with marks and words in it. " * 20
P = f"<p>{TEXT}</p>"
OUT = TEXT.strip()
CASES = {
    "a layout's class names a sidebar": (f'<div class="content no-sidebar">{P}</div>', OUT),
    "a layout's class begins with a mark": (f'<div class="sidebar-layout">{P}<div class="sidebar"><p>side, x.</p></div></div>', OUT),
    "an article's class is a mark": (f'<article class="post share">{P}</article>', OUT),
    "a self-closing image": (f'<p>Before, it.</p><svg viewBox="0"/>{P}', f"Before, it.\n{OUT}"),
    "an image without end": (f"<svg>{P}", OUT),
    "a frame without end": (f"{P}<iframe src=x>{P}", f"{OUT}\n{OUT}"),
    "a script without end": (f"{P}<script>var a = 1;<p>More, text.</p>", f"{OUT}\nMore, text."),
    "a teaser beside the body": (f"<article><p>Teaser, short.</p></article><div>{P}<p>more, here.</p></div>", f"{OUT}\nmore, here."),
    "a form around all": (f"<form><nav>Menu</nav>{P}</form>", OUT),
    "comments that outweigh the text": (f'<div>{P}</div><div class="comments">{P * 4}</div>', OUT),
    "comments as articles": (f'<main>{P}</main><div id="comment-list"><article class="comment">{P}</article></div>', OUT),
    "a list of links in the text": (f"<main>{P}<ul><li><a href=1>One thing</a></li><li><a href=2>Two</a></li></ul><p>End.</p></main>", f"{OUT}\nEnd."),
    "a list in the text": (f"<main>{P}<ul><li>One thing</li><li>Two</li></ul><p>End.</p></main>", f"{OUT}\nOne thing\nTwo\nEnd."),
    "an article's own header": (f"<article><header><h1>Title</h1><p>by me</p></header>{P}</article>", f"Title\n{OUT}"),
    "deep nesting": ("<div>" * 5000 + "deep text, here" + "</div>" * 5000, "deep text, here"),
    "unmatched ends": ("<p>" + "</b>" * 5000 + "text, here", "text, here"),
}


@pytest.mark.parametrize("name", CASES)
def test_everyday_markup(name):
    page, want = CASES[name]
    assert html_text.main_text(page) == want


def plain_ratios(nodes):
    """Paths with content, stated plainly: a path is the list of names from the root."""

    def path(e):
        return (path(e.parent) if e.parent else ()) + (e.name,)

    rows = [(path(e), t.strip()) for e, t, _ in nodes if not e.never and t.strip()]
    if not rows:
        return set()
    by = {}
    for p, t in rows:
        by.setdefault(p, []).append(t)
    length = [sum(map(len, by[p])) / len(by[p]) for p, _ in rows]
    dots = [(1 + sum(len(html_text.PUNCTUATION.findall(t)) for t in by[p])) / len(by[p]) for p, _ in rows]

    def smooth(x):
        return [0.25 * x[max(0, i - 1)] + 0.5 * x[i] + 0.25 * x[min(len(x) - 1, i + 1)] for i in range(len(x))]

    fused = [a * b for a, b in zip(smooth(length), smooth(dots))]
    score = {p: float(np.mean([f for (q, _), f in zip(rows, fused) if q == p])) for p in by}
    least = min(html_text.CUT * float(np.std(fused)), max(score.values()))
    return {p for p, v in score.items() if v >= least * (1 - 1e-12)}


@pytest.mark.parametrize("seed", range(30))
def test_path_ratios_on_random_trees(seed):
    rng = random.Random(seed)

    def tree(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.6:
                tag = rng.choice(["div", "section", "b", "ul", "nav", "table", "h2", "a"])
                parts.append(f"<{tag}>{tree(depth - 1)}</{tag}>")
            else:
                parts.append(f"<p>{'word, ' * rng.choice([1, 2, 30])}end.</p>")
        return "".join(parts)

    elements, nodes = html_text.parse(tree(5))
    html_text.boilerplate(elements, nodes)

    def path(e):
        return (path(e.parent) if e.parent else ()) + (e.name,)

    got = html_text.content_paths(nodes)
    assert {path(e) for e, _, _ in nodes if e.path in got} == plain_ratios(nodes)
    names = {}
    for e in elements:
        assert names.setdefault(e.path, path(e)) == path(e)
    assert len(set(names.values())) == len(names)
