"""Pages whose wrappers, comments and attributes look like what they are not; time in proportion to the page."""

import random
import time

import pytest

from assayframe.llm import pages

A = "The article's first sentence is here. It goes on for a while, as articles do, and ends."
B = "A second paragraph with more text. It also has two sentences."
C = "I do not agree with this at all. What a strange thing to say, really."
CASES = {
    "entry-header": (f"<article><div class='entry-header'><h1>Title</h1></div><p>{A}</p></article>", f"Title {A}"),
    "page-header": (f"<article><h1 class='page-header'>Title</h1><p>{A}</p></article>", f"Title {A}"),
    "form": (f"<body><form id='aspnetForm'><div><p>{A}</p><p>{B}</p></div></form></body>", f"{A} {B}"),
    "widget": (f"<body><div class='elementor-widget'><p>{A}</p><p>{B}</p></div></body>", f"{A} {B}"),
    "legal": (f"<body><div class='legal'><p>{A}</p><p>{B}</p></div></body>", f"{A} {B}"),
    "legal nav": (f"<body><nav><a href=x>Home</a> <a href=y>About us</a></nav><div class='legal'><p>{A}</p><p>{B}</p></div><footer>Imprint and more</footer></body>", f"{A} {B}"),
    "comment articles": (f"<main><article><h1>T</h1><p>{A}</p><p>{B}</p></article><section class='comments'><article class='comment'><p>{C}</p></article><article class='comment'><p>{C}</p></article></section></main>", f"T {A} {B}"),
    "comments in article": (f"<article><p>{A}</p><p>{B}</p><div id='comments'><article class='comment'><p>{C}</p></article><article><p>{C}</p></article></div></article>", f"{A} {B}"),
    "aside article": (f"<main><article><p>{A}</p><aside><article><h3>Other</h3><p>{C}</p></article></aside><p>{B}</p></article></main>", f"{A} {B}"),
    "aside beside": (f"<main><article><p>{A}</p><p>{B}</p></article><aside><article><h3>Other</h3><p>{C}</p></article></aside></main>", f"{A} {B}"),
    "apostrophe": (f"<article><p title=it's>{A}</p><p>{B}</p><p class='x'>End.</p></article>", f"{A} {B} End."),
    "body sidebar": (f"<body class='has-sidebar sidebar'><article class='legal'><p>{A}</p></article></body>", A),
    "many comments": (f"<main><article><p>{A}</p><p>{B}</p></article><section class='comments'>"+f"<article class='comment'><p>{C}</p></article>" * 8 + "</section></main>", f"{A} {B}"),
    "cookie": (f"<div class='cookie-notice'><div><div><div><p>We use cookies. By going on you agree to our rules, all of them.</p></div></div></div></div><article><p>{A}</p><p>{B}</p></article>", f"{A} {B}"),
    "quoted gt": (f"<article><p title=\"a > b\" data-x='c>d'>{A}</p><p data = 'it\"s'>{B}</p></article>", f"{A} {B}"),
    "newsletter": (f"<article><p>{A}</p><form><p>Sign up to our letter. It comes each week.</p><label>Mail</label></form><p>{B}</p></article>", f"{A} {B}"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_main_text(name):
    page, want = CASES[name]
    assert pages.main_text(page) == want


@pytest.mark.parametrize("page", ["<p>A</p><div><a href=x>link</a></div>", "<div>w w w</div><div><a href=x>l</a></div>", "<div>x ", "<p><b>x ", "<p a='", "<a b=c=d=", "<form><nav>"])
def test_time_is_linear(page):
    start = time.perf_counter()
    pages.main_text(page * 4000)
    assert time.perf_counter() - start < 2.5


def test_cut_of_larger_graphs_equals_a_plain_flow():
    """Against augmenting one path at a time."""
    r = random.Random(11)
    for _ in range(40):
        n = r.randint(8, 40)
        cost = [r.uniform(-3, 3) for _ in range(n)]
        links = [(i - 1, i, r.uniform(0, 2)) for i in range(1, n)] + [(r.randrange(i), i, r.uniform(0, 2)) for i in range(1, n)]
        links = [x for x in links if x[0] != x[1]]
        cap = {}
        for a, b, w in links:
            cap[a, b] = cap.get((a, b), 0) + w
            cap[b, a] = cap.get((b, a), 0) + w
        for v, c in enumerate(cost):
            cap["s", v], cap[v, "t"], cap[v, "s"], cap["t", v] = max(0, c), max(0, -c), 0, 0
        total = 0
        while True:
            back, todo = {"s": None}, ["s"]
            for v in todo:
                for (a, b), c in cap.items():
                    if a == v and c > 1e-12 and b not in back:
                        back[b] = a
                        todo.append(b)
            if "t" not in back:
                break
            way, v = [], "t"
            while back[v] is not None:
                way.append((back[v], v))
                v = back[v]
            amount = min(cap[e] for e in way)
            for a, b in way:
                cap[a, b] -= amount
                cap[b, a] += amount
            total += amount
        got = pages.min_cut(cost, links)
        price = sum(abs(c) for c, k in zip(cost, got) if (c > 0) != k) + sum(w for a, b, w in links if got[a] != got[b])
        assert abs(price - total) < 1e-9
