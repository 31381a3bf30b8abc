"""Page text and vector links against plain versions."""

import random

import numpy as np
import pytest

from assayframe.llm import pages, vectors


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>", ""),
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>First &amp; <b>bold</b>  one.<p>Second\n one.</article><footer>Foot</footer>", "Title First & bold one. Second one."),
    ("<article><p>Text here.</p><aside>More to read</aside><div class='comments'><p>A reader's long comment. With sentences. And more.</p></div><p>End.</p></article>", "Text here. End."),
    ("<div class=\"cookie-notice\">We use cookies.</div><main><p>Body text.</p><form><input>Sign up</form><script>var a='<p>no</p>';</script><style>p{}</style></main>", "Body text."),
    ("<article><p>Cut off in a ta<b", "Cut off in a ta"), ("<article><p>One<br>two<p>&lt;three&gt; &#233;&#x41; &nbsp;x</article>", "One two <three> éA x"),
    ("<header>Site</header><article><header><h1>Head</h1></header><p>Text.</p></article>", "Head Text."),
    ("<article>a<!-- no --><p hidden>no</p><p>b</p></article>", "a b"),
])
def test_main_text(page, want):
    assert pages.main_text(page) == want


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>x y</p>", "t", 5), (1, "u", "<p>x y</p>", "t", 5), (None, None, None, None, None), (2, "v", "<p>é</p>" * 3000, "", 1)],
                               "page_id long, url string, html string, text string, n_chars int")
    got = pages.extract(df).collect()
    assert [(r["page_id"], r["n_chars"]) for r in sorted(got, key=lambda r: (r["page_id"] is None, r["page_id"]))] == [(1, 3), (1, 3), (2, 5999), (None, 0)]
    assert pages.extract(df.limit(0)).count() == 0


def test_cut_is_least():
    """Every labelling of small graphs, compared with the cut."""
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 7)
        cost = [r.uniform(-3, 3) for _ in range(n)]
        links = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        price = lambda x: sum(abs(c) for c, k in zip(cost, x) if (c > 0) != k) + sum(w for a, b, w in links if x[a] != x[b])  # noqa: E731, B023
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(price(pages.min_cut(cost, links)) - best) < 1e-9


@pytest.mark.parametrize("chunk", [16, 8192])
def test_vectors(spark, chunk):
    g = np.random.default_rng(4)
    base = g.standard_normal((40, 24))
    near = [b + g.standard_normal(24) * s for b in base for s in (0.0, 0.02, 0.1, 0.2, 0.3, 0.35)]
    edge = [np.array([1.0] + [0.0] * 23), np.array([0.95, np.sqrt(1 - 0.95**2)] + [0.0] * 22), np.array([2.0] + [0.0] * 23)]
    values = [[float(x) for x in np.float32(v)] for v in [*near, *edge]]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, 1, 0) for i, v in enumerate(values + odd)] + [(3, values[3], 1, 0), (None, values[7], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int, k int").repartition(3)
    fine = [v if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for _, v, *_ in rows]
    link = [[] for _ in rows]
    for i, a in enumerate(fine):
        for j, b in enumerate(fine):
            if i != j and a and b and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= 0.95:
                    link[i].append(j)
    seen, comp = {}, []
    for i in range(len(rows)):
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                for j in link[todo.pop()]:
                    if j not in part:
                        part.add(j)
                        todo.append(j)
            low = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
            seen.update({j: low for j in part})
        comp.append(seen[i])
    want = sorted((str(r[0]), len(k), str(c)) for r, k, c in zip(rows, link, comp))
    got = vectors.near_vectors(df, chunk=chunk).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_no_group_exceeds_two_chunks(spark, monkeypatch):
    """A crowded cell: its own rows and its visitors are dealt, and the links stay the same."""
    meet, chunk = vectors._meet, 40
    g = np.random.default_rng(6)
    values = [[float(x) for x in v] for v in g.standard_normal((600, 8)) * 0.3 + np.eye(8)[0]]

    def bounded(key, table, parts, cosine):
        if table.num_rows > 3 * chunk:  # two chunks, and what a hash scatters
            raise ValueError(f"{table.num_rows} rows in one group")
        return meet(key, table, parts, cosine)

    df = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "_meet", bounded)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df, chunk=chunk).collect()}
    u = np.array(values) / np.linalg.norm(values, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()))


PARAGRAPHS = "<h1>Title of it</h1><p>A first paragraph of some length. It has two sentences.</p><p>The second paragraph goes on. And it ends.</p>"
WORDS = "Title of it A first paragraph of some length. It has two sentences. The second paragraph goes on. And it ends."


@pytest.mark.parametrize("page", [
    f"<body class='has-sidebar'><nav><a href=x>Menu</a></nav><article>{PARAGRAPHS}</article></body>",
    f"<body class='navbar-fixed'><div>{PARAGRAPHS}</div><footer>Foot</footer></body>",
    f"<html class='cookies'><body><article class='legal'>{PARAGRAPHS}</article><div class='related'><a href=x>More</a></div></body></html>",
    f"<main id='menu-page'>{PARAGRAPHS}</main>",
    f"<form id='f'><div class='page'><main>{PARAGRAPHS}</main></div><div class='footer'>Foot</div></form>",
    f"<div class='has-sidebar'><div>{PARAGRAPHS}</div></div><div class='sidebar'><p>Other stuff</p></div>",
    f"<div class='sidebar-layout'><div><article>{PARAGRAPHS}</article></div></div>",
])
def test_wrapper_names_keep_the_article(page):
    assert pages.main_text(page) == WORDS


def test_blocks_of_different_evidence_are_joined():
    found = pages.blocks("<article><p>Text here.</p><div class='share'>Tell it</div><p>End.</p></article>")
    assert {(0, 1), (1, 2)} <= {(a, b) for a, b, _ in pages.edges(found)}
    assert [b.away for b in found] == [0.0, pages.AWAY_COST, 0.0]
