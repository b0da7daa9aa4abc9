"""Page extraction and neighbour search."""

import numpy as np
import pytest

from textweir.llm import neighbours, wrapper

PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><header>top</header><nav><ul><li><a href='x'>menu</a></ul></nav><div class='cookie-notice'>cookies</div><div class='ad'>buy</div><article><h1>Head %d</h1><p>Share this page</p><p>First &amp; <b>bold</b>\n text %d<p>Second&nbsp;<span class='ad'>buy</span> text<br>goes on %d</p><form><input>mail</form><aside>more</aside><ul><li>item %d<li>last</ul><!-- gone --><p>Follow us</p></article><section id='comments'><article class='comment'>%s</article></section><footer>&copy; foot</footer></body></html>"


def page(i):
    return PAGE % (i, i, i, i, "nice " * 500)


def test_template_and_content():
    template = wrapper.load(wrapper.dump(wrapper.induce([page(i) for i in range(6)])))
    found = wrapper.extract(page(77), template).split("\n")
    assert found == ["Head 77", "First & bold text 77", "Second text goes on 77", "item 77"]
    # "last" is the same on all pages too: part of the template like the two appeals.
    plain = wrapper.extract(page(77), None).split("\n")
    assert plain == ["Head 77", "Share this page", "First & bold text 77", "Second text goes on 77", "item 77", "last", "Follow us"]


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<article><p>a</article", "a"), ("<main>m<nav>n</nav></main>x", "m"), ("<div>a <b>b", "a b"), ("<script>x", ""), ("&lt;p&gt;", "<p>"), ("<article>s</article><article>longer</article>", "s\nlonger"), ("<body class='has-sidebar'><div class='post ad-free'><h1 class='entry-header'>T</h1><p>x</div>", "T\nx"), ("<main><h1>t</h1><article><p>a</article><p>z</main>y", "t\na\nz")])
def test_odd_pages(html, text):
    assert wrapper.extract(html, None) == text


def test_the_template_decides():
    """Boxes without telling names or elements: a page alone takes the longest, its host knows better."""
    box = lambda i, long: f"<div class='x{i}'><div><p>offer {i} {'deal ' * (60 if long else 1)}</p></div><section><h2>title {i}</h2><p>text {i} {'word ' * (3 if long else 40)}</p><p>Read on</p></section><div><p>foot {i}</p></div></div>"
    template = wrapper.load(wrapper.dump(wrapper.induce([box(i, False) for i in range(6)])))
    right = "title 9\ntext 9 word word word"
    assert wrapper.extract(box(9, True), template) == right
    assert wrapper.extract(box(9, True), None).startswith("offer 9 deal")


def test_trees_match_as_plain_recursion_says():
    """The size of the matching against the textbook recursion, on random trees."""
    import random

    rng = random.Random(2)

    def grow(depth):
        node = wrapper.Group(rng.choice("ab"), ())
        node.kids = [grow(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return node

    def plain(x, y):
        if x.tag != y.tag:
            return 0
        best = [[0] * (len(y.kids) + 1) for _ in range(len(x.kids) + 1)]
        for i, a in enumerate(x.kids):
            for j, b in enumerate(y.kids):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(a, b))
        return best[-1][-1] + 1

    for _ in range(300):
        a, b = grow(3), grow(3)
        a.tag = b.tag = "r"
        pairs = wrapper.match(a, b)
        assert all(x.tag == y.tag for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        assert len(pairs) == plain(a, b)


@pytest.mark.parametrize("make", [
    lambda k: "<div>" * 5000 + f"deep {k}" + "</div>" * 5000,
    lambda k: "".join(f"<p>para {i} {k}</p>" for i in range(5000)),
    lambda k: "<hr><div>z</div>" * (k % 3) + "".join(f"<p>p {i} {k}</p>" if (i * k) % 3 else f"<ul><li>{i} {k}</ul>" for i in range(5000)),
])
def test_deep_and_wide_pages(make):
    import time

    began = time.time()
    template = wrapper.load(wrapper.dump(wrapper.induce([make(k) for k in range(1, 9)])))
    found = wrapper.extract(make(10), template).split("\n")
    assert found[-1].endswith("10") and len(found) in (1, 5000, 5001) and time.time() - began < 30


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", page(i), "clash") for i in range(40)] + [(90, None, None, ""), (91, "nonsense", "<p>x", ""), (92, "http://few.example/", page(1), ""), (None, "http://h0.example/", page(7), ""), (7, "http://h1.example/7", page(7), "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in wrapper.main_texts(df).collect()}
    assert len(got) == 44 and wrapper.main_texts(df).count() == 45 and got[None].text == got[7].text
    assert got[7].text == "Head 7\nFirst & bold text 7\nSecond text goes on 7\nitem 7" and got[7].n_chars == len(got[7].text)
    assert (got[90].text, got[90].n_chars, got[91].text) == ("", 0, "x")
    assert got[92].text.startswith("Head 1\nShare this page")  # one page makes no template
    assert wrapper.main_texts(df.where("false")).count() == 0


def exact(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            score = x @ q
            out[i] = [(j, s) for s, j in sorted(((-s, j) for j, s in zip(ids, score) if j != i))][:k]
    return out


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[: n // 4] = x[0] + 0.05 * rng.standard_normal((n // 4, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n,scale", [(1500, 1.0), (200, 1e5), (12, 1e-30), (1, 1.0)])
def test_neighbours(spark, n, scale):
    x = vectors(n, 16) * np.float32(scale)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000000, None, 1), (1000020, [0.0] * 16, 1), (1000040, [float("nan")] * 16, 1), (1000060, [None] * 16, 1), (1000080, [scale] * 3, 1), (None, [1.0] * 16, 1)]
    rows += [rows[0], rows[-2]]  # repeated rows count once
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in neighbours.nearest(df, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    # The short vector counts as filled with zeros.
    x = np.vstack([x, np.float32([scale] * 3 + [0.0] * 13)])
    ids = [*range(n), 1000080]
    expected, place = exact(ids, x.astype(np.float64), 20, 20), {j: i for i, j in enumerate(ids)}
    assert set(got) == set(expected)
    hits = total = 0
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, min(20, n) + 1))
        assert all(r.score == pytest.approx(float(x[place[q]].astype(np.float64) @ x[place[r.vec_id]].astype(np.float64)), rel=1e-9, abs=1e-12 * scale**2) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found) and q not in {r.vec_id for r in found}
        hits += len({r.vec_id for r in found} & {j for j, _ in expected[q]})
        total += len(expected[q])
    assert hits / total >= 0.9
    assert neighbours.nearest(df.where("false")).count() == 0


def test_a_node_sends_a_row_for_each_list(spark):
    """Candidates do not travel as a row for each pair; long groups are merged in parts."""
    x = vectors(64, 16)
    rows = [(0, i, True, v.tobytes(), float("-inf")) for i, v in enumerate(x)]
    lists = spark.createDataFrame(rows, "x long, y long, fresh boolean, packed binary, least float")
    found = neighbours.joined(lists, 12)
    assert found.count() == len(rows)
    near = x @ x.T - 9 * np.eye(64, dtype=np.float32)
    for r in neighbours.best(found, 12).collect():
        edges = np.frombuffer(r.edges, neighbours.EDGE)
        assert len(edges) == r.fresh == 12 and r.least == pytest.approx(edges["s"].min())
        assert list(edges["s"]) == pytest.approx(sorted(near[r.u], reverse=True)[:12], abs=1e-6)
    again = neighbours.best(neighbours.settled(found).unionByName(found), 12)
    assert [r.fresh for r in again.collect()] == [0] * 64


def test_sorting_by_two_keys():
    first, second = np.array([1, 0, 1, 0, 1]), np.array([5, 2**62, -(2**62), 3, 5])
    for by in (second, second % 7):
        order = neighbours.by_two(first, by)
        assert list(zip(first[order], by[order])) == sorted(zip(first, by))


def test_what_all_articles_share_stays_and_boxes_go():
    from textweir.llm.wrapper import extract, induce

    pages = [f"<html><body><article><h1>T{k}</h1><p>para {k} is here</p><h2>Conclusion</h2><p>end {k}</p><div class=tools><span>Print this page</span></div></article></body></html>" for k in range(8)]
    assert extract(pages[0], induce(pages)) == "T0\npara 0 is here\nConclusion\nend 0"


def test_alignment_of_large_tables_is_bounded():
    import time

    from textweir.llm.wrapper import collapse, extract, induce, match, parse

    def page(n, k):
        rows = "".join(f"<tr class={'ab'[i % 2]}>" + "".join(f"<td class={'cd'[(i + j) % 2]}>{k} {i} {j}</td>" for j in range(20)) + "</tr>" for i in range(n))
        return f"<html><body><ul><li>Home</li></ul><div class=c><table>{rows}</table><p>text {k} of this page</p></div></body></html>"

    began = time.process_time()
    template = induce([page(300 + 5 * k, k) for k in range(4)])
    assert extract(page(300, 9), template).count("\n") == 300 * 20 - 1 and time.process_time() - began < 60
    a, b = collapse(parse(page(7, 0))), collapse(parse(page(5, 1)))
    pairs = match(a, b)
    assert len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs}) and all(x.tag == y.tag for x, y in pairs)


def test_matching_is_as_heavy_as_by_brute_force():
    import random

    from textweir.llm.wrapper import Group, match

    rng = random.Random(1)

    def tree(depth):
        node = Group(rng.choice("xy"), (rng.choice("pq"),))
        node.kids = [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
        return node

    def heaviest(a, b):
        if a.tag != b.tag:
            return 0
        n, m = len(a.kids), len(b.kids)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + heaviest(a.kids[i], b.kids[j]))
        return 1 + (a.names == b.names) + best[n][m]

    for _ in range(200):
        a, b = tree(3), tree(3)
        b.tag = a.tag
        assert sum(1 + (x.names == y.names) for x, y in match(a, b)) == heaviest(a, b)
