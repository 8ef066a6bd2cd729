import random
import time

import pytest

from aerolith.llm.html_text import MANY, extract, parse

SCHEMA = "page_id long, url string, html string, host string"


@pytest.mark.parametrize("page,want", [
    ("", []),
    ("just text", ["just text"]),
    ("<p>a<p>b", ["a", "b"]),
    ("<article><h1>T &amp; t</h1><p><b>x\n  y<br><p>z&nbsp;&#233;&quot;</article><footer>f</footer>", ["T & t", "x y", 'z é"']),
    ("<body><nav>m</nav><header>h</header><main><p>in</p></main><p>out</p></body>", ["in"]),
    ("<article><header><h1>own</h1></header><p>a</p><div class='comments'><p>c</p></div><section id=comments>d</section><aside>s</aside></article>", ["own", "a"]),
    ("<div class='post'><p>a</p></div><div class=\"cookie-notice\">n</div><div class=ad>x</div><div class='shadow'>kept</div>", ["a", "kept"]),
    ("<script>var a='<p>no</p>'</script><p>1 < 2 &lt; 3</p><!-- c > <p>no</p> --><style>p{}</style>", ["1 < 2 < 3"]),
    ("<article>open <script>never closed <p>x", ["open"]),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", ["a", "b", "1 2", "3"]),
    ("<form><p>f</p></form><div role=banner>b</div><div hidden>h</div><p>t</p></div></div>", ["t"]),
    ("<p>a</p><!-- never closed <p>b</p>", ["a"]),
    ("<article><p>one</p></article><article><p>two</p></article><article class=comment><p>c</p></article>", ["one", "two"]),
    ("<p>&am", ["&am"]),
    ("<main><div class='social-studies'><p>Hello world</p></div></main>", ["Hello world"]),
    ("<article><div class='share-price'>12.5</div><p class='notice-of-motion'>motion</p><p class='post ads'>x</p><div id=shareButtons>y</div><div class='site-footer_2'>z</div></article>", ["12.5", "motion"]),
    ("<main><p>long text</p><article><h2>Card</h2></article><p>more</p></main><p>out</p>", ["long text", "Card", "more"]),
    ("<p title='a>b'>q</p><img alt=\"x\"><p>" + "w " * 50_000 + "</p>", ["q", " ".join(["w"] * 50_000)]),
])
def test_blocks(page, want):
    assert parse(page)[0] == want


def test_templates_of_a_host_go_and_articles_stay(spark):
    box = "<div class='x1'><p>Follow our weekly letter</p></div>"
    rows = [(i, f"https://u@A.example.com:80/p{i}?q", f"<body>{box}<div><p>text {i}</p></div></body>", "clash") for i in range(8)]
    rows += [(20 + i, "http://b.example.com/", f"<body>{box}<p>b {i}</p></body>", "") for i in range(MANY - 1)]  # too few
    rows += [(30 + i, "http://c.example.com/", "<body><div><p>same page</p></div></body>", "") for i in range(9)]  # one page, repeated
    rows += [(40 + i, "http://d.example.com/", f"<article><p>same words</p>{box}<p>d {i}</p></article>", "") for i in range(6)]
    rows += [(50, None, f"<body>{box}</body>", None), (51, "odd", None, ""), (None, "http://a.example.com", f"{box}<p>no id</p>", "")]
    got = {r.page_id: (r.text, r.n_chars, r.url) for r in extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    assert all(got[i][0] == f"text {i}" for i in range(8)) and got[None][0] == "no id"
    assert all(got[20 + i][0] == f"Follow our weekly letter\nb {i}" for i in range(MANY - 1))
    assert got[30][0] == "same page" and got[41][0] == "same words\nd 1" and got[50][0] == "Follow our weekly letter"
    assert got[51] == ("", 0, "odd") and all(n == len(t) for t, n, _ in got.values())


def as_html(node):
    tag, kids = node
    return f"<{tag}>{kids if isinstance(kids, str) else ''.join(map(as_html, kids))}</{tag}>"


def blocks_of(node, cut=frozenset()):
    tag, kids = node
    if node in cut:
        return []
    return [kids] if isinstance(kids, str) else [b for k in kids for b in blocks_of(k, cut)]


def subtrees(node):
    if not isinstance(node[1], str):
        yield from (x for k in node[1] for x in subtrees(k))
        if node[0] in ("div", "section"):
            yield node


def test_templates_like_a_plain_count(spark):
    """Trees whose boxes recur, counted beside the texts that remain without them, and cut where the count says so."""
    rng = random.Random(3)
    boxes = [("div", (("p", f"box {k}"), ("section", (("p", f"inner {k % 3}"),)))) for k in range(12)]
    pages = []
    for i in range(120):
        own = tuple(("p", f"words {rng.randrange(60)} {j}") for j in range(rng.randint(1, 3)))
        some = tuple(b for k, b in enumerate(boxes) if rng.random() < 0.5 / (k + 1))
        kids = [*some, ("div", own), *([("div", (("p", "own text on many pages"),))] if i % 40 == 0 else [])]
        rng.shuffle(kids)
        pages.append((i, rng.choice(["x.example.com", "x.example.com", "y.example.com"]), ("body", tuple(kids))))
    pages += [(200 + i, "x.example.com", pages[0][2]) for i in range(20)]  # copies
    beside, all_pages = {}, {}
    for _, host, tree in pages:
        all_pages.setdefault(host, set()).add(tree)
        for x in subtrees(tree):
            beside.setdefault((host, x), set()).add(tuple(sorted(rest(tree, x))))
    cut = {h: frozenset(x for (g, x), n in beside.items() if g == h and len(n) >= MANY and len(n) ** 2 >= len(all_pages[h])) for h in all_pages}
    assert all(2 < len(c) < 14 for c in cut.values())
    rows = [(i, f"https://{host}/{i}", as_html(tree), "") for i, host, tree in pages]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == {i: "\n".join(blocks_of(tree, cut[host])) for i, host, tree in pages}


def rest(tree, subtree):
    """Blocks beside one occurrence of a subtree."""
    out = blocks_of(tree)
    for b in blocks_of(subtree):
        out.remove(b)
    return out


def test_one_article_with_many_menus_is_no_template(spark):
    page = "<body><div id=m{0}><p>menu {0}</p></div><div><p>the same article</p></div></body>"
    rows = [(i, "http://n.example.com/", page.format(i % 3), "") for i in range(30)]
    assert {r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {f"menu {k}\nthe same article" for k in range(3)}


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_nesting_takes_linear_time():
    took = []
    for n in (2_000, 16_000):
        page = "<body>" + "<div>" * n + "<p>text</p>" + "</div>" * n + "</body>"
        at = time.process_time()
        assert parse(page)[0] == ["text"]
        took.append(time.process_time() - at)
    assert took[1] < 25 * took[0]
