import re

import pytest

from quarry.llm import site_tree

SCHEMA = "page_id bigint, url string, html string, text int, node string, row int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 0, "", 0) for i, u, h in rows], SCHEMA)


def text(page):
    return site_tree.main_text("http://a/", page, lambda _: False)


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two  \n three<br>four", "one\ntwo three four"),
    ("<html><head><title>t</title><style>x{}</style></head><body><nav>menu</nav><article><h1>H</h1><p>a <b>b</b>c</p></article>"
     "<footer>f</footer>", "H\na bc"),
    ("<div class='ad'><div>x</div>y</div><div id=main-content>body &eacute;&#233;&#xe9;</div>", "body ééé"),
    ("<nav><ul><li>open <p>text</p></ul></nav><p>kept</p>", "kept"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<pre>a  b\n c</pre><ul><li>x<li>y</ul>", "a b c\nx\ny"),
    ("<script>if (a < b) '</p>'</script><p>s</p><!-- <p>no</p> --><noscript>n</noscript>", "s"),
    ("<main><header><h1>Title</h1></header><p>t</p><aside>side</aside><section class=comments><p>c</p></section></main>out", "Title\nt"),
    ("<header>site</header><div class='sidebarLeft'>s</div><form>f<input></form><div class=cookie-notice>c</div><p>x</p>", "x"),
    ("<p>a</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul>", "a"),
    ("<p>see <a href=1>one</a>, <a href=2>two</a> and <a href=3>three</a> for more on all of these things</p>",
     "see one, two and three for more on all of these things"),
    ("<article>one</article><div>x</div><article>two</article>", "one\ntwo"),
    ("<p hidden>h</p><p style='display: none'>n</p><p>v</p><a title=\"x>y\">z</a>", "v\nz"),
    ("<p>broken <b>bold<i>x</p><p>next</b></i>", "broken boldx\nnext"), ("a < b and <3", "a < b and <3"),
    ("<article class=comment>c</article><p>p</p>", "p"), ("</p></div>x", "x"), ("<p>&copy; &middot; &unknown;</p>", "© · &unknown;"),
])
def test_golden_pages(page, want):
    assert text(page) == want


def test_deep_and_long_pages():
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long = " ".join(f"w{i}" for i in range(60_000))
    assert text(f"<p>{long}</p>") == long
    assert text('<a title="' * 200 + "x")


def site(n, host="h.example"):
    rows = []
    for i in range(n):
        body = " ".join(f"unique{i}x{j}" for j in range(30))
        rows.append((i, f"http://{host}/{i}", f"<html><body><div class=qa><p>Welcome to our lovely place</p></div>"
                     f"<div class=qb><h2>Story {i}</h2><p>{body}</p></div><div class=qc><span>All the rest of it here</span></div>"))
    return rows


def want(i):
    return f"Story {i}\n" + " ".join(f"unique{i}x{j}" for j in range(30))


def test_template_branches_go_by_entropy(spark):
    rows = site(12) + [(100 + i, f"http://tiny{i}.example/", "<div class=qa><p>Welcome to our lovely place</p></div><p>own</p>")
                       for i in range(3)]
    got = {r.page_id: r for r in site_tree.extract(pages(spark, rows)).collect()}
    for i in range(12):
        assert got[i].text == want(i) and got[i].n_chars == len(got[i].text)
    assert got[100].text == "Welcome to our lovely place\nown"        # one page says nothing about its host


def test_copies_of_a_page_are_no_template(spark):
    article = "<article><p>The very same article text on every page</p></article>"
    rows = [(i, f"http://c.example/{i}", article) for i in range(50)] + site(12)[:0]
    assert {r.text for r in site_tree.extract(pages(spark, rows)).collect()} == {"The very same article text on every page"}


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = site(12) + [(50, None, "<p>a</p>"), (51, "u", None), (52, "", "")]
    one = sorted(tuple(r) for r in site_tree.extract(pages(spark, rows)).collect())
    monkeypatch.setattr(site_tree, "MAX_BROADCAST_NODES", 0)
    assert sorted(tuple(r) for r in site_tree.extract(pages(spark, rows)).collect()) == one
    assert dict((r[0], r[2]) for r in one)[3] == want(3) and [r for r in one if r[0] == 51] == [(51, "u", "", 0)]


def test_null_ids_repeats_and_empty_table(spark):
    got = site_tree.extract(pages(spark, [(None, None, "<p>x"), (1, "u", "<p>x"), (1, "u", "<p>x")])).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "x"), (1, "x"), (1, "x")]
    assert site_tree.extract(pages(spark, [])).count() == 0


def test_articles_of_the_test_pages(spark):
    import html
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in site_tree.extract(rows).collect()}
    for r in rows.collect():
        inner = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<br>|</?b>", "", x)).split()) for x in re.split("</?(?:h1|p)>", inner)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


ARTICLE = "<article><h1>Head</h1><p>The first paragraph of it.</p>{}<p>The last one.</p></article>"
KEPT = "Head\nThe first paragraph of it.\n{}The last one."


@pytest.mark.parametrize("open_", ['<div class="page has-sidebar">', '<div class="layout-with-sidebar">', '<div id="main-menu-open">',
                                   '<div class="sidebar">', '<section class="widget comments">', '<nav>', '<form id="f">', '<aside>'])
def test_wrappers_of_an_article_stay(open_):
    end = "</" + re.match(r"<(\w+)", open_)[1] + ">"
    assert text(open_ + ARTICLE.format("") + end) == KEPT.format("")


@pytest.mark.parametrize("name", ["related-work", "share-prices", "social-history", "notice-period", "ad-hoc", "menuItemsOfTheDay"])
def test_parts_of_an_article_with_noisy_words_stay(name):
    part = f"<section id='{name}'><p>Part of the text.</p></section>"
    assert text(ARTICLE.format(part)) == KEPT.format("Part of the text.\n")
    assert text(ARTICLE.format(part.replace("id=", "class="))) == KEPT.format("Part of the text.\n")


@pytest.mark.parametrize("name", ["comments", "comment-list", "sidebarLeft", "share-buttons", "related", "ad", "cookieNotice", "newsletter signup"])
def test_noisy_parts_of_an_article_go(name):
    assert text(ARTICLE.format(f"<div class='{name}'><p>Noise</p></div>")) == KEPT.format("")


def test_text_in_a_form_or_noisy_wrapper_stays():
    body = "<p>" + "All of the text of the page. " * 5 + "</p>"
    want = ("All of the text of the page. " * 5).strip()
    assert text(f"<nav>menu</nav><form method=post>{body}</form>") == want
    assert text(f"<nav>menu</nav><div class=widget>{body}</div><div class=widget><p>small</p></div>") == want


def brute_importance(rows):
    """Node importances from page trees, by definition: entropies of child sequences and of texts over pages."""
    from collections import Counter, defaultdict
    import math
    styles, texts, pages_of = defaultdict(dict), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for _, url, html in rows:
        root = site_tree.parse(html)
        site_tree.measure(root)
        page = tuple(t for t, _ in site_tree.candidate_blocks(root, site_tree.has_links(html)))
        for words, around in site_tree.blocks(root, lambda n: n.unseen):
            for i, node in enumerate(around):
                path = (site_tree.host_of(url), *(n.name for n in around[:i + 1]))
                kinds = [p.tag for p in node.parts if isinstance(p, site_tree.Node)]
                styles[path].setdefault(page, set()).add(tuple(k for j, k in enumerate(kinds) if j == 0 or k != kinds[j - 1]))
                texts[path][words.lower()].add(page)
                pages_of[path].add(page)
    out = {}
    for path, found in pages_of.items():
        seen = Counter(s for page in styles[path].values() for s in page)
        m = sum(seen.values())
        if m < 2:
            out[path] = (m, 1.0)
            continue
        presentation = -sum(n / m * math.log(n / m, m) for n in seen.values())
        content = 1 - sum(math.log(len(p), m) for p in texts[path].values()) / len(texts[path])
        share = site_tree.GAMMA ** len(seen)
        out[path] = (m, (1 - share) * presentation + share * content)
    return out


def test_importances_equal_their_definition(spark):
    rows = site(9) + site(7, "other.example") + [(90, "http://h.example/x", "<div class=qb><h2>Odd</h2></div><ul><li>a<li>b</ul>")]
    rows += [(91 + i, f"http://nav.example/{i}", f"<nav><a href=1>Home</a><a href=2>News {i % 2}</a></nav><article><p>own words {i}</p></article>"
              "<footer>All rights</footer>") for i in range(8)]
    want = {site_tree.key_of(p[0], "".join(f"/{n}" for n in p[1:])): v for p, v in brute_importance(rows).items()}
    got = {r.node: (r.m, r.importance) for r in site_tree.importances(pages(spark, rows), "url", "html").collect()}
    assert set(got) == set(want)
    for node, (m, value) in want.items():
        assert got[node][0] == m and got[node][1] == pytest.approx(value, abs=1e-9)


def test_the_tree_takes_what_names_do_not(spark, monkeypatch):
    """Boilerplate of a host without any telling name, and of one with names outside the lists."""
    rows = site(12) + [(200 + i, f"http://n.example/{i}", "<div class=zoneA><p>Open every day from nine to five</p></div>"
                        f"<div class=zoneB><p>{' '.join(f'own{i}w{j}' for j in range(20))}</p></div><div class=kolofon>Printed by us</div>")
                       for i in range(6)]
    with_tree = {r.page_id: r.text for r in site_tree.extract(pages(spark, rows)).collect()}
    assert all(with_tree[i] == want(i) for i in range(12))
    assert all(with_tree[200 + i] == " ".join(f"own{i}w{j}" for j in range(20)) for i in range(6))
    monkeypatch.setattr(site_tree, "LOW", -1.0)
    without = {r.page_id: r.text for r in site_tree.extract(pages(spark, rows)).collect()}
    assert all("Welcome" in without[i] and "All the rest" in without[i] for i in range(12))
    assert all("Printed by us" in without[200 + i] for i in range(6))


def test_tree_of_the_given_pages(spark):
    """Menus repeat more than articles there, but no branch is a template: each has words of its own on every page."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = {site_tree.host_of(r.url) for r in rows.select("url").collect()}
    nav, article = ({site_tree.key_of(h, f"/#root/html/body/{tag}") for h in hosts} for tag in ("nav", "article"))
    found = site_tree.importances(rows, "url", "html").filter("m >= 3").collect()
    mean = [sum(r.importance for r in found if r.node in some) / sum(r.node in some for r in found) for some in (nav, article)]
    assert mean[0] < mean[1]
    assert site_tree.low_nodes(rows, "url", "html").count() == 0
