import html
import re
import time

from pyspark.sql import functions as F

from folioscope.llm import html_extraction as H

FURNITURE = """<header class="masthead"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><form><label>Mail</label><input></form><script>var a="</p><article>x</article>";</script><style>p{}</style><!-- <p>no</p> -->"""
END = '<section id="comments"><article class="comment"><p>Nice post! Nice post! Nice post! Nice post! Nice post!</p></article></section><div class="ad">Buy</div><footer>&copy; 2024</footer>'


def page(body):
    return f"<!DOCTYPE html><html class='has-sidebar'><head><title>T &amp; t</title></head><body>{FURNITURE}{body}{END}</body></html>"


def test_article_without_furniture():
    got = H.main_text(page("<article><h1>A &amp; B</h1><p><b>bold</b>ly  go &lt;x&gt; &eacute;<br>next<p>two\n\tthree<aside>no</aside></article>"))
    assert got == "A & B boldly go <x> é next two three"


def test_broken_markup():
    assert H.main_text("<article><p>one<p>two</b> &am <i>th</i>ree") == "one two &am three"
    assert H.main_text("<p>a <b>b") == "a b"
    assert H.main_text("just text < 3 & more") == "just text < 3 & more"
    assert H.main_text(None, {}) == H.main_text("", {}) == H.main_text("<!-- open") == ""


def test_long_page():
    assert H.main_text("<div>" * 3000 + "deep" + "<p>x</p>" * 20000).startswith("deep x x")


def test_style_tree_without_article(spark):
    rows = [(i, "http://a.example/%d" % i, f"<body><div class='c1'><p>same words on every page of this host</p></div><div class='c2'><p>own text {' '.join(f'w{i}x{k}' for k in range(30))}</p></div></body>", "x") for i in range(12)]
    rows += [(20, "http://b.example/", "<div>only page</div>", "x"), (21, None, None, "x"), (22, "http://c.example/", "", "x"), (22, "http://c.example/", "", "x")]
    rows += [(30 + i, "http://copy.example/", "<div>the same page again</div>", "x") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string").repartition(3)
    got = H.extracted(pages)
    assert got.columns == ["page_id", "url", "path", "text"]
    texts = [(r.page_id, r.text) for r in got.collect()]
    assert len(texts) == len(rows)
    assert sorted(texts)[0] == (0, "own text " + " ".join(f"w0x{k}" for k in range(30)))
    assert dict(texts) | {20: "only page", 21: "", 22: "", 30: "the same page again", 31: "the same page again", 32: "the same page again"} == dict(texts)


def plain(page):
    """The test tables' pages, taken apart by their known form."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (html.unescape(re.sub(r"</?b>", "", p)) for p in re.split(r"</?(?:p|h1|br)>", body))
    return " ".join(t for t in (" ".join(p.split()) for p in parts) if t)


def test_tables_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = H.op2_style_tree_extraction(spark, sf)
    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.page_id: (r.text, r.n_chars) for r in got.collect()} == {k: (v, len(v)) for k, v in want.items()}


def test_mirrored_article_keeps_list_and_table(spark):
    body = page("<article><h1>Title</h1><p>Some prose.</p><ul><li>first point</li><li>second point</li></ul><table><tr><td>cell one</td><td>cell two</td></tr></table></article>")
    others = [(i, f"https://a.example/{i}", page(f"<article><p>other text {i}</p></article>")) for i in range(2, 6)]
    pages = [(0, "https://a.example/0", body), (1, "https://a.example/1", body), *others]
    found = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[0] == found[1] == "Title Some prose. first point second point cell one cell two"
    assert [found[i] for i in range(2, 6)] == [f"other text {i}" for i in range(2, 6)]


def test_page_with_two_articles():
    text = H.main_text(page("<article><p>first one</p></article><aside><article><p>advert</p></article></aside><article><p>and the longer second</p></article>"))
    assert text == "first one and the longer second"


def test_marks_never_hide_the_only_article():
    article = "<article><p>Hello world text</p></article>"
    for wrapper in ("layout with-sidebar", "content comment-page", "sidebar", "page-menu"):
        assert H.main_text(f'<body><nav>menu words here</nav><div class="{wrapper}">{article}</div></body>') == "Hello world text"
    assert H.main_text(f'<article><p>Own</p></article><div class="sidebar">{article}</div>') == "Own"
    assert H.main_text(f'<article><p>Own</p><div class="related-work"><p>Earlier work.</p></div><div class="related-posts">More</div></article><section id="comments">{article}</section>') == "Own Earlier work. More"
    assert H.main_text('<div class="content comment-page"><p>All of the text of this page</p></div><div class="ad">Buy</div>') == "All of the text of this page"
    assert H.main_text("<nav>all of it is menu</nav>") == ""


def test_nested_unknown_end_tags_take_linear_time():
    started = time.process_time()
    H.parse("<div>" * 20000 + "</b></i></p>" * 20000)
    assert time.process_time() - started < 3


def test_articles_lose_nothing_that_others_repeat(spark):
    """Headings, paragraphs and lists that every article of a host has stay, and so do sections named like furniture."""
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(20))
    body = lambda i: f"<h2>Introduction</h2><p>{own(i)}</p><p>Read more every day</p><div class='x'><ul><li>first promise</li></ul></div><h2>References</h2>"
    rows = [(i, f"https://a.example/{i}", page(f"<article>{body(i)}</article>"), "host", "nodes") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, nodes string").repartition(3)
    got = H.extracted(pages)
    assert got.columns == ["page_id", "url", "host", "nodes", "text"]
    assert {r.page_id: r.text for r in got.collect()} == {i: f"Introduction {own(i)} Read more every day first promise References" for i in range(8)}
    for name in ("discussion", "search", "related", "notification", "share", "banner-design"):
        assert H.main_text(f'<article><p>One.</p><section id="{name}"><h2>Heading</h2><p>Prose.</p></section></article>') == "One. Heading Prose."
    assert H.main_text("<article><p>As <math><mi>x</mi></math> grows</p></article>") == "As x grows"
    assert H.main_text('<article><p>One.</p><div class="ad">Buy</div><aside>Side</aside><nav>Menu</nav><form>Mail</form><section id="comments"><p>Nice!</p></section></article>') == "One."


def slow_text(page, site):
    """The style tree over plain dictionaries: (page, all distinct pages of its host) -> text."""
    import math

    def weighed(root):
        out, todo = {}, [root]
        while todo:
            n = todo.pop()
            styles, words = out.setdefault(n.path, [[], []])
            below = [] if n.article else [c for c in n.children if not isinstance(c, str) and not c.silent]
            styles += [c.style for c in below if c.tag not in H.INLINE and c.style not in styles]
            if not n.article:
                words += [w for c in n.children if isinstance(c, str) for w in html.unescape(c).lower().split()]
                words += [w for c in below if c.tag in H.INLINE for b in H.blocks(c) for w in b.lower().split()]
            todo += [c for c in below if c.tag not in H.INLINE]
        return out

    merged = {}
    for p in set(site):
        for path, (styles, words) in weighed(H.parse(p)).items():
            merged.setdefault(path, []).append((tuple(styles), words))
    low = {}
    for path, held in merged.items():
        m = len(held)
        if m < H.EVIDENCE:
            continue
        words = {w for _, ws in held for w in ws}
        if words:
            spread = []
            for w in words:
                counts = [ws.count(w) for _, ws in held if w in ws]
                spread.append(-sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts))
            own = 1 - sum(spread) / len(words) / math.log(m)
        else:
            shares = [sum(s == t for t, _ in held) / m for s in {s for s, _ in held}]
            own = -sum(x * math.log(x) for x in shares) / math.log(m)
        if own < H.LEAST:
            low[path] = (own, len({s for s, _ in held}))

    def importance(n):
        own, kinds = low.get(n.path, (1.0, 1))
        below = [] if n.article else [c for c in n.children if not isinstance(c, str) and not c.silent and c.tag not in H.INLINE]
        if below:
            own = (1 - 0.9**kinds) * own + 0.9**kinds * sum(importance(c) for c in below) / len(below)
        return 1.0 if n.article else own

    def gone(n):
        below = [] if n.article else [c for c in n.children if not isinstance(c, str) and not c.silent and c.tag not in H.INLINE]
        return {c.path for c in below if not c.article and importance(c) < 0.3}.union(*(gone(c) for c in below))

    root = H.parse(page)
    if H.articles(root):
        return " ".join(H.region_blocks(root))
    return " ".join(H.region_blocks(root, frozenset(gone(root))) or H.region_blocks(root))


def test_unmarked_pages_same_as_a_plain_style_tree(spark):
    """Pages of bare divisions: what each host repeats goes, what differs stays; the tree decides, as without it nothing would go."""
    import random

    rng = random.Random(3)
    word = lambda k: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(k))
    rows = []
    for host in range(4):
        menu, foot = word(8), word(12)
        for i in range(9):
            items = "".join(f"<div><span>{word(2)}</span></div>" for _ in range(rng.randint(0, 3)))
            body = f"<div class='u{host}'><div class='m'>{menu}</div></div><div class='v'><div class='t'>{word(30)}</div>{items}</div><div class='w'><div>{foot}</div></div>"
            rows.append((len(rows), f"http://h{host}.example/{i}", body if i < 8 else f"<article><p>{word(9)}</p></article>{body}", menu, foot))
        rows += [(len(rows), f"http://h{host}.example/again", rows[-2][2], menu, foot)]
    site = {u: [r[2] for r in rows if r[1].split("/")[2] == u.split("/")[2]] for _, u, *_ in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, menu string, foot string").repartition(5)
    got = {r.page_id: r.text for r in H.extracted(pages).collect()}
    assert got == {i: slow_text(h, site[u]) for i, u, h, *_ in rows}
    assert all(menu not in got[i] and foot not in got[i] for i, _, _, menu, foot in rows)
    assert all(menu in H.main_text(h) and foot in H.main_text(h) for _, _, h, menu, foot in rows if "<article>" not in h)
    # the same in every run and order
    assert got == {r.page_id: r.text for r in H.extracted(pages.orderBy("menu", F.desc("page_id")).repartition(2)).collect()}


def test_pages_with_articles_meet_the_tree(monkeypatch):
    """The tree weighs what is around an article too, and can take none of the article away."""
    html_, seen, weigh = page("<div class='m'>menu</div><article><p>own</p></article><div class='n'>more</div>"), [], H.low_paths
    monkeypatch.setattr(H, "low_paths", lambda top, low: seen.append(weigh(top, low)) or seen[-1])
    known = {p: (0.0, 1) for p in H.style_nodes(H.parse(html_))}
    assert H.main_text(html_, known) == "own"
    assert len(seen) == 1 and len(seen[0]) >= 2 and not hasattr(H, "_passed")


def test_empty(spark):
    assert H.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_tree_weighs_blocks_in_inline_elements(spark):
    """A page whose body is one inline element is weighed like any other."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"http://a.example/{i}", f"<body><font><div class='c1'>same words <b>every</b> day</div><span><div class='c2'>{own(i)}</div></span></font></body>") for i in range(8)]
    got = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert {r.page_id: r.text for r in got.collect()} == {i: own(i) for i in range(8)}


def test_tree_weighs_what_an_article_names_like_furniture(spark):
    """In an article a repeated element that is named like furniture goes; a name alone or a repetition alone takes nothing."""
    own = lambda i, c: " ".join(f"{c}{i}x{k}" for k in range(20))
    body = lambda i: (
        f"<h2>Introduction</h2><div><p>{own(i, 'a')}</p><div class='newsletter'><h3>Stay informed</h3><p>Get our letter</p></div></div>"
        f"<p>{own(i, 'b')} <span class='share'>Share this</span></p><section id='related'><h2>Related work</h2><p>{own(i, 'c')}</p></section><div class='promise'>Read more every day</div>"
    )
    rows = [(i, f"https://a.example/{i}", page(f"<article>{body(i)}</article>")) for i in range(8)]
    rows += [(8, "https://b.example/", page(f"<article>{body(8)}</article>"))]  # one page is no evidence
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    text = lambda i, letter, share: f"Introduction {own(i, 'a')}{letter} {own(i, 'b')}{share} Related work {own(i, 'c')} Read more every day"
    assert got == {i: text(i, "", "") for i in range(8)} | {8: text(8, " Stay informed Get our letter", " Share this")}
    # a path that is low outside of articles takes nothing from one that is in them
    assert H.main_text("<body><div role='article'><div class='x'>own</div></div></body>", {p: (0.0, 1) for p in H.style_nodes(H.parse("<body><div><div class='x'>own</div></div></body>"))}) == "own"
