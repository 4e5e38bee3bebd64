import math
import random
import time

from ledgerline.llm.html_text import html_text, main_text
from ledgerline.llm.queries import op6_html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="masthead"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
<div class="wrap"><div id="main"><h1>Title &amp; more</h1><p>First <b>bold</b> text,
 with&nbsp;space &lt;tag&gt;.<p>Second paragraph<br>with a break and a <a href="#">link</a>.</p><div class="cookie-notice">We use cookies</div>
<ul><li>one<li>two</ul><form><input value=x>Subscribe</form><section id="comments"><p>A very long reader comment that says a lot of things about this.</p></section></div>
<aside>About the author and many other words that don't matter here</aside></div><footer>&copy; 2020</footer></body></html>"""


def test_article_of_a_page():
    assert main_text(PAGE) == "Title & more\n\nFirst bold text, with space <tag>.\n\nSecond paragraph with a break and a link.\n\none\n\ntwo"


def test_sections_of_an_article_stay_together():
    body = "".join(f"<section><p>{w * 30}</p><p>{w * 40}</p></section>" for w in ("alpha ", "beta ", "gamma "))
    text = main_text(f"<html><body><div class=ad>Buy</div><article><h1>x</h1>{body}</article></body></html>")
    assert text.count("\n\n") == 6 and text.startswith("x\n\nalpha") and text.endswith("gamma")


def test_links_make_an_element_thin():
    links = "".join(f'<a href="/{i}">some long link text number {i}</a> ' for i in range(40))
    assert main_text(f"<body><div><div>{links}</div><div><p>{'word ' * 50}</p><p>{'more ' * 50}</p></div></div></body>") == ("word " * 50).strip() + "\n\n" + ("more " * 50).strip()


def test_broken_markup():
    assert main_text("<article><p>open <b>bold<br><p>next &am") == "open bold\n\nnext &am"
    assert main_text("<article><p>text</p></div></span><p>more</p><a hre") == "text\n\nmore"
    assert main_text("<p>a<script>if (x) { '</p>' }") == "a"
    assert main_text("plain text only") == "plain text only"
    assert main_text("a < b and c > d") == "a < b and c > d"
    for odd in (None, "", "<", "<>", "</p>", "<!--", "<!DOCTYPE", "<html></html>", "&", "<p", "<script>"):
        assert isinstance(main_text(odd), str)
    assert len(main_text("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4
    assert main_text("<article>" + "<p>w</p>" * 5000 + "</article>").count("w") == 5000


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x", 2), (None, None, None, "y", 3), (1, "u", PAGE, "x", 2)], "page_id long, url string, html string, text string, n_chars int")
    out = html_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert sorted(r.n_chars for r in got) == [0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert html_text(df.where("page_id = 9")).collect() == []


def test_whole_table_has_the_article_of_every_page(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in op6_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    import html
    import re

    for p in pages:
        inner = p.html.split("<article>", 1)[1].split("</article>")[0].split("<footer")[0]
        parts = re.split("</?(?:p|h1)>", inner)
        want = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in parts]
        assert got[p.page_id] == "\n\n".join(x for x in want if x)


def test_wrappers_open_heads_and_second_articles():
    one, two = "word " * 60, "more " * 60
    want = one.strip() + "\n\n" + two.strip()
    for tag in ('div class="content no-sidebar"', 'div id=page class="has-sidebar"', 'section class="with_footer"', 'div class="page-header-wrap social"'):
        assert main_text(f"<body><{tag}><article><p>{one}</p><p>{two}</p></article></{tag.split()[0]}></body>") == want, tag
        assert main_text(f"<body><{tag}><p>{one}</p><p>{two}</p></{tag.split()[0]}><p>x</p></body>").startswith(want), tag
    assert main_text(f"<html><head><title>t</title><body><p>{one}</p><p>{two}</p></body></html>") == want
    assert main_text(f"<html><head><title>t</title><p>{one}</p><p>{two}</p></html>") == want
    assert main_text(f"<body><article><p>{one}</p></article><article><p>{two}</p></article></body>") == want
    assert main_text(f"<body><article><p>{one}</p></article><div class=comments><article><p>{two * 3}</p></article></div></body>") == one.strip()


def test_class_names_of_layouts():
    one, two, junk = "word " * 60, "more " * 60, "junk " * 20
    for name in ("ad", "cookie-notice", "site-footer", "sidebar_2", "related-posts", "commentList", "share-buttons", "nav main", "ad-slot-1", "js-comments-area"):
        assert main_text(f"<body><div><p>{one}</p><p>{two}</p><div class='{name}'><p>{junk}</p></div></div></body>") == one.strip() + "\n\n" + two.strip(), name
    for name in ("no-sidebar", "post-header", "with-comments", "entry-header", "has_menu", "content", "headline", "download", "adjective", "article-footer", "x-share-story-title"):
        assert main_text(f"<body><div><div class='{name}'><p>{junk}</p></div><p>{one}</p><p>{two}</p></div></body>").startswith("junk"), name
    for name in ("content no-sidebar", "single with-comments"):
        assert main_text(f"<body><div class='{name}'><p>{one}</p><p>{two}</p></div></body>") == one.strip() + "\n\n" + two.strip(), name


def test_deep_markup_is_linear():
    t0 = time.process_time()
    assert main_text("<div>" * 100_000 + "deep") == "deep"
    assert main_text("<b>" * 50_000 + "<div>x</div>" * 1000 + "</i>" * 50_000).count("x") == 1000
    assert time.process_time() - t0 < 10


def tree(r, depth):
    """(name, children) of a random page of containers, paragraphs and links."""
    kids = []
    for _ in range(r.randrange(1, 5)):
        if depth < 4 and r.random() < 0.5:
            kids.append(tree(r, depth + 1))
        else:
            say = [("a", [w]) if r.random() < 0.3 else w for w in ("".join(r.choice("abcdef ") for _ in range(r.randrange(3, 60))) + "x" for _ in range(r.randrange(1, 4)))]
            kids.append(("p", say))
    return ("div", kids)


def render(node):
    return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(render, node[1])) + f"</{node[0]}>"


def counts(node):
    """C, LC, T, LT by the definition, recursively."""
    if isinstance(node, str):
        return len(node.replace(" ", "")), 0, 0, 0
    own = [counts(k) for k in node[1]]
    c, lc, t, lt = (sum(x[i] for x in own) for i in range(4))
    t += sum(not isinstance(k, str) for k in node[1])
    lt += sum(k[0] == "a" for k in node[1] if not isinstance(k, str))
    return c, c if node[0] == "a" else lc, t, lt


def density(node, body):
    c, lc, t, lt = counts(node)
    cb, lcb, _, _ = counts(body)
    if c == 0:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + lcb / cb * c + math.e)
    scale = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    if lc == 0 and (base < 1.0001 or scale <= 1):  # no links, nothing to adjust
        return c / max(t, 1)
    return c / max(t, 1) * (math.log(scale) / math.log(base) if scale > 1 else 0.0)


def plain_blocks(node):
    if node[0] == "p":
        text = " ".join("".join(k if isinstance(k, str) else "".join(k[1]) for k in node[1]).split())
        return [text] if text else []
    return [b for k in node[1] for b in plain_blocks(k)]


def expected(body):
    found = []

    def visit(node, path):
        if node[0] != "p":
            found.append((sum(density(k, body) for k in node[1]), len(found), node, path + [node]))
            for k in node[1]:
                visit(k, path + [node])

    visit(body, [])
    top = max(f[0] for f in found)
    if sum(f[0] > top - 1e-9 for f in found) > 1:
        return None
    _, _, best, path = max(found, key=lambda f: f[0])
    threshold = min(density(n, body) for n in path)

    def take(node):
        if any(node is n for n in path[:-1]):
            return [b for k in node[1] for b in take(k)]
        return plain_blocks(node) if node is best or density(node, body) >= threshold > 0 else []

    return "\n\n".join(take(body))


def test_density_against_the_definition():
    r = random.Random(11)
    tried = whole = 0
    for _ in range(400):
        page = tree(r, 0)
        want = expected(("body", [page]))
        if want is not None:
            tried += 1
            whole += want == "\n\n".join(plain_blocks(page))
            assert main_text(f"<html><body>{render(page)}</body></html>") == want
    assert tried > 300 and 20 < whole < tried - 20
