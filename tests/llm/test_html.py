"""Main-text extraction: worked pages, awkward markup, and generated hosts whose main text is known."""

import random
import time

import pytest

from longpanel.llm import op10_html


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{x}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (
            "<nav><ul><li>menu</li></ul></nav><div class='ad'>buy</div><article><h1>Head &amp; line</h1><p>One\n two<b> three</b><p>four&nbsp;five<br>six<script>var t='</p>'</script></article>"
            "<section class='comments'><article class='comment'>me too</article></section><footer>&copy; x</footer>",
            "Head & line One two three four\xa0five six",
        ),
        ("<article>one</article><article>two</article><article>three</article>", "one two three"),
        ("<article class='post no-comments'>kept</article><p>other", "kept"),
        ("<article><h1 class='article-header'>Title</h1><p class='social-science'>science</p><p class='cookie-notice'>cookies</p></article>", "Title science"),
        ("<article><p title=it's>open</p> and <p title='a>b'>more</p></article>", "open and more"),
        ("<article>a b<!-->c<!--->d<!-- x --!>e</article>", "a bcde"),
        ("<article>1 < 2 & 3 &lt; 4 &#x1F642; &unknown; </ x>5</article>", "1 < 2 & 3 < 4 🙂 &unknown; 5"),
        ("<div class='widget'><article>the only one</article></div>", "the only one"),
        ("<article>text <aside>side</aside><form>form</form><span class=ad>ad</span><pre><span class='comment'># code</span></pre><div id=comments>no</div></article>", "text # code"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><th>e</table><dl><dt>f<dd>g</dl></article>", "a b c d e f g"),
        ("<article><b>bold<p>in</b>side</p> tail</article>", "bold inside tail"),
        ("<main><p>main text</p></main><div>other</div>", "main text"),
        ("<ul><li><a href=/>menu</a></li><li>an <a href=/>entry</a></li></ul><p>body</p>", "an entry body"),
        ("<form><article>in a form</article></form>", "in a form"),
        ("<div itemprop='articleBody'>body</div><div>rest</div>", "body"),
        ("<article>R&<b>amp;D</b> a&am<!-- -->p;b &amp;amp; &<i>#65;</i>&#66;</article>", "R&amp;D a&amp;b &amp; &#65;B"),
        ("<div class='layout right-sidebar'><p>text</p><div class='ad'>buy</div></div>", "text"),
        ("<div class='layout right-sidebar'><p>hidden beside other text</p></div><p>text</p>", "text"),
        ("<div class='menu'><ul><li>no prose</li></ul></div><div class='ad'>buy</div>", ""),
        ("<form id=f><nav>menu</nav><div>text<select><option>no</select><input></div></form>", "text"),
        ("<div>text</div><form><div>a form beside it</div></form>", "text"),
        *[(f"<article><p>text</p><div class='{c}'><p>reader says</p></div></article>", "text") for c in ("reader-comments", "user-comments", "post_comments", "commentlist", "x-comment-list", "blog-replies-area")],
        *[(f"<article><div class='{c}'>text</div></article>", "text") for c in ("no-comments", "has-comments", "comment-free-prose", "commentary")],
        ("<article><p hidden>no</p><p aria-hidden=true>no</p><svg/><svg><text>no</text></svg>yes</article>", "yes"),
    ],
)
def test_worked_pages(body, text):
    assert op10_html.extract(page(body)) == text


def test_empty_and_broken_pages():
    assert [op10_html.extract(x) for x in (None, "", "<", "<!-- open", "<script>x", "<p", "</p></b>")] == ["", "", "<", "", "", "", ""]
    assert op10_html.extract("<article><p>open <i>tags") == "open tags"
    assert op10_html.extract("<head><title>x</title><p>body without end of head") == "body without end of head"


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "deep", "<p>" + "<b>" * 20_000 + "deep" + "</i></b>" * 20_000, "<ul><li>" * 10_000 + "deep" + "<li>" * 10_000, "<div>" * 10_000 + "deep" + "<li></li></p>" * 10_000, "<a x=" + "='" * 20_000 + ">deep", "<p>deep" + "<" * 20_000, "<p>deep" + "</" * 20_000, "<div class=ad>" * 20_000 + "<p>deep" + "<div class=ad>" * 20_000, "<form>" * 20_000 + "deep"])
def test_long_and_deep_pages_take_linear_time(html):
    began = time.time()
    assert op10_html.extract(html).startswith("deep")
    assert time.time() - began < 3


def generated(seed, marked):
    """(host, html, main text): several hosts with their own templates, menus, notices and misleading names."""
    rng = random.Random(seed)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    for h in range(6):
        top, foot, cls = words(4), words(6), rng.choice(["story", "post no-comments", "entry-content", "social-science", "ad-hoc"])
        menu, mid = [words(1) for _ in range(5)], words(5)
        for _ in range(rng.randrange(4, 12)):
            parts = [[words(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 4) if marked else 1)]
            body = f"<div id=top>{top}</div><ul>" + "".join(f"<li><a href=/{m}>{m}</a> {m}</li>" for m in menu) + f"</ul><nav><li>{words(2)}</nav><div class='ad'>{words(5)}</div>"
            for p in parts:
                inner = f"<h2 class='article-header'>{p[0]}</h2>" + "".join(f"<p class='x-{rng.randrange(99)}'>{q}" for q in p[1:])
                body += f"<article class='{cls}'>{inner}</article>" if marked else f"<div class='{cls}'>{inner}</div>"
            body += f"<div class=mid>{mid}</div><div class='cookie-banner'>{words(6)}</div><div>{foot}</div><footer>{words(3)}</footer>"
            yield f"h{h}.example", page(body), " ".join(q for p in parts for q in p)


@pytest.mark.parametrize("marked", [True, False])
def test_generated_hosts_give_their_main_text(spark, marked):
    rows = [(i, f"https://{host}/{i}", html, "x", text) for i, (host, html, text) in enumerate(generated(3, marked))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template string, wanted string")
    found = {r["page_id"]: r["text"] for r in op10_html.main_text(pages).collect()}
    assert found == {r[0]: r[4] for r in rows}


def test_templates_against_the_definition(spark):
    """A text is template if at least three different pages have its node and all of those have the text there."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        blocks = "".join(f"<div class=c{'abc'[k % 3]}>{rng.choice('uv') if rng.random() < 0.15 else 'const'}{k % 4}</div>" for k in range(rng.randrange(5)))
        rows.append((i, f"http://h{i % 7}/", page(blocks + f"<p>{i % 40}</p>")))
    rows += [(100, None, None), (101, "http://h1/", "")]
    wanted = {}
    for host in {f"h{i}" for i in range(7)}:
        pages = {}
        for i, url, html in rows:
            if html and url == f"http://{host}/":
                digest, found = op10_html.node_texts(html)
                pages[digest] = pages.get(digest, set()) | found
        for path in {p for found in pages.values() for p, _ in found}:
            having = [f for f in pages.values() if (path, None) in f]
            common = set.intersection(*[{t for p, t in f if p == path and t} for f in having])
            if len(having) >= 3 and common:
                wanted.setdefault(host, set()).update(common)
    got = {r["host"]: set(map(bytes, r["template"])) for r in op10_html.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == wanted and wanted


def test_copies_prove_no_template(spark):
    rows = [(i, f"https://Site.example/{i}", page(f"<nav>{i}</nav><p>the one text</p>"), "x") for i in range(5)] + [(50, "https://other.example/", page("<div>Lone page</div>"), "x"), (51, None, None, "x"), (52, None, "", "x"), (None, None, "x", None)]
    found = op10_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert sorted(r["text"] for r in found) == ["", "", "Lone page"] + ["the one text"] * 5 + ["x"]


def test_large_templates_join_by_host(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://{host}/{i}", html) for i, (host, html, _) in enumerate(generated(4, False))], "page_id long, url string, html string")
    wanted = sorted(op10_html.main_text(pages).collect())
    monkeypatch.setattr(op10_html, "BROADCAST_BYTES", -1)
    assert sorted(op10_html.main_text(pages).collect()) == wanted
