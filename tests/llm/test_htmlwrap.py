"""Wrappers against the pages they come from, and texts of pages in other templates than the given one."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from voxelkeel.llm import htmlwrap
from voxelkeel.llm.htmlwrap import LOOSE, Page, align

SCHEMA = "page_id long, url string, html string"


def tokens(page):
    """The stream of a page before any folding."""
    out = []
    for kind, value in htmlwrap.read_page(page):
        if kind in ("open", "close"):
            out.append(f"<{'/' if kind == 'close' else ''}{value}>")
        elif kind == "text" and value.split() and out[-1:] != ["#"]:
            out.append("#")
    return "".join(out)


def as_regex(items):
    out = ""
    for token, absent, repeats, inside in items:
        core = "#" if token == "#" else as_regex(inside) if token[0] == "(" else f"<{re.escape(token)}>{as_regex(inside)}</{re.escape(token)}>"
        if token == LOOSE:
            core = "(?:" + "|".join(as_regex(((t, False, r, i),)) for t, _, r, i in inside) + ")"
        out += f"(?:{core}){'*' if absent and repeats else '+' if repeats else '?' if absent else ''}"
    return out


def random_page(rng):
    def word():
        return rng.choice(["one", "two &amp; three", "four", "<b>five</b>", "<a href=x>six</a>", "<i>se<br>ven"])

    def block(depth):
        kind = rng.choice(["p", "p", "h2", "ul", "dl", "div", "table"])
        if kind in ("p", "h2"):
            return f"<{kind}>{word()}" + rng.choice([f"</{kind}>", ""])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{word()}" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind == "dl":
            return "<dl>" + "".join(f"<dt>{word()}<dd>{word()}" for _ in range(rng.randint(1, 3))) + "</dl>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{word()}" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))) + "</table>"
        return "<div>" + "".join(block(depth + 1) for _ in range(rng.randint(0, 3) if depth < 3 else 0)) + "</div>"

    return "<html><body>" + ("<nav>n</nav>" if rng.random() < 0.7 else "") + "".join(block(0) for _ in range(rng.randint(0, 7))) + "<footer>f</footer></body></html>"


@pytest.mark.parametrize("seed", range(25))
def test_wrapper_accepts_every_page(seed):
    rng = random.Random(seed)
    pages = [random_page(rng) for _ in range(rng.randint(2, 6))]
    wrapper = None
    for page in pages:
        wrapper = Page(page).stream if wrapper is None else align(wrapper, Page(page).stream)
        assert re.fullmatch(as_regex(Page(page).stream), tokens(page))
    pattern = as_regex(wrapper)
    assert "|" not in pattern.replace(r"\|", "") or LOOSE in json.dumps(wrapper)
    for page in pages:
        assert re.fullmatch(pattern, tokens(page)), page


def test_repeats_and_options():
    def wrapper(*bodies):
        out = Page(bodies[0]).stream
        for body in bodies[1:]:
            out = align(out, Page(body).stream)
        return as_regex(out).replace(r"\#", "#")

    assert wrapper("<p>a<p>b", "<p>c") == "(?:<p>(?:#)</p>)+"
    assert wrapper("<h1>a</h1><p>b", "<p>c") == "(?:<h1>(?:#)</h1>)?(?:<p>(?:#)</p>)"
    assert wrapper("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>") == "(?:<dl>(?:(?:<dt>(?:#)</dt>)(?:<dd>(?:#)</dd>))+</dl>)"
    assert wrapper("<ul></ul>", "<ul><li>x<li>y</ul>") == "(?:<ul>(?:<li>(?:#)</li>)*</ul>)"


def test_many_different_children_stay_bounded():
    rng = random.Random(4)
    pages = ["<div>" + "".join(f"<{t}>x</{t}>" for t in (rng.choice("h1 h2 h3 h4 p pre ul".split()) for _ in range(3000))) + "</div>" for _ in range(3)]
    wrapper = Page(pages[0]).stream
    for page in pages:
        wrapper = align(wrapper, Page(page).stream)
    assert len(json.dumps(wrapper)) < 5000
    assert all(re.fullmatch(as_regex(wrapper), tokens(p)) for p in pages)


def extract(spark, rows, parts=4):
    out = htmlwrap.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    return {r.page_id: r.text for r in out}


def plain_site(k):
    """No article element: the text's place follows from where the running text is."""
    text = [f"Story {k} line {j} with some running words &lt;{j}&gt;." for j in range(3 + k % 4)]
    page = f"""<!doctype html><html><head><title>t</title><script>if (a < b) document.write("<p>no</p>")</script></head>
    <body class=page-with-sidebar><div class="top menu"><a href=/>Home</a> <a href=/b>News {k}</a></div>
    <div class=cookie-notice>We use cookies, all of them, {k} times.</div>
    <div id=wrap><h1>Title {k}</h1>{''.join(f"<p>{t}" for t in text)}
    <div class="ad-box">Buy {k}!</div><p>Closing <em>wo</em>rds&nbsp;{k}.<div class=newsletter><form>Mail: <input><button>Send</button></form></div>
    <section id="comments"><h2>Comments</h2><div class=comment><p>I disagree {k} with a very long comment, longer than the text, {'really ' * 30}</div></section></div>
    <div class=sidebar><ul><li><a href=1>Other {k}</a></ul></div><div class=copyright>&copy; 2020 {k}</div></body>"""
    return page, " ".join([f"Title {k}", *(t.replace("&lt;", "<").replace("&gt;", ">") for t in text), f"Closing words {k}."])


def article_site(k):
    page = f"""<body><header><h1>Site name</h1></header><nav><ul><li>a<li>b {k}</ul></nav><main>
    <aside>Elsewhere {k}</aside><article class="post"><header><h1>Head {k}</h1></header><p>First&#33; para {k}<br>second line<!-- no --></p>
    <ul><li>item {k}<li>item b {k}</ul><p class=note>Read our terms.</p><table><tr><td>1<td>{k}</table><style>p {{}}</style>
    <p hidden>unseen {k}</p><span class="share">Share {k}</span><footer>Tags {k}</footer></article>
    <article class="comment"><p>Reader {k} says many words {'so ' * 50}</p></article></main><footer>End {k}</footer>"""
    return page, f"Head {k} First! para {k} second line item {k} item b {k} 1 {k}"


def test_other_templates(spark):
    rows, want = [], {}
    for k in range(24):
        for base, site in ((0, plain_site), (100, article_site)):
            page, text = site(k)
            rows.append((base + k, f"http://{'plain' if not base else 'News'}.example.org:80/{k}", page))
            want[base + k] = text
    assert extract(spark, rows) == want
    assert extract(spark, rows, 1) == want


def test_one_page_a_host(spark):
    pages = [site(k) for k, site in enumerate((plain_site, article_site))]
    got = extract(spark, [(k, f"https://h{k}.org/", page) for k, (page, _) in enumerate(pages)])
    assert got[0] == pages[0][1]
    assert got[1] == pages[1][1].removesuffix("1 1") + "Read our terms. 1 1", "with one page nothing says that a line is template text"


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep words" + "</div>" * 3000
    rows = [(0, None, None), (1, "no url", ""), (2, "http://x.org", "just text"), (3, "http://x.org", "<p>a<p>b</b></i></div>c"), (4, "http://deep.org", deep),
            (5, "http://long.org/", "<article>" + "<p>word word</p>" * 100_000 + "</article>"), (6, "http://cut.org/", "<article><p>open <b"), (7, "http://cut.org/", "<article><p>x</p><script>never closed <p>y"),
            (8, "http://q.org/", "<article title='a > b'><p class=\"x>y\">in</p> a < b &amp;amp; &am &copy <p>z"), (9, "http://q.org/", "<nav>only menu</nav>"), (None, "http://q.org/", "<article>no id</article>")]
    got = extract(spark, rows)
    assert got == {0: "", 1: "", 2: "just text", 3: "a b c", 4: "deep words", 5: " ".join(["word"] * 200_000), 6: "open", 7: "x", 8: "in a < b &amp; &am © z", 9: "", None: "no id"}
    assert extract(spark, []) == {}


def test_clashing_columns_and_repeated_rows(spark):
    page, text = article_site(3)
    df = spark.createDataFrame([(1, "http://a.org", page)] * 7, SCHEMA)
    for name in ("host", "rule", "pages", "wrapper", "text", "n_chars", "kind"):
        df = df.withColumn(name, F.lit("x"))
    assert [tuple(r) for r in htmlwrap.main_texts(df).collect()] == [(1, "http://a.org", text.removesuffix("1 3") + "Read our terms. 1 3", len(text) + 16)] * 7


def test_hot_host_meets_the_same_rule(spark):
    rows = [(k, "http://hot.org/" if k % 3 else f"http://h{k}.org/", article_site(k)[0]) for k in range(3000)]
    got = extract(spark, rows, 8)
    assert all(got[k] == article_site(k)[1] for k in range(3000) if k % 3)
