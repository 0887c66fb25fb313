import html as entities
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from quadrel.llm.html import LineBlockParams, Reader, extract_pages, main_text, passages
from quadrel.llm.queries import op8_html_extract

LONG = "Running text of the main story goes on for a while, with commas and full stops. " * 3


def test_article_without_the_rest():
    page = f"""<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><div id=sidebar><p>Side {LONG}</p></div>
    <article><h1>Title &amp;  more</h1><p>One <b>bo</b>ld<br>line<p>Two &lt;3 &eacute;&#233;<script>var x="</p>"</script>
    <aside>Aside</aside><div class="ad banner">Buy</div><form><p>Send</p></form><ul><li>a<li>b</ul><p>{LONG}</p>
    <section class="comments"><p>First!</p></section></article><footer>&copy; me</footer></body>"""
    assert main_text(page) == f"Title & more One bold line Two <3 éé a b {LONG.strip()}"


def test_page_without_article_by_line_blocks():
    page = f"<div><a href=1>Some menu entry</a> <a href=2>Another entry</a></div><div class=menu>x</div><p>{LONG}</p><p>Short end.</p><div class=footer>{LONG}</div><div><a href=3>Imprint</a></div>"
    assert main_text(page) == f"{LONG.strip()} Short end."
    assert main_text("plain text") == "plain text"


def test_text_beside_a_teaser_article():
    story = f"<p>{LONG}</p><p>{LONG}</p>"
    want = f"{LONG.strip()} {LONG.strip()}"
    assert main_text(f"<body><div id=content>{story}</div><article><h3>Read on</h3><p>A teaser.</p></article></body>") == f"{want} Read on A teaser."
    assert main_text(f"<body><article><a href=1>Read this one too</a></article><div id=content>{story}</div></body>") == want
    many = "".join(f"<p>Short paragraph {i} of the story.</p>" for i in range(40))
    assert "paragraph 39" in main_text(f"<body><div>{many}</div><article>{LONG}</article></body>")
    # Text beside a true article stays away, and all of the article counts.
    assert main_text(f"<body><div><p>About this site.</p></div><article>{story}<div class=ad>x</div><p>End.</p></article><div>Imprint of us</div></body>") == f"{want} End."
    links = f"<ul><li><a href=1>{LONG}</a></ul>"
    assert main_text(f"<body><article><p>See:</p>{links}</article><div>Imprint</div></body>") == f"See: {LONG.strip()}"


def test_passages_inside_a_region_compete():
    story, links, advert = f"<p>{LONG}</p><p>{LONG}</p>", "<ul><li><a href=1>Home and news</a><li><a href=2>More of this site</a></ul>", "<p>Buy this now, cheap.</p>"
    want = f"{LONG.strip()} {LONG.strip()}"
    for region in ("main", "article", "div"):
        assert main_text(f"<body><{region}><div>{links}</div><div>{story}</div><div>{advert}</div></{region}></body>") == want, region
    assert main_text(f"<body><main><div>{links}</div><article>{story}</article><div>{advert}</div></main></body>") == want
    # A part of some height, or between kept ones, stays; so does a short one in the story's own container.
    parts = f"<section><h2>One</h2><p>{LONG}</p></section><section><p>Short.</p></section><section><p>{LONG}</p></section>"
    assert main_text(f"<body><main>{parts}</main></body>") == f"One {LONG.strip()} Short. {LONG.strip()}"
    assert main_text(f"<body><main>{story}<div class=ad>x</div><p>End.</p></main></body>") == f"{want} End."


def test_windows_decide_where_a_region_wraps_all():
    """Names taken off and the whole page in <main>: all that is left is text and links. Taking
    every passage that is no menu, whatever its windows say, finds next to nothing."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    plain = [re.sub(r'\s(class|id)="[^"]*"', "", re.sub(r"(</?)(article|nav|footer|header|aside)\b", r"\1div", h)) for h in pages]
    wrapped = [re.sub("</body>", "</main></body>", re.sub(r"<body([^>]*)>", r"<body\1><main>", h)) for h in plain]
    want = [main_text(h) for h in pages]
    assert sum(main_text(h) == w for h, w in zip(wrapped, want, strict=True)) >= 0.93 * len(want)
    assert sum(main_text(h, LineBlockParams(height=0)) == w for h, w in zip(wrapped, want, strict=True)) <= 0.05 * len(want)


def test_short_end_behind_a_removed_element():
    for end in ("<p>Short end.</p>", "Short end.", "<div>Short end.</div>", "<p>See <a href=1>the end</a>"):
        text = " ".join(re.sub("<.*?>", "", end).split())
        assert main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p><div class=ad>Buy</div>{end}</div></body>") == f"{LONG.strip()} {LONG.strip()} {text}"
        assert main_text(f"<body><article><p>{LONG}</p><div class=ad>Buy</div>{end}</article></body>") == f"{LONG.strip()} {text}"
    assert main_text(f"<body><div><p>{LONG}</p></div><div class=ad>Buy</div><section><p>Far away.</p></section></body>") == LONG.strip()


def test_teasers_before_the_story():
    story = f"<p>{LONG}</p><p>{LONG}</p>"
    page = f"<body><article class=card><p>teaser card</p></article><div class=content>{story}</div></body>"
    assert main_text(page) == f"teaser card {LONG.strip()} {LONG.strip()}"
    cards = "".join(f"<article><a href={i}>Card number {i} of this page</a></article>" for i in range(9))
    assert main_text(f"<body>{cards}<div>{story}</div>{cards}</body>") == f"{LONG.strip()} {LONG.strip()}"


def test_names_that_only_hold_a_hint_stay():
    for name in ('class="related-work"', 'id="comments-on-method"', 'class="share"', 'class="header-files"', 'id=admin', 'class="sidebars-considered"'):
        assert main_text(f"<article><p>{LONG}</p><div {name}><p>{LONG}</p></div><p>End.</p></article>") == f"{LONG.strip()} {LONG.strip()} End.", name
    for name in ('class="comments"', 'id="comment-list"', 'class="x ad-box y"', 'class="site-header"', 'id="cookie_notice"', 'class="left-sidebar"', "class=user-comments"):
        assert main_text(f"<article><p>{LONG}</p><div {name}><p>{LONG}</p></div><p>End.</p></article>") == f"{LONG.strip()} End.", name


def test_sections_without_an_article():
    parts = "".join(f"<section><h2>Part {i}</h2><p>{LONG if i != 1 else 'Short.'}</p></section>" for i in range(3))
    page = f"<body><div><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div>Buy this now.</div><div>{parts}</div><div>All rights reserved.</div></body>"
    assert main_text(page) == f"Part 0 {LONG.strip()} Part 1 Short. Part 2 {LONG.strip()}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(1, 9)), max_size=30), st.integers(1, 4))
def test_window_sums_by_brute_force(sizes, window):
    rows = [None if n is None else next(r for r in Reader("x" * n, 1).out if r) for n in sizes]
    found = [(len(p.lines), p.size, p.peak) for p in passages(rows, window)]
    want, run = [], []
    for i in range(len(sizes) + window + 1):  # a passage ends with ``window`` blank lines
        covered = [sizes[j] or 0 for j in range(max(0, i - window + 1), min(i + 1, len(sizes)))]
        if sum(covered):
            run.append((i, sum(covered)))
        elif run:
            own = [sizes[j] for j in range(run[0][0], min(run[-1][0] + 1, len(sizes))) if sizes[j]]
            want.append((len(own), sum(own), max(s for _, s in run)))
            run = []
    assert found == want


def test_time_is_linear_in_hostile_pages():
    def seconds(n):
        begin = time.process_time()
        for page in ("<b>" * n + "</i>x</u>" * n, "<b>" * n + "<p>x" * n, "<div>" * n + "<p>x</li>" * n, '<a "' * n, "<li><b>x" * n, "<article>x<p>y" * n, "<div>x<p>y" * n):
            main_text(page)
        return time.process_time() - begin

    seconds(2000)
    assert seconds(32_000) < 16 * max(seconds(4000), 0.05)


def test_text_decides_without_tags_and_names():
    """Pages of the table with <article> made a <div> and all names taken off, then with every
    container a <div>: the distribution alone finds the text of nearly all of them."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    nameless = [re.sub(r'\s(class|id)="[^"]*"', "", re.sub(r"(</?)article\b", r"\1div", h)) for h in pages]
    divs = [re.sub(r"(</?)(nav|footer|header|aside)\b", r"\1div", h) for h in nameless]
    want = [main_text(h) for h in pages]
    for changed, least in ((nameless, 0.95), (divs, 0.93)):
        assert sum(main_text(h) == w for h, w in zip(changed, want, strict=True)) >= least * len(want)


def test_unclosed_and_hostile():
    assert main_text("<div class=ad>x<article><p>kept") == "kept"
    assert main_text("<p>a <!-- never closed <p>b") == "a"
    assert main_text("<p>1 < 2 and <b>3") == "1 < 2 and 3"
    assert main_text("<p>" * 20000 + "x") == "x"
    assert main_text("<div>" * 2000 + "x") == "x"
    assert main_text(None) == main_text("") == main_text("<script>x") == ""


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b", ">", '"', "'", "<!--", "-->", "<script>", "</script>", "text ", "<nav>", "</nav>", "<article>", "&amp", "=", "<div class=ad>", "</div>", "<", "/"]), max_size=25).map("".join))
def test_any_markup(page):
    text = main_text(page)
    assert text == " ".join(text.split())


def test_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (1, "u", "<p>é one", "x"), (1, "u", "<p>é one", "x"), (2, "v", "<article>" + "<p>word word" * 50000 + "</article>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((r.page_id or 0, r.text[:10], r.n_chars) for r in extract_pages(frame).collect())
    assert out == [(0, "", 0), (1, "", 0), (1, "é one", 5), (1, "é one", 5), (2, "word word ", 500_000 - 1)]
    assert extract_pages(frame.limit(0)).collect() == []


def test_query_against_a_plain_reading(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = {r.page_id: r for r in op8_html_extract(spark, sf).collect()}
    assert out.keys() == pages.keys()
    for k, page in pages.items():
        body = re.search(r"<article>(.*?)(</article>|$)", page.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body))
        want = " ".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)
        assert (out[k].text, out[k].url, out[k].n_chars) == (want, page.url, len(want))
