import re

import pyarrow.parquet as pq

from cellplan.llm import html as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a> tagline of the site</header><nav><ul><li><a href="/a">Home</a><li><a href='/b'>News</a></ul></nav><!-- ad <p>x</p> -->
<div class="cookie-notice">We use cookies, click here to accept all of them now</div>
<div class="ad">Buy now</div><article><header><h1>A  title &lt;1&gt;</h1></header><p>First <b>bold</b>word&nbsp;&amp; more<br>second line<p>Short.
<p class="x">Third one &copy; &#233;</p><div class=ad>advert in text</div><ul><li>one<li>two</ul><form><p>Mail</p><input></form>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I disagree with all of this, in very many words.</p></article></section><p>Last.</p></article>
<aside>About the author, a long text that says much</aside><footer>&copy; 2020</footer>"""


def test_article():
    assert h.main_text(PAGE) == "A title <1>\nFirst boldword & more second line\nShort.\nThird one © é\none\ntwo\nLast."


def test_without_article():
    long = "Much text that goes on for long enough to be an article's paragraph, as articles have. "
    page = "<body><div><a href=x>Home</a></div><div><a href=y>News</a></div><div><a href=z>More</a></div><div><a href=z>More</a></div><div>" + "".join(f"<p>{long}{k}</p>" for k in range(5)) + "</div>" + "<p><a href=x>link</a></p>" * 5 + "<p>© me</p>"
    assert h.main_text(page) == "\n".join(f"{long}{k}" for k in range(5))


def test_body_outside_the_article():
    long = "Much text that goes on for long enough to be an article's paragraph, as articles have. "
    body = "".join(f"<p>{long}{k}</p>" for k in range(5))
    want = "\n".join(f"{long}{k}" for k in range(5))
    links = "<p><a href=x>link</a></p>" * 5
    for tag in ("article", "main"):
        assert h.main_text(f"<{tag}><p>A teaser.</p></{tag}>{links}<div>{body}</div>") == want
        assert h.main_text(f"<div>{body}</div>{links}<{tag}><p>A teaser.</p></{tag}>") == want
        # An article outweighs shorter text elsewhere, and none of it is lost.
        page = f"<div><p>{long}</p></div>{links}<{tag}>{body}" + "<div class=ad>ad</div>" * 3 + f"<p>Last.</p></{tag}>"
        assert h.main_text(page) == f"{want}\nLast."


def test_skips_boilerplate_only():
    for opening, end in (("div class='content has-sidebar'", "div"), ("div id='post' class='no-sidebar'", "div"), ("section class='related-work'", "section"), ("article class='post comments-open'", "article")):
        assert h.main_text(f"<{opening}><p>Text.</p></{end}>") == "Text.", opening
    for name in ("sidebar", "x sidebar", "cookie-notice", "ad_1"):
        assert h.main_text(f"<p>Text.</p><div class='{name}'>No.</div>") == "Text.", name
    for tag in ("svg viewBox='0 0 1 1' />", "svg/>", "button>", "video src=x>", "object data='x'>", "video-player>", "select-box a=b></select-box>", "script src='x' />", "button></button>", "button>", "title-bar>"):
        assert h.main_text(f"<p>Before <{tag}</p><p>After.</p>") == "Before\nAfter.", tag
    assert h.main_text("<p>Buy <button>A</button> now <object><object>x</object>y</object>here</p>") == "Buy now here"
    assert h.main_text("<button><p>Text.</p><button>B</button>") == "Text."
    assert h.main_text("<script src=/a/>x</script>y") == "y" == h.main_text("y<script>x")


def test_weak_run_between_strong_ones():
    long = "Much text that goes on for long enough to be an article's paragraph, as articles have. " * 9
    links = "<p><a href=x>link</a></p>" * 5
    text = "A short passage between two figures, with an end of its own, that is long enough to be read."
    assert h.main_text(f"<p>{long}</p>{links}<p>{text}</p>{links}<p>Hm.</p>{links}<p>{long}</p>{links}<p>© me</p>") == f"{long.strip()}\n{text}\nHm.\n{long.strip()}"


def test_sections_at_the_ends():
    """On an unmarked page no section is dropped for its size, however far from the rest; scraps are."""
    long = "Much text that goes on for long enough to be an article's paragraph, as articles have. " * 40
    links = "<p><a href=x>link</a></p>" * 5
    close = "A closing section that is far shorter than a quarter of what stands before it, but is part of the article all the same."
    for text in (close, "So it ends.", "Really?", "He said: \u201cno.\u201d"):
        assert h.main_text(f"<p>{long}</p>{links}<p>{text}</p>{links}<p>© 2020 We. All rights reserved.</p><p>Menu</p>") == f"{long.strip()}\n{text}"
        assert h.main_text(f"<p>Menu</p>{links}<p>{text}</p>{links}<p>{long}</p>") == f"{text}\n{long.strip()}"
    assert h.main_text(f"<h1>The title</h1>{links}<p>{long}</p>{links}<h2>Tags</h2>") == f"The title\n{long.strip()}"


def test_between_articles():
    assert h.main_text("<article>A</article><div>Related: buy this now</div><article>B</article>") == "A\nB"
    assert h.main_text("<article><p>One.</p><button>Share<p>Two three.</p></article>") == "One.\nShare\nTwo three."
    assert h.main_text("<article><p>One.</p><p><a href=x>All of it a link</a></p></article>") == "One.\nAll of it a link"


def test_references():
    """Each piece is decoded by itself, once, and no reference spans markup."""
    assert h.main_text("<article>&am<b>p;</b> &amp<!-- x -->lt; a&#38;lt;b &lt;p&gt; &nbsp;x") == "&amp; &lt; a&lt;b <p> x"


def test_unmarked_pages():
    """Without the article's marks the line blocks find the same text."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    same = [h.main_text(p) == h.main_text(re.sub("</?article>", "", p)) for p in pages]
    assert sum(same) >= 0.95 * len(same), sum(same)
    same = [h.main_text(p) == h.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>")) for p in pages]
    assert sum(same) >= 0.95 * len(same), sum(same)


def test_odd_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<p>") == h.main_text("<!-- x") == h.main_text("<script>x") == ""
    assert h.main_text("just text") == "just text"
    assert h.main_text("<article><p>a < b && c &am") == "a < b && c &am"
    assert h.main_text("<article>x<div class=ad>y") == "x\ny"
    assert len(h.main_text("<article>" + "<p>a</p>" * 50_000)) == 99_999
    assert len(h.main_text("<" * 100_000 + '<a b="' * 20_000)) > 0


def test_surges():
    assert h.surges([0, 5, 0, 7, 0, 0, 0, 3]) == [(1, 4), (7, 8)]
    assert h.surges([]) == [] == h.surges([0, 0])


def test_all_pages(spark):
    """Every block of the marked article in page order and nothing else, against a parse of these pages' plain form."""
    import html

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert h.main_text(p["html"]) == "\n".join(b for b in blocks if b)
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, None), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    out = h.op10_html_extraction(df).collect()
    assert [x.n_chars for x in out] == [len(x.text) for x in out] and len(out) == 3 and out[0].text == out[1].text
    assert h.op10_html_extraction(df.limit(0)).count() == 0
