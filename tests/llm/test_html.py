import html as h

from gradeloom.llm.html_text import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies, a long notice that says many things about them and more.</p></div>
<nav><ul><li><a href=1>One</a></li><li><a>Two</a></ul></nav><div class="ad">Buy this now, it is very cheap today and tomorrow.</div>
{main}
<aside><p>Sidebar text of some length, with words.</p></aside><form><label>Name</label><input name=x></form>
<section class="comments"><article class="comment"><p>First! A reader's comment that is long enough to look like text of an article, really long.</p></article></section>
<footer>&copy; site</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>First   paragraph\n with <b>bold</b> and <a href=x>a link</a>, long enough to be content of the page.</p><p>Short.<p>Unclosed<br>break"


def test_article_without_the_rest():
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div><div class=content>{}</div></div>", "<article><header>{}</header></article>"):
        want = "Head & line\nFirst paragraph with bold and a link, long enough to be content of the page.\nShort.\nUnclosed break"
        assert main_text(PAGE.format(main=wrap.format(BODY))) == want, wrap


def test_edges(spark):
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("plain text") == "plain text" and main_text("a &lt;b&gt; &eacute; &#233; &am &amp") == "a <b> é é &am &"
    assert main_text("<p>a<p>b</div></p><script>x") == "a\nb"
    assert main_text("<p>a <script>no</script>b <button>no</button>c</p>") == "a b c"
    long = "<article>" + "".join(f"<p>{h.escape('word & ' * 50)}{i}</p>" for i in range(3000)) + "</article>"
    assert main_text(long).count("\n") == 2999
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "u", "<p>x</p>", 2), (3, "u", "<div " * 2000, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = extract_main_text(df).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got)[0] == (0, "x", 1) and len(got) == 4
    assert extract_main_text(df.limit(0)).count() == 0


def test_content_in_several_blocks():
    """All blocks that the clustering chose stay: a short one beside a long one, sibling articles, and text beside an article."""
    intro, body = "Intro words that are long enough to be content here.", "Body words that are long enough to be content of this page, too."
    for one, many in (("<div>{}</div>", "<div class=content>{}</div>"), ("<article>{}</article>", "<div>{}</div>"), ("<article>{}</article>", "{}")):
        page = many.format(one.format(f"<p>{intro}</p>") + one.format(f"<p>{body}</p>" * 8))
        assert main_text(PAGE.format(main=page)) == "\n".join([intro] + [body] * 8), (one, many)
    page = f"<article><p>{intro}</p></article><div><div><p>{body}</p></div></div>"
    assert main_text(PAGE.format(main=page)) == f"{intro}\n{body}"


LAYOUTS = [
    "{top}<article>{body}</article>{bottom}", "{top}<main><div>{body}</div></main>{bottom}", "{top}<div id=content><div class=post>{body}</div></div>{bottom}",
    "<table><tr><td>{top}</td><td><div>{body}</div></td></tr></table>{bottom}", "<div class=page>{top}<section><div>{body}</div></section>{bottom}</div>",
    "{top}<main><article><header>{head}</header><div>{rest}</div></article></main>{bottom}",
]
AD = "Buy one of these today, and get another one for nothing at all, as long as there are some left."
NOISE = [
    ("<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", "<footer><p>Company, all rights reserved, and an address that is long.</p></footer>"),
    (f"<div class=advert><p>{AD}</p></div>", f"<div class='sponsored box'><p>{AD}</p></div>"),
    ("<div id=cookie-banner><p>We use cookies, and we tell you so at great length, on each and every page.</p></div>", "<div class=newsletter><p>Sign up for our letter and never miss a thing.</p></div>"),
    ("<aside><p>About the author, who has written many things for this and other pages.</p></aside>", "<section id=comments><p>First! I have read all of it and I do not agree with a word.</p></section>"),
    ("<div class=share><a href=1>Mail it</a> <a href=2>Print it</a></div>", "<div class=related><ul><li><a href=1>Another story that you may like to read</a><li><a href=2>One more story for you</a></ul></div>"),
]


def test_thirty_pages():
    head, rest = "<h1>Head line</h1>", "".join(f"<p>Paragraph {i} has words enough to be a part of the text, and <a href=x>a link</a>, too.</p>" for i in range(5)) + "<p>End.</p>"
    want = "Head line\n" + "\n".join(f"Paragraph {i} has words enough to be a part of the text, and a link, too." for i in range(5)) + "\nEnd."
    for layout in LAYOUTS:
        for top, bottom in NOISE:
            page = "<html><head><title>T</title></head><body>" + layout.format(top=top, bottom=bottom, head=head, rest=rest, body=head + rest) + "</body></html>"
            assert main_text(page) == want, page


def test_content_named_like_something_else():
    """Names that only hint do not remove text that the clusters chose."""
    text = "Words that are long enough to be content of this page, whatever the class of the block may say."
    for name in ("related", "share", "header", "social", "search"):
        page = f"<article><p>{text}</p><div class={name}><p>{text} Again.</p></div><p>{text}</p></article>"
        assert main_text(PAGE.format(main=page)) == f"{text}\n{text} Again.\n{text}", name


def test_deep_nesting():
    """20,000 open elements, blocks and inline ones, in time and memory that grow with them."""
    assert main_text("<div>" * 20_000 + "deep words" + "</div>" * 20_000) == "deep words"
    assert main_text("<div>" * 20_000 + "<p>a<p>b" + "<span>" * 20_000 + "c<p>d") == "a\nb c\nd".replace("b c", "bc")
