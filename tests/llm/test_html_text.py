from planloom.llm import html_text

ARTICLE = "<p>The first paragraph has a fair number of words, so that it is dense &amp; long enough.</p><p>A second one\n  goes on   about <b>the same</b> matter at some length, too.</p>"
WANT = "The first paragraph has a fair number of words, so that it is dense & long enough.\n\nA second one goes on about the same matter at some length, too."


def test_boilerplate_goes_and_blocks_stay():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>Other</a></ul></nav>
<div class="cookie-notice">We use cookies for all kinds of things and want you to agree to that.</div>
<div id="sidebar"><p>Popular: <a href=/1>one long title of a story</a> <a href=/2>another long title of a story</a></p></div>
<article><h1>Headline</h1>{ARTICLE}<form><input><button>Send</button></form><div class="ad">Buy now, it is cheap.</div><ul><li>point one<li>point two</ul></article>
<section class="comments"><p>I do not agree with any of that, and here are many words on why that is so.</p></section>
<footer>&copy; Site</footer></body></html>"""
    assert html_text.main_text(page) == f"Headline\n\n{WANT}\n\npoint one\n\npoint two"


def test_density_finds_the_article_without_names():
    links = "".join(f"<li><a href=/{k}>link number {k}</a></li>" for k in range(30))
    page = f"<html><body><div><ul>{links}</ul></div><div><div>{ARTICLE}</div></div><div><a href=/a>about</a> <a href=/b>terms</a></div></body></html>"
    assert html_text.main_text(page) == WANT


def test_all_dense_subtrees_are_content():
    texts = [" ".join([f"word{k}"] * 45) for k in range(10)]
    first, second = ("".join(f"<p>{t}</p>" for t in part) for part in (texts[:5], texts[5:]))
    links = "".join(f"<li><a href=/{k}>link number {k}</a></li>" for k in range(30))
    assert html_text.main_text(f"<body><div><div>{first}</div><ul>{links}</ul><div>{second}</div></div></body>") == "\n\n".join(texts)
    assert html_text.main_text(f"<body><div><article>{first}</article><ul>{links}</ul><article>{second}</article></div></body>") == "\n\n".join(texts)
    assert html_text.main_text(f"<body><div><div>{second}</div></div><div><div>{first}</div></div></body>") == "\n\n".join(texts[5:] + texts[:5])


def test_broken_and_odd_pages():
    assert html_text.main_text("") == ""
    assert html_text.main_text("just words &lt;here&gt;") == "just words <here>"
    assert html_text.main_text("<html><body><nav><a href=/>x</a></nav></body></html>") == ""
    assert html_text.main_text("<article><h1>A &#233;</h1><p><b>one<br>two<p>three") == "A é\n\none two\n\nthree"
    assert html_text.main_text("<p>" * 5000 + "deep " + "<div>" * 5000 + "down") == "deep\n\ndown"
    assert html_text.main_text("<body><article><p>" + "word " * 300_000 + "</p></article>") == ("word " * 300_000).strip()


def test_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, f"<body><article>{ARTICLE}</article>", None), (2, None, f"<body><article>{ARTICLE}</article>", None), (None, "u", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(df).collect(), key=lambda r: (r.page_id or 0))
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(None, "", 0), (1, "", 0), (2, WANT, len(WANT)), (2, WANT, len(WANT))]
    assert html_text.extract(df.limit(0)).count() == 0
