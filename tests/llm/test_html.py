import html as entities
import random
from html.parser import HTMLParser

from pyspark.sql import types as T

from barloom.llm.html import BLOCK, decide, extract_text, grow, main_text, read_blocks, training_table

TREE = grow(*training_table())
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site">Big Site</header><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>A title</h1><p>Some &eacute;t&eacute; <b>bo</b>ld   text
here &lt;ok&gt; &#8364;<p>Short.<p>A line<br>and <a href=z>a link</a><aside>related</aside><div class="adBox ad">Buy now</div>
<form><input name=q>Search</form><!-- hidden --><p>Last words</article><section id="comments"><p>nice post</p></section></main>
<footer>&copy; me</footer></body></html>"""


def test_page():
    assert main_text(PAGE, TREE) == "A title\nSome été bold text here <ok> €\nShort.\nA line\nand a link\nLast words"


def test_without_an_article():
    page = "<div id=menu><a>Home</a> <a>About</a></div><div><p>" + "word " * 40 + "</p><p>" + "again " * 30 + "</p><p>Short.</p><p>" + "more " * 50 + "</p></div><div class=footer>copyright</div>"
    got = main_text(page, TREE).split("\n")
    assert len(got) == 4 and got[2] == "Short."


def test_headers():
    page = '<div class="site-header">Site</div><article><header class="post-header"><h1>Head</h1></header><div id="articleHeader">By me</div><p>Text</p></article>'
    assert main_text(page, TREE) == "Head\nBy me\nText"


def test_broken_pages():
    for page in (None, "", "<", "<p", "<!-- open", "<script>x", "a < b", "<p class='x>y", "</p></div>", "<article><p>x<div>y</article>z"):
        assert isinstance(main_text(page, TREE), str)
    assert main_text("<article>a < b &amp c</article>", TREE) == "a < b & c"
    assert main_text("<article><p>one<p>two <scr", TREE) == "one\ntwo"
    assert main_text("<article>" + "<p>x y</p>" * 20_000 + "</article>", TREE).count("\n") == 19_999


def test_inside_an_article():
    """Text stays whatever its length and neighbours; links beside links go; what is marked goes."""
    r = random.Random(2)
    for _ in range(3000):
        near = [(r.randint(0, 90), r.choice([0.0, r.random(), 1.0])) for _ in range(2)]
        own = (r.randint(1, 90), r.random() * 0.9)
        assert decide(TREE, (1, 1, 0, r.randint(0, 1), *near[0], *own, *near[1])) == 1
        assert decide(TREE, (1, 1, 1, 0, *near[0], *own, *near[1])) == 0 and decide(TREE, (1, 0, 0, 0, *near[0], *own, *near[1])) == 0
        assert decide(TREE, (1, 1, 0, 0, r.randint(0, 90), r.random() * 0.4, own[0], 1.0, r.randint(0, 90), r.random() * 0.4)) == 1
        assert decide(TREE, (1, 1, 0, 0, *near[0], own[0], 1.0, r.randint(1, 15), 1.0)) == 0


def test_raw_and_custom_elements():
    assert main_text("<article><p>one</p><video-player></video-player><p>two</p><p>three</p></article>", TREE) == "one\ntwo\nthree"
    assert main_text('<article><p>text <span class="advert">buy <b>it</b></span> more</p><span hidden>no</span><p>x <ins class="adsbygoogle">ad</ins>y</p><cookie-banner><p>We use</p></cookie-banner><my-note>end</my-note></article>', TREE) == "text more\nx y\nend"
    assert main_text("<article><h1>Head</h1><p><a href=x>open link</p><p>one two three</p><p>four</p></article>", TREE) == "Head\nopen link\none two three\nfour"
    assert main_text('<article><pre>x <span class="hljs-comment"># c</span></pre><p>a <span class="ad">x <p>y</p> c</article>tail', TREE) == "x # c\na"


class Reader(HTMLParser):
    """Blocks of well-formed pages by the standard library's parser: (text, words in links)."""

    def __init__(self):
        super().__init__()
        self.out, self.parts, self.links, self.linked, self.quiet = [], [], 0, 0, 0

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((text, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.quiet += tag in ("script", "style")
        self.links += tag == "a"
        if tag in BLOCK:
            self.cut()

    def handle_endtag(self, tag):
        self.quiet -= tag in ("script", "style")
        self.links -= tag == "a"
        if tag in BLOCK:
            self.cut()

    def handle_data(self, data):
        if not self.quiet:
            self.parts.append(data)
            self.linked += len(data.split()) if self.links else 0


def _page(r, marked):
    """A page and its main text. Without marks all elements around blocks are plain ``div``."""
    word = lambda: "".join(r.choice("abcdefghij&é") for _ in range(r.randint(2, 8))).replace("&", "&amp;")
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{k}'>{words(1, 2)}</a></li>" for k in range(r.randint(4, 8))) + "</ul>"
    box = lambda tag, body: f"<{tag}>{body}</{tag.split()[0]}>" if marked else f"<div>{body}</div>"
    want = [words(3, 9)]
    body = f"<h1>{want[0]}</h1>"
    for _ in range(r.randint(3, 8)):
        text = words(25, 70)
        want.append(text)
        link = text.split(" ", 2)
        body += f"<p>{link[0]} <a href=x>{link[1]}</a> {link[2]}</p>"
        if marked and r.random() < 0.3:
            body += r.choice([f"<aside>{words(30, 40)}</aside>", f'<div class="advert">{words(5, 40)}</div>', f"<form>{words(2, 5)}<input></form>", menu(), f"<script>{words(3, 4)}</script>"])
    page = box("nav", menu()) + box('div class="cookie-notice"', words(4, 9)) + box("article", body)
    page += box('section id="comments"', f"<p>{words(30, 50)}</p><p>{words(3, 9)}</p>") if marked else ""
    return f"<html><head><style>p{{}}</style></head><body>{page}{box('footer', words(3, 8))}</body></html>", entities.unescape("\n".join(want))


def test_blocks_against_the_standard_parser():
    r = random.Random(8)
    for k in range(60):
        page, want = _page(r, k % 2 == 0)
        reader = Reader()
        reader.feed(page)
        reader.cut()
        assert [(b[0], b[2]) for b in read_blocks(page).blocks] == reader.out
        if k % 2 == 0:
            assert main_text(page, TREE) == want


def test_words_and_links_alone_find_the_text():
    """Of the blocks of pages without any mark at least 95 percent are told right, by words and links of neighbours."""
    r, right, total = random.Random(9), 0, 0
    for _ in range(200):
        page, want = _page(r, False)
        got, want = set(main_text(page, TREE).split("\n")), set(want.split("\n"))
        every = {b[0] for b in read_blocks(page).blocks}
        total += len(every)
        right += len(every) - len(got ^ want)
    assert right / total > 0.95, right / total


def test_query(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, None), (2, None, "", None), (None, "v", "<article>ü</article>", "x")], schema)
    rows = {(r.page_id, r.url): r for r in extract_text(df).collect()}
    assert rows[1, "u"].n_chars == len(rows[1, "u"].text) and rows[2, None].text == "" and rows[None, "v"].n_chars == 1
    assert extract_text(df).count() == 4 and extract_text(df.limit(0)).collect() == []
