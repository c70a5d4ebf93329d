"""HTML extraction against an extractor of its own: generated pages whose boilerplate is marked for it by an attribute."""

import html
import random
import re
import time
from html.parser import HTMLParser

import pytest
from pixelloom.llm.html_extract import extract_text, main_text

STOPS = "the of and to in is that it was for on are as with be at by this have from".split()
RARE = "river lantern copper village harbour machine copperplate window morning theory signal".split()


class Reference(HTMLParser):
    """Text of all blocks outside elements that have data-junk."""

    blocks = {"p", "h1", "h2", "li", "div", "article", "main", "section", "blockquote", "nav", "header", "footer", "aside", "form", "ul", "body", "td", "tr", "table"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.junk, self.parts, self.out = [], [], []

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.blocks:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("img", "hr", "input", "meta"):
            self.junk.append((tag, "data-junk" in dict(attrs) or bool(self.junk and self.junk[-1][1]) or tag in ("script", "style", "title")))

    def handle_endtag(self, tag):
        if tag in self.blocks:
            self.flush()
        if self.junk and self.junk[-1][0] == tag:
            self.junk.pop()

    def handle_data(self, data):
        if not (self.junk and self.junk[-1][1]):
            self.parts.append(data)


def reference(page):
    r = Reference()
    r.feed(page)
    r.close()
    r.flush()
    return "\n\n".join(r.out)


def generated(seed):
    rng = random.Random(seed)

    def prose(n):
        words = [rng.choice(STOPS) if rng.random() < 0.45 else rng.choice(RARE) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(words))
            words[i] = rng.choice(("<b>{}</b>", "<a href='/x>y'>{}</a>", "<i class=\"menu-word\">{}</i>", "{}<br>", "{} &amp; &eacute;&#8212;", "{}\n\t ", "<!-- note > -->{}")).format(words[i])
        return " ".join(words)

    def block(inside):
        kind = rng.random()
        if kind < 0.6 or not inside:
            return f"<p>{prose(rng.randint(30, 120))}</p>"
        if kind < 0.7:
            return f"<h2 id='s{seed}'>{prose(4)}</h2>"
        if kind < 0.8:
            return f"<p>{prose(5)}</p>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{prose(rng.randint(8, 20))}" for _ in range(3)) + "</ul>"
        return f"<blockquote><p>{prose(40)}</p></blockquote>"

    def junk(inside):
        tag, attrs = rng.choice((
            ("nav", ""), ("aside", ""), ("div", 'class="ad"'), ("div", 'class="cookie-notice"'), ("div", "id=sidebar"), ("section", 'id="comments"'), ("div", 'class="share"'),
            ("div", 'role="navigation"'), ("form", ""), ("div", 'class="newsletter box"'), ("footer", ""), ("div", 'id="user-comments"'), ("div", 'class="commentlist"'), ("div", 'class="cookie-message"'), ("section", 'class="js-consent"'), *((() if inside else (("header", ""),))),
        ))
        body = rng.choice((f"<p>{prose(30)}</p>", "".join(f"<a href='/{i}'>{prose(2)}</a> " for i in range(6)), "<ul>" + "".join(f"<li><a href=#>{rng.choice(RARE)}</a></li>" for _ in range(5)) + "</ul>"))
        return f"<{tag} {attrs} data-junk>{body}</{tag}>"

    holder, attrs = rng.choice((("article", ""), ("main", ""), ("article", 'class="post has-comments"'), ("div", 'class="entry-content"'), ("div", "id=text")))
    inside = holder != "div"
    parts = [f"<h1>{prose(5)}</h1>", block(False)]
    for _ in range(rng.randint(1, 7)):
        parts.append(junk(True) if rng.random() < 0.25 and inside else "<script>if (a < b) { x = '</p>'; }</script>" if rng.random() < 0.1 else block(inside))
    parts.append(block(False))
    around = rng.choice(("content has-sidebar", "no-ads", "layout-nav", "with-comments", "container", "page-wrap"))
    before, after = "".join(junk(False) for _ in range(rng.randint(0, 3))), "".join(junk(False) for _ in range(rng.randint(0, 3)))
    if rng.random() < 0.3:  # replies below the article, each an article
        replies = "".join(f"<article class='comment depth-{i}' data-junk><p>{prose(40)}</p></article>" for i in range(3))
        after = f"<ol class=\"comment-list\" data-junk>{replies}</ol>{after}" if rng.random() < 0.5 else replies + after
    if rng.random() < 0.2 and "<form" not in before + after + "".join(parts):  # the whole page in a form
        before, after = f"<form id='aspnetForm' action=x>{before}", f"{after}</form><p data-junk></p>"
    return f"<!DOCTYPE html><html><head><title>{prose(3)}</title><style>p > a {{}}</style></head><body class='home nav-open'>{before}<div class=\"{around}\"><{holder} {attrs}>{''.join(parts)}</{holder}></div>{after}</body></html>"


def test_generated_pages():
    for seed in range(200):
        page = generated(seed)
        assert main_text(page) == reference(page), seed


def test_comments_notices_and_forms():
    text, other = " ".join(STOPS * 4), " ".join(["or an not but which they you his"] * 6)
    for around in ("<article class=comment>{}</article>", "<div id='user-comments'><p>{}</p></div>", "<ol class='commentlist'><li><article><p>{}</p></article></ol>", "<div class='cookie-message'>{}</div>", "<div id=comment-12><p>{}</p></div>", "<div class='GDPR_consent-text'>{}</div>"):
        assert main_text(f"<article><p>{text}</p></article>{around.format(other)}") == text, around
        assert main_text(f"<div><p>{text}</p></div>{around.format(other)}") == text, around
        assert main_text(around.format(other)) == other, around  # alone on its page it stays
    for name in ("comments-open", "no-comments", "has-comments", "comment-count-3"):
        assert main_text(f"<div class='{name}'><p>{text}</p></div>") == text and main_text(f"<article class='{name}'><p>{text}</p></article><p>{other}</p>").startswith(text), name
    assert main_text(f"<form id=aspnetForm><div><p>{text}</p><p>{other}</p></div></form><p>{text[:80]}</p>").startswith(f"{text}\n\n{other}")
    assert main_text(f"<p>{text}</p><p>{text}</p><form><p>{other}</p></form>") == f"{text}\n\n{text}"


def test_page_table_against_the_reference(spark):
    class Article(Reference):
        def handle_starttag(self, tag, attrs):
            super().handle_starttag(tag, [("data-junk", "")] if tag in ("nav", "footer", "head") or dict(attrs).get("class") == "ad" else [])

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {}
    for r in pages.collect():
        article = Article()
        article.feed(r.html or "")
        article.close()
        article.flush()
        wanted[r.page_id] = "\n\n".join(article.out)
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == wanted


@pytest.mark.parametrize("piece", ['<a b="', "</div>", "<div>", "<!", "<script>", "<p title='x\" y>a ", "<", '<a href="x>', "<a ='", "<!--", "<head>", "<![CDATA[", "<a>x", "<style x/>"])
def test_time_is_linear(piece):
    begin = time.perf_counter()
    main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - begin < 3


def test_unclosed_quotes_hide_nothing():
    words = " ".join(STOPS * 3)
    assert main_text(f"<p><a href=\"x>a link</a> {words}</p><p>{words}</p>") == f"a link {words}\n\n{words}"
    assert main_text(f"<p it's>{words}</p><p class='a>b'>{words}</p>") == f"{words}\n\n{words}"
    assert main_text(f"<p>1 < 2 & 3 &l<b>t;</b> {words}</p>") == f"1 < 2 & 3 &lt; {words}"
    assert html.unescape("&copy;") in main_text(f"<p>&copy; {words}</p>")


def test_no_pages_and_other_columns(spark):
    df = spark.createDataFrame([(None, None, None, "x", 1.0), (2**60 + 1, "u", "<p>one two</p>", "y", 2.0)], "page_id long, url string, html string, text string, n_chars double")
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in extract_text(df).collect()} == {(None, None, "", 0), (2**60 + 1, "u", "one two", 7)}
    assert extract_text(df.limit(0)).collect() == []
