"""Main text: names and values of attributes, wrappers, headers, and random pages against a plain tree walk."""

import random
from html.parser import HTMLParser

import pytest

from sozgar.llm.html import BLOCK, main_text

ONE, TWO = "The hidden city lay, as they said, beyond the river and the old walls.", "A second paragraph follows, with commas, and goes on for a while."
TEXT = f"{ONE}\n\n{TWO}"


@pytest.mark.parametrize("start", [
    '<div title="the hidden city">', '<div data-overflow="hidden">', '<div class="content has-sidebar">', '<div class="post entry comments-open">', "<div data-x='un hidden'>", '<div class="no-ads">',
    '<div class="layout-sidebar with-comments">', '<article class="post comments-open sharing-enabled">', '<div class="content-sidebar">', '<div data-class="comments" data-id=ad>', '<form id="aspnetForm" class="form"><h1 hidden>x</h1>',
])
def test_articles_are_not_lost_by_words_in_attributes(start):
    if "layout" in start or "form" in start:
        start += "<main>"
    assert main_text(f"<body><nav>Menu</nav>{start}<p>{ONE}</p><p>{TWO}</p></body>") == TEXT


def test_words_in_inner_attributes():
    page = f'<body><article><p data-x="un hidden">{ONE}</p><p><a href="/hidden/x">A second</a> paragraph follows, with commas, and goes on for a while.</p><p hidden>gone</p><p style="display: none">gone</p></article></body>'
    assert main_text(page) == TEXT
    assert main_text(f'<body><p title=a">{ONE}</p><p class="y">{TWO}</p></body>') == TEXT
    assert main_text(f'<body><p title="a > b">{ONE}</p><p title=\'"\'>{TWO}</p></body>') == TEXT


def test_headers():
    page = f"<body><header><h1>Site</h1><p>Since 1900</p></header><article><header><h2><a href=/a>Title</a></h2><p>By <a href=/x>link</a>line, in June</p></header><p>{ONE}</p><p>{TWO}</p></article></body>"
    assert main_text(page) == f"Title\n\nBy line, in June\n\n{TEXT}"


def test_open_head_and_broken_markup():
    assert main_text(f"<html><head><title>T</title><meta charset=x><body><p>{ONE}<p>{TWO}") == TEXT
    assert main_text(f"<title>T</title><link rel=x><p>{ONE}</b></i><p>{TWO}</div></div>") == TEXT


@pytest.mark.parametrize("noise", [
    '<div class="comments"><article class="comment"><p>{0}</p></article></div>', '<section id="comment-list"><h3>Replies</h3><p>{0}</p></section>', '<div class="sidebar content"><p>{0}</p></div>', '<div class="main-menu"><a href=/>{0}</a></div>',
    '<div class="post-navigation">{0}</div>', '<div class="article-footer"><p>{0}</p></div>', '<aside><p>{0}</p></aside>', '<div role="search form">{0}</div>', '<div class=adBanner>{0}</div>', '<div aria-hidden=true>{0}</div>', "<footer>{0}</footer>",
])
def test_what_is_not_the_article(noise):
    some = noise.format("Buy now, pay later.")
    for body in (f"<article><p>{ONE}</p><p>{TWO}</p>{some}</article>", f"<article><p>{ONE}</p><p>{TWO}</p></article>{some}", f"{some}<div class=content><p>{ONE}</p>{some}<p>{TWO}</p></div>"):
        assert main_text(f"<html><body>{body}</body></html>") == TEXT


class Walk(HTMLParser):
    """The blocks of the element with data-take, but for elements with data-leave."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.take, self.leave, self.out, self.part = [], 0, 0, [], []

    def flush(self):
        text = " ".join("".join(self.part).split())
        self.part = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        names = dict(attrs)
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.part.append(" ")
            return
        self.open.append((tag, "data-take" in names, "data-leave" in names))
        self.take += "data-take" in names
        self.leave += "data-leave" in names

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        _, take, leave = self.open.pop()
        self.take -= take
        self.leave -= leave

    def handle_data(self, data):
        if self.take and not self.leave:
            self.part.append(data)


def random_page(r: random.Random) -> str:
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvxyz") for _ in range(r.randint(2, 9)))
    extra = lambda: r.choice(["", "", ' title="hidden comments"', " data-ad='nav menu'", ' class="has-sidebar"', ' data-id="footer"', ' lang=en class="lead wide"', ' id="p12"'])

    def inline(n):
        out = []
        for _ in range(n):
            w = word() + r.choice(["", "", "", ",", ".", " &amp;", "&nbsp;", "<br>"])
            out.append(r.choice([w, w, w, f"<b>{w}</b>", f'<a href="/hidden/ad">{w}</a>' if r.random() < 0.2 else w, f"<em{extra()}>{w}</em>"]))
        return r.choice([" ", "\n ", "\t"]).join(out)

    def noise():
        few = " ".join(word() for _ in range(r.randint(1, 5)))
        tag, names = r.choice([("nav", ""), ("aside", ""), ("footer", ""), ("div", ' class="ad"'), ("div", ' class="cookie-notice"'), ("section", ' id="comments"'), ("div", ' class="share-buttons sharing"'), ("form", ""), ("ul", ' role="menu"'), ("div", " hidden"), ("div", " class='sidebarLeft'")])
        return f"<{tag}{names} data-leave>{few}</{tag}>"

    def block(depth):
        k = r.random()
        if k < 0.1:
            return noise()
        if k < 0.55 or depth > 3:
            return f"<p{extra()}>{inline(r.randint(6, 40))}</p>"
        if k < 0.65:
            return f"<h{r.randint(2, 5)}{extra()}>{inline(3)}</h3>".replace("</h3>", "") and (lambda t: f"<{t}>{inline(3)}</{t}>")(r.choice(["h2", "h3"]))
        if k < 0.75:
            return f"<ul{extra()}>" + "".join(f"<li>{inline(r.randint(1, 8))}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if k < 0.85:
            return f"<blockquote><p>{inline(r.randint(5, 20))}</p></blockquote>"
        return f"<div{extra()}>" + "".join(block(depth + 1) for _ in range(r.randint(1, 4))) + "</div>"

    tag, names = r.choice([("article", ""), ("main", ""), ("div", ' class="entry-content"'), ("div", " id=content"), ("article", ' class="post comments-open"')])
    body = f"<h1>{inline(4)}</h1><p>{inline(40)}</p>" + "".join(block(0) for _ in range(r.randint(2, 9)))
    around = lambda: "".join(noise() for _ in range(r.randint(0, 3)))
    main = f"<{tag}{names} data-take>{body}</{tag}>"
    for _ in range(r.randint(0, 3)):
        main = f"<div{extra()}>{around()}{main}{around()}</div>"
    return f'<!doctype html><html><head><title>{word()}</title><style>p {{ color: red }}</style></head><body class="nav-open">{around()}{main}{around()}<script>var a = "<p>x</p>";</script></body></html>'


def test_random_pages_against_a_plain_walk():
    r = random.Random(11)
    for k in range(400):
        page = random_page(r)
        walk = Walk()
        walk.feed(page)
        walk.flush()
        assert main_text(page) == "\n\n".join(walk.out), f"page {k}: {page}"
