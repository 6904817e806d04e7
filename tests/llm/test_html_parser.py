"""The tree of a page against an independent parser, hand-written texts and pages that leave much open."""

import random
import time
from html.parser import HTMLParser

import pytest

from colloquy.llm import html_extract

VOID = {"br", "img", "hr", "input", "meta", "link"}
GONE = {"script", "style", "noscript", "template", "iframe", "select"}


class Reader(HTMLParser):
    """All visible text of a well-formed page, blocks apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.gone, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in GONE:
            self.gone += 1
        elif tag not in ("b", "i", "a", "span"):
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in GONE:
            self.gone -= 1
        elif tag not in ("b", "i", "a", "span"):
            self.text.append(" ")

    def handle_data(self, data):
        if not self.gone:
            self.text.append(data)


def plain(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return "".join(reader.text).split()


def whole(page):
    """Every text of the tree, nothing judged, as words."""
    words, stack = [], [html_extract.parse(page)]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            words.append(n)
        else:
            apart = n.tag not in html_extract._INLINE
            stack += [" "] * apart + n.parts[::-1] + [" "] * apart
    return "".join(words).split()


def made(rng, depth=0):
    """A random well-formed page."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        text = " ".join(rng.choice(["word", "it's", "a&amp;b", "&lt;x&gt;", "é", "\"q\"", "1 &gt; 0"]) for _ in range(rng.randint(1, 5)))
        if kind < 0.35 or depth > 4:
            inner = rng.choice([text, f"<b>{text}</b>", f"<a href='x?a=1&b=\"2\"' title=it's>{text}</a> {text}", f"{text}<br/>{text}", f"<span class=\"a'b > c\">{text}</span>"])
            out.append(f"<p class=\"x\">{inner}</p>")
        elif kind < 0.5:
            out.append(f"<{(tag := rng.choice(sorted(GONE)))} a=b>{'x = 1' if tag in ('script', 'style') else '<option>no' + ('</option>' if tag == 'select' else '')}</{tag}>")
        elif kind < 0.6:
            out.append(f"<!-- {text} --><ul><li>{text}</li><li>{text}</li></ul>")
        else:
            tag = rng.choice(["div", "section", "article", "aside", "td"])
            out.append(f"<{tag} id='a'>{made(rng, depth + 1)}</{tag}>")
    return "\n".join(out)


def test_tree_holds_what_another_parser_reads():
    rng = random.Random(8)
    for _ in range(300):
        page = "<html><body>" + made(rng) + "</body></html>"
        assert whole(page) == plain(page), page


@pytest.mark.parametrize("page,text", [
    ("<p title=it's>Hello I don't know</p><p>x</p>", "Hello I don't know x"),
    ('<p class="foo>Text</p>', "Text"),
    ("<p>a <select><option>x</p><p>b</p>", "a b"),
    ("<div><select><option>x<p>b</p></div>", "b"),
    ("<template><template>x</template>leak</template><p>y</p>", "y"),
    ("<div><noscript><p>no</div><p>yes</p>", "yes"),
    ("<div><iframe src=x></div><p>yes</p>", "yes"),
    ("<p>a <iframe>no</iframe> b</p>", "a b"),
    ("<p a = 'x > y' b=\"1 > 0\" c>t</p>", "t"),
    ("<p>1 < 2 and <b>3</b> > 2</p>", "1 < 2 and 3 > 2"),
    ("<ul><li>a<li>b</ul></p></b>c", "a b c"),
    ("<div></p>a</span></div></div></div>b", "a b"),
    ("<p", ""), ("<p>a<b", "a"), ("", ""),
])
def test_texts_by_hand(page, text):
    assert " ".join(whole(page)) == text


@pytest.mark.parametrize("page", [
    "<b>" * 100_000 + "<p>x" * 100_000, ("</q>" * 4 + "<b>" * 4 + "</i>" * 4) * 30_000, "<div><b>" * 60_000 + "</i></b>" * 60_000,
    "<select><option>x" * 60_000, "<b>" * 100_000 + "<x/>" * 100_000, "<p a='x" * 100_000, "<p a=\"" * 50_000 + "<p a='" * 50_000, "<p>a<div>" * 100_000, "<template>" * 100_000,
], ids=range(9))
def test_open_pages_are_read_in_linear_time(page):
    start = time.process_time()
    html_extract._measure(html_extract.parse(page))
    assert time.process_time() - start < 15
