"""Tag-path ratios by another parser, what they decide, and broken pages."""

import random
import time
from html.parser import HTMLParser
from math import sqrt

import pytest

from sparkloom.llm import htmltext

SKIP = {"br", "b", "i", "a"}


class Paths(HTMLParser):
    """(path, text, characters in links) of every block of a page whose markup is well formed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text, self.linked = [], [], "", 0

    def close_block(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append(("/".join(x for x in self.stack if x not in SKIP), text, self.linked))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag not in SKIP:
            self.close_block()
        if tag != "br":
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag not in SKIP:
            self.close_block()
        self.stack.pop()

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) if "a" in self.stack else 0


def plain_scores(page):
    p = Paths()
    p.feed(page)
    paths = {}
    for path, text, linked in p.blocks:
        x = paths.setdefault(path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(text), sum(text.count(c) for c in ".,;:!?"), linked)):
            x[k] += v
    names, out = list(paths), []
    for k, name in enumerate(names):
        around = [names[j] for j in (k - 1, k, k + 1) if 0 <= j < len(names)] + [name] * htmltext.OWN
        chars, marks = (sum(sqrt(paths[a][i] / paths[a][0]) for a in around) / len(around) for i in (1, 2))
        parts = name.split("/")
        weight = (htmltext.MAIN_WEIGHT if {"article", "main"} & set(parts) else 1) * (htmltext.OTHER_WEIGHT if {"nav", "footer", "aside"} & set(parts) else 1)
        out.append(chars * (0.1 + marks) * weight * (1.05 - paths[name][3] / paths[name][1]))
    return out


def page_of(seed):
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["one", "two,", "three.", "four;", "five"]) for _ in range(n))
    part = lambda: "".join(f"<{t}>{words(r.randint(1, 60))}</{t}>" for t in r.choices(["p", "h2", "pre", "blockquote"], k=r.randint(1, 5)))
    hold = lambda: "".join(f"<{t}>{part()}</{t}>" for t in r.choices(["div", "section", "nav", "footer", "article", "aside"], k=4))
    return f"<html><body>{hold()}<div><p>{words(3)} <a>{words(2)}</a></p>{hold()}</div></body></html>"


@pytest.mark.parametrize("seed", range(30))
def test_ratios(seed):
    page = page_of(seed)
    blocks = htmltext.blocks_of(page)
    assert htmltext.scores(blocks)[0] == pytest.approx(plain_scores(page))


LONG = "A long sentence, of some words; it goes on. " * 30
SHORT = "Some words and a stop. " * 2


def test_threshold_decides():
    """Nothing here is declared: which container is the article is a matter of the ratios."""
    page = f"<body><div id=x1><p>{SHORT}</p></div><div id=x2><p>{LONG}</p><p>{LONG}</p></div><div id=x3>Links and things</div></body>"
    texts = [htmltext.main_text(page, x) for x in (0.001, 0.3)]
    assert texts[1] == f"{LONG.strip()}\n\n{LONG.strip()}" and texts[0].startswith(SHORT.strip()) and len(texts[0]) > len(texts[1])


def test_declared_parts():
    assert htmltext.main_text(f"<form><nav><a href=x>Home</a></nav><h1>T</h1><p>{LONG}</p></form>") == f"T\n\n{LONG.strip()}"
    assert htmltext.main_text(f"<body><div class='page-header'><h1>T</h1><p>{LONG}</p></div><div class=ad>Buy, now!</div></body>") == f"T\n\n{LONG.strip()}"
    assert htmltext.main_text("<body><div><p>Some text <span class='ad'>Buy!</span> here, and more.</p></div></body>") == "Some text here, and more."
    assert htmltext.main_text(f"<body><div><h1>T</h1><p>{LONG}</p><div class=comments><p>{LONG}</p></div></div></body>") == f"T\n\n{LONG.strip()}"
    assert htmltext.main_text("a < b and 3<4") == "a < b and 3<4"
    assert htmltext.main_text("<p title='a>b'>x</p><p title='>y</p>") == "x\n\ny"


def test_ordinary_names():
    """Sections of an article keep their ids, whatever words are in them; names of other things are still told."""
    parts = "".join(f"<section id='{x}'><h2>{x}</h2><p>{SHORT}</p></section>" for x in ("side-effects", "related-work", "search-methods", "share-price", "menu-costs", "reply-brief", "ad-hoc", "header-files"))
    text = htmltext.main_text(f"<body><nav>Home</nav><article><h1>T</h1><p>{LONG}</p>{parts}<div class='ad-slot top'>Buy!</div><div class='related posts'>More</div><div id='comment-list'>Me!</div></article></body>")
    assert text.count(SHORT.strip()) == 8 and text.startswith("T\n\n") and not any(x in text for x in ("Buy", "More", "Me!", "Home"))
    for name in ("ad", "site-header", "social-share", "cookie-banner", "page_footer", "nav2", "main-nav", "user-comments", "js-newsletter-form"):
        assert htmltext.declared_words(name)
    for name in ("adhoc", "leadership", "side-effects", "navier-stokes", "commentary", "", "w-1/2"):
        assert not htmltext.declared_words(name)


def test_slashes():
    """A slash at the end of a start tag closes only svg and math; behind a bare value it is part of it."""
    assert htmltext.main_text(f"<body><p>{LONG}</p><script src='a.js'/>var leaked = 1;</script><p>{LONG}</p></body>") == f"{LONG.strip()}\n\n{LONG.strip()}"
    assert htmltext.main_text(f"<body><div><p>{LONG}</p><div class='ad'/>BUY NOW</div><div class=ad/>BUY NOW</div></div></body>") == LONG.strip()
    assert htmltext.main_text(f"<body><p>{LONG}</p><svg width='1'/><p>Behind. It is, here.</p></body>").endswith("Behind. It is, here.")
    assert htmltext.main_text("<p>a <br/>b<hr/>c <math><mi/>x</math> d</p>") == "a b\n\nc x d"


def test_wrappers():
    """What holds nearly all of the text isn't a header, whatever it is called; comments need a heading for that."""
    inner = f"<p>{LONG}</p><p>{LONG}</p>"
    assert htmltext.main_text(f"<body><p>One line. Of text.</p><div class='page-header'>{inner}</div></body>").endswith(f"{LONG.strip()}\n\n{LONG.strip()}")
    assert htmltext.main_text(f"<body><div><p>{LONG}</p><div class='comments'>{inner}</div></div></body>") == LONG.strip()


def test_ratios_decide():
    """Without names, only the ratios tell the article from lines around it."""
    page = f"<body><div><div>Home, about, contact.</div><div>Of this page, more.</div></div><div><p>{LONG}</p><p>{LONG}</p></div><div><div>All rights, reserved.</div></div></body>"
    assert htmltext.main_text(page) == f"{LONG.strip()}\n\n{LONG.strip()}"
    assert htmltext.main_text(page, 0.0) != htmltext.main_text(page)


def test_time_grows_with_length():
    for page in ("<script " * 20_000, "<a " * 50_000, "<a>" * 50_000 + "</b>" * 50_000 + "x", "<a href='x>\"y " * 20_000, "<!-- " * 50_000, "<p>x" * 50_000, "<div>" * 20_000 + "x"):
        began = time.process_time()
        htmltext.main_text(page)
        assert time.process_time() - began < 5
