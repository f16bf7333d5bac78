"""Main text of the fixture's pages by another way: the article element under Python's own parser."""

from html.parser import HTMLParser

BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "div", "article", "footer", "nav", "body", "html"}


class Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.part = 0, [], ""

    def close_block(self):
        text = " ".join(self.part.split())
        if text and self.inside:
            self.blocks.append(text)
        self.part = ""

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.close_block()
        if tag == "br":
            self.part += " "
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.close_block()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.part += data


def main_text(html):
    a = Article()
    a.feed(html or "")
    a.close()
    a.close_block()
    return "\n\n".join(a.blocks)
