"""Sections of nested pages against a tree of the page."""

import random
from html.parser import HTMLParser

from quern.operators import pages


class Tree(HTMLParser):
    """Texts outside of boxes, by a tree: each element has its children and its parent."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.root = self.now = {"box": False, "kids": [], "up": None}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        said = " ".join(filter(None, (held.get("class"), held.get("id"))))
        box = tag in pages.BOXES or tag == "div" and any(w in said for w in ("footer", "sidebar", "menu", "cookie", "banner", "navigation", "breadcrumb"))
        self.now["kids"].append(new := {"box": box, "kids": [], "up": self.now})
        self.now = new

    def handle_endtag(self, tag):
        self.now = self.now["up"]

    def handle_data(self, data):
        self.now["kids"].append(data)

    def text(self, node=None) -> str:
        node = node or self.root
        return "" if node["box"] else "".join(k if isinstance(k, str) else self.text(k) for k in node["kids"])


def nested(rng, depth=0) -> str:
    out = ""
    for _ in range(rng.randint(0, 4)):
        tag = rng.choice(["div", "div", "p", "nav", "footer", "aside", "section"])
        extra = rng.choice(["", "", ' class="main"', ' id="side-menu"', " class='x sidebar'"]) if tag == "div" else ""
        out += f"t{rng.randint(0, 99)} <{tag}{extra}>" + (nested(rng, depth + 1) if depth < 5 else "") + f"</{tag}>"
    return out + f" e{rng.randint(0, 99)} "


def test_boxes_are_balanced():
    import re

    rng = random.Random(1)
    for _ in range(400):
        html = nested(rng)
        assert re.sub("<[^>]*>", "", pages.content(html)).split() == Tree(html).text().split()


def test_sections(spark):
    html = "<header>top</header>before &amp; <nav><div><nav>x</nav><h2>none</h2></div></nav><h1>One <b>two</b></h1>body<div class='sidebar'>a<div>b</div>c</div> on <script>'<nav>'</script><!-- <nav> --><H3>Three</H3><aside>never closed"
    rows = [(1, html), (2, None), (3, ""), (4, "plain text"), (5, "</div><nav>a</nav></nav>b<h2></h2>")]
    got = [tuple(r) for r in pages.sections(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id", "pos").collect()]
    assert got == [(1, 0, 0, "", "before &"), (1, 1, 1, "One two", "body on -->"), (1, 2, 3, "Three", "never closed"), (4, 0, 0, "", "plain text"), (5, 0, 0, "", "b"), (5, 1, 2, "", "")]
