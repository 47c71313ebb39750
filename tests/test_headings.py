"""Headings and their links against a plain tree of the page."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlparse

import pytest

from marquee.functions import dates, headings


class _Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.root = self.top = {"name": "", "up": None, "children": [], "href": None, "text": [], "at": -1}
        self.count = 0
        self.feed(re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", html))

    def handle_starttag(self, tag, attrs):
        node = {"name": tag, "up": self.top, "children": [], "href": dict(attrs).get("href") if tag == "a" else None, "text": [], "at": self.count}
        self.count += 1
        self.top["children"].append(node)
        self.top["text"].append(node)
        if tag not in headings.VOID:
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.count += 1
        node = self.top
        while node["up"] is not None and node["name"] != tag:
            node = node["up"]
        if node["up"] is not None:
            self.top = node["up"]

    def handle_data(self, data):
        self.top["text"].append(data)


def _link(node):
    return node["href"] or next((h for c in node["children"] if (h := _link(c))), None)


def _text(node):
    return re.sub(r"\s+", " ", " ".join(t if isinstance(t, str) else _text(t) for t in node["text"])).strip()


def _plain(html):
    found = []

    def walk(node, chrome):
        chrome = chrome or node["name"] in headings.CHROME
        if node["name"] in headings.HEADS and not chrome and not re.fullmatch(dates.MONTH_YEAR, _text(node), re.I):
            href, orphan = _link(node), False
            if not href:
                orphan, siblings = True, node["up"]["children"]
                k = next(i for i, c in enumerate(siblings) if c is node)
                for side in (siblings[:k][::-1], siblings[k + 1 :]):
                    for s in side[: headings.HOPS]:
                        if s["name"] in headings.HEADS:
                            break
                        if href := _link(s):
                            break
                    if href:
                        break
            if href:
                found.append((node["at"], _text(node), href, orphan))
        for c in node["children"]:
            walk(c, chrome)

    walk(_Tree(html).root, False)
    return sorted(found)


def _voted(found):
    if len(found) < 3:
        return []
    segments = [next((p for p in urlparse(f[2]).path.split("/") if p), None) for f in found]
    counts = Counter(s for s in segments if s)
    top, n = counts.most_common(1)[0] if counts else (None, 0)
    if top and n >= max(3, len(found) * 0.5):
        return [f for f, s in zip(found, segments, strict=True) if s == top]
    orphans = [f for f in found if f[3]]
    return orphans if len(orphans) >= 3 else []


def _page(draw):
    """Cards of linked and plain headings, posters, buttons, navigation, and tags that are never closed."""
    def bit(depth):
        kind = draw.randrange(13)
        href = draw.choice(["/event/a", "/event/b?x=1", "https://v.example.com/event/c", "/slug", "/about/us", "#top"])
        a = f'<a class="x" href="{href}">' + draw.choice(["<img src='p.png'>", "TICKETS", ""]) + "</a>"
        head = f"h{draw.randint(1, 5)}"
        if kind < 3:
            return f"<{head}>{draw.choice(['Show', 'June 2026', 'A <b>bold</b> one'])}</{head}>"
        if kind < 5:
            return f"<{head} id='t'>{draw.choice(['', '<span>'])}{a} Night</{head}>"
        if kind < 7:
            return a
        if kind == 7:
            return draw.choice(["<br>", "<p>loose ", "</i>", "text > text", "<!-- <h2>no</h2> -->", "<script>'<h2><a href=\"/event/z\">'</script>", "<img src=x/>"])
        name = draw.choice(["div", "section", "li", "nav", "header", "footer", "span"]) if kind > 8 else "div"
        if depth > 3:
            return "<hr>"
        inner = "".join(bit(depth + 1) for _ in range(draw.randint(0, 5)))
        return f"<{name}>{inner}" + (f"</{name}>" if draw.random() < 0.9 else "")

    return "".join(bit(0) for _ in range(draw.randint(1, 9)))


@pytest.mark.parametrize("seed", range(3))
def test_headings_equal_a_plain_tree(spark, seed):
    draw = random.Random(seed)
    pages = [(i, _page(draw)) for i in range(150)]
    df = spark.createDataFrame([*pages, (900, None), (901, ""), (902, "no tags")], "page_id long, html string")
    got = {r["page_id"]: [tuple(h) for h in r["h"]] for r in df.select("page_id", headings.headings(df.html).alias("h")).collect()}
    want = {i: _plain(html) for i, html in pages}
    for i, html in pages:
        assert got[i] == want[i], html
    assert got[900] == got[901] == got[902] == [] and sum(f[3] for w in want.values() for f in w) > 30
    voted = {}
    for r in headings.event_headings(df).collect():
        voted.setdefault(r["page_id"], []).append((r["at"], r["title"], r["href"], r["orphan"]))
    assert {i: sorted(v) for i, v in voted.items()} == {i: v for i, w in want.items() if (v := _voted(w))} and voted


def test_a_flat_site_of_posters_and_plain_headings(spark):
    card = lambda i: f'<div><a href="/slug{i}"><img src="p"></a><h2>Act {i}</h2><a href="/tickets/{i}">Tickets</a></div>'
    html = "<nav><h2>Menu</h2><a href='/m'>m</a></nav>" + "".join(card(i) for i in range(4)) + "<footer><h3><a href='/event/x'>f</a></h3></footer>"
    out = headings.event_headings(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("at").collect()
    assert [(r["title"], r["href"], r["orphan"]) for r in out] == [(f"Act {i}", f"/slug{i}", True) for i in range(4)]


def test_long_pages_and_tags(spark):
    """40,000 tags, and a tag of 50,000 characters: a fold of interpreted DataFrame functions took half a millisecond a tag, and a tag's
    pattern in the JVM a stack frame a character."""
    html = "".join(f'<div><h3>Act {i}</h3><a href="/event/{i}">see</a></div>' for i in range(6000)) + f"<a data={'x' * 50_000} href='/event/last'><h2>Last</h2></a>" + "<br>" * 4000
    start = time.monotonic()
    out = headings.event_headings(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("at").collect()
    assert [(r["title"], r["href"]) for r in out[:2]] == [("Act 0", "/event/0"), ("Act 1", "/event/1")] and len(out) == 6000
    assert time.monotonic() - start < 15
