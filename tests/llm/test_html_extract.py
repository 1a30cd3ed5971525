import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from linkweave.llm import html_extract as he
from linkweave.llm.html_extract import extract, main_lines, smoothed

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/x>News and more news</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy this now, it is long enough to look like text.</div>
<article><h1>A title &amp; more</h1><p>First  paragraph with <b>bold</b> and <a href=/y>a link</a> in it,<br>going on.
<p>Short.</p><form><input name=q><button>Go</button></form><blockquote>A quote&nbsp;here &lt;3</blockquote><ul><li>one<li>two</ul>
<aside>Related: something else entirely</aside><section class="comments"><p>I am a reader and I say so.</p></section></article>
<footer>&copy; 2020 Somebody with a long line of text at the end of the page.</footer></body></html>"""


def test_article():
    want = ["A title & more", "First paragraph with bold and a link in it, going on.", "Short.", "A quote here <3", "one", "two"]
    assert main_lines(PAGE) == want


def test_page_without_article():
    page = PAGE.replace("<article>", "<div id=content>").replace("</article>", "</div>")
    assert main_lines(page) == main_lines(PAGE)


def test_odd_pages():
    assert main_lines(None) == main_lines("") == main_lines("<nav>menu</nav>") == main_lines("<script>x</script>") == []
    assert main_lines("plain &eacute; text") == ["plain é text"]
    assert main_lines("<article><p>cut off in the mid") == ["cut off in the mid"]
    assert main_lines("<div class=ad>open<article><p>Some words of text</p></article>") == ["Some words of text"]
    assert main_lines("<p>a<p>a<p>a") == ["a", "a", "a"]
    assert len(main_lines("<article>" + "<p>many words stand here</p>" * 20_000)) == 20_000


LONG = [f"<p>Paragraph {i} of the article goes on for a good while, with many plain words and nothing else in it.</p>" for i in range(4)]
ARTICLE = "".join(LONG)
WANT = [p[3:-4] for p in LONG]
MENU = "<nav><a href=/>Home</a> <a href=/n>News</a></nav>"
LAYOUTS = [
    f"{MENU}<div id='page-no-sidebar'>{ARTICLE}</div><div class=footer>Made by us.</div>",
    f"{MENU}<div class='entry share-enabled'>{ARTICLE}</div><div class=share><a href=/s>Share</a></div>",
    f"{MENU}<article class='post comments-open'>{ARTICLE}</article><div id=comments>{ARTICLE}</div>",
    f"{MENU}<div class='has-sidebar'><div>{ARTICLE}</div><div class=sidebar>A few teasers here, of no use.</div></div>",
    f"{MENU}<div class='content-sidebar-wrap'><main>{ARTICLE}</main><aside>{ARTICLE}</aside></div>",
    f"<table><tr><td class=menu><a href=/>Home</a></td><td>{ARTICLE}</td><td class=ads>Buy this, it is good.</td></tr></table>",
    f"<div class=page><div class='ad-slot'>Buy this.</div><div class='social'>{ARTICLE}</div></div>",
    f"<section><h2></h2>{ARTICLE}</section><ol class='comment-list'><li class=comment><article class='comment-body'>{ARTICLE}</article></li></ol>",
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_names_do_not_decide_alone(page):
    assert main_lines(page) == WANT


def test_malformed_markup():
    assert main_lines("<![foo[bar]]>text") == ["text"] and main_lines("<p>a</p><![ [x") == ["a", "<![ [x"]
    assert main_lines("<![CDATA[x]]>y") == ["y"] and main_lines("<p>a</p><!-- never ends <p>b</p>") == ["a", "b"]
    assert main_lines(f"<!-- x --!><p>a</p><!-- {MENU} --><p>b</p>") == ["b"]  # up to the next that ends as it should
    for page in ("<!", "<!foo", "<?x", "</", '<a b="', "<!-", "<!--", "&#", "&#xFFFFFFFF;", "<![if !IE]>", "<!DOCTYPE [<!ENTITY x 'y'>]>"):
        main_lines(page)


@pytest.mark.parametrize("unit", ["<div>x", "<b>x", "<div class=ad>x", "<b><p>x</p>", "<div>x</section>", "<!--", "<a ", "</", "<![", "<i><div><b></i>"])
def test_time_grows_with_length(unit):
    def seconds(length):
        start = time.process_time()
        main_lines(unit * (length // len(unit)) + ">")
        return time.process_time() - start

    assert seconds(160_000) < 12 * min(seconds(20_000) for _ in range(3)) + 1  # eight times the length; squared, it would be 64


class Paths(HTMLParser):
    """The same lines, each with the list of all its open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.seen = [], [], False
        self.next()

    def next(self):
        self.lines.append({"open": list(self.open), "text": "", "tags": 0, "linked": 0})

    def cut(self, at):
        self.open = self.open[:at]

    def handle_starttag(self, tag, attrs):
        if tag in he.VOID:
            self.lines[-1]["tags"] += 1
            if tag in he.INLINE:
                self.lines[-1]["text"] += " " if tag == "br" else ""
            else:
                self.next()
            return
        blocks = [i for i, e in enumerate(self.open) if e["tag"] not in he.INLINE]
        if tag not in he.INLINE and blocks and (self.open[blocks[-1]]["tag"] == "p" or tag == "li" == self.open[blocks[-1]]["tag"]):
            self.cut(blocks[-1])
        if tag in ("body", "article", "main") and not self.seen:
            self.cut(next((i for i, e in enumerate(self.open) if e["kind"]), len(self.open)))
            self.seen = tag != "body"
        names, kind = [set(he.NAME_PARTS.split(n)) for n in (dict(attrs).get("class") or "").lower().split()], ""
        if tag in he.OTHER_TAGS or tag == "header" and not any(e["tag"] in he.REGION_TAGS for e in self.open):
            kind = "other"
        elif tag not in ("html", "body", "main"):
            signs = [n for n in names if n & (he.COMMENT_NAMES if tag == "article" else he.OTHER_NAMES)]
            kind = "" if not signs else "state" if all(n & he.STATE_NAMES for n in signs) else "named"
        comments = kind in ("state", "named") and any(n & he.COMMENT_NAMES for n in names)
        self.open.append({"tag": tag, "kind": kind, "comments": comments, "holds": False})
        if tag in he.REGION_TAGS and not comments:
            for e in self.open:
                e["holds"] = True
        if tag not in he.INLINE or kind:
            self.next()
        self.lines[-1]["tags"] += 1

    def handle_endtag(self, tag):
        at = max((i for i, e in enumerate(self.open) if e["tag"] == tag), default=None)
        if at is None:
            return
        above = [e["tag"] for e in self.open[at + 1 :]]
        if tag in he.INLINE and any(t not in he.INLINE for t in above) or tag == "p" and set(above) & set(he.ENDS_PARAGRAPH):
            return
        block = tag not in he.INLINE or any(e["kind"] for e in self.open[at:])
        self.cut(at)
        if block:
            self.next()

    def handle_data(self, data):
        self.lines[-1]["text"] += data
        self.lines[-1]["linked"] += len(data) * any(e["tag"] == "a" for e in self.open)


def literal(html):
    parser = Paths()
    parser.feed(html)
    parser.close()
    lines = [x | {"text": t} for x in parser.lines if (t := " ".join(x["text"].split()))]
    if not lines:
        return []
    ratio = [max(0, len(x["text"]) - x["linked"]) / max(1, x["tags"]) for x in lines]
    weight = lambda i, j: float(np.exp(-((i - j) ** 2) / 2)) if abs(i - j) <= 2 else 0.0
    smooth = [sum(weight(i, j) * ratio[j] for j in range(len(lines))) / sum(weight(i, j) for j in range(len(lines))) for i in range(len(lines))]

    def marked(own):
        best = min(float(np.std(smooth)), max((smooth[i] for i in own), default=0.0))
        sure = [i for i in own if smooth[i] >= best - 1e-9 and ratio[i] > 0]
        return sure or [i for i in own if ratio[i] > 0] or own

    within = lambda e, i: any(e is x for x in lines[i]["open"])
    size = lambda chosen: sum(len(lines[i]["text"]) for i in chosen)
    own = [i for i, x in enumerate(lines) if not any(e["kind"] == "other" for e in x["open"])]
    first = marked(own)
    free = size(i for i in first if not any(e["kind"] for e in lines[i]["open"]))

    def gone(e):
        if e["kind"] not in ("named", "state"):
            return False
        held = [i for i in first if within(e, i)]
        most = len(held) >= 2 and size(held) >= he.NAMED_SHARE * (free + size(held))
        return not held or e["kind"] == "named" and (e["comments"] or not (e["holds"] or most))

    own = [i for i in own if not any(gone(e) for e in lines[i]["open"])]
    chosen = marked(own)
    outer = lambda i: next((e for e in lines[i]["open"] if e["tag"] in he.REGION_TAGS), None)
    regions = [outer(i) for i in chosen if outer(i)]
    if regions:
        return [lines[i]["text"] for i in own if any(outer(i) is e for e in regions)]
    containers = [e for i in chosen for e in lines[i]["open"] if e["tag"] not in he.INLINE and e["tag"] != "p"]
    enough = [e for e in containers if size(i for i in chosen if within(e, i)) >= he.REGION_SHARE * size(chosen)]
    deepest = max(enough, key=lambda e: max(next(d for d, y in enumerate(x["open"]) if y is e) for x in lines if any(y is e for y in x["open"])), default=None)
    return [lines[i]["text"] for i in own if deepest is None or within(deepest, i)]


def test_second_implementation():
    chosen = random.Random(5)
    classes = ["", "", "", " class=sidebar", " class='comment-list'", " class='no-sidebar'", " class='comments-open'", " class='related x'", " class=entry"]
    several = 0
    for _ in range(1500):
        page = "".join(
            chosen.choice([
                lambda: f"<{chosen.choice(['div', 'section', 'p', 'li', 'ul', 'b', 'a', 'header', 'footer', 'article', 'main', 'span', 'h1'])}{chosen.choice(classes)}>",
                lambda: f"</{chosen.choice(['div', 'div', 'section', 'p', 'ul', 'b', 'a', 'article', 'header', 'footer', 'span'])}>",
                lambda: f"w{chosen.randrange(99)} " * chosen.choice([1, 2, 30]),
                lambda: chosen.choice(["<br>", "<hr>", "<img>", "&amp;"]),
            ])()
            for _ in range(chosen.randrange(1, 40))
        ) + "<hr>"
        assert main_lines(page) == literal(page), page
        several += len(main_lines(page)) > 1
    assert several > 500


def test_smoothing_keeps_a_level():
    assert np.allclose(smoothed(np.full(9, 3.0)), 3.0) and np.allclose(smoothed(np.array([2.0])), 2.0)


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "", "")]
    pages = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, main_text string")
    found = extract(pages).collect()
    assert [r["page_id"] for r in found] == [1, 1, None, 2] and extract(pages).columns == ["page_id", "url", "main_text"]
    assert found[0]["main_text"] == found[1]["main_text"] == "\n".join(main_lines(PAGE)) and found[2]["main_text"] == found[3]["main_text"] == ""
    assert extract(pages.limit(0)).count() == 0
