"""HTML parsing: end tags left out, hidden inline elements, class words, linear time, and an independent parser."""

import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from tokentally.llm import op1_html as H

SF = "/root/testdata/sf0.001"


def text(page):
    return H.extract(page, None)[0]


@pytest.mark.parametrize("page,want", [
    ('<p class="ad">Ad<p>Real one<p>Real two', "Real one\nReal two"),
    ('<ul><li class="share">Share<li>Item one<li>Item two</ul>', "Item one\nItem two"),
    ('<ul><li class="share"><p>Share<ul><li>inner</ul><li>Item</ul>', "Item"),
    ('<table><tr><td class="ad">x<td>y<tr><td>z</table>', "y\nz"),
    ('<dl><dt>a<dd class="ad">b<dt>c<dd>d</dl>', "a\nc\nd"),
    ('<div class="ad"><p>x</div><p>y', "y"),
    ('<p>One <span hidden>x</span>two</p>', "One two"),
    ('<p>One <span class="advert">x <span>y</span> z</span>two</p>', "One two"),
    ('<p>One <span style="display:none">x</span>two <span hidden="false">three</span></p>', "One two three"),
    ('<p>One <span hidden>lost</p><p>two</p>', "One\ntwo"),
    ('<p>a <button>b<p>c</button> d</p>', "a d"),
    ('<p>a <select><option>b<option>c</select>d <audio>e</audio>f <canvas>g</canvas>h <video>i</video>j</p>', "a d f h j"),
    ('<div class="social-science">Kept</div><div class="search-algorithms">Also</div>', "Kept\nAlso"),
    ('<div class="no-sidebar">Kept</div><div class="comment-list">No</div><div id="ad-container-2">No</div>', "Kept"),
    ('<div class="related-posts">No</div><div class="post post-body">Yes</div><div role="contentinfo">No</div>', "Yes"),
    ('<div>a<b>b</b> <i>c</i></div></section></p>', "ab c"),
])
def test_cases(page, want):
    assert text(page) == want


class Plain(HTMLParser):
    """Blocks outside boilerplate by the library's parser, for pages whose tags are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.held, self.blocks, self.skip = [("", False, False)], [], [], 0

    def end_block(self):
        block = " ".join("".join(self.held).split())
        if block and not self.stack[-1][1]:
            self.blocks.append(block)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title"):
            self.skip += 1
            return
        if self.skip:
            return
        names = {k: v or "" for k, v in attrs}
        _, junk, owned = self.stack[-1]
        bad = (tag in H._JUNK_TAGS or (tag == "header" and not owned) or "hidden" in names
               or any(map(H._marked, f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}".lower().split())))
        if tag == "br":
            self.held.append(" ")
        if tag in H._BLOCKS:
            self.end_block()
        if tag not in H._VOID:
            inside = owned or (tag in ("article", "main") and not junk and not bad)
            self.stack.append((tag, junk or (bad and tag not in ("html", "body")), inside))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title"):
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in H._BLOCKS:
            self.end_block()
        if any(t == tag for t, *_ in self.stack[1:]):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def test_blocks_equal_an_independent_parser(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect() if r["html"]]
    same = 0
    for page in pages:
        p = Plain()
        p.feed(page)
        p.close()
        p.end_block()
        same += p.blocks == [b for _, b in H.parse(page)[1]]
    assert same == len(pages) > 20


@pytest.mark.parametrize("page", ["<a " * 700_000, "<div>" * 100_000, "<div>" * 8000 + "</section>" * 8000, '<a "' * 100_000,
                                  "<!" * 200_000, "<!--" * 200_000, "<span hidden>" * 20_000 + "<p>" * 20_000, "<div>a" * 20_000,
                                  "<p><button>" + "<span hidden>" * 20_000 + "<li><p>" * 20_000])
def test_broken_markup_takes_linear_time(page):
    start = time.process_time()
    H.extract(page, None)
    assert time.process_time() - start < 5


def test_deep_pages_take_linear_memory():
    peaks = []
    for n in (4000, 8000):
        tracemalloc.start()
        H.extract("<div class=a>x" * n, None)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2.5 * peaks[0] and peaks[1] < 24 << 20


def test_paths_of_deep_containers_differ():
    nodes, _ = H.parse("<div class=a>" + "<div>" * 300 + "x" + "</div>" * 301 + "<div class=b>" + "<div>" * 300 + "x")
    deep = [n.path for n in nodes if n.score]
    assert len(set(deep)) == len(deep) and max(map(len, deep)) <= H.PATH_CHARS + 20
