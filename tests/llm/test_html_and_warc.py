import base64
import hashlib
import json
import re
import time
from html import unescape
from html.parser import HTMLParser

import pytest
from pyspark.sql import Row

from twinframe.llm import html_extract as h
from twinframe.llm import warc as w

PROSE = ["The first paragraph, which has commas, and goes on for a while so that it earns points.", "Short.", "Another paragraph follows here, again with a comma, and with a <a href='/x'>link</a> in it, as articles have."]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
TEXT = "\n".join(re.sub("<[^>]*>", "", p) for p in PROSE)
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article>{BODY}</article><footer>&copy; 2020, all rights, reserved, here.</footer></body></html>",
        f"<div id='page' class='layout'><div class='sidebar'>{MENU}<p>Sidebar text, of some length, with commas, which is not the article.</p></div><div class='post-content'>{BODY}</div><div id='comments'><p>A reader's comment, long, with commas, more commas, and more text, which must go away.</p></div></div>",
        f"<body><div class='cookie-notice'>We use cookies, as you know, to make this site, and others, work.</div><header><h1>Site, name, of, commas, and more text here</h1></header><main>{BODY}<aside>An aside, with text, and commas, that goes.</aside></main><form><p>Your, mail, address, here, please, now, and so on.</p></form></body>",
        f"<body><table><tr><td>{MENU}</td><td>{BODY}</td></tr></table><div class='ad'>Buy, now, this, thing, that, is, good, for you, today.</div></body>",
        f"<BODY><DIV>{BODY.replace('</p>', '')}</DIV><SCRIPT>var x = '<p>no, no, no, no, no, no, no</p>';</SCRIPT><!-- <p>no</p> --></BODY>",
        f"<body><div style='display:none'><p>Hidden, text, that, nobody, sees, at all, in the page.</p></div><section>{BODY}</section><section class='related-posts'>{MENU}</section></body>",
        f"<body><div>{MENU}</div><div>{BODY}</div><div>{MENU}</div></body>",
        f"<article>{BODY}{MENU}</article><section id='comments'><article><p>First reader, says, a lot, of things, with commas, and goes on and on, for long.</p></article></section>",
    ],
)
def test_the_article_and_nothing_else(page):
    assert h.main_text(page) == TEXT


def test_blocks_and_references():
    assert h.main_text("<article><h1>A &amp; B</h1><p>x<b>y</b>\n\t z &#233;<br>w</p>tail</article>") == "A & B\nxy z é w\ntail"
    assert h.main_text(None) == h.main_text("") == h.main_text("<p> </p><script>x</script>") == ""
    assert h.main_text("plain\n text &lt;") == "plain text <"
    assert h.main_text("<div class='comments'><p>only, this, is, here, in the whole page, so it stays.</p></div>").startswith("only")
    for broken in ("<", "<p", "<p>a<", "</p></div>x", "<a href=\"x>y</a>", "<script>never closed", "<!-- open", "<p>a<table><tr><td>b<p>c", "<div>" * 5000 + "deep" + "</div>" * 4000, "İ<script>x</script>y"):
        h.main_text(broken)
    assert h.main_text("<div>" * 5000 + "deep") == "deep"


def expected(page):
    """The given pages' articles, read from their fixed layout."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", article)
    return "\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks) if t)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in h.digest(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == expected(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_tables(spark):
    rows = [Row(page_id=1, url=None, html=None, text="mine"), Row(page_id=None, url="u", html=f"<article>{BODY}</article>", text="x"), Row(page_id=None, url="u", html=f"<article>{BODY}</article>", text="x"), Row(page_id=3, url="v", html="<article>" + "<p>Many words, again.</p>" * 20000 + "</article>", text="y")]
    pages = spark.createDataFrame(rows)
    got = h.digest(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, len(TEXT)), (0, len(TEXT)), (1, 0), (3, 20000 * 18 + 19999)]
    assert h.digest(pages.limit(0)).count() == 0
    out = h.extract(pages)
    assert out.columns == ["page_id", "url", "html", "text", "__tf_text"] and {r.text for r in out.collect()} == {"mine", "x", "y"}
    assert w.digest(pages).count() == 8 and w.digest(pages.limit(0)).count() == 0


def test_derivatives(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    rows = w.digest(pages).collect()
    assert len(rows) == 2 * len(source) and len({r.record_id for r in rows}) == len(rows)
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    pairs = {}
    for r in rows:
        page = source[r.page_id]
        headers = json.loads(r.source_headers)
        assert r.refers_to == headers["WARC-Record-ID"] and r.target_uri == page.url == headers["WARC-Target-URI"]
        assert r.source_payload_digest == sha1(page.html.encode()) and r.block_digest == sha1(r.block.encode()) and r.content_length == len(r.block.encode())
        pairs.setdefault(r.page_id, {})[r.record_type] = r
    for page_id, both in pairs.items():
        about = json.loads(both["metadata"].block)["Envelope"]
        assert both["metadata"].concurrent_to == both["conversion"].record_id and both["conversion"].concurrent_to == both["metadata"].record_id
        assert about["WARC-Header-Metadata"] == json.loads(both["conversion"].source_headers)
        links = about["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"]
        assert [x["url"] for x in links] == re.findall(r'<a href="([^"]*)"', source[page_id].html)
        assert set(h.main_text(source[page_id].html).split("\n")) <= set(both["conversion"].block.split("\n"))


def test_round_trip_through_files(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>Text {i} é</p>".encode()) for i in range(5)]
    data = b""
    for i, url, payload in rows:
        block = w.http_block(payload)
        data += w.record_bytes(w.response_headers(i, url, payload, block), block)
    data += w.record_bytes({"WARC-Type": "warcinfo", "Content-Length": "3"}, b"a:b")
    (tmp_path / "a.warc.gz").write_bytes(data)
    records = w.read_records(spark, str(tmp_path))
    assert records.count() == 6
    derived = w.write_records(w.record_derivatives(records)).collect()
    assert len(derived) == 10
    for r in derived:
        (headers, block), = w.parse_records(r.record)
        assert block.decode() == r.block and headers["WARC-Refers-To"] == r.refers_to == r.source_id and headers["WARC-Block-Digest"] == r.block_digest
    assert w.split_http(b"no http") == ("", [], b"no http")


def test_an_articles_own_link_list_stays():
    items = "<ul>" + "".join(f'<li><a href="/{k}">Reference number {k}</a></li>' for k in range(5)) + "</ul>"
    listed = "\n".join(f"Reference number {k}" for k in range(5))
    for tag in ("article", "main"):
        got = h.main_text(f"<body><{tag}><header>{items}</header>{BODY}{items}<p>More, after that.</p><h2>References</h2>{items}<nav>{items}</nav></{tag}></body>")
        assert got == f"{TEXT}\n{listed}\nMore, after that.\nReferences\n{listed}"
    assert listed not in h.main_text(f"<body><div>{BODY}{items}</div></body>")


PAGES = "/root/testdata/sf0.001/pages.parquet"


class Plain(HTMLParser):
    """The blocks of a well-formed page, in a plainer way: text between any two block tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.hidden = [], "", []

    def flush(self):
        if got := " ".join(self.text.split()):
            self.blocks.append(got)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in h.BLOCKS:
            self.flush()
        if self.hidden:
            self.hidden += [tag] * (tag == self.hidden[0])
        elif tag in h.RAW | {"head", "template"} or tag in h.BLOCKS and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (attrs.get("style") or "").lower())):
            self.hidden = [tag]
        elif tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        if tag in h.BLOCKS:
            self.flush()
        if self.hidden and tag == self.hidden[0]:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.text += data


def test_visible_text_like_a_plain_parser(spark):
    for row in spark.read.parquet(PAGES).collect():
        plain = Plain()
        plain.feed(row.html or "")
        plain.close()
        plain.flush()
        assert h.visible_text(h.parse(row.html or "")) == "\n".join(plain.blocks), row.page_id


def test_scores_like_their_definition(spark):
    for row in spark.read.parquet(PAGES).limit(25).collect():
        nodes = h.parse(row.html or "").nodes
        blocks = h._blocks(nodes, 0, h._dropped(nodes, True))
        chain = lambda i: [i, *chain(nodes[i].parent)] if i >= 0 else []
        scores, size, linked, _ = h._scores(nodes, blocks)
        for i in range(len(nodes)):
            below = [(n, t, k) for n, t, k in blocks if i in chain(n)]
            points = 0.0
            for n, t, _ in below:
                level = chain(n if nodes[n].tag in ("html", "body", "div", "section", "article", "main", "td") else nodes[n].parent)
                if len(t) >= 25 and i in level[:8]:
                    worth = 1 + sum(t.count(c) for c in ",，、") + min(len(t) // 100, 3)
                    points += worth * [1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15, 1 / 18, 1 / 21][level.index(i)]
            letters = sum(len(t) for _, t, _ in below)
            assert size[i] == letters and linked[i] == sum(k for *_, k in below)
            assert abs(scores[i] - (points * (1 - linked[i] / letters) if letters else 0)) < 1e-9


def test_time_grows_with_the_page():
    n = 30_000
    pages = ["<div>" * n + "<li>" * n, "<div>" * n + "</p>" * n, "<div>" * n + "<p>x</section>" * n, "<head>" * n + "<body>" * n, "<table>" + "<tr><td>" * n, "<dl>" * n + "<dt>a<dd>b" * n, "<article>" + (BODY + MENU) * (n // 20) + "</article>"]
    began = time.process_time()
    for page in pages:
        h.main_text(page)
        h.visible_text(h.parse(page))
    assert time.process_time() - began < 60  # a walk of the stack for each tag would take hours


def test_closing_tags_end_what_they_should():
    text = lambda page: h.visible_text(h.parse(page))
    assert text("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert h.parse("<ul><li>a<div><li>b</ul>").nodes[4].parent == 1  # an inner div doesn't shield the open item
    assert h.parse("<table><tr><td>a<tr><td>b</table>").nodes[4].parent == 1
    assert h.parse("<ul><li>a<ul><li>b</ul><li>c</ul>").nodes[5].parent == 1
    assert h.main_text("</p></div>x</li>") == "x"


def test_large_and_damaged_files_are_read_record_by_record():
    rng = __import__("random").Random(1)
    one = w.record_bytes({"WARC-Type": "resource", "Content-Length": "3000"}, rng.randbytes(3000))
    data = one * 8000
    began = time.process_time()
    assert sum(len(block) for _, block in w.parse_records(data)) == 3000 * 8000
    assert time.process_time() - began < 20
    first = next(w.parse_records(data + b"junk"))
    assert len(first[1]) == 3000
    assert len(list(w.parse_records(one + b"\0\0 padding"))) == 1 and len(list(w.parse_records(one + one[: len(one) // 2]))) == 2
    plain = b"WARC/1.0\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\nContent-Length: x\r\n\r\n"
    assert [b for _, b in w.parse_records(plain)] == [b"abcde", b""] and list(w.parse_records(b"")) == [] and list(w.parse_records(b"WARC/1.0\r\nA: b")) == []
