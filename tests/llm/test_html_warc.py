"""Page extraction against plain expectations; archives through an exact round trip."""

import base64
import gzip
import hashlib

import pytest

from tradewind.llm.html_extract import extract, main_text, regions, smoothed
from tradewind.llm.warc import read_archives, record, write_archives

TEXT = "A sentence of the article that is long enough to be read as such. " * 3
FURNITURE = """
<header><p>Site name and claim</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies and ask you to accept all of them now.</p></div>
<aside class="sidebar"><p>Other things to read elsewhere on this site.</p></aside>
<form><p>Your name</p><input><button>Send</button></form>
<section id="comments"><article class="comment"><p>First! I disagree with all of this.</p></article></section>
<footer><p>&copy; us</p></footer><script>var a = "<p>no</p>";</script><style>p{}</style>"""


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>"])
@pytest.mark.parametrize("end", ["</body></html>", ""])
def test_the_article_alone_is_kept(wrap, end):
    body = f"<h1>Title &amp; more</h1><p>{TEXT}<b>bold</b>&nbsp;end<p>{TEXT}<br>next</p>"
    page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{FURNITURE}{wrap.format(body)}{end}"
    one = " ".join(TEXT.split())
    lines = main_text(page).split("\n")
    assert lines[-2:] == [f"{one} bold end", f"{one} next"]
    if "div" not in wrap:
        assert lines == ["Title & more", *lines[-2:]]


def test_short_lines_inside_the_article_stay():
    page = f"<article><p>Hm.</p><p>{TEXT}</p><p>Ok.</p><div class='ad'>Buy!</div><p>So.</p></article>"
    assert main_text(page) == f"Hm.\n{TEXT.strip()}\nOk.\nSo."


@pytest.mark.parametrize(
    "part",
    [
        "<section id='related-work'>{}</section>", "<div id='menu-planning'>{}</div>", "<div class='social-history'>{}</div>",
        "<section id='notice-of-appeal' class='ad-hoc-section'>{}</section>",
    ],
)
@pytest.mark.parametrize("wrap", ["<article class='post tag-social'>{}</article>", "<main>{}</main>"])
def test_parts_of_an_article_may_be_named_after_their_subject(part, wrap):
    inner = f"<h2 id='social-history'>One</h2><p>{TEXT}</p><h3 id='notice'>Two</h3><p>{TEXT}</p>"
    page = wrap.format(f"<p>{TEXT}</p>" + part.format(inner))
    one = TEXT.strip()
    assert main_text(f"<body>{FURNITURE}{page}</body>").split("\n") == [one, "One", one, "Two", one]


@pytest.mark.parametrize("name", ["class='x ad'", "class='cookie-notice'", "id='comments'", "id='Related'"])
def test_whole_names_rule_out_inside_an_article(name):
    page = f"<article><p>{TEXT}</p><div {name}><p>{TEXT}</p></div></article>"
    assert main_text(page) == TEXT.strip()


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>"])
def test_an_article_of_links_stays(wrap):
    items = [f"A work that is cited here, number {i}, with its title and its year" for i in range(12)]
    links = "".join(f"<li><a href='/{i}'>{x}</a></li>" for i, x in enumerate(items))
    assert main_text(f"<body>{FURNITURE}{wrap.format(f'<ul>{links}</ul>')}</body>").split("\n") == items
    assert main_text(f"<body><div><ul>{links}</ul></div></body>") == ""


@pytest.mark.parametrize("html", [None, "", " ", "<", "<p", "<!-- x", "<article></article>", "&", "<script>"])
def test_nothing_to_read(html):
    assert main_text(html) in ("", "<", "&")


def test_smoothing_and_regions():
    assert smoothed([5.0]) == [5.0]
    assert smoothed([1.0, 1.0, 1.0]) == pytest.approx([1.0, 1.0, 1.0])
    assert regions([]) == []
    assert regions([0, 0, 0, 0, 0, 90, 80, 90, 0, 0, 0, 0, 0])[0][0] >= 3


def test_every_page_is_a_row(spark):
    rows = [(1, "u", None, "c"), (2, None, f"<article><p>é {TEXT}</p></article>", "c"), (2, None, "", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(tuple(r) for r in extract(pages, carry=()).collect())
    text = f"é {TEXT.strip()}"
    assert got == [(1, "", 0), (2, "", 0), (2, text, len(text))]


PAGES = [
    (1, "http://a", "<p>" + "x" * 5000), (2, "http://b", "<p>" + "x" * 5000), (3, None, None), (4, "", ""),
    (5, "http://c", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" * 3),
    (6, "http://d", "\x1f\u008b\x08" * 50), (7, "http://é", "你好" * 900), (5, "http://c2", "other"),
] + [(100 + i, f"http://e/{i}", f"page {i} " * (i % 40)) for i in range(200)]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("split", [257, 1 << 20])
def test_archives_round_trip(spark, tmp_path, zipped, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    archives = write_archives(pages, str(tmp_path), zipped=zipped)
    got = read_archives(archives, split, payloads=True).collect()
    assert len(got) == len(PAGES)
    first = {}
    for page, _, html in sorted(PAGES, key=lambda p: p[0]):
        first.setdefault(html or "", page)
    wanted = sorted(
        (p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
         "response" if first[h or ""] == p else "revisit", first[h or ""] if first[h or ""] != p else -1)
        for p, _, h in PAGES
    )
    assert sorted(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to if r.refers_to is not None else -1)
        for r in got
    ) == wanted
    html = {(p, h or "") for p, _, h in PAGES}
    assert all((r.page_id, bytes(r.payload).decode()) in html for r in got if r.payload is not None)


def test_magic_in_a_payload_is_rejected_and_damage_ends_the_chain(spark, tmp_path):
    inner = record(9, "http://in", b"inside", None)
    whole = record(1, "http://a", inner + b"tail", None) + record(2, "http://b", b"two", None)
    (tmp_path / "a.warc").write_bytes(whole)
    damaged = record(3, "http://c", b"three", None) + b"garbage" + record(4, "http://d", b"four", None)
    (tmp_path / "b.warc").write_bytes(damaged)
    zipped = gzip.compress(record(5, "http://e", gzip.compress(inner), None)) + gzip.compress(record(6, "", b"", None))
    (tmp_path / "c.warc.gz").write_bytes(zipped)
    rows = [(str(tmp_path / n), (tmp_path / n).stat().st_size) for n in ("a.warc", "b.warc", "c.warc.gz")]
    archives = spark.createDataFrame(rows, "path string, size long")
    for split in (50, 1 << 20):
        assert sorted(r.page_id for r in read_archives(archives, split).collect()) == [1, 2, 3, 5, 6]


def test_a_block_ends_a_paragraph_at_any_depth():
    words = "some words of an article that go on for a while "
    for depth in (1, 7, 8, 9, 40):
        deep = "<b>" * depth
        page = f"<body><article><p>{words}{deep}inner<div>{words}</div></article></body>"
        assert main_text(page).split("\n") == [f"{words}inner", words.strip()]
