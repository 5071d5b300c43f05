"""WARC round trips and main-text extraction."""

import base64
import gzip
import hashlib
import time
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from ratewright.llm import html_extract, warc

PAGES = "page_id long, url string, html string, payload string, leader long, id string, noise string"


def page_rows(*rows):
    return [(i, u, h, "p", 3, "i", "n") for i, u, h in rows]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    """The contract, row by row: of equal payloads the largest page_id is the response."""
    lead = {}
    for i, _, h in rows:
        if i is not None:
            lead[h or ""] = max(i, lead.get(h or "", i))
    same = Counter(h or "" for _, _, h in rows)
    out = Counter()
    for i, _, h in rows:
        first = lead.get(h or "")
        revisit = same[h or ""] > 1 and first is not None and i != first
        out[i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def test_archive_equals_brute_force(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://b/\r\nX: y", ""), (5, "http://b/5", "é" * 70_000), (5, "http://b/5", "é" * 70_000), (6, "", "\r\n\r\nWARC/1.1\r\n"), (None, "http://c", "lone"), (9, "http://d", "<p>x</p>")]
    df = spark.createDataFrame(page_rows(*rows), PAGES).repartition(3)
    got = warc.archive_pages(df, f"file://{tmp_path}/w").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == expected(rows)
    assert warc.archive_pages(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_archive_of_the_table(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = warc.archive_pages(pages, f"file://{tmp_path}/w").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == expected(rows)


def test_payloads_filters_and_plain_files(spark, tmp_path):
    rows = [(k, f"http://h{k % 3}/{k}", f"<p>{k // 2}</p>" * 50) for k in range(40)]
    warc.archive_pages(spark.createDataFrame(page_rows(*rows), PAGES), f"file://{tmp_path}/w").count()
    back = warc.read_warc(spark, f"file://{tmp_path}/w")
    responses = {r.target_uri: bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()}
    assert responses == {u: h for k, u, h in rows if k % 2}
    some = warc.read_warc(spark, f"file://{tmp_path}/w", payload="false").where(F.col("target_uri").startswith("http://h1/") & (F.col("record_type") == "revisit"))
    assert {r.target_uri for r in some.collect()} == {u for k, u, _ in rows if k % 3 == 1 and k % 2 == 0}
    assert warc.read_warc(spark, f"file://{tmp_path}/w", record_types="request").count() == 0
    data = b"".join(warc.encode_record({"record_id": f"urn:{k}", "target_uri": u, "date": None, "refers_to": None, "payload_digest": None, "payload": h.encode()}) for k, u, h in rows)
    (tmp_path / "plain.warc").write_bytes(data)
    (tmp_path / "other.warc.gz").write_bytes(gzip.compress(data[: len(data) // 1]))
    assert {bytes(r.payload).decode() for r in warc.read_warc(spark, f"file://{tmp_path}/plain.warc", verify="true").collect()} == {h for _, _, h in rows}


def test_a_wrong_digest_is_found(spark, tmp_path):
    record = {"record_id": "urn:1", "target_uri": "http://a", "date": None, "refers_to": None, "payload_digest": digest("other"), "payload": b"this"}
    (tmp_path / "bad.warc").write_bytes(warc.encode_record(record))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, f"file://{tmp_path}/bad.warc", verify="true").collect()


ARTICLE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><nav><a href=/>Home</a></nav></header><div class="sidebar"><p>Side</p></div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b>
 text&nbsp;here.<p>Second &lt;tag&gt; &#233;</p><ul><li>one<li>two</ul><div class="advert">Buy</div><form><p>Name <input></p></form></article>
<section id="comments"><p>Reader says</p></section><footer>Legal</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "http://a/1", ARTICLE), (2, "http://a/2", None), (3, None, ""), (4, "odd", "just text"), (5, "http://a/5", "<div><p>un<b>closed"), (6, "http://a/6", "a < b && c > d <!-- gone --> e"), (1, "http://a/1", ARTICLE)]
    got = html_extract.extract_pages(spark.createDataFrame(page_rows(*rows), PAGES)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert texts[1] == "Head & line\n\nFirst bold text here.\n\nSecond <tag> é\n\none\n\ntwo"
    assert texts[2] == texts[3] == "" and texts[4] == "just text" and texts[5] == "unclosed" and texts[6].startswith("a < b && c > d") and texts[6].endswith("e")
    assert html_extract.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_branches_that_a_host_repeats_are_noise(spark):
    page = lambda k: f"<body><div class=x1><p>Same words on each page</p></div><div class=x2><p>Own words {k} {k * k}</p></div></body>"
    rows = [(k, f"http://host/{k}", page(k)) for k in range(12)] + [(100 + k, f"http://few{k}/", page(k)) for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(page_rows(*rows), PAGES)).collect()}
    assert got[3] == "Own words 3 9" and got[101] == "Same words on each page\n\nOwn words 1 1"
    copies = [(k, f"http://copies/{k}", page(1)) for k in range(12)]
    assert {r.text for r in html_extract.extract_pages(spark.createDataFrame(page_rows(*copies), PAGES)).collect()} == {"Same words on each page\n\nOwn words 1 1"}


STORY = "The river bends past an old mill where farmers bring grain in autumn, and children swim there in summer."


@pytest.mark.parametrize(
    "wrapper",
    ['div class="layout has-sidebar"', 'div class="main-content no-sidebar"', 'div id="page-with-menu"', 'article class="post comments-open"', 'div class="post share-enabled"', 'div class="story"'],
)
def test_names_of_states_do_not_drop_an_article(wrapper):
    page = f"<html><body><nav>Home</nav><{wrapper}><p>{STORY}</p><div class='sidebar'>Popular</div></{wrapper.split()[0]}><div class='site-footer'>All rights</div></body></html>"
    assert html_extract.main_text(html_extract.Page(page)) == STORY


def test_a_teaser_does_not_stand_for_the_page():
    page = f"<body><article><p>A short teaser.</p></article><div class=story><p>{STORY}</p><p>{STORY} And more.</p></div></body>"
    assert html_extract.main_text(html_extract.Page(page)) == f"A short teaser.\n\n{STORY}\n\n{STORY} And more."


def test_deep_nesting_takes_seconds():
    began = time.time()
    page = html_extract.Page("".join(f"<div>word{k}" for k in range(100_000)) + "</p>" * 1000)
    assert html_extract.main_text(page).split("\n\n") == [f"word{k}" for k in range(100_000)] and time.time() - began < 30


def test_three_pages_with_unlisted_names(spark):
    pages = [(k, f"http://small.example/{k}", f"<body><div class=zx9>Tell us what you think of this place</div><div class=q7><p>{STORY} It was day {k} {'abc'[k] * 9}.</p></div></body>") for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{STORY} It was day {k} {'abc'[k] * 9}." for k in range(3)}


def test_node_importance_equals_brute_force(spark):
    import math
    from collections import Counter, defaultdict

    pages = [("h", f"<body><div class=top>Same words</div><div class=mid><p>Own words of {k}</p>{'<ul><li>x</ul>' * (k % 3)}</div></body>") for k in range(6)]
    got = {r.sign: (r.pages, r.importance) for r in html_extract.node_importance(spark.createDataFrame(pages, "host string, html string")).collect()}
    on, styles, contents = Counter(), defaultdict(Counter), defaultdict(Counter)
    for _, text in pages:
        page = html_extract.Page(text)
        own = {(s, t) for t, _, signs in page.blocks for s in signs}
        on.update({s for s, _ in own})
        for s, v in page.styles:
            styles[s][v] += 1
        for s, t in own:
            contents[s][t] += 1
    assert set(got) == {s for s, n in on.items() if n > 1}
    for s, (n, importance) in got.items():
        repeat = sum(math.log(c, n) for c in contents[s].values()) / len(contents[s])
        shown = sum(styles[s].values())
        entropy = -sum(c / shown * math.log(c / shown, n) for c in styles[s].values()) if shown else 0.0
        weight = 0.9 ** max(len(styles[s]), 1)
        assert n == on[s] and abs(importance - ((1 - weight) * min(entropy, 1.0) + weight * (1 - repeat))) < 1e-9
