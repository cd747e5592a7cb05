"""Cases in which an operator once did less than its whole job."""

import zlib

import numpy as np
import public_tokenizers as P

from lumastack.llm import html_tree, line_rules, pii, records

PAGES = "page_id long, url string, html string"


def test_importance_decides_in_articles(spark):
    body = "<html><body><div class='ad'>Ad {1}</div><article><h1>T{0}</h1><p>Text {0}</p><p>Subscribe for our letter</p><ul><li>About us</li></ul></article></body></html>"
    rows = [(i, "http://h.org/x", body.format(i, i)) for i in range(8)]
    rows += [(100 + i, "http://c.org/x", body.format(i // 30, i)) for i in range(60)]  # copies of two articles
    got = {r["page_id"]: r["text"] for r in html_tree.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"T{i}\nText {i}" for i in range(8))
    assert all(got[100 + i] == f"T{i // 30}\nText {i // 30}\nSubscribe for our letter\nAbout us" for i in range(60))


def test_pages_by_where_most_text_is(spark):
    text = "The body of the page is far longer than all that stands around it. " * 3
    pages = {
        "comments": f"<div>{text}</div><article class='comment'>One says</article><aside><article>Teaser</article></aside>",
        "teaser": f"<div>{text}</div><article>A teaser</article>",
        "wrapped": f"<div id='page' class='no-sidebar'><div>{text}</div><div class='sidebar'>Side</div></div>",
        "named": f"<article class='social-policy'><p>{text}</p><div class='comments'>One says</div></article><div class='share'>Share</div>",
        "around": f"<div class='page menu'><article><p>{text}</p></article><p>Beside</p></div>",
        "discussed": f"<article><p>{text}</p></article><div class='comments-area'>{text}{text}</div>",
    }
    rows = [(i, f"http://{k}.org/x", f"<html><body>{v}</body></html>") for i, (k, v) in enumerate(pages.items())]
    got = {r["url"][7:-6]: r["text"] for r in html_tree.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    whole = text.strip()
    assert got == {**dict.fromkeys(pages, whole), "teaser": f"{whole}\nA teaser"}


def test_added_tokens_as_the_library_gives_them(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))  # unmodified
    mark = "<|endoftext|>"
    texts = ["plain words here", f"a {mark} b", mark, f"two  {mark}{mark}\nx", f"word{mark}, and more words here", "<|endoftext |>", "", f"plain words {mark[:-1]}"]
    want, start = [], 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = records.record_digests(rows, P.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_line_of_many_texts_in_one_large_source(spark):
    """A line in 1,001 texts is below the share of a source of 13,000, and goes by the absolute limit."""
    shared = "All rights belong to the editors of this page"
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))  # noqa: E731  digits would make all lines one
    rows = [(i, f"{shared}\nThis is the story of {name(i)} as told by {name(7 * i)} in ten words" if i <= 1000 else f"Another story of its own with {name(i)} and some more words") for i in range(13_000)]
    rows += [(20_000, f"{shared}\nA few words"), (20_001, f"A line that is held by this one text only and not more\n{shared}")]
    docs = spark.createDataFrame([(i, t, "big") for i, t in rows], "doc_id long, text string, host string")
    got = {r["doc_id"]: r for r in line_rules.line_rules(docs).collect()}
    assert all(got[i]["removed_words"] == 9 and got[i]["kept"] for i in range(1001))
    assert all(got[i]["removed_words"] == 0 and got[i]["kept"] for i in range(1001, 13_000))
    assert not got[20_000]["kept"] and not got[20_000]["base_failed"]  # 3 words are left
    assert got[20_001]["kept"]
    within = {r["doc_id"]: r for r in line_rules.line_rules(docs.where("doc_id < 1000 or (doc_id > 1000 and doc_id < 20000)")).collect()}
    assert all(within[i]["removed_words"] == 0 for i in range(1000))  # 1,000 texts are within the limit


def test_addresses_behind_many_digits():
    """A span with a written-out mark is a candidate whatever number of digits stands before the mark."""
    text = "reach me: " + "-".join(["12345678"] * 6) + "-bob (at) home.org today"
    atoms, found = pii.segments(text, text.index("1234"), len(text))
    assert any(kind == 0 and i == 0 and text[: atoms[j - 1][1]].endswith("home.org") for i, j, kind, _ in found)
