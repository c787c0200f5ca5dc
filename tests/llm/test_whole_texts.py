"""Long texts, cuts and samples: what is cut for speed must not change a result."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from tidemark.llm import fingerprint, language, licences, quality
from tidemark.llm import textbytes as tb


def sequential(table: np.ndarray, codes: list[int]) -> int:
    state, phrases = int(table[0]) >> 2, 0
    for c in codes:
        step = int(table[state + c])
        phrases, state = phrases + (step & 3), step >> 2
    return phrases + (state > 0)


def test_phrases_do_not_depend_on_pieces():
    rng = random.Random(3)
    model = language.Model([("x", [prose(rng, 300)]), ("y", ["aaaa aaab " * 30, "ab" * 40]), ("z", ["q"])])
    texts = [prose(rng, rng.randint(0, 200)) for _ in range(30)] + ["a" * 700, "ab" * 300, "", "!", "zzz" * 99]
    for _, _, data, offsets in tb.blocks(pa.array(texts)):
        low, ends = language.symbols(data, offsets)
        codes = model.classes(low).astype(np.int32)
        for table in model.tables:
            want = [sequential(table, codes[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for piece in (1, 2, 7, 64, 256, 100_000):
                assert language.phrase_counts(table, codes, ends, piece).tolist() == want, piece


def test_learning_takes_whole_lines_and_different_texts(spark, monkeypatch):
    rng = random.Random(4)
    other = "ß ch ung keit ü der ein sch"
    copies = [("one text again and again", "en")] * 400
    rows = copies + [(prose(rng, 60), "en") for _ in range(30)] + [(prose(rng, 60, other), "de") for _ in range(30)] + [(prose(rng, 9000, "x yy zzz"), "long"), (None, "en"), ("lost", None)]
    table = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    model = language.fit(table)
    assert sorted(model.names) == ["de", "en", "long"] and model.names[0] == "en"
    tests = pa.array([prose(rng, 40), prose(rng, 40, other), prose(rng, 40, "x yy zzz")])
    assert model.predict(tests).field("lang_pred").to_pylist() == ["en", "de", "long"]
    assert min(len(t) for t in model.tables) > 5000  # the copies did not fill the sample
    monkeypatch.setattr(language, "TOTAL_SYMBOLS", 900)
    small = language.fit(table)
    assert sorted(small.names) == ["de", "en", "long"] and all(2 ** b <= 302 for b in small.bits)


def test_a_licence_is_found_however_the_text_goes_on(spark):
    mit = licences.TEMPLATES[0][1]
    rng = random.Random(5)
    gaps = mit.split()
    loose = " ".join(w + (" inserted" if i % 9 == 8 else "") for i, w in enumerate(gaps))
    rows = [
        (0, mit), (1, mit + " x of the software" * 60), ((2), ("x of the software " * 60) + mit + " x of the software" * 60), (3, "x of the software " * 90), (4, loose),
        (5, " ".join(gaps[:15])), (6, " ".join(f"{w} {prose(rng, 30)}" for w in (" ".join(gaps[i : i + 4]) for i in range(0, len(gaps), 4)))), (7, mit + " " + mit),
    ]
    got = {r["key"]: (r["labels"], r["score"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k][0] for k in range(8)] == ["mit", "mit", "mit", "", "mit", "", "", "mit"]
    assert got[0][1] == got[1][1] == got[2][1] == 1.0


def test_long_texts_of_licences_take_seconds(spark):
    text = (licences.TEMPLATES[0][1] + ". ") * 3000  # about a megabyte
    table = spark.createDataFrame([(1, text), (2, "word " * 300_000)], "doc_id long, text string")
    start = time.time()
    got = {r["key"]: (r["labels"], r["n_words"]) for r in licences.scan(table).collect()}
    assert got == {1: ("mit", 3000 * len(licences.tb_words(licences.TEMPLATES[0][1]))), 2: ("", 300_000)}
    assert time.time() - start < 60


@pytest.mark.parametrize("times", [3, 1_048_581])
def test_lanes_hold_a_million_sentences(spark, times):
    table = spark.createDataFrame([(1, "one sentence."), (2, "other words.")], "doc_id long, text string")
    many = table.selectExpr("doc_id", f"repeat(text, case when doc_id = 1 then {times} else 1 end) as text")
    one, found = (({r["id"]: r["signs"] for r in fingerprint.fingerprints(t).collect()}) for t in (table, many))
    assert found[1] == [times * x for x in one[1]] and found[2] == one[2]


def test_the_sample_follows_the_text_where_ids_do_not_tell(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 40)
    rng = random.Random(6)
    table = spark.createDataFrame([(None, prose(rng, 30)) for _ in range(400)], "doc_id long, text string").repartition(5)
    x, seen = quality.sample(table, "text", "doc_id", 400)
    again, _ = quality.sample(table.repartition(2), "text", "doc_id", 400)
    assert 10 < len(x) < 80 and len(seen) == len(x)
    assert np.array_equal(x, again)


BODY = "<p>" + "Body words stand here, one after another. " * 30 + "</p>"


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        (f'<article><header class="entry-header"><h1>A title</h1></header><div class="body">{BODY}</div></article>', "A title"),
        (f'<article><div class="post-header"><h1>A title</h1><p>A standfirst.</p></div><div class="body">{BODY}</div></article>', "A title A standfirst."),
        (f'<article><section class="ad-free-zone"><p>Quiet zone.</p></section><div class="body">{BODY}</div></article>', "Quiet zone."),
        (f'<article><div class="body"><p class="notice-period">Thirty days.</p>{BODY}</div></article>', "Thirty days."),
        (f'<article><div class="body">{BODY}<h2 id="related-work">Related work</h2><p>More.</p></div></article>', "Related work More."),
        (f'<article><div class="body">{BODY}</div><ol><li><a href="/1">First source</a></li></ol></article>', "First source"),
        (f"<article><div class='body'><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>{BODY}</div></article>", "So x=2 holds."),
    ],
)
def test_parts_of_an_article_stay(page, kept):
    from tidemark.llm import html_text

    assert kept in html_text.main_text(f"<html><body><nav>Menu</nav>{page}<footer>End</footer></body></html>", None)


@pytest.mark.parametrize("part", ['<div class="page-header">Noise</div>', '<p class="notice">Noise</p>', '<article><div class="share-buttons">Noise</div></article>', '<div id="cookie-banner">Noise</div>', '<article><p class="ad">Noise</p></article>'])
def test_noise_goes(part):
    from tidemark.llm import html_text

    assert "Noise" not in html_text.main_text(f"<body>{part}<article>{BODY}</article></body>", None)


def test_deep_pages_take_seconds():
    from tidemark.llm import html_text

    start = time.time()
    assert html_text.main_text("<div>x " * 100_000, None).split() == ["x"] * 100_000
    assert html_text.main_text("<div>" * 50_000 + BODY + "</div>" * 50_000, None).startswith("Body words")
    assert time.time() - start < 30


def test_hosts_without_a_common_path_keep_their_pages(spark):
    from tidemark.llm import html_text

    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, "http://one/x", f'<body><nav>Menu</nav><div class="c{name(i)}">{BODY}<p>Page {i}.</p></div></body>') for i in range(200)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in html_text.extract(table).collect()}
    assert all(found[i].endswith(f"Page {i}.") and "Menu" not in found[i] for i in range(200))
    assert [len(r["paths"]) for r in html_text.winning_paths(table).collect()] == [1]


@pytest.mark.parametrize("ids", [[None] * 150, [7] * 150, [*range(149), 1 << 61], [None] * 50 + [-(1 << 61)] + [5] * 60 + list(range(90))], ids=["no id", "one id", "far id", "all"])
def test_neighbours_are_found_whatever_the_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "CELL_ROWS", 8)
    monkeypatch.setattr(fingerprint, "CELLS", 2)
    rng = random.Random(11)
    rows = [(x, prose(rng, rng.randint(0, 9))) for x in ids]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed = fingerprint.in_cells(table, "doc_id", "text").where("not extra").groupBy("cell").count().collect()
    assert max(r["count"] for r in placed) <= 32 and sum(r["count"] for r in placed) == len(rows)
    hashed = [(r["doc_id"], r["text"], r["tie"]) for r in table.selectExpr("*", "xxhash64(text) as tie").collect()]
    order = sorted(hashed, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = []
    for i, (x, text, _) in enumerate(order):
        third = len(text) // 3
        edited = text[: len(text) - third] + order[(i + 1) % len(order)][1][:third]
        want.append((str(x), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(str(r["id"]), r["n_chars"], r["edited_sha256"]) for r in fingerprint.edited_and_next(table).collect()]
    assert sorted(got) == sorted(want)
