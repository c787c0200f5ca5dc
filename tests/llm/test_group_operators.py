"""Near duplicates, mixture, pages, fingerprints, and the pipeline: against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import COLUMNS, prose
from tidemark.llm import fingerprint, html_text, mixing, simhash

SPACED = re.compile("[^\x20\x09-\x0d]+")


def fingerprint_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPACED.findall(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def test_simhash_by_brute_force(spark, odd, odd_rows, empty):
    got = odd.select("text", simhash.as_hex(simhash.simhash("text")).alias("fp")).collect()
    assert all(r["fp"] == f"{fingerprint_of(r['text']):016x}" for r in got) and len(got) == len(odd_rows)
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows)
    where = {r["key"]: r["component_id"] for r in found}
    assert where[106] == 3 and where[102] == 100 and where[101] == 100
    assert simhash.near_duplicates(empty).count() == 0


def test_links_and_components_by_brute_force(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:40]:  # chains of neighbours, also across the halves
        for _ in range(4):
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    expected = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in simhash.links(fps).collect()} == expected
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in expected:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps)).collect()}
    assert all(got.get(v, v) == find(v) for v in values)


def test_components_of_a_long_chain(spark):
    n = 70
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, n)}


def test_schedule_deviates_less_than_a_block():
    rng = random.Random(4)
    for _ in range(60):
        weights = mixing.whole_weights({str(i): rng.random() ** 3 + 1e-5 for i in range(rng.randint(1, 15))}, 97)
        assert sum(weights.values()) == 97 and min(weights.values()) >= 1
        seen = Counter()
        for t, name in enumerate(mixing.period(weights), 1):
            seen[name] += 1
            assert all(abs(seen[k] - w * t / 97) < 1 for k, w in weights.items())


def test_mixture_places_every_document_once(spark, odd, odd_rows, empty):
    rows = mixing.mix(odd, block=2).collect()
    assert len(rows) == len(odd_rows)
    place = [r["mix_"]["position"] for r in rows]
    assert len(set(place)) == len(place)
    for source in {r["source"] for r in rows}:
        mine = sorted((r["mix_"]["rank"], r["mix_"]["position"]) for r in rows if r["source"] == source)
        assert [k for k, _ in mine] == list(range(len(mine))) and [p for _, p in mine] == sorted(p for _, p in mine)
    assert mixing.ordered(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0
    only = mixing.mix(odd.select("doc_id", "source"), weights={"src0": 1.0, "nowhere": 2.0}, block=2).select("source", "mix.*").collect()
    first = [r for r in only if r["phase"] == 0]
    assert {r["source"] for r in first} == {"src0"} and len(only) == len(odd_rows)


def test_mixture_in_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    rows = mixing.mix(docs, block=3).select("source", "mix.*").collect()
    counts = Counter(r["source"] for r in rows)
    placed = mixing.phases({k: -(-n // 3) for k, n in counts.items()}, mixing.target_weights(counts))
    slots = sorted((p["slot0"] + i // p["quota"] * p["span"] + p["at"][i % p["quota"]]) for p in placed for i in range(p["end_block"] - p["first_block"]))
    assert slots == list(range(len(slots))) and {r["slot"] for r in rows} == set(slots)
    assert len({r["position"] for r in rows}) == 300
    first = sorted({(r["slot"], r["source"]) for r in rows if r["phase"] == 0})
    weight = {r["source"]: r["weight"] for r in rows}
    seen = Counter()
    for t, (_, source) in enumerate(first, 1):
        seen[source] += 1
        assert all(abs(seen[k] - w * t) < 1 + t / mixing.SLOTS for k, w in weight.items())


def test_long_schedule_keeps_to_the_exact_weights():
    weights = mixing.target_weights({"big": 1_600_000} | {f"s{i:02}": 80_000 for i in range(20)})
    turns = {}
    for p in mixing.phases({k: 100_000 if k == "big" else 5_000 for k in weights}, weights):
        if p["phase"] == 0:
            turns.setdefault(p["source"], []).extend(p["slot0"] + i // p["quota"] * p["span"] + p["at"][i % p["quota"]] for i in range(p["end_block"] - p["first_block"]))
    for k, w in weights.items():
        for i, t in enumerate(sorted(turns[k])):  # the deviation is greatest just before and just after a turn
            assert i - w * t > -1 and i + 1 - w * (t + 1) < 1, (k, i, t)


def test_mixture_keeps_to_the_weight_it_returns(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15, "rare").otherwise("rest").alias("source"))
    rows = mixing.mix(docs, weights={"rare": 0.00075, "rest": 0.99925}, block=1).select("source", "mix.*").where("phase = 0").collect()
    weight = {r["source"]: r["weight"] for r in rows}
    seen = Counter()
    for t, r in enumerate(sorted(rows, key=lambda r: r["slot"]), 1):
        seen[r["source"]] += 1
        assert r["slot"] == t - 1 and all(abs(seen[k] - w * t) < 1 for k, w in weight.items())


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav>
<div id="cookie-notice">We use cookies</div><div class="wrap"><div class="post-%d"><h1>T &amp; x</h1><p>Hello  <b>wor</b>ld<br>again &eacute; y
<p>Second <a href="x>y">link</a> para.<ul><li>one<li>two</ul><script>if (a < b) "</p>"</script><div class="share">Share!</div></div>
<div class="sidebar"><p>Side</div><section class="comments"><p>A comment that is longer than the article itself, by far, and again by far</section></div><footer>(c)"""


def test_pages(spark):
    rows = [(i, f"https://User@Host.example:8{i}/a", PAGE % i, i) for i in range(6)]
    rows += [(6, "http://host.example/b", "<p>only <i>this</i></p> and that", 0), (7, None, None, 0), (8, "", "", 0), (10, "odd url", '<p class="x>Quote <b title=\'y>left</b> open</p>', 0), (9, "odd url", "<div>a &lt;b&gt; <div>c", 0), (9, "odd url", "<div>a &lt;b&gt; <div>c", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(2)
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(pages).collect())
    article = "T & x Hello world again é y Second link para. one two"
    assert got == [(i, article) for i in range(6)] + [(6, "only this and that"), (7, ""), (8, ""), (9, "a <b> c"), (9, "a <b> c"), (10, "Quote left open")]
    paths = {r["host"]: r["paths"] for r in html_text.winning_paths(pages).collect()}
    assert paths["host.example"][0] == "body/div.wrap/div.post-#"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pages_keep_all_parts_of_an_article(spark):
    intro, main, lead = "Intro words " * 20, "Main words of it " * 25, "A lead of a few words"
    menu = '<div class="list"><a href="/x">Some other page</a></div>'
    pages = [
        (1, f"<body>{menu}<article><section class='intro'><p>{intro}</section>{menu}<section class='main'><p>{main}</section></article></body>", f"{intro}{main}"),
        (2, f"<body><article><h1>Title</h1><p>{lead}</p><div class='body'><p>{main}</div></article></body>", f"Title {lead} {main}"),
        (3, f"<body><div class='page'><h1>Title</h1><div class='grid'><div class='body'><p>{main}</div></div></div>{menu}</body>", f"Title {main}"),
        (4, f"<body><div class='has-sidebar no-sidebar'><article><p>{main}</article><div class='sidebar'>Side {lead}</div></div></body>", main),
        (5, f"<body><div class='page-widget'><div class='nav-page'><h1>Title</h1><p>{main}</div></div><p>{lead}</body>", f"Title {main}{lead}"),
        (6, f"<body><div class='page-widget'><p>{main}</div></body>", main),
        (7, f"<body><div class='post'><p>{lead}</div><div class='comments'><p>{main}</div></body>", lead),
    ]
    given = spark.createDataFrame([(10 * k + j, f"http://h{k}.example/{j}", page) for k, page, _ in pages for j in range(3)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(given).collect()}
    assert got == {10 * k + j: " ".join(text.split()) for k, _, text in pages for j in range(3)}


def test_quoted_values_of_any_length():
    for n in (10, 7_000, 9_000, 300_000):
        value = "<p class='ad'>inner > markup</p>" * (n // 32 + 1)
        page = f"""<body><div data-page="{value}" {'a="" ' * 300} class="post"><p>body text</p><iframe srcdoc="{value}"></iframe></div></body>"""
        assert html_text.blocks(page) == [(("body", "div.post", "p"), "body text", 0)]
    odd = html_text.blocks("""<p class="x>Quote <b title='y>left</b> open</p><p>""" + "a < b " * 3)
    assert [x[1] for x in odd] == ["Quote left open", "a < b a < b a < b"]
    assert [x[1] for x in html_text.blocks("<p>one <!-- no > <p>two")] == ["one"]


def test_odd_quoting_takes_linear_time():
    for piece in ('<a "', "<a '", '<a "<b \'', "<!x ", '<a b="c> ', '"<a" ', "<a b='\" "):
        start = time.process_time()
        html_text.main_text("<p>x</p>" + piece * 200_000, None)
        assert time.process_time() - start < 10, piece


def test_fingerprints(spark, odd, odd_rows, empty):
    rows = fingerprint.edited_and_next(odd).collect()
    assert len(rows) == len(odd_rows)
    order = sorted(odd_rows, key=lambda r: -1e9 if r[0] is None else r[0], reverse=True)
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        assert any((x["id"], x["n_chars"], x["edited_sha256"]) == (r[0], n, hashlib.sha256(edited.encode()).hexdigest()) for x in rows)
    assert all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in rows)
    assert len({x["fingerprint"] for x in rows if x["id"] in (3, 106)}) == 1
    assert fingerprint.edited_and_next(empty).count() == 0


def test_fingerprints_add_up(spark):
    rng = random.Random(9)
    lines = [prose(rng, 12) for _ in range(40)]
    texts = {1: lines, 2: lines[::-1], 3: lines[:30], 4: lines[30:], 5: [*lines, "", "  "], 6: [prose(rng, 12) for _ in range(40)]}
    got = {r["id"]: r for r in fingerprint.fingerprints(spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "doc_id long, text string")).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == got[5]["fingerprint"] != got[3]["fingerprint"]
    assert [a + b for a, b in zip(got[3]["signs"], got[4]["signs"], strict=True)] == got[1]["signs"]
    strong = lambda k: [int(got[k]["fingerprint"][8 * i : 8 * i + 8], 16) for i in range(8)]
    assert [(a + b) % (1 << 32) for a, b in zip(strong(3), strong(4), strict=True)] == strong(1)


def test_fingerprint_query_in_sql(spark, sf_dir):
    from tidemark.llm.queries import op9_document_fingerprints

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(fingerprint.sql()).df().sort_values("doc_id").reset_index(drop=True)
    got = op9_document_fingerprints(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert (got[c] == want[c]).all(), c


@pytest.fixture(scope="module")
def stages(spark, odd_rows, tmp_path_factory):
    """Rows after each stage of the pipeline over the odd documents."""
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(odd_rows, COLUMNS)
    out = [("documents", docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, str(folder)).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.columns, docs.collect()))
    return {name: (columns, rows) for name, columns, rows in out}


def test_pipeline_stages(stages, odd_rows):
    ids = {name: Counter(r["doc_id"] for r in rows) for name, (_, rows) in stages.items()}
    for name in ("language", "quality", "near_duplicates", "mixing"):
        assert stages[name][0] == stages["documents"][0]
    assert ids["documents"] - ids["language"] == Counter([100, 101, 102, 105])
    assert ids["language"] >= ids["quality"] and all(ids["quality"][i] for i in range(90))
    text = {r["doc_id"]: r["text"] for r in stages["quality"][1]}
    groups: dict[int, set] = {}
    for i, x in text.items():
        near = [g for g in groups if (g ^ fingerprint_of(x)).bit_count() <= 3]
        members = {i}.union(*(groups.pop(g) for g in near))
        groups[fingerprint_of(x)] = members
    assert ids["near_duplicates"][3] == 1 and 106 not in ids["near_duplicates"]
    assert len(ids["near_duplicates"]) == len(groups) and set(ids["near_duplicates"].values()) == {1}
    assert ids["mixing"] == ids["near_duplicates"] == ids["sentencepiece"]
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in stages["sentencepiece"][1])


def test_one_row_of_each_component_stays(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    t = [prose(rng, 60) for _ in range(9)]
    near = " ".join(t[1].split()[::-1]) + " and"  # far from t[1]; only exact copies link here
    rows = [(None, t[0]), (None, t[2]), (None, t[3]), (None, t[3]), (7, t[4]), (7, t[5]), (7, t[5]), (None, t[4]), (3, t[1]), (5, t[1]), (5, t[6]), (5, near), (9, t[7]), (2, t[7]), (None, None), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], COLUMNS).repartition(3)
    groups = {fingerprint_of(x) for _, x in rows}
    assert all((a ^ b).bit_count() > 3 for a in groups for b in groups if a != b)
    docs.write.parquet(str(tmp_path / "docs"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        got = Counter((r["doc_id"], r["text"] or "") for r in corpus_pipeline.duplicate_stage(spark, given, "").collect())
        assert got == Counter([(None, t[0]), (None, t[2]), (None, t[3]), (7, t[4]), (7, t[5]), (3, t[1]), (5, t[6]), (5, near), (2, t[7]), (4, "")])


def test_position_is_the_order_of_the_mixture(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    docs = spark.createDataFrame([(i, prose(rng, 5 if i % 3 else 400), "en", f"s{i % 4}", 1) for i in range(400)], COLUMNS)
    wanted = [r["doc_id"] for r in mixing.mix(docs).select("doc_id", "mix.position").orderBy("position").collect()]
    mixed = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    assert [r["doc_id"] for r in mixed] == wanted
    path = str(tmp_path / "mixed")
    for lo, hi in ((0, 20), (20, 50), (50, 130), (130, 400)):  # as one writer does it, the last file the largest
        part = str(tmp_path / f"part{lo}")
        spark.createDataFrame(mixed[lo:hi], COLUMNS).coalesce(1).write.parquet(part)
        os.makedirs(path, exist_ok=True)
        (name,) = (f for f in os.listdir(part) if f.endswith(".parquet"))
        os.rename(f"{part}/{name}", f"{path}/part-{lo:05}-{name.split('-', 2)[2]}")
    read = spark.read.parquet(path)
    assert [r["doc_id"] for r in read.collect()] != wanted
    got = corpus_pipeline.token_stage(spark, read, "")
    assert got.columns == [*read.columns, "position", "ids", "n_tokens"]
    assert [(r["position"], r["doc_id"]) for r in got.orderBy("position").collect()] == list(enumerate(wanted))
    assert {r["position"] for r in corpus_pipeline.token_stage(spark, docs, "").collect()} == set(range(400))


def test_pipeline_on_no_documents(spark, empty, sf_dir):
    import corpus_pipeline

    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_queries_over_whole_tables(spark, sf_dir):
    from tidemark.llm.queries import QUERIES

    n_docs, n_pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages"))
    for name, query in QUERIES.items():
        rows = query(spark, sf_dir).count()
        if name.startswith("op11_"):
            assert rows > n_docs
        elif name.startswith("op13_"):
            assert rows == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
        else:
            assert rows == (n_pages if name.startswith(("op6_", "op12_")) else n_docs), name
