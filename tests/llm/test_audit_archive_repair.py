"""Divergence of sources, archives and the repair of conversations, against brute force and exact round trips."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import dialogue, divergence, warc

# ---- divergence ------------------------------------------------------------------------------


def brute_divergence(rows: list[tuple]) -> set[tuple]:
    """(lang, source, part, item, value, rank) of all ranks of pairs and the first TOP terms, from (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, lang, source in rows]
    seen = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in seen.items():
        if n >= 3:
            kept[lang].append(t)
    groups = {(lang, source) for lang, source, _ in docs}
    counts = Counter((lang, source, t) for lang, source, terms in docs for t in terms if seen[lang, t] >= 3)
    out = set()
    for lang, source in groups:
        terms = kept[lang]
        share = lambda of, t: 1 + 10**9 * (sum(counts[lang, s, t] for s in of) + 1) // (sum(counts[lang, s, u] for s in of for u in terms) + len(terms))  # noqa: B023, E731
        sources = sorted(s for x, s in groups if x == lang)
        pairs = []
        for other in sources:
            if other != source:
                pq = [(share([source], t), share([other], t)) for t in terms]
                pairs.append((-sum((p - q) ** 2 // q for p, q in pq), other.encode()))
        own = []
        for t in terms:
            p, q = share([source], t), share(sources, t)
            if counts[lang, source, t] and p > q:
                own.append((-((p - q) ** 2 // q), t.encode()))
        for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:200])):
            out |= {(lang, source, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


def divergence_rows() -> list[tuple]:
    rng = random.Random(3)
    words = "Alpha beta Γάμμα delta épsilon zeta ETA theta 漢字 iota x2y kappa".split()
    rows = [(" ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(0, 30))), rng.choice(["en", "de"]), f"s{rng.randint(0, 4)}") for _ in range(60)]
    rows += [(None, "en", "s1"), ("", None, None), ("beta beta", None, ""), ("123 !!", "en", "none"), (None, "xx", "a"), ("rare", "xx", "b"), ("beta " * 3000, "en", "s0")]
    return rows


@pytest.mark.parametrize(("groups", "terms"), [(2, 3), (12, 16_384)])
def test_divergence_equals_brute_force(spark, monkeypatch, groups, terms):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rows = divergence_rows()
    docs = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n long").repartition(3)
    found = divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == brute_divergence(rows)


def test_divergence_of_nothing(spark, empty):
    assert divergence.audit(empty).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 123_456_789_012, 9_876_543_210_987, 54_321_098
    found = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()["p"]
    assert found == 1 + 10**9 * (n + 1) // (total + terms)
    assert list(divergence.shares(__import__("numpy").array([n, 0]), total, terms)) == [found, 1 + 10**9 // (total + terms)]


# ---- archives --------------------------------------------------------------------------------


def pages(spark):
    same, near = "<p>" + "same " * 40 + "</p>", "x" * 99
    rows = [
        (1, "http://a/ü?q=1", "<p>one</p>" * 20), (5, "http://a/5", same), (3, None, same), (4, "http://b/\r\nX: y", same), (6, "", near), (7, "http://a/7", near), (8, "http://a/8", None),
        (None, "http://n", same), (3, "http://again", same), (9, "http://long", "é" * 300_000), (10, "http://odd", "a\r\n\r\n\x00b" * 30), (11, "http://hundred", "y" * 100), (12, "http://hundred", "y" * 100),
    ]
    return rows, spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, place int, digest string").repartition(3)


def test_archives_give_pages_back(spark):
    rows, table = pages(spark)
    found = warc.stored(table, file_bytes=2_000).collect()
    assert len(found) == len(rows)
    assert all(r["problem"] is None for r in found)
    assert sorted((r["key"] or 0, r["url"] or "") for r in found) == sorted((k or 0, u or "") for k, u, _ in rows)
    by_payload = defaultdict(list)
    for key, url, html in rows:
        by_payload[html or ""].append((key is None, key or 0, url or ""))
    ids = {r["record_id"]: r for r in found}
    assert len(ids) == len(rows)
    for r in found:
        html = next(h or "" for k, u, h in rows if (k, u) == (r["key"], r["url"]))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        group = by_payload[html]
        if r["record_type"] == "response":
            assert r["payload"] == html.encode() and r["refers_to_key"] is None
            assert len(html.encode()) < 100 or r["key"] == min(group)[1]
        else:
            assert len(group) > 1 and len(html.encode()) >= 100
            assert r["refers_to_key"] == min(group)[1] and r["payload"] is None
            assert ids[r["refers_to"]]["record_type"] == "response" and ids[r["refers_to"]]["key"] == r["refers_to_key"]
    assert Counter(r["record_type"] for r in found) == {"response": len(rows) - 5, "revisit": 5}
    for path in {r["path"] for r in found}:  # each file is a run of plain gzip members
        text = gzip.decompress(open(path.removeprefix("file:"), "rb").read())
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_listed_files_are_those_written(spark, tmp_path):
    _, table = pages(spark)
    files = warc.write(table, str(tmp_path / "w"), file_bytes=1)
    assert sum(r["records"] for r in files.collect()) == table.count() == files.count()
    seen = {r["path"].removeprefix("file:").replace("///", "/"): r["bytes"] for r in warc.listed(spark, str(tmp_path / "w")).collect()}
    assert seen == {r["path"]: r["bytes"] for r in files.collect()}
    assert warc.read(warc.listed(spark, str(tmp_path / "w"))).where("problem is null").count() == table.count()


def test_archives_of_nothing(spark):
    table = pages(spark)[1].limit(0)
    assert warc.stored(table).collect() == []


def test_damaged_archives_are_told(tmp_path):
    one = lambda n: warc.record("", f"http://a/{n}", b"body %d" % n * 50, len(b"body %d" % n * 50), hashlib.sha256(b"body %d" % n * 50).hexdigest(), f"<urn:x:{n}>", None)
    good = [one(n) for n in range(3)]
    path = str(tmp_path / "a.warc.gz")

    def problems(data: bytes, piece: int) -> list:
        open(path, "wb").write(data)
        return [r["problem"] for r in warc.records(path, piece=piece)]

    wrong = warc.member([("WARC-Type", "resource"), ("WARC-Block-Digest", "sha256:00")], b"text")
    long = gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    framed = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\n")
    for piece in (1, 7, 1 << 18):
        assert problems(b"".join(good), piece) == [None] * 3
        assert problems(b"", piece) == []
        assert problems(good[0] + wrong + good[1], piece) == [None, "digest", None]
        assert problems(good[0] + long + good[1], piece) == [None, "cut off", None]
        assert problems(framed + good[1], piece) == ["framing", None]
        assert problems(gzip.compress(b"no record at all\r\n\r\n" * 50) + good[1], piece) == ["framing", None]
        assert problems(good[0] + good[1][:-20], piece) == [None, "cut off"]
        assert problems(good[0] + b"not gzip" + good[1], piece) == [None, "broken member: the rest of the file is left out"]
    offsets = [r["offset"] for r in warc.records(path)]
    assert offsets[0] == 0 and zlib.decompressobj(31).decompress(open(path, "rb").read())


# ---- conversations ---------------------------------------------------------------------------


def brute_edits(kinds: list[int]) -> tuple[int, str]:
    """Cheapest and then ASCII-least edits, keeping the whole audit of each state; kinds as in dialogue.ways."""
    legal = {0: "su", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    best = {0: (0, "")}
    for i, kind in enumerate([*kinds, None]):
        for _ in range(2):  # insertions before the row
            for s, (c, w) in list(best.items()):
                t = after[[x for x in legal[s] if x != "s"][0]]
                best[t] = min(best.get(t, (10**9, "")), (c + 2, w + "I"))
        if kind is None:
            break
        new: dict = {}
        for s, (c, w) in best.items():
            options = [(s, 3, "D")]
            if kind < 8:
                initial, cut = "?sua"[kind // 2], kind % 2
                options += [(after[x], 2 + cut, "R") for x in legal[s] if x != "s"]
                options += [(after[initial], cut, "K")] if initial in legal[s] else []
            for t, cost, letter in options:
                new[t] = min(new.get(t, (10**9, "")), (c + cost, w + letter))
        best = new
    return min(best[s] for s in (0, 3) if s in best)


def test_repair_equals_brute_force():
    rng = random.Random(1)
    for n in range(400):
        kinds = [rng.choice((0, 1, 2, 3, 4, 5, 6, 7, 8, 4, 6)) for _ in range(rng.randint(0, 14) if n < 380 else 300)]
        assert dialogue.repair_kinds(kinds) == brute_edits(kinds), kinds


def test_summaries_of_pieces_give_the_same_repair():
    rng = random.Random(2)
    for _ in range(60):
        kinds = [rng.randint(0, 8) for _ in range(rng.randint(1, 40))]
        cut = [kinds[i : i + 4] for i in range(0, len(kinds), 4)]
        nodes = [dialogue.summed(c) for c in cut]
        cost, last = dialogue.best_exit(dialogue.summed(nodes))
        at = dialogue.crossings(nodes, 0, last)
        audit = "".join("".join(dialogue.edits_between(c, dialogue.crossings(c, a, b))) for c, a, b in zip(cut, at, at[1:], strict=False))
        assert (cost, audit + dialogue.ENDINGS[last]) == brute_edits(kinds)


def brute_conversations(rows: list[tuple]) -> dict:
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if harm == 0:
                continue
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            kept += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in kept if t is not None]
        seen, kinds, faults = set(), [], Counter()
        for _, role, text in kept:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            kinds.append(8 if fault in ("blank", "duplicate") else 2 * max("?sua".find(role[:1]) if role else 0, 0) + (fault == "truncated"))
        cost, audit = brute_edits(kinds)
        lines, state, i = [], 0, 0
        for letter in audit:
            follow = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            name = {2: "user", 3: "assistant"}[follow]
            if letter == "I":
                lines.append(f"{name}:")
                state = follow
                continue
            _, role, text = kept[i]
            i += 1
            if letter == "K":
                lines.append(f"{role}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            elif letter == "R":
                lines.append(f"{name}:{text}")
                state = follow
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:], strict=False)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversation_rows() -> list[tuple]:
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Assistant", "s", "a"]
    texts = ["Hello.", "What now?", "Yes!", "cut off", "", " \t\n", None, "Dots. \n", "long " * 3000 + "end.", "ünï!", "Hello."]
    rows = []
    for c in range(40):
        turn = 0
        for _ in range(rng.randint(1, 9)):
            turn += rng.choice((1, 1, 1, 3))
            rows.append((c, turn, rng.choice(roles[: rng.choice((2, 3, 11))]), rng.choice(texts[: rng.choice((4, 11))]) if rng.random() < 0.7 else f"Text {rng.random()}."))
    rows += [(100, t, "user" if t % 2 else "assistant", f"Row {t % 37} of many{'.' * (t % 3)}") for t in range(200)]  # a long one, with repeats
    rows += [(None, t, "user", "Nobody's.") for t in range(3)] + [(101, None, "user", "No turn."), (101, 2, "assistant", "Two."), (102, None, None, None)]
    lost = next(c for c in range(200, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (lost, 0, "user", "Is lost.")]


@pytest.mark.parametrize(("piece", "fan"), [(1024, 256), (4, 3)])
def test_conversations_equal_brute_force(spark, monkeypatch, piece, fan):
    monkeypatch.setattr(dialogue, "PIECE", piece)
    monkeypatch.setattr(dialogue, "FAN", fan)
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, nth int, edits string").repartition(3, "turn")
    found = dialogue.damaged_and_repaired(table).collect()
    want = brute_conversations(rows)
    assert len(found) == len(want)
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found}
    assert got == want


def test_repaired_rows_alternate(spark):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    work = dialogue.repair(table)
    by_conv = defaultdict(list)
    for r in work.repaired().orderBy("conv", "nth").collect():
        by_conv[r["conv"]].append(r["role"][0])
    assert by_conv and all(re.fullmatch("s?(ua)+", "".join(v)) for v in by_conv.values())
    assert work.audits().count() == len({r[0] for r in rows})


def test_conversations_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.damaged_and_repaired(table).collect() == []
