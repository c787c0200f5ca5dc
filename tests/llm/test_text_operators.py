"""Language, quality, licences, language model, ids, rules: against brute force, and on odd input."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import docstats, language, licences, ngrams, pieces, quality, rules
from tidemark.llm import textbytes as tb
from tidemark.llm.queries import in_fold

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hashes_do_not_depend_on_segments(monkeypatch):
    data = np.frombuffer(("ab cd\n" * 300 + "x" * 777 + "\n").encode(), np.uint8)
    starts, ends = tb.spans(data, tb.NOT_SPACE)
    whole = tb.hashes(data, starts, ends)
    monkeypatch.setattr(tb, "SEGMENT", 64)
    tb._powers.cache_clear()
    assert (tb.hashes(data, starts, ends) == whole).all()
    assert len(set(whole.tolist())) == 3
    assert (tb.per_row(data, np.array([0, 6, len(data)]), tb.SPACE, tb.NOT_SPACE) == [[2, len(data) - 6 - 777 - 299 * 4], [4, 777 + 299 * 4]]).all()
    monkeypatch.undo()
    tb._powers.cache_clear()


def phrases(text: str, other: str) -> int:
    """Cross-parsing by search: longest matches of text in other."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in other:
            size += 1
        n, at = n + 1, at + size
    return n


def test_cross_parsing_counts_longest_matches():
    model = language.Model([("x", ["abcab cabd abba"]), ("y", ["ddd dcd ccd"])])
    for text in ("abcabd", "dcdccd abba", "zzz"):
        data = np.frombuffer(text.encode() + b"\n", np.uint8)
        bits, n = model.entropies(data, np.array([0, len(data)]))
        for k, learned in enumerate(("\x00abcab\x00cabd\x00abba\x00"[1:], "ddd\x00dcd\x00ccd\x00")):
            plain = text.replace(" ", "\x00") + "\x00"
            lead = learned if "\x00" not in learned else learned
            # a text begins after a gap, which counts with its first phrase
            expected = phrases("\x00" + plain, lead)
            assert round(bits[k, 0] * len(plain) / model.bits[k]) == expected, (text, k)
        assert n[0] == sum(c != " " for c in text)


def test_languages_are_told_apart(spark, odd, odd_rows, empty):
    model = language.fit(odd.where(~in_fold(5, 0)))
    found = odd.select("doc_id", "lang", "n_chars", language.predict(spark, model, F.col("text")).alias("a")).select("*", "a.*")
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    prose = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 90]
    assert sum(r["lang"] == r["lang_pred"] for r in prose) >= len(prose) - 1
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (100, 101, 102, 105)) and 0 <= r["score"] <= 1
    nothing = language.fit(empty)
    assert {r[0]["lang_pred"] for r in odd.select(language.predict(spark, nothing, F.col("text"))).collect()} == {"und"}
    assert empty.select(language.predict(spark, model, F.col("text"))).count() == 0


def test_statistics_by_brute_force(odd_rows):
    texts = [r[1] for r in odd_rows] + ["a b c d e f a b c d e\nx y\nx y\n\n\nx y ", "q\nq\n q"]
    got = np.concatenate([docstats.measure(data, offsets)[0] for _, _, data, offsets in tb.blocks(pa.array(texts), 2000)])
    for x, row in zip(texts, got, strict=True):
        w = SPACED.findall(x or "")
        lines = [line for line in (x or "").split("\n") if SPACED.search(line)]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = dict(zip(docstats.NAMES, row.tolist(), strict=True))
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"], r["n_distinct_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered), len(set(w)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in x or "")


def test_weak_labels_find_the_worse_class():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    v = np.zeros((4000, len(quality.LABELLERS)), int)
    right = np.linspace(0.75, 0.97, v.shape[1])
    for j, p in enumerate(right):
        says = np.where(rng.random(4000) < p, truth, ~truth)
        v[:, j] = np.where(rng.random(4000) < 0.3, quality.NONE, np.where(says, quality.GOOD, quality.BAD))
    patterns, counts = np.unique(quality.pattern_of(v), return_counts=True)
    assert (quality.votes_of(patterns) == np.unique(v[:, ::-1], axis=0)[:, ::-1]).all()
    model = quality.estimate(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - right).max() < 0.06 and abs(model.share - 0.8) < 0.05
    assert ((model.posterior(quality.pattern_of(v)) > 0.5) == truth).mean() > 0.93


def test_quality_scores(spark, odd, odd_rows, empty):
    labels, scorer = quality.fit(odd)
    rows = odd.select("doc_id", quality.score(spark, scorer, F.col("text")).alias("a")).select("doc_id", "a.*").collect()
    assert len(rows) == len(odd_rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[105] < scorer.threshold and all(score[i] >= scorer.threshold for i in range(90))
    assert len({r["score"] for r in rows if r["doc_id"] == 106}) == 1
    _, untrained = quality.fit(empty)
    assert empty.select(quality.score(spark, untrained, F.col("text"))).count() == 0


def test_licences_by_brute_force(spark, odd, odd_rows, empty):
    got = {r["key"]: r for r in licences.scan(odd).collect()}
    assert licences.scan(odd).count() == len(odd_rows) and licences.scan(empty).count() == 0
    for doc_id, text, *_ in odd_rows:
        w = ALNUM.findall(lower(text))
        places, labels = [], set()
        for phrase, label in licences.BASE.items():
            p = phrase.split()
            hit = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hit
            labels |= {label} if hit else set()
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(","))


def test_licence_spans_survive_edits(spark):
    (label, text) = licences.TEMPLATES[0]
    words = text.split()
    edited = words[:10] + ["really", "very"] + words[10:20] + words[22:]
    rows = [(1, "x " * 50 + " ".join(edited) + " y" * 9), (2, " ".join(words[:8])), (3, "All rights\nreserved, all rights. reserved")]
    got = {r["key"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == label and 0.5 < got[1]["score"] < 1 and got[1]["n_spans"] == 1
    assert got[2]["labels"] == "" and got[2]["score"] == 0
    assert got[3]["labels"] == "all-rights-reserved" and got[3]["n_spans"] == 2


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_language_model_by_brute_force(request, odd_rows, which):
    df = request.getfixturevalue(which)
    got = ngrams.score(df, in_fold(7, 2)).collect()
    rows = odd_rows if which == "odd" else []
    assert len(got) == len(rows)
    held = lambda doc_id: zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2
    toks = [[*SPACED.findall(lower(r[1])), None] for r in rows]
    learned = [t for t, r in zip(toks, rows, strict=True) if not held(r[0])]
    one, two = Counter(w for t in learned for w in t), Counter(p for t in learned for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    expected = sorted((r[0] or -1, held(r[0]), len(t), sum(one[w] > 0 for w in t), n, round(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), 6)) for t, r in zip(toks, rows, strict=True))
    assert sorted((r["key"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    by_key = {r["key"]: r["score"] for r in got}
    mixture = None
    for t, r in zip(toks, rows, strict=True):
        words = np.array([one[w] for w in t])
        pairs = np.array([two[p] for p in zip(["<s>", *t], t, strict=False)])
        if mixture is None:
            cells = [ngrams.cells_of(*(np.array(x) for x in zip(*[(one[b], two[a, b], len(learned) if a == "<s>" else one[a]) for a, b in zip(["<s>", *u], u, strict=False)], strict=True))) for u in learned]
            ids, counts = np.unique(np.concatenate(cells), return_counts=True)
            mixture = ngrams.Mixture(ids, counts.astype(float), n, v)
        assert abs(mixture.scores(words, pairs, len(learned))[1] - by_key[r[0]]) < 1e-6 * max(1, abs(by_key[r[0]]))


def test_mixture_is_a_distribution():
    mixture = ngrams.Mixture(ngrams.cells_of(np.array([3, 1, 9]), np.array([2, 1, 4]), np.array([8, 2, 9])), np.ones(3), 100, 20)
    assert np.allclose(mixture.weights.sum(1), 1) and (mixture.weights[:, 2] > 0).all()
    for x in (0, 5, 15, 16, 17, 1000, 10**9):
        assert abs(ngrams.ungrid(ngrams.grid(np.array([x])))[0] - x) <= 0.05 * x
    big = np.array([0, 3, 1 << 40], np.uint64)
    assert (ngrams.unpack(ngrams.pack(big)) == big).all() and (ngrams.unpack_sorted(ngrams.pack_sorted(big)) == big).all()
    assert len(ngrams.unpack(ngrams.pack(big[:0]))) == 0


def test_ids_are_the_best_path_and_come_back(spark, odd, odd_rows, empty):
    automaton = pieces.Automaton(pieces.Pieces())
    scores = automaton.pieces.scores
    index = {x: i for i, (x, ok) in enumerate(zip(automaton.pieces.names, automaton.pieces.usable, strict=True)) if ok}

    def best(text):  # over the whole text, without cuts or automaton
        marked = (pieces.MARK + text.replace(pieces.MARK, pieces.OWN_MARK).replace(" ", pieces.MARK)) if text else ""
        top = [0.0] + [-1e300] * len(marked)
        for i in range(1, len(marked) + 1):
            for j in range(max(0, i - 48), i):
                if (k := index.get(marked[j:i])) is not None:
                    top[i] = max(top[i], top[j] + scores[k])
            if marked[i - 1] not in index:
                top[i] = max(top[i], top[i - 1] + automaton.unknown_score)
        return top[-1]

    texts = [(r[1] or "")[:400] for r in odd_rows] + ["\n", "  ", " a", "a ", "x\n y  z\n\n"]
    ids, sizes = automaton.encode(texts)
    at = 0
    for x, n in zip(texts, sizes.tolist(), strict=True):
        mine = ids[at : at + n].tolist()
        at += n
        spelt = [i for i in mine if i in set(automaton.pieces.bytes_of.values())]
        value = sum(scores[i] for i in mine if i not in set(spelt)) + automaton.unknown_score * sum(c not in index for c in x.replace(" ", pieces.MARK).replace(pieces.MARK, pieces.OWN_MARK if pieces.MARK in x else pieces.MARK))
        if pieces.MARK not in x:
            assert abs(value - best(x)) < 1e-6 * max(1, abs(value)), x
    back = odd.select("text", pieces.decode(spark, pieces.encode(spark, "text")).alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in back) and len(back) == len(odd_rows)
    both = odd.select(pieces.encode_and_compare(spark, "text").alias("c"), pieces.encode(spark, "text").alias("ids")).collect()
    assert all(r["c"]["round_trip"] and r["c"]["ids"] == r["ids"] for r in both)
    assert empty.select(pieces.encode(spark, "text")).count() == 0


def test_isolation_forest_isolates_outliers():
    rng = np.random.default_rng(3)
    usual, far = rng.normal(size=(3000, len(rules.FEATURES))), rng.normal(size=(20, len(rules.FEATURES))) + 8
    forest = rules.grow(np.concatenate([usual, far]))
    assert forest.scores(far).min() > np.quantile(forest.scores(usual), 0.995)
    one = rules.grow(np.zeros((5, len(rules.FEATURES))))
    assert len(set(one.scores(usual[:5]).round(9))) == 1 and rules.grow(np.empty((0, len(rules.FEATURES)))).scores(usual[:2]).shape == (2,)


def test_rules(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)] + [(105, 0, 0), (105, 0, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = rules.judge(odd, labels).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert sum(r["kept"] for r in rows if r["key"] is not None and r["key"] < 90) >= 88
    assert rules.judge(empty, labels.limit(0)).count() == 0
