import random

import numpy as np
import pytest

from flowsieve.llm import quality as q

from . import brute


def test_counts_and_base_rules(docs, docs_rows):
    got = {r.doc_id: r for r in q.quality(docs, least_reference=50).collect()}
    for i, t in docs_rows:
        n, chars, symbols, dup, rep = brute.quality_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)


def test_references_are_exact(spark, docs, docs_rows):
    from collections import Counter

    ref = q.references(docs, common=20, least=50)
    assert set(ref) == {"de", "en"}
    for lang, k in (("en", 1), ("de", 2)):
        c = Counter(w for i, t in docs_rows if i % 3 == k for w in brute.words(t, True))
        n = sum(c.values())
        assert sorted(np.round(ref[lang]["words"][:-1] * n).astype(int).tolist(), reverse=True) == sorted(c.values(), reverse=True)[:20]
        assert abs(ref[lang]["classes"].sum() - 1) < 1e-12


def test_distance():
    p = np.array([[0.5, 0.5, 0], [1, 0, 0], [0, 0, 1]])
    d = q.distance(p, np.array([0.5, 0.5, 0]))
    assert d[0] == 0 and d[2] == 1 and 0 < d[1] < 1


def test_odd_texts_go_and_clean_ones_stay(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.quality(docs, least_reference=500).join(labels, "doc_id").where("not base_failed and n_words >= 80").collect()
    good, bad = ([r.kept for r in rows if r.quality == x] for x in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.35 * len(bad) + 1


def test_nulls_repeats_and_nothing(odd_ids, empty):
    assert q.quality(odd_ids).count() == 28
    assert q.quality(empty).count() == 0


def prose(rng, letters, n=150):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    return lambda: " ".join(words[int(60 * rng.random() ** 2)] for _ in range(n))


LETTERS = {"en": "abcdefghij", "ru": "абвгдежзик", "ja": "あいうえおかきく", None: "αβγδεζηθ"}


@pytest.mark.parametrize("most", [256, 1])
@pytest.mark.parametrize("few", [1, 3, 50])
def test_a_small_language_has_its_own_reference(spark, monkeypatch, most, few):
    monkeypatch.setattr(q, "MAX_LANGUAGES", most)
    rng = random.Random(3)
    rows = []
    for lang, letters in LETTERS.items():
        text = prose(rng, letters)
        rows += [(len(rows) + i, text(), lang) for i in range(200 if lang == "en" else few)]
    rows.append((len(rows), prose(rng, "#$%&*<>|", 150)(), "en"))
    got = {r.doc_id: r for r in q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert len(got) == len(rows)
    assert [i for i, _, _ in rows if not got[i].kept] == [len(rows) - 1]
    assert all(r.class_distance < 0.25 for i, r in got.items() if i < len(rows) - 1)


def test_odd_text_of_a_small_language_goes(spark, monkeypatch):
    rng = random.Random(4)
    text, odd = prose(rng, LETTERS["ru"]), prose(rng, "#$%&*<>|")
    rows = [(i, text(), "ru") for i in range(40)] + [(40, odd(), "ru")] + [(41 + i, prose(rng, LETTERS["en"])(), "en") for i in range(100)]
    for most in (256, 1):
        monkeypatch.setattr(q, "MAX_LANGUAGES", most)
        kept = {r.doc_id: r.kept for r in q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id <= 40").collect()}
        assert [i for i, k in kept.items() if not k] == [40]


def crowd(most=8):
    """Documents of `most` languages, each with its own words, and documents without a language: of each of their words, odd ones and a text without words."""
    rng = random.Random(5)
    texts = {f"l{i}": prose(rng, rng.sample("abcdefghijklmnopqrstuvwxyz", 7)) for i in range(most)}
    rows = [(text(), lang) for lang, text in texts.items() for _ in range(30)]
    rows += [(text(), None) for text in texts.values()] + [(prose(rng, "#$%&*<>|")(), None), (prose(rng, "ㄱㄴㄷㄹㅁ")(), None), (" ", None), (texts["l0"]() + " " + texts["l1"](), None)]
    return [(i, t, lang) for i, (t, lang) in enumerate(rows)]


@pytest.mark.parametrize("most", [1, 3])
def test_documents_without_a_language_are_held_against_every_reference(spark, monkeypatch, most):
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(q, "COMMON", 1_000_000)
    plain = {r.doc_id: r for r in q.quality(docs).collect()}
    monkeypatch.setattr(q, "MAX_LANGUAGES", most)
    got = {r.doc_id: r for r in q.quality(docs).collect()}
    assert got == plain
    want = brute.quality_verdicts(rows)
    assert {i: r.kept for i, r in got.items()} == want
    odd = [i for i, _, lang in rows if lang is None and not want[i]]
    assert len(odd) >= 2 and any(got[i].n_words >= 80 and not got[i].base_failed for i in odd)


def test_kept_rows_do_not_depend_on_how_many_references_are_held(spark, monkeypatch):
    from flowsieve.llm import stages

    docs = spark.createDataFrame([(i, t, lang, i) for i, t, lang in crowd()], "doc_id long, text string, lang string, n long").repartition(3)
    want = sorted(stages.quality_stage(docs).collect(), key=lambda r: r.n)
    assert 2 <= docs.count() - len(want) < 10
    for most in (1, 3):
        monkeypatch.setattr(q, "MAX_LANGUAGES", most)
        assert sorted(stages.quality_stage(docs).collect(), key=lambda r: r.n) == want


def test_one_language_more_than_are_held_changes_no_other_row(spark):
    from flowsieve.llm import stages

    rows = crowd()
    rows += [(len(rows) + i, f"{i}a {i}b", f"m{i}") for i in range(q.MAX_LANGUAGES - 8)]

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
        return sorted(r.doc_id for r in stages.quality_stage(docs).collect())

    few = kept(rows)
    assert sum(1 for i, t, lang in rows if lang is None and len(t.split()) >= 80 and i not in few) >= 2
    assert kept([*rows, (len(rows), "one more", "one")]) == few


@pytest.mark.parametrize("most", [1, 256])
def test_a_document_without_a_language_may_share_no_word_with_a_reference(spark, monkeypatch, most):
    monkeypatch.setattr(q, "MAX_LANGUAGES", most)
    rng = random.Random(6)
    rows = [(text(), lang) for lang, text in (("en", prose(rng, LETTERS["en"])), ("ru", prose(rng, LETTERS["ru"]))) for i in range(8)]
    rows += [(" ".join(f"c{j} c{j}" for j in range(q.COMMON)), None), (" ".join(f"r{j}" for j in range(90)), None)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(rows)]
    alone = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in q.quality(alone).collect()}
    assert len(got) == len(rows) and got[len(rows) - 1].n_words == 90 and 0 < got[len(rows) - 1].word_distance <= 1
    assert {i: r.kept for i, r in got.items()} == brute.quality_verdicts(rows)
