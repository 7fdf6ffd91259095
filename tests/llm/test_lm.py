import math

import numpy as np

from flowsieve.llm import lm

from . import brute


def test_base_score_and_better_model(docs, docs_rows):
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    want = brute.base_scores(docs_rows)
    assert len(got) == len(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_are_the_likeliest():
    rng = np.random.default_rng(1)
    f2, f1, f0 = rng.random(500) * (rng.random(500) < 0.4), rng.random(500) / 10 * (rng.random(500) < 0.8), 1e-3
    n, level = rng.integers(1, 50, 500).astype(float), np.ones(500, int)
    best = lm.learn(level, f2, f1, f0, n)[1]
    like = lambda a: (n * np.log(a[0] * f2 + a[1] * f1 + a[2] * f0)).sum()
    assert abs(best.sum() - 1) < 1e-9
    for i in range(3):
        for j in range(3):
            other = best.copy()
            step = min(0.01, max(other[j] - 1e-6, 0))
            other[i] += step
            other[j] -= step
            assert like(best) >= like(np.maximum(other, 1e-12)) - 1e-4


def test_all_held_out_or_none(spark):
    """Without documents held out weights are equal; without training documents every word is unknown."""
    held = [i for i in range(60) if brute.base_scores([(i, "")])[i][0]]
    rest = [i for i in range(60) if i not in held]
    for ids in (held, rest):
        rows = lm.score(spark.createDataFrame([(i, "a b a") for i in ids], "doc_id long, text string")).collect()
        assert len(rows) == len(ids) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
        assert all(r.n_known == (0 if ids is held else 4) for r in rows)


def test_nulls_repeats_and_nothing(odd_ids, empty):
    rows = lm.score(odd_ids).collect()
    assert len(rows) == 28 and not next(r for r in rows if r.doc_id is None).held_out
    assert lm.score(empty).count() == 0
