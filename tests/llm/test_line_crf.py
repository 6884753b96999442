"""The field against enumeration of all labellings, its slopes against differences, and held-out accuracy."""

from itertools import product

import numpy as np
import pytest

from quarryline.llm import line_crf as crf


def chain_terms(scores, link):
    """(labelling, log potential) of every labelling of one chain."""
    for labels in product((0, 1), repeat=len(scores)):
        yield labels, sum(s for s, y in zip(scores, labels) if y) + sum(link[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_marginals_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    lengths = np.array([1, 5, 2, 7, 1, 3])
    scores, link, weight = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, (2, 2)), rng.random(lengths.sum())
    order, starts = crf.chains(lengths)
    p, both, total = crf.marginals(scores, starts, lengths[order], link, weight)
    want_p, want_both, want_total, at = [], np.zeros((2, 2)), [], 0
    for n in lengths:
        terms = list(chain_terms(scores[at : at + n], link))
        z = np.logaddexp.reduce([t for _, t in terms])
        want_total.append(z)
        for i in range(n):
            want_p.append(sum(np.exp(t - z) for y, t in terms if y[i]))
            if i:
                for y, t in terms:
                    want_both[y[i - 1], y[i]] += weight[at + i] * np.exp(t - z)
        at += n
    assert np.allclose(p, want_p) and np.allclose(both, want_both) and np.allclose(total, np.array(want_total)[order])


def test_slopes_by_differences():
    rng = np.random.default_rng(9)
    lengths = np.array([3, 1, 6, 2])
    x, gold = rng.normal(size=(lengths.sum(), 4)), np.repeat(np.array([1.0, 0.0, 0.0, 1.0]), lengths)
    w, link, eps = rng.normal(size=4), rng.normal(size=(2, 2)), 1e-6
    value = lambda w, link: crf.objective(w, link, x, gold, lengths)[0]
    _, by_w, by_link = crf.objective(w, link, x, gold, lengths)
    for i in range(4):
        step = np.eye(4)[i] * eps
        assert np.isclose(by_w[i], (value(w + step, link) - value(w - step, link)) / (2 * eps), atol=1e-6)
    for i in np.ndindex(2, 2):
        step = np.zeros((2, 2))
        step[i] = eps
        assert np.isclose(by_link[i], (value(w, link + step) - value(w, link - step)) / (2 * eps), atol=1e-6)


def test_the_objective_is_the_mean_likelihood_of_documents():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 2])
    x, gold, w, link = rng.normal(size=(6, 3)), np.array([1.0] * 4 + [0.0] * 2), rng.normal(size=3), rng.normal(size=(2, 2))
    want, at = 0.0, 0
    for n in lengths:
        scores, label = (x @ w)[at : at + n], tuple(gold[at : at + n].astype(int))
        terms = dict(chain_terms(scores, link))
        want += (terms[label] - np.logaddexp.reduce(list(terms.values()))) / n / len(lengths)
        at += n
    want -= crf.L2 / 2 * ((w**2).sum() + (link**2).sum())
    assert np.isclose(crf.objective(w, link, x, gold, lengths)[0], want)


def test_fit_climbs():
    docs = [(b"a plain line of words here\nand a second plain line follows", 1), (b"$$$ ### !!! WIN\n%%% $$$ NOW NOW NOW", 0)] * 20
    found = [crf.line_features(t) for t, _ in docs]
    lengths = np.array([len(f) for f, _ in found])
    begins = np.cumsum(lengths) - lengths
    x = crf.with_neighbours(np.concatenate([f for f, _ in found]), begins, begins + lengths - 1)
    gold = np.repeat(np.array([y for _, y in docs], dtype=float), lengths)
    model = crf.fit(docs)
    before = crf.objective(np.zeros_like(model["w"]), np.zeros((2, 2)), x, gold, lengths)[0]
    assert crf.objective(model["w"], model["link"], x, gold, lengths)[0] > before
    scores = crf.score_texts([t for t, _ in docs[:2]], model)
    assert scores[0] > 0.5 > scores[1]


def test_the_sample_is_bounded_by_its_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * 100) for i in range(200)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    whole = crf.training_sample(docs, labels)
    assert len(whole) == len(set(whole)) > 50
    monkeypatch.setattr(crf, "SAMPLE_CHARS", 1500)
    some = crf.training_sample(docs, labels)
    assert some == whole[: len(some)] and 1000 < sum(len(t) for t, _ in some) <= 1500
