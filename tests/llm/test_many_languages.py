"""Spans with more languages than fit in a byte."""

import numpy as np

from folioflow.llm import language_id


def best_path(scores, penalty):
    """The plain recursion over all pairs of labels."""
    n = scores.shape[1]
    state, back = scores[0].astype(float), []
    for row in scores[1:]:
        step = state[:, None] - penalty * (1 - np.eye(n))
        back.append(step.argmax(0))
        state = step.max(0) + row
    path = [int(state.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_paths_among_300_languages():
    r = np.random.default_rng(4)
    docs = [(r.random((n, 300)) * 4).astype(np.float32) for n in (1, 9, 40, 3)]
    docs.append(np.zeros((0, 300), np.float32))
    for k, found in enumerate(language_id.viterbi(docs, 3.0)):
        want = best_path(docs[k], 3.0) if len(docs[k]) else []
        total = lambda p, k=k: sum(docs[k][i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert len(found) == len(want) and (not want or abs(total(found.tolist()) - total(want)) < 1e-3)
        assert not len(found) or found.min() >= 0


def test_labels_among_140_languages():
    names = [f"l{i:03d}" for i in range(140)]
    scores = np.full((language_id.BUCKETS, 140), -9.0, np.float32)
    word = language_id.trigrams(["wort"])[0]
    scores[word, 139] = -1.0
    model = language_id.Model(names, scores, np.ones((len(language_id.SCRIPT_NAMES), 140), bool))
    labeller = next(c for c in vars(language_id).values() if isinstance(c, type) and hasattr(c, "learn"))(model)
    assert labeller.label(["wort wort wort"])[0][0] == "l139"
