"""op4 within its CPU budget."""

from __future__ import annotations

import numpy as np

from newsmill.llm import language_model as lm


def test_logits_are_bounded_where_weights_may_pass_the_cap(monkeypatch):
    """op4: no pass over the logits where weights are too small to reach the cap; where they aren't, scores stay finite."""
    rng = np.random.default_rng(3)
    model = lm.Model(np.sort(rng.integers(1, 900, 200))[::-1].astype(float))
    texts = [rng.integers(1, 200, n).astype(np.int32) for n in (5, 30, 80)]
    want = lm.score_texts(model, texts)
    with monkeypatch.context() as m:
        m.setattr(np, "minimum", None)
        assert (lm.score_texts(model, texts) == want).all()
    model.parts()["Ww"][:, -1] = 200
    assert np.isfinite(lm.score_texts(model, texts)).all()
