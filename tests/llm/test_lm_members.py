import numpy as np

from pairsmith.llm import lm


def test_classes_are_gathered_once_for_all_blocks(monkeypatch):
    """The words of a class are scored together for a whole slice, not block by block; what comes out is the same, and is normalised."""
    rng = np.random.default_rng(2)
    model = lm.LogBilinear(rng.integers(1, 50, 400).astype(float))
    two, one, target = rng.integers(0, 400, (3, 3000))
    whole = model.log10(two, one, target)
    calls, members = [], lm.LogBilinear._members
    monkeypatch.setattr(lm, "BLOCK", 64)
    monkeypatch.setattr(lm.LogBilinear, "_members", lambda self, t: calls.append(len(t)) or members(self, t))
    assert np.allclose(model.log10(two, one, target), whole, atol=1e-5) and calls == [3000]
    every = np.arange(400)
    assert np.isclose((10 ** model.log10(np.full(400, two[0]), np.full(400, one[0]), every)).sum(), 1, atol=1e-4)
