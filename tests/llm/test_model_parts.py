"""Parts of the language model: one look-up per word, and chances without the greatest logit taken off."""

import numpy as np

from emberwatch.llm import maxent

SHAPE = maxent.Shape(classes=2, members=3, rare=2, class_rows=16, member_rows=16)


def test_one_look_up_gives_symbol_and_number():
    frequent = [(maxent.END, 9), (b"a", 5), (b"b", 4), (b"c", 3), (b"d", 2), (b"e", 2)]
    symbols, use, numbers = maxent.Vocabulary(SHAPE, frequent, [b"pq", b"r"]).tokens([[b"a", b"pq", b"zz"], [], [b"r", b"e"]])
    assert numbers[use].tolist() == [1, 6, -1, 0, 0, 7, 5, 0]
    rare = [6 + w[-1] % 2 for w in (b"pq", b"zz", b"r")]
    assert symbols[use].tolist() == [1, rare[0], rare[1], 0, 0, rare[2], 5, 0]
    assert (symbols[~use] == 0).all() and (~use).sum() == 9


def test_logits_beyond_the_range_of_exp():
    """Rows of weights by which plain exp would be 0 or infinite, beside usual ones."""
    rng = np.random.default_rng(2)
    for size in (1, 200):
        weights = maxent.Weights(SHAPE, rng.normal(size=4), rng.normal(size=(2, 3)))
        weights.tables = [(size * rng.normal(size=t.shape)).astype(np.float32) for t in weights.tables]
        rows, column = rng.integers(0, 16, (4, 50)), rng.integers(0, 4, 50)
        out, more = np.empty((50, 4), np.float32), np.empty((50, 4), np.float32)
        sums, right = weights.exps(0, rows, weights.class_bias[None], out, more, column)
        logits = weights.tables[0].astype(float)[rows].sum(0) + weights.class_bias
        top = logits.max(1)
        want = logits[np.arange(50), column] - top - np.log(np.exp(logits - top[:, None]).sum(1))
        assert np.allclose(right - np.log(sums), want, rtol=1e-4, atol=1e-3)
