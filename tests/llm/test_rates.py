import numpy as np
import pytest

from millrace.llm import mixing


def nnls(a, b):
    """Lawson and Hanson's active sets."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(500):
        g = np.where(on, -1, a.T @ (b - a @ x))
        if g.max() <= 1e-12:
            break
        on[np.argmax(g)] = True
        while True:
            z = np.zeros(len(x))
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if z[on].min() > 0:
                x = z
                break
            bad = on & (z <= 0)
            x = x + np.min(x[bad] / (x[bad] - z[bad])) * (z - x)
            on &= x > 1e-14
            x[~on] = 0
    return x


def blunt(top, mean, size=4000):
    rng = np.random.default_rng(3)
    t = np.minimum(top, rng.exponential(mean, size))
    t[0], g = top, rng.uniform(0.3, 1, size)
    return np.c_[g * (1 - t), (1 - g) * (1 - t), t]


@pytest.mark.parametrize(
    "p,goal",
    [
        (blunt(0.3, 0.04), [0.64, 0.08, 0.28]), (blunt(0.05, 0.01), [0.88, 0.08, 0.04]), (blunt(0.05, 0.01), [0.5, 0.1, 0.4]),
        (blunt(0.9, 0.15)[:, [0, 2]] / blunt(0.9, 0.15)[:, [0, 2]].sum(axis=1, keepdims=True), [0.5, 0.5]), (blunt(0.3, 0.1), [0.0, 0.0, 1.0]),
    ],
)
def test_residual_is_that_of_nnls(p, goal):
    """Blunt posteriors, and targets out of reach (the third and the last)."""
    n = np.random.default_rng(5).integers(1, 5000, len(p)).astype(float)
    goal = np.array(goal)
    steps, left = mixing.solve(lambda *a: mixing.batch_sums(n, p, *a), goal, 100, 1e-7)
    have = (mixing.Mixture(None, steps, None).rates(p) * n) @ p / n.sum()
    a = (p * (n / n.sum())[:, None]).T
    assert np.linalg.norm(have - goal) <= np.linalg.norm(a @ nnls(a, goal) - goal) + 1e-5
    assert np.abs(have - goal - left).max() < 1e-9
