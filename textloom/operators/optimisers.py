"""Steps of a model (a dictionary of arrays) along a gradient, in place; ``state`` holds what a rule remembers and begins empty."""

from __future__ import annotations

import numpy as np

#: Decays and smallest divisors of the published rules (fixed values).
DECAY, ADADELTA_LEAST = 0.95, 1e-6
MOMENTUM, RMSPROP_LEAST = 0.9, 1e-4
ADAM_DECAYS, ADAM_LEAST = (0.1, 0.001), 1e-8

Arrays = dict[str, np.ndarray]


def shortened(g: Arrays, longest: float) -> Arrays:
    """The gradient, or the one of norm ``longest`` in its direction if it is longer; 0 sets no bound."""
    norm = float(np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values())))
    return {k: x * (longest / norm) for k, x in g.items()} if longest and norm > longest else g


def _of(state: dict[str, Arrays], name: str, like: Arrays) -> Arrays:
    if name not in state:
        state[name] = {k: np.zeros(x.shape) for k, x in like.items()}
    return state[name]


def _mix(held: np.ndarray, new: np.ndarray, share: float) -> None:
    held += share * (new - held)


def sgd(m: Arrays, g: Arrays, state: dict, rate: float) -> None:
    for k, x in g.items():
        m[k] -= (rate * x).astype(m[k].dtype)


def adadelta(m: Arrays, g: Arrays, state: dict, rate: float) -> None:
    """The rate is not used: the sizes of past steps set it."""
    slopes, steps = _of(state, "slopes", g), _of(state, "steps", g)
    for k, x in g.items():
        _mix(slopes[k], x * x, 1 - DECAY)
        by = x * np.sqrt((steps[k] + ADADELTA_LEAST) / (slopes[k] + ADADELTA_LEAST))
        _mix(steps[k], by * by, 1 - DECAY)
        m[k] -= by.astype(m[k].dtype)


def rmsprop(m: Arrays, g: Arrays, state: dict, rate: float) -> None:
    """Slopes are divided by their deviation from the running mean, and steps have momentum."""
    means, squares, moving = (_of(state, name, g) for name in ("means", "squares", "moving"))
    for k, x in g.items():
        _mix(means[k], x, 1 - DECAY)
        _mix(squares[k], x * x, 1 - DECAY)
        moving[k] *= MOMENTUM
        moving[k] -= rate * x / np.sqrt(squares[k] - means[k] ** 2 + RMSPROP_LEAST)
        m[k] += moving[k].astype(m[k].dtype)


def adam(m: Arrays, g: Arrays, state: dict, rate: float) -> None:
    first, second = _of(state, "first", g), _of(state, "second", g)
    state["n"] = n = state.get("n", 0) + 1
    rate *= np.sqrt(1 - (1 - ADAM_DECAYS[1]) ** n) / (1 - (1 - ADAM_DECAYS[0]) ** n)
    for k, x in g.items():
        _mix(first[k], x, ADAM_DECAYS[0])
        _mix(second[k], x * x, ADAM_DECAYS[1])
        m[k] -= (rate * first[k] / (np.sqrt(second[k]) + ADAM_LEAST)).astype(m[k].dtype)


RULES = {"sgd": sgd, "adadelta": adadelta, "rmsprop": rmsprop, "adam": adam}
