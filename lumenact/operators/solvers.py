"""Bodies of fits on weighted distinct vectors: numpy on one pattern table (see `patterns.run_fits`).

All take `x` (distinct vectors), `n` (their rows in each class) and `test`, and
return class scores of the test vectors and facts about the fit. A vector with
w rows counts like w equal rows would.
"""

from __future__ import annotations

import numpy as np

TOLERANCE = 1e-4
GRADIENT = 1e-8
MAX_KERNEL = 4_000
MAX_STEPS = 10_000_000
_TINY = 1e-12


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scale_gamma(x: np.ndarray, n: np.ndarray) -> float:
    """1 / (features * variance of all entries), the usual kernel width."""
    w = n.sum(axis=1)
    total = w.sum() * x.shape[1]
    mean = w @ x.sum(axis=1) / total
    variance = w @ (x * x).sum(axis=1) / total - mean ** 2
    return 1.0 / (x.shape[1] * variance) if variance > 0 else 1.0


class Kernel:
    """Rows of a kernel matrix between distinct vectors, all at once where that is small."""

    def __init__(self, x: np.ndarray, gamma: float | None):
        self.x, self.gamma = x, gamma
        self.whole = self.between(x, x) if len(x) <= MAX_KERNEL else None
        self.diagonal = np.ones(len(x)) if gamma is not None else (x * x).sum(axis=1)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Linear, or of the squared distance, which for 0/1 vectors is the Hamming distance."""
        products = a @ b.T
        if self.gamma is None:
            return products
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * products
        return np.exp(-self.gamma * np.maximum(squares, 0.0))

    def row(self, i: int) -> np.ndarray:
        return self.whole[i] if self.whole is not None else self.between(self.x[i:i + 1], self.x)[0]


def two_class_svm(x: np.ndarray, counts: np.ndarray, c: float, gamma: float | None):
    """Soft-margin machine with a free bias: signed dual weights of the vectors, bias, and facts.

    `counts` are the rows of the first and of the second class. The dual has a
    variable for each vector and class, bounded by C times its rows. Each step
    moves the pair that violates optimality most, the second by the gain of the
    move, until no violation exceeds TOLERANCE.
    """
    kernel = Kernel(x, gamma)
    at, side = np.nonzero(counts)
    y = 1.0 - 2.0 * side
    bound = c * counts[at, side]
    alpha, gradient = np.zeros(len(at)), -np.ones(len(at))
    steps = 0
    while steps < MAX_STEPS:
        pull = -y * gradient
        up = np.where(y > 0, alpha < bound, alpha > 0)
        down = np.where(y > 0, alpha > 0, alpha < bound)
        i = int(np.argmax(np.where(up, pull, -np.inf)))
        lowest = np.min(np.where(down, pull, np.inf), initial=np.inf)
        if not up.any() or not down.any() or pull[i] - lowest <= TOLERANCE:
            break
        row_i = kernel.row(at[i])[at]
        bend = np.maximum(kernel.diagonal[at[i]] + kernel.diagonal[at] - 2 * row_i, _TINY)
        gap = pull[i] - pull
        j = int(np.argmax(np.where(down & (gap > 0), gap * gap / bend, -np.inf)))
        row_j = kernel.row(at[j])[at]
        room_i = bound[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else bound[j] - alpha[j]
        move = min(gap[j] / bend[j], room_i, room_j)
        for k, room, sign in ((i, room_i, 1.0), (j, room_j, -1.0)):
            # A variable that reaches its bound lies on it exactly.
            target = alpha[k] + sign * y[k] * move
            alpha[k] = (bound[k] if sign * y[k] > 0 else 0.0) if move == room else target
        gradient += y * move * (row_i - row_j)
        steps += 1
    pull = -y * gradient
    free = (alpha > 0) & (alpha < bound)
    if free.any():
        bias = float(pull[free].mean())
    else:
        up = np.where(y > 0, alpha < bound, alpha > 0)
        down = np.where(y > 0, alpha > 0, alpha < bound)
        bias = float((np.max(np.where(up, pull, -np.inf)) + np.min(np.where(down, pull, np.inf))) / 2)
    weights = np.bincount(at, weights=alpha * y, minlength=len(x))
    # Gradient + 1 is y times the decision without its bias.
    quadratic = float(alpha @ (gradient + 1))
    slack = float(bound @ np.maximum(0.0, 1 - (gradient + 1) - y * bias))
    primal, dual = quadratic / 2 + slack, float(alpha.sum()) - quadratic / 2
    return weights, bias, {"gap": (primal - dual) / max(primal, 1.0), "steps": steps, "n_patterns": len(x),
                           "n_rows": counts.sum()}


def pair_svm(x: np.ndarray, n: np.ndarray, test: np.ndarray, pair: tuple[int, int], c: float, rbf: bool = False):
    """One vote for one class of a pair; the kernel's width comes from all classes' rows, as of the whole table."""
    one, other = pair
    gamma = scale_gamma(x, n) if rbf else None
    own = np.flatnonzero(n[:, [one, other]].any(axis=1))
    votes = np.zeros((len(test), n.shape[1]))
    counts = n[own][:, [one, other]]
    if not counts.any(axis=0).all():
        # A class without rows gets no vote, as it would have no machine.
        votes[:, one if counts[:, 0].any() else other] += float(counts.any())
        return votes, {"gap": 0.0, "steps": 0, "n_patterns": len(own), "n_rows": counts.sum()}
    weights, bias, facts = two_class_svm(x[own], counts, c, gamma)
    used = weights != 0
    decision = Kernel(x[own][used], gamma).between(test, x[own][used]) @ weights[used] + bias
    votes[np.arange(len(test)), np.where(decision > 0, one, other)] = 1.0
    return votes, facts


def logistic(x: np.ndarray, n: np.ndarray, test: np.ndarray, c: float):
    """Multinomial logistic regression, C times the loss plus half the squared weights, bias free: Newton steps."""
    weights, facts = newton_logistic(x, n, c)
    return np.column_stack([test, np.ones(len(test))]) @ weights.T, facts


def newton_logistic(x: np.ndarray, n: np.ndarray, c: float, start: np.ndarray | None = None):
    """Weights (class by feature, bias last) where the gradient per row is below GRADIENT."""
    wide = np.column_stack([x, np.ones(len(x))])
    rows, total = n.sum(axis=1), max(n.sum(), 1.0)
    classes, width = n.shape[1], wide.shape[1]
    decay = np.append(np.ones(width - 1), 0.0) / (c * total)
    weights = np.zeros((classes, width)) if start is None else start.copy()

    def loss(w: np.ndarray) -> float:
        scores = wide @ w.T
        top = scores.max(axis=1, keepdims=True)
        logs = scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
        return float(-(n * logs).sum() / total + (w * w * decay).sum() / 2)

    now = loss(weights)
    for step in range(200):
        p = softmax(wide @ weights.T)
        gradient = (rows[:, None] * p - n).T @ wide / total + weights * decay
        norm = float(np.abs(gradient).max())
        if norm < GRADIENT:
            break
        hessian = np.zeros((classes * width, classes * width))
        for a in range(classes):
            for b in range(a, classes):
                d = rows * p[:, a] * ((a == b) - p[:, b]) / total
                block = (wide * d[:, None]).T @ wide
                hessian[a * width:(a + 1) * width, b * width:(b + 1) * width] = block
                hessian[b * width:(b + 1) * width, a * width:(a + 1) * width] = block.T
        hessian[np.diag_indices_from(hessian)] += np.tile(decay, classes) + 1e-12
        move = np.linalg.lstsq(hessian, gradient.ravel(), rcond=None)[0].reshape(weights.shape)
        rate = 1.0
        while rate > 1e-6 and loss(weights - rate * move) > now - 1e-4 * rate * float((gradient * move).sum()):
            rate /= 2
        weights = weights - rate * move
        after = loss(weights)
        if after >= now and rate <= 1e-6:
            break
        now = after
    return weights, {"gradient": norm, "steps": step, "loss": now, "n_patterns": len(x), "n_rows": rows.sum()}


def bernoulli_bayes(x: np.ndarray, n: np.ndarray, test: np.ndarray, alpha: float = 1.0):
    """Naive Bayes over what fires and what does not, with smoothed shares."""
    per_class = n.sum(axis=0)
    p = (n.T @ x + alpha) / (per_class[:, None] + 2 * alpha)
    with np.errstate(divide="ignore"):
        prior = np.log(per_class / per_class.sum())
    return test @ np.log(p).T + (1 - test) @ np.log1p(-p).T + prior, {
        "n_patterns": len(x), "n_rows": n.sum()}


def forest(x: np.ndarray, n: np.ndarray, test: np.ndarray, trees: range | tuple, seed: int = 42):
    """Sums of class shares over some trees of a forest: bootstrap rows, the square root of the features a split.

    A tree's draws depend on the seed and its own number, not on the task it grows in.
    """
    trees = range(*trees) if isinstance(trees, tuple) else trees
    cells, total = n.ravel(), int(n.sum())
    scores, nodes = np.zeros((len(test), n.shape[1])), 0
    for tree in trees:
        random = np.random.default_rng([seed, tree])
        rows = random.multinomial(total, cells / total).reshape(n.shape).astype(np.float64)
        waiting = [(np.flatnonzero(rows.any(axis=1)), np.arange(len(test)))]
        while waiting:
            own, asked = waiting.pop()
            nodes += 1
            counts = rows[own].sum(axis=0)
            feature = _gini_split(x[own], rows[own], random) if np.count_nonzero(counts) > 1 else None
            if feature is None:
                scores[asked] += counts / counts.sum()
                continue
            right, asked_right = x[own, feature] > 0.5, test[asked, feature] > 0.5
            waiting += [(own[~right], asked[~asked_right]), (own[right], asked[asked_right])]
    return scores, {"nodes": nodes, "n_patterns": len(x), "n_rows": total}


def _gini_split(x: np.ndarray, rows: np.ndarray, random: np.random.Generator) -> int | None:
    """The best 0/1 feature of a random few; more are tried only while none parts the rows."""
    order = random.permutation(x.shape[1])
    fires = x[:, order] > 0.5
    usable = order[fires.any(axis=0) & ~fires.all(axis=0)]
    if not len(usable):
        return None
    tried = max(int(np.sqrt(x.shape[1])), 1)
    few = [f for f in order[:tried] if f in usable] or [usable[0]]
    right = (x[:, few] > 0.5).T.astype(np.float64) @ rows
    left = rows.sum(axis=0) - right
    purity = (right ** 2).sum(axis=1) / right.sum(axis=1) + (left ** 2).sum(axis=1) / left.sum(axis=1)
    return int(few[int(np.argmax(purity))])


def network(
    x: np.ndarray, n: np.ndarray, test: np.ndarray, hidden: tuple = (64,), seed: int = 0, epochs: int = 30,
    batch: int = 512, rate: float = 1e-3, decay: float = 0.01,
):
    """Rectified layers trained by mini-batches with decoupled weight decay; the loss of every epoch is a fact."""
    layers, losses = train_network(x, n, hidden, seed, epochs, batch, rate, decay)
    return forward(layers, test)[-1], {f"loss {i:03d}": loss for i, loss in enumerate(losses)}


def forward(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """Inputs, hidden activations and scores."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        out.append(np.maximum(x, 0.0) if i + 1 < len(layers) else x)
        x = out[-1]
    return out


#: Parameters that one pass of the update goes over: they and their moments stay in a core's cache.
_UPDATED_AT_ONCE = 8192
#: Moments of units that fire no more shrink by a tenth a step, down to numbers that processors are slow with.
#: What is below this changes no parameter; it is set to zero every so many steps.
_NO_MOMENT = 1e-200
_STEPS_A_SWEEP = 256


def _update(values, grads, moments, squares, step, rate, decay, room):
    """One Adam step with decoupled decay, in place."""
    first, second = 1 - 0.9 ** step, np.sqrt(1 - 0.999 ** step)
    for at in range(0, len(values), _UPDATED_AT_ONCE):
        part = slice(at, at + _UPDATED_AT_ONCE)
        value, grad, m, s = values[part], grads[part], moments[part], squares[part]
        a = room[:len(value)]
        np.subtract(grad, m, out=a)
        a *= 0.1
        m += a
        np.multiply(grad, grad, out=a)
        a -= s
        a *= 0.001
        s += a
        np.sqrt(s, out=a)
        a += 1e-8 * second
        np.divide(m, a, out=a)
        a *= rate * second / first
        value *= 1 - rate * decay
        value -= a
    if step % _STEPS_A_SWEEP == 0:
        moments[np.abs(moments) < _NO_MOMENT] = 0.0
        squares[squares < _NO_MOMENT] = 0.0


def _layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases as views of one flat array."""
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def train_network(x, n, hidden, seed, epochs, batch, rate, decay):
    random = np.random.default_rng(seed)
    sizes = [x.shape[1], *hidden, n.shape[1]]
    flat, grads, moments, squares = np.zeros((4, sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))))
    layers, slopes = _layers(flat, sizes), _layers(grads, sizes)
    # Uniform in +-1/sqrt(inputs), weights and biases.
    for a, (w, b) in zip(sizes[:-1], layers, strict=True):
        w[:] = random.uniform(-1, 1, w.shape) / np.sqrt(a)
        b[:] = random.uniform(-1, 1, len(b)) / np.sqrt(a)
    vector, label = np.nonzero(n)
    rows = np.repeat(np.arange(len(vector)), n[vector, label].astype(np.int64))
    room = np.empty(_UPDATED_AT_ONCE)
    losses, step = [], 0
    for _ in range(epochs):
        shuffled = random.permutation(rows)
        parts = []
        for start in range(0, len(shuffled), batch):
            # Equal rows of a batch count together, and equal vectors, which lie side by side, are scored once.
            cells, times = np.unique(shuffled[start:start + batch], return_counts=True)
            at, y, share = vector[cells], label[cells], times / times.sum()
            new = np.diff(at, prepend=-1) != 0
            own = np.cumsum(new) - 1
            seen = forward(layers, x[at[new]])
            p = softmax(seen[-1])
            parts.append(float(-(share * np.log(np.maximum(p[own, y], 1e-300))).sum()))
            back = p * np.bincount(own, weights=share)[:, None]
            back[own, y] -= share
            step += 1
            for i in reversed(range(len(layers))):
                np.matmul(seen[i].T, back, out=slopes[i][0])
                back.sum(axis=0, out=slopes[i][1])
                if i:
                    back = back @ layers[i][0].T
                    back *= seen[i] > 0
            _update(flat, grads, moments, squares, step, rate, decay, room)
        losses.append(float(np.mean(parts)))
    return layers, losses
