"""A small gated recurrent language model in numpy with a class-factored output softmax.

Symbols 0 .. words - 1 are words, symbol ``END`` among them ends a text and starts the next; the
symbols after them are classes of rare words, which are predicted as classes only.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

END = 0
HIDDEN = 16
WINDOW = 32
#: Streams of texts that advance together while scoring.
LANES = 256
Parameters = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """Number of words, of words in an output class and of rare classes."""

    words: int
    class_size: int
    rare: int

    @property
    def classes(self) -> int:
        return -(-self.words // self.class_size)


def initial(shape: Shape, frequency: np.ndarray, seed: int = 3) -> Parameters:
    """Small random weights; output biases are the log frequencies of the symbols."""
    random = np.random.default_rng(seed)
    share = np.log((frequency + 0.5) / (frequency + 0.5).sum())
    padded = np.full(shape.classes * shape.class_size, -30.0)
    padded[: shape.words] = share[: shape.words]
    by_class = padded.reshape(shape.classes, shape.class_size)
    total = np.log(np.exp(by_class).sum(axis=1))
    out = {
        "inputs": 0.1 * random.standard_normal((shape.words + shape.rare, 3 * HIDDEN)),
        "gates": random.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN),
        "bias": np.zeros(3 * HIDDEN),
        "class_weights": 0.05 * random.standard_normal((HIDDEN, shape.classes + shape.rare)),
        "class_bias": np.concatenate((total, share[shape.words :])),
        "word_weights": 0.05 * random.standard_normal((shape.classes, HIDDEN, shape.class_size)),
        "word_bias": by_class - total[:, None],
    }
    return {name: value.astype(np.float32) for name, value in out.items()}


def _inputs(p: Parameters, symbols: np.ndarray) -> np.ndarray:
    """What the symbols of a window (steps x lanes) bring to the gates: steps x gates x lanes."""
    steps, lanes = symbols.shape
    rows = p["inputs"][symbols.ravel()] + p["bias"]
    return np.ascontiguousarray(rows.reshape(steps, lanes, -1).transpose(0, 2, 1))


def _step(gates: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state (units x lanes), and what the backward pass needs of this step; ``x`` is overwritten."""
    units = len(h)
    back = gates.T @ h
    both = x[: 2 * units]
    both += back[: 2 * units]
    np.negative(both, out=both)
    np.exp(both, out=both)
    both += 1
    np.reciprocal(both, out=both)
    z, r, n = both[:units], both[units:], x[2 * units :]
    n += r * back[2 * units :]
    np.tanh(n, out=n)
    return n + z * (h - n), z, r, n, back[2 * units :]


def _by_row(states: np.ndarray) -> np.ndarray:
    """States of steps x units x lanes as rows of units."""
    return np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, states.shape[1])


def _large(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether a product with states, which lie between -1 and 1, can be too large for an exponential."""
    return bool((np.abs(weights).sum(axis=-2) + np.abs(bias)).max() > 80)


def _softmax(x: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each row, in the place of the row, and their sums; large rows are shifted."""
    if large:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = states @ weights
    out += bias
    return out


def _output_class(shape: Shape, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The output class of each target, an order by class, and the bounds of the word classes in it."""
    kind = np.where(targets < shape.words, targets // shape.class_size, shape.classes + targets - shape.words)
    order = np.argsort(kind, kind="stable")
    return kind, order, np.searchsorted(kind[order], np.arange(shape.classes + 1))


def log_probability(p: Parameters, shape: Shape, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target symbol after its state (a row)."""
    kind, order, bounds = _output_class(shape, targets)
    large = _large(p["class_weights"], p["class_bias"]), _large(p["word_weights"], p["word_bias"])
    e, total = _softmax(_logits(states, p["class_weights"], p["class_bias"]), large[0])
    out = np.log(e[np.arange(len(targets)), kind] / total).astype(float)
    for k in range(shape.classes):
        some = order[bounds[k] : bounds[k + 1]]
        if len(some):
            e, total = _softmax(_logits(states[some], p["word_weights"][k], p["word_bias"][k]), large[1])
            out[some] += np.log(e[np.arange(len(some)), targets[some] - k * shape.class_size] / total)
    return out


def streams(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to at most ``lanes`` streams of about equal length: the longest first, each to the shortest stream."""
    heap = [(0, lane) for lane in range(max(1, min(lanes, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, lane = heap[0]
        out[lane].append(i)
        heapq.heapreplace(heap, (length + int(lengths[i]), lane))
    return out


def text_scores(p: Parameters, shape: Shape, texts: Sequence[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text's symbols and its end.

    Texts are read one after the other in streams, in windows; the state is carried from window to
    window and starts anew with each text, so the whole text counts.
    """
    out = np.zeros(len(texts))
    if not len(texts):
        return out
    lengths = np.array([len(t) + 1 for t in texts])
    # No stream need be longer than the longest text.
    dealt = streams(lengths, min(LANES, int(lengths.sum() // lengths.max())))
    flat = [np.concatenate([x for i in lane for x in (texts[i], (END,))]).astype(np.int32) for lane in dealt]
    owner = [np.repeat(lane, [len(texts[i]) + 1 for i in lane]) for lane in dealt]
    steps = max(map(len, flat))
    symbols, owners = np.full((steps, len(flat)), END, np.int32), np.full((steps, len(flat)), -1, np.int32)
    for lane, (own, whose) in enumerate(zip(flat, owner, strict=True)):
        symbols[: len(own), lane], owners[: len(own), lane] = own, whose
    h = np.zeros((p["gates"].shape[0], len(flat)), p["gates"].dtype)
    for start in range(0, steps, WINDOW):
        part = slice(start, min(steps, start + WINDOW))
        # Every target is read next; the end of a text opens the following one.
        before = np.vstack((symbols[start - 1] if start else np.full(len(flat), END, np.int32), symbols[part.start : part.stop - 1]))
        fresh = before == END
        x, states = _inputs(p, before), []
        for t in range(part.stop - part.start):
            h = _step(p["gates"], x[t], np.where(fresh[t], h.dtype.type(0), h))[0]
            states.append(h)
        whose = owners[part].ravel()
        live = whose >= 0
        value = log_probability(p, shape, _by_row(np.array(states))[live], symbols[part].ravel()[live])
        out += np.bincount(whose[live], value, len(texts))
    return out


def gradients(p: Parameters, shape: Shape, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, live: np.ndarray | None = None) -> tuple[Parameters, np.ndarray, float]:
    """Mean loss of a window (steps x lanes) and its gradients; ``fresh`` marks steps that start a text.

    The backward pass stops at the window's start; the state after it (units x lanes) is returned.
    Steps that ``live`` leaves out have no loss.
    """
    steps, lanes = inputs.shape
    units = len(h)
    x, kept, states = _inputs(p, inputs), [], []
    for t in range(steps):
        before = np.where(fresh[t], h.dtype.type(0), h)
        h, z, r, n, back = _step(p["gates"], x[t], before)
        kept.append((before, z, r, n, back))
        states.append(h)
    rows, target = _by_row(np.array(states)), targets.ravel()
    weight = np.full(len(target), 1 / len(target), h.dtype) if live is None else live.ravel().astype(h.dtype) / max(1, live.sum())
    kind, order, bounds = _output_class(shape, target)
    place = np.arange(len(target))
    g: Parameters = {"word_weights": np.zeros_like(p["word_weights"]), "word_bias": np.zeros_like(p["word_bias"])}
    large = _large(p["class_weights"], p["class_bias"]), _large(p["word_weights"], p["word_bias"])
    delta, total = _softmax(_logits(rows, p["class_weights"], p["class_bias"]), large[0])
    loss = -float(np.log(delta[place, kind] / total) @ weight)
    delta *= (weight / total)[:, None]
    delta[place, kind] -= weight
    g["class_weights"], g["class_bias"] = rows.T @ delta, delta.sum(axis=0)
    slope = delta @ p["class_weights"].T
    for k in range(shape.classes):
        some = order[bounds[k] : bounds[k + 1]]
        if len(some):
            own, mine = rows[some], weight[some]
            delta, total = _softmax(_logits(own, p["word_weights"][k], p["word_bias"][k]), large[1])
            at = (np.arange(len(some)), target[some] - k * shape.class_size)
            loss -= float(np.log(delta[at] / total) @ mine)
            delta *= (mine / total)[:, None]
            delta[at] -= mine
            g["word_weights"][k], g["word_bias"][k] = own.T @ delta, delta.sum(axis=0)
            slope[some] += delta @ p["word_weights"][k].T
    slope = np.ascontiguousarray(slope.reshape(steps, lanes, units).transpose(0, 2, 1))
    carried = np.zeros_like(h)
    to_input = np.empty((steps, 3 * units, lanes), h.dtype)
    g["gates"] = np.zeros_like(p["gates"])
    to_gates = np.empty((3 * units, lanes), h.dtype)
    for t in reversed(range(steps)):
        before, z, r, n, back = kept[t]
        d = slope[t]
        d += carried
        kz = 1 - z
        dn = d * kz
        to_input[t, :units] = (before - n) * z * dn
        dn *= 1 - n * n
        to_input[t, units : 2 * units] = dn * back * r * (1 - r)
        to_input[t, 2 * units :] = dn
        to_gates[:] = to_input[t]
        to_gates[2 * units :] *= r
        g["gates"] += before @ to_gates.T
        carried = d * z
        carried += p["gates"] @ to_gates
        carried *= ~fresh[t]
    by_gate = np.ascontiguousarray(to_input.transpose(1, 0, 2)).reshape(3 * units, -1)
    g["bias"] = by_gate.sum(axis=1)
    symbols = inputs.ravel()
    g["inputs"] = np.ascontiguousarray(np.array([np.bincount(symbols, row, len(p["inputs"])) for row in by_gate]).T.astype(h.dtype))
    return g, h, loss


def train(p: Parameters, shape: Shape, texts: Sequence[np.ndarray], *, rate: float = 0.004, lanes: int = 48, seed: int = 1) -> tuple[Parameters, int]:
    """One pass of truncated backpropagation with Adam over all texts; the parameters and the symbols seen.

    The texts form one stream that is cut into lanes; the last lane is filled up with steps without loss.
    """
    p = {name: value.copy() for name, value in p.items()}
    if not len(texts):
        return p, 0
    order = np.random.default_rng(seed).permutation(len(texts))
    # Every text is END, its symbols; its targets are the symbols and END.
    goal = np.concatenate([x for i in order for x in (texts[i], (END,))]).astype(np.int32)
    number = len(goal)
    width = max(1, min(lanes, number // WINDOW))
    length = -(-number // width)
    goal = np.concatenate((goal, np.full(width * length - number, END, np.int32)))
    before = np.concatenate(([END], goal[:-1]))
    inputs, targets, fresh, live = (x.reshape(width, length).T for x in (before, goal, before == END, np.arange(len(goal)) < number))
    mean, square = ({name: np.zeros_like(value) for name, value in p.items()} for _ in range(2))
    h = np.zeros((p["gates"].shape[0], width), np.float32)
    windows = -(-length // WINDOW)
    for w in range(windows):
        part = slice(w * WINDOW, (w + 1) * WINDOW)
        g, h, _ = gradients(p, shape, inputs[part], targets[part], fresh[part], h, live[part])
        size = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)))
        step = w + 1
        pace = np.float32(rate * min(1.0, step / 20) * (1 - 0.8 * w / windows) / (1 - 0.9**step))
        root = np.float32(1 / np.sqrt(1 - 0.99**step))
        for name, value in g.items():
            value *= scale
            mean[name] *= np.float32(0.9)
            mean[name] += np.float32(0.1) * value
            value *= value
            square[name] *= np.float32(0.99)
            value *= np.float32(0.01)
            square[name] += value
            np.sqrt(square[name], out=value)
            value *= root
            value += np.float32(1e-7)
            p[name] -= pace * mean[name] / value
    return p, number


def pack(p: Parameters) -> bytes:
    return b"".join(p[name].astype(np.float32).tobytes() for name in sorted(p))


def unpack(data: bytes | np.ndarray, like: Parameters) -> Parameters:
    flat = data if isinstance(data, np.ndarray) else np.frombuffer(data, np.float32)
    out, at = {}, 0
    for name in sorted(like):
        out[name] = flat[at : at + like[name].size].reshape(like[name].shape).astype(np.float32)
        at += like[name].size
    return out
