"""A small gated recurrent language model in numpy.

A token is one of the known words or the tail. The output is factored: a softmax over classes of words (the
tail is a class of its own), then one over the words of the class. The gates of the recurrent unit are
    z, r = sigmoid(E[x] + h U),  n = tanh(E[x] + r (h U)),  h' = n + z (h - n).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
CLASSES = 32
CLASS_WORDS = 32
KNOWN = CLASSES * CLASS_WORDS
TAIL = KNOWN
WINDOW = 32
RATE = 0.16
#: Texts side by side in scoring; their states stay in a core's cache.
SCORED_AT_ONCE = 512

_SHAPES = {
    "E": (KNOWN + 1, 3 * HIDDEN),
    "U": (HIDDEN, 3 * HIDDEN),
    "Wc": (HIDDEN, CLASSES + 1),
    "bc": (CLASSES + 1,),
    "Ww": (CLASSES, HIDDEN, CLASS_WORDS),
    "bw": (CLASSES, CLASS_WORDS),
}
SIZE = sum(math.prod(s) for s in _SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def initial(counts: np.ndarray, tail: float) -> np.ndarray:
    """Parameters whose output is the unigram distribution; ``counts`` of the known words, most frequent first."""
    rng = np.random.default_rng(7)
    flat = rng.normal(0, 0.1, SIZE).astype(np.float32)
    p = views(flat)
    p["Wc"][:], p["Ww"][:] = p["Wc"] * 0.1, p["Ww"] * 0.1
    padded = np.zeros(KNOWN)
    padded[: len(counts)] = counts + 1.0
    by_class = padded.reshape(CLASSES, CLASS_WORDS)
    with np.errstate(divide="ignore"):
        p["bw"][:] = np.maximum(np.log(by_class), -60.0)
        p["bc"][:] = np.maximum(np.log(np.append(by_class.sum(axis=1), tail)), -60.0)
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over the first axis, along which numpy sums fastest: ``x`` becomes its exponentials; their sums, and what was taken off before."""
    most = x.max(axis=0)
    x -= most
    np.exp(x, out=x)
    return x.sum(axis=0), most


@dataclass
class Window:
    """Tokens of several texts side by side: what comes in, what is to be predicted, and where texts still run."""

    given: np.ndarray
    wanted: np.ndarray
    runs: np.ndarray


def windows(texts: list[np.ndarray], first: int):
    """Windows over texts sorted by falling length, and how many of the texts each window still has."""
    lengths = np.array([len(t) for t in texts], np.int64)
    tokens = np.concatenate([*texts, np.full(WINDOW, TAIL)]).astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    for start in range(0, int(lengths.max(initial=0)), WINDOW):
        n = int(np.searchsorted(-lengths, -start, side="left"))  # texts longer than start
        at = np.arange(start, min(start + WINDOW, int(lengths[0])))[:, None]
        runs = at < lengths[None, :n]
        # Where a text has ended, the tokens are another's: they are not scored, and no error comes from there.
        wanted = tokens[starts[:n] + at]
        before = np.full(n, first, np.int32) if start == 0 else tokens[starts[:n] + start - 1]
        yield n, Window(np.concatenate([before[None], wanted[:-1]]), wanted, runs)


class Net:
    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.p = views(flat)
        self.squares = np.full(SIZE, 1e-4, np.float32)  # sums for the step sizes (Adagrad)
        self.sum, self.seen = np.zeros(SIZE), 0  # of the parameters after each step, by its tokens

    def _run(self, w: Window, h: np.ndarray, keep: bool):
        """States by step and text, the last ones, and what ``_back`` needs of the steps; inside, a text is a column."""
        u, steps, h = np.ascontiguousarray(self.p["U"].T), [], h.T
        states = np.empty((*w.given.shape, HIDDEN), np.float32)
        for t, given in enumerate(w.given):
            own = np.ascontiguousarray(self.p["E"][given].T)
            back = u @ h
            gates = own[: 2 * HIDDEN]
            gates += back[: 2 * HIDDEN]
            _sigmoid(gates)
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            n = r * back[2 * HIDDEN :]
            n += own[2 * HIDDEN :]
            np.tanh(n, out=n)
            if keep:
                steps.append((h, z, r, n, back[2 * HIDDEN :]))
            h = h - n
            h *= z
            h += n
            states[t] = h.T
        return states, h.T, steps

    def _output(self, states: np.ndarray, wanted: np.ndarray, grads: dict | None):
        """Log probabilities of the wanted tokens; with ``grads``, also what the loss does to the states."""
        p, n = self.p, len(wanted)
        # By class throughout, so that the rows of a class are one slice.
        order = np.argsort((wanted // CLASS_WORDS).astype(np.int8), kind="stable")
        states, wanted = states[order], wanted[order]
        cls, each = wanted // CLASS_WORDS, np.arange(n)
        edges = np.searchsorted(cls, np.arange(CLASSES + 1))
        logits = p["Wc"].T @ states.T
        logits += p["bc"][:, None]
        found = logits[cls, each]
        sums, most = _softmax(logits)
        found -= most + np.log(sums)
        back = None
        if grads is not None:
            d = logits
            d /= sums
            d[cls, each] -= 1
            grads["Wc"] += (d @ states).T
            grads["bc"] += d.sum(axis=1)
            back = d.T @ p["Wc"].T
        for c in range(CLASSES):
            rows = slice(edges[c], edges[c + 1])
            if rows.start == rows.stop:
                continue
            own, word, at = states[rows], wanted[rows] % CLASS_WORDS, each[: rows.stop - rows.start]
            logits = p["Ww"][c].T @ own.T
            logits += p["bw"][c][:, None]
            found[rows] += logits[word, at]
            sums, most = _softmax(logits)
            found[rows] -= most + np.log(sums)
            if grads is not None:
                d = logits
                d /= sums
                d[word, at] -= 1
                grads["Ww"][c] += (d @ own).T
                grads["bw"][c] += d.sum(axis=1)
                back[rows] += d.T @ p["Ww"][c].T
        place = np.empty(n, np.int64)
        place[order] = each
        return found[place], None if back is None else back[place]

    def score(self, texts: list[np.ndarray], first: int) -> np.ndarray:
        """Natural logarithm of each whole text's probability; ``texts`` hold token numbers."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        total = np.zeros(len(texts))
        for at in range(0, len(texts), SCORED_AT_ONCE):
            batch = [texts[i] for i in order[at : at + SCORED_AT_ONCE]]
            h = np.zeros((len(batch), HIDDEN), np.float32)
            for n, w in windows(batch, first):
                states, h, _ = self._run(w, h[:n], False)  # the state goes on into the next window
                found, _ = self._output(states[w.runs], w.wanted[w.runs], None)
                part = np.zeros(w.runs.shape)
                part[w.runs] = found
                total[at : at + n] += part.sum(axis=0)
        out = np.empty(len(texts))
        out[order] = total
        return out

    def learn(self, texts: list[np.ndarray], first: int) -> None:
        """One pass over the texts, a step per window; errors go back to the start of the window only."""
        texts = sorted(texts, key=len, reverse=True)
        h = np.zeros((len(texts), HIDDEN), np.float32)
        for n, w in windows(texts, first):
            before = h[:n]
            states, h, steps = self._run(w, before, True)
            flat = np.zeros(SIZE, np.float32)
            grads = views(flat)
            _, back = self._output(states[w.runs], w.wanted[w.runs], grads)
            above = np.zeros_like(states)
            above[w.runs] = back
            self._back(w, steps, above, grads)
            count = int(w.runs.sum())
            flat /= count + 1000  # windows with few tokens make small steps
            np.clip(flat, -1, 1, out=flat)
            self.squares += flat * flat
            self.flat -= RATE * flat / np.sqrt(self.squares)
            self.sum += self.flat * np.float64(count)
            self.seen += count

    def _back(self, w: Window, steps: list, above: np.ndarray, grads: dict) -> None:
        u = self.p["U"]
        into = np.empty((len(steps), 3 * HIDDEN, w.given.shape[1]), np.float32)
        dh = np.zeros((HIDDEN, w.given.shape[1]), np.float32)
        through = np.empty_like(into[0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, n, back = steps[t]
            dh += above[t].T
            d = into[t]
            rest = 1 - z
            dn = np.multiply(dh, rest, out=d[2 * HIDDEN :])
            dn *= 1 - n * n
            rest *= z
            rest *= dh
            np.multiply(rest, h - n, out=d[:HIDDEN])
            through[2 * HIDDEN :] = dn * r
            rest = 1 - r
            rest *= back
            np.multiply(rest, through[2 * HIDDEN :], out=d[HIDDEN : 2 * HIDDEN])
            through[: 2 * HIDDEN] = d[: 2 * HIDDEN]
            grads["U"] += h @ through.T
            dh *= z
            dh += u @ through
        given, rows = w.given.ravel(), into.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
        order = np.argsort(given.astype(np.int16), kind="stable")
        counts = np.bincount(given)
        ids = np.flatnonzero(counts)
        starts = np.cumsum(counts[ids]) - counts[ids]
        grads["E"][ids] += np.add.reduceat(rows[order], starts, axis=0)
