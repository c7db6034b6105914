"""A character-level bidirectional LSTM with CRF transitions in numpy: training and batched decoding."""

from __future__ import annotations

import numpy as np

#: Printable ASCII has ids 1-95; then other letters, other digits, other white space, the rest. 0 is padding.
CHARS = 100
#: Rows of a product: so few that the library under numpy does it in the calling thread, since Spark runs a task a core.
SMALL = 1024
#: Windows that are scored together: enough to outweigh the calls, few enough for a core's cache.
ROWS = 512
_IDS = np.zeros(0x110000, np.uint8)  # of other characters than ASCII's as they come up
_IDS[:128] = 99
_IDS[32:127] = np.arange(1, 96)
_IDS[[9, 10, 11, 12, 13]] = 98


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _IDS[codes]
    if not out.all():
        for i in set(codes[out == 0].tolist()):
            c = chr(i)
            _IDS[i] = 98 if c.isspace() else 96 if c.isalpha() else 97 if c.isdigit() else 99
        out = _IDS[codes]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _planes(x: np.ndarray) -> np.ndarray:
    """Weights (m, 4h) of all gates as (4, m, h), for sigmoids of negated arguments: the last gate's twice, as a tanh is one of 2x."""
    return np.ascontiguousarray((x.reshape(len(x), 4, -1) * np.array([-1, -1, -1, -2])[:, None]).transpose(1, 0, 2), np.float32)


class Tagger:
    """Parameters in self.p: for each direction wx (chars, 4h), wh (h, 4h), b (4h); then wo, bo, and the CRF's move and start."""

    def __init__(self, tags: int, hidden: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.k, self.h, self.p = tags, hidden, {}
        for d in "fb":
            self.p[f"wx{d}"] = r.normal(0, 0.3, (CHARS, 4 * hidden))
            self.p[f"wh{d}"] = r.normal(0, 0.2, (hidden, 4 * hidden))
            self.p[f"b{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p |= {"wo": r.normal(0, 0.2, (2 * hidden, tags)), "bo": np.zeros(tags), "move": np.zeros((tags, tags)), "start": np.zeros(tags)}

    def _run(self, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (length, rows, h) of one direction. ids: (length, rows)."""
        n, hs = self.h, np.empty((*ids.shape, self.h))
        h = c = np.zeros((ids.shape[1], n))
        wx, wh = self.p[f"wx{d}"] + self.p[f"b{d}"], self.p[f"wh{d}"]
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            z = wx[ids[t]] + h @ wh
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before, old = h, c
            c = gates[:, n : 2 * n] * c + gates[:, :n] * g
            tc = np.tanh(c)
            hs[t] = h = gates[:, 2 * n :] * tc
            if keep is not None:
                keep.append((t, before, old, gates, g, tc))
        return hs

    def _scores(self, ids: np.ndarray) -> np.ndarray:
        """Scores (length, tags, rows) of ids (length, rows): what _run gives, in 32 bits, both directions at once and without new arrays.

        Each gate is a plane of its own, in which the rows of one direction follow those of the other, so all arithmetic runs over
        adjoining numbers. All gates are sigmoids of negated arguments, 1 / (1 + exp(x)), since exp costs half of tanh: tanh(x) is
        twice the sigmoid of 2x, less 1. The last gate is -4 times its sigmoid, c is -2 times the cell and h half the state.
        """
        n, (length, rows) = self.h, ids.shape
        gates = np.array([1, 1, 1, -4], np.float32)[:, None, None]
        wx = np.concatenate([_planes(self.p[f"wx{d}"] + self.p[f"b{d}"]) for d in "fb"], axis=1)
        wh = np.stack([_planes(2 * self.p[f"wh{d}"]) for d in "fb"])
        wo = np.stack([2 * self.p["wo"][:n].T, 2 * self.p["wo"][n:].T]).astype(np.float32)
        both = np.concatenate([ids, ids[::-1].astype(np.intp) + CHARS], axis=1)
        h, c, new = (np.zeros((2 * rows, n), np.float32) for _ in range(3))
        z, hz, got = np.empty((4, 2 * rows, n), np.float32), np.empty((4, 2 * rows, n), np.float32), np.empty((2, self.k, rows), np.float32)
        state, moved = h.reshape(2, rows, n), hz.reshape(4, 2, rows, n).transpose(1, 0, 2, 3)
        parts = [slice(a, a + SMALL) for a in range(0, rows, SMALL)]
        moves = [(state[:, None, a], moved[:, :, a]) for a in parts]
        reads = [(state[:, a].transpose(0, 2, 1), got[:, :, a]) for a in parts]
        out = np.empty((length, self.k, rows), np.float32)
        out[:] = self.p["bo"].astype(np.float32)[:, None]
        with np.errstate(over="ignore"):  # exp may be infinite: its sigmoid is 0
            for t in range(length):
                np.take(wx, both[t], axis=1, out=z, mode="clip")
                for x, to in moves:
                    np.matmul(x, wh, out=to)
                z += hz
                np.exp(z, out=z)
                z += 1
                np.divide(gates, z, out=z)
                np.add(z[3], 2, out=new)
                new *= z[0]
                c *= z[1]
                c += new
                np.exp(c, out=new)
                new += 1
                np.divide(1, new, out=new)
                new -= 0.5
                np.multiply(z[2], new, out=h)
                for x, to in reads:
                    np.matmul(wo, x, out=to)
                out[t] += got[0]
                out[length - 1 - t] += got[1]
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (length, rows, tags). ids: (length, rows)."""
        return self._scores(ids).transpose(0, 2, 1)

    def _may_differ(self, e: np.ndarray) -> np.ndarray:
        """The rows of scores e (length, tags, rows) whose best path may not be zeros throughout.

        No path gains on zeros unless one of its stretches of other tags does. A stretch gains at most what it would if each of
        its tags came from the best other tag: its scores against zero's, the moves in, inside and out, or the start or the end.
        """
        move, start = self.p["move"] - self.p["move"][0, 0], self.p["start"] - self.p["start"][0]
        inside, enter, begin = (x.astype(np.float32)[:, None] for x in (move[1:, 1:].max(axis=0), move[0, 1:], start[1:]))
        leave = np.float32(move[1:, 0].max())
        run = (e[0, 1:] + begin).max(axis=0) - e[0, 0]
        best = np.full_like(run, -np.inf)
        for at in range(1, len(e), 16):
            x = e[at : at + 16]
            further, first = ((x[:, 1:] + way).max(axis=1) - x[:, 0] for way in (inside, enter))
            for more, new in zip(further, first, strict=True):
                np.maximum(best, run, out=best)
                run += more
                np.maximum(run, new, out=run)
        return np.flatnonzero(np.maximum(best + leave, run) > -1e-3)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags (rows, length) of windows ids (rows, length)."""
        tags, found, kept = np.zeros(ids.shape, np.int8), [], []
        step = -(-len(ids) // max(1, -(-len(ids) // ROWS)))
        for at in range(0, len(ids), max(1, step)):
            e = self._scores(np.ascontiguousarray(ids[at : at + step].T))
            may = self._may_differ(e)
            found.append(may + at)
            kept.append(e[:, :, may])
        open_ = np.concatenate([*found, np.zeros(0, np.int64)])
        if not len(open_):
            return tags
        e, into = np.ascontiguousarray(np.concatenate(kept, axis=2).transpose(0, 2, 1)), np.ascontiguousarray(self.p["move"].T)
        score, back = self.p["start"] + e[0], np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            paths = score[:, None, :] + into
            back[t] = paths.argmax(axis=2)
            score = paths.max(axis=2) + e[t]
        best = np.empty((len(open_), len(e)), np.int8)
        best[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(open_))
        for t in range(len(e) - 1, 0, -1):
            best[:, t - 1] = back[t][rows, best[:, t]]
        tags[open_] = best
        return tags

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood and its gradients. ids, tags: (rows, length)."""
        ids, tags = ids.T, tags.T
        length, rows = ids.shape
        keep = {d: [] for d in "fb"}
        both = np.concatenate([self._run(ids, d, keep[d]) for d in "fb"], axis=2)
        e, move, start = both @ self.p["wo"] + self.p["bo"], self.p["move"], self.p["start"]
        a, b = np.empty(e.shape), np.zeros(e.shape)
        a[0] = start + e[0]
        for t in range(1, length):
            a[t] = _logsum(a[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(length - 2, -1, -1):
            b[t] = _logsum(move + (e[t + 1] + b[t + 1])[:, None, :], 2)
        z = _logsum(a[-1], 1)
        de = np.exp(a + b - z[:, None])
        at = np.arange(rows)
        gold = start[tags[0]] + e[0][at, tags[0]]
        g = {}
        for t in range(1, length):
            gold = gold + move[tags[t - 1], tags[t]] + e[t][at, tags[t]]
        # of each pair of neighbours, how likely each move is: exp(a) and exp(e + b) around the move's own, scaled by their tops
        left, right = a[:-1], e[1:] + b[1:]
        tops = left.max(axis=2, keepdims=True), right.max(axis=2, keepdims=True)
        weight = np.exp(tops[0] + tops[1] - z[None, :, None])
        g["move"] = np.tensordot(np.exp(left - tops[0]) * weight, np.exp(right - tops[1]), ([0, 1], [0, 1])) * np.exp(move)
        np.add.at(g["move"], (tags[:-1].ravel(), tags[1:].ravel()), -1)
        np.put_along_axis(de, tags[:, :, None], np.take_along_axis(de, tags[:, :, None], 2) - 1, 2)
        g["start"] = de[0].sum(axis=0)
        g["wo"], g["bo"] = np.tensordot(both, de, ([0, 1], [0, 1])), de.sum(axis=(0, 1))
        dboth, n = de @ self.p["wo"].T, self.h
        for d, part in (("f", dboth[:, :, :n]), ("b", dboth[:, :, n:])):
            wh = self.p[f"wh{d}"]
            steps, gh = np.empty((length, rows, 4 * n)), np.zeros_like(wh)
            dh = dc = np.zeros((rows, n))
            for t, before, old, gates, new, tc in reversed(keep[d]):
                i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * new * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                steps[t] = dz
                gh += before.T @ dz
                dh, dc = dz @ wh.T, dc * f
            gx = (np.arange(CHARS)[:, None] == ids.reshape(1, -1)).astype(float) @ steps.reshape(-1, 4 * n)
            g[f"wx{d}"], g[f"wh{d}"], g[f"b{d}"] = gx, gh, gx.sum(axis=0)
        return float((z - gold).mean()), {k: v / rows for k, v in g.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 120, rows: int = 48, rate: float = 0.03, seed: int = 11) -> float:
        """Adam with a falling rate; returns the last step's loss."""
        r, loss = np.random.default_rng(seed), 0.0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = r.integers(0, len(ids), rows)
            loss, g = self.gradients(ids[pick], tags[pick])
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 5 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = self.p[k] - rate * (1 - 0.8 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss
