"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored output softmax.

Token 0 is the end of a document (and what stands before its first token), token 1 any word outside the vocabulary,
the others are the most frequent words. Tokens lie in classes of SPAN neighbours by rank; the probability of a token
is that of its class times that of the token inside the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN, SPAN, WINDOW = 24, 46, 32
#: Documents that are scored side by side.
SIDE = 256
RATE, CLIP = 0.05, 1.0
#: Documents that are trained side by side: a window's gates then stay in a core's cache.
BATCH = 128
#: Columns of states that are multiplied at once: their products stay in a core's cache, and small products are the faster ones.
COLUMNS = 512
#: Tokens of a document that are trained on in a row.
SEGMENT = 128 * WINDOW


def exps(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The targets' logits, the exponentials of all and their sums, a column for each target. Only columns whose sum would
    leave the range of its type are shifted by their largest logit."""
    given = logits.reshape(-1).take(target * len(target) + np.arange(len(target)))
    with np.errstate(over="ignore"):
        e = np.exp(logits)
        s = e.sum(axis=0)
    if not (s.min(initial=1) > 1e-20 and s.max(initial=1) < 1e30):
        far = ~((s > 1e-20) & (s < 1e30))
        top = logits[:, far].max(axis=0)
        given[far] -= top
        e[:, far] = np.exp(logits[:, far] - top)
        s[far] = e[:, far].sum(axis=0, dtype=np.float64)
    return given, e, s


def softmax_loss(logits: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """The negative sum of the targets' log probabilities, a column for each, and its gradients by the logits."""
    given, e, s = exps(logits, target)
    e *= 1 / s
    e.reshape(-1)[target * len(target) + np.arange(len(target))] -= 1
    return -float((given - np.log(s)).sum()), e


def log_shares(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probabilities of the targets, a column for each. Products come summed up in double precision and are rounded
    here: in single precision their last bits depend on how many rows and columns there are and which of them one is, so a
    score would depend on what is scored beside it."""
    if len(target) == 1:  # one column alone is summed up in another order
        return log_shares(np.repeat(logits, 2, axis=1), np.repeat(target, 2))[:1]
    given, _, s = exps(logits.astype(np.float32), target)
    return given - np.log(s)


def sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of stretches of rows: many short ones side by side, row after row, the long ones alone."""
    sizes = np.diff(starts, append=len(rows))
    out = rows.take(starts, axis=0)
    some = np.flatnonzero((sizes > 1) & (sizes <= 8))
    for k in range(1, 8):
        some = some[sizes[some] > k]
        out[some] += rows.take(starts[some] + k, axis=0)
    for i in np.flatnonzero(sizes > 8).tolist():
        rows[starts[i] : starts[i] + sizes[i]].sum(axis=0, out=out[i])
    return out


def stretches(rows: np.ndarray) -> list[tuple[int, int, int]]:
    """Of ascending numbers each one, its first place and the place after its last."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return list(zip(rows[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True)) if len(rows) else []


def shelves(parts: list[tuple[int, int, int]]) -> Iterator[tuple[list[tuple[int, int, int]], int, int]]:
    """Stretches on end put together to at most COLUMNS places, longer ones cut; and where these begin and end."""
    some: list[tuple[int, int, int]] = []
    for c, first, end in parts:
        for i, j in blocks(first, end):
            if some and j - some[0][1] > COLUMNS:
                yield some, some[0][1], i
                some = []
            some.append((c, i, j))
    if some:
        yield some, some[0][1], some[-1][2]


def blocks(i: int, j: int) -> list[tuple[int, int]]:
    return [(a, min(a + COLUMNS, j)) for a in range(i, j, COLUMNS)]


class Gru:
    """Weights by name; ``size`` tokens."""

    NAMES = ("embed", "u", "b", "klass", "klass_b", "word", "word_b")

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 3) -> Gru:
        """Random weights whose output biases already give each token its share of the counts."""
        rng = np.random.default_rng(seed)
        size, h = len(counts), HIDDEN
        classes = -(-size // SPAN)
        p = np.zeros(classes * SPAN)
        p[:size] = (counts + 0.5) / (counts + 0.5).sum()
        p = p.reshape(classes, SPAN)
        total = p.sum(axis=1)
        with np.errstate(divide="ignore"):
            inside = np.where(p > 0, np.log(p / total[:, None]), -30.0)
        f = np.float32
        return cls(
            {
                "embed": (rng.standard_normal((size, 3 * h)) * 0.1).astype(f),
                "u": (rng.standard_normal((h, 3 * h)) * h**-0.5).astype(f),
                "b": np.zeros(3 * h, f),
                "klass": (rng.standard_normal((h, classes)) * 0.05).astype(f),
                "klass_b": np.log(total).astype(f),
                "word": (rng.standard_normal((classes, h, SPAN)) * 0.05).astype(f),
                "word_b": inside.astype(f),
            }
        )

    def wide(self) -> dict[str, np.ndarray]:
        """Transposed weights for scoring, with biases as the last column, in double precision where products are summed up.
        Those of the gates are halved, as the logistic function of x is (1 + tanh(x / 2)) / 2."""
        w, n = self.w, HIDDEN
        out = {
            "embed": w["embed"].astype(np.float32),
            "u": np.vstack((w["u"], w["b"])).T.astype(np.float64, order="C"),
            "klass": np.vstack((w["klass"], w["klass_b"])).T.astype(np.float64, order="C"),
            "word": np.concatenate((w["word"], w["word_b"][:, None]), axis=1).transpose(0, 2, 1).astype(np.float64, order="C"),
        }
        out["embed"][:, : 2 * n] /= 2
        out["u"][: 2 * n] /= 2
        return out

    @staticmethod
    def _step(wide: dict[str, np.ndarray], tokens: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The new state of each column; the last row of the states is one."""
        n = HIDDEN
        x = wide["embed"].take(tokens, axis=0).T
        g = (wide["u"] @ h).astype(np.float32)
        gates, new = g[: 2 * n], g[2 * n :]
        gates += x[: 2 * n]
        np.tanh(gates, out=gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        new *= gates[:n]
        new += x[2 * n :]
        np.tanh(new, out=new)
        out = h[:n].astype(np.float32)
        out -= new
        out *= gates[n:]
        out += new
        return out

    @staticmethod
    def _log_probs(wide: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Of targets after the states in these rows, which end with one."""
        klass, inside = targets // SPAN, targets % SPAN
        out, found = np.empty(len(targets), np.float32), np.empty(len(targets), np.float32)
        for i, j in blocks(0, len(targets)):
            out[i:j] = log_shares(wide["klass"] @ states[i:j].T.astype(np.float64, order="C"), klass[i:j])
        order = np.argsort(klass.astype(np.uint16) if len(wide["klass"]) <= 1 << 16 else klass, kind="stable")
        own, inside = states.take(order, axis=0), inside[order]
        for some, i, j in shelves(stretches(klass[order])):
            columns, logits = own[i:j].T.astype(np.float64, order="C"), np.empty((SPAN, j - i))
            for c, a, b in some:
                np.matmul(wide["word"][c], columns[:, a - i : b - i], out=logits[:, a - i : b - i])
            found[i:j] = log_shares(logits, inside[i:j])
        out[order] += found
        return out

    def step(self, tokens: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of the recurrence for a batch, a row for each document: the new state and the one before."""
        return self._step(self.wide(), tokens, self._with_one(h).T.astype(np.float64)).T, h

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target after its state, a row for each."""
        return self._log_probs(self.wide(), self._with_one(states), targets)

    @staticmethod
    def _with_one(states: np.ndarray) -> np.ndarray:
        return np.column_stack((states, np.ones(len(states), states.dtype)))

    def score(self, tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Natural log probability of each whole document; ``begins`` has one entry more than documents, each document
        ends with token 0. Documents of like length go side by side."""
        length = np.diff(begins)
        order = np.argsort(-length, kind="stable")
        out, wide = np.zeros(len(order)), self.wide()
        for i in range(0, len(order), SIDE):
            part = order[i : i + SIDE]
            out[part] = self._score(wide, tokens, begins[:-1][part], length[part])
        return out

    @classmethod
    def _score(cls, wide: dict[str, np.ndarray], tokens: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of documents that come longest first. The state goes from one window to the next until each ends."""
        total, n = np.zeros(len(begin)), HIDDEN
        h = np.zeros((n + 1, len(begin)))
        h[n] = 1
        last = np.zeros(len(begin), np.int64)
        at, end = 0, int(length.max(initial=0))
        while at < end:
            # As many tokens in a window of few documents as in one of many.
            steps = np.arange(at, min(at + SIDE * WINDOW // int(np.searchsorted(-length, -at)), end))
            at += len(steps)
            on = np.searchsorted(-length, -steps).tolist()  # documents that go on, at each step
            now = tokens[np.minimum(begin[: on[0], None] + steps, len(tokens) - 1)].T
            states, ends = np.ones((sum(on), n + 1), np.float32), np.cumsum([0, *on]).tolist()
            for t, m in enumerate(on):
                h[:n, :m] = new = cls._step(wide, last[:m], h[:, :m])
                states[ends[t] : ends[t + 1], :n] = new.T
                last = now[t]
            found = cls._log_probs(wide, states, np.concatenate([now[t, :m] for t, m in enumerate(on)]))
            for t, m in enumerate(on):
                total[:m] += found[ends[t] : ends[t + 1]]
        return total

    def _room(self, steps: int, docs: int, kind: np.dtype) -> list[np.ndarray]:
        """Arrays for a window, the same ones for all windows of a shape: fresh memory costs more than what is done in it."""
        if getattr(self, "_shape", None) != (steps, docs, kind):
            self._shape = steps, docs, kind
            self._arrays = [np.empty((steps, k * HIDDEN, docs), kind) for k in (3, 3, 2, 1, 1, 1)] + [np.ones((steps + 1, HIDDEN + 1, docs), kind)]
        return self._arrays

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Over one window (step by document; target -1 after a document's end): gradients of the mean loss (of the
        embedding as rows and their values), the last state, and that loss. Nothing flows back beyond the window."""
        w, n, kind = self.w, HIDDEN, self.w["u"].dtype
        steps, docs = inputs.shape
        half = kind.type(0.5)
        # Step by feature by document, so that the gates are blocks. Biases go with a state that is always one; what goes
        # into the gates is halved, as the logistic function of x is (1 + tanh(x / 2)) / 2.
        scale = np.ones((3 * n, 1), kind)
        scale[: 2 * n] = half
        x, g, gates, new, kept, by_new, states = self._room(steps, docs, kind)
        given = w["embed"].take(inputs, axis=0, out=g.reshape(steps, docs, 3 * n), mode="clip")
        x[...] = given.transpose(0, 2, 1)
        x[:, : 2 * n] *= half
        turn = np.ascontiguousarray(np.vstack((w["u"], w["b"])).T) * scale
        states[0, :n] = h.T
        for t in range(steps):
            np.matmul(turn, states[t], out=g[t])
            gate = np.add(x[t, : 2 * n], g[t, : 2 * n], out=gates[t])
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
            fresh = np.multiply(gate[:n], g[t, 2 * n :], out=new[t])
            fresh += x[t, 2 * n :]
            np.tanh(fresh, out=fresh)
            keep = np.subtract(states[t, :n], fresh, out=kept[t])
            keep *= gate[n:]
            np.add(keep, fresh, out=states[t + 1, :n])
        # States in the order of their targets' classes, those without a target left out.
        goal = targets.ravel()
        klass = goal // SPAN
        order = np.argsort(klass.astype(np.int16) if len(w["word"]) < 1 << 15 else klass, kind="stable")[int((goal < 0).sum()) :]
        count = max(1, len(order))
        own_rows = states[1:].transpose(0, 2, 1).reshape(-1, n + 1).take(order, axis=0)
        own = np.ascontiguousarray(own_rows.T)
        rows, inside = klass[order], goal[order] % SPAN
        with_b = np.vstack((w["klass"], w["klass_b"]))
        by_klass, by_word = np.zeros_like(with_b.T), np.zeros((len(w["word"]), SPAN, n + 1), kind)
        back = np.zeros((n, len(order) + 1), kind)  # the last column is for states without a target
        loss = 0.0
        for i, j in blocks(0, len(order)):
            more, p = softmax_loss(with_b.T @ own[:, i:j], rows[i:j])
            loss += more
            by_klass += p @ own_rows[i:j]
            np.matmul(w["klass"], p, out=back[:, i:j])
        with_b = np.concatenate((w["word"], w["word_b"][:, None]), axis=1)
        for some, i, j in shelves(stretches(rows)):
            p = np.empty((SPAN, j - i), kind)
            for c, a, b in some:
                np.matmul(with_b[c].T, own[:, a:b], out=p[:, a - i : b - i])
            more, p = softmax_loss(p, inside[i:j])
            loss += more
            for c, a, b in some:
                part = p[:, a - i : b - i]
                by_word[c] += part @ own_rows[a:b]
                back[:, a:b] += w["word"][c] @ part
        by_klass /= count
        by_word /= count
        back /= count
        place = np.full(len(goal), len(order))
        place[order] = np.arange(len(order))
        d_states = back.take(place, axis=1).reshape(n, steps, docs)
        r, z = gates[:, :n], gates[:, n:]
        # What the state's gradient is multiplied with on its way to the gates.
        rest = 1 - z
        kept *= rest
        np.multiply(new, new, out=by_new)
        np.subtract(1, by_new, out=by_new)
        by_new *= rest
        by_r = np.subtract(1, r, out=rest)
        by_r *= r
        by_r *= g[:, 2 * n :]
        d_g, d_new, d_h = g, new, np.zeros((n, docs), kind)
        for t in reversed(range(steps)):
            d_h += d_states[:, t]
            d = np.multiply(d_h, by_new[t], out=d_new[t])
            np.multiply(d, by_r[t], out=d_g[t, :n])
            np.multiply(d_h, kept[t], out=d_g[t, n : 2 * n])
            np.multiply(d, r[t], out=d_g[t, 2 * n :])
            d_h *= z[t]
            d_h += w["u"] @ d_g[t]
        by_u = (states[:-1] @ d_g.transpose(0, 2, 1)).sum(axis=0)
        d_g[:, 2 * n :] = d_new
        # Only the rows of tokens that were given.
        flat_in = inputs.ravel()
        order = np.argsort(flat_in.astype(np.uint16) if len(w["embed"]) <= 1 << 16 else flat_in, kind="stable")
        given = flat_in[order]
        starts = np.flatnonzero(np.diff(given, prepend=-1))
        by_token = x.reshape(steps, docs, 3 * n)
        by_token[...] = d_g.transpose(0, 2, 1)
        by_embed = sums(by_token.reshape(-1, 3 * n).take(order, axis=0, out=g.reshape(-1, 3 * n), mode="clip"), starts)
        grads = {"u": by_u[:n], "b": by_u[n], "klass": by_klass[:, :n].T, "klass_b": by_klass[:, n], "word": by_word[:, :, :n].transpose(0, 2, 1), "word_b": by_word[:, :, n]}
        grads["embed"] = given[starts], by_embed
        return grads, np.array(states[-1, :n].T, order="C"), loss / count

    def train(self, tokens: np.ndarray, begins: np.ndarray, seed: int, batch: int = BATCH, rate: float = RATE, before: np.ndarray | None = None) -> int:
        """One pass of AdaGrad over all windows of the documents in a seeded order, the state going from one window to
        the next up to SEGMENT tokens. ``before`` has the token that stands before each document's first, the end token if not given.
        Returns the tokens it learned from.

        ``batch`` documents go side by side; where one ends the next takes its turn. The order spreads documents over
        the pass by their length, so that long ones do not remain alone at its end.
        """
        rng = np.random.default_rng(seed)
        # Long documents go in segments side by side, so that none is trained on alone, window after window.
        segments = -(-np.diff(begins) // SEGMENT)
        nth = np.arange(int(segments.sum())) - np.repeat(np.cumsum(segments) - segments, segments)
        opens, end = np.repeat(begins[:-1], segments) + nth * SEGMENT, np.repeat(begins[1:], segments)
        end = np.minimum(opens + SEGMENT, end)
        first = np.where(nth > 0, tokens[np.maximum(opens - 1, 0)], 0 if before is None else np.repeat(before, segments))
        turns = -(-(end - opens) // WINDOW)
        steps = max(-(-int(turns.sum()) // batch), int(turns.max(initial=0)))
        order = np.argsort(rng.random(len(turns)) * (steps - turns + 1), kind="stable")
        seen = waiting = 0
        if not hasattr(self, "_sum"):
            self._sum = {k: np.full_like(v, 1e-3) for k, v in self.w.items()}
        pick, place, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HIDDEN), np.float32)
        while True:
            on = place < end[pick]
            more = order[waiting : waiting + batch - int(on.sum())]
            waiting += len(more)
            pick, place = np.concatenate((pick[on], more)), np.concatenate((place[on], opens[more]))
            h = np.concatenate((h[on], np.zeros((len(more), HIDDEN), np.float32)))
            if not len(pick):
                return seen
            at = place + np.arange(WINDOW)[:, None]
            live = at < end[pick]
            target = np.where(live, tokens[np.minimum(at, len(tokens) - 1)], -1)
            given = np.where(live, np.where(at == opens[pick], first[pick], tokens[np.clip(at - 1, 0, len(tokens) - 1)]), 0)
            grads, h, _ = self.gradients(given, target, h)
            n = int(live.sum())
            seen += n
            place = place + WINDOW
            for name, g in grads.items():
                w, upto = self.w[name], self._sum[name]
                if name == "embed":
                    rows, g = g
                    w, upto = w.take(rows, axis=0), upto.take(rows, axis=0)
                g = np.multiply(g, np.float32(n / batch), order="C")  # few documents that are left alone move it little
                np.clip(g, -CLIP, CLIP, out=g)
                upto += g * g
                g *= np.float32(rate)
                g /= np.sqrt(upto)
                w -= g
                if name == "embed":
                    self.w[name][rows], self._sum[name][rows] = w, upto

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.NAMES])

    def like(self, flat: np.ndarray) -> Gru:
        """A model of this shape with these weights."""
        out, at = {}, 0
        for k in self.NAMES:
            out[k] = flat[at : at + self.w[k].size].reshape(self.w[k].shape).astype(np.float32)
            at += self.w[k].size
        return Gru(out)
