"""A character-level bidirectional LSTM with CRF transitions, trained and decoded in numpy.

`python -m adtflow.llm.pii_model` trains it on generated labelled texts and writes its weights beside this file; queries only read them.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
#: ASCII, other letters, other characters, padding.
SYMBOLS = 131
EMBEDDING, HIDDEN = 12, 24
STEPS, BATCH, LENGTH = 2500, 32, 72
#: The trained weights, a few thousand numbers.
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
NEVER = -1e4


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    big = c >= 128
    if big.any():
        c[big] = [128 if text[i].isalpha() else 129 for i in np.flatnonzero(big)]
    return c


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, NEVER where not: I of a kind only follows B or I of that kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = NEVER
        out[[inside - 1, inside], inside] = 0
    return out


_ALLOWED = _allowed()
_START = np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) == 0, 0, NEVER), 0).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name: e embeddings; x, h, b of each direction; u, c output; t CRF transitions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(rng: np.random.Generator) -> Tagger:
        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        p = {"e": rng.normal(0, 0.5, (SYMBOLS, EMBEDDING)).astype(np.float32), "u": draw(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            p |= {f"x{d}": draw(EMBEDDING, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        return Tagger(p)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states in time order; x is (time, batch, embedding), reversed for the backward direction by the caller."""
        time, batch, _ = x.shape
        z_x = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out, saved = np.empty((time, batch, HIDDEN), np.float32), []
        for t in range(time):
            z = z_x[t] + h @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                saved.append((i, f, o, g, c, tc, h))
            c, h = new, o * tc
            out[t] = h
        return out, saved

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """ids (batch, time) to scores (time, batch, tags)."""
        x = self.p["e"][ids.T]
        f, sf = self._run(x, "f", keep)
        b, sb = self._run(x[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        scores = both @ self.p["u"] + self.p["c"]
        return (scores, x, both, sf, sb) if keep else scores

    def loss_and_gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags (batch, time) under the CRF, and its gradient."""
        scores, x, both, sf, sb = self.emissions(ids, keep=True)
        time, batch, _ = scores.shape
        trans, y = self.p["t"] + _ALLOWED, tags.T
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + _START
        for t in range(1, time):
            alpha[t] = scores[t] + _logsumexp(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(time - 2, -1, -1):
            beta[t] = _logsumexp(trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        rows = np.arange(batch)
        gold = scores[0, rows, y[0]] + _START[y[0]]
        for t in range(1, time):
            gold = gold + scores[t, rows, y[t]] + trans[y[t - 1], y[t]]
        ds = np.exp(alpha + beta - z[None, :, None])
        dt = np.zeros_like(trans)
        for t in range(1, time):
            dt += np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t] - z[:, None])[:, None, :]).sum(0)
            np.add.at(dt, (y[t - 1], y[t]), -1)
        ds[np.arange(time)[:, None], rows[None], y] -= 1
        ds, dt = (ds / batch).astype(np.float32), (dt / batch).astype(np.float32)
        g = {"t": dt, "u": np.tensordot(both, ds, ([0, 1], [0, 1])), "c": ds.sum((0, 1))}
        dh = ds @ self.p["u"].T
        dx_f = self._back(x, dh[:, :, :HIDDEN], "f", sf, g)
        dx_b = self._back(x[::-1], dh[::-1, :, HIDDEN:], "b", sb, g)
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], ids.T, dx_f + dx_b[::-1])
        return float((z - gold).mean()), g

    def _back(self, x: np.ndarray, dh_out: np.ndarray, d: str, saved: list, g: dict[str, np.ndarray]) -> np.ndarray:
        time, batch, _ = x.shape
        dz = np.empty((time, batch, 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((batch, HIDDEN), np.float32)
        gh = np.zeros_like(self.p[f"h{d}"])
        for t in range(time - 1, -1, -1):
            i, f, o, gg, c, tc, h = saved[t]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            z = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
            dz[t] = z
            gh += h.T @ z
            dh, dc = z @ self.p[f"h{d}"].T, dc * f
        g[f"h{d}"], g[f"b{d}"], g[f"x{d}"] = gh, dz.sum((0, 1)), np.tensordot(x, dz, ([0, 1], [0, 1]))
        return dz @ self.p[f"x{d}"].T

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """The best tags (batch, time) under emissions (time, batch, tags) and transitions; beyond a row's length they mean nothing."""
        time, batch, _ = scores.shape
        trans, same = self.p["t"] + _ALLOWED, np.arange(TAGS, dtype=np.int8)
        best, back = scores[0] + _START, np.empty((time, batch, TAGS), np.int8)
        for t in range(1, time):
            x = best[:, :, None] + trans
            back[t] = x.argmax(1)
            new = x.max(1) + scores[t]
            if lengths is not None and (over := lengths <= t).any():
                back[t, over], new[over] = same, best[over]
            best = new
        out = np.empty((batch, time), np.int8)
        out[:, -1] = best.argmax(1)
        rows = np.arange(batch)
        for t in range(time - 1, 0, -1):
            out[:, t - 1] = back[t, rows, out[:, t]]
        return out


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of one row of tags."""
    out, start, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and t != 2 * kind + 2:
            out.append((kind, start, i))
            start = -1
        if t % 2:
            start, kind = i, (t - 1) // 2
    return out


def _checked_card(r: random.Random) -> str:
    d = [r.choice((3, 4, 5, 6)), *(r.randrange(10) for _ in range(r.choice((13, 14, 14, 14, 17))))]
    total = sum(v if i % 2 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(reversed(d)))
    return "".join(map(str, [*d, -total % 10]))


def _word(r: random.Random) -> str:
    if r.random() < 0.4:
        w = "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(1, 10)))
    else:
        w = "".join(r.choice(("an", "er", "the", "on", "re", "ti", "es", "or", "in", "st", "é", "ción", "sch", "ou", "le", "k", "ba", "mo")) for _ in range(r.randint(1, 4)))
    return r.choice((w, w, w, w, w.capitalize(), w.upper(), w + ",", w + ".", w + "."))


def _private(r: random.Random) -> tuple[int, str, str, str]:
    """A kind, what stands before it, the data and what stands after it."""
    kind = r.randrange(5)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(of) for _ in range(n))
    name = lambda: letters(r.randint(2, 9))
    digits = lambda n: letters(n, "0123456789")
    if kind == 0:
        user = r.choice((name(), name(), f"{name()}.{name()}", f"{name()}.{digits(2)}", f"{name()}_{digits(r.randint(1, 4))}", f"{name()}+{name()}", name() + "".join(name() for _ in range(r.randint(2, 5)))))
        host, end = f"{name()}{r.choice(('', digits(1)))}", r.choice(("com", "org", "net", "example.com", "co.uk", "de", "io"))
        if r.random() < 0.45:  # written so that no pattern with a sign finds it
            a, z = r.choice(("()", "[]", "{}"))
            gap = r.choice(("", " ", " "))
            dot = lambda: r.choice((f"{gap}{a}dot{z}{gap}", "."))
            return 0, "", f"{user}{gap}{a}{r.choice(('at', 'at', 'AT'))}{z}{gap}{host}{dot()}{end}", ""
        return 0, "", f"{user}@{host}.{end}", ""
    if kind == 1:
        return 1, "", ".".join(str(r.randrange(256)) for _ in range(4)), ""
    if kind == 2:
        c = _checked_card(r)
        sep = r.choice(("", "", " ", "-", "."))
        return 2, "", sep.join(c[i : i + 4] for i in range(0, len(c), 4)), ""
    if kind == 3:
        a, b, c, q = digits(3), digits(3), digits(4), r.randint(1, 99)
        return 3, "", r.choice((f"+{q} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{q} {a} {b} {c}", f"+{q}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"+{q}{a}{b}{c}", f"+{q} ({a}) {b} {c}")), ""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    mixed = upper + upper.lower()
    of = r.choice(("0123456789abcdef", "0123456789abcdef", mixed))
    if (x := r.random()) < 0.3:
        return 4, "", r.choice(("AKIA", "AKIA", "ASIA")) + letters(16, upper + "0189"), ""
    if x < 0.4:
        return 4, "", r.choice(("ghp_", "sk-", "xoxb-")) + letters(r.randint(20, 36), mixed + "0189"), ""
    what = r.choice(("password", "password", "passwd", "token", "token", "secret", "api_key", "Password", "auth_token", "PASSWORD"))
    quote = r.choice(("", "", '"', '"', "'"))
    return 4, f"{what}{r.choice(('=', '=', ' = ', ' = ', ': ', ':'))}{quote}", letters(r.randint(12, 44), of), quote


def _decoy(r: random.Random) -> str:
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice(
        (
            digits(r.randint(1, 6)),
            f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
            f"{r.randint(1, 9)}.{r.randint(0, 20)}",
            f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
            '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"',
            f"{r.randint(0, 23):02}:{r.randint(0, 59):02}",
            f"${digits(3)}.{digits(2)}",
            f"@{_word(r)}",
            f"({r.choice(('at', 'dot', 'as'))})",
            f"{r.choice(('password', 'token', 'secret', 'the key'))} {_word(r)}",
            "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 32, 40)))),
            f"{r.choice(('n', 'count', 'width', 'x'))}{r.choice(('=', ' = '))}{digits(r.randint(1, 3))}",
            "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randint(3, 20))),
            f"({digits(r.randint(1, 4))})",
            f"{digits(3)}+{digits(2)}",
        )
    )


def labelled_text(r: random.Random, length: int = LENGTH) -> tuple[str, list[int]]:
    """A text of exactly length characters with labelled spans, as a window would cut it from a longer one."""
    text, tags = "", []
    skip = r.randrange(12)
    while len(text) < length + skip:
        kind, head, s, tail = -1, "", _word(r), ""
        x = r.random()
        if x < 0.18:
            kind, head, s, tail = _private(r)
        elif x < 0.3:
            s = _decoy(r)
        tail += r.choice((" ", " ", " ", " ", ", ", ". ", "\n", "%%% ", "!! "))
        text += head + s + tail
        tags += [0] * len(head) + ([0] * len(s) if kind < 0 else [2 * kind + 1] + [2 * kind + 2] * (len(s) - 1)) + [0] * len(tail)
    text, tags = text[skip : skip + length], tags[skip : skip + length]
    if tags[0] and tags[0] % 2 == 0:  # a span that the cut went through starts here
        tags[0] -= 1
    return text, tags


def train(seed: int = 11, steps: int = STEPS) -> Tagger:
    """The tagger after steps of Adam over generated labelled texts."""
    r, m = random.Random(seed), Tagger.new(np.random.default_rng(seed))
    first, second = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        batch = [labelled_text(r) for _ in range(BATCH)]
        _, g = m.loss_and_gradient(np.stack([symbols(t) for t, _ in batch]), np.array([y for _, y in batch]))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale, rate = min(1, 5 / max(norm, 1e-9)), 0.02 * (1 - step / (steps + 1)) + 0.0005
        for k, v in g.items():
            v = v * scale
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            m.p[k] = (m.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


@lru_cache(1)
def trained() -> Tagger:
    with np.load(WEIGHTS) as w:
        return Tagger({k: w[k].astype(np.float32) for k in w.files})


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in train().p.items()})
