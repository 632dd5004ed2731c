"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans.

The tagger is trained in numpy from labelled spans; the default training set is drawn by a
seeded generator of invented prose, half of it without any span. `train_pii` does this once, rounds the weights and keeps
them in pii_tagger.json, so every machine has the same model. It reads whole texts: windows of WINDOW characters lie over all of each text, STRIDE apart, and depend on
nothing but this text. Where two windows overlap their emissions are averaged, with more weight on the one whose
centre is nearer, and one Viterbi pass over the whole text reconciles them. No span can lie where
every way through a tag scores less than staying outside; such stretches are found first by sums (see
`_undecided`), so the pass runs on the rest and gives what it gives on the whole text.

Gates are piecewise linear (clipped lines), so a step is one small product and a few passes.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, schema_of, table, to_arrow_schema

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WINDOW, STRIDE = 512, 464
TRAINED = 64  # characters of a training window
BATCH = 2048  # windows that step together
LONG = 1 << 20  # characters that are scored at once
SYMBOLS = 99

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # kind index, start, end


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(run: str) -> bool:
    own = run.lstrip("0")
    return len(own) <= 3 and int(own or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, failing matches dropped, in order of kind and start; linear in the text."""
    out: list[Span] = []
    at = cursor = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            cursor = at = m.end()
        else:
            at += 1
    if not _DIGITS.search(text):
        return out
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        runs = [(r.start() + m.start(), r.end() + m.start()) for r in re.finditer(r"[0-9]+", m[0])]
        for k in range(0, len(runs) - 3, 4):
            four = runs[k : k + 4]
            if all(_octet(text[a:b]) for a, b in four):
                out.append((1, four[0][0], four[3][1]))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- training data -------------------------------------------------------------------------

_SYLLABLES = "the an er on in at es re th ou ti is or en ed nd ha to ly ble sh st wh ing tion é è ç ü ö ä ñ ó que la de con ein sch lich der ado ción ra os il".split()


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _word(rng: np.random.Generator, plain: bool = False) -> str:
    if rng.random() < 0.25:
        w = "".join(_LETTERS[i] for i in rng.integers(0, 26, rng.integers(1, 12)))
    else:
        w = "".join(x for x in (_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), rng.integers(1, 6))) if not plain or x.isascii())
    return (w or "an").capitalize() if rng.random() < 0.1 else w or "an"


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _made(rng: np.random.Generator, kind: int) -> str:
    d, pick = lambda n: _digits(rng, n), lambda *x: x[rng.integers(0, len(x))]
    if kind == 0:
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."))
        dot = pick(dot, dot, dot.upper()) if "dot" in dot else dot
        user = _word(rng, True) + pick("", "." + _word(rng, True), "_" + d(2), "." + d(2), "-" + _word(rng, True))
        host = _word(rng, True).lower() + pick("", d(1), dot + _word(rng, True).lower())
        return user + at + host + dot + pick("com", "org", "net", "de", "example.com")
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        return pick(d(16), d(16), d(16), " ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4)), f"{d(4)} {d(6)} {d(5)}", f"{d(4)}-{d(6)}-{d(5)}")
    return pick(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}")


def _unlabelled(rng: np.random.Generator, runs: bool = True) -> str:
    """What looks like a span and is none; runs: also digits in numbers that no card has, which a count tells apart."""
    d, pick = lambda n: _digits(rng, n), lambda *x: x[rng.integers(0, len(x))]
    code = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40))
    return pick(f'token = "{code}"', code, f"Version {d(1)}.{d(1)}.", f"{d(1)}.{d(1)}", f"20{d(2)}", f"20{d(2)} 20{d(2)}", f"{d(2)} 20{d(2)}", f"20{d(2)} {d(2)} {d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}:{d(2)}", d(5), d(2), d(8), f"{d(1)},{d(3)}.{d(2)}", f"https://{_word(rng, True)}.org/{d(3)}", f"{d(3)}%", f"({d(2)})", "@ " + _word(rng),
        f"({_word(rng)} at {_word(rng)})", f"({_word(rng)})", f"({_word(rng)} {_word(rng)})", f"({_word(rng)} {_word(rng)} {_word(rng)})", f"{_word(rng)}'s", f"[{d(1)}]", "at the dot", "(at)", "dot. com", f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}_{_word(rng)}({d(1)}, {d(2)})", f"{d(1)}.{d(2)}.{d(1)}", d(12) if runs else d(7), d(24) if runs else d(6), f"#{d(6)}", f"{d(2)}/{d(2)}/20{d(2)}", "-" * 12, "=" * 9, "$$$", "***", "日本語の文", "Текст на", "<b>", f"&{_word(rng)};", f"+{d(2)}", f"-{d(1)}.{d(4)}")


def labelled_windows(n: int = 2400, seed: int = 7, runs: bool = True) -> list[tuple[str, list[Span]]]:
    """Invented prose with labelled spans, every second text without any; for `runs` see `_unlabelled`."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        text, spans = "", []
        while len(text) < TRAINED * 2:
            for _ in range(rng.integers(1, 5)):
                text += _word(rng) + (", " if rng.random() < 0.08 else ". " if rng.random() < 0.06 else "\n" if rng.random() < 0.04 else " ")
            if rng.random() < 0.35 or k % 2:
                text += _unlabelled(rng, runs) if rng.random() < 0.6 else ""
            else:
                kind = int(rng.integers(0, len(KINDS)))
                made = _made(rng, kind)
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            text += ("" if rng.random() < 0.15 else "." if rng.random() < 0.1 else "!!" if rng.random() < 0.05 else " |" if rng.random() < 0.05 else "") + " "
        while rng.random() < 0.7:
            text += _word(rng) + (", " if rng.random() < 0.08 else " ")
        out.append((text.rstrip() + ("." if rng.random() < 0.6 and not (spans and spans[-1][2] >= len(text.rstrip())) else ""), spans))
    return out


# --- network -------------------------------------------------------------------------------


_SYMBOL = np.full(0x2000, 97, np.uint8)
_SYMBOL[:32] = 96
_SYMBOL[32:127] = np.arange(1, 96)


def symbols(text: str) -> np.ndarray:
    """Printable ASCII by character, control characters, letters of other scripts, and what lies beyond; 0 is padding."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 0x2000, _SYMBOL[np.minimum(c, 0x1FFF)], np.uint8(98))


def _lstm(xw: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, list]:
    """Outputs of all steps and what the way back needs; xw: (steps, batch, 4 hidden), gates as input, forget, output, candidate."""
    steps, batch, four = xw.shape
    n = four // 4
    h, c = np.zeros((batch, n), xw.dtype), np.zeros((batch, n), xw.dtype)
    out, memo = np.empty((steps, batch, n), xw.dtype), []
    for t in range(steps):
        z = xw[t] + h @ wh
        gates = np.clip(0.25 * z[:, : 3 * n] + 0.5, 0, 1)
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        g = np.clip(z[:, 3 * n :], -1, 1)
        before, last = c, h
        c = f * c + i * g
        tc = np.clip(c, -1, 1)
        h = o * tc
        out[t] = h
        memo.append((i, f, o, g, before, c, tc, last))
    return out, memo


def _lstm_back(dout: np.ndarray, memo: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, n = dout.shape
    dxw, dwh = np.empty((steps, batch, 4 * n), dout.dtype), np.zeros_like(wh)
    dh, dc = np.zeros((batch, n), dout.dtype), np.zeros((batch, n), dout.dtype)
    slope = lambda x: 0.25 * ((x > 0) & (x < 1))
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, c, tc, last = memo[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (np.abs(c) < 1)
        dz = np.concatenate((dc * g * slope(i), dc * before * slope(f), dh * tc * slope(o), dc * i * (np.abs(g) < 1)), 1).astype(dout.dtype)
        dxw[t] = dz
        dwh += last.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dxw, dwh


def _run(ids: np.ndarray, active: np.ndarray, table: np.ndarray, both: np.ndarray, back: bool, e: np.ndarray) -> None:
    """Adds the emissions (steps, tags, batch) of one direction to e; table: (4 hidden, symbols), scaled so that gates are clipped sums. Windows go from long to short, and the first `active` of a step reach it.

    `both` stacks the recurrent weights on those of the tags, so one product gives a step's scores and what the next step starts from, and no states are kept.
    """
    steps, batch = ids.shape
    n = both.shape[1]
    cell, hidden, given = np.zeros((n, batch), np.float32), np.empty((n, batch), np.float32), np.empty((4 * n, batch), np.float32)
    sums = np.zeros((len(both), batch), np.float32)  # windows that begin here (or, backwards, end here) have no state yet
    m = 0
    for t in range(steps - 1, -1, -1) if back else range(steps):
        if m != active[t]:
            m = int(active[t])
            c, h, x, after, z, scores = cell[:, :m], hidden[:, :m], given[:, :m], sums[:, :m], sums[: 4 * n, :m], sums[4 * n :, :m]
            i, f, o, gates, g = z[:n], z[n : 2 * n], z[2 * n : 3 * n], z[: 3 * n], z[3 * n :]
        np.take(table, ids[t, :m], axis=1, out=x, mode="clip")
        z += x
        np.clip(gates, 0, 1, out=gates)  # one pass, and a faster one than minimum or maximum
        np.clip(g, -1, 1, out=g)
        c *= f
        g *= i
        c += g
        np.clip(c, -1, 1, out=h)
        h *= o
        np.matmul(both, h, out=after)
        e[t, :, :m] += scores


class Tagger:
    """Parameters by name; float32, and float64 while they are trained."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @staticmethod
    def fresh(hidden: int = 10, width: int = 10, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        u = lambda *s: rng.uniform(-1, 1, s) / np.sqrt(s[0])
        p = {"emb": rng.normal(0, 0.5, (SYMBOLS, width)), "out": u(2 * hidden, TAGS), "ob": np.zeros(TAGS), "tr": np.zeros((TAGS, TAGS))}
        for d in "fb":
            b = np.zeros(4 * hidden)
            b[hidden : 2 * hidden] = 1
            p |= {f"wx{d}": u(width, 4 * hidden), f"wh{d}": u(hidden, 4 * hidden), f"b{d}": b}
        return Tagger(p)

    def learn(self, ids: np.ndarray):
        """(scores (steps, batch, tags), what the way back needs) of ids (batch, steps)."""
        p, x = self.p, self.p["emb"][ids.T]
        hf, mf = _lstm(x @ p["wxf"] + p["bf"], p["whf"])
        hb, mb = _lstm(x[::-1] @ p["wxb"] + p["bb"], p["whb"])
        h = np.concatenate((hf, hb[::-1]), 2)
        return h @ p["out"] + p["ob"], (x, h, mf, mb)

    def emissions(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores (steps, tags, batch) of ids (steps, batch), windows of falling sizes; only those within a window's size mean anything."""
        active = np.searchsorted(-sizes, -np.arange(len(ids)), "left")
        p, n = self.p, len(self.p["whf"])
        e = np.zeros((len(ids), TAGS, ids.shape[1]), np.float32)
        for d, rows in (("f", slice(None, n)), ("b", slice(n, None))):
            table, wh = (p["emb"] @ p[f"wx{d}"] + p[f"b{d}"]).T.copy(), p[f"wh{d}"].T.copy()
            table[: 3 * n] = 0.25 * table[: 3 * n] + 0.5
            wh[: 3 * n] *= 0.25
            _run(ids, active, table, np.concatenate((wh, p["out"][rows].T)), d == "b", e)
        e += p["ob"][:, None]
        return e

    def viterbi(self, e: np.ndarray, before: bool = False, after: bool = False) -> np.ndarray:
        """Best tags of one sequence of emissions; `before` and `after`: there are neighbours, which are outside."""
        tr, steps = self.p["tr"] + _ALLOWED, len(e)
        back, score = np.empty((steps, TAGS), np.int8), e[0] + (tr[0] if before else _START)
        for t in range(1, steps):
            all_ = score[:, None] + tr
            back[t] = all_.argmax(0)
            score = all_.max(0) + e[t]
        tags = np.empty(steps, np.int64)
        tags[-1] = (score + tr[:, 0] if after else score).argmax()
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


_ALLOWED = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _ALLOWED[:, 2 + 2 * _k] = -1e4
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0
_START = np.zeros(TAGS, np.float32)
_START[2::2] = -1e4


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _crf(e: np.ndarray, tr: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, its gradient by emissions and by transitions), means over the batch; y: (steps, batch)."""
    steps, batch, _ = e.shape
    t_all = tr + _ALLOWED
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, steps):
        a[t] = _logsum(a[t - 1][:, :, None] + t_all, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        b[t] = _logsum(t_all + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _logsum(a[-1], 1)
    de = np.exp(a + b - z[None, :, None])
    dtr = np.zeros_like(tr)
    for t in range(1, steps):
        dtr += np.exp(a[t - 1][:, :, None] + t_all + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
    tt, bb = np.meshgrid(np.arange(steps), np.arange(batch), indexing="ij")
    gold = e[tt, bb, y].sum() + t_all[y[:-1], y[1:]].sum()
    de[tt, bb, y] -= 1
    np.subtract.at(dtr, (y[:-1].ravel(), y[1:].ravel()), 1)
    return float(z.sum() - gold) / batch, de / batch, dtr / batch


def loss_and_gradient(tagger: Tagger, ids: np.ndarray, y: np.ndarray, own: float = 0.5) -> tuple[float, dict[str, np.ndarray]]:
    """CRF likelihood of tags y (steps, batch) of ids (batch, steps), and `own` times that of each tag by its emissions alone, which keeps prose far from any tag."""
    p, batch = tagger.p, len(ids)
    e, (x, h, mf, mb) = tagger.learn(ids)
    loss, de, dtr = _crf(e, p["tr"], y)
    chance = np.exp(e - e.max(2, keepdims=True))
    chance /= chance.sum(2, keepdims=True)
    loss -= own / batch * float(np.log(np.take_along_axis(chance, y[:, :, None], 2)).sum())
    np.put_along_axis(chance, y[:, :, None], np.take_along_axis(chance, y[:, :, None], 2) - 1, 2)
    de = de + (own / batch) * chance
    n = h.shape[2] // 2
    dh = de @ p["out"].T
    dxf, dwhf = _lstm_back(dh[:, :, :n], mf, p["whf"])
    dxb, dwhb = _lstm_back(dh[::-1, :, n:], mb, p["whb"])
    flat = lambda a: a.reshape(-1, a.shape[-1])
    dx = dxf @ p["wxf"].T + (dxb @ p["wxb"].T)[::-1]
    demb = np.zeros_like(p["emb"])
    np.add.at(demb, ids.T.ravel(), flat(dx))
    return loss, {"emb": demb, "out": flat(h).T @ flat(de), "ob": flat(de).sum(0), "tr": dtr, "wxf": flat(x).T @ flat(dxf), "whf": dwhf, "bf": flat(dxf).sum(0), "wxb": flat(x[::-1]).T @ flat(dxb), "whb": dwhb, "bb": flat(dxb).sum(0)}


def train(examples: list[tuple[str, list[Span]]], steps: int = 500, batch: int = 64, rate: float = 0.015, seed: int = 5) -> Tagger:
    """Adam over random windows of the labelled texts, in float64 and in one fixed order."""
    rng, tagger = np.random.default_rng(seed), Tagger.fresh()
    coded = []
    for text, spans in examples:
        y = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            y[a:b] = 2 + 2 * kind
            y[a] = 1 + 2 * kind
        if len(text) >= TRAINED:
            coded.append((symbols(text), y))
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    for step in range(1, steps + 1):
        ids, ys = [], []
        for k in rng.integers(0, len(coded), batch):
            s, y = coded[k]
            at = int(rng.integers(0, len(s) - TRAINED + 1))
            for _ in range(8):  # rather no span that is cut
                if not (y[at] and y[at] % 2 == 0) and not (at + TRAINED < len(y) and y[at + TRAINED] and y[at + TRAINED] % 2 == 0):
                    break
                at = int(rng.integers(0, len(s) - TRAINED + 1))
            if rng.random() < 0.2:  # the end of a text
                end, n = len(s), int(rng.integers(TRAINED // 4, TRAINED))
                s, y, at = np.concatenate((s[end - n :], np.zeros(TRAINED - n, s.dtype))), np.concatenate((y[end - n :], np.zeros(TRAINED - n, y.dtype))), 0
            gold = y[at : at + TRAINED].copy()
            if gold[0] and gold[0] % 2 == 0:
                gold[0] -= 1  # a span cut by the window begins here
            ids.append(s[at : at + TRAINED])
            ys.append(gold)
        _, grads = loss_and_gradient(tagger, np.array(ids), np.array(ys).T)
        p = tagger.p
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads.values()))) / 5)
        for k, g in grads.items():
            g = g / norm
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return tagger


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    """The tagger that `train_pii` has trained and rounded once; nothing is trained when a query runs."""
    held = json.loads((Path(__file__).parent / "pii_tagger.json").read_text())
    return Tagger({k: np.array(v, np.float32) for k, v in held["weights"].items()})


# --- decoding ------------------------------------------------------------------------------


def _plausible(kind: int, s: str) -> bool:
    n = len(_DIGITS.findall(s))
    if kind == 0:
        return bool(re.search(r"@|[(\[{]\s?at\s?[)\]}]", s, re.I)) and bool(re.search(r"\.|dot", s, re.I))
    if kind == 1:
        parts = s.split(".")
        return len(parts) == 4 and all(x.isdigit() and int(x[:9]) <= 255 for x in parts)
    return 13 <= n <= 19 if kind == 2 else 7 <= n <= 15


def _whole_number(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """A card or phone number that the tagger cut goes on to the ends of its digits (cards: with single blanks or hyphens between, as far as 19 digits allow)."""
    if kind < 2:
        return a, b
    digits = len(_DIGITS.findall(text[a:b]))
    gap = " -" if kind == 2 else ""
    while digits <= 19 and b < len(text) and (text[b].isdigit() or (text[b] in gap and text[b + 1 : b + 2].isdigit())):
        digits, b = digits + text[b].isdigit(), b + 1
    while digits <= 19 and a > 0 and (text[a - 1].isdigit() or (text[a - 1] in gap and a > 1 and text[a - 2].isdigit())):
        digits, a = digits + text[a - 1].isdigit(), a - 1
    return a, b


class _Emissions:
    """Emissions of texts that stand one after another in ids, each under windows of its own.

    `window_range` takes only these windows of a single text; characters then count from the first one's start on.
    They stay as the network gives them, tags beside windows. `lead` has for each character how much the best
    other tag scores over O, and `rows` puts out the scores of a range.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, tagger: Tagger, window_range: tuple[int, int] | None = None):
        count = np.where(lengths > WINDOW, -(-(lengths - WINDOW) // STRIDE) + 1, (lengths > 0).astype(np.int64))
        start = np.cumsum(lengths) - lengths
        if window_range:
            text, k = np.zeros(window_range[1] - window_range[0], np.int64), np.arange(*window_range)
        else:
            text = np.repeat(np.arange(len(lengths)), count)
            k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(WINDOW, lengths[text] - k * STRIDE)
        at = start[text] + k * STRIDE
        wide = size + (k == count[text] - 1)  # the end of a text is one symbol of padding
        self.joined = k > (window_range[0] if window_range else 0)  # begins in the window before
        goes_on = np.append(self.joined[1:], False)[: len(k)]
        own = np.where(goes_on, STRIDE, size)  # the characters up to the next window
        self.begin = at - (at[0] if len(at) else 0)
        self.size = int(self.begin[-1] + size[-1]) if len(at) else 0
        self.lead = np.empty(self.size, np.float32)
        self.pair = np.cumsum(self.joined) - 1
        pairs, share = int(self.joined.sum()), ((np.arange(WINDOW - STRIDE) + 0.5) / (WINDOW - STRIDE)).astype(np.float32)[:, None, None]
        heads, tails = np.empty((2, WINDOW - STRIDE, TAGS, pairs), np.float32)
        self.blocks, self.slot = [], np.empty(len(k), np.int64)
        order = np.argsort(-wide, kind="stable")
        self.slot[order] = np.arange(len(order))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            step = np.arange(int(wide[part[0]]))[:, None]
            chars = ids[np.minimum(at[part] + step, len(ids) - 1)]
            chars[step >= size[part]] = 0
            e = tagger.emissions(chars, wide[part])
            self.blocks.append(e)
            if len(to := np.flatnonzero(self.joined[part])):
                heads[:, :, self.pair[part[to]]] = e[: WINDOW - STRIDE, :, to]
            if len(to := np.flatnonzero(goes_on[part])):
                tails[:, :, self.pair[part[to] + 1]] = e[STRIDE:WINDOW, :, to]
            lead = (e[:, 1:].max(1) - e[:, 0]).T.copy()
            for row, b, n in zip(lead, self.begin[part].tolist(), own[part].tolist()):
                self.lead[b : b + n] = row[:n]
        self.both = np.multiply(share, heads, out=heads)  # what two windows say of the characters where they overlap
        self.both += np.multiply(1 - share, tails, out=tails)
        lead = (self.both[:, 1:].max(1) - self.both[:, 0]).T.copy()
        for row, b in zip(lead, self.begin[self.joined].tolist()):
            self.lead[b : b + WINDOW - STRIDE] = row

    def rows(self, a: int, b: int) -> np.ndarray:
        """(characters, tags) from a to b."""
        out, at, w = np.empty((b - a, TAGS), np.float32), a, int(np.searchsorted(self.begin, a, "right")) - 1
        while at < b:
            end = min(b, int(self.begin[w + 1]) if w + 1 < len(self.begin) else self.size)
            block, column = divmod(int(self.slot[w]), BATCH)
            q = at - int(self.begin[w])
            out[at - a : end - a] = self.blocks[block][q : q + end - at, :, column]
            if self.joined[w] and q < WINDOW - STRIDE:
                over = self.both[q : q + end - at, :, self.pair[w]]
                out[at - a : at - a + len(over)] = over
            at, w = end, w + 1
        return out


def _scores(ids: np.ndarray, lengths: np.ndarray, tagger: Tagger) -> np.ndarray:
    """(characters, tags): all emissions of texts that stand one after another in ids."""
    e = _Emissions(ids, lengths, tagger)
    return e.rows(0, e.size)


def _undecided(lead: np.ndarray, lengths: np.ndarray, tagger: Tagger) -> list[tuple[int, int]]:
    """Ranges outside which the best tags are all O; lead: how much the best other tag scores over O.

    A stretch with tags, from one O to the next, scores at most the sum of lead + inside over its characters plus
    `edge` over staying outside, where inside and edge hold the best transitions. So a character can have a tag only if
    some stretch around it sums to -edge or more. The best sum around a character is that of the best stretch that ends there and that of the best one that begins there.
    """
    tr = tagger.p["tr"].astype(np.float64) + _ALLOWED
    stay = tr[0, 0]
    inside = tr[1:, 1:].max() - stay
    edge = max(tr[0, 1:].max() - stay, 0.0) + max(tr[1:, 0].max() - stay, 0.0) - inside
    start = np.cumsum(lengths) - lengths

    def ending(x: np.ndarray) -> np.ndarray:
        sums = np.cumsum(x)
        return sums - np.minimum.accumulate(np.concatenate(([0.0], sums[:-1])))

    out = []
    # Where each character is below both bounds, so is each sum: most texts need no sums.
    hot = np.flatnonzero(lead >= min(-edge, 0.0) - inside - 1e-2)
    for text in np.unique(np.searchsorted(start, hot, "right") - 1):
        a, n = int(start[text]), int(lengths[text])
        s = lead[a : a + n].astype(np.float64) + inside
        best = ending(s) + ending(s[::-1])[::-1] - s
        some = best >= -edge - 1e-3 - 1e-9 * n
        turn = np.flatnonzero(np.diff(np.concatenate(([False], some, [False])).view(np.int8)))
        out += zip((a + turn[::2]).tolist(), (a + turn[1::2]).tolist())
    return out


def _tagged(ids: np.ndarray, lengths: np.ndarray, tagger: Tagger) -> list[tuple[int, np.ndarray]]:
    """(first character, tags) of the ranges that may hold spans."""
    if len(lengths) == 1 and len(ids) > LONG:  # scored in parts, and the ranges once more
        last = -(-(len(ids) - WINDOW) // STRIDE) + 1
        step = LONG // STRIDE
        lead = np.empty(len(ids), np.float32)

        def scored(a: int, b: int) -> tuple[_Emissions, int]:
            x, y = max(0, a // STRIDE - 1), min(last, (b - 1) // STRIDE + 1)
            return _Emissions(ids, lengths, tagger, (x, y)), x * STRIDE

        def rows(a: int, b: int) -> np.ndarray:
            e, x = scored(a, b)
            return e.rows(a - x, b - x)

        for w in range(0, last, step):
            a, b = w * STRIDE, len(ids) if w + step >= last else (w + step) * STRIDE
            e, x = scored(a, b)
            lead[a:b] = e.lead[a - x : b - x]
    else:
        e = _Emissions(ids, lengths, tagger)
        lead, rows = e.lead, e.rows

    start = np.cumsum(lengths) - lengths
    out = []
    for a, b in _undecided(lead, lengths, tagger):
        text = int(np.searchsorted(start, a, "right")) - 1
        while not lengths[text]:
            text -= 1
        out.append((a, tagger.viterbi(rows(a, b), a > start[text], b < start[text] + lengths[text])))
    return out


def tagger_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """What the tagger marks in whole texts, without outer white space."""
    out: list[list[Span]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return out
    start = np.cumsum(lengths) - lengths
    for a, tags in _tagged(symbols("".join(texts)), lengths, tagger):
        i = int(np.searchsorted(start, a, "right")) - 1
        a, at = a - int(start[i]), 0
        while at < len(tags):
            if tags[at] == 0:
                at += 1
                continue
            kind, end = int(tags[at] - 1) // 2, at + 1
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            s = texts[i][a + at : a + end]
            x, y = a + at + len(s) - len(s.lstrip()), a + at + len(s.rstrip())
            if y > x:
                out[i].append((kind, x, y))
            at = end
    return out


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """Spans of the tagger that hold what their kind can't be without and touch no base span."""
    out: list[list[Span]] = []
    for text, taken, spans in zip(texts, base, tagger_spans(texts, tagger), strict=True):
        ends, starts = sorted(q for _, _, q in taken), sorted(p for _, p, _ in taken)
        # A base span touches (x, y) unless it ends by x or starts at y or later.
        free = lambda x, y: bisect_right(ends, x) + len(starts) - bisect_left(starts, y) == len(taken)
        whole = sorted({(k, *_whole_number(text, k, x, y)) for k, x, y in spans})
        out.append([(k, x, y) for k, x, y in whole if free(x, y) and _plausible(k, text[x:y])])
    return out


SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_pii(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, keep: list[str] | None = None) -> DataFrame:
    """id, spans array<struct(kind, start, end, base)>, and with `redact` the text with each span replaced by its kind in angle brackets.

    Spans go by kind (email, ip, card, phone), then start; code points, end exclusive. A null or
    empty text has no spans (and stays as it is); very long texts are taken whole; repeated
    rows are searched again; a null id stays null; no rows give no rows; other columns are ignored,
    or those in `keep` are passed through, before spans. Without `keep`, ids are whole numbers, or texts of digits.
    """
    own = docs.select(*keep) if keep else docs.select(F.col(id_col).cast("long"), text_col)
    cols = own.columns if keep else [id_col]
    at = own.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((tagger or default_tagger()).p)
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    types = pa.schema([*to_arrow_schema(own.select(*cols).schema), ("spans", item), *[("redacted", pa.string())] * redact])

    def rows(batch: pa.RecordBatch):
        model = Tagger(shared.value)
        for a, b in byte_slices(batch.column(at)):
            texts = batch.column(at).slice(a, b - a).to_pylist()
            base = [base_spans(x) if x else [] for x in texts]
            more = added_spans([x or "" for x in texts], base, model)
            both = [sorted([(*s, True) for s in p] + [(*s, False) for s in q]) for p, q in zip(base, more, strict=True)]
            out = {c: batch.column(k).slice(a, b - a) for k, c in enumerate(cols)} | {"spans": [[{"kind": KINDS[k], "start": x, "end": y, "base": z} for k, x, y, z in own] for own in both]}
            if redact:
                out["redacted"] = [redacted(x, own) for x, own in zip(texts, both, strict=True)]
            yield out

    return arrow_map(own, rows, schema_of(own, cols) + f", spans {SPAN_TYPE}" + ", redacted string" * redact, types)


def redacted(text: str | None, spans: list) -> str | None:
    """Spans replaced by `<KIND>`; of spans that overlap, the union gets the first one's kind."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
