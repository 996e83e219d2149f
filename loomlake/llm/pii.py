"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The model, trained in numpy on generated
sentences with labelled spans, adds spans of forms that the patterns miss (numbers
without a plus sign, cards with dots, addresses in other alphabets, IPv6, secrets).
Each kind holds a digit or ``@``, so the model reads the surroundings of those
characters wherever they stand in the text: regions of overlapping windows, each
decoded by Viterbi. Spans cut by a window's edge are joined with those of the
neighbouring windows, over as many windows as they reach; what stays cut is dropped.
Of all spans of a text the non-overlapping set with the largest total score is kept.
Spans touching a base span are dropped.

Null text counts as empty and has no spans. Positions are code points, end exclusive.
Repeated rows each get their own row.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
WINDOW, STRIDE, MARGIN, MIN_SCORE = 128, 64, 48, 4.0
BATCH_WINDOWS = 2048

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, in linear time."""
    out: list[tuple[str, int, int]] = []
    last = 0
    for m in _AT_DOMAIN.finditer(text):
        s = m.start()
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append(("email", s, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return in_order(out)


def in_order(spans):
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in in_order(spans))


# --- the model -----------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
PAD, OTHER, SYMBOLS = 0, 1, 2 + 128
EMBED, HIDDEN = 12, 20


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points + 2, OTHER).astype(np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x, W, b):
    """x: (T, B, E). Hidden states and what the backward pass needs."""
    T, B, _ = x.shape
    H = W.shape[1] // 4
    pre = x @ W[: x.shape[2]] + b
    h, c = np.zeros((B, H), x.dtype), np.zeros((B, H), x.dtype)
    hs, kept = np.empty((T, B, H), x.dtype), []
    for t in range(T):
        z = pre[t] + h @ W[x.shape[2] :]
        s, g = _sigmoid(z[:, : 3 * H]), np.tanh(z[:, 3 * H :])
        i, f, o = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        kept.append((h, c, i, f, o, g, tc))
        h, c = o * tc, c_new
        hs[t] = h
    return hs, kept


def _backward(x, W, dh, kept):
    E, H = x.shape[2], W.shape[1] // 4
    dW, db, dx = np.zeros_like(W), np.zeros(W.shape[1], W.dtype), np.empty_like(x)
    next_h, next_c = np.zeros_like(dh[0]), np.zeros_like(dh[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc = kept[t]
        d = dh[t] + next_h
        dc = d * o * (1 - tc * tc) + next_c
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dW[:E] += x[t].T @ dz
        dW[E:] += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ W[:E].T
        next_h, next_c = dz @ W[E:].T, dc * f
    return dW, db, dx


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def crf_gradient(e, tags, move, first):
    """Negative log likelihood of tag paths, and its gradients. e: (T, B, K)."""
    T, B, _ = e.shape
    a = np.empty_like(e)
    a[0] = e[0] + first
    for t in range(1, T):
        a[t] = e[t] + _lse(a[t - 1][:, :, None] + move, 1)
    z = _lse(a[-1], 1)
    b = np.zeros_like(e)
    d_move = np.zeros_like(move)
    for t in range(T - 2, -1, -1):
        onward = e[t + 1] + b[t + 1]
        both = a[t][:, :, None] + move + onward[:, None, :]
        b[t] = _lse(move + onward[:, None, :], 2)
        d_move += np.exp(both - z[:, None, None]).sum(0)
    d_e = np.exp(a + b - z[None, :, None])
    rows = np.arange(B)
    gold = first[tags[0]] + e[0, rows, tags[0]]
    d_first = d_e[0].sum(0)
    np.subtract.at(d_first, tags[0], 1)
    for t in range(T):
        d_e[t, rows, tags[t]] -= 1
        if t:
            gold = gold + move[tags[t - 1], tags[t]] + e[t, rows, tags[t]]
            np.subtract.at(d_move, (tags[t - 1], tags[t]), 1)
    return float((z - gold).mean()), d_e / B, d_move / B, d_first / B


def forbidden() -> np.ndarray:
    """Large negative for moves into the inside of a kind from elsewhere."""
    no = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        no[[t for t in range(TAGS) if t not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -1e4
    return no


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, B) symbols to (T, B, TAGS)."""
        w = self.weights
        v = w["embed"][x]
        there, _ = _forward(v, w["there"], w["there_b"])
        back, _ = _forward(v[::-1], w["back"], w["back_b"])
        return np.concatenate([there, back[::-1]], 2) @ w["out"] + w["out_b"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (T, B), and by how much each position's tag beats 'outside'."""
        e = self.emissions(x)
        move, first = self.weights["move"] + forbidden(), self.weights["first"] + forbidden()[0]
        T, B, K = e.shape
        best, back = e[0] + first, np.empty((T, B, K), np.int8)
        for t in range(1, T):
            s = best[:, :, None] + move
            back[t] = s.argmax(1)
            best = s.max(1) + e[t]
        path = np.empty((T, B), np.int64)
        path[-1] = best.argmax(1)
        rows = np.arange(B)
        for t in range(T - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        gain = np.take_along_axis(e, path[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return path, gain


def fit(windows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 350, batch: int = 64, length: int = 80, seed: int = 11) -> Model:
    """Trains on (text, spans) pairs by gradient descent with adaptive steps."""
    rng = np.random.default_rng(seed)
    x = np.full((len(windows), length), PAD, np.int64)
    y = np.zeros((len(windows), length), np.int64)
    for n, (text, spans) in enumerate(windows):
        c = encode(text)[:length]
        x[n, : len(c)] = c
        for kind, s, e in spans:
            k = KINDS.index(kind)
            y[n, s:e] = 2 + 2 * k
            y[n, s : s + 1] = 1 + 2 * k
    f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"embed": f(SYMBOLS, EMBED) * 3, "there": f(EMBED + HIDDEN, 4 * HIDDEN), "back": f(EMBED + HIDDEN, 4 * HIDDEN), "out": f(2 * HIDDEN, TAGS), "move": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32), "out_b": np.zeros(TAGS, np.float32)}
    for side in ("there_b", "back_b"):
        w[side] = np.zeros(4 * HIDDEN, np.float32)
        w[side][HIDDEN : 2 * HIDDEN] = 1  # remember at first
    square = {k: np.zeros_like(v) for k, v in w.items()}
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        xb, yb = x[pick].T, y[pick].T
        v = w["embed"][xb]
        there, kept_t = _forward(v, w["there"], w["there_b"])
        back, kept_b = _forward(v[::-1], w["back"], w["back_b"])
        h = np.concatenate([there, back[::-1]], 2)
        _, d_e, d_move, d_first = crf_gradient(h @ w["out"] + w["out_b"], yb, w["move"] + forbidden(), w["first"] + forbidden()[0])
        d_h = d_e @ w["out"].T
        g = {"out": np.tensordot(h, d_e, ([0, 1], [0, 1])), "out_b": d_e.sum((0, 1)), "move": d_move, "first": d_first}
        g["there"], g["there_b"], dx1 = _backward(v, w["there"], d_h[:, :, :HIDDEN], kept_t)
        g["back"], g["back_b"], dx2 = _backward(v[::-1], w["back"], d_h[::-1, :, HIDDEN:], kept_b)
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], xb, dx1 + dx2[::-1])
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in w:
            q = g[k] * min(1.0, 5 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * q
            square[k] = 0.99 * square[k] + 0.01 * q * q
            w[k] = (w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(w)


# --- generated training sentences ------------------------------------------------

_PARTS = "the an er in re ent ou tion le de eau èr ñe ció üb sch ung ge ver as mi con ll he th st ing ha ea es ti or nd".split()


def _word(rng) -> str:
    return "".join(_PARTS[i] for i in rng.integers(0, len(_PARTS), rng.integers(1, 5)))


def _digits(rng, n) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng, sep) -> str:
    d = _digits(rng, 15)
    d += next(c for c in "0123456789" if _luhn(d + c))
    return sep.join(d[i : i + 4] for i in range(0, 16, 4))


def _example(rng, kind: str) -> str:
    pick = lambda *options: options[rng.integers(len(options))]
    n = lambda a, b: str(rng.integers(a, b))
    if kind == "email":
        return f"{_word(rng)}{pick('.', '_', '')}{pick(n(0, 100), _word(rng))}@{pick('mail', _word(rng))}{pick('', n(0, 10))}.{pick('example.com', 'org', 'co.uk', 'net', 'пример.рф')}"
    if kind == "ip":
        return pick(".".join(n(0, 256) for _ in range(4)), ":".join(f"{int(v):x}" for v in rng.integers(1, 65536, 8)))
    if kind == "card":
        return _card(rng, pick("", " ", "-", "."))
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return pick(f"+{n(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{n(1, 99)} {a} {b} {c}", f"00{n(20, 60)} {a} {b} {c}")
    return pick("", "sk-", "ghp_") + "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, rng.integers(18, 41)))


def _decoy(rng) -> str:
    pick = lambda *options: options[rng.integers(len(options))]
    n = lambda a, b: str(rng.integers(a, b))
    return pick(n(0, 10000), f"{n(1, 13)}.{n(0, 60)}", f"{n(1990, 2030)}-{n(1, 13)}-{n(1, 32)}", f"{n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 99)},{_digits(rng, 3)}.{_digits(rng, 2)}", f"{n(0, 24)}:{_digits(rng, 2)}", f"@{_word(rng)}", f"{_word(rng)}{n(0, 100)}", f"${n(1, 9999)}", f"{n(1, 100)}%", f"({n(1, 50)})", _digits(rng, rng.integers(5, 9)))


def training_windows(count: int = 4000, length: int = 80, seed: int = 3):
    """Sentences of invented words with labelled spans and with numbers that are none."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        text, spans = "", []
        while len(text) < length:
            roll = rng.random()
            if roll < 0.14:
                kind = KINDS[rng.integers(len(KINDS))]
                made = _example(rng, kind)
                if kind == "secret" and rng.random() < 0.7:
                    text += ("password=", 'token = "', "api_key: ", "secret=")[rng.integers(4)]
                spans.append((kind, len(text), len(text) + len(made)))
            elif roll < 0.24:
                made = _decoy(rng)
            else:
                made = _word(rng)
                made = (made, made.upper(), made.capitalize())[rng.choice(3, p=(0.8, 0.08, 0.12))]
            text += made + (" ", ". ", ", ", "\n", " | ", "### ", "!! ")[rng.choice(7, p=(0.7, 0.08, 0.08, 0.05, 0.03, 0.03, 0.03))]
        cut = int(rng.integers(0, 30))
        text = text[cut : cut + length]
        out.append((text, [(k, max(0, s - cut), min(length, e - cut)) for k, s, e in spans if e > cut and s - cut < length]))
    return out


@lru_cache(maxsize=2)
def default_model(steps: int = 350) -> Model:
    return fit(training_windows(), steps)


# --- decoding of whole texts ------------------------------------------------------


def regions(text: str):
    """(start, end) around runs of digits and ``@``; together they hold every one of them."""
    end = -1
    start = None
    for m in _TRIGGER.finditer(text):
        if start is None or m.start() - MARGIN > end:
            if start is not None:
                yield start, end
            start = max(0, m.start() - MARGIN)
        end = min(len(text), m.end() + MARGIN)
    if start is not None:
        yield start, end


def windows_of(text: str):
    """(start, end, cut at the left, cut at the right) covering all regions."""
    for a, b in regions(text):
        s = a
        while True:
            e = min(b, s + WINDOW)
            yield s, e, s > a, e < b
            if e == b:
                break
            s += STRIDE


def _spans(path, length):
    """Spans of one decoded window."""
    t = 0
    while t < length:
        if path[t]:
            k, s = (path[t] - 1) // 2, t
            t += 1
            while t < length and path[t] == 2 + 2 * k:
                t += 1
            yield KINDS[k], s, t
        else:
            t += 1


def stitched(pieces):
    """(kind, start, end, score) of the whole spans among a text's pieces, (window, kind, start,
    end, cut at the left, cut at the right, gains), and of cut ones joined. Neighbouring windows'
    pieces of one kind join if both hold the middle of their overlap; each counts on its side of it."""
    out, chains = [], {}
    for w, kind, s, e, left, right, gain in sorted(pieces, key=lambda p: p[:3]):
        middle = w + (WINDOW - STRIDE) // 2
        mine = [] if left else [(s, 0.0, s)]  # start, score before the place from which this piece counts, that place
        if s <= middle < e:
            joined_up = [(s0, score + float(gain0[at - p : middle - p].sum()), middle) for s0, score, at, p, right0, gain0 in chains.get((w - STRIDE, kind), ()) if p <= middle < p + len(gain0) and (right0 or left)]
            mine += sorted(joined_up, key=lambda c: (-c[1], c[0]))[:1]  # of those that join here the best, whatever follows
        for s0, score, at in mine:
            if not right:
                out.append((kind, s0, e, score + float(gain[at - s :].sum())))
            chains.setdefault((w, kind), []).append((s0, score, at, s, right, gain))
    return out


def plausible(kind: str, found: str) -> bool:
    """What a span of the model must hold: a trigger character, and for numbers the digits of their kind."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return bool(_TRIGGER.search(found))


def best_together(found):
    """Of (kind, start, end, score), the non-overlapping set with the largest total score."""
    found = sorted(set(found), key=lambda x: (x[2], x[1], x[0]))
    ends = [f[2] for f in found]
    best = [(0.0, None, 0)]
    for i, (_, s, _, score) in enumerate(found):
        j = bisect.bisect_right(ends, s, 0, i)
        take = best[j][0] + score
        best.append((take, i, j) if take > best[i][0] else (best[i][0], None, i))
    out, i = [], len(found)
    while i:
        _, took, j = best[i]
        if took is not None:
            out.append(found[took])
        i = j
    return out[::-1]


def find_all(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
    pieces: list[list] = [[] for _ in texts]
    held = []

    def flush():
        held.sort(key=lambda h: h[2] - h[1])
        for i in range(0, len(held), 512):
            part = held[i : i + 512]
            x = np.full((max(h[2] - h[1] for h in part), len(part)), PAD, np.int64)
            for n, (d, s, e, *_) in enumerate(part):
                x[: e - s, n] = encode(texts[d][s:e])
            path, gain = model.decode(x)
            for n, (d, s, e, left, right) in enumerate(part):
                for kind, a, b in _spans(path[:, n], e - s):
                    pieces[d].append((s, kind, s + a, s + b, left and a == 0, right and b == e - s, gain[a:b, n].copy()))
        held.clear()

    for d, t in enumerate(texts):
        if not _TRIGGER.search(t):
            continue
        for w in windows_of(t):
            held.append((d, *w))
            if len(held) >= BATCH_WINDOWS:
                flush()
    flush()
    out = []
    for t, b, p in zip(texts, base, pieces):
        f = [(kind, s, e, round(score, 3)) for kind, s, e, score in stitched(p) if score >= MIN_SCORE and plausible(kind, t[s:e])]
        taken = sorted((s, e) for _, s, e in b)
        starts = [s for s, _ in taken]
        reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
        free = []
        for kind, s, e, score in f:
            i = bisect.bisect_left(starts, e)
            if not i or reach[i - 1] <= s:
                free.append((kind, s, e, score))
        out.append((b, in_order(b + [x[:3] for x in best_together(free)])))
    return out


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model or default_model())  # a fixed size

    def run(batches):
        m = sent.value
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                got = find_all([t or "" for t in part.column("text").to_pylist()], m)
                n = [[sum(s[0] == k for s in base) for base, _ in got] for k in BASE_KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in n), pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]), pa.array([joined(every) for _, every in got])],
                    names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
