"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy on labelled windows: windows of sampled documents, labelled by the fixed patterns, and
generated ones, in which written forms that the patterns miss are labelled too: national phone numbers, and numbers that stand side
by side, where a pattern's match takes both and fails its check as a whole. Sampled windows that hold such a failing match aren't
learnt from, as the patterns can't tell what is in them. Every kind needs a digit or an @, so windows are laid over all stretches of a text around such characters; the
rest of the text can't hold a span. Scores of overlapping windows are averaged, each weighing by how far inside its window a
character lies, and one Viterbi path is decoded over the whole stretch. A decoded span is added if it passes its kind's
exact check, is confident, and meets no span of the patterns; then the stretch is decoded again with the added spans fixed, until none is added. A decoded
stretch of digits that is no number as a whole, but several with a space between two, counts as these.

Defined cases. Columns besides doc_id and text, whatever their names, aren't read by the search and pass through redaction
unchanged (n_chars is set anew). Null text: empty, no spans. Null doc_id: kept. Repeated rows: each is searched. An empty table gives an empty result; the
network is then trained on generated windows alone. Texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_document, seldom, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Documents that training windows are drawn from, windows of one document, generated windows.
SAMPLE_DOCS, DOC_WINDOWS, GENERATED = 300, 6, 2400
WINDOW, STEP, MARGIN = 64, 32, 24
UNITS, WIDTH, BATCH, PASSES = 24, 12, 64, 10
CONFIDENT = 0.6
N_TAGS = 1 + 2 * len(KINDS)

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: int, found: str) -> bool:
    if kind == 0:
        local, _, domain = found.partition("@")
        return bool(local) and set(local) <= _LOCAL and _DOMAIN.fullmatch(domain) is not None
    if kind == 1:
        parts = found.split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]+", p) is not None and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    digits = _digits(found)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind, then start."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:  # a match holds one @: its local part is the run before, so no start is tried twice
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        last = m.end() if m else at + 1
        if m:
            out.append((0, start, m.end()))
        at = text.find("@", last)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if valid(1, m[0])]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if valid(2, m[0])]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if valid(3, m[0])]
    return out


def failing(text: str) -> list[tuple[int, int]]:
    """Start and end of the card and phone patterns' matches that hold enough digits for either and fail their check."""
    found = [m for kind, p in ((2, _CARD), (3, _PHONE)) for m in p.finditer(text) if len(_digits(m[0])) >= 9 and not valid(kind, m[0])]
    return [(m.start(), m.end()) for m in found]


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# Characters: 0 beyond the text, printable ASCII, other white space, other letters, all else.
_CODE = np.full(0x110000, 97, np.uint8)
_CODE[32:127] = np.arange(1, 96)
_CODE[[9, 10, 11, 12, 13]] = 96
_CODE[0xC0:0x250] = 98
N_CODES = 99


def codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def stretches(text: str) -> list[tuple[int, int]]:
    """Start and end of the parts of the text around digits and @."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def tags(spans: list[Span], start: int, n: int) -> np.ndarray:
    """Tag of each of n characters from start: 0 outside, 1 + 2 * kind at a span's first character, 2 + 2 * kind inside."""
    out = np.zeros(n, np.uint8)
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        lo, hi = max(s - start, 0), min(e - start, n)
        if lo < hi and not out[lo:hi].any():
            out[lo:hi] = 2 + 2 * k
            if s >= start:
                out[lo] = 1 + 2 * k
    return out


def generated(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """n windows with spans, or with digits that are none, among made-up words."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[rng.integers(len(s))]
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("etaoinshrdlucmfwygpbéüñ") for _ in range(rng.integers(2, 9)))

    def card() -> str:
        body = str(rng.integers(3, 7)) + digits(rng.integers(12, 16))
        body = next(body[:-1] + str(c) for c in range(10) if luhn(body[:-1] + str(c)))
        return body if rng.random() < 0.5 else pick(" -").join(body[i : i + 4] for i in range(0, len(body), 4))

    made = (
        lambda: f"{word()}{pick('._-+')}{word()}{digits(rng.integers(0, 3))}@{word()}{pick(['', '-', '.'])}{word()}.{pick(['com', 'org', 'net', 'de', 'example.com'])}",
        lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        card,
        lambda: pick([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
    )
    others = (
        lambda: digits(rng.integers(1, 9)), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(3)}.{digits(2)}",
        lambda: f'{word()} = "{bytes(rng.integers(0, 256, 16, dtype=np.uint8)).hex()}"', lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()} @ {word()}", lambda: f"AKIA{word().upper()}{digits(3)}",
        lambda: digits(rng.integers(20, 30)), lambda: digits(rng.integers(8, 14)), lambda: f'{word()} = "{digits(rng.integers(8, 20))}{bytes(rng.integers(0, 256, 8, dtype=np.uint8)).hex()}"',
    )
    x, y = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.uint8)
    for i in range(n):
        text, spans = word() + " ", []
        while len(text) < WINDOW:
            if rng.random() < 0.3:
                if rng.random() < 0.6:
                    kind = int(rng.integers(4))
                    one = made[kind]()
                    spans.append((kind, len(text), len(text) + len(one)))
                    if kind > 1 and rng.random() < 0.5:  # side by side with another number
                        text += one + " "
                        kind = int(rng.integers(1, 5))
                        one = made[kind]() if kind < 4 else digits(rng.integers(1, 5))
                        spans += [(kind, len(text), len(text) + len(one))] * (kind < 4)
                else:
                    one = pick(others)()
                text += one + pick([" ", " ", ". ", ", ", "\n"])
            else:
                text += word() + pick([" ", " ", " ", ". ", "\n"])
        at = int(rng.integers(0, min(len(text) - WINDOW + 1, 20)))
        x[i], y[i] = codes(text)[at : at + WINDOW], tags(spans, at, WINDOW)
    return x, y


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """p: embed (codes x width); wx, wh, b of the two directions; wo, bo; step (tag to tag) and first (tag) scores."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        u = lambda *s: rng.normal(0, (1 / s[-2]) ** 0.5, s).astype(np.float32)
        b = np.zeros((2, 1, 4 * UNITS), np.float32)
        b[:, :, UNITS : 2 * UNITS] = 1  # remember at first
        return Network({"embed": u(N_CODES, WIDTH), "wx": u(2, WIDTH, 4 * UNITS), "wh": u(2, UNITS, 4 * UNITS), "b": b, "wo": u(2 * UNITS, N_TAGS), "bo": np.zeros(N_TAGS, np.float32), "step": np.zeros((N_TAGS, N_TAGS), np.float32), "first": np.zeros(N_TAGS, np.float32)})

    def emit(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Tag scores of each character, windows x length x tags. keep: gets what the backward pass needs."""
        p, (n, t), u = self.p, x.shape, UNITS
        table = p["embed"] @ p["wx"] + p["b"]
        both = np.stack([x, x[:, ::-1]])
        h, c = np.zeros((2, n, u), table.dtype), np.zeros((2, n, u), table.dtype)
        hs = np.empty((t, 2, n, u), table.dtype)
        for i in range(t):
            z = np.stack([table[0][both[0, :, i]], table[1][both[1, :, i]]]) + h @ p["wh"]
            s, g = _sigmoid(z[..., : 3 * u]), np.tanh(z[..., 3 * u :])
            was, c = c, s[..., u : 2 * u] * c + s[..., :u] * g
            tc = np.tanh(c)
            if keep is not None:
                keep.append((h, was, s, g, tc))
            h = s[..., 2 * u :] * tc
            hs[i] = h
        out = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)  # length x windows x 2u
        if keep is not None:
            keep.append((both, out))
        return (out @ p["wo"] + p["bo"]).transpose(1, 0, 2)

    def _passes(self, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scaled forward and backward passes over windows x length x tags: the tags' own shares, both passes and the scales, length first;
        the log of the sum over all paths."""
        p, (n, t, k) = self.p, e.shape
        most = e.max(axis=2)
        mass = np.exp(e - most[:, :, None]).transpose(1, 0, 2).astype(np.float64)
        step = np.exp(p["step"] - p["step"].max()).astype(np.float64)
        ahead, back, c = np.empty((t, n, k)), np.ones((t, n, k)), np.empty((t, n, 1))
        for i in range(t):
            a = (ahead[i - 1] @ step if i else np.exp(p["first"] - p["first"].max())) * mass[i]
            c[i] = a.sum(axis=1, keepdims=True)
            ahead[i] = a / c[i]
        for i in range(t - 2, -1, -1):
            back[i] = (mass[i + 1] * back[i + 1]) @ step.T / c[i + 1]
        return mass, ahead, back, c, np.log(c).sum(axis=(0, 2)) + most.sum(axis=1) + p["first"].max() + (t - 1) * p["step"].max()

    def posterior(self, e: np.ndarray) -> np.ndarray:
        """Probability of each tag of each character of one stretch, over all paths."""
        _, ahead, back, _, _ = self._passes(e[None])
        return (ahead * back)[:, 0]

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tags, a mean over windows."""
        p, keep = self.p, []
        e = self.emit(x, keep)
        n, t, k = e.shape
        mass, ahead, back, c, z = self._passes(e)
        de = ahead * back
        g = {v: np.zeros_like(w) for v, w in p.items()}
        g["first"] += de[0].sum(axis=0) - np.bincount(y[:, 0], minlength=k)
        pairs = ahead[:-1].reshape(-1, k).T @ (mass[1:] * back[1:] / c[1:]).reshape(-1, k) * np.exp(p["step"] - p["step"].max())
        g["step"] += pairs - np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        at = np.arange(n)[:, None], np.arange(t)[None], y
        gold = p["first"][y[:, 0]] + e[at].sum(axis=1) + p["step"][y[:, :-1], y[:, 1:]].sum(axis=1)
        de[at[1], at[0], y] -= 1
        both, out = keep.pop()
        de = de.astype(e.dtype)
        g["wo"], g["bo"] = np.tensordot(out, de, ([0, 1], [0, 1])), de.sum(axis=(0, 1))
        dout = de @ p["wo"].T
        dhs, u = np.stack([dout[..., :UNITS], dout[::-1, :, UNITS:]], axis=1), UNITS
        dh, dc = np.zeros_like(keep[0][0]), np.zeros_like(keep[0][0])
        dtable, dzs = np.zeros((2, N_CODES, 4 * u), e.dtype), np.empty((t, 2, n, 4 * u), e.dtype)
        for i in range(t - 1, -1, -1):
            h, was, s, gt, tc = keep[i]
            dh = dh + dhs[i]
            dc = dc + dh * s[..., 2 * u :] * (1 - tc**2)
            ds = np.concatenate([dc * gt, dc * was, dh * tc], axis=2) * s * (1 - s)
            dz = np.concatenate([ds, dc * s[..., :u] * (1 - gt**2)], axis=2)
            g["wh"] += h.transpose(0, 2, 1) @ dz
            dzs[i] = dz
            dh, dc = dz @ p["wh"].transpose(0, 2, 1), dc * s[..., u : 2 * u]
        for d in (0, 1):
            met = both[d].T.ravel()
            order = np.argsort(met, kind="stable")
            code, first = np.unique(met[order], return_index=True)
            dtable[d, code] = np.add.reduceat(dzs[:, d].reshape(-1, 4 * u)[order], first)
        g["wx"], g["b"] = p["embed"].T @ dtable, dtable.sum(axis=1, keepdims=True)
        g["embed"] = (dtable @ p["wx"].transpose(0, 2, 1)).sum(axis=0)
        return float((z - gold).mean()), {v: (w / n).astype(e.dtype) for v, w in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, rate: float = 0.03, seed: int = 2) -> Network:
        """Adam over shuffled batches, with a falling rate. In double precision, so that the order in which a machine adds up hardly matters;
        the weights are rounded in the end, so that the rest of it doesn't either."""
        rng = np.random.default_rng(seed)
        self.p = {k: w.astype(np.float64) for k, w in self.p.items()}
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        steps, t = PASSES * -(-len(x) // BATCH), 0
        for _ in range(PASSES):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                t += 1
                some = order[at : at + BATCH]
                _, g = self.loss_and_gradient(x[some], y[some])
                scale = min(1.0, 5 / max(1e-9, sum(float((w**2).sum()) for w in g.values()) ** 0.5))
                for k, w in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * w * scale
                    v[k] = 0.999 * v[k] + 0.001 * (w * scale) ** 2
                    self.p[k] = self.p[k] - rate * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p = {k: np.round(w, 4).astype(np.float32) for k, w in self.p.items()}
        return self

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best path over one stretch, length x tags."""
        best, by = self.p["first"] + e[0], np.empty(e.shape, np.int8)
        for i in range(1, len(e)):
            z = best[:, None] + self.p["step"]
            by[i] = z.argmax(axis=0)
            best = z.max(axis=0) + e[i]
        out = np.empty(len(e), np.int64)
        out[-1] = best.argmax()
        for i in range(len(e) - 1, 0, -1):
            out[i - 1] = by[i][out[i]]
        return out


def _windows(s: int, e: int) -> list[int]:
    return [s] if e - s <= WINDOW else [*range(s, e - WINDOW, STEP), e - WINDOW]


#: Weight of a window's characters in the average: more inside.
_INNER = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def model_spans(net: Network, texts: list[str]) -> list[list[Span]]:
    """Confident, valid spans of the decoded paths of each text's stretches."""
    jobs, starts, rows = [], [], []
    for i, text in enumerate(texts):
        for s, e in stretches(text):
            x = codes(text[s:e])
            at = _windows(0, e - s)
            jobs.append((i, s, e - s, len(rows), at))
            for w in at:
                row = np.zeros(WINDOW, np.uint8)
                row[: min(WINDOW, e - s - w)] = x[w : w + WINDOW]
                rows.append(row)
            starts += at
    out: list[list[Span]] = [[] for _ in texts]
    if not rows:
        return out
    distinct, back = np.unique(np.stack(rows), axis=0, return_inverse=True)
    scores = np.concatenate([net.emit(distinct[a : a + 2048]) for a in range(0, len(distinct), 2048)])
    back = back.reshape(-1)
    for i, s, n, first, at in jobs:
        total, weight = np.zeros((n, N_TAGS), np.float32), np.zeros((n, 1), np.float32)
        for j, w in enumerate(at):
            k = min(WINDOW, n - w)
            total[w : w + k] += scores[back[first + j], :k] * _INNER[:k, None]
            weight[w : w + k, 0] += _INNER[:k]
        e = total / weight
        if (e[:, 1:].max(axis=1) > e[:, 0] - 12).any():
            out[i] += [(k, s + a, s + b) for k, a, b in certified(net, e, texts[i][s : s + n])]
    return out


def parted(kind: int, text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The fewest valid numbers, with one space between two, that text[a:b] is made of; the earliest ends of equally many. None: it isn't."""
    ends = [k for k in range(a, b) if text[k] == " "] + [b]
    best: dict[int, list[tuple[int, int]]] = {a: []}
    for end in ends:
        ways = [[*best[s], (s, end)] for s in sorted(best) if s < end and valid(kind, text[s:end])]
        if ways:
            best[end + 1] = min(ways, key=lambda w: (len(w), w))
    return best.get(b + 1, [])


#: Added to the scores of a certain span's tags.
SURE = np.float32(40)


def certified(net: Network, e: np.ndarray, text: str) -> list[Span]:
    """The confident, valid spans of one stretch with tag scores e. What has been certified is then taken as given: the stretch is decoded again with
    those spans fixed, which makes up the network's mind about a number beside one, until nothing is added."""
    found: list[Span] = []
    while True:
        path, new, a = net.decode(e), [], 0
        while a < len(path):
            if path[a] == 0:
                a += 1
                continue
            kind, b = int(path[a] - 1) // 2, a + 1
            while b < len(path) and path[b] == 2 + 2 * kind:
                b += 1
            if not any(x < b and a < y for _, x, y in found):
                parts = [(a, b)] if valid(kind, text[a:b]) else parted(kind, text, a, b) if kind > 1 else []
                lo = max(0, a - MARGIN)  # what is farther away hardly matters
                share = net.posterior(e[lo : b + MARGIN])[a - lo : b - lo] if parts else None
                if parts and share[np.arange(b - a), path[a:b]].min() >= CONFIDENT:
                    new += [(kind, x, y) for x, y in parts]
            a = b
        if not new:
            return sorted(found, key=lambda x: x[1])
        found += new
        e = e.copy()
        for kind, a, b in new:
            e[a, 1 + 2 * kind] += SURE
            e[a + 1 : b, 2 + 2 * kind] += SURE
            if b < len(e):
                e[b, 2 + 2 * kind] -= SURE  # the span ends here


def find(net: Network, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    out = []
    for text, more in zip(texts, model_spans(net, texts), strict=True):
        base = base_spans(text)
        taken = sorted((s, e) for _, s, e in base)
        out.append((base, [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)]))
    return out


def train(docs: DataFrame) -> Network:
    chosen = docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                spans, unsure = base_spans(text or ""), failing(text or "")
                at = [w for s, e in stretches(text or "") for w in _windows(s, e)] + list(range(0, len(text or "") - WINDOW, 977))
                at = [w for w in at if not any(s < w + WINDOW and w < e for s, e in unsure)]
                for w in sorted(at, key=lambda v: hashlib.blake2b(f"{doc}:{v}".encode()).digest())[:DOC_WINDOWS]:
                    x = codes(text[w : w + WINDOW])
                    pad = np.zeros(WINDOW - len(x), np.uint8)
                    rows.append((doc, np.append(x, pad).tobytes(), np.append(tags(spans, w, len(x)), pad).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "x", "y"])

    got = docs.select("doc_id", "text").join(F.broadcast(seldom(docs, chosen)), "doc_id").mapInPandas(take, "doc_id long, x binary, y binary").limit(2 * SAMPLE_DOCS * DOC_WINDOWS).toPandas()
    got = got.sort_values(["doc_id", "x", "y"], kind="stable")
    x, y = generated(GENERATED)
    read = lambda c: [np.frombuffer(b, np.uint8)[None] for b in got[c]]
    return Network.new().fit(np.concatenate([x, *read("x")]), np.concatenate([y, *read("y")]).astype(np.int64))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def search(docs: DataFrame, net: Network) -> DataFrame:
    """The digest of each text's spans; n_ counts by kind are of the base spans, n_spans counts all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                found = find(net, ["" if t is None else t for t in some["text"]])
                rows = [(*(sum(k == kind for k, _, _ in base) for kind in range(4)), hashlib.sha256(told(base).encode()).hexdigest(), told(base + more), len(base) + len(more)) for base, more in found]
                out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])
                out.insert(0, "doc_id", some["doc_id"].to_numpy())
                yield out

    return by_document(docs, run, RESULT)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind's mark; spans that meet are replaced as one, by the first one's mark."""
    out, at, end = [], 0, -1
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        end = at = max(end, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network) -> DataFrame:
    """docs with all spans replaced in text, and n_chars, where there is such a column, set to the new length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            was = batch.column(at).to_pylist()
            texts = ["" if t is None else t for t in was]
            found = [x for i in range(0, len(texts), 1024) for x in find(net, texts[i : i + 1024])]
            new = [None if w is None else redacted(w, base + more) for w, (base, more) in zip(was, found, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return search(docs, train(docs))
