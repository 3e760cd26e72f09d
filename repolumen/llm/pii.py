"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The network reads overlapping windows of characters. Each window's tag marginals come from the forward-backward
algorithm over the CRF; where windows overlap, a character takes the tag potentials of the window in which it stands
farthest from an edge, and one Viterbi pass over the whole stretch decides (the global reconciliation). Every kind
needs a digit, an ``@`` or an ``(at)``; stretches of a text farther than a window's margin from any of these are not
read, because no span can lie there.

The model is trained in numpy from labelled spans: windows around the base spans of a bounded sample of documents,
and rewritten forms of the same spans that the patterns do not catch (telephone numbers without ``+``, cards in
dotted groups, addresses with spaces around ``@``).

Cases: null and empty texts have no spans. Any length is read whole. Without any labelled span in the sample the
network is skipped and the base spans stand alone. Repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Most documents that are read for training, and most windows.
TRAINING_DOCS, TRAINING_WINDOWS = 600, 2400
WINDOW, OVERLAP, REACH = 96, 32, 40
#: Least mean marginal of an added span.
CONFIDENCE = 0.95
HIDDEN, CLASSES = 16, 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every span holds: base spans a digit or an ``@``, spans of the network these or a spelled-out ``@``.
_BASE_TRIGGER = re.compile(r"[0-9@]")
_TRIGGER = re.compile(r"[0-9@]|\(at\)")


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        value = int(d) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in linear time: only the run before each ``@`` can be the local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        domain = _DOMAIN.match(text, at) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base patterns, sorted; offsets in code points."""
    if not _BASE_TRIGGER.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
              if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found)


def _classes(text: str) -> np.ndarray:
    """A class per character: digits, signs and separators by themselves, letters by shape."""
    out = np.empty(len(text), np.int64)
    for at, c in enumerate(text):
        if c in "0123456789":
            out[at] = 1 + int(c == "0") + 2 * (c in "345")
        elif c in _SIGNS:
            out[at] = _SIGNS[c]
        elif c.isascii() and c.isalpha():
            out[at] = 5 if c.islower() else 6
        elif c.isalpha():
            out[at] = 7
        else:
            out[at] = 8 if c.isspace() else 9
    return out


_SIGNS = {c: 10 + i for i, c in enumerate(" @.+-()_%:;,/\"'=#*|\n[]<>{}")}
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)


def _tags(n: int, spans) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for start, kind, end in spans:
        if start >= 0 and end <= n and not out[start:end].any():
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
    return out


@dataclass
class Model:
    """Weights of the two LSTM directions, of the tag layer, and the CRF transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        p = {}
        for way in "fb":
            p[f"x{way}"] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            p[f"h{way}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p[f"x{way}"][:, HIDDEN: 2 * HIDDEN] += 0.5
        p["o"] = rng.normal(0, 0.2, (2 * HIDDEN, TAGS))
        p["ob"] = np.zeros(TAGS)
        p["t"] = np.zeros((TAGS, TAGS))
        return cls(p)

    def allowed(self) -> np.ndarray:
        """Inside tags follow their own begin or inside tag only."""
        gate = np.zeros((TAGS, TAGS))
        for kind in range(len(KINDS)):
            inside = 2 + 2 * kind
            gate[:, inside] = -1e4
            gate[[inside - 1, inside], inside] = 0
        return gate

    def run(self, x: np.ndarray, way: str):
        """One direction over ``x`` (windows by characters), keeping what back-propagation needs."""
        order = range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1)
        h = c = np.zeros((len(x), HIDDEN))
        out, trace = np.zeros((*x.shape, HIDDEN)), []
        for t in order:
            z = self.p[f"x{way}"][x[:, t]] + h @ self.p[f"h{way}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN: 2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            before, c = (h, c), f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
            trace.append((t, before, i, f, o, g, c))
        return out, trace

    def emissions(self, x: np.ndarray) -> np.ndarray:
        hidden = np.concatenate([self.run(x, "f")[0], self.run(x, "b")[0]], axis=2)
        return hidden @ self.p["o"] + self.p["ob"]

    def marginals(self, e: np.ndarray):
        """Forward-backward: log of the partition sum, tag marginals, expected transitions."""
        move, n = self.p["t"] + self.allowed(), e.shape[1]
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + self.allowed()[0]
        for t in range(1, n):
            a[:, t] = e[:, t] + _lse(a[:, t - 1][:, :, None] + move, 1)
        for t in range(n - 2, -1, -1):
            b[:, t] = _lse(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        total = _lse(a[:, -1], 1)
        tags = np.exp(a + b - total[:, None, None])
        pairs = np.exp(np.clip(a[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :]
                               - total[:, None, None, None], -700, 0))
        return total, tags, pairs.sum((0, 1))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the CRF's negative log-likelihood, by back-propagation through both directions."""
        (hf, tf), (hb, tb) = self.run(x, "f"), self.run(x, "b")
        hidden = np.concatenate([hf, hb], axis=2)
        _, tags, pairs = self.marginals(hidden @ self.p["o"] + self.p["ob"])
        de = tags.copy()
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        de /= len(x)
        seen = np.zeros((TAGS, TAGS))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        grads = {"o": np.einsum("bth,btk->hk", hidden, de), "ob": de.sum((0, 1)), "t": (pairs - seen) / len(x)}
        back = de @ self.p["o"].T
        for way, trace, part in (("f", tf, back[:, :, :HIDDEN]), ("b", tb, back[:, :, HIDDEN:])):
            gh, bends = np.zeros_like(self.p[f"h{way}"]), np.empty((*x.shape, 4 * HIDDEN))
            dh = dc = np.zeros((len(x), HIDDEN))
            for t, (h0, c0), i, f, o, g, c in reversed(trace):
                dh = dh + part[:, t]
                bent = np.tanh(c)
                dc = dc + dh * o * (1 - bent ** 2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * bent * o * (1 - o),
                                     dc * i * (1 - g ** 2)], axis=1)
                bends[:, t] = dz
                gh += h0.T @ dz
                dh, dc = dz @ self.p[f"h{way}"].T, dc * f
            grads[f"x{way}"], grads[f"h{way}"] = np.tensordot(np.eye(CLASSES)[x], bends, ((0, 1), (0, 1))), gh
        return grads

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tag path over one stretch."""
        move = self.p["t"] + self.allowed()
        best, back = e[0] + self.allowed()[0], np.zeros(e.shape, np.int64)
        for t in range(1, len(e)):
            step = best[:, None] + move
            back[t] = step.argmax(0)
            best = step.max(0) + e[t]
        path = np.empty(len(e), np.int64)
        path[-1] = best.argmax()
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def rewritten(kind: int, span: str, at: int) -> str:
    """Another spelling of a labelled span that the base patterns miss."""
    if kind == 0:
        return span.replace("@", " @ ") if at % 2 else span.replace("@", "(at)")
    if kind == 2:
        digits = re.sub(r"[^0-9]", "", span)
        return ".".join(digits[k: k + 4] for k in range(0, len(digits), 4))
    if kind == 3:
        return span.lstrip("+") if at % 2 else "tel " + span.lstrip("+")
    return span


def training_windows(texts: list[str], limit: int = TRAINING_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Windows with labelled spans, half of them with rewritten spans, and windows of other digits without spans."""
    xs, ys, n = [], [], 0
    for text in texts:
        spans = base_spans(text)
        for start, kind, end in spans:
            n += 1
            shift = (n * 29) % max(1, WINDOW - (end - start) - 8)
            left, value = max(0, start - shift), text[start:end]
            if n % 2:
                value = rewritten(kind, value, n // 2)
            piece = text[left:start] + value + text[end: end + WINDOW]
            marks = [(a - left, k, b - left) for a, k, b in spans if left <= a and b <= start]
            head = 4 if value.startswith("tel ") else 0
            marks.append((start - left + head, kind, start - left + len(value)))
            moved = len(value) - (end - start)
            marks += [(a - left + moved, k, b - left + moved) for a, k, b in spans if a >= end]
            xs.append(piece[:WINDOW].ljust(WINDOW))
            ys.append(_tags(WINDOW, marks))
        for m in list(_BASE_TRIGGER.finditer(text))[:: max(1, len(text) // 400)][:4]:
            left = max(0, m.start() - (m.start() * 7) % WINDOW)
            marks = [(a - left, k, b - left) for a, k, b in spans]
            if all(b <= 0 or a >= WINDOW for a, _, b in marks):
                xs.append(text[left: left + WINDOW].ljust(WINDOW))
                ys.append(np.zeros(WINDOW, np.int64))
    if not any(y.any() for y in ys):
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    keep = np.random.default_rng(3).permutation(len(xs))[:limit]
    return np.array([_classes(xs[k]) for k in keep]), np.array([ys[k] for k in keep])


def fit(texts: list[str], steps: int = 1000, batch: int = 16, rate: float = 0.05) -> Model | None:
    """Adam on the windows of the sample, equally many steps for any number; None without a labelled span."""
    x, y = training_windows(texts)
    if not len(x):
        return None
    model, rng = Model.fresh(), np.random.default_rng(9)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    order = np.concatenate([rng.permutation(len(x)) for _ in range(-(-steps * batch // len(x)))])
    for step in range(1, steps + 1):
        rows = order[(step - 1) * batch: step * batch]
        for k, g in model.gradient(x[rows], y[rows]).items():
            g = np.clip(g, -5, 5)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.p[k] -= rate * 0.15 ** (step / steps) * (first[k] / (1 - 0.9 ** step)) \
                / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that lie near a digit, an ``@`` or an ``(at)``."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def model_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """Spans of each text by the network: windows of all texts in batches, one decision per stretch."""
    jobs = [(n, a, b) for n, text in enumerate(texts) for a, b in _stretches(text)]
    windows = []
    for j, (n, a, b) in enumerate(jobs):
        for left in range(a, max(a + 1, b - OVERLAP), WINDOW - OVERLAP):
            windows.append((j, left - a, texts[n][left: min(b, left + WINDOW)]))
    scores = [np.full((b - a, TAGS), -np.inf) for _, a, b in jobs]
    depth = [np.full(b - a, -1) for _, a, b in jobs]
    for at in range(0, len(windows), 256):
        part = windows[at: at + 256]
        width = max(len(w) for _, _, w in part)
        emitted = model.emissions(np.array([_classes(w.ljust(width)) for _, _, w in part]))
        for (j, left, piece), e in zip(part, emitted, strict=True):
            n = len(piece)
            inner = np.minimum(np.arange(n), n - 1 - np.arange(n))
            better = inner > depth[j][left: left + n]
            scores[j][left: left + n][better] = e[:n][better]
            depth[j][left: left + n][better] = inner[better]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (n, a, _), e in zip(jobs, scores, strict=True):
        path = model.viterbi(e)
        if not path.any():
            continue
        sure = model.marginals(e[None])[1][0]
        begins = np.flatnonzero((path > 0) & (path % 2 == 1))
        for begin in begins:
            kind, end = (path[begin] - 1) // 2, begin + 1
            while end < len(path) and path[end] == 2 + 2 * kind:
                end += 1
            if sure[np.arange(begin, end), path[begin:end]].mean() >= CONFIDENCE:
                out[n].append((a + int(begin), int(kind), a + int(end)))
    return out


def _plausible(text: str, span: tuple[int, int, int]) -> bool:
    start, kind, end = span
    piece = text[start:end]
    digits = sum(c in "0123456789" for c in piece)
    edge = text[start - 1: start] + " " + text[end: end + 1]
    if any(c.isalnum() for c in edge):
        return False
    return {0: "@" in piece or "(at)" in piece, 1: piece.count(".") == 3 and digits >= 4,
            2: 12 <= digits <= 19 and luhn("".join(c for c in piece if c in "0123456789")),
            3: 9 <= digits <= 15 and not any(c.isalpha() for c in piece)}[kind]


def all_spans(texts: list[str], model: Model | None) -> list[tuple[list, list]]:
    """Base spans and all spans (base ones, and those of the network that touch none of them) of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    out = []
    for text, mine, more in zip(texts, base, model_spans(texts, model), strict=True):
        extra = [s for s in more if all(s[2] <= a or s[0] >= b for a, _, b in mine) and _plausible(text, s)]
        out.append((mine, sorted(mine + extra)))
    return out


def listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one mark."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out.append(text[at:start] + f"<{KINDS[kind].upper()}>")
        at = max(at, end)
    return "".join(out) + text[at:]


def train(docs: DataFrame, rows: int = TRAINING_DOCS) -> Model | None:
    """Model from at most ``rows`` documents that hold a digit or an ``@``, chosen by a hash of the text. Only the
    surroundings of such characters are fetched."""
    near = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"(?s)(.{0,80}[0-9@].{0,120})"), 1)
    parts = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), near.alias("near")) \
        .orderBy("h", F.hash("near")).limit(rows)
    texts = sorted(t for row in parts.toLocalIterator() for t in row.near[:8])
    return fit(texts)


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row with ``pii``: base spans, all spans, counts of all spans by kind, and the masked text."""
    @F.pandas_udf("base string, spans string, n_email long, n_ip long, n_card long, n_phone long, masked string")
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            texts = list(series.fillna(""))
            rows = []
            hot = [n for n, t in enumerate(texts) if _TRIGGER.search(t)]
            found = dict(zip(hot, all_spans([texts[n] for n in hot], model), strict=True))
            for n, text in enumerate(texts):
                base, spans = found.get(n, ([], []))
                kinds = [kind for _, kind, _ in spans]
                rows.append((listed(base), listed(spans), *[kinds.count(k) for k in range(4)],
                             masked(text, spans) if spans else None))
            yield pd.DataFrame(rows, columns=["base", "spans", "n_email", "n_ip", "n_card", "n_phone", "masked"])
    return docs.withColumn("pii", search(F.col("text").cast("string")))


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` per document; counts are of all spans."""
    found = find(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", *[F.col(f"pii.n_{k}").alias(f"n_{k}") for k in KINDS],
                        F.sha2(F.col("pii.base").cast("binary"), 256).alias("base_sha256"),
                        F.col("pii.spans").alias("spans"))
