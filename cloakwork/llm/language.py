"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a window in both directions, gives every position a
probability for each language, and a document the mean over all its positions.  It is
trained with numpy by backpropagation through time on windows of labelled documents, and
applied with numpy inside Spark tasks, many windows at a time.

A text is cut into windows of `window` bytes, the last one moved back to end with the
text; positions that two windows hold count once.  A text shorter than a window is
filled up with spaces that do not count.

Bounded: training takes at most `per_language` documents, chosen by a hash of the id,
and `WINDOWS_EACH` windows of each.
Prediction reads whole texts.

Defined results: a text that is null or has no letter is `und` with score 0; if nothing
could be learned all texts are; documents without a language, an id or any text teach
nothing; repeated rows give repeated results; an empty table gives no rows; other
columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import smallest_by_hash, with_struct

UNDETERMINED = "und"
WINDOW, HIDDEN = 96, 12
PER_LANGUAGE, WINDOWS_EACH = 800, 6
STEPS, BATCH, RATE = 300, 256, 0.01
WINDOWS_AT_ONCE = 4_096
LETTER = regex.compile(r"\p{L}")


@dataclass
class Direction:
    """One direction's weights; gates in the order update, reset, candidate."""

    byte: np.ndarray  # [256, 3 * hidden], with the biases
    state: np.ndarray  # [hidden, 3 * hidden]


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # [2 * hidden, languages]
    bias: np.ndarray
    window: int = WINDOW

    def arrays(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.state, self.back.byte, self.back.state, self.out, self.bias]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_network(languages: list[str], hidden: int, window: int, rng: np.random.Generator) -> Network:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    def direction() -> Direction:
        return Direction(normal(256, 3 * hidden, scale=0.3), normal(hidden, 3 * hidden, scale=hidden**-0.5))

    out = normal(2 * hidden, len(languages), scale=(2 * hidden) ** -0.5)
    return Network(languages, direction(), direction(), out, np.zeros(len(languages), np.float32), window)


def _read(d: Direction, x: np.ndarray, order: list[int]) -> tuple[np.ndarray, dict]:
    """States after each position, [position, row, hidden], and what going back needs."""
    rows, hidden = len(x), len(d.state)
    h = np.zeros((rows, hidden), np.float32)
    states, kept = np.empty((x.shape[1], rows, hidden), np.float32), {}
    for t in order:
        own, past = d.byte[x[:, t]], h @ d.state
        z = sigmoid(own[:, :hidden] + past[:, :hidden])
        r = sigmoid(own[:, hidden : 2 * hidden] + past[:, hidden : 2 * hidden])
        recalled = past[:, 2 * hidden :]
        n = np.tanh(own[:, 2 * hidden :] + r * recalled)
        kept[t] = (h, z, r, n, recalled)
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _go_back(d: Direction, x: np.ndarray, order: list[int], kept: dict, grads: np.ndarray) -> tuple:
    """Gradients of a direction's weights, from those of its states."""
    hidden = len(d.state)
    d_state = np.zeros_like(d.state)
    gates = np.empty((x.shape[1], len(x), 3 * hidden), np.float32)
    dh = np.zeros((len(x), hidden), np.float32)
    for t in reversed(order):
        h, z, r, n, recalled = kept[t]
        dh = dh + grads[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * recalled * r * (1 - r)
        into_state = np.concatenate([dz, dr, dn * r], axis=1)
        gates[t] = np.concatenate([dz, dr, dn], axis=1)
        d_state += h.T @ into_state
        dh = dh * z + into_state @ d.state.T
    at = np.eye(256, dtype=np.float32)[x.T.reshape(-1)]
    return at.T @ gates.reshape(-1, 3 * hidden), d_state


def loss_and_gradients(net: Network, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the positions with weight, and its gradients by backpropagation through time."""
    steps = list(range(x.shape[1]))
    ahead, kept_ahead = _read(net.ahead, x, steps)
    back, kept_back = _read(net.back, x, steps[::-1])
    both = np.concatenate([ahead, back], axis=2)
    logits = both @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    weight = (counts.T / counts.sum())[:, :, None].astype(np.float32)
    rows = np.arange(len(y))
    loss = -(np.log(p[:, rows, y] + 1e-9) * weight[:, :, 0]).sum()
    p[:, rows, y] -= 1
    d_logits = p * weight
    flat = d_logits.reshape(-1, d_logits.shape[2])
    d_out = both.reshape(-1, both.shape[2]).T @ flat
    d_both = d_logits @ net.out.T
    hidden = len(net.ahead.state)
    d_ahead = _go_back(net.ahead, x, steps, kept_ahead, d_both[:, :, :hidden])
    d_back = _go_back(net.back, x, steps[::-1], kept_back, d_both[:, :, hidden:])
    return float(loss), [*d_ahead, *d_back, d_out, flat.sum(axis=0)]


def train(
    windows: np.ndarray,
    counts: np.ndarray,
    labels: np.ndarray,
    languages: list[str],
    hidden: int = HIDDEN,
    steps: int = STEPS,
    batch: int = BATCH,
    rate: float = RATE,
    seed: int = 42,
) -> Network:
    """Adam on batches that hold all languages alike; `counts` is 1 for positions of the text."""
    rng = np.random.default_rng(seed)
    net = new_network(languages, hidden, windows.shape[1], rng)
    weights = net.arrays()
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(rows, -(-batch // len(of))) for rows in of])
        _, grads = loss_and_gradients(net, windows[chosen], labels[chosen], counts[chosen])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def window_starts(n: int, window: int) -> list[int]:
    """Starts of windows over n bytes; the last ends with them."""
    return [0] if n <= window else [*range(0, n - window, window), n - window]


def pooled(net: Network, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the counted positions of each window: probabilities, and labels as given by position.

    States are kept with positions outermost and rows innermost, so that every
    operation runs over whole rows of memory.
    """
    rows, width = x.shape
    hidden = len(net.ahead.state)
    at = np.ascontiguousarray(x.T)
    counted = np.ascontiguousarray(counts.T, np.float32)
    # A logistic gate is a hyperbolic tangent of half its input.
    scale = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), hidden)[:, None]

    def states(d: Direction, order: range) -> Iterator[tuple[int, np.ndarray]]:
        byte = np.ascontiguousarray(d.byte.T) * scale
        state = np.ascontiguousarray(d.state.T) * scale
        h = np.zeros((hidden, rows), np.float32)
        own, past = np.empty((3 * hidden, rows), np.float32), np.empty((3 * hidden, rows), np.float32)
        for t in order:
            np.take(byte, at[t], axis=1, out=own, mode="clip")
            np.matmul(state, h, out=past)
            gates = own[: 2 * hidden]
            gates += past[: 2 * hidden]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:hidden], gates[hidden:]
            r *= past[2 * hidden :]
            r += own[2 * hidden :]
            np.tanh(r, out=r)
            h -= r
            h *= z
            h += r
            yield t, h

    read = np.empty((width, hidden, rows), np.float32)
    for t, h in states(net.ahead, range(width)):
        read[t] = h
    of_ahead, of_back = net.out[:hidden].T.copy(), net.out[hidden:].T.copy()
    sums = np.zeros((len(net.languages), rows), np.float32)
    labelled = np.zeros((len(net.languages), rows), np.float32)
    for t, h in states(net.back, range(width - 1, -1, -1)):
        p = of_ahead @ read[t]
        p += of_back @ h
        p += net.bias[:, None]
        most = p.max(axis=0)
        p -= most
        labelled += (p == 0) * counted[t]
        np.exp(p, out=p)
        p *= counted[t] / p.sum(axis=0)
        sums += p
    return sums.T, labelled.T


def predictions(net: Network, texts: list[str | None]) -> Iterator[tuple[str, float, float]]:
    """Language, pooled probability, and share of positions labelled with that language."""
    width = net.window
    results: list[np.ndarray | None] = [None] * len(texts)
    rows: list[bytes] = []
    counted: list[tuple[int, int]] = []
    owners: list[int] = []

    def flush() -> None:
        if not rows:
            return
        x = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
        since = np.array(counted)
        place = np.arange(width)
        counts = (place >= since[:, :1]) & (place < since[:, 1:])
        sums = np.concatenate(pooled(net, x, counts), axis=1)
        whose = np.array(owners)
        firsts = np.flatnonzero(np.diff(whose, prepend=-1))
        for owner, own in zip(whose[firsts].tolist(), np.add.reduceat(sums.astype(np.float64), firsts)):
            results[owner] = own if results[owner] is None else results[owner] + own
        rows.clear(), counted.clear(), owners.clear()

    for i, text in enumerate(texts):
        if not text or not LETTER.search(text):
            continue
        data = text.encode("utf-8", "replace")
        done = 0
        for start in window_starts(len(data), width):
            part = data[start : start + width]
            counted.append((done - start, len(part)))
            done = start + len(part)
            rows.append(part if len(part) == width else part.ljust(width, b" "))
            owners.append(i)
            if len(rows) == WINDOWS_AT_ONCE:
                flush()
    flush()
    n = len(net.languages)
    for own in results:
        if own is None:
            yield UNDETERMINED, 0.0, 0.0
        else:
            best, total = int(np.argmax(own[:n])), max(own[:n].sum(), 1e-12)
            yield net.languages[best], float(min(1.0, own[best] / total)), float(own[n + best] / max(own[n:].sum(), 1e-12))


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    window: int = WINDOW,
    seed: int = 42,
) -> Network | None:
    """A network trained on the labelled documents of the frame; none if there are none."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang")).where("id IS NOT NULL AND lang IS NOT NULL")
    # At most per_language rows of each language, so they may be broadcast.
    picked = F.broadcast(smallest_by_hash(known, per_language, "id", "lang").dropDuplicates(["id", "lang"]))
    n = F.length("text")
    own = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # From each document, stretches at places that its id draws, longer than a window in bytes.
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)),
        lambda k: F.substr(
            F.col("text"),
            (F.pmod(F.xxhash64(F.col("id").cast("string"), k), F.greatest(n - window + 1, F.lit(1))) + 1).cast("int"),
            F.lit(window),
        ),
    )
    chosen = own.join(picked, ["id", "lang"]).where(n > 0).select("lang", F.array_distinct(parts).alias("parts"))
    rows = sorted((r.lang, tuple(r.parts)) for r in chosen.toLocalIterator())
    windows, counts, labels = [], [], []
    for language, own_parts in rows:
        for part in own_parts:
            data = part.encode("utf-8", "replace")[:window]
            windows.append(data.ljust(window, b" "))
            counts.append(np.arange(window) < len(data))
            labels.append(language)
    seen = sorted(set(labels))
    if not seen:
        return None
    numbers = {language: k for k, language in enumerate(seen)}
    x = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, window)
    return train(x, np.array(counts, np.float32), np.array([numbers[v] for v in labels]), seen, seed=seed)


def predict(
    df: DataFrame, net: Network | None, text: str = "text", lang_as: str = "lang_pred", score_as: str = "score",
    share_as: str = "label_share",
) -> DataFrame:
    """The frame with the language of every whole text, its probability, and the share of positions so labelled."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("share", pa.float64())])

    def predicted(texts: pa.Array) -> pa.Array:
        own = texts.to_pylist()
        found = [(UNDETERMINED, 0.0, 0.0)] * len(own) if shared.value is None else list(predictions(shared.value, own))
        return pa.array([dict(zip(("lang", "score", "share"), f)) for f in found], kind)

    value = F.arrow_udf(predicted, "struct<lang:string,score:double,share:double>")(F.col(text))
    return with_struct(df, value, {"lang": lang_as, "score": score_as, "share": share_as})
