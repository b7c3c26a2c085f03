"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's bytes (in lower case, white space as one blank) both ways, labels every position, and is
trained by backpropagation through time on windows of a bounded sample of labelled documents. A document's language is
pooled from the log-probabilities of all its positions. To read many places at once, texts are cut into segments; each
direction's state is carried into a segment by reading the ``WARM`` bytes before it (behind it, for the way back), whose
own labels aren't counted again. Every byte of the whole text counts once.

Defined cases: null text or text without a letter gives ``und`` with score 1; without any labelled row every document
gives ``und`` with score 0; a null doc_id isn't held out (held_out is null) and isn't learnt from; a text longer than a
slice is a slice of its own; repeated rows are each answered; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidra.llm.common import bucket_of, checked_columns, sliced

SEGMENT = 384
WARM = 24
BLANK = 32


@dataclass
class Network:
    """One entry per direction in ``inputs`` (256 x 3h), ``recur`` (h x 3h) and ``bias`` (3h)."""

    langs: list[str]
    inputs: list[np.ndarray]
    recur: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recur, *self.bias, self.out, self.out_bias]


def new_network(langs: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return Network(
        langs, [draw(256, 3 * hidden) for _ in range(2)], [draw(hidden, 3 * hidden) for _ in range(2)],
        [np.zeros(3 * hidden, np.float32) for _ in range(2)], draw(2 * hidden, len(langs)), np.zeros(len(langs), np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _direction(words: np.ndarray, inputs: np.ndarray, recur: np.ndarray, bias: np.ndarray, keep: list | None) -> np.ndarray:
    """States (position, word, hidden) of one direction; ``keep`` collects what backpropagation needs."""
    n, steps = words.shape
    size = recur.shape[0]
    gates_of = inputs + bias
    state = np.zeros((n, size), np.float32)
    states = np.empty((steps, n, size), np.float32)
    for t in range(steps):
        x, u = gates_of[words[:, t]], state @ recur
        zr = _sigmoid(x[:, : 2 * size] + u[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        new = np.tanh(x[:, 2 * size :] + r * u[:, 2 * size :])
        if keep is not None:
            keep.append((state, u[:, 2 * size :], z, r, new))
        state = new + z * (state - new)
        states[t] = state
    return states


def _back(words: np.ndarray, recur: np.ndarray, keep: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, recur and bias of one direction."""
    size = recur.shape[0]
    d_in, d_rec, d_next = np.zeros((256, 3 * size), np.float32), np.zeros_like(recur), 0.0
    for t in range(len(keep) - 1, -1, -1):
        before, u_new, z, r, new = keep[t]
        d = d_states[t] + d_next
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (before - new) * z * (1 - z)
        d_r = d_new * u_new * r * (1 - r)
        d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
        np.add.at(d_in, words[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
        d_rec += before.T @ d_u
        d_next = d * z + d_u @ recur.T
    return d_in, d_rec, d_in.sum(axis=0)


def position_log_probs(net: Network, words: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities (position, word, language) of equally long words, and the states they came from."""
    ahead = _direction(words, net.inputs[0], net.recur[0], net.bias[0], keep and keep[0])
    behind = _direction(words[:, ::-1], net.inputs[1], net.recur[1], net.bias[1], keep and keep[1])
    states = np.concatenate([ahead, behind[::-1]], axis=2)
    logits = states @ net.out + net.out_bias
    logits -= logits.max(axis=2, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), states


def gradients(net: Network, words: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions and the gradients in the order of ``net.parameters()``."""
    keep: tuple[list, list] = ([], [])
    logp, states = position_log_probs(net, words, keep)
    steps, n, _ = logp.shape
    loss = -float(logp[:, np.arange(n), labels].mean())
    d = np.exp(logp)
    d[:, np.arange(n), labels] -= 1
    d /= steps * n
    flat = d.reshape(-1, d.shape[2])
    d_states = d @ net.out.T
    size = net.recur[0].shape[0]
    one = _back(words, net.recur[0], keep[0], d_states[:, :, :size])
    two = _back(words[:, ::-1], net.recur[1], keep[1], d_states[::-1, :, size:])
    out = states.reshape(-1, 2 * size).T @ flat
    return loss, [one[0], two[0], one[1], two[1], one[2], two[2], out, flat.sum(axis=0)]


def segments(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts raw[starts[k] : starts[k + 1]] in segments: a row of bytes each, with WARM bytes on either side (blanks where
    the text ends); how many bytes count, and which text each is of."""
    sizes = np.diff(starts)
    counts = -(-sizes // SEGMENT)
    of = np.repeat(np.arange(len(sizes)), counts)
    place = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * SEGMENT
    at = (starts[:-1][of] + place)[:, None] + np.arange(-WARM, SEGMENT + WARM)[None, :]
    inside = (at >= starts[:-1][of][:, None]) & (at < starts[1:][of][:, None])
    rows = np.where(inside, raw[np.clip(at, 0, max(len(raw) - 1, 0))], BLANK).astype(np.uint8) if len(of) else np.zeros((0, SEGMENT + 2 * WARM), np.uint8)
    return rows, np.minimum(SEGMENT, sizes[of] - place), of


def text_scores(net: Network, raw: np.ndarray, starts: np.ndarray, block: int = 1024) -> np.ndarray:
    """Per text the sums over its positions of the log-probabilities of each language; last column: positions."""
    rows, held, of = segments(raw, starts)
    out = np.zeros((len(starts) - 1, len(net.langs) + 1))
    for at in range(0, len(rows), block):
        n, some = held[at : at + block], rows[at : at + block]
        used = int(n.max())
        some = some[:, : used + 2 * WARM]
        logp = _segment_log_probs(net, some, used)
        counts = (np.arange(used)[:, None] < n[None, :]).astype(np.float32)
        logp *= counts[:, None, :]
        np.add.at(out[:, :-1], of[at : at + block], logp.sum(axis=0, dtype=np.float64).T)
    np.add.at(out[:, -1], of, held)
    return out


def _swift(words: np.ndarray, inputs: np.ndarray, recur: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """_direction() for reading only: states (position, hidden, row). Gates lie row by row, so that every step works on
    whole stretches of memory, in place; the arguments' factors are in the weights already, as exp() is the fast one here."""
    steps, n = words.shape
    size = recur.shape[0]
    factor = np.repeat(np.array([-1, -1, -2], np.float32), size)
    table, weights = np.ascontiguousarray(((inputs + bias) * factor).T), np.ascontiguousarray((recur * factor).T)
    x, u = np.empty((3 * size, n), np.float32), np.empty((3 * size, n), np.float32)
    states = np.empty((steps, size, n), np.float32)
    state = np.zeros((size, n), np.float32)
    gates, fresh, z, r = x[: 2 * size], u[2 * size :], x[:size], x[size : 2 * size]
    for t in range(steps):
        np.take(table, words[t], axis=1, out=x, mode="clip")
        np.matmul(weights, state, out=u)
        gates += u[: 2 * size]
        _sigmoid_of_minus(gates)
        fresh *= r
        fresh += x[2 * size :]
        _sigmoid_of_minus(fresh)
        fresh *= np.float32(2)
        fresh -= np.float32(1)
        state -= fresh
        state *= z
        state += fresh
        states[t] = state
    return states


def _sigmoid_of_minus(x: np.ndarray) -> None:
    np.minimum(x, np.float32(80), out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    np.reciprocal(x, out=x)


def _segment_log_probs(net: Network, rows: np.ndarray, used: int) -> np.ndarray:
    """Log-probabilities (position, language, segment) of the ``used`` positions between the warming bytes; each direction
    stops where they end."""
    columns = np.ascontiguousarray(rows.T)
    ahead = _swift(columns[: WARM + used], net.inputs[0], net.recur[0], net.bias[0])[WARM:]
    behind = _swift(columns[: WARM - 1 : -1], net.inputs[1], net.recur[1], net.bias[1])[WARM:][::-1]
    size = net.recur[0].shape[0]
    logits = np.matmul(net.out[:size].T, ahead)
    logits += np.matmul(net.out[size:].T, behind)
    logits += net.out_bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def train(samples: list[tuple[str, bytes]], *, hidden: int = 8, steps: int = 400, batch: int = 160, window: int = 32, rate: float = 0.03, seed: int = 7) -> Network:
    """Network fitted to (language, bytes) samples by Adam, on windows drawn from them; languages are drawn alike
    whatever their shares."""
    langs = sorted({lang for lang, _ in samples})
    net = new_network(langs, hidden, seed)
    rng = np.random.default_rng(seed)
    own = [np.frombuffer(b"".join(x + b" " * window for lang, x in samples if lang == name and x), dtype=np.uint8) for name in langs]
    pools = [(k, x) for k, x in enumerate(own) if len(x) > window]
    if not pools:
        return net
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        n = max(1, batch // len(pools))
        rows = np.concatenate([x[rng.integers(0, len(x) - window, n)[:, None] + np.arange(window)[None, :]] for _, x in pools])
        _, grads = gradients(net, rows, np.repeat([k for k, _ in pools], n))
        pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(net.parameters(), grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def _bytes_of(texts: pa.Array) -> pa.Array:
    """Lower case, each stretch of white space as one blank."""
    return pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("").cast(pa.string())), r"\s+", " ")


def sampled(docs: DataFrame, held_out_modulus: int, held_out: int, rows: int, most: int) -> list[tuple[str, bytes]]:
    """At most ``rows`` labelled documents outside the held-out fold, lowest id hash first, each with at most ``most``
    bytes in words spread evenly over its whole text."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(bucket_of("doc_id", held_out_modulus) != held_out, F.lit(False)))
    chosen = able.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for x in _bytes_of(b.column(1)).to_pylist():
                words = x.encode().split(b" ")
                # Groups of eight words keep what stands together; the bound is on all of them.
                groups = [b" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
                step = max(1, -(-sum(map(len, groups)) // most))
                out.append(b" ".join(groups[::step])[:most])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["lang", "some"])

    # At most ``rows`` ids: the bound of the broadcast. Rows that repeat an id stand beside it, in order.
    found = able.join(F.broadcast(chosen), "doc_id").select("lang", "text").mapInArrow(thin, "lang string, some binary").distinct()
    return [(r.lang, bytes(r.some)) for r in found.orderBy("lang", "some").limit(rows).collect()]


def identify(docs: DataFrame, *, modulus: int = 3, held_out: int = 1, sample_rows: int = 2000, sample_bytes_each: int = 1000, sharpness: int = 24) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs`` (doc_id, text, lang)."""
    docs = checked_columns(docs, "doc_id", "text", "lang")
    samples = sampled(docs, modulus, held_out, sample_rows, sample_bytes_each)
    net = train(samples) if samples else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1 << 20):
            texts = b.column(2)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            langs, scores = np.full(len(texts), "und", dtype=object), np.where(lettered, 0.0, 1.0)
            if net is not None and len(texts):
                own = _bytes_of(texts)
                starts = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
                raw = np.frombuffer(own.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
                p = pooled(text_scores(net, raw, starts - starts[0]), sharpness)
                langs = np.where(lettered, np.array(net.langs, dtype=object)[p.argmax(axis=1)], langs)
                scores = np.where(lettered, p.max(axis=1), scores)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs.tolist(), pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    marked = docs.select("doc_id", (bucket_of("doc_id", modulus) == held_out).alias("held_out"), "text")
    return marked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def pooled(totals: np.ndarray, sharpness: int) -> np.ndarray:
    """Probabilities per text from the sums of its positions: the mean log-probability, counted as often as there are
    positions, but ``sharpness`` times at most."""
    n = np.maximum(totals[:, -1:], 1)
    logs = totals[:, :-1] / n * np.minimum(n, sharpness)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)
