"""LM scoring by masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from
the two tokens on either side; the sum of the log-probabilities scores a document.

Vocabulary: words (A-Z lower-cased, split at blanks) are counted over all documents; the most frequent get a token each, the rest share
``RARE`` hashed tokens. Network: a token's four neighbours add their position's embeddings, tanh, then a softmax over
classes of tokens and one over the tokens of the class. Training: in each round every partition starts from the same
parameters and goes through every position of all its documents, in slices of ``SLICE``, with Adagrad; the parameters are then
averaged by positions seen. All documents take part, whatever their size. The average depends on how the rows lie in
partitions, so scores of two layouts of the same rows differ somewhat; with the same files a rerun has the same.

Bounds: 3,840 words have a token of their own whatever the corpus; all others share 256. The driver and workers hold one set of
parameters (about 330,000). What leaves a partition is one row a parameter and the counts of its distinct words, in runs of
``FLUSH``. Very long texts are scored whole, in slices.

Defined results. Null and wordless texts: 0 tokens, log_prob 0, per_token null. Null ids and repeated rows: a result each.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, discard, durable, frequent, sliced, small_batches

CLASSES, MEMBERS, RARE, HIDDEN, SIDE = 64, 64, 256, 16, 2
TOKENS, PAD = CLASSES * MEMBERS, CLASSES * MEMBERS
ROUNDS, RATE, BATCH, FLUSH, SLICE = 1, 0.1, 16384, 200_000, 1 << 16
_SHAPES = [(2 * SIDE, TOKENS + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, MEMBERS), (CLASSES, MEMBERS)]
_SIZES = [int(np.prod(s)) for s in _SHAPES]


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_BYTES).split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for b in sliced(batches):
        for text in b.column(0).cast(pa.binary()).to_pylist():
            seen.update(words(text))
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    yield out()


def vocabulary(docs: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """Tokens of the most frequent words of all documents, by count, then word."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = durable(counts, "words")
    top = sorted(frequent(counted, TOKENS - RARE, "word").collect(), key=lambda r: (-r["n"], r["word"]))
    discard(counted)
    return {r["word"].encode(): i for i, r in enumerate(top)}


def tokens(text: bytes | None, vocab: dict[bytes, int]) -> np.ndarray:
    get = vocab.get
    return np.array([t if (t := get(w)) is not None else TOKENS - RARE + zlib.crc32(w) % RARE for w in words(text)], np.int64)


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    return [p.reshape(s) for p, s in zip(np.split(flat, np.cumsum(_SIZES)[:-1]), _SHAPES, strict=True)]


def start(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.1, sum(_SIZES)).astype(np.float32)


def windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens beside each position in ``at``: two before, two after; PAD outside."""
    padded = np.concatenate((np.full(SIDE, PAD), ids, np.full(SIDE, PAD)))
    return np.stack([padded[at + d] for d in (*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1))])


def _softmax(x: np.ndarray) -> np.ndarray:
    """Down the columns, in place: sums over rows of many columns are vectorised, sums over short rows aren't."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _log_softmax(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of one row of each column; spends ``x``."""
    x -= x.max(0)
    own = x[row, np.arange(x.shape[1])]
    return own - np.log(np.exp(x, out=x).sum(0))


def _forward(p: list[np.ndarray], around: np.ndarray):
    emb, bias = p[0], p[1]
    h = bias + emb[0][around[0]]
    for k in range(1, 2 * SIDE):
        h = h + emb[k][around[k]]
    return np.tanh(h)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of positions by their token's class, and the stretch of each class in it."""
    order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")
    bounds = np.searchsorted((target // MEMBERS)[order], np.arange(CLASSES + 1))
    return order, [(c, slice(bounds[c], bounds[c + 1])) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]


def log_probs(p: list[np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    h = _forward(p, around)
    out = _log_softmax(p[2].T @ h.T + p[3][:, None], target // MEMBERS)
    order, stretches = _by_class(target)
    sorted_h, member, within = h[order], target[order] % MEMBERS, np.empty_like(out)
    for c, at in stretches:
        within[at] = _log_softmax(p[4][c].T @ sorted_h[at].T + p[5][c][:, None], member[at])
    out[order] += within
    return out


def gradient(p: list[np.ndarray], around: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log-probability."""
    n, h = len(target), _forward(p, around)
    g = [np.zeros_like(x) for x in p]
    e = _softmax(p[2].T @ h.T + p[3][:, None])
    e[target // MEMBERS, np.arange(n)] -= 1
    g[2], g[3], dh = (e @ h).T / n, e.sum(1) / n, e.T @ p[2].T
    order, stretches = _by_class(target)
    sorted_h, member, within = h[order], target[order] % MEMBERS, np.empty_like(h)
    for c, at in stretches:
        m = _softmax(p[4][c].T @ sorted_h[at].T + p[5][c][:, None])
        m[member[at], np.arange(m.shape[1])] -= 1
        g[4][c], g[5][c] = (m @ sorted_h[at]).T / n, m.sum(1) / n
        within[at] = m.T @ p[4][c].T
    dh[order] += within
    dh *= (1 - h * h) / n
    g[1] = dh.sum(0)
    for k in range(2 * SIDE):
        for j in range(HIDDEN):
            g[0][k][:, j] = np.bincount(around[k], weights=dh[:, j], minlength=TOKENS + 1)
    return g


def _trainer(shared):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = shared.value
        flat = flat.copy()
        params, square, seen = unpack(flat), [np.full(s, 1e-6, np.float32) for s in _SHAPES], 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def step():
            around, target = np.concatenate([a for a, _ in held], axis=1), np.concatenate([t for _, t in held])
            for i in range(0, len(target), BATCH):
                for x, s, g in zip(params, square, gradient(params, around[:, i : i + BATCH], target[i : i + BATCH]), strict=True):
                    s += g * g
                    x -= RATE * g / np.sqrt(s)
            held.clear()
            return len(target)

        for b in sliced(batches):
            for text in b.column(0).cast(pa.binary()).to_pylist():
                ids = tokens(text, vocab)
                for i in range(0, len(ids), SLICE):
                    at = np.arange(i, min(len(ids), i + SLICE))
                    held.append((windows(ids, at), ids[at]))
                    size += len(at)
                    if size >= BATCH:
                        seen, size = seen + step(), 0
        if held:
            seen += step()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen), pa.int64())], names=["place", "value", "weight"])

    return train


def train(docs: DataFrame, *, text_col: str = "text", rounds: int = ROUNDS) -> tuple[dict[bytes, int], np.ndarray]:
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    vocab, flat = vocabulary(docs, text_col), start()
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    for _ in range(rounds):
        mean = texts.mapInArrow(_trainer(sc.broadcast((vocab, flat))), "place int, value double, weight long").groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
        flat = flat.copy()
        flat[mean["place"].to_numpy()] = mean["value"].to_numpy()
    return vocab, flat


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = shared.value
        p = unpack(flat)
        for b in sliced(batches):
            ids = [tokens(t, vocab) for t in b.column(1).cast(pa.binary()).to_pylist()]
            sums, held, owner, size = np.zeros(len(ids)), [], [], 0

            def flush():
                around, target = np.concatenate([a for a, _ in held], axis=1), np.concatenate([t for _, t in held])
                lp = np.concatenate([log_probs(p, around[:, i : i + BATCH], target[i : i + BATCH]) for i in range(0, len(target), BATCH)])
                np.add.at(sums, np.array([o for o, _ in owner]), np.add.reduceat(lp.astype(np.float64), np.cumsum([0, *(n for _, n in owner[:-1])])))
                held.clear()
                owner.clear()

            for d, x in enumerate(ids):
                for i in range(0, len(x), SLICE):
                    at = np.arange(i, min(len(x), i + SLICE))
                    held.append((windows(x, at), x[at]))
                    owner.append((d, len(at)))
                    size += len(at)
                    if size >= SLICE:
                        flush()
                        size = 0
            if held:
                flush()
            n = np.array([len(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sums), pa.array([s / k if k else None for s, k in zip(sums.tolist(), n.tolist(), strict=True)], pa.float64())], names=["doc_id", "n_tokens", "log_prob", "per_token"])

    return score


def score(docs: DataFrame, model: tuple[dict[bytes, int], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over tokens) and per_token of every row."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, n_tokens long, log_prob double, per_token double")
