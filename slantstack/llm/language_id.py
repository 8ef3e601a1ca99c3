"""Language ID by multilingual mixture inference.

Model: character trigrams (hashed to ``BUCKETS``) of lower-cased words are counted per language over all labelled rows,
with one row per (language, bucket) leaving each task. A word's likelihood in a language is the product of its
trigrams'. A document's words are drawn from a mixture of languages whose shares expectation-maximisation estimates; the
set of languages grows from the best single one, in order of the shares, while the likelihood gains more than
``PENALTY`` * log(words) for a further language. The prediction is the set's language with the largest share, and
``score`` is this share.

Bounds: the driver and each worker hold (languages x BUCKETS) figures, whatever the corpus. Texts are read in slices of
about ``SLICE`` code points; a text's words cost 8 bytes a language while it is scored.

Defined results. Null texts and texts without a letter: ``und`` with score 0, as for every text if nothing is labelled.
Null ids and labels: scored, not learned. Repeated rows: a result each. Empty table: empty result. Ties go to the first
language in order. Other columns are ignored; ``keep_known`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches

BUCKETS, SLICE, PENALTY, ROUNDS, SMOOTH = 1 << 15, 1 << 18, 3.0, 12, 0.05
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter."""
    return np.fromiter((ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(0x110000))), np.uint32, 0x110000)


def _codes(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, texts, code points with a 0 after each text) in slices; a longer text comes alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= SLICE or i == len(texts) - 1:
            yield begin, i + 1 - begin, np.frombuffer("\x00".join([*texts[begin : i + 1], ""]).encode("utf-32-le"), np.uint32)
            begin, size = i + 1, 0


def trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, and where words begin among them."""
    x = np.concatenate((np.zeros(1, np.uint32), _letters()[codes], np.zeros(1, np.uint32)))
    at = np.flatnonzero(x)
    mixed = x[at - 1] * np.uint32(0x9E3779B1) ^ x[at] * np.uint32(0x85EBCA77) ^ x[at + 1] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(17)).astype(np.int32) % BUCKETS, np.flatnonzero(x[at - 1] == 0), at


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def out():
        for lang, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["lang", "bucket", "n"])

    for b in sliced(batches):
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for _, _, codes in _codes(texts):
                counts[lang] = counts.get(lang, 0) + np.bincount(trigrams(codes)[0], minlength=BUCKETS)
        if len(counts) > 64:
            yield from out()
            counts.clear()
    yield from out()


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-likelihoods (bucket, language) of trigrams."""
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = labelled.mapInArrow(_counter, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    table = np.full((BUCKETS, max(1, len(langs))), SMOOTH)
    place = {x: i for i, x in enumerate(langs)}
    np.add.at(table, (rows["bucket"].to_numpy(), np.array([place[x] for x in rows["lang"].to_pylist()], int)), rows["n"].to_numpy())
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def _shares(p: np.ndarray, of: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """EM over all documents of a slice: shares (document, language), zero where not allowed."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        r = p * share[of]
        r /= r.sum(1, keepdims=True)
        share = np.add.reduceat(r, first, axis=0) / n[:, None]
    return share


def infer(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of the selected languages. words: log-likelihoods (word, language); first: each document's first word."""
    n = np.diff(np.append(first, len(words)))
    of = np.repeat(np.arange(len(first)), n)
    top = words.max(1, keepdims=True)
    p = np.maximum(np.exp(words - top), 1e-30).astype(np.float64)
    single = np.add.reduceat(words.astype(np.float64) - top, first, axis=0)
    order = np.argsort(-_shares(p, of, first, n, np.ones_like(single)), axis=1, kind="stable")
    best = single.argmax(1)
    rows = np.arange(len(first))
    chosen = np.zeros(single.shape, bool)
    chosen[rows, best] = True
    share, gain = chosen.astype(float), single[rows, best]
    growing = np.ones(len(first), bool)
    for k in range(single.shape[1]):
        nxt = order[:, k]
        todo = np.flatnonzero(growing & ~chosen[rows, nxt])
        if not len(todo):
            continue
        tried = chosen[todo].copy()
        tried[np.arange(len(todo)), nxt[todo]] = True
        own = np.isin(of, todo)
        sub_n = n[todo]
        sub_first = np.concatenate(([0], np.cumsum(sub_n)[:-1]))
        sub_of = np.repeat(np.arange(len(todo)), sub_n)
        new = _shares(p[own], sub_of, sub_first, sub_n, tried.astype(float))
        likely = np.add.reduceat(np.log((p[own] * new[sub_of]).sum(1)), sub_first)
        better = likely - gain[todo] > PENALTY * np.log(sub_n + 1)
        chosen[todo[better]], share[todo[better]], gain[todo[better]] = tried[better], new[better], likely[better]
        growing[todo[~better]] = False
    return share


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for b in sliced(batches):
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for begin, count, codes in _codes(texts) if langs else ():
                grams, starts, at = trigrams(codes)
                if not len(grams):
                    continue
                likely = np.add.reduceat(table[grams], starts, axis=0)
                ends = np.cumsum([len(t) + 1 for t in texts[begin : begin + count]])
                doc = np.searchsorted(ends, at[starts] - 1, side="right")  # at counts from the 0 in front
                some, first = np.unique(doc, return_index=True)
                share = infer(likely, first)
                best = share.argmax(1)
                for d, i, s in zip(some, best, share[np.arange(len(best)), best], strict=True):
                    pred[begin + d], score[begin + d] = langs[i], min(1.0, s)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, columns: dict | None = None, text_col: str = "text") -> DataFrame:
    """``columns`` (name: expression), lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    read = docs.select(*(v.alias(k) for k, v in (columns or {"doc_id": F.col("doc_id")}).items()), F.col(text_col).cast("string").alias("the_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in read.schema.fields[:-1])
    return read.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model)), fields + "lang_pred string, score double")


def keep_known(docs: DataFrame, *, min_score: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language that makes up ``min_score`` of its words."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = predict(docs, train(docs, text_col=text_col, lang_col=lang_col), columns={n: F.col(f"`{c}`") for n, c in zip(names, docs.columns, strict=True)}, text_col=text_col)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
