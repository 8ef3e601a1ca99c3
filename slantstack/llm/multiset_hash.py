"""Document fingerprints: a homomorphic multiset hash, the sum of wide vectors hashed from paragraphs.

A paragraph (a line, or a sentence of one: long lines are cut after ". ") hashes to 128 bits. A document's fingerprint is the
sum of its paragraphs' vectors: the digest as ``WIDE`` lanes modulo 2^64, and its bits as ``WIDTH`` signs modulo 2^32. So the
order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its vector (``insert``,
``delete``). The wide lanes tell multisets apart whatever a paragraph's count below 2^64; the signs hold counts up to 2^31. Two
fingerprints' squared distance of signs over WIDTH estimates how many paragraphs are in one only, which gives ``likeness``:
1 - |a-b|^2 / (|a|^2+|b|^2), at least 0; 1 for equal fingerprints, less than 1 for others.

``edited`` needs the document that follows in descending id. Documents are dealt into ranges of ids, and the first
document of a range also goes to the range before, so texts are shuffled once and each task reads its range as a stream.
Ranges are quantiles of the ids; the driver holds one id of each range.

Defined results. Ids are integers, or text that holds one. Null text: empty. Very long texts: paragraphs are hashed 65,536 at a
time; a row's text and its follower's are held at once. A single document is followed by itself. Equal ids follow each other by text. Rows
without an id come last. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches

WIDTH, WIDE, MAX_RANGES = 128, 2, 4096
#: Likeness of fingerprints that differ, at most.
UNEQUAL = 1.0 - 2.0**-40


def paragraphs(text: str) -> list[bytes]:
    return [p for p in text.encode().replace(b". ", b".\n").split(b"\n") if p]


class Fingerprint(NamedTuple):
    wide: np.ndarray  # uint64
    signs: np.ndarray  # uint32

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.wide + other.wide, self.signs + other.signs)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.wide - other.wide, self.signs - other.signs)

    def __eq__(self, other) -> bool:
        return bool((self.wide == other.wide).all() and (self.signs == other.signs).all())

    def __ne__(self, other) -> bool:
        return not self == other


def fingerprint(text: str) -> Fingerprint:
    parts = paragraphs(text)
    wide, signs = np.zeros(WIDE, np.uint64), np.zeros(WIDTH, np.int64)
    for i in range(0, len(parts), 65536):
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in parts[i : i + 65536]]), np.uint8).reshape(-1, WIDTH // 8)
        wide += digests.view(np.uint64).sum(0, dtype=np.uint64)
        signs += 2 * np.unpackbits(digests, axis=1).sum(0, dtype=np.int64) - len(digests)
    return Fingerprint(wide, signs.astype(np.uint32))


def insert(fp: Fingerprint, paragraph: str) -> Fingerprint:
    return fp + fingerprint(paragraph)


def delete(fp: Fingerprint, paragraph: str) -> Fingerprint:
    return fp - fingerprint(paragraph)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a == b:
        return 1.0
    x, y = (f.signs.astype(np.int32).astype(np.float64) for f in (a, b))
    size = float((x**2).sum() + (y**2).sum())
    return min(UNEQUAL, max(0.0, 1.0 - float(((x - y) ** 2).sum()) / size)) if size else 0.0


def as_text(fp: Fingerprint) -> str:
    return base64.b64encode(fp.wide.astype("<u8").tobytes() + fp.signs.astype("<u4").tobytes()).decode()


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text: str, fp: Fingerprint, after: str, after_fp: Fingerprint) -> tuple:
    changed = edit(text, after)
    changed_fp = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(fp), as_text(changed_fp), likeness(fp, changed_fp), likeness(fp, after_fp)


def _compare(id_type: pa.DataType):
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: range, id, text, fingerprint
        for b in sliced(batches):
            out = []
            for part, extra, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if extra and (held is None or held[0] != part):
                    continue  # a further row with the id of the next range's first one
                fp = fingerprint(text)
                if held is not None and held[0] == part:
                    out.append(_row(*held[1:], text, fp))
                held = None if extra else (part, doc_id, text, fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return compare


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and how near they are to each other and to the next text's."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    ranges = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    # Each quantile opens a range; null ids have range -1.
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0))
    heads = sorted(map(tuple, ids.withColumn("part", part).groupBy("part").agg(F.max("doc_id")).collect()), reverse=True)
    # The head of a range follows the last row of the range above it; that of the highest, the last row of all.
    follows = spark.createDataFrame([(h[1], heads[(i - 1) % len(heads)][0]) for i, h in enumerate(heads)], "head long, above int")
    dealt = rows.withColumn("part", part).join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own, extra = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra")), F.struct(F.col("above").alias("part"), F.lit(True).alias("extra"))
    dealt = dealt.select("doc_id", "text", F.inline(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, extra))))
    ordered = dealt.repartitionById(len(bounds) + 2, F.col("part") + 1).sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text").select("part", "extra", "doc_id", "text")
    return ordered.mapInArrow(_compare(pa.int64()), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
