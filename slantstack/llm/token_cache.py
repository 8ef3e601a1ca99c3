"""Token counts through a digest cache: only texts that the cache doesn't know are encoded.

The cache is a Parquet table ``<cache>/tokenizer=<digest of the tokenizer file and library version>`` of (digest,
n_tokens), digest being the SHA-256 of the normalised content. Normalisation may not change a count, so it is UTF-8
with null as the empty text. A call (1) digests every row, (2) anti-joins the distinct digests to the cache, (3) sends
the texts of the missing ones, one row for each, through the tokenizer, (4) appends these counts as new files, and
(5) joins all rows to the cache. The digest is a function of the content, so a second writer of the same digest only
repeats a row; readers group them. Texts are encoded whole.

Step 3 joins on (id, digest): ids spread copies evenly, so thousands of copies of a text meet as digests, not as texts.

Defined results. Null text: 0 bytes, 0 tokens. Null ids and repeated rows: a result each. Empty table: empty result and
an unchanged cache. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, shared_dir, sliced, small_batches

CACHED = "digest binary, n_tokens long"
_LOADED: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the file and of the library's version: either changes the counts."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    return hashlib.sha256(library.encode() + b"\n" + Path(path).read_bytes()).hexdigest()[:32]


def counter(path: str):
    """texts -> counts, as the library gives them: no begin, end or added special tokens, no truncation or padding."""
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _LOADED[path] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            p = SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(p.encode(x, num_threads=1)) for x in texts]
    return _LOADED[path]


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in sliced(batches):
            digests, texts, once = b.column(0).to_pylist(), b.column(1).to_pylist(), {}
            for d, t in zip(digests, texts, strict=True):
                once.setdefault(d, t)
            yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.binary()), pa.array(count(list(once.values())), pa.int64())], names=["digest", "n_tokens"])

    return encode


def _cached(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHED).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    except AnalysisException:  # nothing stored yet
        return spark.createDataFrame([], CACHED)


def token_counts(docs: DataFrame, tokenizer: str, *, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row. ``tokenizer``: path of a .json or .model file that all executors have.

    ``cache``: a folder that all executors share; by default one in the shared folder of the session.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = f"{(cache or shared_dir(spark) + '/token-counts').rstrip('/')}/tokenizer={tokenizer_version(tokenizer)}"
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    known = durable(rows.select("doc_id", "digest", "n_bytes"), "digests")
    first = known.groupBy("digest").agg(F.min_by("doc_id", F.coalesce(F.hash("doc_id"), F.lit(0))).alias("doc_id"))
    missing = first.join(_cached(spark, path), "digest", "left_anti")
    texts = rows.alias("r").join(missing.alias("m"), (F.col("r.digest") == F.col("m.digest")) & F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")), "left_semi").select("digest", "text")
    texts.mapInArrow(_encoder(tokenizer), CACHED).write.mode("append").parquet(path)
    counts = durable(first.select("digest").join(_cached(spark, path), "digest"), "counts")
    return known.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def report(docs: DataFrame, tokenizer: str, limit: int = 4096, **kw) -> DataFrame:
    return token_counts(docs, tokenizer, **kw).withColumn("over_limit", F.col("n_tokens") > limit)
