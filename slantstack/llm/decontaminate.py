"""Benchmark decontamination: an Aho-Corasick automaton over normalised test items scans each text once.

Texts and items are lower-cased (A-Z) and cut into words; every run of ``width`` consecutive words of an item (the
whole item if it is shorter) is a window. Words of windows are numbered, and the automaton runs over a text's sequence of word
numbers (0 for any other word), where neighbours stand beside each other in some window, so a window has at most ``width`` states and a match ends at a word. ``spans`` maps the words hit
to code points of the original text.

Distinct windows and their items are found by a query; the driver gets them as one table and broadcasts it, and every worker
builds the automaton once. Memory: about 0.4 kB a window in a worker (213,000 windows: 82 MB), 0.2 kB on the driver. Up to
``BLOCK`` windows are one automaton, which scans each text once; beyond that every further ``BLOCK`` windows scan it again and
the hits of a text are merged: the results are the same.

Defined results. Very long texts are scanned whole, one at a time. Null or wordless texts: no words, no hits. Null or wordless items: no pattern. An item without an id
marks words but is no counted item. Repeated rows: a result each. Empty tables: empty result, or no hits. Other columns
of either table are ignored here and, whatever their names, kept by the pipeline stage.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, sliced, small_batches, source_key

#: Windows of an automaton.
BLOCK = 1_000_000
#: Bits of the table of neighbours, as a power of 2.
BITS = 22
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BUILT: dict[str, "Scanner"] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _windows(width: int):
    """item_id and texts -> window (words joined by blanks), item_id."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = []
            for item, *texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for text in texts:
                    w = words((text or "").encode())
                    k = min(width, len(w))
                    found += [(b" ".join(w[i : i + k]), item) for i in range(len(w) - k + 1) if k]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], names=["window", "item"])

    return windows


def patterns(items: DataFrame, id_col: str, text_cols: list[str], width: int, block: int) -> list[pa.Table]:
    """Tables of window and items (sorted ids), ``block`` windows each."""
    read = items.select(F.col(id_col).cast("string").alias("item"), *(F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(text_cols)))
    found = read.mapInArrow(_windows(width), "window binary, item string").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    table = found.toArrow().sort_by("window").combine_chunks()
    return [table.slice(k, block) for k in range(0, max(1, table.num_rows), block)]


class Scanner:
    """An automaton over word numbers and the items of its windows.

    A match is a run of words whose neighbours are neighbours in some window. The automaton gets only such runs of a text;
    neighbours are looked up in a bit table by hash, so a run may be too long but no match is left out.
    """

    def __init__(self, table: pa.Table):
        self.items = table["items"]
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.beside, alone, sizes = np.zeros(1 << BITS, bool), [0], set()
        for n, p in enumerate(table["window"].to_pylist()):
            key = tuple([self.number.setdefault(w, len(self.number) + 1) for w in p.split()])
            self.automaton.add_word(key, (n, len(key)))
            self.beside[self._places(np.array(key))] = True
            sizes.add(len(key))
            if len(key) == 1:
                alone += key
        self.least = min(sizes, default=1)
        self.alone = np.zeros(len(self.number) + 1, bool)
        self.alone[alone[1:]] = True
        if self.number:
            self.automaton.make_automaton()

    @staticmethod
    def _places(ids: np.ndarray) -> np.ndarray:
        """Of each pair of neighbours, its bit in the table."""
        return (((ids[:-1] << 32 | ids[1:]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    def hits(self, text: bytes) -> tuple[int, np.ndarray | None, set[int]]:
        """Words, which of them lie in a match (None if none does), and the windows matched."""
        w = words(text)
        if not w or not self.number:
            return len(w), None, set()
        get = self.number.get
        ids = np.array([get(x, 0) for x in w])
        near = self.beside[self._places(ids)] & (ids[:-1] > 0) & (ids[1:] > 0)
        run = np.zeros(len(w) + 2, np.int8)
        run[1:-1] = self.alone[ids]
        run[1:-2] |= near
        run[2:-1] |= near
        edge, found = None, set()
        for a, b in np.flatnonzero(np.diff(run)).reshape(-1, 2).tolist():
            if b - a < self.least:
                continue
            for last, (n, k) in self.automaton.iter(tuple(ids[a:b].tolist())):
                edge = np.zeros(len(w) + 1, np.int64) if edge is None else edge
                edge[a + last - k + 1] += 1
                edge[a + last + 1] -= 1
                found.add(n)
        return len(w), None if edge is None else np.cumsum(edge[:-1]) > 0, found

    def items_of(self, found: set[int]) -> list[str]:
        return sorted({i for n in found for i in self.items[n].as_py()})


def _scanner_of(key: str, table: pa.Table) -> Scanner:
    if key not in _BUILT:
        _BUILT.clear()  # one automaton at a time in a worker
        _BUILT[key] = Scanner(table)
    return _BUILT[key]


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the text as it was."""
    at = [m.span() for m in _WORD.finditer(text)]
    on = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"begin": at[a][0], "end": at[b - 1][1]} for a, b in on.reshape(-1, 2)]


def _scan_rows(shared, key: str, keep_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner_of(key, shared.value)
        for b in sliced(batches):
            counts, n_hit, spans, ids = [], [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                n, hit, found = scanner.hits(text or b"")
                counts.append(n)
                n_hit.append(0 if hit is None else int(hit.sum()))
                spans.append([] if hit is None else original_spans(text.decode(), hit))
                ids.append(scanner.items_of(found))
            texts = b.column(1) if keep_text else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "n_hit", "spans", "items"])

    return scan


_SCANNED = "doc_id {}, text string, n_words long, n_hit long, spans array<struct<begin:long,end:long>>, items array<string>"


def scan(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("text",), width: int = 10, block: int = BLOCK, keep_text: bool = True) -> DataFrame:
    """doc_id, text, n_words, n_hit, spans (code points, begin and end) and items (ids, sorted) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = patterns(items, item_id, list(item_texts), width, block)
    schema = _SCANNED.format(read.schema["doc_id"].dataType.simpleString())
    parts = [read.mapInArrow(_scan_rows(spark.sparkContext.broadcast(b), uuid.uuid4().hex, keep_text or len(blocks) > 1), schema) for b in blocks]
    if len(parts) == 1:
        return parts[0]
    # Several blocks: the hits of equal rows are merged by id and digest, go back to every row, and are counted again there.
    runs = None
    for p in parts:
        p = p.where(F.size("items") + F.size("spans") > 0).select("doc_id", source_key().alias("key"), "spans", "items")
        runs = p if runs is None else runs.unionAll(p)
    merged = runs.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("named"))
    left = parts[0].select("doc_id", "text", "n_words", source_key().alias("key")).alias("a")
    join = left.join(merged.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    empty = "cast(array() as array<{}>)"
    whole = join.select("a.doc_id", "text", "n_words", F.lit(0).cast("long").alias("n_hit"), F.coalesce("found", F.expr(empty.format("struct<begin:long,end:long>"))).alias("spans"), F.coalesce("named", F.expr(empty.format("string"))).alias("items"))
    return whole.mapInArrow(_covered, schema)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_hit by the (possibly overlapping) spans."""
    for b in sliced(batches):
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
            n, end = 0, 0
            for s in sorted(spans, key=lambda s: (s["begin"], s["end"])):
                if s["end"] > end:
                    n += len(_WORD.findall(text[max(s["begin"], end) : s["end"]]))
                    end = s["end"]
            out.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.int64()), *b.columns[4:]], names=b.schema.names)


def report(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    found = scan(docs, items, keep_text=False, **kw)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _flagger(shared, key: str, text_at: int):
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner_of(key, shared.value)
        for b in sliced(batches):
            clean = [scanner.hits(t or b"")[1] is None for t in b.column(text_at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return flag


def without_hits(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("text",), width: int = 10, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no pattern stands. Nothing is shuffled."""
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    for windows in patterns(items, item_id, list(item_texts), width, block):
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        rows = rows.mapInArrow(_flagger(shared, uuid.uuid4().hex, docs.columns.index(text_col)), rows.schema)
    return rows.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
