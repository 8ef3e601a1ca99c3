"""Line dedup by content-defined chunks of lines that are looked up in all texts.

Lines: a text is cut at line ends and, inside these, behind every word that ends in a mark (``MARKS``) or whose hash is the
least of some ``CUT`` successive ones. That depends on the words alone, in any script, and no line has more than ``CUT`` words. Chunks: ``LINES``
successive lines; a rolling hash runs over the line hashes, and where it is the least of some ``WINDOW`` successive ones
a chunk begins (winnowing). Inside a passage the same chunks are found whatever stands around it: two places that
have ``CUT * (LINES + WINDOW - 1) + 2 * (CUT - 1)`` = 49 words in common share a chunk at least, and most that have 25 do.

A chunk whose hash stands in more than one place is a candidate. Its first place (least id, then position) stays. The
chunks of a text whose first places lie in one document at the same shift are joined to a span, with ``MARGIN`` words on either
side; the bytes of the first document's span are fetched, and every word is compared with them. Of runs of equal words,
``min_words`` at least, that reach over a line end of the text or have ``LONE`` words, the lines that lie in them whole
are removed. So a lone common line stays, and a removed word always has its equal at an earlier place.

Shuffles: a row a chunk (hash, id, place), counted with partial sums; the compressed texts twice, to fetch spans and to
rebuild. Rows of a hot chunk are joined to a single row of it; spans of a hot first document meet a single text.
Every intermediate table is deleted once the next is written; the last, of spans, when the application ends.

Defined results. Null text stays null. Blank texts are kept. Rows equal in id and text are one document: each keeps what
the other keeps. Null ids count as the least id. Very long texts are read whole, their words hashed in blocks of ``BLOCK``
bytes. Empty table: empty result. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, sliced, small_batches
from .simhash import among

CUT, LINES, WINDOW, LONE = 3, 4, 12, 40
#: Words on either side of a span's chunks: what is the same further off has a chunk of its own.
MARGIN = CUT * (WINDOW + 1)
#: Chunks further apart (words) or longer spans are spans of their own.
GAP, SPAN = CUT * (LINES + WINDOW), 8192
#: Bytes hashed at a time, and the longest word hashed with others.
BLOCK, WORD = 1 << 20, 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
#: Marks that end a clause; behind a word that ends so a line ends.
MARKS = b".,;:!?"
_MARK = np.isin(np.arange(256), list(MARKS))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_MOST = np.uint64(2**64 - 1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


_UP, _DOWN = _powers(_STEP, BLOCK), _powers(pow(_STEP, -1, 2**64), BLOCK)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


class Words(NamedTuple):
    """Words of some texts that lie one behind the other."""

    begin: np.ndarray  # byte
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray  # which text
    ends_line: np.ndarray  # a line of the text ends behind the word
    marked: np.ndarray  # the word ends in a mark


def _block_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin, end and hash of the words in at most BLOCK bytes; ``first``: bytes at which a text begins."""
    blank = _SPACE[data]
    apart = np.zeros(len(data) + 1, bool)
    apart[first] = apart[len(data)] = apart[0] = True
    apart[1:] |= blank
    begin = np.flatnonzero(~blank & apart[:-1])
    after = apart[1:].copy()
    after[:-1] = blank[1:]
    after[first[first > 0] - 1] = True
    end = np.flatnonzero(~blank & after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _UP[: len(data)], out=sums[1:])
    h = _mixed((sums[end] - sums[begin]) * _DOWN[begin])
    for i in np.flatnonzero(end - begin > WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return begin, end, h


def split_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of the texts data[bounds[i]:bounds[i+1]] (bytes)."""
    parts, at, last = [], int(bounds[0]), int(bounds[-1])
    while at < last:
        to = min(at + BLOCK, last)
        if to < last:  # up to a text's begin or a blank; a word that fills the block stands alone
            edge = int(bounds[np.searchsorted(bounds, to, "right") - 1])
            blanks = np.flatnonzero(_SPACE[data[max(at, edge) : to]])
            if len(blanks):
                to = max(at, edge) + int(blanks[-1]) + 1
            elif edge > at:
                to = edge
            else:
                stop = int(bounds[np.searchsorted(bounds, to, "left")])
                while to < stop and not (found := np.flatnonzero(_SPACE[data[to : min(to + BLOCK, stop)]])).size:
                    to = min(to + BLOCK, stop)
                to += int(found[0]) if to < stop else 0
                parts.append((np.array([at]), np.array([to]), np.array([xxhash.xxh3_64_intdigest(data[at:to].tobytes())], np.uint64)))
                at = to
                continue
        inside = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, to)] - at
        b, e, h = _block_words(data[at:to], inside)
        parts.append((b + at, e + at, h))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), none, none.astype(bool), none.astype(bool))
    begin, end, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(begin, bounds)))
    feeds = np.flatnonzero(data[int(bounds[0]) : last] == 10) + int(bounds[0])
    ends_line = np.ones(len(begin), bool)
    ends_line[:-1] = text[1:] != text[:-1]
    before = np.searchsorted(end, feeds, "right") - 1
    ends_line[before[before >= 0]] = True
    return Words(begin, end, h, text, ends_line, _MARK[data[end - 1]])


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of every ``width`` successive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = best(x[:-step], x[step:]), done + step
    return x


def least_of(x: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Which values are the least of some ``width`` successive ones of their text."""
    if not len(x):
        return np.zeros(0, bool)
    order = np.concatenate(([0], np.cumsum(text[1:] != text[:-1])))
    padded = np.full(len(x) + (width - 1) * (int(order[-1]) + 2), _MOST)
    at = np.arange(len(x)) + (width - 1) * (order + 1)
    padded[at] = x
    # Of the windows that hold a value, the greatest minimum is the value itself.
    return _slide(_slide(padded, width, np.minimum), width, np.maximum)[at - (width - 1)] == x


def line_begins(w: Words) -> np.ndarray:
    """Words at which a line begins."""
    cut = w.ends_line | w.marked | least_of(w.hash, w.text, CUT)
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(cut)), bool), cut[:-1])))


def lines(text: bytes) -> list[bytes]:
    """Concatenated they are the text."""
    w = split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    at = [0, *w.begin[line_begins(w)[1:]].tolist(), len(text)]
    return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def chunks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk: its text, its first word (numbered in the text) and its hash."""
    begin = line_begins(w)
    if len(begin) < LINES:
        return begin[:0], begin[:0], w.hash[:0]
    size = np.diff(np.concatenate((begin, [len(w.hash)])))
    wide = np.concatenate((w.hash, np.zeros(CUT, np.uint64)))
    h = wide[begin] * _UP[1]
    for k in range(1, CUT):
        h += np.where(size > k, wide[begin + k] * _UP[k + 1], np.uint64(0))
    h, text, n = _mixed(h), w.text[begin], len(begin) - LINES + 1
    rolled = np.zeros(n, np.uint64)
    for k in range(LINES):
        rolled += h[k : k + n] * _UP[k + 1]
    whole = np.flatnonzero(text[:n] == text[LINES - 1 :])
    rolled, text, begin = _mixed(rolled[whole]), text[whole], begin[whole]
    place = np.flatnonzero(least_of(rolled, text, WINDOW))
    rolled, text, begin = rolled[place], text[place], begin[place]
    # Of a run of equal chunks one in WINDOW is enough.
    fresh = np.ones(len(place), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (text[1:] != text[:-1])
    step = (place - np.maximum.accumulate(np.where(fresh, place, 0))) // WINDOW
    fresh[1:] |= step[1:] != step[:-1]
    first = np.searchsorted(w.text, text)
    return text[fresh], (begin - first)[fresh], rolled[fresh]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _lists(column: pa.Array) -> Iterator[list[tuple]]:
    """The structs of each list as tuples: a Python list a field, no dict a struct."""
    rows = zip(*(f.to_pylist() for f in column.flatten().flatten()), strict=True)
    for n in column.value_lengths().to_pylist():
        yield list(islice(rows, n or 0))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        if not b.num_rows:
            continue
        data, offsets = _buffers(b.column(2))
        text, at, h = chunks(split_words(data, offsets))
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), pa.array(at.astype(np.int64))], names=["h", "doc_id", "rk", "at"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in sliced(batches):
        packed = [None if t is None else z.compress(t) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(packed, pa.binary())], names=[*b.schema.names[:-1], "packed"])


def spans(found: list[tuple]) -> list[tuple]:
    """Chunks of a text as (first document, its word, word here), to spans (first document, from, to, word here)."""
    out, held = [], None
    for doc, there, here in sorted(found, key=lambda f: (f[0], f[2] - f[1], f[2])):
        if held and held[0] == doc and held[3] - held[1] == here - there and there - held[2] <= GAP and there - held[1] <= SPAN:
            held[2] = there
            continue
        if held:
            out.append(held)
        held = [doc, there, there, here]
    if held:
        out.append(held)
    spread = []
    for doc, begin, end, here in out:
        before = min(MARGIN, begin, here)
        spread.append((doc, begin - before, end + CUT * LINES + MARGIN, here - before))
    return spread


def _span_rows(id_type: pa.DataType):
    """doc_id, rk, found -> first_id, first_rk, wanted (spans of many texts in the same first document share a row)."""
    wanted = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("doc_id", id_type), ("rk", pa.int64()), ("at", pa.int64()), ("own", pa.bool_())]))

    def span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            by: dict[tuple, list] = {}
            for doc_id, rk, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _lists(b.column(2)), strict=True):
                number: dict[tuple, int] = {}
                places = [(number.setdefault((first_id, first_rk), len(number)), there, here) for first_id, first_rk, there, here in found]
                name = list(number)
                for i, begin, end, here in spans(places):
                    by.setdefault(name[i], []).append({"from": begin, "to": end, "doc_id": doc_id, "rk": rk, "at": here, "own": name[i] == (doc_id, rk)})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in by], id_type), pa.array([k[1] for k in by], pa.int64()), pa.array(list(by.values()), wanted)], names=["first_id", "first_rk", "wanted"])

    return span_rows


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """packed, wanted -> doc_id, rk, at, own (the first place is in the text itself), body."""
    unpack, size, out, kinds = zstandard.ZstdDecompressor().decompress, 0, [], None

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "rk", "at", "own", "body"])

    for b in sliced(batches, 64):
        kinds = (b.column(1).type.value_type.field("doc_id").type, pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for packed, wanted in zip(b.column(0).to_pylist(), _lists(b.column(1)), strict=True):
            words = unpack(packed).split()
            for begin, end, doc_id, rk, at, own in wanted:
                body = b" ".join(words[begin:end])
                out.append((doc_id, rk, at, own, body))
                size += len(body) + 64
                if size > BLOCK:
                    yield batch()
                    out.clear()
                    size = 0
    if out:
        yield batch()


def same_runs(words: list[bytes], matches: list[tuple], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs (from, to) of ``min_words`` or more words that stand in first places too, and which words stand first in another text.

    matches: at, own, body of the first places of the text's spans.
    """
    same, elsewhere = np.zeros(len(words), bool), np.zeros(len(words), bool)
    for x, own, body in matches:
        there = body.split()
        here = words[x : x + len(there)]
        equal = np.fromiter(map(eq, here, there), bool, len(here))
        same[x : x + len(here)] |= equal
        if not own:
            elsewhere[x : x + len(here)] |= equal
    runs = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0])))).reshape(-1, 2)
    return runs[runs[:, 1] - runs[:, 0] >= min_words], elsewhere


def removed_lines(runs: np.ndarray, elsewhere: np.ndarray, ends_line: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, int]:
    """Which lines (they begin at the words ``begins``) go, and how many of their words stand first in another text."""
    gone, ends = np.zeros(len(begins), bool), np.append(begins[1:], len(elsewhere))
    for x, y in runs.tolist():
        if y - x >= LONE or ends_line[x : y - 1].any():
            gone[np.searchsorted(begins, x) : np.searchsorted(ends, y, "right")] = True
    return gone, int(elsewhere[np.repeat(gone, ends - begins)].sum())


def _rebuild(min_words: int):
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in sliced(batches):
            texts = [None if p is None else unpack(p) for p in b.column(b.num_columns - 2).to_pylist()]
            counts, cut, copied, matches = [0] * len(texts), [False] * len(texts), [0.0] * len(texts), list(_lists(b.column(b.num_columns - 1)))
            runs = {i: same_runs(texts[i].split(), m, min_words) for i, m in enumerate(matches) if m}
            # Without a run that is long enough nothing goes, whatever the lines are.
            some = [i for i, (found, _) in runs.items() if len(found)]
            bounds = np.cumsum([0, *(len(texts[i]) for i in some)])
            w = split_words(np.frombuffer(b"".join(texts[i] for i in some), np.uint8), bounds)
            all_begins = line_begins(w)
            for k, i in enumerate(some):
                x, y = np.searchsorted(w.text, (k, k + 1))
                begins = all_begins[np.searchsorted(all_begins, x) : np.searchsorted(all_begins, y)]
                text = texts[i]
                gone, elsewhere = removed_lines(*runs[i], w.ends_line[x:y], begins - x)
                copied[i] = elsewhere / max(1, int(y - x))
                counts[i] = int(gone.sum())
                if counts[i]:
                    at = w.begin[begins] - bounds[k]
                    at[0] = 0
                    kept = np.append(at, len(text))[np.flatnonzero(np.diff(np.concatenate(([1], gone.astype(np.int8), [1]))))]
                    texts[i] = b"".join(text[p:q] for p, q in kept.reshape(-1, 2).tolist())
                    cut[i] = not texts[i].strip()
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(cut, pa.bool_()), pa.array(copied, pa.float64())], names=[*b.schema.names[:-2], "new_text", "n_removed", "emptied", "copied"])

    return rebuild


def dedup_lines(docs: DataFrame, *, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``others``, new_text, n_removed (lines), emptied (nothing is left) and copied (share of the words that were cut
    and stand first in another text) of every row."""
    small_batches(docs.sparkSession)
    rk = F.xxhash64(F.lit(3), F.col(id_col), F.col(text_col)).alias("rk")
    read = docs.select(F.col(id_col).alias("doc_id"), rk, F.col(text_col).cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    rows = durable(read.mapInArrow(_chunk_rows, f"h long, doc_id {kind}, rk long, at long"), "chunks")
    repeated = durable(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated")
    places = durable(rows.join(repeated, "h", "left_semi"), "places", rows, repeated)
    first = places.groupBy("h").agg(F.min(F.struct("doc_id", "rk", "at")).alias("first")).select("h", F.col("first.doc_id").alias("first_id"), F.col("first.rk").alias("first_rk"), F.col("first.at").alias("first_at"))
    # One row a chunk on the right: rows of a hot chunk can be split, as a second key gives sums by the first an exchange of their own.
    top = F.shiftright("h", 32).alias("top")
    here = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("rk") == F.col("first_rk")) & (F.col("at") == F.col("first_at"))
    again = places.select("*", top).join(first.select("*", top), ["h", "top"]).where(~here).groupBy("doc_id", "rk").agg(F.collect_list(F.struct("first_id", "first_rk", "first_at", "at")).alias("found"))
    listed = f"first_id {kind}, first_rk long, wanted array<struct<`from`: long, to: long, doc_id: {kind}, rk: long, at: long, own: boolean>>"
    wanted = durable(again.mapInArrow(_span_rows(to_arrow_type(read.schema["doc_id"].dataType)), listed), "spans", places)
    packed = lambda rows, *more: rows.mapInArrow(_pack, _schema(docs, id_col, more) + "packed binary")
    # Texts that hold no first place aren't packed nor shuffled here.
    source = among(docs.select(F.col(id_col).alias("doc_id"), rk, F.col(text_col).cast("string").alias("text")), wanted.select(F.col("first_id").alias("doc_id"), F.col("first_rk").alias("rk")), ["doc_id", "rk"])
    met = packed(source).join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("rk") == F.col("first_rk"))).select("packed", "wanted")
    # No table of their own: for each file of a local folder Hadoop starts three processes (chmod) from the executor's JVM.
    bodies = met.mapInArrow(_fetch, f"doc_id {kind}, rk long, at long, own boolean, body binary")
    found = bodies.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("at", "own", "body")).alias("matches")).withColumnRenamed("doc_id", "id").withColumnRenamed("rk", "hash")
    names = [f"o{i}" for i in range(len(others))]
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("rk") == F.col("hash"))
    more = [F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)]
    joined = packed(docs.select(F.col(id_col).alias("doc_id"), rk, *more, F.col(text_col).cast("string").alias("text")), *more).join(found, same, "left").select("doc_id", *names, "packed", "matches")
    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(others, names, strict=True))
    out = joined.mapInArrow(_rebuild(min_words), f"doc_id {kind}, {fields}new_text string, n_removed long, emptied boolean, copied double")
    return out.select("doc_id", *(F.col(n).alias(c) for c, n in zip(others, names, strict=True)), "new_text", "n_removed", "emptied", "copied")


def _schema(docs: DataFrame, id_col: str, more) -> str:
    kept = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("rk"), *more).schema
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept)


def without_repeats(docs: DataFrame, *, most_copied: float = 0.6, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with repeated lines cut from the texts.

    Texts of which nothing is left go, and so do near copies: texts of which more than ``most_copied`` of the words were cut
    and stand first in other texts. What they leave is no document of its own.
    """
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    found = dedup_lines(docs.select([F.col(f"`{c}`") for c in docs.columns]), id_col=id_col, text_col=text_col, others=others, **kw)
    # Other columns may clash with this module's names: columns are told by place.
    flat = found.toDF("a_id", *(f"b{i}" for i in range(len(others))), "c_text", "d_n", "e_gone", "f_copied").where(~F.col("e_gone") & (F.col("f_copied") <= most_copied))
    place = {c: f"b{i}" for i, c in enumerate(others)} | {id_col: "a_id", text_col: "c_text"}
    return flat.select(*(F.col(place[c]).alias(c) for c in docs.columns))
