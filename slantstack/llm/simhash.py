"""SimHash near-duplicates by multi-index hashing.

``fingerprints``: 64 bits; a bit is set where more than half of a text's shingle hashes (XXH64, seed 42) have it set.
``close_pairs``: fingerprints within two differing bits. A fingerprint has two segments of 32 bits; of two fingerprints
with two differing bits or fewer, one segment differs in one bit at most. A table holds each distinct fingerprint under
both segments; each fingerprint probes it with the Hamming ball of radius 1 around both segments (66 keys), and the
complete distances of what it meets are verified.

A key under which more than ``crowd`` distinct fingerprints stand (a large group of near copies shares segments) would
emit their square. There the ball is also enumerated in the other segment: the points at one differing bit of a
fingerprint, at most 33 a probe. Two fingerprints within two bits meet in such a point, and any two that meet are
within two bits, so each is linked to the least one of the point. Both ways are exact; no link is lost.

``components``: smallest reachable node by alternating large-star and small-star steps over the links.

Only distinct fingerprints are linked, so exact copies are never expanded into pairs.

``keep_one`` also links texts with ``similarity`` of their five-word shingles in common. Candidates come from prefixes:
in any order of all shingles, two such texts share one of their first n - ceil(similarity n) + 1 (``prefix``), so none is
lost, whatever their length. The order is by hash, with shingles common among prefixes last; texts that share a passage
only meet there if little else is in them. Of what meets, only pairs are compared that can still be similar by the number
of shingles they share in their prefixes and by what may follow (``possible``); they are compared on the whole sets of
shingle hashes, which the texts are scanned for again. Shingles that more than ``crowd`` texts hold even so bind these to cohorts: each text is compared with the most typical one of its cohort,
and where that leaves several components, all pairs of different components are compared in blocks of ``BLOCK`` texts.

Bounds: common shingles are broadcast (eight bytes each; at most the prefixes' length over ``crowd``). A cohort that
doesn't fall to one component costs (its texts)^2 / BLOCK rows: that is the price of comparing all of it. What is wanted
of the texts is broadcast as a byte each, for the scan.

Defined results. Null, empty and blank texts: fingerprint 0, linked like any other. Fewer words than a shingle: one
shingle of all words. Repeated rows and equal ids: a result each. A component whose ids are all null has a null
component_id. Empty table: empty result. Other columns are kept by ``keep_one`` and ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, discard, durable, sliced, small_batches, source_key, spare

HALF = 32
#: At most this many distinct fingerprints of a key are paired; larger ones are linked through shared points.
CROWD = 16
_SLICE = 65_536
#: Texts of a cohort that are compared with each other in one go, and columns of their shingles at a time.
BLOCK, COLUMNS = 256, 8192
#: Bytes of a shingle's hash in the sets that are compared.
KEPT = 5
#: Bits of one row of Spark's bitmaps, and bits for each text in the filter of a scan.
BITMAP, FILTER = 32_768, 8


def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every run of k words joined by blanks, in slices."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return
    line, width = b" ".join(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    begins, ends, digest = begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), xxhash.xxh64_intdigest
    for i in range(0, len(begins), _SLICE):
        yield np.array([digest(line[a:b], 42) for a, b in zip(begins[i : i + _SLICE], ends[i : i + _SLICE], strict=True)], np.uint64)


def fingerprint(text: bytes, k: int) -> int:
    return majority(shingle_hashes(text, k))


def majority(slices) -> int:
    """Bits that are set in more than half of the hashes; signed, as Spark's long holds it."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in slices:
        if not len(h):
            continue
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _printer(k: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([fingerprint(t or b"", k) for t in texts], pa.int64())], names=[*b.schema.names[:-1], "fp"])

    return prints


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of every row."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(_printer(shingle), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, fp long")


def _segment(fp, s: int):
    return F.shiftrightunsigned(fp, HALF) if s else fp.bitwiseAND(F.lit((1 << HALF) - 1))


def _key(value, s: int):
    return F.shiftleft(value, 1).bitwiseOR(F.lit(s))


#: The ball of radius 1 in a segment: itself and each bit flipped.
_BALL = [0, *(1 << i for i in range(HALF))]


def close_pairs(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links that connect all fingerprints (column fp, distinct) within two differing bits."""
    fp = F.col("fp")
    table = fps.select("fp", F.explode(F.array(*[_key(_segment(fp, s), s) for s in (0, 1)])).alias("key"))
    flips = F.array(*[F.lit(m).cast("long") for m in _BALL])
    probes = None
    for s in (0, 1):
        p = fps.select("fp", F.lit(s).alias("s"), F.explode(flips).alias("flip")).withColumn("key", _key(_segment(fp, s).bitwiseXOR(F.col("flip")), s))
        probes = p if probes is None else probes.unionAll(p)
    crowded = durable(table.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    found = probes.select("fp", "key").alias("p").join(table.join(crowded, "key", "left_anti").alias("t"), (F.col("p.key") == F.col("t.key")) & (F.col("p.fp") < F.col("t.fp")) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= 2))
    found = found.select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    # Crowded keys: the probe's key with the other segment as it is, and for an unflipped key with each of its bits flipped.
    met = probes.join(crowded, "key", "left_semi")
    other = F.when(F.col("flip") == 0, flips).otherwise(F.array(F.lit(0).cast("long")))
    moved = F.when(F.col("s") == 1, F.shiftleft("flip", HALF).bitwiseXOR(F.col("rest"))).otherwise(F.col("flip").bitwiseXOR(F.shiftleft("rest", HALF)))
    points = durable(met.select("fp", "s", "flip", F.explode(other).alias("rest")).select("fp", fp.bitwiseXOR(moved).alias("point")), "points")
    least = durable(points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("point", "a"), "least")
    linked = points.join(least, "point").where((F.col("a") < fp) & (F.bit_count(F.col("a").bitwiseXOR(fp)) <= 2)).select("a", fp.alias("b"))
    return durable(found.unionAll(linked).distinct(), "links", crowded, points, least)


def rooted(edges: DataFrame) -> DataFrame:
    """fp, root of what ``components`` gives."""
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def components(pairs: DataFrame) -> DataFrame:
    """u, v (durable): the smallest node v that each other node u of a component reaches (roots have no row)."""
    edges = durable(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            return edges
        state = now
        # Large star: every larger neighbour of u is tied to the least of u and its neighbours.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = durable(edges.select(F.col("v").alias("u"), F.col("u").alias("w")).unionAll(edges.select("u", F.col("u").alias("w"))).join(least, "u").where("w > m").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "large", edges, least)
        # Small star: u and its smaller neighbours are tied to the least of these.
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = durable(small.where("u > v").distinct(), "edges", large, least)


def near_duplicates(docs: DataFrame, *, shingle: int = 3, **cols) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = durable(fingerprints(docs, shingle=shingle, **cols), "prints")
    own = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "own")
    links = close_pairs(own.select("fp"))
    edges = components(links)
    tied = durable(own.join(rooted(edges), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "tied", links, own, edges)
    least = durable(tied.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component")
    of = durable(tied.join(least, "root").select("fp", "component_id"), "of", tied, least)
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")



def held_in(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which hashes are in ``common`` (sorted): a search each. ``np.isin`` sorts all of ``common`` again at every call, and that grows with the input."""
    return common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)


def prefix(distinct: np.ndarray, similarity: float, common: np.ndarray | None = None) -> np.ndarray:
    """The least shingle hashes of a set (sorted), those in ``common`` last: as many as a similar set must share one of."""
    if common is not None:
        often = held_in(distinct, common)
        distinct = np.concatenate((distinct[~often], distinct[often]))
    return distinct[: len(distinct) - math.ceil(similarity * len(distinct) - 1e-9) + 1]


def place(keys: np.ndarray, common: np.ndarray | None = None) -> int:
    """Where a prefix ends in the order of all shingles: never falls along it."""
    if not len(keys):
        return 0
    return int(keys[-1] >> np.uint64(2)) + (1 << 62 if common is not None and held_in(keys[-1:], common)[0] else 0)


def possible(similarity: float):
    """Whether a and b can be similar: columns shared (shingles in both prefixes), last (place of the last of these in the
    own prefix), n and end, each of the latter as a and b.

    Behind the last shared shingle and behind the prefix that ends first, no more shingles can be common than either has left.
    """
    left = {c: F.col(f"n{c}") - F.col(f"last{c}") - 1 for c in "ab"}
    rest = {c: F.ceil(similarity * F.col(f"n{c}") - 1e-9) - 1 for c in "ab"}
    behind = F.when(F.col("enda") < F.col("endb"), rest["a"]).when(F.col("endb") < F.col("enda"), rest["b"]).otherwise(F.greatest(rest["a"], rest["b"]))
    return F.col("shared") + F.least(left["a"], left["b"], behind) >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6


def to_bytes(distinct: np.ndarray) -> bytes:
    """The top ``KEPT`` bytes of each hash: that two different shingles agree in them has a chance of one in 2^40."""
    return np.unique(distinct >> np.uint64(64 - 8 * KEPT)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :].tobytes()


def from_bytes(kept: bytes) -> np.ndarray:
    wide = np.zeros((len(kept) // KEPT, 8), np.uint8)
    wide[:, 8 - KEPT :] = np.frombuffer(kept, np.uint8).reshape(-1, KEPT)
    return wide.view(">u8").astype(np.uint64).ravel()


def resemblance(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of hashes."""
    x, y = from_bytes(a), from_bytes(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def distinct_shingles(text: bytes | None, k: int) -> np.ndarray:
    return np.unique(np.concatenate([*shingle_hashes(text or b"", k), np.zeros(0, np.uint64)]))


def _signed(sets: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))


def _profiler(k: int, similarity: float):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 128):
            sets = [distinct_shingles(t, k) for t in b.column(2).cast(pa.binary()).to_pylist()]
            keys = [prefix(x, similarity) for x in sets]
            columns = [b.column(0), b.column(1), pa.array([majority([x]) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), _signed(keys), pa.array([place(x) for x in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "fp", "n", "keys", "end"])

    return profile


def _reorderer(k: int, similarity: float, shared):
    """doc_id, key, text -> doc_id, key, n, keys, end and the share of common shingles."""

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 128):
            sets = [distinct_shingles(t, k) for t in b.column(2).cast(pa.binary()).to_pylist()]
            share = [float(held_in(x, shared.value).mean()) if len(x) else 0.0 for x in sets]
            keys = [prefix(x, similarity, shared.value) for x in sets]
            columns = [b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), _signed(keys), pa.array([place(x, shared.value) for x in keys], pa.int64()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "keys", "end", "typical"])

    return reorder


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 128):
            sets = [to_bytes(distinct_shingles(t, k)) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["doc_id", "key", "shingles"])

    return sets


def _verifier(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield b.select(["a", "b"]).filter(pa.array([resemblance(p, q) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_()))

    return verify


def block_pairs(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all pairs of sets that are similar."""
    sizes = np.array([len(x) for x in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, some = np.repeat(np.arange(len(sets)), sizes), held > 1
    place = np.cumsum(some) - 1
    row, column = row[some[column]], place[column[some[column]]]
    order = np.argsort(column, kind="stable")
    row, column, both = row[order], column[order], np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(some.sum()), COLUMNS):
        x, y = np.searchsorted(column, (c, c + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[x:y], column[x:y] - c] = 1
        both += part @ part.T
    return np.nonzero(np.triu(both >= similarity * (sizes[:, None] + sizes - both) - 1e-6, 1))


def _blocks(similarity: float):
    def compare(group: pa.Table) -> pa.Table:
        fp, root = group["fp"].to_numpy(), group["root"].to_numpy()
        i, j = block_pairs([from_bytes(s) for s in group["shingles"].to_pylist()], similarity)
        a, b = fp[i], fp[j]
        apart = root[i] != root[j]
        return pa.table({"a": np.minimum(a, b)[apart], "b": np.maximum(a, b)[apart]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return compare


def among(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose ``columns`` are among those of ``wanted`` (durable), and a few others: a scan with a bit filter, no shuffle."""
    size = BITMAP * max(1, math.ceil(FILTER * wanted.count() / BITMAP))
    at = F.pmod(F.xxhash64(*columns), F.lit(size))
    bucket, bits, bit = (spare(rows, c) for c in ("bucket", "bits", "bit"))
    # Spark counts bits from 1
    marks = wanted.select((at + 1).alias(bit)).groupBy(F.bitmap_bucket_number(bit).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(bits))
    marked = rows.withColumn(bit, at).withColumn(bucket, F.bitmap_bucket_number(F.col(bit) + 1)).join(F.broadcast(marks), bucket)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.pmod(F.floor(F.col(bit) / 8), F.lit(BITMAP // 8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte, F.pmod(F.col(bit), F.lit(8)).cast("int")) == 1).select(rows.columns)


def similar_pairs(profiles: DataFrame, again, shingled, links: DataFrame, *, shingle: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """``links`` (a, b) and more of them, which connect all fingerprints whose texts are similar.

    profiles: fp (distinct), n, keys (the prefix), end (its ``place``) and typical, durable; again: from the common shingles
    (a sorted array) to such profiles in which these come last; shingled: from a durable table of fp to their fp and set of shingles.
    """
    held = lambda: profiles.select("fp", F.posexplode("keys").alias("pos", "key"))
    shared = lambda: durable(profiles.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    counts = shared()
    crowded = counts.where(F.col("m") > crowd).select("key")
    common = np.sort(crowded.toArrow()["key"].to_numpy().view(np.uint64))
    if len(common):
        # Prefixes without a common shingle stay as they are; the texts are scanned again, not shuffled.
        profiles = durable(again(common), "profiles", profiles, counts)
        counts = shared()
    meeting = durable(held().join(counts, "key").select("key", "fp", "pos", "m"), "meeting", counts)
    few, many = meeting.where(F.col("m") <= crowd), meeting.where(F.col("m") > crowd).select("key", "fp")
    met = few.alias("x").join(few.alias("y"), F.col("x.key") == F.col("y.key")).where(F.col("x.fp") < F.col("y.fp"))
    met = met.groupBy(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max("x.pos").alias("lasta"), F.max("y.pos").alias("lastb"))
    side = lambda c: profiles.select(F.col("fp").alias(c), F.col("n").alias("n" + c), F.col("end").alias("end" + c))
    # Texts that share a shingle of ``many`` too are compared below, whatever they share here.
    pairs = durable(met.join(side("a"), "a").join(side("b"), "b").where(possible(similarity)).select("a", "b"), "candidates")
    wanted = durable(pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).unionAll(many.select("fp")).distinct(), "wanted")
    sets = durable(shingled(wanted), "sets", wanted)
    one = lambda c: sets.select(F.col("fp").alias(c), F.col("shingles").alias("s" + c))
    verified = lambda p, *spent: durable(p.join(one("b"), "b").join(one("a"), "a").select("a", "b", "sa", "sb").mapInArrow(_verifier(similarity), "a long, b long"), "similar", *spent)
    links = links.unionAll(verified(pairs, pairs))
    if not many.take(1):
        discard(profiles, meeting, sets)
        return links
    least = durable(many.groupBy("key").agg(F.min("fp").alias("a")), "least")
    ties = components(many.join(least, "key").where("a < fp").select("a", F.col("fp").alias("b")).distinct())
    members = profiles.select("fp", "typical").join(many.select("fp").distinct(), "fp", "left_semi")
    cohorts = durable(members.join(rooted(ties), "fp", "left").select("fp", "typical", F.coalesce("root", "fp").alias("cohort")), "cohorts", profiles, meeting, least, ties)
    lead = durable(cohorts.groupBy("cohort").agg(F.max_by("fp", F.struct("typical", "fp")).alias("lead")), "leads")
    star = cohorts.join(lead, "cohort").where("fp <> lead").select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b"))
    links = links.unionAll(verified(star, lead))
    roots = components(links)
    placed = durable(cohorts.join(rooted(roots), "fp", "left").select("fp", "cohort", F.coalesce("root", "fp").alias("root")), "placed", cohorts, roots)
    mixed = placed.groupBy("cohort").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    # Half a block each from two parts of a cohort: every pair of its texts meets in one task at least.
    parts = F.ceil(F.col("m") / F.lit(BLOCK // 2)).cast("int")
    laid = durable(placed.join(mixed.select("cohort", parts.alias("parts")), "cohort").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).join(sets, "fp"), "laid", placed, sets)
    other = laid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = other.select("cohort", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp", "root", "shingles")
    rest = met.groupBy("cohort", "i", "j").applyInArrow(_blocks(similarity), "a long, b long")
    return links.unionAll(durable(rest, "rest", laid))


def keep_one(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the least id (then digest) stays.

    Linked are texts whose fingerprints (of distinct shingles) are within two bits, and texts that have ``similarity`` of
    their shingles in common.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), source_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    prints = durable(read.mapInArrow(_profiler(shingle, similarity), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, key string, fp long, n long, keys array<long>, end long"), "prints")
    # nulls last, then by digest; n_rows counts rows that are equal in both
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = durable(prints.groupBy("fp", "doc_id", "key").agg(F.count(F.lit(1)).alias("n_rows")).groupBy("fp").agg(F.min_by(F.struct("doc_id", "key", "n_rows"), rank).alias("best")).select("fp", "best.*"), "best")
    named = best.select(F.col("fp").alias("f"), F.col("doc_id").alias("i"), F.col("key").alias("k"), "n_rows")
    own = (F.col("doc_id").eqNullSafe(F.col("i"))) & (F.col("key") == F.col("k"))

    def single(rows: DataFrame) -> DataFrame:
        """A row for each fp: only rows of documents that stand there more than once need be told apart."""
        return rows.where("n_rows = 1").drop("n_rows").unionAll(rows.where("n_rows > 1").drop("n_rows").dropDuplicates(["fp"]))

    profiles = durable(single(prints.drop("fp").join(named, own).select(F.col("f").alias("fp"), "n", "keys", "end", F.lit(0.0).alias("typical"), "n_rows")), "profiles", prints)

    def again(common: np.ndarray) -> DataFrame:
        schema = f"doc_id {read.schema['doc_id'].dataType.simpleString()}, key string, n long, keys array<long>, end long, typical double"
        found = read.mapInArrow(_reorderer(shingle, similarity, docs.sparkSession.sparkContext.broadcast(common)), schema)
        return single(found.join(named, own).select(F.col("f").alias("fp"), "n", "keys", "end", "typical", "n_rows"))

    def shingled(fps: DataFrame) -> DataFrame:
        chosen = durable(best.join(fps, "fp", "left_semi").select("fp", "doc_id", "key", "n_rows"), "chosen")
        found = among(read, chosen, ["doc_id", "key"]).mapInArrow(_setter(shingle), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, key string, shingles binary")
        wanted = chosen.select("fp", F.col("doc_id").alias("i"), F.col("key").alias("k"), "n_rows")
        return single(found.join(wanted, own).select("fp", "shingles", "n_rows"))

    links = similar_pairs(profiles, again, shingled, close_pairs(best.select("fp")), shingle=shingle, similarity=similarity)
    roots = components(links)
    tied = durable(best.join(rooted(roots), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "doc_id", "key", "n_rows"), "tied", best, roots)
    kept = durable(tied.groupBy("root").agg(F.min_by(F.struct("doc_id", "key", "n_rows"), rank).alias("best")).select("best.*"), "kept", tied)
    key, many = spare(docs, "key"), spare(docs, "n_equal")
    mark = kept.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), F.col("n_rows").alias(many))
    rows = docs.withColumn(key, source_key(text_col)).alias("d").join(mark, F.col(f"d.{id_col}").eqNullSafe(F.col("kept_id")) & (F.col(f"d.{key}") == F.col("kept_key")))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    return rows.where(F.col(many) == 1).select(columns).unionAll(rows.where(F.col(many) > 1).select(columns).dropDuplicates([id_col, text_col]))
