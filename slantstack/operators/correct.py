"""Corrections given per epoch (atmospheric delay): choice of source, differences for pairs, effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Preferred first.
SOURCES = ("slant_tif", "zenith_tif", "zenith_flat")


def choose_source(epochs: DataFrame, files: DataFrame) -> DataFrame:
    """t, source: the best kind of file of each epoch, NULL if it has none. files: t, kind."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("kind"))
    best = files.where(rank > 0).groupBy("t").agg(F.min_by("kind", rank).alias("source"))
    return epochs.select("t").join(F.broadcast(best), "t", "left")


def pair_corrections(pairs: DataFrame, delays: DataFrame) -> DataFrame:
    """p, y, x, corr: second epoch's delay less the first's, where both are given. delays: t, y, x, delay."""
    a = delays.select(F.col("t").alias("i"), "y", "x", F.col("delay").alias("da"))
    b = delays.select(F.col("t").alias("j"), "y", "x", F.col("delay").alias("db"))
    return a.join(F.broadcast(pairs), "i").join(b, ["j", "y", "x"]).select("p", "y", "x", (F.col("db") - F.col("da")).alias("corr"))


def uncorrectable(pairs: DataFrame, delays: DataFrame) -> DataFrame:
    """Pairs of which an epoch has no delay at all."""
    have = delays.select("t").distinct()
    full = pairs.join(F.broadcast(have.withColumnRenamed("t", "i")), "i", "left_semi").join(F.broadcast(have.withColumnRenamed("t", "j")), "j", "left_semi")
    return pairs.join(F.broadcast(full.select("p")), "p", "left_anti")


def corrected(obs: DataFrame, corrections: DataFrame) -> DataFrame:
    """y, x, p, ph, before: phases less the correction."""
    return obs.join(corrections, ["p", "y", "x"]).select("y", "x", "p", (F.col("ph") - F.col("corr")).alias("ph"), F.col("ph").alias("before"))


def effect(corr: DataFrame) -> DataFrame:
    """p, std_before, std_after, rate (percent) of each pair."""
    s = corr.where("ph is not null").groupBy("p").agg(F.stddev_pop("before").alias("std_before"), F.stddev_pop("ph").alias("std_after"))
    return s.withColumn("rate", (F.col("std_before") - F.col("std_after")) / F.nullif("std_before", F.lit(0.0)) * 100)


def freshness(remote: DataFrame, local: DataFrame) -> DataFrame:
    """path, code: 0 the same, 1 another size, 2 remote newer, 3 not there remotely, 4 not there locally. Both: path, size, mtime."""
    r, loc = remote.select("path", F.col("size").alias("rs"), F.col("mtime").alias("rm")), local.select("path", F.col("size").alias("ls"), F.col("mtime").alias("lm"))
    code = F.when(F.col("rs").isNull(), 3).when(F.col("ls").isNull(), 4).when(F.col("rs") != F.col("ls"), 1).when(F.col("rm") > F.col("lm"), 2).otherwise(0)
    return r.join(loc, "path", "full_outer").select("path", code.alias("code"))


def latest_with_layer(files: DataFrame, kind: str, until: int) -> DataFrame:
    """t: the last epoch at or before ``until`` that has a file of a kind."""
    return files.where((F.col("kind") == kind) & (F.col("t") <= until)).agg(F.max("t").alias("t"))
