"""Exact and near duplicates by hashes, with greedy survivors."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import DEFAULTS

#: The better of two records: more pixels, more bytes, a license, the later path.
QUALITY = ["pixels", "bytes", "licensed", "path"]


def simhashes(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, simhash: 64 bits (16 hex digits), each the majority of that bit over the digests of a text's distinct tokens; zeros without tokens.

    Bits are 64 sums in one aggregate, combined before they are shuffled.
    """
    tokens = texts.select(id_column, F.explode_outer(T.tokens(F.col(text_column))).alias("t"))
    digests = tokens.select(id_column, F.conv(F.substring(F.md5("t"), 1, 16), 16, -10).cast("long").alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]
    counted = digests.groupBy(id_column).agg(F.count("h").alias("n"), *sums)
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("n"), "1").otherwise("0") for b in range(63, -1, -1)]
    return counted.select(id_column, F.lower(F.lpad(F.conv(F.concat(*bits), 2, 16), 16, F.lit("0"))).alias("simhash"))


def exact_duplicates(records: DataFrame, keys: list[str]) -> DataFrame:
    """Adds keeper (path of the best record with the same sha256 in the key's group) and duplicate."""
    by = [*keys, "sha256"]
    best = records.groupBy(*[F.col(c).alias(f"{c}_") for c in by]).agg(F.max_by("path", F.struct(*QUALITY)).alias("keeper"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by]
    return records.join(best, same).drop(*[f"{c}_" for c in by]).withColumn("duplicate", F.col("keeper") != F.col("path"))


def bands(column: Column, distance: int, equal: int = 2) -> list[Column]:
    """Keys such that hashes within the distance share one at least.

    column: a hash as a long. Of distance + equal blocks of bits, `equal` must agree; each choice of so many blocks is a key, a long of the
    blocks' bits with the number of the choice above them. More blocks mean more keys, each of more bits: 28 of 16 bits for a distance of
    6 and 2 equal blocks, 210 of 25 bits for 4, which billions of hashes need.
    """
    edges = np.linspace(0, 64, distance + equal + 1).round().astype(int).tolist()
    keys = []
    for i, chosen in enumerate(combinations(range(distance + equal), equal)):
        key = F.lit(i).cast("long")
        for k in chosen:
            width = edges[k + 1] - edges[k]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(column, edges[k]).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    return keys


def near_pairs(records: DataFrame, id_column: str, hash_column: str, distance: int = DEFAULTS.hamming_distance, equal: int = 2) -> DataFrame:
    """a, b, distance of all pairs of unlike hashes within the distance, and of equal hashes through their least id.

    An equi-join on keys of bits has every such pair; equal hashes are one node, so a mass of copies makes no pairs among themselves.
    """
    nodes = records.where(F.col(hash_column).isNotNull()).groupBy(F.col(hash_column).alias("h")).agg(F.min(id_column).alias("id"))
    known = nodes.where(F.col("h").rlike("^[0-9a-fA-F]{1,16}$")).select("id", F.conv("h", 16, -10).cast("long").alias("v"), F.length("h").alias("n"))
    banded = known.select("id", "v", "n", F.explode(F.array(*bands(F.col("v"), distance, equal))).alias("band"))
    x, y = banded.toDF("a", "va", "n", "band"), banded.toDF("b", "vb", "n", "band")
    d = F.bit_count(F.col("va").bitwiseXOR(F.col("vb")))
    unlike = x.join(y, (x.band == y.band) & (x.n == y.n) & (F.col("a") < F.col("b")) & (d <= distance)).select("a", "b", d.alias("distance")).distinct()
    copies = records.select(F.col(id_column).alias("b"), F.col(hash_column).alias("h")).join(nodes, "h").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b", F.lit(0).alias("distance"))
    return unlike.union(copies)


def _bits(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    known = values.fillna("").str.fullmatch("[0-9a-fA-F]{16}")
    return np.array([int(v, 16) if ok else 0 for v, ok in zip(values, known)], "u8"), known.to_numpy(bool)


def greedy_dedupe(records: DataFrame, keys: list[str], distance: int = DEFAULTS.hamming_distance) -> DataFrame:
    """Adds keeper and reason (exact, phash, dhash; both null for what is kept) within each group of keys.

    From the best record on, a record goes to the keeper with its sha256, else to the first keeper within the distance by phash,
    else by dhash, else it is kept. Only keepers are compared with, so this is no matter of components. A group is one segment's
    candidates, whose number fan-out bounds.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", keeper string, reason string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(QUALITY, ascending=False, kind="stable").reset_index(drop=True)
        p, has_p = _bits(rows.phash)
        d, has_d = _bits(rows.dhash)
        kept: list[int] = []
        by_sha: dict[str, int] = {}
        keeper, reason = [None] * len(rows), [None] * len(rows)
        for i, sha in enumerate(rows.sha256):
            hit, why = by_sha.get(sha), "exact"
            if hit is None and kept:
                k = np.array(kept)
                near_p = has_p[i] & has_p[k] & (np.bitwise_count(p[k] ^ p[i]) <= distance)
                near_d = has_d[i] & has_d[k] & (np.bitwise_count(d[k] ^ d[i]) <= distance)
                near = near_p | near_d
                if near.any():
                    j = int(np.argmax(near))
                    hit, why = kept[j], "phash" if near_p[j] else "dhash"
            if hit is None:
                kept.append(i)
                by_sha[sha] = i
            else:
                keeper[i], reason[i] = rows.path[hit], why
        return rows.assign(keeper=keeper, reason=reason)

    return records.groupBy(*keys).applyInPandas(run, schema)


def mark_duplicates(deduped: DataFrame) -> DataFrame:
    """Status and note of each record, from greedy_dedupe's columns."""
    note = F.when(F.col("keeper").isNotNull(), F.concat(F.col("reason"), F.lit(" duplicate of "), F.col("keeper")))
    return deduped.withColumn("status", F.when(F.col("keeper").isNull(), "kept").otherwise("duplicate")).withColumn("notes", note)


def thin(deduped: DataFrame, keys: list[str], least: int = 15) -> DataFrame:
    """Groups with fewer records kept than `least`."""
    return deduped.groupBy(*keys).agg(F.count_if(F.col("keeper").isNull()).alias("kept")).where(F.col("kept") < least)


def picture_hashes(pixels: np.ndarray) -> tuple[str, str]:
    """(phash, dhash) of a grey picture: signs of low cosine frequencies against their median, and of differences along rows."""

    def shrunk(height: int, width: int) -> np.ndarray:
        y = np.linspace(0, pixels.shape[0], height + 1).astype(int)
        x = np.linspace(0, pixels.shape[1], width + 1).astype(int)
        return np.array([[pixels[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(x, x[1:])] for a, b in zip(y, y[1:])])

    n = 32
    basis = np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(n)[:, None] / (2 * n))
    low = (basis @ shrunk(n, n) @ basis.T)[:8, :8].ravel()
    small = shrunk(8, 9)
    return tuple(f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}" for bits in (low > np.median(low), small[:, 1:] > small[:, :-1]))
