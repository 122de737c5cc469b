"""Scoring of candidates, diverse selection, and ranking with a memory of recent picks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import DEFAULTS, Params
from .dedupe import _bits

# What a host's pictures are worth, in tiers, and a candidate by the kind of search string that found it.
SOURCE_TIERS = (
    (1.00, ("commons.wikimedia.org", "upload.wikimedia.org", "wikipedia.org")),
    (0.85, ("swtor.com", "starwars.com", "lucasfilm.com", "ea.com", "bioware.com")),
    (0.70, ("fandom.com", "wikia.nocookie.net", "gamepedia.com", "wiki.gg")),
    (0.55, ("artstation.com", "deviantart.com", "flickr.com")),
    (0.40, ("reddit.com", "imgur.com", "pinterest.com", "tumblr.com")),
)
OTHER_TIER = 0.5
EVENT_BONUS = {"exact_event": 1.0, "quest": 0.6, "character_setting": 0.5, "location": 0.35, "object": 0.3, "youtube": 0.2, "fallback": 0.0}
SHAPES = ((1.9, "ultrawide"), (1.4, "widescreen"), (1.1, "landscape"), (0.9, "square"))


def build_prompt(interpretation: Column, entities: Column, event: Column, location: Column, narration: Column, tag: Column) -> Column:
    """What a picture is compared with: the segment's reading, names, event and place (its words, if there are none of these), and the tag."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    named = some(F.array_join(F.slice(entities, 1, 4), ", "))
    parts = [some(interpretation), named, some(event), some(location)]
    return F.left(F.concat_ws(". ", *parts, F.when(F.coalesce(*parts).isNull(), some(narration)), some(tag)), F.lit(600))


def source_tier(domain: Column) -> Column:
    host = F.lower(F.coalesce(domain, F.lit("")))
    out = F.lit(OTHER_TIER)
    for value, names in reversed(SOURCE_TIERS):
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(host, F.lit(n))
        out = F.when(hit, value).otherwise(out)
    return out


def entity_bonus(entities: Column, *texts: Column) -> Column:
    """Share of the entities (of over two characters) that stand in the record's own texts."""
    long = F.filter(entities, lambda e: F.length(e) > 2)
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return F.when(F.size(long) > 0, F.size(F.filter(long, lambda e: F.contains(hay, F.lower(e)))) / F.size(long)).otherwise(0.0)


def event_bonus(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in EVENT_BONUS.items() for x in (F.lit(k), F.lit(v))]), kind), F.lit(0.0))


def resolution_score(width: Column, height: Column) -> Column:
    mega = width.cast("double") * height / 1e6
    return F.when(mega > 0, F.least(F.lit(1.0), F.log1p(mega) / math.log(9.0))).otherwise(0.0)


def active_weights(meaningful: bool, params: Params = DEFAULTS) -> dict[str, float]:
    """The weights; without a meaningful embedding its share goes to the four others evenly."""
    w = dict(params.weights)
    if not meaningful:
        share = w["clip"] / 4
        w |= {"clip": 0.0} | {k: w[k] + share for k in ("entity", "source", "resolution", "sharpness")}
    return w


def score_records(records: DataFrame, meaningful: bool = True, params: Params = DEFAULTS) -> DataFrame:
    """Columns clip, entity, exact_event, source, resolution, sharpness, repetition, watermark -> adds score and breakdown.

    The entity term is the greater of itself and half the exact-event one.
    """
    w = active_weights(meaningful, params)
    entity = F.greatest("entity", 0.5 * F.col("exact_event"))
    total = (
        w["clip"] * F.col("clip") + w["entity"] * entity + w["source"] * F.col("source") + w["resolution"] * F.col("resolution") + w["sharpness"] * F.col("sharpness")
        + params.exact_event_weight * F.col("exact_event") - abs(w["repetition"]) * F.col("repetition") - params.watermark_weight * F.col("watermark")
    )
    names = ("clip", "entity", "exact_event", "source", "resolution", "sharpness", "repetition", "watermark")
    parts = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.round(entity if n == "entity" else F.col(n), 6) for n in names]))
    return records.withColumn("score", F.round(F.greatest(F.lit(0.0), total), 6)).withColumn("breakdown", parts)


def shape_bucket(width: Column, height: Column) -> Column:
    ratio = F.when(height != 0, width.cast("double") / height).otherwise(1.0)
    out = F.lit("portrait")
    for least, name in reversed(SHAPES):
        out = F.when(ratio >= least, name).otherwise(out)
    return out


def top_k(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each group by score, ties by sha256, numbered."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "sha256")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _shape(width: float, height: float) -> str:
    ratio = width / height if height else 1.0
    return next((name for least, name in SHAPES if ratio >= least), "portrait")


def pick_diverse(score: np.ndarray, phash: pd.Series, dhash: pd.Series, shapes: list[str], keep: int, params: Params = DEFAULTS) -> list[int]:
    """Places chosen from a pool in order of score: each next one by its score less its likeness to a chosen one and to their shapes.

    Likeness is 1 - distance / 20 by the nearer of two hashes, 0 without a phash; the earlier of equals wins.
    """
    if not len(score) or keep <= 0:
        return []
    p, has_p = _bits(phash)
    d, has_d = _bits(dhash)
    like, shape = np.zeros(len(score)), np.array(shapes)
    chosen, free, same = [0], np.ones(len(score), bool), np.zeros(len(score))
    while True:
        last = chosen[-1]
        free[last] = False
        if len(chosen) >= keep or not free.any():
            return chosen
        far = np.where(has_p & has_p[last], np.bitwise_count(p ^ p[last]).astype(float), 999.0)
        far = np.where(has_p & has_p[last] & has_d & has_d[last], np.minimum(far, np.bitwise_count(d ^ d[last])), far)
        like = np.maximum(like, 1 - np.minimum(1.0, far / 20.0))
        same += shape == shape[last]
        value = np.where(free, score - params.diversity * like - params.shape_penalty * same, -np.inf)
        chosen.append(int(np.argmax(value)))


def repetition_of(phash: np.ndarray, known: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """How much each picture resembles recent picks: the greatest of likeness (1 - distance / 12) times recency."""
    worst = np.zeros(len(phash))
    for age, picked in enumerate(reversed(history)):
        if len(picked):
            distance = np.bitwise_count(phash[:, None] ^ picked[None, :]).min(axis=1)
            worst = np.maximum(worst, np.where(distance <= 12, (1 - distance / 12) * (1 - age / len(history)), 0.0))
    return np.where(known, worst, 0.0)


def mmr_select(scored: DataFrame, keys: list[str], keep: int | None = None, params: Params = DEFAULTS) -> DataFrame:
    """The diverse best of each group, ranked; a group is one segment's kept candidates."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema) + ", rank int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(neg=-rows.score).sort_values(["neg", "sha256"], kind="stable").drop(columns="neg").reset_index(drop=True)
        chosen = pick_diverse(rows.score.to_numpy(float), rows.phash, rows.dhash, [_shape(w, h) for w, h in zip(rows.width, rows.height)], params.keep if keep is None else keep, params)
        return rows.iloc[chosen].assign(rank=range(1, len(chosen) + 1))

    return scored.groupBy(*keys).applyInPandas(run, schema)


def rank_with_history(records: DataFrame, keep: int | None = None, params: Params = DEFAULTS, window: int | None = None) -> DataFrame:
    """project, index, base (score without repetition) and hashes -> picks with score, repetition and rank.

    A segment's scores depend on what the last few segments of its project picked, so a project is one task; its rows are narrow.
    """
    schema = "project {}, index int, path string, sha256 string, base double, repetition double, score double, rank int".format(records.schema["project"].dataType.simpleString())
    columns = ["project", "index", "path", "sha256", "base", "phash", "dhash", "width", "height"]
    weight, memory = abs(params.weights["repetition"]), params.history if window is None else window

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        history, out = [], []
        for _, part in rows.sort_values("index", kind="stable").groupby("index", sort=True):
            part = part.reset_index(drop=True)
            p, known = _bits(part.phash)
            part["repetition"] = repetition_of(p, known, history)
            part["score"] = (part.base - weight * part.repetition).clip(lower=0).round(6)
            part = part.assign(neg=-part.score).sort_values(["neg", "sha256"], kind="stable").reset_index(drop=True)
            chosen = pick_diverse(part.score.to_numpy(), part.phash, part.dhash, [_shape(w, h) for w, h in zip(part.width, part.height)], params.keep if keep is None else keep, params)
            picked = part.iloc[chosen].assign(rank=range(1, len(chosen) + 1))
            q, has = _bits(picked.phash)
            history = [*history, q[has]][-memory:] if memory else []
            out.append(picked)
        return pd.concat(out)[["project", "index", "path", "sha256", "base", "repetition", "score", "rank"]]

    return records.select(*columns).groupBy("project").applyInPandas(run, schema)


def picks(ranked: DataFrame) -> DataFrame:
    """Ranked pictures as picks; the first of a segment is used."""
    return ranked.select("project", "index", F.lit("image").alias("kind"), "path", "rank", "score", F.round(F.least(F.lit(1.0), "score"), 3).alias("confidence"), (F.col("rank") == 1).alias("use"))


def sharpness(grey: np.ndarray) -> float:
    """Spread of the Laplacian over the four neighbours, on a saturating curve."""
    g = grey.astype(float)
    if min(g.shape) < 3:
        return 0.0
    laplacian = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(min(1.0, np.log1p(laplacian.var()) / np.log(501.0)))


def watermark(grey: np.ndarray) -> float:
    """How much more gradient a picture's border holds than its middle: 0 up to a ratio of 1.3, 1 from 3 on; 0 below 32 pixels a side.

    The border is an eighth at each edge; a corner belongs to a strip of rows and to one of columns, and counts in both.
    """
    if min(grey.shape) < 32:
        return 0.0
    energy = sum(np.abs(g) for g in np.gradient(grey.astype(float)))
    y, x = (max(2, n // 8) for n in grey.shape)
    rows, columns = np.delete(energy, np.s_[y:-y], 0), np.delete(energy, np.s_[x:-x], 1)
    middle = energy[y:-y, x:-x].mean()
    ratio = (rows.sum() + columns.sum()) / (rows.size + columns.size) / (middle if middle > 0 else 1e-6)
    return float(0.0 if ratio <= 1.3 else min(1.0, (ratio - 1.3) / 1.7))


def hash_embedding(text: str, size: int = 192) -> np.ndarray:
    """A stand-in for a text's embedding: bytes of its digests, centred and of unit length."""
    import hashlib

    raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(-(-size // 32)))[:size]
    v = np.frombuffer(raw, "u1").astype(float) - 127.5
    return v / np.linalg.norm(v)


def cosine_topk(vectors: DataFrame, keys: list[str], query: Column, k: int) -> DataFrame:
    """The k vectors of each group nearest to the query column, ties by id."""
    scored = vectors.withColumn("similarity", F.round(T.cosine(F.col("embedding"), query), 6))
    order = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
