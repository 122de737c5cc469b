"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, pick, text_of

#: Weights that sources take in turn, in code-point order (null last); most copies of a document; words in a block; documents in a shard.
WEIGHTS, MOST, BLOCK, PER_SHARD, SEED = (5, 2, 1), 3, 8, 4096, "mix-1"


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds weight and target: total size shared by weight, a target stopping at most times the size and the excess shared again.

    Sorted by cap over weight, the sources that reach their cap come first; one that does not sets the level for all after it. A table
    of sources is a registry and small beside the documents; nothing else passes through its one partition.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("i", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("i"))
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "i", "level"))).over(whole)
    return found.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(common["level"] * F.col("weight")))


def sainte_lague(rows: DataFrame, group: list[str], order: str, votes: str, seats: str, name: str) -> DataFrame:
    """Adds to each row the seats that highest quotients votes / (2 s + 1) give it within its group.

    With n rows, T seats and V votes in a group, the method gives a row between v (T - n/2) / V - 1/2 and v (T + n/2) / V + 1/2
    seats. Up to the lower bound they are certain; only the quotients between the bounds (about two a row) are ranked. Equal
    quotients go by the order column. A group without votes gets no seats.
    """
    w = Window.partitionBy(*group)
    v, t, n, total = F.col(votes), F.col(seats), F.count("*").over(w), F.sum(votes).over(w)
    low = F.when(total > 0, F.greatest(F.floor(v * (t - n / 2) / total - 1.5), F.lit(0))).otherwise(0).cast("long")
    high = F.when(total > 0, F.greatest(F.floor(v * (t + n / 2) / total + 1.5), F.lit(0))).otherwise(0).cast("long")
    base = rows.withColumn("low", low).withColumn("high", high).withColumn("open", F.col(seats) - F.sum("low").over(w))
    bids = base.where("high > low").select(*group, order, votes, "open", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("s"))
    place = F.row_number().over(w.orderBy((F.col(votes) / (2 * F.col("s") + 1)).desc(), order, "s"))
    won = bids.withColumn("place", place).where("place <= open").groupBy(*group, order).agg(F.count("*").alias("won"))
    return base.join(won, [*group, order], "left").withColumn(name, F.col("low") + F.coalesce(F.col("won"), F.lit(0))).drop("low", "high", "open", "won")


def mix_sources(docs: DataFrame, carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, per_shard: int = PER_SHARD, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, then source, copies and two word ranges of the document.

    The mix takes each document `copies` times whole, and once more its words [head_start, head_start + head_words) and
    [tail_start, tail_start + tail_words); taken is the sum. Sizes are words; a null text has none, a null source is one more source.
    Every source's documents are dealt by hash to shards of about per_shard; Sainte-Laguë gives each source a number of equal blocks by
    its target, and each shard its integer quota of them by its size. A shard's documents, in seeded order, form a stream of blocks: the
    quota takes the whole stream as often as it goes, then a run of blocks from a seeded place, cyclically. Blocks cost nothing by number
    (the work is that of sources, shards and documents), so they are small and a source misses its target by a few words a shard. Reruns agree: rows with one id go by their size, then
    by a digest of their text. Repeated rows are documents of their own; an empty table gives none; a long text is a number like any other.
    carry names columns of docs to keep; others are ignored, whatever their names.
    """
    names = [c for c in carry if c not in ("doc_id", "source")]
    source = pick(docs, *dict.fromkeys(["doc_id", "text", "source", *names]))
    sized = source.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"), F.md5(text_of()).alias("digest"), *[F.col(c).alias(f"carry_{c}") for c in names])
    sized = sized if names else materialize(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    whole = Window.partitionBy("g")
    found = _targets(totals, weights, most).withColumn("g", F.lit(0)).withColumn("seats", F.round(F.sum("source_size").over(whole) / block).cast("long"))
    found = sainte_lague(found, ["g"], "i", "target", "seats", "blocks")
    found = found.select("i", F.col("source").alias("of"), "source_size", "target", "blocks", F.ceil(F.col("n_docs") / per_shard).cast("long").alias("shards"))
    found = materialize(found, "sources")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    dealt = sized.join(found, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("h", key)
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("h", 25, 8), 16, 10).cast("long"), F.col("shards")))
    shards = dealt.groupBy("i", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("blocks"))
    shards = sainte_lague(shards, ["i"], "shard", "shard_size", "blocks", "quota").select("i", "shard", "shard_size", "quota")
    turn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "i", "shard")), 1, 8), 16, 10).cast("long")
    n = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1)).cast("long")
    shards = shards.withColumn("n", n).withColumn("copies", F.least(F.floor(F.col("quota") / F.col("n")), F.lit(most)).cast("long"))
    shards = shards.withColumn("rest", F.when(F.col("copies") == most, 0).otherwise(F.col("quota") % F.col("n"))).withColumn("turn", turn % F.col("n"))
    end = F.col("turn") + F.col("rest")
    shards = shards.select("i", "shard", "copies", (F.col("turn") * block).alias("from1"), (F.least(end, F.col("n")) * block).alias("to1"), (F.greatest(end - F.col("n"), F.lit(0)) * block).alias("to2"))
    stream = Window.partitionBy("i", "shard").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(shards, ["i", "shard"]).withColumn("a", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    a, b, zero = F.col("a"), F.col("a") + F.col("size"), F.lit(0)
    tail = F.greatest(F.least(b, F.col("to1")) - F.greatest(a, F.col("from1")), zero)
    head = F.greatest(F.least(b, F.col("to2")) - a, zero)
    out = placed.withColumn("tail_words", tail).withColumn("head_words", head).withColumn("tail_start", F.when(F.col("tail_words") > 0, F.greatest(a, F.col("from1")) - a).otherwise(0))
    taken = F.col("copies") * F.col("size") + F.col("tail_words") + F.col("head_words")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "copies", F.lit(0).cast("long").alias("head_start"), "head_words", "tail_start", "tail_words", *[F.col(f"carry_{c}").alias(c) for c in names])


#: The same mix as SQL over a view of documents.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM totals),
weighed AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM ranked),
leveled AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
capped AS (SELECT *, cap <= level * weight AS is_capped FROM leveled),
targets AS (SELECT *, CASE WHEN is_capped THEN CAST(cap AS DOUBLE) ELSE arg_min(level, CASE WHEN is_capped THEN NULL ELSE {'r': cap / weight, 'i': i} END) OVER () * weight END AS target,
    CAST(round(sum(source_size) OVER () / @block) AS BIGINT) AS seats, count(*) OVER () AS k FROM capped),
votes1 AS (SELECT *, sum(target) OVER () AS total FROM targets),
bounds1 AS (SELECT *, CASE WHEN total > 0 THEN CAST(greatest(floor(target * (seats - k / 2) / total - 1.5), 0) AS BIGINT) ELSE 0 END AS low,
    CASE WHEN total > 0 THEN CAST(greatest(floor(target * (seats + k / 2) / total + 1.5), 0) AS BIGINT) ELSE 0 END AS high FROM votes1),
open1 AS (SELECT *, seats - sum(low) OVER () AS open FROM bounds1),
bids1 AS (SELECT i, open, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, i, s) AS place FROM (SELECT i, target, open, unnest(range(low, high)) AS s FROM open1)),
won1 AS (SELECT i, count(*) AS won FROM bids1 WHERE place <= open GROUP BY i),
sources AS (SELECT o.i, o.source, o.source_size, o.target, o.low + coalesce(w.won, 0) AS blocks, CAST(ceil(n_docs / 4096) AS BIGINT) AS shards FROM open1 o LEFT JOIN won1 w USING (i)),
keyed AS (SELECT d.doc_id, d.size, d.digest, s.*, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(size AS VARCHAR)) AS h FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
dealt AS (SELECT *, CAST('0x' || substr(h, 25, 8) AS BIGINT) % shards AS shard FROM keyed),
shard_sizes AS (SELECT i, shard, CAST(sum(size) AS BIGINT) AS shard_size, max(blocks) AS seats FROM dealt GROUP BY i, shard),
votes2 AS (SELECT *, sum(shard_size) OVER (PARTITION BY i) AS total, count(*) OVER (PARTITION BY i) AS k FROM shard_sizes),
bounds2 AS (SELECT *, CASE WHEN total > 0 THEN CAST(greatest(floor(shard_size * (seats - k / 2) / total - 1.5), 0) AS BIGINT) ELSE 0 END AS low,
    CASE WHEN total > 0 THEN CAST(greatest(floor(shard_size * (seats + k / 2) / total + 1.5), 0) AS BIGINT) ELSE 0 END AS high FROM votes2),
open2 AS (SELECT *, seats - sum(low) OVER (PARTITION BY i) AS open FROM bounds2),
bids2 AS (SELECT i, shard, open, row_number() OVER (PARTITION BY i ORDER BY shard_size / (2 * s + 1) DESC, shard, s) AS place FROM (SELECT i, shard, shard_size, open, unnest(range(low, high)) AS s FROM open2)),
won2 AS (SELECT i, shard, count(*) AS won FROM bids2 WHERE place <= open GROUP BY i, shard),
quotas AS (SELECT o.i, o.shard, CAST(greatest(ceil(shard_size / @block), 1) AS BIGINT) AS n, o.low + coalesce(w.won, 0) AS quota FROM open2 o LEFT JOIN won2 w USING (i, shard)),
turned AS (SELECT *, least(quota // n, 3) AS copies, CAST('0x' || substr(md5('mix-1|' || CAST(i AS VARCHAR) || '|' || CAST(shard AS VARCHAR)), 1, 8) AS BIGINT) % n AS turn FROM quotas),
runs AS (SELECT *, CASE WHEN copies = 3 THEN 0 ELSE quota % n END AS rest FROM turned),
ranges AS (SELECT i, shard, copies, turn * @block AS from1, least(turn + rest, n) * @block AS to1, greatest(turn + rest - n, 0) * @block AS to2 FROM runs),
placed AS (SELECT d.*, r.copies, r.from1, r.to1, r.to2, coalesce(sum(size) OVER (PARTITION BY i, shard ORDER BY h, doc_id NULLS LAST, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM dealt d JOIN ranges r USING (i, shard)),
parts AS (SELECT *, greatest(least(a + size, to1) - greatest(a, from1), 0) AS tail_words, greatest(least(a + size, to2) - a, 0) AS head_words FROM placed)
SELECT doc_id, size, source_size, target, CAST(copies * size + tail_words + head_words AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies, CAST(0 AS BIGINT) AS head_start,
  CAST(head_words AS BIGINT) AS head_words, CAST(CASE WHEN tail_words > 0 THEN greatest(a, from1) - a ELSE 0 END AS BIGINT) AS tail_start, CAST(tail_words AS BIGINT) AS tail_words
FROM parts
""".replace("\\\\", "\\").replace("@block", str(BLOCK))
