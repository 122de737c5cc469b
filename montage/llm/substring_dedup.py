"""Removal of every byte covered by a long string that also starts elsewhere, by suffix sorting of shards that hold equal windows together.

Every window of 200 bytes contains an anchor, the 50-byte gram with the least hash in it, so equal windows have equal anchors. Consecutive
windows with one anchor form a segment. Anchors that occur once cannot belong to a repeated window; of the rest, equal segments are
counted, and only distinct segments of anchors that have several go on, as bytes, to shards by anchor. A shard's segments are one text whose
suffixes are sorted with common prefixes by external induced sorting; a window that shares 200 bytes with a neighbour in that order is
repeated. An anchor with very many distinct segments (a passage that many texts quote) would make a shard of its own size: its segments
are cut anew by longer anchors, which tell most of them apart, and windows that even these leave together are matched by digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, pick, remove, shards_for, text_of
from .induced_sort import suffix_sort

#: Bytes of a window, of an anchor, of a longer anchor, of a shard's text; distinct segments of one anchor beyond which longer ones cut them.
WINDOW, GRAM, LONG_GRAM, SHARD_BYTES, HOT_SEGMENTS = 200, 50, 185, 1_500_000, 256
_SPAN = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xC2B2AE3D27D4EB4F | 1


class _Grams:
    """Rolling hashes modulo 2^64 by prefix sums of byte codes times powers of an odd base."""

    def __init__(self, base: int = _BASE, seed: int = 7):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.codes = np.random.default_rng(seed).integers(0, 2**63, 256, "u8") * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, "u8")

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            k = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, k, 1 << 64))])
            self.inverses = np.concatenate([self.inverses, self.inverses * np.uint64(pow(self.inverse, k, 1 << 64))])

    def __call__(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, "u8")
        np.cumsum(self.codes[data] * self.powers[:n], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * self.inverses[: n + 1 - width]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return h ^ (h >> np.uint64(29))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` values, by running minima from both ends of blocks."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, ~np.uint64(0))
    full[:n] = x
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes], grams: _Grams, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of (text number, first window, windows, anchor hash, segment hash) of the texts' segments, a group of texts at a time."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), _SPAN - window + 1):
            piece = text[at : at + _SPAN]
            if group and size + len(piece) > _SPAN:
                yield _segments_of(group, grams, window, gram)
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield _segments_of(group, grams, window, gram)


def _segments_of(group: list[tuple[int, int, bytes]], grams: _Grams, window: int, gram: int) -> tuple[np.ndarray, ...]:
    joined = b"".join(p[2] for p in group)
    data = np.frombuffer(joined, "u1")
    lengths = np.array([len(p[2]) for p in group])
    starts = np.cumsum(lengths) - lengths
    h = grams(data, gram)
    # the place in the low bits makes the leftmost of equal grams the least; content alone decides, as places grow with windows
    low = np.uint64(_SPAN - 1)
    least = _sliding_least((h & ~low) | np.arange(len(h), dtype="u8"), window - gram + 1)
    anchor = (least & low).astype("i4")
    counts = lengths - window + 1
    owner = np.repeat(np.arange(len(group), dtype="i4"), counts)
    windows = np.arange(counts.sum()) + (starts - (np.cumsum(counts) - counts))[owner]
    anchor = anchor[windows]
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    spans = np.diff(np.append(first, len(windows)))
    begin, whose = windows[first], owner[first]
    digest = xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(joined[f:t]) for f, t in zip(begin.tolist(), (begin + spans + window - 1).tolist())), "u8", len(first))
    text_of_piece, place_of_piece = np.array([p[0] for p in group]), np.array([p[1] for p in group])
    return text_of_piece[whose], place_of_piece[whose] + begin - starts[whose], spans, h[anchor[first]].view("i8"), digests.view("i8")


def _occurrences(texts: DataFrame) -> DataFrame:
    """ref, first, windows, anchor, segment of each segment; ref is a 128-bit digest of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        for batch in batches:
            refs, data = batch.column(0), [v.as_py() for v in batch.column(1).cast(pa.large_binary())]
            for text, first, n, anchor, segment in segments(data, grams):
                columns = [first.astype("i8"), n.astype("i2"), anchor, segment]
                yield pa.RecordBatch.from_arrays([refs.take(pa.array(text)), *[pa.array(c) for c in columns]], names=["ref", "first", "windows", "anchor", "segment"])

    return map_batches(texts.select("ref", "text"), run, "ref binary, first long, windows short, anchor long, segment long")


def repeated_windows(pieces: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each piece the places of its windows that occur in any piece more than once, by suffix sorting."""
    # UTF-8 has no byte 0xC0 or 0xFF: the one stands for zero bytes, the other ends a piece; a zero byte ends the text
    text = np.frombuffer(b"\xff".join(pieces).replace(b"\0", b"\xc0") + b"\xff\0", "u1")
    order, common = suffix_sort(text, window)
    reach = common >= window
    hit = reach.copy()
    hit[:-1] |= reach[1:]
    found = np.zeros(len(text), bool)
    found[order[hit]] = True
    out, at = [], 0
    for piece in pieces:
        out.append(np.flatnonzero(found[at : at + max(len(piece) - window + 1, 0)]))
        at += len(piece) + 1
    return out


def _runs(places: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Byte ranges covered by windows at ascending places."""
    if not len(places):
        return
    breaks = np.flatnonzero(np.diff(places) > 1)
    for i, j in zip(np.append(0, breaks + 1), np.append(breaks, len(places) - 1)):
        yield int(places[i]), int(places[j]) + window


def _sort_shard(table: pa.Table) -> pa.Table:
    pieces = table.column("bytes").to_pylist()
    single, refs, firsts = table.column("single").to_pylist(), table.column("ref").to_pylist(), table.column("first").to_pylist()
    rows = []
    for k, places in enumerate(repeated_windows(pieces)):
        if single[k]:
            rows += [(refs[k], firsts[k] + a, firsts[k] + b) for a, b in _runs(places, WINDOW)]
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["ref", "start", "stop"])


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each segment with two hashes: segment's ref, place in the text, single."""
    one, two = _Grams(), _Grams(_BASE2, 11)
    for batch in batches:
        for data, ref, first, single in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            x = np.frombuffer(data, "u1")
            a, b = one(x, WINDOW).view("i8"), two(x, WINDOW).view("i8")
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([ref] * n, pa.binary()), pa.array(first + np.arange(n)), pa.array(np.full(n, single))], names=["a", "b", "ref", "place", "single"])


def _cut_anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (bytes, ref, first, single) cut by longer anchors: the same columns, and anchor and segment."""
    grams = _Grams()
    for batch in batches:
        data, refs, firsts, single = (batch.column(i).to_pylist() for i in range(4))
        found = (zip(*(c.tolist() for c in part)) for part in segments(data, grams, WINDOW, LONG_GRAM))
        rows = [(data[i][f : f + n - 1 + WINDOW], refs[i], firsts[i] + f, single[i], a, d) for part in found for i, f, n, a, d in part]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bytes", "ref", "first", "single", "anchor", "segment"])


def _hot_ranges(hot: DataFrame) -> DataFrame:
    """ref, start, stop of repeated windows among segments (bytes, ref, first, single) of anchors that have very many."""
    cut = materialize(map_batches(hot, _cut_anew, "bytes binary, ref binary, first long, single boolean, anchor long, segment long"), "cut")
    kinds = cut.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.every("single").alias("single"))
    kinds = materialize(kinds.withColumn("sure", (F.col("n") > 1) | ~F.col("single")), "kinds")
    equal = cut.where("single").join(kinds.where("sure").select("anchor", "segment"), ["anchor", "segment"])
    equal = equal.select("ref", F.col("first").alias("start"), (F.col("first") + F.octet_length("bytes")).alias("stop"))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.every("sure").alias("done")).where("kinds > 1 and not done").select("anchor")
    # one row stands for each distinct segment; those found above count as partners only
    left = cut.join(several, "anchor").groupBy("anchor", "segment").agg(F.first("bytes").alias("bytes"), F.min("ref").alias("ref"), F.min("first").alias("first"), F.count("*").alias("n"), F.every("single").alias("s"))
    windows = map_batches(left.select("bytes", "ref", "first", (F.col("s") & (F.col("n") == 1)).alias("single")), _windows_of, "a long, b long, ref binary, place long, single boolean")
    windows = materialize(windows, "windows")
    often = windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    matched = windows.where("single").join(often, ["a", "b"]).select("ref", F.col("place").alias("start"), (F.col("place") + WINDOW).alias("stop"))
    return equal.union(matched)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted segments (ref, items: list of first, windows, anchor, segment, single, hot), once for each text."""
    joined = docs.join(wanted, "ref").select("text", "ref", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, ref = batch.column(0).slice(i, 1).cast(pa.large_binary())[0].as_py(), batch.column(1)[i].as_py()
                items = batch.column(2)[i].as_py()
                data = [text[x["first"] : x["first"] + x["windows"] - 1 + WINDOW] for x in items]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(data, pa.binary()), pa.array([ref] * len(items), pa.binary()), *[pa.array([x[c] for x in items], k) for c, k in (("first", pa.int64()), ("single", pa.bool_()), ("anchor", pa.int64()), ("segment", pa.int64()), ("hot", pa.bool_()))]],
                    names=["bytes", "ref", "first", "single", "anchor", "segment", "hot"],
                )

    found = map_batches(joined, run, "bytes binary, ref binary, first long, single boolean, anchor long, segment long, hot boolean")
    # copies of a text give each segment again
    return found.groupBy("anchor", "segment").agg(F.first("bytes").alias("bytes"), F.first("ref").alias("ref"), F.first("first").alias("first"), F.first("single").alias("single"), F.first("hot").alias("hot"))


def covered(docs: DataFrame) -> DataFrame:
    """docs: ref, text. Returns ref, ranges: the byte ranges of repeated windows of each text that occurs once."""
    occurrences = materialize(_occurrences(docs), "segments")
    # a table of its own: a join of two plain tables can be split where an anchor is hot, one with an aggregate in its stage cannot
    often = materialize(occurrences.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    candidates = materialize(occurrences.join(often, "anchor"), "candidates")
    remove(often)
    remove(occurrences)
    distinct = candidates.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("ref", "first", "windows")).alias("at"))
    distinct = materialize(distinct, "distinct")
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    unsure = distinct.join(mixed.select("anchor", (F.col("kinds") > HOT_SEGMENTS).alias("hot")), "anchor")
    unsure = materialize(unsure.select("at.*", "anchor", "segment", (F.col("n") == 1).alias("single"), "hot"), "unsure")
    size = unsure.where("not hot").agg(F.sum(F.col("windows") + WINDOW)).first()[0] or 0
    shards = shards_for(size, SHARD_BYTES)
    items = unsure.groupBy("ref").agg(F.collect_list(F.struct("first", "windows", "anchor", "segment", "single", "hot")).alias("items"))
    fetched = materialize(_fetch(docs, items), "bytes")
    cold = fetched.where("not hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    sorted_ = cold.select("shard", "bytes", "ref", "first", "single").groupBy("shard").applyInArrow(_sort_shard, "ref binary, start long, stop long")
    hot = _hot_ranges(fetched.where("hot").select("bytes", "ref", "first", "single"))
    equal = candidates.join(distinct.where("n > 1").select("anchor", "segment"), ["anchor", "segment"]).select("ref", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + WINDOW).alias("stop"))
    copies = docs.groupBy("ref").count().where("count > 1").select("ref")
    ranges = equal.join(copies, "ref", "left_anti").union(sorted_).union(hot)
    return ranges.groupBy("ref").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")).join(copies.withColumn("all", F.lit(True)), "ref", "full")


def _merge(ranges: list, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["stop"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, as text if they are UTF-8), and columns to carry.

    Each byte goes that a 200-byte string covers which also starts anywhere else, in the same text or another; matches end with their text,
    overlaps count, and strings are judged on the input. Texts of under 200 bytes (null and empty ones included) stay whole. Equal texts
    of 200 bytes or more go whole, repeated rows too; an empty table gives none. Characters that a range cuts are dropped from `kept`,
    not from the digest. A long text is taken a span at a time where windows are hashed and whole where ranges are cut out. Which of equal
    windows comes first decides nothing. Other columns are ignored, whatever their names.
    """
    names = list(dict.fromkeys(["doc_id", "text", *carry]))
    source = pick(docs, *names).withColumn("text", text_of())
    keyed = source.withColumn("ref", F.unhex(F.md5("text")))
    kept = [c for c in names if c != "text"]
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    joined = keyed.join(covered(keyed), "ref", "left").select(*kept, "text", "ranges", "all")
    want_text = "text" in carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(kept)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(at).slice(i, 1).cast(pa.large_binary())[0].as_py()
                n = len(text)
                spans = [(0, n)] if batch.column(at + 2)[i].as_py() and n >= WINDOW else _merge(batch.column(at + 1)[i].as_py() or [], n)
                left, last = [], 0
                for a, b in spans:
                    left.append(text[last:a])
                    last = b
                rest = b"".join([*left, text[last:]])
                rows.append((n, n - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore") if want_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(at)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_batches(joined, run, schema)
