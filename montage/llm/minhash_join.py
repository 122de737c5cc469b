"""N-gram Jaccard join: MinHash banding finds candidates, full shingle sets verify them, links form classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, pick, remove, text_of
from .components import components

#: Words in a shingle, least similarity, least probability that a pair of just that similarity shares a band, hash functions at most.
NGRAM, SIMILARITY, RECALL, MOST_HASHES, SEED = 5, 0.8, 0.99, 256, 20_231
#: Cells of a set's parity.
CELLS = 1024
#: Nodes and shingles of a class's part on average, where links are counted; columns of a block's matrix.
PART_NODES, PART_GRAMS, WIDTH = 512, 500_000, 4096

#: Bytes that are looked at together; places of a word that have a power of their own.
SPAN, PLACES = 1 << 19, 1 << 12

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band (the fewest false candidates) whose bands reach the recall within `most` hashes."""
    found = (1, 1)
    for rows in range(1, most + 1):
        p = similarity**rows
        bands = 1 if p >= recall else int(np.ceil(np.log1p(-recall) / np.log1p(-p)))
        if bands * rows > most:
            break
        found = (bands, rows)
    return found


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """64-bit hashes of all words of many texts at once, by sums of byte codes times powers of the place in the word.

    Nothing is kept between calls but the powers. Bytes are taken a span at a time, cut between words, so that what is held beside the
    hashes does not grow with a text.
    """

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.codes = rng.integers(0, 2**63, 256, "u8") * np.uint64(2) + np.uint64(1)
        # a place is a low and a high part, each with powers of its own
        self.low = np.cumprod(np.full(PLACES, _PRIME))
        self.high = np.ones(1, "u8")

    def _span(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each word of the bytes; borders: where texts start in them."""
        inside = ~_BLANK[data]
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        fresh[borders] = inside[borders]
        starts, kept = np.flatnonzero(fresh), np.flatnonzero(inside)
        if not len(starts):
            return starts, np.empty(0, "u8")
        first = np.searchsorted(kept, starts)
        length = np.diff(np.append(first, len(kept)))
        place = np.arange(len(kept)) - np.repeat(first, length)
        terms = self.codes[data[kept]] * self.low[place & (PLACES - 1)]
        longest = int(length.max())
        if longest > PLACES:
            n = -(-longest // PLACES)
            if len(self.high) < n:
                self.high = np.cumprod(np.append(np.ones(1, "u8"), np.full(n - 1, np.uint64(0xC2B2AE3D27D4EB4F))))
            terms *= self.high[place // PLACES]
        return starts, _mix(np.add.reduceat(terms, first) + length.astype("u8"))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts (text i is data[offsets[i]:offsets[i + 1]]), and the number of words before each text."""
        at, end, starts, hashes = int(offsets[0]), int(offsets[-1]), [np.empty(0, "i8")], [np.empty(0, "u8")]
        while at < end:
            stop, reach = end, SPAN
            while at + reach < end:
                # the last place in the span between words: after a blank, or where a text starts
                blanks = np.flatnonzero(_BLANK[data[at : at + reach]])
                text = int(offsets[np.searchsorted(offsets, at + reach, "right") - 1])
                stop = max(at + int(blanks[-1]) + 1 if len(blanks) else at, text)
                if stop > at:
                    break
                stop, reach = end, reach * 2  # a word longer than the span
            i, j = np.searchsorted(offsets, [at, stop])
            found, h = self._span(data[at:stop], np.unique(offsets[i:j]) - at)
            starts.append(found + at)
            hashes.append(h)
            at = stop
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def text_buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without nulls, as they lie in its buffers."""
    values = values.cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], "i8")[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", "u1"), offsets


def shingles(values: pa.Array, words: Words, n: int = NGRAM) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct 64-bit hashes of n-word shingles; a shorter text is one shingle, one without words has none."""
    if not len(values):
        return
    h, first = words(*text_buffers(values))
    whole = _shingle(h, n)
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        found = np.sort(whole[i : j - n + 1] if j - i >= n else _shingle(h[i:j], j - i) if j > i else h[:0])
        yield found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def _shingle(h: np.ndarray, n: int) -> np.ndarray:
    count = max(0, len(h) - n + 1)
    out = np.full(count, n, "u8")
    for k in range(n):
        out = out * _PRIME + h[k : k + count]
    return _mix(out)


class Sketch:
    """Band hashes of a shingle set: least values of linear functions of the upper halves of its hashes."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**31, bands * rows, "u4") * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, "u4")
        self.held = np.empty((512, bands * rows), "u4")  # 512 shingles stay in a core's cache

    def __call__(self, s: np.ndarray) -> np.ndarray:
        least, upper = np.full(len(self.a), ~np.uint32(0)), (s >> np.uint64(32)).astype("u4")
        for i in range(0, len(s), len(self.held)):
            part = upper[i : i + len(self.held), None]
            values = np.multiply(part, self.a, out=self.held[: len(part)])
            values += self.b
            np.minimum(least, values.min(axis=0), out=least)
        out = np.arange(self.bands, dtype="u8")
        for column in least.reshape(self.bands, self.rows).T:
            out = _mix(out * _PRIME + column)
        return out.view("i8")


def sketches(docs: DataFrame, bands: int, rows: int, n: int = NGRAM) -> DataFrame:
    """doc_id, key (128-bit digest of the shingle set, null if empty), size (of the set), bands."""
    source = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sketch = Words(), Sketch(bands, rows)
        for batch in batches:
            keys, sizes, out = [], [], []
            for s in shingles(batch.column(1), words, n):
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "key", "size", "bands"])

    return map_batches(source, run, f"doc_id {kind}, key binary, size int, bands array<bigint>")


def parity(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's hashes falls into each of CELLS cells, as 64-bit words.

    A cell in which two sets differ holds at least one hash that only one of them has: differing cells bound the symmetric difference.
    """
    odd = np.bincount((s & np.uint64(CELLS - 1)).astype("i8"), minlength=CELLS) & 1
    return np.packbits(odd.astype("u1")).view("i8")


def may_reach(similarity: float, m: Column, k: Column, a: Column, b: Column) -> Column:
    """False only if sets of sizes m and k with these parities cannot reach the similarity."""
    apart = sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(1, CELLS // 64)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))
    return (m + k - apart) >= F.lit(similarity) * (m + k + apart) - 1e-9


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """key, grams, parity of the wanted keys, from the text of the document that stands for each (wanted: key, doc_id)."""
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").alias("of"), text_of().alias("text"))
    joined = source.join(wanted, F.col("of").eqNullSafe(F.col("doc_id"))).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keys, grams, parities = [], [], []
            for key, found in zip(batch.column(0), shingles(batch.column(1), words, n), strict=True):
                raw = found.tobytes()
                if xxhash.xxh3_128_digest(raw) == key.as_py():  # ids may repeat with other texts
                    keys.append(key.as_py())
                    grams.append(raw)
                    parities.append(parity(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(grams, pa.binary()), pa.array(parities, pa.list_(pa.int64()))], names=["key", "grams", "parity"])

    return map_batches(joined, run, "key binary, grams binary, parity array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                hit.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    return map_batches(both, run, "a binary, b binary").distinct()


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of x has in common with each set of y (sets of distinct hashes)."""
    both = [*x, *y]
    if not x or not y or not any(map(len, both)):
        return np.zeros((len(x), len(y)))
    cells, rows = np.concatenate(both), np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(cells, kind="stable")
    cells, rows = cells[order], rows[order]
    new = np.concatenate([[True], cells[1:] != cells[:-1]])
    column = np.cumsum(new) - 1
    twice = np.bincount(column) > 1  # a hash of one set alone is in no intersection
    rows, column = rows[twice[column]], (np.cumsum(twice) - 1)[column[twice[column]]]
    out = np.zeros((len(x), len(y)))
    for at in range(0, int(twice.sum()), WIDTH):
        i, j = np.searchsorted(column, [at, at + WIDTH])
        held = np.zeros((len(both), WIDTH), "f4")  # exact: sums of at most WIDTH ones
        held[rows[i:j], column[i:j] - at] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out


def _degrees(shared: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """key, n_links: for each node with a link, the nodes that share a band with it and whose shingle sets reach the similarity.

    Links lie within classes. A class is dealt to parts by a hash; each two parts (and each part with itself) are a block, which compares
    all its pairs at once and gives one number a node. Rows of sets that repeat (as their ids do) count once. In a class of two nodes each has one link.
    """
    bands = shared.groupBy("key").agg(F.first("size").alias("size"), F.collect_list("band").alias("bands"))
    members = materialize(bands.join(labels.withColumnRenamed("node", "key"), "key"), "members")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(PART_NODES), F.sum("size") / F.lit(PART_GRAMS))).cast("int").alias("parts")
    held = members.groupBy("label").agg(F.count("*").alias("k"), parts)
    dealt = members.join(held, "label")
    dealt = dealt.select("key", "label", "bands", "k", "parts", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("own"))
    many = dealt.where("k > 2").join(sets.select("key", "grams").dropDuplicates(["key"]), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = many.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "bands", "grams")

    def run(block: pa.Table) -> pa.Table:
        i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
        own = block.column("own").to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        grams = [np.frombuffer(g.as_buffer(), "u8") for g in block.column("grams")]
        bands = [np.array(b, "i8") for b in block.column("bands").to_pylist()]
        size = np.array([len(g) for g in grams])
        common = common_counts([grams[k] for k in left], [grams[k] for k in right])
        linked = common >= similarity * (size[left][:, None] + size[right] - common) - 1e-9
        linked &= common_counts([bands[k] for k in left], [bands[k] for k in right]) > 0
        n = np.zeros(len(own), "i8")
        if i == j:
            np.fill_diagonal(linked, False)
        else:
            n[right] = linked.sum(axis=0)
        n[left] += linked.sum(axis=1)
        return pa.table({"key": block.column("key"), "n": pa.array(n)})

    counted = blocks.groupBy("label", "i", "j").applyInArrow(run, "key binary, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n_links")).union(dealt.where("k = 2").select("key", F.lit(1).cast("long")))


def jaccard_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = NGRAM, count_links: bool = True) -> DataFrame:
    """Per document: doc_id, class_id, n_links, n_copies, n_shingles.

    Documents with equal shingle sets are one node. A node's weight is the number of nodes that it meets in buckets: a text that others
    were copied from meets most. In each band's bucket every node is compared with the heaviest one and with the heaviest of its
    sixteenth of the bucket, by full shingle sets; pairs that reach the similarity are links, and components of links are classes. Only
    where a bucket still holds several classes are its pairs of unlike classes compared too, as far as sizes and parities let them reach
    the similarity. So the classes are exactly those that all pairs sharing a band would give. n_links counts all links of a document's node: the
    nodes that share a band with it and reach the similarity, each pair of a class being compared (without count_links it is null);
    n_copies counts the documents of that node; class_id is the class's least doc_id (null if it has none).
    A text without words (null and empty included) is a class of its own, without links. Repeated rows are copies; of equal weights the
    greater digest is the heaviest, which changes no class; an empty table gives none. Long texts are hashed a span at a time and hold
    eight bytes a word. Other columns are ignored, whatever their names.
    """
    bands, rows = choose_bands(similarity, recall)
    found = materialize(sketches(docs, bands, rows, n), "sketches")
    nodes = found.where("key is not null")
    spread = nodes.select("key", "size", F.explode("bands").alias("band")).distinct()
    often = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # nodes of buckets that hold one node alone end here; all that follows is about the others
    met = materialize(spread.join(often, "band"), "buckets")
    weight = met.groupBy("key").agg(F.sum("n").alias("weight"))
    part = F.conv(F.substring(F.hex("key"), 1, 1), 16, 10).cast("int")
    shared = materialize(met.drop("n").join(weight, "key").withColumn("part", part), "weighed")
    remove(met)
    head = F.max_by(F.struct("key", "size"), F.struct("weight", "key"))
    heads = shared.groupBy("band").agg(head.alias("h"))
    parts = shared.groupBy("band", "part").agg(head.alias("h"))
    found_pairs = shared.join(heads, "band").select("h", "key", "size").union(shared.join(parts, ["band", "part"]).select("h", "key", "size"))
    found_pairs = found_pairs.select(F.col("h.key").alias("a"), F.col("key").alias("b"), F.col("h.size").alias("m"), F.col("size").alias("k"))
    fits = (F.col("a") != F.col("b")) & (F.least("m", "k") >= F.lit(similarity) * F.greatest("m", "k") - 1e-9)
    pairs = materialize(found_pairs.where(fits).select("a", "b").distinct(), "pairs")
    owners = nodes.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    wanted = shared.select("key").distinct().join(owners, "key")
    sets = materialize(_sets(docs, wanted, n), "sets")
    links = materialize(_verified(pairs, sets, similarity), "verified")
    labels = components(links)
    named = shared.select("band", "key", "size").join(labels.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "size", F.coalesce("label", "key").alias("label"))
    open_ = named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band")
    rest = materialize(named.join(open_, "band").join(sets.select("key", "parity"), "key").select("band", "key", "size", "label", "parity"), "open")
    one, two = rest.toDF("band", "a", "m", "la", "pa"), rest.toDF("band", "b", "k", "lb", "pb")
    alike = (F.least("m", "k") >= F.lit(similarity) * F.greatest("m", "k") - 1e-9) & may_reach(similarity, F.col("m"), F.col("k"), F.col("pa"), F.col("pb"))
    across = one.join(two, "band").where((F.col("la") < F.col("lb")) & alike)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialize(_verified(across.join(tried, ["a", "b"], "left_anti"), sets, similarity), "verified")
    if more.limit(1).count():
        links = materialize(links.union(more), "verified")
        labels = components(links)
    empty = F.lit(0 if count_links else None).cast("long")
    degree = materialize(_degrees(shared, labels, sets, similarity), "degrees") if count_links else labels.select(F.col("node").alias("key"), empty.alias("n_links"))
    remove(sets)
    sizes = nodes.groupBy("key").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("least"))
    named = sizes.join(labels.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = materialize(named, "nodes")
    classes = named.groupBy("label").agg(F.min("least").alias("class_id"))
    about = named.join(classes, "label").select("key", "class_id", "n_links", "n_copies")
    return (
        found.select("doc_id", F.col("key").alias("k"), "size")
        .join(about, F.col("k") == F.col("key"), "left")
        .select("doc_id", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", empty).alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.col("size").cast("long").alias("n_shingles"))
    )


def one_of_each_class(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), similarity: float = SIMILARITY) -> DataFrame:
    """The named columns of one row of each class, that with the least doc_id; texts without words all stay.

    Where ids repeat, rows get numbers first, and the class's first row by these stays, so that neither a repeated row nor another text
    under the same id stands for the class twice. Columns are found by exact name, so that others may have clashing ones.
    """
    source = pick(docs, *dict.fromkeys(["doc_id", "text", *columns]))
    ident = "doc_id"
    if source.groupBy("doc_id").count().where("count > 1").limit(1).count():
        ident = "row_number_"
        source = materialize(source.withColumn(ident, F.monotonically_increasing_id()), "numbered")  # numbers hold once they are written
    found = jaccard_classes(source.select(F.col(ident).alias("doc_id"), "text"), similarity, count_links=False)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("keep_id"))
    return source.join(keep, F.col(ident).eqNullSafe(F.col("keep_id")), "left_semi").select(*columns)
