"""Packing documents into sequences of tokens by minimum bin slack."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, pick, shards_for, text_of

#: The pattern by which byte-level tokenizers of this family split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 1
#: Runs of white space that the pattern's engine is not given: it keeps a frame for each place of a run.
LONG_BLANK = 65_536


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes -> id of a byte-level BPE file: its letters stand for bytes, the unprintable ones shifted to 256 and above."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def load_added(path: str) -> dict[str, int]:
    """String -> id of the file's added tokens. Only those taken as they stand are known here: flags that widen or narrow a match raise."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that strip or need word borders are not supported")
    return {x["content"]: x["id"] for x in added}


def encoder(path: str, added: bool = False) -> Callable[[str], bytes]:
    """Text -> its ids as little-endian unsigned 32-bit bytes.

    The ids are those that `tokenizers` gives for the same file with add_special_tokens=False; the merges run in tiktoken, which takes a
    fifth of the time. With added, strings of added tokens in the text are these tokens, as in a Tokenizer's default state; else they are
    ordinary text, as with its encode_special_tokens. A text with a very long run of white space, on which tiktoken's pattern runs out of
    stack, goes through `tokenizers` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens=load_added(path) if added else {})
    blank, slow = re.compile(rf"\s{{{LONG_BLANK}}}"), []

    def run(text: str) -> bytes:
        if len(text) >= LONG_BLANK and blank.search(text):
            if not slow:
                slow.append(Tokenizer.from_file(path))
                slow[0].encode_special_tokens = not added
            ids = slow[0].encode(text, add_special_tokens=False).ids
        else:
            ids = encoding.encode(text, allowed_special="all") if added else encoding.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    return run


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Each document's ids and the end id, cut at multiples of capacity: doc_id, start, length, ids_crc32, doc_tokens, salt.

    salt numbers the rows of a task, so that repeated rows spread over shards.
    """
    source = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    kind = source.schema[0].dataType.simpleString()
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, salt = encoder(path, added=True), 0
        for batch in batches:
            owner, rows = [], []
            for i, value in enumerate(batch.column(1)):
                ids = ids_of(value.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    owner.append(i)
                    rows.append((start, len(piece) // 4, zlib.crc32(piece), total, salt))
                    salt += 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64()))] + [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return map_batches(source, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (with counts up to those given) whose sum comes closest to room from below.

    Bit s of a bitset says that some multiset sums to s. Counts are split into powers of two, so that each step is one shift; the steps
    are walked back from the best sum. Lengths enter from the longest, and the walk stops as soon as room itself is reached.
    """
    if counts.get(room):
        return {room: 1}
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    full = 1 << room
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            grown = (reach | reach << take * length) & mask
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            left -= take
            take *= 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: each bin takes the longest one left and the multiset that fills the rest of it best.

    A filling that can be had several times over is used as often as its counts allow before the next search.
    """
    order = np.argsort(lengths, kind="stable")
    values, starts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    stock = {int(v): order[s : s + c].tolist() for v, s, c in zip(values, starts, counts, strict=True)}
    left = {v: len(x) for v, x in stock.items()}
    bins, offsets, k = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8"), 0
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            chosen = fill(left, capacity - longest) if longest < capacity else {}
            left[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            for _ in range(min(left[x] // n for x, n in chosen.items())):
                offset = 0
                for x, n in chosen.items():
                    for _ in range(n):
                        item = stock[x].pop()
                        bins[item], offsets[item] = k, offset
                        offset += x
                    left[x] -= n
                k += 1
    return bins, offsets


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, per_shard: int = 4096) -> DataFrame:
    """Packs all documents into sequences of capacity tokens; returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is cut only at multiples of capacity. Its pieces are dealt to shards of about per_shard pieces by a hash of piece and row
    number, so no document, source or repeated row makes a shard large; each shard is packed by minimum bin slack and leaves at most one
    sequence badly filled. A null or empty text has the end id alone; an empty table gives no rows. Only lengths are shuffled, never ids.
    Memory is that of one text's ids beside a batch. Pieces of equal length are taken by doc_id, start and row number, so that reruns over
    the same files agree; repeated rows are packed each; other columns are ignored, whatever their names.
    """
    pieces = materialize(cut_pieces(docs, path, capacity), "pieces")
    shards = shards_for(pieces.count(), per_shard)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(shards)))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("salt", "ascending")])
        bins, offsets = minimum_bin_slack(table.column("length").to_numpy(), capacity)
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array(bins + (shard << 24))).append_column("offset", pa.array(offsets))

    return dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
