"""The corpus operators against brute force, round trips and odd inputs."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import rows as comparable
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from montage.llm import common, induced_sort, license_index, media_tiff, minhash_join, mixing, packing, quality, substring_dedup, toxicity, url_templates, warc_zip
from montage.llm import queries as registered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names operators use themselves."""
    shared = prose(1, 80)
    texts = [None, "", " \n\t ", "one", "a b c d", shared, shared, shared + " tail end", prose(2, 300) + " " + shared + " " + prose(3, 200), prose(4, 6000), "ü" * 300, "x\0y " * 100, "cc by all rights reserved " * 30, "word " * 120]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", i, "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, shared, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_bytes(t):
    return (t or "").encode()


# -- TIFF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    assert media_tiff.lzw_decode(media_tiff.lzw_encode(data)) == data
    assert media_tiff.unpack_bits(media_tiff.pack_bits(data)) == data


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 32])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 256, s).astype("u1") for s in ((1, 64), (100, 64), (50, 33))]
    got = list(media_tiff.decode_pages(media_tiff.encode(pages, compression, predictor, tile, 16)))
    assert [g["pixels"] for g in got] == [p.tobytes() for p in pages]
    assert [(g["page"], g["width"], g["height"]) for g in got] == [(i, p.shape[1], p.shape[0]) for i, p in enumerate(pages)]


def test_tiff_big_endian_16_bit():
    import struct

    image = (np.arange(12).reshape(3, 4) * 1000).astype(">u2")
    stored = np.diff(image.astype("u2"), axis=1, prepend=0).astype(">u2").tobytes()
    tags = [(256, 4), (257, 3), (258, 16), (259, 1), (273, 8), (277, 1), (278, 3), (279, len(stored)), (317, 2)]
    at = 8 + len(stored)
    data = b"MM\0*" + struct.pack(">I", at) + stored + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags) + b"\0\0\0\0"
    assert next(media_tiff.decode_pages(data))["pixels"] == image.tobytes()


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("fill", [1, 2])
def test_tiff_of_few_bits(bits, fill):
    import struct

    image = np.random.default_rng(bits).integers(0, 1 << bits, (5, 11)).astype("u1")
    rows = [np.packbits(np.unpackbits(r[:, None], axis=1)[:, 8 - bits :].ravel(), bitorder="big" if fill == 1 else "little").tobytes() for r in image]
    stored = media_tiff.pack_bits(b"".join(rows))
    tags = [(256, 11), (257, 5), (259, 32773), (266, fill), (273, 8), (278, 5), (279, len(stored))] + ([(258, bits)] if bits > 1 else [])
    at = 8 + len(stored)
    data = b"II*\0" + struct.pack("<I", at) + stored + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags)) + b"\0\0\0\0"
    page = next(media_tiff.decode_pages(data))
    assert page["pixels"] == image.tobytes() and page["bits"] == bits


def test_payloads_of_all_sizes_meet_all_forms():
    met = Counter()
    for i in range(400):
        payload = random.Random(i).randbytes(64 * (1 + i % 90))
        page = next(media_tiff.decode_pages(media_tiff.store_payload(payload)))
        assert page["pixels"] == payload
        met[page["compression"], page["tiled"], len(payload) > 3000] += 1
    assert len(met) == 12
    long = b"long text " * 200_000
    long += b"\0" * (-len(long) % 64)
    assert b"".join(p["pixels"] for p in media_tiff.decode_pages(media_tiff.store_payload(long))) == long


def test_tiff_media(odd, none):
    got = media_tiff.tiff_media(odd).collect()
    want = Counter()
    for doc_id, text, *_ in odd_documents():
        raw = text_bytes(text)
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want[(doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media_tiff.tiff_media(none).count() == 0


def test_tiff_pages_reports_broken_files(spark):
    good = media_tiff.encode([np.zeros((4, 64), "u1"), np.ones((2, 64), "u1")])
    media = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"nothing")), (3, None)], "id long, media binary")
    got = media_tiff.tiff_pages(media, "id", "media").collect()
    assert sorted((r.id, r.page, r.height) for r in got if r.error is None) == [(1, 0, 4), (1, 1, 2)]
    assert sorted(r.id for r in got if r.error) == [2, 3]


# -- packing


def test_filling_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 9)))
        room = rng.randint(1, 120)
        sums = {0}
        for v, n in counts.items():
            sums = {s + k * v for s in sums for k in range(n + 1)}
        got = packing.fill(counts, room)
        assert all(n <= counts[v] for v, n in got.items())
        assert sum(v * n for v, n in got.items()) == max(s for s in sums if s <= room)


def test_ids_are_those_of_tokenizers(odd):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = packing.encoder(path)
    for text in [*(x[1] or "" for x in odd_documents()), "it's  we'll\n\n y\u3000z <|endoftext|> 漢字 ١٢ 😀\r\n"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_tokenizers(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = [*(x[1] or "" for x in odd_documents()), "hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>  a\n<|endoftext|>\n", "<|endoftext|", "x <|endoftext|>'s  \n <|endoftext|> 漢字"]
    encode = packing.encoder(path, added=True)
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(i, x, "en", "s", 1, None, None) for i, x in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack_documents(docs, path, 10**6).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_long_runs_of_white_space(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = [" " * 1_000_000, "a" + "\n" * 70_000 + "b <|endoftext|>", "x" * 200_000 + " y"]
    docs = spark.createDataFrame([(i, x, "en", "s", 1, None, None) for i, x in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack_documents(docs, path, 10**7).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_packing(odd, none):
    path = packing.tokenizer_path()
    encode = packing.encoder(path)
    got = packing.pack_documents(odd, path, 256, per_shard=20).collect()
    want = Counter()
    for doc_id, text, *_ in odd_documents():
        ids = encode(text or "") + (1).to_bytes(4, "little")
        for start in range(0, len(ids) // 4, 256):
            piece = ids[4 * start : 4 * (start + 256)]
            want[(doc_id, start, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(bins) <= total / 256 + 1 + len(got) / 20 + 1
    assert packing.pack_documents(none, path).count() == 0


# -- WARC


def test_zip_directories():
    import io
    import zipfile

    members = [("a/b.txt", b"x" * 1000), ("empty", b""), ("ü", b"yz")]
    for wide in (False, True):
        blob = warc_zip.pack_zip(members, zip64=wide)
        assert {i.filename: zipfile.ZipFile(io.BytesIO(blob)).read(i) for i in zipfile.ZipFile(io.BytesIO(blob)).infolist()} == dict(members)
        found = warc_zip.zip_members(lambda at, n, b=blob: b[at : at + n], len(blob))
        assert {k: blob[at : at + n] for k, (m, at, n) in found.items()} == dict(members)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/x", b"q" * 50)
    blob = out.getvalue()
    assert warc_zip.zip_members(lambda at, n: blob[at : at + n], len(blob))["archive/x"][2] == 50
    with pytest.raises(ValueError):
        warc_zip.zip_members(lambda at, n: b"", 0)


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    big = "<p>" + prose(9, 50)
    pages = [(1, "http://a/\r\nX: y", big), (2, None, big), (0, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (0, "u", big), (7, "u", "ünï")]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    got = warc_zip.warc_round_trip(table, least).collect()
    heads = {}
    for page, _, html in pages:
        if page is not None:
            heads[html or ""] = min(heads.get(html or "", page), page)
    import base64

    want = Counter()
    for page, _, html in pages:
        raw = text_bytes(html)
        revisit = len(raw) >= least and page != heads[html or ""]
        want[(page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", heads[html or ""] if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc_zip.warc_round_trip(table.limit(0)).count() == 0


# -- suffix sorting


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=40) | st.text("abcdef", max_size=40), st.integers(1, 3), st.booleans())
def test_suffix_order_and_common_prefixes(text, times, external):
    data = (text * times).encode() + b"\0"
    order, common = induced_sort.suffix_sort(np.frombuffer(data, "u1"), 200, *((2, 3) if external else (10**9, 10**9)))
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    for (a, b), c in zip(zip(want, want[1:]), common[1:]):
        k = 0
        while max(a, b) + k < len(data) and data[a + k] == data[b + k]:
            k += 1
        assert c == k


def removed_by_force(texts: list[bytes], window: int) -> list[bytearray]:
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                mask[i : i + window] = b"\1" * window
        out.append(mask)
    return out


@pytest.mark.parametrize("hot", [256, 1])
def test_removal_of_repeats(spark, odd, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    rng = random.Random(4)
    docs, passage = odd_documents(), prose(50, 90)
    for i in range(40):
        cut = rng.randint(0, 200)
        docs.append((100 + i, prose(200 + i, rng.randint(5, 80)) + passage[cut : cut + rng.randint(150, 400)] + prose(300 + i, 10), "en", "s", 1, None, None))
    docs.append((900, (prose(77, 30) + " ") * 7, "en", "s", 1, None, None))
    texts = [text_bytes(d[1]) for d in docs]
    want = Counter()
    for d, t, mask in zip(docs, texts, removed_by_force(texts, 200)):
        kept = bytes(b for b, m in zip(t, mask) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        want[(d[0], len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert substring_dedup.remove_repeats(none).count() == 0


# -- mixing


def test_mix_equals_sql_and_keeps_its_bounds(spark, odd, none, tmp_path):
    rng = random.Random(8)
    docs = [(i, prose(i, rng.randint(0, 60)), "en", "big" if i % 3 else f"s{i % 7}", 1, None, None) for i in range(400)]
    for table in (odd, spark.createDataFrame(docs, SCHEMA)):
        got = mixing.mix_sources(table).collect()
        path = str(tmp_path / f"{len(got)}.parquet")
        table.select("doc_id", "text", "source").coalesce(1).write.parquet(path)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        result = con.execute(mixing.MIX_SQL)
        names = [c[0] for c in result.description]
        assert comparable(got, sorted(names)) == comparable([dict(zip(names, r)) for r in result.fetchall()], sorted(names))
        taken, target = Counter(), {}
        for r in got:
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 3 * r["size"]
        assert sum(target.values()) == pytest.approx(sum(r["size"] for r in got))
        assert all(abs(taken[s] - target[s]) <= 4 * mixing.BLOCK for s in target)
    assert mixing.mix_sources(none).count() == 0


def test_highest_quotients(spark):
    rng = random.Random(1)
    for _ in range(3):
        votes = [rng.choice([0, 1, 5, 5, 40, 300]) for _ in range(6)]
        seats = rng.randint(1, 60)
        got = mixing.sainte_lague(spark.createDataFrame([("g", i, v, seats) for i, v in enumerate(votes)], "g string, i int, v long, t long"), ["g"], "i", "v", "t", "s")
        want = Counter()
        for _ in range(seats):
            i = max(range(6), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert {r.i: r.s for r in got.collect()} == {i: want[i] if sum(votes) else 0 for i in range(6)}


# -- near duplicates


def test_bands_reach_the_recall():
    for s, r in ((0.8, 0.99), (0.5, 0.9), (0.95, 0.999)):
        bands, rows = minhash_join.choose_bands(s, r, 512)
        assert 1 - (1 - s**rows) ** bands >= r and bands * rows <= 512


def classes_by_force(docs):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (d[1] or "").split()) else frozenset() for d in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(d[0], least[find(i)] if sets[i] else d[0]) for i, d in enumerate(docs)]


def test_jaccard_classes(spark, odd, none):
    rng = random.Random(11)
    docs = [d for d in odd_documents() if not d[1] or "\0" not in d[1]]
    for family in range(3):
        base = prose(500 + family, 150).split()
        for k in range(25):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            docs.append((1000 + 100 * family + k, " ".join(words), "en", "s", 1, None, None))
    got = minhash_join.jaccard_classes(spark.createDataFrame(docs, SCHEMA)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(classes_by_force(docs))
    assert all(r.n_links > 0 for r in got if r.doc_id is not None and r.doc_id > 1000 and r.class_id != r.doc_id and r.n_copies == 1)
    assert minhash_join.jaccard_classes(none).count() == 0


@pytest.mark.parametrize("part", [512, 7])
def test_links_are_all_counted(spark, monkeypatch, part):
    monkeypatch.setattr(minhash_join, "PART_NODES", part, raising=False)
    rng, docs = random.Random(31), []
    for family in range(3):
        base = prose(700 + family, 150).split()
        for k in range(2 if family == 2 else 40):
            words = list(base)
            for _ in range(0 if k == 0 else 1 if family == 0 else rng.choice([1, 2, 4, 5])):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            docs += [(100 * family + k, " ".join(words), "en", "s", 1, None, None)] * (2 if k == 5 else 1)
    sketch = minhash_join.Sketch(*minhash_join.choose_bands())
    sets = dict(zip([d[0] for d in docs], minhash_join.shingles(pa.array([d[1] for d in docs]), minhash_join.Words())))
    bands = {i: set(sketch(s).tolist()) for i, s in sets.items()}
    want = {}
    for a, x in sets.items():
        want[a] = sum(1 for b, y in sets.items() if a != b and bands[a] & bands[b] and (c := len(np.intersect1d(x, y))) >= 0.8 * (len(x) + len(y) - c) - 1e-9)
    got = minhash_join.jaccard_classes(spark.createDataFrame(docs, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((d[0], want[d[0]]) for d in docs)
    assert all(want[k] == 39 for k in range(40)) and len({want[100 + k] for k in range(40)}) > 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab \n\u3000é", max_size=40), max_size=6), st.sampled_from([4, 16, 1 << 19]), st.sampled_from([2, 4096]))
def test_shingles_are_distinct_runs_of_words(texts, span, places):
    import re

    held = minhash_join.SPAN, minhash_join.PLACES
    minhash_join.SPAN, minhash_join.PLACES = span, places
    try:
        got = list(minhash_join.shingles(pa.array(texts, pa.string()), minhash_join.Words()))
    finally:
        minhash_join.SPAN, minhash_join.PLACES = held
    names: dict = {}
    for text, found in zip(texts, got, strict=True):
        words = re.findall(common.WORD, text)
        width = min(5, len(words))
        want = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
        assert len(found) == len(want) and found.tolist() == sorted(found.tolist())
        names.setdefault(frozenset(want), set()).add(tuple(found.tolist()))
    assert all(len(x) == 1 for x in names.values()) and len({x for y in names.values() for x in y}) == len(names)


def test_one_of_each_class_with_odd_ids(spark):
    text, other = prose(900, 120), prose(901, 120)
    rows = [(1, text, "x"), (1, text, "x"), (1, other, "x"), (2, text + " end", "x"), (None, text, "x"), (3, None, "x"), (3, "", "x"), (None, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, Doc_Id string")
    got = minhash_join.one_of_each_class(table).collect()
    assert sorted(len(r.text.split()) for r in got if r.text) == [120, 120] and sum(not r.text for r in got) == 3
    single = spark.createDataFrame([rows[0], rows[3], rows[5], (9, other, "x")], "doc_id long, text string, DOC_ID string")
    assert sorted(r.doc_id for r in minhash_join.one_of_each_class(single).collect()) == [1, 3, 9]


def test_parity_never_rules_out_a_match():
    rng = np.random.default_rng(2)
    for n in (5, 200, 5000):
        a = np.unique(rng.integers(0, 2**63, n, "u8"))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**63, n // 5, "u8")]))
        apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in minhash_join.parity(a) ^ minhash_join.parity(b))
        assert apart <= len(np.setxor1d(a, b))


# -- urls and licenses


def test_urls_and_rules(spark):
    urls = ["https://A.Com", "http://b.com/x?y", "HTTP://www.Example.com/en/1#t", "x://example.com/en/", "q://m.example.com/en", None, "no scheme", "http://x.net/es/1", "http://x.net/es", "http://netx/es/1", "http://net/fr/?a", "://h/p", "http://h.com:80/", "http://a.org/b/c/d/e/f"]
    got = {r.page_id: r for r in url_templates.judge_urls(spark.createDataFrame([(i, u, "z") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for v, h, p in url_templates.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0])
        assert got[i].verdict == (rule[1] or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_templates.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_template_tree_generalises_and_judges(spark):
    urls = [f"http://s.net/es/{i}" for i in range(60)] + [f"http://s.net/u{chr(97 + i % 26)}{chr(97 + i // 26)}/{i}" for i in range(500)] + [f"http://s.net/{l}/{i}" for l in ("fr", "it") for i in range(60)]
    got = url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert any("*" in r.template for r in got) and any("{2}" in r.template or "{1}" in r.template for r in got)
    assert all(r.verdict == "block" for r in got if r.path.startswith("/fr/"))


def test_deep_paths_differ_and_equal_their_sql(spark, tmp_path):
    rng = random.Random(3)
    urls = [f"http://{rng.choice(['s.net', 'a.org', 'www.example.com'])}" + "".join("/" + rng.choice(["es", "fr", "it", "x", f"u{rng.randrange(200)}", ""]) for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    urls += [f"http://s.net/it/a/b/c/d/{x}" for x in ("one", "two")] * 40 + [None, "x", "http://long.org/" + "a/" * 2000 + "z" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_templates.judge_urls(pages).collect()
    by_url = {urls[r.page_id]: r for r in got}
    assert by_url["http://s.net/it/a/b/c/d/one"].template != by_url["http://s.net/it/a/b/c/d/two"].template
    path = str(tmp_path / "pages")
    pages.where("page_id < 1582").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    result = con.execute(url_templates.judge_sql())
    names = sorted(c[0] for c in result.description)
    want = [dict(zip([c[0] for c in result.description], r)) for r in result.fetchall()]
    assert comparable(url_templates.judge_urls(pages.where("page_id < 1582")).collect(), names) == comparable(want, names)


def test_marks_cover_phrases():
    for p, _ in license_index.PHRASES:
        assert any(m in f" {p} " for m in license_index.MARKS)
    for text, keys in license_index.TEMPLATES.values():
        assert all(f" {k} " in f" {text} " or len(keys) > 1 for k in keys)
        assert any(m in f" {k} " for k in keys for m in license_index.MARKS)


def test_licenses(spark, odd, none):
    import re

    mit = license_index.TEMPLATES["mit"][0]
    more = [(50, "Intro words. " + mit.capitalize().replace(" ", "\n", 3) + " end", None, None, 0, None, None), (51, "CC BY cc by, CC-BY x General Public License", None, None, 0, None, None), (52, "permission is hereby granted free of charge", None, None, 0, None, None), (53, "all all rights reserved ALL RIGHTS\tRESERVED", None, None, 0, None, None)]
    got = license_index.scan_licenses(spark.createDataFrame(odd_documents() + more, SCHEMA)).collect()
    want = Counter()
    for d in odd_documents() + more:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1] or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        hits = [(i, label) for p, label in license_index.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        want[(d[0], len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[50].labels == "mit" and by_id[50].score == 1.0
    assert by_id[51].labels == "cc-by,gpl" and all(0 <= r.score <= 1 for r in got)
    assert license_index.scan_licenses(none).count() == 0


def test_licenses_do_not_depend_on_what_else_a_file_holds(spark):
    passages = {t: x for t, (x, _) in license_index.TEMPLATES.items()}
    words = sorted({w for x in passages.values() for w in x.split()})
    random.Random(5).shuffle(words)
    mixed = " ".join(words)
    mit, half = passages["mit"], " ".join(passages["mit"].split()[:14])
    docs = [(1, "\n\n".join(passages.values())), (2, "\n".join(x for t, x in passages.items() if t != "gpl-notice")), (3, f"{prose(1, 3000)} {mixed} {mit} {mixed} {prose(2, 3000)}"), (4, f"{mixed} {half} {prose(3, 50)} {mixed}")]
    # words that stand in few files alone, so that those of other templates are the rarest
    docs += [(10 + i, mit) for i in range(5)]
    got = {r.doc_id: r for r in license_index.scan_licenses(spark.createDataFrame([(i, t, None, None, 0, None, None) for i, t in docs], SCHEMA)).collect()}
    assert got[1].labels == ",".join(sorted([*passages, "gpl"]))
    assert got[2].labels == ",".join(sorted(set(passages) - {"gpl-notice"})) and got[2].score == 1.0
    assert got[3].labels == "mit" and got[3].score == 1.0
    assert got[4].labels == "mit" and got[4].score >= 14 / len(mit.split())


def test_scan_with_other_templates(spark):
    templates = {"own": ("grant of use for the tool by its maker without any fee", ("grant of use",)), "none": ("x y z", ("x y",))}
    texts = ["here: Grant of use for the tool, by its maker without any fee.", "grant of use for a tool by its maker", "x y", None, "the tool by its maker without any fee"]
    got = {r.doc_id: r for r in license_index.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()}
    assert (got[0].labels, got[0].score) == ("own", 1.0) and got[1].labels == "own" and got[1].score == pytest.approx(8 / 12)
    assert (got[2].labels, got[3].labels, got[4].labels) == ("none", "", "")


# -- quality


def counts_by_force(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text("ab \n#|é", max_size=60))
def test_text_counts(text):
    assert quality.text_counts(text) == counts_by_force(text)


def test_quality_keeps_clean_and_drops_junk(spark, odd, none):
    clean = [(i, prose(i, 60 + i % 90), "en", "a" if i % 3 else "b", 1, None, None) for i in range(600)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i, 80).split()), "en", "a", 1, None, None) for i in range(15)] + [(2000 + i, prose(i, 80).upper().replace(" ", "!! "), "en", "b", 1, None, None) for i in range(15)]
    got = quality.quality_rules(spark.createDataFrame(clean + junk, SCHEMA)).collect()
    assert sum(not r.kept for r in got if r.doc_id < 1000) == 0
    assert sum(r.kept for r in got if r.doc_id >= 1000) == 0
    got = quality.quality_rules(odd).collect()
    want = Counter((d[0], *counts_by_force(d[1])) for d in odd_documents())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.quality_rules(none).count() == 0


def distances_by_force(cases: list[tuple]) -> list[float]:
    """Squared distances of (lang, source, vector) rows from their pair's estimate, row by row and start by start."""
    p, spread = len(quality.STATS), np.array(quality.SPREAD)
    factor = quality.KEEP / quality.chi2_cdf(quality.chi2_quantile(quality.KEEP, p), p + 2)
    x = np.array([c[2] for c in cases])

    def middle(v):
        bins = np.sort(np.floor(v / quality.BIN), axis=0)
        return (bins[int(np.ceil(0.5 * len(v))) - 1] + 0.5) * quality.BIN

    def apart(v, mean, cov):
        return np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov), v - mean)

    def estimate(v):
        m = middle(v)
        scale = np.sqrt((middle(np.abs(v - m)) * 1.4826) ** 2 + spread**2)
        z = (v - m) / scale
        r2 = (z**2).sum(axis=1)
        u = z[r2 > 0] / np.sqrt(r2[r2 > 0])[:, None]
        starts = [(m, np.diag(scale**2)), (v.mean(axis=0), np.cov(v.T, bias=True) + np.diag(spread**2)), (m, u.T @ u / len(v) * p * np.outer(scale, scale) + np.diag(spread**2))]
        ends = []
        for mean, cov in starts:
            while True:
                bins = np.floor(np.log(np.maximum(apart(v, mean, cov), 1e-9)) / quality.LOG_BIN)
                near = v[bins <= np.sort(bins)[int(np.ceil(quality.KEEP * len(v))) - 1]]
                new = near.mean(axis=0), np.cov(near.T, bias=True) * factor + np.diag(spread**2)
                if not np.linalg.slogdet(cov)[1] - np.linalg.slogdet(new[1])[1] > quality.FALL:
                    break
                mean, cov = new
            ends.append((np.linalg.slogdet(cov)[1], len(ends), mean, cov))
        return len(v), *min(ends, key=lambda e: e[:2])[2:]

    def drawn(n, mean, cov, wide):
        w = n / (n + quality.PRIOR_ROWS)
        return w * mean + (1 - w) * wide[0], w * cov + (1 - w) * wide[1] + w * (1 - w) * np.outer(mean - wide[0], mean - wide[0])

    whole, out = estimate(x)[1:], [0.0] * len(cases)
    for lang in {c[0] for c in cases}:
        of_lang = drawn(*estimate(x[[c[0] == lang for c in cases]]), whole)
        for source in {c[1] for c in cases if c[0] == lang}:
            rows = [i for i, c in enumerate(cases) if c[:2] == (lang, source)]
            for i, d in zip(rows, apart(x[rows], *drawn(*estimate(x[rows]), of_lang)), strict=True):
                out[i] = d
    return out


def test_outliers_equal_brute_force(spark):
    rng = random.Random(17)
    docs = []
    for i in range(420):
        text = prose(i, rng.randint(50, 120))
        if i % 11 == 0:
            text = text.replace(" ", rng.choice(["# ", "!! ", "\nthe the\n"]), rng.randint(1, 60))
        docs.append((i, text.upper() if i % 97 == 0 else text, "en" if i % 3 else None, ["a", "b", None][min(2, i % 7)], 1, None, None))
    docs += [(1000, "too short", "en", "a", 1, None, None), docs[0], docs[22]]
    got = quality.quality_rules(spark.createDataFrame(docs, SCHEMA)).collect()
    cases = []
    for _, text, lang, source, *_ in docs:
        n, chars, symbols, duplicates, repeated = counts_by_force(text)
        loud = sum("A" <= c <= "Z" or c == "!" for c in text)
        cases.append((lang, source, (np.log(chars / n), *np.sqrt([symbols / chars, loud / chars, duplicates / (text.count("\n") + 1), repeated / n]))))
    good = [i for i, d in enumerate(docs) if len(d[1].split()) >= 50 and 100 * counts_by_force(d[1])[4] <= 50 * counts_by_force(d[1])[0]]
    want = dict(zip([docs[i][0] for i in good], distances_by_force([cases[i] for i in good])))
    cutoff = quality.chi2_quantile(1 - quality.TAIL, len(quality.STATS))
    for r in got:
        assert r.base_failed == (r.doc_id not in want)
        assert r.kept == (not r.base_failed and want[r.doc_id] <= cutoff)
        if not r.base_failed:
            assert r.distance == pytest.approx(want[r.doc_id], rel=1e-6)
    assert 0 < sum(not r.kept and not r.base_failed for r in got) < 60


def test_chi_square():
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality.chi2_cdf(quality.chi2_quantile(0.3, 7), 7) == pytest.approx(0.3)


# -- toxicity


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(6)
    scores, moves = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    lengths = np.array([5, 3, 1])
    p, expected, total = toxicity.marginals(scores, lengths, moves)
    pairs = np.zeros((2, 2))
    for k, n in enumerate(lengths):
        weights, ones = 0.0, np.zeros(5)
        local = np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(scores[k, i] * s for i, s in enumerate(states)) + sum(moves[a, b] for a, b in zip(states, states[1:])))
            weights += w
            for i, s in enumerate(states):
                ones[i] += w * s
            for a, b in zip(states, states[1:]):
                local[a, b] += w
        assert np.log(weights) == pytest.approx(total[k])
        assert p[k] == pytest.approx(ones / weights)
        pairs += local / weights
    assert expected == pytest.approx(pairs)


def test_toxicity_learns_held_out_rows(spark, odd, none):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = prose(i, 60).split()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilest", "rotten", "nasty"]))
        docs.append((i, " ".join(words), "en", "s", 1, None, None))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(docs, SCHEMA)
    marked = spark.createDataFrame([*labels, (None, None, None), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marked)
    got = {r.doc_id: r for r in toxicity.tag_toxic(table, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) >= 0.98
    spans = [docs[i][1][s.start : s.end] for i in held for s in got[i].spans if labels[i][2]]
    assert set(" ".join(spans).split()) >= {"vilest", "rotten", "nasty"}
    flat = toxicity.tag_toxic(odd, model).collect()
    assert len(flat) == len(odd_documents()) and all(0 <= r.score <= 1 for r in flat)
    assert toxicity.tag_toxic(none, toxicity.train(none, marked.limit(0))).count() == 0


def test_scores_and_spans_equal_enumeration(spark):
    import itertools

    rng = np.random.default_rng(8)
    known = ["vile", "rotten", "you", "are"]
    model = toxicity.Field({w: i for i, w in enumerate(known)}, np.hstack([rng.normal(0, 2, (3, 4)), np.zeros((3, 1))]), -0.4, rng.normal(0, 0.7, (2, 2)), np.array([-0.3, 0.8, 1.1, 0.5]))
    texts = ["İİİ vile", "You are VILE, rotten! 42 plain words", "nothing here", "", None, "vile " * 3 + "İ_are", "are" * 50 + " you"]
    docs = [(i, t, "en", "s", 1, None, None) for i, t in enumerate([*texts, texts[1]])]
    got = {r.doc_id: r for r in toxicity.tag_toxic(spark.createDataFrame(docs, SCHEMA), model).collect()}
    for i, text, *_ in docs:
        places = [m.span() for m in toxicity._TOKEN.finditer(text or "")]
        words = [(text or "")[a:b].lower() for a, b in places]
        score = lambda k: model.bias + sum(model.weights[f, model.words[words[j]]] for f, j in ((0, k), (1, k - 1), (2, k + 1)) if 0 <= j < len(words) and words[j] in model.words)
        total, ones = 0.0, np.zeros(len(words))
        for states in itertools.product((0, 1), repeat=len(words)):
            weight = np.exp(sum(score(k) for k, s in enumerate(states) if s) + sum(model.moves[a, b] for a, b in zip(states, states[1:])))
            total += weight
            ones += weight * np.array(states)
        p = ones / total
        x = np.array([1.0, np.log1p(p.sum()), p.max(initial=0), p.sum() / max(1, len(p))])
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-x @ model.logit))) and got[i].predicted == int(got[i].score >= 0.5)
        inside = {c for (a, b), q in zip(places, p) if q >= 0.5 for c in range(a, b)}
        words_at = {c for a, b in places for c in range(a, b)}
        assert {c for s in got[i].spans for c in range(s.start, s.end)} & words_at == inside
        assert all(p[k] >= 0.5 for s in got[i].spans for k, (a, b) in enumerate(places) if s.start <= a < s.end)
    assert len(got) == len(docs) and got[1].score == got[7].score


def test_toxic_labels_of_other_id_types(spark):
    docs = spark.createDataFrame([(f"d{i}", prose(i, 40) + (" vilest rotten" if i % 4 == 0 else "")) for i in range(200)], "doc_id string, text string")
    marked = spark.createDataFrame([(f"d{i}", int(i % 4 == 0)) for i in range(200)], "doc_id string, toxic int")
    got = toxicity.tag_toxic(docs, toxicity.train(docs, marked)).collect()
    assert np.mean([r.predicted == (int(r.doc_id[1:]) % 4 == 0) for r in got if r.held_out]) >= 0.98


def test_one_long_text_does_not_end_the_toxic_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_BYTES", 100_000)
    docs = [(i, prose(i, 40) + (" vilest vilest rotten" if i % 4 == 0 else ""), "en", "s", 1, None, None) for i in range(200)]
    table, labels = spark.createDataFrame(docs, SCHEMA), [(i, 1, int(i % 4 == 0)) for i in range(200)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    order = [r.doc_id for r in table.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id")).collect()]
    long = table.withColumn("text", F.when(F.col("doc_id") == order[0], F.lit("word " * 30_000)).otherwise(F.col("text")))
    assert "vilest" in toxicity.train(long, marked).words
    alone = toxicity.train(long, marked.where(F.col("doc_id") == order[0]))
    assert not any(r.predicted for r in toxicity.tag_toxic(long, alone).collect())


# -- pipeline and registration


def test_pipeline_stages(spark, odd, none):
    rng = random.Random(21)
    passage = prose(5000, 90)
    docs = [(i, prose(i, rng.randint(60, 200)) + (" " + passage if i % 9 == 0 else ""), "en", f"s{i % 4}", 9, None, None) for i in range(250)]
    docs += [(300 + i, docs[i][1], "en", "s1", 9, None, None) for i in range(10)] + [(400, "too short", "en", "s1", 9, None, None)]
    table = spark.createDataFrame([d[:5] for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = common.materialize(stages["quality"](spark, table, ""), "t")
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs if d[0] != 400}
    single = common.materialize(stages["near_duplicates"](spark, kept, ""), "t")
    assert sorted(r.doc_id for r in single.collect()) == list(range(250))
    cut = common.materialize(stages["substrings"](spark, single, ""), "t")
    texts = {d[0]: d[1] for d in docs}
    masks = removed_by_force([texts[i].encode() for i in range(250)], 200)
    assert {r.doc_id: r.text for r in cut.collect()} == {i: t for i in range(250) if (t := bytes(b for b, m in zip(texts[i].encode(), masks[i]) if not m).decode())}
    mixed = common.materialize(stages["mixing"](spark, cut, ""), "t")
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(cut).collect()}
    assert words == Counter({k: v for k, v in taken.items() if v})
    packed = stages["packing"](spark, mixed, "").collect()
    assert sum(r.length for r in packed if r.start == 0) > 0 and {r.doc_id for r in packed} == {k for k, v in taken.items() if v}
    for name, stage in corpus_pipeline.STAGES:
        for odd_table in (odd, none):
            out = stage(spark, odd_table, "")
            out.count()
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in registered.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(registered.ORACLE_SQL) <= set(registered.QUERIES)


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_corpus_query_equals_its_sql(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    result = con.execute(registered.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    got = registered.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert comparable(got.collect(), sorted(columns)) == comparable([dict(zip(columns, r)) for r in result.fetchall()], sorted(columns))
    assert json.dumps(columns)
