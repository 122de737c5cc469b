"""Toxicity: a linear-chain conditional random field over words, and document scores from its marginals.

A word's state is scored by the word itself and the words before and after it, and by the move from the state before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pick, text_of

#: Bounds of the sample that the model is fitted on: labelled rows, bytes of their texts.
MAX_ROWS, MAX_BYTES = 3000, 24_000_000
#: Words in a chain (a longer text is cut); of the sample's chains without a marked word one in so many is fitted, counted as often; chains
#: that go through forward-backward at once.
CHAIN, PLAIN, AT_ONCE = 64, 8, 4096
_TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Field:
    """The field's weights (state 1 against state 0): of a word, of the word before and the word after, of all words; of moves between
    states; and the document's logit. words gives a word's column; the last column is that of all other words, and is 0."""

    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, 1)))
    bias: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logit: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0, 0.0]))


#: Penalty on squares of the weights of a word, of the word before, of the word after; weights too small to matter are left out.
PENALTY, FLOOR = np.array([0.1, 10.0, 10.0]), 0.05


def around(ids: np.ndarray) -> np.ndarray:
    """The columns of each word, the one before and the one after; -1 beyond the text's ends."""
    out = np.full((3, len(ids)), -1)
    out[0], out[1, 1:], out[2, :-1] = ids, ids[:-1], ids[1:]
    return out


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = True, counted: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over rows of scores (state 1 against 0): P(state 1), expected moves, log of the partition function.

    Positions at or beyond a row's length have probability 0. Moves of a row count as often as `counted` says.
    """
    n, t = scores.shape
    inside = np.arange(t) < lengths[:, None]
    unary = np.stack([np.zeros_like(scores), scores], 2)
    forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    forward[:, 0] = unary[:, 0]
    log_add = np.logaddexp
    for i in range(1, t):
        before = forward[:, i - 1]
        step = log_add(before[:, :1] + moves[0], before[:, 1:] + moves[1]) + unary[:, i]
        forward[:, i] = np.where(inside[:, i : i + 1], step, before)
    for i in range(t - 2, -1, -1):
        after = backward[:, i + 1] + unary[:, i + 1]
        step = np.stack([log_add(moves[0, 0] + after[:, 0], moves[0, 1] + after[:, 1]), log_add(moves[1, 0] + after[:, 0], moves[1, 1] + after[:, 1])], 1)
        backward[:, i] = np.where(inside[:, i + 1 : i + 2], step, backward[:, i + 1])
    total = log_add(forward[:, -1, 0], forward[:, -1, 1])
    p = np.exp(np.clip(forward[:, :, 1] + backward[:, :, 1] - total[:, None], -700, 0)) * inside
    if not pairs:
        return p, np.zeros((2, 2)), total
    pair = forward[:, :-1, :, None] + moves + (unary + backward)[:, 1:, None, :] - total[:, None, None, None]
    weight = inside[:, 1:, None, None] * np.reshape(counted, (-1, 1, 1, 1))
    expected = (np.exp(np.clip(pair, -700, 0)) * weight).sum((0, 1)) if t > 1 else np.zeros((2, 2))
    return p, expected, total


def _words(text: str) -> list[str]:
    """The words of the text as it stands, each lower-cased: their places are those in the text."""
    return [w.lower() for w in _TOKEN.findall(text)]


def chains(words: list[str]) -> list[tuple[int, int]]:
    return [(i, min(i + CHAIN, len(words))) for i in range(0, len(words), CHAIN)]


def _summary(p: np.ndarray, n: int) -> np.ndarray:
    """What the document's logit is made of: the expected toxic words, the surest one, their share."""
    return np.array([1.0, np.log1p(p.sum()), p.max(initial=0.0), p.sum() / max(n, 1)])


def word_marginals(model: Field, documents: list[list[str]], quiet: dict[int, np.ndarray]) -> list[np.ndarray]:
    """P(toxic) of each word of each document.

    Chains in which nothing has a weight differ in length alone and are worked out once for each length; the others of all documents go
    through forward-backward together, so many at once.
    """
    get, out, busy = model.words.get, [], []
    for k, words in enumerate(documents):
        ids = np.fromiter((get(w, -1) for w in words), "i8", len(words))
        p = np.zeros(len(words))
        scores = np.zeros(len(words))
        if (ids >= 0).any():
            for weights, column in zip(model.weights, around(ids), strict=True):
                scores += weights[column]
        heavy = set((np.flatnonzero(scores) // CHAIN).tolist())
        for i, j in chains(words):
            if i // CHAIN in heavy:
                busy.append((k, i, j, scores[i:j] + model.bias))
            else:
                if j - i not in quiet:
                    quiet[j - i] = marginals(np.full((1, j - i), model.bias), np.array([j - i]), model.moves)[0][0]
                p[i:j] = quiet[j - i]
        out.append(p)
    busy.sort(key=lambda b: b[2] - b[1])
    for start in range(0, len(busy), AT_ONCE):
        part = busy[start : start + AT_ONCE]
        lengths = np.array([j - i for _, i, j, _ in part])
        scores = np.zeros((len(part), lengths.max()))
        for row, (_, _, _, w) in zip(scores, part, strict=True):
            row[: len(w)] = w
        for row, (k, i, j, _) in zip(marginals(scores, lengths, model.moves, pairs=False)[0], part, strict=True):
            out[k][i:j] = row[: j - i]
    return out


def _tells(c: int, o: int, n1: int, n0: int, words: int) -> bool:
    """Whether a word in c of n1 toxic and o of n0 other documents is toxic: log-odds above 2, and a chance (by Chernoff's bound) under 1 / words."""
    odds = np.log((c + 0.5) / (n1 - c + 0.5)) - np.log((o + 0.5) / (n0 - o + 0.5))
    k, q, base = c + o, c / (c + o), n1 / (n1 + n0)
    if odds <= 2 or q <= base:
        return False
    return k * (q * np.log(q / base) + ((1 - q) * np.log((1 - q) / (1 - base)) if q < 1 else 0.0)) > np.log(words)


def fit(texts: list[str], labels: list[int], steps: int = 40) -> Field:
    """Fits the field to documents marked toxic or not.

    The labels mark documents, so words are labelled first: a word of a toxic document is toxic if it stands much more often in toxic
    documents (in copies of one text only once) than in others, and so clearly that less than one of all words would by chance. The field
    is fitted to these labels by gradient ascent on its likelihood with a penalty on squares, over all chains that hold a marked word and
    each PLAIN-th of the others, counted PLAIN times; then the document's logit to the document labels.
    """
    model = Field()
    tokens = [_words(t) for t in texts]
    y = np.array(labels, float)
    toxic, other = Counter(), Counter()
    for words, label in zip(tokens, labels, strict=True):
        (toxic if label else other).update(set(words))
    # copies of a text are no evidence of their own: a word counts as often as it stands between different neighbours, at most
    places = {(a, w, b) for words, label in zip(tokens, labels, strict=True) if label for a, w, b in zip(["", *words], words, [*words[1:], ""])}
    differing = Counter(w for _, w, _ in places)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    marked = {w for w, c in toxic.items() if _tells(min(c, differing[w]), other[w], n1, n0, len(toxic))}
    often = Counter(toxic) + Counter(other)
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, c in often.items() if c >= 2))}
    columns, truth, counted, plain = [], [], [], 0
    for words, label in zip(tokens, labels, strict=True):
        ids = around(np.fromiter((vocabulary.get(w, -1) for w in words), "i8", len(words)))
        for i, j in chains(words):
            is_marked = any(w in marked for w in words[i:j])
            plain += not is_marked
            if is_marked or plain % PLAIN == 1:
                columns.append(ids[:, i:j])
                truth.append([bool(label) and w in marked for w in words[i:j]])
                counted.append(1.0 if is_marked else float(PLAIN))
    if not columns or not marked:
        model.logit = np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0, 0, 0])
        return model
    lengths, counted = np.array([len(t) for t in truth]), np.array(counted)
    ids, gold = np.full((3, len(truth), CHAIN), -1, "i4"), np.zeros((len(truth), CHAIN))
    for k, (c, t) in enumerate(zip(columns, truth, strict=True)):
        ids[:, k, : c.shape[1]], gold[k, : len(t)] = c, t
    inside = np.arange(CHAIN) < lengths[:, None]
    state = gold.astype(int)
    seen = np.zeros((2, 2))
    both = inside[:, 1:]
    np.add.at(seen, (state[:, :-1][both], state[:, 1:][both]), np.broadcast_to(counted[:, None], both.shape)[both])
    # the last column, of words without a weight, stays 0
    w, bias, moves = np.zeros((3, len(vocabulary) + 1)), -4.0, np.zeros((2, 2))
    rate = np.zeros(w.size + 5)
    for _ in range(steps):
        grad_w, grad_bias, expected = -PENALTY[:, None] * w, 0.0, np.zeros((2, 2))
        for at in range(0, len(truth), AT_ONCE):
            rows = slice(at, at + AT_ONCE)
            p, pairs, _ = marginals(w[0][ids[0, rows]] + w[1][ids[1, rows]] + w[2][ids[2, rows]] + bias, lengths[rows], moves, counted=counted[rows])
            error = (gold[rows] - p) * inside[rows] * counted[rows, None]
            for g, column in zip(grad_w, ids[:, rows], strict=True):
                g += np.bincount(column.ravel() % len(g), error.ravel(), len(g))
            grad_bias += error.sum()
            expected += pairs
        grad_w[:, -1] = 0
        grad = np.concatenate([grad_w.ravel(), [grad_bias], (seen - expected).ravel()])
        rate += grad**2
        step = grad / np.sqrt(rate + 1e-6)
        w += step[: w.size].reshape(w.shape)
        bias += 0.5 * step[w.size]
        moves = moves + 0.1 * step[-4:].reshape(2, 2)
    w[np.abs(w) < FLOOR] = 0
    told = sorted(x for x, k in vocabulary.items() if w[:, k].any())
    model.words = {x: k for k, x in enumerate(told)}
    model.weights = np.hstack([w[:, [vocabulary[x] for x in told]], np.zeros((3, 1))])
    model.bias, model.moves = float(bias), moves
    quiet: dict[int, np.ndarray] = {}
    x = np.array([_summary(p, len(p)) for p in word_marginals(model, tokens, quiet)])
    a = np.zeros(4)
    for _ in range(60):  # Newton's steps with a light penalty
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1, 1e-3])
        a += np.linalg.solve(hessian, x.T @ (y - p) - np.array([1e-3, 0.1, 0.1, 1e-3]) * a)
    model.logit = a
    return model


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits on labelled rows outside the held-out fold: the first MAX_ROWS by a hash of doc_id, without those whose text would pass
    MAX_BYTES in all.

    Null labels and null ids are left out. Without labelled rows the model scores every text 0.5 or less.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    chosen = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    rows = chosen.collect()  # at most MAX_ROWS pairs of numbers
    if not rows:
        return Field()
    sample = docs.sparkSession.createDataFrame(rows, chosen.schema)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", text_of().alias("text"), F.xxhash64("doc_id").alias("h"))
    # a limit on rows, since an id may repeat; sizes are checked before texts come to the driver
    sizes = texts.groupBy("h", "doc_id").agg(F.sum(F.octet_length("text")).alias("size")).collect()
    total, within = 0, []
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if total + r["size"] <= MAX_BYTES:  # a text that does not fit is left out alone
            total += r["size"]
            within.append(r.doc_id)
    if not within:
        return Field()
    got = sorted(texts.where(F.col("doc_id").isin(within)).select("h", "doc_id", "toxic", "text").collect())
    return fit([r.text for r in got], [r.toxic for r in got])


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words likelier toxic than not, by their places in the text."""
    found: list[dict] = []
    if len(p) and p.max() >= 0.5:
        last = -2
        for k, m in enumerate(_TOKEN.finditer(text)):
            if p[k] >= 0.5:
                if last == k - 1:
                    found[-1]["end"] = m.end()
                else:
                    found.append({"start": m.start(), "end": m.end()})
                last = k
    return found


def tag_toxic(docs: DataFrame, model: Field) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and spans (start and end in characters) of words that are likelier toxic than not.

    Labels, language, source and id are not inputs of a score. A null text is the empty one, whose score is the logit's constant; a null
    id is held out; repeated rows and equal texts get equal scores; an empty table gives none. Whole texts are scored, a long one in
    chains; the words of up to 256 texts of a batch are held at once. Other columns are ignored, whatever their names.
    """
    source = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.bias, model.moves, model.logit))  # words of at most MAX_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, quiet = Field(*shared.value), {}
        for batch in batches:
            scores, spans = [], []
            for begin in range(0, batch.num_rows, 256):  # the words of so many texts at once
                texts = [value.as_py() for value in batch.column(1).slice(begin, 256)]
                for text, p in zip(texts, word_marginals(model, [_words(t) for t in texts], quiet), strict=True):
                    scores.append(float(1 / (1 + np.exp(-np.clip(_summary(p, len(p)) @ model.logit, -30, 30)))))
                    spans.append(_spans(text, p))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    kind = source.schema[0].dataType.simpleString()
    scored = map_batches(source, run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
