"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Texts become counts of hashed byte trigrams and four-grams and of one term for the share of words that repeat
the word before, weighted by inverse document frequency and by how unlike the two labels' mean counts are, and are projected to a few latent dimensions (singular value
decomposition of labelled texts). The labelled vectors are broadcast; every document's cosines with all of
them are computed exactly, in blocks, and the nearest ones vote with a power of their similarity as weight; all that are as
near as the last of them (up to rounding) vote too, so a score doesn't depend on the order of the rows.
The share of label 1 among all training labels votes too, so that texts unlike anything labelled get it.

The model is fitted on a bounded sample: of each label, the ``per_label`` training rows with the smallest
hash of the id (rows that share an id: of the text). Its size, and so the broadcast, depends on the parameters alone. Whole texts are scored.

Null and empty texts have a zero vector and get the share of label 1 among all training labels. Null labels and labels other than 0 and
1 are not used. A label whose document has no row is left out; repeated documents or labels count as often as
they stand there. With no labelled row, every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_windows, crc32_mod, map_texts, text_buffer
from .grams import gram_counts

BITS, ORDERS, RANK, PER_LABEL, NEIGHBOURS = 12, (3, 4), 48, 1500, 21
#: Upper ends of the classes of the share of repeated words; the power of the similarity; the prior's votes.
REPEATS, POWER, PRIOR_VOTES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7), 8, 1.0
#: Similarities (32-bit floats) that differ by less are equal.
TIE = 1e-5
CODES = (1 << BITS) + len(REPEATS)


@dataclass
class Model:
    weight: np.ndarray  # by code
    basis: np.ndarray  # code by latent dimension
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    share: float  # of label 1
    neighbours: int


def _tf(counts: np.ndarray) -> np.ndarray:
    tf = np.log1p(counts, dtype=np.float32)
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-9)
    return tf


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _repeats(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """By text, the share of words that are like the word before (length and first bytes)."""
    n, word = len(offsets) - 1, data > 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & ~np.r_[False, word[:-1]] | word & edge[:-1])
    if not len(start):
        return np.zeros(n)
    end = np.flatnonzero(word & (~np.r_[word[1:], False] | edge[1:]))
    row = np.searchsorted(offsets, start, "right") - 1
    sign = (end - start).astype(np.int64) << 32
    for i in range(4):
        sign |= np.where(start + i <= end, data[np.minimum(start + i, len(data) - 1)], 0).astype(np.int64) << (8 * i)
    same = (sign[1:] == sign[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][same], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def _scan_counts(column: pa.Array):
    """Counts in blocks of whole texts."""
    offsets, data = text_buffer(column)
    for a, b in byte_windows(offsets, 1 << 20):
        for c in range(a, b, 128):
            d = min(b, c + 128)
            own, part = offsets[c : d + 1] - offsets[c], data[offsets[c] : offsets[d]]
            repeats = np.searchsorted(REPEATS, _repeats(own, part))
            # as many as two thousand times the term, which is on a par with the commonest grams
            terms = np.where((np.arange(len(REPEATS)) < repeats[:, None]), 2000, 0)
            yield np.c_[gram_counts(own, part, ORDERS, BITS), terms]


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, train, per_label: int):
    """Counts and labels of the sampled training rows, on the driver: at most ``2 * per_label`` rows."""
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    marks = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    marks = marks.where(train(F.col("id")) & F.col("label").isin(0, 1))
    order = F.xxhash64("id")
    # the ids are chosen first, so that only the chosen rows' texts are gathered
    chosen = [marks.where(F.col("label") == y).select("id", "label").join(own.select("id"), "id", "left_semi").orderBy(order, "id").limit(per_label) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    texts = own.join(F.broadcast(chosen), "id")
    if texts.select("id").count() > 2 * per_label:
        # rows that share an id count one by one: those with the smallest hashes of id and text stay within the bound
        rows = [texts.where(F.col("label") == y).orderBy(order, "id", F.xxhash64("text")).limit(per_label) for y in (0, 1)]
        texts = rows[0].unionByName(rows[1])

    def scan():
        def run(column: pa.Array) -> list:
            rows = [np.log1p(x).astype("<f2").tobytes() for block in _scan_counts(column) for x in block]
            return [pa.array(rows, pa.binary())]

        return run

    got = map_texts(texts, "text", ["label", "id"], "counts binary", scan).toArrow()
    # rows that share an id are ordered by label and counts
    rows = sorted(zip([-1 if x is None else x for x in got["id"].to_pylist()], got["label"].to_pylist(), got["counts"].to_pylist(), strict=True))
    counts = np.array([np.expm1(np.frombuffer(x, "<f2").astype(np.float32)) for _, _, x in rows], np.float32).reshape(-1, CODES)
    return counts, np.array([y for _, y, _ in rows], np.float64)


def _basis(x: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors, by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ turn.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, train, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """``train(id column)`` is true for the ids whose labels may be learned from."""
    counts, y = labelled_sample(docs, labels, doc_id, text, label, train, per_label)
    share = labels.where(train(F.col(f"`{doc_id}`")) & F.col(f"`{label}`").isin(0, 1)).agg(F.avg(f"`{label}`")).first()[0]
    share = 0.5 if share is None else float(share)
    some = counts.sum(axis=1) > 0
    counts, y = counts[some], y[some]
    if not len(y):
        return Model(np.zeros(CODES, np.float32), np.zeros((CODES, 1), np.float32), np.zeros((0, 1), np.float32), y, share, neighbours)
    tf = _tf(counts)
    idf = np.log((1 + len(y)) / (1 + (counts > 0).sum(axis=0))) + 1
    weight = idf.astype(np.float32)
    if 0 < y.sum() < len(y):
        gap = np.abs(tf[y == 1].mean(axis=0) - tf[y == 0].mean(axis=0)) / (tf.std(axis=0) + 1e-3)
        weight = weight * (0.05 + gap).astype(np.float32)
    x = _unit(tf * weight)
    basis = _basis(x, rank)
    return Model(weight.astype(np.float32), basis, _unit(x @ basis).astype(np.float32), y, share, min(neighbours, len(y)))


def _vote(model: Model, counts: np.ndarray) -> np.ndarray:
    if not len(model.labels):
        return np.full(len(counts), model.share)
    z = _unit((_tf(counts) * model.weight) @ model.basis)
    sims = z @ model.vectors.T
    k = model.neighbours
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    w = np.clip(np.take_along_axis(sims, near, axis=1), 0, 1).astype(np.float64) ** POWER
    votes, total = (w * model.labels[near]).sum(axis=1), w.sum(axis=1)
    # where others are as near as the last one, all of them vote
    last = np.take_along_axis(sims, near, axis=1).min(axis=1) - TIE
    for i in np.flatnonzero((sims >= last[:, None]).sum(axis=1) > k):
        all_ = sims[i] >= last[i]
        w = np.clip(sims[i][all_], 0, 1).astype(np.float64) ** POWER
        votes[i], total[i] = w @ model.labels[all_], w.sum()
    score = (votes + PRIOR_VOTES * model.share) / (total + PRIOR_VOTES)
    return np.where(counts.sum(axis=1) == 0, model.share, np.clip(score, 0.0, 1.0))


def score_documents(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3, with_text: str | None = None) -> DataFrame:
    """Score every whole text: per row ``keep`` and ``score double, predicted int``. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan():
        def run(column: pa.Array) -> list:
            scores = [_vote(shared.value, block) for block in _scan_counts(column)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            return [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]

        return run

    return map_texts(df, text, list(keep), "score double, predicted int", scan, with_text)


def in_training(doc_id):
    """Labels may be learned from where crc32 of the id modulo 5 is not 0."""
    return F.coalesce(crc32_mod(doc_id, 5) != 0, F.lit(False))
