"""Language identification as a mixture of languages.

Each language has a distribution over hashed byte n-grams (letters only, A-Z in lower case), counted over all
training texts. A document is a mixture: expectation-maximisation estimates the languages' proportions from
the n-grams' likelihoods. Sets of languages are compared by penalised likelihood: from the likeliest single
language on, the language with the next largest proportion joins while the gain in log-likelihood exceeds the
penalty. The predicted language is the one with the largest proportion in the chosen set, that proportion is
the score.

The mixture is over all languages, whatever their number: the model is kept as rows by language and code, and broadcast in
blocks of ``BLOCK`` languages. With several blocks, texts are scanned for each of them, and a document's likelihoods from all
blocks are brought together.

Texts that are null or have no letter are ``und`` with score 0. A text in letters that no training text had
still gets the likeliest learned language; without any learned language, everything is ``und``. Null langs
are not learned from; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_windows, crc32_mod, map_texts, stored, text_buffer
from .grams import folded, gram_rows

BITS, ORDERS, ROUNDS, PENALTY = 16, (3, 4), 12, 0.5
#: Languages that are broadcast together (1 MB each).
BLOCK = 64
#: Bytes of likelihoods that a task holds before it passes them on.
HELD = 16 << 20


@dataclass
class Block:
    """Likelihoods of some languages, by code and language."""

    languages: list[str]
    likelihood: np.ndarray
    log: np.ndarray


@dataclass
class Model:
    """All languages in order, and the stored counts ``lang, code, n``."""

    languages: list[str]
    counts: DataFrame
    smoothing: float

    def blocks(self, size: int) -> Iterator[Block]:
        for i in range(0, len(self.languages), size):
            names = self.languages[i : i + size]
            got = self.counts.where(F.col("lang").isin(names)).toArrow()
            n = np.zeros((len(names), 1 << BITS))
            if got.num_rows:
                place = {x: i for i, x in enumerate(names)}
                n[[place[x] for x in got["lang"].to_pylist()], got["code"].to_numpy()] = got["n"].to_numpy()
            p = n + self.smoothing
            p /= p.sum(axis=1, keepdims=True)
            yield Block(names, np.ascontiguousarray(p.T), np.ascontiguousarray(np.log(p).T))


def _padded(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts with a space at both ends."""
    n = len(offsets) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    out[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1] = folded(data, letters_only=True)
    return offsets + 2 * np.arange(n + 1), out


def _grams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = _padded(offsets, data)
    rows, codes = gram_rows(offsets, data, ORDERS, BITS)
    blank = np.isin(codes, _BLANKS)
    return rows[~blank], codes[~blank]


_BLANKS = [int(gram_rows(np.array([0, n]), np.full(n, 32, np.uint8), (n,), BITS)[1][0]) for n in ORDERS]


def learn(df: DataFrame, train, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Count n-grams by language over all rows for whose id ``train`` is true.

    Each task sums its rows per language, so what is shuffled is bounded by tasks, languages and codes. The driver gets
    the languages' names, and later the counts of one block of them at a time.
    """
    rows = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where(train(F.col(f"`{doc_id}`")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            offsets, data = text_buffer(batch.column(1))
            langs = batch.column(0).to_pylist()
            for a, b in byte_windows(offsets, 1 << 20):
                row, code = _grams(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                names = sorted(set(langs[a:b]))
                of_row = np.array([names.index(x) for x in langs[a:b]])
                sums = np.bincount(of_row[row] << BITS | code, minlength=len(names) << BITS).reshape(len(names), -1)
                for name, s in zip(names, sums, strict=True):
                    total[name] = total[name] + s if name in total else s
        for name, s in total.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], ["lang", "code", "n"])

    # a language whose texts have no letters is learned too, as one without n-grams
    counts = rows.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return Model(languages, stored(counts), smoothing)


def _mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p (likelihoods by n-gram) and the log-likelihood of counts n."""
    share, total = np.full(p.shape[1], 1.0 / p.shape[1]), n.sum()
    for _ in range(rounds):
        share = share * ((n / (p @ share)) @ p) / total
    return share, float(n @ np.log(p @ share))


def choose(p: np.ndarray, alone: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> tuple[int, float]:
    """Which of the candidates (columns of p, with log-likelihoods by themselves) is predicted, and its proportion."""
    best = int(np.argmax(alone))
    if len(alone) == 1:
        return best, 1.0
    share, full = _mixture(p, n)
    size = n.sum() / len(ORDERS)
    cost = penalty * np.log(size + 1) * 2
    chosen, likely, own = [best], float(alone[best]), np.ones(1)
    order = [x for x in np.argsort(-share, kind="stable") if x != best]
    while order and (full - likely) / len(ORDERS) > cost:
        more = [*chosen, order.pop(0)]
        own2, likely2 = _mixture(p[:, more], n)
        if (likely2 - likely) / len(ORDERS) <= cost:
            break
        chosen, own, likely = more, own2, likely2
    top = min(range(len(chosen)), key=lambda i: (-own[i], chosen[i]))
    return chosen[top], float(min(1.0, own[top]))


def identify(model: Block, code: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> tuple[int, float]:
    """The predicted language and its proportion."""
    return choose(model.likelihood[code], n @ model.log[code], n, penalty)


def _counted(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row, codes, counts)`` of every text that has a letter."""
    offsets, data = text_buffer(column)
    for a, b in byte_windows(offsets, 1 << 20):
        row, code = _grams(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        key, n = np.unique(row << BITS | code, return_counts=True)
        ends = np.searchsorted(key, np.arange(b - a + 1) << BITS)
        for i in range(b - a):
            raw = data[offsets[a + i] : offsets[a + i + 1]]
            low = raw | 32
            if ((low >= 97) & (low < 123)).any() or any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace")):
                x, y = ends[i], ends[i + 1]
                yield a + i, key[x:y] & ((1 << BITS) - 1), n[x:y].astype(float)


RESULTS = "lang_pred string, score double"


def identify_languages(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """Every whole text's language: per row ``keep`` and ``lang_pred string, score double``. No shuffle with one block of
    languages; with more, what is shuffled are a document's likelihoods by language."""
    if len(model.languages) > block:
        return _by_blocks(df, model, text, keep, block)
    shared = df.sparkSession.sparkContext.broadcast(next(model.blocks(block), None))

    def scan():
        m = shared.value

        def run(column: pa.Array) -> list:
            names, scores = ["und"] * len(column), [0.0] * len(column)
            for i, code, n in _counted(column) if m else ():
                best, scores[i] = identify(m, code, n)
                names[i] = m.languages[best]
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return run

    return map_texts(df, text, list(keep), RESULTS, scan)


def _by_blocks(df: DataFrame, model: Model, text: str, keep: tuple[str, ...], block: int) -> DataFrame:
    """Each document's likelihoods of every block's languages, and the mixture of them all."""
    names = [c for c in keep if c not in ("lang_pred", "score")]
    rows = stored(df.select(*(F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(names)), F.col(f"`{text}`").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()))
    schema, kinds = "row long, start int, alone binary, p binary, n binary", (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    fields, parts = [x.split()[0] for x in schema.split(", ")], []
    for b, part in enumerate(model.blocks(block)):
        shared, start = df.sparkSession.sparkContext.broadcast(part), b * block

        def look(batches, shared=shared, start=start):
            def given(out: list[tuple]) -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], fields)

            for batch in batches:
                out, held = [], 0
                for i, code, n in _counted(batch.column(1)):
                    p = shared.value.likelihood[code]
                    out.append((batch.column(0)[i].as_py(), start, (n @ shared.value.log[code]).tobytes(), p.tobytes(), n.tobytes()))
                    held += p.nbytes
                    if held > HELD:
                        yield given(out)
                        out, held = [], 0
                yield given(out)

        parts.append(stored(rows.select("row", "text").mapInArrow(look, schema)))
        shared.destroy()
    languages = df.sparkSession.sparkContext.broadcast(model.languages)

    def decide(batches):
        # a document's blocks stand together, in order, and may come in several batches
        now, blocks = None, []

        def decided() -> tuple:
            n = np.frombuffer(blocks[0][2])
            best, share = choose(np.concatenate([np.frombuffer(p).reshape(len(n), -1) for _, p, _ in blocks], axis=1), np.concatenate([np.frombuffer(a) for a, _, _ in blocks]), n)
            return now, languages.value[best], share

        def given(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.float64()), strict=True)], ["row", "lang_pred", "score"])

        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = batch.column(0)[k].as_py()
                if row != now and blocks:
                    out.append(decided())
                    blocks = []
                now = row
                blocks.append(tuple(batch.column(c)[k].as_py() for c in (2, 3, 4)))
            yield given(out)
        yield given([decided()] if blocks else [])

    likely = reduce(DataFrame.unionByName, parts).repartition("row").sortWithinPartitions("row", "start")
    both = rows.join(likely.mapInArrow(decide, f"row long, {RESULTS}"), "row", "left")
    return both.select(*(F.col(f"k_{i}").alias(c) for i, c in enumerate(names)), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def in_training(doc_id):
    """Languages may be learned from where crc32 of the id modulo 4 is not 2."""
    return F.coalesce(crc32_mod(doc_id, 4) != 2, F.lit(False))
