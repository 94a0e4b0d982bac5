"""Alignment of the tokens of two tokenizers, and what their id pairs count over the corpus.

A text with a space before it is encoded by a byte-level BPE file (A), and the text by a sentencepiece model (B), which
adds that space itself. Both cover the same bytes. In each batch, keyed by document, ``merge_asof`` finds for
the start of every A token the B token that covers it, and the other way round; both together are all pairs of tokens
that overlap (a pair with one start is found twice and counts once). Where tokens of both sides end at the same
byte, groups end.

A is encoded by tiktoken with the file's own ids as ranks, where they are in the order of its merges (which gives the
ids of the tokenizers library), else by that library.

Per document the distinct id pairs with their counts are kept as packed arrays in a written table. The corpus counts are
added up per task first. Then the most frequent id pairs, ``MOST_PAIRS`` at most, are broadcast and looked up in
the packed arrays; what is left are rare pairs, which are joined as rows and can't be hot.

Texts that are null, empty, or whose tokens don't give the bytes of the space and the text (as a model does that
normalises) have no tokens: all numbers are 0 and the groups are empty. Strings of special tokens are plain text. Rows
are independent; equal rows and ids count each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Vocabulary, windows
from .common import dropped, stored

#: The byte-level splitting rule (fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most id pairs that are broadcast (17 bytes each).
MOST_PAIRS = 1_000_000
#: Bytes of text that are aligned together (a longer text stands alone).
WINDOW = 1 << 20
#: Distinct id pairs that a task adds up before it hands them on.
PARTIAL = 1 << 20


class ByteModel:
    """A byte-level BPE file of the tokenizers library as bytes per token; special tokens are plain text."""

    def __init__(self, spec: str):
        vocabulary = Vocabulary(spec)
        self.token, self.tok, self.ranked = vocabulary.token, None, None
        if (np.diff(vocabulary.made) > 0).all():  # ids are in order of merges, so they serve as ranks
            import tiktoken

            ranks = {t: i for i, t in enumerate(self.token) if t and t not in vocabulary.added}
            self.ranked = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_str(spec)
            self.tok.no_truncation()
            self.tok.no_padding()
            self.tok.encode_special_tokens = True

    def encode(self, text: str) -> np.ndarray:
        if self.ranked:
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int64)


class PieceModel:
    """A sentencepiece model as bytes per piece; it puts a space before each text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.token = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.sp.encode(text, num_threads=1), np.int64)


class Pair:
    """Both encoders in one task."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteModel(spec), PieceModel(model)
        self.token_a, self.token_b = self.a.token, self.b.token
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.token_a, self.token_b))

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B, or None if the tokens of either don't give the bytes of the space and the text."""
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return None
        if not text:
            return None
        a, b, whole = self.a.encode(" " + text), self.b.encode(text), b" " + data
        for token, ids in ((self.token_a, a), (self.token_b, b)):
            if b"".join(map(token.__getitem__, ids.tolist())) != whole:
                return None
        return a, b


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all A and B tokens that overlap. Starts count through the batch, so they are sorted."""
    a = pd.DataFrame({"doc": doc_a, "start": start_a})
    b = pd.DataFrame({"doc": doc_b, "start": start_b})
    a["i"], b["i"] = np.arange(len(a)), np.arange(len(b))
    of_a = pd.merge_asof(a[["doc", "start"]], b, on="start", by="doc")["i"].to_numpy()
    of_b = pd.merge_asof(b[["doc", "start"]], a, on="start", by="doc")["i"].to_numpy()
    later = start_a[of_b] != start_b  # with one start, the pair is there already
    return np.r_[a["i"].to_numpy(), of_b[later]], np.r_[of_a, b["i"].to_numpy()[later]]


class Aligner:
    """Alignment of batches: numbers, groups and packed pair counts of each document."""

    def __init__(self, pair: Pair):
        self.pair, self.width = pair, len(pair.token_b)
        # texts of ids with what may follow: within a group, at the end of A's part or of the group
        self.text_a = [f"{i},".encode() for i in range(len(pair.token_a))] + [f"{i}|".encode() for i in range(len(pair.token_a))]
        self.text_b = [f"{i},".encode() for i in range(self.width)] + [f"{i};".encode() for i in range(self.width)]
        self.texts = self.text_a + self.text_b

    def align(self, texts: list[bytes]) -> list[tuple[int, int, int, int, bytes, bytes, bytes]]:
        """Per text: numbers of A tokens, B tokens, groups, links; the groups' text; pairs (8 bytes each, A id times
        the number of pieces plus B id) and their counts (4 bytes each)."""
        got = [self.pair.encode(t) for t in texts]
        held = [i for i, x in enumerate(got) if x]
        out: list[tuple] = [(0, 0, 0, 0, b"", b"", b"")] * len(texts)
        if not held:
            return out
        a, b = (np.concatenate([got[i][side] for i in held]) for side in (0, 1))
        n_a, n_b = (np.array([len(got[i][side]) for i in held]) for side in (0, 1))
        doc_a, doc_b = np.repeat(np.arange(len(held)), n_a), np.repeat(np.arange(len(held)), n_b)
        end_a, end_b = np.cumsum(self.pair.size_a[a]), np.cumsum(self.pair.size_b[b])
        of_a, of_b = overlaps(doc_a, end_a - self.pair.size_a[a], doc_b, end_b - self.pair.size_b[b])
        n_links = np.bincount(doc_a[of_a], minlength=len(held))
        # counts of id pairs by document
        span = len(self.pair.token_a) * self.width
        per = max(1, (1 << 62) // span)
        if len(held) > per:
            raise ValueError("too many texts in a window")
        coded, counts = np.unique(doc_a[of_a] * span + a[of_a] * self.width + b[of_b], return_counts=True)
        pairs, cuts = coded % span, np.searchsorted(coded, np.arange(len(held) + 1) * span)
        counts = counts.astype("<u4")
        # groups end where both sides end
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        n_groups = np.bincount(doc_a[last_a], minlength=len(held))
        group_a, group_b = np.r_[0, np.cumsum(last_a)[:-1]], np.r_[0, np.cumsum(last_b)[:-1]]
        code = np.r_[a + last_a * len(self.pair.token_a), b + last_b * self.width + 2 * len(self.pair.token_a)]
        code = code[np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")].tolist()
        at, text = 0, self.texts.__getitem__
        for k, i in enumerate(held):
            n = int(n_a[k] + n_b[k])
            groups = b"".join(map(text, code[at : at + n]))[:-1]
            at += n
            x, y = cuts[k], cuts[k + 1]
            out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), groups, pairs[x:y].astype("<i8").tobytes(), counts[x:y].tobytes())
        return out


def aligned(df: DataFrame, vocabulary_file: str, piece_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), groups: bool = False) -> DataFrame:
    """Per row ``keep`` and ``n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts`` (with ``groups``: also their
    text as ``groups``): see ``Aligner.align``. Both files are read by the driver and sent to the tasks once."""
    sc = df.sparkSession.sparkContext
    with open(vocabulary_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        files = sc.broadcast((f.read(), g.read()))
    results = T._parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary" + ", groups string" * groups)
    names = [c for c in keep if c not in {f.name for f in results.fields}]
    source = df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*(source.schema[c] for c in names), *results.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Pair(*files.value))
        for batch in batches:
            at = 0
            for texts in windows(batch.column(len(names)), WINDOW):
                got = list(zip(*aligner.align(texts), strict=True))
                digests = [hashlib.sha256(x).hexdigest() if n else "" for n, x in zip(got[0], got[4], strict=True)]
                arrays = [*(pa.array(x, pa.int64()) for x in got[:4]), pa.array(digests, pa.string()), pa.array(got[5], pa.binary()), pa.array(got[6], pa.binary())]
                own = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(len(names))), *arrays, *([pa.array(got[4], pa.binary()).cast(pa.string())] if groups else [])], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: links that hold an id pair over the corpus, and whether that is the most of its B id."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], names=["pair", "n"])

        sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            n = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").astype(np.int64)
            pairs, where = np.unique(np.r_[sums[0], pairs], return_inverse=True)
            sums = pairs, np.bincount(where, np.r_[sums[1], n], len(pairs)).astype(np.int64)
            if len(pairs) > PARTIAL:
                yield from handed(*sums)
                sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from handed(*sums)

    counted = stored(rows.select("pairs", "counts").mapInArrow(added, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    most = counted.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    out = stored(counted.withColumn("b", F.col("pair") % width).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    dropped(counted)
    return out


def _frequent(counts: DataFrame, most: int) -> int:
    """A least count that at most ``most`` pairs have."""
    n, total = counts.agg(F.count("*"), F.sum("n")).first()
    if n <= most:
        return 0
    likely = counts.agg(F.percentile_approx("n", 1 - most / n, 10_000)).first()[0] + 1
    return likely if counts.where(F.col("n") >= likely).count() <= most else total // most + 1


def align_tokenizers(df: DataFrame, vocabulary_file: str, piece_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), groups: bool = False, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per row ``keep`` and ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (with ``groups``: also their
    text).

    An id pair's count is the number of links over all rows that hold it. ``n_best`` counts the row's links whose pair
    has the highest count of its B id (ties included), ``count_sum`` adds up the counts over the row's links.
    """
    import sentencepiece

    spark = df.sparkSession
    width = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    shown = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else [])]
    names = [c for c in keep if c not in {*shown, "pairs", "counts", "n_best", "count_sum", "groups"}]
    rows = stored(aligned(df, vocabulary_file, piece_file, text, names, groups))
    counts = pair_counts(rows, width)
    least = _frequent(counts, most_pairs)
    table = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    fixed = [*names, *shown]
    columns = rows.select(*(F.col(f"`{c}`") for c in fixed), *([F.monotonically_increasing_id().alias("__row")] if least else []), "pairs", "counts")
    passed = [f for f in columns.schema.fields if f.name not in ("pairs", "counts")]
    rare = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
    schema = T.StructType([*passed, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), *([T.StructField("__rare", rare)] if least else [])])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            blobs, times = batch.column(len(passed)).to_pylist(), batch.column(len(passed) + 1).to_pylist()
            ends = np.cumsum([len(x) // 8 for x in blobs])
            asked, times = np.frombuffer(b"".join(blobs), "<i8"), np.frombuffer(b"".join(times), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(pair, asked), max(len(pair) - 1, 0))
            hit = pair[at] == asked if len(pair) else np.zeros(len(asked), bool)
            sums = [np.r_[0, np.cumsum(np.where(hit, x, 0))] for x in ((times * best[at], times * n[at]) if len(pair) else (times * 0, times * 0))]
            starts = np.r_[0, ends[:-1]]
            arrays = [pa.array(s[ends] - s[starts]) for s in sums]
            if least:
                lost = np.flatnonzero(~hit)
                offsets = np.searchsorted(lost, np.r_[0, ends]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(asked[lost]), pa.array(times[lost])], ["pair", "times"])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(passed))), *arrays], names=[f.name for f in schema.fields])

    found = columns.mapInArrow(look_up, schema)
    if least:
        found = stored(found)
        wanted = found.select("__row", F.explode("__rare").alias("r")).select("__row", "r.pair", "r.times")
        rest = (
            wanted.join(counts.where(F.col("n") < least), "pair").groupBy("__row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
        )
        found = found.join(rest, "__row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))})
    return found.select(*(F.col(f"`{c}`") for c in names), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))
