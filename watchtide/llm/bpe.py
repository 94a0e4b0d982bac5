"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be bridged by a merge, so a text may be
cut there with certainty. The scan cuts each text at such pairs where white space begins, encodes the
fragments independently (each distinct fragment once per batch) and concatenates the ids. Inside a
fragment, the tokenizer's splitting rule applies, and the pieces are cut again at every forbidden pair
before the merges run. All distinct new fragments of a batch are merged together in numpy.

Null texts count as empty; an empty text has no tokens. Repeated rows give repeated results. The added
token of the vocabulary file, where it stands in a text, gets its own id, as the tokenizers library does.
Bytes that aren't valid UTF-8 become U+FFFD first.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: White space as the splitting rule's engine has it (fixed values).
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: The byte-level splitting rule (fixed values).
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_WHITE = b" \t\n\r"
#: Distinct fragments that a task remembers; the memory is emptied when it is full.
MEMORY = 200_000
#: Longer fragments aren't remembered.
LONG = 64


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself,
    the other bytes for the letters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and forbidden pairs of a byte-level BPE file of the tokenizers library."""

    def __init__(self, text: str):
        letters, spec = _byte_letters(), json.loads(text)
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {to_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.token = [b""] * (max(chain(vocab.values(), self.added.values())) + 1)
        for k, v in (vocab | self.added).items():
            self.token[v] = k
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[to_bytes(a)] for a, _ in pairs], np.int64)
        right = np.array([vocab[to_bytes(b)] for _, b in pairs], np.int64)
        made = np.array([vocab[to_bytes(a + b)] for a, b in pairs], np.int64)
        self._hash_table(left << 32 | right, made)
        self.inside = np.zeros((256, 256), bool)
        for t in vocab:
            self.inside[list(t[:-1]), list(t[1:])] = True

    def _hash_table(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open addressing, so that ranks of many pairs are looked up at once."""
        size = 1 << (int(len(keys) * 4 - 1).bit_length())
        self.mask = size - 1
        self.slot_key, self.slot_rank = np.full(size, -1, np.int64), np.full(size, 1 << 30, np.int64)
        self.made = made
        left, slot = np.arange(len(keys)), self._slots(keys)
        self.steps = 0
        while len(left):
            free = self.slot_key[slot] == -1
            first = np.zeros(len(left), bool)
            _, at = np.unique(slot, return_index=True)
            first[at] = True
            take = free & first
            self.slot_key[slot[take]], self.slot_rank[slot[take]] = keys[left[take]], left[take]
            left, slot = left[~take], (slot[~take] + 1) & self.mask
            self.steps += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(40)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; 2**30 where there is none."""
        keys = left << 32 | right
        slot, out = self._slots(keys), np.full(len(keys), 1 << 30, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.steps):
            stored = self.slot_key[slot]
            hit = stored == keys[todo]
            out[todo[hit]] = self.slot_rank[slot[hit]]
            more = ~hit & (stored != -1)
            if not more.any():
                break
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out

    def fragment_rule(self) -> re.Pattern:
        """Fragments end before white space, unless the two bytes there occur inside a token."""
        bridged = bytes(b for b in range(256) if b not in _WHITE and any(self.inside[b, w] for w in _WHITE))
        white = re.escape(_WHITE)
        inner = b"(?:(?<=[" + re.escape(bridged) + b"])[" + white + b"]+)?" if bridged else b""
        return re.compile(b"[" + white + b"]*(?:[^" + white + b"]+" + inner + b")+|[" + white + b"]+")

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many ids each has. Each round applies to every
        piece its merge of least rank, at all places from left to right."""
        n = len(pieces)
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(n), [len(p) for p in pieces])
        done_ids, done_owner, done_at = [], [], []
        at = np.arange(len(ids))  # keeps the order within a piece
        rank = self._pair_ranks(ids, owner)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            width = np.diff(np.r_[starts, len(ids)])
            least_here = np.repeat(least, width)
            over = least_here == 1 << 30
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                done_at.append(at[over])
                keep = ~over
                ids, owner, at, rank, least_here = ids[keep], owner[keep], at[keep], rank[keep], least_here[keep]
                if not len(ids):
                    break
            hit = rank == least_here
            if (hit[1:] & hit[:-1]).any():  # runs of one pair overlapping, as in aaa: every other one
                index = np.arange(len(hit))
                run = index - np.maximum.accumulate(np.where(hit, -1, index))
                hit &= run % 2 == 1
            merged_at = np.flatnonzero(hit)
            ids[merged_at] = self.made[rank[merged_at]]
            keep = np.ones(len(ids), bool)
            keep[merged_at + 1] = False
            ids, owner, at = ids[keep], owner[keep], at[keep]
            where = merged_at - np.arange(len(merged_at))
            rank = rank[keep]
            stale = np.unique(np.r_[where, where[where > 0] - 1])
            rank[stale] = self._pair_ranks(ids, owner, stale)
        if not done_ids:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        ids, owner, at = (np.concatenate(x) for x in (done_ids, done_owner, done_at))
        order = np.argsort(at, kind="stable")
        return ids[order].astype("<u4"), np.bincount(owner, minlength=n)

    def _pair_ranks(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(ids)) if at is None else at
        out = np.full(len(at), 1 << 30, np.int64)
        inner = at < len(ids) - 1
        pair = at[inner]
        same = owner[pair] == owner[pair + 1]
        pair = pair[same]
        out[np.flatnonzero(inner)[same]] = self.ranks(ids[pair], ids[pair + 1])
        return out


class Encoder:
    """Encodes and decodes in one task, with a bounded memory of fragments."""

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY):
        self.v, self.memory, self.known = vocabulary, memory, {}
        self.fragments = vocabulary.fragment_rule().findall
        self.split = regex.compile(_SPLIT).findall
        self.added = re.compile(b"(" + b"|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) + b")") if vocabulary.added else None

    def pieces(self, fragment: bytes) -> list[bytes]:
        """The fragment's splits, cut again at every forbidden pair."""
        out = []
        for word in self.split(fragment.decode()):
            word, start = word.encode(), 0
            for i in range(1, len(word)):
                if not self.v.inside[word[i - 1], word[i]]:
                    out.append(word[start:i])
                    start = i
            out.append(word[start:])
        return out

    def learn(self, fragments: set[bytes]) -> None:
        fragments = list(fragments)
        pieces, count = [], np.zeros(len(fragments), np.int64)
        for i, f in enumerate(fragments):
            own = self.pieces(f)
            count[i] = len(own)
            pieces += own
        ids, lengths = self.v.merged(pieces)
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(count)]] * 4
        data = ids.tobytes()
        self.known.update(zip(fragments, (data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = []
        for t in texts:
            try:
                t.decode()
            except UnicodeDecodeError:
                t = t.decode("utf-8", "replace").encode()
            parts = self.added.split(t) if self.added and any(a in t for a in self.v.added) else [t]
            cut.append([x for i, p in enumerate(parts) for x in ([p] if i % 2 else self.fragments(p))])
        for a, i in self.v.added.items():
            self.known[a] = i.to_bytes(4, "little")
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(new)
        out = [b"".join(map(self.known.__getitem__, x)) for x in cut]
        if len(self.known) > self.memory:
            self.known = {}
        elif new:
            for f in new:
                if len(f) > LONG:
                    del self.known[f]
        return out

    def decode(self, ids: bytes) -> bytes:
        data = b"".join(map(self.v.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace").encode()


def windows(column: pa.Array, limit: int):
    """Lists of whole texts as bytes, with about ``limit`` bytes each."""
    held, size = [], 0
    for t in column.cast(pa.large_binary()):
        t = t.as_py() or b""
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(df: DataFrame, vocabulary_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """Encode every whole text, decode the ids again, and return per row ``keep`` and
    ``n_tokens, ids_sha256, decoded_sha256`` (with ``ids``: also the ids as ``array<int>``).

    The vocabulary file is read by the driver and sent to the tasks once. Null and empty texts have no
    ids. Rows are independent: no shuffle, and a task's memory is bounded by its Arrow batch and by
    ``memory`` fragments.
    """
    with open(vocabulary_file, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def scan():
        coder = Encoder(Vocabulary(spec.value), memory)

        def run(column: pa.Array) -> list:
            n, coded, decoded, own = [], [], [], []
            for texts in windows(column, 1 << 20):
                for got in coder.encode(texts):
                    n.append(len(got) // 4)
                    coded.append(hashlib.sha256(got).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(got)).hexdigest())
                    if ids:
                        own.append(np.frombuffer(got, "<i4"))
            return [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()), *([pa.array(own, pa.list_(pa.int32()))] if ids else [])]

        return run

    return map_texts(df, text, list(keep), "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, scan)
