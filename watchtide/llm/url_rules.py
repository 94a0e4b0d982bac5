"""URL filter: allow and block entries in a trie over reversed host labels and path segments.

An entry ``(verdict, host, path)`` fits its host and all subdomains, if the URL's path starts with the entry's.
Of the entries that fit, the longest wins: first the one with most host labels, then the one with the longest
path; of equal ones with different verdicts, block. The trie is built on the driver from entries that the driver
holds anyway, and sent to the tasks once.

A URL's host stands after its first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; its path
stands from there up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has an empty host and an empty
path, which no entry fits (but one without host and path). Rows are judged one by one: repeated rows and ids do no
harm, and there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(_UPPER, _LOWER)
VERDICTS = ("allow", "block")

#: An entry as it is found: its text, and its verdict.
Entry = tuple[str, str]


class PathNode:
    """The entries of one host by path: whole segments lead on to ``below``; what an entry has after its last
    ``/`` is the beginning of a segment and stands in ``begins``."""

    __slots__ = ("begins", "below", "sizes")

    def __init__(self):
        self.below: dict[str, PathNode] = {}
        self.begins: dict[str, Entry] = {}
        self.sizes: list[int] = []

    def add(self, path: str, entry: Entry) -> None:
        *whole, begin = path.split("/")
        node = self
        for segment in whole:
            node = node.below.setdefault(segment, PathNode())
        if begin not in node.begins or entry[1] == "block":
            node.begins[begin] = entry
        node.sizes = sorted({len(x) for x in node.begins}, reverse=True)

    def find(self, segments: list[str]) -> Entry | None:
        node, best = self, None
        for segment in segments:
            for n in node.sizes:
                if n <= len(segment) and segment[:n] in node.begins:
                    best = node.begins[segment[:n]]  # deeper is longer
                    break
            node = node.below.get(segment)
            if node is None:
                break
        return best


class HostNode:
    """Entries by host label, from the last label to the first."""

    __slots__ = ("below", "paths")

    def __init__(self):
        self.below: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class UrlTrie:
    def __init__(self, entries: Iterable[tuple[str, str, str]]):
        self.root = HostNode()
        for verdict, host, path in entries:
            if verdict not in VERDICTS:
                raise ValueError(f"a verdict is allow or block, not {verdict!r}")
            host, node = host.translate(_LOWERED), self.root
            for label in reversed(host.split(".")):
                node = node.below.setdefault(label, HostNode())
            node.paths = node.paths or PathNode()
            node.paths.add(path, (host + path, verdict))

    def nodes(self, host: str) -> list[PathNode]:
        """Nodes with entries on the host's way down, the longest host first."""
        out, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths:
                out.append(node.paths)
        return out[::-1]

    @staticmethod
    def longest(nodes: list[PathNode], path: str) -> Entry | None:
        segments = path.split("/")
        for node in nodes:
            found = node.find(segments)
            if found:
                return found
        return None


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def judge_urls(df: DataFrame, entries: Iterable[tuple[str, str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Per row the columns ``keep`` and ``host, path, rule, verdict``; where no entry fits, ``rule`` is null and
    the verdict is ``default``. A kept column with the name of a result is replaced by it."""
    if default not in VERDICTS:
        raise ValueError(f"a verdict is allow or block, not {default!r}")
    results = ["host", "path", "rule", "verdict"]
    names = [c for c in keep if c not in results]
    host, path = url_parts(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")))
    source = df.select(*(F.col(f"`{c}`") for c in names), host.alias("host"), path.alias("path"))
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(entries))
    schema = T.StructType([*source.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for batch in batches:
            hosts, paths = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            nodes = {h: t.nodes(h) for h in set(hosts)}
            found = [t.longest(nodes[h], p) if nodes[h] else None for h, p in zip(hosts, paths, strict=True)]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[f.name for f in schema.fields])

    return source.mapInArrow(judge, schema)
