"""Line deduplication over a whole corpus, with DataFrame functions only.

Line hashes are range-partitioned together with their document, so that even a line that stands in a third
of all documents is spread over many partitions; inside each partition the rows are sorted by hash, document
and position, and a running row number streams out the first occurrence of a line in each document. Those
are counted per hash (partial counts before the shuffle). The lines that stay are returned as one compressed
bitmap per document, never as text. Of the lines that go, the most frequent (so many that there can't be more
than ``HOT_KEYS`` of them) are looked up by broadcast, the others by a join whose keys are then all small.

Rows that share an id are one document, a row without id is one with all that have its text; each text of an id has its
own bitmap. A null text is empty, and an empty text has one empty line. Columns other than id and text play no
part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

#: Most keys that are looked up by broadcast.
HOT_KEYS = 4096

#: White space at the ends of a line: space and U+0009 to U+000D (fixed values).
WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    # lower() is the same for ASCII, and far cheaper than looking up every character
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def document_key(doc_id: Column, text: Column) -> Column:
    """16 bytes for the row's id and text; null ids have a key too."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))))


def kept_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_key_chars: int = 1, keep_first: bool = False, copies_as_one: bool = False, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Bitmaps of the lines that stay, for documents that lose any.

    A key of at least ``min_key_chars`` code points found in at least ``min_docs`` documents loses all its
    lines; with ``keep_first``, its first occurrence (smallest document key, then position) stays.
    With ``copies_as_one``, rows of equal text count as one document whatever their ids, so that a group of
    copies doesn't make its own lines common.
    Returns ``doc_key binary, kept map<long, long>``: bit ``i % 64`` of word ``i div 64`` is set if line ``i``
    stays; words of which every line stays are left out.
    """
    own, id_ = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`")
    doc = F.xxhash64(own) if copies_as_one else F.when(id_.isNotNull(), F.xxhash64(id_.cast("string"))).otherwise(F.xxhash64(F.lit("null"), own))
    # the document's keys are computed once, below the explode; the hashes are stored once, for three uses
    lines = stored(
        df.select(document_key(id_, F.col(f"`{text}`")).alias("doc_key"), doc.alias("doc"), lines_of(F.col(f"`{text}`")).alias("lines"))
        .select("doc_key", "doc", F.posexplode("lines").alias("pos", "line"))
        .select("doc_key", "doc", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_key_chars)
        .select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g"), "doc_key", "doc", "pos")
    )
    if copies_as_one:
        # partial results take the copies together before the shuffle
        first = lines.groupBy("h", "g", "doc").agg(F.min(F.struct("doc_key", "pos")).alias("at"))
    else:
        dealt = lines.repartitionByRange("h", "g", "doc").sortWithinPartitions("h", "g", "doc", "doc_key", "pos")
        first = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("h", "g", "doc").orderBy("doc_key", "pos"))).where("nth = 1").withColumn("at", F.struct("doc_key", "pos"))
    common = stored(first.groupBy("h", "g").agg(F.count("*").alias("n_docs"), F.min("at").alias("first")).where(F.col("n_docs") >= min_docs))
    # sum of n_docs >= number of frequent keys * the least n_docs among them
    least = 1 + common.agg(F.sum("n_docs")).first()[0] // hot_keys if common.head(1) else 1
    hot = F.broadcast(common.where(F.col("n_docs") >= least))
    gone = lines.join(hot, ["h", "g"]).unionByName(lines.join(hot.select("h", "g"), ["h", "g"], "left_anti").join(common.where(F.col("n_docs") < least), ["h", "g"]))
    if keep_first:
        gone = gone.where(F.struct("doc_key", "pos") != F.col("first"))
    out = stored(
        gone.groupBy("doc_key", F.expr("cast(pos div 64 as bigint)").alias("word"))
        .agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
        .groupBy("doc_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("kept"))
    )
    dropped(lines)
    dropped(common)
    return out


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """Apply ``kept_lines``: per row the columns ``keep`` and ``n_lines`` (before), ``n_dropped`` and
    ``kept_text`` (the lines that stay, joined by newline)."""
    bitmaps = kept_lines(df, doc_id, text, **how)
    names = [c for c in keep if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = df.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in names), document_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("doc_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    both = rows.join(bitmaps, "doc_key", "left").withColumn("lines", lines_of(F.col("text")))
    is_kept = lambda _, i: F.coalesce(F.try_element_at("kept", F.floor(i / 64)), F.lit(-1)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0
    left = F.when(F.col("kept").isNull(), F.col("lines")).otherwise(F.filter("lines", is_kept))
    return both.select(
        *(F.col(f"__{c}").alias(c) for c in names),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.aggregate(F.map_values("kept"), F.lit(0), lambda n, w: n + 64 - F.bit_count(w))).cast("long").alias("n_dropped"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept_text"),
    )
