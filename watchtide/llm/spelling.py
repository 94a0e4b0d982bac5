"""Grouping of spelling variants by a variable-length gram index.

Words are the distinct letter runs of a corpus with their numbers of occurrences. Two words are near if they
differ by exactly one inserted, deleted or replaced code point.

The gram dictionary holds the grams of two to ``LONGEST`` code points that stand in many words (a frequency bound
that follows from the size of the corpus keeps it below ``MOST_GRAMS``). A word, with a mark before and behind it,
is decomposed into one gram for each position: the longest of the dictionary that begins there, or else the two
code points. A gram can only change if an edit touches the code points that were read to find it, so the word's
bound of affected grams is the largest number of such stretches that share a place. Grams that an edit leaves alone are
grams of both words, at the same place or shifted by the difference in length. Hence, with the grams of each
word ordered from rare to frequent, the first ``bound + merge`` of each word hold ``merge`` common ones: those are
written to lists by gram, length and place, the lists are merged by counting, and what reaches the count is
verified by edit distance.

Very short words may have no gram that is sure to stay. Such a word is listed with all its grams, which finds its near
words that have a bound. Two words without one, and words of lists of more than ``MOST_IN_LIST``, are left to an exact other
way: they are compared by what is left of them when one code point is deleted. Results don't depend on any of these
parameters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: Code points of the longest gram.
LONGEST = 4
#: Most grams in the dictionary, which is broadcast.
MOST_GRAMS = 1 << 16
#: A gram of the dictionary stands in so many words at least.
LEAST_WORDS = 4
#: Most words in a list that is merged.
MOST_IN_LIST = 1000
#: Common grams that two words must have among their first ones.
MERGE = 2
#: Marks before and behind a word; no letters.
BEFORE, BEHIND = "\x02", "\x03"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 6, min_count: int = 5, letters: str = "A-Za-zÀ-ÿ", drop_every: int | None = None) -> DataFrame:
    """``word, n``: distinct maximal runs of ``letters`` with A-Z in lower case, of at least ``min_chars`` code
    points and ``min_count`` occurrences over all texts.

    With ``drop_every``, a run whose crc32 of ``<doc_id>:<run>`` it divides loses the code point at crc32 modulo
    its length, which makes misspellings. A null text has no words; a null id counts as the text ``null``; repeated
    rows count each. Occurrences are added up before the shuffle, so a frequent word is no hot key.
    """
    # runs shorter than min_chars can only become shorter
    runs = df.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"[{letters}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.char_length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("word"))
    if drop_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("word")).alias("word"))
    return runs.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class GramIndex:
    """Decomposes words by a dictionary of grams with their frequencies."""

    def __init__(self, grams: dict[str, int], longest: int = LONGEST):
        self.grams, self.longest = grams, longest

    def decompose(self, word: str) -> tuple[list[tuple[int, str, int]], int]:
        """``(frequency, gram, place)`` for every place, and the bound of grams that one edit can affect."""
        s, grams, longest = BEFORE + word + BEHIND, self.grams, self.longest
        n, out, touched = len(s), [], [0] * (len(s) + 1)
        for p in range(n - 1):
            size, read = 2, 2
            # every beginning of a gram of the dictionary is as frequent, so it's in the dictionary too
            if s[p : p + 2] in grams:
                while size < longest and p + size < n:
                    read = size + 1
                    if s[p : p + read] not in grams:
                        break
                    size = read
            gram = s[p : p + size]
            out.append((grams.get(gram, 0), gram, p))
            touched[p] += 1
            touched[p + read] -= 1
        most = here = 0
        for i in range(n):
            here += touched[i]
            if 0 < i:  # the mark before the word is never edited
                most = max(most, here)
        return out, most

    def keys(self, word: str, merge: int = MERGE) -> tuple[list[tuple[str, int]], int]:
        """The word's first grams from rare to frequent with their places, and how many of them it has in
        common with any near word (0: the word has no bound, and all its grams are there)."""
        out, affected = self.decompose(word)
        need = max(0, min(merge, len(out) - affected))
        return [(g, p) for _, g, p in sorted(out)[: affected + need if need else None]], need


def gram_dictionary(words: DataFrame, longest: int = LONGEST, most: int = MOST_GRAMS, least: int = LEAST_WORDS) -> dict[str, int]:
    """Grams of two to ``longest`` code points by the number of their places in all words.

    Only grams with more than ``all places / most`` places are kept, of which there can't be more than ``most``.
    """
    marked = F.concat(F.lit(BEFORE), "word", F.lit(BEHIND))
    sizes = range(2, longest + 1)
    n = F.char_length("word") + 2
    places = words.agg(F.sum(sum((F.greatest(n - (q - 1), F.lit(0)) for q in sizes), F.lit(0)))).first()[0] or 0
    bound = max(least, places // most + 1)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(s[p : p + q] for s in batch.column(0).to_pylist() for q in sizes for p in range(len(s) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "n"])

    counted = words.select(marked.alias("s")).mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= bound)
    return {r["gram"]: r["n"] for r in counted.toLocalIterator()}


def _deletions(word: Column) -> Column:
    """The word, and what is left of it without each of its code points; repeats once."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def near_words(words: DataFrame, merge: int = MERGE, longest: int = LONGEST, most_grams: int = MOST_GRAMS, most_in_list: int = MOST_IN_LIST) -> DataFrame:
    """All pairs ``a, a_n, b, b_n`` of near words, each in both orders. ``words``: distinct ``word`` with ``n``."""
    spark = words.sparkSession
    grams = spark.sparkContext.broadcast(gram_dictionary(words, longest, most_grams))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = GramIndex(grams.value, longest)
        for batch in batches:
            got = [index.keys(w, merge) for w in batch.column(0).to_pylist()]
            keys = pa.array([[{"gram": g, "place": p} for g, p in k] for k, _ in got], pa.list_(pa.struct([("gram", pa.string()), ("place", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys, pa.array([n for _, n in got], pa.int32())], names=["word", "n", "keys", "need"])

    decomposed = stored(words.select("word", "n").mapInArrow(entries, "word string, n long, keys array<struct<gram:string,place:int>>, need int"))
    listed = decomposed.select("word", "n", "need", F.char_length("word").alias("size"), F.explode("keys").alias("k")).select("word", "n", "need", "size", "k.gram", "k.place")
    # a word of equal length has the gram at the same place; one that is a code point longer, at the same or the next
    shifts = F.explode(F.array(*(F.struct(F.lit(a).alias("longer"), F.lit(b).alias("later")) for a, b in ((0, 0), (1, 0), (1, 1)))))
    asked = listed.select("*", shifts.alias("s")).select("word", "n", "need", "gram", (F.col("size") + F.col("s.longer")).alias("size"), (F.col("place") + F.col("s.later")).alias("place"), (F.col("s.longer") == 0).alias("level"))
    crowded = stored(listed.groupBy("gram", "size", "place").agg(F.count("*").alias("c")).where(F.col("c") > most_in_list).drop("c"))
    rest = decomposed.where("need = 0").select("word", "n")
    key = ["gram", "size", "place"]
    if crowded.head(1):
        full = listed.join(crowded, key, "left_semi").select("word", "n").unionByName(asked.join(crowded, key, "left_semi").select("word", "n"))
        rest = rest.unionByName(full).distinct()
        listed, asked = (x.join(crowded, key, "left_anti") for x in (listed, asked))
    met = (
        asked.withColumnsRenamed({"word": "a", "n": "a_n", "need": "a_need"})
        .join(listed.withColumnsRenamed({"word": "b", "n": "b_n", "need": "b_need"}), key)
        .where("NOT level OR a < b")
        .groupBy("a", "a_n", "b", "b_n")
        .agg(F.count("*").alias("common"), F.min(F.least(*(F.nullif(c, F.lit(0)) for c in ("a_need", "b_need")))).alias("need"))
        .where("common >= coalesce(need, 0)")
        .select("a", "a_n", "b", "b_n")
    )
    left = rest.select("word", "n", F.explode(_deletions(F.col("word"))).alias("left"))
    cut = left.withColumnsRenamed({"word": "a", "n": "a_n"}).join(left.withColumnsRenamed({"word": "b", "n": "b_n"}), "left").where("struct(char_length(a), a) < struct(char_length(b), b)").select("a", "a_n", "b", "b_n").distinct()
    pairs = stored(met.unionByName(cut).where(F.levenshtein("a", "b", 1) == 1).distinct())
    dropped(decomposed)
    dropped(crowded)
    grams.destroy()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for every word of ``links (word, form)``, whose chains have an end. Each round doubles the
    steps taken, so there are as many rounds as the longest chain has binary digits."""
    at = stored(links.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stored(at.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        dropped(at)
        at = after.select("word", "root")
        at._stored_at = after._stored_at
        if not after.where("moved").head(1):
            return at


def group_variants(words: DataFrame, factor: int = 5, **how) -> DataFrame:
    """For each word of ``words (word, n)``: ``word, n, n_near, form, form_n, root``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that is at least
    ``factor`` times the word's own, else null; ``root`` is where the forms lead to, the word itself if it has none.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that forms lead somewhere")
    near = near_words(words, **how)
    best = near.groupBy(F.col("a").alias("word"), F.col("a_n").alias("n")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("order"), F.col("b").alias("form"))).alias("best"))
    fits = -F.col("best.order") >= factor * F.col("n")
    best = stored(best.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.order")).alias("form_n")))
    ends = roots(best.where("form IS NOT NULL"))
    return (
        words.select("word", "n").join(best, "word", "left").join(ends, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )


def spelling_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", factor: int = 5, counts: dict | None = None, **how) -> DataFrame:
    """``group_variants`` of the words of ``df``; ``counts`` goes to ``word_counts``. Columns other than id and
    text play no part; an empty table has no words."""
    words = stored(word_counts(df, doc_id, text, **(counts or {})))
    return group_variants(words, factor, **how)
