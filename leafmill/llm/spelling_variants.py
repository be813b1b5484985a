"""Spelling variants: words one edit apart, and for each the much more frequent word it stands for.

Two words a single inserted, deleted or replaced code point apart share one of two disjoint
chunks, since the edit falls into one of them at most. The shorter word (of two equally
long ones either) contributes its two halves, the other its grams of that length at every
place where a half can lie, shifted by one at most; words that meet under a chunk are
compared. A chunk that very many words share is not compared as it stands: its words meet
again under longer ones, with the half that may hold the edit cut in two, and so on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import cut_lineage

#: The characters of words; least length and count of a word; how much more frequent a form is.
LETTERS, LEAST_LENGTH, LEAST_COUNT, FACTOR = "A-Za-zÀ-ÿ", 6, 5, 5
#: Rows under one chunk that are compared; more meet again under longer chunks.
MANY = 1000
#: Words and characters a task counts before it passes them on.
_HELD_WORDS, _HELD_CHARS = 400_000, 16_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(ident, text: str, fraction: int | None, least_length: int):
    """(word, count) of a text; a word for which `fraction` divides h, the crc32 of `id:word`, loses its character h % length."""
    counts = Counter(re.findall(f"[{LETTERS}]{{{least_length},}}", text.translate(_LOWER)))  # a shorter run stays too short
    if fraction is None:
        yield from counts.items()
        return
    prefix = f"{ident}:"
    for word, n in counts.items():
        h = zlib.crc32((prefix + word).encode())
        if h % fraction == 0:
            cut = h % len(word)
            word = word[:cut] + word[cut + 1:]
        yield word, n


def count_words(documents: DataFrame, ident: str = "doc_id", text: str = "text", fraction: int | None = None,
                least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words of at least `least_length` characters that occur `least_count` times or more in all texts.

    A word is a run of `LETTERS` with A-Z lower-cased. Tasks count their own texts first,
    so a frequent word is a row per task. Null texts have no words; with a `fraction`, a
    null id counts as the text `None`.
    """
    def run(batches):
        counts: dict[str, int] = {}
        chars = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                for word, n in words_of(i.as_py(), t.as_py() or "", fraction, least_length):
                    if len(word) >= least_length:
                        if word in counts:
                            counts[word] += n
                        else:
                            counts[word] = n
                            chars += len(word)
                if len(counts) >= _HELD_WORDS or chars >= _HELD_CHARS:
                    yield out()
                    counts.clear()
                    chars = 0
        yield out()

    named = documents.select(F.col(ident).alias("_id"), F.col(text).alias("_text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _chunks(words: DataFrame) -> DataFrame:
    """(word, longer, len, low, high, chunk): the rows under which words meet.

    len is the length of the shorter word, of whose characters [low, high) one may be edited
    while the other half is the chunk. `longer` is 0 for words of that length, 1 for words
    one longer, in which an added character may shift the second half by one.
    """
    def rows(longer):
        length = F.length("word") - longer
        half = F.floor(length / 2).cast("int")

        def row(low, high, chunk):
            return F.struct(F.lit(longer).alias("longer"), length.alias("len"), low.alias("low"), high.alias("high"), chunk.alias("chunk"))

        return [row(half, length, F.col("word").substr(F.lit(1), half)),
                row(F.lit(0), length - half, F.col("word").substr(length - half + longer + 1, half))]

    return words.select("word", F.inline(F.array(*rows(0), *rows(1))))


def _finer(rows: DataFrame) -> DataFrame:
    """The same words with the stretch that may hold the edit cut in two."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")

    def kept(low, high):
        return F.struct("longer", "len", low.alias("low"), high.alias("high"), F.concat(
            F.col("word").substr(F.lit(1), low), F.lit("\0"), F.col("word").substr(high + F.col("longer") + 1, F.col("len"))).alias("chunk"))

    return rows.select("word", F.inline(F.array(kept(F.col("low"), middle), kept(middle, F.col("high")))))


def near_words(words: DataFrame, word: str = "word", many: int = MANY) -> DataFrame:
    """(word, other) both ways, for distinct words exactly one edit apart; no pair twice, none missing.

    Words under one chunk are compared with a bound of one edit inside the join. Chunks
    with more than `many` rows are cut finer, down to a single character: no more words can
    meet there than the alphabet has characters, or pairs of them.
    """
    words = words.select(F.col(word).alias("word")).filter(F.col("word").isNotNull()).distinct()
    rows, found, key = cut_lineage(_chunks(words)), [], ["len", "low", "high", "chunk"]
    while True:
        sizes = rows.filter("high - low > 1").groupBy(*key).agg(F.count("*").alias("size"))
        hot = cut_lineage(sizes.filter(F.col("size") > many).select(*key))
        dense = not hot.isEmpty()
        plain = rows.join(hot, key, "left_anti") if dense else rows
        givers, others = plain.filter("longer = 0"), plain.select("word", "longer", *key)
        pairs = givers.select(F.col("word").alias("a"), *key).join(others.select(F.col("word").alias("b"), "longer", *key), key).filter(
            ((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(pairs.select("a", "b"))
        if not dense:
            break
        rows = cut_lineage(_finer(rows.join(hot, key, "left_semi")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.distinct()
    return out.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(out.select(F.col("b").alias("word"), F.col("a").alias("other")))


def spelling_variants(counted: DataFrame, factor: int = FACTOR, many: int = MANY) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct counted words (word, n).

    A word's form is its near word of greatest n (of equal ones the first in code-point
    order) if that n is at least `factor` times its own (more than one), else null; its
    root is where its forms lead, itself if it has none. A form is at least `factor` times
    as frequent, so the way is short; each round halves it. Words are rows, so no group of
    variants is ever gathered. An empty table gives no rows; rows with a null word are dropped.
    """
    if factor < 2:
        raise ValueError("factor must be at least two")
    counted = cut_lineage(counted.select("word", "n").filter(F.col("word").isNotNull()))
    near = near_words(counted, many=many).join(counted.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("_best"))
    fits = -F.col("_best.less") >= factor * F.col("n")
    out = cut_lineage(counted.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("_best.other")).alias("form"), F.when(fits, -F.col("_best.less")).alias("form_n")))
    steps = cut_lineage(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # a root that has a form itself moves on to that one's root
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(steps.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        steps = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            break
    return out.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
