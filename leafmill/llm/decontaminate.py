"""Benchmark decontamination with an FM-index per shard of training texts.

A shard is a run of documents inside one task. Test phrases are searched backwards
through a wavelet matrix over the shard's Burrows-Wheeler transform, their occurrences
located by sampled suffix positions, and the word spans they cover merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ALNUM, free_name, hash_words, slices
from leafmill.llm.suffixes import suffix_array
from leafmill.session import cut_lineage

WINDOW = 13
#: Bytes of benchmark text that one pass over the documents carries to the tasks.
BLOCK_BYTES = 8_000_000
#: Every such suffix position is kept for locating.
SAMPLE = 8


class WaveletMatrix:
    """Rank queries over a sequence of integers below 2**levels, many at once."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in reversed(range(levels)):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(places), places.copy()
        for i, level in enumerate(reversed(range(self.levels))):
            one = ((symbols >> level) & 1).astype(bool)
            ones, zeros = self.ones[i], self.zeros[i]
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, places: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        found, at = np.zeros_like(places), places.copy()
        for i in range(self.levels):
            ones, zeros = self.ones[i], self.zeros[i]
            one = (ones[at + 1] - ones[at]).astype(bool)
            found = found * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return found


class FMIndex:
    """Backward search over a sequence of symbols 1..size-1; 0 parts what must not be joined."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.concatenate([text, [0]]).astype(np.int64)
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.wavelet = WaveletMatrix(bwt, max(1, int(size - 1).bit_length()))
        self.whole = int(np.flatnonzero(sa == 0)[0])  # the row of the whole text: the symbol before it is the last one
        kept = sa % SAMPLE == 0
        self.kept = kept
        self.kept_rank = np.cumsum(kept) - 1
        self.kept_at = sa[kept]

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (rows of equal length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            symbol = phrases[live, j]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            gone = low[live] >= high[live]
            high[live[gone]] = low[live[gone]]
            live = live[~gone]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix row: steps back until a kept position."""
        at, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.kept[at[live]]
            done = live[hit]
            found[done] = self.kept_at[self.kept_rank[at[done]]] + steps[done]
            live = live[~hit]
            if len(live):
                symbol, row = self.wavelet.access(at[live]), at[live]
                at[live] = self.before[symbol] + self.wavelet.rank(symbol, row) + ((symbol == 0) & (row < self.whole))
                steps[live] += 1
        return found


class Phrases:
    """Distinct test phrases by length, as word numbers, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        texts = [t for _, t in items]
        owner, _, _, hashes, _ = hash_words(texts, ALNUM)
        self.words = np.unique(hashes)
        numbers = np.searchsorted(self.words, hashes) + 1
        self.items = [i for i, _ in items]
        windows: dict[int, list[np.ndarray]] = {}
        held: dict[int, list[int]] = {}
        bounds = np.searchsorted(owner, np.arange(len(items) + 1))
        for k in range(len(items)):
            own = numbers[bounds[k]:bounds[k + 1]]
            size = min(window, len(own))
            if size:
                rows = np.lib.stride_tricks.sliding_window_view(own, size)
                windows.setdefault(size, []).append(rows)
                held.setdefault(size, []).extend([k] * len(rows))
        self.sets = []
        for size in sorted(windows):
            rows, inverse = np.unique(np.concatenate(windows[size]), axis=0, return_inverse=True)
            order = np.argsort(inverse.reshape(-1), kind="stable")
            self.sets.append((rows.astype(np.int64), np.array(held[size])[order], np.searchsorted(inverse.reshape(-1)[order], np.arange(len(rows) + 1))))
        self.shortest = min(windows, default=0)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] numbers, then those of the next."""
    ends = np.cumsum(counts)
    return np.arange(int(counts.sum())) + np.repeat(starts - ends + counts, counts)


def search_shard(texts: list[bytes], phrases: Phrases):
    """For the texts of a shard: words per text, (text, first word, end word) of merged spans, (text, item) pairs, byte offsets of words.

    Words that no phrase holds cannot be inside an occurrence. They, and runs of known
    words shorter than the shortest phrase, are left out of the index; a separator
    stands for each such gap and between texts.
    """
    owner, starts, ends, hashes, _ = hash_words(texts, ALNUM)
    n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    none = np.zeros(0, np.int64)
    if not len(phrases.words) or not len(hashes):
        return n_words, (none, none, none), (none, none), (owner, starts, ends)
    at = np.minimum(np.searchsorted(phrases.words, hashes), len(phrases.words) - 1)
    known = phrases.words[at] == hashes
    first = known & ~np.concatenate(([False], known[:-1] & (owner[1:] == owner[:-1])))
    run_start = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    lengths = np.bincount(run[known], minlength=len(run_start))
    wide = lengths >= phrases.shortest
    run_start, lengths = run_start[wide], lengths[wide]
    if not len(run_start):
        return n_words, (none, none, none), (none, none), (owner, starts, ends)
    place = _spread(run_start, lengths)  # word positions that the index holds
    gap = np.cumsum(lengths) + np.arange(len(lengths))
    text = np.zeros(len(place) + len(lengths), np.int64)
    word_at = np.full(len(text), -1, np.int64)
    solid = np.ones(len(text), bool)
    solid[gap] = False
    text[solid], word_at[solid] = at[place] + 1, place
    index = FMIndex(text, len(phrases.words) + 1)
    hits = np.zeros(len(owner) + 1, np.int64)
    pairs = []
    for rows, held, bounds in phrases.sets:
        low, high = index.count(rows)
        some = np.flatnonzero(high > low)
        counts = high[some] - low[some]
        found = index.locate(_spread(low[some], counts))
        begin = word_at[found]
        np.add.at(hits, begin, 1)
        np.add.at(hits, begin + rows.shape[1], -1)
        phrase = np.repeat(some, counts)
        both = np.unique(owner[begin] * len(rows) + phrase)
        document, phrase = both // len(rows), both % len(rows)
        many = bounds[phrase + 1] - bounds[phrase]
        pairs.append(np.repeat(document, many) * len(phrases.items) + held[_spread(bounds[phrase], many)])
    hit = np.cumsum(hits[:-1]) > 0
    edge_in = hit & ~np.concatenate(([False], hit[:-1] & (owner[1:] == owner[:-1])))
    edge_out = hit & ~np.concatenate((hit[1:] & (owner[1:] == owner[:-1]), [False]))
    begin, end = np.flatnonzero(edge_in), np.flatnonzero(edge_out) + 1
    both = np.unique(np.concatenate(pairs)) if pairs else none
    return n_words, (owner[begin], begin, end), (both // len(phrases.items), both % len(phrases.items)), (owner, starts, ends)


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", tagged: bool = False) -> DataFrame:
    """(id, n_words, spans, items) of every document; with `tagged` also the hash of its text.

    `spans` are the merged runs of hit words: word numbers and byte offsets in the text,
    end exclusive. `items` are the ids, as strings, of items with a window in it, sorted.
    The benchmark is a stated query set: it is dealt into blocks of about `block_bytes`
    and each block is one map-only pass over the documents, of which only numbers are
    shuffled. Null and empty texts have no words; an item without words has no window, and
    one without an id is searched like the others but has no id to list. Documents with the
    same id count as one row each, told apart by a hash of their text.
    """
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kind = dict(documents.dtypes)[ident]
    out = f"{ident} {kind}, n_words long, spans array<struct<word:long,end:long,byte:long,byte_end:long>>, items array<string>"
    out = f"{out}, tag long"
    names = [ident, "n_words", "spans", "items", "tag"]

    def searcher(phrases: Phrases):
        def run(batches):
            for rows, texts in slices(batches, text):
                n_words, (doc, begin, end), (held, which), (_, starts, ends) = search_shard(texts, phrases)
                base = np.cumsum([0] + [len(t) + 1 for t in texts])
                word0 = np.cumsum(n_words) - n_words
                spans: list[list] = [[] for _ in texts]
                items: list[list] = [[] for _ in texts]
                for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist()):
                    spans[d].append({"word": a - int(word0[d]), "end": b - int(word0[d]), "byte": int(starts[a] - base[d]), "byte_end": int(ends[b - 1] - base[d])})
                for d, k in zip(held.tolist(), which.tolist()):
                    if phrases.items[k] is not None:
                        items[d].append(phrases.items[k])
                span = pa.list_(pa.struct([(k, pa.int64()) for k in ("word", "end", "byte", "byte_end")]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words), pa.array(spans, span),
                                                  pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), rows.column(2)], names)
        return run

    passes = []
    for block in range(blocks):
        mine = benchmark.filter(F.pmod(F.xxhash64(item, item_text), F.lit(blocks)) == block)
        rows = mine.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("words")).collect()
        phrases = Phrases([(r["item"], (r["words"] or "").encode()) for r in sorted(rows, key=lambda r: (r["item"] or "", r["words"] or ""))], window)
        passes.append(documents.select(ident, text, F.xxhash64(text).alias("_tag")).mapInArrow(searcher(phrases), out))
    if blocks == 1:
        return passes[0] if tagged else passes[0].drop("tag")
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    # alike rows of a pass give alike results: one group, given out as often as a pass has them
    merged = every.groupBy(ident, "tag", "n_words").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
                                                        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("copies"))
    merged = merged.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("copies") / blocks))))
    join = F.expr("""aggregate(spans, cast(array() as array<struct<word:bigint,end:bigint,byte:bigint,byte_end:bigint>>), (a, s) ->
        if(size(a) > 0 and a[size(a) - 1].end >= s.word, concat(slice(a, 1, size(a) - 1), array(named_struct(
            'word', a[size(a) - 1].word, 'end', greatest(a[size(a) - 1].end, s.end), 'byte', a[size(a) - 1].byte,
            'byte_end', greatest(a[size(a) - 1].byte_end, s.byte_end)))), concat(a, array(s))))""")
    return merged.select(ident, "n_words", join.alias("spans"), "items", *(["tag"] if tagged else []))


def contamination_columns(found: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Per document: hit words, items with a window, their digest, and the verdict: hit words are a twentieth or more."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["word"])
    return found.select(ident, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), *(["tag"] if "tag" in found.columns else [])).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(documents: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """`documents` without the contaminated ones; each row is judged by its own text, whatever its id."""
    verdicts = contamination_columns(find_contamination(documents, benchmark, ident=ident, text=text, tagged=True, **how), ident)
    tag = free_name(documents, "_tag")
    dropped = cut_lineage(verdicts.filter("contaminated").select(F.col("tag").alias(tag)).distinct())
    return documents.withColumn(tag, F.xxhash64(text)).join(dropped, tag, "left_anti").select(*documents.columns)
