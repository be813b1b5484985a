"""Hierarchical best-fit packing of token sequences.

Leaves pack their pieces best-fit, largest first. Nearly full bins are done; the others
go up a tree as items of their own, and each node packs the bins of its children best-fit
again, until the root.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import KEPT, hash_words, slices
from leafmill.session import cut_lineage

CAPACITY = 2048
#: Pieces a leaf packs, about; children of a node of the tree; free tokens of a bin that counts as full.
LEAF_PIECES, FANOUT, SLACK = 40_000, 8, 8
#: Words, and parts of words, whose ids a worker remembers; parts encoded together.
KNOWN_WORDS, KNOWN_PARTS, TOGETHER = 700_000, 100_000, 4000
#: How this vocabulary cuts lower-cased ASCII words, parted by blanks, before it looks for tokens; a blank is a part too.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 ]+| ")



def _no_parts() -> list:
    """[number of each part, first id, ids per part, ids]; part 0 is the blank, which has none."""
    return [{" ": 0}, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)]


def _no_words() -> dict:
    """Hashes of words in order, their first id and number of ids, ids."""
    return {"known": np.zeros(0, np.uint64), "first": np.zeros(0, np.int64), "count": np.zeros(0, np.int32), "ids": np.zeros(0, np.uint32)}


def _state(path: str) -> dict:
    """The tokenizer and what it has told so far; a worker keeps one."""
    state = KEPT.setdefault("packing", {})
    if state.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task uses its own core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        last = np.zeros(1 + max(vocabulary.values()), bool)
        last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        state.clear()
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        state.update(path=path, tokenizer=tokenizer, last=last, special=special, parts=_no_parts(), **_no_words())
    return state


def _encode_apart(parts: list[str], path: str, cut: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all parts in a row, ids per part), encoded as one text with blanks between.

    A part that is `cut` as the vocabulary does ends with a token that ends a word, its
    only one; tokens of other words are told apart by where they lie.
    """
    state, ids, counts = _state(path), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i in range(0, len(parts), TOGETHER):
        some = parts[i:i + TOGETHER]
        text = " ".join(some)
        made = state["tokenizer"].encode(text, add_special_tokens=False)
        ids.append(np.array(made.ids, dtype=np.uint32))
        if cut:
            ends = np.flatnonzero(state["last"][ids[-1]]) + 1
            counts.append(np.diff(ends, prepend=0))
        else:
            starts = np.cumsum([0] + [len(p) + 1 for p in some[:-1]])
            begins = np.array(made.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            counts.append(np.bincount(np.searchsorted(starts, begins, side="right") - 1, minlength=len(some)))
    return np.concatenate(ids), np.concatenate(counts)


def _encode(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, ids per word); a word holds no white space, so its ids depend on it alone.

    ASCII words are lower-cased and cut as the vocabulary does, and each part is encoded
    once: `Word,` and `word` share one. Other words, and those that hold a special token,
    are parts of their own.
    """
    state = _state(path)
    every = " ".join(words)
    special = [s for s in state["special"] if s in every]
    plain = np.array([w.isascii() and not any(s in w for s in special) for w in words], bool)
    parts = _PARTS.findall(" ".join([w for w, p in zip(words, plain.tolist()) if p]).lower())
    others = [w for w, p in zip(words, plain.tolist()) if not p]
    known = state["parts"][0]
    fresh = [sorted(set(x).difference(known)) for x in (parts, others)]
    if len(known) + sum(map(len, fresh)) > KNOWN_PARTS:
        state["parts"] = _no_parts()
        fresh = [sorted(set(x).difference(" ")) for x in (parts, others)]
    number, first, count, held = state["parts"]
    for some, cut in zip(fresh, (True, False)):
        if some:
            ids, counts = _encode_apart(some, path, cut)
            number.update(zip(some, range(len(number), len(number) + len(some))))
            first = np.concatenate([first, len(held) + np.cumsum(counts) - counts])
            count, held = np.concatenate([count, counts]), np.concatenate([held, ids])
    state["parts"] = [number, first, count, held]
    at = np.array([number[p] for p in parts], np.int64)
    word = np.concatenate([np.flatnonzero(plain)[np.cumsum(at == 0)] if len(at) else np.zeros(0, np.int64), np.flatnonzero(~plain)])
    at = np.concatenate([at, np.array([number[p] for p in others], np.int64)])
    order = np.argsort(word, kind="stable")
    at, word = at[order], word[order]
    sizes = count[at]
    ends = np.cumsum(sizes)
    ids = held[np.arange(int(sizes.sum())) + np.repeat(first[at] - ends + sizes, sizes)]
    return ids, np.bincount(word, weights=sizes, minlength=len(words)).astype(np.int64)


def token_ids(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by id 0; ids per text).

    Texts are cut at white space, each distinct word is encoded once, and the ids are put
    together again; that equals the encoding of the whole text, since this vocabulary's
    tokens never cross white space (tests compare the two).
    """
    owner, starts, ends, hashes, data = hash_words(texts, keep_case=True)
    state = _state(path)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    known = state["known"]
    at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
    fresh = np.flatnonzero(known[at] != distinct) if len(known) else np.arange(len(distinct))
    if len(fresh):
        if len(known) + len(fresh) > KNOWN_WORDS:  # start anew with this slice's words
            fresh = np.arange(len(distinct))
            state.update(_no_words())
        raw = data.tobytes()
        ids, counts = _encode([raw[starts[i]:ends[i]].decode() for i in first[fresh]], path)
        begin = len(state["ids"]) + np.cumsum(counts) - counts
        place = np.searchsorted(state["known"], distinct[fresh])
        state.update(known=np.insert(state["known"], place, distinct[fresh]), first=np.insert(state["first"], place, begin),
                      count=np.insert(state["count"], place, counts), ids=np.concatenate([state["ids"], ids]))
        at = np.searchsorted(state["known"], distinct)
    first, count = state["first"][at][inverse], state["count"][at][inverse].astype(np.int64)
    total = int(count.sum())
    ends_at = np.cumsum(count)
    source = np.arange(total) + np.repeat(first - ends_at + count, count)
    out = np.zeros(total + len(texts), np.uint32)
    out[np.arange(total) + np.repeat(owner, count)] = state["ids"][source]
    return out, np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64) + 1


def pieces_of(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids, cut only if there are more than `capacity`.

    Map-only. A null or empty text is the one id 0. `vocabulary` is the path of a
    tokenizer file that every executor has.
    """
    kind = dict(documents.dtypes)[ident]

    def run(batches):
        for rows, texts in slices(batches, text, keep="packing"):
            ids, lengths = token_ids(texts, vocabulary)
            raw, begins = ids.astype("<u4").tobytes(), np.cumsum(lengths) - lengths
            pieces = -(-lengths // capacity)
            row = np.repeat(np.arange(len(texts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, lengths[row] - start)
            begin = begins[row] + start
            crc = [zlib.crc32(raw[4 * b:4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                [ident, "piece", "start", "length", "ids_crc32"])

    return documents.select(ident, text).mapInArrow(run, f"{ident} {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, largest first: (bin of each item, its offset there, fill of each bin)."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_bins: dict[int, list[int]] = {}
    frees: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(frees, size)
        if at == len(frees):
            b = len(fill)
            fill.append(0)
        else:
            free = frees[at]
            b = open_bins[free].pop()
            if not open_bins[free]:
                del open_bins[free]
                frees.pop(at)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        free = capacity - fill[b]
        if free:
            if free not in open_bins:
                open_bins[free] = []
                bisect.insort(frees, free)
            open_bins[free].append(b)
    return bins, offsets, np.array(fill, dtype=np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, size: str = "length", leaf_pieces: int = LEAF_PIECES,
         fanout: int = FANOUT, slack: int = SLACK) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`: each sequence holds at most `capacity`, without gaps.

    Pieces of the full size are sequences of their own and are not shuffled. A piece
    beyond the capacity or without a size is an error of the caller and fails the job.
    The others are dealt by hash to leaves of about `leaf_pieces`. After best-fit at most
    one bin of a leaf is half full or less, since two such would have met; only those can
    still move. So a node passes up its half-full bins and, of the fuller ones, as many
    as there are leaves, widest gap first: no more can ever be needed. The rest are done.
    A moved bin is a row of (bin, host, shift), joined at the end.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    wide = pieces.withColumn(size, F.when((F.col(size) > capacity) | (F.col(size) < 1) | F.col(size).isNull(),
                                          F.raise_error(F.lit("a piece does not fit"))).otherwise(F.col(size)))
    full = wide.filter(F.col(size) == capacity).withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")})
    small = wide.filter(F.col(size) < capacity)
    leaves = max(1, -(-small.count() // leaf_pieces))
    schema = small.schema

    def leaf(table: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in names if not pa.types.is_nested(table.schema.field(c).type)]
        table = table.sort_by(order).combine_chunks()  # the same bins if the task runs again
        node = table["node"][0].as_py()
        bins, offsets, fill = best_fit(table[size].to_numpy(), capacity)
        return table.drop_columns(["node"]).append_column("bin", pa.array((node << 40) + bins)).append_column("offset", pa.array(offsets)).append_column("fill", pa.array(fill[bins]))

    placed = cut_lineage(small.withColumn("node", F.pmod(F.hash(*[c for c in names]), F.lit(leaves)).cast("long")).groupBy("node").applyInArrow(
        leaf, _with(schema, "bin long, offset long, fill long")))
    underfull = placed.filter(F.col("fill") < capacity - slack).select("bin", "fill").distinct().withColumn("node", F.shiftright("bin", 40))

    def node_pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin").combine_chunks()
        names_of, fills, parent = table["bin"].to_numpy(), table["fill"].to_numpy(), table["up"][0].as_py()
        bins, offsets, fill = best_fit(fills, capacity)
        host = np.zeros(len(fill), np.int64)
        host[bins[offsets == 0]] = names_of[offsets == 0]
        moved = np.flatnonzero(offsets > 0)
        half = np.flatnonzero(fill <= capacity // 2)
        gaps = np.flatnonzero((fill > capacity // 2) & (fill < capacity - slack))
        gaps = gaps[np.argsort(fill[gaps], kind="stable")[:leaves]]
        left = np.concatenate([half, gaps])
        n, k = len(moved), len(left)
        return pa.table({"bin": np.concatenate([names_of[moved], host[left]]), "host": pa.array(host[bins[moved]].tolist() + [None] * k, pa.int64()),
                         "shift": pa.array(offsets[moved].tolist() + [0] * k, pa.int64()),
                         "fill": pa.array([0] * n + fill[left].tolist(), pa.int64()), "node": pa.array([parent] * (n + k), pa.int64())})

    rounds, nodes = [], leaves
    while nodes > 1:
        nodes = -(-nodes // fanout)
        done = cut_lineage(underfull.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).select("bin", "fill", "up").groupBy("up").applyInArrow(
            node_pack, "bin long, host long, shift long, fill long, node long"))
        rounds.append(done.filter("host IS NOT NULL").select("bin", "host", "shift"))
        underfull = done.filter("host IS NULL").select("bin", "fill", "node")
    for moves in rounds:
        placed = placed.join(moves, "bin", "left").withColumns(
            {"offset": F.col("offset") + F.coalesce("shift", F.lit(0)), "bin": F.coalesce("host", "bin")}).drop("host", "shift")
    packed = placed.withColumn("sequence_id", F.col("bin") * 2 + 1)
    return full.select(*names, "sequence_id", "offset").unionByName(packed.select(*names, "sequence_id", "offset"))


def _with(schema, more: str):
    from pyspark.sql import types as T

    return T.StructType(list(schema.fields) + list(T.StructType.fromDDL(more).fields))


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, ident: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Documents to pieces to sequences; the piece table is written once and read again."""
    return pack(cut_lineage(pieces_of(documents, vocabulary, capacity, ident, text)), capacity, **how)
