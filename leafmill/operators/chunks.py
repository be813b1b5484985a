"""Sections, windows and chunks, computed inside the row."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import fixed_values as fv
from leafmill.functions import text as tx
from leafmill.functions.ordered import number_within, position_bucket

CUT, SHIELD = "\uffff", "\ufffe"  # Unicode noncharacters: the mark of a cut while a text is being split, and its escape


def shielded(text: Column) -> Column:
    """The text without CUT: both noncharacters become SHIELD and a digit, which `unshielded` undoes."""
    return F.replace(F.replace(text, F.lit(SHIELD), F.lit(SHIELD + "0")), F.lit(CUT), F.lit(SHIELD + "1"))


def unshielded(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(SHIELD + "1"), F.lit(CUT)), F.lit(SHIELD + "0"), F.lit(SHIELD))


def structural_sections(text: Column) -> Column:
    """Sections between blank lines, dash lines and one-word headings."""
    s, nonspace = tx.INLINE_SPACE, r"[^\s\x1c-\x1f]"
    heading = rf"(?:#{{1,6}}|\d+(?:\.\d+){{0,3}}[.)]){s}+{nonspace}+"
    marked = F.regexp_replace(shielded(text), r"\r\n?", "\n")
    marked = F.regexp_replace(marked, rf"(?dmU){s}+$", "")
    marked = F.regexp_replace(marked, rf"(?dmU)^{s}*(?:-{{3,}})?$", CUT)
    marked = F.regexp_replace(marked, rf"(?dmU)^{s}*({heading})$", f"{CUT}$1{CUT}")
    marked = F.regexp_replace(marked, rf"(?dmU)^{s}+(\|.*\|)$", "$1")
    parts = F.transform(F.split(marked, CUT), lambda p: tx.strip(unshielded(p)))
    return F.filter(parts, lambda p: p != "")


def merge_small(sections: Column, min_tokens: int = fv.MIN_SECTION_TOKENS) -> Column:
    """Carry sections forward until they hold `min_tokens`; a small tail joins the last."""
    if min_tokens <= 0:
        return sections
    empty = F.struct(tx.no_strings().alias("done"), F.lit(None).cast("string").alias("carry"))

    def step(state, section):
        grown = F.concat_ws("\n\n", state["carry"], section)
        return tx.let(F.struct(grown.alias("text"), (tx.token_length(grown) >= min_tokens).alias("enough")), lambda g: F.struct(
            F.when(g["enough"], F.concat(state["done"], F.array(g["text"]))).otherwise(state["done"]).alias("done"),
            F.when(~g["enough"], g["text"]).alias("carry")))

    def finish(state):
        done, carry = state["done"], state["carry"]
        with_tail = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                             F.array(F.concat_ws("\n\n", F.try_element_at(done, F.lit(-1)), carry)))
        return F.when(carry.isNull(), done).otherwise(with_tail)

    stripped = F.filter(F.transform(sections, tx.strip), lambda s: s != "")
    return F.aggregate(stripped, empty, step, finish)


def word_windows(words: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Windows of `size` words, one every max(1, size - overlap) words."""
    step = F.lit(max(1, size - overlap))

    def windows(w):
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), step)
        joined = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(F.size(w) == 0, tx.no_strings()).otherwise(joined)

    return tx.let(words, windows)


def separator_split(text: Column, size: int = fv.CHUNK_SIZE) -> Column:
    """Pieces of at most `size` tokens, cut at the strongest separator that will do.

    One pass per separator, strongest first: a piece that is too long is cut
    after each separator and packed again as full as possible. What no
    separator can cut is cut by length. Joined, the pieces are the text.
    """
    pieces = F.when(tx.strip(text) == "", tx.no_strings()).otherwise(F.array(text))
    too_long = lambda p: tx.token_length(p) > size

    def pack(parts):
        empty = F.struct(tx.no_strings().alias("done"), F.lit("").alias("open"))

        def step(state, part):
            grown = F.concat(state["open"], part)
            return tx.let(~too_long(grown) | (state["open"] == ""), lambda fits: F.struct(
                F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"),
                F.when(fits, grown).otherwise(part).alias("open")))

        return F.aggregate(parts, empty, step, lambda s: F.concat(s["done"], F.array(s["open"])))

    def cut_after(mark):
        return lambda p: F.when(too_long(p), pack(F.split(p, mark))).otherwise(F.array(p))

    for separator in fv.SEPARATORS:
        mark = "(?<=" + "".join("\\" + ch if ch in ".?" else ch for ch in separator) + ")"
        pieces = F.flatten(F.transform(pieces, cut_after(mark)))
    width = size * 4
    by_length = lambda p: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1)), F.lit(width)), lambda i: p.substr(i, F.lit(width)))
    return F.flatten(F.transform(pieces, lambda p: F.when(too_long(p), by_length(p)).otherwise(F.array(p))))


def _windows(parts: list[str], size: int, overlap: int, length) -> list[str]:
    """Neighbouring parts joined while they fit; a new window starts with the last parts of the one before, up to `overlap` tokens of them."""
    sizes = [length(p) for p in parts]
    out, first, held = [], 0, 0
    for i, more in enumerate(sizes):
        if i > first and held + more > size:
            out.append("".join(parts[first:i]))
            while held > overlap or (held and held + more > size):
                held -= sizes[first]
                first += 1
        held += more
    if parts:
        out.append("".join(parts[first:]))
    return [w for w in (w.strip() for w in out) if w]


def _recursive(text: str, separators: list[str], size: int, overlap: int, length) -> list[str]:
    """Windows of the parts between the strongest separator that occurs; parts that do not fit are cut by the weaker ones."""
    at = next((k for k, mark in enumerate(separators) if mark in text), len(separators))
    if at == len(separators):
        parts, weaker = list(text), None
    else:
        mark, weaker = separators[at], separators[at + 1:]
        head, *tail = text.split(mark)
        parts = [p for p in (head, *(mark + x for x in tail)) if p]
    out, fitting = [], []
    for part in parts:
        if length(part) < size or weaker is None:
            fitting.append(part)
            continue
        out += _windows(fitting, size, overlap, length)
        fitting = []
        out += _recursive(part, weaker, size, overlap, length)
    return out + _windows(fitting, size, overlap, length)


def split_recursively(df: DataFrame, column: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, whole: bool = True) -> DataFrame:
    """`df` with the array of texts in `column` replaced by the array of their overlapping pieces, in order.

    Texts are cut at the strongest separator that occurs (SEPARATORS, then single
    characters), and a part that does not fit by the weaker ones. A separator stays with
    the part after it, and pieces are stripped; empty ones go. Of a piece its last whole
    parts, up to `overlap` tokens, open the next one. With `whole`, a text that fits is one
    piece as it stands. The cuts depend on each other from part to part, which no built-in
    function carries on, so rows go through Arrow. Null counts as no texts.
    """
    separators, at = list(fv.SEPARATORS), df.columns.index(column)

    def length(text):
        n = len(text.strip())
        return max(1, n // 4) if n else 0

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for given in batch.column(at):
                pieces: list[str] = []
                for text in given.as_py() or ():
                    if text and text.strip():
                        pieces += [text] if whole and length(text) <= size else _recursive(text, separators, size, overlap, length)
                out.append(pieces)
            yield batch.set_column(at, column, pa.array(out, pa.list_(pa.string())))

    return df.mapInArrow(cut, df.schema)


def split_long(text: Column, size: int, overlap: int, splitter: str) -> Column:
    if splitter == "separators":
        long = F.filter(F.transform(separator_split(text, size), tx.strip), lambda p: p != "")
    else:
        long = word_windows(tx.words(text), size, overlap)
    return F.when(tx.token_length(text) <= size, F.array(text)).otherwise(long)


def text_sections(text: Column, strategy: str = "hybrid", min_tokens: int = fv.MIN_SECTION_TOKENS) -> Column:
    """What of a text is cut apart: itself for strategy `token`, else its sections, small ones merged."""
    text = F.coalesce(text, F.lit(""))
    if strategy.lower().strip() == "token":
        return F.filter(F.array(tx.strip(text)), lambda s: s != "")
    return merge_small(structural_sections(text), min_tokens)


def text_chunks(text: Column, strategy: str = "hybrid", size: int = 0, overlap: int = 0,
                min_tokens: int = fv.MIN_SECTION_TOKENS, splitter: str = "windows") -> Column:
    """The chunks of a whole text as an array. 0 for size or overlap means the default; `recursive` needs `chunk_texts`."""
    if splitter not in ("windows", "separators"):
        raise ValueError("splitter must be windows or separators")
    size, overlap = size or fv.CHUNK_SIZE, overlap or fv.CHUNK_OVERLAP
    sections = text_sections(text, strategy, min_tokens)
    return F.flatten(F.transform(sections, lambda s: split_long(s, size, overlap, splitter)))


PAGE_BREAK = re.compile(r"-{3,}")
HEADING = re.compile(r"(?:#{1,6}|\d+(?:\.\d+){0,3}[.)])\s+\S+")


def _sections(text: str, min_tokens: int) -> list[str]:
    """`merge_small(structural_sections(text))` of one text."""
    found: list[str] = []
    lines: list[str] = []

    def flush():
        section = "\n".join(lines).strip()
        lines.clear()
        if section:
            found.append(section)

    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        bare = line.strip()
        if not bare or PAGE_BREAK.fullmatch(bare):
            flush()
        elif HEADING.fullmatch(bare):
            flush()
            found.append(bare)
        else:
            lines.append(bare if len(bare) > 1 and bare[0] == bare[-1] == "|" else line.rstrip())
    flush()
    if min_tokens <= 0:
        return found
    merged: list[str] = []
    carry = ""
    for section in found:
        carry = f"{carry}\n\n{section}" if carry else section
        if _tokens(carry) >= min_tokens:
            merged.append(carry)
            carry = ""
    if carry:
        merged[-1:] = [f"{merged[-1]}\n\n{carry}"] if merged else [carry]
    return merged


def _tokens(text: str) -> int:
    n = len(text.strip())
    return max(1, n // 4) if n else 0


def cut_to_windows(df: DataFrame, column: str, size: int, overlap: int, sections: Callable[[str], list[str]]) -> DataFrame:
    """`df` with the text in `column` replaced by the array of its chunks: sections that fit as they are, word windows of the others.

    The same as `text_chunks`, without the cost of carrying each text through nested
    expressions: rows go through Arrow. Null counts as no text.
    """
    at, step = df.columns.index(column), max(1, size - overlap)
    out = T.StructType([T.StructField(f.name, T.ArrayType(T.StringType())) if f.name == column else f for f in df.schema.fields])

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for text in batch.column(at).to_pylist():
                pieces: list[str] = []
                for section in sections(text) if text else ():
                    if _tokens(section) <= size:
                        pieces.append(section)
                    else:
                        words = section.split()
                        pieces += [" ".join(words[i:i + size]) for i in range(0, len(words), step)]
                found.append(pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.list_(pa.string())), *batch.columns[at + 1:]], out.names)

    return df.mapInArrow(cut, out)


def _whole(text: str) -> list[str]:
    return [x for x in (text.strip(),) if x]


def piece_count(text: str | None, size: int, overlap: int) -> int:
    """How many chunks `chunk_blocks` cuts of a block's text by windows."""
    tokens = _tokens(text) if text else 0
    return min(tokens, 1) if tokens <= size else -(-len(text.split()) // max(1, size - overlap))


def chunk_lists(docs: DataFrame, keys: list[str], text_col: str, splitter: str = "windows", strategy: str = "hybrid", size: int = 0, overlap: int = 0,
                min_tokens: int = fv.MIN_SECTION_TOKENS) -> DataFrame:
    """`keys`, pieces: the chunks of each text as an array. `splitter`: windows, separators or recursive."""
    full = size or fv.CHUNK_SIZE, overlap or fv.CHUNK_OVERLAP
    if splitter == "recursive":
        return split_recursively(docs.select(*keys, text_sections(F.col(text_col), strategy, min_tokens).alias("pieces")), "pieces", *full)
    if splitter == "windows":
        sections = _whole if strategy.lower().strip() == "token" else partial(_sections, min_tokens=min_tokens)
        return cut_to_windows(docs.select(*keys, F.col(text_col).alias("pieces")), "pieces", *full, sections)
    return docs.select(*keys, text_chunks(F.col(text_col), strategy, size, overlap, min_tokens, splitter).alias("pieces"))


def chunk_texts(docs: DataFrame, keys: list[str], text_col: str, splitter: str = "windows", **params) -> DataFrame:
    """`keys`, chunk_idx, content, token_cnt: one row per chunk, a map-only job. `splitter`: windows, separators or recursive."""
    cut = chunk_lists(docs, keys, text_col, splitter, **params)
    return cut.select(*keys, F.posexplode("pieces").alias("chunk_idx", "content")).withColumn("token_cnt", tx.token_length(F.col("content")))


BLOCK_FIELDS = ["page_number", "sheet_name", "slide_number", "section_path", "language"]


def chunk_blocks(blocks: DataFrame, size: int = 0, overlap: int = 0, splitter: str = "windows",
                 doc: str = "doc_id", first: str | None = None) -> DataFrame:
    """Chunks of blocks with the block's own fields, numbered along the document.

    `first` names a column with the number of a block's first chunk, counted for the same
    size and overlap by windows (`blocks.numbered_blocks`): its chunks are numbered where they lie.
    Blocks where it is null are numbered by a shuffle.
    """
    if first:
        placed = _block_pieces(blocks.filter(F.col(first).isNotNull()), size, overlap, "windows", doc, [first])
        placed = placed.withColumn("chunk_idx", F.col(first) + F.col("part"))
        other = chunk_blocks(blocks.filter(F.col(first).isNull()), size, overlap, "windows", doc)
        return placed.withColumn("token_cnt", tx.token_length(F.col("content"))).drop(first, "part").unionByName(other)
    parts = _block_pieces(blocks, size, overlap, splitter, doc).withColumn("_bucket", position_bucket(F.col("block_idx")))
    numbered = number_within(parts, [doc], ["block_idx", "part"], "_bucket", "chunk_idx")
    return numbered.withColumn("token_cnt", tx.token_length(F.col("content"))).drop("_bucket", "part")


def _block_pieces(blocks: DataFrame, size: int, overlap: int, splitter: str, doc: str, carry: list[str] | None = None) -> DataFrame:
    """The chunks of each block, `part` counting them from 0."""
    size, overlap = size or fv.CHUNK_SIZE, overlap or fv.CHUNK_OVERLAP
    body = blocks.withColumn("_text", tx.strip(F.coalesce("source_text", F.lit("")))).filter("_text <> ''")
    fields = [*[c for c in BLOCK_FIELDS if c in blocks.columns], *(carry or [])]
    own = [doc, "block_idx", F.col("block_type").alias("chunk_type"), *fields]
    if splitter == "recursive":
        cut = split_recursively(body.select(*own, F.array("_text").alias("_pieces")), "_pieces", size, overlap)
    elif splitter == "windows":
        cut = cut_to_windows(body.select(*own, F.col("_text").alias("_pieces")), "_pieces", size, overlap, _whole)
    else:
        cut = body.select(*own, split_long(F.col("_text"), size, overlap, splitter).alias("_pieces"))
    parts = cut.select(*[c for c in cut.columns if c != "_pieces"], F.posexplode("_pieces").alias("part", "content"))
    return parts.filter("content <> ''")


def chunk_documents(docs: DataFrame, blocks: DataFrame, text_col: str, **params) -> DataFrame:
    """Chunks from a document's blocks where it has any, else from its raw text."""
    doc = "doc_id"
    from_blocks = chunk_blocks(blocks, **{k: v for k, v in params.items() if k in ("size", "overlap", "splitter")})
    bare = docs.join(blocks.select(doc).distinct(), doc, "left_anti")
    from_text = chunk_texts(bare, [doc], text_col, **params)
    return from_blocks.unionByName(
        from_text.withColumn("chunk_idx", F.col("chunk_idx").cast("long")).withColumn("chunk_type", F.lit("text")),
        allowMissingColumns=True)
