"""Typed blocks from page text, cell grids, sheets and slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leafmill.functions import fixed_values as fv
from leafmill.functions import text as tx
from leafmill.functions.ordered import nearest_in_order, number_within, position_bucket
from leafmill.operators.chunks import CUT, piece_count, shielded, unshielded

DOCUMENTS = 256  # documents whose block texts a task holds as Python objects at a time

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CAPTION = rf"(?iu)\A(?U)[\s\x1c-\x1f]*{fv.CAPTION_LEADS}"


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def split_pages(docs: DataFrame, keys: list[str], markdown: str) -> DataFrame:
    """Pages between `---` lines; numbers count blank pieces, which are then dropped."""
    pieces = F.posexplode(F.split(markdown, fv.PAGE_MARK)).alias("at", "piece")
    pages = docs.select(*keys, pieces)
    return (pages.select(*keys, (F.col("at") + 1).alias("page_num"), tx.strip(F.col("piece")).alias("text"))
            .filter("text <> ''"))


def block_array(markdown: Column) -> Column:
    """array<struct<block_type, source_text, section_path>> of one page, in order."""
    s = tx.INLINE_SPACE
    marked = F.regexp_replace(shielded(F.coalesce(markdown, F.lit(""))), LINE_END, "\n")
    marked = F.regexp_replace(marked, rf"(?dmU)^{s}+|{s}+$", "")
    marked = F.regexp_replace(marked, r"(?dm)^$", CUT)
    single = rf"(?dmiu)^((?:{fv.CAPTION_LEADS}|#).*)$"
    marked = F.regexp_replace(marked, single, f"{CUT}$1{CUT}")
    marked = F.regexp_replace(marked, r"(?dm)((?:^\|(?:.*\|)?$\n?)+)", f"{CUT}$1{CUT}")
    parts = F.filter(F.transform(F.split(marked, CUT), lambda p: tx.strip(unshielded(p))), lambda p: p != "")

    def typed(part):
        heading = part.startswith("#")
        kind = (F.when(part.rlike(r"\A\|(?:[^\n]*\|)?(?:\n|\z)"), "table")
                .when(is_caption(part), "caption").otherwise("text"))
        path = F.when(heading, tx.strip(F.regexp_replace(part, r"\A[# ]+", "")))
        return F.struct(kind.alias("block_type"), part.alias("source_text"), path.alias("section_path"))

    return F.transform(parts, typed)


def page_blocks(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """Blocks of a table of pages, numbered along each document."""
    parts = pages.select(doc, F.col(page).alias("page_number"),
                         F.posexplode(block_array(F.col(text))).alias("_at", "b"))
    flat = parts.select(doc, "page_number", "_at", "b.*").withColumn(
        "_bucket", position_bucket(F.col("page_number"), 64))
    return number_within(flat, [doc], ["page_number", "_at"], "_bucket", "block_idx").drop("_at", "_bucket")


def image_text(prefix: str, index: Column, page: Column) -> Column:
    return F.concat(F.lit(prefix + " "), index.cast("string"), F.lit(" from page "),
                    F.coalesce(F.nullif(page, F.lit(0)), F.lit(1)).cast("string"))


def parsed_blocks(parsed: DataFrame, prefix: str = "Extracted image") -> DataFrame:
    """All blocks of parsed documents, one document a row, image placeholders last.

    `parsed` needs doc_id, markdown, pages array<struct<page_num, text>> and
    images array<struct<path, page_num>>. Map-only: numbering needs no shuffle.
    """
    rows = parsed.select("doc_id", parsed_block_array(prefix).alias("blocks"))
    return rows.select("doc_id", F.posexplode("blocks").alias("block_idx", "b")).select("doc_id", "block_idx", "b.*")


def parsed_block_array(prefix: str = "Extracted image") -> Column:
    """All blocks of a parsed document as an array, in order."""
    whole = F.array(F.struct(F.lit(None).cast("int").alias("page_num"), F.col("markdown").alias("text")))
    pages = F.when(F.coalesce(F.size("pages"), F.lit(0)) > 0, F.col("pages")).otherwise(whole)
    block = ("array<struct<block_type:string,source_text:string,section_path:string,"
             "page_number:int,image_index:int,image_type:string>>")

    def of_page(page):
        return F.transform(block_array(page["text"]), lambda b: F.struct(
            b["block_type"].alias("block_type"), b["source_text"].alias("source_text"),
            b["section_path"].alias("section_path"), page["page_num"].cast("int").alias("page_number"),
            F.lit(None).cast("int").alias("image_index"), F.lit(None).cast("string").alias("image_type")))

    def placeholder(image, i):
        page = F.nullif(image["page_num"], F.lit(0)).cast("int")
        return F.struct(
            F.lit("image").alias("block_type"), image_text(prefix, i + 1, page).alias("source_text"),
            F.lit(None).cast("string").alias("section_path"), page.alias("page_number"),
            (i + 1).alias("image_index"),
            F.regexp_extract(image["path"], r"\.([^./]*)\z", 1).alias("image_type"))

    images = F.coalesce(F.transform("images", placeholder), F.array().cast(block))
    return F.concat(F.flatten(F.transform(pages, of_page)).cast(block), images.cast(block))


def link_captions(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Give each image the nearest caption on its page or slide; ties take the earlier.

    Only the last caption before and the first after an image can be nearest,
    so running columns per (document, page) and per (document, slide) replace a
    join of images with captions. Other blocks take no part. Two missing pages
    count as equal.
    """
    marks = blocks.filter(F.col("block_type").isin("caption", "image")).withColumn(
        "_bucket", position_bucket(F.col("block_idx")))
    caption = F.when(F.col("block_type") == "caption", F.struct("block_idx", "source_text"))
    work = nearest_in_order(marks, [doc, "page_number"], ["block_idx"], "_bucket", caption, "_page_before", "_page_after")
    options = ["_page_before", "_page_after"]
    if "slide_number" in blocks.columns:
        work = work.withColumn("_slide", F.nullif(F.col("slide_number"), F.lit(0)))
        work = nearest_in_order(work, [doc, "_slide"], ["block_idx"], "_bucket", F.when(F.col("_slide").isNotNull(), caption),
                                "_slide_before", "_slide_after")
        options += ["_slide_before", "_slide_after"]

    def option(name):
        c = F.col(name)
        return F.when(c.isNotNull(), F.struct(
            F.abs(c["block_idx"] - F.col("block_idx")).alias("distance"),
            c["block_idx"].alias("parent_block_idx"), c["source_text"].alias("caption_text")))

    nearest = F.array_min(F.array(*[option(o) for o in options]))
    links = work.filter("block_type = 'image'").select(doc, "block_idx", nearest.alias("_near")).select(
        doc, "block_idx", "_near.parent_block_idx", "_near.caption_text").filter("parent_block_idx IS NOT NULL")
    text, found = F.col("source_text"), F.col("caption_text")
    add = found.isNotNull() & (found != "") & ~F.contains(text, found)
    linked = F.when(add, tx.strip(F.concat(text, F.lit("\nCaption: "), found))).otherwise(text)
    return blocks.join(links, [doc, "block_idx"], "left").withColumn("source_text", linked)


def finish_blocks(blocks: DataFrame) -> DataFrame:
    """Add the searchable form of each block's text."""
    return blocks.withColumn("normalized_text", tx.normalise_in_batches(F.col("source_text")))


def numbered_blocks(parsed: DataFrame, alone: str, size: int = 0, overlap: int = 0, prefix: str = "Extracted image") -> DataFrame:
    """`finish_blocks` of `parsed_blocks`, and `first_chunk`: the number that the block's first chunk has in its document.

    A document's blocks are in its row here, so that `chunk_blocks` needs no shuffle of
    texts to number them. `alone` names a column that is true where no other row has the
    document's id; elsewhere first_chunk is null.
    """
    size, overlap = size or fv.CHUNK_SIZE, overlap or fv.CHUNK_OVERLAP
    rows = parsed.select("doc_id", F.col(alone).alias("alone"), parsed_block_array(prefix).alias("blocks"))
    out = T.StructType([rows.schema["doc_id"], T.StructField("block_idx", T.IntegerType()), *rows.schema["blocks"].dataType.elementType.fields,
                        T.StructField("normalized_text", T.StringType()), T.StructField("first_chunk", T.LongType())])
    schema = to_arrow_schema(out)
    at = out.names.index("source_text") - 2

    def finish(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, DOCUMENTS):
                docs = batch.slice(start, DOCUMENTS)
                lists = docs.column("blocks")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                fields = lists.flatten().flatten()
                texts = fields[at].to_pylist()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                opens = (np.cumsum(sizes) - sizes)[owner]
                count = np.fromiter((piece_count(x, size, overlap) for x in texts), np.int64, len(texts))
                before = np.cumsum(count) - count
                first = before - before[opens]
                single = docs.column("alone").fill_null(False).to_numpy(zero_copy_only=False)[owner]
                yield pa.RecordBatch.from_arrays([
                    docs.column("doc_id").take(pa.array(owner)), pa.array((np.arange(len(texts)) - opens).astype(np.int32)),
                    *[f.cast(schema.field(i + 2).type) for i, f in enumerate(fields)],
                    pa.array([tx.normalised(x) for x in texts], pa.string()), pa.array(first, mask=~single)], schema=schema)

    return rows.mapInArrow(finish, out)


def raw_text(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One text per document: its text, table and caption blocks, blank lines between."""
    body = blocks.withColumn("_text", tx.strip(F.coalesce("source_text", F.lit("")))).filter(
        F.col("block_type").isin("text", "table", "caption") & (F.col("_text") != ""))
    ordered = F.sort_array(F.collect_list(F.struct("block_idx", "_text")))
    return body.groupBy(doc).agg(
        F.array_join(F.transform(ordered, lambda b: b["_text"]), "\n\n").alias("raw_text"))


# --- grids, sheets, slides --------------------------------------------------

def grid_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Markdown tables from (keys, row, col, text); body rows take the header's width."""
    rows = cells.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("r"))
    rows = rows.select(*keys, "row", F.transform("r", lambda c: F.coalesce(c["text"], F.lit(""))).alias("texts"))
    first = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "texts"))).alias("rows"))
    width = F.size(F.col("rows")[0]["texts"])
    bar = lambda texts: F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))
    fit = lambda texts: F.slice(F.concat(texts, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    lines = F.transform("rows", lambda r: bar(fit(r["texts"])))
    rule = bar(F.array_repeat(F.lit("---"), width))
    return first.select(*keys, F.array_join(F.concat(
        F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n").alias("source_text"))


def sheet_blocks(cells: DataFrame, doc: str = "doc_id", sheet: str = "sheet_name") -> DataFrame:
    """One table block per sheet from (doc, sheet, row, col, value); blank rows dropped."""
    rows = cells.groupBy(doc, sheet, "row").agg(F.sort_array(F.collect_list(
        F.struct("col", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("v")))).alias("r"))
    rows = rows.select(doc, sheet, "row", F.transform("r", lambda c: c["v"]).alias("v"))
    rows = rows.filter(F.exists("v", lambda v: tx.strip(v) != ""))
    sheets = rows.groupBy(doc, sheet).agg(F.sort_array(F.collect_list(
        F.struct("row", F.array_join("v", " | ").alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return sheets.select(
        doc, sheet, F.lit("table").alias("block_type"), F.lit(1).alias("page_number"),
        F.concat(F.lit("Sheet:"), F.col(sheet)).alias("section_path"),
        tx.strip(F.concat(F.lit("## Sheet: "), F.col(sheet), F.lit("\n\n"), body)).alias("source_text"))


def slide_texts(parts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One text per deck from (doc, slide_number, pos, text)."""
    slides = parts.groupBy(doc, "slide_number").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    slides = slides.select(doc, "slide_number", F.concat(
        F.lit("## Slide "), F.col("slide_number").cast("string"), F.lit("\n\n"), body).alias("slide_text"))
    decks = slides.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("slide_number", "slide_text"))).alias("s"))
    return decks.select(doc, F.array_join(F.transform("s", lambda x: x["slide_text"]), "\n\n").alias("deck_text"))


def route_by_type(files: DataFrame, file_type: str = "type") -> DataFrame:
    """Which reader takes a file; what no reader takes becomes a failed row."""
    kind = F.lower(file_type)
    reader = (F.when(kind.isin(fv.PAGE_READER_TYPES), "pages").when(kind == "docx", "document")
              .when(kind.isin("xlsx", "xls"), "sheets").when(kind == "pptx", "slides"))
    return (files.withColumn("reader", reader)
            .withColumn("error_msg", F.when(reader.isNull(), F.concat(F.lit("Unsupported file type: ."), kind)))
            .withColumn("status", F.when(reader.isNull(), "failed").otherwise("processing")))
