"""Pages, blocks, grids, sheets and slides (A4, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import part, query, sql
from checks.standins import t
from leafmill.operators import blocks as bk
from leafmill.sources import files as fl


def longs(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


@query("a4_parsed_pages", sql("page_lines", body="""
  SELECT doc_id, page - 1 AS pos, page AS page_num, CASE WHEN lang = 'en' THEN 'Figure ' || page || chr(10) || line ELSE line END AS text
  FROM page_lines"""))
def a4(spark, sf):
    return longs(fl.parsed_pages(s.parsed(spark, sf)), "pos", "page_num")


@query("c1_page_split", sql("page_lines", body=f"SELECT doc_id, page AS page_num, {s.sql_strip('line')} AS text FROM page_lines WHERE {s.sql_strip('line')} <> ''"))
def c1(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n---\n").alias("md"))
    return longs(bk.split_pages(docs, ["doc_id"], "md"), "page_num")


# lines of a markdown text to blocks, by islands of lines
def sql_blocks(source: str) -> str:
    line = s.sql_strip("line")
    return f"""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS pos,
         CASE kind WHEN 'head' THEN 'text' ELSE kind END AS block_type, string_agg(line, chr(10) ORDER BY i) AS source_text,
         CASE WHEN kind = 'head' THEN trim(ltrim(min(line), '# ')) END AS section_path FROM (
    SELECT *, sum(CASE WHEN kind IN ('head', 'caption') OR kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
    FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
      SELECT *, CASE WHEN line = '' THEN 'blank' WHEN line LIKE '|%' AND line LIKE '%|' THEN 'table'
             WHEN regexp_matches(line, '(?i)^(figure|fig\\.|table|표|그림)') THEN 'caption' WHEN line LIKE '#%' THEN 'head' ELSE 'text' END AS kind
      FROM (SELECT doc_id, i, {line} AS line FROM {source})))) WHERE kind <> 'blank' GROUP BY doc_id, island, kind"""


part("doc_lines", """SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM sentences)""", "sentences")


def blocks_of(df, text):
    return longs(df.select("doc_id", F.posexplode(bk.block_array(F.col(text))).alias("pos", "b")).select(
        "doc_id", "pos", "b.block_type", "b.source_text", "b.section_path"), "pos")


@query("c2_blocks_of_documents", sql("doc_lines", body=sql_blocks("doc_lines")))
def c2a(spark, sf):
    return blocks_of(s.sentences(spark, sf), "text")


part("order_md", """
  SELECT doc_id, '# Order ' || doc_id || chr(10) || 'priority' || chr(10) || o_orderpriority || chr(10) || chr(10)
         || 'Table ' || doc_id || ' lines' || chr(10) || source_text || chr(10) || 'status ' || o_orderstatus AS md
  FROM grid_md JOIN orders ON o_orderkey = doc_id""", "grid_md")
part("order_lines", """SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(md, chr(10)) AS ls FROM order_md)""", "order_md")


def order_markdown(spark, sf):
    grids = bk.grid_tables(s.cells(spark, sf), ["doc_id"])
    orders = t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority", "o_orderstatus")
    key = F.col("doc_id").cast("string")
    return grids.join(orders, "doc_id").select("doc_id", F.concat(
        F.lit("# Order "), key, F.lit("\npriority\n"), "o_orderpriority", F.lit("\n\nTable "), key, F.lit(" lines\n"),
        "source_text", F.lit("\nstatus "), "o_orderstatus").alias("md"))


@query("c2_blocks_of_order_sheets", sql("order_lines", body=sql_blocks("order_lines")))
def c2b(spark, sf):
    return blocks_of(order_markdown(spark, sf), "md")


@query("c3_caption_lines", sql("order_lines", body="""
  SELECT doc_id, i - 1 AS line_no FROM order_lines WHERE regexp_matches(line, '(?i)^\\s*(figure|fig\\.|table|표|그림)')"""))
def c3(spark, sf):
    lines = order_markdown(spark, sf).select("doc_id", F.posexplode(F.split("md", "\n")).alias("line_no", "line"))
    return longs(lines.filter(bk.is_caption(F.col("line"))).select("doc_id", "line_no"), "line_no")


@query("c4_grid_tables", sql("grid_md", body="SELECT * FROM grid_md"))
def c4(spark, sf):
    return bk.grid_tables(s.cells(spark, sf), ["doc_id"])


@query("c5_sheet_blocks", sql("grid", body="""
  SELECT doc_id, sheet_name, 'table' AS block_type, 1::BIGINT AS page_number, 'Sheet:' || sheet_name AS section_path,
         '## Sheet: ' || sheet_name || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY r) AS source_text FROM (
    SELECT doc_id, CASE WHEN c IS NULL THEN 'short' WHEN has_d THEN 'long' ELSE 'full' END AS sheet_name, r,
           a || ' | ' || b || CASE WHEN c IS NOT NULL THEN ' | ' || c ELSE '' END || CASE WHEN has_d THEN ' | cut' ELSE '' END AS line
    FROM grid) GROUP BY doc_id, sheet_name"""))
def c5(spark, sf):
    cells = s.cells(spark, sf).filter("row > 0")
    width = cells.groupBy("doc_id", "row").agg(F.max("col").alias("w"))
    sheet = F.when(F.col("w") == 1, "short").when(F.col("w") == 3, "long").otherwise("full")
    cells = cells.join(width, ["doc_id", "row"]).select("doc_id", sheet.alias("sheet_name"), "row", "col", F.col("text").alias("value"))
    return longs(bk.sheet_blocks(cells), "page_number")


@query("c6_slide_texts", """
  SELECT conv_id AS doc_id, string_agg('## Slide ' || (turn + 1) || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)),
         chr(10) || chr(10) ORDER BY turn) AS deck_text FROM conversations GROUP BY conv_id""")
def c6(spark, sf):
    parts = t(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("slide_number"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return bk.slide_texts(parts)


@query("c7_image_placeholders", sql("parsed_blocks", body="""
  SELECT doc_id, block_idx, source_text, page_number, page_number AS image_index FROM parsed_blocks WHERE block_type = 'image'"""))
def c7(spark, sf):
    rows = bk.parsed_blocks(s.parsed(spark, sf)).filter("block_type = 'image'")
    return longs(rows.select("doc_id", "block_idx", "source_text", "page_number", "image_index"), "block_idx", "page_number", "image_index")


@query("c8_nearest_caption", sql("parsed_blocks", body="""
  SELECT i.doc_id, i.block_idx, arg_min(c.block_idx, abs(c.block_idx - i.block_idx) * 1000000 + c.block_idx) AS parent_block_idx,
         any_value(i.source_text) || coalesce(chr(10) || 'Caption: ' || arg_min(c.source_text, abs(c.block_idx - i.block_idx) * 1000000 + c.block_idx), '') AS source_text
  FROM parsed_blocks i LEFT JOIN parsed_blocks c ON c.doc_id = i.doc_id AND c.page_number = i.page_number AND c.block_type = 'caption'
  WHERE i.block_type = 'image' GROUP BY i.doc_id, i.block_idx"""))
def c8(spark, sf):
    rows = bk.link_captions(bk.parsed_blocks(s.parsed(spark, sf))).filter("block_type = 'image'")
    return longs(rows.select("doc_id", "block_idx", "parent_block_idx", "source_text"), "block_idx", "parent_block_idx")


@query("c9_raw_text", sql("parsed_blocks", body="""
  SELECT doc_id, string_agg(source_text, chr(10) || chr(10) ORDER BY block_idx) AS raw_text FROM parsed_blocks
  WHERE block_type <> 'image' GROUP BY doc_id"""))
def c9(spark, sf):
    return bk.raw_text(bk.parsed_blocks(s.parsed(spark, sf)))


@query("c10_block_numbering", sql("parsed_blocks", body=f"""
  SELECT doc_id, block_idx, page_number, {s.sql_norm('source_text')} AS normalized_text FROM parsed_blocks WHERE block_type <> 'image'"""))
def c10(spark, sf):
    """Numbered from a table of pages, where the pages of a document are rows."""
    pages = fl.parsed_pages(s.parsed(spark, sf))
    rows = bk.finish_blocks(bk.page_blocks(pages))
    return longs(rows.select("doc_id", "block_idx", "page_number", "normalized_text"), "block_idx", "page_number")


# documents in German have no page list: their lines are one page without a number
part("mixed_blocks", f"""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS block_idx, page AS page_number, normalized_text FROM (
    SELECT doc_id, page_number AS page, block_idx AS pos, {s.sql_norm('source_text')} AS normalized_text FROM parsed_blocks WHERE block_type <> 'image' AND lang <> 'de'
    UNION ALL
    SELECT doc_id, NULL, min(page), {s.sql_norm("string_agg(trim(line), ' ' ORDER BY page)")} FROM (
      SELECT doc_id, page, line, cap, sum(CASE WHEN cap OR was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM (
        SELECT *, lag(cap, 1, false) OVER (PARTITION BY doc_id ORDER BY page) AS was FROM (
          SELECT doc_id, page, line, regexp_matches(line, '(?i)^(figure|fig\\.|table|표|그림)') AS cap FROM page_lines WHERE lang = 'de' AND trim(line) <> '')))
    GROUP BY doc_id, run)""", "parsed_blocks", "page_lines")


@query("c10_blocks_without_page_list", sql("mixed_blocks", body="SELECT doc_id, block_idx, page_number, normalized_text FROM mixed_blocks"))
def c10b(spark, sf):
    """Documents without a page list are numbered too."""
    parsed = s.parsed(spark, sf)
    parsed = parsed.withColumn("pages", F.when(F.col("lang") != "de", F.col("pages")))
    rows = bk.finish_blocks(bk.page_blocks(fl.parsed_pages(parsed)))
    return longs(rows.select("doc_id", "block_idx", "page_number", "normalized_text"), "block_idx", "page_number")


FILE_TYPES = {"en": "PDF", "fr": "docx", "de": "xls", "es": "txt"}


@query("c11_route_by_type", f"""
  SELECT doc_id, type, CASE type WHEN 'PDF' THEN 'pages' WHEN 'docx' THEN 'document' WHEN 'xls' THEN 'sheets' END AS reader,
         CASE WHEN type = 'txt' THEN 'failed' ELSE 'processing' END AS status,
         CASE WHEN type = 'txt' THEN 'Unsupported file type: .txt' END AS error_msg
  FROM (SELECT doc_id, {s.sql_cases('lang', FILE_TYPES)} AS type FROM documents)""")
def c11(spark, sf):
    return bk.route_by_type(t(spark, sf, "documents").select("doc_id", s.cases("lang", FILE_TYPES).alias("type")))
