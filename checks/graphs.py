"""Entities and the entity graph (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import part, query, sql
from checks.searching import expanded
from checks.standins import t
from leafmill.functions import fixed_values as fv
from leafmill.operators import graph as gr
from leafmill.operators import sync as sy
from leafmill.plans import indexing as ix

COLLAPSED = "trim(regexp_replace(string_agg(content, ' ' ORDER BY chunk_idx), '\\s+', ' ', 'g'))"
part("doc_texts", f"SELECT doc_id, {COLLAPSED} AS text FROM chunks GROUP BY doc_id", "chunks")


@query("h1_document_texts", sql("doc_texts", body="SELECT * FROM doc_texts"))
def h1(spark, sf):
    return gr.document_texts(ix.text_chunk_table(t(spark, sf, "documents")))


# The documents hold no Hangul, so of the rules only ISO dates and the three
# technical ones can match. DuckDB's \b knows ASCII only: other letters become _.
def lit(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


STOP_FORMS = lit(fv.ACRONYM_STOP_FORMS)
part("ascii_texts", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM doc_texts", "doc_texts")
RULES = {
    "iso_date": ("DATE", r"\d{4}[-./]\d{1,2}[-./]\d{1,2}"),
    "acronym": ("TECH", r"\b[A-Z]{2,}\b"),
    "camel": ("TECH", r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"),
    "product": ("TECH", r"\b[A-Za-z][A-Za-z0-9\-]{2,}\s*[vV]?\d+(?:\.\d+)*\b"),
}
part("mentions", "SELECT DISTINCT doc_id, name AS entity_name, kind AS entity_type FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, trim(unnest(regexp_extract_all(text, '{p}'))) AS name, '{k}' AS kind FROM ascii_texts" for k, p in RULES.values())
    + f") WHERE length(name) >= 2 AND name NOT IN {STOP_FORMS}", "ascii_texts")


def mentions(spark, sf):
    return ix.settled(ix.mention_table(t(spark, sf, "documents")))


@query("h6_h7_mentions", sql("mentions", body="SELECT * FROM mentions"))
def h6(spark, sf):
    return ix.mention_table(t(spark, sf, "documents")).select("doc_id", "entity_name", "entity_type")


KOREAN = "'주식회사 ' || c_mktsegment || ' / ' || c_name || '연구소, 홍길동대표; 20' || (10 + c_nationkey) || '년 3월 ' || (1 + c_nationkey) || '일 ' || '상반기 2024년 2024-0' || (1 + c_nationkey % 9) || '-11 홍길동대표'"
KOREAN_RULES = [(i, k, p) for i, (k, p) in enumerate(fv.ENTITY_PATTERNS) if i < fv.ACRONYM_RULE]
part("korean_texts", f"SELECT c_custkey AS doc_id, {KOREAN} AS text FROM customer")


@query("h2_to_h5_korean_mentions", sql("korean_texts", body="SELECT DISTINCT doc_id, name AS entity_name, kind AS entity_type FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, trim(unnest(regexp_extract_all(text, '{p}'))) AS name, '{k}' AS kind, {i} AS rule FROM korean_texts" for i, k, p in KOREAN_RULES)
    + ") WHERE length(name) >= CASE rule WHEN 0 THEN 3 ELSE 2 END"))
def h2(spark, sf):
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(KOREAN).alias("text"))
    return gr.mentions(rows).filter("entity_type <> 'TECH'").select("doc_id", "entity_name", "entity_type")


@query("h8_entity_table", sql("mentions", body="""
  SELECT doc_id, entity_name, entity_type FROM mentions WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT DISTINCT doc_id, entity_name, 'NEW' FROM mentions WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"""))
def h8(spark, sf):
    """Labelled documents are extracted again; those of low quality give nothing any more."""
    found, labels = mentions(spark, sf).select("doc_id", "entity_name", "entity_type"), t(spark, sf, "labels")
    new = found.join(labels.filter("quality = 1"), "doc_id", "left_semi").select(
        "doc_id", "entity_name", F.lit("NEW").alias("entity_type")).distinct()
    return sy.replace_by_document(found, new, labels)


part("vertices", """
  SELECT entity_name, arg_min(entity_type, (-n)::VARCHAR || entity_type) AS entity_type, any_value(n_docs) AS n_docs FROM (
    SELECT entity_name, entity_type, lpad((1000000000 - count(*))::VARCHAR, 12, '0') AS k, count(*) AS n FROM mentions GROUP BY ALL)
  JOIN (SELECT entity_name, count(DISTINCT doc_id) AS n_docs FROM mentions GROUP BY 1) USING (entity_name) GROUP BY entity_name""".replace(
    "(-n)::VARCHAR || entity_type", "k || entity_type"), "mentions")


@query("h9_entity_vertices", sql("vertices", body="SELECT * FROM vertices"))
def h9(spark, sf):
    return gr.entity_vertices(mentions(spark, sf))


@query("h10_appears_in", sql("mentions", body="SELECT DISTINCT entity_name, doc_id FROM mentions"))
def h10(spark, sf):
    return gr.appears_in(mentions(spark, sf))


# DuckDB 2.0 loses the rows of pos 0 under `pos < 5` (a filter on row_number() - 1), not under IN
part("words", "SELECT query_id, pos AS word_pos, variant AS word FROM forms WHERE pos IN (0, 1, 2, 3, 4)", "forms")
part("found", """
  SELECT query_id, word_pos, word, entity_name, entity_type, n_docs,
         row_number() OVER (PARTITION BY query_id, word_pos ORDER BY n_docs DESC, entity_name) AS rank
  FROM words JOIN vertices ON contains(entity_name, word) QUALIFY rank <= 5""", "words", "vertices")


def found(spark, sf, vertices):
    return gr.find_entities(vertices, gr.lookup_words(expanded(spark, sf)))


@query("h12_entity_lookup", sql("found", body="SELECT * FROM found"))
def h12(spark, sf):
    rows = found(spark, sf, gr.entity_vertices(mentions(spark, sf)))
    return rows.withColumn("rank", F.col("rank").cast("long"))


part("edges", "SELECT DISTINCT entity_name, doc_id FROM mentions", "mentions")


@query("h11_co_occurrences", sql("found", "edges", body="""
  SELECT DISTINCT a.entity_name AS src, b.entity_name AS dst FROM edges a JOIN edges b ON a.doc_id = b.doc_id AND a.entity_name < b.entity_name
  WHERE a.entity_name IN (SELECT entity_name FROM found) OR b.entity_name IN (SELECT entity_name FROM found)"""))
def h11(spark, sf):
    """Edges of the entities the benchmark passages lead to."""
    rows = mentions(spark, sf)
    return gr.co_occurrences(gr.appears_in(rows), found(spark, sf, gr.entity_vertices(rows)))


part("one_hop", """SELECT DISTINCT a.entity_name, b.entity_name AS neighbour FROM edges a JOIN edges b USING (doc_id)""", "edges")
part("near", """
  SELECT entity_name, neighbour, row_number() OVER (PARTITION BY entity_name ORDER BY neighbour) AS rank FROM (
    SELECT DISTINCT a.entity_name, b.neighbour FROM one_hop a JOIN one_hop b ON b.entity_name = a.neighbour WHERE a.entity_name <> b.neighbour)
  QUALIFY rank <= 10""", "one_hop")


@query("h13_neighbours", sql("near", body="SELECT * FROM near"))
def h13(spark, sf):
    rows = gr.neighbours(gr.appears_in(mentions(spark, sf)))
    return rows.withColumn("rank", F.col("rank").cast("long"))


part("lines", """
  SELECT query_id, word_pos, f.rank, entity_name || ' (' || entity_type || '): related to ' || names AS line
  FROM found f JOIN (SELECT entity_name, string_agg(neighbour, ', ' ORDER BY neighbour) AS names FROM near GROUP BY 1) USING (entity_name)""", "found", "near")
part("graph_texts", f"""
  SELECT query_id, '{fv.GRAPH_OPEN.strip()}' || chr(10) || string_agg(line, chr(10) ORDER BY word_pos, rank) || chr(10) || '{fv.GRAPH_CLOSE.strip()}' AS graph_text
  FROM lines GROUP BY query_id""", "lines")


def graph_texts(spark, sf):
    rows = mentions(spark, sf)
    hits = found(spark, sf, gr.entity_vertices(rows))
    return gr.graph_texts(gr.context_lines(hits, gr.neighbours(gr.appears_in(rows))))


@query("h14_graph_context", sql("graph_texts", body="SELECT * FROM graph_texts"))
def h14(spark, sf):
    return graph_texts(spark, sf)
