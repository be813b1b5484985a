"""Chunks, terms and keywords (D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import part, query, sql
from leafmill.functions import fixed_values as fv
from leafmill.functions import text as tx
from leafmill.operators import blocks as bk
from leafmill.operators import chunks as ck
from leafmill.operators import terms as tm
from leafmill.plans import indexing as ix
from checks.standins import t
from leafmill.sources.tables import spread


@query("d1_token_length", f"SELECT doc_id, ({s.sql_tokens('text')})::BIGINT AS tokens FROM documents")
def d1(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.token_length(F.col("text")).cast("long").alias("tokens"))


# sections of the spaced documents, from their lines
LINE = s.sql_strip("line")
part("section_lines", """
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM sentences)""", "sentences")
part("section_kinds", f"""
  SELECT *, CASE WHEN {LINE} = '' OR regexp_matches({LINE}, '^-{{3,}}$') THEN 'cut'
            WHEN regexp_matches({LINE}, '^(#{{1,6}}\\s+\\S+|(\\d+(\\.\\d+){{0,3}}[.)])\\s+\\S+)$') THEN 'head' ELSE 'body' END AS kind
  FROM section_lines""", "section_lines")
part("sections", f"""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS pos,
         {s.sql_strip("string_agg(regexp_replace(line, '\\s+$', ''), chr(10) ORDER BY i)")} AS section FROM (
    SELECT *, sum(CASE WHEN kind <> 'body' OR before IS DISTINCT FROM 'body' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
    FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM section_kinds)) WHERE kind <> 'cut'
  GROUP BY doc_id, island""", "section_kinds")


@query("d2_structural_sections", sql("sections", body="SELECT * FROM sections"))
def d2(spark, sf):
    return s.sentences(spark, sf).select("doc_id", F.posexplode(ck.structural_sections(F.col("text"))).alias("pos", "section")).withColumn(
        "pos", F.col("pos").cast("long"))


# the carry after each section; a section group ends where it holds 80 tokens
part("carries", f"""RECURSIVE
  SELECT doc_id, pos, section AS text, {s.sql_tokens('section')} >= 80 AS full_, 0::BIGINT AS grp FROM sections WHERE pos = 0
  UNION ALL
  SELECT doc_id, pos, text, {s.sql_tokens('text')} >= 80, grp FROM (
    SELECT n.doc_id, n.pos, CASE WHEN c.full_ THEN n.section ELSE c.text || chr(10) || chr(10) || n.section END AS text,
           CASE WHEN c.full_ THEN c.grp + 1 ELSE c.grp END AS grp
    FROM carries c JOIN sections n ON n.doc_id = c.doc_id AND n.pos = c.pos + 1)""", "sections")
part("merged", """
  SELECT doc_id, grp AS pos, text FROM (
    SELECT doc_id, grp, max(grp) OVER (PARTITION BY doc_id) AS last_grp, arg_max(text, pos) AS text, bool_or(full_) AS is_full
    FROM carries GROUP BY doc_id, grp) WHERE is_full OR last_grp = 0""", "carries")
part("tails", """
  SELECT doc_id, grp, arg_max(text, pos) AS tail FROM carries GROUP BY doc_id, grp HAVING NOT bool_or(full_) AND grp > 0""", "carries")
part("merged_sections", """
  SELECT m.doc_id, pos, text || coalesce(chr(10) || chr(10) || tail, '') AS section
  FROM merged m LEFT JOIN tails t ON t.doc_id = m.doc_id AND t.grp = m.pos + 1""", "merged", "tails")


@query("d3_merged_sections", sql("merged_sections", body="SELECT * FROM merged_sections"))
def d3(spark, sf):
    merged = ck.merge_small(ck.structural_sections(F.col("text")))
    return s.sentences(spark, sf).select("doc_id", F.posexplode(merged).alias("pos", "section")).withColumn("pos", F.col("pos").cast("long"))


@query("d4_word_windows", f"""
  SELECT doc_id, st // 90 AS pos, array_to_string(list_slice(w, st + 1, st + 100), ' ') AS piece FROM (
    SELECT doc_id, w, unnest(range(0, len(w), 90)) AS st FROM (SELECT doc_id, {s.sql_words('text')} AS w FROM documents))""")
def d4(spark, sf):
    pieces = ck.word_windows(tx.words(F.col("text")), 100, 10)
    return t(spark, sf, "documents").select("doc_id", F.posexplode(pieces).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@query("d5_separator_split", f"""
  SELECT doc_id, text = '' OR {s.sql_strip('text')} <> '' AS has_text, length(text) AS n_chars, true AS all_fit, sha256(text) AS joined_hash
  FROM documents""")
def d5(spark, sf):
    """What the split promises: pieces fit, and joined in order they are the text."""
    pieces = ck.separator_split(F.col("text"), 128)
    return t(spark, sf, "documents").select("doc_id", pieces.alias("p")).select(
        "doc_id", (F.size("p") > 0).alias("has_text"),
        F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_chars"),
        F.forall("p", lambda x: tx.token_length(x) <= 128).alias("all_fit"),
        F.sha2(F.array_join("p", ""), 256).alias("joined_hash"))


SEPARATOR_LIST = "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in [*fv.SEPARATORS, ""]) + "]"


def recursive_parts(name: str, source: str, row: str, text: str, size: int, overlap: int) -> str:
    """Registers the pieces (row, path, at, piece) of the texts of `source`: a row's pieces in the order of (path, place)."""
    long = f"({s.sql_tokens('x')}) >= {size}"
    child = f"""
      SELECT {row}, list_append(path, i) AS path, k + 1 AS k, x, {long} AS long FROM (
        SELECT {row}, path, k, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (
          SELECT {row}, path, k, list_filter(CASE WHEN seps[k] = '' THEN string_split(x, '') ELSE list_transform(
            string_split(x, seps[k]), lambda y, i: CASE WHEN i = 1 THEN y ELSE seps[k] || y END) END, lambda y: y <> '') AS xs FROM (
            SELECT *, list_filter(range(k0, {len(fv.SEPARATORS) + 2}), lambda i: seps[i] = '' OR contains(x, seps[i]))[1] AS k FROM """
    part(f"{name}_parts", f"""RECURSIVE
      {child} (SELECT {row}, []::BIGINT[] AS path, 1 AS k0, {text} AS x, {SEPARATOR_LIST} AS seps FROM {source}))))
      UNION ALL
      {child} (SELECT {row}, path, k AS k0, x, {SEPARATOR_LIST} AS seps FROM {name}_parts WHERE long AND k <= {len(fv.SEPARATORS) + 1}))))""")
    part(f"{name}_runs", f"""
      SELECT {row}, parent, list(x ORDER BY path) AS xs, min(path) AS path,
             list_prepend(0::BIGINT, list_transform(list(tokens ORDER BY path), lambda t, i: list_sum(list(tokens ORDER BY path)[1:i])::BIGINT)) AS sums FROM (
        SELECT *, path[1:len(path) - 1] AS parent, ({s.sql_tokens('x')})::BIGINT AS tokens,
               count(*) FILTER (long) OVER (PARTITION BY {row}, path[1:len(path) - 1] ORDER BY path) AS grp FROM {name}_parts)
      WHERE NOT long GROUP BY {row}, parent, grp""", f"{name}_parts")
    end = f"list_filter(range(i0 + 1, len(xs) + 1), lambda i: sums[i + 1] - sums[a] > {size})[1]"
    part(f"{name}_cuts", f"""RECURSIVE
      SELECT *, {end} AS e FROM (SELECT *, 1::BIGINT AS a, 1::BIGINT AS i0 FROM {name}_runs)
      UNION ALL
      SELECT {row}, parent, xs, path, sums, a, i0, {end} AS e FROM (
        SELECT {row}, parent, xs, path, sums, e AS i0, list_filter(range(a, e + 1), lambda j: NOT (sums[e] - sums[j] > {overlap}
          OR (sums[e] - sums[j] > 0 AND sums[e + 1] - sums[j] > {size})))[1] AS a FROM {name}_cuts WHERE e IS NOT NULL)""", f"{name}_runs")
    part(name, f"""
      SELECT {row}, path, a AS place, piece FROM (
        SELECT *, {s.sql_strip("array_to_string(list_slice(xs, a, coalesce(e - 1, len(xs))), '')")} AS piece FROM {name}_cuts) WHERE piece <> ''""", f"{name}_cuts")
    return name


recursive_parts("doc_pieces", "documents", "doc_id", "text", 128, 24)


@query("d5_recursive_split", sql("doc_pieces", body="""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path, place) - 1 AS pos, piece FROM doc_pieces"""))
def d5b(spark, sf):
    """Overlapping pieces, cut by cut; texts that fit are only stripped."""
    rows = ck.split_recursively(t(spark, sf, "documents").select("doc_id", F.array("text").alias("pieces")), "pieces", 128, 24, whole=False)
    return rows.select("doc_id", F.posexplode("pieces").alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@query("d6_token_chunks", sql("chunks", body="SELECT doc_id, chunk_idx, content, token_cnt::BIGINT AS token_cnt FROM chunks"))
def d6a(spark, sf):
    return counted(ck.chunk_texts(t(spark, sf, "documents"), ["doc_id"], "text", strategy="token"))


def counted(df):
    return df.withColumn("chunk_idx", F.col("chunk_idx").cast("long")).withColumn("token_cnt", F.col("token_cnt").cast("long"))


def sql_pieces(source: str, keys: str, text: str, order: str, size: int, overlap: int) -> str:
    """Pieces of each text: whole if it fits, else windows; numbered per document."""
    step = size - overlap
    return f"""
  SELECT {keys}, row_number() OVER (PARTITION BY doc_id ORDER BY {order}, st) - 1 AS chunk_idx, content,
         ({s.sql_tokens('content')})::BIGINT AS token_cnt FROM (
    SELECT {keys}, {order}, 0 AS st, {text} AS content FROM {source} WHERE {s.sql_tokens(text)} BETWEEN 1 AND {size}
    UNION ALL
    SELECT {keys}, {order}, st, array_to_string(list_slice(w, st + 1, st + {size}), ' ') FROM (
      SELECT {keys}, {order}, w, unnest(range(0, len(w), {step})) AS st
      FROM (SELECT {keys}, {order}, {s.sql_words(text)} AS w FROM {source} WHERE {s.sql_tokens(text)} > {size})))"""


@query("d6_hybrid_chunks", sql("merged_sections", body=sql_pieces("merged_sections", "doc_id", "section", "pos", 100, 20)))
def d6b(spark, sf):
    return counted(ck.chunk_texts(s.sentences(spark, sf), ["doc_id"], "text", strategy="hybrid", size=100, overlap=20))


def sql_recursive_pieces(name: str, source: str, keys: str, text: str, order: str, size: int, overlap: int) -> tuple[str, str]:
    """(the part to name, pieces of each text: whole if it fits, else overlapping ones; numbered per document)."""
    part(f"{name}_given", f"SELECT *, row_number() OVER (ORDER BY doc_id, {order}) AS rid FROM {source}")
    recursive_parts(f"{name}_split", f"(SELECT * FROM {name}_given WHERE {s.sql_tokens(text)} > {size})", "rid", text, size, overlap)
    return f"{name}_split", f"""
  SELECT {keys}, row_number() OVER (PARTITION BY doc_id ORDER BY {order}, path, place) - 1 AS chunk_idx, content,
         ({s.sql_tokens('content')})::BIGINT AS token_cnt FROM (
    SELECT {keys}, {order}, []::BIGINT[] AS path, 0::BIGINT AS place, {text} AS content FROM {name}_given WHERE {s.sql_tokens(text)} BETWEEN 1 AND {size}
    UNION ALL SELECT {keys}, {order}, path, place, piece FROM {name}_split JOIN {name}_given USING (rid))"""


SECTIONS = sql_recursive_pieces("section", "merged_sections", "doc_id", "section", "pos", 100, 20)


@query("d6_recursive_chunks", sql("merged_sections", "section_given", SECTIONS[0], body=SECTIONS[1]))
def d6c(spark, sf):
    return counted(ck.chunk_texts(s.sentences(spark, sf), ["doc_id"], "text", strategy="hybrid", size=100, overlap=20, splitter="recursive"))


def page_line_blocks(spark, sf):
    """A block per line of a document, typed by its language."""
    lines = F.posexplode(F.split("text", "\n")).alias("block_idx", "source_text")
    rows = t(spark, sf, "documents").select("doc_id", F.col("lang").alias("block_type"), lines)
    return rows.withColumn("page_number", F.col("block_idx") + 1)


part("blocks_by_line", f"""
  SELECT doc_id, lang AS block_type, page - 1 AS block_idx, page AS page_number, {s.sql_strip('line')} AS source_text FROM page_lines""", "page_lines")
part("line_chunks", sql_pieces("(SELECT doc_id, block_type AS chunk_type, block_idx, page_number, source_text FROM blocks_by_line)",
                               "doc_id, chunk_type, page_number", "source_text", "block_idx", 40, 8), "blocks_by_line")


@query("d7_block_chunks", sql("line_chunks", body="SELECT doc_id, chunk_type, page_number::BIGINT AS page_number, chunk_idx, content, token_cnt FROM line_chunks"))
def d7(spark, sf):
    rows = ck.chunk_blocks(page_line_blocks(spark, sf), 40, 8)
    return counted(rows.select("doc_id", "chunk_type", F.col("page_number").cast("long").alias("page_number"), "chunk_idx", "content", "token_cnt"))


LINES = sql_recursive_pieces("line", "(SELECT doc_id, block_type AS chunk_type, block_idx, page_number, source_text FROM blocks_by_line)",
                             "doc_id, chunk_type, page_number", "source_text", "block_idx", 40, 8)


@query("d7_recursive_block_chunks", sql("blocks_by_line", "line_given", LINES[0], body=f"""
  SELECT doc_id, chunk_type, page_number::BIGINT AS page_number, chunk_idx, content, token_cnt FROM ({LINES[1]})"""))
def d7b(spark, sf):
    rows = ck.chunk_blocks(page_line_blocks(spark, sf), 40, 8, "recursive")
    return counted(rows.select("doc_id", "chunk_type", F.col("page_number").cast("long").alias("page_number"), "chunk_idx", "content", "token_cnt"))


@query("d8_chunk_numbering", sql("line_chunks", body="""
  SELECT doc_id, count(*) AS n, min(chunk_idx) AS first, max(chunk_idx) AS last, sum(chunk_idx * token_cnt)::BIGINT AS weighted FROM line_chunks GROUP BY 1"""))
def d8(spark, sf):
    rows = counted(ck.chunk_blocks(page_line_blocks(spark, sf), 40, 8))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("chunk_idx").alias("first"), F.max("chunk_idx").alias("last"),
                                      F.sum(F.col("chunk_idx") * F.col("token_cnt")).alias("weighted"))


@query("d9_chunk_path", sql("line_chunks", "chunks", body="""
  SELECT doc_id, chunk_type, chunk_idx, content FROM line_chunks WHERE chunk_type <> 'es'
  UNION ALL
  SELECT doc_id, 'text', chunk_idx, content FROM (""" + sql_pieces(
      "(SELECT doc_id, 0 AS pos, " + s.sql_strip("text") + " AS section FROM documents WHERE lang = 'es')", "doc_id", "section", "pos", 40, 8) + ")"))
def d9(spark, sf):
    """Spanish documents have no blocks, so their raw text is cut."""
    blocks = page_line_blocks(spark, sf).filter("block_type <> 'es'")
    rows = ck.chunk_documents(t(spark, sf, "documents"), blocks, "text", size=40, overlap=8)
    return rows.select("doc_id", "chunk_type", F.col("chunk_idx").cast("long").alias("chunk_idx"), "content")


SPANISH = sql_recursive_pieces("spanish", "(SELECT doc_id, 0 AS pos, " + s.sql_strip("text") + " AS section FROM documents WHERE lang = 'es')",
                               "doc_id", "section", "pos", 40, 8)


@query("d9_recursive_chunk_path", sql("blocks_by_line", "line_given", LINES[0], "spanish_given", SPANISH[0], body=f"""
  SELECT doc_id, chunk_type, chunk_idx, content FROM ({LINES[1]}) WHERE chunk_type <> 'es'
  UNION ALL
  SELECT doc_id, 'text', chunk_idx, content FROM ({SPANISH[1]})"""))
def d9b(spark, sf):
    blocks = page_line_blocks(spark, sf).filter("block_type <> 'es'")
    rows = ck.chunk_documents(t(spark, sf, "documents"), blocks, "text", size=40, overlap=8, splitter="recursive", strategy="token")
    return rows.select("doc_id", "chunk_type", F.col("chunk_idx").cast("long").alias("chunk_idx"), "content")


# --- terms ----------------------------------------------------------------------

@query("e1_normalise", f"SELECT doc_id, {s.sql_norm('text')} AS normal FROM documents")
def e1(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.normalise(F.col("text")).alias("normal"))


@query("e2_candidate_terms", s.sql_terms("documents", "doc_id", "text"))
def e2(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.posexplode(tx.candidate_terms(F.col("text"))).alias("pos", "term"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def part_aliases(spark, sf):
    return t(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_brand").alias("canonical_name"), F.col("p_name").alias("alias"),
        F.lit("product").alias("alias_type"), F.lit("en").alias("language"), (F.col("p_size") / 10).alias("boost"))


# aliases of the built-in list that could occur in the tables are all ASCII; the Korean ones cannot
part("builtin_aliases", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}', '{a}', '{k}', '{g}', {b}::DOUBLE)" for i, (c, a, k, g, b) in enumerate(__import__(
        "leafmill.functions.fixed_values", fromlist=["ALIASES"]).ALIASES)) + ") v(ord, canonical_name, alias, alias_type, language, boost)")
part("aliases", f"""
  SELECT *, {s.sql_norm('alias')} AS alias_norm, {s.sql_norm('canonical_name')} AS canonical_norm FROM (
    SELECT 0 AS source, * FROM builtin_aliases
    UNION ALL SELECT 1, p_partkey, p_brand, p_name, 'product', 'en', p_size / 10 FROM part)""", "builtin_aliases")


@query("e3_alias_groups", sql("aliases", body="""
  SELECT canonical_norm, surface, term_norm FROM (
    SELECT DISTINCT canonical_norm, unnest([canonical_name, alias]) AS surface FROM aliases) g
  LEFT JOIN (SELECT term_norm, arg_max(canonical_norm, n) AS owner FROM (
      SELECT canonical_norm, alias_norm AS term_norm, row_number() OVER (ORDER BY source, ord) * 2 AS n FROM aliases
      UNION ALL SELECT canonical_norm, canonical_norm, row_number() OVER (ORDER BY source, ord) * 2 + 1 FROM aliases) GROUP BY 1) o
  ON o.owner = g.canonical_norm AND o.term_norm = """ + s.sql_norm("surface")))
def e3(spark, sf):
    """Every spelling of every canonical name, and whether a lookup of it leads back."""
    aliases = tm.alias_rows(spark, part_aliases(spark, sf))
    groups = tm.alias_groups(aliases).withColumn("norm", tx.normalise(F.col("surface")))
    owner = tm.alias_lookup(aliases).select(F.col("term_norm"), F.col("canonical_norm").alias("owner"))
    same = (F.col("norm") == F.col("term_norm")) & (F.col("canonical_norm") == F.col("owner"))
    return groups.join(owner, same, "left").select("canonical_norm", "surface", "term_norm")


part("lookup", """
  SELECT term_norm, arg_max(canonical_norm, n) AS canonical_norm FROM (
    SELECT canonical_norm, alias_norm AS term_norm, row_number() OVER (ORDER BY source, ord) * 2 AS n FROM aliases
    UNION ALL SELECT canonical_norm, canonical_norm, row_number() OVER (ORDER BY source, ord) * 2 + 1 FROM aliases) GROUP BY 1""", "aliases")


@query("e4_expand_terms", sql("lookup", body=f"""
  , base AS ({s.sql_terms('part', 'p_partkey', 'p_name')}
             UNION ALL SELECT p_partkey, 1000, p_name FROM part),
  groups AS (SELECT DISTINCT canonical_norm, unnest([canonical_name, alias]) AS surface FROM aliases),
  spelled AS (SELECT p_partkey, pos, term AS variant FROM base
              UNION ALL SELECT p_partkey, pos, surface FROM base JOIN lookup ON term_norm = {s.sql_norm('term')} JOIN groups USING (canonical_norm)),
  kept AS (SELECT *, {s.sql_norm('variant')} AS variant_norm FROM spelled
           QUALIFY row_number() OVER (PARTITION BY p_partkey, {s.sql_norm('variant')} ORDER BY pos, length(variant) DESC, variant DESC) = 1)
  SELECT p_partkey, variant, variant_norm, row_number() OVER (PARTITION BY p_partkey ORDER BY pos, length(variant) DESC, variant DESC) - 1 AS pos
  FROM kept""".replace("\n  , base", ", base", 1)))
def e4(spark, sf):
    terms = t(spark, sf, "part").select("p_partkey", F.posexplode(
        F.concat(tx.candidate_terms(F.col("p_name")), F.array("p_name"))).alias("pos", "term"))
    return tm.expand_terms(terms, tm.alias_rows(spark, part_aliases(spark, sf)), ["p_partkey"])


# keywords: tokens, then what contained aliases write over them
def sql_keywords(source: str, key: str, text: str, aliases: str) -> str:
    return f"""
  SELECT {key}, rank, keyword, normalized_keyword, keyword_type, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY weight DESC, length(normalized_keyword) DESC, place) AS rank FROM (
      SELECT {key}, normalized_keyword, arg_max(keyword, n) AS keyword, arg_max(keyword_type, n) AS keyword_type,
             arg_max(weight, n) AS weight, min(n) AS place FROM (
        SELECT {key}, term AS normalized_keyword, term AS keyword, 'token' AS keyword_type, 0.9::DOUBLE AS weight, pos AS n
        FROM ({s.sql_terms(source, key, text)})
        UNION ALL
        SELECT {key}, alias_norm, alias, alias_type, boost, 1000000 + a.n * 2 FROM normal JOIN {aliases} a ON contains(normal, alias_norm)
        UNION ALL
        SELECT {key}, canonical_norm, canonical_name, 'canonical', boost + 0.05, 1000001 + a.n * 2 FROM normal JOIN {aliases} a ON contains(normal, alias_norm))
      GROUP BY {key}, normalized_keyword)) WHERE rank <= 48"""


part("doc_normal", f"SELECT doc_id, {s.sql_norm('text')} AS normal FROM documents")
part("ranked_builtin", f"SELECT *, ord AS n, {s.sql_norm('alias')} AS alias_norm, {s.sql_norm('canonical_name')} AS canonical_norm FROM builtin_aliases", "builtin_aliases")


@query("e5_keywords", sql("doc_normal", "ranked_builtin", body=sql_keywords("documents", "doc_id", "text", "ranked_builtin").replace("normal JOIN", "doc_normal JOIN")))
def e5(spark, sf):
    return ranked(tm.keyword_index(t(spark, sf, "documents"), ["doc_id"], "text"))


def ranked(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


# words of the benchmark passages as a dictionary: they do occur in documents
def passage_aliases(spark, sf):
    words = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("x"))
    return words.select(F.col("item_id").alias("ord"), F.element_at(F.split("x", " "), 1).alias("canonical_name"),
                        F.element_at(F.split("x", " "), -1).alias("alias"), F.lit("passage").alias("alias_type"),
                        F.lit("en").alias("language"), (1 + F.col("item_id") / 1000).alias("boost"))


part("passage_aliases", f"""
  SELECT *, {s.sql_norm('alias')} AS alias_norm, {s.sql_norm('canonical_name')} AS canonical_norm FROM (
    SELECT n, alias, canonical_name, alias_type, boost FROM (SELECT ord AS n, alias, canonical_name, alias_type, boost FROM builtin_aliases)
    UNION ALL SELECT 1000 + item_id, string_split(text, ' ')[-1], string_split(text, ' ')[1], 'passage', 1 + item_id / 1000 FROM benchmark)""", "builtin_aliases")


@query("e5_keywords_with_alias_table", sql("doc_normal", "passage_aliases", body=sql_keywords("documents", "doc_id", "text", "passage_aliases").replace("normal JOIN", "doc_normal JOIN")))
def e5b(spark, sf):
    return ranked(tm.keyword_index(t(spark, sf, "documents"), ["doc_id"], "text", tm.alias_rows(spark, passage_aliases(spark, sf))))


# a large dictionary: part names, half of which have no boost of their own
part("part_aliases", f"""
  SELECT *, {s.sql_norm('alias')} AS alias_norm, {s.sql_norm('canonical_name')} AS canonical_norm FROM (
    SELECT n, alias, canonical_name, alias_type, boost FROM (SELECT ord AS n, alias, canonical_name, alias_type, boost FROM builtin_aliases)
    UNION ALL SELECT 1000 + p_partkey, p_name, p_brand, 'part', CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 1.0 END FROM part)""", "builtin_aliases")
part("part_texts", f"SELECT p_partkey AS doc_id, 'see ' || p_name || ' of ' || p_brand AS text, {s.sql_norm("'see ' || p_name || ' of ' || p_brand")} AS normal FROM part")


@query("e5_keywords_with_part_names", sql("part_texts", "part_aliases", body=sql_keywords("part_texts", "doc_id", "text", "part_aliases").replace("normal JOIN", "part_texts JOIN")))
def e5c(spark, sf):
    """Every part name is an alias; a null boost counts 1.0."""
    parts = spread(t(spark, sf, "part"))
    table = parts.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("canonical_name"), F.col("p_name").alias("alias"),
                         F.lit("part").alias("alias_type"), F.lit("en").alias("language"), F.when(F.col("p_partkey") % 2 == 0, 1.5).alias("boost"))
    texts = parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("see "), "p_name", F.lit(" of "), "p_brand").alias("text"))
    return ranked(tm.keyword_index(texts, ["doc_id"], "text", tm.alias_rows(spark, table)))


part("chunk_normal", f"SELECT chunk_id, {s.sql_norm('content')} AS normal FROM chunks", "chunks")


@query("e6_keyword_index", sql("chunks", "chunk_normal", "ranked_builtin", body=sql_keywords("chunks", "chunk_id", "content", "ranked_builtin").replace("normal JOIN", "chunk_normal JOIN")))
def e6(spark, sf):
    return ranked(ix.keyword_table(ix.text_chunk_table(t(spark, sf, "documents"))).drop("doc_id"))


POSTINGS = f"""
  SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({s.sql_index_tokens('content')}) AS term FROM chunks) GROUP BY ALL"""


@query("e7_chunk_postings", sql("chunks", body=POSTINGS))
def e7a(spark, sf):
    return ix.posting_table(ix.text_chunk_table(t(spark, sf, "documents")))


@query("e7_block_postings", sql("parsed_blocks", body=f"""
  SELECT doc_id, block_idx, term, count(*) AS tf FROM (
    SELECT doc_id, block_idx, unnest({s.sql_index_tokens('source_text')}) AS term FROM parsed_blocks) GROUP BY ALL"""))
def e7b(spark, sf):
    rows = tm.postings(bk.parsed_blocks(s.parsed(spark, sf)), ["doc_id", "block_idx"], "source_text")
    return rows.withColumn("block_idx", F.col("block_idx").cast("long"))


@query("e8_preview", "SELECT page_id, CASE WHEN length(url || html) <= 240 THEN url || html ELSE substr(url || html, 1, 237) || '...' END AS preview FROM pages")
def e8(spark, sf):
    return t(spark, sf, "pages").select("page_id", tx.preview(F.concat("url", "html")).alias("preview"))


@query("e9_file_search", "SELECT doc_id FROM documents WHERE source ILIKE '%C1_%' OR lang ILIKE '%C1_%'")
def e9a(spark, sf):
    return t(spark, sf, "documents").filter(tx.matches_search(" C1_ ", F.col("source"), F.col("lang"))).select("doc_id")


@query("e9_console_search", "SELECT page_id FROM pages WHERE contains(lower(url), 'page=2') OR contains(lower(html), 'lang=\"fr\"')")
def e9b(spark, sf):
    pages = t(spark, sf, "pages")
    return pages.filter(tx.contains_search(" PAGE=2", F.col("url")) | tx.contains_search('lang="FR"', F.col("html"))).select("page_id")
