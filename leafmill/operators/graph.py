"""Entity mentions, the entity graph, and its neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import fixed_values as fv
from leafmill.functions import text as tx
from leafmill.functions.ordered import top_k
from leafmill.operators.terms import contained_rows

NEIGHBOURS = 10


def document_texts(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks in order, joined by a space, white space collapsed."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_idx", "content")))
    joined = F.array_join(F.transform(ordered, lambda c: c["content"]), " ")
    return chunks.groupBy(doc).agg(tx.collapse_space(joined).alias("text"))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<name, start, end>> of every match, with character offsets.

    Offsets follow from the lengths of the matches and of the gaps between them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("hit")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,start:int,end:int>>").alias("out"))

    def step(state, s):
        start = state["at"] + F.length(s["gap"])
        end = start + F.coalesce(F.length(s["hit"]), F.lit(0))
        hit = F.struct(s["hit"].alias("name"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["hit"].isNull(), state["out"]).otherwise(
            F.concat(state["out"], F.array(hit))).alias("out"))

    return F.aggregate(steps, empty, step, lambda s: s["out"])


# Tests a text must pass before a rule's pattern is tried on it: what every match needs.
NEEDS_HANGUL, NEEDS_DIGIT = "[가-힣]", r"(?U)\d"


def _java(pattern: str) -> str:
    """The same pattern for Java: Unicode classes, and a cheap look at the next character before \\b."""
    if pattern.startswith(r"\b["):
        first = pattern[2:pattern.index("]") + 1]
        pattern = f"(?={first})(?<![A-Za-z0-9_])" + pattern
    return "(?U)" + pattern


def mention_array(text: Column, offsets: bool = False) -> Column:
    """Every mention of one text, rule by rule; with `offsets`, also where it stands."""
    kept = []
    for i, (kind, pattern) in enumerate(fv.ENTITY_PATTERNS):
        pattern = _java(pattern)
        if offsets:
            hits = _matches(text, pattern)
        else:
            hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("name")))
        where = ["start", "end"] if offsets else []
        named = _named(hits, kind, where)
        if i == fv.ACRONYM_RULE:
            named = F.filter(named, lambda m: ~F.array_contains(tx.words_of(fv.ACRONYM_STOP_FORMS), m["name"]))
        least = fv.MIN_ORG_SUFFIX_NAME if i == 0 else 2
        named = _at_least(named, least)
        shape = "array<struct<name:string,type:string" + "".join(f",{w}_char:int" for w in where) + ">>"
        if any("가" <= ch <= "힣" for ch in pattern):
            named = F.when(text.rlike(NEEDS_HANGUL), named)
        elif r"\d" in pattern:
            named = F.when(text.rlike(NEEDS_DIGIT), named)
        kept.append(F.coalesce(named.cast(shape), F.array().cast(shape)))
    return F.concat(*kept)


def _named(hits: Column, kind: str, where: list[str]) -> Column:
    return F.transform(hits, lambda m: F.struct(
        tx.strip(m["name"]).alias("name"), F.lit(kind).alias("type"), *[m[w].alias(f"{w}_char") for w in where]))


def _at_least(named: Column, size: int) -> Column:
    return F.filter(named, lambda m: F.length(m["name"]) >= size)


def mentions(texts: DataFrame, doc: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(doc, place, entity_name, entity_type), distinct per document, first kept; map-only.

    With `offsets` also start_char and end_char of the first mention in the
    collapsed text.
    """
    clean = texts.select(doc, tx.collapse_space(F.col(text_col)).alias("text"))
    found = clean.select(doc, mention_array(F.col("text"), offsets).alias("all"))
    if offsets:
        found = found.withColumn("keys", F.transform("all", lambda m: F.struct(m["name"], m["type"])))
        firsts = F.transform(F.array_distinct("keys"),
                             lambda k: F.element_at(F.col("all"), F.array_position(F.col("keys"), k).cast("int")))
    else:
        firsts = F.array_distinct("all")
    rows = found.select(doc, F.posexplode(firsts).alias("place", "m"))
    return rows.select(doc, "place", F.col("m.name").alias("entity_name"), F.col("m.type").alias("entity_type"),
                       *(["m.start_char", "m.end_char"] if offsets else []))


# --- graph ------------------------------------------------------------------

def entity_vertices(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One vertex per name with its most frequent type, and the documents that hold it."""
    types = found.groupBy("entity_name", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    kept = types.groupBy("entity_name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("entity_type").alias("entity_type"))).alias("t"))
    degree = appears_in(found, doc).groupBy("entity_name").agg(F.count(F.lit(1)).alias("n_docs"))
    return kept.select("entity_name", F.col("t.entity_type").alias("entity_type")).join(degree, "entity_name")


def appears_in(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    return found.select("entity_name", doc).distinct()


def co_occurrences(edges: DataFrame, names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(src, dst), src < dst: the co-occurrence edges that touch any of `names`.

    The edge table of the whole graph would hold every pair of every document.
    It is never written: APPEARS_IN already implies it, and a reader asks for
    the edges of the entities it is looking at.
    """
    touched = edges.join(names.select("entity_name").distinct(), "entity_name", "left_semi")
    pairs = touched.select(F.col("entity_name").alias("a"), doc).join(
        edges.select(F.col("entity_name").alias("b"), doc), doc).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def neighbours(edges: DataFrame, k: int = NEIGHBOURS, doc: str = "doc_id") -> DataFrame:
    """The k first names within two hops of every entity: (entity_name, neighbour, rank).

    Only the k + 1 smallest names can matter at any point (one may be the
    entity itself), so each step passes on at most k + 1 names per document or
    entity: document -> entity -> document -> entity. Work grows with the
    mentions, never with their pairs, and hubs stay small.
    """
    keep = k + 1

    def smallest(rows, key):
        return top_k(rows.distinct(), [key], [F.asc("neighbour")], keep).drop("rank")

    of_doc = smallest(edges.select(doc, F.col("entity_name").alias("neighbour")), doc)
    one_hop = smallest(edges.join(of_doc, doc).select("entity_name", "neighbour"), "entity_name")
    near_doc = smallest(edges.join(one_hop, "entity_name").select(doc, "neighbour"), doc)
    two_hops = smallest(edges.join(near_doc, doc).select("entity_name", "neighbour"), "entity_name")
    return top_k(two_hops.filter("entity_name <> neighbour"), ["entity_name"], [F.asc("neighbour")], k)


def lookup_words(expanded: DataFrame, first: int = 5) -> DataFrame:
    """The first forms of each query that the graph is searched for."""
    return expanded.filter(F.col("pos") < first).select("query_id", F.col("pos").alias("word_pos"), F.col("variant").alias("word"))


def find_entities(vertices: DataFrame, words: DataFrame, k: int = 5) -> DataFrame:
    """Up to k entities per word whose name contains it, most documents first.

    The words asked for are the dictionary, and each name is walked once.
    """
    asked = words.select("query_id", "word_pos", "word")
    found = contained_rows(vertices.select("entity_name", "entity_type", "n_docs"), "entity_name", asked, "word")
    pairs = found.select("entity_name", "entity_type", "n_docs", F.inline("hits"))
    return top_k(pairs, ["query_id", "word_pos"], [F.desc("n_docs"), F.asc("entity_name")], k)


def context_lines(found: DataFrame, near: DataFrame) -> DataFrame:
    """`name (type): related to a, b`; an entity without neighbours gives none."""
    listed = near.join(found.select("entity_name").distinct(), "entity_name", "left_semi").groupBy("entity_name").agg(
        F.array_join(F.sort_array(F.collect_list("neighbour")), ", ").alias("names"))
    return found.join(listed, "entity_name").select(
        "query_id", "word_pos", "rank",
        F.concat("entity_name", F.lit(" ("), "entity_type", F.lit("): related to "), "names").alias("line"))


def graph_texts(lines: DataFrame) -> DataFrame:
    """One text per query; it has at most 25 lines."""
    ordered = F.sort_array(F.collect_list(F.struct("word_pos", "rank", "line")))
    body = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy("query_id").agg(F.concat(F.lit(fv.GRAPH_OPEN), body, F.lit(fv.GRAPH_CLOSE)).alias("graph_text"))
