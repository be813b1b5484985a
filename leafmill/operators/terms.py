"""Alias dictionary, term expansion, keyword and full-text indexes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leafmill.functions import fixed_values as fv
from leafmill.functions import text as tx
from leafmill.session import cut_lineage

BLOCK_CHARS = 4_000_000  # characters of needles in one automaton
SPELLED, CELLS_PER_PART = 250_000, 4  # rows that a task of `expand_terms` gives, about; cells that even out its parts
PIECES_KNOWN = 100_000  # pieces of texts whose terms a task remembers, about
_TERM, _STOP = re.compile(fv.TERM), frozenset(fv.STOPWORDS)
_AUTOMATA: dict = {}  # of this worker: the last one it walked


def _automaton(name: str, needles: list[str]):
    """An Aho-Corasick automaton that gives the numbers of equal needles; a worker keeps one."""
    if name not in _AUTOMATA:
        import ahocorasick

        numbers: dict[str, list[int]] = {}
        for i, needle in enumerate(needles):
            numbers.setdefault(needle, []).append(i)
        built = ahocorasick.Automaton()
        for needle, same in numbers.items():
            built.add_word(needle, tuple(same))
        if numbers:
            built.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = built if numbers else None
    return _AUTOMATA[name]


def contained_rows(texts: DataFrame, text_col: str, dictionary: DataFrame, needle_col: str, out: str = "hits", ordered: bool = True,
                   form: Callable | None = None, then: tuple[Callable, T.StructType] | None = None) -> DataFrame:
    """`texts` with the array `out` of those rows of `dictionary` whose needle occurs in the text, in their order.

    An automaton over a block of the dictionary walks each text once. A block holds about
    BLOCK_CHARS characters and is sent to the tasks; a larger dictionary is more blocks,
    each a pass of its own that adds to the rows of the one before. Nothing is joined or
    shuffled, and a needle that occurs in every text costs no more than its hits. An empty
    or null needle is in no text, a null text holds none. Without `ordered` the rows come in any order.
    With `form` a text is first replaced by form(text). With `then`, (function, schema), the last pass hands its batches on to the function in
    the same worker: they have `out`, and after an earlier pass `_before` with the rows it found.
    """
    import pyarrow as pa

    usable = dictionary.filter(F.length(needle_col) > 0)
    total = usable.agg(F.sum(F.length(needle_col))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    entry = T.ArrayType(T.StructType(dictionary.schema.fields))
    spark, rows = texts.sparkSession, texts
    at, texts_field = texts.columns.index(text_col), to_arrow_schema(texts.schema).field(text_col)
    for block in range(blocks):
        table = usable.filter(F.pmod(F.xxhash64(needle_col), F.lit(blocks)) == block).toArrow()  # BLOCK_CHARS bounds it
        table = pa.Table.from_arrays(table.columns, schema=to_arrow_schema(dictionary.schema)).combine_chunks()
        shared, name = spark.sparkContext.broadcast(table), uuid.uuid4().hex
        schema = T.StructType([*texts.schema.fields, T.StructField(out, entry)])
        finish = then if block + 1 == blocks else None

        def walk(batches, shared=shared, name=name, form=form if block == 0 else None):
            import numpy as np

            entries = pa.StructArray.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in shared.value.columns], fields=list(shared.value.schema))
            built = _automaton(name, shared.value[needle_col].to_pylist())
            for batch in batches:
                values = batch.column(text_col).to_pylist()
                if form:
                    values = [form(x) for x in values]
                    batch = batch.set_column(at, texts_field, pa.array(values, texts_field.type))
                found = [sorted({i for _, same in built.iter(x) for i in same}) if built and x else [] for x in values]
                ends = np.cumsum([0] + [len(f) for f in found])
                hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries.take(pa.array([i for f in found for i in f], pa.int64())))
                yield pa.RecordBatch.from_arrays([*batch.columns, hits], [*batch.schema.names, out])

        if finish:
            if block:
                rows = rows.withColumnRenamed(out, "_before")
            return rows.mapInArrow(lambda batches, walk=walk, go_on=finish[0]: go_on(walk(batches)), finish[1])
        if block:
            before = rows.withColumnRenamed(out, "_before")
            wide = T.StructType([*before.schema.fields, T.StructField(out, entry)])
            rows = before.mapInArrow(walk, wide).withColumn(out, F.concat("_before", out)).drop("_before")
        else:
            rows = rows.mapInArrow(walk, schema)
        if block + 1 < blocks:
            rows = cut_lineage(rows)  # one automaton at a time
    return rows.withColumn(out, F.sort_array(out)) if ordered else rows


# --- alias dictionary -------------------------------------------------------

def alias_rows(spark: SparkSession, table: DataFrame | None = None) -> DataFrame:
    """Built-in rows, then the table's rows, with the order that decides overrides.

    `table` needs ord, canonical_name, alias, alias_type, language, boost (null: 1.0).
    """
    names = ["ord", "canonical_name", "alias", "alias_type", "language", "boost"]
    entries = [F.struct(*[F.lit(v).cast("long" if n == "ord" else "double" if n == "boost" else "string").alias(n)
                          for n, v in zip(names, (i, *row))]) for i, row in enumerate(fv.ALIASES)]
    builtin = spark.range(1).select(F.inline(F.array(*entries)))
    rows = builtin.withColumn("source", F.lit(0))
    if table is not None:
        rows = rows.unionByName(table.select(*builtin.columns).withColumn("source", F.lit(1)))
    return rows.select(
        F.struct("source", "ord").alias("place"), "canonical_name", "alias", "alias_type", "language",
        F.coalesce("boost", F.lit(1.0)).alias("boost"),
        tx.normalise(F.col("alias")).alias("alias_norm"),
        tx.normalise(F.col("canonical_name")).alias("canonical_norm"),
    )


def alias_groups(aliases: DataFrame) -> DataFrame:
    """(canonical_norm, surface): every spelling that belongs to a canonical name."""
    usable = aliases.filter((F.col("alias_norm") != "") & (F.col("canonical_norm") != ""))
    return usable.select("canonical_norm", F.explode(F.array("canonical_name", "alias")).alias("surface")).distinct()


def alias_lookup(aliases: DataFrame) -> DataFrame:
    """(term_norm, canonical_norm): what a spelling means; the latest row wins.

    Alike rows are first reduced to the last of them, which needs no sort of the dictionary.
    """
    usable = aliases.filter((F.col("alias_norm") != "") & (F.col("canonical_norm") != ""))
    writes = usable.select(F.col("place.source").alias("source"), F.col("place.ord").alias("ord"), "canonical_norm",
                           F.posexplode(F.array("alias_norm", "canonical_norm")).alias("step", "term_norm"))
    last = writes.groupBy("term_norm", "canonical_norm", "source", "step").agg(F.max("ord").alias("ord"))
    return last.groupBy("term_norm").agg(
        F.max_by("canonical_norm", F.struct("source", "ord", "step")).alias("canonical_norm"))


def spellings(aliases: DataFrame) -> DataFrame:
    """(canonical_norm, variant_norm, variant): of the spellings of a canonical name with one normal form the longest, then the greatest.

    The distinct spellings are written first: only those are sorted, however many rows the dictionary has for them.
    """
    groups = cut_lineage(alias_groups(aliases)).withColumn("variant_norm", tx.normalise(F.col("surface"))).filter("variant_norm <> ''")
    best = groups.groupBy("canonical_norm", "variant_norm").agg(F.max(F.struct(F.length("surface"), "surface")).alias("b"))
    return best.select("canonical_norm", "variant_norm", F.col("b.surface").alias("variant"))


def expand_terms(terms: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Each term with all spellings of its canonical name, in first-seen order.

    `terms` needs `keys`, pos, term. Gives `keys`, pos, variant, variant_norm:
    one row per normal form, `pos` counting from 0.

    How many rows come out is counted first, and the work is cut into parts of about SPELLED
    of them. Terms and spellings meet by canonical name and cell, a hash of the key, so a name
    that many terms mean is many tasks; the rows that come out are dealt once, by key, and put
    in order there.
    """
    lookup, known = cut_lineage(alias_lookup(aliases)), spellings(aliases)
    found = cut_lineage(terms.withColumn("term_norm", tx.normalise(F.col("term"))).filter("term_norm <> ''")
                        .join(lookup, "term_norm", "left").select(*keys, "pos", "term", "term_norm", "canonical_norm"))
    times, sizes = (df.groupBy("canonical_norm").agg(F.count(F.lit(1)).alias(n)) for df, n in ((found, "_times"), (known, "_size")))
    total = times.join(sizes, "canonical_norm", "left").agg(F.sum(F.col("_times") * (1 + F.coalesce("_size", F.lit(0))))).first()[0] or 0
    parts, meet = max(1, -(-total // SPELLED)), ["canonical_norm", "_cell"]
    asked = found.filter("canonical_norm IS NOT NULL").select(*keys, "pos", "canonical_norm", F.pmod(F.xxhash64(*keys), F.lit(parts * CELLS_PER_PART)).alias("_cell"))
    given = known.join(asked.select(*meet).distinct(), "canonical_norm").repartition(parts, *meet)
    others = asked.repartition(parts, *meet).join(given, meet).select(*keys, "pos", "variant", "variant_norm")
    own = found.select(*keys, "pos", F.col("term").alias("variant"), F.col("term_norm").alias("variant_norm"))
    best = F.struct(-F.col("pos"), F.length("variant"), F.col("variant"))
    kept = own.unionByName(others).repartition(parts, *keys).groupBy(*keys, "variant_norm").agg(F.max(best).alias("b"))
    order = Window.partitionBy(*keys).orderBy(F.col("b").desc())
    return kept.select(*keys, (F.row_number().over(order) - 1).cast("long").alias("pos"),
                       F.col("b.variant").alias("variant"), "variant_norm")


# --- keywords ---------------------------------------------------------------

KEYWORDS = T.ArrayType(T.StructType([T.StructField("keyword", T.StringType()), T.StructField("normalized_keyword", T.StringType()),
                                      T.StructField("keyword_type", T.StringType()), T.StructField("weight", T.DoubleType())]))


def alias_writes(aliases: DataFrame) -> DataFrame:
    """What a found alias writes: a row per needle and key with its last entry, the place of that and of the first.

    An alias writes its own key and that of its canonical name. Aliases of one spelling are
    found together, so of all they write to a key only the last entry and the first place
    count, however many rows the dictionary has for it.
    """
    place = [F.col("place.source").alias("source"), F.coalesce("place.ord", F.lit(-(1 << 63))).alias("ord"), F.col("alias").alias("by"),
             *[F.coalesce(c, F.lit("")).alias(c) for c in ("canonical_name", "alias_type")], F.col("boost").alias("by_boost")]

    def write(key, keyword, kind, weight, step):
        return F.struct(key.alias("key"), keyword.alias("keyword"), kind.alias("kind"), weight.alias("weight"), F.struct(*place, F.lit(step).alias("step")).alias("at"))

    both = F.array(write(F.col("alias_norm"), F.col("alias"), F.col("alias_type"), F.col("boost"), 0),
                   write(F.col("canonical_norm"), F.col("canonical_name"), F.lit("canonical"), F.col("boost") + F.lit(fv.CANONICAL_BONUS), 1))
    writes = aliases.filter("alias_norm <> ''").select(F.col("alias_norm").alias("needle"), F.inline(both)).filter("key <> ''")
    return writes.groupBy("needle", "key").agg(
        F.max_by(F.struct("keyword", "kind", "weight"), "at").alias("entry"), F.min("at").alias("first"), F.max("at").alias("last"))


def distinct_terms(normal: str, known: dict[str, list[str]]) -> list[str]:
    """The distinct search terms of a normal text, stop words left out, in first-seen order.

    A term never holds a space, so each distinct piece between spaces is looked at once;
    `known` keeps the terms of pieces that are not a term as they stand.
    """
    pieces = list(dict.fromkeys(normal.split(" ")))
    out, whole = [], True
    for piece in pieces:
        if 1 < len(piece) < 65 and piece.isalnum() and piece.isascii():
            if piece not in _STOP:
                out.append(piece)
            continue
        found = known.get(piece)
        if found is None:
            found = known[piece] = [t for t in _TERM.findall(piece) if t not in _STOP]
        if found:
            whole = False
            out += found
    return out if whole else list(dict.fromkeys(out))


def _weight(term: str) -> float:
    return fv.HANGUL_TOKEN_WEIGHT if "가" <= term[0] <= "힣" else fv.TOKEN_WEIGHT


def ranked_terms(terms: list[str], limit: int) -> list[str]:
    """The terms by weight and length, both falling; equal ones stay in order."""
    best = sorted(terms, key=len, reverse=True)
    hangul = [t for t in best if not t.isascii()]
    return (hangul + [t for t in best if t.isascii()] if hangul else best)[:limit]


def ranked_keywords(terms: list[str], writes: list[tuple], limit: int) -> list[tuple]:
    """(keyword, key, kind, weight) of one text, best first, from its terms and what its aliases write: (first, last, key, keyword, kind, weight).

    Later writes replace earlier ones of the same key but keep its place: tokens first,
    then keys in the order in which they were first written.
    """
    if not writes:
        return [(t, t, "token", _weight(t)) for t in ranked_terms(terms, limit)]
    firsts, lasts = {}, {}
    for first, last, key, *entry in writes:
        if key not in lasts or last > lasts[key][0]:
            lasts[key] = (last, entry)
        if key not in firsts or first < firsts[key]:
            firsts[key] = first
    place = {t: i for i, t in enumerate(terms)}
    kept = ranked_terms([t for t in terms if t not in lasts], limit)  # no other token can be among the best
    found = [(-_weight(t), -len(t), place[t], t, t, "token", _weight(t)) for t in kept]
    for i, key in enumerate(sorted(firsts, key=firsts.get)):
        keyword, kind, weight = lasts[key][1]
        found.append((-weight, -len(key), place.get(key, len(terms) + i), keyword, key, kind, weight))
    return [f[3:] for f in sorted(found, key=lambda f: f[:3])[:limit]]


def keyword_lists(texts: DataFrame, keys: list[str], text_col: str, aliases: DataFrame | None = None,
                  limit: int = fv.MAX_KEYWORDS) -> DataFrame:
    """(keys, keywords): the ranked keywords of each text as an array, a map-only job.

    The dictionary is walked by automata, block by block, and texts are put in normal form and
    ranked in the same Arrow batches.
    """
    normal = texts.select(*keys, F.col(text_col).alias("normal"))
    writes = alias_writes(alias_rows(texts.sparkSession) if aliases is None else aliases)
    if aliases is not None:
        writes = cut_lineage(writes)  # read once to count, then block by block
    out = T.StructType([*[normal.schema[k] for k in keys], T.StructField("keywords", KEYWORDS)])
    schema = to_arrow_schema(out)

    def rank(batches):
        import numpy as np
        import pyarrow as pa

        fields = list(schema.field("keywords").type.value_type)
        known: dict[str, list[str]] = {}
        for batch in batches:
            written = [_written(batch.column(c)) for c in ("_before", "hits") if c in batch.schema.names]
            sizes, tokens, other = [0], [], {}
            if len(known) > PIECES_KNOWN:
                known.clear()
            for i, text in enumerate(batch.column("normal").to_pylist()):
                terms, found = distinct_terms(text, known), [w for rows in written for w in rows.get(i, ())]
                if not found:
                    tokens += ranked_terms(terms, limit)
                else:
                    for keyword, key, kind, weight in ranked_keywords(terms, found, limit):
                        if kind != "token" or keyword != key:
                            other[len(tokens)] = keyword, kind, weight
                        tokens.append(key)
                sizes.append(len(tokens))
            key = pa.array(tokens, pa.string())
            weights = np.fromiter(map(_weight, tokens), np.float64, len(tokens))
            if other:
                names, kinds = list(tokens), ["token"] * len(tokens)
                for at, entry in other.items():
                    names[at], kinds[at], weights[at] = entry
                names, kinds = pa.array(names, pa.string()), pa.array(kinds, pa.string())
            else:
                names, kinds = key, pa.repeat(pa.scalar("token"), len(tokens))
            entries = pa.StructArray.from_arrays([names, key, kinds, pa.array(weights)], fields=fields)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], lists], out.names)

    return contained_rows(normal, "normal", writes, "needle", ordered=False, form=tx.normalised, then=(rank, out))


def _written(hits) -> dict[int, list[tuple]]:
    """(first, last, key, keyword, kind, weight) of every entry found, by the row of the batch that holds it."""
    import numpy as np
    import pyarrow.compute as pc

    flat = hits.flatten()
    if not len(flat):
        return {}
    place = lambda name: zip(*[c.to_pylist() for c in flat.field(name).flatten()])
    rows = zip(place("first"), place("last"), flat.field("key").to_pylist(), *[c.to_pylist() for c in flat.field("entry").flatten()])
    out: dict[int, list[tuple]] = {}
    for i, row in zip(np.repeat(np.arange(len(hits)), pc.fill_null(pc.list_value_length(hits), 0).to_numpy()).tolist(), rows):
        out.setdefault(i, []).append(row)
    return out


def keyword_rows(lists: DataFrame) -> DataFrame:
    """One row per keyword of `keyword_lists`: keys, rank, keyword, type, weight."""
    keys = [c for c in lists.columns if c != "keywords"]
    rows = lists.select(*keys, F.posexplode("keywords").alias("at", "k"))
    return rows.select(*keys, (F.col("at") + 1).alias("rank"), "k.keyword", "k.normalized_keyword", "k.keyword_type", "k.weight")


def keyword_index(texts: DataFrame, keys: list[str], text_col: str, aliases: DataFrame | None = None,
                  limit: int = fv.MAX_KEYWORDS) -> DataFrame:
    """One row per keyword of each text: `keys`, rank, keyword, type, weight; map-only."""
    return keyword_rows(keyword_lists(texts, keys, text_col, aliases, limit))


# --- full text --------------------------------------------------------------

def postings(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(term, keys, tf). The key holds the text's id, so no term makes a hot group."""
    return (texts.select(*keys, F.explode(tx.index_tokens(F.col(text_col))).alias("term"))
            .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")))


@dataclass(frozen=True)
class TermIndex:
    """Stored word counts of chunks (chunk_id, size, what the access rule reads, terms, tfs), (term, df), and one row (n, mean_size)."""

    counts: DataFrame
    terms: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, chunk_id, dept_id, folder_id, tf, size): a row per word of each chunk."""
        return posting_rows(self.counts)


def posting_rows(counts: DataFrame) -> DataFrame:
    keys = [c for c in counts.columns if c not in ("size", "terms", "tfs")]
    rows = counts.select(*keys, "size", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return rows.select(F.col("p.terms").alias("term"), *keys, F.col("p.tfs").alias("tf"), "size")


def word_counts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dept_id, folder_id, size, terms, tfs): the words of each chunk, counted inside its row, no shuffle."""
    keys = [c for c in ("chunk_id", "dept_id", "folder_id") if c in chunks.columns]
    spaced = chunks.select(*keys, F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N} ]+", " ").alias("words"))
    out = T.StructType([*[spaced.schema[k] for k in keys], T.StructField("size", T.IntegerType()),
                        T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def count(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [Counter((text or "").split(" ")) for text in batch.column("words").to_pylist()]
            for words in found:
                words.pop("", None)
            ends = pa.array(np.cumsum([0] + [len(f) for f in found]), pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array([w for f in found for w in f], pa.string()))
            tfs = pa.ListArray.from_arrays(ends, pa.array([n for f in found for n in f.values()], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array([sum(f.values()) for f in found], pa.int32()), terms, tfs], out.names)

    return spaced.mapInArrow(count, out)


def term_index(chunks: DataFrame, store) -> TermIndex:
    """The index of `chunks`; `store(df, name)` writes a table and gives it back as read.

    A chunk's words stay in its row, so that a search adds up all of a chunk's score in one
    task; nothing is shuffled but counts of words.
    """
    counts = store(word_counts(chunks), "postings")
    terms = store(counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    totals = store(counts.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size")), "totals")
    return TermIndex(counts, terms, totals)


def term_frequencies(texts: DataFrame, text_col: str) -> DataFrame:
    """(term, df): in how many texts a term occurs; counted per task first."""
    return (texts.select(F.explode(F.array_distinct(tx.index_tokens(F.col(text_col)))).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
