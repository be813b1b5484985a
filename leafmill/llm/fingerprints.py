"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed, runs of `gram` words get a rolling hash (words' hashes rotated and
xored, so the next one follows from the last), and of every `window` consecutive ones
the least is kept, the rightmost if several, with its place. Any run of
gram + window - 1 words that two texts share leaves a common hash in both prints.

Short texts use smaller windows, so that they too keep a handful of hashes; what a
wide window keeps, a narrower one keeps as well, so the guarantee holds across lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import cut_lineage

GRAM, WINDOW = 3, 8
#: Rows of a bucket of the order, about; coarse ranges that the driver keeps bounds of.
BUCKET_ROWS, RANGES = 512, 256
_PLACES = 0xFFFFFFFF


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def winnow(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """`df` with `out`: the kept places of `text`, as hash * 2**32 + (2**32 - 1 - word number), in order of place.

    White space parts words. A text of fewer than `gram` words is one gram; one without
    words has no place; a null text gives null. `window` is a power of two. Each step is
    a column of its own, so that no lambda evaluates an array anew.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    w, h, g, n = (f"_{out}_{x}" for x in "whgn")
    df = df.withColumn(w, F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x))).drop(w)
    df = df.withColumn(n, F.when(F.col(h).isNotNull(), F.greatest(F.size(h) - gram + 1, F.lit(0))))
    rolled = F.slice(h, F.lit(1), F.col(n))
    for j in range(1, gram):
        rolled = F.zip_with(rolled, F.slice(h, F.lit(j + 1), F.col(n)), lambda a, b: _rotated(a, 1).bitwiseXOR(b))
    few = F.aggregate(h, F.lit(0).cast("long"), lambda a, b: _rotated(a, 1).bitwiseXOR(b))
    df = df.withColumn(g, F.when(F.col(n) > 0, rolled).when(F.size(h) > 0, F.array(few)).when(F.col(h).isNotNull(), F.array().cast("array<long>")))
    df = df.withColumn(n, F.size(g)).withColumn(g, F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32).bitwiseOR(F.lit(_PLACES) - i)))
    step = 1
    while step < window:
        # after this step each entry is the least of 2 * step neighbours; texts with few grams stop earlier
        length = F.col(n) - step
        least = F.zip_with(F.slice(g, F.lit(1), length), F.slice(g, F.lit(step + 1), length), lambda a, b: F.least(a, b))
        long_enough = F.col(n) >= 16 * step
        df = df.withColumn(g, F.when(long_enough, least).otherwise(F.col(g))).withColumn(n, F.when(long_enough, length).otherwise(F.col(n)))
        step *= 2
    return df.withColumn(out, F.array_distinct(g)).drop(h, g, n)


def printed(kept: Column | str) -> Column:
    """A fingerprint as text: hash@place, by place."""
    return F.concat_ws(" ", F.transform(kept, lambda p: F.concat(
        F.lpad(F.hex(F.shiftright(p, 32)), 8, "0"), F.lit("@"), (F.lit(_PLACES) - p.bitwiseAND(F.lit(_PLACES))).cast("string"))))


def likeness(a: Column | str, b: Column | str) -> Column:
    """2 * common / (all of both), over the distinct hashes of two prints; 1 if both are empty."""
    x, y = (F.array_distinct(F.transform(k, lambda p: F.shiftright(p, 32))) for k in (a, b))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def _bucket(documents: DataFrame, ident: str) -> Column | None:
    """A bucket that grows with the id and holds about BUCKET_ROWS rows, wherever ids crowd; None if there are no ids.

    Bounds of RANGES ranges of about equal numbers of rows come from the ids of all
    rows; each range is cut evenly again. The driver keeps RANGES bounds and a count.
    """
    share = [i / RANGES for i in range(RANGES + 1)]
    row = documents.agg(F.count(ident).alias("n"), F.percentile_approx(ident, share, 20_000).alias("q"), F.min(ident).alias("lo"), F.max(ident).alias("hi")).first()
    if not row["n"]:
        return None
    bounds = sorted({row["lo"], row["hi"], *row["q"]})
    per_range = -(-row["n"] // RANGES)
    parts = -(-per_range // BUCKET_ROWS)
    lows = F.array(*[F.lit(b).cast("long") for b in bounds])
    widths = F.array(*[F.lit(max(1, -(-((bounds[i + 1] if i + 1 < len(bounds) else b + 1) - b) // parts))).cast("long") for i, b in enumerate(bounds)])
    at = F.size(F.filter(lows, lambda b: b <= F.col(ident)))
    return at.cast("long") * (1 << 32) + F.floor((F.col(ident) - F.element_at(lows, at)) / F.element_at(widths, at))


def with_next(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, next_text, edge): the text of the row with the next id, after the last that of the first.

    Rows are sorted bucket by bucket, one shuffle of the texts; a bucket's last row
    (`edge`) takes the first of the next bucket, found among ids alone. Rows of one id
    stand in the order of their texts. A row without an id has no next text.
    """
    rows = documents.select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    bucket = _bucket(rows, "id")
    alone = rows.filter("id IS NULL").select("id", "text", F.lit(None).cast("string").alias("next_text"), F.lit(False).alias("edge"))
    if bucket is None:
        return alone
    placed = rows.filter("id IS NOT NULL").withColumn("bucket", bucket)
    heads = placed.groupBy("bucket").agg(F.min("id").alias("head"))
    heads = cut_lineage(heads)
    ahead = heads.select((F.col("bucket") - 1).alias("bucket"), F.col("head").alias("next_head"))
    beside = heads.join(ahead, "bucket", "left")
    # buckets whose neighbour number is not there (ends of ranges, gaps): few rows, put in order together
    open_ends = beside.filter("next_head IS NULL").select("bucket", F.lit(None).cast("long").alias("start"))
    starts = heads.join(heads.select((F.col("bucket") + 1).alias("bucket")), "bucket", "left_anti").select((F.col("bucket") - 0.5).alias("at"), F.col("head").alias("start"), F.lit(None).cast("long").alias("bucket"))
    line = open_ends.select(F.col("bucket").cast("double").alias("at"), "start", "bucket").unionByName(starts)
    order = Window.orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gaps = line.withColumn("next_head", F.coalesce(F.first("start", True).over(order), F.first("start", True).over(whole))).filter("bucket IS NOT NULL").select("bucket", "next_head")
    edges = beside.filter("next_head IS NOT NULL").select("bucket", "next_head").unionByName(gaps)
    edges = cut_lineage(edges)  # a small table of known size, so the planner may broadcast it
    first_text = rows.join(edges.select(F.col("next_head").alias("id")).distinct(), "id").groupBy("id").agg(F.min("text").alias("edge_text"))
    tail = edges.join(first_text, edges["next_head"] == first_text["id"]).select("bucket", "edge_text")
    inside = Window.partitionBy("bucket").orderBy("id", "text")
    led = placed.withColumn("next_text", F.lead("text").over(inside)).withColumn("edge", F.lead(F.lit(True)).over(inside).isNull())
    parted = led.join(tail, "bucket", "left")
    text_next = F.when(F.col("edge"), F.col("edge_text")).otherwise(F.col("next_text")).alias("next_text")
    return parted.select("id", "text", text_next, "edge").unionByName(alone)


def fingerprint_documents(documents: DataFrame, gram: int = GRAM, window: int = WINDOW, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kept, fingerprint) of every row, map-only; null counts as empty, and an empty text has an empty print."""
    rows = documents.select(F.col(ident).alias(ident), F.coalesce(text, F.lit("")).alias("_text"))
    return winnow(rows, "_text", "kept", gram, window).select(ident, "kept", printed("kept").alias("fingerprint"))


def edited_fingerprints(documents: DataFrame, gram: int = GRAM, window: int = WINDOW, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Prints of each text, of its edit with the next text, and their likeness (id, n_chars, edited_sha256, ...)."""
    rows = with_next(documents, ident, text)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.coalesce(F.substring("next_text", F.lit(1), half), F.lit(""))))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = winnow(winnow(rows, "text", "own", gram, window), "edited", "other", gram, window).drop("text", "edited")
    rows = winnow(rows, "next_text", "following", gram, window).drop("next_text")
    none = F.array().cast("array<long>")
    return rows.select(F.col("id").alias(ident), "n_chars", "edited_sha256", printed("own").alias("fingerprint"), printed("other").alias("edited_fingerprint"),
                       likeness("own", "other").alias("near_edited"), likeness("own", F.coalesce("following", none)).alias("near_next"))
