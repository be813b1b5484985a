"""Log and ingest work as Structured Streaming. Each job has a batch form with the same result."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import fixed_values as fv
from leafmill.functions.ordered import nearest_in_order
from leafmill.operators import blocks as bk
from leafmill.operators import chunks as ck
from leafmill.operators import reports as rp
from leafmill.operators import terms as tm
from leafmill.operators.lockouts import lockouts, sign_in  # noqa: F401  (the batch form)
from leafmill.operators.retrieval import chunk_key
from leafmill.session import cut_lineage, stored

# --- ingest of new files ----------------------------------------------------

FILES = ("path string, doc_id long, markdown string, "
         "pages array<struct<page_num:int,text:string>>, images array<struct<path:string,page_num:int>>")


def chosen_files(names: DataFrame, known: DataFrame | None) -> DataFrame:
    """(path, hash, doc_id, times, alone) of the files to read, from (path, hash, doc_id): one row per path.

    `times` counts the rows of that path and hash; `alone` says that no other file to read has the doc_id.
    Texts take no part, so that none of them is shuffled to find out which are read.
    """
    alike = names.filter("path IS NOT NULL AND hash IS NOT NULL").groupBy("path", "hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"))
    files = alike.groupBy("path").agg(F.min(F.struct("hash", "doc_id", "times")).alias("f")).select("path", "f.*")

    def first_of_equal(rows):
        return rows.groupBy("hash").agg(F.min(F.struct("path", "doc_id", "times")).alias("f")).select("f.path", "hash", "f.doc_id", "f.times")

    if known is None:
        found = first_of_equal(files)
    else:
        latest = known.groupBy("path").agg(F.max_by(F.struct("doc_id", "hash"), "batch").alias("was"))
        placed = files.join(latest, "path", "left")
        changed = placed.filter(F.col("was.hash") != F.col("hash")).select("path", "hash", "was.doc_id", "times")
        fresh = placed.filter("was IS NULL").drop("was").join(latest.select(F.col("was.hash").alias("hash")).distinct(), "hash", "left_anti")
        found = changed.unionByName(first_of_equal(fresh))
    return found.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("doc_id")) == 1)


def files_of(hashed: DataFrame, chosen: DataFrame, repeated: bool = True) -> DataFrame:
    """The chosen of the files with their hash, one row each. `repeated`: some have several rows with one path and hash."""
    rows = hashed.drop("doc_id").join(chosen.drop("times").hint("shuffle_hash"), ["path", "hash"])
    return rows.dropDuplicates(["path", "hash"]) if repeated else rows


def new_documents(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """Files to read: known paths with other content, and unknown paths with unknown content.

    `known` holds (path, doc_id, hash, batch) of every batch so far; the latest row of
    a path counts. A file that changed keeps the doc_id of its path. Of equal unknown
    files the smallest path is read; of rows of one path that with the smallest hash.
    """
    hashed = files.withColumn("hash", F.sha2("markdown", 256))
    return files_of(hashed, chosen_files(hashed.select("path", "hash", "doc_id"), known)).select("hash", *files.columns)


TABLES = ("documents", "blocks", "chunks", "keywords")
MOST_WORDS = 500_000  # words of 64 ids that `current_rows` sends to the tasks, at most
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffled files go when their query has ended, not when the driver collects garbage
_KEEP: ContextVar[Callable[[str, DataFrame], DataFrame] | None] = ContextVar("keep", default=None)  # in a stream's batch: writes a table where it is kept


def finished_batches(spark: SparkSession, target: str) -> DataFrame:
    """(batch, n_documents) of the batches whose tables are all written: their marks are written last."""
    return spark.read.schema("n_documents long, batch long").parquet(f"{target}/finished")


def current_rows(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table of the ingest as it stands: of each document the rows of its latest finished batch.

    A changed file writes its document, blocks, chunks and keywords anew; what older
    batches wrote of it is passed over. A batch that is still being written, or that was
    stopped, has no mark, so its tables become visible together or not at all.

    The documents that a later batch replaced are written first, as a bit for each id in words of 64 ids of a batch.
    Up to MOST_WORDS words go to the tasks, and the table's rows are read where they lie; more are joined with them.
    """
    marks = [r.batch for r in finished_batches(spark, target).select("batch").distinct().collect()]
    finished = lambda at: spark.read.parquet(f"{target}/{at}").withColumn("batch", F.col("batch").cast("long")).filter(F.col("batch").isin(marks) & F.col("doc_id").isNotNull())
    rows = finished(name)
    if len(marks) < 2:
        return rows.drop("batch")
    batches = finished("documents").groupBy("doc_id").agg(F.collect_set("batch").alias("b")).filter(F.size("b") > 1)
    replaced = batches.select("doc_id", F.explode(F.array_remove("b", F.array_max("b"))).alias("batch"))
    word, bit = F.shiftright("doc_id", 6).alias("_word"), F.col("doc_id").bitwiseAND(63).cast("int")
    words = cut_lineage(replaced.groupBy("batch", word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits")))
    passed = words if words.count() > MOST_WORDS else F.broadcast(words)
    held = F.call_function("shiftright", F.coalesce("_bits", F.lit(0).cast("long")), bit).bitwiseAND(1) == 0
    return rows.withColumn("_word", F.shiftright("doc_id", 6)).join(passed, ["batch", "_word"], "left").filter(held).select(*[c for c in rows.columns if c != "batch"])


def compact_ingest(spark: SparkSession, target: str, compacted: str) -> None:
    """Write the current rows of every table to `compacted` as one finished batch; the next ingest may go on from there.

    Rows that later batches pass over, and batches without a mark, are left behind.
    """
    number = finished_batches(spark, target).agg(F.max("batch")).first()[0]
    for name in TABLES:
        stored(current_rows(spark, target, name), f"{compacted}/{name}/batch={number}")
    _mark(spark, compacted, number)


def _mark(spark: SparkSession, target: str, number: int) -> None:
    rows = spark.read.parquet(f"{target}/documents/batch={number}")
    rows.agg(F.count(F.lit(1)).alias("n_documents")).write.mode("overwrite").parquet(f"{target}/finished/batch={number}")


def ingest_tables(new: DataFrame, settle: Callable[[DataFrame], DataFrame] = cut_lineage) -> dict[str, DataFrame]:
    """The tables of new documents. Blocks and chunks are settled first, so that pages are parsed once, not once per table.

    In a batch of `ingest_stream` they are settled by writing them where they are kept. With the
    column `alone` of `chosen_files` chunks are numbered without a shuffle.
    """
    keep = _KEEP.get()
    settled = lambda name, table: keep(name, table) if keep else settle(table)
    alone = "alone" in new.columns
    blocks = settled("blocks", bk.numbered_blocks(new, "alone") if alone else bk.finish_blocks(bk.parsed_blocks(new)))
    chunks = ck.chunk_blocks(blocks, first="first_chunk" if alone else None)
    chunks = settled("chunks", chunks.withColumn("chunk_id", chunk_key(F.col("doc_id"), F.col("chunk_idx"))))
    return {
        "documents": document_rows(new),
        "blocks": blocks, "chunks": chunks,
        "keywords": tm.keyword_index(chunks, ["chunk_id", "doc_id"], "content"),
    }


def document_rows(files: DataFrame) -> DataFrame:
    return files.select("doc_id", "path", "hash", F.lit("pending").alias("status"))


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000):
    """Start the ingest of parsed files from `source` into tables under `target`.

    A batch writes folders named by its number, then its mark, and compares itself only
    with other finished batches, so a batch that runs again gives the same tables.
    Removals cannot be seen by a file source; the batch comparison finds them.
    """
    files = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession  # of this stream alone
        spark.conf.set(CLEANED, "true")
        known = None
        if number > 0:
            known = spark.read.schema("path string, doc_id long, hash string, batch long").parquet(f"{target}/documents").filter(F.col("batch") < number)
            known = known.join(finished_batches(spark, target).select("batch"), "batch", "left_semi")
        hashed = batch.withColumn("hash", F.sha2("markdown", 256))
        chosen = cut_lineage(chosen_files(hashed.select("path", "hash", "doc_id"), known))
        paged = F.coalesce(F.size("pages"), F.lit(0)) > 0  # then the markdown is not read
        new = files_of(hashed.withColumn("markdown", F.when(~paged, F.col("markdown"))), chosen, not chosen.filter("times > 1").isEmpty())
        kept: dict[str, DataFrame] = {}

        def keep(name: str, table: DataFrame) -> DataFrame:
            kept[name] = stored(table, f"{target}/{name}/batch={number}")
            return kept[name]

        token = _KEEP.set(keep)
        try:
            tables = {**ingest_tables(new), "documents": document_rows(chosen)}
        finally:
            _KEEP.reset(token)
        for name, table in tables.items():
            if table is not kept.get(name):
                keep(name, table)
        _mark(spark, target, number)

    return (files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# --- module statistics per window -------------------------------------------

def windowed_module_stats(events: DataFrame, size: str = "1 day", slide: str | None = None,
                          watermark: str = "1 hour") -> DataFrame:
    """Module measures per time window of `ts`; the watermark counts only on a stream."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), "module").agg(*rp.module_measures()).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "module",
        "total_events", "errors", "warnings", "avg_duration_ms")


# --- stage durations ---------------------------------------------------------

def stage_pairs(starts: DataFrame, ends: DataFrame, within: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Starts left-joined with all ends of the same (trace, stage) inside a time range.

    Both inputs need trace_id, stage, ts, ord; ends also event_type. On streams
    a start without an end is given out once the watermark has passed its range.
    `nearest_ends` then keeps one end per start.
    """
    if starts.isStreaming:
        starts, ends = starts.withWatermark("ts", watermark), ends.withWatermark("ts", watermark)
    s = starts.select("trace_id", "stage", F.col("ts").alias("started_at"), F.col("ord").alias("start_ord"))
    e = ends.select(F.col("trace_id").alias("_trace"), F.col("stage").alias("_stage"), F.col("ts").alias("ended_at"),
                    F.col("ord").alias("end_ord"), F.col("event_type").alias("outcome"))
    same = ((F.col("trace_id") == F.col("_trace")) & (F.col("stage") == F.col("_stage"))
            & (F.col("ended_at") >= F.col("started_at"))
            & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {within}")))
    return s.join(e, same, "left").drop("_trace", "_stage")


def nearest_ends(pairs: DataFrame) -> DataFrame:
    """Of each start's ends the first, null if it has none: what a stream has written, read as a table."""
    first = F.min(F.when(F.col("ended_at").isNotNull(), F.struct("ended_at", "end_ord", "outcome"))).alias("e")
    kept = pairs.groupBy("trace_id", "stage", "started_at", "start_ord").agg(first)
    return kept.select("trace_id", "stage", "started_at", "start_ord", "e.*")


def stage_durations(starts: DataFrame, ends: DataFrame, within: str = "1 day") -> DataFrame:
    """Each start with the first end of its (trace, stage) at or after it, if that lies within the range.

    Rows are put in order day by day, so no start meets more than one end and a busy
    trace is many tasks.
    """
    s = starts.select("trace_id", "stage", "ts", F.lit(0).alias("kind"), "ord", F.lit(None).cast("string").alias("event_type"))
    e = ends.select("trace_id", "stage", "ts", F.lit(1).alias("kind"), "ord", "event_type")
    rows = s.unionByName(e).withColumn("_day", F.to_date("ts"))
    end = F.when(F.col("kind") == 1, F.struct("ts", "ord", "event_type"))
    found = nearest_in_order(rows, ["trace_id", "stage"], ["ts", "kind", "ord"], "_day", end, after="_end").filter("kind = 0")
    near = F.when(F.col("_end.ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"), F.col("_end"))
    return found.withColumn("_end", near).select(
        "trace_id", "stage", F.col("ts").alias("started_at"), F.col("ord").alias("start_ord"), F.col("_end.ts").alias("ended_at"),
        F.col("_end.ord").alias("end_ord"), F.col("_end.event_type").alias("outcome"))


# --- lockout after failed sign-ins --------------------------------------------

def lockout_stream(attempts: DataFrame, failures_to_lock: int = fv.LOCKOUT_FAILURES,
                   minutes: int = fv.LOCKOUT_MINUTES) -> DataFrame:
    """`lockouts` on a stream: the count and the lock of a user live in the state store.

    Micro-batches must come in the order of time; inside one, rows are put in order.
    """
    limit, span = failures_to_lock, minutes * 60_000_000

    def update(key, batches, state):
        import pandas as pd
        rows = pd.concat(list(batches)).sort_values(["t", "ord"])  # one user's rows of one micro-batch
        now = state.get if state.exists else (0, None)
        out = []
        for t, o, ok in zip(rows["t"].tolist(), rows["ord"].tolist(), rows["success"].tolist()):
            *now, outcome = sign_in(*now, t, bool(ok), limit, span)
            out.append((key[0], t, o, outcome, *now))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["user_id", "t", "ord", "outcome", "failures", "until"]).astype({"until": "Int64"})

    rows = attempts.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "ord", "success")
    done = rows.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, t long, ord long, outcome string, failures int, until long", "failures int, until long", "append", "NoTimeout")
    return done.select("user_id", F.timestamp_micros("t").alias("ts"), "ord", "outcome", "failures", F.timestamp_micros("until").alias("locked_until"))


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a stream over all input there is now, into a Parquet folder, and read that folder."""
    query = (stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def event_stream(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def success_flag(event_type: Column, success: list[str]) -> Column:
    return event_type.isin(success)
