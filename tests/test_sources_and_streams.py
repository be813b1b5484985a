import datetime
import hashlib
import json
import os

import pytest

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import blocks as bk
from leafmill.operators import chunks as ck
from leafmill.operators import terms as tm
from leafmill.plans import indexing as ix
from leafmill.session import cut_lineage, shared_dir
from leafmill.sources import files as fl
from leafmill.sources import tables as tb
from leafmill.streaming import jobs as jb

NOW = datetime.datetime(2024, 1, 1)


def test_file_scan(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    files = {"a.pdf": b"one", "deep/B.DocX": b"two", "deep/er/c.tiff": b"three", "skip.txt": b"no", "pdf": b"no"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    out = {r.name: (r.ext, r.size, r.hash) for r in fl.scan_files(spark, str(tmp_path)).collect()}
    assert out == {"a.pdf": ("pdf", 3, hashlib.sha256(b"one").hexdigest()), "B.DocX": ("docx", 3, hashlib.sha256(b"two").hexdigest()),
                   "c.tiff": ("tiff", 5, hashlib.sha256(b"three").hexdigest())}
    assert [r.name for r in fl.scan_files(spark, str(tmp_path), recursive=False).collect()] == ["a.pdf"]


def test_user_feed(spark, tmp_path):
    (tmp_path / "users.csv").write_text("email,usr_name,dept_id,role_id\na@x,A,1,2\nb@x,B,oops,3\n")
    rows = fl.read_user_feed(spark, str(tmp_path / "users.csv")).orderBy("ord").collect()
    assert [(r.email, r.dept_id, r.role_id) for r in rows] == [("a@x", 1, 2), ("b@x", None, 3)]


def test_parsed_pages(spark, tmp_path):
    docs = [{"doc_id": 1, "markdown": "m", "total_pages": 2, "pages": [{"page_num": 1, "text": "a"}, {"page_num": 3, "text": "b"}], "images": []},
            {"doc_id": 2, "markdown": "whole", "total_pages": 1, "pages": []}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, docs)))
    rows = fl.parsed_pages(fl.read_parsed(spark, str(tmp_path))).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.page_num, r.text) for r in rows] == [(1, 1, "a"), (1, 3, "b"), (2, None, "whole")]


def test_replace_documents(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(i, f"old{i}") for i in range(20)], "doc_id long, v string")
    tb.write_by_document(base, path, 4)
    new = spark.createDataFrame([(3, "new3"), (3, "new3b"), (99, "new99")], "doc_id long, v string")
    processed = spark.createDataFrame([(3,), (4,), (99,)], "doc_id long")
    tb.replace_documents(spark, path, new, processed)
    got = sorted((r.doc_id, r.v) for r in spark.read.parquet(path).collect())
    want = sorted([(i, f"old{i}") for i in range(20) if i not in (3, 4)] + [(3, "new3"), (3, "new3b"), (99, "new99")])
    assert got == want


def test_replace_can_empty_a_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    tb.write_by_document(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, v string"), path, 1)
    none = spark.createDataFrame([], "doc_id long, v string")
    tb.replace_documents(spark, path, none, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert spark.read.schema("doc_id long, v string").parquet(path).count() == 0


def test_append_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, NOW, "m" * 3000, None, None, None), (2, NOW, "x", "E", "e" * 1500, "t" * 2500 + "end")],
                                 "id int, created_at timestamp, message string, error_type string, error_message string, traceback string")
    tb.append_log(rows, path)
    tb.append_log(rows, path)
    out = spark.read.parquet(path)
    assert out.count() == 4
    details = json.loads(out.filter("id = 2").first().details)
    assert len(out.filter("id = 1").first().message) == 2000 and out.filter("id = 1").first().details is None
    assert (len(details["error_message"]), len(details["traceback"]), details["traceback"][-3:]) == (1000, 2000, "end")


def test_index_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "NSCLC milestone text"), (2, " ".join(f"w{i}" for i in range(900)))], "doc_id long, text string")
    tables = ix.write_index(spark, docs, str(tmp_path))
    assert {n: t.count() for n, t in tables.items() if n in ("chunks", "vectors")} == {"chunks": 3, "vectors": 3}
    assert tables["keywords"].filter("normalized_keyword = 'nsclc'").count() == 1
    assert tables["postings"].filter("term = 'w500'").count() == 2  # in two overlapping windows
    assert [r.entity_name for r in tables["mentions"].filter("doc_id = 1").collect()] == ["NSCLC"]


def write_json(folder, name, docs):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(map(json.dumps, docs)))


def test_ingest_stream(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    doc = lambda i, path, text: {"path": path, "doc_id": i, "markdown": text, "pages": [{"page_num": 1, "text": text}], "images": []}
    write_json(source, "1.json", [doc(1, "/b", "EGFR text"), doc(2, "/a", "EGFR text"), doc(3, "/c", "other")])
    jb.ingest_stream(spark, source, target, progress).awaitTermination()
    write_json(source, "2.json", [doc(4, "/d", "other"), doc(5, "/e", "fresh milestone")])
    jb.ingest_stream(spark, source, target, progress).awaitTermination()
    docs = spark.read.parquet(f"{target}/documents")
    assert sorted((r.doc_id, r.path, r.batch) for r in docs.collect()) == [(2, "/a", 0), (3, "/c", 0), (5, "/e", 1)]
    assert spark.read.parquet(f"{target}/keywords").filter("normalized_keyword = 'milestone'").select("doc_id").collect()[0].doc_id == 5
    # the batch form over all files gives the same documents
    files = spark.read.schema(jb.FILES).json(source)
    batch = jb.ingest_tables(jb.new_documents(files, None))
    assert sorted(r.path for r in batch["documents"].collect()) == ["/a", "/c", "/e"]
    assert batch["keywords"].count() == spark.read.parquet(f"{target}/keywords").count()


def test_a_stopped_batch_shows_nothing(spark, tmp_path, monkeypatch):
    source, target, progress, small = (str(tmp_path / n) for n in ("in", "out", "progress", "small"))
    doc = lambda i, path, text: {"path": path, "doc_id": i, "markdown": text, "pages": [{"page_num": 1, "text": text}], "images": []}
    write_json(source, "1.json", [doc(1, "/a", "first reading"), doc(2, "/b", "stays as it is")])
    jb.ingest_stream(spark, source, target, progress).awaitTermination()
    read = lambda at=target: {n: sorted(str(r) for r in jb.current_rows(spark, at, n).collect()) for n in jb.TABLES}
    before = read()
    write_json(source, "2.json", [doc(1, "/a", "second reading"), doc(3, "/c", "new here")])
    tables = jb.ingest_tables
    monkeypatch.setattr(jb, "ingest_tables", lambda new: {**dict(list(tables(new).items())[:2]), "chunks": new.select(F.raise_error(F.lit("stopped")).alias("x"))})
    with pytest.raises(Exception, match="stopped"):
        jb.ingest_stream(spark, source, target, progress).awaitTermination()
    assert spark.read.parquet(f"{target}/documents").filter("batch = 1").count() == 2 and read() == before
    monkeypatch.setattr(jb, "ingest_tables", tables)
    jb.ingest_stream(spark, source, target, progress).awaitTermination()
    after = read()
    assert sorted((r.doc_id, r.path) for r in jb.current_rows(spark, target, "documents").collect()) == [(1, "/a"), (2, "/b"), (3, "/c")]
    assert {r.content for r in jb.current_rows(spark, target, "chunks").collect()} == {"second reading", "stays as it is", "new here"}
    jb.compact_ingest(spark, target, small)
    assert read(small) == after and spark.read.parquet(f"{small}/documents").count() == 3


def read_file(i, path, text, pages=None):
    return {"path": path, "doc_id": i, "markdown": text, "pages": [{"page_num": n + 1, "text": x} for n, x in enumerate(pages or [])], "images": [{"path": "a.png", "page_num": 1}]}


def test_ingest_keeps_each_text_table_once(spark, tmp_path):
    """Blocks and chunks are written where they are kept, and nothing that is shuffled stays; rows are those of the batch form."""
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    long = " ".join(f"w{i}" for i in range(1500))
    files = [read_file(1, "/a", "p", ["Figure 1\nshort", long, "", "# Head\nmore"]), read_file(2, "/b", "whole text | without pages"),
             read_file(3, "/c", "x", ["one of two"]), read_file(3, "/d", long, [long, "shares its id"]), read_file(5, "/e", "again", ["again"]), read_file(5, "/e", "again", ["again"])]
    write_json(source, "1.json", files)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    jb.ingest_stream(spark, source, target, progress).awaitTermination()
    wrote = [f"{shared_dir(spark)}/{d}" for d in os.listdir(shared_dir(spark).removeprefix("file:")) if d.startswith("settled-") and d not in before]
    assert wrote and not {c for d in wrote for c in spark.read.parquet(d).columns} & {"source_text", "content", "pages", "markdown"}
    plain = jb.ingest_tables(jb.new_documents(spark.read.schema(jb.FILES).json(source), None), settle=lambda table: table)
    for name in jb.TABLES:
        found = jb.current_rows(spark, target, name)
        for some, left_out in (("doc_id <> 3", []), ("doc_id = 3", ["chunk_id", "chunk_idx"])):  # which of two files with one id comes first is open
            columns = [c for c in plain[name].columns if c not in left_out]
            got, want = (sorted(str(r) for r in df.filter(some).select(*columns).collect()) for df in (found, plain[name]))
            assert got == want and got
    keys = lambda df: sorted((r.doc_id, r.chunk_idx, r.chunk_id) for r in df.collect())
    got = keys(jb.current_rows(spark, target, "chunks"))
    assert got == keys(plain["chunks"]) and len(set(got)) == len(got)


def test_texts_are_not_shuffled_to_number_chunks_or_to_read_current_rows(spark, tmp_path, monkeypatch):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    ids = [-65, -64, -1, 0, 1, 63, 64, 127, 128, 1 << 38]
    rounds = [ids, ids[::2], [0, 63, 64], [63]]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n, some in enumerate(rounds):
            write_json(source, f"{n}.json", [read_file(i, f"/{i}", f"reading {n} of {i}") for i in some])
            jb.ingest_stream(spark, source, target, progress).awaitTermination()
        last = {i: max(n for n, some in enumerate(rounds) if i in some) for i in ids}
        for most in (500_000, 0):
            monkeypatch.setattr(jb, "MOST_WORDS", most)
            rows = jb.current_rows(spark, target, "blocks").filter("block_type = 'text'")
            assert sorted((r.doc_id, r.source_text) for r in rows.collect()) == sorted((i, f"reading {n} of {i}") for i, n in last.items())
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange hashpartitioning" in plan) == (most == 0)
        stored = spark.read.parquet(f"{target}/blocks/batch=0")
        placed = ck.chunk_blocks(stored, first="first_chunk")._jdf.queryExecution().optimizedPlan().children().head().toString()
        assert "Window" not in placed and "MapInArrow" in placed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_numbered_blocks(spark, monkeypatch):
    """Blocks as parsed and finished apart; the chunk numbers are those that a shuffle gives."""
    monkeypatch.setattr(bk, "DOCUMENTS", 3)
    texts = ["", "  ", "a", "a " * 90 + "b", " ".join(["word"] * 31), "\x1c\u3000x", "한국 " * 40, "x" * 400]
    page = lambda n, x: (n, x)
    rows = [(i, True if i % 4 else None, "m" if i % 3 else None, [page(j, texts[(i * j + j) % len(texts)]) for j in range(i % 6)] if i % 5 else None,
             [("p.png", 0), ("q", 2)][:i % 3]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, alone boolean, markdown string, pages array<struct<page_num:int,text:string>>, images array<struct<path:string,page_num:int>>").coalesce(2)
    got, want = bk.numbered_blocks(docs, "alone", 20, 5).cache(), bk.finish_blocks(bk.parsed_blocks(docs))
    assert sorted(map(str, got.drop("first_chunk").collect())) == sorted(map(str, want.collect()))
    assert all((r.first_chunk is None) == (r.doc_id % 4 == 0) for r in got.collect())
    chunks = ck.chunk_blocks(got, 20, 5, first="first_chunk")
    assert sorted(map(str, chunks.collect())) == sorted(map(str, ck.chunk_blocks(want, 20, 5).select(*chunks.columns).collect()))


def sign_ins(outcomes):
    return [(1, NOW + datetime.timedelta(minutes=m), i, ok) for i, (m, ok) in enumerate(outcomes)]


def test_lockout_rule(spark):
    rows = sign_ins([(0, False), (1, False), (2, False), (3, False), (4, False), (5, True), (33, False), (34, False), (64, False), (95, True), (96, False)])
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, ord long, success boolean")
    out = [r.outcome for r in jb.lockouts(df).orderBy("ord").collect()]
    assert out == ["failure"] * 4 + ["locked", "rejected", "rejected", "locked", "locked", "success", "failure"]


def test_lockouts_put_together_in_a_tree(spark, monkeypatch):
    import random

    from leafmill.operators import lockouts as lo

    rng = random.Random(6)
    for limit, span in ((1, 0), (2, 50), (3, 7), (5, 400)):
        for _ in range(40):
            n = rng.randint(1, 80)
            times, marks = sorted(rng.randint(0, 400) for _ in range(n)), [rng.random() < .3 for _ in range(n)]
            cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(4))})
            parts = [lo.stretch_of(times[a:b], marks[a:b], limit, span) for a, b in zip(cuts, cuts[1:])]
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.then(p)
            for start in ((0, None), (7, None), (rng.randint(0, 6), times[0] + rng.randint(0, span))):
                want, state = start, start
                for t, ok in zip(times, marks):
                    *want, _ = lo.sign_in(*want, t, ok, limit, span)
                for p in parts:
                    state = p.end(*state)
                assert tuple(want) == tuple(state) == tuple(whole.end(*start))
    monkeypatch.setattr(lo, "BLOCK_ROWS", 8)
    monkeypatch.setattr(lo, "FANOUT", 3)
    rows = [(u, NOW + datetime.timedelta(minutes=rng.randint(0, 4000)), i, rng.random() < .25) for i, u in enumerate([1] * 500 + [2] * 60 + [None] * 40 + [3])]
    schema = "user_id long, ts timestamp, ord long, success boolean"
    got = {r.ord: (r.user_id, r.ts, r.outcome, r.failures, r.locked_until) for r in jb.lockouts(spark.createDataFrame(rows, schema).repartition(5), 3, 30).collect()}
    states = {}
    for u, ts, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        at = int((ts - NOW).total_seconds() * 1_000_000)
        failures, until, outcome = lo.sign_in(*states.get(u, (0, None)), at, ok, 3, 30 * 60_000_000)
        states[u] = failures, until
        assert got.pop(i) == (u, ts, outcome, failures, None if until is None else NOW + datetime.timedelta(microseconds=until))
    assert not got and jb.lockouts(spark.createDataFrame([], schema)).collect() == []


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    import random
    rng = random.Random(1)
    rows = [(rng.randrange(3), NOW + datetime.timedelta(minutes=i * 3), i, rng.random() < 0.3) for i in range(300)]
    schema = "user_id long, ts timestamp, ord long, success boolean"
    for part in range(3):  # files in time order
        spark.createDataFrame(rows[part * 100:part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jb.run_to_table(jb.lockout_stream(stream, 3, 30), str(tmp_path / "out"), str(tmp_path / "progress"))
    want = jb.lockouts(spark.createDataFrame(rows, schema), 3, 30)
    pick = lambda df: sorted(map(tuple, df.select("ord", "outcome", "failures", "locked_until").collect()), key=lambda r: r[0])
    assert pick(got) == pick(want)


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    schema = "ts timestamp, module string, severity string, duration_ms double"
    at = lambda h: NOW + datetime.timedelta(hours=h)
    # the second batch moves the watermark past day one; Spark gives that day out in the third, and drops late rows from the fourth
    batches = [[(at(h), "m", "info", 1.0)] for h in (1, 60, 61, 2, 120)]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jb.run_to_table(jb.windowed_module_stats(stream), str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {r.window_start: r.total_events for r in out.collect()}
    assert got == {NOW: 1, NOW + datetime.timedelta(days=2): 2}


def test_cut_lineage_uses_the_shared_folder(spark):
    df = cut_lineage(tm.alias_rows(spark))
    assert df.count() == 23 and spark.sparkContext.getCheckpointDir() is not None


def test_nearest_ends_keeps_starts_without_any(spark):
    pairs = spark.createDataFrame([("a", "s", 1, 1, None, None, None), ("a", "s", 2, 2, 9, 5, "y"), ("a", "s", 2, 2, 7, 6, "x"), ("a", "s", 2, 2, None, None, None)],
                                  "trace_id string, stage string, started_at int, start_ord int, ended_at int, end_ord int, outcome string")
    got = {tuple(r) for r in jb.nearest_ends(pairs).collect()}
    assert got == {("a", "s", 1, 1, None, None, None), ("a", "s", 2, 2, 7, 6, "x")}


def test_ingest_parses_pages_once(spark):
    """Chunks are made from written blocks and keywords from written chunks; the rows are those of tables made apart."""
    files = spark.createDataFrame([(1, "/a", "h", "Figure 1\nHello world", [(1, "Figure 1\nHello world")], None), (2, "/b", "i", "# Head\ntext", None, None)],
                                  "doc_id long, path string, hash string, markdown string, pages array<struct<page_num:int,text:string>>, images array<struct<path:string,page_num:int>>")
    steps, plain = [], jb.ingest_tables(files, settle=lambda table: table)
    found = jb.ingest_tables(files, settle=lambda table: steps.append(table.inputFiles()) or cut_lineage(table))
    assert steps[0] == [] and all("/settled-" in f for f in steps[1]) and steps[1]
    assert all(f.split("/settled-")[1] for f in jb.ingest_tables(files)["keywords"].inputFiles())
    for name in jb.TABLES:
        assert sorted(map(str, found[name].collect())) == sorted(map(str, plain[name].collect()))


def test_normal_form_in_batches(spark):
    texts = [None, "", "  ", "A  b\tC", "ÀÉ ß İstanbul K", "한국 어-1.2_x/y", "a" * 500 + " B\n", "\x1c x   Ω"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.filter(~tx.normalise_in_batches(F.col("t")).eqNullSafe(tx.normalise(F.col("t")))).count() == 0
