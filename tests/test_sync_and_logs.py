import datetime
import random

from pyspark.sql import functions as F

from leafmill.functions import ordered as od
from leafmill.operators import logs as lg
from leafmill.operators import sync as sy

NOW = datetime.datetime(2024, 1, 1)
DOC = "doc_id int, path string, hash string, status string"


def test_scan_and_sync_diff(spark):
    docs = spark.createDataFrame([(1, "/a", "h1", "indexed"), (2, "/b", "h2", "indexed"), (3, "/c", "h3", "failed"), (4, "/e", "h5", "indexed")], DOC)
    scan = spark.createDataFrame([("/a", "h1"), ("/b", "h9"), ("/d", "h4"), ("/f", "h5"), ("/g", "h4")], "path string, hash string")

    def found(exclude):
        out = {}
        for r in sy.classify_changes(scan, docs, exclude).collect():
            out.setdefault(r.change, set()).add(r.doc_id or r.path)
        return out
    assert found(False) == {"added": {"/d"}, "modified": {2}, "deleted": {3, 4}, "same": {1}, "moved": {"/f"}, "repeated": {"/g"}}
    assert found(True) == {"added": {"/d"}, "modified": {2}, "deleted": {4}, "same": {1}, "moved": {"/f"}, "repeated": {"/g"}}


def test_apply_diff(spark):
    docs = spark.createDataFrame(
        [(1, "/a.pdf", "h1", 5, "failed", "File removed from source", NOW), (2, "/b.pdf", "h2", 5, "indexed", None, NOW), (3, "/c.pdf", "h3", 5, "indexed", None, NOW)],
        "doc_id int, path string, hash string, size long, status string, error_msg string, updated_at timestamp")
    scan = spark.createDataFrame([("/a.pdf", "h1", 5), ("/b.pdf", "h9", 6), ("/x/d.PDF", "h4", 7)], "path string, hash string, size long")
    later = datetime.datetime(2024, 2, 2)
    out = {r.path: r for r in sy.apply_changes(sy.classify_changes(scan, docs), docs, later).collect()}
    assert (out["/a.pdf"].status, out["/a.pdf"].updated_at) == ("failed", NOW)  # comes back unchanged: stays failed
    assert (out["/b.pdf"].status, out["/b.pdf"].hash, out["/b.pdf"].size, out["/b.pdf"].updated_at) == ("pending", "h9", 6, later)
    assert (out["/c.pdf"].status, out["/c.pdf"].error_msg) == ("failed", "File removed from source")
    assert (out["/x/d.PDF"].doc_id, out["/x/d.PDF"].status) == (None, "pending")


def test_upsert_keeps_last_row(spark):
    users = spark.createDataFrame([(1, "a@x", "A", 1, 1, NOW), (2, "b@x", "B", 1, 1, NOW)], "user_id int, email string, usr_name string, dept_id long, role_id long, updated_at timestamp")
    feed = spark.createDataFrame([("a@x", 2, "A2", 5, None), ("a@x", 1, "A1", 4, 4), ("c@x", 3, "C", 1, 1)], "email string, ord int, usr_name string, dept_id long, role_id long")
    out = {r.email: (r.usr_name, r.dept_id, r.role_id, r.change) for r in sy.upsert_users(users, feed, NOW).collect()}
    assert out == {"a@x": ("A2", 5, 1, "updated"), "b@x": ("B", 1, 1, "kept"), "c@x": ("C", 1, 1, "added")}


def close_by_hand(events):
    open_, rows = [], {}
    for ord_, status, ts in sorted(events, key=lambda e: (e[2], e[0])):
        if status == "running":
            open_.append(ord_)
            rows[ord_] = ("running", None)
        elif open_:
            rows[open_.pop()] = (status, ts)
        else:
            rows[ord_] = (status, ts)
    return rows


def test_close_stages_matches_a_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for doc in range(6):
        events = []
        for _ in range(60):
            ord_ = len(rows)
            ts = NOW + datetime.timedelta(hours=rng.randrange(200))  # repeats and many days
            status = rng.choice(["running", "success", "failed"])
            events.append((ord_, status, ts))
            rows.append((ord_, doc, "embed", status, ts, None))
        want |= close_by_hand(events)
    df = spark.createDataFrame(rows, "ord int, doc_id int, stage string, status string, ts timestamp, error string")
    got = {r.ord: (r.status, r.finished_at) for r in lg.close_stages(df).collect()}
    assert got == want
    got = {r.ord: (r.status, r.finished_at) for r in lg.close_stages(df, F.lit(0)).collect()}  # one bucket
    assert got == want


def test_stage_fixture(spark):
    t = lambda m: NOW + datetime.timedelta(minutes=m)
    rows = [(1, 1, "chunk", "running", t(0), None), (2, 1, "chunk", "success", t(1), None), (3, 1, "embed", "running", t(2), None),
            (4, 1, "embed", "running", t(3), None), (5, 1, "embed", "failed", t(4), "x" * 1200), (6, 1, "index", "success", t(5), None)]
    stages = lg.close_stages(spark.createDataFrame(rows, "ord int, doc_id int, stage string, status string, ts timestamp, error string"))
    got = {r.ord: (r.stage, r.status, r.finished_at) for r in stages.collect()}
    assert got == {1: ("chunk", "success", t(1)), 3: ("embed", "running", None), 4: ("embed", "failed", t(4)), 6: ("index", "success", t(5))}
    docs = spark.createDataFrame([(1, "pending", None, NOW), (2, "pending", None, NOW)], "doc_id int, status string, error_msg string, updated_at timestamp")
    out = {r.doc_id: (r.status, len(r.error_msg or "")) for r in lg.document_states(docs, stages, NOW).collect()}
    assert out == {1: ("failed", 1000), 2: ("pending", 0)}


def test_requests(spark):
    rows = [("GET", "/chat", 200, 2000), ("GET", "/chat", 200, 2001), ("GET", "/chat", 404, 5), ("GET", "/health", 500, 9000), ("GET", "/admin/x", 500, 9000)]
    out = lg.classify_requests(spark.createDataFrame(rows, "method string, path string, status int, duration_ms long"))
    assert [r.message for r in out.orderBy("path", "status", "duration_ms").collect()] == [
        None, None, "Slow request: GET /chat → 200", "GET /chat → 404", None]


def test_numbering_of_one_hot_group(spark):
    rows = [(0 if i % 3 else i % 5, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, pos int").repartition(7).withColumn("_b", od.position_bucket(F.col("pos"), 64))
    out = od.number_within(df, ["k"], ["pos"], "_b", "n").collect()
    seen = {}
    for r in sorted(out, key=lambda r: r.pos):
        assert r.n == seen.get(r.k, 0)
        seen[r.k] = r.n + 1


def test_nearest_in_order_with_null_keys(spark):
    rows = [(None if i % 2 else 1, i, i % 10 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, pos int, mark boolean").withColumn("_b", od.position_bucket(F.col("pos"), 7))
    out = od.nearest_in_order(df, ["k"], ["pos"], "_b", F.when(F.col("mark"), F.col("pos")), "back", "ahead")
    for r in out.collect():
        marks = [p for k, p, m in rows if k == r.k and m]
        assert r.back == max([p for p in marks if p <= r.pos], default=None)
        assert r.ahead == min([p for p in marks if p >= r.pos], default=None)


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, i % 4, "running" if i % 3 else "success", NOW + datetime.timedelta(hours=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "ord int, doc_id int, status string, ts timestamp").withColumn("stage", F.lit("s")).withColumn("error", F.lit(None).cast("string"))
    results = []
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, lg.close_stages(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_quantiles_are_exact(spark):
    import numpy as np
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randrange(400)) / 4) for _ in range(501)] + [("c", 7.0)]
    out = od.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(6), ["k"], "v", {"half": 0.5, "high": 0.95, "low": 0.0})
    for r in out.collect():
        values = [v for k, v in rows if k == r.k]
        assert r.n == len(values)
        for name, p in (("half", 0.5), ("high", 0.95), ("low", 0.0)):
            assert abs(r[name] - np.quantile(values, p)) < 1e-9


def test_quantiles_are_spread(spark):
    """No window holds all rows of a step, and the values are exact."""
    from leafmill.functions.ordered import quantiles

    rows = spark.range(20000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("step"), (F.col("id") * 7919 % 20011 / 3.0).alias("ms"))
    found = quantiles(rows, ["step"], "ms", {"p50": 0.5, "p95": 0.95})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(step#" not in plan
    for r in found.collect():
        want = sorted(x["ms"] for x in rows.filter(F.col("step") == r["step"]).collect())
        at = 0.95 * (len(want) - 1)
        low = int(at)
        assert r["n"] == len(want) and abs(r["p95"] - (want[low] + (want[min(low + 1, len(want) - 1)] - want[low]) * (at - low))) < 1e-9


def test_deletes_in_a_circle_and_of_a_tree(spark):
    folders = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)], "id int, parent int")
    files = spark.createDataFrame([(10, 4, 11), (11, 6, 12), (12, 5, None), (13, None, 10)], "id int, folder int, next int")
    refs = [sy.Reference("folders", "parent", "folders"), sy.Reference("files", "folder", "folders"), sy.Reference("files", "next", "files", "set null")]
    keys = {"folders": ["id"], "files": ["id"]}
    left = sy.delete_along({"folders": folders, "files": files}, keys, refs, {"folders": folders.filter("id = 1")})
    assert sorted(r.id for r in left["folders"].collect()) == [5, 6]
    assert sorted((r.id, r.next or 0) for r in left["files"].collect()) == [(11, 12), (12, 0), (13, 0)]
    ring = [sy.Reference("files", "next", "files")]
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 4)], "id int, next int")
    assert sorted(r.id for r in sy.delete_along({"files": loop}, {"files": ["id"]}, ring, {"files": loop.filter("id = 2")})["files"].collect()) == [4, 5]
