import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import access as ac
from leafmill.operators import answers as an
from leafmill.operators import graph as gr
from leafmill.operators import nearest as nn
from leafmill.operators import retrieval as rt
from leafmill.operators import terms as tm
from leafmill.operators import vector_index as vi
from leafmill.functions import vectors as vx
from leafmill.plans import hybrid as hy
from leafmill.plans import indexing as ix

NOW = datetime.datetime(2024, 1, 1)


def test_fusion(spark):
    def branch(name, ids):
        rows = [(1, c, 1.0, i + 1) for i, c in enumerate(ids)]
        return spark.createDataFrame(rows, f"query_id int, chunk_id string, {name}_score double, rank int")
    out = rt.fuse_ranks({"dense": branch("dense", "ab"), "sparse": branch("sparse", "b"), "keyword": branch("keyword", "")})
    rows = {r.chunk_id: r for r in out.collect()}
    assert (round(rows["b"].rrf_score, 6), round(rows["a"].rrf_score, 6)) == (0.032522, 0.016393)
    assert (rows["b"].fused_rank, rows["a"].sparse_score, rows["a"].keyword_score) == (1, None, None)


def test_equal_sums_keep_first_seen_order(spark):
    rows = lambda name, c: spark.createDataFrame([(1, c, 1.0, 1)], f"query_id int, chunk_id string, {name}_score double, rank int")
    out = rt.fuse_ranks({"x": rows("x", "z"), "y": rows("y", "a")}).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in out] == ["z", "a"]


def test_boost(spark):
    queries = spark.createDataFrame([(1, "표로 EGFR 적응증 보여줘")], "query_id int, query_text string")
    forms = spark.createDataFrame([(1, 0, "EGFR", "egfr"), (1, 1, "적응증", "적응증")], "query_id int, pos int, variant string, variant_norm string")
    profile = rt.with_query_profile(queries, forms)
    p = profile.first()
    assert (p.pref_table, p.pref_caption, p.pref_text, p.pref_image) == (0.28, 0.08, 0.0, 0.0)
    hits = spark.createDataFrame(
        [(1, 1, "summary.xlsx", "xlsx", "| Target | Value |\n| EGFR | NSCLC |", "table", "Sheet1", None, 1, None, 0.5, None),
         (1, 2, "summary.xlsx", "xlsx", "EGFR 적응증 설명 문장", "text", None, None, 1, None, 0.5, None)],
        "query_id int, chunk_id int, file_name string, file_type string, content string, block_type string, sheet_name string, "
        "slide_number int, page_number int, section_path string, rrf_score double, keyword_score double")
    out = {r.chunk_id: r for r in rt.exact_match_boost(hits.join(profile, "query_id")).collect()}
    assert (out[1].exact_match_boost, round(out[1].final_score, 6)) == (0.41, 0.91)
    assert (out[2].exact_match_boost, round(out[2].final_score, 6)) == (0.12, 0.62)


def test_hints_match_inside_words(spark):
    prefs = rt.block_preferences(F.lit("growth"))
    assert spark.range(1).select(prefs["table"].alias("t")).first()["t"] == 0.28


DOCS = [(1, 1, 10, "indexed"), (2, 2, 20, "indexed"), (3, 2, None, "indexed"), (4, 1, 10, "failed")]
GRANTS = [(7, 20, True, None), (7, 10, True, datetime.datetime(2020, 1, 1)), (7, 30, False, None)]


def test_access(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, dept_id int, folder_id int, status string")
    grants = ac.live_grants(spark.createDataFrame(GRANTS, "user_id int, folder_id int, is_active boolean, expires_at timestamp"), NOW)
    assert [tuple(r) for r in grants.collect()] == [(7, 20)]
    asked = spark.createDataFrame([(7, 1, s) for s in ("dept", "folder", "all")] + [(8, 1, "folder")], "user_id int, dept_id int, search_scope string")
    pairs = ac.with_folders(asked.withColumnRenamed("dept_id", "mine"), grants).join(docs.filter("status = 'indexed'"), F.lit(True)).filter(
        ac.may_see(F.col("search_scope"), F.col("mine"), F.col("folder_ids"), F.col("dept_id"), F.col("folder_id")))
    seen = {}
    for r in pairs.collect():
        seen.setdefault((r.user_id, r.search_scope), []).append(r.doc_id)
    assert {k: sorted(v) for k, v in seen.items()} == {(7, "dept"): [1], (7, "folder"): [2], (7, "all"): [1, 2]}
    counts = ac.visible_counts(asked.select("user_id", "dept_id").distinct(), grants, docs)
    assert {r.user_id: (r.dept_docs, r.folder_docs, r.all_docs) for r in counts.collect()} == {7: (1, 1, 2), 8: (1, 0, 1)}


def vectors(spark, n, dim, name, vec, seed):
    data = np.random.default_rng(seed).integers(-3, 4, (n, dim)).astype(float)
    rows = [(i, v.tolist(), int(i % 3), int(i % 5) if i % 7 else None) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, f"{name} int, {vec} array<float>, dept_id int, folder_id int")


def test_dense_top_k_is_exact(spark, monkeypatch):
    v, vectors_df = vectors(spark, 300, 8, "chunk_id", "embedding", 1)
    q, queries_df = vectors(spark, 40, 8, "query_id", "query_vector", 2)
    queries_df = queries_df.withColumn("search_scope", F.element_at(F.array(F.lit("dept"), F.lit("folder"), F.lit("all")), F.col("query_id") % 3 + 1)).withColumn(
        "folder_ids", F.when(F.col("query_id") % 4 > 0, F.array(F.col("query_id") % 5))).drop("folder_id")
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(q) @ unit(v).T, 6) + 0.0

    def want(access):
        out = set()
        for i in range(40):
            ok = []
            for j in range(300):
                if not np.linalg.norm(v[j]):
                    continue
                dept, folder = j % 3 == i % 3, bool(j % 7) and i % 4 > 0 and j % 5 == i % 5
                if not access or {"dept": dept, "folder": folder, "all": dept or folder}[("dept", "folder", "all")[i % 3]]:
                    ok.append(j)
            best = sorted(ok, key=lambda j: (-scores[i, j], j))[:5]
            out |= {(i, j, r + 1) for r, j in enumerate(best)}
        return out

    for access in (False, True):
        got = nn.dense_top_k(vectors_df.repartition(6), queries_df, 8, 5, access=access)
        assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == want(access)
    monkeypatch.setattr(nn, "GROUP_BYTES", 8 * 4 * 40)  # several groups
    monkeypatch.setattr(nn, "HITS_HELD", 30)
    packed = nn.packed
    monkeypatch.setattr(nn, "packed", lambda *a, **more: packed(*a, **more, rows=7))
    for access in (False, True):
        got = nn.dense_top_k(vectors_df.repartition(6), queries_df, 8, 5, access=access)
        assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == want(access)


def test_search_of_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(1000, None), (1001, [0.0, 0.0]), (1002, [float("nan"), 1.0]), (1003, [-1.0, -2.0])]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [-3.0, -6.0])], "query_id int, query_vector array<float>")
    first = sorted(str(i) for i in range(500))[:3]
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.dense_score) for r in nn.dense_top_k(v, q, 2, 3).collect())
    assert got[:3] == [(1, i + 1, c, 1.0) for i, c in enumerate(first)] and got[3] == (4, 1, "1003", 1.0) and len(got) == 6  # ties go by id
    assert nn.dense_top_k(v.limit(0), q, 2, 3).collect() == [] and nn.dense_top_k(v, q.limit(0), 2, 3).collect() == []
    with pytest.raises(Exception, match="not of length"):
        nn.dense_top_k(v, q, 3, 3).collect()
    index = vi.build_index(v, 2)
    got = sorted((r.query_id, r["rank"], r.dense_score) for r in vi.approximate_top_k(index, q, 3).collect() if r.dense_score > 0)
    assert got == [(1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (4, 1, 1.0)]
    assert vi.approximate_top_k(vi.build_index(v.limit(0), 2), q, 3).collect() == []


def test_inverted_file_with_all_lists_and_pairs_is_exact(spark, monkeypatch):
    _, vectors_df = vectors(spark, 300, 8, "chunk_id", "embedding", 1)
    _, queries_df = vectors(spark, 40, 8, "query_id", "query_vector", 2)
    want = {tuple(r) for r in nn.dense_top_k(vectors_df, queries_df, 8, 5).collect()}
    monkeypatch.setattr(vi, "GROUP_ROWS", 64)  # lists that span groups, groups of several lists
    index = vi.build_index(vectors_df.repartition(4), 8, lists=6)
    assert {tuple(r) for r in vi.approximate_top_k(index, queries_df, 5, probes=6, rescored=300).collect()} == want
    some = {tuple(r)[:3] for r in vi.approximate_top_k(index, queries_df, 5, probes=2).collect()}
    assert some and all(abs(s - dict(((a, b), c) for a, b, c, _ in nn.dense_top_k(vectors_df, queries_df, 8, 300).collect())[(i, j)]) < 1e-9 for i, j, s in list(some)[:20])
    assert {r[0] for r in vi.code_candidates(index, queries_df, 2, 9).select("list").distinct().collect()} <= set(range(6))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_registered_search(spark, folder):
    from checks import registry, searching

    recall = registry.QUERIES["f4_recall"](spark, folder).agg(F.sum("found").alias("f"), F.sum("expected").alias("e")).first()
    assert recall.e > 0 and recall.f >= 0.9 * recall.e
    index, asked = searching.vector_index(spark, folder), searching.fiftieth(spark, folder)
    lists = len(index.sizes)
    scored = vi.code_candidates(index, asked, -(-3 * lists // 4), 100).count()
    assert scored <= 0.2 * asked.count() * sum(index.sizes)


def test_sparse_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 60) or "none" for _ in range(200)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string").repartition(5)
    asked = [["w1"], ["w1", "w2"], ["w3", "w1", "w5"], ["w1", "missing"], ["w40"]]
    queries = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(asked)], "query_id int, query_text string")
    words = spark.createDataFrame(list(enumerate(asked)), "query_id int, words array<string>")
    tokens = [t.split() for t in texts]
    mean = sum(map(len, tokens)) / len(tokens)
    df = {w: sum(w in t for t in tokens) for q in asked for w in q}

    def bm25(q, t):
        return sum(np.log(1 + (200 - df[w] + .5) / (df[w] + .5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (.25 + .75 * len(t) / mean))
                   for w in q if w in t)

    index = tm.term_index(chunks, lambda df, name: df)
    for match, test in (("all", all), ("any", any)):
        want = set()
        for i, q in enumerate(asked):
            hits = [(round(bm25(q, t), 6), j) for j, t in enumerate(tokens) if test(w in t for w in q)]
            want |= {(i, j) for _, j in sorted(hits, key=lambda h: (-h[0], h[1]))[:10]}
        got = {(r.query_id, r.chunk_id) for r in rt.sparse_top_k(index, queries, words, 10, match).collect()}
        assert got == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(vx.l2_normalise(F.col("a")).alias("n"), vx.l2_normalise(F.col("z")).alias("z"),
                  vx.cosine(F.col("a"), F.col("a")).alias("c"), vx.cosine(F.col("a"), F.col("z")).alias("none")).first()
    assert [round(x, 6) for x in r.n] == [0.6, 0.8] and r.z == [0.0, 0.0] and round(r.c, 9) == 1.0 and r.none is None
    texts = spark.createDataFrame([("Alpha beta alpha",), ("",), (None,)], "t string").select(vx.hash_embedding(F.col("t")).alias("e")).collect()
    import hashlib
    want = np.zeros(1024)
    for token in ("alpha", "beta", "alpha"):
        d = hashlib.sha256(token.encode()).digest()
        for i in range(0, 16, 2):
            want[(d[i] * 256 + d[i + 1]) % 1024] += 1
    assert texts[0].e == want.tolist() and sum(texts[1].e) == 8 and texts[1].e == texts[2].e


def test_rerank_and_context(spark):
    hits = spark.createDataFrame(
        [(1, 10, 5, "a.pdf", "alpha beta", "text", 2, None, None, None, 0.5, 1, "alpha beta"),
         (1, 11, 5, "a.pdf", "gamma", "table", 0, "S", 3, "Intro", 0.9, 2, "alpha beta"),
         (1, 12, 6, "b.pdf", "beta", "text", None, None, None, None, 0.1, 3, "alpha beta")],
        "query_id int, chunk_id int, doc_id int, file_name string, content string, block_type string, page_number int, sheet_name string, "
        "slide_number int, section_path string, final_score double, fused_rank int, query_text string")
    text = {r.chunk_id: r.t for r in hits.select("chunk_id", an.rerank_text().alias("t")).collect()}
    assert text[10] == "[type=text | page=2]\nalpha beta"
    assert text[11] == "[type=table | sheet=S | slide=3 | section=Intro]\ngamma"
    best = an.rerank(hits, 2)
    assert [(r.chunk_id, r.rerank_score) for r in best.orderBy("place").collect()] == [(10, 1.5), (12, 0.5)]
    web = spark.createDataFrame([(1, 1, "T", "u", "s")], "query_id int, place int, title string, url string, snippet string")
    graph = spark.createDataFrame([(1, "G")], "query_id int, graph_text string")
    got = an.context_texts(an.rerank(hits, 3), "P", graph, web).first().system_text
    assert got == ("P\n\nG\n\n=== 관련 문서 ===\n[문서 1: a.pdf p.2 type=text]\nalpha beta\n\n[문서 2: b.pdf type=text]\nbeta\n\n"
                   "[문서 3: a.pdf sheet=S slide=3 type=table section=Intro]\ngamma\n=== 문서 끝 ===\n\n"
                   "위 문서를 참고하여 답변하세요. 문서에 없는 내용은 모른다고 알려주세요.\n\n"
                   "=== 웹 검색 결과 ===\n[웹 1: T]\nURL: u\ns\n=== 웹 검색 끝 ===\n\n위 웹 검색 결과도 참고하여 답변하세요.")


def test_input_tokens_match_json(spark):
    import json
    context = spark.createDataFrame([(1, 'say "hi"\n\t표')], "query_id int, system_text string")
    queries = spark.createDataFrame([(1, "q\\1")], "query_id int, query_text string")
    history = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a")], "query_id int, place int, role string, content string")
    r = an.chat_messages(context, queries, history).select("messages", an.input_tokens(F.col("messages")).alias("n")).first()
    told = [m.asDict() for m in r.messages]
    assert [m["content"] for m in told] == ['say "hi"\n\t표', "a", "b", "q\\1"]
    assert r.n == len(json.dumps(told, ensure_ascii=False)) // 4


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({(f"e{int(e):02d}", int(d)) for e, d in zip(rng.integers(0, 40, 90), rng.integers(0, 30, 90))})
    edges = spark.createDataFrame(pairs, "entity_name string, doc_id int")
    docs = {}
    for e, d in pairs:
        docs.setdefault(d, set()).add(e)
    near = {}
    for members in docs.values():
        for e in members:
            near.setdefault(e, set()).update(members)
    want = {(e, n) for e in near for n in sorted(set().union(*[near[x] for x in near[e]]) - {e})[:3]}
    got = {(r.entity_name, r.neighbour) for r in gr.neighbours(edges, 3).collect()}
    assert got == want
    seeds = spark.createDataFrame([("e01",), ("e02",)], "entity_name string")
    got = {(r.src, r.dst) for r in gr.co_occurrences(edges, seeds).collect()}
    assert got == {tuple(sorted((s, n))) for s in ("e01", "e02") for n in near.get(s, ()) if n != s}


def test_lookup_and_lines(spark):
    vertices = spark.createDataFrame([("DataLake", "TECH", 3), ("lake", "TECH", 9), ("EGFR", "TECH", 1)], "entity_name string, entity_type string, n_docs long")
    words = spark.createDataFrame([(1, 0, "ake"), (1, 1, "egfr"), (1, 2, "L")], "query_id int, word_pos int, word string")
    found = gr.find_entities(vertices, words)
    assert [(r.word, r.entity_name) for r in found.orderBy("word_pos", "rank").collect()] == [("ake", "lake"), ("ake", "DataLake"), ("L", "DataLake")]
    near = spark.createDataFrame([("lake", "b", 2), ("lake", "a", 1)], "entity_name string, neighbour string, rank int")
    assert [r.line for r in gr.context_lines(found, near).collect()] == ["lake (TECH): related to a, b"]


def test_chunk_keys_never_collide(spark):
    from leafmill.operators.retrieval import chunk_key

    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2**39 - 1, 2**24 - 1), (-1, 5)], "d long, i int")
    assert rows.select(chunk_key(F.col("d"), F.col("i")).alias("k")).distinct().count() == 5
    for wrong in ((2**40, 0), (1, 2**24)):
        with pytest.raises(Exception, match="no chunk key"):
            spark.createDataFrame([wrong], "d long, i int").select(chunk_key(F.col("d"), F.col("i"))).collect()


def test_searches_read_no_text(spark, tmp_path):
    """A written index is searched without tokenising, embedding or scanning texts, also where nothing is broadcast."""
    from leafmill.plans import hybrid as hy
    from leafmill.plans import indexing as ix

    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i}", f"f{i}", "txt", "indexed", "d", "f") for i in range(20)],
                                 "doc_id long, text string, file_name string, type string, status string, dept_id string, folder_id string")
    ix.write_index(spark, docs, str(tmp_path))
    index = hy.SearchIndex.read(spark, str(tmp_path), docs)
    queries = spark.createDataFrame([(1, "alpha beta1"), (2, "gamma7")], "query_id long, query_text string")
    words = spark.createDataFrame([(1, ["alpha", "beta1"]), (2, ["gamma7"])], "query_id long, words array<string>")
    for size in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        found = rt.sparse_top_k(index.words, queries, words)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "content" not in plan and "split(" not in plan
        assert {(r.query_id, r.chunk_id >> 24) for r in found.collect()} == {(1, i) for i in range(20) if i % 3 == 1} | {(2, 7)}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hits = hy.hybrid_search(index, queries)
    assert hits.filter("query_id = 2").orderBy(F.desc("final_score")).first().doc_id == 7


def test_scores_come_about_where_a_chunk_lies(spark, monkeypatch):
    """No pair of query and chunk is shuffled; blocks of queries and of pairs change nothing."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 9, 6)) for _ in range(300)]
    chunks = spark.createDataFrame([(i, t, f"d{i % 3}", f"f{i % 4}") for i, t in enumerate(texts)],
                                   "chunk_id long, content string, dept_id string, folder_id string").repartition(6)
    queries = spark.createDataFrame([(q, ("dept", "folder", "all")[q % 3], f"d{q % 3}", [f"f{q % 4}"] if q % 2 else None) for q in range(9)],
                                    "query_id long, search_scope string, dept_id string, folder_ids array<string>")
    forms = spark.createDataFrame([(q, w) for q in range(9) for w in (f"w{q}", f"w{(q + 1) % 9}")], "query_id long, variant_norm string")
    lists = tm.keyword_lists(chunks, ["chunk_id", "dept_id", "folder_id"], "content")
    sees = lambda q, c: {"dept": c % 3 == q % 3, "folder": bool(q % 2) and c % 4 == q % 4}.get(("dept", "folder", "all")[q % 3], c % 3 == q % 3 or (q % 2 and c % 4 == q % 4))
    for access in (False, True):
        want = set()
        for q in range(9):
            sums = [(-0.9 * len({f"w{q}", f"w{(q + 1) % 9}"} & set(t.split())), c) for c, t in enumerate(texts) if not access or sees(q, c)]
            want |= {(q, c, round(-s, 6), i + 1) for i, (s, c) in enumerate(sorted(x for x in sums if x[0])[:7])}
        for terms, pairs in ((rt.BLOCK_TERMS, rt.CELLS), (4, 50)):
            monkeypatch.setattr(rt, "BLOCK_TERMS", terms)
            monkeypatch.setattr(rt, "CELLS", pairs)
            for rows in (lists, tm.keyword_rows(lists)):
                found = rt.keyword_top_k(rows, queries, forms, 7, access)
                assert {tuple(r) for r in found.collect()} == want
        plan = rt.keyword_top_k(lists, queries, forms, 7)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "HashAggregate" not in plan


def test_hash_embedding_counts_slice_by_slice(spark):
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(i % 9)) for i in range(vx.ROWS_COUNTED + 40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    some = (0, 5, vx.ROWS_COUNTED - 1, vx.ROWS_COUNTED, len(texts) - 1)
    whole = {r.i: r.e for r in rows.select("i", vx.hash_embedding(F.col("t")).alias("e")).filter(F.col("i").isin(*some)).collect()}
    for i in some:
        alone = spark.createDataFrame([(texts[i],)], "t string").select(vx.hash_embedding(F.col("t")).alias("e")).first().e
        assert whole[i] == alone and sum(alone) == 8 * max(1, len(texts[i].split()))


def test_a_search_writes_only_the_tables_it_reads(spark, monkeypatch):
    """A sparse search waits for no vectors and keywords; each table is written once."""
    docs = spark.createDataFrame([(1, "red apples and pears", "a.pdf", "pdf", "indexed", "en", "f"), (2, "green pears", "b.pdf", "pdf", "indexed", "en", "f")],
                                 "doc_id long, text string, file_name string, type string, status string, dept_id string, folder_id string")
    written, settled = [], ix.settled
    monkeypatch.setattr(ix, "settled", lambda df: written.append(tuple(df.columns)) or settled(df))
    found = hy.SearchIndex.of_documents(docs)
    assert found.words is found.words
    assert len(written) == 4 and not any("embedding" in c or "keywords" in c for c in written)
    assert found.vectors.count() == found.keywords.count() == 2 and found.vectors is found.vectors
    assert len(written) == 6


def test_texts_of_chunks_are_not_shuffled_to_their_hits(spark, tmp_path):
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(i)).cast("string"), 256) for i in range(8)])
    spark.range(4000).select(F.col("id").alias("chunk_id"), (F.col("id") % 100).alias("doc_id"), text.alias("content"),
                             F.lit("text").alias("chunk_type")).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    documents = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("f").alias("file_name"), F.lit("pdf").alias("type"))
    scored = spark.range(2).crossJoin(chunks.select("chunk_id")).select(F.col("id").alias("query_id"), "chunk_id", (F.col("chunk_id") % 97).alias("score"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = rt.top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], 20)
        rows = rt.hit_rows(hits, chunks, documents)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(chunk_id" not in plan and "SortMergeJoin" not in plan
        got = {(r.query_id, r.chunk_id): r.content for r in rows.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {(r.query_id, r.chunk_id) for r in hits.collect()}
    assert set(got) == want and len(want) == 40 and all(len(x) == 8 * 65 - 1 for x in got.values())
