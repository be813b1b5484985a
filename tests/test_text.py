import collections
import re

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import blocks as bk
from leafmill.operators import chunks as ck
from leafmill.operators import graph as gr
from leafmill.operators import terms as tm


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("o")).first()["o"]


def test_normalise(spark):
    assert one(spark, "Project Atlas / EGFR 적응증", tx.normalise) == "project atlas / egfr 적응증"
    assert [one(spark, v, tx.normalise) for v in (None, "", "!!")] == ["", "", ""]


def test_candidate_terms(spark):
    assert one(spark, "EGFR 관련 적응증 및 milestone 요약", tx.candidate_terms) == ["egfr", "적응증", "milestone"]


def test_token_length(spark):
    assert [one(spark, v, tx.token_length) for v in ("", "  \n", "abc", "a" * 9, " " + "a" * 8 + "\t")] == [0, 0, 1, 2, 2]


def test_strip_takes_all_white_space(spark):
    assert one(spark, " \x1c a b  \n", tx.strip) == "a b"


def test_preview_and_search(spark):
    assert one(spark, "x" * 241, tx.preview) == "x" * 237 + "..."
    assert one(spark, "x" * 240, tx.preview) == "x" * 240
    hits = spark.createDataFrame([("Report_1.PDF",), ("reportX1.pdf",)], "f string")
    assert hits.filter(tx.matches_search("report_1", F.col("f"))).count() == 2  # _ is a wildcard
    assert hits.filter(tx.contains_search("report_1", F.col("f"))).count() == 1


def recursive(spark, texts, size, overlap, whole=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    return [r["t"] for r in ck.split_recursively(df, "t", size, overlap, whole).orderBy("i").collect()]


def test_recursive_split(spark):
    words = " ".join(f"word{i:04d}" for i in range(40))  # two tokens each, with the blank before
    pieces = recursive(spark, [[words]], 10, 4)[0]
    assert pieces[0] == " ".join(f"word{i:04d}" for i in range(5)) and pieces[1] == " ".join(f"word{i:04d}" for i in range(3, 8))
    assert all(tx_length(p) <= 11 for p in pieces) and pieces[-1].endswith("word0039")
    assert recursive(spark, [[words]], 10, 0)[0] == [" ".join(f"word{i:04d}" for i in range(k, k + 5)) for k in range(0, 40, 5)]
    got = recursive(spark, [["aa\n\nbb" * 3, "x" * 100, " \n "], [], None, ["", "short"]], 8, 2)
    assert got[0][0] == "aa\n\nbbaa\n\nbbaa\n\nbb" and got[1:] == [[], [], ["short"]]
    assert got[0][1] == "xxxxxxxx" and got[0][-1].strip("x") == "" and sum(map(len, got[0][1:-1])) > 100  # single characters, with overlap
    assert recursive(spark, [["One. Two! Three? " * 10]], 8, 3)[0][0].startswith("One. Two")


def tx_length(text):
    n = len(text.strip())
    return max(1, n // 4) if n else 0


def test_contained_rows_in_one_block_and_in_many(spark, monkeypatch):
    import random

    rng = random.Random(4)
    needles = [(i, "".join(rng.choice("ab 中") for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(60, ""), (61, None), (62, "aaaaaaaaaaaaaaaaaaaa")]
    texts = [(i, "".join(rng.choice("ab 中") for _ in range(rng.randint(0, 12))), i) for i in range(200)] + [(200, None, 0), (201, "a" * 50_000, 0)]
    dictionary = spark.createDataFrame(needles, "place int, word string")
    rows = spark.createDataFrame(texts, "id int, t string, place int").repartition(4)
    want = {i: [n for n in needles if n[1] and n[1] in (x or "")] for i, x, _ in texts}
    for room in (tm.BLOCK_CHARS, 20):
        monkeypatch.setattr(tm, "BLOCK_CHARS", room)
        got = {r["id"]: [tuple(h) for h in r["hits"]] for r in tm.contained_rows(rows, "t", dictionary, "word").collect()}
        assert got == want
    assert {len(r["hits"]) for r in tm.contained_rows(rows, "t", dictionary.limit(0), "word").collect()} == {0}
    assert tm.contained_rows(rows.limit(0), "t", dictionary, "word").collect() == []
    plan = tm.contained_rows(rows, "t", dictionary, "word")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_expand_terms(spark):
    terms = spark.createDataFrame([(1, 0, "마일스톤"), (1, 1, "적응증"), (2, 0, "other")], "query_id int, pos int, term string")
    out = tm.expand_terms(terms, tm.alias_rows(spark), ["query_id"]).orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.pos, r.variant) for r in out] == [
        (1, 0, "milestone"), (1, 1, "마일스톤"), (1, 2, "indication"), (1, 3, "적응증"), (2, 0, "other")]


def test_later_alias_rows_override(spark):
    table = spark.createDataFrame([(0, "goal", "milestone", "domain", "en", 1.0)],
                                  "ord long, canonical_name string, alias string, alias_type string, language string, boost double")
    terms = spark.createDataFrame([(1, 0, "milestone")], "query_id int, pos int, term string")
    out = tm.expand_terms(terms, tm.alias_rows(spark, table), ["query_id"]).orderBy("pos").collect()
    assert [r.variant for r in out] == ["milestone", "goal"]


def test_spellings_of_a_frequent_name_are_many_tasks(spark, monkeypatch):
    """Rows come out in parts of about SPELLED, none of them sorted where a name meets its spellings; the result is that of brute force."""
    monkeypatch.setattr(tm, "SPELLED", 1000, raising=False)
    names = [f"{'Red' if i % 2 else 'red'} bolt {i // 2}{'!' * (i % 3)}" for i in range(90)]
    table = [(i, "Hot" if i % 9 else f"Cold {i % 2}", x) for i, x in enumerate(names)]
    given = spark.createDataFrame([(*row, "product", "en", 1.0) for row in table], "ord long, canonical_name string, alias string, alias_type string, language string, boost double")
    texts = {k: [names[k % 90], "hot", f"other {k}", names[k % 7].upper()][k % 2:] for k in range(400)} | {None: ["cold 1"], -1: ["hot", "?"]}
    terms = spark.createDataFrame([(k, i, x) for k, given_ in texts.items() for i, x in enumerate(given_)], "k long, pos int, term string")
    norm = lambda x: " ".join(re.findall(r"[0-9a-z._+\-/]+", x.lower()))
    owner, spelled = {}, {}
    for _, name, alias in table:
        owner[norm(alias)] = owner[norm(name)] = norm(name)
        spelled.setdefault(norm(name), set()).update((name, alias))
    want = set()
    for k, given_ in texts.items():
        best = {}
        for i, x in enumerate(given_):
            for v in {x} | spelled.get(owner.get(norm(x)), set()):
                if norm(v):
                    best[norm(v)] = max(best.get(norm(v), (-99,)), (-i, len(v), v))
        want |= {(k, i, b[2], n) for i, (b, n) in enumerate(sorted(((b, n) for n, b in best.items()), reverse=True))}
    out = tm.expand_terms(terms, tm.alias_rows(spark, given), ["k"])
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    assert {tuple(r)[:4] for r in rows} == want and len(rows) == len(want) > 15_000
    assert max(collections.Counter(r.part for r in rows).values()) < 2500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortAggregate(key=[k#" not in plan.split("REPARTITION_BY_NUM", 1)[1]


def keywords(spark, text, aliases=None, **params):
    rows = tm.keyword_index(spark.createDataFrame([(1, text)], "id int, t string"), ["id"], "t", aliases, **params)
    return [(r.normalized_keyword, round(r.weight, 4), r.keyword_type) for r in rows.orderBy("rank").collect()]


def test_keywords(spark):
    found = keywords(spark, "Project Atlas의 적응증은 NSCLC이고 milestone status는 pending 입니다.")
    assert [(k, w) for k, w, _ in found] == [
        ("nsclc", 1.25), ("milestone", 1.2), ("indication", 1.15), ("적응증", 1.1), ("적응증은", 1.0), ("이고", 1.0),
        ("project", 0.9), ("pending", 0.9), ("status", 0.9), ("atlas", 0.9)]
    assert {"preclinical", "비임상", "clinical", "임상"} <= {k for k, _, _ in keywords(spark, "비임상 시험")}


def test_alias_table_gives_the_same_keywords(spark):
    for text in ("Project Atlas의 적응증은 NSCLC이고 milestone", "비임상 시험 term sheet", "nothing here", "CMC cmc 타깃"):
        assert keywords(spark, text) == keywords(spark, text, tm.alias_rows(spark))


def test_keyword_cap(spark):
    assert len(keywords(spark, " ".join(f"word{i}" for i in range(100)))) == 48


def windows(spark, n, size=512, overlap=50):
    text = " ".join(str(i) for i in range(n))
    out = one(spark, text, lambda t: ck.word_windows(tx.words(t), size, overlap))
    return [(int(w.split()[0]), int(w.split()[-1]) + 1) for w in out]


def test_word_windows(spark):
    assert windows(spark, 0) == []
    assert windows(spark, 462) == [(0, 462)]
    assert windows(spark, 463) == [(0, 463), (462, 463)]
    assert windows(spark, 512) == [(0, 512), (462, 512)]
    assert windows(spark, 1000) == [(0, 512), (462, 974), (924, 1000)]
    assert windows(spark, 4, 2, 5) == [(0, 2), (1, 3), (2, 4), (3, 4)]


def test_merge_small(spark):
    def sizes(*tokens, least=80):
        sections = ["x" * (4 * n) for n in tokens]
        df = spark.createDataFrame([(sections,)], "s array<string>")
        return df.select(ck.merge_small(F.col("s"), least).alias("o")).first()["o"]
    a, b = "x" * 360, "x" * 40
    assert sizes(90, 10, 10) == [f"{a}\n\n{b}\n\n{b}"]
    assert sizes(10, 90) == [f"{b}\n\n{a}"]
    assert sizes(90, 90) == [a, a]
    assert sizes(10) == [b]
    assert sizes() == []
    assert sizes(10, 90, least=0) == [b, a]


def test_structural_sections(spark):
    text = "# Overview\r\nfirst  \n  second\n\n---\n1.2. Scope\nlast\n  | a | b |  \n\n \n# Two words\n"
    assert one(spark, text, ck.structural_sections) == [
        "# Overview", "first\n  second", "1.2. Scope", "last\n| a | b |", "# Two words"]


def test_chunk_strategies(spark):
    long = " ".join(f"w{i}" for i in range(1200))
    assert one(spark, "  \n ", ck.text_chunks) == []
    assert one(spark, " short ", lambda t: ck.text_chunks(t, "token")) == ["short"]
    assert len(one(spark, long, lambda t: ck.text_chunks(t, "token"))) == 3
    assert one(spark, long, lambda t: ck.text_chunks(t, "odd")) == one(spark, long, ck.text_chunks)


def test_separator_split_keeps_all_text(spark):
    text = "One. Two? Three! " * 40 + "\n\n" + "x" * 5000 + "\n" + "a, b; c " * 300
    for size in (5, 40, 512):
        out = one(spark, text, lambda t: ck.separator_split(t, size))
        assert "".join(out) == text
        assert all(max(1, len(p.strip()) // 4) <= size for p in out if p.strip())


def test_block_chunks_keep_fields(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "text", "적응증 관련 요약 문장입니다.", 2, None, "Overview"),
         (1, 1, "table", "| Target | Value |\n| --- | --- |\n| EGFR | NSCLC |", 3, "Summary", None),
         (1, 2, "text", "   ", 3, None, None)],
        "doc_id long, block_idx int, block_type string, source_text string, page_number int, sheet_name string, section_path string")
    out = ck.chunk_blocks(blocks, 128, 16).orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, r.chunk_type, r.token_cnt, r.page_number, r.sheet_name, r.section_path) for r in out] == [
        (0, "text", 4, 2, None, "Overview"), (1, "table", 12, 3, "Summary", None)]


PAGE = """# Overview
first line
second line

Table 1. Results
| a | b |
| --- | --- |
| 1 | 2 |
after the table"""


def test_blocks_of_a_page(spark):
    out = one(spark, PAGE, bk.block_array)
    assert [(b.block_type, b.source_text, b.section_path) for b in out] == [
        ("text", "# Overview", "Overview"), ("text", "first line\nsecond line", None),
        ("caption", "Table 1. Results", None), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |", None),
        ("text", "after the table", None)]
    assert one(spark, "tables are useful", bk.block_array)[0].block_type == "caption"
    assert [b.block_type for b in one(spark, "|\n|x\nFIG. 2\n그림 3", bk.block_array)] == ["table", "text", "caption", "caption"]
    assert one(spark, "\n \n", bk.block_array) == []


def test_pages_and_blocks(spark):
    docs = spark.createDataFrame([(1, "A\n---\n\n---\nB")], "doc_id long, md string")
    pages = bk.split_pages(docs, ["doc_id"], "md")
    assert [(p.page_num, p.text) for p in pages.orderBy("page_num").collect()] == [(1, "A"), (3, "B")]
    blocks = bk.page_blocks(pages).orderBy("block_idx").collect()
    assert [(b.block_idx, b.page_number, b.source_text) for b in blocks] == [(0, 1, "A"), (1, 3, "B")]


def test_parsed_documents(spark):
    parsed = spark.createDataFrame(
        [(1, "whole", [(2, "Figure 1. EGFR summary\nbody")], [("/i/a.png", 2), ("/i/b.jpg", None)]),
         (2, "only markdown", [], [])],
        "doc_id long, markdown string, pages array<struct<page_num:int,text:string>>, images array<struct<path:string,page_num:int>>")
    rows = bk.parsed_blocks(parsed)
    out = [(r.doc_id, r.block_idx, r.block_type, r.source_text, r.page_number, r.image_type) for r in rows.orderBy("doc_id", "block_idx").collect()]
    assert out == [
        (1, 0, "caption", "Figure 1. EGFR summary", 2, None), (1, 1, "text", "body", 2, None),
        (1, 2, "image", "Extracted image 1 from page 2", 2, "png"), (1, 3, "image", "Extracted image 2 from page 1", None, "jpg"),
        (2, 0, "text", "only markdown", None, None)]
    linked = {(r.doc_id, r.block_idx): r for r in bk.link_captions(rows).collect()}
    assert linked[1, 2].parent_block_idx == 0
    assert linked[1, 2].source_text == "Extracted image 1 from page 2\nCaption: Figure 1. EGFR summary"
    assert linked[1, 3].parent_block_idx is None


def link(spark, rows):
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, block_idx int, block_type string, page_number int, slide_number int, source_text string")
    return {r.block_idx: r.parent_block_idx for r in bk.link_captions(df).collect()}


def test_nearest_caption(spark):
    assert link(spark, [(0, "caption", 1, None, "a"), (2, "image", 1, None, "i"), (4, "caption", 1, None, "b")])[2] == 0
    assert link(spark, [(0, "caption", 2, None, "a"), (2, "image", 1, None, "i")])[2] is None
    assert link(spark, [(0, "caption", None, None, "a"), (2, "image", None, None, "i")])[2] == 0
    assert link(spark, [(0, "caption", 2, 7, "a"), (5, "image", 1, 7, "i"), (9, "caption", 1, 8, "b")])[5] == 9
    assert link(spark, [(0, "caption", 2, 0, "a"), (5, "image", 1, 0, "i")])[5] is None


def test_link_captions_across_position_buckets(spark):
    rows = [(0, "caption", 1, None, "a"), (9000, "image", 1, None, "i"), (30000, "caption", 1, None, "b"), (29000, "image", 1, None, "j")]
    out = link(spark, rows)
    assert (out[9000], out[29000]) == (0, 30000)


def test_grids_sheets_slides(spark):
    cells = [(0, 0, "구분"), (0, 1, "값"), (1, 0, "Target"), (1, 1, "EGFR"), (2, 0, "only"), (3, 0, "a"), (3, 1, "b"), (3, 2, "cut")]
    df = spark.createDataFrame([(1, 1, *c) for c in cells], "doc_id int, table_id int, row int, col int, text string")
    assert bk.grid_tables(df, ["doc_id", "table_id"]).first()["source_text"] == (
        "| 구분 | 값 |\n| --- | --- |\n| Target | EGFR |\n| only |  |\n| a | b |")
    sheet = spark.createDataFrame([(1, "S", 0, 0, "x"), (1, "S", 0, 1, None), (1, "S", 1, 0, " "), (1, "S", 2, 0, "7"), (1, "S", 2, 1, "8")],
                                  "doc_id int, sheet_name string, row int, col int, value string")
    block = bk.sheet_blocks(sheet).first()
    assert (block.source_text, block.section_path) == ("## Sheet: S\n\nx | \n7 | 8", "Sheet:S")
    parts = spark.createDataFrame([(1, 2, 0, "b"), (1, 1, 0, "a"), (1, 1, 1, "c")], "doc_id int, slide_number int, pos int, text string")
    assert bk.slide_texts(parts).first()["deck_text"] == "## Slide 1\n\na\n\nc\n\n## Slide 2\n\nb"


def test_routes(spark):
    files = spark.createDataFrame([("PDF",), ("docx",), ("xls",), ("pptx",), ("txt",)], "type string")
    out = {r.type: (r.reader, r.status) for r in bk.route_by_type(files).collect()}
    assert out == {"PDF": ("pages", "processing"), "docx": ("document", "processing"), "xls": ("sheets", "processing"),
                   "pptx": ("slides", "processing"), "txt": (None, "failed")}


MENTIONS = ("주식회사 한빛 김민수 팀장 2024년 3월 15일 EGFR NSCLC의 DataLake v2 PDF Atlas-7 홍길동대표 "
            "2024-03-15 1분기 2024년")


def test_mentions(spark):
    import re

    from leafmill.functions import fixed_values as fv
    out = gr.mentions(spark.createDataFrame([(1, MENTIONS)], "doc_id int, text string"), offsets=True).orderBy("place").collect()
    plain = gr.mentions(spark.createDataFrame([(1, MENTIONS)], "doc_id int, text string")).orderBy("place").collect()
    assert [(m.entity_name, m.entity_type) for m in plain] == [(m.entity_name, m.entity_type) for m in out]
    by_type = {}
    for m in out:
        by_type.setdefault(m.entity_type, []).append(m.entity_name)
        assert MENTIONS[m.start_char:m.end_char].strip() == m.entity_name
    assert "주식회사 한빛 김민수 팀장 2024년 3월 15" in by_type["ORG"]
    assert by_type["PERSON"] == ["홍길동대표"]
    assert by_type["DATE"] == ["2024년 3월 15일", "2024-03-15", "3월 15일", "2024년", "1분기 2024년"]
    assert by_type["TECH"][:2] == ["EGFR", "DataLake"] and {"DataLake v2", "Atlas-7"} <= set(by_type["TECH"])
    assert "PDF" not in by_type["TECH"] and "NSCLC" not in by_type["TECH"]
    # every rule finds what the same pattern finds in Python, first of each name and type
    want = []
    for i, (kind, pattern) in enumerate(fv.ENTITY_PATTERNS):
        for m in re.finditer(pattern, MENTIONS):
            name = m.group(0).strip()
            if len(name) < (3 if i == 0 else 2) or (i == fv.ACRONYM_RULE and name in fv.ACRONYM_STOP_FORMS):
                continue
            if (name, kind) not in [w[:2] for w in want]:
                want.append((name, kind, m.start()))
    assert [(m.entity_name, m.entity_type, m.start_char) for m in out] == want


def test_cut_mark_inside_a_text(spark):
    text = "one \uffff two \ufffe three\n\nfour \ufffe1 five"
    assert one(spark, text, ck.structural_sections) == ["one \uffff two \ufffe three", "four \ufffe1 five"]


def test_alias_without_boost_counts_one(spark):
    table = spark.createDataFrame([(1, "Canon", "nickname", "x", "en", None)], "ord int, canonical_name string, alias string, alias_type string, language string, boost double")
    assert ("nickname", 1.0, "x") in keywords(spark, "the nickname here", tm.alias_rows(spark, table))


def test_windows_in_batches_equal_the_expressions(spark):
    import random

    rng = random.Random(6)
    parts = ["word ", "x" * 30, "\n", "\n\n", "\r\n", "---\n", "## Head\n", "1.2. Part\n", " | a | b | \n", "\t", "\x1c", "　", "٣. x\n", "한국 ", "|", "\x85", "￿", "a b c d e f g h "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", " \n ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for params in ({}, {"strategy": "token", "size": 12, "overlap": 3}, {"size": 9, "overlap": 2, "min_tokens": 5}, {"min_tokens": 0, "size": 3, "overlap": 9}):
        want = {r["i"]: r["o"] for r in df.select("i", ck.text_chunks(F.col("t"), **params).alias("o")).collect()}
        assert {r["i"]: r["pieces"] for r in ck.chunk_lists(df, ["i"], "t", **params).collect()} == want


def test_strip_takes_what_the_pattern_takes(spark):
    rows = spark.range(0xD800).select(F.expr("cast(id as int)").alias("c"), F.expr("char_length(btrim(decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE'), 'x'))").alias("n"),
                                      F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("t"))
    kept = rows.select("c", (tx.strip(F.col("t")) == "").alias("by_characters"), (F.regexp_replace("t", rf"(?U){tx.SPACE}", "") == "").alias("by_pattern"))
    assert kept.filter("by_characters <> by_pattern").count() == 0 and kept.filter("by_pattern").count() == len(tx.SPACES)


def test_one_spelling_of_many_rows_is_found_once(spark):
    """An alias that the dictionary repeats costs a text no more than the keys it writes."""
    rows = [(i, f"Maker {i % 3}", "hot bolt", "part", "en", 1.0 + i / 1000) for i in range(900)]
    table = spark.createDataFrame(rows, "ord long, canonical_name string, alias string, alias_type string, language string, boost double")
    writes = tm.alias_writes(tm.alias_rows(spark, table)).filter("needle = 'hot bolt'")
    assert writes.count() == 4  # its own key, and those of three makers
    found = keywords(spark, "see hot bolt", tm.alias_rows(spark, table))
    assert found[:4] == [("maker 2", 1.949, "canonical"), ("maker 1", 1.948, "canonical"), ("maker 0", 1.947, "canonical"), ("hot bolt", 1.899, "part")]


def test_a_task_normalises_as_the_column_function_does(spark):
    points = [c for c in (*range(1, 0x3000), *range(0xABF0, 0xD7B0), *range(0xF900, 0x10000), *range(0x10400, 0x10450), 0x1F600) if not 0xD800 <= c < 0xE000]
    texts = [f"A{chr(c)}b {chr(c)}  Z" for c in points] + ["", None, "  a,,b  ", "İKK ẞΣ 가.나-다/_+"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", tx.normalise(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: tx.normalised(x) for i, x in enumerate(texts)}


def test_keywords_are_made_in_one_pass_over_the_texts(spark):
    rows = spark.createDataFrame([(1, "Target SAFETY of the phase-2 target, NSCLC!"), (2, None), (3, "비임상 자료 beta")], "chunk_id int, content string")
    lists = tm.keyword_lists(rows, ["chunk_id"], "content")
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_replace" not in plan
    got = {r.chunk_id: [(k.keyword, k.normalized_keyword, k.keyword_type, round(k.weight, 2)) for k in r.keywords] for r in lists.collect()}
    assert got[2] == [] and ("phase-2", "phase-2", "token", 0.9) in got[1] and ("NSCLC", "nsclc", "drug_dev", 1.2) not in got[1]
    assert ("nsclc", "nsclc", "canonical", 1.25) in got[1] and got[3][0][0] == "preclinical"


def test_collapse_space_leaves_single_spaces(spark):
    import re

    texts = ["a b", "a  b", "a \n b", "a\n\nb c", "\t a　b\x85 c ", " ", "", "a\xa0 b", "a \xa0b\r\n c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.o, r.singles) for r in rows.select("i", tx.collapse_space(F.col("t")).alias("o"), F.col("t").rlike(tx.SPREAD_SPACE).alias("singles")).collect()}
    assert {i: o for i, (o, _) in got.items()} == {i: re.sub(f"[{tx.SPACES}]+", " ", x).strip(" ") for i, x in enumerate(texts)}
    assert not got[0][1] and all(got[i][1] for i in (1, 2, 3, 4, 7, 8))


def test_keywords_do_not_depend_on_the_blocks_of_the_dictionary(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Target SAFETY of the term sheet, NSCLC!"), (2, None), (3, "비임상 milestone beta")], "chunk_id int, content string")
    aliases = tm.alias_rows(spark)
    whole = {r.chunk_id: r.keywords for r in tm.keyword_lists(rows, ["chunk_id"], "content", aliases).collect()}
    monkeypatch.setattr(tm, "BLOCK_CHARS", 60)
    assert {r.chunk_id: r.keywords for r in tm.keyword_lists(rows, ["chunk_id"], "content", aliases).collect()} == whole
