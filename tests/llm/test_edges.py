"""Every operator and stage on the tables that tend to break them, each case with its defined result."""

import pytest

import corpus_pipeline
from leafmill.llm import decontaminate, fingerprints, lm_scores, near_copies, packing, page_text, periodic_runs, pii, quality, suffix_dedup, toxicity
from leafmill.llm.queries import QUERIES, vocabulary
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 9973}é" for i in range(120_000))
TEXTS = [(1, "The same words again and again, on one line."), (1, "The same words again and again, on one line."), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, LONG),
         (None, "no id here but some words all the same"), (7, "x" * 5000), (8, "naïve Ünïcode — 漢字かな交じり文 🙂"), (9, "word")]
CLASHING = "doc_id long, text string, score double, predicted int, label int, id long, tag long, set long, n long, bucket int, spans string, kept string, piece int, length long, offset long, bin long, node int, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *[None] * 15, 3) for i, t in TEXTS], CLASHING).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(10)] + [(1, 1, 1), (None, 1, 1), (77, None, None), (78, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "again and again, on"), (2, None), (3, ""), (4, "!!"), (4, "word"), (5, "word")], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, b: suffix_dedup.remove_repeats(d),
    "op2": lambda d, b: quality.score_quality(d, None),
    "op3": lambda d, b: packing.pack_documents(d, vocabulary()),
    "op4": lambda d, b: fingerprints.edited_fingerprints(d),
    "op5": lambda d, b: toxicity.score_toxicity(d, None),
    "op6": lambda d, b: pii.pseudonymise_documents(d, b"k"),
    "op7": lambda d, b: near_copies.near_copies(d),
    "op8": lambda d, b: decontaminate.contamination_columns(decontaminate.find_contamination(d, b)),
    "op9": lambda d, b: lm_scores.score_texts(d, F.col("doc_id") < 5),
    "op11": lambda d, b: periodic_runs.run_columns(periodic_runs.periodic_runs(periodic_runs.repeat_tails(d))),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_every_row_comes_back_once(docs, bench, name):
    got = [r["doc_id"] for r in OPERATORS[name](docs, bench).collect()]
    if name == "op3":
        got = list(dict.fromkeys(got))
        assert set(got) == {i for i, _ in TEXTS}
    else:
        assert sorted(got, key=str) == sorted((i for i, _ in TEXTS), key=str)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_rows(none, bench, name):
    assert OPERATORS[name](none, bench).collect() == []


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_benchmark_rows(docs, bench, name):
    if name == "op8":
        assert not any(r["contaminated"] for r in OPERATORS[name](docs, bench.limit(0)).collect())


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_defined_results(docs, bench):
    by = {i: (n, removed) for i, n, removed in rows(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed")}
    size = len(LONG.encode())
    assert by[5] == by[6] == (size, size) and by[7] == (5000, 5000) and by[2] == by[3] == (0, 0) and by[1] == (44, 0)
    near = dict((i, c) for i, c in rows(near_copies.near_copies(docs), "doc_id", "component_id"))
    assert near[6] == 5 and near[2] == 2 and near[3] == 3 and near[4] == 4 and near[None] is None
    hit = {i: x for i, *x in rows(OPERATORS["op8"](docs, bench), "doc_id", "n_words", "n_hit", "n_items", "contaminated")}
    assert hit[1] == [9, 4, 1, True] and hit[2] == [0, 0, 0, False] and hit[9] == [1, 1, 2, True]
    known = {i: x for i, *x in rows(OPERATORS["op9"](docs, bench), "doc_id", "n_tokens", "n_known")}
    assert known[2] == known[3] == known[4] == [1, 1] and known[5] == known[6] == [120_001, 1]
    prints = {i: x for i, *x in rows(OPERATORS["op4"](docs, bench), "doc_id", "n_chars", "fingerprint", "near_next")}
    assert prints[2][:2] == [0, ""] and prints[5][1] == prints[6][1] and prints[5][2] == 1.0


def test_models_from_odd_labels(docs, none, labels):
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        for d in (docs, none):
            for marks in (labels, labels.limit(0)):
                model = fit(d, marks.select("doc_id", F.col("quality").alias("label")), F.lit(True))
                assert all(0 <= r["score"] <= 1 for r in score(d, model).collect())


def test_pages(spark):
    pages = [(1, "u", None, 1), (1, None, "", 1), (2, "u", "<<<>>><p", 1), (None, "u", "<article><p>a &amp; b<br>c</article>", 1), (3, "u", "<p>" * 20000 + "deep", 1),
             (4, "u", "<ul>" + "<li><a href=x>menu</a>" * 3000, 1), (5, "u", "<div>" * 3000 + "text" + "</p>" * 9, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = {(r["page_id"], r["url"]): r["text"] for r in page_text.extract_pages(df).collect()}
    assert got[(1, "u")] == got[(1, None)] == got[(4, "u")] == "" and got[(None, "u")] == "a & b c" and got[(3, "u")] == "deep"
    assert page_text.extract_pages(df.limit(0)).collect() == []


def test_stages(spark, docs, none, labels, bench, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    whole = spark.createDataFrame([(i, t, "en", None, None) for i, t in TEXTS], columns)
    for start in (whole, whole.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, start, str(tmp_path))
            if k < 4:
                assert out.columns == whole.columns
            out.collect()


def test_registered_queries_are_named_by_number():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
