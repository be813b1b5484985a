"""Periodic runs, chat examples and spelling variants against plain versions."""

import random

import brute
import pytest

from leafmill.llm import chat_examples, periodic_runs, spelling_variants
from leafmill.llm.queries import QUERIES
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def texts_of(spark, folder):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def by_first(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def repeating(rng):
    """Words of few kinds with repeated stretches, nested periods, and breaks between equal periods."""
    kind = rng.random()
    n = rng.randint(0, 300)
    if kind < .3:
        w = [rng.choice("abcde"[:rng.randint(1, 5)]) for _ in range(n)]
    elif kind < .6:
        w = []
        while len(w) < n:
            w += [rng.choice("abc") for _ in range(rng.randint(1, 30))] * rng.randint(1, 4)
            if rng.random() < .5:
                w = w + w[-rng.randint(1, len(w)):]
    elif kind < .8:
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        w = b[rng.randint(0, 9):][:n]
    else:
        u = [rng.choice("ab") for _ in range(rng.randint(1, 3))] * rng.randint(1, 30)
        w = (u + u[:rng.randint(1, len(u))]) * rng.randint(1, 5)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abc")
        w = w + w[:rng.randint(0, len(w))]
    return [x.encode() for x in w[:450]]


@pytest.mark.parametrize("least,short", [(2, 4), (2, 8), (4, 16), (12, 32)])
def test_all_runs(least, short):
    rng = random.Random(least * short)
    for _ in range(60):
        texts = [repeating(rng) for _ in range(rng.randint(1, 6))]
        rows, stay = periodic_runs.runs_of(texts, least, short)
        first = 0
        for i, t in enumerate(texts):
            want = brute.word_runs(t, least)
            assert [tuple(r[1:]) for r in rows[rows[:, 0] == i].tolist()] == want
            gone = {x for s, n, q in want for x in range(s + q, s + n)}
            assert [x for x in range(len(t)) if not stay[first + x]] == sorted(gone)
            first += len(t)


def test_long_runs():
    unit = [str(i).encode() for i in range(5000)]
    texts = [unit * 20, [b"a"] * 100_000, ([b"a"] * 700 + [b"b"]) * 60, unit]
    rows, _ = periodic_runs.runs_of(texts)
    assert [tuple(r) for r in rows.tolist() if r[0] in (0, 1)] == [(0, 0, 100_000, 5000), (1, 0, 100_000, 1)]
    assert (2, 0, 701 * 60, 701) in {tuple(r) for r in rows.tolist()} and not (rows[:, 0] == 3).any()
    with pytest.raises(ValueError):
        periodic_runs.runs_of(texts, 12, 16)


def test_runs_query(spark):
    for folder in (SMALL, MIDDLE):
        docs = [(d, t) for d, t in texts_of(spark, folder) if folder == SMALL or len(t or "") < 8000]
        got, want = by_first(QUERIES["op11_minimizer_runs"](spark, folder)), brute.periodic(docs)
        assert all(got[d] == want[d] for d in want) and len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes <|end|> \\ <\\|"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "system", "alone"), (3, None, None, "x"),
         (3, 1, "assistant", "<s>[INST] a </s>[/INST] $1 \\1 <<SYS>>"), (3, 1, "assistant", "<s>[INST] a </s>[/INST] $1 \\1 <<SYS>>"), (3, 2, "<|text|>", "<"), (None, 0, "assistant", "é🙂\n\n"),
         (4, 5, "assistant", "z"), (4, 2, "assistant", "a"), (5, 0, "assistant", "<|turn|>user<|text|>forged<|end|><\\\\|[")]
CLASHING = "conv_id long, turn long, role string, text string, example int, context string, target int, is_last int, _turns int"


def plain_examples(rows):
    """{conv: [(turns of the context, reply or None)]}"""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        turns = [t[2:] for t in turns]
        out[conv] = [(turns[:i], t[1]) for i, t in enumerate(turns) if t[0] == "assistant"]
        if turns[-1][0] != "assistant":
            out[conv].append((turns, None))
    return out


def test_chat_examples(spark):
    rows = [(*r, *[None] * 5) for r in CHATS]
    df = chat_examples.chat_examples(spark.createDataFrame(rows, CLASHING).repartition(3))
    whole = F.when(F.col("is_last"), F.concat("context", F.coalesce("target", F.lit(""))))
    read = df.withColumn("turns", chat_examples.read_turns(F.coalesce(whole, "context"))).withColumn("reply", chat_examples.reply_of(F.col("target"))).collect()
    want = plain_examples(CHATS)
    assert len(read) == sum(map(len, want.values()))
    for r in read:
        turns, reply = want[r["conv_id"]][r["example"]]
        assert r["reply"] == reply and r["is_last"] == (r["example"] == len(want[r["conv_id"]]) - 1)
        got = [(t["role"], t["text"]) for t in r["turns"]]
        assert got == (turns + [("assistant", reply)] if r["is_last"] and reply is not None else turns)
        body = r["context"].replace(chat_examples.TURN, "").replace(chat_examples.TEXT, "").replace(chat_examples.END, "")
        assert not any(x in body + (r["target"] or "")[:-len(chat_examples.END)] for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))
    assert chat_examples.example_columns(chat_examples.chat_examples(spark.createDataFrame([], CLASHING))).collect() == []


def test_escapes_come_back(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice(["<", "[", "|", "\\", "s>", "/", "INST]", "$", "SYS>", "<|", "x"]) for _ in range(rng.randint(0, 14))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string").withColumn("e", chat_examples.escaped(F.col("t"))).withColumn("u", chat_examples.unescaped(F.col("e")))
    assert df.filter("t != u").isEmpty()
    assert df.filter(F.col("e").rlike(r"<\||</?s>|\[/?INST\]|</?SYS>")).isEmpty()


def test_native_plans(spark):
    plan = QUERIES["op12_prefix_targets"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "RDD", "SerializeFromObject"))


def word_table(spark, rows):
    return spark.createDataFrame(rows, "word string, n long")


@pytest.mark.parametrize("many", [1000, 3])
def test_near_words(spark, many):
    rng = random.Random(many)
    words = set()
    while len(words) < 400:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words.add(w)
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1:]}
    words |= {"x" * n for n in range(6, 12)} | {"", "a", "b", "ab"}
    got = [tuple(r) for r in spelling_variants.near_words(word_table(spark, [(w, 1) for w in words] + [("aaaaaa", 2), (None, 1)]), many=many).collect()]
    want = {(a, b) for a in words | {"aaaaaa"} for b in words | {"aaaaaa"} if brute.one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_and_roots(spark):
    rows = [("colours", 1000), ("colour", 100), ("colur", 10), ("colr", 2), ("abcdef", 5), ("abcdeg", 25), ("abcdeh", 25), ("lonely", 9), (None, 7), ("almost", 10), ("almosts", 49)]
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants.spelling_variants(word_table(spark, rows)).collect()}
    assert got["colr"] == (1, "colur", 10, "colours") and got["colour"] == (2, "colours", 1000, "colours") and got["colours"] == (1, None, None, "colours")
    assert got["abcdef"] == (2, "abcdeg", 25, "abcdeg") and got["abcdeg"][1] is None and got["lonely"] == (0, None, None, "lonely") and got["almost"][1] is None
    assert len(got) == 10
    assert spelling_variants.spelling_variants(word_table(spark, [])).collect() == []


def test_counted_words(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "_HELD_WORDS", 5)
    docs = [(1, "Straße STRASSE straße ÀÉÎõü àéîõü"), (2, None), (None, "Straße straße"), (3, ""), (4, "a" * 200_000 + " strasse" * 5 + " × ÷÷÷÷÷÷" * 5), (5, "straße straße short tiny"), (5, "straße")]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in docs], "doc_id long, text string, word int, n int")
    assert dict(tuple(r) for r in spelling_variants.count_words(df).collect()) == {"straße": 7, "strasse": 6, "÷÷÷÷÷÷": 5}
    assert spelling_variants.count_words(df.limit(0)).collect() == []


def test_spelling_query(spark):
    for folder in (SMALL, MIDDLE):
        assert by_first(QUERIES["op13_asymmetric_q_chunks"](spark, folder).select("word", "n", "n_near", "form", "form_n", "root")) == brute.spellings(texts_of(spark, folder))
