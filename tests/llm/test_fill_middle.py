from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from tidemark.llm import fill_middle
from tidemark.llm.fill_middle import ClassRuns, Marks, fill_in_middle, restore


def plain(doc_id, text):
    """The contract's rules, unit by unit."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(8)
    letters = ["a", "Zq", "é", "ß", " ", "  ", "\n", "\x00", "1", "_", "<", ">", "<P", "S>", "<<", "M", "日本", "😀", "́", "[", "{", "@", "`", "K"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return made + [None, "", " ", "x", "7", "the <M> mark", "<P>", "a" * 5000, "é" * 5000, "ab " * 400_000, *["same text again"] * 3]


def test_runs_give_the_offset_of_every_cut():
    for text in odd_texts():
        text = (text or "")[:3000]
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        runs = ClassRuns(text)
        assert runs.units == len(tokens)
        at = 0
        for n, t in enumerate([*tokens, ""]):
            assert runs.offset(n) == at
            at += len(t)


def test_outputs_by_plain_rules_and_exact_round_trip(spark):
    texts = odd_texts()
    docs = documents(spark, texts).withColumns({"_text": F.lit("clash"), "_cut": F.lit(1), "units": F.lit(2)})
    made = fill_in_middle(docs)
    assert made.columns == [*docs.columns, "form", "output", "n", "prefix_chars", "middle_chars"]
    rows = made.withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, texts[r.doc_id])
        assert r.back == (texts[r.doc_id] or "")
        assert r.text == texts[r.doc_id] and r["_text"] == "clash" and r.units == 2
    forms = {r.form for r in rows}
    assert forms == {"plain", "psm", "spm"}


def test_null_ids_empty_tables_and_other_marks(spark):
    schema = "doc_id long, text string"
    assert fill_in_middle(spark.createDataFrame([], schema)).collect() == []
    nameless = fill_in_middle(spark.createDataFrame([(None, "one two three")] * 2, schema)).collect()
    assert nameless[0] == nameless[1] and nameless[0].n == 5
    marks = Marks("p", "s", "m")
    docs = spark.createDataFrame([(i, "<P> holds <S> usual marks <M> " * 3) for i in range(60)], schema)
    made = fill_in_middle(docs, marks=marks, seed=9, cut_share=100, suffix_first_share=50)
    rows = made.withColumn("back", restore(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.back == r.text for r in rows)
    for wrong in (("<P>", "<P>", "<M>"), ("<P", "<PS", "<M>"), ("<P", "S", "<M"), ("<<", "<S", "<M")):
        with pytest.raises(ValueError):
            Marks(*wrong)
    assert fill_middle.MARKS == Marks()
