from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import language_id
from tidemark.llm.language_id import END, FLOOR, LONGEST_GRAM, START

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": "ba ko ri tu mel", "bb": "sch ung ber ei ken", "cc": "eau ri lle on tu"}


def speech(rng, lang, n):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_model(rows, word_entries=None, gram_entries=None):
    """The docstring's rules by dictionaries: {lang: {item: log frequency}} of words and of n-grams by length."""
    words, grams = {}, {}
    for _, text, lang in rows:
        if text is None or lang is None:
            continue
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            words.setdefault(lang, Counter())[w] += 1
    for lang, own in words.items():
        for w in own:
            for k in range(1, LONGEST_GRAM + 1):
                spelt = w if k == 1 else START + w + END
                for i in range(len(spelt) - k + 1):
                    grams.setdefault(k, {}).setdefault(lang, Counter())[spelt[i : i + k]] += 1

    def kept(by_lang, entries):
        share = {(item, lang): n / sum(own.values()) for lang, own in by_lang.items() for item, n in own.items()}
        buckets = Counter(math.floor(math.log2(v) * 8) for v in share.values())
        so_far, lowest = 0, math.inf
        for b in sorted(buckets, reverse=True):
            so_far += buckets[b]
            if entries is not None and so_far > entries:
                break
            lowest = b
        return {k: max(FLOOR, math.log(v)) for k, v in share.items() if math.floor(math.log2(v) * 8) >= lowest}

    return sorted(words), kept(words, word_entries), {k: kept(own, gram_entries) for k, own in grams.items()}


def plain_predict(model, text):
    langs, words, grams = model
    found = regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
    if not found or not langs:
        return "und", 0.0
    known_words = {w for w, _ in words}
    total = dict.fromkeys(langs, 0.0)
    for w in found:
        if w in known_words:
            for lang in langs:
                total[lang] += words.get((w, lang), FLOOR)
            continue
        for k in range(LONGEST_GRAM, 0, -1):
            spelt = w if k == 1 else START + w + END
            own = [spelt[i : i + k] for i in range(len(spelt) - k + 1)]
            own = [g for g in own if any((g, lang) in grams.get(k, {}) for lang in langs)]
            if own:
                for lang in langs:
                    total[lang] += sum(grams[k].get((g, lang), FLOOR) for g in own) / len(own)
                break
    mean = {lang: v / len(found) for lang, v in total.items()}
    best = max(langs, key=lambda lang: mean[lang])
    close = [lang for lang in langs if mean[lang] > mean[best] - 1e-9]
    return close, 1 / sum(math.exp((mean[lang] - mean[best]) * math.sqrt(len(found))) for lang in langs)


@pytest.mark.parametrize("entries", [(200_000, 60_000), (60, 40)])
def test_predictions_by_plain_rules(spark, entries):
    rng = random.Random(12)
    rows = [(i, speech(rng, rng.choice(list(SYLLABLES)), rng.randint(0, 30)), None) for i in range(150)]
    rows = [(i, t, rng.choice([*SYLLABLES, None]) if i % 9 == 0 else next((k for k, v in SYLLABLES.items() if t[:2] in v), "aa")) for i, t, _ in rows]
    rows += [(900 + i, "same words again", "cc") for i in range(70)]
    odd = [None, "", " 12 !? ", "qqqq", "Ünïcode wörds", "ééé", "日本語 が", "İstanbul", "x" * 200_000, "ba " * 300_000, "ба ко", "²³ ½", "́́"]
    rows += [(2000 + i, t, "aa" if i % 2 else None) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"item": F.lit("clash"), "kind": F.lit(1), "n": F.lit(2)}).repartition(3)
    model = language_id.fit(docs, *entries)
    want = plain_model(rows, *entries)
    assert model.languages == want[0]
    found = language_id.identify(docs, model).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in found:
        langs, score = plain_predict(want, texts[r.doc_id])
        assert r.lang_pred in langs and r.score == pytest.approx(score, abs=1e-6)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {i for i, t in texts.items() if not regex.search(r"\p{L}", t or "")}


def test_held_out_texts_and_labels_that_are_not_read(spark):
    rng = random.Random(3)
    rows = [(i, speech(rng, (lang := rng.choice(list(SYLLABLES))), rng.randint(3, 40)), lang) for i in range(400)]
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    lied = [(i, t, "zz" if i in held else lang) for i, t, lang in rows] + [(None, "ba ko", "aa")] * 2
    found = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(lied, SCHEMA)).collect()}
    assert {i for i, r in found.items() if r.held_out and i is not None} == set(held)
    right = [found[i].lang_pred == lang for i, _, lang in rows if i in held]
    assert sum(right) / len(right) >= 0.97 and all(r.lang_pred != "zz" for r in found.values())
    assert all(0 <= r.score <= 1 for r in found.values())


def test_nothing_to_learn_from(spark):
    assert language_id.language_id(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "words", None), (2, None, "aa"), (3, "12", "bb")]
    found = language_id.language_id(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    one = language_id.language_id(spark.createDataFrame([(i, "ba", "aa") for i in range(20)], SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("aa", 1.0)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_held_out_accuracy_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.language_id(docs).filter("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id")
    right, all_ = found.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert right / all_ >= 0.97, (right, all_)
