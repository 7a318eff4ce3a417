from __future__ import annotations

import collections
import dataclasses
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, words
from tidemark.llm import html_crf, jaccard_join, kernels, lattice_lm, line_dedup, mixing, toxicity


# ------------------------------------------------------------------ mixing


def test_fit_is_as_near_as_any_choice():
    rng = random.Random(2)
    for _ in range(200):
        lengths = {rng.randint(0, 30): rng.randint(0, 3) for _ in range(rng.randint(1, 5))}
        total = sum(n * c for n, c in lengths.items())
        budget = rng.randint(0, total + 5)
        found = mixing.fit_counts(lengths, budget)
        assert all(0 <= found.get(n, 0) <= c for n, c in lengths.items())
        sums = [sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*[range(c + 1) for c in lengths.values()])]
        assert abs(sum(n * c for n, c in found.items()) - budget) == min(abs(s - budget) for s in sums)


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(4)
    sources = [rng.choice(["b", "a", "ü", None, "Z"]) for _ in range(300)]
    texts = [None if i == 7 else "" if i == 8 else words(rng, rng.randint(1, 30)) for i in range(300)]
    docs = documents(spark, texts, sources).withColumn("size", F.lit("clash"))
    docs = docs.unionByName(docs.filter("doc_id = 3"))
    runs = [sorted(map(str, mixing.mix_documents(d).select("doc_id", "_size", "_source_size", "_target", "_copies").collect())) for d in (docs, docs.repartition(5))]
    assert runs[0] == runs[1]
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == 301
    sizes = collections.Counter()
    for r in rows:
        assert r["_size"] == len((texts[r.doc_id] or "").split())
        sizes[r.source] += r["_size"]
    wanted = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert {r["_source_size"] for r in own} == {sizes[s]}
        assert own[0]["_target"] == pytest.approx(wanted[s])
        assert abs(sum(r["_size"] * r["_copies"] for r in own) - wanted[s]) <= 1
        assert all(0 <= r["_copies"] <= 2 for r in own)
    assert mixing.mix_documents(docs.limit(0)).collect() == []


def test_mixing_ranks_common_lengths_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = documents(spark, ["one two"] * 200 + ["three"] * 11, ["a"] * 200 + ["b"] * 11)
    rows = mixing.mix_documents(docs).collect()
    for s in ("a", "b"):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r["_size"] * r["_copies"] for r in own) - own[0]["_target"]) <= 2


# ------------------------------------------------------------------ toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    plain = [words(rng, 3, "bdgl") for _ in range(40)]
    texts, toxic = [], []
    for _ in range(900):
        body = " ".join(rng.choice(plain) for _ in range(20)).split()
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), "vex" + rng.choice(["ator", "ing", "ed", "ous", "les", "ify"]))
        texts.append(" ".join(body))
        toxic.append(int(bad))
    docs = documents(spark, [*texts, None, "", "same", "same"])
    labels = spark.createDataFrame([*((i, 1, t) for i, t in enumerate(toxic)), (0, 1, None), (5, 1, toxic[5])], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(rows) == 904 and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].held_out == (i in set(held)) for i in range(900))
    right = [rows[i].predicted == toxic[i] for i in held]
    assert sum(right) / len(right) > 0.97
    assert rows[900].score == rows[901].score and rows[902].score == rows[903].score
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in rows.values())
    none = toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


SEEN = {w: (0, 20) for w in ("moronel", "moronos", "moronia")} | {w: (40, 40) for w in ("table", "stone", "morning", "river", "tables")}


def test_unseen_inflections_follow_their_stem():
    known, unseen, ordinary = toxicity.Scorer.of(toxicity.Model(SEEN)).ratios(["moronel", "moronax", "stones"])
    assert known > 1 and unseen > 1 > abs(ordinary)


def test_classes_are_distributions_and_back_off_alike():
    """Plain interpolated Kneser-Ney, from its definition."""
    model = toxicity.Model(SEEN)
    spelt = [(toxicity._spell(w), n) for w, n in SEEN.items()]
    letters = sorted({c for w, _ in spelt for c in w})
    order = toxicity.ORDER

    def discount(counts):
        ones, twos = (sum(c == k for c in counts) for k in (1, 2))
        return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def lower(h, x):
        seen = collections.defaultdict(set)  # grams of one length -> what precedes them
        for w, _ in spelt:
            for i in range(1, len(w)):
                for s in range(max(0, i - order + 1) + 1, i + 1):
                    if i - s == len(h):
                        seen[w[s : i + 1]].add(w[s - 1])
        d = discount([len(v) for v in seen.values()])
        rest = lower(h[1:], x) if h else 1 / (len(letters) + 1)
        after = {g: len(v) for g, v in seen.items() if g[:-1] == h}
        if not after:
            return rest
        total = sum(after.values())
        return max(after.get(h + x, 0) - d, 0) / total + d * len(after) / total * rest

    def grams(c):
        made = collections.Counter()
        for w, n in spelt:
            for i in range(1, len(w)):
                made[w[max(0, i - order + 1) : i + 1]] += n[c] if c < 2 else sum(n)
        return made

    pooled = grams(2)

    def shared(h, x):
        after = {g: n for g, n in pooled.items() if g[:-1] == h}
        total = sum(after.values())
        d = discount(pooled.values())
        return max(after.get(h + x, 0) - d, 0) / total + d * len(after) / total * lower(h[1:], x)

    for h in ("\x02", "\x02m", "\x02moro", "moron", "table", "stone"):
        for c in (0, 1):
            after = {g: n for g, n in grams(c).items() if g[:-1] == h and n}
            total = sum(after.values())
            for x in letters:
                kept = max(after.get(h + x, 0) - toxicity.RARE, 0) / total if total else 0
                free = sum(min(n, toxicity.RARE) for n in after.values()) / total if total else 1
                assert model.probability(h + x, c) == pytest.approx(kept + free * shared(h, x))
            assert sum(model.probability(h + x, c) for x in letters) <= 1 + 1e-9


# ------------------------------------------------------------------ pages


def test_field_on_held_out_layouts():
    field = html_crf.trained_field()
    right = sum(html_crf.main_text(page, field) == " ".join(kept) for page, kept in html_crf.training_pages(150, seed=77))
    assert right >= 140


def test_training_raises_the_likelihood_and_decoding_finds_the_best_path():
    pages = [html_crf.labelled(*p) for p in html_crf.training_pages(3, seed=1)]
    field = html_crf.train(pages, epochs=30)
    blank = html_crf.Field()
    for features, gold in pages:
        n = min(len(gold), 8)
        every = [path_score(field, features[:n], ys) for ys in itertools.product((0, 1), repeat=n)]
        wanted = path_score(field, features[:n], gold[:n]) - np.logaddexp.reduce(every)
        assert html_crf.log_likelihood(field, features[:n], gold[:n]) == pytest.approx(wanted)
        assert html_crf.log_likelihood(field, features, gold) > html_crf.log_likelihood(blank, features, gold) / 4
        best = max(itertools.product((0, 1), repeat=min(len(gold), 8)), key=lambda ys: path_score(field, features[:8], ys))
        assert field.decode(features[:8]) == list(best)


def path_score(field, features, labels):
    total, before = 0.0, 2
    for (a, b), y in zip(field.scores(features), labels):
        total += field.transition[before, y] + (b if y else a)
        before = y
    return total


def test_extract(spark):
    page = (
        "<html><head><title>t</title><script>'</p>'</script></head><body><nav><ul><li><a href=x>Home<li><a>News</a></ul></nav><!-- <p>no</p> -->"
        '<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>One <b>two\n\n three<br><p>Caf&eacute; &lt;x&gt; &amp;amp; end.'
        '<div class="ad">Buy now, it is cheap.</div><p>Last one.</article><section class="comments"><p>I disagree with it.</p></section><footer>&copy; me</footer></body></html>'
    )
    long = "<article>" + "<p>Word and more.</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<<<>&#"), (5, "x", long), (5, "x", long)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in html_crf.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    assert rows[1].text == "A & B One two three Café <x> &amp; end. Last one."
    assert rows[2].text == rows[3].text == "" and rows[2].n_chars == 0
    assert rows[5].text == " ".join(["Word and more."] * 20_000) and rows[5].n_chars == len(rows[5].text)
    assert html_crf.extract(pages.limit(0)).collect() == []


def test_open_heads_end_where_the_body_begins():
    body = "<article><h1>A title</h1><p>One two three.</p></article>"
    whole = f"<html><head><meta charset=x><title>t</title></head><body>{body}</body></html>"
    blocks = [b.text for b in html_crf.leaf_blocks(whole)]
    assert blocks == ["A title", "One two three."]
    for page in (whole.replace("</head>", ""), whole.replace("</head><body>", ""), f"<head><style>p {{}}</style><script>x</script>{body}", f"<head><template><p>no</p></template>{body}"):
        assert [b.text for b in html_crf.leaf_blocks(page)] == blocks
    assert html_crf.main_text(whole.replace("</head>", ""), html_crf.trained_field()) == html_crf.main_text(whole, html_crf.trained_field()) != ""
    assert [b.text for b in html_crf.leaf_blocks("<head><title>t</title>Plain <p>words")] == ["Plain", "words"]


def test_tags_follow_htmls_rules():
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<p title=it's>One two<p>Three four") == ["One two", "Three four"]
    assert texts("<p title='a>b' class=\"x>y\">One</p>a < b <3 <!-->c<!-- > -->d<!x>e</ z>f") == ["One", "a < b <3 cdef"]
    assert texts("<svg><path d=1><p>One<p>Two") == ["One", "Two"]
    assert texts("<svg><text>no</text></svg><p>One") == ["One"]
    assert texts("<p a=b/>One<p a = 'x' b>Two<p ==x>Three<p") == ["One", "Two", "Three"]
    assert texts("<script>'<p>'</script>x<title>y</title >z") == ["xz"] or texts("<script>'<p>'</script>x") == ["x"]
    assert html_crf.leaf_blocks('<p id=a class="Big-Note">x')[0].path == (("p", frozenset({"a", "big", "note"})),)


# ------------------------------------------------------------------ lattice language model


def pieces_path():
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def plain_lattice(word, weights, pieces):
    """Sum over every segmentation, by listing them."""
    word = lattice_lm.START + word
    numbers = {int(k): int(n) for k, n in zip(pieces.keys, pieces.numbers)}

    def arc(i, j):
        n = numbers.get(lattice_lm.Pieces._hash(word[i:j]))
        if n is not None:
            return math.exp(weights[n])
        return math.exp(weights[lattice_lm.UNSEEN]) * 256.0 ** -len(word[i].encode()) if j == i + 1 else 0.0

    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        total += math.prod(arc(a, b) for a, b in zip(ends, ends[1:]))
    return math.log(total)


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.pieces_of(pieces_path())
    lattice = lattice_lm.Lattice(pieces, pieces.first[:, None])
    for group in (["the", "xyz", "日é\U0001f600"], ["morning", "zzqqzzx"], ["a"]):
        found = lattice.log_probability(group)[:, 0]
        assert found == pytest.approx([plain_lattice(w, pieces.first, pieces) for w in group], rel=1e-5)
    expected = lattice.expected(["the"])
    share = sum(expected[:-1])
    assert 1 <= share <= 4


def test_lattice_scores(spark):
    rng = random.Random(8)
    stock = words(rng, 200).split()
    texts = [" ".join(rng.choice(stock) for _ in range(60)) for _ in range(200)] + [None, "", "New NEW\tüber x", "rep rep", "rep rep", "y" * 5000]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in lattice_lm.score(docs, pieces_path()).collect()}
    counts, tokens = collections.Counter(), {}
    for i, text in enumerate(texts):
        tokens[i] = [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and math.isfinite(r.score) and r.score < 0
    assert lattice_lm.score(docs.limit(0), pieces_path()).collect() == []


def test_scores_against_listing_every_segmentation(spark, monkeypatch):
    """Whole texts: the marginal over kinds and over all segmentations of all words, from the definition."""
    monkeypatch.setattr(lattice_lm, "KINDS", 2)
    monkeypatch.setattr(lattice_lm, "TIER", 12)
    rng = random.Random(18)
    stocks = [["the", "moon", "a", "rain", "or", "sea"], ["xu", "zyz", "wov", "kkj", "x", "jq"]]
    texts = [" ".join(rng.choice(stocks[i % 2]) + rng.choice(["", "", "s"]) for _ in range(rng.randint(0, 12))) for i in range(60)] + ["moon xu unseen unseen", None]
    docs = documents(spark, texts)
    rows = {r.doc_id: r.score for r in lattice_lm.score(docs, pieces_path()).collect()}
    theta, share = lattice_lm.find_kinds(docs, kinds=2)
    counted = lattice_lm.count_words(docs, theta, share)
    weights = lattice_lm.fit_pieces(counted, pieces_path(), len(share))
    pieces = lattice_lm.pieces_of(pieces_path())
    counts = [{bytes(r["word"]).decode(): r[1 + k] for r in counted.collect()} for k in range(len(share))]
    ends = [c.get("", 0) for c in counts]
    for i, text in enumerate(texts):
        by_kind = []
        for k, own in enumerate(counts):
            tokens, types = sum(own.values()), sum(n > 0 for w, n in own.items() if w)
            log = math.log(max(ends[k], 0.5) / sum(ends))
            drawn = collections.Counter()
            for t, word in enumerate((text or "").split()):
                whole = max(own.get(word, 0) - lattice_lm.DISCOUNT, 0) / tokens
                p = whole + lattice_lm.DISCOUNT * types / tokens * math.exp(plain_lattice(word, weights[:, k], pieces))
                log += math.log((lattice_lm.URN * p + drawn[word]) / (lattice_lm.URN + t))
                drawn[word] += 1
            end = max(ends[k] - lattice_lm.DISCOUNT, 1e-3) / tokens
            by_kind.append(log + math.log(lattice_lm.URN * end / (lattice_lm.URN + sum(drawn.values()))))
        assert rows[i] == pytest.approx(np.logaddexp.reduce(by_kind) / math.log(10), rel=1e-4)


def test_word_weights_sum_to_at_most_one():
    pieces = lattice_lm.pieces_of(pieces_path())
    names = ["ab", "cd", "the"]
    counts = np.array([[5.0], [3.0], [1.0]])
    model = lattice_lm.Model(pieces_path(), pieces.first[:, None], np.array([10.0]), np.array([3.0]), np.array([1.0]))
    letters = "abcdefghijklmnopqrstuvwxyz"
    every = ["".join(p) for n in (1, 2) for p in itertools.product(letters, repeat=n) if "".join(p) not in names]
    total = np.exp(model.words(names, counts)).sum() + np.exp(model.words(every, np.zeros((len(every), 1)))).sum() + np.exp(model.end()).sum()
    assert 0.5 < total <= 1.0 + 1e-9


def test_kinds_are_fitted_to_all_training_documents(spark):
    rng = random.Random(9)
    rare = {i for i in range(600) if i % 10 == 0}
    docs = documents(spark, [words(rng, 60, "xzvw" if i in rare else "bdgl") for i in range(600)])
    train = [i for i in range(600) if zlib.crc32(str(i).encode()) % 7 != 2]
    first = min(docs.select(F.xxhash64(F.lit(lattice_lm.SEED), "doc_id"), "doc_id").collect(), key=lambda r: r[0] if r[1] in set(train) else 1 << 63)[1]
    repeated = docs.filter(F.col("doc_id") == first).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("n")
    for table, more in ((docs, 0), (docs.unionByName(repeated), 40)):
        _, share = lattice_lm.find_kinds(table, sample=40, kinds=2)
        n = sum(i in rare for i in train) + (more if first in rare else 0)
        assert min(np.exp(share)) == pytest.approx((n + 1) / (len(train) + more + 2), rel=1e-3)


# ------------------------------------------------------------------ line dedup


def test_line_dedup(spark):
    rng = random.Random(10)
    passage = ". ".join(words(rng, 12).capitalize() for _ in range(5)) + "."
    own = [". ".join(words(rng, 9).capitalize() for _ in range(4)) + "." for _ in range(6)]
    short = "Licensed under the same old terms."
    texts = [own[0] + "\n" + passage + "\n" + own[1], own[2] + " " + passage.upper() + " " + own[3], own[4] + "\n" + short, own[5] + "\n" + short, None, "", "x" * 300_000, passage]
    docs = documents(spark, texts)
    found = line_dedup.repeated_passages(docs, 30).collect()
    assert {(r.doc_id, tuple(r.kept_doc_ids)) for r in found} == {(1, (0,)), (7, (0,))}
    for r in found:
        assert texts[r.doc_id][r.start : r.end].lower() == passage.lower()
    extra = docs.withColumns({"start": F.lit(1), "end": F.lit(2)})
    cut = {r.doc_id: r for r in line_dedup.remove_repeats(extra.unionByName(extra.filter("doc_id = 2")), 30).collect()}
    assert cut[0].text == texts[0] and cut[2].text == texts[2] and cut[4].text is None and cut[6].text == texts[6]
    assert cut[1].text.split() == (own[2] + " " + own[3]).split() and cut[7].text == ""
    assert [(s["start"], s["end"]) for s in cut[7]["_removed"]] == [(0, len(passage))]
    assert line_dedup.repeated_passages(docs.limit(0), 30).collect() == []


def test_line_dedup_keeps_first_of_a_document_s_own_repeats(spark):
    rng = random.Random(12)
    passage = words(rng, 40).capitalize() + "."
    found = line_dedup.repeated_passages(documents(spark, [f"{passage}\n{passage}\nshort one here."]), 30).collect()
    assert [(r.doc_id, r.start, r.end, r.kept_doc_ids) for r in found] == [(0, len(passage) + 1, 2 * len(passage) + 1, [0])]


def test_line_dedup_finds_lists_of_short_units(spark):
    rng = random.Random(13)
    listed = " ".join(f"{w.upper()}!!" for w in words(rng, 90).split())
    texts = [listed, words(rng, 9) + ".\nOne! two! " + listed, listed]
    found = {r.doc_id: r for r in line_dedup.repeated_passages(documents(spark, texts), 30).collect()}
    assert found.keys() == {1, 2}
    assert texts[2][found[2].start : found[2].end] == listed
    assert texts[1][found[1].start : found[1].end].count("!!") > 60


def test_line_dedup_keeps_what_occurs_once(spark):
    rng = random.Random(14)
    first, second = (words(rng, 40).capitalize() + "." for _ in range(2))
    once = "\n".join(words(rng, 1) for _ in range(30))
    docs = documents(spark, [f"{first}\n{second}", f"{first}\n{once}\n{second}"])
    cut = {r.doc_id: r.text for r in line_dedup.remove_repeats(docs, 30).collect()}
    assert cut[1].split() == once.split()


def test_line_dedup_carries_runs_into_sentences(spark):
    rng = random.Random(15)
    head, tail = words(rng, 20), words(rng, 20)
    passage = f"{head}. {words(rng, 14).capitalize()}. {tail}"
    own = [words(rng, 8) for _ in range(4)]
    texts = [f"{own[0]} {passage} {own[1]}.", f"{own[2]} {passage} {own[3]}."]
    found = line_dedup.repeated_passages(documents(spark, texts), 30).collect()
    assert [(r.doc_id, r.n_words, r.kept_doc_ids, texts[1][r.start : r.end]) for r in found] == [(1, 54, [0], passage)]
    cut = {r.doc_id: r.text for r in line_dedup.remove_repeats(documents(spark, texts), 30).collect()}
    assert cut[1].split() == f"{own[2]} {own[3]}.".split()


# ------------------------------------------------------------------ jaccard join


def plain_components(texts, like):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        k = like.words
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and like.per_union * len(a & b) >= like.per_inter * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, n, size, edits):
    base = words(rng, size).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = words(rng, 1)
        out.append(" ".join(own))
    return out


def join_texts():
    rng = random.Random(21)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(60)]
    for size, edits in ((30, 2), (80, 6), (200, 8), (12, 1)):
        texts += near_copies(rng, 25, size, edits)
    texts += ["one two", "ONE two", "one two", "", None, "  \t ", "a b c", "A B\x0bC", texts[0], texts[0], words(rng, 6000)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("like", [jaccard_join.Likeness(), jaccard_join.Likeness(words=5, per_inter=80, spread=1.95, spare=0.2), jaccard_join.Likeness(cells=2)])
def test_jaccard_join_finds_every_link(spark, like):
    texts = join_texts()
    rows = jaccard_join.components(documents(spark, texts), like).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts, like)


def test_jaccard_join_splits_large_clusters_exactly(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CLUSTER_NODES", 8)
    monkeypatch.setattr(jaccard_join, "BROADCAST_NODES", 3)
    texts, like = join_texts(), jaccard_join.Likeness()
    rows = jaccard_join.components(documents(spark, texts), like).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_components(texts, like)


def sets(*each):
    return jaccard_join.Sets(np.concatenate(each), np.cumsum([0, *map(len, each)]))


def plain_labels(each, like):
    label = list(range(len(each)))
    for i, j in itertools.combinations(range(len(each)), 2):
        both = len(np.intersect1d(each[i], each[j]))
        if like.linked(len(each[i]), len(each[j]), both) and label[i] != label[j]:
            old, name = max(label[i], label[j]), min(label[i], label[j])
            label = [name if x == old else x for x in label]
    return label


def test_a_cluster_keeps_links_into_the_component_of_a_blocks_first_set():
    # Set 65 is linked with set 200 alone, which is in one component with set 64, the first of its block.
    of = lambda low, high: np.sort(jaccard_join.mix(np.arange(low, high, dtype=np.uint64)) >> np.uint64(16))
    each = [of(10_000 * n, 10_000 * n + 100) for n in range(1, 202)]
    each[0], each[64], each[200], each[65] = of(0, 100), of(0, 99), of(5, 105), of(10, 110)
    found = jaccard_join.cluster_links(sets(*each), jaccard_join.Likeness())
    assert found[[0, 64, 65, 200]].tolist() == [0, 0, 0, 0] and len(np.unique(found)) == 198


def test_a_clusters_components_are_those_of_all_pairs():
    rng, like = np.random.default_rng(8), jaccard_join.Likeness()
    for _ in range(5):
        at = rng.integers(0, 700, 220)
        each = [np.sort(jaccard_join.mix(np.arange(n, n + 100, dtype=np.uint64)) >> np.uint64(16)) for n in at]
        assert jaccard_join.cluster_links(sets(*each), like).tolist() == plain_labels(each, like)


@pytest.mark.parametrize("cells", [2, 3, 4])
@pytest.mark.parametrize("like", [jaccard_join.Likeness(), jaccard_join.Likeness(per_inter=80, spread=1.95, spare=0.2)])
def test_similar_sets_share_a_signature(like, cells):
    like = dataclasses.replace(like, cells=cells)
    rng = np.random.default_rng(1)
    for n in (5, 9, 10, 11, 19, 20, 40, 150, 700):
        for _ in range(20):
            a = np.unique(jaccard_join.mix(rng.integers(0, 1 << 62, n).astype(np.uint64)) >> np.uint64(16))
            drop = rng.integers(0, len(a) // 5 + 1)
            b = np.sort(rng.permutation(a)[drop:])
            if like.linked(len(a), len(b), len(b)) and len(a) != len(b):
                found, owner = jaccard_join.signatures(sets(a, b), like)
                assert set(found[owner == 0]) & set(found[owner == 1]), (n, drop)


def test_sets_of_a_batch_are_those_of_its_texts():
    rng = random.Random(3)
    texts = [t.encode() for t in [words(rng, n) for n in (0, 1, 2, 3, 4, 50, 3, 700)] + ["A b\x0bC", "a B c", "  x  ", "é É", "\x00 \x00"]]
    for size in (1, 3, 5):
        batch = jaccard_join.shingle_sets(*[kernels.words_of(*chunk[1:]) for chunk in kernels.chunks(pa.array(texts))], size)
        nodes = batch.nodes()
        for i, text in enumerate(texts):
            own = jaccard_join.shingles(text, size)
            w = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
            assert len(own) == len({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} or {tuple(w)} if w else set())
            assert (batch.take(np.array([i])).features == own).all() and nodes[i] == sets(own).nodes()[0]
    assert nodes[8] == nodes[9]


def test_keep_one(spark):
    texts = join_texts()
    like = jaccard_join.Likeness()
    docs = documents(spark, texts).withColumns({"node": F.lit("clash"), "component_id": F.lit("clash")})
    docs = docs.unionByName(docs.filter("doc_id < 5"))
    kept = jaccard_join.keep_one(docs, like).collect()
    told = plain_components(texts, like)
    empty = [i for i, (n, _) in told.items() if not n]
    wanted = sorted([i for i, (n, c) in told.items() if n and c == i] + empty * 1 + [i for i in empty if i < 5])
    assert sorted(r.doc_id for r in kept) == wanted
    assert jaccard_join.components(docs.limit(0), like).collect() == []


def plain_units(text):
    """Units by their definition: lines cut at sentence ends, runs of short ones joined."""
    sentences, at = [], 0
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    current = []
    for i, w in enumerate(words):
        current.append(w)
        gap = text[w.end() : words[i + 1].start()] if i + 1 < len(words) else "\n"
        if w[0][-1] in ".!?" or "\n" in gap:
            sentences.append(current)
            current = []
    return [(s[0].start(), s[-1].end(), len(s)) for s in sentences]


def test_units_are_lines_cut_at_sentence_ends():
    rng = random.Random(16)
    texts = ["", "One two three. Four five six\nseven eight nine! »Ten« eleven …twelve", "é. " * 3, "a\n\n\nb c d e", " x ", "no end here at all"]
    texts += [". ".join(words(rng, rng.randint(3, 9)) for _ in range(20)) for _ in range(5)]
    column = pa.array([t.encode() for t in texts])
    ((_, data, offsets),) = kernels.chunks(column)
    units = line_dedup.units_of(data, offsets)
    for row, text in enumerate(texts):
        own = np.flatnonzero(units.row == row)
        found = [(int(units.word_starts[units.first[u]]), int(units.word_ends[units.last[u]]), int(units.words[u])) for u in own]
        sentences = plain_units(text)
        assert sum(n for *_, n in found) == sum(n for *_, n in sentences)
        if all(n >= line_dedup.UNIT_WORDS for *_, n in sentences):
            assert found == sentences
        assert units.no[own].tolist() == list(range(len(own)))
    same = [line_dedup.units_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).digest for t in ("One, two THREE.", "(one two  «three»", "one two tree")]
    assert same[0] == same[1] != same[2]


def test_long_runs_of_signs_take_linear_time(spark):
    began = time.perf_counter()
    texts = ["!" * 400_000, "? " * 200_000, "a." * 200_000]
    assert line_dedup.repeated_passages(documents(spark, texts), line_dedup.PASSAGE_WORDS).count() >= 0
    html_crf.leaf_blocks("<a '" * 200_000)
    html_crf.leaf_blocks("<a x='" * 200_000 + "<!-- " * 100_000)
    assert len(html_crf.leaf_blocks("<div>x" * 20_000)) == 20_000
    assert time.perf_counter() - began < 30


def test_a_script_ends_at_its_end_tag_whatever_its_slash():
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<p>one<script src=x />bad()</script><p>two") == texts("<p>one<script src=x>bad()</script><p>two") == ["one", "two"]
    assert texts("<p>one<svg><script src=x /><g>shape</g></svg><p>two") == ["one", "two"]


def test_words_to_fit_are_a_parameter(spark):
    texts = ["w " * n for n in range(1, 40)] * 3
    docs = documents(spark, texts, ["a", "b", "c"] * 39)
    for fit_words in (0, 5, 65_536):
        rows = mixing.mix_documents(docs, fit_words=fit_words).collect()
        by_source = {}
        for r in rows:
            taken, target = by_source.get(r.source, (0, r["_target"]))
            by_source[r.source] = taken + r["_copies"] * r["_size"], target
        assert all(abs(taken - target) <= (1 if fit_words > 40 else 40) for taken, target in by_source.values())


def test_every_repeat_goes_by_default_and_the_rest_stays(spark):
    rng = random.Random(17)
    once, twice = (words(rng, 6).capitalize() + "." for _ in range(2))
    texts = [f"{once}\n\n\n{twice}", f"  A first one here. {twice}\n\n\n Another paragraph is here.\n\n", None, f"{twice}"]
    docs = documents(spark, texts).withColumns({"_key": F.lit("mine"), "_doc": F.lit("too"), "_removed": F.lit("three")})
    cut = {r.doc_id: r for r in line_dedup.remove_repeats(docs, removed="gone").collect()}
    assert cut[0].text == texts[0] and cut[2].text is None and cut[3].text == ""
    assert cut[1].text == texts[1].replace(f" {twice}", "")
    assert {(r["_key"], r["_doc"], r["_removed"]) for r in cut.values()} == {("mine", "too", "three")}
    assert [texts[i][s["start"] : s["end"]] for i in (1, 3) for s in cut[i].gone] == [twice, twice]
    lost = documents(spark, [twice, twice]).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.col("doc_id")))
    assert [(r.doc_id, r.kept_doc_ids) for r in line_dedup.repeated_passages(lost).collect()] == [(None, [1])]


def test_repeats_against_a_plain_pass(spark):
    """Every unit but the earliest of its digest, over random lines."""
    rng = random.Random(19)
    stock = [words(rng, rng.randint(3, 6)) for _ in range(40)]
    texts = ["\n".join(rng.choice(stock) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    seen, kept = set(), {}
    for i, text in enumerate(texts):
        kept[i] = [line for line in text.split("\n") if not (line in seen or seen.add(line))]
    cut = {r.doc_id: r.text for r in line_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert {i: [line for line in t.split("\n") if line] for i, t in cut.items()} == kept


def test_wide_sketches_rule_out_long_sets_and_no_link():
    rng = np.random.default_rng(11)
    like = jaccard_join.Likeness(words=5, per_inter=80, per_union=100, cells=2, spread=1.95, spare=0.2)
    sets = []
    for size in (1, 5, 1900, 2047, 2048, 2100, 6000, 8192, 9000):
        base = rng.integers(0, 1 << 48, size, dtype=np.uint64)
        for share in (0.0, 0.1, 0.14, 0.5, 1.0):  # of the features made anew
            one = base.copy()
            one[: int(size * share)] = rng.integers(0, 1 << 48, int(size * share), dtype=np.uint64)
            sets.append(np.unique(one[: rng.integers(int(size * 0.95), size) + 1]))
    whole = jaccard_join.Sets(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    rows = np.arange(len(sets))
    near = jaccard_join.WideSketches(whole.wide_sketches(), whole.sizes).near(rows, rows, like)
    linked = np.array([[like.linked(len(a), len(b), len(np.intersect1d(a, b))) for b in sets] for a in sets])
    assert linked.sum() > len(sets) + 20 and not (linked & ~near).any()
    long = whole.sizes > 1000
    far = np.array([[len(np.intersect1d(a, b)) == 0 for b in sets] for a in sets]) & long & long[:, None]
    short = jaccard_join.Sketches(whole.sketches(), whole.sizes).near(rows, rows, like)
    assert (far & short).any() and not (far & near).any()


def test_whole_sets_of_long_texts_that_met_by_chance_are_not_moved(spark, monkeypatch):
    rng = np.random.default_rng(12)
    like = jaccard_join.Likeness(words=1, per_inter=80, per_union=100, cells=2, spread=1.95, spare=0.2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 7000)) for _ in range(3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([texts[0], texts[1], texts[2], texts[0] + " one more"])], "doc_id long, text string")
    rows = jaccard_join._signature_rows
    # All sets meet in one signature, as chance may have it.
    monkeypatch.setattr(jaccard_join, "_signature_rows", lambda t, k: rows(t, k).withColumn("sig", F.lit(1).cast("long")).distinct())
    moved, with_hubs = [], jaccard_join._with_hubs

    def counted(*given):
        made = with_hubs(*given)
        moved.append(made.select("node").distinct().count())
        return made

    monkeypatch.setattr(jaccard_join, "_with_hubs", counted)
    with jaccard_join.scratch(spark):
        found = {r.doc_id: r.component_id for r in jaccard_join.components(docs, like).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 0}
    assert moved == [4, 2]  # by short sketches, by wide ones
