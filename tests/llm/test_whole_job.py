"""Cases that a bound or a prefilter once left out."""

import hashlib
import random
import zlib
from collections import defaultdict
from re import _parser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import language_id as L
from quern.llm import license_rules as R
from quern.llm import secret_crf as S
from quern.llm.fracminhash import fingerprints
from quern.llm.mixing import mix
from quern.llm.ngram_join import one_of_each_group


def _sentences(r, letters, n):
    """Sentences of a language that has words of its own."""
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 4))) for _ in range(30)]
    return [" ".join(r.choice(words) for _ in range(20)) for _ in range(n)]


def test_every_label_is_learned_and_every_letter_is_its_own(spark):
    # 70 labels, the last of them rarest, over the same 600 letters
    r = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(600)]
    rows = [(1000 * k + i, text, f"l{k:02}") for k in range(70) for i, text in enumerate(_sentences(r, letters, 14 if k < 66 else 9))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert set(L.learn(docs)) == {f"l{k:02}" for k in range(70)}
    got = {x["doc_id"]: x for x in L.identify(docs).collect()}
    out = [(i, lang) for i, _, lang in rows if got[i]["held_out"]]
    assert {lang for _, lang in out} > {"l66", "l69"}
    assert [got[i]["lang_pred"] for i, _ in out] == [lang for _, lang in out]


def test_a_label_whose_rows_the_sample_misses_is_learned(spark):
    # one text over and over: the hash takes all of its rows or none
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.translate((F.col("id") % 20).cast("string"), "0123456789", "abcdefghij")).alias("text"), (F.col("id") % 20).cast("string").alias("lang"))
    assert set(L.learn(docs)) == {str(k) for k in range(20)}


def test_copies_do_not_starve_the_sample(spark):
    # 4,000 rows, 2 % of them distinct: the sample holds pieces of all distinct texts
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(150)) + f" {chr(97 + i // 26)}{chr(97 + i % 26)}z" for i in range(80)]
    docs = spark.createDataFrame([(3 * i, texts[i % 80 if i < 400 else 0], "x") for i in range(4000)], "doc_id bigint, text string, lang string")
    learned = L.learn(docs)["x"]
    known = {x for i, x in enumerate(texts) if any(zlib.crc32(str(3 * j).encode()) % 3 != 1 for j in range(i, 400, 80))}
    assert len(known) > 75 and all(x in learned for x in known)


def test_the_sample_is_bounded_and_not_of_beginnings(spark):
    text = " ".join(f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd")
    learned = L.learn(spark.createDataFrame([(0, text * 40, "x")], "doc_id bigint, text string, lang string"))["x"]
    assert len(learned) <= L.SAMPLE_PIECES * (L.PIECE + 1) and sum(w in learned for w in text.split()) > 900
    late = "1 " * 50_000 + "letters at the end"
    assert "letters at" in L.learn(spark.createDataFrame([(0, late, "x")], "doc_id bigint, text string, lang string"))["x"]


@pytest.mark.parametrize("lane", [1, 7, 512])
def test_phrases_run_over_the_ends_of_lanes(monkeypatch, lane):
    from tests.llm.test_brute_force import _phrases

    monkeypatch.setattr(L, "LANE", lane)
    r = random.Random(8)
    samples = {"a": "".join(r.choice("ab ") for _ in range(400)), "b": "abc" * 100, "c": "".join(chr(0x4E00 + r.randrange(90)) for _ in range(500))}
    p = L.CrossParser(samples)
    texts = [samples["a"] * 5, "abc" * 700, "bca" * 300 + "x" + samples["a"], samples["c"][7:] * 3, "a", "".join(r.choice("abc q") for _ in range(3000))]
    for t, row in zip(texts, p.rates(texts)[0]):
        codes = p.classes[L.folded(t)]
        for g, name in enumerate(p.names):
            assert row[g] * len(codes) / p.weight[g] == pytest.approx(_phrases(codes, p.classes[L.folded(samples[name])]))


def test_texts_in_no_learned_language_go(spark):
    r = random.Random(10)
    words = ["the", "river", "and", "house", "many", "green", "under", "stone", "water", "walking"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    soup = "".join(r.choice("bcdfgjkpqxzvw") + r.choice("hjkqxyz") + " " * (r.random() < 0.2) for _ in range(300))
    rows = [(i, line(40), "en") for i in range(60)] + [(100, line(30), None), (101, "the house", None), (102, soup, None), (103, "Καλημέρα σε όλους τους ανθρώπους της πόλης και του χωριού", None), (104, "1234 5678", None), (105, "zzq", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in L.in_known_language(docs).where("doc_id >= 100").collect()} == {100, 101, 105}
    assert L.in_known_language(docs, languages=["de"]).count() == 0


def test_phrases_of_large_alphabets():
    from tests.llm.test_brute_force import _phrases

    r = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(300)] + [" "] * 20
    samples = {"a": "".join(r.choice(letters) for _ in range(2000)), "b": "".join(r.choice("abc ") for _ in range(300))}
    p = L.CrossParser(samples)
    assert [x.dense for x in p.automata] == [False, True]
    texts = [samples["a"][i : i + 40] + "xyz" + samples["b"][i : i + 9] for i in range(0, 250, 50)] + ["".join(r.choice([*letters, "q"]) for _ in range(400))]
    for t, row in zip(texts, p.rates(texts)[0]):
        codes = p.classes[L.folded(t)]
        for g, name in enumerate(p.names):
            assert row[g] == pytest.approx(_phrases(codes, p.classes[L.folded(samples[name])]) * p.weight[g] / len(codes))


def _match(r, parsed):
    """A string that a parsed regex matches."""
    out = ""
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "SUBPATTERN":
            out += _match(r, x[3])
        elif op == "BRANCH":
            out += _match(r, r.choice(x[1]))
        elif op == "MAX_REPEAT":
            out += "".join(_match(r, x[2]) for _ in range(r.randint(x[0], min(x[1], x[0] + 3))))
        elif op == "IN":
            kind, y = r.choice(x)
            out += chr(y if str(kind) == "LITERAL" else r.randint(*y))
        else:
            assert op == "ASSERT", op  # the space after a match
    return out


def test_no_license_rule_is_narrowed_by_a_prefilter():
    r = random.Random(7)
    for rule in R.rules():
        parsed = _parser.parse(rule.regex.pattern)
        for _ in range(40):
            norm = _match(r, parsed).encode("latin-1") + b" "
            assert rule.regex.match(norm), norm
            assert rule in R.candidates(norm), (rule, norm)


@pytest.mark.parametrize(("text", "label"), [
    ("This project is covered by Apache 2.0", "apache-2.0"), ("governed by MIT", "mit"), ("released by Mozilla Public 2.0", "mpl"), ("Unauthorized copying of this file is strictly prohibited.", "proprietary"),
    ("must not be used to train AI models", "no-ai"), ("see the file COPYING", "license-file"), ("provided under the Open Data Database", "odbl"),
])
def test_license_rules_without_other_hints(text, label):
    assert label in R.scan(text)["labels"].split(",")


def test_license_keywords_are_found_as_by_plain_search(data):
    import pyarrow.parquet as pq

    for text in [*pq.read_table(f"{data}/documents.parquet")["text"].to_pylist(), "Tous droits réservés", "This is licensed by and under the terms of no license"]:
        norm, _ = R.normalized(text or "")
        want = [r for r in R.rules() if r.keywords[0].encode() in norm and (len(r.keywords) == 1 or any(k.encode() in norm for k in r.keywords[1:]))]
        assert set(R.candidates(norm)) == set(want)


def test_suppression_as_by_all_pairs():
    r = random.Random(11)
    for _ in range(300):
        found = []
        for _ in range(r.randrange(14)):
            a = r.randrange(20)
            found.append((a, a + r.randint(1, 9), R.Rule(r.choice("abc"), ("k",), None, r.randrange(3), 0.5)))
        kept = []
        for x in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label)):
            if not any(c <= x[0] and x[1] <= d for c, d, _ in kept):
                kept.append(x)
        assert R.unsuppressed(found) == sorted(kept, key=lambda x: x[:2])


def test_license_scans_take_linear_time():
    import time

    took = {}
    for n in (4000, 8000):
        text = " ".join(["Licensed under the Apache License, Version 2.0. All rights reserved. Released under the MIT License."] * n)
        began = time.process_time()
        got = R.scan(text)
        took[n] = time.process_time() - began
        assert got["found"].count("apache-2.0") == got["found"].count("mit") == n
    assert took[8000] < 3 * took[4000] + 0.2


@pytest.mark.parametrize(("text", "labels"), [
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "apache-2.0,bsd-3-clause,mit"), ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2.0,gpl-classpath"), ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this", "mit"), ("either version 3 of the License, or (at your option) any later version.", "gpl-3.0-or-later"), ("Tous droits réservés", "reserved"), ("Neither the name of X nor its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("the endorsement of the terms by the house, and written permission", ""),
])
def test_sentences_of_license_texts(text, labels):
    assert R.scan(text)["labels"] == labels


def test_secrets_without_digits():
    field = S.trained()
    for text, secret in [("pwd: CorrectHorseBattery and more", "CorrectHorseBattery"), ("passphrase = correct-horse-battery-staple\n", "correct-horse-battery-staple"), ("header bearer QWxhZGRpbjpvcGVu now", "QWxhZGRpbjpvcGVu")]:
        assert [text[a:b] for a, b in field.spans(text)] == [secret]
    assert field.spans("the secret garden was open: nobody knew") == []
    r, hit, real = random.Random(123), 0, 0
    for _ in range(300):
        text, spans = S.generated_file(r)
        bare = {(a, b) for a, b in spans if not any(c in "0123456789_+/" for c in text[a:b])}
        hit, real = hit + len(bare & set(field.spans(text))), real + len(bare)
    assert real > 100 and hit / real > 0.85


def test_cues_are_found_in_linear_time():
    import time

    for text in ("=" * 200_000 + ".", "token" + " " * 200_000 + ".", "= " * 100_000 + ".", "key is " * 30_000 + ".", "-" * 200_000 + "A"):
        began = time.time()
        S.stretches(text)
        assert time.time() - began < 10


def test_only_the_text_that_lost_its_group_goes(spark):
    words = [f"w{i}" for i in range(60)]
    near, clean = " ".join(words), "another text of several words that stands in no group at all"
    rows = [(1, near, "a"), (5, near + " end", "b"), (5, clean, "c"), (5, clean, "c"), (5, None, "d"), (7, near + " end", "e"), (8, clean + " but long enough to be another one now and then", "f")]
    kept = one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted((r["doc_id"], r["source"]) for r in kept) == [(1, "a"), (5, "c"), (5, "d"), (8, "f")]


def test_the_words_before_a_stretch_are_the_last_ones():
    (_, _, before, after), = S.stretches("ab.cd," * 50 + "hash a1b2c3 " + "ef,gh." * 50)
    assert before == ["cd", ",", "hash"] and after == ["ef"]


def _mixed_one_by_one(rows, weights, budget, seed, epochs):
    """The mixture by plain loops: rows of (doc_id, text, lang, source, n); n tokens each."""
    leaves = defaultdict(list)
    for row in rows:
        leaves["d", row[2] or "(none)", row[3] or "(none)"].append(row)

    def deal(nodes, total):
        """Shares a budget among nodes (weight, capacity) until all is given or all are full."""
        given, left, active = [0.0] * len(nodes), float(total), {i for i, (w, c) in enumerate(nodes) if w}
        while left > 1e-9 and active:
            unit = left / sum(nodes[i][0] for i in active)
            full = {i for i in active if nodes[i][1] - given[i] <= unit * nodes[i][0] + 1e-12}
            for i in full or active:
                add = min(nodes[i][1] - given[i], unit * nodes[i][0])
                given[i] += add
                left -= add
            active = active - full if full else set()
        return given

    langs = sorted({k[1] for k in leaves})
    cap = {k: epochs * sum(r[4] for r in v) for k, v in leaves.items()}
    top = min(float(budget), float(sum(cap.values())))
    out = defaultdict(list)
    for lang, b in zip(langs, deal([(weights.get(x, 1), sum(c for k, c in cap.items() if k[1] == x)) for x in langs], top)):
        own = sorted(k for k in leaves if k[1] == lang)
        for k, x in zip(own, deal([(1, cap[k]) for k in own], b)):
            left, total = int(x + 1e-6), sum(r[4] for r in leaves[k])
            for epoch in range(epochs):
                for r in sorted(leaves[k], key=lambda r: hashlib.md5(f"{seed}:{epoch}:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest() if left < total else ""):
                    if left > 0:
                        out[r[0], r[1], epoch].append(min(r[4], left))
                        left -= r[4]
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("share", [10, 80, 199])
def test_mixture_of_nulls_ties_and_clashing_columns(spark, share):
    r = random.Random(share)
    rows = [(i if i % 4 else None, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 9))) if i % 9 else None, r.choice(["en", "de", None]), r.choice(["s1", "s2"])) for i in range(60)]
    rows += [(None, "the same text", "en", "s1")] * 25 + [(77, "one id and text", "de", "s2")] * 5  # copies, many without an id
    rows = [(*x, max(1, len((x[1] or "").split()))) for x in rows]
    docs = spark.createDataFrame([(*x, "old", 5, 6, "k") for x in rows], "doc_id bigint, text string, lang string, source string, n bigint, mix_domain string, mix_epoch int, mix_tokens int, `odd name.x` string").repartition(5)
    budget = share * sum(x[4] for x in rows) // 100
    for tokens in (None, F.col("n")):
        out = mix(docs, F.lit("d"), {"lang": {"en": 3}}, F.lit(budget), 9, 2, tokens)
        assert out.columns == ["doc_id", "text", "lang", "source", "n", "odd name.x", "mix_domain", "mix_epoch", "mix_tokens"]
        got = defaultdict(list)
        for x in out.collect():
            got[x["doc_id"], x["text"], x["mix_epoch"]].append(x["mix_tokens"])
        assert {k: sorted(v) for k, v in got.items()} == _mixed_one_by_one(rows, {"en": 3}, budget, 9, 2)


def _text_order(row):
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), seed=42)
    return row[0] is None, -(row[0] or 0), h - (h >> 63 << 64), row[1] or ""


@pytest.mark.parametrize("case", ["ties", "nulls", "copies", "distinct", "one"])
def test_next_rows_of_hot_keys(spark, case):
    r = random.Random(case)
    text = lambda: " ".join(f"w{r.randrange(50)}" for _ in range(r.randint(0, 30)))
    rows = [(r.randrange(-500, 500) if case != "distinct" else 7 * i, text()) for i in range(120 if case != "one" else 0)]
    rows += {"ties": [(17, text()) for _ in range(80)], "nulls": [(None, r.choice([None, text()])) for _ in range(90)], "copies": [(17, "all the same text here")] * 60 + [(None, "the same again")] * 50, "distinct": [], "one": [(3, "all the same text here")] * 40}[case]
    got = fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()
    ordered, want = sorted(rows, key=_text_order), []
    for a, b in zip(ordered, ordered[1:] + ordered[:1]):
        x, y = a[1] or "", b[1] or ""
        half = len(x) // 2
        want.append((str(a[0]), len(x), hashlib.sha256((x[: len(x) - half] + y[:half]).encode()).hexdigest()))
    assert sorted((str(x["doc_id"]), x["n_chars"], x["edited_sha256"]) for x in got) == sorted(want)


def test_places_among_many_cuts(spark):
    from quern.llm.fracminhash import not_above

    r = random.Random(2)
    for n in (0, 1, 2, 3, 10, 1000):
        cuts = sorted(r.sample(range(-10**6, 10**6), n))
        keys = [*cuts[:50], *(r.randrange(-10**6, 10**6) for _ in range(50)), -(1 << 63), (1 << 63) - 1]
        rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", not_above(cuts, F.col("k")).alias("n")).collect()
        assert [x["n"] for x in rows] == [sum(c <= x["k"] for c in cuts) for x in rows]


def _recall(found, x, ids):
    got = defaultdict(list)
    for r in found:
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        s[q] = -9
        hit += len(set(ids[np.lexsort((ids, -s))[:5]].tolist()) & {v for v, _ in got[ids[q]]})
        assert all(abs(s[np.flatnonzero(ids == v)[0]] - c) < 1e-9 for v, c in got[ids[q]])
    return hit / (5 * (ids % 50 == 0).sum())


def test_neighbours_in_large_clusters_of_near_equal_vectors(spark):
    from quern.llm.nn_descent import nearest

    r = np.random.default_rng(3)
    x = np.concatenate([c + 0.002 * r.normal(size=(400, 16)) for c in r.normal(size=(4, 16))])
    ids = np.arange(len(x)) * 5
    assert _recall(nearest(spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id bigint, embedding array<double>")).collect(), x, ids) >= 0.95


def test_vectors_are_measured_in_double_precision(spark):
    from quern.llm.nn_descent import nearest

    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 1e-9, 0.0]), (2, [1e300, 1e299, 0.0]), (3, [1e-300, 2e-300, 0.0]), (4, [3.0, 0.0, 1e-5]), (5, [5e-324, 0.0, 5e-324])]
    out = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("rank").collect()
    assert [x["vec_id"] for x in out] == [1, 4, 2, 5, 3]
    want = [1.0, 1 / np.sqrt(1 + 1e-10 / 9), 1 / np.sqrt(1.01), np.sqrt(0.5), 1 / np.sqrt(5)]
    assert all(abs(x["score"] - y) < 1e-14 for x, y in zip(out, want))
