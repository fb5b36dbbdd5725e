"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm.chat_preference import conversations_as_arrays, format_preferences, neighbour_pairs
from quern.llm.fracminhash import fingerprints
from quern.llm.language_id import identify, in_known_language
from quern.llm.license_rules import license_scan
from quern.llm.mixing import mix
from quern.llm.ngram_join import ngram_jaccard_join, one_of_each_group
from quern.llm.nn_descent import nearest
from quern.llm.packing import pack
from quern.llm.pii_semicrf import pii_scan, redact
from quern.llm.secret_crf import secret_scan

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, rank int, tokens string, domain string, words string"
LONG = " ".join(f"word{i % 977} of the line" for i in range(60_000))


def _row(i, text, lang="en", source="src1"):
    return (i, text, lang, source, 7, "x", 1, "y", "z", "w")


ROWS = [_row(1, None), _row(2, ""), _row(3, "one"), _row(3, "one"), _row(4, "the same five words here again", None), _row(5, "the same five words here again", "de", None), _row(None, "the same five words here again", None, None), _row(6, LONG), _row(7, " \t\n "), _row(8, "日本語 テキスト\U0001f600 password=abcdef1"), _row(None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _mix(d):
    return mix(d, F.lit("d"), {}, F.sum("tokens"), 1, 2)


ONE_EACH = {"secrets": secret_scan, "pii": pii_scan, "licenses": license_scan, "language": identify, "sketch": fingerprints, "join": ngram_jaccard_join, "redact": redact}


@pytest.mark.parametrize("name", ONE_EACH)
def test_a_row_for_each_row(name, docs, nothing):
    assert ONE_EACH[name](docs).count() == len(ROWS)
    assert ONE_EACH[name](nothing).count() == 0


def test_values_of_null_and_empty_texts(docs):
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    for scan in (secret_scan, pii_scan):
        assert {(r["base_sha256"], r["spans"]) for r in scan(docs).where("doc_id in (1, 2)").collect()} == {(empty, "")}
    assert {tuple(r) for r in license_scan(docs).where("doc_id in (1, 2)").select("n_words", "first_word", "labels", "score").collect()} == {(0, None, "", 0.0)}
    assert {r["lang_pred"] for r in identify(docs).where("doc_id in (1, 2, 7)").collect()} == {"und"}
    assert {tuple(r) for r in ngram_jaccard_join(docs).where("doc_id in (1, 2, 7)").select("n_shingles", "component_id").collect()} == {(0, 1), (0, 2), (0, 7)}


def test_join_groups_repeats_and_null_ids(docs):
    found = [tuple(r) for r in ngram_jaccard_join(docs).collect()]
    assert found.count((3, 1, 3)) == 2
    assert {c for i, n, c in found if n == 2} == {4}  # the null id's component is the smallest id
    kept = [r["doc_id"] for r in one_of_each_group(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 3, 4, 6, 7, 8] and kept.count(None) == 2


def test_packing_edges(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack(docs, path).collect()
    assert pack(nothing, path).count() == 0
    assert [r for r in rows if r["doc_id"] == 1][0]["doc_tokens"] == 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 2 * [r for r in rows if r["doc_id"] == 3][0]["doc_tokens"]
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 6)
    assert all(a + n == b for (a, n), (b, _) in zip(long, long[1:])) and len(long) > 100


def test_mixing_keeps_columns_and_takes_all_when_the_budget_is_all(docs, nothing):
    out = _mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.where("mix_epoch = 0").count() <= len(ROWS) and out.count() > 0
    assert _mix(nothing).count() == 0


def test_known_language_keeps_columns(docs, nothing, spark):
    more = spark.createDataFrame([_row(100 + i, f"the same line of english words number {i} and more of them") for i in range(60)], SCHEMA).unionByName(docs)
    out = in_known_language(more)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} >= {100, 159} and not {1, 2, 7} & {r["doc_id"] for r in out.collect()}
    assert in_known_language(nothing).count() == 0


def test_redaction_keeps_nulls(docs):
    assert [r["text"] for r in redact(docs).where("doc_id = 1").collect()] == [None]


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", "k"), (1, 1, "assistant", "b", "k"), (1, 1, "assistant", "b", "k"), (2, None, None, None, "k"), (None, 0, "user", "z", "k"), (None, 0, "assistant", "y", "k")], "conv_id bigint, turn bigint, role string, text string, reply string")
    rows = format_preferences(neighbour_pairs(turns)).collect()
    out = {r["pair_id"]: r for r in rows}
    # turns without an id are conversations of their own; the assistant's gets the first conversation's last reply
    assert sorted((r["prompt"], r["chosen"], r["rejected"]) for r in rows if r["pair_id"] is None) == [("", "<|im_start|>assistant\ny<|im_end|>\n", "<|im_start|>assistant\nb<|im_end|>\n"), ("<|im_start|>user\nz<|im_end|>\n", "", "")]
    assert neighbour_pairs(turns.limit(0)).count() == 0
    assert len(out) == 3 and out[2]["chosen"] == "" and out[2]["prompt_turns"] == 1
    assert conversations_as_arrays(turns.limit(0)).count() == 0
    pairs = spark.createDataFrame([(1, [("user", "a")], [("user", "a"), ("assistant", "b")]), (2, None, [("assistant", "b")])], "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: r for r in format_preferences(pairs).collect()}
    assert got[1]["prompt_turns"] == 1 and got[1]["chosen"] == "" and "b" in got[1]["rejected"]
    a, b = map(int, got[2]["rejected_mask"].split(":"))
    assert got[2]["rejected"][a:b] == "b<|im_end|>" and got[2]["prompt"] == ""


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (100, None)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit("n"))
    out = [tuple(r) for r in nearest(v).orderBy("query_id", "rank").collect()]
    assert [(q, r, i) for q, r, i, _ in out] == [(0, 1, 50), (0, 2, 7), (0, 3, 1), (50, 1, 0), (50, 2, 7), (50, 3, 1)]
    assert abs(out[0][3] - 1) < 1e-12 and out[2][3] == 0
    assert nearest(v.limit(0)).count() == 0
