"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.secret_crf import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.chat_preference import format_preferences, neighbour_pairs

    return format_preferences(neighbour_pairs(_table(spark, sf_dir, "conversations")))


_PREFERENCE_SQL = """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations),
l AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN pos END) AS last FROM t GROUP BY conv_id),
r AS (SELECT l.conv_id, l.last, t.text AS reply FROM l LEFT JOIN t ON t.conv_id = l.conv_id AND t.pos = l.last),
f AS (SELECT reply FROM r WHERE conv_id = (SELECT min(conv_id) FROM conversations)),
d AS (SELECT r.conv_id, r.last, CASE WHEN n.conv_id IS NOT NULL THEN n.reply ELSE (SELECT reply FROM f) END AS other FROM r LEFT JOIN r n ON n.conv_id = r.conv_id + 1),
p AS (SELECT t.conv_id, t.pos, t.role, t.text AS ctext, CASE WHEN t.pos = d.last AND d.other IS NOT NULL THEN d.other ELSE t.text END AS rtext FROM t JOIN d USING (conv_id)),
k AS (SELECT conv_id, coalesce(min(CASE WHEN ctext <> rtext THEN pos END) - 1, max(pos)) AS k FROM p GROUP BY conv_id),
s AS (SELECT p.*, k.k, '<|im_start|>' || role || chr(10) || ctext || '<|im_end|>' || chr(10) AS crow, '<|im_start|>' || role || chr(10) || rtext || '<|im_end|>' || chr(10) AS rrow FROM p JOIN k USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(crow)) FILTER (pos > k) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cat,
    coalesce(sum(length(rrow)) FILTER (pos > k) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rat FROM s)
SELECT conv_id AS pair_id, max(k)::BIGINT AS prompt_turns, coalesce(string_agg(crow, '' ORDER BY pos) FILTER (pos <= k), '') AS prompt,
    coalesce(string_agg(crow, '' ORDER BY pos) FILTER (pos > k), '') AS chosen, coalesce(string_agg(rrow, '' ORDER BY pos) FILTER (pos > k), '') AS rejected,
    coalesce(string_agg((cat + length(role) + 13) || ':' || (cat + length(role) + 13 + length(ctext) + 10), ',' ORDER BY pos) FILTER (pos > k AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((rat + length(role) + 13) || ':' || (rat + length(role) + 13 + length(rtext) + 10), ',' ORDER BY pos) FILTER (pos > k AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id"""


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_fracminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.fracminhash import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


_JOIN_SQL = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT DISTINCT doc_id, doc_id FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def op6_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pii_semicrf import pii_scan

    return pii_scan(_table(spark, sf_dir, "documents"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.nn_descent import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.license_rules import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


#: The mixture of op10_mix: weights by level (others: 1), share of all tokens, epochs at most.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
MIX_SHARE, MIX_SEED, MIX_EPOCHS = (3, 4), 20240607, 4


def mix_domain():
    """Sources belong to one of four domains by their number."""
    return F.concat(F.lit("d"), (F.expr("try_cast(regexp_extract(source, '[0-9]+$', 0) as bigint)") % 4).cast("string"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import mix

    share = F.floor(F.sum("tokens") * MIX_SHARE[0] / MIX_SHARE[1])
    out = mix(_table(spark, sf_dir, "documents"), mix_domain(), MIX_WEIGHTS, share, MIX_SEED, MIX_EPOCHS)
    return out.select("doc_id", "lang", "source", "mix_domain", "mix_epoch", "mix_tokens")


def _mix_sql() -> str:
    case = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in sorted(MIX_WEIGHTS[level].items())) + " ELSE 1 END"
    fill = lambda n, at, level, budget: f"""
n{n} AS (SELECT {', '.join([*at, level])}, sum(capacity)::BIGINT AS capacity, {case(level)} AS weight FROM leaves GROUP BY {', '.join([*at, level])}),
l{n} AS (SELECT c.*, b.budget, (b.budget - coalesce(sum(capacity) OVER (PARTITION BY {', '.join(['1', *('c.' + a for a in at)])} ORDER BY capacity / weight, c.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (PARTITION BY {', '.join(['1', *('c.' + a for a in at)])} ORDER BY capacity / weight, c.{level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM n{n} c {budget}),
g{n} AS (SELECT {', '.join([*at, level])}, least(capacity::DOUBLE, weight * max(level) OVER (PARTITION BY {', '.join(['1', *at])})) AS budget FROM l{n})"""  # noqa: E731
    return f"""WITH words AS (SELECT doc_id, concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS name, lang AS lang0, source AS source0, coalesce('d' || (try_cast(nullif(regexp_extract(source, '[0-9]+$'), '') AS BIGINT) % 4)::VARCHAR, '(none)') AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {MIX_EPOCHS} AS capacity FROM words GROUP BY ALL),
total AS (SELECT floor(sum(tokens)::DOUBLE * {MIX_SHARE[0]} / {MIX_SHARE[1]}) AS budget FROM leaves),{fill(1, [], 'domain', 'CROSS JOIN total b')},{fill(2, ['domain'], 'lang', 'JOIN g1 b ON b.domain = c.domain')},{fill(3, ['domain', 'lang'], 'source', 'JOIN g2 b ON b.domain = c.domain AND b.lang = c.lang')},
targets AS (SELECT l.domain, l.lang, l.source, floor(g.budget)::BIGINT // l.tokens AS whole, floor(g.budget)::BIGINT % l.tokens AS rest FROM leaves l JOIN g3 g USING (domain, lang, source)),
keyed AS (SELECT w.*, t.whole, t.rest, md5('{MIX_SEED}:' || t.whole || ':' || w.name) AS k FROM words w JOIN targets t USING (domain, lang, source)),
run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM keyed),
taken AS (SELECT doc_id, lang0, source0, domain, e.epoch, tokens FROM run, range(0, whole) e(epoch)
    UNION ALL SELECT doc_id, lang0, source0, domain, whole, least(tokens, rest - before) FROM run WHERE before < rest)
SELECT doc_id, lang0 AS lang, source0 AS source, domain AS mix_domain, epoch AS mix_epoch, tokens AS mix_tokens FROM taken"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_crf, op2_preference, op3_pack, op4_fracminhash, op5_ngram_jaccard_join, op6_pii_semicrf, op7_nn_descent, op8_cross_parsing, op9_license_rules, op10_mix, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_preference": _PREFERENCE_SQL, "op5_ngram_jaccard_join": _JOIN_SQL, "op10_mix": _mix_sql()}
