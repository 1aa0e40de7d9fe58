"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    rows = report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_adaptive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op5_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import dedup

    return dedup(_table(spark, sf_dir, "documents"))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .likelihood import score

    return score(_table(spark, sf_dir, "documents"))


def op7_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import count

    return count(_table(spark, sf_dir, "documents"))


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import compare_edited

    return compare_edited(_table(spark, sf_dir, "documents"))


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(_table(spark, sf_dir, "documents"))


def op10_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_slot_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import audit

    return audit(_table(spark, sf_dir, "documents"))


def op12_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine_relabelled

    return mine_relabelled(_table(spark, sf_dir, "embeddings"))


def op13_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, report

    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return report(format_chats(rows))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_wavelet_matrix, op2_positional_index, op3_adaptive_prefix, op4_concat_and_cut, op5_fingerprint_index, op6_pseudo_likelihood, op7_longest_match, op8_closed_syncmers, op9_disclosure, op10_noisy_channel, op11_slot_pivot, op12_threshold_join, op13_grammar_round_trip)}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

SQL: dict[str, str] = {
    "op2_positional_index": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS l FROM bw),
dw AS (SELECT doc_id, l, i, list_slice(w, i, i + l - 1) AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, sizes WHERE len(w) >= l)),
hits AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
 coalesce(its.s, sha256('')) AS items_sha256, pos.n IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op5_fingerprint_index": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
    "op11_slot_pivot": r"""
WITH RECURSIVE c AS (SELECT doc_id, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p,
 concat('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
 CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head, n_chars, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
 list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
l AS (SELECT doc_id, g, p, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
 CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || tail) END AS changed FROM c),
t AS (SELECT g, 0 AS lev, p, leaf AS dig, count(*) OVER (PARTITION BY g) AS n FROM l
 UNION ALL SELECT g, lev + 1, p // 2, sha256(string_agg(dig, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lev, p // 2),
s AS (SELECT g, dig AS subroot, lev AS depth, row_number() OVER (ORDER BY g) - 1 AS q FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, q AS p, subroot AS dig, count(*) OVER () AS n FROM s
 UNION ALL SELECT lev + 1, p // 2, sha256(string_agg(dig, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lev, p // 2),
steps AS (SELECT g, lev, p, dig, n FROM t WHERE n > 1 UNION ALL SELECT '#', lev, p, dig, n FROM u WHERE n > 1),
w AS (SELECT l.doc_id, l.g, l.p AS lp, k.step, k.own, o.dig AS other FROM l JOIN s USING (g) JOIN LATERAL
 (SELECT x AS step, CASE WHEN x < depth THEN l.g ELSE '#' END AS side, CASE WHEN x < depth THEN x ELSE x - depth END AS lev, CASE WHEN x < depth THEN l.p >> x ELSE q >> (x - depth) END AS own
  FROM unnest(range(0, depth + (SELECT max(lev) FROM u))) AS r(x)) k ON true LEFT JOIN steps o ON o.g = k.side AND o.lev = k.lev AND o.p = xor(k.own, 1)),
f AS (SELECT g, p, 0 AS step, coalesce(changed, leaf) AS acc FROM l
 UNION ALL SELECT f.g, f.p, f.step + 1, sha256(CASE WHEN w.own % 2 = 1 THEN coalesce(w.other, '') || f.acc ELSE f.acc || coalesce(w.other, '') END) FROM f JOIN w ON w.g = f.g AND w.lp = f.p AND w.step = f.step),
proofs AS (SELECT g, lp AS p, sha256(coalesce(string_agg(other, '' ORDER BY step), '')) AS proof FROM w GROUP BY 1, 2),
ends AS (SELECT g, p, arg_max(acc, step) AS folded FROM f GROUP BY 1, 2)
SELECT l.doc_id, l.leaf, s.subroot, root.dig AS root, coalesce(proofs.proof, sha256('')) AS proof_sha256, ends.folded AS folded_root, ends.folded = root.dig AS verified
FROM l JOIN s USING (g) JOIN ends USING (g, p) LEFT JOIN proofs USING (g, p) CROSS JOIN (SELECT dig FROM u WHERE n = 1) root""",
    "op12_threshold_join": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) <= 3""",
    "op13_grammar_round_trip": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok'))),
x AS (SELECT *, length(text) - length(replace(text, '\', '')) AS slashes, (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS marks,
 contains(text, '\\') OR contains(text, '\### ') OR contains(text, '\</turn>') OR suffix(text, '\') AS deep FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(4 + length(role) + 2 + length(text) + marks + CASE WHEN deep THEN slashes ELSE 0 END + 8) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id""",
}
