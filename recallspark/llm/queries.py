"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import document_prints, filter_audit, language_id, line_dedup, packing, pieces, prefix_trie, quality_rules, simhash, substring_dedup, suffix_dedup, token_groups, toxicity
from recallspark.llm.tables import table
from recallspark.sources.shipping import ship

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(ship(spark), sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    out = language_id.identify(docs, language_id.train(docs, language_id.usable_rows()))
    return out.select("doc_id", language_id.held_out(4, 2).alias("held_out"), "lang_pred", "score", "figure")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_prints.document_prints(table(ship(spark), sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(ship(spark), sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(ship(spark), sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(ship(spark), sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = language_id.held_out(3, 1)
    out = toxicity.score(docs, toxicity.train(docs, labels, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return quality_rules.judged(docs, table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_MODEL)
    return pieces.digest(pieces.encode(table(ship(spark), sf_dir, "documents"), path), path)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie.prefix_trie(table(ship(spark), sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_groups.jaccard_join(table(ship(spark), sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_substring_dedup, op2_language_id, op3_document_fingerprints, op4_line_dedup, op5_simhash_near_dedup,
        op6_packing, op7_suffix_array_dedup, op8_toxicity, op9_quality_rules, op10_sentencepiece, op11_prefix_trie, op12_jaccard_join, op13_filter_audit, pipeline,
    )
    return {f.__name__: f for f in found}


_WORD = r"[^\x20\x09-\x0D]+"
_NUMBER = "('0x' || substr(md5({x}), 1, 15))::BIGINT"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Only what DuckDB computes over whole tables in seconds; the others are held against brute force
#: in tests/llm.
ORACLE = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM s WHERE n > 1),
e AS (SELECT d.doc_id, u.i, u.x, g.i IS NOT NULL AS gone
      FROM d, LATERAL (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i) u
      LEFT JOIN g ON g.doc_id = d.doc_id AND g.i = u.i)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(a.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept
                  FROM e GROUP BY doc_id) a USING (doc_id)""",
    "op4_line_dedup": rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS no, unnest(parts) AS line FROM d),
l AS (SELECT doc_id, no, len(regexp_extract_all(line, '{_WORD}')) AS w, {_NUMBER.format(x='line')} AS h FROM l0),
own AS (SELECT doc_id, list(no ORDER BY no) AS no, list(h ORDER BY no) AS h, list(w ORDER BY no) AS w FROM l WHERE w > 0 GROUP BY doc_id),
e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM own),
k AS (SELECT *, list_filter(range(1, 9), lambda k: list_sum(w[i:i + k - 1]) >= 8)[1] AS k,
      coalesce(list_filter(range(1, 13), lambda k: list_sum(w[i:i + k - 1]) >= 12)[1], 12) AS r FROM e),
u AS (SELECT *, CASE WHEN k IS NOT NULL AND i + k - 1 <= len(h) THEN {_NUMBER.format(x="array_to_string(h[i:i + k - 1], ',')")} END AS u FROM k),
m AS (SELECT a.doc_id, a.i, arg_min(b.i, (b.u, b.i)) AS pos FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + a.r - 1 AND b.u IS NOT NULL GROUP BY ALL),
p AS (SELECT DISTINCT m.doc_id, m.pos, u.u AS fp, u.h FROM m JOIN u ON u.doc_id = m.doc_id AND u.i = m.pos),
g AS (SELECT a.doc_id, a.pos, coalesce(list_filter(range(1, a.pos), lambda j: a.h[a.pos - j] IS DISTINCT FROM CASE WHEN b.pos > j THEN b.h[b.pos - j] END)[1] - 1, a.pos - 1) AS back,
      coalesce(list_filter(range(0, len(a.h) - a.pos + 1), lambda j: a.h[a.pos + j] IS DISTINCT FROM b.h[b.pos + j])[1], len(a.h) - a.pos + 1) AS ahead
      FROM p a JOIN p b ON a.fp = b.fp AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)),
x AS (SELECT DISTINCT doc_id, unnest(range(pos - back, pos + ahead)) AS i FROM (SELECT doc_id, pos, max(back) AS back, max(ahead) AS ahead FROM g GROUP BY ALL)),
gone AS (SELECT x.doc_id, own.no[x.i] AS no FROM x JOIN own USING (doc_id)),
t AS (SELECT l0.doc_id, count(*) AS n, count(gone.no) AS cut, string_agg(line, chr(10) ORDER BY l0.no) FILTER (gone.no IS NULL) AS kept
      FROM l0 LEFT JOIN gone ON gone.doc_id = l0.doc_id AND gone.no = l0.no GROUP BY l0.doc_id)
SELECT doc_id, coalesce(t.n, 0)::BIGINT AS n_lines, coalesce(t.cut, 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM documents LEFT JOIN t USING (doc_id)""",
    "op11_prefix_trie": rf"""
WITH c AS (SELECT conv_id, list({{'k': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'w': len({_WORDS})}}
                  ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT conv_id, list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), lambda a, x:
        list_reduce(list_prepend(xor(a, x), [0::BIGINT FOR i IN range(8)]), lambda v, i: if(v & 1 = 1, xor(v >> 1, 3988292384), v >> 1))) AS a FROM c),
h AS (SELECT conv_id, xor(a, 4294967295) % 4 AS h FROM b),
r AS (SELECT c.conv_id, list_concat(coalesce(o.t, [])[1:h.h], c.t[h.h + 1:]) AS t
      FROM c JOIN h USING (conv_id) LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, unnest(range(0, len(t) + 1)) AS d, t FROM r),
n AS (SELECT d, array_to_string([x.k FOR x IN t[1:d]], '') AS k, any_value(array_to_string([x.k FOR x IN t[1:d - 1]], '')) AS up, any_value(CASE WHEN d > 0 THEN t[d].w ELSE 0 END) AS w,
             count(*) AS n, min(conv_id) AS least, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(t) = d), '')) AS ends
      FROM p GROUP BY ALL),
q AS (SELECT up AS k, d - 1 AS d, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(q.children, 0) AS children FROM n LEFT JOIN q USING (k, d)),
s AS (SELECT a.k, a.d, count(*) FILTER (b.children = 0) AS leaves, sum((b.n - 1) * b.w) AS saved FROM m a JOIN m b ON starts_with(b.k, a.k) GROUP BY ALL)
SELECT m.least AS conv_id, m.d::BIGINT AS depth, u.least AS parent_conv_id, m.n AS n_convs, m.children AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s USING (k, d) LEFT JOIN m u ON m.d > 0 AND u.k = m.up AND u.d = m.d - 1""",
    "op12_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
t AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 2 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
k AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS k FROM t),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.k = b.k AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(m.c, t.doc_id) AS component_id
FROM t LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op13_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
f AS (SELECT part, doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
             coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY text) AS e FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS failed FROM f LEFT JOIN l USING (doc_id)),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS ng, count(*) FILTER (toxic) AS nt FROM x GROUP BY ALL),
z AS (SELECT unnest(string_split('ABCDE', '')) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM z a, z b, z c, z d, z e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
p AS (SELECT part, filter_order, step, filter_order[step] AS filter, failed, n, ng, nt, contains(failed, filter_order[step]) AS own,
             len(list_filter(string_split(failed, ''), lambda k: k <> '' AND position(k IN filter_order) < step)) > 0 AS gone FROM g, s),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed = filter), 0) AS unique_fails,
             coalesce(sum(ng) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(nt) FILTER (own AND NOT gone), 0) AS toxic_lost FROM p GROUP BY ALL)
SELECT part, filter_order, step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM r""",
}
