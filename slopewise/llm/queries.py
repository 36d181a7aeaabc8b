"""The operators as queries on whole tables, and SQL where it can put the same question."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import archived
from .chat import format_chats, read_chats
from .contamination import contamination
from .counts import count_tokens
from .interactions import document_interactions
from .language import languages
from .likelihood import score_texts
from .lines import line_classes
from .near import near_classes
from .packing import pack
from .phrases import repeated_passages
from .quality import repetition
from .repair import damaged, repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; CORPUS_TOKENIZERS names another folder."""
    folder = os.environ.get("CORPUS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(_table(spark, sf_dir, "documents")).select("doc_id", "line_no", "class_doc", "class_line", "copies", "kept")


@query("op10_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "kept")


_QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, w FROM d),
runs AS (SELECT doc_id, i, k, count(*) OVER (PARTITION BY doc_id, k, array_to_string(w[i + 1:i + k], ' ')) AS times
         FROM w, (VALUES (5), (8), (51)) AS sizes(k) WHERE i + k <= n),
hit AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS i FROM runs WHERE times > 1),
cover AS (SELECT doc_id, count(*) FILTER (k = 5) AS five, count(*) FILTER (k = 8) AS eight, count(*) FILTER (k = 51) AS long FROM hit GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(n - 1) AS dups FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
             coalesce(eight, 0)::BIGINT AS n_repeat_words, coalesce(five, 0)::BIGINT AS covered_words, coalesce(long, 0) AS long
      FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND covered_words <= 0.4 * n_words AND long = 0 AS kept, covered_words FROM b
"""


@query("op5_quality_rules", _QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")


_CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS i, w FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM bi),
sizes AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM d),
dw AS (SELECT doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM di, sizes WHERE i + k <= len(w)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op3_decontamination", _CONTAMINATION_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.array_sort("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


@query("op2_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op9_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op8_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op7_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


_ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT *, list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + (('0x' || substr(hex, 1 + 5 * (k // 4), 5))::INT // (32 ** (3 - k % 4))::INT) % 32, 1)), lambda x, y: x || y) AS digest FROM b)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


@query("op4_warc", _ARCHIVE_SQL)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(22 + length(role) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op6_chat_format", _CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("\\### Assistant: </turn> ok").alias("text"))
    back = read_chats(format_chats(turns.unionByName(odd)))
    said = F.expr(r"array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


_REPAIR_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
m AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(key)), lambda i: ascii(substr(key, i + 1, 1))::BIGINT)),
                lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM m, range(2) AS copies(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS times,
             substr(role, 1, 1) AS c, substr(lag(role) OVER w, 1, 1) AS b, lag(role) OVER w IS NOT NULL AS follows, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body
      FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN times > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n),
-- states: 0 nothing yet, 1 after the system turn, 2 an answer is due, 3 after an answer
p(conv_id, i, q, cost, audit) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '' FROM conversations
  UNION ALL
  SELECT conv_id, i, q, w.cost, w.audit FROM (
    SELECT conv_id, i, q, min({'cost': cost, 'audit': audit}) AS w FROM (
      SELECT o.conv_id, f.i, e.edit, o.cost + (CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) + (CASE WHEN e.edit <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END) AS cost, o.audit || e.edit AS audit,
             CASE WHEN e.edit = 'D' THEN o.q WHEN e.edit = 'R' THEN CASE WHEN o.q = 2 THEN 3 ELSE 2 END
                  WHEN o.q = 0 AND f.c = 's' THEN 1 WHEN o.q <> 2 AND f.c = 'u' THEN 2 WHEN o.q = 2 AND f.c = 'a' THEN 3 END AS q
      FROM (SELECT conv_id, i, q, cost, audit FROM p UNION ALL SELECT conv_id, i, CASE WHEN q = 2 THEN 3 ELSE 2 END, cost + 5, audit || 'I' FROM p) AS o
      JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i + 1, (VALUES ('K'), ('R'), ('D')) AS e(edit)
      WHERE e.edit = 'D' OR f.fault NOT IN ('b', 'd'))
    WHERE q IS NOT NULL GROUP BY conv_id, i, q)),
s AS (SELECT conv_id, count(i) AS rows, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
             count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (follows AND b || c NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT DISTINCT conv_id FROM conversations) AS every LEFT JOIN f USING (conv_id) GROUP BY conv_id),
g AS (SELECT conv_id, min({'cost': cost, 'audit': audit}) AS w
      FROM (SELECT conv_id, i, q, cost, audit FROM p UNION ALL SELECT conv_id, i, CASE WHEN q = 2 THEN 3 ELSE 2 END, cost + 5, audit || 'I' FROM p) JOIN s USING (conv_id)
      WHERE i = rows AND q IN (0, 3) GROUP BY conv_id),
a AS (SELECT conv_id, j, w.audit[j] AS edit, length(replace(w.audit[1:j], 'I', '')) AS i, length(replace(w.audit[1:j], 'D', '')) AS place
      FROM (SELECT conv_id, w, unnest(range(1, length(w.audit) + 1)) AS j FROM g)),
t AS (SELECT a.conv_id, place, edit, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text,
             max(CASE WHEN place = 1 AND edit = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id) AS has_s
      FROM a LEFT JOIN f ON f.conv_id = a.conv_id AND f.i = a.i WHERE edit <> 'D'),
r AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS whole FROM t GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, blank, duplicate, truncated, illegal, w.cost AS cost, w.audit AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM s JOIN g USING (conv_id) LEFT JOIN r USING (conv_id)
"""


@query("op11_conversation_repair", _REPAIR_SQL)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(_table(spark, sf_dir, "conversations")), present=F.col("present"))


_PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
r AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 35], ' ') AS run FROM i),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r SEMI JOIN (SELECT run FROM r GROUP BY run HAVING count(*) > 1) AS x USING (run)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM d) ANTI JOIN h USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


@query("op12_repeated_passages", _PASSAGES_SQL)
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


_INTERACTIONS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
                    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)} AS x, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, [x.A, x.B, x.C, x.D, x.E] AS x, good, toxic, count(*) AS n FROM f GROUP BY ALL),
v(k) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.k, b.k, c.k, d.k, 15 - a.k - b.k - c.k - d.k] AS o FROM v AS a, v AS b, v AS c, v AS d
      WHERE a.k <> b.k AND a.k <> c.k AND a.k <> d.k AND b.k <> c.k AND b.k <> d.k AND c.k <> d.k),
s AS (SELECT part, o, step, o[step] AS filter, n, good, toxic, x[o[step]] AS fails, list_bool_or(list_transform(o[1:step - 1], lambda k: x[k])) AS before,
             len(list_filter(x, lambda y: y)) = 1 AS alone FROM c, o, range(1, 6) AS steps(step)),
r AS (SELECT part, list_aggregate(list_transform(o, lambda k: 'ABCDE'[k]), 'string_agg', '') AS filter_order, step, any_value(filter) AS filter,
             coalesce(sum(n) FILTER (NOT fails AND NOT coalesce(before, false)), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT coalesce(before, false)), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (fails AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails,
             coalesce(sum(n) FILTER (fails AND NOT coalesce(before, false) AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT coalesce(before, false) AND toxic), 0)::BIGINT AS toxic_lost
      FROM s GROUP BY part, o, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""


@query("op13_filter_interactions", _INTERACTIONS_SQL)
def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
