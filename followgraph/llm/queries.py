"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from followgraph.llm import bpe, chat, pii, quality, secrets
from followgraph.llm.decontaminate import contamination
from followgraph.llm.near_dedup import near_duplicates
from followgraph.llm.passages import repeated_passages
from followgraph.llm.prefix_trie import prefix_trie
from followgraph.llm.scratch import folder as scratch_folder
from followgraph.llm.sharding import sharded
from followgraph.llm.token_file import read_tokens, write_tokens
from followgraph.llm.top_k import top_k
from followgraph.llm.whitening import whitened

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return secrets.scan(documents, secrets.train(documents))


def op3_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(_table(spark, folder, "documents"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoded(documents, path, public_tokenizers.PATTERN).drop("ids")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return quality.scored(documents, quality.train(documents, _table(spark, folder, "labels")))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(_table(spark, folder, "documents"))


def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


TOP_K_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""


def op8_token_file(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_folder(spark)
    write_tokens(_table(spark, folder, "documents"), place, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, place).drop("ids")


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    probe = spark.range(1).selectExpr(
        f"inline(array((-7L, 0L, 'user', r'{text}'), (-7L, 1L, 'assistant', r'{text}'))) AS (conv_id, turn, role, text)"
    )
    return chat.digests(chat.formatted(turns.unionAll(probe)))


CHAT_SQL = r"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</', '<\/')) AS body,
    length(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</', '<\/')) AS head
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN before IS NULL OR before <> role THEN head + 12 ELSE 0 END
    + CASE WHEN after IS NULL OR after <> role THEN 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    # As a long, the deviation is null where it does not fit.
    return whitened(_table(spark, folder, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharded(_table(spark, folder, "documents"), with_text=False)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(_table(spark, folder, "conversations"))


_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""

PREFIX_TRIE_SQL = f"""WITH k AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, g) AS i FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS chars,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g
    FROM conversations WHERE conv_id IS NOT NULL)),
s AS (SELECT conv_id, count(*) AS n FROM k GROUP BY conv_id),
c AS (
  SELECT s.conv_id, s.conv_id - s.conv_id % 100 AS head, {_CRC32.format("s.conv_id")} % 6 AS h FROM s),
r AS (SELECT c.*, least(h, coalesce(s.n, 0)) AS lent FROM c LEFT JOIN s ON s.conv_id = head),
t AS (
  SELECT r.conv_id, i AS d, g, chars FROM r JOIN k ON k.conv_id = head AND i <= h
  UNION ALL SELECT r.conv_id, lent + i - h, g, chars FROM r JOIN k ON k.conv_id = r.conv_id AND i > h),
p AS (
  SELECT r.conv_id, coalesce(list(g ORDER BY d) FILTER (g IS NOT NULL), []) AS gs,
    coalesce(list(chars ORDER BY d) FILTER (g IS NOT NULL), []) AS cs
  FROM r LEFT JOIN t ON t.conv_id = r.conv_id GROUP BY r.conv_id),
m AS (
  SELECT conv_id, len(gs) AS most, d, array_to_string(gs[1:d], '') AS path,
    CASE WHEN d = 0 THEN 0 ELSE cs[d] END AS chars
  FROM (SELECT *, unnest(range(0, len(gs) + 1)) AS d FROM p)),
v AS (
  SELECT path, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = most) AS ends
  FROM m GROUP BY path),
b AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM v WHERE d > 0 GROUP BY 1),
u AS (
  SELECT left(path, 32 * a) AS path, sum(saved) AS saved, count_if(leaf) AS leaves FROM (
    SELECT v.path, (v.n - 1) * chars AS saved, b.n IS NULL AS leaf, unnest(range(0, d + 1)) AS a
    FROM v LEFT JOIN b ON b.path = v.path)
  GROUP BY 1)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, v.n AS n_convs,
  coalesce(b.n, 0) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN u ON u.path = v.path LEFT JOIN b ON b.path = v.path
LEFT JOIN v o ON v.d > 0 AND o.path = left(v.path, 32 * (v.d - 1))"""

NEAR_DEDUP_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gs
  FROM w),
n AS (SELECT doc_id, CAST(len(gs) AS BIGINT) AS n_shingles FROM g),
s AS (SELECT doc_id, unnest(gs) AS s FROM g),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * common >= 75 * (a.n_shingles + b.n_shingles - common)),
r AS (SELECT doc_id AS x, doc_id AS c FROM n UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
c AS (SELECT x, min(c) AS c FROM r GROUP BY x)
SELECT doc_id, n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN c ON doc_id = x"""


def queries() -> dict[str, Query]:
    """One entry per operator, over whole tables."""
    return {f.__name__: f for f in (op1_decontaminate, op2_secrets, op3_passages, op4_bpe, op5_quality, op6_pii, op7_top_k, op8_token_file, op9_near_dedup, op10_chat, op11_whitening, op12_sharding, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    """The same results as SQL, where SQL can express them."""
    return {"op9_near_dedup": NEAR_DEDUP_SQL, "op10_chat": CHAT_SQL, "op7_top_k": TOP_K_SQL, "op13_prefix_trie": PREFIX_TRIE_SQL}
