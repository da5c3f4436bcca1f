"""The registered queries of the training-data operators, with SQL where SQL expresses the whole operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm import alignment, bpe, chat, fingerprints, html_text, merkle, mixing, near_dedup, rank_queue, token_shards, topk, toxicity, url_filter
from planloom.llm.common import table

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT *, '.' || host AS h, starts_with(path, '/en/') AS en FROM split),
ruled AS (SELECT page_id, host, path, CASE
 WHEN suffix(h, '.www.example.com') AND en THEN 'www.example.com/en/'
 WHEN suffix(h, '.example.com') AND en THEN 'example.com/en/'
 WHEN suffix(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
 WHEN suffix(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
 WHEN suffix(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM fits)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations")).drop("position")


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, VOCABULARY, decoded=True))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keeper")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixing.calibrated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.col("_p").alias("p"), F.col("_kept").alias("kept"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_token_shards(spark, sf_dir: str) -> DataFrame:
    shards, _ = token_shards.materialise(table(spark, sf_dir, "documents"))
    return shards.select("shard", "first_slot", "n_sequences", "stride", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("sha256"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


OP11_SQL = """
WITH RECURSIVE
rows_ AS (SELECT doc_id, lang, 'd' || coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS f1, coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS f2,
 n_chars, coalesce(strlen(text) || ':' || text, '-') AS f4,
 xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda crc, c: list_reduce([xor(crc, c)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 7 = 0 AS hit FROM documents),
hashed AS (SELECT doc_id, lang, sha256(f1[2:] || f2 || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || f4) AS leaf,
 sha256(f1[2:] || f2 || coalesce(strlen((n_chars + coalesce(hit, false)::INT)::VARCHAR) || ':' || (n_chars + coalesce(hit, false)::INT), '-') || f4) AS checked FROM rows_),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
nodes(lang, level, pos, h, n) AS (SELECT lang, 0, place, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
 UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_(level, pos, h, n) AS (SELECT 0, k, subroot, n FROM subroots
 UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM upper_ WHERE n > 1 GROUP BY level, pos // 2),
sides AS (SELECT a.level, a.pos, (CASE WHEN a.pos % 2 = 0 THEN 'R' ELSE 'L' END) || coalesce(b.h, '') AS side FROM upper_ a LEFT JOIN upper_ b ON a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
tops AS (SELECT s.lang, s.subroot, (SELECT h FROM upper_ WHERE n = 1) AS root,
 (SELECT coalesce(list(u.side ORDER BY u.level), []) FROM sides u WHERE u.pos = s.k >> u.level) AS path FROM subroots s),
beside AS (SELECT a.lang, a.level, a.pos, (CASE WHEN a.pos % 2 = 0 THEN 'R' ELSE 'L' END) || coalesce(b.h, '') AS side
 FROM nodes a LEFT JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
own AS (SELECT l.lang, l.place, list(n.side ORDER BY n.level) AS path
 FROM leaves l JOIN beside n ON l.lang IS NOT DISTINCT FROM n.lang AND n.pos = l.place >> n.level GROUP BY l.lang, l.place),
joined AS (SELECT l.*, t.subroot, t.root, coalesce(o.path, []) || t.path AS path FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang
 LEFT JOIN own o ON l.lang IS NOT DISTINCT FROM o.lang AND l.place = o.place),
folded AS (SELECT *, list_reduce([checked] || path, lambda node, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || node) ELSE sha256(node || s[2:]) END) AS folded_root FROM joined)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def op12_rank_queue_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank_queue.digests(rank_queue.decode(rank_queue.encode(docs, RANKS), RANKS))


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, PIECES)[0]


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_chat_formatting, op3_document_fingerprints, op4_html_extraction, op5_exact_topk, op6_bpe, op7_minhash_near_dedup, op8_mixing,
                                  op9_toxicity, op10_token_shards, op11_merkle_manifest, op12_rank_queue_bpe, op13_tokenizer_alignment)}
ORACLES = {"op1_url_filters": OP1_SQL, "op5_exact_topk": OP5_SQL, "op11_merkle_manifest": OP11_SQL}
