"""The queries of this subpackage and, where SQL can express one on whole tables, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, mixing, near_duplicates, packing, quality, sharding, substrings, vectors, warc, webtext
from .common import scratch, shuffles_removed, table

TOKENIZER = "byte_bpe_50k.json"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written to their shards, then where each is found."""
    with shuffles_removed(spark):
        written = sharding.write_shards(table(spark, sf_dir, "documents"), "doc_id", SHARDS, scratch(spark, "shards"))
    return written.select("doc_id", "slot", "shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_capture_index, op2_source_mix, op3_page_text, op4_near_duplicates, op5_fingerprints, op6_near_vectors, op7_repeated_passages, op8_best_fit_packing, op9_quality, op10_sharding)}


_WORDS = r"[^\x20\x09-\x0D]+"

_OP1 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
SELECT page_id, url, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN head END AS refers_to
FROM h"""

_OP2 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS own, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
h AS (SELECT *, (SELECT level FROM l AS m WHERE m.level <= m.own ORDER BY k LIMIT 1) AS height FROM l),
t AS (SELECT source, source_size, CASE WHEN level > own THEN cap::DOUBLE ELSE weight * height END AS target FROM h),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
e AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, floor(q.target)::BIGINT - q.whole * q.source_size AS quota,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS ahead
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, quota - ahead)))::BIGINT AS taken FROM e"""

_OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
                ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS s FROM w),
class AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
member AS (SELECT d.doc_id, c.rep FROM sets d JOIN class c ON list_sort(d.s) = c.s),
item AS (SELECT rep, n, unnest(s) AS x FROM class),
hits AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
         FROM item a JOIN item b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM hits WHERE 100 * common >= 80 * (na + nb - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS id, rep AS root FROM class UNION SELECT e.b, r.root FROM reach r JOIN edge e ON r.id = e.a),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN member m ON m.doc_id = d.doc_id LEFT JOIN root r ON r.id = m.rep"""

_OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT * FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN link l ON r.id = l.a),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, root.root AS component_id, root.root = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN root ON root.id = v.vec_id"""

_OP7 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
place AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS k FROM place),
first AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
hit AS (SELECT win.doc_id, i FROM win JOIN first USING (k) WHERE low < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM hit),
word AS (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS j FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY word.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_OP10 = """
WITH RECURSIVE shard AS (SELECT i, md5(printf('shard-%03d', i)) AS d FROM range(64) t(i)),
pref AS (SELECT i, (('0x' || substr(d, 1, 12))::BIGINT % 4099) AS off, (('0x' || substr(d, 13, 12))::BIGINT % 4098) + 1 AS skip FROM shard),
lists AS (SELECT list(off ORDER BY i) AS off, list(skip ORDER BY i) AS skip FROM pref),
inverse AS (SELECT list(inv ORDER BY i) AS inv FROM (SELECT i, (SELECT k FROM range(1, 4099) r(k) WHERE (k * skip) % 4099 = 1) AS inv FROM pref)),
fill(turn, slot, free) AS (
  SELECT 0, NULL::BIGINT, range(4099) FROM lists
  UNION ALL
  SELECT turn + 1, s, list_filter(free, lambda x: x <> s)
  FROM (SELECT f.turn, f.free,
               (list_min(list_transform(f.free, lambda x: ((((x - l.off[f.turn % 64 + 1]) % 4099 + 4099) % 4099) * p.inv[f.turn % 64 + 1]) % 4099))
                * l.skip[f.turn % 64 + 1] + l.off[f.turn % 64 + 1]) % 4099 AS s
        FROM fill f, lists l, inverse p WHERE f.turn < 4099)),
slot AS (SELECT slot, ((turn - 1) % 64)::INTEGER AS shard FROM fill WHERE turn > 0),
doc AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % 4099) AS slot FROM documents)
SELECT doc.doc_id, doc.slot::INTEGER AS slot, slot.shard FROM doc JOIN slot ON doc.slot = slot.slot"""


def oracle_sql() -> dict[str, str]:
    return {"op1_capture_index": _OP1, "op2_source_mix": _OP2, "op4_near_duplicates": _OP4, "op6_near_vectors": _OP6, "op7_repeated_passages": _OP7, "op10_sharding": _OP10}
