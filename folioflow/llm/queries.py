"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, exact_dedup, language_id, near_dedup, packing, quality, resampling, secrets, substring_dedup, suffix_dedup, token_files
from .workspace import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(_table(spark, sf_dir, "documents"))


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.detokenise(bpe.tokenise(docs, _vocabulary()), _vocabulary())
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    out = language_id.label(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.collapse(_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "status", "kept", "rendered")


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path, _vocabulary())
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_chat_format, op3_packing, op4_bpe_round_trip, op5_language_id, op6_minhash_near_dedup, op7_quality_rules, op8_paragraph_dedup, op9_secret_scan, op10_suffix_dedup, op11_importance_resampling, op12_token_files, op13_centroid_clustering)}


OP1_SQL = r"""
WITH k AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha AS text_sha256
FROM k WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)
"""


OP2_SQL = """
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS turns FROM r GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN struct_pack(u := turn, r := role, t := text) END),
h AS (SELECT conv_id, turns, len(turns) AS n, md5(turns::VARCHAR) AS whole FROM c),
p AS (SELECT DISTINCT md5(list_slice(turns, 1, i)::VARCHAR) AS pre FROM (SELECT turns, unnest(range(1, n)) AS i FROM h)),
s AS (SELECT *, CASE WHEN whole IN (SELECT pre FROM p) THEN 'snapshot' WHEN row_number() OVER (PARTITION BY whole ORDER BY conv_id NULLS LAST) = 1 THEN 'kept' ELSE 'copy' END AS status FROM h)
SELECT conv_id, n AS n_turns, status, status = 'kept' AS kept, CASE WHEN status = 'kept' THEN
  array_to_string(list_transform(turns, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '') END AS rendered FROM s
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(hx, 2 * s + 1, 200)) AS h FROM (SELECT doc_id, hx, unnest(range(0, greatest(n - 99, 0))) AS s FROM d)),
g AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
b AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM g),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM b),
r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS e FROM i GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(hx), 2 * max(e) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


#: The checksum's table of 256 entries comes from its polynomial (3988292384).
OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
text AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM text),
each AS (SELECT side, id, unnest(w) AS w FROM words),
coded AS (SELECT w, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c FROM (SELECT DISTINCT w FROM each), crc),
bucket AS (SELECT w, xor(c, 4294967295) % 10000 AS b FROM coded),
counts AS (SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM each JOIN bucket USING (w) GROUP BY b),
total AS (SELECT sum(s)::BIGINT AS ss, sum(t)::BIGINT AS tt FROM counts),
gain AS (SELECT b, floor(1000 * ln(((t + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS g FROM counts, total),
weighed AS (SELECT id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN bucket USING (w) JOIN gain USING (b) WHERE side = 's' GROUP BY id),
luck AS (SELECT doc_id, floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS h FROM documents),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + h AS score FROM luck LEFT JOIN weighed ON id = doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


def _op13_sql(k: int = 8, rounds: int = 10) -> str:
    """Full searches, round by round, without bounds."""
    near = "SELECT vec_id, v, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, {}) GROUP BY vec_id, v"
    steps = [
        "raw AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "kept AS MATERIALIZED (SELECT vec_id, v FROM raw)",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS m FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(f'm{i}')})",
            f"u{i} AS (SELECT c, list(x ORDER BY j) AS m FROM (SELECT c, j, (sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS x FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c)",
            f"m{i + 1} AS MATERIALIZED (SELECT m{i}.c, coalesce(u{i}.m, m{i}.m) AS m FROM m{i} LEFT JOIN u{i} ON m{i}.c = u{i}.c)",
        ]
    steps.append(f"z AS ({near.format(f'm{rounds}')})")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, z.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY z.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(m, ',')) AS centroid_sha256 FROM z JOIN m{rounds} ON z.c = m{rounds}.c"
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_chat_format": OP2_SQL, "op10_suffix_dedup": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_centroid_clustering": _op13_sql()}
