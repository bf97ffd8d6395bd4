"""The thin queries over the whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .dedup import exact_dedup
from .jaccard import jaccard_components
from .licenses import scan_licenses
from .lines import drop_shared_lines
from .manifest import merkle_manifest
from .mixing import mix_sources
from .packing import pack_best_fit
from .quality import score_quality
from .resampling import importance_resample
from .scratch import scratch_root
from .sharding import stratified_shards
from .toxicity import score_toxicity
from .wavelet import token_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(_table(spark, sf_dir, "documents"), shards=40)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/storyatlas/shards-{uuid.uuid4().hex}"
    return token_shards(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)


def op11_drop_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_shared_lines(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_nearest_neighbours, op3_stratified_shards, op4_mix_sources, op5_pack_best_fit, op6_score_quality, op7_scan_licenses,
        op8_score_toxicity, op9_jaccard_components, op10_token_shards, op11_drop_shared_lines, op12_importance_resample, op13_merkle_manifest,
    )
}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The table of the checksum's polynomial, made from its rule.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of)"""


def crc(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of ``text``, beside ``crc_table``."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value}), '-')"


def _level(nodes: str) -> str:
    return f"list_transform(range((len({nodes}) + 7) // 8), lambda i: sha256(array_to_string(list_slice({nodes}, 8 * i + 1, 8 * i + 8), '')))"


def _side(nodes: str, place: str, level: str) -> str:
    at = f"({place} // (8 ** {level})::BIGINT)"
    first = f"({at} - {at} % 8)"
    return f"array_to_string(list_slice({nodes}, {first} + 1, {at}), '') AS l, array_to_string(list_slice({nodes}, {at} + 2, {first} + 8), '') AS r"


ORACLE = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM t""",
    "op11_drop_shared_lines": f"""
        WITH d AS (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
             k AS (SELECT doc_id, line, pos,
                          translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
             shared AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
             j AS (SELECT k.doc_id, line, pos, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN shared USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op12_importance_resample": f"""
        WITH {CRC_TABLE},
             texts AS (SELECT doc_id, false AS wanted, text FROM documents UNION ALL SELECT NULL, true, text FROM benchmark),
             w AS (SELECT doc_id, wanted,
                          regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
             f AS (SELECT doc_id, wanted, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS gram FROM w),
             b AS (SELECT gram, {crc("gram")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM f), crc_table),
             fb AS (SELECT doc_id, wanted, bucket FROM f JOIN b USING (gram)),
             c AS (SELECT bucket, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t FROM fb GROUP BY bucket),
             a AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM c),
             g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM c, a),
             m AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS gain FROM fb JOIN g USING (bucket) WHERE NOT wanted GROUP BY doc_id),
             x AS (SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
                          CASE WHEN n IS NULL THEN 0 ELSE (gain - ((gain % n) + n) % n) // n END::BIGINT AS weight,
                          ('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT AS h
                   FROM w LEFT JOIN m USING (doc_id) WHERE NOT wanted),
             y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
             r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS many FROM y WHERE n_words >= 20)
        SELECT y.doc_id, n_features, weight, score, CASE WHEN place <= many THEN place END AS rank FROM y LEFT JOIN r USING (doc_id)""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE {CRC_TABLE},
             e AS (SELECT doc_id, lang, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} AS head, text,
                          {crc("doc_id::VARCHAR")} % 3 = 0 AS tampered FROM documents, crc_table),
             leaves AS (SELECT doc_id, lang, sha256(head || {_field("text")}) AS leaf,
                               CASE WHEN tampered THEN sha256(head || {_field(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}) END AS alt,
                               row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM e),
             tree AS (SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY lang
                      UNION ALL SELECT lang, level + 1, {_level("nodes")} FROM tree WHERE len(nodes) > 1),
             subs AS (SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1),
             top AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subs UNION ALL SELECT level + 1, {_level("nodes")} FROM top WHERE len(nodes) > 1),
             steps AS (SELECT doc_id, level AS hop, {_side("nodes", "l.place", "level")} FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND len(nodes) > 1
                       UNION ALL SELECT doc_id, height + level, {_side("nodes", "s.place", "level")}
                       FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top t ON len(nodes) > 1),
             paths AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY hop)) AS proof, list({{'l': l, 'r': r}} ORDER BY hop) AS path FROM steps GROUP BY doc_id),
             fold AS (SELECT leaves.doc_id, path, proof, 0 AS done, coalesce(alt, leaf) AS node FROM leaves LEFT JOIN paths ON paths.doc_id = leaves.doc_id
                      UNION ALL SELECT doc_id, path, proof, done + 1, sha256(path[done + 1].l || node || path[done + 1].r) FROM fold WHERE done < len(path)),
             whole AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
        SELECT l.doc_id, l.leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
        FROM leaves l JOIN fold f ON f.doc_id = l.doc_id AND done = coalesce(len(path), 0) JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang, whole""",
}
