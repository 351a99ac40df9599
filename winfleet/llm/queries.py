"""One query for each operator, over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winfleet.llm import embedding_dedup, fingerprints, html_density, language_id, licences, merkle, mixing, order_minhash, packing, periodic, recompression, token_output, warc
from winfleet.llm.common import table

END_ID = 2


def op1_tiled_pca_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, folder = token_output.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_output.read_ids(spark, blocks, folder, with_ids=False)


def op3_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op4_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op6_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.main_text(table(spark, sf_dir, "pages"))


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_of(table(spark, sf_dir, "documents"))


def op10_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _looped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the words of the chosen texts (h divisible by 10) from word a on by the p words from there, over and over."""
    for batch in batches:
        texts = batch["text"].to_pylist()
        for i, h in enumerate(batch["h"].to_pylist()):
            if h is not None and h % 10 == 0 and (words := (texts[i] or "").encode("utf-8", "replace").split()):
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                loop = words[a : a + p]
                texts[i] = b" ".join([*words[:a], *(loop * (1 + (n - a) // p))[: n - a]]).decode("utf-8")
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    runs = periodic.periodic_runs(docs.mapInArrow(_looped, "doc_id long, text string"), with_text=False)
    return runs.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


MANIFEST_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = {c: F.col(c) for c in MANIFEST_COLUMNS}
    cut = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    shown = F.when(cut, merkle.leaf_digest(list((kept | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values()))).otherwise(F.col("leaf"))
    leaves = docs.select(*MANIFEST_COLUMNS, merkle.leaf_digest(list(kept.values())).alias("leaf")).select("source", "doc_id", "leaf", F.unhex(shown).alias("shown"))
    built = merkle.manifest(leaves, carry=["doc_id", "shown"])
    rows = merkle.paths(built).withColumn("root", F.lit(built.root).cast("string"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof_sha256"), merkle.folded("path", F.lower(F.hex("shown"))).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents")).drop("expressions")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_tiled_pca_dedup, op2_ranked_token_files, op3_variable_best_fit, op4_iblt_fingerprints, op5_order_minhash,
        op6_warc_boundary_chain, op7_composite_text_density, op8_recompression_dedup, op9_hyperdimensional_language, op10_entropy_balancing,
        op11_periodic_runs, op12_merkle_manifest, op13_license_scan,
    )
}

_OP1 = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

_OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY sha1(payload)) AS response FROM p)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1],
        lambda u: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0x' || substr(hex, 5 * i + 1, 5))::BIGINT // u % 32 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> response THEN response END AS refers_to
FROM d
"""

_OP8 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), gone AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) < doc_id AS repeated FROM windows),
covered AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM gone, range(13) AS offsets(k) WHERE repeated GROUP BY doc_id),
kept AS (
    SELECT d.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
        list_filter(list_transform(w, lambda x, j: CASE WHEN places IS NULL OR NOT list_contains(places, j) THEN x END), lambda x: x IS NOT NULL) AS words
    FROM d LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""

# crc32 of a number's decimal digits: bytes into the reflected polynomial, bit by bit.
_CRC = """(xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
), 4294967295))"""

_OP12 = f"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS row_id, *, CASE WHEN {_CRC.format("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents
), parts AS (
    SELECT row_id, doc_id, source, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id::VARCHAR, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars::VARCHAR, '-') AS head,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS body, coalesce(octet_length(encode(shown)) || ':' || shown, '-') AS cut
    FROM d
), leaves AS (
    SELECT row_id, doc_id, source, sha256(head || body) AS leaf, sha256(head || cut) AS shown FROM parts
), nodes(height, source, rank, n, digest) AS (
    SELECT 0, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1, count(*) OVER (PARTITION BY source), leaf FROM leaves
    UNION ALL
    SELECT height + 1, source, rank // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY rank)) FROM nodes WHERE n > 1 GROUP BY height, source, rank // 3, n
), subroots AS (
    SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), over_(height, rank, n, digest) AS (
    SELECT 0, place, n, subroot FROM subroots
    UNION ALL
    SELECT height + 1, rank // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY rank)) FROM over_ WHERE n > 1 GROUP BY height, rank // 3, n
), beside AS (
    SELECT a.height, a.source, a.rank, string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank < a.rank) AS l, string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank > a.rank) AS r
    FROM nodes a JOIN nodes b ON a.height = b.height AND a.source IS NOT DISTINCT FROM b.source AND a.rank // 3 = b.rank // 3 WHERE a.n > 1 GROUP BY ALL
), beside_over AS (
    SELECT a.height, a.rank, string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank < a.rank) AS l, string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank > a.rank) AS r
    FROM over_ a JOIN over_ b ON a.height = b.height AND a.rank // 3 = b.rank // 3 WHERE a.n > 1 GROUP BY ALL
), fold(row_id, source, height, rank, node, proof) AS (
    SELECT l.row_id, l.source, 0, row_number() OVER (PARTITION BY l.source ORDER BY l.doc_id NULLS FIRST, l.leaf, l.row_id) - 1, shown, '' FROM leaves l
    UNION ALL
    SELECT f.row_id, f.source, f.height + 1, f.rank // 3, sha256(coalesce(l, '') || node || coalesce(r, '')), proof || coalesce(l, '') || coalesce(r, '')
    FROM fold f JOIN beside b ON b.height = f.height AND b.source IS NOT DISTINCT FROM f.source AND b.rank = f.rank
), in_source AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY height DESC) = 1),
fold_over(row_id, height, rank, node, proof) AS (
    SELECT row_id, 0, place, node, proof FROM in_source i JOIN subroots s ON s.source IS NOT DISTINCT FROM i.source
    UNION ALL
    SELECT f.row_id, f.height + 1, f.rank // 3, sha256(coalesce(l, '') || node || coalesce(r, '')), proof || coalesce(l, '') || coalesce(r, '')
    FROM fold_over f JOIN beside_over b ON b.height = f.height AND b.rank = f.rank
), ends AS (SELECT * FROM fold_over QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY height DESC) = 1),
root AS (SELECT digest AS root FROM over_ WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, root.root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = root.root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN ends e USING (row_id), root
"""

ORACLES: dict[str, str] = {"op1_tiled_pca_dedup": _OP1, "op6_warc_boundary_chain": _OP6, "op8_recompression_dedup": _OP8, "op12_merkle_manifest": _OP12}
