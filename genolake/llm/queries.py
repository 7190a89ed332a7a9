"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses, multiset_hash, sentencepiece_lattice, sharding, simhash, suffix_dedup, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece_lattice.query,
    "op2_chat_formatting": chat.query,
    "op3_license_scan": licenses.query,
    "op4_toxicity_crf": toxicity.query,
    "op5_suffix_array_dedup": suffix_dedup.query,
    "op6_vector_bin_packing": sharding.query,
    "op7_document_fingerprints": multiset_hash.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_token_files": token_files.query,
    "op10_benchmark_decontamination": decontaminate.query,
}

_TURNS = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(11 + length(role) + length(text) + length(regexp_replace(role || text, '[^~<|>\\[\\]]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

_WINDOWS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS x FROM (SELECT item, w, n, unnest(range(len(w) - n + 1)) AS i FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0) z) y),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM bw) m) y),
h AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw USING (n, x)),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) z GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) z GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

ORACLES: dict[str, str] = {"op2_chat_formatting": _TURNS, "op10_benchmark_decontamination": _WINDOWS}
