"""The registered query of each operator, over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyframe.llm import language, toxicity
from plyframe.llm.common import crc_fold, documents, save
from plyframe.llm.embeddings import near_vectors
from plyframe.llm.exact_dedup import exact_dedup
from plyframe.llm.mixture import mix
from plyframe.llm.pieces import encode_pieces
from plyframe.llm.preferences import formatted, swapped_turns
from plyframe.llm.secrets import scan
from plyframe.llm.simhash import simhash_groups
from plyframe.llm.token_counts import count_tokens, frequent_table
from plyframe.llm.vector_codes import compress
from plyframe.llm.warc import read_archives, resolve_revisits, write_archives
from plyframe.llm.whitening import whiten
from plyframe.session import scratch_path


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(spark, documents(spark, sf_dir))


def op2_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_archives(spark, documents(spark, sf_dir, "pages"), path)
    records = resolve_revisits(save(spark, read_archives(spark, path), "warc-records"))
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_preferences(spark, sf_dir):
    pairs = formatted(swapped_turns(documents(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s.begin, s.end)), ",")
    return pairs.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.train(language.sample(docs, crc_fold(4) != 2))
    return language.predict(docs.select("doc_id", (crc_fold(4) == 2).alias("held_out"), "text"), model)


def op5_embedding_near_dedup(spark, sf_dir):
    return near_vectors(spark, documents(spark, sf_dir, "embeddings"))


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash_groups(spark, documents(spark, sf_dir))


def op7_mixture(spark, sf_dir):
    taken = mix(spark, documents(spark, sf_dir).select("doc_id", "text", "source"))
    return taken.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target",
                        (F.size("_mix.shards") * F.col("_mix.size")).alias("taken"), "source",
                        F.concat_ws(",", "_mix.shards").alias("shards"))


def piece_model(path: str | None = None) -> bytes:
    """The SentencePiece model file: ``path``, or the public one installed here."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def piece_digests(docs, model_path: str | None = None):
    """One row per row of ``docs``: the contract's digests of ``encode_pieces``, and the bytes its spans cover."""
    rows = encode_pieces(docs.select("doc_id", "text"), piece_model(model_path))
    covered = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), covered.cast("long").alias("covered_bytes"))


def op8_sentencepiece(spark, sf_dir):
    return piece_digests(documents(spark, sf_dir))


def toxic_scores(spark, docs, sf_dir):
    """The rows of ``docs`` and ``_score``, by a model of the labelled rows of ``sf_dir``."""
    rows = toxicity.sample(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels"))
    return toxicity.score(docs, toxicity.train(rows))


def op9_toxicity(spark, sf_dir):
    scored = toxic_scores(spark, documents(spark, sf_dir).select("doc_id", "text"), sf_dir)
    return scored.select("doc_id", (crc_fold(3) == 1).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_secret_scan(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    found = scan(spark, docs, crc_fold(2) == 0)
    return found.select("doc_id", "nth", "begin", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                        (crc_fold(2) == 1).alias("held_out"), "score", "is_secret")


def op11_token_counts(spark, sf_dir, tokenizer_path: str | None = None):
    if tokenizer_path is None:
        import public_tokenizers
        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer_path, "rb") as f:
        tokenizer = f.read()
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, tokenizer, frequent_table(spark, docs, tokenizer))


def op12_embedding_whitening(spark, sf_dir):
    return whiten(spark, documents(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark, sf_dir):
    return compress(spark, documents(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_warc, op3_preferences, op4_language_id, op5_embedding_near_dedup, op6_simhash_near_dedup, op7_mixture, op8_sentencepiece, op9_toxicity,
                                  op10_secret_scan, op11_token_counts, op12_embedding_whitening, op13_vector_codes)}

def _codes_assign(n: int) -> str:
    """One assignment a{n} to the entries b{n}, in whole numbers as doubles (exact), ties to the lower index."""
    return f"""
a{n} AS MATERIALIZED (SELECT rid, part, any_value(y) AS y, min({{'d': yy - 2 * list_inner_product(y, c) + cc, 'e': e}}) AS m
  FROM parts JOIN b{n} USING (part) GROUP BY rid, part)"""


def _codes_move(n: int) -> str:
    """Entries b{n + 1}: the floor of the mean of each entry's parts; an entry without parts stays."""
    return f""",
m{n} AS (SELECT part, m.e AS e, i, floor(sum(y[i + 1]) / count(*)) AS val FROM a{n}, generate_series(0, len(y) - 1) t(i) GROUP BY ALL),
n{n} AS (SELECT part, e, list(val ORDER BY i) AS c FROM m{n} GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT part, e, c, list_inner_product(c, c) AS cc FROM (
  SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b{n} b LEFT JOIN n{n} n ON n.part = b.part AND n.e = b.e)),"""


ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
""",
    "op2_warc": r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
g AS (SELECT p, min(page_id) AS first_id FROM t WHERE strlen(p) >= 100 GROUP BY p)
SELECT t.page_id, strlen(t.p) AS payload_bytes, sha256(t.p) AS payload_digest,
  CASE WHEN t.page_id > g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN t.page_id > g.first_id THEN g.first_id END AS refers_to
FROM t LEFT JOIN g USING (p)
""",
    "op3_preferences": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS l FROM t WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY 1),
s AS (SELECT conv_id, l.turn AS last_turn, l.text AS own,
        coalesce(lead(l.text) OVER (ORDER BY conv_id), (SELECT arg_min(l.text, conv_id) FROM l)) AS reply FROM l),
w AS (SELECT t.*, role = 'assistant' AND turn = last_turn AND text = own AS is_last, reply,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS pos
      FROM t JOIN s USING (conv_id)),
c AS (SELECT conv_id, pos, role, replace(text, '<|im_', '<| im_') AS text, text AS raw,
        replace(CASE WHEN is_last THEN reply ELSE text END, '<|im_', '<| im_') AS rtext,
        CASE WHEN is_last THEN reply ELSE text END AS rraw FROM w),
d AS (SELECT conv_id, coalesce(min(CASE WHEN raw <> rraw THEN pos END), max(pos) + 1) AS n FROM c GROUP BY 1),
r AS (SELECT c.conv_id, pos, n, role, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS ctext,
        rtext || '<|im_end|>' AS rtext FROM c JOIN d USING (conv_id)),
o AS (SELECT *, CASE WHEN pos >= n THEN coalesce(sum(CASE WHEN pos >= n THEN length(head) + length(ctext) + 1 END)
          OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS cat,
        CASE WHEN pos >= n THEN coalesce(sum(CASE WHEN pos >= n THEN length(head) + length(rtext) + 1 END)
          OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS rat FROM r)
SELECT conv_id AS pair_id, CAST(any_value(n) AS BIGINT) AS prompt_turns,
  coalesce(string_agg(CASE WHEN pos < n THEN head || ctext || chr(10) END, '' ORDER BY pos), '') AS prompt,
  coalesce(string_agg(CASE WHEN pos >= n THEN head || ctext || chr(10) END, '' ORDER BY pos), '') AS chosen,
  coalesce(string_agg(CASE WHEN pos >= n THEN head || rtext || chr(10) END, '' ORDER BY pos), '') AS rejected,
  coalesce(string_agg(CASE WHEN pos >= n AND role = 'assistant' THEN
    CAST(CAST(cat + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(cat + length(head) + length(ctext) AS BIGINT) AS VARCHAR)
    END, ',' ORDER BY pos), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN pos >= n AND role = 'assistant' THEN
    CAST(CAST(rat + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(rat + length(head) + length(rtext) AS BIGINT) AS VARCHAR)
    END, ',' ORDER BY pos), '') AS rejected_mask
FROM o GROUP BY conv_id
""",
    "op13_vector_codes": """WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
parts AS MATERIALIZED (SELECT rid, part, y, list_inner_product(y, y) AS yy FROM (
  SELECT rid, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS y FROM v, range(16) t(part))),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS e, y AS c, yy AS cc FROM parts WHERE rid <= 64),""" + _codes_assign(0) + _codes_move(0) + _codes_assign(1) + _codes_move(1) + _codes_assign(2) + """,
sha AS (SELECT sha256(string_agg(CAST(CAST(c[i + 1] AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS s
  FROM b2, generate_series(0, len(c) - 1) t(i)),
r AS (SELECT rid, string_agg(format('{:02x}', CAST(m.e AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM r JOIN v USING (rid), sha""",
}
