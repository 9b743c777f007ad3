"""The queries of this folder's operators and the SQL that DuckDB can check."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, chat_format, collocations, langid, media, mixing, quality_lm, simhash, substring_dedup, token_counts, toxicity, vector_codes, vector_search
from framelake.llm.common import materialise

CONTROL = "</s>[INST] ok [/INST]"
TOKEN_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(materialise(mixing.sizes(_table(spark, sf_dir, "documents")), "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(probe)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search_embeddings(_table(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded_embeddings(_table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix_sources, op2_token_counts, op3_chat_format, op4_quality, op5_media_columns, op6_language_id, op7_top_k, op8_byte_bpe, op9_toxicity, op10_simhash, op11_vector_codes, op12_substring_dedup, op13_collocations, pipeline)
    return {f.__name__: f for f in own}


_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\]|(?:IMAGE|AUDIO|DOCUMENT):)', '\1\2\\\3', 'g')"

OP3_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')
), formatted AS (
    SELECT *, '<s>[ROLE]' || {_ESCAPED.format("role")} || '[/ROLE]' || {_ESCAPED.format("text")} || '</s>' || chr(10) AS f FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, f)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, f) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(f)) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id
"""

OP7_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

_ASSIGNED = """
a{i} AS (
    SELECT p.vec_id, p.label, p.part, p.x, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), entry := c.entry)) AS best
    FROM parts p JOIN c{i} c ON c.part = p.part GROUP BY ALL
)"""
_MOVED = """
m{i} AS (
    SELECT part, best.entry AS entry, list(CAST(floor_sum AS BIGINT) ORDER BY pos) AS x
    FROM (SELECT part, best, pos, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
          FROM (SELECT part, struct_pack(entry := best.entry) AS best, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS v FROM a{i}) GROUP BY ALL)
    GROUP BY ALL
), c{j} AS (
    SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry
)"""
OP11_SQL = """
WITH v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT vec_id, label, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS part FROM v)
), c0 AS (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts
    WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
),""" + ",".join(_ASSIGNED.format(i=i) + "," + _MOVED.format(i=i, j=i + 1) for i in range(2)) + "," + _ASSIGNED.format(i=2) + """, coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM coded
"""

OP12_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT row_id, doc_id, i AS start, array_to_string(w[i:i + 19], ' ') AS seq FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM words)
), firsts AS (
    SELECT *, rank() OVER (PARTITION BY seq ORDER BY doc_id NULLS LAST) AS r, row_number() OVER (PARTITION BY seq, row_id ORDER BY start) AS own FROM windows
), covered AS (
    SELECT DISTINCT row_id, unnest(range(start, start + 20)) AS i FROM firsts WHERE r > 1 OR own > 1
), each AS (
    SELECT row_id, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
    SELECT e.row_id, string_agg(e.w[e.i], ' ' ORDER BY e.i) AS kept, count(*) AS n FROM each e LEFT JOIN covered c ON c.row_id = e.row_id AND c.i = e.i WHERE c.i IS NULL GROUP BY e.row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (row_id)
"""

OP13_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece_id, coalesce(lang, 'und') AS lang,
           regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents
), sizes AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), grams AS (
    SELECT lang, p, CAST(count(*) AS BIGINT) AS f
    FROM (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS p FROM pieces)
    GROUP BY lang, p HAVING count(*) >= 30
), cuts AS (
    SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM grams WHERE len(p) > 1
), scored AS (
    SELECT c.*, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
    FROM cuts c JOIN grams l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN grams r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), held AS (
    SELECT lang, p, max(f) AS longer
    FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, len(p)), lambda n: list_transform(range(1, len(p) - n + 2), lambda i: p[i:i + n - 1])))) AS p FROM grams WHERE len(p) > 2)
    GROUP BY lang, p
), kept AS (
    SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.p = b.p
    WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < 80::HUGEINT * b.a
)
SELECT k.lang, CAST(row_number() OVER w AS BIGINT) AS rank, phrase, a, l, r, n, score FROM kept k JOIN sizes USING (lang)
WINDOW w AS (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY row_number() OVER w <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op7_top_k": OP7_SQL, "op11_vector_codes": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
