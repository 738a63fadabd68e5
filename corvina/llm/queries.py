"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvina.llm import (
    fill_in_middle,
    fingerprints,
    masked_lm,
    mixing,
    packing,
    piece_codec,
    quality_classifier,
    quality_rules,
    sharding,
    simhash_dedup,
    suffix_dedup,
    toxicity,
    vector_codes,
)
from corvina.shared import spread


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long: Arrow batches of fewer rows bound what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_frequency_rules(_docs(spark, sf_dir))


def op2_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_docs(spark, sf_dir))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return masked_lm.score(docs, masked_lm.train(docs))


def op4_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality_classifier.score(docs, quality_classifier.train(docs, _labels(spark, sf_dir)))


def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def op8_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(_docs(spark, sf_dir))


def op10_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_docs(spark, sf_dir)).drop("first")


def op11_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_codec.coded(_docs(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), with_content=False)
    return found.drop("ids", "decoded")


def op12_part_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))[0]


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(_docs(spark, sf_dir), with_output=False).drop("output")


QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_induced_suffixes": op2_induced_suffixes,
    "op3_masked_lm": op3_masked_lm,
    "op4_karmarkar_karp": op4_karmarkar_karp,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_raking": op6_raking,
    "op7_toxicity": op7_toxicity,
    "op8_sum_of_squares": op8_sum_of_squares,
    "op9_simhash": op9_simhash,
    "op10_simhash_trie_join": op10_simhash_trie_join,
    "op11_piece_backtracking": op11_piece_backtracking,
    "op12_part_codebooks": op12_part_codebooks,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def _books_sql(round_: int, parts: int = 16) -> str:
    """The codebooks after one more round, as a table b{round_} (part, entry, v)."""
    return f"""n{round_} AS (SELECT part, id, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT x.part, x.id, x.v, b.entry,
        list_sum(list_transform(range(1, len(x.v) + 1), lambda k: (x.v[k] - b.v[k]) * (x.v[k] - b.v[k])))::BIGINT AS d
        FROM x JOIN b{round_} b USING (part)) GROUP BY ALL),
    s{round_} AS (SELECT part, entry, k, floor(sum(v[k])::DOUBLE / count(*))::BIGINT AS m FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS k FROM n{round_}) GROUP BY ALL),
    b{round_ + 1} AS (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{round_} b LEFT JOIN (SELECT part, entry, list(m ORDER BY k) AS v FROM s{round_} GROUP BY ALL) m USING (part, entry))"""


PART_CODEBOOKS_SQL = f"""WITH q AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS (SELECT id, part, q[part * len(q) // 16 + 1:(part + 1) * len(q) // 16] AS v FROM q, range(16) r(part)),
    b0 AS (SELECT part, id - 1 AS entry, v FROM x WHERE id <= 64),
    {_books_sql(0)},
    {_books_sql(1)},
    f AS (SELECT part, id, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT x.part, x.id, b.entry,
        list_sum(list_transform(range(1, len(x.v) + 1), lambda k: (x.v[k] - b.v[k]) * (x.v[k] - b.v[k])))::BIGINT AS d FROM x JOIN b2 b USING (part)) GROUP BY ALL),
    c AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY id),
    h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN q USING (id), h"""

ORACLE: dict[str, str] = {
    "op1_line_frequency": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 4)),
    t AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g),
    p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) x(k) WHERE n > 1 GROUP BY r),
    l AS (SELECT * FROM (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
    e AS (SELECT r, CASE WHEN doc_id IS NULL THEN 't' || text ELSE 'i' || doc_id END AS counted, host,
        trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
        sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n FROM l GROUP BY ALL),
    hosts AS (SELECT host, count(DISTINCT counted) AS host_docs FROM e GROUP BY host),
    f AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT counted) AS n_docs FROM e GROUP BY host, norm) JOIN hosts USING (host)
        WHERE n_docs > 20 AND n_docs > 0.05 * host_docs),
    v AS (SELECT r, count(*) AS n_lines_removed, sum(n) AS n_words_removed FROM e JOIN f USING (host, norm) GROUP BY r),
    o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed,
        coalesce(n_words_removed, 0)::BIGINT AS n_words_removed FROM d LEFT JOIN p USING (r) LEFT JOIN dup USING (r) LEFT JOIN v USING (r)),
    b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM o)
    SELECT *, (NOT base_failed AND n_words_removed <= 0.5 * n_words) AS kept FROM b""",
    "op12_part_codebooks": PART_CODEBOOKS_SQL,
    "op13_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
    l AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
        [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM d),
    e AS (SELECT doc_id, text, units, len(units) AS n, h, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
        greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
            WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
    c AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM e)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM c""",
}
