"""Queries of the corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import ann, bpe, langid, minhash, packing, pii, quality, secrets, suffixes, toxicity
from inkframe.llm.common import crc_mod, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies on this machine; files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.fit(docs)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.label_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("score"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_packing": op2_packing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_secrets": op4_secrets,
        "op5_toxicity": op5_toxicity,
        "op6_ann": op6_ann,
        "op7_minhash": op7_minhash,
        "op8_quality_rules": op8_quality_rules,
        "op9_language_id": op9_language_id,
        "op10_bpe": op10_bpe,
    }


_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_PHRASES = " OR ".join(f"contains(lower(x), '{p}')" for p in quality.BOILERPLATE)
_MARKED = r"""(CASE WHEN len(regexp_extract_all(x, '[!-/:-@\[-`{-~]')) * 6 > length(x) THEN true
  WHEN contains(x, '|') OR contains(x, '>') THEN len(regexp_extract_all(x, '[|>]')) >= 3 AND len(regexp_extract_all(x, '[|>]')) * 24 > length(x)
  WHEN length(x) <= 200 THEN """ + _PHRASES + " ELSE false END)"
_OP8 = (
    f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 p AS (SELECT rid, doc_id, t, {_WORDS.format('t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, """
    + r"'[^\x20\x09-\x0D]'"
    + f""")) AS lines FROM d),
 g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) >= 3)),
 twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
 rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
 c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(coalesce(array_to_string(w, ''), ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
   coalesce(list_sum(list_transform(lines, lambda x: CASE WHEN {_MARKED} THEN length(x) ELSE 0 END)), 0)::BIGINT AS lost_chars, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0)::BIGINT AS line_chars
   FROM p LEFT JOIN rep USING (rid))
 SELECT *, (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed, NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND lost_chars * 2 <= line_chars AS kept FROM c"""
)
_OP7 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
 r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(seen) AS c FROM r GROUP BY id) m ON m.id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op7_minhash": _OP7, "op8_quality_rules": _OP8}
