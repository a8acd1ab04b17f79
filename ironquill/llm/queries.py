"""One query per operator, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironquill.llm import html_extract, toxicity, warc
from ironquill.llm.bpe import encoded
from ironquill.llm.decontaminate import contamination
from ironquill.llm.exact_dedup import exact_groups
from ironquill.llm.license_scan import licenses
from ironquill.llm.mixing import replicate
from ironquill.llm.oracle_sql import contamination_sql, spelling_sql, vector_codes_sql
from ironquill.llm.secret_scan import BASE_RULES, RULES, secret_spans, span_text
from ironquill.llm.shared import hexed, table
from ironquill.llm.simhash import near_groups
from ironquill.llm.spelling import variants
from ironquill.llm.vector_codes import vector_codes
from ironquill.llm.winnow import edited_likeness

#: Shares of the mixture, in documents; the other sources share what is left.
MIX_WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.08, "src3": 0.05, "src4": 0.02}

#: The public vocabulary that documents are encoded with.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = found.withColumn("_base", F.expr(f"filter(_spans, x -> x.k < {len(BASE_RULES)})"))
    counts = [F.expr(f"cast(size(filter(_base, x -> x.k = {n})) as long)").alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)]
    return base.select(F.col("_id").alias("doc_id"), *counts, hexed(span_text(F.col("_base"))).alias("base_sha256"), span_text(F.col("_spans")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.scored(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), F.col("_score").alias("score"),
                        F.when(F.col("_score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
                        F.col("_ratio").alias("log_ratio"), F.col("_clear").alias("clear_ratio"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extracted(pages, html_extract.fit(pages))
    return found.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, hashed; a null text has no tokens."""
    found = encoded(table(spark, sf_dir, "documents"), vocabulary_path(), lists=False)
    return found.select("doc_id", (F.octet_length("_ids_le") / 4).cast("long").alias("n_tokens"), F.sha2("_ids_le", 256).alias("ids_sha256"),
                        hexed(F.col("_decoded")).alias("decoded_sha256"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document that the mixture holds, in global random order."""
    copies = replicate(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return copies.select("doc_id", "source", F.col("_copy").alias("copy"), F.col("_copies").alias("copies"),
                         F.round("_rate", 9).alias("rate"), F.col("_place").alias("place"), "text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every embedding without null, NaN or infinite components; null labels are one label."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots; null texts have no words."""
    return variants(table(spark, sf_dir, "documents"))


def op13_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its words inside windows of benchmark items, and these items; null texts have no words."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
                        F.size("_items").cast("long").alias("n_items"), hexed(F.array_join("_items", ",")).alias("items_sha256"),
                        (F.col("_n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_html_extraction": op4_html_extraction,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe_encoding": op9_bpe_encoding,
    "op10_source_mixing": op10_source_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_benchmark_contamination": op13_benchmark_contamination,
}

def _span_sql() -> str:
    """Spans of every rule: gaps and matches, numbered, with running sums of their lengths."""
    parts = []
    for n, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
            select doc_id, {n} as k, '{r.kind}' as kind, {r.least} as least, unnest(string_split_regex(t, '{pattern}')) as gap,
                   unnest(regexp_extract_all(t, '{pattern}', 0)) as found, unnest(regexp_extract_all(t, '{pattern}', {r.group})) as part,
                   generate_subscripts(string_split_regex(t, '{pattern}'), 1) as i
            from text where regexp_matches(t, '{pattern}')""")
    return " union all ".join(parts)


_WEIGHTS = ", ".join(f"('{k}', {w}::double)" for k, w in MIX_WEIGHTS.items())

ORACLES: dict[str, str] = {
    "op2_secret_scan": f"""
        with text as (select doc_id, coalesce(text, '') as t from documents),
        piece as ({_span_sql()}),
        place as (select *, sum(length(gap) + coalesce(length(found), 0)) over (partition by doc_id, k order by i) as e from piece),
        span as (select doc_id, k, kind, e - length(found) as s, e, kind || ':' || (e - length(found)) || ':' || e as one
                 from place where found is not null and length(part) >= least),
        row_of as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
                          coalesce(string_agg(one, ',' order by s, k) filter (k < 3), '') as base,
                          string_agg(one, ',' order by s, k) as spans from span group by doc_id)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from text left join row_of using (doc_id)""",
    "op8_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op10_source_mixing": f"""
        with weight(source, w) as (values {_WEIGHTS}),
        unit as (select d.*, w.source as listed, coalesce(w.w, 1 - (select sum(w) from weight)) as w
                 from documents d left join weight w using (source)),
        rate as (select listed, any_value(w) * (select count(*) from documents) / count(*) as rate from unit group by listed),
        step as (select listed, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by listed order by k) as below
                 from rate, range(0, 200) as r(k)),
        drawn as (select u.doc_id, u.source, u.text, u.listed,
                         (('0x' || substr(md5('mix-1:' || u.doc_id || ':'), 1, 13))::bigint + 0.5) / (1::bigint << 52)::double as x
                  from unit u),
        counted as (select d.doc_id, d.source, d.text, s.rate, count(*) filter (s.below < d.x) as copies
                    from drawn d join step s on d.listed is not distinct from s.listed group by all)
        select doc_id, source, copy::int as copy, copies::int as copies, round(rate, 9) as rate,
               md5('mix-1:place:' || doc_id || ':' || copy) as place, text
        from counted, lateral (select unnest(generate_series(1, copies)) as copy)""",
    "op11_vector_codes": vector_codes_sql(),
    "op12_spelling_variants": spelling_sql(),
    "op13_benchmark_contamination": contamination_sql(),
}
