"""Queries for the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, merkle, merkle_sql, mixing, neardup, neighbours, pages, pii, quality, search, secrets, substrings, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Token shares that the mix aims at, by domain.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mix: texts with a row in ``labels`` and their language."""
    known = labels.select("doc_id").distinct()
    return docs.select("doc_id", "text", "lang").join(known, "doc_id", "left_semi").withColumnRenamed("lang", "domain")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.rates(docs, labelled_domains(docs, _table(spark, sf_dir, "labels")), TARGETS)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan_documents(_table(spark, sf_dir, "documents"))
    return secrets.digest(findings)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the documents whose id is divisible by 100."""
    docs = _table(spark, sf_dir, "documents")
    return search.search_documents(docs, docs.where(F.col("doc_id") % 100 == 0), 10)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.build(_table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_neardup": op2_neardup,
    "op3_suffixes": op3_suffixes,
    "op4_mix": op4_mix,
    "op5_quality": op5_quality,
    "op6_pages": op6_pages,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_decontaminate": op9_decontaminate,
    "op10_search": op10_search,
    "op11_alignment": op11_alignment,
    "op12_merkle": op12_merkle,
    "op13_neighbours": op13_neighbours,
}

OP1 = r"""
with docs as (
  select row_number() over () as row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), starts as (
  select row_id, doc_id, words, unnest(range(1, len(words) - 48)) as pos from docs where len(words) >= 50
), windows as (
  select row_id, doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) as digest from starts
), firsts as (
  select digest, min(doc_id) as first_doc from windows group by digest
), gone as (
  select distinct row_id, unnest(range(pos, pos + 50)) as pos
  from windows join firsts using (digest) where first_doc < doc_id
), kept as (
  select d.row_id, d.words, d.doc_id, list(g.pos) filter (g.pos is not null) as gone
  from docs d left join gone g using (row_id) group by d.row_id, d.words, d.doc_id
)
select doc_id, len(words) as n_words, len(coalesce(gone, [])) as n_removed,
  sha256(array_to_string(case when gone is null then words
    else list_transform(list_filter(range(1, len(words) + 1), lambda i: not list_contains(gone, i)), lambda i: words[i]) end, ' ')) as kept_sha256
from kept
"""

OP10 = r"""
with docs as (
  select row_number() over () as row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), stats as (
  select count(*) as n, avg(len(words)) as mean_length from docs
), postings as (
  select row_id, doc_id, len(words) as length, word, count(*) as tf
  from (select row_id, doc_id, words, unnest(words) as word from docs)
  group by all
), frequency as (
  select word, count(*) as df from postings group by word
), impacts as (
  select p.row_id, p.doc_id, p.word,
    ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.length / s.mean_length)) as impact
  from postings p join frequency f using (word), stats s
), scored as (
  select q.row_id as query, q.doc_id as query_id, i.doc_id, round(sum(i.impact), 6) as score
  from postings q join impacts i using (word)
  where q.doc_id % 100 = 0 and i.doc_id is not null
  group by q.row_id, q.doc_id, i.row_id, i.doc_id
), ranked as (
  select *, row_number() over (partition by query order by score desc, doc_id) as rank from scored where score > 0
)
select query_id, rank, doc_id, score from ranked where rank <= 10
"""

ORACLE: dict[str, str] = {
    "op1_substrings": OP1,
    "op10_search": OP10,
    "op12_merkle": merkle_sql.statement(),
}
