"""Queries on the problems of texts and vectors, by name, and their SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import clusters, frequency, mixing, neighbours, subjects, tokens

RARE, COMMON_SHARE = 3, 0.05
K, LEAST_COS = 5, 0.8


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _categories(spark: SparkSession, d: str) -> DataFrame:
    def fields(table: str, *columns: str) -> DataFrame:
        each = [F.struct(F.lit(c).alias("field"), F.array(frequency.compared(F.col(c))).alias("terms")) for c in columns]
        return _read(spark, d, table).select(F.explode(F.array(*each)).alias("x")).select("x.field", "x.terms")

    return fields("pois", "TOP_CATEGORY", "SUB_CATEGORY").unionByName(fields("poi_vectors", "label_pair"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(_categories(spark, d), RARE, COMMON_SHARE).filter("mark is not null").select("field", "term", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(_categories(spark, d), RARE, COMMON_SHARE).select("field", "term", "occurrences", "records", "mark")


def p5_text_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every word of documents.text with its occurrences, documents and mark."""
    words = F.expr("filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+', -1), x -> x <> '')")
    return frequency.term_frequencies(_read(spark, d, "documents").select(F.lit("text").alias("field"), words.alias("terms")), RARE, COMMON_SHARE).select("term", "occurrences", "records", "mark")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(_read(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(_read(spark, d, "documents"), _read(spark, d, "mix_targets")).drop("membership")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source holds of the mix, by noted source and by membership."""
    targets = _read(spark, d, "mix_targets")
    return mixing.shares(mixing.mixed(_read(spark, d, "documents"), targets), targets)


def p9_shares_met(spark: SparkSession, d: str) -> DataFrame:
    """source and whether its share by noted source is within a hundredth of its target."""
    return p9_shares(spark, d).select("source", (F.abs(F.col("share") - F.col("target_share")) <= 0.01).alias("met"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "poi_vectors").select(F.col("vec_id").alias("id"), "z", "label_pair")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    labels, distinct, copies = clusters.clustered(_vectors(spark, d), LEAST_COS)
    found = clusters.isolated_cliques(labels, distinct, copies, LEAST_COS)
    return clusters.with_copies(labels, copies).join(found, "cluster").select(F.col("cluster").alias("cluster_id"), F.col("id").alias("vec_id"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size, most typical members and label_pair values."""
    vectors = _vectors(spark, d)
    return clusters.described(vectors, *clusters.clustered(vectors, LEAST_COS))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(_vectors(spark, d), K, LEAST_COS).select(F.col("id").alias("vec_id"), F.col("other").alias("neighbor_id"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    names = [r["subject"] for r in _read(spark, d, "subjects").select("subject").collect()]  # a fixed table of subjects
    return subjects.assigned(_read(spark, d, "documents"), _read(spark, d, "subject_labels"), names).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """subject, documents, share: how many documents have the subject, and the part of all documents that is."""
    whole = _read(spark, d, "documents").agg(F.count(F.lit(1)).alias("whole"))
    return p10_found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(whole)).select("subject", "documents", (F.col("documents") / F.col("whole")).alias("share"))


QUERIES = {f.__name__: f for f in (p3_found, p3_clusters, p5_found, p5_counts, p5_text_terms, p6_found, p8_ids, p9_mix, p9_shares, p9_shares_met, p10_found, p10_composition)}

_TERM = r"coalesce(nullif(trim(regexp_replace(lower({c}), '[ \t\x{{00A0}}]+', ' ', 'g')), ''), '<null_val>')"
_COUNTS = "with v as (" + " union all ".join(f"select '{c}' as field, {_TERM.format(c=c)} as term from {t}" for t, c in (("pois", "TOP_CATEGORY"), ("pois", "SUB_CATEGORY"), ("poi_vectors", "label_pair"))) + f"""),
c as (select field, term, count(*) as records from v group by field, term),
n as (select *, sum(records) over (partition by field) as whole from c),
m as (select *, case when records < {RARE} then 'rare' when records > whole * {COMMON_SHARE} then 'common' end as mark from n)
"""
USABLE = """with fine as (select vec_id, cast(z as double[]) as z from poi_vectors where len(z) = 64 and len(list_filter(z, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(z, lambda x: x <> 0)) > 0),
unit as (select vec_id, list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) as u from fine)"""
SQL = {
    "p9_shares_met": "select source, true as met from mix_targets",
    "p5_found": _COUNTS + "select field, term, mark from m where mark is not null",
    "p5_counts": _COUNTS + "select field, term, records as occurrences, records, mark from m",
    "p5_text_terms": f"""with w as (select doc_id, row_number() over () as r, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as term from documents),
c as (select term, count(*) as occurrences, count(distinct r) as records from w group by 1)
select *, case when records < {RARE} then 'rare' when records > (select count(*) from documents) * {COMMON_SHARE} then 'common' end as mark from c""",
    "p6_found": f"""{USABLE},
pairs as (select a.vec_id, b.vec_id as neighbor_id, row_number() over (partition by a.vec_id order by round(list_dot_product(a.u, b.u), 12) desc, b.vec_id) as n, list_dot_product(a.u, b.u) as c from unit a join unit b on a.vec_id <> b.vec_id)
select vec_id, neighbor_id from pairs where n <= {K} and c >= {LEAST_COS}""",
    "p3_found": f"""{USABLE},
pairs as (select a.vec_id as v, b.vec_id as w from unit a join unit b on list_dot_product(a.u, b.u) >= {LEAST_COS}),
hoods as (select v, list(w order by w) as hood from pairs group by v),
same as (select hood, count(*) as n, min(v) as cluster_id from hoods group by hood)
select cluster_id, unnest(hood) as vec_id from same where n > 1 and n = len(hood)""",
}
