"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillok.functions.urls import canonical_url
from sillok.llm import abuse, encode, lookalike, mixing, names, neardup, residue
from sillok.llm.history import HistoryIndex
from sillok.plans.reference_queries import CANONICAL
from sillok.session import give_back, scratch_path, stored, table

#: What TESTDATA.md calls alike.
POSTINGS_ALIKE = neardup.Likeness(shingle=3, threshold=0.6)
LEAST_WORDS = 40


def posting_texts(job: DataFrame) -> DataFrame:
    """``id, text`` of the postings with a long enough description."""
    long_enough = F.size(neardup.words(F.coalesce("description", F.lit("")))) >= LEAST_WORDS
    return job.filter(long_enough).select(F.col("ordinal").alias("id"), neardup.plain_text("title", "company", "description").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(posting_texts(table(spark, sf_dir, "job")), POSTINGS_ALIKE)
    pairs = neardup.expand_pairs(found.links, found.copies)
    return pairs.select(F.col("id_a").alias("ordinal_a"), F.col("id_b").alias("ordinal_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a posting text: its class of equal texts and the number of classes that are alike."""
    rows = posting_texts(table(spark, sf_dir, "job"))
    found = neardup.classes(rows, neardup.near_duplicates(rows, POSTINGS_ALIKE))
    return found.select(F.col("id").alias("ordinal"), F.col("rep").alias("class_ordinal"), "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = table(spark, sf_dir, "companies_3").select(F.lit("companies_3").alias("src"), F.col("id").alias("rec_key"), F.array("verification.title").alias("texts"))
    live = table(spark, sf_dir, "integration_live").select(F.lit("integration_live").alias("src"), F.col("acq_no").cast("string").alias("rec_key"), F.col("diagnostics").alias("texts"))
    job = table(spark, sf_dir, "job").select(F.lit("job").alias("src"), F.col("ordinal").cast("string").alias("rec_key"), F.array("description").alias("texts"))
    return residue.with_residue(companies.unionByName(live).unionByName(job), "texts", "src", "rec_key").select("src", "rec_key")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older three quarters of the collection runs are taken in at once as history; every later run is a batch of its own, checked against the index of all before it."""
    job = table(spark, sf_dir, "job")
    long_enough = F.size(neardup.words(F.coalesce("description", F.lit("")))) >= LEAST_WORDS
    rows = job.select(
        F.col("ordinal").alias("id"), "batch_no", canonical_url(F.col("url")).alias("address"),
        F.when(long_enough, neardup.plain_text("title", "company", "description")).alias("text"),
    )
    index = HistoryIndex(spark, scratch_path(spark, "history"), POSTINGS_ALIKE)
    runs = [r["batch_no"] for r in job.groupBy("batch_no").agg(F.min("ordinal").alias("first")).orderBy("first").collect()]  # one row a run
    old, new = runs[: 3 * len(runs) // 4], runs[3 * len(runs) // 4 :]
    for batch in [old] * bool(old) + [[run] for run in new]:
        index.add_batch(rows.filter(F.col("batch_no").isin([r for r in batch if r is not None]) | (F.col("batch_no").isNull() & F.lit(None in batch))))
        give_back(spark)
    found = index.cases() if index.batches else spark.createDataFrame([], "id_a long, id_b long")
    return found.select(F.col("id_a").alias("ordinal_a"), F.col("id_b").alias("ordinal_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = table(spark, sf_dir, "companies_2").select(F.lit("companies_2").alias("src"), F.col("id").alias("rec_key"), F.col("name_ko").alias("text"))
    job = table(spark, sf_dir, "job").select(F.lit("job").alias("src"), F.col("ordinal").cast("string").alias("rec_key"), F.col("title").alias("text"))
    return lookalike.not_plain(companies.unionByName(job), "text").drop("text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue, others = table(spark, sf_dir, "companies_2"), table(spark, sf_dir, "companies_3")
    fields = ("id", "name_ko", "name_en", "aliases", "homepage")
    listed, unlisted = ([tuple(r) for r in t.select(*fields).limit(names.CATALOGUE_ROWS + 1).collect()] for t in (catalogue, others))  # the build refuses more
    model = names.build_model(listed, unlisted)
    own = [("companies_2", row, entity) for row, entity in sorted(model.entity.items()) if row != entity]
    job = table(spark, sf_dir, "job").select("ordinal", "company").filter("company IS NOT NULL")
    linked = names.link_names(model, job.groupBy("company").agg(F.count(F.lit(1)).alias("uses")), "company")
    stated = spark.createDataFrame([(n, e) for e, spelled in sorted(model.stated.items()) for n in sorted(spelled)], "company string, entity string")
    variants = linked.join(stated, ["company", "entity"], "left_anti")
    found = job.join(variants, "company").select(F.lit("job").alias("src"), F.col("ordinal").cast("string").alias("rec_key"), F.col("entity").alias("entity_id"))
    return found.unionByName(spark.createDataFrame(own, "src string, rec_key string, entity_id string"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode.token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return stored(docs.select("doc_id", "source", "tokens"), scratch_path(spark, "sizes"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_target")
    return mixing.shares(mixing.plan(sizes.select("source", "tokens"), targets), sizes, targets)


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_target")
    return mixing.mix(sizes, mixing.plan(sizes.select("source", "tokens"), targets), "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_label"), "doc_id", "text", abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_label"), "doc_id", "text")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = p9_found(spark, sf_dir).withColumn("bad", F.lit(1))
    rated = docs.select("doc_id", "source").join(found, "doc_id", "left")
    return rated.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("bad", F.lit(0))).alias("abusive")).withColumn("rate", F.col("abusive") / F.col("documents"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p6_found": p6_found, "p7_ids": p7_ids, "p8_shares": p8_shares, "p8_documents": p8_documents, "p3_found": p3_found, "p5_found": p5_found, "p2_found": p2_found, "p2_classes": p2_classes, "p4_found": p4_found}
#: Every pair by brute force over the shared runs of three words.
_PAIRS = """
w AS (SELECT ordinal, list_filter(regexp_split_to_array(coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(description, ''), '[ \\t\\n]+'), lambda x: x <> '') AS w
  FROM job WHERE len(list_filter(regexp_split_to_array(coalesce(description, ''), '[ \\t\\n]+'), lambda x: x <> '')) >= 40),
s AS (SELECT DISTINCT ordinal, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT ordinal, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
n AS (SELECT ordinal, count(*) AS n FROM s GROUP BY ordinal),
c AS (SELECT a.ordinal AS ordinal_a, b.ordinal AS ordinal_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.ordinal < b.ordinal GROUP BY ALL),
pairs AS (SELECT ordinal_a, ordinal_b FROM c JOIN n a ON a.ordinal = ordinal_a JOIN n b ON b.ordinal = ordinal_b WHERE k >= 0.6 * (a.n + b.n - k))"""
#: First-come acceptance, row after row: a row is a case if an earlier row it repeats was accepted.
_ARRIVALS = """
u AS (SELECT ordinal, {address} AS url FROM job WHERE url IS NOT NULL AND url <> ''),
repeats AS MATERIALIZED (SELECT ordinal_a, ordinal_b FROM pairs UNION SELECT a.ordinal, b.ordinal FROM u a JOIN u b ON a.url = b.url AND a.ordinal < b.ordinal),
todo AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ordinal_b) AS i, ordinal_b, list(ordinal_a ORDER BY ordinal_a) AS before FROM repeats GROUP BY ordinal_b),
state AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS cases, NULL::BIGINT AS ordinal_a, NULL::BIGINT AS ordinal_b
  UNION ALL SELECT t.i, CASE WHEN len(list_filter(t.before, lambda x: NOT list_contains(s.cases, x))) > 0 THEN list_append(s.cases, t.ordinal_b) ELSE s.cases END,
    list_filter(t.before, lambda x: NOT list_contains(s.cases, x))[1], t.ordinal_b FROM state s JOIN todo t ON t.i = s.i + 1)
SELECT ordinal_a, ordinal_b FROM state WHERE ordinal_a IS NOT NULL"""
ORACLES: dict[str, str] = {
    "p2_found": f"WITH {_PAIRS} SELECT ordinal_a, ordinal_b FROM pairs",
    "p2_classes": f"""WITH {_PAIRS}, k AS (SELECT ordinal, min(ordinal) OVER (PARTITION BY w) AS class_ordinal FROM w),
l AS (SELECT DISTINCT a.class_ordinal AS a, b.class_ordinal AS b FROM pairs JOIN k a ON a.ordinal = ordinal_a JOIN k b ON b.ordinal = ordinal_b WHERE a.class_ordinal <> b.class_ordinal),
e AS (SELECT c, count(DISTINCT d) AS links FROM (SELECT a AS c, b AS d FROM l UNION SELECT b, a FROM l) GROUP BY c)
SELECT ordinal, class_ordinal, coalesce(links, 0) AS links FROM k LEFT JOIN e ON c = class_ordinal""",
    "p4_found": f"WITH RECURSIVE {_PAIRS}, " + _ARRIVALS.replace("{address} AS url FROM job WHERE url IS NOT NULL AND url <> ''", "url FROM (" + CANONICAL + ")"),
}
