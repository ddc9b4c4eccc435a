"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import alignment, exact, hidden, jaccard, language, mixing, neighbours, packing, personal, quality, ranking, repeats, simhash
from evidentia.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def held_out(folds: int, aside: int):
    return F.coalesce(fold("doc_id", folds) == aside, F.lit(False))


def op1_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, root, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, root, "documents"))


def op3_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact.exact_groups(table(spark, root, "documents")).drop("row")


def quality_model(spark: SparkSession, root: str) -> quality.Model:
    """Learned from the labelled documents outside the held-out fold."""
    # of several labels the highest counts; a null one says nothing
    labels = table(spark, root, "labels").filter(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality is not null")
    return quality.train(table(spark, root, "documents"), labels=labels)


def op4_quality(spark: SparkSession, root: str) -> DataFrame:
    rows = quality.quality_scores(table(spark, root, "documents"), quality_model(spark, root), keep=(held_out(5, 0).alias("held_out"),))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"))


def op6_language_model(spark: SparkSession, root: str) -> DataFrame:
    rows = hidden.language_scores(table(spark, root, "documents"), fold("doc_id", 10) != 0)
    return rows.drop("learn").withColumn("held_out", held_out(10, 0))


def op7_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.nearest(table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_personal(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    rows = personal.personal_spans(docs, personal.train(docs))
    place = {k: i for i, k in enumerate(personal.KINDS)}
    order = lambda s: F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    named = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    # a second parameter of the function would be the element's index
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in personal.KINDS]
    both = named(F.concat("base", "added"))
    return rows.select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), both.alias("spans"), F.size("added").cast("long").alias("n_added"))


def op10_language(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    model = language.train(docs.filter(fold("doc_id", 4) != 2))
    return language.identify(docs, model, keep=(held_out(4, 2).alias("held_out"),))


def op11_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, root, "documents"))


def op12_token_alignment(spark: SparkSession, root: str) -> DataFrame:
    return alignment.aligned(table(spark, root, "documents"))


def op13_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return ranking.ranked(table(spark, root, "documents"), table(spark, root, "benchmark"))


EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

RANKED_SQL = r"""
WITH term_of AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_no, doc_id, terms, len(terms)::BIGINT AS n FROM term_of WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
held AS (
  SELECT row_no, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row_no, doc_id, n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, total GROUP BY term, docs),
scored AS (
  SELECT item_id, row_no, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM held JOIN weight USING (term) JOIN wanted USING (term), total GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row_no)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_jaccard_join, op3_exact_dedup, op4_quality, op5_packing, op6_language_model, op7_mixing,
        op8_neighbours, op9_personal, op10_language, op11_simhash, op12_token_alignment, op13_ranked_search,
    )
}
SQL: dict[str, str] = {"op3_exact_dedup": EXACT_SQL, "op13_ranked_search": RANKED_SQL}
