"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import bloom, bpe, packing, quantiles, sentences
from stratalog.session import new_path, settle, table

PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _seen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return bloom.seen_before(table(spark, d, "index_entry"), table(spark, d, "sstable_entry"), "entry_key", "entry_key", "entry_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose key was indexed or written before."""
    return _seen(spark, d)[0]


def p1_error_report(spark: SparkSession, d: str) -> DataFrame:
    """How often the chains answered wrongly, beside their bound."""
    return _seen(spark, d)[1]


def p1_error_check(spark: SparkSession, d: str) -> DataFrame:
    """Keys that were new, by the chains' answers and their correction, and whether the measured rate keeps to the bound."""
    return p1_error_report(spark, d).select((F.col("wrong") + F.col("unseen")).alias("new_keys"), (F.col("measured_error") <= F.col("error_bound")).alias("within_bound"))


def p1_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """The history and the older half of the records, then the rest by the chains that were kept: together what one run finds."""
    history, records = table(spark, d, "index_entry"), table(spark, d, "sstable_entry")
    half = records.agg(F.expr("percentile_approx(entry_id, 0.5, 1000)").alias("n")).first()["n"]
    older, newer = records.where(F.col("entry_id") <= half), records.where(F.col("entry_id") > half)
    store = bloom.ChainStore(spark, new_path(spark, "chains"))
    first, _ = bloom.seen_before(history, older, "entry_key", "entry_key", "entry_id", store=store)
    earlier = history.select(F.col("entry_key").alias("k")).unionByName(older.select(F.col("entry_key").alias("k")))
    second, _ = bloom.seen_before(None, newer, "entry_key", "entry_key", "entry_id", store=store, earlier=earlier)
    return first.unionByName(second)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of amount per region and category, combined from sketches of single days."""
    groups = ["region", "category"]
    days = quantiles.daily_sketches(table(spark, d, "sales_transactions"), "amount", groups, "created_at", "id")
    return quantiles.read_quantiles(quantiles.combine(days, groups), groups, PERCENTILES)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the combined sketches know exactly: count, lowest and highest finite amount."""
    return p3_percentiles(spark, d).select("region", "category", "n", "lowest", "highest")


def p3_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Does every percentile of every group lie within its rank error? Ranks are counted exactly."""
    found = p3_percentiles(spark, d).withColumnsRenamed({"region": "_region", "category": "_category"})
    rows = table(spark, d, "sales_transactions").select("id", "region", "category", "amount", "created_at").where("amount IS NOT NULL AND NOT isnan(amount) AND abs(amount) <> double('infinity')").distinct()
    both = rows.join(found, F.col("region").eqNullSafe(F.col("_region")) & F.col("category").eqNullSafe(F.col("_category")))
    share = lambda c: F.count(F.when(c, 1)) / F.count("*")
    ranks = both.groupBy("region", "category").agg(F.max("rank_error").alias("e"), F.max("n").alias("n"), *(share(F.col("amount") < F.col(p)).alias(f"below_{p}") for p in PERCENTILES), *(share(F.col("amount") <= F.col(p)).alias(f"to_{p}") for p in PERCENTILES))
    # a value of many ties has many ranks; one of a group without compaction is off by its own row at most
    tests = [(F.col(f"below_{p}") <= q + F.col("e") + 1e-9) & (F.col(f"to_{p}") >= q - F.col("e") - 1e-9) for p, q in PERCENTILES.items()]
    within = tests[0]
    for t in tests[1:]:
        within = within & t
    return ranks.select("region", "category", "n", within.alias("within"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str, sizes: DataFrame | None = None) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(bpe.token_counts(docs) if sizes is None else sizes, table(spark, d, "pack_capacity"), packing.shard_count(docs))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container for each capacity."""
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(settle(_packed(spark, d), "packed"))


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """Is each document whole in the containers of each capacity, and cut only if it exceeds the capacity?"""
    sizes = settle(bpe.token_counts(table(spark, d, "documents")), "sizes")
    parts = _packed(spark, d, sizes).groupBy("doc_id", "capacity_id", "capacity_tokens").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("held"), F.max("token_end").alias("reach"), F.count("*").alias("parts"))
    whole = (F.col("held") == F.col("tokens")) & (F.col("reach") == F.col("tokens")) & (F.col("parts") == F.greatest(F.ceil(F.col("tokens") / F.col("capacity_tokens")), F.lit(1)))
    return parts.join(sizes, "doc_id").select("doc_id", "capacity_id", whole.alias("whole"))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Containers over their capacity, and whether less than a tenth of the space is unused (a small corpus leaves a few containers open)."""
    fill = p8_fill(spark, d)
    return fill.select("capacity_id", (F.col("fullest") > F.col("capacity_tokens")).alias("overfull"), ((F.col("fill") > 0.9) | (F.col("containers") < 20)).alias("well_filled"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every commit message."""
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_error_report, p1_error_check, p1_two_runs, p3_percentiles, p3_counts, p3_within_bound, p7_ids, p8_packed, p8_fill, p8_covered, p8_limits, p9_found)}

_SEEN = """WITH r AS (SELECT DISTINCT entry_id, entry_key FROM sstable_entry WHERE entry_key IS NOT NULL),
f AS (SELECT entry_key, min(entry_id) AS first_id FROM r GROUP BY entry_key)
SELECT DISTINCT r.entry_id FROM r JOIN f USING (entry_key) WHERE r.entry_id > f.first_id OR r.entry_key IN (SELECT entry_key FROM index_entry WHERE entry_key IS NOT NULL)"""

SQL = {
    "p1_found": _SEEN,
    "p1_two_runs": _SEEN,
    "p1_error_check": """SELECT count(DISTINCT entry_key) AS new_keys, TRUE AS within_bound FROM sstable_entry
WHERE entry_key NOT IN (SELECT entry_key FROM index_entry WHERE entry_key IS NOT NULL)""",
    "p3_counts": """SELECT region, category, count(*) AS n, min(amount) AS lowest, max(amount) AS highest
FROM (SELECT DISTINCT id, region, category, amount, created_at FROM sales_transactions WHERE isfinite(amount)) GROUP BY region, category""",
    "p3_within_bound": """SELECT region, category, count(*) AS n, TRUE AS within
FROM (SELECT DISTINCT id, region, category, amount, created_at FROM sales_transactions WHERE isfinite(amount)) GROUP BY region, category""",
    "p8_covered": "SELECT doc_id, capacity_id, TRUE AS whole FROM documents CROSS JOIN pack_capacity",
    "p8_limits": "SELECT capacity_id, FALSE AS overfull, TRUE AS well_filled FROM pack_capacity",
}
