"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import compression, fingerprints, licenses, mixing, packing, pii, simhash, toolcalls, toxicity, urls
from corvane.llm.sql import ORACLES
from corvane.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def dated_list(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of the pages, as the tables hold no list: a hash of the host chooses its list and dates.

    A third of the hosts are listed for blocking, a sixth for allowing; half of the entries are removed again later, and
    some of these come back. Entries of hosts with a subdomain also name the parent domain.
    """
    found = pages.select(urls.host(F.col("url")).alias("host")).filter("host is not null").distinct()
    named = found.select(F.explode(urls.suffixes(F.col("host"))).alias("domain")).distinct()
    digest = F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("int")
    rows = named.select("domain", digest.alias("d")).filter("d % 6 < 3")
    day = lambda n: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast({n} as int))")
    turns = F.array(
        F.struct(F.lit("add").alias("action"), day("d % 200").alias("dated"), F.lit(True).alias("used")),
        F.struct(F.lit("remove").alias("action"), day("d % 200 + 30 + d % 70").alias("dated"), (F.col("d") % 4 < 2).alias("used")),
        F.struct(F.lit("add").alias("action"), day("d % 200 + 130 + d % 70").alias("dated"), (F.col("d") % 4 < 1).alias("used")),
    )
    kind = F.when(F.col("d") % 6 < 2, "block").otherwise("allow")
    return rows.select(F.concat(F.lit("list-"), F.col("d") % 3).alias("list"), kind.alias("kind"), "domain", F.explode(F.filter(turns, lambda t: t["used"])).alias("t")).select("list", "kind", "domain", "t.action", "t.dated")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture; the table holds no fetch time, so the id sets it: a day of 2024."""
    pages = _table(spark, sf_dir, "pages")
    fetched = F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast(page_id * 37 % 366 as int))")
    return urls.evaluate(pages.select("page_id", "url", fetched.alias("fetched_at")), dated_list(pages))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumn("findings", F.to_json("findings"))


def op6_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def tool_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of conversations, as the table holds none.

    An assistant's turn is a call named by a hash of its text, its arguments are the whole text and figures,
    with faults in some; a third of the calls wait for the one before. The turn after it is its result.
    """
    d = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 6), 16, 10).cast("int")
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), d.alias("d"))
    identifier = lambda shift: F.concat(F.lit("call_"), (F.col("turn") + shift).cast("string"))
    query = toolcalls.quoted(F.col("text"))
    arguments = (
        F.when(F.col("d") % 11 == 0, F.concat(F.lit('{"query":'), query))
        .when(F.col("d") % 7 == 0, F.concat(F.lit('{"limit": "many", "query": '), query, F.lit("}")))
        .when(F.col("d") % 5 == 0, F.concat(F.lit('{"limit": '), (F.col("d") % 50).cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"query": '), query, F.lit(', "limit": '), (F.col("d") % 50).cast("string"), F.lit(', "deep": {"b": [1, true], "a": null}}')))
    )
    name = F.get(F.array(*map(F.lit, ("search", "lookup", "other"))), F.col("d") % 3)
    after = F.when(F.col("d") % 3 == 0, F.array(identifier(-2))).otherwise(F.array().cast("array<string>"))
    calls = turns.filter("role = 'assistant'").select("conv_id", identifier(0).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = turns.filter("role = 'user' and turn > 0").select("conv_id", identifier(-1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


SCHEMAS = [(n, *f) for n, deep in (("search", True), ("lookup", False)) for f in (("query", "STRING", True), ("limit", "BIGINT", False), *([("deep", "OBJECT", False)] if deep else []))]


def op8_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls(_table(spark, sf_dir, "conversations"))
    fields = ", ".join(f"('{n}', '{f}', '{t}', {str(r).lower()})" for n, f, t, r in SCHEMAS)
    schemas = spark.sql(f"SELECT * FROM VALUES {fields} AS t(name, field, type, required)")
    return toolcalls.link(calls, results, schemas)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_urls, op3_mixing, op4_packing, op5_licenses, op6_compression, op7_toxicity, op8_toolcalls, op9_pii, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
