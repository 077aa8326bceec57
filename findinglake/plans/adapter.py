"""The finding model over the driver's tables: each function reads only the columns that its view needs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.datetime(2001, 8, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(key, values: list[str]):
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(key == i, v).otherwise(out)
    return out


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    k = F.col("o_orderkey")
    severity = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").when(F.col("o_orderpriority") == "5-LOW", "LOW").otherwise("INFO")
    )
    status = (
        F.when(k % 20 == 7, "REOPENED").when(k % 20 == 11, "FALSE_POSITIVE").when(k % 20 == 13, "ACCEPTED_RISK")
        .when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("RESOLVED")
    )
    rows = o.join(c, "o_custkey").select(
        k.alias("finding_id"),
        F.col("o_custkey").alias("repository_id"),
        F.col("c_nationkey").alias("project_id"),
        severity.alias("severity"),
        status.alias("status"),
        _choice(k % 4, ["CONFIRMED", "HIGH", "MEDIUM", "LOW"]).alias("confidence"),
        _choice(k % 7, ["PROVEN_DATAFLOW", "LIKELY", "POSSIBLE", "THEORETICAL"]).alias("exploitability"),
        _choice(k % 9, ["AI_SUGGESTED", "CONFIRMED", "FALSE_POSITIVE", "DETECTED"]).alias("verification"),
        F.col("o_orderdate").alias("first_seen_at"),
    )
    later = F.col("first_seen_at") + F.make_dt_interval((F.col("finding_id") % 90).cast("int"))
    return rows.withColumn("resolved_at", F.when(F.col("status") == "RESOLVED", later))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("vuln_class"))
    return li.join(p, "l_partkey").select(
        F.col("l_orderkey").alias("finding_id"),
        F.concat(F.lit("src/p"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py")).alias("path"),
        F.col("l_quantity").cast("int").alias("line"),
        "vuln_class",
        F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("scanner"),
        F.concat(F.lit("call( "), F.col("l_returnflag"), F.lit(" )  ")).alias("snippet"),
        F.col("l_shipdate").alias("seen_at"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    t = F.col("event_type")
    status = (
        F.when(t == "purchase", "COMPLETED").when(t == "error", "FAILED").when(t == "signup", "CANCELLED")
        .when(t == "click", "RUNNING").otherwise("QUEUED")
    )
    return e.select(
        F.col("event_id").alias("scan_id"), (F.col("user_id") % 25).alias("project_id"), F.col("ts").alias("finished_at"),
        F.col("value").alias("risk_index"), status.alias("status"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), F.col("lang").alias("language"), "source", F.col("n_chars").alias("size"), "text")


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("organization_id"), F.col("r_name").alias("name"))
    return r.withColumn("deleted_at", F.when(F.col("organization_id") == 3, F.lit(AS_OF)))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("organization_id")
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository_id"), F.col("c_name").alias("name"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lower(F.col("c_name")).alias("email"))
    return c.withColumn("deleted_at", F.when(F.col("user_id") % 17 == 0, F.lit(AS_OF)))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a member of the organization of their nation, and of that nation's project."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    role = _choice(F.col("c_custkey") % 5, ["OWNER", "ADMIN", "SECURITY_ANALYST", "DEVELOPER", "VIEWER"])
    rows = c.join(F.broadcast(projects(spark, sf_dir)), F.col("c_nationkey") == F.col("project_id"))
    return rows.select(F.col("c_custkey").alias("user_id"), "organization_id", "project_id", role.alias("role"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), F.col("event_id")
    return e.select(
        k.alias("event_id"), F.when(k % 3 != 0, k % 5).alias("organization_id"), F.col("user_id").alias("actor_user_id"),
        F.when(k % 2 == 0, "user").otherwise("scan").alias("target_type"), (k % 1500).cast("string").alias("target_id"),
        F.concat("event_type", F.lit(".done")).alias("action"), F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("outcome"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor_label"), F.col("ts").alias("created_at"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences with their findings' severity and confidence, as reports of scanners about a line."""
    o = occurrences(spark, sf_dir).join(findings(spark, sf_dir).select("finding_id", "severity", "confidence", "exploitability"), "finding_id")
    return o.select(
        F.concat_ws("|", "path", F.col("line").cast("string"), "vuln_class").alias("group_id"), F.concat_ws("-", "scanner", F.col("finding_id").cast("string")).alias("ord"),
        F.concat("scanner", F.lit(":"), F.col("finding_id").cast("string")).alias("rule_id"), F.col("vuln_class").alias("title"), "vuln_class", "path", "line",
        (F.col("finding_id") % 11 == 0).alias("has_flow"), (F.col("finding_id") % 6 == 0).alias("ai"), (F.col("scanner") == "s0").alias("own"),
        "severity", "confidence", "exploitability", F.array("scanner").alias("scanners"),
        F.array(F.concat(F.lit("CWE-"), (F.col("finding_id") % 3).cast("string")), F.concat(F.lit("CWE-"), (F.col("finding_id") % 5).cast("string"))).alias("cwe"),
    )
