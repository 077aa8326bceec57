"""The catalogue of classes of weaknesses: a small nested dimension that findings are described by.

An entry has a key, a name, an engine, CWEs, OWASP categories, a severity, texts, examples by language (insecure and
secure code) and references.  Entries come as JSON texts, one each; the join with findings is left to AQE, which knows
the catalogue's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findinglake.domain import SEVERITIES

_ENTRY = (
    "struct<key:string,name:string,engine:string,cwe:array<string>,owasp:array<string>,severity:string,description:string,impact:string,recommendation:string,"
    "remediation:string,examples:map<string,struct<vulnerable:string,secure:string>>,references:array<string>>"
)
# Languages whose examples are those of another one.
_LIKE = {"typescript": "javascript", "tsx": "javascript"}


def catalog(texts: DataFrame) -> DataFrame:
    """Entries of texts (json: an entry), one row for each key: of several entries of a key the first by its JSON.

    Texts that aren't entries, and entries without key or name, go.  The engine is APPSEC and the severity MEDIUM unless
    the entry names known ones; white space runs in description, impact and recommendation become one space; missing
    lists are empty, missing texts too.
    """
    rows = texts.select("json", F.from_json("json", _ENTRY).alias("e")).where("e.key is not null and e.name is not null")
    first = rows.groupBy("e.key").agg(F.min_by("json", "json").alias("json")).select(F.from_json("json", _ENTRY).alias("e")).select("e.*")
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    none = F.array().cast("array<string>")
    return first.select(
        "key", "name", F.when(F.col("engine") == "AISEC", "AISEC").otherwise("APPSEC").alias("engine"), F.coalesce("cwe", none).alias("cwe"), F.coalesce("owasp", none).alias("owasp"),
        F.when(F.col("severity").isin(SEVERITIES), F.col("severity")).otherwise("MEDIUM").alias("severity"), flat("description").alias("description"), flat("impact").alias("impact"),
        flat("recommendation").alias("recommendation"), F.coalesce("remediation", F.lit("")).alias("remediation"), "examples", F.coalesce("references", none).alias("references"),
        F.when(F.col("engine") == "AISEC", "AI Security").otherwise("Application Security").alias("category"),
    )


def example(examples: Column, language: Column) -> Column:
    """language, insecure and secure of the example in a language, or the first there is; null if there is none."""
    own = language
    for a, b in _LIKE.items():
        own = F.when(language == a, b).otherwise(own)
    entries = F.map_entries(examples)
    same = F.get(F.filter(entries, lambda e: e["key"] == own), F.lit(0))
    e = F.coalesce(same, F.get(entries, F.lit(0)))
    return F.when(e.isNotNull(), F.struct(e["key"].alias("language"), F.coalesce(e["value"]["vulnerable"], F.lit("")).alias("insecure"), F.coalesce(e["value"]["secure"], F.lit("")).alias("secure")))


def described(findings: DataFrame, classes: DataFrame) -> DataFrame:
    """findings with what the catalogue says of their class: class_name, category, root_cause, impact, prevention,
    class_cwe, class_references, example and secure_pattern, the remediation with the example's two codes.

    findings: vuln_class and language.  A class that isn't in the catalogue has nulls; columns called like a result are
    replaced.
    """
    made = ["class_name", "category", "root_cause", "impact", "prevention", "class_cwe", "class_references", "example", "secure_pattern"]
    c = classes.select(
        F.col("key").alias("_key"), F.col("name").alias("class_name"), "category", F.col("description").alias("root_cause"), "impact", F.col("recommendation").alias("prevention"),
        F.col("cwe").alias("class_cwe"), F.col("references").alias("class_references"), "remediation", "examples",
    )
    keep = [x for x in findings.columns if x not in made]
    rows = findings.select(*keep).join(c, F.col("vuln_class") == F.col("_key"), "left").withColumn("example", example(F.col("examples"), F.coalesce("language", F.lit(""))))
    codes = F.concat("remediation", F.lit("\n\nInstead of:\n    "), F.col("example.insecure"), F.lit("\n\nwrite:\n    "), F.col("example.secure"))
    return rows.withColumn("secure_pattern", F.coalesce(codes, "remediation")).select(*keep, *made)
