"""Output of other analysers as findings: Bandit, Semgrep and Gitleaks JSON, and OSV advisories.

Each row of the input is one tool's report as text; its results are exploded, so a report may be of any size that one
text can have.  Text that isn't such a report, and a null one, give no rows.  Missing fields are null or take the
defaults named below; repeated reports give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findinglake.functions.columns import lookup, package_name
from findinglake.operators.secrets import redact
from findinglake.operators.versions import advisory_severity, describe_ranges

# Classes of weaknesses by CWE.
CWE_CLASSES = {
    "CWE-22": "path_traversal", "CWE-23": "path_traversal", "CWE-36": "path_traversal", "CWE-73": "path_traversal", "CWE-77": "command_injection",
    "CWE-78": "command_injection", "CWE-79": "xss", "CWE-80": "xss", "CWE-83": "xss", "CWE-88": "command_injection", "CWE-89": "sql_injection",
    "CWE-90": "ldap_injection", "CWE-94": "code_injection", "CWE-95": "code_injection", "CWE-98": "file_inclusion", "CWE-120": "buffer_overflow",
    "CWE-121": "buffer_overflow", "CWE-122": "buffer_overflow", "CWE-125": "out_of_bounds", "CWE-129": "out_of_bounds", "CWE-134": "format_string",
    "CWE-190": "integer_overflow", "CWE-200": "sensitive_data_exposure", "CWE-209": "dangerous_api", "CWE-256": "insecure_authentication",
    "CWE-259": "hardcoded_secret", "CWE-285": "broken_authorization", "CWE-287": "insecure_authentication", "CWE-295": "insecure_tls",
    "CWE-297": "insecure_tls", "CWE-319": "insecure_tls", "CWE-321": "hardcoded_secret", "CWE-326": "weak_cryptography",
    "CWE-327": "weak_cryptography", "CWE-328": "weak_cryptography", "CWE-330": "weak_randomness", "CWE-338": "weak_randomness",
    "CWE-347": "insecure_authentication", "CWE-352": "missing_csrf_protection", "CWE-362": "race_condition", "CWE-367": "race_condition",
    "CWE-377": "unsafe_file_handling", "CWE-415": "double_free", "CWE-416": "use_after_free", "CWE-434": "unsafe_file_handling",
    "CWE-489": "dangerous_api", "CWE-502": "insecure_deserialization", "CWE-564": "sql_injection", "CWE-601": "open_redirect", "CWE-611": "xxe",
    "CWE-614": "insecure_authentication", "CWE-639": "broken_authorization", "CWE-643": "xpath_injection", "CWE-676": "dangerous_api",
    "CWE-680": "integer_overflow", "CWE-732": "unsafe_file_handling", "CWE-776": "xxe", "CWE-787": "out_of_bounds", "CWE-798": "hardcoded_secret",
    "CWE-862": "broken_authorization", "CWE-863": "broken_authorization", "CWE-916": "weak_cryptography", "CWE-917": "expression_injection",
    "CWE-918": "ssrf", "CWE-942": "dangerous_api", "CWE-943": "nosql_injection", "CWE-1004": "insecure_authentication",
    "CWE-1321": "prototype_pollution", "CWE-1333": "redos", "CWE-1336": "template_injection", "CWE-1395": "vulnerable_dependency",
    "CWE-1426": "llm_output_handling", "CWE-1427": "prompt_injection",
}
# Classes of weaknesses by Bandit test.
BANDIT_CLASSES = {
    "B102": "code_injection", "B103": "unsafe_file_handling", "B104": "dangerous_api", "B105": "hardcoded_secret", "B106": "hardcoded_secret",
    "B107": "hardcoded_secret", "B108": "unsafe_file_handling", "B201": "dangerous_api", "B301": "insecure_deserialization",
    "B302": "insecure_deserialization", "B303": "weak_cryptography", "B304": "weak_cryptography", "B305": "weak_cryptography",
    "B306": "unsafe_file_handling", "B307": "code_injection", "B308": "xss", "B310": "ssrf", "B311": "weak_randomness", "B312": "insecure_tls",
    "B313": "xxe", "B314": "xxe", "B315": "xxe", "B316": "xxe", "B317": "xxe", "B318": "xxe", "B319": "xxe", "B320": "xxe", "B321": "insecure_tls",
    "B323": "insecure_tls", "B324": "weak_cryptography", "B501": "insecure_tls", "B502": "insecure_tls", "B503": "insecure_tls",
    "B504": "insecure_tls", "B505": "weak_cryptography", "B506": "insecure_deserialization", "B507": "insecure_tls", "B601": "command_injection",
    "B602": "command_injection", "B604": "command_injection", "B605": "command_injection", "B608": "sql_injection", "B609": "command_injection",
    "B610": "sql_injection", "B611": "sql_injection", "B612": "dangerous_api", "B613": "dangerous_api", "B614": "insecure_deserialization",
    "B615": "ai_supply_chain", "B701": "xss", "B702": "xss", "B703": "xss", "B704": "xss",
}
# Severities and confidences by the tools' names for them; others are MEDIUM.
SEVERITY_NAMES = {"HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW", "ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW", "CRITICAL": "CRITICAL"}
CONFIDENCE_NAMES = {"HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW"}
OTHER_CLASS = "dangerous_api"



def cwe_name(value: Column) -> Column:
    """CWE-n from a text that holds it, or from a bare number; else null."""
    number = F.regexp_extract(value, r"(?i)CWE-(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("CWE-"), number)).when(value.rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), value))


def class_of(cwes: Column, default: str = OTHER_CLASS) -> Column:
    """The class of the first CWE in a list that has one."""
    table = F.create_map(*(F.lit(x) for kv in CWE_CLASSES.items() for x in kv))
    known = F.filter(F.transform(cwes, lambda c: F.element_at(table, c)), lambda c: c.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit(default))


def _relative(path: Column) -> Column:
    return F.regexp_replace(path, "^[./]+", "")


def _normal(rows: DataFrame, tool: str, catalog: DataFrame | None) -> DataFrame:
    """rule_id with the tool's name, snippet and message with secrets masked, fixed exploitability, and CWEs with those of the class; classes that the catalog
    (vuln_class, class_cwe; small) doesn't know are `dangerous_api`."""
    rows = rows.withColumns({
        "rule_id": F.concat(F.lit(f"{tool}:"), "rule_id"), "exploitability": F.lit("THEORETICAL"), "scanners": F.array(F.lit(tool)),
        "snippet": redact(F.substring(F.trim(F.coalesce("snippet", F.lit(""))), 1, 300), F.col("path")),
        "message": redact(F.coalesce("message", F.lit("")), F.col("path")),
    })
    if catalog is None:
        return rows
    known = catalog.select(F.col("vuln_class").alias("_c"), "class_cwe")  # joined by its size, which AQE knows
    rows = rows.join(known.select("_c"), F.col("vuln_class") == F.col("_c"), "left").withColumn("vuln_class", F.coalesce("_c", F.lit(OTHER_CLASS))).drop("_c")
    rows = rows.join(known, F.col("vuln_class") == F.col("_c"), "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("cwe", F.array_distinct(F.concat("cwe", F.coalesce("class_cwe", none)))).drop("_c", "class_cwe")


def bandit(reports: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Findings of Bandit reports (report_id, json)."""
    item = (
        "struct<test_id:string,test_name:string,issue_text:string,issue_severity:string,issue_confidence:string,issue_cwe:struct<id:string>,"
        "filename:string,line_number:int,col_offset:int,code:string>"
    )
    rows = reports.select("report_id", F.explode(F.from_json("json", f"struct<results:array<{item}>>")["results"]).alias("x")).select("report_id", "x.*")
    cwe = F.array_compact(F.array(cwe_name(F.col("issue_cwe.id"))))
    lines = F.filter(F.split(F.coalesce("code", F.lit("")), "\n"), lambda x: x != "")
    own = F.filter(lines, lambda x: F.split_part(x, F.lit(" "), F.lit(1)) == F.col("line_number").cast("string"))
    line = F.coalesce(F.get(F.transform(own, lambda x: F.regexp_replace(x, "^[0-9]+ ?", "")), F.lit(0)), F.get(lines, F.lit(0)))
    test = F.coalesce("test_id", F.lit(""))
    rows = rows.select(
        "report_id", test.alias("rule_id"), F.coalesce(lookup(test, BANDIT_CLASSES, None).cast("string"), class_of(cwe)).alias("vuln_class"),
        F.concat(F.coalesce("test_name", test), F.lit(" (Bandit "), test, F.lit(")")).alias("title"),
        lookup(F.col("issue_severity"), SEVERITY_NAMES, "MEDIUM").alias("severity"),
        lookup(F.col("issue_confidence"), CONFIDENCE_NAMES, "MEDIUM").alias("confidence"), _relative(F.col("filename")).alias("path"),
        F.col("line_number").alias("line"), (F.coalesce("col_offset", F.lit(0)) + 1).alias("col"), line.alias("snippet"), cwe.alias("cwe"), F.col("issue_text").alias("message"),
    )
    return _normal(rows, "bandit", catalog)


def semgrep(reports: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Findings of Semgrep reports (report_id, json); a rule's `cwe` may be a text or a list."""
    item = (
        "struct<check_id:string,path:string,start:struct<line:int,col:int>,"
        "extra:struct<message:string,severity:string,lines:string,metadata:struct<cwe:string,confidence:string>>>"
    )
    rows = reports.select("report_id", F.explode(F.from_json("json", f"struct<results:array<{item}>>")["results"]).alias("x")).select("report_id", "x.*")
    raw = F.col("extra.metadata.cwe")  # a list arrives as its JSON text
    several = F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))
    cwe = F.array_compact(F.transform(F.when(raw.startswith("["), several).otherwise(F.array(raw)), cwe_name))
    rule = F.coalesce("check_id", F.lit("rule"))
    rows = rows.select(
        "report_id", rule.alias("rule_id"), class_of(cwe).alias("vuln_class"),
        F.replace(F.element_at(F.split(rule, "[.]"), -1), F.lit("-"), F.lit(" ")).alias("title"),
        lookup(F.upper(F.coalesce("extra.severity", F.lit("WARNING"))), SEVERITY_NAMES, "MEDIUM").alias("severity"),
        lookup(F.upper("extra.metadata.confidence"), CONFIDENCE_NAMES, "MEDIUM").alias("confidence"), _relative(F.col("path")).alias("path"),
        F.col("start.line").alias("line"), F.col("start.col").alias("col"), F.col("extra.lines").alias("snippet"), cwe.alias("cwe"), F.col("extra.message").alias("message"),
    )
    return _normal(rows, "semgrep", catalog)


def gitleaks(reports: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Findings of Gitleaks reports (report_id, json: a list); all are secrets of severity HIGH and confidence MEDIUM."""
    item = "struct<RuleID:string,Description:string,File:string,StartLine:int,StartColumn:int>"
    lists = reports.where(F.ltrim("json").startswith("["))  # an object would be read as a list of one
    rows = lists.select("report_id", F.explode(F.from_json("json", f"array<{item}>")).alias("x")).select("report_id", "x.*")
    rows = rows.select(
        "report_id", F.coalesce("RuleID", F.lit("secret")).alias("rule_id"), F.lit("hardcoded_secret").alias("vuln_class"),
        F.concat(F.lit("Hardcoded secret ("), F.coalesce(F.nullif("Description", F.lit("")), "RuleID", F.lit("None")), F.lit(")")).alias("title"),
        F.lit("HIGH").alias("severity"), F.lit("MEDIUM").alias("confidence"), _relative(F.col("File")).alias("path"),
        F.col("StartLine").alias("line"), F.col("StartColumn").alias("col"), F.lit(None).cast("string").alias("snippet"), F.array(F.lit("CWE-798")).alias("cwe"), F.col("Description").alias("message"),
    )
    return _normal(rows, "gitleaks", catalog)


_OSV = (
    "struct<id:string,aliases:array<string>,summary:string,details:string,withdrawn:string,published:string,modified:string,"
    "severity:array<struct<type:string,score:string>>,database_specific:struct<severity:string>,"
    "affected:array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,"
    "ranges:array<struct<type:string,events:array<map<string,string>>>>,"
    "database_specific:struct<severity:string>,ecosystem_specific:struct<severity:string>>>,references:array<struct<type:string,url:string>>>"
)


def osv_records(texts: DataFrame) -> DataFrame:
    """One row (column `record`) for each advisory of texts (json: one record or a list of them) that isn't withdrawn."""
    list_ = F.coalesce(F.from_json("json", f"array<{_OSV}>"), F.array(F.from_json("json", _OSV)))
    rows = texts.select(F.explode(F.when(F.ltrim("json").startswith("["), list_).otherwise(F.array(F.from_json("json", _OSV)))).alias("record"))
    return rows.where(F.col("record.id").isNotNull() & (F.coalesce("record.withdrawn", F.lit("")) == ""))


def osv_files(spark: SparkSession, folder: str) -> DataFrame:
    """osv_records of all *.json files below a folder; files that can't be parsed give none."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    return osv_records(files.select(F.col("value").alias("json")))


def osv_advisories(records: DataFrame) -> DataFrame:
    """One row for each package that an advisory affects: its ranges as text, fixed versions, severity and references.

    Entries of one package are taken together, in their order.  severity is that of the first valid CVSS v3 vector,
    else of the first known label (of the record, then of the entries), else MEDIUM.
    """
    e = records.select("record", F.posexplode("record.affected").alias("at", "entry"))
    e = e.withColumns({"ecosystem": F.col("entry.package.ecosystem"), "package": package_name(F.col("entry.package.ecosystem"), F.col("entry.package.name"))})
    told = describe_ranges(F.col("entry.ranges"))
    part = F.struct("at", told.alias("told"), F.col("entry.database_specific.severity").alias("db"), F.col("entry.ecosystem_specific.severity").alias("eco"))
    r = F.col("record")
    first = F.coalesce(F.nullif(r["summary"], F.lit("")), r["details"], F.lit(""))
    # A record's entries are in one text; they meet again by its id and the package.
    rows = e.select(
        r["id"].alias("advisory_id"), "ecosystem", "package", part.alias("part"), r["aliases"].alias("aliases"), r["severity"].alias("vectors"),
        F.substring(F.split_part(F.trim(first), F.lit("\n"), F.lit(1)), 1, 300).alias("summary"), r["database_specific"]["severity"].alias("label"),
        F.slice(F.filter(F.transform(r["references"], lambda x: x["url"]), lambda u: F.coalesce(u, F.lit("")) != ""), 1, 10).alias("references"),
    )
    plain = ["aliases", "vectors", "summary", "label", "references"]
    rows = rows.groupBy("advisory_id", "ecosystem", "package").agg(F.min_by(F.struct(*plain), "part.at").alias("x"), F.array_sort(F.collect_list("part")).alias("parts"))
    labels = F.concat(F.array("x.label"), F.transform("parts", lambda p: p["db"]), F.transform("parts", lambda p: p["eco"]))
    return rows.select(
        "advisory_id", "ecosystem", "package", F.coalesce("x.aliases", F.array().cast("array<string>")).alias("aliases"), F.col("x.summary").alias("summary"),
        F.array_distinct(F.flatten(F.transform("parts", lambda p: p["told"]["ranges"]))).alias("affected_ranges"),
        F.array_distinct(F.flatten(F.transform("parts", lambda p: p["told"]["fixed"]))).alias("fixed_versions"),
        advisory_severity(F.coalesce("x.vectors", F.array().cast("array<struct<type:string,score:string>>")), labels).alias("severity"),
        F.coalesce("x.references", F.array().cast("array<string>")).alias("references"),
    )
