"""Settings as rows: configuration files and risk weights, checked key by key; policies and weights that they give.

A document is JSON text (which is YAML as well) parsed to a variant once.  Nothing is dropped in silence: an unknown key
or a bad value is a row of path and message, and a document with any such row gives no policy and no weights.  All
rules are column expressions, so checking is one scan with no Python and, but for keeping the first problems of each
document, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findinglake.domain import ACTIVE, CONFIDENCES, SATURATION, SEVERITIES, UNKNOWN_WEIGHT, WEIGHTS
from findinglake.functions.columns import confidence_rank
from findinglake.operators.dashboard import first_in_groups

LONGEST = 256 * 1024  # fixed value: bytes of a configuration
SHOWN = 10  # fixed value: problems told for a document


@dataclass(frozen=True)
class Rule:
    """What the value at `path` (a section and a key, or a key alone) may be.

    kind: whole or number (low to high), weight (a number that isn't written as text or a truth value), flag, text,
    one (of values), some (a list of values), texts (a list of any texts).  upper: letters' case doesn't count.
    """

    path: str
    kind: str
    values: tuple[str, ...] = ()
    low: float = 0
    high: float | None = None
    null: bool = False
    upper: bool = False
    flags: bool = False  # a truth value stands for one of values, as YAML reads a bare on or off


# Sections and keys of a configuration file.
CONFIGURATION = (
    Rule("version", "whole", low=1, high=1),
    Rule("scan.scanners", "some", ("sast", "secrets", "dependencies")),
    Rule("scan.exclude", "texts"),
    Rule("scan.external", "one", ("auto", "off"), flags=True),
    Rule("scan.max_file_kb", "whole", low=1, high=102400),
    Rule("dependencies.source", "one", ("osv", "offline", "none")),
    Rule("dependencies.offline_db", "text", null=True),
    Rule("gate.fail_on", "some", tuple(reversed(SEVERITIES)), upper=True),
    Rule("gate.min_confidence", "one", tuple(reversed(CONFIDENCES)), upper=True),
    Rule("gate.include_ai_suggested", "flag"),
    Rule("gate.fail_on_regression", "flag"),
    Rule("gate.max_findings", "whole", null=True),
    Rule("report.formats", "some", ("json", "sarif", "html", "markdown")),
    Rule("report.directory", "text"),
)
RISK_WEIGHTS = (
    Rule("saturation", "weight", low=1, high=10_000),
    *(Rule(f"{factor}.{name}", "weight", low=0, high=100) for factor, names in WEIGHTS.items() for name in names),
)
_FLAGS = ["true", "false", "yes", "no", "on", "off", "t", "f", "y", "n", "1", "0"]  # fixed values
_EMPTY = ["null", "[]", "{}", "false", "0", '""']


def parsed(text: Column) -> Column:
    """The document as a variant; an empty or null one is an empty object, and null if it isn't JSON."""
    v = F.try_parse_json(F.when(F.coalesce(F.trim(text), F.lit("")) == "", "{}").otherwise(text))
    return F.when(F.to_json(v).isin(_EMPTY), F.parse_json(F.lit("{}"))).otherwise(v)


def _get(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, *kinds: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).isin(*kinds)


def _number(low: float, high: float | None) -> str:
    return f"of {low:g} or more" if high is None else f"from {low:g} to {high:g}"


def _fault(rule: Rule, v: Column) -> Column:
    """What is wrong with one value, or null."""
    number, text = _get(v, "double"), F.when(_is(v, "STRING"), _get(v, "string"))
    text = F.upper(text) if rule.upper else text
    inside = (number >= rule.low) & (F.lit(True) if rule.high is None else number <= rule.high)
    if rule.kind == "whole":
        ok, what = inside & (number == F.floor(number)), f"must be a whole number {_number(rule.low, rule.high)}"
    elif rule.kind == "weight":
        ok, what = inside & _is(v, "BIGINT", "DECIMAL", "DOUBLE"), f"must be a number {_number(rule.low, rule.high)}"
    elif rule.kind == "flag":
        ok, what = F.lower(_get(v, "string")).isin(_FLAGS), "must be true or false"
    elif rule.kind in ("one", "some"):
        ok, what = text.isin(*rule.values), f"must be one of {', '.join(rule.values)}"
        if rule.flags:
            ok = F.coalesce(ok, F.lit(False)) | _is(v, "BOOLEAN")
    else:
        ok, what = text.isNotNull(), "must be a text"
    if rule.null:
        ok = F.coalesce(ok, F.lit(False)) | F.is_variant_null(v)
    return F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(what))


def _problem(path: Column, message: Column) -> Column:
    return F.struct(path.alias("path"), message.alias("message"))


def _faults(rule: Rule, v: Column) -> Column:
    """An array of problems of the value at the rule's path; of a list, one for each wrong element."""
    path = F.lit(rule.path)
    if rule.kind in ("some", "texts"):
        each = F.transform(
            _get(v, "array<variant>"),
            lambda x, i: _problem(F.concat(path, F.lit("."), i.cast("string")), _fault(rule, x)),
        )
        return F.when(_is(v, "ARRAY"), each).otherwise(F.array(_problem(path, F.lit("must be a list"))))
    return F.array(_problem(path, _fault(rule, v)))


def problems(documents: DataFrame, rules: tuple[Rule, ...], by: str = "config_id", text: str = "content", most: int = SHOWN) -> DataFrame:
    """by, place, path, message: the first `most` problems of each document in order of their paths; none if it is right.

    documents: `by`, unique, and `text`.  Problems of the whole document (too long, no JSON, no object) have an empty
    path.  Null and empty texts are right.  An object with a key twice isn't JSON.  Other columns aren't read.
    """
    sections = sorted({r.path.split(".")[0] for r in rules if "." in r.path})
    long = F.octet_length(text) > LONGEST
    docs = documents.select(F.col(by), long.alias("long"), F.when(long, None).otherwise(parsed(F.col(text))).alias("v"))
    whole = F.when(F.col("long"), f"is longer than {LONGEST // 1024} KB").when(F.col("v").isNull(), "isn't JSON")
    whole = whole.when(~_is(F.col("v"), "OBJECT"), "must be an object")
    bad = docs.select(by, F.lit("").alias("path"), whole.alias("message")).where("message is not null")

    def inside(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(by, *keep, F.explode(_get(F.col("v"), "map<string,variant>")).alias("key", "value"))

    top = inside(docs).withColumn("section", F.col("key").isin(sections))
    flat = F.col("section") & ~_is(F.col("value"), "OBJECT")
    wrong = top.where(flat).select(by, F.col("key").alias("path"), F.lit("must be an object").alias("message"))
    alone = top.where("not section").select(by, F.col("key").alias("path"), "value")
    below = inside(top.where(F.col("section") & ~flat).select(by, F.col("key").alias("name"), F.col("value").alias("v")), "name")
    values = alone.unionByName(below.select(by, F.concat("name", F.lit("."), "key").alias("path"), "value"))
    found = F.when(F.lit(False), F.array(_problem(F.lit(""), F.lit(""))))
    for rule in rules:
        found = found.when(F.col("path") == rule.path, _faults(rule, F.col("value")))
    found = found.otherwise(F.array(_problem(F.col("path"), F.lit("isn't a known key"))))
    judged = values.select(by, F.explode(found).alias("p")).select(by, "p.*").where("message is not null")
    out = first_in_groups(bad.unionByName(wrong).unionByName(judged), by, ["path", "message"], most)
    return out.select(by, "place", "path", "message")


def _right(documents: DataFrame, rules: tuple[Rule, ...], by: str, text: str, columns: Callable[[Column], list[Column]]) -> DataFrame:
    wrong = problems(documents, rules, by, text, 1).select(by)
    return documents.join(wrong, by, "left_anti").select(by, parsed(F.col(text)).alias("v")).select(by, *columns(F.col("v")))


def gate_policies(documents: DataFrame, by: str = "config_id", text: str = "content") -> DataFrame:
    """by, fail_on, min_confidence, include_ai, fail_on_regression, max_findings of each right document."""

    def flag(v: Column, key: str, default: bool) -> Column:
        said = F.lower(_get(v, "string", f"$.gate.{key}"))
        return F.coalesce(said.isin("true", "yes", "on", "t", "y", "1"), F.lit(default))

    def columns(v: Column) -> list[Column]:
        listed = F.transform(_get(v, "array<string>", "$.gate.fail_on"), F.upper)
        return [
            F.coalesce(listed, F.array(F.lit("CRITICAL"), F.lit("HIGH"))).alias("fail_on"),
            F.coalesce(F.upper(_get(v, "string", "$.gate.min_confidence")), F.lit("MEDIUM")).alias("min_confidence"),
            flag(v, "include_ai_suggested", False).alias("include_ai"),
            flag(v, "fail_on_regression", True).alias("fail_on_regression"),
            _get(v, "double", "$.gate.max_findings").cast("long").alias("max_findings"),
        ]

    return _right(documents, CONFIGURATION, by, text, columns)


def _weights(v: Column | None) -> Column:
    """All weights by `factor.name`, and `saturation`."""
    known = {"saturation": SATURATION} | {f"{f}.{n}": w for f, names in WEIGHTS.items() for n, w in names.items()}
    said = lambda k, w: F.lit(w) if v is None else F.coalesce(_get(v, "double", f"$.{k}"), F.lit(w))
    return F.create_map(*(c for k, w in known.items() for c in (F.lit(k), said(k, w))))


def risk_weights(documents: DataFrame, by: str = "config_id", text: str = "content") -> DataFrame:
    """by and weights (a map of `factor.name` and saturation), defaults with the overrides of each right document."""
    return _right(documents, RISK_WEIGHTS, by, text, lambda v: [_weights(v).alias("weights")])


def gate_and_risk(findings: DataFrame, by: str, policies: DataFrame, weights: DataFrame, regressions: DataFrame) -> DataFrame:
    """Per group: gate, reasons, blocking, counted, risk_index and total_risk, by the group's own policy and weights.

    policies, weights: as above, one row for each `by` at most; a group without one has the defaults.  regressions: by
    and n.  Findings need severity, confidence, exploitability, verification and status.  Groups without findings have
    no row; unknown and null values rank and weigh as nowhere else known.  Findings are counted by their five values
    before anything is joined, so a hot group is at most a few thousand rows.
    """
    factors = ["severity", "confidence", "exploitability", "verification", "status"]
    rows = findings.groupBy(by, *factors).agg(F.count("*").alias("n"))
    rows = rows.join(policies, by, "left").join(weights, by, "left")
    w = F.coalesce("weights", _weights(None))
    risk = F.lit(1.0)
    for f in factors:
        key = F.concat(F.lit(f"{f}."), F.col(f))
        risk = risk * F.coalesce(F.try_element_at(w, key), F.lit(UNKNOWN_WEIGHT.get(f, 1.0)))
    least, ai = F.coalesce("min_confidence", F.lit("MEDIUM")), F.coalesce("include_ai", F.lit(False))
    fail_on = F.coalesce("fail_on", F.array(F.lit("CRITICAL"), F.lit("HIGH")))
    status, verification = (F.coalesce(c, F.lit("")) for c in ("status", "verification"))
    counted = status.isin(ACTIVE) & (verification != "FALSE_POSITIVE")
    blocking = counted & (ai | (verification != "AI_SUGGESTED")) & F.coalesce(F.array_contains(fail_on, F.col("severity")), F.lit(False))
    blocking = blocking & (confidence_rank(F.col("confidence")) >= confidence_rank(least))
    how_many = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    worst = list(reversed(SEVERITIES))
    out = rows.groupBy(by).agg(
        *(how_many(blocking & (F.col("severity") == s)).alias(s) for s in worst),
        how_many(blocking).alias("blocking"),
        how_many(counted).alias("counted"),
        F.sum(F.round(risk.cast("decimal(38,12)"), 12) * F.col("n")).alias("t"),
        F.first(w["saturation"]).alias("k"),
        F.first(least).alias("least"),
        F.first("max_findings").alias("max"),
        F.first(F.coalesce("fail_on_regression", F.lit(True))).alias("strict"),
    )
    back = regressions.groupBy(by).agg(F.sum("n").alias("back"))
    out = out.join(back, by, "left")
    said = [
        *(F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s} from confidence "), "least")) for s in worst),
        F.when(F.col("strict") & (F.col("back") > 0), F.concat(F.col("back").cast("string"), F.lit(" came back after they were resolved"))),
        F.when(F.col("counted") > F.col("max"), F.concat(F.col("counted").cast("string"), F.lit(" open, allowed "), F.col("max").cast("string"))),
    ]
    reasons = F.filter(F.array(*said), lambda x: x.isNotNull())
    index = F.when(F.col("t") > 0, F.round(100 * (1 - F.exp(-F.col("t").cast("double") / F.col("k"))), 1)).otherwise(0.0)
    return out.select(
        by, F.when(F.size(reasons) > 0, "FAIL").otherwise("PASS").alias("gate"), reasons.alias("reasons"), "blocking", "counted",
        index.alias("risk_index"), F.round("t", 3).cast("double").alias("total_risk"),
    )
