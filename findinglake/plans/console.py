"""Registered queries on settings, on findings in full and on snapshots of two scans, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findinglake.operators import detail, settings
from findinglake.plans import adapter as A
from findinglake.plans.catalog import _F

# Made documents, the same expression in both dialects; k is a repository's number.
_CONFIG = """case when k % 11 = 0 then '' when k % 13 = 0 then '{"gate": [' when k % 17 = 0 then '[1]' else
    '{"version": ' || cast(case when k % 23 = 0 then 2 else 1 end as string) || ', "gate": {"max_findings": ' || cast(k % 40 - 3 as string)
    || ', "min_confidence": "' || case k % 7 when 0 then 'huge' when 1 then 'low' when 2 then 'High' when 3 then 'CONFIRMED' else 'MEDIUM' end
    || '", "fail_on": ["high", "' || case k % 9 when 0 then 'severe' when 1 then 'medium' else 'critical' end
    || '"], "' || case when k % 10 = 0 then 'include_al' else 'include_ai_suggested' end || '": ' || case k % 3 when 0 then 'true' when 1 then '"no"' else 'false' end
    || '}, "scan": ' || case when k % 19 = 0 then '[]' else '{"max_file_kb": ' || cast(k % 50 * 2500 as string)
    || ', "exclude": ["docs", ' || case when k % 29 = 0 then '7' else '"x"' end || ']}' end || '}' end"""
_WEIGHTS = """case when k % 4 = 0 then '{"status": {"ACCEPTED_RISK": 0.5}, "saturation": ' || cast(k % 60 as string) || '}'
    when k % 4 = 1 then '{"severity": {"HUGE": 1, "HIGH": "7"}, "exposure": ' || case when k % 3 = 0 then '2' else '{"INTERNAL": 101}' end || '}' else '' end"""


def _documents(spark, sf, content: str) -> DataFrame:
    return A.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("repository_id"), F.expr(content).alias("content"))


def _told(spark, sf, content: str, rules) -> DataFrame:
    return settings.problems(_documents(spark, sf, content), rules, "repository_id").withColumn("place", F.col("place").cast("long"))


def _gate(spark, sf):
    """Gate and risk of each repository by its own configuration and weights."""
    f = A.findings(spark, sf)
    back = f.where("status = 'REOPENED'").groupBy("repository_id").agg(F.count("*").alias("n"))
    policies = settings.gate_policies(_documents(spark, sf, _CONFIG), "repository_id")
    weights = settings.risk_weights(_documents(spark, sf, _WEIGHTS), "repository_id")
    return settings.gate_and_risk(f, "repository_id", policies, weights, back).withColumn("reasons", F.concat_ws("; ", "reasons"))


def _details(spark, sf):
    """Each finding with its three newest occurrences and two newest results, written as texts."""
    o = A.occurrences(spark, sf)
    tested = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("finding_id"), F.when(F.col("l_linenumber") != 2, F.col("l_shipdate")).alias("created_at"),
        F.col("l_linenumber").cast("long").alias("retest_id"), F.col("l_returnflag").alias("result"),
    )
    rows = detail.finding_details(A.findings(spark, sf).select("finding_id", "severity"), o, tested, 3, 2)
    place = lambda x: F.concat(x["path"], F.lit(":"), x["line"].cast("string"), F.lit(":"), x["scanner"])
    answer = lambda x: F.concat(x["retest_id"].cast("string"), x["result"])
    return rows.select(
        "finding_id", "severity", F.array_join(F.transform("occurrences", place), " ").alias("places"), F.array_join(F.transform("retests", answer), " ").alias("results")
    )


def _stored(spark, sf):
    """Findings and occurrences as stored rows; a scan is a supplier, and its baseline the one before it."""
    k = F.col("finding_id")
    f = A.findings(spark, sf).select(
        k, F.concat(F.lit("fp"), k.cast("string")).alias("fingerprint"), F.concat(F.lit("R"), (k % 13).cast("string")).alias("rule_id"), F.lit("SAST").alias("engine"),
        F.concat(F.lit("c"), (k % 13).cast("string")).alias("vuln_class"), F.lit("t").alias("title"), "severity", "confidence", F.when(k % 5 != 0, F.lit("src/whole.py")).alias("path"),
    )
    li, n = A.table(spark, sf, "lineitem"), F.col("l_linenumber")
    o = li.select(
        F.col("l_suppkey").alias("scan_id"), F.col("l_orderkey").alias("finding_id"), F.when(n % 2 == 0, F.concat(F.lit("src/"), n.cast("string"))).alias("path"),
        F.col("l_quantity").cast("int").alias("line"), F.col("l_quantity").cast("int").alias("end_line"), F.lit("f").alias("function"),
        F.col("l_returnflag").alias("snippet"), F.when(n % 3 == 0, F.array(F.lit("s"))).alias("scanners"),
    )
    s = F.col("s_suppkey")
    return f, o, A.table(spark, sf, "supplier").select(s.alias("scan_id"), F.when(s % 3 == 0, s - 1).alias("baseline_scan_id"))


def _baselines(spark, sf):
    rows = detail.baseline_rows(*_stored(spark, sf))
    return rows.select("for_scan", "scan_id", "fingerprint", "rule_id", "path", "line", "snippet", F.size("scanners").cast("long").alias("scanners"))


def _changes(spark, sf):
    """Findings before and after: some go, some come, and severity, line and snippet of others change."""
    k = F.col("finding_id")
    rows = A.findings(spark, sf).select(k, F.concat(F.lit("fp"), k.cast("string")).alias("fingerprint"), "severity", "confidence", F.lit("R").alias("rule_id"), F.lit("p").alias("path"))
    old = rows.where(k % 10 != 0).withColumns({"line": (k % 50).cast("int"), "snippet": F.when(k % 3 != 0, F.lit("x"))})
    new = rows.where(k % 10 != 1).withColumns(
        {"line": F.when(k % 4 == 0, 7).otherwise(k % 50).cast("int"), "snippet": F.when(k % 6 != 0, F.lit("x")), "severity": F.when(k % 7 == 0, "LOW").otherwise(F.col("severity"))}
    )
    out = detail.snapshot_changes(old, new)
    return out.select("fingerprint", F.col("before.line").alias("line_before"), F.col("after.line").alias("line_after"), F.array_join("changed", ",").alias("changed"))


def _dependencies(spark, sf):
    li = A.table(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_suppkey").alias("scan_id"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("n"), (F.col("l_partkey") % 9).cast("string")).alias("name"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_returnflag")).alias("version"), F.lit("package.json").alias("manifest_path"), "l_orderkey", "l_linenumber",
    )
    return detail.one_of_each_dependency(rows, ["l_orderkey", "l_linenumber"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "config_problems": lambda spark, sf: _told(spark, sf, _CONFIG, settings.CONFIGURATION),
    "weight_problems": lambda spark, sf: _told(spark, sf, _WEIGHTS, settings.RISK_WEIGHTS),
    "gate_by_settings": _gate,
    "finding_details": _details,
    "baseline_findings": _baselines,
    "snapshot_changes": _changes,
    "scan_dependencies": _dependencies,
}

_DOCS = f"""
d as (select c_custkey as k, {_CONFIG.replace("k %", "c_custkey %")} as content from customer),
j as (select k, case when content = '' then json '{{}}' else try_cast(content as json) end as j from d),
x as (select * from j where json_type(j) = 'OBJECT'),
p as (
    select k, '' as path, 'isn''t JSON' as message from j where j is null
    union all select k, '', 'must be an object' from j where json_type(j) <> 'OBJECT'
    union all select k, 'version', 'must be a whole number from 1 to 1' from x where cast(j->>'$.version' as double) <> 1
    union all select k, 'gate.max_findings', 'must be a whole number of 0 or more' from x where cast(j->>'$.gate.max_findings' as double) < 0
    union all select k, 'gate.min_confidence', 'must be one of CONFIRMED, HIGH, MEDIUM, LOW' from x
        where upper(j->>'$.gate.min_confidence') not in ('LOW', 'MEDIUM', 'HIGH', 'CONFIRMED')
    union all select k, 'gate.fail_on.1', 'must be one of CRITICAL, HIGH, MEDIUM, LOW, INFO' from x
        where upper(j->>'$.gate.fail_on[1]') not in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO')
    union all select k, 'gate.' || key, 'isn''t a known key' from (select k, unnest(json_keys(j, '$.gate')) as key from x)
        where key not in ('fail_on', 'min_confidence', 'include_ai_suggested', 'fail_on_regression', 'max_findings')
    union all select k, 'scan', 'must be an object' from x where json_type(j, '$.scan') <> 'OBJECT'
    union all select k, 'scan.max_file_kb', 'must be a whole number from 1 to 102400' from x
        where cast(j->>'$.scan.max_file_kb' as double) not between 1 and 102400
    union all select k, 'scan.exclude.1', 'must be a text' from x where json_type(j, '$.scan.exclude[1]') <> 'VARCHAR'),
wj as (select c_custkey as k, case when content = '' then json '{{}}' else content::json end as j
    from (select c_custkey, {_WEIGHTS.replace("k %", "c_custkey %")} as content from customer)),
wp as (
    select k, 'saturation' as path, 'must be a number from 1 to 10000' as message from wj where cast(j->>'$.saturation' as double) not between 1 and 10000
    union all select k, 'severity.HUGE', 'isn''t a known key' from wj where json_exists(j, '$.severity.HUGE')
    union all select k, 'severity.HIGH', 'must be a number from 0 to 100' from wj where json_type(j, '$.severity.HIGH') = 'VARCHAR'
    union all select k, 'exposure', 'must be an object' from wj where json_type(j, '$.exposure') <> 'OBJECT'
    union all select k, 'exposure.INTERNAL', 'must be a number from 0 to 100' from wj where cast(j->>'$.exposure.INTERNAL' as double) > 100)
"""
_TOLD = "select k as repository_id, path, message, row_number() over (partition by k order by path, message) as place from {} qualify place <= 10"
_COUNTED = "live and verification <> 'FALSE_POSITIVE'"

ORACLE: dict[str, str] = {
    "config_problems": f"with {_DOCS} {_TOLD.format('p')}",
    "weight_problems": f"with {_DOCS} {_TOLD.format('wp')}",
    "gate_by_settings": f"""with {_F}, {_DOCS},
        pol as (select k, list_transform(cast(j->'$.gate.fail_on' as varchar[]), lambda s: upper(s)) as fail_on, upper(j->>'$.gate.min_confidence') as least,
            coalesce(j->>'$.gate.include_ai_suggested', 'false') = 'true' as ai, cast(j->>'$.gate.max_findings' as bigint) as most
            from x where k not in (select k from p)),
        w as (select k, cast(j->>'$.status.ACCEPTED_RISK' as double) as accepted, cast(j->>'$.saturation' as double) as saturation from wj where k not in (select k from wp)),
        q as (select g.*, coalesce(least, 'MEDIUM') as l, most, coalesce(saturation, 25) as saturation,
                cast(case when live then inherent when status = 'ACCEPTED_RISK' then inherent * coalesce(accepted, 0) else 0 end as decimal(38, 12)) as risk,
                {_COUNTED} as open_, {_COUNTED} and (coalesce(ai, false) or verification <> 'AI_SUGGESTED')
                and list_contains(coalesce(fail_on, ['CRITICAL', 'HIGH']), severity)
                and cr >= case coalesce(least, 'MEDIUM') when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 else 3 end as blocks
            from g left join pol on pol.k = repository_id left join w on w.k = repository_id),
        t as (select repository_id, any_value(l) as l, any_value(most) as most, any_value(saturation) as s, sum(risk) as t,
            count(*) filter (blocks) as blocking, count(*) filter (open_) as counted, count(*) filter (status = 'REOPENED') as back,
            count(*) filter (blocks and severity = 'CRITICAL') as a, count(*) filter (blocks and severity = 'HIGH') as b, count(*) filter (blocks and severity = 'MEDIUM') as c
            from q group by 1),
        r as (select *, concat_ws('; ', case when a > 0 then a || ' CRITICAL from confidence ' || l end, case when b > 0 then b || ' HIGH from confidence ' || l end,
            case when c > 0 then c || ' MEDIUM from confidence ' || l end, case when back > 0 then back || ' came back after they were resolved' end,
            case when counted > most then counted || ' open, allowed ' || most end) as reasons from t)
        select repository_id, case when reasons = '' then 'PASS' else 'FAIL' end as gate, reasons, blocking, counted,
            case when t > 0 then round(100 * (1 - exp(-cast(t as double) / s)), 1) else 0.0 end as risk_index, cast(round(t, 3) as double) as total_risk from r""",
    "finding_details": f"""with {_F},
        o as (select l_orderkey as finding_id, 'src/p' || l_partkey % 50 || '.py' as path, cast(l_quantity as int) as line, 's' || l_suppkey % 5 as scanner, l_returnflag,
            row_number() over (partition by l_orderkey order by l_shipdate desc nulls last, 'src/p' || l_partkey % 50 || '.py', cast(l_quantity as int), 's' || l_suppkey % 5) as n
            from lineitem join part on p_partkey = l_partkey),
        r as (select l_orderkey as finding_id, l_linenumber || l_returnflag as answer,
            row_number() over (partition by l_orderkey order by case when l_linenumber <> 2 then l_shipdate end desc nulls last, l_linenumber, l_returnflag) as n from lineitem),
        a as (select finding_id, string_agg(path || ':' || line || ':' || scanner, ' ' order by n) as places from o where n <= 3 group by 1),
        b as (select finding_id, string_agg(answer, ' ' order by n) as results from r where n <= 2 group by 1)
        select finding_id, severity, coalesce(places, '') as places, coalesce(results, '') as results from g left join a using (finding_id) left join b using (finding_id)""",
    "baseline_findings": f"""with {_F}
        select s_suppkey as for_scan, l_suppkey as scan_id, 'fp' || finding_id as fingerprint, 'R' || finding_id % 13 as rule_id,
            coalesce(case when l_linenumber % 2 = 0 then 'src/' || l_linenumber end, case when finding_id % 5 <> 0 then 'src/whole.py' end, '') as path,
            cast(l_quantity as int) as line, l_returnflag as snippet, cast(case when l_linenumber % 3 = 0 then 1 else 0 end as bigint) as scanners
        from supplier join lineitem on l_suppkey = s_suppkey - 1 join g on finding_id = l_orderkey where s_suppkey % 3 = 0""",
    "snapshot_changes": f"""with {_F}, b as (select finding_id as k, * from g),
        v as (select k, k % 10 <> 0 as was, k % 10 <> 1 as is_, cast(k % 50 as int) as l1, cast(case when k % 4 = 0 then 7 else k % 50 end as int) as l2,
            case when k % 3 <> 0 then 'x' end as s1, case when k % 6 <> 0 then 'x' end as s2, severity as v1, case when k % 7 = 0 then 'LOW' else severity end as v2 from b)
        select 'fp' || k as fingerprint, case when was then l1 end as line_before, case when is_ then l2 end as line_after,
            concat_ws(',', case when not (was and is_) or v1 <> v2 then 'severity' end, case when not (was and is_) then 'confidence,rule_id,path' end,
                case when not (was and is_) or l1 <> l2 then 'line' end,
                case when (case when was then s1 end) is distinct from (case when is_ then s2 end) then 'snippet' end) as changed
        from v where was or is_""",
    "scan_dependencies": """select l_suppkey as scan_id, 'npm' as ecosystem, 'n' || l_partkey % 9 as name, case when l_partkey % 4 <> 0 then l_returnflag end as version,
            'package.json' as manifest_path, l_orderkey, l_linenumber from lineitem
        qualify row_number() over (partition by l_suppkey, l_partkey % 9, case when l_partkey % 4 <> 0 then l_returnflag end order by l_orderkey, l_linenumber) = 1""",
}
