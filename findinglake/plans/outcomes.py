"""Registered queries on what scans yield and how they compare, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findinglake.operators import findings as O
from findinglake.operators import lifecycle, outcomes
from findinglake.plans import adapter as A
from findinglake.plans.catalog import _F
from findinglake.sources import manifests

_SUPPORTED = ("en", "de", "fr")
_NAMES = ("sast", "secrets", "gitleaks")
_RUN = """case when (s_suppkey + place) % 4 = 0 then 'failed' when (s_suppkey + place) % 7 = 0 then 'skipped' else 'ran' end"""
# Manifests of parts, one directory each; every seventh isn't JSON, and every fifth is a file of another kind.
_MANIFEST = """case when p_partkey % 7 = 0 then '{"dependencies": {' else '{"dependencies": {"n' || p_partkey || '": "1.' || p_partkey % 10 || '.0"}, "devDependencies": {"tool": "^2.0.0"}}' end"""


def _lines(spark, sf) -> DataFrame:
    """One row for each order and line number: the largest part, supplier and quantity."""
    li = A.table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("n"))
    return li.agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))


def _text(m: Column, value=lambda v: v.cast("string")) -> Column:
    """A map as text: entries in the order of their keys."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ",")


def _retests(spark, sf):
    """A supplier is a scan: lines are findings, a third of which only the baseline has, a third only the scan."""
    p, n = F.col("p"), F.col("n")
    rows = _lines(spark, sf).select(
        F.col("s").alias("scan_id"), (F.col("l_orderkey") * 100 + n).alias("ord"), F.concat(F.lit("fp"), (p % 30).cast("string")).alias("fingerprint"), F.lit("r").alias("rule_id"),
        F.lit("c").alias("vuln_class"), F.when(p % 3 == 0, "DEPENDENCY").otherwise("SAST").alias("source_kind"), F.when(n % 5 != 0, F.concat(F.lit("p"), (p % 50).cast("string"))).alias("path"),
        F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("function"), F.lit("x").alias("snippet"),
        F.when(n != 3, F.array(F.concat(F.lit("s"), (p % 5).cast("string"), F.lit(":rule")), F.lit("other"))).alias("scanners"), "l_orderkey", "q",
    )
    own = rows.drop("l_orderkey", "q")
    s = F.col("s_suppkey")
    scans = A.table(spark, sf, "supplier").select(s.alias("scan_id"), (s % 2 == 0).alias("partial"))
    looked = F.when((F.col("scan_id") + F.substring("path", 2, 9).cast("long")) % 4 == 0, "SKIPPED_SIZE").otherwise("ANALYZED")
    files = own.where("path is not null").select("scan_id", "path", looked.alias("status")).distinct()
    names = F.array(*(F.lit(x) for x in ("s0", "s1", "s2", "s3", "s4", outcomes.ADVISORIES)))
    runs = scans.select("scan_id", F.posexplode(names).alias("i", "scanner"))
    runs = runs.select("scan_id", "scanner", F.when((F.col("scan_id") + F.col("i")) % 3 == 0, "failed").otherwise("ran").alias("status"))
    history = rows.where("q > 45").select("scan_id", "fingerprint")
    out = outcomes.retests(own.where(rows.l_orderkey % 3 != 0), own.where(rows.l_orderkey % 3 != 1), scans, files, runs, history)
    return out.select("scan_id", "base_ord", "cur_ord", "fingerprint", "result", "match")


def _statistics(spark, sf):
    d, li, p = (A.table(spark, sf, t) for t in ("documents", "lineitem", "part"))
    k = F.col("doc_id")
    status = F.when(k % 6 == 0, "SKIPPED_BINARY").when(k % 11 == 0, "PARSE_ERROR").otherwise("ANALYZED")
    files = d.select((k % 40).alias("scan_id"), status.alias("status"), F.when(k % 9 != 0, F.col("lang")).alias("language"), F.when(k % 5 != 0, F.col("n_chars")).alias("lines"))
    severity = F.when(F.col("l_linenumber") == 1, "HIGH").when(F.col("l_linenumber") == 2, None).otherwise("LOW")
    found = li.select(F.col("l_suppkey").alias("scan_id"), severity.alias("severity"), F.col("l_returnflag").alias("source_kind"))
    deps = p.select((F.col("p_partkey") % 60).alias("scan_id"), F.when(F.col("p_size") > 25, "AFFECTED").otherwise("NOT_VERIFIED").alias("vuln_status"))
    rows = outcomes.scan_statistics(A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scan_id")), files, found, deps, _SUPPORTED)
    maps = {c: _text(F.col(c)) for c in rows.columns if "_by_" in c}
    told = lambda v: F.concat_ws("/", v["files"].cast("string"), v["lines"].cast("string"), v["sast"].cast("string"))
    return rows.withColumns(maps | {"languages": _text(F.col("languages"), told)})


def _runs(spark, sf) -> DataFrame:
    s = A.table(spark, sf, "supplier").select("s_suppkey", F.posexplode(F.array(*(F.lit(x) for x in _NAMES))).alias("place", "scanner"))
    return s.select(F.col("s_suppkey").alias("scan_id"), "scanner", F.expr(_RUN).alias("status"), F.when(F.col("s_suppkey") % 5 != 0, F.repeat(F.lit("boom "), F.lit(50))).alias("detail"))


def _united(spark, sf):
    """Lines, parts and orders as the outputs of three scanners."""
    row = lambda scan, ord_, snippet: [scan.alias("scan_id"), ord_.alias("ord"), F.lit("a.py").alias("path"), snippet.alias("snippet")]
    n, k, o = F.col("n"), F.col("p_partkey"), F.col("o_orderkey")
    sast = _lines(spark, sf).select(*row(F.col("s"), F.col("l_orderkey") * 100 + n, F.lit("x = 1")))
    secrets = A.table(spark, sf, "part").select(*row(k % 100 + 1, k, F.concat(F.lit("key = 'AKIA"), F.lpad(k.cast("string"), 16, "Q7ZK"), F.lit("'"))), F.lit("HIGH").alias("severity"))
    leaks = A.table(spark, sf, "orders").select(*row(o % 100 + 1, o, F.lit(None).cast("string")))
    rows = outcomes.united_outputs(dict(zip(_NAMES, (sast, secrets, leaks))), _runs(spark, sf))
    return rows.select("scan_id", "scanner", "ord", "number", "severity", F.coalesce(F.col("snippet").rlike("AKIA[0-9A-Z]{16}"), F.lit(False)).alias("in_clear"))


def _slugs(spark, sf):
    """Parts named anew beside existing slugs, some of which end in numbers."""
    k = F.col("p_partkey")
    p = A.table(spark, sf, "part")
    slug = F.concat(F.translate("p_name", " ", "-"), F.when(k % 2 == 0, F.concat(F.lit("-"), (k % 23).cast("string"))).otherwise(""))
    old = p.where(k % 5 == 0).select((k % 3).alias("organization_id"), slug.alias("slug"))
    name = F.when(k % 41 == 0, "!!").when(k % 13 == 0, F.concat(F.col("p_name"), F.lit(" "), (k % 17).cast("string"))).otherwise(F.initcap("p_name"))
    rows = outcomes.unique_slugs(old, p.where(k % 5 != 0).select((k % 3).alias("organization_id"), name.alias("name"), k.alias("ord")))
    return rows.select("organization_id", "ord", "slug")


def _gate(spark, sf):
    """Gate over what is new since the baseline: findings first seen before 1997 are in it."""
    f = A.findings(spark, sf).withColumn("fingerprint", F.concat(F.lit("fp"), F.col("finding_id").cast("string")))
    f = f.withColumns({"path": F.lit("a.py"), "scanner": F.lit("s")})
    cut = F.lit("1997-01-01").cast("timestamp")
    history = f.where(F.col("finding_id") % 6 == 0).select("fingerprint")
    results = O.compare_scans(f.where(F.col("first_seen_at") < cut), f.where(F.col("finding_id") % 4 != 1), history)
    return O.gate(lifecycle.introduced(f, results), "repository_id", max_findings=3)


def _inventory(spark, sf):
    name = F.expr("'d' || p_partkey || case when p_partkey % 5 = 0 then '/readme.md' else '/package.json' end")
    files = A.table(spark, sf, "part").select(name.alias("path"), F.expr(_MANIFEST).alias("text"))
    return manifests.dependency_inventory(files)[2].select("dependencies", "manifests", "errors", "detail")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "retests_of_scans": _retests,
    "scan_statistics": _statistics,
    "united_outputs": _united,
    "run_errors": lambda spark, sf: outcomes.run_errors(_runs(spark, sf)),
    "unique_slugs": _slugs,
    "gate_since_baseline": _gate,
    "dependency_inventory": _inventory,
}

_RUNS = f"""
r as (select s_suppkey as scan_id, scanner, {_RUN} as status, case when s_suppkey % 5 <> 0 then repeat('boom ', 50) end as detail
    from supplier, (values (0, 'sast'), (1, 'secrets'), (2, 'gitleaks')) v(place, scanner))"""
_LI = """
li as (select l_orderkey, cast(l_linenumber as bigint) as n, max(l_partkey) as p, max(l_suppkey) as s, max(l_quantity) as q from lineitem group by 1, 2)"""

ORACLE: dict[str, str] = {
    "retests_of_scans": f"""with {_LI},
        a as (select s as scan_id, l_orderkey * 100 + n as ord, 'fp' || p % 30 as fingerprint, p % 3 = 0 as dep, case when n % 5 <> 0 then p % 50 end as path, p % 5 as scanner, n <> 3 as named, q, l_orderkey from li),
        b as (select *, row_number() over (partition by scan_id, fingerprint order by ord) as nth from a where l_orderkey % 3 <> 0),
        c as (select scan_id, fingerprint, min(ord) as cur from a where l_orderkey % 3 <> 1 group by 1, 2),
        h as (select distinct scan_id, fingerprint from a where q > 45)
        select b.scan_id, b.ord as base_ord, case when nth = 1 then cur end as cur_ord, b.fingerprint,
            case when nth = 1 and cur is not null then 'STILL_OPEN'
                when path is not null and (b.scan_id + path) % 4 = 0 then case when b.scan_id % 2 = 0 then 'NOT_TESTED' else 'NOT_REPRODUCED' end
                when case when dep then (b.scan_id + 5) % 3 = 0 when named then (b.scan_id + scanner) % 3 = 0 else true end then 'NOT_TESTED' else 'RESOLVED' end as result,
            case when nth = 1 and cur is not null then 'FINGERPRINT' else 'NONE' end as match
        from b left join c using (scan_id, fingerprint)
        union all select c.scan_id, null, cur, c.fingerprint, case when h.scan_id is null then 'NEW' else 'REGRESSION' end, case when h.scan_id is null then 'NONE' else 'FINGERPRINT' end
        from c left join h using (scan_id, fingerprint) where not exists (select 1 from b where b.scan_id = c.scan_id and b.fingerprint = c.fingerprint)""",
    "scan_statistics": """with
        f as (select doc_id % 40 as scan_id, case when doc_id % 6 = 0 then 'SKIPPED_BINARY' when doc_id % 11 = 0 then 'PARSE_ERROR' else 'ANALYZED' end as status,
            case when doc_id % 9 <> 0 then lang end as language, case when doc_id % 5 <> 0 then n_chars end as lines from documents),
        g as (select l_suppkey as scan_id, case l_linenumber when 1 then 'HIGH' when 2 then null else 'LOW' end as severity, l_returnflag as kind from lineitem),
        d as (select p_partkey % 60 as scan_id, case when p_size > 25 then 'AFFECTED' else 'NOT_VERIFIED' end as status from part),
        fs as (select scan_id, sum(n) as files_total, string_agg(status || '=' || n, ',' order by status) as files_by_status, coalesce(sum(n) filter (status = 'ANALYZED'), 0) as files_analyzed
            from (select scan_id, status, count(*) as n from f group by 1, 2) group by 1),
        ls as (select scan_id, sum(l) as lines_analyzed, string_agg(language || '=' || n || '/' || l || '/' || case when language in ('en', 'de', 'fr') then 'true' else 'false' end, ',' order by language) as languages
            from (select scan_id, language, count(*) as n, sum(coalesce(lines, 0)) as l from f where status = 'ANALYZED' and language is not null group by 1, 2) group by 1),
        gs as (select scan_id, sum(n) as findings_total, string_agg(severity || '=' || n, ',' order by severity) as findings_by_severity from (select scan_id, severity, count(*) as n from g group by 1, 2) group by 1),
        gk as (select scan_id, string_agg(kind || '=' || n, ',' order by kind) as findings_by_source_kind from (select scan_id, kind, count(*) as n from g group by 1, 2) group by 1),
        ds as (select scan_id, sum(n) as dependencies_total, string_agg(status || '=' || n, ',' order by status) as dependencies_by_vuln_status from (select scan_id, status, count(*) as n from d group by 1, 2) group by 1)
        select s_suppkey as scan_id, cast(coalesce(files_total, 0) as bigint) as files_total, cast(coalesce(files_analyzed, 0) as bigint) as files_analyzed, coalesce(files_by_status, '') as files_by_status,
            cast(coalesce(lines_analyzed, 0) as bigint) as lines_analyzed, coalesce(languages, '') as languages, cast(coalesce(findings_total, 0) as bigint) as findings_total,
            coalesce(findings_by_severity, '') as findings_by_severity, coalesce(findings_by_source_kind, '') as findings_by_source_kind,
            cast(coalesce(dependencies_total, 0) as bigint) as dependencies_total, coalesce(dependencies_by_vuln_status, '') as dependencies_by_vuln_status
        from supplier left join fs on fs.scan_id = s_suppkey left join ls on ls.scan_id = s_suppkey left join gs on gs.scan_id = s_suppkey left join gk on gk.scan_id = s_suppkey left join ds on ds.scan_id = s_suppkey""",
    "united_outputs": f"""with {_RUNS}, {_LI},
        o as (select s as scan_id, 'sast' as scanner, 0 as place, l_orderkey * 100 + n as ord, null as severity from li
            union all select p_partkey % 100 + 1, 'secrets', 1, p_partkey, 'HIGH' from part union all select o_orderkey % 100 + 1, 'gitleaks', 2, o_orderkey, null from orders)
        select scan_id, scanner, ord, row_number() over (partition by scan_id order by place, ord) as number, severity, false as in_clear
        from o where exists (select 1 from r where r.scan_id = o.scan_id and r.scanner = o.scanner and status = 'ran')""",
    "run_errors": f"""with {_RUNS} select scan_id, scanner, scanner || ' failed' || case when detail is null then '' else ': ' || left(detail, 200) end as text from r where status = 'failed'""",
    "unique_slugs": """with
        p as (select p_partkey as k, p_partkey % 3 as org, p_name from part),
        old as (select distinct org, replace(p_name, ' ', '-') || case when k % 2 = 0 then '-' || k % 23 else '' end as slug from p where k % 5 = 0),
        new as (select org, k, case when k % 41 = 0 then 'item' when k % 13 = 0 then replace(p_name, ' ', '-') || '-' || k % 17 else replace(lower(p_name), ' ', '-') end as base from p where k % 5 <> 0),
        own as (select org, base, min(k) as k from new where not exists (select 1 from old where old.org = new.org and slug = base) group by 1, 2),
        rest as (select *, row_number() over (partition by org, base order by k) as n, count(*) over (partition by org, base) as m from new where (org, k) not in (select (org, k) from own)),
        taken as (select org, slug from old union select org, base from own),
        free as (select org, base, v, row_number() over (partition by org, base order by v) as n
            from (select org, base, unnest(range(2, m + (select count(*) from taken) + 2)) as v from (select distinct org, base, m from rest)) q
            where not exists (select 1 from taken where taken.org = q.org and slug = base || '-' || v))
        select org as organization_id, k as ord, base as slug from own
        union all select org, k, base || '-' || v from rest join free using (org, base, n)""",
    "gate_since_baseline": f"""with {_F},
        q as (select *, severity in ('CRITICAL', 'HIGH') as bad, status in ('OPEN', 'IN_PROGRESS', 'REOPENED') and verification <> 'FALSE_POSITIVE' as counts from f
            where first_seen_at >= timestamp '1997-01-01' and finding_id % 4 <> 1),
        t as (select repository_id, count(*) filter (counts and bad and confidence <> 'LOW' and verification <> 'AI_SUGGESTED') as blocking, count(*) filter (counts) as counted from q group by 1)
        select *, case when blocking > 0 or counted > 3 then 'FAIL' else 'PASS' end as gate from t""",
    "dependency_inventory": """with m as (select p_partkey % 7 = 0 as bad from part where p_partkey % 5 <> 0),
        c as (select 2 * count(*) filter (not bad) as dependencies, count(*) filter (not bad) as manifests, count(*) filter (bad) as errors from m)
        select *, dependencies || ' dependencies in ' || manifests || ' manifests' as detail from c""",
}
