"""Registered queries over the finding model, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findinglake.functions import columns as C
from findinglake.operators import correlate, findings as O
from findinglake.plans import adapter as A

Query = Callable[[SparkSession, str], DataFrame]


def _of_findings(f) -> Query:
    return lambda spark, sf: f(A.findings(spark, sf))


def _of_occurrences(f) -> Query:
    return lambda spark, sf: f(A.occurrences(spark, sf))


def _of_scans(f) -> Query:
    return lambda spark, sf: f(A.scans(spark, sf))


def _hotspots(spark, sf):
    return O.hotspots(A.occurrences(spark, sf), A.findings(spark, sf))


def _never_observed(spark, sf):
    seen = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("finding_id"))
    return A.findings(spark, sf).join(seen, "finding_id", "left_anti").select("finding_id", "severity")


def _findings_in_scan(spark, sf):
    seen = A.occurrences(spark, sf).where("scanner = 's3'").select("finding_id")
    rows = A.findings(spark, sf).join(seen, "finding_id", "left_semi")
    return rows.groupBy("project_id", "severity").agg(F.count("*").alias("n"))


def _search(spark, sf):
    parts = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_type")
    return O.filtered(parts, contains="%Wid_get", text_columns=("title", "p_type")).select("id", "title")


def _page(spark, sf):
    rows = A.findings(spark, sf).withColumn("risk_score", F.round(O.finding_risk(), 3))
    rows = O.filtered(rows, active_only=True, severity=["CRITICAL", "HIGH"])
    return O.page(O.severity_sorted(rows), 3, 25).select("finding_id", "severity", "risk_score")


def _finding_risk(rows):
    return rows.select("finding_id", F.round(O.finding_risk(), 6).alias("risk"), F.round(O.finding_risk(ignore_status=True), 6).alias("inherent"))


def _fingerprint(rows):
    return O.fingerprint_code(F.lit("APPSEC"), F.col("vuln_class"), F.col("path"), F.lit(None), F.col("snippet"))


def _fingerprints(rows):
    rows = rows.select("finding_id", _fingerprint(rows).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("finding_id").alias("first_id"))


def _dedup(rows):
    rows = rows.select("finding_id", "line", "scanner", "seen_at", "path", "vuln_class", "snippet", _fingerprint(rows).alias("fingerprint"))
    return O.first_of(rows, ["fingerprint"], "path", "line", "scanner", "finding_id").select("fingerprint", "path", "line", "scanner", "finding_id")


def _supersedes(rows):
    hits = rows.select("path", "line", "vuln_class", (F.col("scanner") == "s0").alias("proven")).distinct()
    left = O.proven_supersedes(hits, ["path", "line", "vuln_class"], F.col("proven"))
    return left.groupBy("path", "proven").agg(F.count("*").alias("n"))


def _retest(rows):
    """Two scans by time, lines being part of the identity; what was seen before the first had been resolved."""
    rows = rows.select(F.concat_ws("-", _fingerprint(rows), F.col("line").cast("string")).alias("fingerprint"), "path", "scanner", "seen_at")
    before, old, now = (
        rows.where(c).drop("seen_at")
        for c in (
            "seen_at < timestamp'1996-01-01'", "seen_at >= timestamp'1996-01-01' and seen_at < timestamp'1998-06-01'",
            "seen_at >= timestamp'1998-06-01' and path <> 'src/p9.py' and scanner <> 's4'",
        )
    )
    return O.compare_scans(O.first_of(old, ["fingerprint"], "path", "scanner"), now, before).groupBy("result").agg(F.count("*").alias("n"))


def _correlate(rows):
    reports = rows.select("path", F.col("vuln_class").alias("family"), "line", "scanner", F.col("finding_id").alias("ord"))
    return O_corr(reports)


def O_corr(reports):
    return correlate.corroborated(correlate.correlate(reports))


def _masks(spark, sf):
    d = A.files(spark, sf).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9a-f]{4,64}"), F.lit(0))).alias("nth", "value"))
    return d.select("doc_id", F.col("nth").cast("long").alias("nth"), C.mask_secret(F.col("value")).alias("masked"))


def _entropy(spark, sf):
    d = A.files(spark, sf).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9a-f]{6,40}"), F.lit(0))).alias("nth", "value"))
    return d.select("doc_id", F.col("nth").cast("long").alias("nth"), F.round(C.entropy(F.col("value")), 6).alias("entropy"))


def _duplicates(spark, sf):
    d = A.files(spark, sf).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    out = d.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return out.where("n > 1")


def _systems(spark, sf):
    m = A.table(spark, sf, "conversations")
    return m.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


def _time():
    return F.col("ts").cast("timestamp")


def _sessions(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "user_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.unix_micros(_time()) - F.unix_micros(F.lag(_time()).over(w)) > 1_800_000_000, F.lit(True))
    e = e.withColumn("session", F.sum(new.cast("int")).over(w))
    return e.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def _rate(spark, sf):
    e = A.table(spark, sf, "events").select("user_id", F.floor(F.unix_micros(_time()) / 1_000_000).alias("s"))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)
    return e.withColumn("hits", F.count("*").over(w)).groupBy("user_id").agg(F.max("hits").alias("most"))


def _path_sanitize(spark, sf):
    """Paths made of the documents' sources and first words: plain ones, and one of each unsafe and untidy form."""
    source, word = F.coalesce("source", F.lit("s")), F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")), F.lit("w"))
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    forms = [
        join(source, "/./", word, ".py"), join(source, "\\", word, "\\x"), join("../", source, "/", word), join("/", source, "/", word),
        join("C:/", source, "/", word), join(source, "//", word), F.lit("./."), join(source, "/", word), join(source, "/../", word),
    ]
    name = forms[-1]
    for i, f in enumerate(forms[:-1]):
        name = F.when(F.col("doc_id") % len(forms) == i, f).otherwise(name)
    return A.table(spark, sf, "documents").select("doc_id", name.alias("name")).select("doc_id", C.clean_path(F.col("name")).alias("path"))


def _vectors(spark, sf):
    """Base vectors of all metrics' values, dealt by the numbers of orders; every 50th isn't one."""
    k = F.col("o_orderkey")
    part = lambda name, values, at: F.concat(F.lit(f"/{name}:"), A._choice(F.floor(k / at) % len(values), list(values)))
    vector = F.concat(
        F.when(k % 50 == 0, "CVSS:2.0").when(k % 2 == 0, "CVSS:3.1").otherwise("CVSS:3.0"), part("AV", "NALP", 1), part("AC", "LH", 4), part("PR", "NLH", 8),
        part("UI", "NR", 24), part("S", "UC", 48), part("C", "HLN", 96), part("I", "HLN", 288), part("A", "HLN", 864),
    )
    return A.table(spark, sf, "orders").select(k.alias("id"), vector.alias("vector"))


def _cvss(spark, sf):
    score = C.cvss3_base_score(F.col("vector"))
    return _vectors(spark, sf).select("id", "vector", score.alias("score"), C.severity_from_score(score).alias("severity"))


QUERIES: dict[str, Query] = {
    "open_by_severity": _of_findings(O.open_by_severity),
    "severity_by_project": _of_findings(O.severity_by_project),
    "by_status": _of_findings(lambda f: O.grouped(f, "status", False)),
    "by_verification": _of_findings(lambda f: O.grouped(f, "verification")),
    "top_classes": _of_occurrences(O.top_classes),
    "finding_trend_30d": _of_findings(lambda f: O.daily_trend(f, A.AS_OF)),
    "mttr_days": _of_findings(lambda f: O.mttr_days(f, A.AS_OF)),
    "risk_history": _of_scans(O.risk_history),
    "file_hotspots": _hotspots,
    "stats_grouping_sets": lambda spark, sf: O.file_stats(A.files(spark, sf)),
    "latest_completed_scan": _of_scans(lambda s: O.latest(s.where("status = 'COMPLETED'"), "project_id", "finished_at", "scan_id")),
    "default_baseline": _of_scans(O.default_baseline),
    "findings_page": _page,
    "findings_search": _search,
    "findings_in_scan": _findings_in_scan,
    "never_observed": _never_observed,
    "finding_risk": _of_findings(_finding_risk),
    "risk_index_by_repository": _of_findings(lambda f: O.risk_index(f, "repository_id")),
    "gate_by_project": _of_findings(lambda f: O.gate(f, "project_id", max_findings=400)),
    "fingerprint_code": _of_occurrences(_fingerprints),
    "dedup_by_fingerprint": _of_occurrences(_dedup),
    "public_ids": _of_findings(O.public_ids),
    "proven_supersedes": _of_occurrences(_supersedes),
    "retest_exact": _of_occurrences(_retest),
    "correlate_groups": _of_occurrences(_correlate),
    "mask_values": _masks,
    "text_entropy": _entropy,
    "duplicate_documents": _duplicates,
    "system_messages": _systems,
    "event_sessions": _sessions,
    "sliding_rate_flags": _rate,
    "path_sanitize": _path_sanitize,
    "cvss_scores": _cvss,
}

_F = """
f as (
    select o_orderkey as finding_id, o_custkey as repository_id, c_nationkey as project_id,
        case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM'
            when '5-LOW' then 'LOW' else 'INFO' end as severity,
        case when o_orderkey % 20 = 7 then 'REOPENED' when o_orderkey % 20 = 11 then 'FALSE_POSITIVE'
            when o_orderkey % 20 = 13 then 'ACCEPTED_RISK' when o_orderstatus = 'O' then 'OPEN'
            when o_orderstatus = 'P' then 'IN_PROGRESS' else 'RESOLVED' end as status,
        case o_orderkey % 4 when 0 then 'CONFIRMED' when 1 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as confidence,
        case o_orderkey % 7 when 0 then 'PROVEN_DATAFLOW' when 1 then 'LIKELY' when 2 then 'POSSIBLE' else 'THEORETICAL' end as exploitability,
        case o_orderkey % 9 when 0 then 'AI_SUGGESTED' when 1 then 'CONFIRMED' when 2 then 'FALSE_POSITIVE' else 'DETECTED' end as verification,
        o_orderdate as first_seen_at
    from orders join customer on c_custkey = o_custkey),
g as (select *, case when status = 'RESOLVED' then first_seen_at + to_days(cast(finding_id % 90 as integer)) end as resolved_at,
        status in ('OPEN', 'IN_PROGRESS', 'REOPENED') as live,
        case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end as sr,
        case confidence when 'CONFIRMED' then 3 when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end as cr,
        case severity when 'CRITICAL' then 10.0::double when 'HIGH' then 7.0 when 'MEDIUM' then 4.0 when 'LOW' then 1.5 else 0.0 end
        * case confidence when 'CONFIRMED' then 1.0::double when 'HIGH' then 0.9 when 'MEDIUM' then 0.6 else 0.3 end
        * case exploitability when 'PROVEN_DATAFLOW' then 1.0::double when 'LIKELY' then 0.85 when 'POSSIBLE' then 0.65 else 0.45 end
        * case verification when 'AI_SUGGESTED' then 0.5::double when 'FALSE_POSITIVE' then 0.0 else 1.0 end as inherent from f)
"""
_O = """
o as (
    select l_orderkey as finding_id, 'src/p' || cast(l_partkey % 50 as varchar) || '.py' as path, cast(l_quantity as integer) as line,
        p_type as vuln_class, 's' || cast(l_suppkey % 5 as varchar) as scanner, 'call( ' || l_returnflag || ' )' as snippet,
        l_shipdate as seen_at
    from lineitem join part on p_partkey = l_partkey),
p as (select *, sha256('APPSEC' || chr(31) || vuln_class || chr(31) || path || chr(31) || '' || chr(31) || snippet) as fingerprint from o)
"""
_S = """
s as (
    select event_id as scan_id, user_id % 25 as project_id, ts as finished_at, value as risk_index,
        case event_type when 'purchase' then 'COMPLETED' when 'error' then 'FAILED' when 'signup' then 'CANCELLED'
            when 'click' then 'RUNNING' else 'QUEUED' end as status
    from events)
"""

ORACLE: dict[str, str] = {
    "correlate_groups": f"""with recursive {_O},
        d as (select path, vuln_class as family, line, scanner, min(finding_id) as ord from o group by 1, 2, 3, 4),
        q as (select *, row_number() over (partition by path, family order by ord, line, scanner) as n from d),
        r(path, family, n, anchors, line, scanner) as (
            select path, family, n, [{{'l': line, 's': scanner}}], line, scanner from q where n = 1
            union all
            select path, family, n, case when own is null then list_append(anchors, {{'l': line, 's': scanner}}) else anchors end,
                coalesce(own.l, line), coalesce(own.s, scanner)
            from (select q.path, q.family, q.n, q.line, q.scanner, r.anchors,
                    list_filter(r.anchors, lambda g: g.l = q.line or abs(g.l - q.line) <= 2 and g.s <> q.scanner)[1] as own
                from r join q on q.path = r.path and q.family = r.family and q.n = r.n + 1))
        select path, family, line as anchor_line, scanner as anchor_scanner, count(*) as members, count(distinct x.scanner2) as scanners
        from (select r.*, q.scanner as scanner2 from r join q using (path, family, n)) x group by 1, 2, 3, 4""",
    "open_by_severity": f"""with {_F} select d.severity, count(finding_id) as n
        from (values ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) d(severity)
        left join g on g.severity = d.severity and live group by 1""",
    "severity_by_project": f"""with {_F} select project_id, count(*) as open,
        count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high,
        count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low,
        count(*) filter (severity = 'INFO') as info from g where live group by 1""",
    "by_status": f"with {_F} select status, count(*) as n from g group by 1",
    "by_verification": f"with {_F} select verification, count(*) as n from g where live group by 1",
    "top_classes": f"with {_O} select vuln_class, count(*) as n from o group by 1 order by n desc, 1 limit 10",
    "finding_trend_30d": f"""with {_F},
        d as (select cast(x as date) as day from range(date '2001-07-03', date '2001-08-02', interval 1 day) t(x)),
        a as (select cast(first_seen_at as date) as day, count(*) as n from g
            where first_seen_at >= timestamp '2001-07-03' group by 1),
        b as (select cast(resolved_at as date) as day, count(*) as n from g
            where status = 'RESOLVED' and resolved_at >= timestamp '2001-07-03' group by 1)
        select day, coalesce(a.n, 0) as new, coalesce(b.n, 0) as resolved from d left join a using (day) left join b using (day)""",
    "mttr_days": f"""with {_F} select round(sum(epoch(resolved_at - first_seen_at)) / count(*) / 86400, 1) as mttr_days
        from g where status = 'RESOLVED' and resolved_at >= timestamp '2001-08-01' - interval 90 days""",
    "risk_history": f"""with {_S} select scan_id, project_id, risk_index, finished_at from s
        where status = 'COMPLETED' and risk_index is not null order by finished_at desc, scan_id desc limit 60""",
    "file_hotspots": f"""with {_F}, {_O}, h as (
        select path, count(*) as n, max(sr) as w from o join g using (finding_id) where live group by 1)
        select path, n, case w when 4 then 'CRITICAL' when 3 then 'HIGH' when 2 then 'MEDIUM' when 1 then 'LOW' else 'INFO' end as severity
        from h order by w desc, n desc, path limit 10""",
    "stats_grouping_sets": """select lang as language, source, count(*) as files, cast(sum(n_chars) as bigint) as size,
        cast(grouping(lang, source) as bigint) as level from documents group by grouping sets ((lang), (source), ())""",
    "latest_completed_scan": f"""with {_S} select project_id, max(finished_at) as finished_at, arg_max(scan_id, (finished_at, scan_id)) as scan_id
        from s where status = 'COMPLETED' group by 1""",
    "default_baseline": f"""with {_S} select scan_id, last_value(case when status = 'COMPLETED' then scan_id end ignore nulls) over (
        partition by project_id order by finished_at, scan_id rows between unbounded preceding and 1 preceding) as baseline_id from s""",
    "findings_page": f"""with {_F}, r as (select *, round(inherent, 3) as risk_score from g where live and sr >= 3)
        select finding_id, severity, risk_score from r order by sr desc, risk_score desc nulls last, finding_id limit 25 offset 50""",
    "findings_search": "select p_partkey as id, p_name as title from part where p_name ilike '%widget%' or p_type ilike '%widget%'",
    "findings_in_scan": f"""with {_F}, {_O} select project_id, severity, count(*) as n from g
        where finding_id in (select finding_id from o where scanner = 's3') group by 1, 2""",
    "never_observed": f"with {_F} select finding_id, severity from g where not exists (select 1 from lineitem where l_orderkey = finding_id)",
    "finding_risk": f"with {_F} select finding_id, round(case when live then inherent else 0 end, 6) as risk, round(inherent, 6) as inherent from g",
    "risk_index_by_repository": f"""with {_F}, t as (select repository_id, sum(cast(case when live then inherent else 0 end as decimal(38, 12))) as t,
            sum(cast(case when status = 'ACCEPTED_RISK' then inherent else 0 end as decimal(38, 12))) as a from g group by 1)
        select repository_id, case when t > 0 then round(100 * (1 - exp(-cast(t as double) / 25.0::double)), 1) else 0 end as risk_index,
            cast(round(t, 3) as double) as total_risk, cast(round(a, 3) as double) as accepted_risk from t""",
    "gate_by_project": f"""with {_F}, t as (select project_id,
            count(*) filter (live and verification not in ('FALSE_POSITIVE', 'AI_SUGGESTED') and sr >= 3 and cr >= 1) as blocking,
            count(*) filter (live and verification <> 'FALSE_POSITIVE') as counted from g group by 1)
        select project_id, blocking, counted, case when blocking > 0 or counted > 400 then 'FAIL' else 'PASS' end as gate from t""",
    "fingerprint_code": f"with {_O} select fingerprint, count(*) as n, min(finding_id) as first_id from p group by 1",
    "dedup_by_fingerprint": f"""with {_O} select fingerprint, path, line, scanner, finding_id from p
        qualify row_number() over (partition by fingerprint order by path, line, scanner, finding_id) = 1""",
    "public_ids": f"""with {_F} select finding_id, project_id, 'FL-' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end
        as public_id from (select *, row_number() over (partition by project_id order by sr desc, cr desc, finding_id) as n from g)""",
    "proven_supersedes": f"""with {_O}, h as (select distinct path, line, vuln_class, scanner = 's0' as proven from o),
        k as (select *, bool_or(proven) over (partition by path, line, vuln_class) as known from h)
        select path, proven, count(*) as n from k where proven or not known group by 1, 2""",
    "retest_exact": f"""with {_O}, q as (select fingerprint || '-' || line as fingerprint, path, scanner, seen_at from p),
        a as (select fingerprint, min(path) as path, arg_min(scanner, (path, scanner)) as scanner from q
            where seen_at >= timestamp '1996-01-01' and seen_at < timestamp '1998-06-01' group by 1),
        b as (select * from q where seen_at >= timestamp '1998-06-01' and path <> 'src/p9.py' and scanner <> 's4'),
        r as (
            select case when a.fingerprint in (select fingerprint from b) then 'STILL_OPEN'
                when a.path not in (select path from b) then 'NOT_REPRODUCED'
                when a.scanner not in (select scanner from b) then 'NOT_TESTED' else 'RESOLVED' end as result from a
            union all
            select case when h.fingerprint is not null then 'REGRESSION' else 'NEW' end
            from (select distinct fingerprint from b where fingerprint not in (select fingerprint from a)) n
            left join (select distinct fingerprint from q where seen_at < timestamp '1996-01-01') h using (fingerprint))
        select result, count(*) as n from r group by 1""",
    "mask_values": """with l as (select doc_id, regexp_extract_all(text, '[0-9a-f]{4,64}') as l from documents),
        v as (select doc_id, unnest(range(0, len(l))) as nth, unnest(l) as v from l)
        select doc_id, nth, case when length(v) >= 12 then substr(v, 1, 4) || repeat('*', least(length(v) - 8, 12)) || right(v, 4)
            when length(v) >= 8 then substr(v, 1, 2) || repeat('*', length(v) - 4) || right(v, 2) else repeat('*', length(v)) end as masked from v""",
    "text_entropy": """with l as (select doc_id, regexp_extract_all(text, '[0-9a-f]{6,40}') as l from documents),
        v as (select doc_id, unnest(range(0, len(l))) as nth, unnest(l) as v from l),
        c as (select doc_id, nth, length(v) as n, unnest(string_split(v, '')) as x from v),
        n as (select doc_id, nth, x, count(*) / n::double as p from c group by doc_id, nth, x, n)
        select doc_id, nth, round(-sum(p * log2(p)), 6) + 0.0 as entropy from n group by 1, 2""",
    "duplicate_documents": """select sha256(coalesce(text, '')) as sha256, count(*) as n, min(doc_id) as first_id
        from documents group by 1 having count(*) > 1""",
    "system_messages": "select role, count(*) as n, count(distinct conv_id) as conversations from conversations group by 1",
    "event_sessions": """with a as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over w) > 1800000000, true) as fresh from events
            window w as (partition by user_id order by ts, event_id)),
        b as (select *, cast(sum(cast(fresh as integer)) over (partition by user_id order by ts, event_id) as bigint) as session from a)
        select user_id, session, min(ts) as began, max(ts) as ended, count(*) as n from b group by 1, 2""",
    "sliding_rate_flags": """with e as (select user_id, epoch_us(ts) // 1000000 as s from events),
        h as (select user_id, count(*) over (partition by user_id order by s range between 3600 preceding and current row) as hits from e)
        select user_id, max(hits) as most from h group by 1""",
    "path_sanitize": """with w as (select doc_id, coalesce(source, 's') as s, coalesce(nullif(regexp_extract(text, '[A-Za-z]+'), ''), 'w') as w from documents)
        select doc_id, case doc_id % 9 when 0 then s || '/' || w || '.py' when 1 then s || '/' || w || '/x' when 5 then s || '/' || w when 7 then s || '/' || w end as path from w""",
    "cvss_scores": """with k as (select o_orderkey as id, o_orderkey % 4 as av, o_orderkey // 4 % 2 as ac, o_orderkey // 8 % 3 as pr, o_orderkey // 24 % 2 as ui,
            o_orderkey // 48 % 2 as s, o_orderkey // 96 % 3 as c, o_orderkey // 288 % 3 as i, o_orderkey // 864 % 3 as a from orders),
        v as (select *, case when id % 50 = 0 then 'CVSS:2.0' when id % 2 = 0 then 'CVSS:3.1' else 'CVSS:3.0' end || '/AV:' || ['N', 'A', 'L', 'P'][av + 1]
            || '/AC:' || ['L', 'H'][ac + 1] || '/PR:' || ['N', 'L', 'H'][pr + 1] || '/UI:' || ['N', 'R'][ui + 1] || '/S:' || ['U', 'C'][s + 1]
            || '/C:' || ['H', 'L', 'N'][c + 1] || '/I:' || ['H', 'L', 'N'][i + 1] || '/A:' || ['H', 'L', 'N'][a + 1] as vector,
            1 - (1 - [0.56::double, 0.22, 0][c + 1]) * (1 - [0.56::double, 0.22, 0][i + 1]) * (1 - [0.56::double, 0.22, 0][a + 1]) as iss,
            8.22::double * [0.85::double, 0.62, 0.55, 0.2][av + 1] * [0.77::double, 0.44][ac + 1]
                * case s when 1 then [0.85::double, 0.68, 0.5][pr + 1] else [0.85::double, 0.62, 0.27][pr + 1] end * [0.85::double, 0.62][ui + 1] as ease from k),
        m as (select *, case s when 1 then 7.52::double * (iss - 0.029::double) - 3.25::double * power(iss - 0.02::double, 15) else 6.42::double * iss end as impact from v),
        r as (select *, cast(round(least(case s when 1 then 1.08::double * (impact + ease) else impact + ease end, 10) * 100000) as bigint) as whole from m),
        t as (select id, vector, case when id % 50 = 0 then null when impact <= 0 then 0.0::double when whole % 10000 = 0 then whole / 100000.0::double
            else (whole // 10000 + 1) / 10.0::double end as score from r)
        select id, vector, score, case when score >= 9 then 'CRITICAL' when score >= 7 then 'HIGH' when score >= 4 then 'MEDIUM' when score > 0 then 'LOW'
            when score is not null then 'INFO' end as severity from t""",
}
