"""Registered queries on secrets, packages, files, reports and streams, and the same in DuckDB SQL where it can say so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findinglake.operators import merge, retest, sarif, secrets, versions
from findinglake.plans import adapter as A
from findinglake.plans.catalog import _fingerprint
from findinglake.sources import inventory, manifests
from findinglake.streaming import state as S


def _secret_scan(spark, sf):
    """The documents' tokens under a name that counts as a credential's."""
    text = F.replace(F.col("text"), F.lit("token = "), F.lit("access_token = "))
    found = secrets.scan_secrets(A.files(spark, sf).select("doc_id", "path", text.alias("text")))
    return found.select("doc_id", "detector", "line", "masked", "severity")


def _access_keys(spark, sf):
    """The documents' tokens in the form of a provider's."""
    text = F.regexp_replace("text", 'token = "([0-9a-f]{36})', 'token = "ghp_$1')
    found = secrets.scan_secrets(A.files(spark, sf).select("doc_id", "path", text.alias("text")))
    return found.select("doc_id", "detector", "line", "masked", "severity")


def _redacted(spark, sf):
    """Whole documents, their tokens in the form of a provider's."""
    text = F.regexp_replace("text", 'token = "([0-9a-f]{36})', 'token = "ghp_$1')
    f = A.files(spark, sf).select("doc_id", "path", text.alias("text"))
    return f.select("doc_id", F.sha2(secrets.redact(F.col("text"), F.col("path")), 256).alias("redacted_sha256"))


def _dependencies(spark, sf):
    k = F.col("p_partkey")
    version = F.concat_ws(".", F.col("p_size"), k % 10, k % 7)
    return A.table(spark, sf, "part").select(k.alias("dep_id"), F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), version.alias("version"))


def _entries(spark, sf):
    """One advisory per supplier: versions from its nation's number up to ten more, and one listed version."""
    n = F.col("s_nationkey")
    event = lambda k, v: F.create_map(F.lit(k), F.concat(v.cast("string"), F.lit(".0.0")))
    return A.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("advisory_id"), F.lit("npm").alias("ecosystem"),
        F.concat(F.lit("BRAND#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (n % 5 + 1).cast("string")).alias("name"),
        F.array(F.lit("50.1.1")).alias("versions"),
        F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(event("introduced", n), event("fixed", n + 10)).alias("events"))).alias("ranges"),
    )


def _enriched(spark, sf):
    out = versions.enrich(_dependencies(spark, sf), _entries(spark, sf))
    return out.groupBy("vuln_status").agg(F.count("*").alias("n"), F.sum(F.size("advisory_ids")).alias("advisories"))


def _merged(spark, sf):
    k = F.col("p_partkey")
    locked = (F.col("p_size") % 2 == 0) & (k % 3 == 0)
    rows = A.table(spark, sf, "part").select(
        F.concat(F.lit("d"), F.col("p_size").cast("string"), F.when(locked, "/lock").otherwise("/manifest")).alias("manifest_path"),
        F.lit("npm").alias("ecosystem"), locked.alias("locked"), F.col("p_brand").alias("name"), (k % 5).cast("string").alias("version"),
        F.lit(None).cast("string").alias("version_spec"), (~locked).alias("direct"), F.lit(False).alias("dev"),
    )
    return manifests.merge_manifests(rows).groupBy("manifest_path", "locked", "direct").agg(F.count("*").alias("n"))


def _manifest_texts(spark, sf):
    """One manifest per part, its kind by the key; version 1 package locks nest as many levels as the part's size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name, version = F.concat(F.lit("pkg"), (k % 97).cast("string")), F.concat_ws(".", size, k % 10, k % 7)
    level = lambda i: F.concat(F.lit(',"dependencies":{"'), name, F.lit("-"), i.cast("string"), F.lit('":{"version":"'), i.cast("string"), F.lit('.0.0"'))
    nested = F.concat(F.lit('{"lockfileVersion":1'), F.array_join(F.transform(F.sequence(F.lit(1), size), level), ""), F.repeat(F.lit("}}"), size), F.lit("}"))
    texts = {
        "requirements.txt": "# c\nNAME==VERSION\n", "pyproject.toml": '[project]\ndependencies=["NAME==VERSION"]\n',
        "Pipfile.lock": '{"develop":{"NAME":{"version":"==VERSION"}}}', "poetry.lock": '[[package]]\nname="NAME"\nversion="VERSION"\n',
        "uv.lock": '[[package]]\nname="NAME"\nversion="VERSION"\n', "package.json": '{"dependencies":{"NAME":"VERSION"}}', "package-lock.json": "",
        "yarn.lock": '# yarn\n\nNAME@^1:\n  version "VERSION"\n', "pnpm-lock.yaml": "packages:\n\n  /NAME@VERSION:\n    dev: true\n\n",
        "composer.json": '{"require":{"a/NAME":"VERSION"}}', "composer.lock": '{"packages":[{"name":"a/NAME","version":"vVERSION"}]}',
    }
    at = (k % len(texts) + 1).cast("int")
    path = F.concat(F.lit("d"), k.cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, texts)), at))
    plain = F.replace(F.replace(F.element_at(F.array(*map(F.lit, texts.values())), at), F.lit("NAME"), name), F.lit("VERSION"), version)
    return A.table(spark, sf, "part").select(path.alias("path"), F.when(plain == "", nested).otherwise(plain).alias("text"))


def _parsed(spark, sf):
    return manifests.parse_manifests(_manifest_texts(spark, sf)).drop("version_spec")


def _inventory(spark, sf):
    f = A.files(spark, sf)
    content = F.encode("text", "UTF-8")
    files = f.select("path", F.length(F.coalesce(content, F.lit(b""))).cast("long").alias("size"), content.alias("content"))
    return inventory.inventory(files, max_bytes=1 << 30).select("path", "size", "status", "lines", "sha256")


def _classify(spark, sf):
    d = A.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return d.select("page_id", secrets.is_test_path(F.col("path")).alias("is_test"), secrets.is_env_file(F.col("path")).alias("is_env"))


def _compare(spark, sf):
    d = _dependencies(spark, sf).select("dep_id", "version")
    c = versions.compare_versions(F.lit("npm"), F.col("version"), F.lit("25.5.3"))
    return d.select("dep_id", c.alias("sign"))


def _sarif_rules(spark, sf):
    o = A.occurrences(spark, sf)
    rows = o.select(F.col("finding_id").alias("ord"), F.col("vuln_class").alias("rule_id"), "vuln_class", F.lit("HIGH").alias("severity"), F.col("vuln_class").alias("title"), F.array(F.lit("CWE-1")).alias("cwe"))
    return sarif.rules(rows).select("rule_id", "rule_index")


def _fuzzy(spark, sf):
    o = A.occurrences(spark, sf)
    rows = o.select(
        _fingerprint(o).alias("fingerprint"), "path", "scanner", "vuln_class", F.lit("SAST").alias("source_kind"), F.lit(None).cast("string").alias("function"),
        "line", "snippet", F.col("vuln_class").alias("rule_id"), "seen_at",
    )
    old, now = (rows.where(f"seen_at {op} timestamp'1998-06-01'").drop("seen_at") for op in ("<", ">="))
    out = retest.compare_scans_fuzzy(old, now, rows.where("seen_at < timestamp'1993-01-01'").select("fingerprint"))
    return out.groupBy("result", "method").agg(F.count("*").alias("n"))


def _alias_groups(spark, sf):
    """Parts as reports of dependencies: one by its own number, with aliases that chains of parts share."""
    k = F.col("p_partkey")
    alias = F.array(F.concat(F.lit("x"), (k % 40 + F.floor(k / 500) * 1000).cast("string")), F.when(k % 7 == 0, F.concat(F.lit("x"), ((k + 1) % 40 + F.floor(k / 500) * 1000).cast("string"))))
    rows = A.table(spark, sf, "part").select(
        k.alias("id"), F.lit("npm").alias("ecosystem"), F.lit("P").alias("package_name"), (k % 2).cast("string").alias("version"),
        F.concat(F.lit("a"), k.cast("string")).alias("advisory_id"), F.lit("r").alias("rule_id"), alias.alias("aliases"),
    )
    return merge.grouped_by_keys(rows.select("id", merge.alias_keys().alias("keys")))


def _audit(spark, sf):
    e = A.table(spark, sf, "events").where("event_type in ('purchase', 'error') and value is not null")
    return e.where(F.get_json_object("props", "$.k").isNotNull()).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def _windows(spark, sf):
    e = A.table(spark, sf, "events").select("user_id", "ts")
    return S.sessions(e, "user_id").select("user_id", "began", "n")


def _stream(spark, sf):
    schema = A.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a file or a folder of that name
    return e.select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_type") != "error").alias("ok"))


def _limited(spark, sf):
    return S.run_available(S.rate_limit(_stream(spark, sf).drop("ok"), 2, 3600.0))


def _locked(spark, sf):
    return S.run_available(S.lockout(_stream(spark, sf), 2, 24 * 60.0))


def _bounded(spark, sf):
    return S.run_available(S.bounded_sessions(_stream(spark, sf).drop("ok"), 24 * 3600.0, 72 * 3600.0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "secret_scan": _secret_scan,
    "secret_access_keys": _access_keys,
    "redacted_texts": _redacted,
    "advisory_match": lambda spark, sf: versions.advisory_matches(_dependencies(spark, sf), _entries(spark, sf)),
    "dependency_status": _enriched,
    "semver_order": _compare,
    "manifest_merge": _merged,
    "manifest_parse": _parsed,
    "file_inventory": _inventory,
    "path_classify": _classify,
    "sarif_rules": _sarif_rules,
    "retest_fuzzy": _fuzzy,
    "audit_filter": _audit,
    "session_windows": _windows,
    "alias_groups": _alias_groups,
    "bounded_sessions": _bounded,
    "rate_limit_stream": _limited,
    "lockout_stream": _locked,
}

_DEPS = """
d as (select p_partkey as dep_id, upper(p_brand) as name, cast(p_size as bigint) as a, p_partkey % 10 as b, p_partkey % 7 as c from part),
e as (select s_suppkey as advisory_id, 'BRAND#' || (s_suppkey % 5 + 1) || (s_nationkey % 5 + 1) as name, s_nationkey as n from supplier),
m as (select dep_id, advisory_id from d join e using (name) where (a >= n and a < n + 10) or (a = 50 and b = 1 and c = 1))
"""

_EVENTS = """e as (select user_id as key, event_id, epoch_us(ts) / 1e6::double as t, event_type <> 'error' as ok,
    row_number() over (partition by user_id order by ts, event_id) as n from events)"""

ORACLE: dict[str, str] = {
    "alias_groups": """with recursive p as (select p_partkey as id, p_partkey % 2 as v, p_partkey % 40 + p_partkey // 500 * 1000 as a,
            case when p_partkey % 7 = 0 then (p_partkey + 1) % 40 + p_partkey // 500 * 1000 end as b from part),
        k as (select id, v || '|' || a as k from p union select id, v || '|' || b from p where b is not null),
        firsts as (select id, min(k) as k from k group by 1),
        key_links as (select distinct x.k as x, y.k as y from k x join k y using (id)),
        reach(x, y) as (select k, k from k union select r.x, l.y from reach r join key_links l on r.y = l.x),
        least as (select r.x as k, min(k.id) as group_id from reach r join k on k.k = r.y group by 1)
        select id, group_id from firsts join least using (k)""",
    "redacted_texts": """select doc_id, sha256(regexp_replace(text, 'token = "[0-9a-f]{32,}([0-9a-f]{4})', 'token = "ghp_************\\1', 'g')) as redacted_sha256
        from documents""",
    "bounded_sessions": f"""with recursive {_EVENTS},
        r(key, n, event_id, t, began) as (
            select key, n, event_id, t, t from e where n = 1
            union all
            select e.key, e.n, e.event_id, e.t, case when e.t - r.t > 86400 or e.t - r.began > 259200 then e.t else r.began end
            from r join e on e.key = r.key and e.n = r.n + 1)
        select cast(key as varchar) as key, event_id, t, began from r""",
    "rate_limit_stream": f"""with recursive {_EVENTS},
        r(key, n, event_id, t, allowed, retry_after, times) as (
            select key, n, event_id, t, true, 0.0::double, [t] from e where n = 1
            union all
            select key, n, event_id, t, ok, case when ok then 0.0::double else greatest(0.0::double, 3600 - (t - kept[1])) end,
                case when ok then list_append(kept, t) else kept end
            from (select *, len(kept) < 2 as ok from (
                select e.key, e.n, e.event_id, e.t, list_filter(r.times, lambda x: e.t - x <= 3600) as kept from r join e on e.key = r.key and e.n = r.n + 1)))
        select cast(key as varchar) as key, event_id, t, allowed, retry_after from r""",
    "lockout_stream": f"""with recursive {_EVENTS},
        r(key, n, event_id, t, outcome, failed, until) as (
            select key, n, event_id, t, case when ok then 'SUCCESS' else 'FAILURE' end, cast(not ok as integer), -1.0::double from e where n = 1
            union all
            select key, n, event_id, t, case when locked then 'DENIED' when ok then 'SUCCESS' else 'FAILURE' end,
                case when locked then failed when ok or failed + 1 >= 2 then 0 else failed + 1 end,
                case when locked then until when ok then -1 when failed + 1 >= 2 then t + 86400 else until end
            from (select e.*, r.failed, r.until, r.until > e.t as locked from r join e on e.key = r.key and e.n = r.n + 1))
        select cast(key as varchar) as key, event_id, t, outcome from r""",
    "secret_scan": """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
        v as (select doc_id, n, unnest(regexp_extract_all(line, 'token = "([0-9a-f]{8,200})"', 1)) as v from l)
        select distinct doc_id, 'generic-credential' as detector, cast(n as int) as line, substr(v, 1, 4) || repeat('*', least(length(v) - 8, 12)) || right(v, 4) as masked,
            'HIGH' as severity from v where not regexp_matches(v, 'abcdef|123456|000000')""",
    "secret_access_keys": """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
        v as (select doc_id, n, unnest(regexp_extract_all(line, 'token = "([0-9a-f]{36,})"', 1)) as v from l)
        select distinct doc_id, 'github-token' as detector, cast(n as int) as line, 'ghp_' || repeat('*', 12) || right(v, 4) as masked, 'HIGH' as severity from v""",
    "advisory_match": f"with {_DEPS} select * from m",
    "dependency_status": f"""with {_DEPS}, k as (select dep_id, count(*) as n from m group by 1)
        select case when k.n is null then 'NO_KNOWN_VULNERABILITIES' else 'VULNERABLE' end as vuln_status, count(*) as n,
            cast(coalesce(sum(k.n), 0) as bigint) as advisories from d left join k using (dep_id) group by 1""",
    "semver_order": """select p_partkey as dep_id, case when (p_size, p_partkey % 10, p_partkey % 7) < (25, 5, 3) then -1
        when (p_size, p_partkey % 10, p_partkey % 7) > (25, 5, 3) then 1 else 0 end as sign from part""",
    "manifest_merge": """with r as (select p_size as s, p_size % 2 = 0 and p_partkey % 3 = 0 as locked, p_brand as name, p_partkey % 5 as v from part),
        h as (select s from r where locked group by 1),
        l as (select distinct s, name, v from r where locked),
        x as (
            select 'd' || s || '/lock' as manifest_path, true as locked, exists (select 1 from r where not r.locked and r.s = l.s and r.name = l.name) as direct from l
            union all select 'd' || s || '/manifest', false, true from r where not locked and s not in (select s from h))
        select manifest_path, locked, direct, count(*) as n from x group by 1, 2, 3""",
    "manifest_parse": """with p as (select p_partkey as k, p_size as s, p_partkey % 11 as f, 'pkg' || (p_partkey % 97) as n, p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) as v from part),
        t(f, file, ecosystem, locked, direct, dev) as (values (0, 'requirements.txt', 'PyPI', false, true, false), (1, 'pyproject.toml', 'PyPI', false, true, false),
            (2, 'Pipfile.lock', 'PyPI', true, false, true), (3, 'poetry.lock', 'PyPI', true, false, false), (4, 'uv.lock', 'PyPI', true, false, false),
            (5, 'package.json', 'npm', false, true, false), (7, 'yarn.lock', 'npm', true, false, false), (8, 'pnpm-lock.yaml', 'npm', true, false, false),
            (9, 'composer.json', 'Packagist', false, true, false), (10, 'composer.lock', 'Packagist', true, false, false)),
        d as (select k, n, unnest(range(1, s + 1)) as i from p where f = 6)
        select 'd' || k || '/' || file as manifest_path, ecosystem, locked, case when ecosystem = 'Packagist' then 'a/' else '' end || n as name, v as version, direct, dev from p join t using (f)
        union all select 'd' || k || '/package-lock.json', 'npm', true, n || '-' || i, i || '.0.0', i = 1, false from d""",
    "file_inventory": """with f as (select source || '/' || doc_id || '.txt' as path, coalesce(text, '') as t from documents)
        select path, cast(strlen(t) as bigint) as size, 'ANALYZED' as status,
            cast(length(t) - length(replace(t, chr(10), '')) + case when t <> '' and not suffix(t, chr(10)) then 1 else 0 end as int) as lines, sha256(t) as sha256 from f""",
    "path_classify": """with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages)
        select page_id, regexp_matches(path, '(?i)(^|/)(tests?|spec|specs|__tests__|fixtures?|mocks?|examples?|samples?|docs?)(/|$)|\\.(test|spec)\\.[a-z]+$|_test\\.(py|go)$|test_[^/]*\\.py$') as is_test,
            regexp_matches(path, '(^|/)(\\.env(\\.[A-Za-z0-9_-]+)?|[^/]+\\.env|\\.npmrc|\\.pypirc|\\.netrc|[^/]+\\.(properties|ini|cfg|conf))$') as is_env from p""",
    "sarif_rules": """select p_type as rule_id, cast(row_number() over (order by min(l_orderkey), p_type) - 1 as int) as rule_index
        from lineitem join part on p_partkey = l_partkey group by 1""",
    "audit_filter": """select user_id, event_type, count(*) as n from events where event_type in ('purchase', 'error') and value is not null
        and json_extract_string(props, '$.k') is not null group by 1, 2""",
    "session_windows": """with a as (select user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) over w) > 1800000000, true) as fresh from events
            window w as (partition by user_id order by ts)),
        b as (select *, sum(cast(fresh as integer)) over (partition by user_id order by ts) as s from a)
        select user_id, min(ts) as began, count(*) as n from b group by user_id, s""",
}
