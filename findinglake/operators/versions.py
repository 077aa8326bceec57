"""Versions of packages: order, ranges of advisories, and the join of dependencies with advisories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findinglake.functions.columns import cvss3_base_score, package_name, release_key, severity_from_score

# Fixed value: the version pattern of PEP 440 (public specification), without its optional names.
_PEP440 = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d+)?)?"
    r"((?:-(\d+))|(?:[-_.]?(?:post|rev|r)[-_.]?(\d+)?))?([-_.]?dev[-_.]?(\d+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
_MOST = 2**62


def is_pep440(version: Column) -> Column:
    return version.rlike(_PEP440)


def pep440_key(version: Column) -> Column:
    """A sortable struct of a PEP 440 version: development < pre < final < post releases, local versions last."""
    part = lambda i: F.regexp_extract(version, _PEP440, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("long"), F.lit(0))
    plain = F.regexp_replace(part(2), r"(\.0+)+$", "")
    pre, post, dev = F.lower(part(3)), part(5) != "", part(8) != ""
    stage = F.when(pre.isin("a", "alpha"), 0).when(pre.isin("b", "beta"), 1).when(pre != "", 2)
    stage = stage.when(dev & ~post, -1).otherwise(3)
    local = F.filter(F.split(F.lower(part(10)), "[-_.]"), lambda x: x != "")
    digits = lambda x: x.rlike("^[0-9]+$")
    return F.struct(
        number(1).alias("epoch"),
        F.transform(F.split(plain, r"\."), lambda x: x.cast("long")).alias("release"),
        stage.alias("stage"),
        number(4).alias("pre"),
        F.when(post, F.greatest(number(6), number(7))).otherwise(-1).alias("post"),
        F.when(dev, number(9)).otherwise(F.lit(_MOST)).alias("dev"),
        F.transform(local, lambda x: F.struct(
            digits(x).cast("int").alias("numeric"), F.when(digits(x), x.cast("long")).otherwise(0).alias("n"), F.when(digits(x), "").otherwise(x).alias("s")
        )).alias("local"),
    )


def compare_versions(ecosystem: Column, a: Column, b: Column) -> Column:
    """-1, 0 or 1: PEP 440 order for PyPI when both are such versions, else the order of release keys."""

    def sign(key: Callable[[Column], Column]) -> Column:
        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    return F.when(a == b, 0).when((ecosystem == "PyPI") & is_pep440(a) & is_pep440(b), sign(pep440_key)).otherwise(sign(release_key))


def _kept(ranges: Column) -> Column:
    return F.filter(F.coalesce(ranges, F.array().cast("array<struct<type:string,events:array<map<string,string>>>>")), lambda r: r["type"].isin("ECOSYSTEM", "SEMVER"))


def _kind(event: Column) -> Column:
    has = lambda k: F.map_contains_key(event, k)
    return F.when(has("introduced"), "introduced").when(has("fixed"), "fixed").when(has("last_affected"), "last_affected").when(has("limit"), "limit")


def _keys(version: Column) -> Column:
    """What versions are compared by: (text, is PEP 440, its key, release key)."""
    return F.struct(version.alias("v"), is_pep440(version).alias("is_pep"), F.when(is_pep440(version), pep440_key(version)).alias("pep"), release_key(version).alias("key"))


def _prepared(ecosystem: Column, ranges: Column) -> Column:
    """The ranges' events with their keys, in version order ("0" first, ties as written)."""

    def one(r: Column) -> Column:
        pep = (ecosystem == "PyPI") & F.forall(r["events"], lambda e: (_value(e) == "0") | is_pep440(_value(e)))

        def place(e: Column, i: Column) -> Column:
            v = _value(e)
            return F.struct(
                (v != "0").cast("int").alias("later"), F.when(pep, pep440_key(v)).alias("by_pep"), F.when(~pep, release_key(v)).alias("by_key"),
                i.alias("i"), _kind(e).alias("kind"), _keys(v).alias("k"),
            )

        return F.transform(F.array_sort(F.transform(r["events"], place)), lambda p: F.struct(p["kind"].alias("kind"), p["k"].alias("k")))

    return F.transform(_kept(ranges), one)


def _covered(ecosystem: Column, version: Column, versions: Column, events: Column) -> Column:
    def applies(e: Column) -> Column:
        k = e["k"]
        use_pep = (ecosystem == "PyPI") & version["is_pep"] & k["is_pep"]
        above = F.when(use_pep, version["pep"] > k["pep"]).otherwise(version["key"] > k["key"])
        equal = (version["v"] == k["v"]) | F.when(use_pep, version["pep"] == k["pep"]).otherwise(version["key"] == k["key"])
        return ((e["kind"] == "introduced") & (k["v"] == "0")) | F.when(e["kind"] == "last_affected", above & ~equal).otherwise(above | equal)

    # `get` counts from 0 and gives null for an empty list.
    last = lambda r: F.get(F.reverse(F.filter(r, applies)), F.lit(0))["kind"]
    inside = F.exists(events, lambda r: F.coalesce(last(r) == "introduced", F.lit(False)))
    return F.coalesce(F.array_contains(versions, version["v"]), F.lit(False)) | F.coalesce(inside, F.lit(False))


def is_affected(ecosystem: Column, version: Column, versions: Column, ranges: Column) -> Column:
    """Whether an advisory's entry covers a version: it is listed, or the last event of some range that applies to it,
    in version order ("0" first, ties as written), introduces the flaw.

    ranges: array of (type, events), an event being a map with one of introduced, fixed, last_affected and limit.  A
    range of PyPI versions is put in PEP 440 order if all its values are such versions.
    """
    return _covered(ecosystem, _keys(version), versions, _prepared(ecosystem, ranges))


def _value(event: Column) -> Column:
    return F.element_at(F.map_values(event), 1)


def describe_ranges(ranges: Column) -> Column:
    """struct(ranges, fixed): the ranges as text (`>=a, <b`) and the fixed versions, in the order of events."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("intro"), none.alias("ranges"), none.alias("fixed"))

    def step(s: Column, e: Column) -> Column:
        kind, v = _kind(e), _value(e)
        low = F.coalesce(s["intro"], F.lit("0"))
        text = F.when(kind == "fixed", F.concat(F.lit(">="), low, F.lit(", <"), v))
        text = text.when(kind == "last_affected", F.concat(F.lit(">="), low, F.lit(", <="), v))
        return F.struct(
            F.when(kind == "introduced", v).when(kind.isin("fixed", "last_affected"), None).otherwise(s["intro"]).alias("intro"),
            F.when(text.isNotNull(), F.concat(s["ranges"], F.array(text))).otherwise(s["ranges"]).alias("ranges"),
            F.when(kind == "fixed", F.concat(s["fixed"], F.array(v))).otherwise(s["fixed"]).alias("fixed"),
        )

    def one(r: Column) -> Column:
        done = lambda s: F.struct(
            F.when(s["intro"].isNotNull(), F.concat(s["ranges"], F.array(F.concat(F.lit(">="), s["intro"])))).otherwise(s["ranges"]).alias("ranges"), s["fixed"].alias("fixed")
        )
        return F.aggregate(r["events"], start, step, done)

    parts = F.transform(_kept(ranges), one)
    return F.struct(F.flatten(parts["ranges"]).alias("ranges"), F.flatten(parts["fixed"]).alias("fixed"))


def advisory_severity(severity: Column, labels: Column) -> Column:
    """Severity of an advisory: of its first valid CVSS v3 vector, else its first known label, else MEDIUM.

    severity: array of (type, score); labels: array of strings in order of trust.
    """
    # Labels of advisory databases.
    known = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MODERATE": "MEDIUM", "MEDIUM": "MEDIUM", "LOW": "LOW"}
    scores = F.filter(F.transform(F.filter(severity, lambda s: s["type"].isin("CVSS_V3", "CVSS_V31")), lambda s: cvss3_base_score(s["score"])), lambda x: x.isNotNull())
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    named = F.filter(F.transform(labels, lambda s: F.element_at(table, F.upper(s))), lambda x: x.isNotNull())
    return F.coalesce(severity_from_score(F.get(scores, F.lit(0))), F.get(named, F.lit(0)), F.lit("MEDIUM"))


_VERSION = ["eco", "package", "version"]


def _own_versions(deps: DataFrame) -> DataFrame:
    package = package_name(F.col("ecosystem"), F.col("name")).alias("package")
    return deps.where("version is not null").select("dep_id", F.col("ecosystem").alias("eco"), package, "version")


def _advisories_of_versions(own: DataFrame, entries: DataFrame) -> DataFrame:
    """eco, package, version and the advisory_ids, each once, of each version that has any.

    Advisories whose entries of a package are the same are of one kind; each distinct version meets each kind once.
    """
    package = package_name(F.col("ecosystem"), F.col("name")).alias("package")
    side = F.struct("versions", _prepared(F.col("ecosystem"), F.col("ranges")).alias("events")).alias("side")
    e = entries.select("advisory_id", F.col("ecosystem").alias("eco"), package, side).where("eco is not null and package is not null")
    e = e.groupBy("eco", "package", "advisory_id").agg(F.array_sort(F.collect_set("side")).alias("sides"))
    unnamed = F.max(F.col("advisory_id").isNull())  # lists leave out nulls
    ids = F.collect_list("advisory_id")
    kinds = e.groupBy("eco", "package", "sides").agg(F.when(unnamed, F.array_append(ids, F.lit(None))).otherwise(ids).alias("ids"))
    versions = own.select(*_VERSION).distinct().withColumn("k", _keys(F.col("version")))
    covered = F.exists("sides", lambda x: _covered(F.col("eco"), F.col("k"), x["versions"], x["events"]))
    pairs = versions.join(kinds, ["eco", "package"]).where(covered)
    return pairs.groupBy(*_VERSION).agg(F.flatten(F.collect_list("ids")).alias("ids"))


def _divided(own: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """dep_id and its version of dependencies with one version; dep_id and advisory_id, each once, of the others."""
    v = F.struct(*_VERSION)
    least = own.groupBy("dep_id").agg(F.min(v).alias("v"), F.max(v).alias("high"))
    one = F.col("v").eqNullSafe(F.col("high"))
    more = own.join(least.where(~one).select(F.col("dep_id").alias("other")), F.col("dep_id").eqNullSafe(F.col("other")), "left_semi")
    several = more.join(found, _VERSION).select("dep_id", F.explode("ids").alias("advisory_id")).distinct()
    return least.where(one).select("dep_id", "v.*"), several


def advisory_matches(deps: DataFrame, entries: DataFrame) -> DataFrame:
    """dep_id and advisory_id, each pair once, of each dependency that an advisory's entry covers.

    deps: dep_id, ecosystem, name, version; entries: advisory_id, ecosystem, name, versions, ranges.  Only versions are
    compared with advisories; a dependency takes its version's list, and pairs are neither compared nor shuffled.
    """
    own = _own_versions(deps)
    found = _advisories_of_versions(own, entries)
    single, several = _divided(own, found)
    return single.join(found, _VERSION).select("dep_id", F.explode("ids").alias("advisory_id")).unionByName(several)


def enrich(deps: DataFrame, entries: DataFrame, answered: bool = True) -> DataFrame:
    """deps with vuln_status and sorted advisory_ids.

    Without a version, or if the source of advisories didn't answer, a dependency is NOT_VERIFIED: no answer isn't a
    clean one.
    """
    own = _own_versions(deps)
    found = _advisories_of_versions(own, entries)
    single, several = _divided(own, found)
    of_many = several.groupBy("dep_id").agg(F.collect_list("advisory_id").alias("_all"))
    of_one = found.select(*(F.col(c).alias(f"_{c}") for c in _VERSION), F.array_compact("ids").alias("_own"))
    rows = deps.join(single.select("dep_id", *(F.col(c).alias(f"_{c}") for c in _VERSION)), "dep_id", "left").join(of_many, "dep_id", "left")
    rows = rows.join(of_one, [f"_{c}" for c in _VERSION], "left").withColumn("advisory_ids", F.sort_array(F.coalesce("_own", "_all")))
    status = F.when(F.lit(not answered) | F.col("version").isNull(), "NOT_VERIFIED")
    status = status.when(F.col("advisory_ids").isNotNull(), "VULNERABLE").otherwise("NO_KNOWN_VULNERABILITIES")
    ids = F.coalesce("advisory_ids", F.array().cast("array<string>")) if answered else F.array().cast("array<string>")
    return rows.select(*(deps[c] for c in deps.columns), status.alias("vuln_status"), ids.alias("advisory_ids"))
