"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, fill_middle, filter_audit, html_text, licenses, lm_score, packing, partenum, piece_lattice, quality_mcd, sharding, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_digest(_table(spark, sf_dir, "documents"))


def op2_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encode(_table(spark, sf_dir, "documents"))


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents labelled as of good quality."""
    target = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(_table(spark, sf_dir, "documents"), target)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.quality_rules(_table(spark, sf_dir, "documents")).drop("n_upper", "n_shout", "n_lines")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_groups(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle_digest(_table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_sentencepiece_lattice,
        op3_cross_entropy_difference,
        op4_embedding_near_dedup,
        op5_hypergeometric_shards,
        op6_license_scan,
        op7_quality_rules,
        op8_best_fit_packing,
        op9_ngram_jaccard,
        op10_toxicity,
        op11_fill_in_middle,
        op12_html_extraction,
        op13_filter_interaction_audit,
    )
}

_COMPONENTS = """
reach(x, y) as (
    select id, id from nodes
    union
    select r.x, l.y from reach r join links l on r.y = l.x
),
least as (select x, min(y) as component_id from reach group by x)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    # Texts are cut into pieces of 1024 starts (and 49 bytes more), so that no row holds a whole text for each of its
    # bytes; windows whose 64-bit hash stands in one document only are dropped before their bytes are compared.
    "op1_suffix_dedup": """
        with d as (select coalesce(doc_id, 9223372036854775807) as id, doc_id, row_number() over () as n, hex(encode(coalesce(text, ''))) as h from documents),
        pieces as (select id, n, b, substr(h, 2 * b + 1, 2 * (1024 + 49)) as p from (select id, n, h, unnest(range(0, length(h) // 2, 1024)) as b from d)),
        places as (select id, n, b, o, p from (select id, n, b, p, unnest(range(0, least(1024, length(p) // 2 - 49))) as o from pieces where length(p) >= 100)),
        hashed as (select id, n, b, o, hash(substr(p, 2 * o + 1, 100)) as k from places),
        shared as (select k from hashed group by k having min(id) < max(id)),
        repeated as (select h.id, h.n, h.b, h.o, substr(p.p, 2 * h.o + 1, 100) as w from hashed h semi join shared using (k) join pieces p on p.n = h.n and p.b = h.b),
        firsts as (select w, min(id) as first from repeated group by w having min(id) < max(id)),
        starts as (select n, b + o as pos from repeated join firsts using (w) where first < id),
        begun as (select n, pos, coalesce(pos > lag(pos) over (partition by n order by pos) + 50, true) as new from starts),
        numbered as (select n, pos, sum(cast(new as integer)) over (partition by n order by pos) as i from begun),
        runs as (select n, i, min(pos) as s, max(pos) + 50 as e from numbered group by n, i),
        gaps as (
            select n, coalesce(lag(e) over (partition by n order by s), 0) as s, s as e from runs
            union all select n, max(e), null from runs group by n),
        kept as (select n, string_agg(substr(h, 2 * s + 1, 2 * (coalesce(e, length(h) // 2) - s)), '' order by s) as kept from gaps join d using (n) group by n),
        sums as (select n, sum(e - s) as gone, count(*) as runs from runs group by n)
        select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(runs, 0) as bigint) as n_spans,
            sha256(unhex(coalesce(kept, h))) as kept_sha256
        from d left join sums using (n) left join kept using (n)
    """,
    "op4_embedding_near_dedup": f"""
        with recursive v as (select vec_id as id, label, embedding::double[] as e from embeddings),
        nodes as (
            select * from v
            where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
                and list_dot_product(e, e) > 0),
        links as (
            select a.id as x, b.id as y from nodes a join nodes b
            on a.label = b.label and a.id <> b.id and list_cosine_similarity(a.e, b.e) >= 0.98),
        {_COMPONENTS},
        counts as (select x, count(*) as n from links group by x)
        select v.id as vec_id, cast(coalesce(n, 0) as bigint) as n_links,
            coalesce(component_id, v.id) as component_id, v.id = coalesce(component_id, v.id) as kept
        from v left join counts on counts.x = v.id left join least on least.x = v.id
    """,
    "op9_ngram_jaccard": f"""
        with recursive w as (
            select doc_id as id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        nodes as (
            select id, list_distinct(list_transform(
                range(1, case when len(w) = 0 then 1 else greatest(len(w) - 3, 2) end),
                lambda i: array_to_string(w[i : i + 4], ' '))) as s
            from w),
        items as (select id, unnest(s) as item from nodes),
        shared as (
            select a.id as x, b.id as y, count(*) as n from items a join items b on a.item = b.item and a.id <> b.id
            group by all),
        links as (
            select x, y from shared join nodes a on a.id = x join nodes b on b.id = y
            where 100 * n >= 80 * (len(a.s) + len(b.s) - n)),
        {_COMPONENTS}
        select id as doc_id, cast(len(s) as bigint) as n_shingles, component_id
        from nodes join least on least.x = nodes.id
    """,
    "op11_fill_in_middle": """
        with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        drawn as (
            select doc_id, t, length(t) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
                cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
            from d),
        cut as (
            select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
                    when h4 % 100 < 20 then 'spm' else 'psm' end as form
            from drawn),
        made as (
            select *, case form when 'plain' then t
                when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end as output
            from cut)
        select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
            sha256(output) as output_sha256, sha256(t) as restored_sha256
        from made
    """,
    # These pages hold one article element each, and no other of the elements that the operator leaves out is in it.
    "op12_html_extraction": r"""
        with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article\b[^>]*>(.*?)(?:</article>|$)', 1) as x from pages),
        lines as (
            select page_id, url, unnest(string_split(regexp_replace(replace(x, '<br>', ' '), '</?(?:p|h1)>', chr(1), 'g'), chr(1))) as b,
                unnest(range(len(string_split(regexp_replace(replace(x, '<br>', ' '), '</?(?:p|h1)>', chr(1), 'g'), chr(1))))) as i
            from a),
        decoded as (
            select page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(
                regexp_replace(b, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as b
            from lines)
        select page_id, url, coalesce(string_agg(b, chr(10) order by i) filter (b <> ''), '') as text,
            cast(length(coalesce(string_agg(b, chr(10) order by i) filter (b <> ''), '')) as bigint) as n_chars, 'body>article' as path
        from decoded group by page_id, url
    """,
    "op13_filter_interaction_audit": r"""
        with marks as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
        d as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
            from documents),
        f as (
            select part, len(w) < 50 as A, 100 * len(list_distinct(w)) < 65 * len(w) as B,
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as C, regexp_matches(t, '[#$%&*|]') as D,
                coalesce(doc_id > min(doc_id) over (partition by t), min(doc_id) over (partition by t) is not null) as E,
                coalesce(good, false) as good, coalesce(toxic, false) as toxic
            from d left join marks using (doc_id)),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        orders as (
            select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
            where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        rows as (
            select part, good, toxic, [A, B, C, D, E] as v, count(*) as n from f group by all),
        steps as (
            select *, v[ascii(filter_order[step]) - 64] as fails,
                coalesce(list_min(list_filter(range(1, 6), lambda i: v[ascii(filter_order[i]) - 64])), 6) as first,
                len(list_filter(v, lambda x: x)) as many
            from rows, orders, (select unnest(range(1, 6)) as step)),
        counts as (
            select part, filter_order, cast(step as integer) as step, filter_order[step] as letter,
                coalesce(sum(n) filter (first > step), 0) as kept, coalesce(sum(n) filter (first = step), 0) as removed,
                coalesce(sum(n) filter (fails and first < step), 0) as redundant, coalesce(sum(n) filter (fails and many = 1), 0) as unique_fails,
                coalesce(sum(n) filter (first = step and good), 0) as good_lost, coalesce(sum(n) filter (first = step and toxic), 0) as toxic_lost
            from steps group by all)
        select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
            cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
            cast(sum(removed) over (partition by part, letter) as bigint) as shapley
        from counts
    """,
}
