"""Comparison of scans where changed code may still hold the same finding.

Findings take partners in their order, each the best that is free.  Only findings of one place (path, class and kind) can
be partners, so each place is settled on its own as its rows come in sorted: the current findings, folded where nothing
but their order tells them apart, then the others one by one.  Pairs are looked up there and never listed.

A place with more findings than a task should hold is settled by its pairs: found by blocks of lines and by functions,
compared once for each two texts, and divided into groups of connected pairs; in a group too large for a task, every pair
that nothing before it can change is settled at once, round after round, until what is left falls apart.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from findinglake.functions.columns import normalise_code
from findinglake.operators.components import smallest_linked
from findinglake.storage import written

# Lines that count as near, and the least similarity.
NEAR_LINES = 15
SIMILARITY = 0.6

_PLACE = ["path", "vuln_class", "source_kind"]

_MOST = 1 << 22  # numbers that a place remembers of what it has looked up, for each kind of them
_NONE = np.iinfo(np.int64).max


def _ratio(a: str | None, b: str | None) -> float | None:
    """The ratio of matching blocks if it is SIMILARITY or more; what two texts share of each character bounds it."""
    m = difflib.SequenceMatcher(None, a or "", b or "")
    if m.real_quick_ratio() < SIMILARITY or m.quick_ratio() < SIMILARITY or (r := m.ratio()) < SIMILARITY:
        return None
    return r


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two short texts, null below SIMILARITY; it has no built-in counterpart."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


# Not deterministic, so that it isn't moved below the distinct and run for each pair of findings.
_similarity = similarity.asNondeterministic()


def candidate_pairs(pending: DataFrame, unmatched: DataFrame) -> DataFrame:
    """base, cur and score of pairs that may be the same finding.

    Both sides have id, ord, path, vuln_class, source_kind, function, line, snippet, rule_id.  A pair has equal path,
    class and kind, the same function or lines at most 15 apart, and similar code.  Lines meet by blocks of 15 and
    functions by name, so a file with many findings isn't compared with itself as a whole.
    """
    cols = ["id", "ord", *_PLACE, "function", "line", "rule_id"]
    b = pending.select(*cols, F.coalesce(normalise_code(F.col("snippet")), F.lit("")).alias("code"))
    c = unmatched.select(*(F.col(x).alias(x if x in _PLACE else f"c_{x}") for x in cols), F.coalesce(normalise_code(F.col("snippet")), F.lit("")).alias("c_code"))
    block = F.floor(F.col("line") / NEAR_LINES)
    by_line = b.where("line is not null").withColumn("block", F.explode(F.array(block - 1, block, block + 1))).join(
        c.where("c_line is not null").withColumn("block", F.floor(F.col("c_line") / NEAR_LINES)), [*_PLACE, "block"]
    )
    near = F.abs(F.col("line") - F.col("c_line")) <= NEAR_LINES
    by_line = by_line.where(near).drop("block")
    named = F.col("function") == F.col("c_function")
    by_name = b.where("function <> ''").join(c.where("c_function <> ''").withColumn("function", F.col("c_function")), [*_PLACE, "function"])
    # A pair that is near as well came by its lines already.
    by_name = by_name.where(~F.coalesce(near, F.lit(False))).select(*by_line.columns)
    pairs = by_line.unionByName(by_name)
    # The shorter text bounds the ratio from above; what is left is compared once for each two texts.
    both = F.length("code") + F.length("c_code")
    pairs = pairs.where(2 * F.least(F.length("code"), F.length("c_code")) >= SIMILARITY * both)
    texts = pairs.select("code", "c_code").distinct().withColumn("sim", _similarity("code", "c_code")).where("sim is not null")
    pairs = pairs.join(texts, ["code", "c_code"])
    bonus = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    score = F.col("sim") + bonus(named & (F.col("function") != ""), 0.5) + bonus(near, 0.3) + bonus(F.col("rule_id") == F.col("c_rule_id"), 0.2)
    return pairs.select(*_PLACE, F.col("id").alias("base"), "ord", F.col("c_id").alias("cur"), F.col("c_ord").alias("cur_ord"), score.alias("score"))


def _take(pdf: pd.DataFrame) -> pd.DataFrame:
    """base and cur of whole groups of connected pairs: the sequential rule itself."""
    free, rows = set(pdf["cur"]), []
    ordered = pdf.sort_values(["ord", "base", "score", "cur_ord", "cur"], ascending=[True, True, False, True, True])
    for base, own in ordered.groupby(["ord", "base"], sort=True):
        for cur in own["cur"]:
            if cur in free:
                free.discard(cur)
                rows.append((base[1], cur))
                break
    return pd.DataFrame(rows, columns=["base", "cur"])


def _settled(pairs: DataFrame) -> DataFrame:
    """base and cur of the pairs that are final: the base's best one, and no base before it has a pair with that cur."""
    best = pairs.groupBy("base").agg(F.min_by(F.struct("ord", "cur"), F.struct(-F.col("score"), "cur_ord", "cur")).alias("x")).select("base", "x.ord", "x.cur")
    first = pairs.groupBy("cur").agg(F.min(F.struct("ord", "base")).alias("y"))
    return best.join(first, "cur").where((F.col("y.base") == F.col("base"))).select("base", "cur")


def assigned(pairs: DataFrame, bound: int = 50_000, rounds: int = 3) -> DataFrame:
    """base and cur: in the order of ord (ties: base) each base takes its best free cur (score, then the smaller cur_ord).

    pairs: base, ord, cur, cur_ord, score; base and cur are texts.  No task has more pairs than two groups of `bound`;
    larger groups of connected pairs take `rounds` rounds and are divided again.
    """
    left, done = written(pairs.select("base", "ord", "cur", "cur_ord", "score")), []
    while True:
        if left.count() <= bound:  # one task's work: no need to know the groups
            done.append(left.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_take, "base string, cur string"))
            return reduce(DataFrame.unionByName, done)
        links = left.select(F.concat(F.lit("c"), "cur").alias("node"), F.concat(F.lit("b"), "base").alias("to"))
        label, _ = smallest_linked(links)
        own = F.concat(F.lit("b"), "base")
        grouped = left.join(label.select(F.expr("substring(node, 2)").alias("base"), F.col("to").alias("label")).where("node like 'b%'"), "base", "left")
        grouped = written(grouped.withColumn("label", F.coalesce("label", own)))
        sizes = grouped.groupBy("label").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > bound).select("label")
        small = grouped.join(large, "label", "left_anti")
        parts = max(1, -(-grouped.count() // bound))
        done.append(small.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(parts))).drop("label").groupBy("part").applyInPandas(_take, "base string, cur string"))
        left = written(grouped.join(large, "label", "left_semi").drop("label"))
        for _ in range(rounds):
            final = written(_settled(left))
            done.append(final)
            left = written(left.join(final.select("base"), "base", "left_anti").join(final.select("cur"), "cur", "left_anti"))


class _Place:
    """The free current findings of one place.

    Findings with equal function, line, rule and code are one class: to any other finding they differ in their order
    alone, so a class is a queue whose first one is always the next to be taken.
    """

    def __init__(self):
        self.class_of: dict[tuple, int] = {}
        self.members: list[list] = []
        self.left = self.size = 0
        self.ready = False

    def add(self, key: tuple, row: tuple) -> None:
        """The next finding in the order of cur_ord and cur; key: function, line, rule, code."""
        at = self.class_of.setdefault(key, len(self.members))
        if at == len(self.members):
            self.members.append([])
        self.members[at].append((self.size, row))
        self.size += 1
        self.left += 1

    def rest(self) -> Iterator[tuple]:
        return (row for own in self.members for _, row in own)

    def _prepare(self) -> None:
        keys, self.codes, self.rule_ids = list(self.class_of), {}, {}
        named: dict[str, list] = {}
        for i, (function, *_) in enumerate(keys):
            if function:
                named.setdefault(function, []).append(i)
        self.by_function = {k: np.array(v, np.int64) for k, v in named.items()}
        self.functions = np.full(len(keys), -1, np.int64)  # each by the first class that has it
        for own in self.by_function.values():
            self.functions[own] = own[0]
        self.lines = np.array([np.nan if k[1] is None else k[1] for k in keys], np.float64)
        self.by_line = np.argsort(self.lines, kind="stable")[: np.count_nonzero(~np.isnan(self.lines))]
        self.sorted_lines = self.lines[self.by_line]
        self.rules = np.array([-1 if k[2] is None else self.rule_ids.setdefault(k[2], len(self.rule_ids)) for k in keys], np.int64)
        self.code = np.array([self.codes.setdefault(k[3], len(self.codes)) for k in keys], np.int64)
        self.texts = list(self.codes)
        self.heads = np.array([m[0][0] for m in self.members], np.int64)
        for m in self.members:
            m.reverse()
        self.sims: dict[str, np.ndarray] = {}
        self.lists: dict[tuple, list] = {}
        self.listed = 0
        self.ready = True

    def _similar(self, code: str, at: np.ndarray) -> np.ndarray:
        """The similarity of a text to those of some classes, each two texts compared once; -1 below the least."""
        known = self.sims.get(code)
        if known is None:
            if len(self.sims) * len(self.texts) > _MOST:
                self.sims.clear()
            known = self.sims[code] = np.full(len(self.texts), np.nan)
        other = self.code[at]
        for i in set(other[np.isnan(known[other])].tolist()):
            r = _ratio(code, self.texts[i])
            known[i] = -1.0 if r is None else r
        return known[other]

    def _levels(self, key: tuple) -> list[np.ndarray]:
        """The classes that may be the same finding, those of equal score together, the lowest score first."""
        function, line, rule, code = key
        own = self.by_function.get(function) if function else None
        at = np.empty(0, np.int64) if own is None else own
        if line is not None:
            low, high = np.searchsorted(self.sorted_lines, line - NEAR_LINES), np.searchsorted(self.sorted_lines, line + NEAR_LINES, "right")
            close = self.by_line[low:high]
            at = close if own is None else np.concatenate([own, close[self.functions[close] != own[0]]])
        at = at[self.heads[at] < _NONE]
        sim = self._similar(code, at)
        at, sim = at[sim >= 0], sim[sim >= 0]
        if not at.size:
            return []
        score = sim + np.where(self.functions[at] == (-2 if own is None else own[0]), 0.5, 0.0)
        if line is not None:
            score += np.where(np.abs(self.lines[at] - line) <= NEAR_LINES, 0.3, 0.0)
        score += np.where(self.rules[at] == self.rule_ids.get(rule, -2), 0.2, 0.0)
        order = np.argsort(score)
        return np.split(at[order], np.flatnonzero(np.diff(score[order])) + 1)

    def take(self, key: tuple) -> bool:
        """Takes the best free finding for one with this key, if there is any; `taken` is its row then."""
        if not self.left:
            return False
        if not self.ready:
            self._prepare()
        levels = self.lists.get(key)
        if levels is None:
            if self.listed > _MOST:
                self.lists.clear()
                self.listed = 0
            levels = self.lists[key] = self._levels(key)
            self.listed += sum(x.size for x in levels)
        while levels:
            heads = self.heads[levels[-1]]
            i = int(heads.argmin())
            if heads[i] == _NONE:  # taken, all of them, for good
                self.listed -= levels.pop().size
                continue
            at = levels[-1][i]
            _, self.taken = self.members[at].pop()
            self.heads[at] = self.members[at][-1][0] if self.members[at] else _NONE
            self.left -= 1
            return True
        return False


_HOME = [f"home_{c}" for c in _PLACE]
_SETTLED = "id string, now boolean, nth int, met boolean, was boolean, path string, base string, moved boolean, cur string"


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by home, then current ones before others, ord, id and nth, with what they took.

    Current rows that were taken are left out.  Only the first row of an id takes; others of that id share its fate.
    """
    names = [x.split(" ")[0] for x in _SETTLED.split(", ")]
    home, free, last, moved, cur = None, _Place(), None, False, None
    for pdf in batches:
        rows: list[tuple] = []
        cells = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in (*_HOME, "function", "line", "rule_id", "code", "id", "now", "nth", "met", "was", "path", "base")]
        for p, c, k, function, line, rule, code, id_, now, nth, met, was, path, base in zip(*cells):
            if (p, c, k) != home:
                rows.extend(free.rest())
                home, free = (p, c, k), _Place()
            if now:
                free.add((function, line, rule, code), (id_, True, nth, met, was, path, base, False, None))
                continue
            if id_ is None or met or None in home:
                moved, cur = False, None
            elif nth == 1 or id_ != last:
                moved = free.take((function, line, rule, code))
                cur = free.taken[0] if moved else None
            last = id_
            rows.append((id_, False, nth, met, was, path, base, moved, cur))
        yield pd.DataFrame(rows, columns=names)
    yield pd.DataFrame(list(free.rest()), columns=names)


def _settled_rows(rows: DataFrame, large: DataFrame | None, bound: int) -> DataFrame:
    """Rows as _settle gives them.

    rows: home (place of an id's first row), id, ord, now, nth, met (has a counterpart and looks for none), was, path,
    base, function, line, rule_id, snippet.  large: places to be settled by pairs.
    """
    if large is not None:
        homes = large.select(*(F.col(c).alias(h) for c, h in zip(_PLACE, _HOME)))
        rest, rows = rows.join(homes, _HOME, "left_semi"), rows.join(homes, _HOME, "left_anti")
    code = F.when(~F.col("met"), F.coalesce(normalise_code(F.col("snippet")), F.lit(""))).alias("code")
    small = rows.select(*_HOME, "now", "ord", "id", "nth", "met", "was", "path", "base", "function", F.col("line").cast("double").alias("line"), "rule_id", code)
    # Places cost time rather than bytes, so their number of tasks isn't left to the bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = small.repartition(parts, *_HOME).sortWithinPartitions(*_HOME, F.desc("now"), "ord", "id", "nth").mapInPandas(_settle, _SETTLED)
    if large is None:
        return done
    alone = rest.where("nth = 1 and not met").select(*(F.col(h).alias(c) for c, h in zip(_PLACE, _HOME)), "id", "ord", "now", "function", "line", "rule_id", "snippet")
    found = written(assigned(candidate_pairs(alone.where("not now"), alone.where("now")), bound))
    rest = rest.join(found.withColumnRenamed("base", "id"), "id", "left").join(found.select(F.col("cur").alias("id"), F.lit(True).alias("gone")), "id", "left")
    rest = rest.where("not now or gone is null").withColumn("moved", ~F.col("now") & F.col("cur").isNotNull())
    return done.unionByName(rest.select(*done.columns))


def _large(counted: DataFrame, most: int) -> DataFrame | None:
    """Places with more findings than `most` of rows with a column n, or None."""
    found = written(counted.groupBy(*_PLACE).agg(F.sum("n").alias("n")).where(F.col("n") > most).select(*_PLACE))
    return found if found.limit(1).count() else None


def fuzzy_matches(pending: DataFrame, unmatched: DataFrame, bound: int = 50_000, most: int = 300_000) -> DataFrame:
    """base and cur: in order of ord each pending finding takes its best free candidate (ties: the smaller cur_ord).

    Ids are texts, each once on its side.  A place with more findings than `most` is settled by its pairs, in groups of
    `bound` pairs.
    """
    cols = ["id", "ord", *_PLACE, "function", "line", "snippet", "rule_id"]
    rows = pending.select(*cols, F.lit(False).alias("now")).unionByName(unmatched.select(*cols, F.lit(True).alias("now")))
    large = _large(rows.groupBy(*_PLACE).agg(F.count("*").alias("n")), most)
    rows = rows.select(
        "*", *(F.col(c).alias(h) for c, h in zip(_PLACE, _HOME)), F.lit(1).alias("nth"), F.lit(False).alias("met"),
        F.lit(None).cast("boolean").alias("was"), F.lit(None).cast("string").alias("base"),
    )
    return _settled_rows(rows, large, bound).where("moved").select(F.col("id").alias("base"), "cur")


def _few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, told to Spark as small if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def compare_scans_fuzzy(baseline: DataFrame, current: DataFrame, history: DataFrame, partial: bool = False, bound: int = 50_000, most: int = 300_000) -> DataFrame:
    """fingerprint, result and method of each finding: as compare_scans, but a finding without exact counterpart that
    fuzzily matches a new one is STILL_OPEN, and the new one isn't reported again.

    baseline, current: fingerprint, path, scanner and the columns of candidate_pairs but id and ord.  Whole rows are
    shuffled once by fingerprint and once by place, nothing else of them; `bound` and `most` as in fuzzy_matches.
    """
    cols = ["fingerprint", "path", "scanner", "vuln_class", "source_kind", "function", "line", "snippet", "rule_id"]
    both = baseline.select(*cols, F.lit(False).alias("now")).unionByName(current.select(*cols, F.lit(True).alias("now")))
    base = F.split_part("scanner", F.lit(":"), F.lit(1)).alias("base")
    counted = written(both.groupBy(*_PLACE, base, "now").agg(F.count("*").alias("n")))
    seen = counted.where("now")
    paths = _few(seen.select("path").distinct().withColumn("analysed", F.lit(True)))
    ran = _few(seen.select("base").distinct().withColumn("ran", F.lit(True)))

    same = Window.partitionBy("fingerprint")
    first = Window.partitionBy("fingerprint", "now").orderBy("path", "scanner")
    rows = both.repartition("fingerprint").withColumns({"nth": F.row_number().over(first), "home": F.first(F.struct(*_PLACE)).over(first)})
    rows = rows.where("not now or nth = 1")
    rows = rows.withColumn("met", F.col("fingerprint").isNotNull() & (F.min("now").over(same) != F.max("now").over(same)))
    before = history.select("fingerprint").distinct().withColumn("was", F.lit(True))
    rows = rows.where("not (now and met)").join(before, "fingerprint", "left")
    rows = rows.select(
        *(F.col("home")[c].alias(h) for c, h in zip(_PLACE, _HOME)), F.col("fingerprint").alias("id"), F.col("fingerprint").alias("ord"),
        "now", "nth", "met", "was", "path", base, *(F.when(~F.col("met"), F.col(c)).alias(c) for c in ("function", "line", "rule_id", "snippet")),
    )
    known = _settled_rows(rows, _large(counted, most), bound).join(paths, "path", "left").join(ran, "base", "left")
    gone = F.when(F.col("path").isNotNull() & F.col("analysed").isNull(), "NOT_TESTED" if partial else "NOT_REPRODUCED")
    gone = gone.when(F.col("ran").isNull(), "NOT_TESTED").otherwise("RESOLVED")
    result = F.when(F.col("now"), F.when(F.col("was"), "REGRESSION").otherwise("NEW"))
    result = result.when(F.col("moved") | F.col("met") & (F.col("nth") == 1), "STILL_OPEN").otherwise(gone)
    method = F.when(F.col("moved"), "FUZZY").when(result.isin("STILL_OPEN", "REGRESSION"), "FINGERPRINT").otherwise("NONE")
    return known.select(F.col("id").alias("fingerprint"), result.alias("result"), method.alias("method"))
