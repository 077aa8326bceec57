"""Greedy correlation of scanner reports: reports of one issue by several scanners become one group.

Reports of one (path, family) join the first group whose first member lies within two lines, or on the same line when
that member's scanner is the report's own.  The order of reports decides, so the fold is sequential, but reports
further than two lines from their neighbours can't meet: lines are first cut into islands, which are independent, so
a hot file is not one task.  Within an island reports that repeat a (line, scanner) always join the same group as the
first of them, so only that one takes part.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 2


def fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """One island: anchor (line and scanner of the first member) of each distinct (line, scanner)."""
    pdf = pdf.sort_values(["ord", "line", "scanner"])
    at: dict[int, list[tuple[int, str]]] = {}
    anchors, lines, scanners = 0, [], []
    for line, scanner in zip(pdf["line"].tolist(), pdf["scanner"].tolist()):
        near = [g for k in range(line - WINDOW, line + WINDOW + 1) for g in at.get(k, ()) if k == line or g[1] != scanner]
        g = min(near, default=None)
        if g is None:
            g = (anchors, scanner, line)
            at.setdefault(line, []).append(g)
            anchors += 1
        lines.append(g[2])
        scanners.append(g[1])
    return pdf[["path", "family", "line", "scanner"]].assign(anchor_line=lines, anchor_scanner=scanners)


def correlate(reports: DataFrame) -> DataFrame:
    """reports (path, family, line int, scanner, ord) -> the distinct (path, family, line, scanner) with their anchor.

    ord orders reports; ties go by line and scanner.  Reports without a path or line never merge and don't stand in
    the result.
    """
    rows = reports.where("path is not null and line is not null").groupBy("path", "family", "line", "scanner").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("path", "family").orderBy("line")
    lines = rows.select("path", "family", "line").distinct()
    begins = F.coalesce(F.col("line") - F.lag("line").over(w) > WINDOW, F.lit(True))
    lines = lines.withColumn("island", F.sum(begins.cast("int")).over(w))
    schema = "path string, family string, line int, scanner string, anchor_line int, anchor_scanner string"
    return rows.join(lines, ["path", "family", "line"]).groupBy("path", "family", "island").applyInPandas(fold, schema)


def corroborated(groups: DataFrame) -> DataFrame:
    """Per group: its lines, and whether two or more scanner families agree (names up to ':')."""
    base = F.split_part("scanner", F.lit(":"), F.lit(1))
    return groups.groupBy("path", "family", "anchor_line", "anchor_scanner").agg(
        F.count("*").alias("members"), F.count_distinct(base).alias("scanners")
    )
