"""The island fold equals the sequential greedy fold over all reports."""

import random

from findinglake.operators.correlate import correlate


def _brute(rows):
    groups, out = {}, {}
    for path, family, line, scanner, _ in sorted(rows, key=lambda r: (r[4], r[2], r[3])):
        own = groups.setdefault((path, family), [])
        for a_line, a_scanner in own:
            if abs(line - a_line) <= (0 if a_scanner == scanner else 2):
                break
        else:
            a_line, a_scanner = line, scanner
            own.append((line, scanner))
        out.setdefault((path, family, line, scanner), (a_line, a_scanner))
    return out


def test_equals_sequential_fold(spark):
    rnd = random.Random(3)
    rows = [(f"p{rnd.randrange(3)}", "sql", rnd.randrange(60), f"s{rnd.randrange(3)}", i) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, "sql", 1, "s0", 1), ("p0", "sql", None, "s0", 2)], "path string, family string, line int, scanner string, ord long")
    got = {(r.path, r.family, r.line, r.scanner): (r.anchor_line, r.anchor_scanner) for r in correlate(df).collect()}
    assert got == _brute(rows)
