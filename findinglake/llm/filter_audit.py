"""Audit of filters that act one after another: what each removes in every order in which they can be applied.

A direct replay: each document's failures are crossed with the 120 orders of five filters, each order is exploded into
its five steps, the first failure says at which step the document goes, and steps are counted by conditional sums.
Documents of one part that fail the same filters and have the same labels behave alike, so they are folded to one row
with a count before the replay (combined on the map side), and the replay's size doesn't grow with the input.

Whether a text is equal to that of a smaller doc_id is found from SHA-256 digests, so texts are read once and not shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * 65,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and set of failures: part, A to E, good, toxic and n, the number of documents.

    E fails for a text equal to that of a row with a smaller doc_id, anywhere in the table.  Rows without doc_id count
    as the last ones and aren't later than each other; repeated rows neither.  A null text is empty, a null source the
    empty part.  Of several labels of one id, quality 1 and toxic 1 win; labels without id are left out.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), *[v.alias(k) for k, v in text_failures(F.col("text")).items()])
    # Equal rows first; rows without id are spread over the join's tasks by their text, as labels have no such rows.
    keys = ["doc_id", "part", "key", *LETTERS[:4]]
    rows = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("key", "part")).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        (F.max((F.col("quality") == 1).cast("int")) == 1).alias("good"), (F.max((F.col("toxic") == 1).cast("int")) == 1).alias("toxic")
    )
    marks = marks.withColumn("spread", F.lit(0).cast("long"))
    rows = rows.join(marks, ["doc_id", "spread"], "left").na.fill(False, ["good", "toxic"])
    # The first id of each text in each part, then of each text: both combine on the map side, so a text that a third
    # of all rows share isn't one task's load.  `first` rows have the smallest id of their part's rows of the text.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    by_text = rows.groupBy("key", "part", *LETTERS[:4], "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(order).alias("least"), F.min_by("n", order).alias("first")
    )
    is_first = F.col("least") == F.min("least").over(Window.partitionBy("key"))
    by_text = by_text.withColumn("firsts", F.when(is_first, F.col("first")).otherwise(0))
    kinds = F.array(
        F.struct(F.lit(False).alias("E"), F.col("firsts").alias("n")),
        F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("firsts")).alias("n")),
    )
    split = by_text.select("part", *LETTERS[:4], "good", "toxic", F.explode(kinds).alias("kind"))
    split = split.select("part", *LETTERS[:4], F.col("kind.E").alias("E"), "good", "toxic", F.col("kind.n").alias("n"))
    return split.groupBy("part", *LETTERS, "good", "toxic").agg(F.sum("n").alias("n"))


def replay(failed: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant and lost, and the filter's Shapley sum."""
    spark = failed.sparkSession
    orders = spark.range(1).select(F.explode(F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])).alias("filter_order"))
    fails = F.create_map(*[x for c in LETTERS for x in (F.lit(c), F.col(c))])
    crossed = failed.withColumns({"fails": fails, "failures": sum(F.col(c).cast("int") for c in LETTERS)}).crossJoin(F.broadcast(orders))  # 120 rows
    letters = F.transform(F.sequence(F.lit(1), F.lit(len(LETTERS))), lambda i: F.struct(i.alias("step"), F.substr("filter_order", i, F.lit(1)).alias("letter")))
    first = F.array_min(F.transform(F.filter(letters, lambda x: F.col("fails")[x.letter]), lambda x: x.step))
    crossed = crossed.withColumn("first", F.coalesce(first, F.lit(len(LETTERS) + 1)))
    steps = crossed.select("*", F.explode(letters).alias("s")).select("*", "s.step", "s.letter")
    fails_here, gone = F.col("fails")[F.col("letter")], F.col("first") == F.col("step")
    cases = [F.col("first") > F.col("step"), gone, fails_here & (F.col("first") < F.col("step")), fails_here & (F.col("failures") == 1), gone & F.col("good"), gone & F.col("toxic")]
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in zip(_COUNTS, cases)]
    table = steps.groupBy("part", "filter_order", "step", "letter").agg(*sums)
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))  # 120 rows
    return table.withColumn("shapley", shapley).select("part", "filter_order", "step", *_COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay over documents: 600 rows for each source, and none for an empty table.

    docs needs doc_id, text and source, labels doc_id, quality and toxic; other columns are not read.
    """
    return replay(failures(docs, labels))
