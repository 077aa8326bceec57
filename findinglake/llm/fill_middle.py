"""Fill-in-middle transformation by escaped markers, with Spark's string functions only.

A text is cut into units (code points, words or lines) by a pattern, and a prefix and a middle of given numbers of units
are taken.  One delimiter character marks the end of each unit, so that units are counted by counting it and parts
of given ranks are cut out with substring_index, whatever the pattern is:

1. the delimiter and the escape character are escaped wherever the text holds them, so the delimiter stands nowhere;
2. regexp_replace appends the delimiter to each unit, an escaped pair being one character;
3. delimiters are counted, the two places are drawn from a hash of the id, and substring_index cuts the parts;
4. delimiters are taken out of the parts, escapes are undone, and the parts are put together around the markers.

Everything is a row's own expression: no shuffle, and a lost executor's rows are made again with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_END, _ESC = "\x01", "\x02"  # the delimiter and the escape character
# Patterns over an escaped text.  Neither the escape character nor the letters of its pairs are white space, so that words
# and lines need only classes of characters, which Java repeats without recursion however long a text is.
UNITS = {
    "char": f"{_ESC}[de]|[^{_ESC}]",
    "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+",  # with the white space that follows
    "line": r"[^\n]*\n|[^\n]+",  # with its end
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escape(text: Column) -> Column:
    """text without the delimiter: it and the escape character become pairs that begin with the escape character."""
    return F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "e")), F.lit(_END), F.lit(_ESC + "d"))


def unescape(part: Column) -> Column:
    """The text of a part of a marked text: its delimiters go and its pairs become characters again."""
    bare = F.replace(part, F.lit(_END), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESC + "d"), F.lit(_END)), F.lit(_ESC + "e"), F.lit(_ESC))


def marked(text: Column, unit: str = "char") -> Column:
    """text, escaped, with the delimiter after each of its units."""
    return F.regexp_replace(escape(text), F.lit(f"(?s){UNITS[unit]}"), F.lit("$0" + _END))


def count_units(marks: Column) -> Column:
    return (F.octet_length(marks) - F.octet_length(F.replace(marks, F.lit(_END), F.lit("")))).cast("long")


def _ranked(marks: Column, count: Column) -> Column:
    return F.call_function("substring_index", marks, F.lit(_END), count.cast("int"))


def _draw(seed: str, doc_id: Column, n: int) -> Column:
    """The n-th group of eight digits of the hash of seed, a colon and the id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * n - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """docs with n, form, prefix, middle, suffix and output.

    n is the text's number of units.  `plain` of 100 documents keep their order, as do empty texts and those that hold
    a marker; of the others `spm` of 100 put the suffix first.  prefix, middle and suffix are null for plain ones.
    A null text is empty.  A row without doc_id is drawn like one with an empty id, so all such rows of one length are
    cut alike; repeated rows give equal results.  Other columns are kept, but for those named like results, which are
    replaced.  An empty table gives an empty one.
    """
    made = ["n", "form", "prefix", "middle", "suffix", "output"]
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(others.alias("row"), F.col("doc_id").alias("id"), text.alias("text"), marked(text, unit).alias("marks"))
    rows = rows.withColumn("n", count_units(F.col("marks")))
    places = [F.pmod(_draw(seed, F.col("id"), i), F.col("n") + 1) for i in (1, 2)]
    has_marker = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    is_plain = (F.col("text") == "") | has_marker | (F.pmod(_draw(seed, F.col("id"), 3), F.lit(100)) >= 100 - plain)
    form = F.when(is_plain, "plain").when(F.pmod(_draw(seed, F.col("id"), 4), F.lit(100)) < spm, "spm").otherwise("psm")
    rows = rows.withColumns({"from": F.least(*places), "to": F.greatest(*places), "form": form})
    cut, marks = F.col("form") != "plain", F.col("marks")
    parts = {
        "prefix": _ranked(marks, F.col("from")),
        "middle": F.when(F.col("from") == F.col("to"), "").otherwise(_ranked(_ranked(marks, F.col("to")), F.col("from") - F.col("to"))),
        "suffix": _ranked(marks, F.col("to") - F.col("n") - 1),  # the last delimiter ends the text
    }
    rows = rows.withColumns({k: F.when(cut, unescape(v)) for k, v in parts.items()})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    swapped = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(~cut, F.col("text")).when(F.col("form") == "psm", psm).otherwise(swapped)
    return rows.select("row.*", *made[:5], output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output of the form given, exact: no text that was cut holds a marker."""

    def side(s: Column, marker: str, count: int) -> Column:
        return F.substring_index(s, marker, count)

    middle, rest = side(output, MIDDLE, -1), side(output, MIDDLE, 1)
    psm = F.concat(F.substr(side(rest, SUFFIX, 1), F.lit(len(PREFIX) + 1)), middle, side(rest, SUFFIX, -1))
    spm = F.concat(side(rest, PREFIX, -1), middle, F.substr(side(rest, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
