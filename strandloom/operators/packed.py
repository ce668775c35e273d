"""Several values packed in one text field (problem 3), one row each, in order.

A text is split on its quote characters; odd pieces are literals, even pieces are split on the
delimiters, and array folds put the values back in order. All of it stays in Catalyst expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands between two values of a field.
HABITAT_DELIMITERS = r",;|/\t\n\r"
LIST_DELIMITERS = r",;|/&+\s\"'\[\]"

_MARK, _TWIN, _ESCAPE = "\u0001", "\u0002", "\u0003"


def split_unquoted(text: Column, delimiters: str = LIST_DELIMITERS) -> Column:
    """The values of a text in which quotes mean nothing; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{delimiters}]+"), lambda x: x != "")


def split_quoted(text: Column, delimiters: str = HABITAT_DELIMITERS) -> Column:
    """The values of a text whose quoted values may hold delimiters; null and blank texts have none.

    Only a quote at the start of a value opens one, and it runs to the next quote of its kind that is
    not doubled; a doubled one stands for itself. Opening and closing quotes become marks, the text
    is split on the marks, odd pieces stay whole and even pieces are split on the delimiters. A quote
    that never closes is a letter like any other at a value's edge and is trimmed off there.
    """
    bare = F.coalesce(text, F.lit(""))
    # Marks that stand in the text itself are written as an escape and a letter until the values are out.
    for mark, letter in ((_ESCAPE, "c"), (_MARK, "a"), (_TWIN, "b")):
        bare = F.replace(bare, F.lit(mark), F.lit(_ESCAPE + letter))
    bare = F.regexp_replace(bare, r"^\s*\[|\]\s*$", "")
    opening = rf"(?:^|(?<=[{delimiters}]))\s*+"
    double = r'"([^"]*+(?:""[^"]*+)*+)"'
    single = r"'([^']*+(?:''[^']*+)*+)'"
    marked = F.regexp_replace(bare, f"{opening}(?:{double}|{single})", f"{_MARK}$1{_TWIN}$2{_MARK}")
    pieces = F.split(marked, _MARK)

    def literal(piece: Column) -> Column:
        halves = F.split(piece, _TWIN)
        return F.trim(F.concat(F.replace(halves[0], F.lit('""'), F.lit('"')), F.replace(halves[1], F.lit("''"), F.lit("'"))))

    def values(piece: Column, i: Column) -> Column:
        plain = F.transform(F.split(piece, f"[{delimiters}]"), lambda x: F.regexp_replace(x, r"^[\s\[\]\"']+|[\s\[\]\"']+$", ""))
        return F.when(i % 2 == 1, F.array(literal(piece))).otherwise(plain)

    def restored(value: Column) -> Column:
        for mark, letter in ((_MARK, "a"), (_TWIN, "b"), (_ESCAPE, "c")):
            value = F.replace(value, F.lit(_ESCAPE + letter), F.lit(mark))
        return value

    return F.transform(F.filter(F.flatten(F.transform(pieces, values)), lambda x: x != ""), restored)


def unpack(df: DataFrame, source_table: str, row_key: str, values: Column) -> DataFrame:
    """One row per value, ``item_no`` from 1; rows without values give none."""
    return df.select(F.lit(source_table).alias("source_table"), F.col(row_key).cast("string").alias("row_key"), F.posexplode(values).alias("_i", "item")).select(
        "source_table", "row_key", (F.col("_i") + 1).cast("int").alias("item_no"), "item"
    )


def habitat_values(metadata: Column) -> Column:
    """The values of the key ``habitat`` at the top of a JSON text: of its text, or of its texts in turn.

    Invalid JSON, other JSON than an object, and a missing or null habitat have none.
    """
    habitat = F.from_json(F.when(metadata.rlike(r"^\s*\{"), metadata), "habitat variant")["habitat"]
    texts = F.coalesce(F.try_variant_get(habitat, "$", "array<string>"), F.array(F.try_variant_get(habitat, "$", "string")))
    return F.flatten(F.transform(F.filter(texts, lambda x: x.isNotNull()), lambda x: split_quoted(x)))


def packed_items(spark, directory: str) -> DataFrame:
    """All packed values of the three fields; rows delivered twice count once."""
    from strandloom.session import read

    cas13 = read(spark, directory, "cas13_records").select("record_key", "metadata_json")
    pairs = read(spark, directory, "ambiguous_pairs").select("operon_id", "spacers_json").dropDuplicates(["operon_id", "spacers_json"])
    variants = read(spark, directory, "variant_retrospective").select("variant_id", "mutation").dropDuplicates(["variant_id", "mutation"])
    return (
        unpack(cas13, "cas13_records", "record_key", habitat_values(F.col("metadata_json")))
        .unionByName(unpack(pairs, "ambiguous_pairs", "operon_id", split_unquoted(F.col("spacers_json"))))
        .unionByName(unpack(variants, "variant_retrospective", "variant_id", split_unquoted(F.col("mutation"))))
    )
