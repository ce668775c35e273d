import math

import pytest
from pyspark.sql import functions as F

from strandloom.functions import hashing
from strandloom.functions import sequence as S


def one(spark, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return lambda column: df.select(column.alias("x")).first().x


def test_scalar_metrics(spark):
    two = one(spark, "ACDE", "ACDF")
    a, b = F.col("c0"), F.col("c1")
    assert two(S.identity(a, b)) == 0.75 and two(S.matches(a, b)) == 3
    assert two(S.entropy(a)) == pytest.approx(math.log(4))
    assert one(spark, "AAAACD")(S.longest_homopolymer(F.col("c0"))) == 4
    assert one(spark, "AAAA", "CCCC")(S.composition_deviation(a, b)) == 1
    assert one(spark, "KRDE")(S.net_charge(a)) == 0 and one(spark, "AVDE")(S.hydrophobicity(a)) == 0.5
    assert one(spark, "AC-DE", "ACNDE")(S.aligned_identity(a, b)) == 1 and one(spark, "--", "AC")(S.aligned_identity(a, b)) == 0
    assert two(S.designed_identity(a, b, F.array(F.lit(0), F.lit(3)))) == 1 and two(S.designed_identity(a, b, F.sequence(F.lit(0), F.lit(3)))) is None


def test_unequal_empty_and_null(spark):
    a, b = F.col("c0"), F.col("c1")
    uneven, empty, null = one(spark, "ACD", "AC"), one(spark, "", ""), one(spark, None, "A")
    for metric in (S.identity, S.matches):
        assert uneven(metric(a, b)) is None and null(metric(a, b)) is None
    assert empty(S.identity(a, b)) is None and empty(S.entropy(a)) is None and empty(S.longest_homopolymer(a)) == 0 and empty(S.net_charge(a)) is None
    assert null(S.entropy(a)) is None and null(S.longest_homopolymer(a)) is None


def test_low_complexity(spark):
    a = F.col("c0")
    assert one(spark, "AAAACDEF")(S.low_complexity_windows(a, 4, 0.5)) == [0, 1]
    assert one(spark, "AAC")(S.low_complexity_windows(a, 4, 0.5)) == [] and one(spark, "AACC")(S.low_complexity_windows(a, 4, 0.5)) == []


def test_texts(spark):
    a = F.col("c0")
    assert one(spark, " aag\tt")(S.reverse_complement(S.normal_rna(a))) == "ACUU"
    assert one(spark, ">x1 acß-D*é")(S.letters(a)) == "XACD"
    assert one(spark, "acbZ*")(S.invalid_symbols(a)) == ["*", "B", "Z"]
    assert one(spark, "  VI-D / new ")(S.safe_label(a)) == "vi-d-new" and one(spark, "--")(S.safe_label(a)) is None


def test_hashes(spark):
    a = F.col("c0")
    import hashlib

    number = int(hashlib.sha256(b"abc").hexdigest()[:16], 16)
    assert int(one(spark, "abc")(hashing.hash_number(a))) == number and one(spark, "abc")(hashing.shard_of(a, 7)) == number % 7
    assert one(spark, "abc")(hashing.hash_fraction(a)) == pytest.approx(number / 2**64)
    expected = hashlib.sha256(b"[1,2,5]").hexdigest()
    assert one(spark, "x")(hashing.position_set_hash(F.array(*map(F.lit, (5, 1, 2, 1))))) == expected
