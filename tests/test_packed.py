from pyspark.sql import functions as F

from strandloom.operators import packed


def values(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_quoted_values(spark):
    cases = {
        "miner's shaft,otter's den": ["miner's shaft", "otter's den"],
        '"the ""old"" kiln; upper"; ;reef sponge | ': ['the "old" kiln; upper', "reef sponge"],
        ", 'well \"B\", lower'": ['well "B", lower'],
        "'it''s; here'/x": ["it's; here", "x"],
        "pH:4 bog;sand 0.2mm\tdeep-sea vent (black)\nbiofilm": ["pH:4 bog", "sand 0.2mm", "deep-sea vent (black)", "biofilm"],
        "a, | b; ;c,,": ["a", "b", "c"],
        '"a"': ["a"],
        "[a, b]": ["a", "b"],
        'x;"never closed, y': ["x", "never closed", "y"],
        "": [],
        " ; , ": [],
        '""': [],
        "a,a,a": ["a", "a", "a"],
    }
    assert values(spark, packed.split_quoted, list(cases)) == list(cases.values())
    assert values(spark, packed.split_quoted, [None]) == [[]]


def test_unquoted_values(spark):
    cases = {
        '["AAA", "CCC;GGG"]': ["AAA", "CCC", "GGG"],
        "p.L99A + p.P711C": ["p.L99A", "p.P711C"],
        "ins373_374:RGSSD": ["ins373_374:RGSSD"],
        "'del20-26' & Y21D\tK3A  ": ["del20-26", "Y21D", "K3A"],
        "": [],
        "[]": [],
    }
    assert values(spark, packed.split_unquoted, list(cases)) == list(cases.values())
    assert values(spark, packed.split_unquoted, [None]) == [[]]


def test_habitats_of_metadata(spark):
    cases = ['{"habitat": "a;b"}', '{"habitat": ["a;b", null, "\'c,d\'"]}', '{"habitat": null}', "{}", "[1]", "broken", None, '{"x": {"habitat": "no"}}']
    assert values(spark, packed.habitat_values, cases) == [["a", "b"], ["a", "b", "c,d"], [], [], [], [], [], []]


def test_rows_keep_order_and_long_texts_stay_whole(spark):
    text = ";".join(f"v{i}" for i in range(5_000))
    df = spark.createDataFrame([("k", text, 1), ("empty", None, 2)], "key string, t string, item_no int")
    out = packed.unpack(df, "t", "key", packed.split_unquoted(F.col("t"))).orderBy("item_no").collect()
    assert [r.item for r in out] == text.split(";") and [r.item_no for r in out] == list(range(1, 5_001))
    quoted = "'" + "x;" * 50_000 + "'"
    assert values(spark, packed.split_quoted, [quoted]) == [["x;" * 50_000]]
    assert packed.unpack(df.limit(0), "t", "key", packed.split_unquoted(F.col("t"))).count() == 0


def test_control_characters_are_kept(spark):
    from strandloom.operators.packed import split_quoted

    texts = ["a\u0001b; c\u0002", "'x\u0001;y', \u0003a", '"p""\u0002q", \u0003\u0001']
    out = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", split_quoted(F.col("t")).alias("v")).orderBy("i").collect()]
    assert out == [["a\u0001b", "c\u0002"], ["x\u0001;y", "\u0003a"], ['p"\u0002q', "\u0003\u0001"]]
