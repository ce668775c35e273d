from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
CATALOGS = ["problems", "records", "sequences", "cohorts", "relational", "exchange", "proposals", "designs", "relations"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
@pytest.mark.parametrize("catalog", CATALOGS)
def test_queries_match_their_sql(spark, catalog):
    import importlib

    import tools_compare

    module = importlib.import_module(f"strandloom.plans.{catalog}")
    assert tools_compare.compare(spark, DATA, module.QUERIES, module.SQL) == []


def test_core_does_not_import_the_subpackage():
    for path in Path(__file__).resolve().parent.parent.joinpath("strandloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "strandloom.llm" not in path.read_text(), path
