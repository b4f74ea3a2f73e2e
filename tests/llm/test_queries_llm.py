import pytest

from loomline.llm.queries import ORACLE_SQL, QUERIES
from oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_nothing_outside_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "loomline"
    outside = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert outside and not [p for p in outside if "loomline.llm" in p.read_text()]
