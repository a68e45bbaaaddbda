import re

import __spark_entry__ as E
from assetsweep.llm import queries


def test_every_operator_has_one_query():
    names = sorted(n for n in E.queries() if re.match(r"op\d+_", n))
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(queries.ORACLE) <= set(E.oracle_sql())
