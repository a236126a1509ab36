"""All corpus queries are registered: the entry leaves them out silently where the subpackage is gone, but not for a typo in it."""

import __spark_entry__ as entry
from crosspanel.llm.queries import QUERIES


def test_all_corpus_queries_are_registered():
    known = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {name[: name.index("_") + 1] for name in QUERIES} and set(QUERIES) <= set(known)
    assert "pipeline" in known and {"op1_exact_dedup", "op2_chat_format", "op12_fill_in_middle", "op13_span_dedup"} <= set(entry.oracle_sql())
