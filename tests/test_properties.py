"""Property checks against plain-Python statements of the rules."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tablemove.functions.identifiers import quote_name, split_name
from tablemove.operators.select import select_tables

NAMES = ["orders", "region", "nation", "part", "zzz", "*", " region ", ""]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(NAMES), max_size=8))
def test_selection_rule(spark, spec):
    listing = spark.createDataFrame([("d", t, False) for t in ["orders", "region", "nation", "part"]],
                                    "namespace string, tableName string, isTemporary boolean")
    cleaned = [n.strip() for n in spec if n.strip()]
    if "*" in cleaned:
        expected = sorted(["orders", "region", "nation", "part"])
    else:
        expected = [n for n in dict.fromkeys(cleaned) if n in {"orders", "region", "nation", "part"}]
    got = [(r.position, r.tableName) for r in select_tables(listing, spec).collect()]
    assert got == list(enumerate(expected, start=1))


@given(st.lists(st.text(min_size=1, max_size=6), min_size=1, max_size=4))
def test_quote_split_round_trip(parts):
    assert split_name(quote_name(parts)) == parts
