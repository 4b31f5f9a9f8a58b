import pytest

from tablemove.functions.identifiers import catalog_of, quote_name, split_name


def test_split_plain_and_quoted():
    assert split_name("cat.db.t") == ["cat", "db", "t"]
    assert split_name("db.`a.b`") == ["db", "a.b"]
    assert split_name("`we``ird`.t") == ["we`ird", "t"]


def test_quote_round_trip():
    for parts in (["db", "t"], ["c", "a.b", "x`y"]):
        assert split_name(quote_name(parts)) == parts


def test_bad_names():
    with pytest.raises(ValueError):
        split_name("db..t")
    with pytest.raises(ValueError):
        split_name("`open")


def test_catalog_of():
    assert catalog_of("db.t") == "spark_catalog"
    assert catalog_of("other.db.t") == "other"
