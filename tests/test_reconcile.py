"""Fingerprints tell rows apart: nulls, array borders, nested values; and survive widening and column order."""

import pytest

from tablemove.operators.reconcile import compare

PAIRS = {
    "moved nulls": ("a int, b int", [(None, 5), (7, None)], [(5, None), (None, 7)]),
    "null element": ("v array<int>", [([1, None, 2],)], [([1, 2],)]),
    "which element": ("v array<int>", [([None, 1],)], [([1, None],)]),
    "array borders": ("s struct<a: array<int>, b: array<int>>", [(([1], [2]),)], [(([1, 2], []),)]),
    "columns of arrays": ("a array<int>, b array<int>", [([1], [2])], [([1, 2], [])]),
    "inner borders": ("v array<array<int>>", [([[1], [2]],)], [([[1, 2]],)]),
    "empty or null": ("v array<int>", [([],)], [(None,)]),
    "null struct": ("s struct<a: int>", [((None,),)], [(None,)]),
    "fields": ("s struct<a: int, b: int>", [((1, None),)], [((None, 1),)]),
    "structs in arrays": ("v array<struct<a: int, b: int>>", [([(1, None)],)], [([(None, 1)],)]),
    "null or no element": ("v array<string>", [([None],)], [([],)]),
    "map value": ("m map<string, int>", [({"a": None, "b": 1},)], [({"a": 1, "b": None},)]),
    "empty or null map": ("m map<string, int>", [({},)], [(None,)]),
    "map of arrays": ("m map<string, array<int>>", [({"a": [1], "b": [2]},)], [({"a": [1, 2], "b": []},)]),
    "many columns": (", ".join(f"c{k:03} int" for k in range(130)), [(None, *[1] * 128, 2)], [(2, *[1] * 128, None)]),
}


@pytest.mark.parametrize("name", PAIRS)
def test_different_rows_differ(spark, name):
    schema, left, right = PAIRS[name]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    assert not compare(a, b)["matched"]
    assert compare(a, a.select(*reversed(a.columns)))["matched"]


def test_wider_types_and_other_nullability_match(spark):
    a = spark.createDataFrame([(1, [1, None], {"k": (1.5, None)}, None)], "n int not null, v array<int>, m map<string, struct<x: float, y: int>>, z short")
    b = a.selectExpr("CAST(n AS long) AS n", "CAST(v AS array<long>) AS v", "CAST(m AS map<string, struct<x: double, y: long>>) AS m", "CAST(z AS int) AS z")
    assert compare(a, b)["matched"]
