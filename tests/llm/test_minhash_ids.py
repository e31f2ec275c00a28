"""Null and repeated ids: every row is a document of its own."""

from plotshift.llm import minhash

A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))
C = " ".join(f"gamma{i}" for i in range(60))
SCHEMA = "doc_id long, text string, rep string, comp long, number long"


def found(spark, *rows):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in minhash.report(df).collect()), key=repr)


def test_null_ids_link_nothing(spark):
    """Each of two null rows is a near copy of another document; those two stay apart."""
    got = found(spark, (1, A), (2, B), (None, A + " tail"), (None, B + " tail"))
    assert got == sorted([(1, 59, 1, True), (2, 59, 2, True), (None, 60, 1, False), (None, 60, 2, False)], key=repr)


def test_repeated_ids_link_nothing(spark):
    got = found(spark, (1, A), (2, B), (3, A + " tail"), (3, B + " tail"), (3, C))
    want = [(1, 59, 1, True), (2, 59, 2, True), (3, 60, 1, False), (3, 60, 2, False), (3, 59, 3, True)]
    assert got == sorted(want, key=repr)


def test_components_without_ids_keep_one_row(spark):
    got = found(spark, (None, A), (None, A), (None, C), (None, None), (-5, ""))
    assert [r[3] for r in got if r[1] == 59 and r[0] is None].count(True) == 2 and len(got) == 5
    assert all(r[2] is None for r in got if r[0] is None) and (-5, 0, -5, True) in got and (None, 0, None, True) in got


def test_empty_table(spark):
    assert found(spark) == []
