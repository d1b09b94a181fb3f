"""Exact dedup: groups, ties, repeats, odd rows."""

from cueflow.llm import exact_dedup as E

ROWS = [(1, "same", 5), (2, "same", 5), (9, "same", 5), (3, "samf", 5), (4, None, 5), (5, "", 5),
        (None, "same", 5), (6, "x" * 5000 + "a", 5), (7, "x" * 5000 + "b", 5),
        (8, "x" * 5000 + "a", 5), (10, "twice", 5), (10, "twice", 5), (None, None, 5),
        (11, "same ", 5)]


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, length int")


def test_groups(spark):
    rows = E.exact_groups(table(spark)).collect()
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows)
    assert got == sorted([
        (1, 9, 4, False), (2, 9, 4, False), (9, 9, 4, True), (0, 9, 4, False), (3, 3, 1, True),
        (4, 5, 3, False), (5, 5, 3, True), (0, 5, 3, False), (6, 8, 2, False), (8, 8, 2, True),
        (7, 7, 1, True), (10, 10, 2, False), (10, 10, 2, True), (11, 11, 1, True)])


def test_one_row_of_each_group_stays(spark):
    docs = table(spark)
    left = E.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 7, 8, 9, 10, 11]
    assert E.drop_exact_copies(docs.limit(0)).count() == 0


def test_only_survivors_are_hashed(spark):
    hashed = {r.doc_id for r in E.exact_groups(table(spark)).collect() if r.full_hash}
    assert 11 not in hashed and 3 not in hashed and {1, 2, 9, 6, 8} <= hashed
