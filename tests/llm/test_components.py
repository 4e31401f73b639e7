"""Components that are settled in two steps equal those of all links at once."""

from reweave.llm.components import components, joined


def test_joined_equals_all_links_at_once(spark):
    first, later = [(1, 2), (2, 3), (5, 6), (9, 9)], [(3, 6), (7, 8), (8, 1), (12, 11), (1, 3)]
    kind = "a long, b long"
    one, two = spark.createDataFrame(first, kind), spark.createDataFrame(later, kind)
    got = {(r.node, r.root) for r in joined(components(one, 4), two, 5).collect()}
    assert got == {(r.node, r.root) for r in components(one.unionByName(two), 9).collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 5, 6, 7, 8)} | {(9, 9), (11, 11), (12, 11)}


def test_no_links(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert joined(components(none, 0), none, 0).count() == 0
