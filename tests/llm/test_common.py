from reweave.llm.common import maybe_among


def test_maybe_among_keeps_all_that_are_there(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(2000)] + [(None, "none")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 7)] + [(None,)], "rep_id long")
    got = [r.doc_id for r in maybe_among(rows, "doc_id", ids).collect()]
    assert set(got) >= {*range(0, 2000, 7), None} and len(got) == len(set(got)) < 300
    full = [r.doc_id for r in maybe_among(rows, "doc_id", ids, bits=64).collect()]
    assert set(full) >= {*range(0, 2000, 7), None} and len(full) == len(set(full))
    assert maybe_among(rows, "doc_id", ids.limit(0)).count() == 0
