"""What grows with copies of rows, and what is broadcast, where tables are large."""

import pytest

from reweave.operators import papers
from reweave.plans import paper_queries, registry


def parts(spark, tmp_path, copies):
    """`copies` of 40 parts, under keys of their own; two of the works have no brand."""
    words = ["red", "old", "new", "hot"]
    rows = [
        (c * 1000 + k, f"{words[k % 4]} {words[k // 4 % 4]} ring", (k * 7) % 11, None if k in (7, 8) else f"Brand#{k % 3 + 1}{c * 0}")
        for c in range(copies) for k in range(40)
    ]
    path = f"{tmp_path}/{copies}"
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_brand string").write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["papers_linkage_words", "papers_linkage_words_ranked", "papers_linkage_rounds", "papers_linkage_rounds_ranked"])
def test_linkage_of_copies_equals_sql(spark, tmp_path, name):
    import duckdb

    path = parts(spark, tmp_path, 5)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{path}/part.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, path)
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) >= 10


def test_copies_make_no_candidates(spark, tmp_path):
    for most in (1, 3):
        counts = [paper_queries.scored(spark, parts(spark, tmp_path / str(most), copies), most=most)[1].count() for copies in (3, 6)]
        assert counts[0] == counts[1] > 0


def test_texts_of_names_are_not_broadcast(spark):
    texts = spark.createDataFrame([(1, "an apache license"), (2, "none")], "id long, text string")
    names = spark.createDataFrame([("apache_license",)], "name string")
    found = papers.named(texts, names, "id")
    assert [tuple(r) for r in found.collect()] == [(1, "apache_license")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan or "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()


def named_texts(spark, path):
    """Texts in small files, under ids that repeat or are null; names, one of them twice; and what is found."""
    texts = [(k, f"words of {k}, the MIT-licence and an Apache_License{'' if k % 3 else 's'}, mitigated") for k in range(60)]
    texts += [(1, "all  rights"), (1, "All-Rights, all rights"), (2, None), (3, ""), (None, "an apache license")]
    spark.createDataFrame(texts, "id long, text string").write.parquet(f"{path}/texts")
    names = spark.createDataFrame([("apache license",), ("apache license",), ("mit_licence",), ("all rights",), ("mit",), ("absent",)], "name string")
    want = {(k, n) for k in range(60) for n in ("mit_licence", "mit")} | {(k, "apache license") for k in range(60) if k % 3} | {(1, "all rights")}
    return spark.read.parquet(f"{path}/texts"), names, sorted(want)


def test_names_are_broadcast_and_words_of_texts_are_not(spark, tmp_path):
    texts, names, want = named_texts(spark, tmp_path)
    found = papers.named(texts, names, "id")
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_many_names_are_not_broadcast(spark, tmp_path):
    texts, names, want = named_texts(spark, tmp_path)
    found = papers.named(texts, names, "id", max_letters=0)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_without_words_occur_nowhere(spark, tmp_path):
    texts, names, want = named_texts(spark, tmp_path)
    empty = spark.createDataFrame([("",), (" - ",), (None,)], "name string")
    assert papers.named(texts, empty, "id").collect() == []
    assert sorted(tuple(r) for r in papers.named(texts, names.unionByName(empty), "id").collect()) == want


def test_classes_of_copies_equal_sql_and_no_part_is_broadcast(spark, tmp_path):
    import duckdb

    rows = [(c * 1000 + k, ["LARGE", "BURNISHED COPPER", "Mit-License", None][k % 4], k % 9) for c in range(5) for k in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["papers_classified"](spark, str(tmp_path))
    assert "BuildLeft" not in got._jdf.queryExecution().executedPlan().toString()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * REPLACE (coalesce(p_type, '') AS p_type) FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL['papers_classified']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 300
    assert {r[1] for r in want} == {"Possibly", "Unlikely"} and len({r[-1] for r in want}) >= 4


def test_triples_of_one_pass_equal_the_sql(spark, tmp_path):
    from reweave.plans import bindings

    flags = ["A", "N", "R", None]
    spark.createDataFrame(
        [(k, f"red  ring{k % 3}", f"Brand#{k % 4}", None if k == 5 else ["SMALL", "LARGE"][k % 2], k % 3) for k in range(12)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(
        [(k % 13, k % 3, flags[k % 4], None if k % 29 == 0 else k % 8) for k in range(200)] + [(1, 1, "A", 1)] * 50,
        "l_partkey long, l_suppkey long, l_returnflag string, l_linenumber int",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0,), (1,), (9,), (9,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    tables = {n: bindings.table(spark, str(tmp_path), n) for n in ("part", "lineitem", "supplier")}
    rows = bindings.triples(spark, str(tmp_path))
    want = spark.sql(bindings.TRIPLES, **tables)
    assert rows.columns == want.columns and rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    plan = bindings.ontology_triples(tables["part"], tables["lineitem"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_missing_triples_of_a_pattern_are_not_listed(spark):
    """`direct` joins what an ontology holds; pairs times the patterns' triples are nowhere."""
    from reweave.operators import triples as tr
    from reweave.operators import usage
    from reweave.vocab import SHORT

    pattern = [("pat", f"n#{c}", "iri", "rdf:type", "owl:Class", "iri") for c in "abc"]
    pattern += [("pat", "n#p", "iri", "rdf:type", "owl:ObjectProperty", "iri"), ("pat", "n#a", "iri", "n#p", "n#b", "iri"), ("pat", "n#b", "iri", "n#p", "n#b", "iri")]
    own = [("ont", "n#a", "iri", "n#p", "n#b", "iri"), ("ont", "n#c", "iri", "rdf:type", "owl:Class", "iri")]
    rows = spark.createDataFrame(pattern + own, "graph_id string, s string, s_kind string, p string, o string, o_kind string")
    pairs = spark.createDataFrame([("ont", "pat"), ("none", "pat")], "ontology_id string, pattern_id string")
    found = tr.entities(rows, SHORT)
    out = usage.direct(pairs, rows, found, tr.graph_reuse(pairs, found, tr.terms(rows)))
    assert sorted(tuple(r) for r in out.collect()) == [("ont", "pat", "n#a"), ("ont", "pat", "n#c")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 0


def reuse_tables(spark):
    """Two patterns of twenty classes, of which ontologies use one and name another; the third pattern is nobody's pair."""
    found = [(p, "class", f"http://{p}#OldRing{k}") for p in ("p1", "p2", "p3") for k in range(20)]
    found += [(o, "class", "http://own#old_ring3") for o in ("o1", "o2")] + [("o2", "object", "http://own#old_ring4")]
    found = spark.createDataFrame(found, "graph_id string, kind string, iri string")
    used = spark.createDataFrame([("o1", "http://p1#OldRing7"), ("o1", "http://p1#OldRing7"), ("o2", "http://p3#OldRing7")], "graph_id string, term string")
    pairs = spark.createDataFrame([("o1", "p1"), ("o1", "p2"), ("o2", "p1")], "ontology_id string, pattern_id string")
    said = spark.createDataFrame([], "graph_id string, s string, s_kind string, p string, o string, o_kind string")
    return pairs, found, used, said


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reuse_makes_rows_for_what_is_reused_only(spark):
    from reweave.operators import stats, triples as tr

    pairs, found, used, said = reuse_tables(spark)
    named = tr.labels(said, found)
    alike = tr.similar_labels(named, named, "exact", 1.0)
    each = tr.graph_reuse(pairs, found, used), tr.label_reuse(pairs, named), tr.label_reuse(pairs, named, by_kind=True), tr.similar_label_reuse(pairs, named, alike)
    graph, label, by_kind, similar = ({(r.ontology_id, r.pattern_id, r.iri) for r in df.collect()} for df in each)
    assert graph == {("o1", "p1", "http://p1#OldRing7")}
    # camel case is split before a digit's end only: "old ring3" in all graphs
    assert label == similar == by_kind | {("o2", "p1", "http://p1#OldRing4")}
    assert by_kind == {("o1", "p1", "http://p1#OldRing3"), ("o1", "p2", "http://p2#OldRing3"), ("o2", "p1", "http://p1#OldRing3")}
    # the pairs are met by both graphs, never by the pattern alone, which would list all its entities for each
    assert all("Join Inner, (pattern_id" not in plan(df) for df in each)
    union = stats.union_by_name(pairs.withColumn("pattern_name", pairs["ontology_id"]), found, used)
    assert "Join Inner, (pattern_id" not in plan(union)
    rows = {tuple(r)[:5] for r in union.collect()}
    assert rows == {("o1", "o1", 40, 1, 1), ("o2", "o2", 20, 0, 1)}


def test_names_are_normalised_once_each(spark):
    from reweave.operators import triples as tr

    _, found, _, said = reuse_tables(spark)
    assert "regexp_replace" not in plan(tr.labels(said, found))


def odd_lines(spark, tmp_path):
    """Lines and parts with nulls in every column, upper case and `#` in types, and names that differ in blanks only."""
    types, names = ["SMALL", "small", None, "a#b", ""], ["red ring", "red_ring", None, "b#red", "x"]
    spark.createDataFrame(
        [(k, names[k % 5], None if k % 7 == 3 else f"Brand#{k % 3}", types[k // 5 % 5], k % 3) for k in range(100)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    ).write.parquet(f"{tmp_path}/part.parquet")
    flags = ["A", "N", "R", None, "X"]
    spark.createDataFrame(
        [(None if k % 97 == 0 else k % 103, None if k % 11 == 0 else k % 6, flags[k % 5], None if k % 13 == 0 else k % 9 - 1) for k in range(3000)],
        "l_partkey long, l_suppkey long, l_returnflag string, l_linenumber int",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0,), (1,), (9,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_lines_are_numbers_until_their_triples_are_distinct(spark, tmp_path):
    from reweave.plans import bindings

    path = odd_lines(spark, tmp_path)
    tables = {n: bindings.table(spark, path, n) for n in ("part", "lineitem", "supplier")}
    rows, want = bindings.triples(spark, path), spark.sql(bindings.TRIPLES, **tables)
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    numbered, _ = bindings.numbered_triples(tables["part"], tables["lineitem"])
    assert {t for _, t in numbered.dtypes} == {"bigint"}


def test_coverage_by_references_equals_that_by_strings(spark, tmp_path):
    """The coverage queries look terms and labels up by number; the older way reads every string of every triple."""
    from reweave.operators import triples as tr
    from reweave.plans import graph_queries as gq

    g = gq.Graphs(spark, odd_lines(spark, tmp_path))
    strings = tr.coverage(g.pairs, g.declared, tr.graph_reuse(g.pairs, g.declared, tr.term_rows(g.triples)), g.label_reuse())
    numbers = g.coverage()
    assert numbers.columns == strings.columns
    assert {tuple(r) for r in numbers.collect()} == {tuple(r) for r in strings.collect()}
    assert g.pairs.count() == 7 and numbers.filter("reused_total_graph > 0").count() > 3
    by_string = tr.graph_reuse(g.pairs, g.declared, tr.term_rows(g.triples))
    assert by_string.exceptAll(g.reuse()).isEmpty() and g.reuse().exceptAll(by_string).isEmpty()


def test_summaries_work_their_input_out_once(spark):
    from reweave.operators import reports

    for summary in (lambda df: reports.equal_width(df, "v", 7), lambda df: reports.empirical_cdf(df, "v"), lambda df: reports.five_numbers(df, "v")):
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = spark.range(100).selectExpr("id % 10 AS v").mapInArrow(count, "v long")
        assert summary(rows).count() > 0 and seen.value == 100


def crossed_lines(spark, tmp_path):
    """As `odd_lines`, with suppliers of all repositories, one below 0, one without reuse, and a term that two patterns declare."""
    flags = ["A", "N", "R", None, "X"]
    spark.createDataFrame(
        [(k, None if k == 7 else f"red  ring{k % 3}", None if k == 8 else f"Brand#{k % 4}", None if k == 5 else ["SMALL", "LARGER"][k % 2], k % 3) for k in range(12)]
        + [(12, "x#red ring", "Brand#1", "OLD", 1), (13, "red ring", "Brand#2", "OLD#x", 2), (13, "red ring", "Brand#3", "OLD#x", 1), (None, "none", "Brand#1", "SMALL", 1)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(
        [(k % 15, k % 11 if k % 17 else None, flags[k % 5], None if k % 29 == 0 else k % 9) for k in range(400)]
        + [(12, 21, "R", k) for k in range(1, 5)] + [(13, 24, "A", 1), (13, -4, "A", 1), (5, 30, "R", 3), (7, 31, "N", 1), (8, 32, "N", 3), (0, 33, "N", 5), (None, 34, "A", 1)],
        "l_partkey long, l_suppkey long, l_returnflag string, l_linenumber int",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0,), (1,), (33,), (33,), (40,), (None,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_forms_tell_constructs_and_reuse_without_all_triples(spark, tmp_path):
    from pyspark.sql import functions as F

    from reweave.operators import constructs as co, triples as tr
    from reweave.plans import graph_queries as gq, report_queries as rq
    from reweave.vocab import SHORT

    g = gq.Graphs(spark, crossed_lines(spark, tmp_path))
    got = rq.with_reuse(g.view)
    assert "numbers" not in vars(g.view) and "rows" not in vars(g.view)  # neither the numbered triples nor their strings were made
    got = got.join(g.view.sizes, "graph_id")
    hit = tr.graph_reuse(g.pairs, g.declared, tr.term_rows(g.triples)).select(F.col("ontology_id").alias("graph_id"), F.lit(1).alias("reuse")).distinct()
    want = co.constructs(g.triples, SHORT).filter("graph_id LIKE 'ont%'").join(hit, "graph_id", "left").na.fill(0, ["reuse"])
    want = {tuple(r) for r in want.select(sorted(want.columns)).collect()}
    assert {tuple(r) for r in got.select(sorted(got.columns)).collect()} == want and len(want) > 15
    assert {r[-1] for r in hit.collect()} == {1} and 3 < hit.count() < len(want) - 3


@pytest.mark.parametrize("name", ["report_expressivity_by_reuse", "report_construct_differences", "report_with_and_without"])
def test_reports_by_reuse_equal_their_sql(spark, tmp_path, name):
    import duckdb

    path = crossed_lines(spark, tmp_path)
    db = duckdb.connect()
    for table in ("part", "lineitem", "supplier"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, path)
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    key = lambda row: [str(round(v, 6) if isinstance(v, float) else v) for v in row]
    assert sorted(key(tuple(r)) for r in got.collect()) == sorted(map(key, want)) and want
