"""Entities, labels, terms and namespaces of graphs kept as a triples table.

triples: graph_id, s, s_kind, p, o, o_kind, distinct for each graph; kinds are iri, bnode and literal.
pairs: ontology_id, pattern_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweave.functions.labels import base_namespace, local_name, normalize_label, normalize_label_unicode
from reweave.operators import simjoin
from reweave.storage import written
from reweave.vocab import IRIS, Vocabulary


def entity_rows(triples: DataFrame, v: Vocabulary = IRIS) -> DataFrame:
    """graph_id, kind (class, object, datatype) and iri of what each graph declares, perhaps more than once."""
    kind = (
        F.when(F.col("o").isin(v("owl:Class", "rdfs:Class")), "class")
        .when(F.col("o") == v.one("owl:ObjectProperty"), "object")
        .when(F.col("o") == v.one("owl:DatatypeProperty"), "datatype")
    )
    typed = triples.filter((F.col("p") == v.one("rdf:type")) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri"))
    return typed.select("graph_id", kind.alias("kind"), F.col("s").alias("iri")).filter("kind IS NOT NULL")


def entities(triples: DataFrame, v: Vocabulary = IRIS) -> DataFrame:
    """The distinct rows of `entity_rows`."""
    return entity_rows(triples, v).distinct()


def entity_counts(found: DataFrame) -> DataFrame:
    """n_classes, n_object_properties, n_datatype_properties and n_total of each graph."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return found.groupBy("graph_id").agg(
        of("class").alias("n_classes"),
        of("object").alias("n_object_properties"),
        of("datatype").alias("n_datatype_properties"),
        F.count(F.lit(1)).alias("n_total"),
    )


def ontology_iri(triples: DataFrame, v: Vocabulary = IRIS) -> DataFrame:
    """The smallest IRI that a graph types as an ontology."""
    typed = triples.filter((F.col("p") == v.one("rdf:type")) & (F.col("o") == v.one("owl:Ontology")) & (F.col("s_kind") == "iri"))
    return typed.groupBy("graph_id").agg(F.min("s").alias("ontology_iri"))


def imports(triples: DataFrame, part: str = "", limit: int | None = None, v: Vocabulary = IRIS) -> DataFrame:
    """ontology and imported, where the imported IRI contains `part`; the first `limit` in order of both."""
    found = triples.filter((F.col("p") == v.one("owl:imports")) & F.contains(F.col("o"), F.lit(part)))
    found = found.select(F.col("s").alias("ontology"), F.col("o").alias("imported")).distinct()
    return found if limit is None else found.orderBy("ontology", "imported").limit(limit)


def term_rows(triples: DataFrame) -> DataFrame:
    """graph_id and IRI at any place of a triple, perhaps more than once."""
    places = F.array(*[F.when(F.col(k) == "iri", F.col(c)) if k else F.col(c) for c, k in (("s", "s_kind"), ("p", None), ("o", "o_kind"))])
    return triples.select("graph_id", F.explode(places).alias("term")).filter("term IS NOT NULL")


def terms(triples: DataFrame) -> DataFrame:
    """The distinct rows of `term_rows`."""
    return term_rows(triples).distinct()


def normalised(rows: DataFrame, norm: Callable) -> DataFrame:
    """`rows` with `norm` of their column `name` as `label`, without empty ones. Graphs share most of their names, so each
    distinct name is normalised once and looked up."""
    names = rows.select("name").distinct().withColumn("label", norm(F.col("name"))).filter("label <> ''")
    return rows.join(written(names, "names"), "name").drop("name")


def label_rows(triples: DataFrame, found: DataFrame, v: Vocabulary = IRIS, unicode: bool = True) -> DataFrame:
    """graph_id, kind, iri and label, perhaps more than once: normalised label literals and the local name, without empty ones."""
    said = triples.filter((F.col("p") == v.one("rdfs:label")) & (F.col("o_kind") == "literal"))
    said = written(said.select("graph_id", F.col("s").alias("iri"), F.col("o").alias("name")), "said")  # Spark sees if they are few
    said = found.join(said, ["graph_id", "iri"]).select("graph_id", "kind", "iri", "name")
    both = said.unionByName(found.select("graph_id", "kind", "iri", local_name(F.col("iri")).alias("name")))
    return normalised(written(both, "named"), normalize_label_unicode if unicode else normalize_label)


def labels(triples: DataFrame, found: DataFrame, v: Vocabulary = IRIS, unicode: bool = True) -> DataFrame:
    """The distinct rows of `label_rows`."""
    return label_rows(triples, found, v, unicode).distinct()


def make_pairs(graphs: DataFrame) -> DataFrame:
    """Each ontology with the patterns of its repository. graphs: graph_id, role, repo."""
    o = graphs.filter("role = 'ontology'").select("repo", F.col("graph_id").alias("ontology_id"))
    p = graphs.filter("role = 'pattern'").select("repo", F.col("graph_id").alias("pattern_id"))
    return o.join(p, "repo").select("ontology_id", "pattern_id").distinct()


def of_patterns(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of the patterns' graphs, written: patterns are few where many ontologies share them, and Spark then sees from
    the table's size that it can broadcast them rather than shuffle what they meet."""
    ids = written(pairs.select(F.col("pattern_id").alias("graph_id")).distinct(), "patterns")
    return written(rows.join(ids, "graph_id", "left_semi").distinct(), "of_patterns")


def reused_by(pairs: DataFrame, hits: DataFrame, own: DataFrame, on: list[str]) -> DataFrame:
    """Distinct ontology_id, pattern_id, kind and iri of pattern entities that agree in `on` with a hit of the ontology.

    Hits (ontology_id and `on`) meet the patterns' rows `own` first and the pairs last: rows are made for what is reused, not for
    every entity of every pair."""
    met = hits.join(own.withColumnRenamed("graph_id", "pattern_id"), on).select("ontology_id", "pattern_id", "kind", "iri")
    return met.join(pairs.select("ontology_id", "pattern_id"), ["ontology_id", "pattern_id"], "left_semi").distinct()


def graph_reuse(pairs: DataFrame, found: DataFrame, used: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Pattern entities that occur anywhere in the ontology. Terms that no pattern declares are dropped, and the others numbered,
    before anything is shuffled. Rows of `used` (graph_id, term) may repeat; with `words` they are as in `coverage_by_backend`."""
    own = of_patterns(pairs, found)
    numbers = written(own.select("iri").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    if words is None:
        there = used.join(numbers.withColumnRenamed("iri", "term"), "term")
    else:
        there = used.join(written(words.join(numbers, words["term"] == numbers["iri"]).select("ref", "number").distinct(), "keys"), "ref")
    there = there.select(F.col("graph_id").alias("ontology_id"), "number").distinct()
    return reused_by(pairs, there, own.join(numbers, "iri"), ["number"])


def label_reuse(pairs: DataFrame, named: DataFrame, by_kind: bool = False) -> DataFrame:
    """Pattern entities one of whose labels an entity of the ontology (of the same kind, if `by_kind`) has too."""
    on = ["label"] + (["kind"] if by_kind else [])
    own = of_patterns(pairs, named)
    theirs = named.join(own.select(*on).distinct(), on, "left_semi").select(F.col("graph_id").alias("ontology_id"), *on).distinct()
    return reused_by(pairs, theirs, own, on)


SIMILARITIES = ("exact", "char", "word", "label", "vector", "hybrid", "auto")


def similar_labels(left: DataFrame, right: DataFrame, similarity: str, threshold: float, *, vectors: DataFrame | None = None, prefilter: float = 0.75, edits: int = 0) -> DataFrame:
    """left_label and right_label of labels that count as the same under `similarity`, equal ones among them.

    left, right: label. `vector`, `hybrid` and `auto` take vectors of labels (label, embedding); without any, hybrid and
    auto go on with characters. hybrid asks vectors only where characters come near (`gated_join`)."""
    if similarity not in SIMILARITIES or similarity == "vector" and vectors is None:
        raise ValueError(f"no similarity {similarity!r}" if similarity not in SIMILARITIES else "the vector similarity needs vectors")
    left, right = left.select("label").distinct(), right.select("label").distinct()
    same = left.join(right, "label").select(F.col("label").alias("left_label"), F.col("label").alias("right_label"))
    pair = lambda df: df.select("left_label", "right_label")

    def by_vector(own: DataFrame) -> DataFrame:
        return simjoin.vector_join(own.join(vectors, "label"), right.join(vectors, "label"), threshold, key="label").toDF("left_label", "right_label", "similarity")

    if similarity == "exact":
        return same
    if similarity == "word":
        found = pair(simjoin.word_join(left, right, threshold))
    elif similarity == "label":
        found = pair(simjoin.label_join(left, right, threshold, edits))
    elif similarity in ("vector", "auto") and vectors is not None:
        found = pair(by_vector(left))
    else:
        found = pair(simjoin.char_join(left, right, threshold))
        if similarity == "hybrid" and vectors is not None:
            best = simjoin.char_join(left, right, prefilter - 0.05).groupBy("left_label").agg(F.max("similarity").alias("best"))
            gate = best.filter(F.col("best") < threshold).select(F.col("left_label").alias("label"))
            found = found.unionByName(pair(by_vector(left.join(gate, "label", "left_semi"))))
    return same.unionByName(found).distinct()


def similar_label_reuse(pairs: DataFrame, named: DataFrame, alike: DataFrame, by_kind: bool = False, own: DataFrame | None = None) -> DataFrame:
    """As `label_reuse`, where labels count as equal that `alike` (left_label of the pattern, right_label) names together.

    own: the patterns' rows of `named`, if the caller has them."""
    on = ["label"] + (["kind"] if by_kind else [])
    own = of_patterns(pairs, named) if own is None else own
    alike = written(alike.join(own.select(F.col("label").alias("left_label")).distinct(), "left_label", "left_semi"), "alike")
    theirs = named.withColumnRenamed("label", "right_label").join(alike, "right_label")
    theirs = theirs.select(F.col("graph_id").alias("ontology_id"), F.col("left_label").alias("label"), *on[1:]).distinct()
    return reused_by(pairs, theirs, own, on)


def hybrid_label_reuse(pairs: DataFrame, named: DataFrame, vectors: DataFrame, threshold: float, prefilter: float, own: DataFrame | None = None) -> DataFrame:
    """As `label_reuse`, where characters decide first and vectors second, entity by entity.

    An entity is reused if the best character cosine of its labels with the ontology's is at `threshold` or more. If it lies
    below, but not below `prefilter` - 0.05, a cosine of label vectors at `threshold` or more decides. vectors: label,
    embedding. own: as in `similar_label_reuse`."""
    one, pair = ["ontology_id", "pattern_id", "kind", "iri"], ["ontology_id", "pattern_id"]
    own = of_patterns(pairs, named) if own is None else own
    mine = own.select(F.col("graph_id").alias("pattern_id"), "kind", "iri", F.col("label").alias("left_label"))
    theirs = named.select(F.col("graph_id").alias("ontology_id"), F.col("label").alias("right_label"))
    theirs = theirs.join(pairs.select("ontology_id"), "ontology_id", "left_semi")
    left, right = mine.select(F.col("left_label").alias("label")).distinct(), theirs.select(F.col("right_label").alias("label")).distinct()
    right = written(right, "right")
    near = written(simjoin.char_join(left, right, min(prefilter - 0.05, threshold)), "near")
    # the best of each of the patterns' labels in an ontology, then of each entity
    best = theirs.join(near, "right_label").groupBy("ontology_id", "left_label").agg(F.max("similarity").alias("best"))
    best = best.join(mine, "left_label").join(pairs.select(*pair), pair, "left_semi").groupBy(*one).agg(F.max("best").alias("best"))
    best = written(best, "best")
    reached = F.col("best") >= threshold - 1e-12
    gated = best.filter(~reached & (F.col("best") >= prefilter - 0.05 - 1e-12)).select(*one).join(mine, ["pattern_id", "kind", "iri"])
    gated = written(gated, "gated")
    asked = gated.select(F.col("left_label").alias("label")).distinct().join(vectors, "label")
    alike = simjoin.vector_join(asked, right.join(vectors, "label"), threshold, key="label").toDF("left_label", "right_label", "similarity")
    by_vector = theirs.join(written(alike, "alike"), "right_label").select("ontology_id", "left_label").distinct()
    by_vector = gated.join(by_vector, ["ontology_id", "left_label"], "left_semi").select(*one)
    return best.filter(reached).select(*one).unionByName(by_vector).distinct()


def coverage_by_backend(
    pairs: DataFrame, found: DataFrame, own: DataFrame, used: DataFrame, words: DataFrame, named: DataFrame, labels_: DataFrame, backends: dict[str, dict]
) -> DataFrame:
    """`coverage` under each backend, in the column `backend`. backends: similarity -> options of `similar_labels`.

    found and own: entities and labels (graph_id, iri, label) of the patterns. used, named: graph_id and ref of terms and of
    entities' names, which `words` (ref, term) and `labels_` (ref, label) spell out; their graph_id is of the type of
    ontology_id. Rows may repeat. Patterns, and the terms and labels that their entities can be reused by, are numbered;
    graphs are read for these numbers only, once for all backends."""
    pair = ["ontology_id", "pattern"]
    ids = written(pairs.select("pattern_id").distinct().withColumn("pattern", F.monotonically_increasing_id()), "ids")
    pairs = pairs.select("ontology_id", "pattern_id").join(ids, "pattern_id")
    own = own.join(ids, F.col("graph_id") == F.col("pattern_id")).select("pattern", "iri", "label").distinct()
    own = written(own, "own")
    entries = found.join(ids, F.col("graph_id") == F.col("pattern_id")).select("pattern", "iri").filter("iri IS NOT NULL").distinct()
    entries = written(entries.withColumn("entry", F.monotonically_increasing_id()), "entries")
    mine = own.withColumnRenamed("label", "left_label").join(entries, ["pattern", "iri"]).drop("iri")
    right = written(labels_.select("label").distinct(), "distinct")
    alike = [
        similar_labels(own, right, name, **options).join(mine, "left_label").select("right_label", "pattern", "entry", F.lit(2 << i).cast("long").alias("by"))
        for i, (name, options) in enumerate(backends.items())
    ]
    alike = written(reduce(lambda a, b: a.unionByName(b), alike), "alike")
    numbers = written(entries.select("iri").distinct().withColumn("key", F.monotonically_increasing_id()), "numbers")
    label_numbers = written(alike.select("right_label").distinct().withColumn("key", -1 - F.monotonically_increasing_id()), "numbers")
    alike = alike.join(label_numbers, "right_label").groupBy("key", "pattern", "entry").agg(F.bit_or("by").alias("by"))
    meant = entries.join(numbers, "iri").select("key", "pattern", "entry", F.lit(1).cast("long").alias("by"))
    meant = written(meant.unionByName(alike), "meant")

    there = [
        rows.select("graph_id", "ref").join(written(spelt.join(known, spelt[x] == known[y]).select("ref", "key").distinct(), "keys"), "ref").drop("ref")
        for rows, spelt, known, x, y in ((used, words, numbers, "term", "iri"), (named, labels_, label_numbers, "label", "right_label"))
    ]
    there = there[0].unionByName(there[1]).distinct().withColumnRenamed("graph_id", "ontology_id")
    met = there.join(meant, "key").join(pairs.select(*pair), pair, "left_semi")
    each = met.repartition(*pair).groupBy(*pair, "entry").agg(F.bit_or("by").alias("by"))  # the sums below need no other shuffle
    reached = lambda bits: F.count_if(F.col("by").bitwiseAND(F.lit(bits).cast("long")) != 0)
    counts = each.groupBy(*pair).agg(reached(1).alias("reused_total_graph"), *[reached(1 | 2 << i).alias(f"label_{i}") for i in range(len(backends))])
    total = entries.groupBy("pattern").agg(F.count(F.lit(1)).alias("pattern_total"))
    out = pairs.join(written(total, "totals"), "pattern", "left").join(counts, pair, "left").na.fill(0)
    by_label = F.array(*[F.struct(F.lit(name).alias("backend"), F.col(f"label_{i}").alias("reused_total_label")) for i, name in enumerate(backends)])
    out = out.select("ontology_id", "pattern_id", "pattern_total", "reused_total_graph", F.inline(by_label))
    return out.select(*COUNTS, *shares(), "backend")


COUNTS = ["ontology_id", "pattern_id", "pattern_total", "reused_total_graph", "reused_total_label"]


def shares() -> list[Column]:
    """The columns coverage_graph and coverage_label: what is reused of the pattern's entities; 0 without entities."""
    share = lambda c: F.when(F.col("pattern_total") > 0, F.col(c) / F.col("pattern_total")).otherwise(0.0)
    return [share("reused_total_graph").alias("coverage_graph"), share("reused_total_label").alias("coverage_label")]


def coverage(pairs: DataFrame, found: DataFrame, by_graph: DataFrame, by_label: DataFrame) -> DataFrame:
    """pattern_total, reused_total_graph, reused_total_label and their shares for each pair; 0 without entities.

    An entity reused by IRI counts as reused by label too.
    """
    pair = ["ontology_id", "pattern_id"]
    total = of_patterns(pairs, found).groupBy(F.col("graph_id").alias("pattern_id")).agg(F.count_distinct("iri").alias("pattern_total"))
    either = by_graph.select(*pair, "iri", F.lit(1).alias("graph")).unionByName(by_label.select(*pair, "iri", F.lit(0).alias("graph")))
    either = either.repartition(*pair).groupBy(*pair, "iri").agg(F.max("graph").alias("graph"))  # the sums below need no other shuffle
    counts = either.groupBy(*pair).agg(F.sum("graph").alias("reused_total_graph"), F.count(F.lit(1)).alias("reused_total_label"))
    out = pairs.join(written(total, "totals"), "pattern_id", "left").join(counts, pair, "left").na.fill(0)
    return out.select(*COUNTS, *shares())


def additional(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """How many entities of each kind the ontology declares beyond the pattern's."""
    mine = pairs.join(found.withColumnRenamed("graph_id", "ontology_id"), "ontology_id")
    theirs = found.withColumnRenamed("graph_id", "pattern_id")
    left = mine.join(theirs, ["pattern_id", "kind", "iri"], "left_anti")
    of = lambda k: F.count_if(F.col("kind") == k)
    counts = left.groupBy("ontology_id", "pattern_id").agg(
        of("class").alias("additional_classes"), of("object").alias("additional_object_properties"), of("datatype").alias("additional_datatype_properties")
    )
    return pairs.join(counts, ["ontology_id", "pattern_id"], "left").na.fill(0)


def namespaces(found: DataFrame) -> DataFrame:
    """Distinct graph_id and namespace of the entities; without `#`, the whole IRI is one."""
    return found.select("graph_id", base_namespace(F.col("iri")).alias("ns")).distinct()


def in_namespace(pairs: DataFrame, used: DataFrame, spaces: DataFrame) -> DataFrame:
    """ontology_id, pattern_id and term, for terms of the ontology that start with one of the pattern's namespaces.

    Namespaces ending in `#` are met by an equi-join on the term's prefixes through each `#`; the others by their
    length, one prefix of the term for each length that the pattern's namespaces have.
    """
    spaces = pairs.join(spaces.withColumnRenamed("graph_id", "pattern_id"), "pattern_id").withColumn("n", F.char_length("ns"))
    terms_ = used.select(F.col("graph_id").alias("ontology_id"), "term")
    hashed = terms_.select(
        "ontology_id",
        "term",
        F.explode(
            F.filter(
                F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split("term", "#")) - 1)), lambda i: F.concat(F.array_join(F.slice(F.split("term", "#"), F.lit(1), i), "#"), F.lit("#"))),
                lambda prefix: F.col("term").startswith(prefix),
            )
        ).alias("ns"),
    )
    by_hash = hashed.join(spaces.filter(F.col("ns").endswith("#")), ["ontology_id", "ns"]).select("ontology_id", "pattern_id", "term")
    plain = spaces.filter(~F.col("ns").endswith("#"))
    lengths = plain.select("ontology_id", "n").distinct()
    cut = terms_.join(lengths, "ontology_id").withColumn("ns", F.expr("left(term, n)"))
    by_length = cut.join(plain.select("ontology_id", "pattern_id", "ns"), ["ontology_id", "ns"]).select("ontology_id", "pattern_id", "term")
    return by_hash.unionByName(by_length).distinct()
