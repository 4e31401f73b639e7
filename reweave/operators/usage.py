"""In which forms an ontology uses a pattern: counts for each (ontology, pattern) pair.

All forms look at triples that touch one of the pattern's namespaces. Those are found by equi-joins of each place of the
triples with the terms in any pattern's namespaces, which many ontologies share, so nothing is as large as pairs times triples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweave.operators import triples as tr
from reweave.operators.triples import of_patterns
from reweave.storage import written
from reweave.vocab import IRIS, Vocabulary

PAIR = ["ontology_id", "pattern_id"]
FORMS = [
    "direct", "as_subclass", "as_superclass", "as_subproperty", "as_superproperty", "via_property", "via_restriction", "equivalent",
]
#: Characteristic -> type of property (fixed values).
ROLES = {
    "functional": "owl:FunctionalProperty",
    "inverse_functional": "owl:InverseFunctionalProperty",
    "transitive": "owl:TransitiveProperty",
    "symmetric": "owl:SymmetricProperty",
    "asymmetric": "owl:AsymmetricProperty",
    "reflexive": "owl:ReflexiveProperty",
    "irreflexive": "owl:IrreflexiveProperty",
}


def touching(pairs: DataFrame, triples: DataFrame, inside: DataFrame) -> DataFrame:
    """The ontology's triples with a term in the pattern's namespaces, with s_in, p_in, o_in and s_out, p_out, o_out
    (an IRI outside). inside: term and pattern_id."""
    homes = written(inside.groupBy("term").agg(F.collect_set("pattern_id").alias("homes")), "homes")
    rows = triples.withColumnRenamed("graph_id", "ontology_id")
    iri = {"s": F.col("s_kind") == "iri", "p": F.lit(True), "o": F.col("o_kind") == "iri"}
    for x in "spo":
        own = homes.select(F.col("term").alias(f"{x}_term"), F.col("homes").alias(f"{x}_homes"))
        rows = rows.join(own, iri[x] & (F.col(x) == F.col(f"{x}_term")), "left").drop(f"{x}_term")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"{x}_homes": F.coalesce(f"{x}_homes", none) for x in "spo"})
    rows = rows.withColumn("pattern_id", F.explode(F.array_union(F.array_union("s_homes", "p_homes"), F.col("o_homes"))))
    rows = rows.withColumns({f"{x}_in": F.array_contains(f"{x}_homes", F.col("pattern_id")) for x in "spo"}).drop(*[f"{x}_homes" for x in "spo"])
    return rows.join(pairs, PAIR, "left_semi").withColumns({f"{x}_out": iri[x] & ~F.col(f"{x}_in") for x in "spo"})


def in_any_namespace(triples: DataFrame, spaces: DataFrame) -> DataFrame:
    """term and pattern_id (graph_id of `spaces`) of all terms in the pattern's namespaces, whatever ontologies use them."""
    every = spaces.select(F.lit("").alias("ontology_id"), F.col("graph_id").alias("pattern_id")).distinct()
    used = tr.terms(triples.withColumn("graph_id", F.lit("")))
    return tr.in_namespace(every, used, spaces).select("term", "pattern_id")


def direct(pairs: DataFrame, triples: DataFrame, found: DataFrame, reused: DataFrame) -> DataFrame:
    """Pattern entities all of whose internal triples the ontology holds; without any, those that it reuses.

    Starts from the triples that an ontology holds, and compares numbers: missing ones are never listed."""
    found, triples_ = of_patterns(pairs, found), of_patterns(pairs, triples)
    own = found.select(F.col("graph_id").alias("ontology_id"), F.col("graph_id").alias("pattern_id")).distinct()
    inside = tr.in_namespace(own, tr.terms(triples_), tr.namespaces(found)).select(F.col("pattern_id").alias("graph_id"), "term")
    internal = triples_.filter("s_kind = 'iri' AND o_kind = 'iri'")
    for place in ("s", "p", "o"):
        internal = internal.join(inside.withColumnRenamed("term", place), ["graph_id", place], "left_semi")
    internal = written(internal.select(F.col("graph_id").alias("pattern_id"), "s", "p", "o"), "internal")
    entities = F.explode(F.array_distinct(F.array("s", "p", "o"))).alias("iri")
    needed = internal.select("pattern_id", entities).groupBy("pattern_id", "iri").agg(F.count(F.lit(1)).alias("needed"))
    needed = written(needed.join(found.select(F.col("graph_id").alias("pattern_id"), "iri").distinct(), ["pattern_id", "iri"]), "needed")
    there = triples.filter("s_kind = 'iri' AND o_kind = 'iri'").select(F.col("graph_id").alias("ontology_id"), "s", "p", "o")
    held = there.join(internal, ["s", "p", "o"]).join(pairs, PAIR, "left_semi").select(*PAIR, entities)
    held = held.groupBy(*PAIR, "iri").agg(F.count(F.lit(1)).alias("held"))
    complete = held.join(needed, ["pattern_id", "iri"]).filter("held = needed").select(*PAIR, "iri")
    alone = reused.select(*PAIR, "iri").distinct().join(needed, ["pattern_id", "iri"], "left_anti")
    return complete.unionByName(alone.select(*PAIR, "iri"))


def usage(pairs: DataFrame, triples: DataFrame, v: Vocabulary = IRIS, *, found: DataFrame | None = None, used: DataFrame | None = None, reused: DataFrame | None = None) -> DataFrame:
    """For each pair: FORMS (numbers of entities), import_only, isolated, connectivity_ratio and connected_props_*.

    A caller that has the entities, terms and graph reuse already hands them in as `found`, `used` and `reused`."""
    found = tr.entities(triples, v) if found is None else found
    used = tr.terms(triples) if used is None else used
    reused = written(tr.graph_reuse(pairs, found, used), "reused") if reused is None else reused
    of_pattern = of_patterns(pairs, found)
    spaces = tr.namespaces(of_pattern)
    touched = touching(pairs, triples, in_any_namespace(triples, spaces))
    roles = of_pattern.groupBy(F.col("graph_id").alias("pattern_id"), "iri").agg(
        F.bool_or(F.col("kind") == "class").alias("cls"), F.bool_or(F.col("kind") != "class").alias("prop")
    )
    roles = written(roles, "roles")
    for x in "spo":
        mine = roles.select("pattern_id", F.col("iri").alias(x), F.col("cls").alias(f"{x}_cls"), F.col("prop").alias(f"{x}_prop"))
        touched = touched.join(mine, ["pattern_id", x], "left").na.fill(False, [f"{x}_cls", f"{x}_prop"])
        if x != "p":  # a literal that reads like an IRI is not one
            touched = touched.withColumns({f"{x}_{r}": F.col(f"{x}_{r}") & (F.col(f"{x}_kind") == "iri") for r in ("cls", "prop")})
    touched = written(touched, "touched")
    c = F.col
    sub_class, sub_prop = c("p") == v.one("rdfs:subClassOf"), c("p") == v.one("rdfs:subPropertyOf")
    restriction = c("p").isin(v("owl:onProperty", "owl:someValuesFrom", "owl:allValuesFrom", "owl:hasValue", "owl:onClass", "owl:onDataRange"))
    same = c("p").isin(v("owl:equivalentClass", "owl:equivalentProperty"))
    via = c("p_prop") & (c("s_out") | c("o_out"))

    def distinct(test: Column, term: str) -> Column:
        return F.count_distinct(F.when(test, c(term)))

    mixed = (c("s_in") & (c("p_out") | c("o_out"))) | (c("p_in") & (c("s_out") | c("o_out"))) | (c("o_in") & (c("s_out") | c("p_out")))
    forms = touched.groupBy(*PAIR).agg(
        distinct(sub_class & c("o_cls"), "o").alias("as_subclass"),
        distinct(sub_class & c("s_cls") & c("o_out"), "s").alias("as_superclass"),
        distinct(sub_prop & c("o_prop"), "o").alias("as_subproperty"),
        distinct(sub_prop & c("s_prop") & c("o_out"), "s").alias("as_superproperty"),
        distinct(via, "p").alias("via_property"),
        distinct(restriction & (c("o_cls") | c("o_prop")) & (c("o_kind") == "iri"), "o").alias("via_restriction"),
        F.bool_or(mixed).alias("mixed"),
    )
    ends = F.array(F.when(same & c("s_in") & c("o_out"), c("s")), F.when(same & c("o_in") & c("s_out"), c("o")))
    equal = touched.filter(same).select(*PAIR, F.explode(ends).alias("iri")).groupBy(*PAIR).agg(F.count_distinct("iri").alias("equivalent"))
    beside = F.array(
        F.struct(c("s").alias("iri"), ((c("s_kind") == "iri") & (c("p_out") | c("o_out"))).alias("out")),
        F.struct(c("p").alias("iri"), (c("s_out") | c("o_out")).alias("out")),
        F.struct(c("o").alias("iri"), ((c("o_kind") == "iri") & (c("s_out") | c("p_out"))).alias("out")),
    )
    linked = touched.select(*PAIR, F.explode(beside).alias("x")).select(*PAIR, "x.*").filter("out").select(*PAIR, "iri").distinct()
    one = reused.select(*PAIR, "iri").distinct()
    joined = one.join(linked.withColumn("linked", F.lit(1)), [*PAIR, "iri"], "left")
    connected = joined.groupBy(*PAIR).agg((F.count("linked") / F.count(F.lit(1))).alias("connectivity_ratio"))
    straight = direct(pairs, triples, found, reused).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("direct"))
    imported = triples.filter((c("p") == v.one("owl:imports")) & (c("o_kind") == "iri")).select(c("graph_id").alias("ontology_id"), "o").distinct()
    bare = spaces.select(c("graph_id").alias("pattern_id"), F.rtrim("ns", F.lit("#/")).alias("ns")).distinct()
    importing = pairs.join(imported, "ontology_id").join(bare, "pattern_id").filter(c("o").startswith(c("ns"))).select(*PAIR).distinct()
    props = touched.filter(via).select(*PAIR, c("p").alias("iri")).distinct()
    typed = triples.filter(c("p") == v.one("rdf:type")).select(c("graph_id").alias("ontology_id"), c("s").alias("iri"), c("o").alias("type"))
    roles_of = props.join(typed, ["ontology_id", "iri"], "left").groupBy(*PAIR).agg(
        F.count_distinct("iri").alias("connected_props_total"),
        *[F.count_distinct(F.when(c("type") == v.one(t), c("iri"))).alias(f"connected_props_{n}") for n, t in ROLES.items()],
    )
    out = pairs
    for part in (straight, forms, equal, connected, roles_of, importing.withColumn("importing", F.lit(True))):
        out = out.join(part, PAIR, "left")
    numbers = [*FORMS, "connectivity_ratio", "connected_props_total", *(f"connected_props_{n}" for n in ROLES)]
    out = out.na.fill(0, numbers).na.fill(False, ["mixed", "importing"])
    unused = reduce(lambda a, b: a & b, (c(f) == 0 for f in FORMS))
    return out.select(*PAIR, *FORMS, (c("importing") & unused).alias("import_only"), (~c("mixed")).alias("isolated"), *numbers[len(FORMS) :])
