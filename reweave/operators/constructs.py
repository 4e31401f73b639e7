"""Which logical constructs a graph uses, in one aggregation over its triples."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reweave.vocab import IRIS, Vocabulary

#: The constructs, in their order in reports (fixed values).
CONSTRUCTS = [
    "ROLE_INVERSE", "D", "CONCEPT_INTERSECTION", "CONCEPT_UNION", "CONCEPT_COMPLEX_NEGATION", "FULL_EXISTENTIAL",
    "LIMITED_EXISTENTIAL", "UNIVERSAL_RESTRICTION", "NOMINALS", "Q", "N", "ROLE_COMPLEX", "ROLE_REFLEXIVITY_CHAINS",
    "ROLE_DOMAIN_RANGE", "ROLE_HIERARCHY", "F", "ROLE_TRANSITIVE",
]


def constructs(triples: DataFrame, v: Vocabulary = IRIS) -> DataFrame:
    """graph_id, a boolean for each of CONSTRUCTS, expressivity, dl_complexity_score and n_axioms.

    The head of a `oneOf` list is looked up by one equi-join on (graph, node); all else is one pass.
    """
    p, o, kind = F.col("p"), F.col("o"), F.col("o_kind")
    heads = triples.filter(p == v.one("rdf:first")).select("graph_id", F.col("s").alias("o"), F.col("o_kind").alias("head_kind"))
    lists = triples.filter(p == v.one("owl:oneOf")).select("graph_id", "o").join(heads, ["graph_id", "o"])
    lists = lists.groupBy("graph_id").agg(
        F.bool_or(F.col("head_kind") == "literal").alias("literal_list"), F.bool_or(F.col("head_kind") == "iri").alias("iri_list")
    )

    def has(*names: str) -> Column:
        return p.isin(v(*names))

    def typed(*names: str) -> Column:
        return (p == v.one("rdf:type")) & (kind == "iri") & o.isin(v(*names))

    thing, any_literal = (kind == "iri") & (o == v.one("owl:Thing")), (kind == "iri") & (o == v.one("rdfs:Literal"))

    qualified = has("owl:minQualifiedCardinality", "owl:qualifiedCardinality", "owl:maxQualifiedCardinality")
    different = has("owl:differentFrom", "owl:disjointUnionOf") | typed("owl:AllDifferent")
    tests = {
        "ROLE_INVERSE": has("owl:inverseOf") | typed("owl:SymmetricProperty", "owl:InverseFunctionalProperty"),
        "D": typed("owl:DatatypeProperty") | has("owl:datatypeComplementOf") | (has("owl:hasValue") & (kind == "literal")),
        "CONCEPT_INTERSECTION": has("owl:intersectionOf"),
        "CONCEPT_UNION": has("owl:unionOf") | different,
        "CONCEPT_COMPLEX_NEGATION": has("owl:complementOf", "owl:disjointWith") | typed("owl:AllDisjointClasses") | different,
        "FULL_EXISTENTIAL": (has("owl:someValuesFrom") & ~thing) | (has("owl:hasValue") & (kind == "iri")),
        "LIMITED_EXISTENTIAL": has("owl:someValuesFrom") & thing,
        "UNIVERSAL_RESTRICTION": has("owl:allValuesFrom"),
        "NOMINALS": (has("owl:hasValue") & (kind == "iri")) | has("owl:differentFrom", "owl:sameAs") | typed("owl:AllDifferent"),
        "N": has("owl:minCardinality", "owl:cardinality", "owl:maxCardinality"),
        "ROLE_COMPLEX": has("owl:hasSelf", "owl:propertyDisjointWith")
        | typed("owl:AsymmetricProperty", "owl:AllDisjointProperties", "owl:IrreflexiveProperty"),
        "ROLE_REFLEXIVITY_CHAINS": typed("owl:ReflexiveProperty") | has("owl:propertyChainAxiom"),
        "ROLE_DOMAIN_RANGE": has("rdfs:domain", "rdfs:range"),
        "ROLE_HIERARCHY": has("owl:equivalentProperty", "rdfs:subPropertyOf"),
        "F": typed("owl:FunctionalProperty", "owl:InverseFunctionalProperty"),
        "ROLE_TRANSITIVE": typed("owl:TransitiveProperty"),
        "_qualified": qualified,
        "_filler": (has("owl:onClass") & ~thing) | (has("owl:onDataRange") & ~any_literal),
        "_trivial": (has("owl:onClass") & thing) | (has("owl:onDataRange") & any_literal),
        "_on_datatype": has("owl:onDatatype"),
        "_restrictions": has("owl:withRestrictions"),
    }
    seen = triples.groupBy("graph_id").agg(*[F.bool_or(t).alias(n) for n, t in tests.items()], F.count(F.lit(1)).alias("n_axioms"))
    seen = seen.join(lists, "graph_id", "left").na.fill(False, ["literal_list", "iri_list"])
    c = F.col
    seen = seen.withColumns(
        {
            "D": c("D") | c("literal_list") | (c("_on_datatype") & c("_restrictions")),
            "CONCEPT_UNION": c("CONCEPT_UNION") | c("iri_list"),
            "NOMINALS": c("NOMINALS") | c("iri_list"),
            "Q": c("_qualified") & c("_filler"),
            "N": c("N") | (c("_qualified") & c("_trivial")),
        }
    )
    return seen.select(
        "graph_id", *CONSTRUCTS, expressivity().alias("expressivity"),
        sum((c(x).cast("int") for x in CONSTRUCTS), F.lit(0)).alias("dl_complexity_score"), "n_axioms",
    )


def expressivity() -> Column:
    """The name of the bucket that the flags of CONSTRUCTS fall into; the first that fits."""
    c = F.col
    counting = c("Q") | c("N")
    heavy = reduce(or_, (c("CONCEPT_COMPLEX_NEGATION"), c("CONCEPT_UNION"), c("NOMINALS")))
    chains = c("ROLE_COMPLEX") | c("ROLE_REFLEXIVITY_CHAINS")
    return (
        F.when(~heavy, "EL")
        .when(c("ROLE_TRANSITIVE") & chains & (c("NOMINALS") | c("ROLE_INVERSE") | counting), "SROIQ")
        .when(c("ROLE_TRANSITIVE") & c("ROLE_HIERARCHY") & c("NOMINALS") & (counting | c("ROLE_INVERSE")), "SHOIN")
        .when(c("ROLE_HIERARCHY") & c("ROLE_INVERSE") & counting, "ALCHIQ")
        .otherwise("ALC")
    )
