"""Queries over the triples view: reuse, usage forms and constructs of graphs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweave.functions.labels import hashed_vector
from reweave.operators import constructs as co
from reweave.operators import discovery as di
from reweave.operators import triples as tr
from reweave.operators import usage as us
from reweave.plans.bindings import CTE, OWN_TYPE, TERM_TYPE, Triples, graph_of, key_of, triples
from reweave.storage import written
from reweave.vocab import SHORT


#: Threshold and prefilter of the hybrid similarity.
HYBRID = (0.61, 0.4)


class Graphs:
    """What most queries start from, declared once; pairs and entities, which they need several times, are written."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.view = Triples(spark, sf_dir)

    @property
    def triples(self) -> DataFrame:
        return self.view.rows

    @cached_property
    def pairs(self) -> DataFrame:
        return written(tr.make_pairs(written(self.view.graphs, "graphs")), "pairs")

    @cached_property
    def found(self) -> DataFrame:
        return written(tr.entities(self.triples, SHORT), "entities")

    @cached_property
    def terms(self) -> DataFrame:
        return tr.terms(self.triples)

    @cached_property
    def declared(self) -> DataFrame:
        """The entities of the patterns only."""
        return tr.of_patterns(self.pairs, tr.entity_rows(self.view.patterns, SHORT))

    @cached_property
    def label_rows(self) -> DataFrame:
        return tr.label_rows(self.triples, tr.entity_rows(self.triples, SHORT), SHORT)

    def reuse(self) -> DataFrame:
        used = self.view.refs().withColumn("graph_id", graph_of("graph_id"))
        return tr.graph_reuse(self.pairs, self.declared, used, self.view.words)

    def label_reuse(self, by_kind: bool = False) -> DataFrame:
        return tr.label_reuse(self.pairs, self.label_rows, by_kind)

    def coverage_under(self, backends: dict[str, dict]) -> DataFrame:
        """Ontologies are told apart by their suppliers' keys until the pairs are counted."""
        v = self.view
        own = tr.labels(v.patterns, tr.entity_rows(v.patterns, SHORT), SHORT)
        pairs = self.pairs.withColumn("ontology_id", key_of("ontology_id"))
        out = tr.coverage_by_backend(pairs, self.declared, own, v.refs(), v.words, v.refs(TERM_TYPE, OWN_TYPE), v.labels, backends)
        return out.withColumn("ontology_id", graph_of("ontology_id"))

    def coverage(self) -> DataFrame:
        return self.coverage_under({"exact": {"threshold": 1.0}}).drop("backend")


def rounded_shares(out: DataFrame) -> DataFrame:
    return out.withColumns({c: F.round(c, 6) for c in ("coverage_graph", "coverage_label")})


def coverage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_shares(Graphs(spark, sf_dir).coverage())


def coverage_under(spark: SparkSession, sf_dir: str, backends: dict[str, dict]) -> DataFrame:
    return rounded_shares(Graphs(spark, sf_dir).coverage_under(backends))


def coverage_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters first, and vectors of hashed trigrams where they come near."""
    g = Graphs(spark, sf_dir)
    named = written(g.label_rows.distinct(), "labels")
    vectors = written(named.select("label").distinct(), "distinct").withColumn("embedding", hashed_vector(F.col("label")))
    own, theirs = tr.of_patterns(g.pairs, named), written(named.select("graph_id", "label").distinct(), "theirs")
    by_label = tr.hybrid_label_reuse(g.pairs, theirs, vectors, *HYBRID, own)
    return rounded_shares(tr.coverage(g.pairs, g.declared, g.reuse(), by_label))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.entity_counts(Graphs(spark, sf_dir).found)


def ontology_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.ontology_iri(triples(spark, sf_dir), SHORT)


def import_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.imports(triples(spark, sf_dir), "promo", None, SHORT)


def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graphs(spark, sf_dir).label_rows.distinct()


def reuse_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graphs(spark, sf_dir)
    of = lambda rows, name: rows.groupBy("ontology_id", "pattern_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{name}_{k}") for k in ("class", "object", "datatype")])
    out = g.pairs.join(of(g.reuse(), "graph"), us.PAIR, "left")
    return out.join(of(g.label_reuse(by_kind=True), "label"), us.PAIR, "left").na.fill(0)


def additional_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graphs(spark, sf_dir)
    return tr.additional(g.pairs, g.found)


def namespace_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graphs(spark, sf_dir)
    return tr.in_namespace(g.pairs, g.terms, tr.namespaces(g.found))


def usage_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graphs(spark, sf_dir)
    return us.usage(g.pairs, g.triples, SHORT, found=g.found).withColumn("connectivity_ratio", F.round("connectivity_ratio", 6))


def graph_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.constructs(triples(spark, sf_dir), SHORT)


QUERIES = {
    "graph_coverage": coverage_graph,
    "graph_coverage_char": lambda s, d: coverage_under(s, d, {"char": {"threshold": 0.6}}).drop("backend"),
    "graph_coverage_word": lambda s, d: coverage_under(s, d, {"word": {"threshold": 0.5}}).drop("backend"),
    "graph_coverage_hybrid": coverage_hybrid,
    "graph_coverage_backends": lambda s, d: coverage_under(s, d, {"exact": {"threshold": 1.0}, "char": {"threshold": 0.7}, "word": {"threshold": 0.7}, "auto": {"threshold": 0.7}}),
    "graph_import_rows": lambda s, d: di.as_hits(tr.imports(triples(s, d), "promo", None, SHORT), "imports"),
    "graph_entity_counts": entity_counts,
    "graph_ontology_iri": ontology_iris,
    "graph_import_hits": import_hits,
    "graph_entity_labels": entity_labels,
    "graph_reuse_by_kind": reuse_by_kind,
    "graph_additional_entities": additional_entities,
    "graph_namespace_terms": namespace_terms,
    "graph_usage_forms": usage_forms,
    "graph_constructs": graph_constructs,
}

_COVERAGE = """, lr AS (SELECT DISTINCT ontology_id, pattern_id, p.kind, p.iri FROM pr JOIN lb p ON p.graph_id = pattern_id
       JOIN lb o ON o.graph_id = ontology_id AND o.label = p.label UNION SELECT * FROM ru),
cov AS (SELECT ontology_id, pattern_id,
  (SELECT count(DISTINCT iri) FROM e WHERE graph_id = pattern_id) AS pattern_total,
  (SELECT count(DISTINCT iri) FROM ru WHERE ru.ontology_id = pr.ontology_id AND ru.pattern_id = pr.pattern_id) AS reused_total_graph,
  (SELECT count(DISTINCT iri) FROM lr WHERE lr.ontology_id = pr.ontology_id AND lr.pattern_id = pr.pattern_id) AS reused_total_label FROM pr)
"""
_USAGE = f""", inn AS (SELECT DISTINCT ontology_id, pattern_id, term FROM pr JOIN tm ON tm.graph_id = ontology_id JOIN ns ON ns.graph_id = pattern_id AND starts_with(term, ns.ns)),
role AS (SELECT graph_id AS pattern_id, iri, bool_or(kind = 'class') AS cls, bool_or(kind <> 'class') AS prop FROM e GROUP BY ALL),
f AS (SELECT pr.ontology_id, pr.pattern_id, t.s, t.p, t.o, i1.term IS NOT NULL AS s_in, i2.term IS NOT NULL AS p_in, o_kind = 'iri' AND i3.term IS NOT NULL AS o_in,
        i1.term IS NULL AS s_out, i2.term IS NULL AS p_out, o_kind = 'iri' AND i3.term IS NULL AS o_out,
        coalesce(r1.cls, false) AS s_cls, coalesce(r1.prop, false) AS s_prop, coalesce(r2.prop, false) AS p_prop, coalesce(r3.cls, false) AS o_cls, coalesce(r3.prop, false) AS o_prop
      FROM pr JOIN t ON t.graph_id = pr.ontology_id
      LEFT JOIN inn i1 ON i1.ontology_id = pr.ontology_id AND i1.pattern_id = pr.pattern_id AND i1.term = t.s
      LEFT JOIN inn i2 ON i2.ontology_id = pr.ontology_id AND i2.pattern_id = pr.pattern_id AND i2.term = t.p
      LEFT JOIN inn i3 ON i3.ontology_id = pr.ontology_id AND i3.pattern_id = pr.pattern_id AND i3.term = t.o
      LEFT JOIN role r1 ON r1.pattern_id = pr.pattern_id AND r1.iri = t.s
      LEFT JOIN role r2 ON r2.pattern_id = pr.pattern_id AND r2.iri = t.p
      LEFT JOIN role r3 ON r3.pattern_id = pr.pattern_id AND r3.iri = t.o AND t.o_kind = 'iri'),
eq AS (SELECT ontology_id, pattern_id, count(DISTINCT iri) AS equivalent FROM (
        SELECT ontology_id, pattern_id, s AS iri FROM f WHERE p IN ('owl:equivalentClass','owl:equivalentProperty') AND s_in AND o_out
        UNION SELECT ontology_id, pattern_id, o FROM f WHERE p IN ('owl:equivalentClass','owl:equivalentProperty') AND o_in AND s_out) GROUP BY ALL),
self AS (SELECT graph_id AS pattern_id, term FROM tm JOIN ns USING (graph_id) WHERE starts_with(term, ns.ns)),
it AS (SELECT t.graph_id AS pattern_id, s, p, o FROM t WHERE o_kind = 'iri' AND (graph_id, s) IN (SELECT pattern_id, term FROM self)
       AND (graph_id, p) IN (SELECT pattern_id, term FROM self) AND (graph_id, o) IN (SELECT pattern_id, term FROM self)),
ie AS (SELECT pattern_id, s AS iri, s, p, o FROM it UNION SELECT pattern_id, p, s, p, o FROM it UNION SELECT pattern_id, o, s, p, o FROM it),
rd AS (SELECT DISTINCT ontology_id, pattern_id, iri FROM ru),
dr AS (SELECT ontology_id, pattern_id, count(*) AS direct FROM (
        SELECT pr.ontology_id, pr.pattern_id, role.iri FROM pr JOIN role ON role.pattern_id = pr.pattern_id
        LEFT JOIN ie ON ie.pattern_id = pr.pattern_id AND ie.iri = role.iri
        LEFT JOIN t x ON x.graph_id = pr.ontology_id AND x.s = ie.s AND x.p = ie.p AND x.o = ie.o
        LEFT JOIN rd ON rd.ontology_id = pr.ontology_id AND rd.pattern_id = pr.pattern_id AND rd.iri = role.iri
        GROUP BY ALL HAVING CASE WHEN count(ie.s) = 0 THEN count(rd.iri) > 0 ELSE count(ie.s) = count(x.s) END) GROUP BY ALL),
lk AS (SELECT DISTINCT ontology_id, pattern_id, iri FROM (
        SELECT ontology_id, pattern_id, s AS iri FROM f WHERE p_out OR o_out UNION SELECT ontology_id, pattern_id, p FROM f WHERE s_out OR o_out
        UNION SELECT ontology_id, pattern_id, o FROM f WHERE s_out OR p_out)),
cn AS (SELECT rd.ontology_id, rd.pattern_id, count(lk.iri) / count(*) AS ratio FROM rd LEFT JOIN lk ON lk.ontology_id = rd.ontology_id AND lk.pattern_id = rd.pattern_id AND lk.iri = rd.iri GROUP BY ALL),
im AS (SELECT DISTINCT pr.ontology_id, pr.pattern_id FROM pr JOIN t ON t.graph_id = pr.ontology_id AND t.p = 'owl:imports' JOIN ns ON ns.graph_id = pr.pattern_id AND starts_with(t.o, rtrim(ns.ns, '#/'))),
cp AS (SELECT f.ontology_id, f.pattern_id, {', '.join(f"count(DISTINCT CASE WHEN y.o = '{kind}' THEN f.p END) AS connected_props_{n}" for n, kind in us.ROLES.items())}
       FROM f LEFT JOIN t y ON y.graph_id = f.ontology_id AND y.s = f.p AND y.p = 'rdf:type' WHERE p_prop AND (s_out OR o_out) GROUP BY ALL),
ag AS (SELECT ontology_id, pattern_id,
  count(DISTINCT CASE WHEN p = 'rdfs:subClassOf' AND o_cls THEN o END) AS as_subclass,
  count(DISTINCT CASE WHEN p = 'rdfs:subClassOf' AND s_cls AND o_out THEN s END) AS as_superclass,
  count(DISTINCT CASE WHEN p = 'rdfs:subPropertyOf' AND o_prop THEN o END) AS as_subproperty,
  count(DISTINCT CASE WHEN p = 'rdfs:subPropertyOf' AND s_prop AND o_out THEN s END) AS as_superproperty,
  count(DISTINCT CASE WHEN p_prop AND (s_out OR o_out) THEN p END) AS via_property,
  count(DISTINCT CASE WHEN p IN ('owl:onProperty','owl:someValuesFrom','owl:allValuesFrom','owl:hasValue','owl:onClass','owl:onDataRange') AND (o_cls OR o_prop) THEN o END) AS via_restriction,
  bool_or(s_in AND (p_out OR o_out) OR p_in AND (s_out OR o_out) OR o_in AND (s_out OR p_out)) AS mixed
  FROM f GROUP BY ALL),
us AS (SELECT pr.ontology_id, pr.pattern_id, coalesce(direct, 0) AS direct, coalesce(as_subclass, 0) AS as_subclass, coalesce(as_superclass, 0) AS as_superclass,
  coalesce(as_subproperty, 0) AS as_subproperty, coalesce(as_superproperty, 0) AS as_superproperty, coalesce(via_property, 0) AS via_property,
  coalesce(via_restriction, 0) AS via_restriction, coalesce(equivalent, 0) AS equivalent, NOT coalesce(mixed, false) AS isolated,
  im.ontology_id IS NOT NULL AS importing, coalesce(ratio, 0.0) AS ratio, {', '.join(f"coalesce(connected_props_{n}, 0) AS connected_props_{n}" for n in us.ROLES)}
  FROM pr LEFT JOIN ag USING (ontology_id, pattern_id) LEFT JOIN dr USING (ontology_id, pattern_id) LEFT JOIN eq USING (ontology_id, pattern_id)
  LEFT JOIN cn USING (ontology_id, pattern_id) LEFT JOIN im USING (ontology_id, pattern_id) LEFT JOIN cp USING (ontology_id, pattern_id))
"""
_FLAGS = {
    "ROLE_INVERSE": "p = 'owl:inverseOf' OR p = 'rdf:type' AND o IN ('owl:SymmetricProperty','owl:InverseFunctionalProperty')",
    "D": "p = 'rdf:type' AND o = 'owl:DatatypeProperty' OR p = 'owl:datatypeComplementOf' OR p = 'owl:hasValue' AND o_kind = 'literal'",
    "CONCEPT_INTERSECTION": "p = 'owl:intersectionOf'",
    "CONCEPT_UNION": "p IN ('owl:unionOf','owl:differentFrom','owl:disjointUnionOf') OR p = 'rdf:type' AND o = 'owl:AllDifferent'",
    "CONCEPT_COMPLEX_NEGATION": "p IN ('owl:complementOf','owl:disjointWith','owl:differentFrom','owl:disjointUnionOf') OR p = 'rdf:type' AND o IN ('owl:AllDisjointClasses','owl:AllDifferent')",
    "FULL_EXISTENTIAL": "p = 'owl:someValuesFrom' AND o <> 'owl:Thing' OR p = 'owl:hasValue' AND o_kind = 'iri'",
    "LIMITED_EXISTENTIAL": "p = 'owl:someValuesFrom' AND o = 'owl:Thing'",
    "UNIVERSAL_RESTRICTION": "p = 'owl:allValuesFrom'",
    "NOMINALS": "p = 'owl:hasValue' AND o_kind = 'iri' OR p IN ('owl:differentFrom','owl:sameAs') OR p = 'rdf:type' AND o = 'owl:AllDifferent'",
    "Q": "p IN ('owl:qualifiedCardinality') AND p = 'owl:onClass'",
    "N": "p IN ('owl:minCardinality','owl:cardinality','owl:maxCardinality')",
    "ROLE_COMPLEX": "p IN ('owl:hasSelf','owl:propertyDisjointWith') OR p = 'rdf:type' AND o IN ('owl:AsymmetricProperty','owl:AllDisjointProperties','owl:IrreflexiveProperty')",
    "ROLE_REFLEXIVITY_CHAINS": "p = 'rdf:type' AND o = 'owl:ReflexiveProperty' OR p = 'owl:propertyChainAxiom'",
    "ROLE_DOMAIN_RANGE": "p IN ('rdfs:domain','rdfs:range')",
    "ROLE_HIERARCHY": "p IN ('owl:equivalentProperty','rdfs:subPropertyOf')",
    "F": "p = 'rdf:type' AND o IN ('owl:FunctionalProperty','owl:InverseFunctionalProperty')",
    "ROLE_TRANSITIVE": "p = 'rdf:type' AND o = 'owl:TransitiveProperty'",
}
CONSTRUCT_CTE = f""", c0 AS (SELECT graph_id, {', '.join(f'bool_or({test}) AS "{n}"' for n, test in _FLAGS.items())}, count(*) AS n_axioms FROM t GROUP BY graph_id),
cs AS (SELECT *, CASE WHEN NOT ("CONCEPT_COMPLEX_NEGATION" OR "CONCEPT_UNION" OR "NOMINALS") THEN 'EL'
   WHEN "ROLE_TRANSITIVE" AND ("ROLE_COMPLEX" OR "ROLE_REFLEXIVITY_CHAINS") AND ("NOMINALS" OR "ROLE_INVERSE" OR "Q" OR "N") THEN 'SROIQ'
   WHEN "ROLE_TRANSITIVE" AND "ROLE_HIERARCHY" AND "NOMINALS" AND ("N" OR "Q" OR "ROLE_INVERSE") THEN 'SHOIN'
   WHEN "ROLE_HIERARCHY" AND "ROLE_INVERSE" AND ("Q" OR "N") THEN 'ALCHIQ' ELSE 'ALC' END AS expressivity,
   {' + '.join(f'"{n}"::INT' for n in _FLAGS)} AS dl_complexity_score FROM c0)
"""
USAGE_CTE = _USAGE
COVERAGE_CTE = _COVERAGE
_GRAMS = {
    "char": "(SELECT label, unnest(CASE WHEN length(label) < 3 THEN [label] ELSE list_transform(range(1, length(label) - 1), lambda i: substr(label, i, 3)) END) AS g FROM dl)",
    "word": "(SELECT label, unnest(string_split(label, ' ')) AS g FROM dl)",
}


def similar_coverage(name: str, threshold: float) -> str:
    """Coverage where labels count as equal whose cosine over grams reaches the threshold."""
    return CTE + f""", dl AS (SELECT DISTINCT label FROM lb), gc AS (SELECT label, g, count(*) AS k FROM {_GRAMS[name]} GROUP BY ALL), gn AS (SELECT label, sqrt(sum(k * k)) AS nm FROM gc GROUP BY label),
    sm AS (SELECT a.label AS l, b.label AS r FROM gc a JOIN gc b USING (g) JOIN gn x ON x.label = a.label JOIN gn y ON y.label = b.label
      GROUP BY a.label, b.label, x.nm, y.nm HAVING sum(a.k * b.k) / (x.nm * y.nm) >= {threshold} - 1e-12 UNION SELECT label, label FROM dl),
    lr AS (SELECT DISTINCT ontology_id, pattern_id, p.kind, p.iri FROM pr JOIN lb p ON p.graph_id = pattern_id JOIN sm ON l = p.label
       JOIN lb o ON o.graph_id = ontology_id AND o.label = r UNION SELECT * FROM ru),
    cov AS (SELECT ontology_id, pattern_id, (SELECT count(DISTINCT iri) FROM e WHERE graph_id = pattern_id) AS pattern_total,
      (SELECT count(DISTINCT iri) FROM ru WHERE ru.ontology_id = pr.ontology_id AND ru.pattern_id = pr.pattern_id) AS reused_total_graph,
      (SELECT count(DISTINCT iri) FROM lr WHERE lr.ontology_id = pr.ontology_id AND lr.pattern_id = pr.pattern_id) AS reused_total_label FROM pr)
    SELECT *, round(reused_total_graph / pattern_total, 6) AS coverage_graph, round(reused_total_label / pattern_total, 6) AS coverage_label FROM cov"""


def hybrid_coverage(threshold: float, prefilter: float) -> str:
    """Coverage where the best character cosine of an entity decides, and near it the cosine of hashed trigrams."""
    place = "(unicode(substr(g, 1, 1)) * 961 + unicode(substr(g, 2, 1)) * 31 + unicode(substr(g, 3, 1))) % 64"
    return CTE + f""", dl AS (SELECT DISTINCT label FROM lb), gr_ AS (SELECT label, unnest(CASE WHEN length(label) < 3 THEN [label] ELSE list_transform(range(1, length(label) - 1), lambda i: substr(label, i, 3)) END) AS g FROM dl),
    gc AS (SELECT label, g, count(*) AS k FROM gr_ GROUP BY ALL), gn AS (SELECT label, sqrt(sum(k * k)) AS nm FROM gc GROUP BY label),
    sm AS (SELECT a.label AS l, b.label AS r, sum(a.k * b.k) / (x.nm * y.nm) AS s FROM gc a JOIN gc b USING (g) JOIN gn x ON x.label = a.label JOIN gn y ON y.label = b.label
      GROUP BY a.label, b.label, x.nm, y.nm HAVING sum(a.k * b.k) / (x.nm * y.nm) >= {min(prefilter - 0.05, threshold)} - 1e-12),
    ol AS (SELECT DISTINCT graph_id, label FROM lb),
    best AS (SELECT pr.ontology_id, pr.pattern_id, p.kind, p.iri, max(s) AS best FROM pr JOIN lb p ON p.graph_id = pattern_id JOIN sm ON l = p.label
      JOIN ol o ON o.graph_id = ontology_id AND o.label = r GROUP BY ALL),
    ga AS (SELECT ontology_id, pattern_id, b.kind, b.iri, p.label FROM best b JOIN lb p ON p.graph_id = pattern_id AND p.kind = b.kind AND p.iri = b.iri
      WHERE best < {threshold} - 1e-12 AND best >= {prefilter - 0.05} - 1e-12),
    hc AS (SELECT label, {place} AS h, count(*) AS k FROM gr_ GROUP BY ALL), hn AS (SELECT label, sqrt(sum(k * k)) AS nm FROM hc GROUP BY label),
    vs AS (SELECT a.label AS l, b.label AS r FROM hc a JOIN hc b USING (h) JOIN hn x ON x.label = a.label JOIN hn y ON y.label = b.label
      WHERE a.label IN (SELECT label FROM ga) GROUP BY a.label, b.label, x.nm, y.nm HAVING sum(a.k * b.k) / (x.nm * y.nm) >= {threshold}),
    lr AS (SELECT DISTINCT ontology_id, pattern_id, kind, iri FROM best WHERE best >= {threshold} - 1e-12
      UNION SELECT ontology_id, pattern_id, kind, iri FROM ga JOIN vs ON l = ga.label JOIN ol o ON o.graph_id = ontology_id AND o.label = r UNION SELECT * FROM ru),
    cov AS (SELECT ontology_id, pattern_id, (SELECT count(DISTINCT iri) FROM e WHERE graph_id = pattern_id) AS pattern_total,
      (SELECT count(DISTINCT iri) FROM ru WHERE ru.ontology_id = pr.ontology_id AND ru.pattern_id = pr.pattern_id) AS reused_total_graph,
      (SELECT count(DISTINCT iri) FROM lr WHERE lr.ontology_id = pr.ontology_id AND lr.pattern_id = pr.pattern_id) AS reused_total_label FROM pr)
    SELECT *, round(reused_total_graph / pattern_total, 6) AS coverage_graph, round(reused_total_label / pattern_total, 6) AS coverage_label FROM cov"""


ORACLE_SQL = {
    "graph_coverage_char": similar_coverage("char", 0.6),
    "graph_coverage_word": similar_coverage("word", 0.5),
    "graph_coverage_hybrid": hybrid_coverage(*HYBRID),
    "graph_coverage_backends": " UNION ALL ".join(
        f"SELECT *, '{n}' AS backend FROM ({sql})" for n, sql in (
            ("exact", CTE + _COVERAGE + "SELECT *, round(reused_total_graph / pattern_total, 6) AS coverage_graph, round(reused_total_label / pattern_total, 6) AS coverage_label FROM cov"),
            ("char", similar_coverage("char", 0.7)), ("word", similar_coverage("word", 0.7)), ("auto", similar_coverage("char", 0.7)),
        )
    ),
    "graph_import_rows": CTE + "SELECT DISTINCT 'imports' AS source, '' AS pattern_label, o AS pattern_iri, s AS match_label, s AS url, 'owl:imports' AS details FROM t WHERE p = 'owl:imports' AND contains(o, 'promo')",
    "graph_coverage": CTE + _COVERAGE + """SELECT *, round(reused_total_graph / pattern_total, 6) AS coverage_graph,
        round(reused_total_label / pattern_total, 6) AS coverage_label FROM cov""",
    "graph_entity_counts": CTE + """SELECT graph_id, count(*) FILTER (kind = 'class') AS n_classes, count(*) FILTER (kind = 'object') AS n_object_properties,
        count(*) FILTER (kind = 'datatype') AS n_datatype_properties, count(*) AS n_total FROM e GROUP BY graph_id""",
    "graph_ontology_iri": CTE + "SELECT graph_id, min(s) AS ontology_iri FROM t WHERE p = 'rdf:type' AND o = 'owl:Ontology' GROUP BY graph_id",
    "graph_import_hits": CTE + "SELECT DISTINCT s AS ontology, o AS imported FROM t WHERE p = 'owl:imports' AND contains(o, 'promo')",
    "graph_entity_labels": CTE + "SELECT * FROM lb",
    "graph_reuse_by_kind": CTE + """, lk AS (SELECT DISTINCT ontology_id, pattern_id, p.kind, p.iri FROM pr JOIN lb p ON p.graph_id = pattern_id
        JOIN lb o ON o.graph_id = ontology_id AND o.label = p.label AND o.kind = p.kind)
        SELECT ontology_id, pattern_id, """ + ", ".join(
        f"(SELECT count(*) FROM {rel} x WHERE x.ontology_id = pr.ontology_id AND x.pattern_id = pr.pattern_id AND kind = '{k}') AS {name}_{k}"
        for name, rel in (("graph", "ru"), ("label", "lk")) for k in ("class", "object", "datatype")) + " FROM pr",
    "graph_additional_entities": CTE + "SELECT ontology_id, pattern_id, " + ", ".join(
        f"(SELECT count(*) FROM e x WHERE x.graph_id = ontology_id AND kind = '{k}' AND NOT EXISTS (SELECT 1 FROM e y WHERE y.graph_id = pattern_id AND y.kind = x.kind AND y.iri = x.iri)) AS additional_{n}"
        for k, n in (("class", "classes"), ("object", "object_properties"), ("datatype", "datatype_properties"))) + " FROM pr",
    "graph_namespace_terms": CTE + "SELECT DISTINCT ontology_id, pattern_id, term FROM pr JOIN tm ON tm.graph_id = ontology_id JOIN ns ON ns.graph_id = pattern_id AND starts_with(term, ns.ns)",
    "graph_usage_forms": CTE + _USAGE + f"""SELECT ontology_id, pattern_id, {', '.join(us.FORMS)}, importing AND {' + '.join(us.FORMS)} = 0 AS import_only,
        isolated, round(ratio, 6) AS connectivity_ratio, via_property AS connected_props_total, {', '.join(f'connected_props_{n}' for n in us.ROLES)} FROM us""",
    "graph_constructs": CTE + CONSTRUCT_CTE + "SELECT * FROM cs",
}
