"""Landed JSON of searches and catalogs, as hits and works."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HIT = ["source", "pattern_label", "pattern_iri", "match_label", "url", "details"]
CODE_SEARCH = "items array<struct<path:string,html_url:string,repository:struct<full_name:string>>>"
WEB_SEARCH = "items array<struct<title:string,link:string,snippet:string>>"
PORTAL = "collection array<struct<prefLabel:string,label:string,`@id`:string,id:string,definition:array<string>,description:string>>"
WORK = (
    "id string, doi string, title string, publication_year int, host_venue struct<display_name:string,url:string>, "
    "primary_location struct<landing_page_url:string,pdf_url:string,source:struct<publisher:string>>, "
    "open_access struct<is_oa:boolean,oa_status:string,oa_url:string>, best_oa_location struct<url:string,url_for_pdf:string>, "
    "authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>"
)
RECORD = "DOI string, title array<string>, issued struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string>>, publisher string, URL string"


def _filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _hits(pages: DataFrame, source: str, schema: str, field: str, label: Column, url: Column, details: Column) -> DataFrame:
    """pages: pattern_label, pattern_iri, json."""
    rows = pages.select("pattern_label", "pattern_iri", F.explode(F.from_json("json", schema)[field]).alias("x"))
    return rows.select(F.lit(source).alias("source"), "pattern_label", "pattern_iri", label.alias("match_label"), url.alias("url"), details.alias("details"))


def code_hits(pages: DataFrame) -> DataFrame:
    return _hits(pages, "github", CODE_SEARCH, "items", _filled(F.col("x.repository.full_name")), _filled(F.col("x.html_url")), _filled(F.col("x.path")))


def web_hits(pages: DataFrame) -> DataFrame:
    return _hits(pages, "web", WEB_SEARCH, "items", _filled(F.col("x.title")), _filled(F.col("x.link")), _filled(F.col("x.snippet")))


def portal_hits(pages: DataFrame, source: str) -> DataFrame:
    return _hits(
        pages, source, PORTAL, "collection", _filled(F.col("x.prefLabel"), F.col("x.label")), _filled(F.col("x.@id"), F.col("x.id")),
        _filled(F.array_join("x.definition", " "), F.col("x.description")),
    )


def works(rows: DataFrame) -> DataFrame:
    """Works from landed JSON (column json): authors without nulls, the first address that is one."""
    w = rows.select(F.from_json("json", WORK).alias("w")).select("w.*")
    http = lambda c: F.when(F.col(c).rlike("^https?://"), F.col(c))
    doi = F.when(F.lower("doi").startswith("http"), F.col("doi")).when(F.trim("doi") != "", F.concat(F.lit("https://doi.org/"), F.col("doi")))
    return w.select(
        "id", "doi", "title", F.col("publication_year").alias("year"), F.col("host_venue.display_name").alias("venue"),
        F.col("primary_location.source.publisher").alias("publisher"),
        F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull()).alias("authors"),
        F.coalesce(http("primary_location.landing_page_url"), http("primary_location.pdf_url"), http("host_venue.url"), doi, F.lit("")).alias("url"),
        F.col("open_access.is_oa").alias("is_oa"), F.coalesce("best_oa_location.url_for_pdf", "primary_location.pdf_url").alias("pdf_url"),
        "abstract_inverted_index",
    )


def records(rows: DataFrame) -> DataFrame:
    """Works from landed records whose titles are lists and whose year is the first part of `issued`."""
    r = rows.select(F.from_json("json", RECORD).alias("r")).select("r.*")
    year = F.try_element_at(F.try_element_at(F.col("issued.`date-parts`"), F.lit(1)), F.lit(1))
    return r.select(
        F.lower("DOI").alias("doi"), F.array_join("title", " ").alias("title"), year.alias("year"),
        F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"])).alias("authors"), "publisher", F.col("URL").alias("url"),
    )


def enriched(own: DataFrame, access: DataFrame) -> DataFrame:
    """Works with open-access look-ups by DOI: is_oa is overwritten, addresses are filled in, the first other location last.
    access: doi, is_oa, url, pdf_url, locations array<struct<url,url_for_pdf>>."""
    a = access.select("doi", F.col("is_oa").alias("a_oa"), F.col("url").alias("a_url"), F.col("pdf_url").alias("a_pdf"), F.try_element_at("locations", F.lit(1)).alias("a_other"))
    joined = own.join(a, "doi", "left").withColumns(
        {"is_oa": F.coalesce("a_oa", "is_oa"), "oa_url": F.coalesce("a_url", "a_other.url"), "pdf_url": F.coalesce("pdf_url", "a_pdf", "a_other.url_for_pdf")}
    )
    return joined.drop("a_oa", "a_url", "a_pdf", "a_other")


def looked_up(own: DataFrame, by_doi: DataFrame, by_title: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (doi, title) with `columns` found by DOI, else by the best hit for the title (title, rank)."""
    first = by_title.filter("rank = 1").select("title", *[F.col(c).alias(f"t_{c}") for c in columns])
    d = by_doi.select("doi", *[F.col(c).alias(f"d_{c}") for c in columns])
    out = own.join(d, "doi", "left").join(first, "title", "left")
    return out.select(*own.columns, *[F.coalesce(f"d_{c}", f"t_{c}").alias(c) for c in columns])


#: The fields that hold an object's address, in the order in which they are asked (fixed values).
ADDRESS_KEYS = ("uri", "@id", "id", "value", "url", "href")


def _text_of(value: object) -> str:
    if isinstance(value, list):
        return next((t for t in map(_text_of, value) if t), "")
    if isinstance(value, dict):
        key = next((k for k in ADDRESS_KEYS if k in value), None)
        return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if key is None else _text_of(value[key])
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


@F.pandas_udf(StringType())
def _nested_text(values: pd.Series) -> pd.Series:
    def of(said: str | None) -> str | None:
        try:
            return said and _text_of(json.loads(said))
        except ValueError:
            return said

    return values.map(of)


def as_text(value: Column) -> Column:
    """A landed JSON value as text: the first list item that is not empty, the address of an object (uri, @id, id, value,
    url or href, in this order), other objects as JSON, and null as empty. Lists and objects nest to any depth; what is
    no JSON stays as it is. Only lists and objects go to Python."""
    nested = F.trim(value).rlike(r"^[\[{]")
    return F.coalesce(F.when(nested, _nested_text(F.when(nested, value))).otherwise(value), F.lit(""))


CATALOG = "results array<map<string,string>>"


def catalog_hits(term_pages: DataFrame, vocabulary_pages: DataFrame) -> DataFrame:
    """Hits of a vocabulary catalog's two searches, by term and by vocabulary. Pages: pattern_label, pattern_iri, json."""

    def rows(pages: DataFrame) -> DataFrame:
        return pages.select("pattern_label", "pattern_iri", F.explode(F.from_json("json", CATALOG)["results"]).alias("x"))

    of = lambda m, k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    text = lambda *values: as_text(F.coalesce(*values, F.lit("")))
    x, vocab = F.col("x"), F.from_json(F.try_element_at("x", F.lit("vocabulary")), "map<string,string>")
    terms = rows(term_pages).select(
        F.lit("lov-terms").alias("source"), "pattern_label", "pattern_iri",
        text(of(vocab, "prefix"), of(x, "prefixedName"), of(x, "type"), of(x, "label")).alias("match_label"),
        F.trim(text(of(x, "uri"), of(vocab, "uri"), of(vocab, "uriSpace"))).alias("url"),
        F.concat(F.lit('{"vocab": '), F.coalesce(of(x, "vocabulary"), F.lit("{}")), F.lit("}")).alias("details"),
    )
    found = rows(vocabulary_pages).select(
        F.lit("lov-vocab").alias("source"), "pattern_label", "pattern_iri",
        text(of(x, "prefPrefix"), of(x, "prefix"), of(x, "uri"), of(x, "uriSpace")).alias("match_label"),
        F.trim(text(of(x, "uri"), of(x, "uriSpace"))).alias("url"), text(of(x, "description")).alias("details"),
    )
    return terms.unionByName(found)


def from_sources(hits: DataFrame, names: list[str]) -> DataFrame:
    """The hits of the named sources only; all of them without names."""
    return hits.filter(F.col("source").isin(names)) if names else hits


PREPRINT = (
    "id string, title string, summary string, authors array<struct<name:string>>, links array<struct<type:string,rel:string,href:string>>, "
    "published string, arxiv_primary_category struct<term:string>"
)


def preprints(rows: DataFrame) -> DataFrame:
    """Works from landed entries of a preprint feed (column json)."""
    e = rows.select(F.from_json("json", PREPRINT).alias("e")).select("e.*")
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    last = lambda test: F.try_element_at(F.filter("links", test), F.lit(-1))["href"]
    names = F.filter(F.transform("authors", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    pdf = last(lambda x: x["type"] == "application/pdf")
    return e.select(
        F.coalesce(F.nullif("id", F.lit("")), plain(F.col("title"))).alias("id"), F.lit(None).cast("string").alias("doi"), plain(F.col("title")).alias("title"),
        F.transform(names, plain).alias("authors"), F.left("published", F.lit(4)).try_cast("int").alias("year"), F.lit("arXiv").alias("venue"),
        F.lit("arXiv").alias("publisher"), F.coalesce(last(lambda x: x["rel"] == "alternate"), "id").alias("url"), F.lit("arxiv").alias("source"),
        pdf.alias("oa_url"), pdf.alias("pdf_url"), F.lit(True).alias("is_oa"), plain(F.col("summary")).alias("abstract"),
        F.col("arxiv_primary_category.term").alias("category"),
    )
