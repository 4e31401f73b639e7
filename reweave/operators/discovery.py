"""Search hits and library files: IRI extraction, hit tables and the plan of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reweave.operators.containment import contained

HITS = ["source", "pattern_label", "pattern_iri", "match_label", "url", "details"]
#: Method -> pattern with the IRI as its first group (fixed values).
IRI_PATTERNS = {
    "xml:base": r'(?i)xml:base\s*=\s*"([^"]+)"',
    "xmlns:base (namespace)": r'(?i)xmlns:base\s*=\s*"([^"]+)"',
    "xmlns (default namespace)": r'(?i)xmlns\s*=\s*"([^"]+)"',
    "owl:Ontology IRI/rdf:about": r'(?i)<owl:Ontology[^>]*?(?:IRI|rdf:about)\s*=\s*"([^"]+)"',
    "OWL/XML ontologyIRI": r'(?i)<Ontology[^>]*?\sontologyIRI\s*=\s*"([^"]+)"',
    "Turtle @base": r"(?i)@base\s*<([^>]+)>",
    "Turtle BASE": r"(?im)^\s*BASE\s*<([^>]+)>\s*$",
    "Turtle <IRI> a owl:Ontology": r"(?im)^\s*<([^>]+)>\s+a\s+owl:Ontology\b",
    "owl:versionIRI": r"(?i)owl:versionIRI\s*<([^>]+)>",
}
#: The default prefix, and where it names an ontology (fixed values).
DEFAULT_PREFIX = r"(?i)@prefix\s*:\s*<([^>]+)>\s*\."
DEFAULT_IS_ONTOLOGY = r"(?im)^\s*:\s+a\s+owl:Ontology\b"
#: An ending, the endings known, the page of a file, and what a name can't hold (fixed values).
ENDING = r"\.([A-Za-z0-9]{2,6})(?:$|[?#])"
ENDINGS = ["owl", "ttl", "rdf", "xml", "nt", "trig"]
FILE_PAGE = r"^https?://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.*)$"
NOT_IN_NAMES = r"[^A-Za-z0-9._+\-]"


def _tagged(method: str):
    return lambda iri: F.struct(iri.alias("iri"), F.lit(method).alias("method"))


def extract_iris(files: DataFrame, patterns: dict[str, str] = IRI_PATTERNS, host: str = "") -> DataFrame:
    """Distinct file, dir, iri and method. files: file, dir, text. IRIs without `host` (any case) are left out."""
    found = [
        F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), _tagged(method))
        for method, pattern in patterns.items()
    ]
    colon = F.when(F.col("text").rlike(DEFAULT_IS_ONTOLOGY) & F.col("text").rlike(DEFAULT_PREFIX), F.array(F.struct(F.regexp_extract("text", DEFAULT_PREFIX, 1).alias("iri"), F.lit("Turtle @prefix : <> + : a owl:Ontology").alias("method"))))
    rows = files.select("file", "dir", F.explode(F.concat(*found, F.coalesce(colon, F.slice(found[0], 1, 0)))).alias("x")).select("file", "dir", "x.*")
    iri = F.trim("iri")
    iri = F.when(F.col("method") == "xmlns (default namespace)", F.rtrim(iri, F.lit("#"))).otherwise(iri)
    return rows.withColumn("iri", iri).filter((F.col("iri") != "") & F.contains(F.lower("iri"), F.lit(host.lower()))).distinct()


def directory_summary(files: DataFrame, found: DataFrame) -> DataFrame:
    """For each directory: total_files, files_with_iri, files_without_iri and unique_iris."""
    hit = found.select("file", F.lit(1).alias("hit")).distinct()
    counts = files.join(hit, "file", "left").groupBy("dir").agg(F.count(F.lit(1)).alias("total_files"), F.count("hit").alias("files_with_iri"))
    iris = found.groupBy("dir").agg(F.count_distinct("iri").alias("unique_iris"))
    return counts.join(iris, "dir", "left").na.fill(0, ["unique_iris"]).withColumn("files_without_iri", F.col("total_files") - F.col("files_with_iri"))


def first_iri(text: Column) -> Column:
    """The IRI of xml:base, else of an ontology attribute, else of @base; null without any."""
    of = lambda m: F.nullif(F.trim(F.regexp_extract(text, IRI_PATTERNS[m], 1)), F.lit(""))
    return F.coalesce(of("xml:base"), of("owl:Ontology IRI/rdf:about"), of("Turtle @base"))


def is_generic(iri: Column, home: str) -> Column:
    """Template pages and the home page of the site `home`."""
    t = F.rtrim(F.lower(F.trim(iri)), F.lit("/"))
    return t.endswith("/template") | F.contains(t, F.lit("/template/")) | t.rlike(rf"^https?://(www\.)?{home.replace('.', chr(92) + '.')}$")


def is_generic_at_end(iri: Column, home: str) -> Column:
    """As `is_generic`, but a template only as the last part or with anything below it."""
    return iri.rlike(r"(?i)/template(/.*)?$") | iri.rlike(rf"(?i)^https?://(www\.)?{home.replace('.', chr(92) + '.')}/?$")


def sanitize(label: Column, default: str = "unknown") -> Column:
    s = F.regexp_replace(F.translate(F.trim(F.coalesce(label, F.lit(""))), "/\\", "__"), NOT_IN_NAMES, "_")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(s, "_+", "_"), F.lit("_.")), F.lit("")), F.lit(default))


def slug(name: Column) -> Column:
    """The last part of a path without its extension, white space as underscores."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), r"(?U)\s+", "_")


def as_hits(found: DataFrame, source: str) -> DataFrame:
    """Import rows (ontology, imported) in the shape of hits."""
    return found.select(F.lit(source).alias("source"), F.lit("").alias("pattern_label"), F.col("imported").alias("pattern_iri"),
                        F.col("ontology").alias("match_label"), F.col("ontology").alias("url"), F.lit("owl:imports").alias("details"))


def methods_summary(files: DataFrame, found: DataFrame) -> DataFrame:
    """kind, name, n: how often each method found an IRI, and directories and files without any."""
    by_method = found.groupBy("method").agg(F.count(F.lit(1)).alias("n")).select(F.lit("method").alias("kind"), F.col("method").alias("name"), "n")
    bare = files.join(found.select("file").distinct(), "file", "left_anti").select(F.lit("file without").alias("kind"), F.col("file").alias("name"), F.lit(0).cast("long").alias("n"))
    dirs = directory_summary(files, found).filter("files_with_iri = 0").select(F.lit("directory without").alias("kind"), F.col("dir").alias("name"), F.col("total_files").alias("n"))
    return by_method.unionByName(bare).unionByName(dirs)


def extension(url: Column, details: Column) -> Column:
    """The first known extension in url, then in details; `.owl` without any."""
    of = lambda c: F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), ENDING, 1))
    known = lambda c: F.when(of(c).isin(ENDINGS), F.concat(F.lit("."), of(c)))
    return F.coalesce(known(url), known(details), F.lit(".owl"))


def raw_url(url: Column, raw_host: str) -> Column:
    """A file's raw address from its page's; null for other addresses."""
    return F.when(url.rlike(FILE_PAGE), F.regexp_replace(url, FILE_PAGE, f"https://{raw_host}/$1/$2/$3/$4"))


def stem(url: Column) -> Column:
    """The file name in an address without its extension, sanitised."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    name = F.regexp_extract(F.rtrim(F.when(path == "", url).otherwise(path), F.lit("/")), r"([^/]*)$", 1)
    return sanitize(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def distinct_hits(hits: DataFrame, order: str) -> DataFrame:
    """The first hit, by `order`, of each (source, pattern_iri, url)."""
    first = hits.groupBy("source", "pattern_iri", "url").agg(F.min(order).alias(order))
    return hits.join(first, ["source", "pattern_iri", "url", order], "left_semi")


def containing_files(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """pattern_iri, the file that holds it with the shortest path, then the smallest name, and n_files, how many hold it.

    Patterns that no file holds are left out; see `contained`."""
    met = contained(files, patterns).distinct()
    return met.groupBy("pattern_iri").agg(F.min_by("file", F.struct(F.char_length("file"), F.col("file"))).alias("file"), F.count(F.lit(1)).alias("n_files"))


def dataset_plan(hits: DataFrame, chosen: DataFrame, raw_host: str) -> DataFrame:
    """Hits of code search with an address and another stem than their pattern: folder, raw address, target name, file
    of the pattern and status."""
    own = hits.filter((F.lower("source") == "github") & (F.coalesce("url", F.lit("")) != ""))
    own = own.withColumn("stem", stem(F.col("url"))).filter(F.lower("stem") != F.lower(sanitize(F.col("pattern_label"))))
    out = own.join(chosen.select("pattern_iri", F.col("file").alias("pattern_file")), "pattern_iri", "left")
    raw = raw_url(F.col("url"), raw_host)
    return out.select(
        "pattern_label", "pattern_iri", "url", F.concat("stem", F.lit("_"), sanitize(F.col("match_label"))).alias("folder"),
        raw.alias("raw_url"), F.concat("stem", extension(F.col("url"), F.col("details"))).alias("target"), "pattern_file",
        F.when(raw.isNull(), "no raw address").when(F.col("pattern_file").isNull(), "no pattern file").otherwise("planned").alias("status"),
    )


def capped(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group; a report's feature."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
