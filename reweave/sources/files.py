"""Graph files, inventories and tables of papers."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERM = r"(<[^>]*>|_:\S+)"
OBJECT = r"(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?)"
LINE = rf"^\s*{TERM}\s+(<[^>]*>)\s+{OBJECT}\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$"


def unescaped(text: Column) -> Column:
    """`text` with N-Triples escapes decoded, each once and from left to right."""
    parts = F.regexp_extract_all(text, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)

    def plain(part: Column) -> Column:
        mark = F.substring(part, 2, 1)
        code = F.decode(F.unhex(F.lpad(F.substring(part, 3, 8), 8, "0")), "UTF-32")
        named = F.element_at(F.create_map(*[F.lit(x) for pair in (("n", "\n"), ("t", "\t"), ("r", "\r"), ("b", "\b"), ("f", "\f")) for x in pair]), mark)
        coded = (mark.isin("u", "U")) & (F.char_length(part) > 2)
        return F.when(~part.startswith("\\"), part).when(coded, code).otherwise(F.coalesce(named, mark))

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, plain), "")).otherwise(text)


def read_triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(triples, corrupt lines) of N-Triples or N-Quads files; the file is the graph. Blank nodes are local to a graph."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("graph_id"), F.trim("value").alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    ok = F.col("line").rlike(LINE)
    s, p, o = (F.regexp_extract("line", LINE, i) for i in (1, 2, 3))

    def kind(term: Column) -> Column:
        return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").otherwise("literal")

    def value(term: Column) -> Column:
        quoted = F.regexp_extract(term, r'^"((?:[^"\\]|\\.)*)"', 1)
        return F.when(term.startswith("<"), unescaped(F.btrim(term, F.lit("<>")))).when(term.startswith("_:"), term).otherwise(unescaped(quoted))

    good = lines.filter(ok).select("graph_id", s.alias("st"), p.alias("pt"), o.alias("ot"))
    triples = good.select(
        "graph_id", value(F.col("st")).alias("s"), kind(F.col("st")).alias("s_kind"), value(F.col("pt")).alias("p"),
        value(F.col("ot")).alias("o"), kind(F.col("ot")).alias("o_kind"),
        F.nullif(F.regexp_extract("ot", r'"@([A-Za-z0-9\-]+)$', 1), F.lit("")).alias("o_lang"),
        F.nullif(F.regexp_extract("ot", r'"\^\^<([^>]*)>$', 1), F.lit("")).alias("o_dt"),
    )
    return triples.dropDuplicates(), lines.filter(~ok)


def list_files(spark: SparkSession, base: str, extensions: list[str], max_bytes: int = 1_000_000_000, skip: tuple[str, ...] = (), pattern_extensions: tuple[str, ...] = ("owl", "ttl")) -> DataFrame:
    """path, name, ext, repo (the folder below `base`) and size of files; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", F.col("length").alias("size"))
    name = F.substring_index("path", "/", -1)
    rows = found.withColumns({"name": name, "ext": F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))})
    rows = rows.filter(F.col("ext").isin(extensions) & (F.col("size") <= max_bytes))
    for part in skip:
        rows = rows.filter(~F.contains(F.lower("name"), F.lit(part.lower())))
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
    root = re.sub(scheme, "", base).rstrip("/")
    root = root if root.startswith("/") else os.path.abspath(root)
    below = F.split(F.substring(F.regexp_replace("path", scheme, ""), F.lit(len(root) + 2), F.char_length("path")), "/")
    inside = F.when(F.size(below) > 1, below[0]).otherwise("")
    return rows.withColumn("repo", inside).withColumn("role", F.when(F.col("path").rlike(rf"(?i)/patterns/[^/]+\.({'|'.join(pattern_extensions)})$"), "pattern").otherwise("ontology"))


def looks_like_rdf(content: Column, ext: Column) -> Column:
    """Whether the first 120,000 bytes hold what such a file must."""
    head = F.lower(F.decode(F.substring(content, 1, 120_000), "UTF-8"))
    any_of = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(head, w))
    return F.when(ext == ".ttl", any_of("@prefix", "@base", "prefix ", " a ")).when(
        ext.isin(".owl", ".rdf", ".xml"), any_of("<rdf:rdf", "<owl:", "<ontology", "@prefix")
    ).otherwise(any_of("<http", "_:"))


def main_file(files: DataFrame, prefer_owl: bool = False) -> DataFrame:
    """One ontology file for each repo: by default the rank of the ending counts up from .owl, and the largest rank, then
    the largest file, wins; `prefer_owl` turns the rank around. Ties go to the smaller path."""
    rank = F.when(F.col("ext") == ".owl", 0).when(F.col("ext") == ".ttl", 1).when(F.col("ext").isin(".rdf", ".xml"), 2).otherwise(3)
    order = [rank.asc() if prefer_owl else rank.desc(), F.desc("size"), F.asc("path")]
    own = files.filter("role = 'ontology'").withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(*order)))
    return own.filter("n = 1").drop("n")


def folder_names(files: DataFrame) -> DataFrame:
    """The sorted names of the folders that hold files."""
    return files.select(F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("name")).distinct().orderBy("name")


def read_papers(spark: SparkSession, path: str, columns: dict[str, str], pattern: str | None = None) -> DataFrame:
    """CSV files with quoted line breaks, all strings. columns: our name -> header (any case); missing ones are null.
    The file and the year in its path come along."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(path)
    there = {c.strip().lower(): c for c in raw.columns}
    own = [F.col(f"`{there[h.lower()]}`").alias(n) if h.lower() in there else F.lit(None).cast("string").alias(n) for n, h in columns.items()]
    return raw.select(*own, F.col("_metadata.file_path").alias("file")).withColumn("seed_year", seed_year(F.col("file")))


def seed_year(path: Column) -> Column:
    return F.regexp_extract(path, r"(?:^|/)(\d{4})(?:/|$)", 1).try_cast("int")


def flag(value: Column) -> Column:
    """TRUE/FALSE, yes/no and 1/0 in any case; null otherwise."""
    v = F.upper(F.trim(value))
    return F.when(v.isin("TRUE", "YES", "1"), True).when(v.isin("FALSE", "NO", "0"), False)


def loose_flag(value: Column) -> Column:
    """Whether a flag column says 1, True or true."""
    return F.coalesce(F.trim(value).isin("1", "True", "true"), F.lit(False))


def number(value: Column) -> Column:
    """A number, or null for what is none."""
    return F.trim(value).try_cast("double")


#: Column names that are misspelt in tables of papers -> the right ones (fixed values).
MISSPELT = {"ontolgoy_available?": "ontology_available?", "odp_reused": "odp_reused?", "odp_reused_?": "odp_reused?"}


def normal_columns(df: DataFrame, renamed: dict[str, str] = MISSPELT) -> DataFrame:
    """`df` with trimmed lower-case column names, underscores for spaces, and known misspellings put right."""
    plain = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*[renamed.get(c, c) for c in plain])


def read_texts(spark: SparkSession, base: str, extensions: list[str]) -> DataFrame:
    """file and the whole text of each library file below `base` with one of the endings."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    rows = reader.text(base).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.filter(reduce(lambda a, b: a | b, (F.lower("file").endswith(e.lower()) for e in extensions)))


#: A line that names the ontology, what its IRI begins with, and the first URL or URN of a text (fixed values).
ONTOLOGY_LINE = r"(?im)^\s*Ontology:\s*<([^>\s]+)>"
IRI_START = r"^(https?://|urn:|ftp://)"
ANY_IRI = r"(?i)(\b(?:https?|ftp)://[^\s\"'<>]+|\burn:[^\s\"'<>]+)"


def fallback_iri(text: Column) -> Column:
    """The IRI of a text that no parser reads: that of an `Ontology:` line, else the first URL or URN; null without any."""
    head = F.trim(F.regexp_extract(text, ONTOLOGY_LINE, 1))
    return F.coalesce(F.when(head.rlike(IRI_START), head), F.nullif(F.regexp_extract(text, ANY_IRI, 1), F.lit("")))
