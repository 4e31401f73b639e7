"""Bibliographic records: clean-up, linkage of seeds to candidates, merging, rule-based classes and yearly tables."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from reweave.functions.labels import jaccard, word_tokens
from reweave.operators.order import quantiles

#: Phrases that are no part of a title (fixed values).
TITLE_NOISE = ["ceur-ws.org", "ceur workshop", "ceur workshop proceedings", "ontologydesignpatterns.org", "submission:", "submissions:"]
#: Words that speak of reuse (fixed values).
REUSE_TERMS = [
    "reuse", "re-used", "reused", "reusing", "use", "utilize", "rework", "rewrite", "reimplement", "recycle", "harness", "modularize",
    "reapply", "employ", "instantiate", "instantiated", "instantiation", "adopt", "adopted", "adapting", "adapted", "apply", "applied",
    "applying", "extend", "extended", "extending", "based on", "build on", "built on", "leverage", "leveraged",
]
#: Key phrases, and phrases of another field (fixed values).
KEY_PHRASES = [
    r"ontology design pattern(s)?", r"\bodp(s)?\b", r"content ontology design pattern(s)?", r"pattern-based ontolog(y|ies)",
    r"ontology pattern(s)?", r"design pattern(s)? for ontolog(y|ies)", r"\bopla\b",
]
OTHER_FIELD = [r"software design pattern(s)?", r"programming (design )?pattern(s)?", r"goF pattern(s)?"]


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_doi(doi: Column) -> Column:
    d = F.lower(F.trim(F.replace(F.replace(F.trim(doi), F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit(""))))
    return F.when(doi != "", d)


def clean_title(title: Column) -> Column:
    t = F.regexp_replace(squeeze(F.coalesce(title, F.lit(""))), r"(?iU)https?://\S+", "")
    for phrase in TITLE_NOISE:
        t = F.regexp_replace(t, "(?i)" + phrase.replace(".", r"\."), "")
    return F.btrim(F.regexp_replace(t, r"(?U)\s+", " "), F.lit(" :;-"))


def file_name(text: Column, most: int = 120) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)[^\w\s\-]+", "")), r"(?U)\s+", " ")
    return F.coalesce(F.nullif(F.replace(F.trim(F.left(t, F.lit(most))), F.lit(" "), F.lit("_")), F.lit("")), F.lit("paper"))


def download_name(text: Column, most: int = 140) -> Column:
    """`text` as the name of a downloaded file: ASCII letters, digits, dots and dashes, else underscores."""
    t = F.left(F.regexp_replace(text, r"[^a-zA-Z0-9._\-]+", "_"), F.lit(most))
    return F.coalesce(F.nullif(F.btrim(t, F.lit("_")), F.lit("")), F.lit("file"))


def has_evidence(addresses: Column, venue: Column, address_pattern: str, venue_pattern: str) -> Column:
    """Whether any of the addresses (an array) fits one pattern, or the venue's name the other, in any case."""
    at = F.array_join(F.transform(addresses, lambda a: F.coalesce(a, F.lit(""))), " ")
    return F.coalesce(at, F.lit("")).rlike("(?iU)" + address_pattern) | F.coalesce(venue, F.lit("")).rlike("(?iU)" + venue_pattern)


def year_bonus(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d == 0, 0.15).when(d == 1, 0.10).when(d == 2, 0.05).when(d.isNotNull(), -0.10).otherwise(0.0)


#: What year, evidence and hint can add to a score.
MOST_BONUS = 0.30


@F.pandas_udf(DoubleType())
def _needed_ratio(a: pd.Series, b: pd.Series, need: pd.Series) -> pd.Series:
    """The sequence matcher's ratio; null where the letters in common can't give the ratio that is needed."""
    letters = {x: Counter(x) for x in {*a, *b}}

    def of(x: str, y: str, least: float) -> float | None:
        if 2 * (letters[x] & letters[y]).total() < least * (len(x) + len(y)) - 1e-9:
            return None
        return SequenceMatcher(a=x, b=y).ratio() if x and y else 0.0

    return pd.Series([of(x, y, n) for x, y, n in zip(a, b, need)], dtype=float)


def distinct_seeds(seeds: DataFrame) -> DataFrame:
    """One seed, that with the smallest seed_id, of those equal in title, year and hint: all of them score alike."""
    return seeds.groupBy("title", "year", "hint").agg(F.min("seed_id").alias("seed_id")).select("seed_id", "title", "year", "hint")


def first_works(works: DataFrame, most: int = 1) -> DataFrame:
    """The works with the `most` smallest work_ids of those equal in title, year and venue.

    Such works have equal scores with any seed, and ties go to the smaller work_id; so the `most` best works of a seed are
    all among them, and copies make no pairs."""
    if most == 1:
        return works.groupBy("title", "year", "venue").agg(F.min("work_id").alias("work_id")).select("work_id", "title", "year", "venue")
    rank = F.row_number().over(Window.partitionBy("title", "year", "venue").orderBy("work_id"))
    return works.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def for_every_seed(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """What was found for `distinct_seeds`, for each of `seeds`."""
    same = [F.col(f"seed_{c}").eqNullSafe(F.col(f"own_{c}")) for c in ("title", "year")] + [F.col("hint").eqNullSafe(F.col("own_hint"))]
    own = seeds.select(F.col("seed_id").alias("own_id"), *[F.col(c).alias(f"own_{c}") for c in ("title", "year", "hint")])
    rows = own.join(found, same).withColumn("seed_id", F.col("own_id"))
    return rows.select(*found.columns)


def linkage_candidates(seeds: DataFrame, works: DataFrame, venue_pattern: str, ratio: bool = True, threshold: float | None = None, list_size: int = 10_000) -> DataFrame:
    """Every (seed, work) that shares a title word, with score parts and score; with `threshold`, those that reach it.

    seeds: seed_id, title, year, hint; works: work_id, title, year, venue. Without a shared word no pair can reach a
    threshold above 0.7. With `ratio=False` the similarity is the word Jaccard alone.

    A threshold says how much of the words two titles must share, whatever else they have in common; so titles meet on the
    rarest of their words only. Years, evidence and hints are added next, then the most that the letters allow the ratio,
    and only pairs of titles that can still reach the threshold are matched. The works of a word are dealt into lists of about
    `list_size` titles.
    """
    plain = F.lower(squeeze(F.col("title")))
    s = seeds.select("seed_id", F.col("title").alias("seed_title"), plain.alias("seed_plain"), F.col("year").alias("seed_year"), "hint")
    w = works.select("work_id", "title", plain.alias("plain"), "year", "venue", F.when(F.col("venue").rlike("(?i)" + venue_pattern), 0.10).otherwise(0.0).alias("evidence_bonus"))
    whole, word_part = (0.4, 0.6) if ratio else (0.0, 1.0)
    least = 0.0 if threshold is None else max(0.0, (threshold - MOST_BONUS - whole) / word_part)

    # distinct titles meet and are scored once, however many rows have them
    words = lambda df, t: df.select(F.col(t).alias("t")).distinct().select("t", F.explode(F.array_distinct(word_tokens(F.col("t")))).alias("word"))
    mine, theirs = words(s, "seed_plain"), words(w, "plain")
    often = mine.select("word", F.lit(0).alias("of_works")).unionByName(theirs.select("word", F.lit(1).alias("of_works")))
    often = often.groupBy("word").agg(F.count(F.lit(1)).alias("df"), (F.floor(F.sum("of_works") / list_size) + 1).alias("lists"))

    def rare(df: DataFrame, name: str) -> DataFrame:
        own = Window.partitionBy("t")
        rows = df.join(often, "word").withColumns({"at": F.row_number().over(own.orderBy("df", "word")), "size": F.count(F.lit(1)).over(own)})
        return rows.filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("word", "lists", F.col("t").alias(name))

    left = rare(mine, "seed_plain").withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists") - 1))).drop("lists")
    right = rare(theirs, "plain").withColumn("list", F.pmod(F.xxhash64("plain"), F.col("lists"))).drop("lists")
    met = left.join(right, ["word", "list"]).select("seed_plain", "plain").distinct()
    shared = jaccard(F.array_distinct(word_tokens(F.col("seed_plain"))), F.array_distinct(word_tokens(F.col("plain"))))
    met = met.withColumn("shared", shared).filter(F.col("shared") >= least - 1e-9)
    rows = s.join(met, "seed_plain").join(w, "plain")
    hinted = (F.coalesce("hint", F.lit("")) != "") & F.contains(F.lower("venue"), F.lower("hint"))
    rows = rows.withColumns(
        {
            "year_bonus": year_bonus(F.col("seed_year"), F.col("year")),
            "hint_bonus": F.when(hinted, 0.05).otherwise(0.0),
        }
    )
    bonus = F.col("year_bonus") + F.col("evidence_bonus") + F.col("hint_bonus")
    if not ratio:
        rows = rows.withColumn("sim", F.col("shared"))
    else:
        if threshold is None:
            pairs = met.withColumn("need", F.lit(0.0))
        else:
            need = (threshold - F.col("bonus") - F.col("shared") * word_part) / whole
            pairs = rows.groupBy("seed_plain", "plain", "shared").agg(F.max(bonus).alias("bonus")).withColumn("need", need)
        pairs = pairs.filter("need <= 1 + 1e-9").select("seed_plain", "plain", _needed_ratio("seed_plain", "plain", "need").alias("ratio")).filter("ratio IS NOT NULL")
        rows = rows.join(pairs, ["seed_plain", "plain"]).withColumn("sim", F.col("shared") * word_part + F.col("ratio") * whole).drop("ratio")
    rows = rows.withColumn("score", F.col("sim") + F.col("year_bonus") + F.col("evidence_bonus") + F.col("hint_bonus")).drop("plain", "seed_plain", "shared")
    columns = ["seed_id", "seed_title", "seed_year", "hint", "work_id", "title", "year", "venue", "sim", "year_bonus", "evidence_bonus", "hint_bonus", "score"]
    return rows.select(*columns) if threshold is None else rows.select(*columns).filter(F.col("score") >= threshold)


def best_matches(scored: DataFrame, threshold: float, year_tolerance: int, need_evidence: bool = False) -> DataFrame:
    """The best acceptable work of each seed: within the years, with evidence if asked for, and by total score.

    The threshold must be above 0.7: below it works that share no title word, which are no candidates, could do."""
    if threshold <= 0.7:
        raise ValueError("candidates are complete for thresholds above 0.7 only")
    ok = F.coalesce(F.abs(F.col("year") - F.col("seed_year")) <= year_tolerance, F.lit(True)) & (F.col("score") >= threshold)
    ok = ok & (F.col("evidence_bonus") > 0) if need_evidence else ok
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("score"), "work_id"))
    return scored.filter(ok).withColumn("rank", rank).filter("rank = 1").drop("rank")


def ranked(scored: DataFrame, most: int = 10) -> DataFrame:
    """The `most` best candidates of each seed with their score parts, whether acceptable or not."""
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("score"), "work_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


def phrase_candidates(scored: DataFrame) -> DataFrame:
    """The candidates whose title holds the seed's whole title: the strict round."""
    return scored.filter(F.contains(F.lower(squeeze(F.col("title"))), F.lower(squeeze(F.col("seed_title")))))


def matched_in_rounds(first: DataFrame, second: DataFrame, threshold: float, year_tolerance: int, need_evidence: bool = False) -> DataFrame:
    """The best match of each seed, with its round: the second round counts only for seeds that the first one leaves."""
    best = lambda scored, n: best_matches(scored, threshold, year_tolerance, need_evidence).withColumn("round", F.lit(n))
    one = best(first, 1)
    return one.unionByName(best(second, 2).join(one.select("seed_id"), "seed_id", "left_anti"))


def ranked_in_rounds(first: DataFrame, second: DataFrame, most: int = 10) -> DataFrame:
    """The `most` best candidates of each seed and round."""
    return ranked(first, most).withColumn("round", F.lit(1)).unionByName(ranked(second, most).withColumn("round", F.lit(2)))


def audited(seeds: DataFrame, matches: DataFrame, cited: DataFrame) -> DataFrame:
    """Every seed with its match (id, title, year, score to three places, evidence flag) and citation counts.

    cited: work_id, citation_count, total. Seeds without a match have empty texts and no citations."""
    own = matches.select("seed_id", "work_id", F.col("title").alias("matched_title"), F.col("year").alias("matched_year"),
                         F.format_string("%.3f", "score").alias("match_score"), (F.col("evidence_bonus") > 0).cast("int").alias("evidence"))
    rows = seeds.join(own, "seed_id", "left").join(cited, "work_id", "left")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(
        *[c for c in seeds.columns], F.coalesce("citation_count", F.lit(0)).alias("citation_count"), said("work_id").alias("matched_id"),
        said("matched_title").alias("matched_title"), said("matched_year").alias("matched_year"), said("match_score").alias("match_score"), said("total").alias("total"),
        F.coalesce("evidence", F.lit(0)).alias("evidence"),
    )


def citing_rows(works: DataFrame) -> DataFrame:
    """Citing works for export: empty titles dropped, titles squeezed, DOIs as addresses. works: seed_id, seed_year, title,
    url, year, doi, id, venue, is_oa, oa_status. Write it partitioned by seed_year."""
    doi = F.when(F.lower("doi").startswith("http") | (F.coalesce("doi", F.lit("")) == ""), F.coalesce("doi", F.lit(""))).otherwise(F.concat(F.lit("https://doi.org/"), F.col("doi")))
    rows = works.withColumn("title", squeeze(F.coalesce("title", F.lit("")))).filter("title <> ''")
    return rows.select(
        "seed_id", "seed_year", F.col("title").alias("citing_title"), F.col("url").alias("citing_url"), F.col("year").alias("citing_year"),
        doi.alias("citing_doi"), F.col("id").alias("citing_id"), F.col("venue").alias("venue_name"), "is_oa", "oa_status",
    )


def merged_works(works: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """One row for each work, keyed by DOI, else id, else lower-cased title; each field is the first, by `order`, that
    is not null (empty lists and false count as null)."""
    key = F.coalesce(F.nullif("doi", F.lit("")), F.nullif("id", F.lit("")), F.lower(F.coalesce("title", F.lit(""))))
    kinds = dict(works.dtypes)

    def filled(c: str) -> Column:
        test = F.size(c) > 0 if kinds[c].startswith("array") else F.col(c) if kinds[c] == "boolean" else F.col(c).isNotNull()
        return F.min_by(F.when(test, F.col(c)), F.when(test, F.col(order))).alias(c)

    return works.groupBy(key.alias("key")).agg(F.min(order).alias(order), *[filled(c) for c in fields])


def has_any(text: Column, patterns: list[str]) -> Column:
    return reduce(or_, (text.rlike("(?iU)" + p) for p in patterns))


def reuse_gate(text: Column, terms: list[str] = REUSE_TERMS, topic: str = r"\bontology\b", object_: str = r"\bpatterns?\b") -> Column:
    """Whether a text has a reuse term, the topic's word and the object's word."""
    return has_any(text, [rf"\b{t}\b" for t in terms]) & text.rlike("(?iU)" + topic) & text.rlike("(?iU)" + object_)


def named(texts: DataFrame, names: DataFrame, id_col: str, *, max_letters: int = 2_000_000) -> DataFrame:
    """id and name for names that occur in the text, their words joined by any of space, `-`, `_` or nothing.

    Words are met by an equi-join: the name without separators must start at some word of the text; the pattern decides.
    Texts and their words are never broadcast: their files may be small where they are not. Names are, as long as their
    patterns have no more than `max_letters` characters; more names meet the words by a sorted join. Names without words
    occur nowhere.
    """
    tokens = F.filter(F.split("name", r"[\s\-_/]+"), lambda t: t != "")
    quoted = F.transform(tokens, lambda t: F.regexp_replace(t, r"([\\\^\$\.\|\?\*\+\(\)\[\]\{\}])", r"\\$1"))
    rows = names.select("name", F.concat(F.lit(r"(?iU)(?<!\w)"), F.array_join(quoted, r"[\s\-_]*"), F.lit(r"(?!\w)")).alias("pattern"), F.lower(F.get(tokens, F.lit(0))).alias("first"))
    rows = rows.filter("first IS NOT NULL")
    letters, sizes = rows.agg(F.sum(F.char_length("pattern")), F.collect_set(F.char_length("first"))).first()
    lengths = F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>")  # no more than the longest first word has characters
    starts = texts.select(id_col, F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("word"))
    heads = starts.select(id_col, "word", F.explode(F.filter(lengths, lambda n: n <= F.char_length("word"))).alias("n"))
    heads = heads.select(id_col, F.expr("left(word, n)").alias("first"))
    met = heads.join(rows.hint("broadcast" if (letters or 0) <= max_letters else "merge"), "first").select(id_col, "name", "pattern").distinct()
    met = met.join(texts.select(id_col, "text").hint("merge"), id_col)
    return met.filter(F.expr("rlike(text, pattern)")).select(id_col, "name").distinct()


def classified(texts: DataFrame, found: DataFrame, id_col: str, site: str) -> DataFrame:
    """label, four 0/1 flags and the matched names of each text. texts: id, title, abstract, url."""
    gate = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    text = F.concat_ws("\n", gate, F.coalesce("url", F.lit("")))
    names = found.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("matched_names"))
    rows = texts.join(names, id_col, "left").withColumn("matched_names", F.coalesce("matched_names", F.lit("")))
    flags = {
        "hit_keyphrase": has_any(text, KEY_PHRASES),
        "hit_url": F.contains(F.lower(text), F.lit(site)),
        "hit_named": F.col("matched_names") != "",
        "hit_other_field": has_any(text, OTHER_FIELD) & ~F.contains(F.lower(text), F.lit("ontology")),
    }
    likely = reuse_gate(gate) & (flags["hit_keyphrase"] | flags["hit_url"] | flags["hit_named"]) & ~flags["hit_other_field"]
    return rows.select(id_col, F.when(likely, "Possibly").otherwise("Unlikely").alias("label"), *[f.cast("int").alias(n) for n, f in flags.items()], "matched_names")


def abstract_text(index: Column) -> Column:
    """The text of an inverted index (word -> places); places without a word are empty words."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.cast("int").alias("key"), e["key"].alias("value")))))
    by_place = F.map_from_entries(places)
    last = F.array_max(F.map_keys(by_place))
    words = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(by_place, i), F.lit("")))
    return F.coalesce(F.when(F.size(index) > 0, F.array_join(words, " ")), F.lit(""))


def per_year(papers: DataFrame, first: int, last: int, kind: str) -> DataFrame:
    """year, total, of_kind and reused_of_kind for every year of the range, 0 where there is none.
    papers: year, type, reused."""
    years = papers.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    of = F.contains(F.lower("type"), F.lit(kind.lower()))
    counts = papers.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count_if(of).alias("of_kind"), F.count_if(of & F.col("reused")).alias("reused_of_kind"))
    return years.join(counts, "year", "left").na.fill(0)


def author_counts(papers: DataFrame, column: str, most: int) -> DataFrame:
    """The `most` names that occur most often, split at commas and `and`; ties go to the smaller name."""
    names = papers.select(F.explode(F.split(column, r",| and ")).alias("author")).withColumn("author", F.trim("author")).filter("author <> ''")
    return names.groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(most)


def in_years(papers: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Papers whose year, read as a number, lies in the window; unreadable years are dropped."""
    y = F.col("year").try_cast("int")
    return papers.filter(y.isNotNull() & (F.lit(True) if first is None else y >= first) & (F.lit(True) if last is None else y <= last))


def availability(papers: DataFrame, flag_: str) -> DataFrame:
    """year and the number of papers with the flag; years without any are left out."""
    return papers.filter(F.col(flag_)).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def value_counts(rows: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """value and n, most frequent first; ties by the first seen if `order` tells rows apart, else by value. Null is empty."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    tie = F.min(order) if order else F.min(value)
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), tie.alias("tie")).orderBy(F.desc("n"), "tie").drop("tie")


def citation_stats(papers: DataFrame, key: str) -> DataFrame:
    """total, mean, median, least and most citations for each key."""
    c = F.col("citations")
    sums = papers.groupBy(key).agg(F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))
    middle = quantiles(papers, "citations", {"median": 0.5}, (key,)).select(F.col(key).alias("of"), "median")
    return sums.join(middle, F.col(key).eqNullSafe(F.col("of")), "left").select(key, "total", "mean", "median", "least", "most")


def classification_summary(rows: DataFrame, key: str) -> DataFrame:
    """num_citing, num_possibly and num_unlikely of each seed's file."""
    of = lambda label: F.count_if(F.col("label") == label)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("num_citing"), of("Possibly").alias("num_possibly"), of("Unlikely").alias("num_unlikely"))


def matched_name_counts(rows: DataFrame, most: int, column: str = "matched_names") -> DataFrame:
    """The `most` names that occur most often among lists joined by `;`."""
    names = rows.select(F.explode(F.split(column, ";")).alias("name")).withColumn("name", F.trim("name")).filter("name <> ''")
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)


def overview(rows: DataFrame, file: str, label: str, labels: list[str]) -> DataFrame:
    """metric, value: files, rows, and rows with each label."""
    out = rows.agg(
        F.count_distinct(file).alias("n_classified_files"), F.count(F.lit(1)).alias("n_total_citing_rows"),
        *[F.count_if(F.col(label) == name).alias(f"count_{name.lower()}") for name in labels],
    )
    return out.unpivot([], out.columns, "metric", "value")


def statistics(named_tables: dict[str, DataFrame]) -> DataFrame:
    """One table of metric, key and value from tables of (key, value): what a statistics object holds."""
    parts = [df.toDF("key", "value").select(F.lit(n).alias("metric"), F.col("key").cast("string"), F.col("value").cast("double")) for n, df in named_tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())


def folded(text: Column) -> Column:
    """`text` decomposed for compatibility, without combining marks, in lower case; null is empty.

    No built-in function decomposes; texts of ASCII only, which stay as they are but for their case, don't go to Python."""
    beyond = F.octet_length(text) != F.char_length(text)
    return F.coalesce(F.when(beyond, _decomposed(F.when(beyond, text))).otherwise(F.lower(text)), F.lit(""))


def contains_folded(text: Column, part: Column) -> Column:
    """Whether `text` holds `part`, both folded."""
    return F.contains(folded(text), folded(part))


def citations(pages: DataFrame, cap: int) -> DataFrame:
    """seed and the number of distinct works that cite it, at most `cap`."""
    return pages.dropDuplicates(["seed", "id"]).groupBy("seed").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("citation_count"))


def of_interest(works: DataFrame, tokens: list[str], sites: list[str]) -> DataFrame:
    """Works whose publisher or venue has one of `tokens`, or whose address has one of `sites`, in any case."""
    has = lambda c, parts: F.exists(F.array(*[F.lit(t.lower()) for t in parts]), lambda t: F.contains(F.lower(F.coalesce(c, F.lit(""))), t))
    return works.filter(has("publisher", tokens) | has("venue", tokens) | has("url", sites))


def signal_rates(rows: DataFrame, flags: list[str]) -> DataFrame:
    """signal, hits and rate of each 0/1 flag."""
    long = rows.select(*[F.col(f).cast("long").alias(f) for f in flags]).unpivot([], flags, "signal", "hit")
    return long.groupBy("signal").agg(F.sum("hit").alias("hits"), F.avg("hit").alias("rate"))


def labels_by(rows: DataFrame, key: str, label: str, labels: list[str]) -> DataFrame:
    """Counts of each label for each key, 0 where there is none; the labels are given, so columns don't depend on data."""
    return rows.groupBy(key).pivot(label, labels).agg(F.count(F.lit(1))).na.fill(0, labels)
