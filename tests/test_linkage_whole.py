"""The linkage queries with the whole score against brute force."""

import difflib
import pathlib
import re

import pytest

from reweave.plans import registry

DATA = "/root/testdata/sf0.001"


def brute(parts):
    """seed -> all works that share a word, best first: (-score, work, year difference, score parts)."""
    found = {}
    for k, name, size, _ in parts:
        for j, other, other_size, brand in parts:
            a, b = name.lower().strip(), other.lower().strip()
            x, y = set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))
            if k % 20 or not j % 20 or not x & y:
                continue
            sim = len(x & y) / len(x | y) * 0.6 + difflib.SequenceMatcher(None, a, b).ratio() * 0.4
            years = abs(size % 10 - other_size % 10)
            bonus = ({0: 0.15, 1: 0.10, 2: 0.05}.get(years, -0.10), 0.10 if "#1" in brand else 0.0, 0.05 if "#3" in brand else 0.0)
            found.setdefault(k, []).append((-(sim + bonus[0] + bonus[1] + bonus[2]), j, years, (sim, *bonus)))
    return {k: sorted(own) for k, own in found.items()}


def compare(spark, folder):
    parts = [(r.p_partkey, r.p_name, r.p_size, r.p_brand) for r in spark.read.parquet(f"{folder}/part.parquet").collect()]
    by_seed = brute(parts)
    best = {k: next(((j, -s) for s, j, years, _ in own if years <= 1 and -s >= 0.82), None) for k, own in by_seed.items()}
    got = registry.QUERIES["papers_linkage"](spark, folder).collect()
    assert sorted((r.seed_id, r.work_id, round(r.score, 5)) for r in got) == sorted((k, x[0], round(x[1], 5)) for k, x in best.items() if x)
    want = sorted((k, j, n, *(round(v, 5) for v in (*parts, -s))) for k, own in by_seed.items() for n, (s, j, _, parts) in enumerate(own[:3], 1))
    ranked = registry.QUERIES["papers_linkage_ranked"](spark, folder).collect()
    assert sorted((r.seed_id, r.work_id, r.rank, *(round(v, 5) for v in (r.sim, r.year_bonus, r.evidence_bonus, r.hint_bonus, r.score))) for r in ranked) == want
    return {r.seed_id: r.work_id for r in got}


@pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="needs the tables")
def test_linkage_of_the_whole_table(spark):
    assert compare(spark, DATA)


def test_ratio_finds_and_ranks_what_words_alone_do_not(spark, tmp_path):
    rows = [
        (20, "pattern reuse in ontologies", 1, "Brand#20"), (21, "patterns reuse in ontologies", 1, "Brand#20"), (22, "pattern in", 1, "Brand#20"),
        (40, "alpha beta gamma", 5, "Brand#20"), (41, "gamma beta alpha", 5, "Brand#20"), (42, "alphas beta gamma", 5, "Brand#11"),
        (60, "Reused Parts", 3, "Brand#33"), (61, "reused parts", 4, "Brand#33"), (62, "reused part", 3, "Brand#11"), (63, "nothing alike", 3, "Brand#11"),
    ]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert compare(spark, tmp_path)[20] == 21
    words = {r.seed_id for r in registry.QUERIES["papers_linkage_words"](spark, str(tmp_path)).collect()}
    assert 20 not in words
