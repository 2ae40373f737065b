"""Queries over whole inputs: what a prefix or a subset would leave out."""

import random

import duckdb
import pytest

from ocularis.operators import scanpaths
from ocularis.plans import catalogue


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y or x is None)))
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice(("a", "b", "c", "d", None)) for _ in range(r.randint(0, r.choice((4, 90))))] for _ in "ab")
        assert scanpaths.levenshtein_tokens(a, b) == edits(a, b)


def test_turns_are_compared_to_their_ends(spark, tmp_path):
    r = random.Random(2)
    start = " ".join("abcdefghijkl")
    rows = [(c, t, f"{start} " + " ".join(r.choice("mnopq") for _ in range(r.choice((0, 3, 70))))) for c in range(4) for t in range(5)] + [(9, 0, ""), (9, 1, "a"), (9, 2, "a b")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(duckdb.sql(catalogue.SQL["ngram_jaccard"]).fetchall())
    assert sorted(map(tuple, catalogue.ngram_jaccard(spark, str(tmp_path)).collect())) == want
    text = {(c, t): x.split(" ") for c, t, x in rows}
    for c, t, d in catalogue.levenshtein_turns(spark, str(tmp_path)).collect():
        a, b = text[c, t], text[c, t + 1]
        assert d == pytest.approx(edits(a, b) / max(len(a), len(b)), abs=1e-6)
