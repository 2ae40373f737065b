"""Conversation repair, exact deduplication and hard negatives against plain versions, on rows with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random

import duckdb
import pytest

from ocularis.llm import exactdedup, negatives, repair, sstable
from ocularis.llm.queries import SQL

from . import brute

FAULTS = ["blank", "duplicate", "truncated", ""]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


# --- 11


def test_every_sequence_of_edits():
    r = random.Random(3)
    for _ in range(80):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), str(k), r.choice([0, 1, 2, 3, 3])) for k in range(r.randint(0, 3))]
        plain = [(a, t, FAULTS[f]) for a, t, f in rows]
        want = brute.op11_edits(plain)
        cost, letters = repair.solved([(a[:1], f) for a, _, f in rows])
        assert (cost, letters) == want[:2] == brute.op11_search(plain)[:2]
        turns, _ = repair.applied([(a, t) for a, t, _ in rows], letters)
        assert [x[:2] for x in turns] == want[2]


def test_pieces_of_a_conversation_join():
    r = random.Random(5)
    rows = [(r.choice("suat"), r.choice([0, 1, 2, 3, 3, 3])) for _ in range(200)]
    for n in (0, 1, 6, 7, 8, 50, 200):
        whole = repair.solved(rows[:n])
        assert repair.solved(rows[:n], piece=7) == whole
        assert repair.solved(rows[:n], piece=1) == whole


def conversations():
    r = random.Random(8)
    rows = [(k // 5, k % 5, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", "", " \n", "What?", f"text {k}."])) for k in range(150)]
    # one conversation, and that without an id, hold most rows; turns with gaps, one without a number
    rows += [(r.choice([None, 77]), None if k == 9 else 3 * k, r.choice(["user", "assistant", "system", None, "", "tool"]), r.choice([None, "", "a.", "b!", "c", f"d {k}"])) for k in range(900)]
    rows += [(200, 1, "user", "A very long text. " * 20_000), (200, 2, "assistant", "x" * 100_000)]
    return [(*x, "part", 1, "edit") for x in rows]


TALK = "conv_id long, turn long, role string, text string, part string, kind int, edit string"


def test_conversations_over_many_ranges(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TALK).repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (1, 9):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = repair.report(df).collect()
            assert ordered(got) == ordered(brute.op11([r[:4] for r in rows]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    turns = {}
    for x in repair.repaired(repair.damaged(df)).orderBy("conv_id", "part", "at").collect():
        turns.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    sha = {r["conv_id"]: r["repaired_sha256"] for r in got if r["audit"].strip("D")}
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in turns.items()} == sha


def test_repeated_rows_and_conversations_that_vanish(spark):
    dropped = next(k for k in range(1000) if brute.op11([(k, 0, "user", "a.")])[0][7] == "" and brute.op11([(k, 0, "user", "a.")])[0][6] == 0)
    fine = next(k for k in range(1000) if brute.op11([(k, 0, "user", "a."), (k, 1, "assistant", "b.")])[0][7] == "KK")
    rows = [(dropped, 0, "user", "a."), *[(fine, 0, "user", "a.")] * 3, (fine, 1, "assistant", "b.")]
    got = {r["conv_id"]: r for r in repair.report(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[fine]["audit"] == "KDDK" and got[fine]["duplicate"] == 2 and got[fine]["gaps"] == 0 and got[fine]["illegal"] == 2
    assert repair.report(spark.createDataFrame([], TALK)).count() == 0
    assert repair.repaired(repair.damaged(spark.createDataFrame([], TALK))).count() == 0


# --- 12


def test_fingerprints_compose():
    r = random.Random(1)
    h = exactdedup.Hasher()
    for n in (0, 1, 5, 4095, 4096, 4097, 9000):
        data = bytes(r.randrange(256) for _ in range(n))
        assert list(h.hash(data)) == [sum(b * pow(base, n - 1 - i, exactdedup.PRIME) for i, b in enumerate(data)) % exactdedup.PRIME for base in exactdedup.BASES]
        for k in (0, n // 3, n):
            assert h.combined(h.hash(data[:k]), h.hash(data[k:]), n - k) == h.hash(data)


def texts():
    r = random.Random(1)
    words = ["Aé", "b", "ab c", "", "x" * 30, "X" * 30, "Y" * 29 + "z", "Ä", "ä"]
    rows = [(r.choice([None, *range(40)]), r.choice([None, *words, r.choice(words) + r.choice(words), "q" * r.randint(1, 60)])) for _ in range(300)]
    rows += [(k, "one large group") for k in range(500, 900)] + [(7, "same row")] * 3 + [(None, "no id")] * 2 + [(1000, "w " * 60_000), (1001, "W " * 60_000), (1002, "w " * 59_999 + "v ")]
    return [(*x, "f1", 1, b"c") for x in rows]


@pytest.mark.parametrize("how", [{}, {"prime": 3}, {"chunk": 5000, "huge": 10}, {"prime": 3, "chunk": 7_000, "huge": 10_000}])
def test_exact_groups_whatever_the_fingerprints(spark, how):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, f1 string, size int, content binary").repartition(3)
    got = exactdedup.report(df, **how).collect()
    assert ordered((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == ordered(brute.op12([x[:2] for x in rows]))
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_unique_rows_and_empty_tables(spark):
    rows = texts()
    schema = "doc_id long, text string, f1 string, size int, content binary"
    df = spark.createDataFrame(rows, schema).repartition(3)
    left = exactdedup.unique(df)
    assert left.columns == df.columns
    assert ordered((r["doc_id"], brute.sha((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))) for r in left.collect()) == ordered((r["doc_id"], r["text_sha256"]) for r in exactdedup.report(df).collect() if r["kept"])
    assert exactdedup.report(spark.createDataFrame([], schema)).count() == 0
    assert exactdedup.unique(spark.createDataFrame([], schema)).count() == 0


# --- 13


def vectors():
    r = random.Random(4)
    made = [(k, [r.choice((-0.5, -0.25, 0.0, 0.125, 0.5, 0.9)) for _ in range(11)], r.randrange(3), "parts", 2) for k in range(330)]
    made += [(made[100][0], made[100][1], made[100][2], "x", 1), (made[5][0], made[5][1], made[5][2], "x", 1), (None, made[6][1], 1, None, None), (None, made[6][1], 2, None, None)]
    made += [(600, None, 1, None, None), (700, [0.5, None], 1, None, None), (800, [float("nan")], 1, None, None), (900, [float("inf")] * 11, 1, None, None), (1000, [0.1] * 11, None, None, None), (1100, [], 1, None, None), (1200, [0.75, 100.5], 2, None, None)]
    return made


VECTORS = "vec_id long, embedding array<double>, label int, parts string, block int"


def test_scores_are_inner_products():
    import numpy as np

    r = np.random.default_rng(2)
    for size, low, high in ((1, 0, 0), (3, -1, 0), (64, -256, 256), (17, -70_000, 3), (8, 0, 90_000)):
        shape = negatives.Shape(size, low, high)
        a, c = (shape.array(r.integers(low, high + 1, (n, size)).tolist()) for n in (5, 40))
        assert (shape.scores(shape.tables(a), shape.packed(c)) == c @ a.T).all()
    with pytest.raises(ValueError, match="too large"):
        negatives.Shape(64, -(2**30), 0)


def test_negatives_by_plain_search_and_sql(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = brute.op13([x[:3] for x in rows])
    assert len(want) > 40
    assert ordered(negatives.mined(df).collect()) == ordered(want)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "SLAB", 2)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    assert ordered(negatives.mined(df).collect()) == ordered(want)
    even = [x for x in rows if x[1] is None or len(x[1]) == 11]  # DuckDB's product wants equal lengths
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(x[:3]) for x in even])
    assert ordered(con.sql(SQL["op13_hard_negatives"]).fetchall()) == ordered(brute.op13([x[:3] for x in even]))


def test_tables_without_anchors(spark):
    for rows in ([], [(1, [0.5], 1, "x", 1)], [(100, [0.5], 1, "x", 1)], [(100, None, 1, "x", 1)]):
        assert negatives.mined(spark.createDataFrame(rows, VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        negatives.mined(spark.createDataFrame([(1, [1e300], 1, "x", 1)], VECTORS)).count()


# --- lookups over shards


def test_lookups_over_shards(tmp_path):
    groups = [[None, None, 1, 2, 2], [2, 2], [2, 5], [9, 12, 40]]
    paths, want = [], {}
    for n, ids in enumerate(groups):
        paths.append(f"{tmp_path}/shard-{n}.sst")
        out = sstable.ShardWriter(paths[-1], 4)
        for k, d in enumerate(ids):
            value = (100 * n + k).to_bytes(4, "little")
            out.add(sstable.key_of(d), value, 1)
            want.setdefault(d, []).append(value)
        out.close()
    table = sstable.ShardSet(paths)
    for d in (None, 1, 2, 5, 9, 12, 40):
        assert table.lookup(d) == want[d]
    assert all(table.lookup(d) == [] for d in (-3, 0, 3, 8, 10, 41, 2**62))
    wide = sstable.ShardSet([paths[0], *paths[3:]])
    assert wide.lookup(1) == want[1] and wide.lookup(40) == want[40]
    assert sstable.ShardSet([]).lookup(1) == []
