"""Every operator on null ids, repeated rows, one id with two texts, long texts and clashing names, and on an empty table; the pipeline too."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ocularis.llm import bpe, common, exactdedup, langid, linededup, negatives, pii, quality, repair, simhash, sstable, substring, warc, winnow
from ocularis.llm.queries import vocabulary

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, words int, base string, rank int, place long, run int, windows string"
LAST = 2**62


def made() -> list[tuple]:
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = prose(70)
    texts = [(k, prose(60) + ".\nThe same line on all the sites of this test.\n" + (shared if k % 3 == 0 else prose(20))) for k in range(24)]
    texts += [(5, texts[5][1]), (5, texts[5][1]), (6, prose(80)), (None, texts[7][1]), (None, prose(90)), (None, shared), (30, None), (31, None), (None, None), (32, ""), (33, " \n\t")]
    texts += [(40, prose(30_000) + ".\n" + shared), (41, "x" * 70_000 + " " + shared), (42, "12 " * 40_000), (43, "mail a@b.co " * 3_000)]
    return [(d, t, "en", f"s{k % 13}", len(t or ""), "th", 1, "b", 1, 1, 1, "w") for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    df.count()
    return df


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def plain(rows, *columns):
    return [tuple(LAST if c == 0 and r[0] is None else r[c] for c in columns) for r in rows]


def named(rows):
    return [(None if r[0] == LAST else r[0], *r[1:]) for r in rows]


def test_line_dedup(docs, rows):
    # rows with one id and two texts are two documents of the operator but one of the plain version: give them ids of their own
    some = [r for r in rows if r[0] not in (5, 6, None)] + [r for r in rows if r[0] == 5]
    df = docs.sparkSession.createDataFrame(some, SCHEMA)
    want = brute.op1(plain(some, 0, 1, 3))
    assert ordered(linededup.report(df).collect()) == ordered(want) and sum(x[2] for x in want) > 10
    assert linededup.report(docs).count() == len(rows)
    cleaned = linededup.cleaned(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert sum("same line on all" in (r["text"] or "") for r in cleaned.collect()) == 1


def test_pii(docs, rows):
    got = pii.report(docs).collect()
    sha = lambda t: brute.sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute.op2(t)))
    assert ordered((r["doc_id"], r["base_sha256"]) for r in got) == ordered((r[0], sha(r[1])) for r in rows)


def test_decontamination(docs, rows, spark):
    items = [(1, rows[0][1].split("\n")[2]), (2, rows[3][1][:90]), (None, rows[8][1][:120]), (2, rows[9][1][:100])]
    bench = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id int, text string, words string, doc_id string")
    assert ordered(winnow.report(docs, bench).collect()) == ordered(brute.op3([(r[0], r[1]) for r in rows], items))


def test_token_shards(docs, rows):
    lib = bpe.encoder(vocabulary()).library
    got = sstable.digests(docs, vocabulary()).collect()
    ids = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 2]
    want = [(r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows for i in [ids(r[1])]]
    assert ordered((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == ordered(want)
    by = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by] == [sum(x["n_tokens"] for x in by[:k]) for k in range(len(by))]
    assert [r["doc_id"] for r in by] == [None] * 4 + sorted(r[0] for r in rows if r[0] is not None)
    again = sstable.digests(docs.repartition(7), vocabulary()).collect()
    assert ordered(again) == ordered(got)


def test_language_id(docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] in ("en", "und") and 0 <= r["score"] <= 1 for r in got)
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not any(c.isalpha() for c in r[1] or "") for r in rows)
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns


def test_simhash(docs, rows):
    some = [r for r in rows if r[0] != 6]
    df = docs.sparkSession.createDataFrame(some, SCHEMA)
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.classes(df).collect()]
    texts = [(LAST + k if r[0] is None else r[0] * 100 + k, r[1]) for k, r in enumerate(some)]
    back = {d: r[0] for (d, _), r in zip(texts, some, strict=True)}
    assert ordered(got) == ordered((back[d], f, back[c]) for d, f, c in brute.op6(texts))
    assert simhash.keep_one(docs).columns == docs.columns


def test_substring_dedup(docs, rows):
    some = [r for r in rows if r[0] != 6]
    df = docs.sparkSession.createDataFrame(some, SCHEMA)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicated(df).collect()]
    assert ordered(got) == ordered(named(brute.op7(plain(some, 0, 1)))) and sum(x[2] for x in got) > 300
    assert substring.deduplicated(docs).count() == len(rows)


def test_quality(docs, rows):
    got = quality.report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert ordered(got) == ordered((r[0], *brute.op8_base(r[1])) for r in rows)


def test_bpe(docs, rows):
    lib = bpe.encoder(vocabulary()).library

    def digest(d, t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        return d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(lib.decode(ids, skip_special_tokens=False))

    assert any(len(r[1] or "") > 2 * bpe.LONG for r in rows)
    assert ordered(bpe.digests(docs, vocabulary()).collect()) == ordered(digest(r[0], r[1]) for r in rows)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], docs.schema)
    bench = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for found in (linededup.report(none), linededup.cleaned(none), pii.report(none), winnow.report(none, bench), sstable.digests(none, vocabulary()), langid.identify(none), langid.accepted(none), simhash.classes(none), simhash.keep_one(none), substring.deduplicated(none), quality.report(none), quality.cleaned(none), warc.report(pages), bpe.digests(none, vocabulary())):
        assert found.count() == 0


def test_pipeline(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[1][1][:90])], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), "edges")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == sizes[4]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id int, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_results_without_ansi(spark, rows):
    some = [(*r[:1], (r[1] or "")[:3000] if r[1] is not None else None, *r[2:]) for r in rows]
    docs = spark.createDataFrame(some, SCHEMA).repartition(2).cache()
    bench = spark.createDataFrame([(1, rows[1][1][:90]), (2, None)], "item_id int, text string")
    pages = spark.createDataFrame([(k, None if k % 3 else "u", r[1]) for k, r in enumerate(some)], "page_id long, url string, html string")
    talk = spark.createDataFrame([(k // 4, k % 4 if k % 7 else None, ("user", "assistant", None)[k % 3], r[1]) for k, r in enumerate(some)], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([(k * 50, [k % 5 / 4, None if k == 9 else 0.5, -0.25], k % 3 if k % 8 else None) for k in range(40)], "vec_id long, embedding array<double>, label int")
    jobs = {
        1: lambda: linededup.report(docs), 2: lambda: pii.report(docs), 3: lambda: winnow.report(docs, bench), 4: lambda: sstable.digests(docs, vocabulary()), 5: lambda: langid.identify(docs),
        6: lambda: simhash.classes(docs), 7: lambda: substring.deduplicated(docs), 8: lambda: quality.report(docs), 9: lambda: warc.report(pages), 10: lambda: bpe.digests(docs, vocabulary()),
        11: lambda: repair.report(talk), 12: lambda: exactdedup.report(docs), 13: lambda: negatives.mined(vectors),
    }
    for n, job in jobs.items():
        found = []
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            try:
                found.append(ordered(job().collect()))
            finally:
                spark.conf.unset("spark.sql.ansi.enabled")
        assert found[0] == found[1], n
        assert found[0]
