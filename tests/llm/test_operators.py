"""Each operator against its plain version, on rows with nulls, blanks, long texts, ties, repeated rows and clashing columns."""

import gzip
import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

from ocularis.llm import bpe, langid, linededup, pii, quality, simhash, sstable, substring, warc, winnow
from ocularis.llm.queries import vocabulary

from . import brute

WORDS = "the of and to in river stone light winter garden market open seven carry yellow small under window paper train coffee engine copper silver orchard bridge".split()


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    made = [" ".join(r.choice(WORDS) for _ in range(r.choice((0, 1, 2, 5, 40, 120, 300)))) for _ in range(n)]
    made = [t.replace("river", "river.\n").replace("market", "Market,\t") for t in made]
    for k in range(5, n, 6):  # near copies, shared passages and exact copies
        made[k] = made[k - 1] + " extra" if k % 4 == 1 else made[k - 3][:700] + "\n" + made[k - 1][:500] if k % 4 == 3 else made[k - 2]
    return made


def documents(spark, seed=1, n=60):
    rows = [(i, t, "en", f"site{i % 12}", len(t), f"x{i}", i) for i, t in enumerate(texts(seed, n))]
    rows += [(n, None, None, None, None, None, None), (n + 1, "", "en", "site1", 0, "th", 1), (n + 2, " \n\t ", "en", "site1", 4, "th", 1)]
    rows.append((n + 3, "word " * 6_000, "en", "site2", 30_000, "words", 2))
    # the last two columns clash with names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, th string, words int")


@pytest.fixture(scope="module")
def docs(spark):
    df = documents(spark).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


def same(df, want, columns=None):
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_line_dedup(docs, plain):
    shared = docs.sparkSession.createDataFrame([(1000 + i, f"Own line number {i} here\nAccept all cookies now\n\nAccept all cookies now", f"s{i}") for i in range(14)] + [(2000 + i, f"Only nine sites have this\ntext {i} is all mine", f"s{i}") for i in range(9)], "doc_id long, text string, source string")
    rows = [tuple(r) for r in shared.collect()]
    want = brute.op1(rows)
    same(linededup.report(shared), want)
    assert sum(r[2] for r in want) == 27
    same(linededup.report(docs), brute.op1(plain))
    assert linededup.cleaned(docs).columns == docs.columns


def test_line_dedup_keeps_the_estimate_exact_near_the_limit(docs):
    spark = docs.sparkSession
    rows = [(k * 100 + i, f"a line on {k} sites exactly", f"s{i}") for k in range(5, 18) for i in range(k)]
    shared = spark.createDataFrame(rows, "doc_id long, text string, source string")
    same(linededup.report(shared), brute.op1(rows))


def test_pii_patterns():
    cases = ["", "a@b.co", "x a.b+c@d-e.f.gh,i@j", "a@b.co+x@d.ef", "@@a@b.c@d.e", "1.2.3.4 300.1.1.1 1.2.3.4.5 01.02.03.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824 +12 +123456789012345678", "tél +33 1 23 45 67 89.", "é 10.0.0.1", "1" * 3000 + ".1.1", "a" * 3000 + "@", "٣.1.2.3.4"]
    for t in cases:
        assert pii.base_spans(t) == brute.op2(t), t[:80]


def test_pii_report(docs, spark):
    rows = [(i, f"please call office line {n} today about the river") for i, n in enumerate([f"+1 (743) 555-38{k:02d}" for k in range(24)] + ["743-555-9999", "garden"])]
    rows += [(100, None), (101, ""), (102, "river 555-0000 garden"), (3, rows[3][1])]
    found = pii.report(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows)
    assert by[0]["n_phone"] == 1 and by[0]["base_sha256"] == brute.sha("phone:24:41") and by[0]["n_added"] == 0
    assert by[24]["spans"] == "phone:24:36" and by[24]["n_added"] == 1 and by[24]["n_phone"] == 0
    assert by[25]["spans"] == by[100]["spans"] == by[101]["spans"] == by[102]["spans"] == ""
    same(pii.report(empty(spark, docs)), [])


@pytest.mark.parametrize("bound", [winnow.BROADCAST_ROWS, 0])
def test_decontamination(docs, plain, spark, bound):
    items = [(1, "river stone light"), (2, plain[10][1][:200] if plain[10][1] else "a"), (3, (plain[18][1] or "")[40:300].upper()), (4, None), (5, "  "), (None, "winter garden market"), (7, " ".join(WORDS)), (7, "open seven carry yellow small under window paper train coffee"), (8, "WORD word word Word word word word word word word word")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    same(winnow.report(docs, bench, bound), brute.op3([r[:2] for r in plain], items))


def test_decontamination_without_items_or_documents(docs, spark):
    none = spark.createDataFrame([], "item_id int, text string")
    assert winnow.report(docs, none).filter("contaminated").count() == 0
    assert winnow.clean(docs, none).count() == docs.count()
    some = spark.createDataFrame([(1, "river stone")], "item_id int, text string")
    same(winnow.report(empty(spark, docs), some), [])


def test_token_shards(docs, plain, spark):
    lib = bpe.encoder(vocabulary()).library
    shards = sstable.write(docs, vocabulary())
    at, want = 0, {}
    for d, t, _ in sorted(plain):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    same(sstable.digests(docs, vocabulary()), list(want.values()))
    opened = [sstable.Shard(path) for _, path, _, _ in shards]
    for d in (0, 7, 63, 999, -5, None):
        found = [x for s in opened for x in s.lookup(d)]
        assert [len(x) // 4 for x in found] == ([want[d][2]] if d in want else [])
    assert sstable.digests(empty(spark, docs), vocabulary()).count() == 0


def test_language_id(spark):
    r = random.Random(2)
    parts = {"en": ["th", "ing", "er", "and", "wh", "tion"], "de": ["sch", "ung", "keit", "ä", "ß", "ver"], "fr": ["eau", "é", "aux", "ç", "oi", "ment"]}
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.choice((20, 60)))), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (None, rows[0][1], "en"), (903, "漢字仮名交じり文" * 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(df).collect()}
    truth = {d: lang for d, _, lang in rows}
    held = [d for d in range(180) if got[d]["held_out"]]
    assert held == [d for d in range(180) if brute.crc_held_out(d)] and len(held) > 20
    assert all(got[d]["lang_pred"] == truth[d] and not got[d]["rejected"] for d in range(180))
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (900, 901, 902))
    assert got[903]["rejected"] and 0 <= got[903]["score"] <= 1
    for d, lang, score in brute.op5(rows, langid):
        assert got[d]["lang_pred"] == lang and abs(got[d]["score"] - score) < 1e-4, (d, lang, score, got[d])
    kept = langid.accepted(df)
    assert kept.columns == df.columns and kept.count() == 181
    assert langid.identify(spark.createDataFrame([], df.schema)).count() == 0


def test_language_id_learns_from_a_bounded_sample(spark):
    rows = [(7, "the cat sat on the mat by the river", "en")] * 300 + [(k, f"der hund lief über die brücke {k}", "de") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample=20)
    assert set(model.langs) == {"en", "de"} and [x[0] for x in model.predict(["the river", "die brücke"])] == ["en", "de"]


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_simhash(docs, plain, hot):
    got = simhash.components(docs, hot=hot).select("doc_id", simhash.F.lower(simhash.F.lpad(simhash.F.hex("fp"), 16, "0")), "component_id")
    same(got, brute.op6([r[:2] for r in plain]))


def test_simhash_keeps_one(docs, plain, spark):
    twice = docs.unionByName(docs.filter("doc_id in (0, 8, 60)"))
    kept = simhash.keep_one(twice)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[2] for r in brute.op6([x[:2] for x in plain])})
    assert simhash.classes(empty(spark, docs)).count() == 0


def test_simhash_links_all_pairs_within_three_bits(spark):
    r = random.Random(5)
    made = set()
    for _ in range(40):
        f = r.getrandbits(64)
        made.add(f)
        for _ in range(6):
            g = f
            for b in r.sample(range(64), r.randint(1, 5)):
                g ^= 1 << b
            made.add(g)
    signed = [x - (1 << 64) if x >> 63 else x for x in made]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {tuple(sorted((x["a"], x["b"]))) for x in simhash.links(nodes).collect()}
    want = {tuple(sorted((a, b))) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and len(want) > 50


def test_substring_dedup(docs, plain, spark):
    got = substring.deduplicated(docs)
    same(got, brute.op7([r[:2] for r in plain]), ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert got.filter("n_removed > 0").count() > 3
    for d in got.filter("doc_id < 40").collect():
        assert brute.sha(d["kept"]) == d["kept_sha256"]
    assert substring.deduplicated(empty(spark, docs)).count() == 0


def test_quality(docs, plain, spark):
    extra = spark.createDataFrame([(500, "Home | About | News | Shop\n" * 3 + "A sentence that stays in the text because it ends well. " * 9), (501, "MENU MENU MENU MENU MENU\n" * 30)], "doc_id long, text string")
    every = [(d, t) for d, t, _ in plain] + [tuple(r) for r in extra.collect()]
    both = docs.select("doc_id", "text").unionByName(extra)
    got = quality.report(both)
    same(got, [(d, *brute.op8_base(t)) for d, t in every], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert got.filter("base_failed and kept").count() == 0
    assert quality.report(empty(spark, docs)).count() == 0


def test_quality_line_rules(spark):
    good = "The garden by the river was open to all who came that day in late winter, and {} more words follow here."
    lines = [good.format(w) for w in WORDS]
    rows = [(1, "\n".join(["Home | About | News | Shop", *lines[:8], "Licensed under the MIT licence."])), (2, "\n".join([*lines[:3], *["Home | About | News | Shop | Mail | More | Top"] * 9])), (3, "\n".join(lines))]
    got = {r["doc_id"]: r for r in quality.measured(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["cleaned"] == "\n".join(lines[:8]) and got[1]["n_failed_lines"] == 2
    assert got[3]["n_failed_lines"] == 0


def test_quality_filters_and_long_texts_take_no_longer(docs, spark):
    r = random.Random(8)
    long = [" ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(20_000)) + ".", " ".join(str(r.random()) for _ in range(20_000)) + ".", "so it goes on and on " * 4_000 + "."]
    rows = spark.createDataFrame(list(enumerate(long, 900)), "doc_id long, text string")
    began = time.monotonic()
    got = quality.report(rows)
    same(got, [(d, *brute.op8_base(t)) for d, t in enumerate(long, 900)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert got.filter("base_failed and kept").count() == 0
    assert sorted(r["doc_id"] for r in got.filter("kept").collect()) == [900, 901]
    both = docs.select("doc_id", "text").unionByName(rows)
    verdict = {r["doc_id"] for r in quality.report(both).filter("kept").collect()}
    cleaned = quality.cleaned(both)
    assert {r["doc_id"] for r in cleaned.collect()} == verdict and cleaned.filter("length(text) > 10").count() == len(verdict)
    assert time.monotonic() - began < 90


def test_quality_phrases_in_four_languages(spark):
    lines = ["Alle Rechte vorbehalten, und zwar bei uns allen zu jeder Zeit und ohne Ende.", "TOUS DROITS RÉSERVÉS, pour nous tous et pour toujours et encore un jour.", "Haga clic aquí para ver todo lo que tenemos hoy en la tienda de siempre.", "The cook made cookies for all who came to the old house by the river."]
    got = quality.measured(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert got["n_failed_lines"] == 3 and got["cleaned"] == lines[3]


PAGES = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 5000, "é" * 5000, "\r\n\r\nWARC/1.1\r\n"]


def test_warc(spark):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(PAGES)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows] + [(9, None, "<p>a</p>", "clash")], "page_id long, url string, html string, payload string")
    want = brute.op9([(r[0], r[2]) for r in rows] + [(9, "<p>a</p>")])
    same(warc.report(pages), want)
    archives = warc.write(warc.classified(pages), chunk=700)
    table = warc.record_table(spark, archives, chunk=512).filter("page_id = 5").orderBy("chunk").collect()
    assert b"".join(r["data"] for r in table).decode() == "é" * 5000 and len(table) == 20
    assert [r["is_last"] for r in table] == [False] * 19 + [True] and table[-1]["size"] == 10_000
    same(warc.report(pages, least=10), [(i, n, d, "response" if n < 10 else t, None if n < 10 else f) for i, n, d, t, f in want])
    assert warc.report(spark.createDataFrame([], pages.schema)).count() == 0


def test_warc_urls_repeated_rows_and_null_ids_come_back(spark):
    rows = [(1, "http://x/a b\r\nX-Page-ID: 7", "q"), (2, None, "r"), (3, "", "s"), (4, "about:blank", "t"), (5, "http://é/%0A", "u" * 3_000_000), (5, "http://é/%0A", "u" * 3_000_000), (None, "http://n", "q"), (6, "http://z", "s")]
    table = warc.record_table(spark, warc.write(warc.classified(spark.createDataFrame(rows, "page_id long, url string, html string"))), data=False).filter("is_last").collect()
    assert sorted((str(r["page_id"]), str(r["url"])) for r in table) == sorted((str(p), str(u)) for p, u, _ in rows)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in table}
    assert {(None, "revisit", 1), (6, "revisit", 3), (5, "response", None)} <= kinds and len(table) == len(rows)


def test_warc_archives_have_what_the_format_asks_for(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(PAGES)] * 2, "page_id long, url string, html string").coalesce(1)
    records = [r for path, _ in warc.write(warc.classified(pages)) for r in gzip.open(path.removeprefix("file://")).read().split(b"WARC/1.1\r\nWARC-Type: ")[1:]]
    names = [re.search(rb"WARC-Record-ID: (\S+)", r)[1] for r in records]
    assert len(set(names)) == len(names) and records[0].startswith(b"warcinfo")
    assert all(re.search(rb"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", r) for r in records)
    assert all(b"\r\n\r\nHTTP/1.1 200 OK\r\n" in r for r in records if not r.startswith(b"warcinfo"))


def test_damaged_warc_archives_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", str(i) * 5000) for i in range(4)], "page_id long, url string, html string").coalesce(1)
    ((path, n),) = warc.write(warc.classified(pages))
    whole = Path(path.removeprefix("file://")).read_bytes()
    plain = gzip.decompress(whole)

    def read(data, n=n):
        (tmp_path / "x.warc.gz").write_bytes(data)
        return list(warc.chunks(str(tmp_path / "x.warc.gz"), chunk=512))

    assert sum(x["is_last"] for x in read(whole)) == n == 4
    members = [gzip.compress(b"WARC/1.1" + m) for m in plain.split(b"WARC/1.1")[1:]]
    assert sum(x["is_last"] for x in read(b"".join(members))) == 4
    for cut in (len(whole) - 5, len(whole) - len(whole) // 8, len(whole) // 2):
        with pytest.raises(warc.DamagedArchive):
            read(whole[:cut])
    for old, new in ((b"22222", b"22322"), (b"Content-Length: 5000", b"Content-Length: 4999"), (b"2222222222", b"2")):
        with pytest.raises(warc.DamagedArchive):
            read(b"".join(gzip.compress(gzip.decompress(m).replace(old, new, 1)) for m in members))
    lost = str(tmp_path / "lost.warc.gz")
    Path(lost).write_bytes(b"".join(members[:-1]))
    with pytest.raises(Exception, match="3 records of 4"):
        warc.record_table(spark, [(lost, 4)]).count()


def test_bpe(docs, plain, spark):
    lib = bpe.encoder(vocabulary()).library

    def digest(d, t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        return d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(lib.decode(ids, skip_special_tokens=False))

    same(bpe.digests(docs, vocabulary()), [digest(d, t) for d, t, _ in plain])
    cut = bpe.encoded(docs, vocabulary(), "doc_id long, n_tokens long", lambda enc, ids: (len(ids) // 4,), leaf=100, long=150)
    same(cut, [digest(d, t)[:2] for d, t, _ in plain])
    assert bpe.digests(empty(spark, docs), vocabulary()).count() == 0


def test_bpe_matches_the_library_on_odd_texts():
    enc = bpe.encoder(vocabulary())
    r = random.Random(1)
    odd = ["a", "b", "th", "'s", "'", "!", "é", " ", "\n", "1", "the", "er", "Σ", "<|endoftext|>", "́", "e", "​", "\x1c", "\x85", "İ", "漢", "🙂"]
    for _ in range(600):
        t = "".join(r.choice(odd) for _ in range(r.randint(0, 30)))
        ids = enc.library.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == enc.packed(ids), repr(t)
        assert enc.decode(enc.packed(ids)) == enc.library.decode(ids, skip_special_tokens=False)


def test_tree_concatenation():
    enc = bpe.encoder(vocabulary())
    r = random.Random(3)
    for kind in (["a", "e", "th", "er", "in", "o", "n"], ["!", "'", "s", "'s", "*", "."], ["the", " ", "er", "\n", "é", "12"]):
        for _ in range(25):
            t = "".join(r.choice(kind) for _ in range(r.randint(100, 2500)))
            n = r.choice((37, 100, 301))
            leaves = [t[i : i + n] for i in range(0, len(t), n)]
            assert bpe.concatenated(enc, [(x, enc.encode(x)) for x in leaves]) == enc.packed(enc.library.encode(t, add_special_tokens=False).ids)
