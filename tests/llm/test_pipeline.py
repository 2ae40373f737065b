"""The pipeline, stage by stage, against plain versions."""

import corpus_pipeline
from ocularis.llm import bpe
from ocularis.llm.queries import vocabulary

from . import brute
from .test_operators import texts


def test_pipeline(spark, tmp_path):
    rows = [(i, t, "en", f"site{i % 12}", len(t)) for i, t in enumerate(texts(4, 40))]
    rows += [(100 + i, f"Footer line of every page\n{t}", "en", f"site{i}", 0) for i, t in enumerate(texts(9, 12))]
    rows += [(200, None, "en", "site1", 0), (201, "12 34", "en", "site1", 5)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, rows[10][1][:150] or "x"), (2, "copper silver orchard bridge the of and to in river stone light")]
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, now = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in cols.split(", ")]
        got = {r["doc_id"]: tuple(r) for r in docs.collect()}
        if name == "language_id":
            want = {d for d, r in now.items() if r[1] and any(c.isalpha() for c in r[1])}
        elif name == "line_dedup":
            want = set(now)
            digests = {d: x for d, _, _, x in brute.op1([(r[0], r[1], r[3]) for r in now.values()])}
            assert all(brute.sha(r[1]) == digests[d] and r[4] == len(r[1]) for d, r in got.items())
        elif name == "near_dedup":
            want = {c for _, _, c in brute.op6([(d, r[1]) for d, r in now.items()])}
        else:
            want = {r[0] for r in brute.op3([(d, r[1]) for d, r in now.items()], items) if not r[5]}
        assert set(got) == want
        now = got
    lib = bpe.encoder(vocabulary()).library
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {d: len(lib.encode(r[1], add_special_tokens=False).ids) for d, r in now.items()}
