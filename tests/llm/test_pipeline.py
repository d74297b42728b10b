"""The pipeline on documents whose fate is known."""

import numpy as np
import pytest

import corpus_pipeline
from sparsecg.llm.common import written


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(3)
    plain, bad = [f"w{k}" for k in range(400)], ["grub", "sludge", "vermin"]
    rows, labels, toxic = [], [], set()
    for i in range(700):
        w = [plain[k] for k in rng.integers(0, 400, 80)]
        if i % 6 == 0:
            toxic.add(i)
            for k in rng.integers(0, 80, 8):
                w[k] = bad[k % 3]
        rows.append((i, " ".join(w[:40]) + "\n" + " ".join(w[40:])))
        labels.append((i, 1, int(i % 6 == 0)))
    passage = " ".join(f"b{k}" for k in range(16))
    shared = " ".join(f"s{k}" for k in range(60))
    clean = [i for i in range(700) if i not in toxic]
    texts = dict(rows)
    copies = [(1000 + k, texts[clean[5]].replace("\n", " ") + f" tail{k}") for k in range(5)]  # no line repeats
    rows += [*copies, (2000, passage + " and " + " ".join(plain[:30])), (2001, "x " * 10 + passage), (3000, f"one\n{shared}\ntwo"), (3001, f"three\n{shared}\nfour"), (4000, None), (4001, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, toxic, clean


def test_stages(spark, corpus):
    d, rows, toxic, clean = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, d), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    after_toxic, after_lines, after_copies, after_bench, packed = kept
    everyone = {i for i, _ in rows}
    # a held-out toxic document may be missed, a clean one lost, but hardly any
    assert len(toxic & set(after_toxic)) <= 3 and len(everyone - toxic - set(after_toxic)) <= 3
    assert set(after_lines) == set(after_toxic)
    shared = " ".join(f"s{k}" for k in range(60))
    assert shared in after_lines[3000].text and after_lines[3001].text == "three\nfour" and after_lines[3001].n_chars == 10
    group = {1000 + k for k in range(5)} & set(after_lines)
    assert len(group & set(after_copies)) <= 1 and len(set(after_lines) - set(after_copies) - group) <= 2
    assert len({4000, 4001} & set(after_copies)) == 1
    assert set(after_copies) - set(after_bench) == {2000, 2001}
    assert set(packed) == set(after_bench)


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 500
