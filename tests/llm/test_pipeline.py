import numpy as np

import corpus_pipeline
from barloom.llm import perplexity
from barloom.llm.common import settle

from ..conftest import SMALL
from .test_duplicates import brute_components, brute_fingerprint


def windows_cut(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


def check_stages(spark, docs):
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas()
        docs = settle(stage(spark, docs, SMALL))
        assert docs.columns == names, name
        after = docs.toPandas()
        ids = lambda f: sorted(map(str, f["doc_id"]))
        if name == "quality_rules":
            judged = perplexity.quality_rules(spark.createDataFrame(before[["doc_id", "text", "lang"]], "doc_id long, text string, lang string"))
            assert ids(after) == ids(judged.filter("kept").toPandas())
        elif name == "exact_dedup":
            best = before.assign(text=before.text.fillna("")).groupby("text").doc_id.max()
            assert sorted(after.doc_id) == sorted(best)
        elif name == "near_dedup":
            comps = brute_components(list(before.doc_id), [brute_fingerprint(t) for t in before.text])
            assert sorted(after.doc_id) == sorted(set(comps))
        else:
            want = dict(zip(before.doc_id, windows_cut(before.text), strict=True))
            assert dict(zip(after.doc_id, after.text, strict=True)) == want
            assert (after.n_chars == after.text.str.len()).all()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert set(packed.doc_id) == set(docs.toPandas().doc_id)
    return packed


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    packed = check_stages(spark, docs)
    run = corpus_pipeline.run(spark, SMALL).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run[key].to_numpy().tolist())) == sorted(map(tuple, packed[key].to_numpy().tolist()))


def test_stages_take_clashing_columns_and_no_rows(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = settle(stage(spark, docs, SMALL)), settle(stage(spark, empty, SMALL))
        assert {"kept", "rid", "fp", "component_id", "size"} <= set(docs.columns) and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count() > 0
