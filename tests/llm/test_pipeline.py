import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from regionframe.llm.neardup import shingles, similarity
from regionframe.llm.tokens import vocabulary
from regionframe.llm.toxicity import trained

SF = "/root/testdata/sf0.001"


def test_every_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = [r.asDict() for r in docs.collect()]
    model = trained(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    got, frames = {}, docs
    for name, stage in cp.STAGES[:-1]:
        rows = stage(spark, frames, SF).collect()
        assert list(rows[0].asDict()) == cp.COLUMNS
        got[name] = [r.asDict() for r in rows]
        frames = spark.createDataFrame(rows, docs.schema)
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    assert ids(got["toxicity"]) == [k for k in ids(before) if model.document({r["doc_id"]: r["text"] for r in before}[k] or "")[0] < 0.7]
    # near duplicates: classes by all pairs
    rows = sorted(got["toxicity"], key=lambda r: r["doc_id"])
    sh = [shingles(r["text"] or "").astype(np.uint32) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = similarity(sh[i], sh[j]) >= 0.8 if len(sh[i]) and len(sh[j]) else (rows[i]["text"] or "") == (rows[j]["text"] or "")
            if same:
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert ids(got["near_duplicates"]) == sorted({rows[root(i)]["doc_id"] for i in range(len(rows))})
    # repeats: windows of 50 words
    seen = {}
    words = {r["doc_id"]: re.findall(r"\S+", r["text"] or "") for r in got["near_duplicates"]}
    for k, w in words.items():
        for s in range(len(w) - 49):
            seen.setdefault(tuple(w[s : s + 50]), []).append((k, s))
    gone = {k: set() for k in words}
    for at in seen.values():
        if len(at) > 1:
            for k, s in at:
                gone[k] |= set(range(s, s + 50))
    assert {r["doc_id"]: re.findall(r"\S+", r["text"] or "") for r in got["repeats"]} == {k: [x for i, x in enumerate(w) if i not in gone[k]] for k, w in words.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got["repeats"] if r["text"] is not None)
    # mixing: words of each source near its target, no document more than three times
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in got["repeats"]}
    taken = {}
    for r in got["mixing"]:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert max(taken.values()) <= 3 and abs(sum(size[k] * n for k, n in taken.items()) - sum(size.values())) <= 0.02 * sum(size.values())  # few documents a source here
    # packing: all ids of all copies
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = cp.packing_stage(spark, frames, SF).collect()
    assert sum(p.length for p in pieces) == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in got["mixing"])


def test_run(spark):
    assert cp.run(spark, SF).count() > 0 and cp.ORACLE_SQL is None
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
