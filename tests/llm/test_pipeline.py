import os
from collections import Counter

import pytest

import corpus_pipeline
from docloom.llm import line_crf, mixing
from docloom.llm.shared import written
from tests.llm.test_simhash import plain_roots, plain_similar, plain_wide

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "mix", "shard"]

    model = line_crf.fit(docs, labels)
    good = written(stages["quality"](spark, docs, SF), "t")
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in rows if model.score(r.text) >= 0.7)

    rows = good.collect()
    unique = written(stages["near_dedup"](spark, good, SF), "t")
    fps = {r.doc_id: plain_wide(r.text) for r in rows}
    roots = plain_roots(set(fps.values()), plain_similar)
    least = {}
    for i, f in sorted(fps.items()):
        least.setdefault(roots[f], i)
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(least.values())

    rows = unique.collect()
    clean = written(stages["decontaminate"](spark, unique, SF), "t")
    plain = lambda t: " " + " ".join(t.lower().split()) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in rows if any(i in plain(r.text) for i in items)}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and not left & leaks and len(left) >= len(rows) - len(leaks) - 2

    rows = clean.collect()
    mixed = written(stages["mix"](spark, clean, SF), "t")
    uses = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(uses.values()) <= 2 and set(uses) <= left
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    names = sorted(sizes)
    for name, goal in zip(names, mixing.targets([sizes[n] for n in names]), strict=True):
        mine = [r for r in rows if r.source == name]
        assert abs(sum(uses[r.doc_id] * len(r.text.split()) for r in mine) - goal) <= max(len(r.text.split()) for r in mine)

    out = stages["shard"](spark, mixed, SF).collect()
    counts = Counter(r.shard for r in out)
    each = [counts.get(s, 0) for s in range(40)]
    assert len(out) == sum(uses.values()) and max(each) - min(each) <= 1
