import os
import random
import re

import pytest

import corpus_pipeline as P
from tallyweave.llm import registry

from .helpers import edited, prose


def write(spark, folder, seed=1):
    """Tables with junk, copies, near copies, benchmark passages and personal data; what each document is."""
    rng = random.Random(seed)
    item = prose(rng, 14)
    rows, labels, kinds = [], [], {}
    for i in range(240):
        kind = ("clean", "clean", "junk", "copy", "near", "leak", "mail", "clean")[i % 8]
        t = prose(rng, 90, 600)
        if kind == "junk":
            t = t.upper().replace(" ", "$$$ ")
        elif kind in ("copy", "near") and i >= 8:
            source = rows[i - i % 8][1]
            t = source if kind == "copy" else edited(rng, source, 0.01)
        elif kind == "leak":
            t = f"{t} {item} {prose(rng, 20)}"
        elif kind == "mail":
            t += " write to someone@mail.example.com today"
        rows.append((i, t, "en", "web", len(t)))
        labels.append((i, int(kind != "junk"), 0))
        kinds[i] = kind
    rows += [(900, None, None, None, None), (901, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t, *_ in rows}, kinds, item


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_each_stage_does_its_work(spark, tmp_path):
    texts, kinds, item = write(spark, str(tmp_path))
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else {r.doc_id for r in docs.collect()}
    assert not [i for i in kept["quality"] if kinds.get(i) == "junk"]
    assert [i for i, k in kinds.items() if k != "junk" and i not in kept["quality"]] == []
    left = set(kept["quality"])
    gone = left - set(kept["near_duplicates"])
    for i in left - gone:
        assert not [j for j in left if j < i and texts.get(i) and texts.get(j) and jaccard(texts[i], texts[j]) >= 0.75]
    assert all(any(j < i and jaccard(texts[i], texts[j]) >= 0.75 for j in left if texts.get(j)) for i in gone if texts.get(i))
    assert all(item not in (t or "") for t in kept["decontamination"].values())
    assert any(item in (t or "") for t in kept["near_duplicates"].values())
    assert not any(re.search(r"\S+@\S+\.\S+", t or "") for t in kept["personal_data"].values())
    assert kept["packing"] == set(kept["personal_data"])


def test_run_gives_the_last_stage(spark, tmp_path):
    write(spark, str(tmp_path), 2)
    rows = P.run(spark, str(tmp_path)).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows[0].asDict())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_registered_queries_return_a_row_for_each_document(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name, query in registry.queries().items():
        found = query(spark, folder).toPandas()
        if name == "op7_chat_format":
            assert (found.conv_id == -7).sum() == 1
        else:
            assert found.doc_id.nunique() == n, name
            assert name == "op5_packing" or len(found) == n
