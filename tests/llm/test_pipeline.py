import hmac
import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from regiongrid.llm import packing, pii

from .test_operators import WORDS, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_keep_columns_and_pack_the_rest(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    run = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert run.select(key).exceptAll(docs.select(key)).isEmpty() and run.count() == docs.count()


def test_rows_of_planted_cases(spark, tmp_path):
    """Stages 2 to 5 by brute force on the rows that the classifier keeps."""
    r = random.Random(3)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    texts = {i: line(80) + "." if i % 4 else " ".join(w.upper() + "!!" for w in line(80).split()) for i in range(120)}
    item = line(30)
    mail, secret = "bob.x@site.example.org", "sk_liveABCDefghIJKLmnopQR"
    texts[3] = f"{line(30)} {item} {line(30)}."
    texts[5] = f"{texts[5]} {secret} {line(3)}"
    texts[6] = f"{mail} {texts[6]} {secret}"
    near = texts[2].split()
    near[40] = "changed"
    texts |= {200: texts[1], 201: " ".join(near), 202: texts[3], 203: f"{line(60)} {' '.join(item.split()[:28])} {line(60)}", 204: f"{line(60)} {' '.join(item.split()[:15])} {line(60)}", 205: texts[6]}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(120)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = sorted(x["doc_id"] for x in corpus_pipeline.quality(spark, read, str(tmp_path)).collect())
    assert {1, 2, 3, 5, 6, 200, 201, 202, 203, 204, 205} <= set(kept) and sum(i % 4 == 0 for i in kept if i < 120) <= 3
    sets = {i: shingles(texts[i]) for i in kept}
    top = {i: i for i in kept}
    for _ in kept:  # smallest id of each component
        before = dict(top)
        for a in kept:
            for b in kept:
                if top[a] != top[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
        if top == before:
            break
    left = [i for i in kept if top[i] == i]
    assert not {200, 201, 202, 205} & set(left)
    q = shingles(item)
    left = [i for i in left if 100 * len(q & sets[i]) < 75 * len(q)]
    assert not {3, 203} & set(left) and {1, 2, 5, 6, 204} <= set(left)
    digest = lambda kind, m: hmac.new(pii.DEMO_KEY.encode(), f"{kind}|{m}".encode(), "sha256").hexdigest()
    want = []
    for i in left:
        t = texts[i].replace(mail, f"user.{digest('email', mail)[:32]}@mail.invalid")
        t = t.replace(secret, secret[:4] + digest("secret", secret)[: len(secret) - 4])
        ids = np.append(packing.encode(t), packing.END).astype("<u4")
        want.append((i, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows) == want
    at = {}
    for x in sorted(rows, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == at.get(x["sequence_id"], 0)
        at[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(at.values()) <= packing.CAPACITY


def test_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, a clashing column; then no rows at all."""
    r = random.Random(8)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(i, line(60) + ".", "en", None, 1, 0.1) for i in range(30)] + [(30, None, None, None, None, 0.1), (31, "", "en", "s", 0, 0.1), (None, line(60), "en", "s", 9, 0.1), (32, line(40_000), "en", "s", 9, 0.1)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long, _score double")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{tmp_path}/a/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    ids = [x["doc_id"] for x in got if x["piece"] == 0]
    assert sorted(ids, key=str) == sorted([*range(33), 3, None], key=str)
    assert sum(x["length"] for x in got) == sum(len(packing.encode(x[1])) + 1 for x in [*rows, rows[3]])
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").isEmpty()
