"""The pipeline's stages, each against what it has to keep."""

import collections
import os
import random

import corpus_pipeline
from snapweave.llm import queries


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    clean = [(i, " ".join(word() for _ in range(80)), "en", f"s{i % 3}", 1) for i in range(60)]
    toxic = [(100 + i, " ".join([word() for _ in range(30)] + ["vile", "nasty"] + [word() for _ in range(30)]), "en", "s0", 1) for i in range(40)]
    item = " ".join(word() for _ in range(30))
    leak = [(200 + i, f"{clean[i][1]} {item} {word()}", "en", "s1", 1) for i in range(4)]
    copies = [(300 + i, clean[i][1] + (" tail" if i % 2 else ""), "en", "s2", 1) for i in range(6)]
    rows = [*clean, *toxic, *leak, *copies, (None, None, None, None, None)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(d[0], 1, int(100 <= d[0] < 200)) for d in [*clean, *toxic]], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"stage{i}"))
            out = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept.append([x[0] for x in out.select("doc_id").collect()])
        docs = out
    everyone = {x[0] for x in rows}
    assert set(kept[0]) == everyone - set(range(100, 140))
    assert set(kept[1]) == set(kept[0]) - set(range(300, 306))
    assert set(kept[2]) == set(kept[1]) - set(range(200, 204))
    assert max(collections.Counter(kept[3]).values()) <= 2 and set(kept[3]) <= set(kept[2])
    assert sorted(kept[4], key=str) == sorted(kept[3], key=str)
    assert os.path.exists(queries.tokenizer_path())
