"""The stages on a small table: each keeps what it should, and the columns."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    words = "the of and to in is that it was for on are with as his they at be this from".split()
    base = " ".join(words[(7 * k + k // 3) % 20] + str(k % 11) for k in range(150))
    near = base.replace(base.split()[40], "changed", 1)
    rows = [(0, base, "en"), (1, base + " ", "en"), (2, near, "en"), (3, "mail me at a@b.co or nothing else here", "en"), (4, None, None), (5, "12 34", "en"), (6, "et voila les mots de la fin", "fr")]
    rows += [(10 + k, f"{words[k % 20]} text number {k} with some words of its own like {words[(3 * k) % 20]}{k}", "en") for k in range(20)]
    docs = spark.createDataFrame([(*r[:3], "s", None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        source = f"{tmp_path}/documents.parquet" if k == 0 else f"{tmp_path}/{k - 1}"
        found = stage(spark, spark.read.parquet(source), str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or found.columns == docs.columns, name
        found.write.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/{k}").collect()})
    ids = {r[0] for r in rows}
    assert set(seen[0]) == ids - {4, 5}
    assert set(seen[1]) == ids - {0, 4, 5}
    assert set(seen[2]) == ids - {0, 2, 4, 5}
    assert set(seen[3]) == set(seen[2]) == set(seen[4]) and "[EMAIL]" in seen[3][3]["text"]
    assert seen[3][3]["n_chars"] == len(seen[3][3]["text"])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in run.collect()} == set(seen[4])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, q_row int, key string"


def test_awkward_rows(spark, tmp_path):
    """Nulls, repeated ids, equal rows, a very long text and clashing columns go through all stages."""
    words = "the of and to in is that it was for on are with as his they at be this from".split()
    text = lambda k, n: " ".join(rng.choice(words) + rng.choice(["", "ing"]) for rng in [random.Random(k)] for _ in range(n))
    rows = [(k, text(k, 60 + k), "en") for k in range(30)] + [(3, text(3, 63), "en"), (3, text(41, 50), "en"), (None, text(42, 50), None), (None, None, None), (50, None, "en"), (51, "", "en")]
    rows += [(60, " ".join(f"{w}{i % 999}" for i, w in enumerate(words * 3000)), "en"), (61, "x" * 40_000, "en"), (62, "дом стол окно " * 30, "en"), (63, "1.2.3.4 " * 40, None)]
    docs = spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), "s", 1, "k") for i, t, lang in rows], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, str(tmp_path))
        found.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    left = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/3").collect()]
    assert sorted(x for x in left if x is not None and x < 30) == sorted([*range(30), 3]) and None in left and 60 in left and not {50, 51, 63} & set(left)
    assert {r["doc_id"] for r in docs.collect()} == set(left)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
