import random

import corpus_pipeline as P

from tests.llm.test_simhash import plain_fingerprint, roots_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def some_documents():
    rng = random.Random(9)
    words = "the of river stone light walk under about house green every number people water and sound".split()
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(n)) + "."
    base = [text(120) for _ in range(8)]
    texts = [None, "", " \n\t", "short", *base, *base[:3], *[b.replace("river", "rivers", 1) for b in base[3:6]], text(6000)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base[7], "en", "s1", 3)]


def test_one_of_each_group_stays(spark):
    rows = some_documents()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in P.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect() if r.text is not None)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    root = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for row, r in zip(rows, root):
        key = (row[0] is None, row[0] or 0)
        if r not in least or key < least[r][:2]:
            least[r] = (*key, row[1])
    assert got == sorted(x for x in least.values() if x[2] is not None)


def test_the_whole_pipeline_on_odd_rows(spark, tmp_path):
    rows = some_documents()
    spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "lang").write.parquet(str(tmp_path / "a" / "documents.parquet"))
    out = P.run(spark, str(tmp_path / "a")).collect()
    assert out and all(r.intact and r.n_tokens == len(r.ids) for r in out)
    assert {r.doc_id for r in out} <= {r[0] for r in rows}
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "b")).collect() == []
