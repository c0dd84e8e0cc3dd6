"""Registered queries equal their SQL on the smallest data; the pipeline equals a brute-force one."""

import hashlib
import random

import duckdb
import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from orderloom.llm import decontaminate, oracles, queries
from test_operators import base_spans, brute_components, distance_inside, random_text, shingle_set

SF = "/root/testdata/sf0.001"


def test_all_queries_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) <= names and "pipeline" in names and set(oracles.all_sql()) <= names


@pytest.mark.parametrize("name", sorted(oracles.all_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toArrow()
    rel = con.sql(oracles.all_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(got.column_names) == cols
    a = sorted(zip(*[got.column(c).to_pylist() for c in cols]), key=str)
    assert a == sorted(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=str)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    texts, quality = [], []
    for i in range(120):
        t, good = random_text(rng, rng.randint(25, 60)), i % 5 > 0
        texts.append(t if good else "!! ".join(t.upper().split()))
        quality.append(int(good))
    leak = "an item of the benchmark that nobody should train on today"
    texts[1] += " " + leak.replace("nobody", "nobodi")
    texts[2] = texts[3] + " end"
    texts[4] = texts[3]
    texts[6] += " write to a.b@c.org or +1 (212) 555-0100 now"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, "en", "s", None), (501, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    scores = {r.doc_id: r.score for r in queries.quality_fm.score(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    left = [(r[0], r[1]) for r in rows if scores[r[0]] >= 0.7]
    assert {d for d, _ in left if d < 500} == {i for i, q in enumerate(quality) if q}
    left = [(d, t) for (d, t), c in zip(sorted(left), [c for _, _, c in sorted(brute_components(left, 5, 80), key=lambda x: x[0])]) if c == d]
    assert 4 not in dict(left) and 2 in dict(left) or 3 in dict(left)
    item = decontaminate.normal(leak)
    left = [(d, t) for d, t in left if distance_inside(item, decontaminate.normal(t or "")) > int(0.08 * len(item))]
    assert 1 not in dict(left)
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {}
    for d, t in left:
        t = t or ""
        for s, k, e, _ in sorted(base_spans(t), reverse=True):
            t = t[:s] + ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"][k] + t[e:]
        ids = lib.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert got == want and all(shingle_set(t, 5) or not t for _, t in left)
