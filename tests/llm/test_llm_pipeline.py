"""The DuckDB gate of the SQL-checked queries, and the pipeline's stages against what each must keep."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from budgetlens.llm import bpe, queries
from budgetlens.llm.common import stored
from test_llm_text_ops import brute_components, brute_lines

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.SQL[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, SF).select(*want.column_names).collect()
    assert Counter(map(tuple, got)) == Counter(zip(*(c.to_pylist() for c in want.columns), strict=True))


def test_every_operator_is_registered_once():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"documents": {r.doc_id: r.text for r in docs.collect()}}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-pipeline")
        seen[name] = {r.doc_id: (r.decoded if name == "bpe" else r.text) for r in docs.collect()}
        assert name == "bpe" or docs.columns == columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic}
    gone = set(seen["documents"]) - set(seen["toxicity"])
    # 4 of the 51 labels mark junk without any toxic word (ids 259, 499, 850, 881)
    assert len(toxic & gone) >= 0.9 * len(toxic & set(seen["documents"])) and len(gone) < 0.2 * len(seen["documents"])
    assert seen["line_dedup"] == {i: t for i, _, _, t in brute_lines(list(seen["toxicity"].items()))}
    assert set(seen["jaccard_join"]) == {i for i, _, c in brute_components(list(seen["line_dedup"].items())) if i == c}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i, t in seen["jaccard_join"].items() if any(q in (t or "") for q in items)}
    assert holds and not holds & set(seen["decontaminate"])
    assert len(seen["decontaminate"]) >= len(seen["jaccard_join"]) - 2 * len(holds)
    assert seen["bpe"] == {i: t or "" for i, t in seen["decontaminate"].items()}


def test_pipeline_query_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    first = out.orderBy("doc_id").first()
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and first.n_tokens == len(first.ids)
    assert bpe.Encoder(bpe.tokenizer_bytes(corpus_pipeline.TOKENIZER)).decode(first.ids) == first.decoded
