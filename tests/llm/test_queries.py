"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm.common import read
from tests.llm.test_models import brute_join
from tests.llm.test_texts import brute_lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_sharding", "op4_warc_zstd", "op5_line_dedup", "op7_jaccard_forest"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = con.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


def test_all_ten_and_the_pipeline_are_there():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline(spark):
    docs = read(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram jaccard join", "packing"]
    clean = stages["toxicity"](spark, docs, SF).cache()
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} < {r["doc_id"] for r in docs.select("doc_id").collect()}
    lines = stages["line dedup"](spark, clean, SF).cache()
    assert lines.schema == clean.schema
    want = brute_lines([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in lines.collect()) == sorted((i, t, len(t)) for i, _, _, t in want)
    kept = stages["n-gram jaccard join"](spark, lines, SF).cache()
    assert kept.columns == docs.columns
    alone = {root for _, _, root, _ in brute_join([(i, t) for i, _, _, t in want])}
    assert {r["doc_id"] for r in kept.collect()} == alone
    packed = stages["packing"](spark, kept, SF).collect()
    assert {r["doc_id"] for r in packed} == alone
    whole = corpus_pipeline.run(spark, SF).collect()
    pieces = lambda rows: sorted((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert pieces(whole) == pieces(packed)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows and ids, ties, a long text and clashing columns."""
    text = "one line that many documents hold\n" + " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, text, "en", "s", 1, "a"),
        (1, text, "en", "s", 1, "a"),
        (2, text.upper(), None, None, None, None),
        (3, None, None, None, None, None),
        (3, "", "en", "s", 0, "b"),
        (None, text, "en", "s", 2, "c"),
        (None, None, None, None, None, None),
        (4, "calm words and nothing else here " * 4000, "en", "s", 3, "d"),
        (4, "another text of the same id", "en", "s", 3, "d"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __gone string").withColumnRenamed("__gone", "gone")
    docs = docs.selectExpr("*", "source AS start", "lang AS `c0`")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF).cache()
        assert out.columns == docs.columns, name
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    # Document 2 loses both its lines to document 1, and is then a copy of the empty document 3.
    assert [k for k, _ in kept] == ["1", "2", "4", "None", "None"] and kept[1][1] == ""
    assert kept[2][1] == "another text of the same id" and kept[0][1] == text
    packed = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["start"] == 0) == [k for k, _ in kept]


def test_a_missing_wheel_is_not_swallowed(monkeypatch):
    import builtins
    import importlib

    plain = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "zstandard":
            raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")
        return plain(name, *args, **kwargs)

    import sys

    held = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("tessera.llm") or k == "corpus_pipeline"}
    try:
        monkeypatch.setattr(builtins, "__import__", without)
        with pytest.raises(ModuleNotFoundError, match="zstandard"):
            importlib.reload(entry)
    finally:
        monkeypatch.undo()
        sys.modules.update(held)
        importlib.reload(entry)
