"""Every registered query that has SQL gives the same rows as DuckDB."""

import math

import pytest

from texts import TEXTS

from pairlake.plans import flagship
from pairlake.queries import ORACLES, QUERIES, lexical


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return None
        if isinstance(v, float):
            return round(v, 8)
        return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "year") else v

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def written_texts(spark, tmp_path_factory):
    """A folder whose documents are the hand-written texts, which the invented prose of the tables hardly reaches."""
    import duckdb

    top = str(tmp_path_factory.mktemp("texts"))
    odd = [(100, "Élan Vital and ÉCHPA met the FED in São Paulo.", ""), (101, "net sales rose 5 percent, driven by demand for oil as prices surged to $90.", "")]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t, _ in [*TEXTS, *odd]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, "cached")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(r[0], r[0] % 2) for r in rows if r[0] % 11], "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet/*.parquet'")
    return top, c


GATES = sorted((set(lexical.ORACLES) - {"collect_entities", "direction_filter"}) | {"rich_leak", "year_value_errors", "lead_relevance", "mda_drivers", "summarize", "scenario_fact"})


@pytest.mark.parametrize("name", GATES)
def test_gates_on_written_texts(spark, written_texts, name):
    top, c = written_texts
    got, want = QUERIES[name](spark, top).toPandas(), c.execute(ORACLES[name]).df()
    assert rows(got) == rows(want)


def test_answers_confirm_what_patterns_flag(spark, written_texts):
    """A leak needs both: some flagged text is confirmed, some is cleared, some has no answer; no other text is a leak."""
    got = QUERIES["semantic_leak_gate"](spark, written_texts[0]).toPandas()
    flagged = got[got.flagged]
    assert flagged.leak.any() and flagged.unknown.any() and (~flagged.leak & ~flagged.unknown).any()
    assert not got[~got.flagged].leak.any() and not (got.leak & got.unknown).any()


def test_flagship_like_sql(spark, duck, sf):
    assert rows(flagship.pairs(spark, sf).toPandas()) == rows(duck.execute(flagship.sql()).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_items_of_one_key_keep_their_answers(spark, tmp_path):
    """Equal prices and no texts: all items of a segment share histories and keys, not answers."""
    import datetime

    import duckdb

    days = [datetime.datetime(1996, 1, 1) + datetime.timedelta(i) for i in range(40)]
    made = {
        "orders": spark.createDataFrame([(i, i % 2, 100.25, d) for i, d in enumerate(days * 2)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp"),
        "customer": spark.createDataFrame([(0, "A"), (1, "B")], "c_custkey long, c_mktsegment string"),
        "documents": spark.createDataFrame([(1, None, "en", "src1")], "doc_id long, text string, lang string, source string"),
    }
    c = duckdb.connect()
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got, want = QUERIES["llmtime_cached"](spark, str(tmp_path)).toPandas(), c.execute(ORACLES["llmtime_cached"]).df()
    assert got.key.nunique() < len(got) and got.parsed.nunique() == 3 and rows(got) == rows(want)
