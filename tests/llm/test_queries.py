"""The registered queries on the smallest tables: against SQL where there is some, else against what their contracts say."""

import glob
import hashlib
import os

import duckdb
import pandas as pd
import pytest

from gridloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).replace({"nan": "-", "<NA>": "-", "None": "-"}).replace(r"\.0$", "", regex=True).to_numpy().tolist()))
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).fetchdf())


def test_repeats_of_the_corpus(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    got, seen = QUERIES["op7_repeats"](spark, SF).toPandas().set_index("doc_id"), set()
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        b = text.encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 99):
            h = hash(b[p : p + 100])
            if h in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(h)
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        assert (len(b), len(b) - len(kept), hashlib.sha256(kept).hexdigest()) == tuple(got.loc[doc, ["n_bytes", "n_removed", "kept_sha256"]])


def test_shards_and_mixture(spark):
    shards = QUERIES["op6_sharding"](spark, SF).toPandas()
    sizes = shards.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in shards.groupby("shard"))
    mixed = QUERIES["op9_mixing"](spark, SF).toPandas().merge(shards[["doc_id", "source"]])
    assert (mixed.taken <= 3 * mixed["size"]).all() and mixed.groupby("source").target.first().sum() == pytest.approx(mixed["size"].sum())
    for _, g in mixed.groupby("source"):
        assert 0 <= g.target.iloc[0] - g.taken.sum() <= g["size"].max()


def test_classifier_on_held_labels(spark):
    judged = QUERIES["op4_quality"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"))
    clean = judged[(judged.quality == 1) & (judged.toxic == 0)]
    assert clean.kept.mean() > 0.98 and judged[judged.quality == 0].kept.mean() < 0.2


def test_fingerprints_and_lines(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    prints = QUERIES["op8_fingerprints"](spark, SF).toPandas()
    assert len(prints) == len(docs) and prints.near_edited.mean() > prints.near_next.mean() + 0.3
    found = QUERIES["op2_lines"](spark, SF).toPandas()
    assert len(found) == len(docs) and found.n_removed.sum() > 0 and (found.n_removed <= found.n_lines).all()
