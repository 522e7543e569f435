"""Manifests, sizes, hashes and writers."""

import hashlib

import pytest

from gleaner.operators import tables as V
from gleaner.sources import tables as S


def test_manifests_and_hashes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"one")
    (tmp_path / "a" / "y.bin").write_bytes(b"three")
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in S.file_manifest(spark, f"{tmp_path}/a", True).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("x.bin", b"one"), ("y.bin", b"three"))}
    assert tuple(S.family_sizes(spark, {"index": f"{tmp_path}/a"}).first()) == ("index", 2, 8)
    assert S.config_hash({"b": 1, "a": [2]}) == S.config_hash({"a": [2], "b": 1}) != S.config_hash({"a": [2], "b": 2})
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    assert S.schema_hash(df) != S.schema_hash(df.select("b", "a"))
    f = S.fingerprint(df.unionByName(df), "t").first()
    assert (f.n_rows, f.columns) == (2, "a,b")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("w00", 0.5)], "config string, ndcg double")
    S.write_grid(df, f"{tmp_path}/grid")
    assert spark.read.csv(f"{tmp_path}/grid", header=True).columns == ["config", "ndcg"]
    with pytest.raises(Exception, match="already exists"):
        S.write_grid(df, f"{tmp_path}/grid")
    S.write_reports(df, df, df, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/diagnostics").count() == 1
    with pytest.raises(ValueError, match="missing required columns: z"):
        V.require_columns(df, ["config", "z"], "grid")
    V.assert_empty(df.limit(0), "nothing")
    with pytest.raises(ValueError, match="w00"):
        V.assert_empty(df, "something")
    assert {(r.column_name, r.n) for r in V.missing_values(spark.createDataFrame([(None, "\u00a0"), ("a", "b")], "a string, b string"), ["a", "b"], "t").collect()} == {("a", 1), ("b", 1)}
    assert V.key_duplicates(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k", "t").first().n == 1
