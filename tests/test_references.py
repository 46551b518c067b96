from datetime import datetime

from loamweave.operators import references as R

REF = "src_table string, rec_key string, ref_kind string, ref_value string, key string, at timestamp_ntz, month string"


def test_runs_are_contiguous_and_cut_at_spans(spark):
    keys = [(f"p{n:05d}",) for n in (1, 2, 3, 7, 8, R.SPAN - 1, R.SPAN)] + [("plain",), (None,), ("p00001",)]
    rows = R.key_runs(spark.createDataFrame(keys, "key string")).collect()
    assert sorted((r["first"], r["last"]) for r in rows if "p" in r.template and r.template != "plain") == [(1, 3), (7, 8), (R.SPAN - 1, R.SPAN - 1), (R.SPAN, R.SPAN)]


def test_orphans_equal_a_plain_anti_join(spark):
    parents = [f"a{n}b" for n in range(0, 300, 3)] + ["x", "a07b"]
    refs = [f"a{n}b" for n in range(320)] + ["x", "y", "", "a7b", "a07b", "a" + "9" * 40]
    got = R.orphan_keys(spark.createDataFrame([(r,) for r in refs * 2], "key string"), spark.createDataFrame([(p,) for p in parents], "key string"))
    assert sorted(r[0] for r in got.collect()) == sorted(set(refs) - set(parents))


def test_empty_parents_and_references(spark):
    none, some = spark.createDataFrame([], "key string"), spark.createDataFrame([("a1",), (None,)], "key string")
    assert [r[0] for r in R.orphan_keys(some, none).collect()] == ["a1"]
    assert R.orphan_keys(none, some).count() == 0


def test_faults(spark):
    t = lambda y: datetime(y, 1, 1)
    parents = spark.createDataFrame([("k1", False, t(2020)), ("k2", True, t(2020)), ("k3", False, t(2030)), ("k4", True, t(2020)), ("k4", False, t(2020)), ("k5", False, None)], "key string, deleted boolean, since timestamp_ntz")
    refs = spark.createDataFrame([("s", "r", "link", k or "bad", k, t(2025), "2025-01") for k in ("k1", "k2", "k3", "k4", "k5", "k6", None)], REF)
    assert {(r.ref_value, r.fault) for r in R.check_references(refs, parents).collect()} == {("k2", "deleted"), ("k3", "late"), ("k6", "missing"), ("bad", "missing")}


def test_spellings(spark):
    df = spark.createDataFrame([(" Title|x ", ".\\RAW/A.pdf", "wiki/assets/I.png"), ("#", "./raw/a.pdf", "I.png"), (None, None, "/srv/i.png"), ("a#b", " ", "assets/../i.png")], "l string, p string, i string")
    got = [tuple(r) for r in df.select(R.link_key(df.l), R.path_key(df.p), R.asset_key(df.i)).collect()]
    assert got == [("title", "raw/a.pdf", "assets/i.png"), (None, "raw/a.pdf", "assets/i.png"), (None, None, None), ("a", None, None)]
