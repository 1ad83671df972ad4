from factloom.operators import keyed

REF = "reference_id string, file_id string, source_symbol_id string, target_name string, target_symbol_id string"


def rows():
    out = [{"reference_id": f"r{i}", "file_id": f"f{i % 3}", "source_symbol_id": "s", "target_symbol_id": "hot"} for i in range(50)]
    out += [{"reference_id": f"n{i}", "file_id": None, "target_name": [" len ", "len", "\tlen"][i % 3]} for i in range(30)]
    out += [{"reference_id": f"e{i}", "target_name": "  "} for i in range(10)] + [{"reference_id": "u", "target_name": None}]
    out += [{"reference_id": f"x{i}", "target_name": f"t{i}"} for i in range(9)] + [{"reference_id": None, "target_name": "len"}]
    return out + out[:20]


def test_heavy(make):
    got = {tuple(r) for r in keyed.heavy_keys(make(REF, rows()), 0.25).select("key_field", "key_value", "n_references").collect()}
    assert got == {("target_symbol_id", "hot", 50), ("target_name", "len", 30)}


def test_profile(make):
    got = {r.key_value: (r.n_references, r.n_files, r.n_symbols, r.is_heavy) for r in keyed.key_profile(make(REF, rows()), 0.4).collect()}
    assert got["hot"] == (50, 3, 1, True) and got["len"] == (30, 0, 0, False) and len(got) == 11


def test_empty(make):
    assert keyed.heavy_keys(make(REF, [])).count() == 0 and keyed.key_profile(make(REF, [])).count() == 0


def test_threshold_is_inclusive(make):
    r = [{"reference_id": str(i), "target_name": "a" if i < 1 else f"b{i}"} for i in range(100)]
    assert keyed.heavy_keys(make(REF, r), 0.01).count() == 100


def test_top_n_of_a_hot_group(spark):
    from pyspark.sql import functions as F

    from factloom.operators.skew import top_n

    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("string").alias("g"), (F.col("id") % 97).alias("v"), "id")
    got = {(r.g, r.rank): (r.v, r.id) for r in top_n(df, ["g"], [F.desc("v"), F.asc("id")], 4, "id").collect()}
    for g in ("true", "false"):
        want = sorted(((-(i % 97), i) for i in range(3000) if (i % 3 == 0) == (g == "true")))[:4]
        assert [got[g, k] for k in range(1, 5)] == [(-v, i) for v, i in want]
