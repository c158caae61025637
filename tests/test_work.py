"""Curation, telemetry, files, streaming, and the driver's contract."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from simgrove.functions import text
from simgrove.operators import curation, telemetry
from simgrove.sources import files
from simgrove.streaming import telemetry as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_licences(spark):
    d = spark.createDataFrame([(x,) for x in ("CC0 1.0", "cc-by_3.0", "https://creativecommons.org/licenses/by-nc/4.0/", "", None, "CC BY-SA 2.0", "creative  commons   attribution")], "v string")
    assert [r[0] for r in d.select(text.normalize_license(F.col("v"))).collect()] == ["CC0", "CC-BY", None, None, None, None, "CC-BY"]


def test_cache_url(spark):
    u = "https://example.org/x"
    got = spark.range(1).select(text.cache_url(F.lit(123), F.lit(u))).first()[0]
    assert got.endswith("/123/media/" + hashlib.md5(u.encode()).hexdigest())


def test_suffixes(spark):
    d = spark.createDataFrame([("image/PNG", "x"), (None, "http://a/b.TIFF?x=1"), ("image/tiff", "x"), (None, "http://a/b"), (None, "c.jpeg")], "c string, u string")
    assert [r[0] for r in d.select(text.suffix_for(F.col("c"), F.col("u"))).collect()] == [".png", ".tiff", ".tif", ".jpg", ".jpeg"]


def test_unequal_strata(spark):
    pool = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9)], "family string, k int")
    got = curation.round_robin_sample(pool, "family", ["k"], 3).orderBy("sample_index").collect()
    assert [(r["family"], r["k"]) for r in got] == [("a", 1), ("b", 9), ("a", 2)]
    assert curation.round_robin_sample(pool, "family", ["k"], 9, strict=False).count() == 4
    with pytest.raises(Exception, match="fewer than 9 valid rows: 4"):
        curation.round_robin_sample(pool, "family", ["k"], 9).collect()


def test_addresses_in_order_with_a_log(spark):
    d = spark.createDataFrame([(1, ["publisher/1", "media/1"]), (3, ["publisher/3"]), (4, []), (5, None)], "k int, at array<string>")
    got = {r["k"]: r for r in files.fetch_first(d, "at", files.demonstration_fetch).collect()}
    assert got[1]["address"] == "media/1" and bytes(got[1]["content"]) == b"media/1" and [(a["address"], a["ok"], a["reason"]) for a in got[1]["attempts"]] == [("publisher/1", False, "http_404"), ("media/1", True, None)]
    assert got[3]["address"] is None and len(got[3]["attempts"]) == 1 and got[4]["attempts"] == [] and got[5]["address"] is None


def test_null_metrics_stay_null(spark):
    d = spark.createDataFrame([(100, None)], "rss long, gpu double")
    r = telemetry.telemetry_summary(d, ["rss", "gpu"]).first()
    assert r["max_rss"] == 100 and r["mean_gpu"] is None and r["n_samples"] == 1


def test_one_value_has_no_spread(spark):
    r = telemetry.bench_stats(spark.createDataFrame([(1, 2.0)], "k int, v double"), "v", ["k"]).first()
    assert r["stdev"] == 0.0 and r["median"] == 2.0


def test_checksums_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("b.txt", "a.txt"):
        (tmp_path / "in" / n).write_text(n)
    files.write_checksums(files.checksums(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    got = files.read_checksums(spark, str(tmp_path / "out")).collect()
    assert [(r["path"], r["sha256"]) for r in got] == [(n, hashlib.sha256(n.encode()).hexdigest()) for n in ("a.txt", "b.txt")]


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    s = stream.read_stream(spark, str(tmp_path / "in"), e.schema, 100)
    q = stream.windowed_summary(s, "ts", "value", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = stream.windowed_summary(e, "ts", "value", "event_type")
    assert spark.table("windows").select("window_start", "key", "n").exceptAll(want.select("window_start", "key", "n")).count() == 0
    assert spark.table("windows").count() == want.count() > 0


@pytest.mark.parametrize("name", ["component_curve", "merge_events", "round_robin_sample", "normalize_license", "correlations", "validate_results", "validate_matrix", "verify_linkage", "critical_threshold", "src_json", "src_binary", "src_http_cache", "snk_npy", "utc_now", "threshold_snapshots"])
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    cols = rel.columns
    d = entry.queries()[name](spark, sf).select(*cols)
    assert sorted(map(repr, (tuple(r) for r in d.collect()))) == sorted(map(repr, rel.fetchall()))


def test_validate_results_finds_planted_faults(spark):
    cells = {(x, i, j): 1.0 if i == j else 0.5 for x in "ab" for i in range(3) for j in range(3)}

    def found(cells, metrics=(("a", 0.3, 0.5, 2.0), ("b", 0.3, 0.5, 2.0)), summary=("c", "m", 3), more=()):
        s = spark.createDataFrame([summary], "config_sha256 string, sample_manifest_sha256 string, n_samples long")
        m = spark.createDataFrame(list(metrics), "layer string, convergence_threshold double, critical_threshold double, critical_rate double")
        c = spark.createDataFrame([(*k, v) for k, v in cells.items()] + list(more), "layer string, i long, j long, similarity double")
        return {tuple(r) for r in curation.validate_results(s, m, c, ["a", "b"], 3, "c", "m").collect()}

    nan = float("nan")
    assert found(cells) == set()
    assert found(cells, summary=("x", None, 4)) == {(None, "config hash"), (None, "manifest hash"), (None, "sample count")}
    assert found(cells | {("b", 0, 1): nan, ("b", 1, 0): nan, ("a", 0, 2): 0.6}) == {("b", "not finite"), ("b", "not symmetric"), ("a", "not symmetric")}
    assert found({k: v for k, v in cells.items() if k != ("a", 2, 2)}, more=[("b", 0, 0, 1.0)]) == {("a", "shape"), ("b", "shape")}
    assert found({k: v for k, v in cells.items() if k[0] == "a"}, metrics=[("a", nan, None, float("inf")), ("z", 0.3, 0.5, 2.0)]) == {
        ("b", "missing layer"), ("z", "unexpected layer"), ("b", "missing matrix"), ("z", "missing matrix"), ("a", "invalid convergence_threshold"), ("a", "invalid critical_threshold"), ("a", "invalid critical_rate"),
    }


def test_stored_layer_results_are_valid(spark, sf):
    assert entry.queries()["validate_layer_results"](spark, sf).collect() == []


def test_matrix_is_judged_block_by_block(spark):
    """Counts of blocks are those of all cells listed: planted faults, a row and a column that are missing, a NaN vector."""
    import numpy as np

    from simgrove.operators import similarity

    rng = np.random.default_rng(4)
    v = rng.standard_normal((30, 5))
    v[3] = np.nan
    f = spark.createDataFrame([("a", k + 1, x.tolist()) for k, x in enumerate(v)] + [("b", 1, [1.0])], "layer string, sample_id long, features array<double>")

    def planted(i, j, s):
        return s + np.where((i + j) % 7 == 0, 2.0, 0.0) + np.where((i < j) & (i % 5 == 0), 0.1, 0.0), (i != 9) & (j != 11) & (j != 12)

    p = similarity.pair_similarity(f)
    i, j = F.col("i"), F.col("j")
    cells = p.unionByName(p.select("layer", j.alias("i"), i.alias("j"), "similarity")).unionByName(f.select("layer", F.col("sample_id").alias("i"), F.col("sample_id").alias("j"), F.lit(1.0).alias("similarity")))
    cells = cells.withColumn("similarity", F.col("similarity") + F.when((i + j) % 7 == 0, 2.0).otherwise(0.0) + F.when((i < j) & (i % 5 == 0), 0.1).otherwise(0.0)).filter((i != 9) & (j != 11) & (j != 12))
    want = sorted(map(tuple, curation.validate_matrix(cells).collect()))
    for block in (1000, 4):
        df = curation.validate_matrix_of(f, planted, block)
        assert sorted(map(tuple, df.collect())) == want and len(want) == 10


def test_stored_blocks_are_judged_like_cells(spark, tmp_path):
    """Blocks hold both halves: sound ones have no fault; a cell that is changed, not finite, missing or there twice is found."""
    import zlib

    import numpy as np

    rng = np.random.default_rng(9)
    f = spark.createDataFrame([(x, k, v.tolist()) for x in ("a", "b") for k, v in enumerate(rng.standard_normal((30, 4)))], "layer string, sample_id long, features array<double>")
    curation.matrix_blocks(f, 8).write.parquet(str(tmp_path / "blocks"))
    rows = [r.asDict() for r in spark.read.parquet(str(tmp_path / "blocks")).collect()]

    def facts(rows):
        return {r["layer"]: tuple(r)[1:] for r in curation.block_facts(spark.createDataFrame([tuple(r.values()) for r in rows], curation.STORED)).collect()}

    assert facts(rows) == {x: (30, 30, 900, 1, 0, 0) for x in "ab"}
    k = next(k for k, r in enumerate(rows) if r["layer"] == "b" and r["ids"] != r["jds"])
    bits = np.frombuffer(zlib.decompress(rows[k]["above"]), np.uint64).copy()
    assert not bits.any() and all(len(r["below"]) < 8 * 65 for r in rows)
    bits[3] = 1 << 62
    assert facts(rows[:k] + [rows[k] | {"above": zlib.compress(bits.tobytes())}] + rows[k + 1 :])["b"][5] == 2
    x = np.frombuffer(rows[k]["below"], np.uint8).reshape(8, -1).copy()
    x[:, 2] = np.frombuffer(np.float64(np.nan).tobytes(), np.uint8)
    assert facts(rows[:k] + [rows[k] | {"below": x.tobytes()}] + rows[k + 1 :])["b"][4:] == (2, 2)
    assert facts(rows + [rows[k]])["b"][3] == 2 and facts(rows[:k] + rows[k + 1 :])["b"][2] < 900
    assert facts(rows[:k] + [rows[k] | {"absent": [0]}] + rows[k + 1 :])["b"][2] == 898


def test_stored_blocks_are_read_back_and_dropped_one_by_one(spark, sf, tmp_path, monkeypatch):
    """Facts of blocks that tasks store, read and drop are those of blocks stored all together, with a vector that isn't finite; no block is left in files."""
    import numpy as np

    v = np.random.default_rng(9).standard_normal((30, 4))
    v[7] = np.nan
    f = spark.createDataFrame([(x, 3 * k, u.tolist()) for x in ("a", "b") for k, u in enumerate(v) if (x, k) != ("b", 7)], "layer string, sample_id long, features array<double>")
    curation.matrix_blocks(f, 8).write.parquet(str(tmp_path / "blocks"))
    want = {r["layer"]: tuple(r) for r in curation.block_facts(spark.read.parquet(str(tmp_path / "blocks"))).collect()}
    for block in (8, 512):
        assert {r["layer"]: tuple(r) for r in curation.stored_facts(f, block).collect()} == want
    assert want["b"][1:] == (29, 29, 29 * 29, 1, 0, 0) and want["a"][3] == 29 * 29 + 1
    from simgrove.plans import work

    seen = []
    monkeypatch.setattr(work, "folder", lambda spark, name: seen.append(str(tmp_path / name)) or seen[-1])
    assert work.validate_layer_results(spark, sf).collect() == [] and len(seen) == 1
    assert sorted(os.listdir(seen[0])) == ["metrics", "summary"]
