"""Golden files for the text sources (IO1, IO2, IO3, IO6, IO7) with the edge
rows every text fixture needs: comment row, blank row, CRLF, no final
newline, repeated spaces, row with no delimiter, row with a missing field,
two rows for one key, 10.0.0.4 beside 10.0.0.41, node1 beside node10.
Host names and values are invented."""

import os

import pytest
from pyspark.sql import functions as F

from stackyard.functions.strings import member_of
from stackyard.operators.updates import upsert
from stackyard.sources import text as TX
from stackyard.sources.xml import overlay, read_xml_properties, write_xml_properties

HOSTS = ("# cluster hosts\r\n"
         "10.0.0.4 node1 alice\r\n"
         "\r\n"
         "10.0.0.41   node10 bob\r\n"
         "10.0.0.5 node2\r\n"
         "lonelyline\r\n"
         "10.0.0.4 node1b carol")  # no final newline


def _write(tmp_dir, name, text):
    p = os.path.join(tmp_dir, name)
    with open(p, "w", newline="") as f:
        f.write(text)
    return p


def test_read_delimited_edges(spark, tmp_dir):
    p = _write(tmp_dir, "hosts.txt", HOSTS)
    rows, rejects = TX.read_delimited(spark, p, ["ip", "hostname", "user"])
    got = sorted(((r.ip, r.hostname, r.user, r.complete) for r in rows.collect()), key=repr)
    assert got == sorted([
        ("10.0.0.4", "node1", "alice", True),
        ("10.0.0.41", "node10", "bob", True),      # repeated spaces are one separator
        ("10.0.0.5", "node2", None, False),        # missing field: NULL, flagged
        (None, None, None, False),                  # no delimiter: NULL, never the whole line
        ("10.0.0.4", "node1b", "carol", True),     # last line without newline is kept
    ], key=repr)
    assert rejects.count() == 2
    assert not any("\r" in (r.line or "") for r in rows.collect())  # CR stripped


def test_upsert_is_exact_key_not_prefix(spark, tmp_dir):
    p = _write(tmp_dir, "hosts.txt", HOSTS)
    rows, _ = TX.read_delimited(spark, p, ["ip", "hostname", "user"])
    base = rows.where("complete").select("ip", "hostname").withColumn("seq", F.lit(0))
    changes = spark.createDataFrame([("10.0.0.4", "node1c", 1), ("10.0.0.4", "node1d", 2)],
                                    "ip string, hostname string, seq int")
    out = upsert(base, changes, ["ip"], ["seq"])
    got = sorted((r.ip, r.hostname) for r in out.collect())
    # both rows of 10.0.0.4 replaced by the newest change; 10.0.0.41 untouched
    assert got == [("10.0.0.4", "node1d"), ("10.0.0.41", "node10")]
    again = upsert(out.withColumn("seq", F.lit(0)).select("ip", "hostname", "seq"), changes,
                   ["ip"], ["seq"])
    assert sorted((r.ip, r.hostname) for r in again.collect()) == got  # idempotent


def test_member_of_is_exact(spark):
    df = spark.createDataFrame([("node1", "node10,node2"), ("node1", "node2,node1"),
                                ("node10", "node1")], "node string, nodes string")
    got = [r.m for r in df.select(member_of("node", "nodes").alias("m")).collect()]
    assert got == [False, True, False]


def test_read_properties_crlf_comments_marker(spark, tmp_dir):
    text = ("# database settings\r\n"
            "driver org.example.Driver END\r\n"
            "url jdbc:example://db1/meta END\r\n"
            "\r\n"
            "user admin\r\n"
            "emptykey\r\n"
            "url jdbc:example://db2/meta END")
    p = _write(tmp_dir, "configs.txt", text)
    got = sorted((r.key, r.value) for r in TX.read_properties(spark, p).collect())
    assert got == [("driver", "org.example.Driver"), ("emptykey", None),
                   ("url", "jdbc:example://db1/meta"), ("url", "jdbc:example://db2/meta"),
                   ("user", "admin")]


def test_list_files_never_reads_content(spark, tmp_dir):
    for sub in ("a", "a/b"):
        os.makedirs(os.path.join(tmp_dir, sub), exist_ok=True)
    for name in ("a/x-1.0.tar.gz", "a/b/y-2.1.tar.gz", "a/readme.txt"):
        _write(tmp_dir, name, "data" * 10)
    df = TX.list_files(spark, tmp_dir, "*.tar.gz")
    assert sorted(r.name for r in df.collect()) == ["x-1.0.tar.gz", "y-2.1.tar.gz"]
    assert "content" not in df.columns
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_compressed_round_trip(spark, tmp_dir):
    nat = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    for codec in TX.CODECS:
        path = os.path.join(tmp_dir, codec)
        TX.write_text(nat, path, codec)
        back = TX.read_text(spark, path, nat.schema)
        assert back.exceptAll(nat).count() == 0 and nat.exceptAll(back).count() == 0


def test_xml_overlay_append_and_replace(spark, tmp_dir):
    base = spark.createDataFrame([("fs.defaultFS", "hdfs://node1:9000", None),
                                  ("io.file.buffer.size", "131072", "buffer")],
                                 "name string, value string, description string")
    extra = spark.createDataFrame([("io.file.buffer.size", "65536")], "name string, value string")
    path = os.path.join(tmp_dir, "core-site")
    write_xml_properties(base, path)
    write_xml_properties(extra, path, mode="append")
    back = read_xml_properties(spark, path)
    assert back.count() == 3  # appended: duplicates of a name stay
    replaced = overlay(base, extra, replace=True)
    assert sorted((r.name, r.value) for r in replaced.collect()) == [
        ("fs.defaultFS", "hdfs://node1:9000"), ("io.file.buffer.size", "65536")]


@pytest.mark.parametrize("splits", [1, 64])
def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path, splits):
    import random
    rng, files = random.Random(splits), {}
    for name in ("a.txt", "b.txt", "sub c.txt"):
        lines = [f"key{rng.randrange(40)} v{i}" + " x" * rng.randrange(30) + rng.choice(["", "\r"]) for i in range(700)]
        lines[5] = ""
        files[name] = [x.rstrip("\r") for x in lines]
        (tmp_path / name).write_bytes(("\n".join(lines) + ("\n" if name == "a.txt" else "")).encode())
    (tmp_path / "empty.txt").write_text("")
    size = sum((tmp_path / n).stat().st_size for n in files)
    saved = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(size // splits, 1) if splits > 1 else 1 << 27))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = TX.numbered_lines(spark, str(tmp_path))
        if splits > 1:
            assert df.rdd.getNumPartitions() > 1
        got = sorted((r.file.rpartition("/")[2].replace("%20", " "), r.line_no, r.line) for r in df.collect())
        assert got == sorted((n, i + 1, x) for n, xs in files.items() for i, x in enumerate(xs))
        first, per_file = {}, {}
        for name in sorted(files):
            for x in files[name]:
                if x:
                    key, value = x.split()[:2]
                    first.setdefault(key, value)
                    per_file.setdefault((key, name), value)
        looked = TX.lookup_properties(spark, str(tmp_path))
        assert {r.key: r.value for r in looked.collect()} == first
        each = TX.lookup_properties(spark, str(tmp_path), per_file=True).collect()
        assert {(r.key, r.file.rpartition("/")[2].replace("%20", " ")): r.value for r in each} == per_file
        some = TX.lookup_properties(spark, str(tmp_path), keys=["key3", "none"]).collect()
        assert [(r.key, r.value) for r in some] == [("key3", first["key3"])]
    finally:
        for c, v in saved.items():
            spark.conf.set(c, v)


def test_days_of_a_table_by_name_with_bounded_files(spark, tmp_path):
    import uuid

    from pyspark.sql import functions as F

    from stackyard.sources.sinks import overwrite_days_table
    name = f"days_{uuid.uuid4().hex[:8]}"
    rows = spark.range(0, 40_000, 1, 16).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("n"),
        F.sha2(F.col("id").cast("string"), 512).alias("pad")).withColumn("day", F.expr("date_add(DATE'2024-01-01', CAST(n AS INT))"))
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "200k")
        for _ in range(2):
            overwrite_days_table(rows, name, "day", path=str(tmp_path / "t"))
        overwrite_days_table(rows.where("n = 4 AND id % 2 = 0").select("day", "pad", "n", "id"), name, "day")
    finally:
        spark.conf.set(conf, before)
    back = spark.table(name)
    assert back.where("n <> 4").count() == rows.where("n <> 4").count()
    assert back.where("n = 4").count() == rows.where("n = 4 AND id % 2 = 0").count()
    files = {r.day: r.f for r in back.select("day", F.input_file_name().alias("at")).groupBy("day").agg(F.count_distinct("at").alias("f")).collect()}
    # the hot day is split (and what shares its reducer with it); a day is no file in every one of 16 tasks
    assert files[min(files)] == max(files.values()) > 1 and sum(files.values()) < 16 * len(files) / 2
    assert sum(f <= 4 for f in files.values()) > len(files) / 2
    spark.sql(f"DROP TABLE {name}")
