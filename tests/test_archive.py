"""Rotation of long groups, and archive files with their index."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.operators import archive
from webloom.sources import warc_files


def greedy(rows, most):
    out, by = [], defaultdict(list)
    for g, o, n in rows:
        by[g].append((o, n))
    for g, each in by.items():
        segment = written = 0
        for o, n in sorted(each):
            if written and written + n > most:
                segment, written = segment + 1, 0
            out.append((g, o, segment, written))
            written += n
    return sorted(out)


@pytest.mark.parametrize("most", [1, 50, 1000, 10**9])
def test_long_groups_rotate_as_short_ones(spark, most):
    rng = random.Random(most)
    rows = [(g, o, rng.choice([0, 0, 1, 5, 30, 70])) for g, n in (("a", 400), ("b", 1), ("c", 60), ("d", 3)) for o in rng.sample(range(1000), n)] + [("z", i, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "part string, seq int, size bigint").withColumn("other", F.lit(1))
    long = archive.rotate_long(df, most).select("part", "seq", "segment", "offset")
    assert sorted(tuple(r) for r in long.collect()) == greedy(rows, most)
    # groups above a length of 50 go that way, others by a stream
    both = archive.rotate(df, most, stream=50)
    assert sorted((r.part, r.seq, r.segment, r.offset) for r in both.collect()) == greedy(rows, most) and both.columns[:4] == ["part", "seq", "size", "other"]
    assert archive.rotate_long(df.limit(0), most).count() == 0


def responses(spark, n=60):
    rows = [(f"http://a.example/{i}", b"GET / HTTP/1.1\r\n\r\n", f"HTTP/1.1 {200 + i % 3} OK\r\nContent-Type: text/html; charset=x\r\n\r\nbody {i} ".encode() + bytes(range(256)) * (i % 7), "revisit" if i % 5 == 0 else "response") for i in range(n)]
    df = spark.createDataFrame(rows, "url string, request binary, message binary, record_type string").withColumn("ts", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    return archive.warc_records(archive.with_digests(df)).repartition(3)


@pytest.mark.parametrize(("compressed", "most"), [(True, None), (True, 4000), (False, 20000)])
def test_index_rows_find_their_records(spark, tmp_path, compressed, most):
    folder = f"file://{tmp_path}/w"
    records = responses(spark)
    files = warc_files.write(records, folder, "x", compressed, most, ["isPartOf: here"]).collect()
    assert (len(files) > 3) == (most is not None) and all((tmp_path / "w" / f.file).stat().st_size == f.bytes for f in files)
    assert not list((tmp_path / "w").glob("_temporary*"))
    index = warc_files.read_index(spark, folder, "x")
    want = {(r.url, r.type, r.block_digest): bytes(r.body) for r in records.collect() if r.type != "request"}
    rows = index.collect()
    assert len(rows) == 60 and {(r.url, r.status, r.content_type, r.stamp) for r in rows} == {(f"http://a.example/{i}", 200 + i % 3, "text/html", "20240102030405") for i in range(60)}
    assert {(r.url, r.type, r.block_digest): bytes(r.body) for r in warc_files.records_at(index, folder).collect()} == want
    assert {r.size for r in rows} == {len(b) for b in want.values()}
    # all records, and those of a type alone
    every = warc_files.read(spark, folder)
    counts = {r.type: r["count"] for r in every.groupBy("type").count().collect()}
    assert counts == {"warcinfo": len(files), "request": 60, "response": 48, "revisit": 12} and sum(f.records for f in files) == every.count()
    assert every.where("type = 'warcinfo'").where(F.col("body").cast("string").contains("isPartOf: here")).count() == len(files)
    assert every.where("type in ('request', 'revisit') and type = 'revisit'").count() == 12


def test_a_job_that_fails_leaves_nothing_and_one_that_runs_again_one_copy(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    bad = responses(spark).withColumn("body", F.when(F.col("url") == "http://a.example/7", F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        warc_files.write(bad, folder)
    assert not list((tmp_path / "w").glob("*")) if (tmp_path / "w").exists() else True
    for mode in ("append", "overwrite"):
        warc_files.write(responses(spark), folder, mode=mode)
        assert warc_files.read(spark, folder).where("type = 'request'").count() == 60
    # a second attempt of a task leaves one copy: only files of committed attempts are moved
    writer = warc_files.WarcWriter({"path": folder, "stem": "y"}, False)
    hidden = tmp_path / "w" / f"_temporary-{writer.job}"
    for attempt in (0, 1):
        (hidden / f"0-{attempt}").mkdir(parents=True)
        (hidden / f"0-{attempt}" / "y-00000.warc.gz").write_bytes(b"%d" % attempt)
    writer.commit([warc_files.Written(str(hidden / "0-1"), [("y-00000.warc.gz", 1, 1)], None)])
    assert (tmp_path / "w" / "y-00000.warc.gz").read_bytes() == b"1" and not hidden.exists()


def test_no_records(spark, tmp_path):
    assert warc_files.write(responses(spark).limit(0), f"{tmp_path}/w").count() == 0
    assert warc_files.read(spark, f"{tmp_path}/w").count() == 0
