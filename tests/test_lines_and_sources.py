"""Rasters as lines, running values in ranges, data sources and streams, on small tables with awkward rows."""

import random
import struct
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.operators import activity, blocks, catalog, raster, ranges, scanlines
from weftspark.plans import jobs
from weftspark.sources import dds, images
from weftspark.sources.tree import TreeSource
from weftspark.streaming import activity as streams

from test_files import png, sample, streamed

at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)


@pytest.fixture
def tiny_batches(spark):
    """Groups that go on over many batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def brute_resampled(image, target_height, target_width):
    def axis(n, m):
        return [[max(0, 2 * max(n, m) - abs((2 * i + 1) * m - (2 * o + 1) * n)) for i in range(n)] for o in range(m)]

    down, across = axis(image.shape[0], target_height), axis(image.shape[1], target_width)
    out = np.zeros((target_height, target_width), int)
    for oy, wy in enumerate(down):
        for ox, wx in enumerate(across):
            total = sum(wy) * sum(wx)
            s = sum(int(image[y, x]) * a * b for y, a in enumerate(wy) if a for x, b in enumerate(wx) if b)
            out[oy, ox] = (2 * s + total) // (2 * total)
    return out


def lines_of(spark, images_, names="v"):
    rows = [(key, y, *[list(map(int, image[y, :, k])) for k in range(len(names))]) for key, image in images_.items() for y in range(image.shape[0])]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "texture_id string, y int, " + ", ".join(f"{n} array<int>" for n in names)).repartition(3)


def test_resampling_in_bands_equals_brute_force(spark, tiny_batches):
    rng = np.random.default_rng(2)
    sizes = {"a": (5, 7, 150, 9), "b": (140, 3, 70, 3), "c": (1, 1, 4, 4), "d": (6, 6, 6, 6), "e": (9, 2, 1, 1), "f": (5, 7, 150, 9)}
    shown = {k: rng.integers(0, 256, (h, w, 2)) for k, (h, w, _, _) in sizes.items()}
    table = spark.createDataFrame([(k, w, h, tw, th) for k, (h, w, th, tw) in sizes.items()], "texture_id string, width int, height int, target_width int, target_height int")
    found = scanlines.resample_to(lines_of(spark, shown, "uv"), table, ("u", "v")).collect()
    assert len(found) == sum(s[2] for s in sizes.values())
    for k, (_, _, th, tw) in sizes.items():
        rows = sorted((r for r in found if r["texture_id"] == k), key=lambda r: r["y"])
        for n, c in enumerate("uv"):
            assert (np.array([r[c] for r in rows]) == brute_resampled(shown[k][..., n], th, tw)).all()


def test_blocks_of_strips_at_the_edges(spark, tiny_batches):
    """Encoding by strips equals encoding a whole image; missing texels have no say; ids may be structs."""
    rng = np.random.default_rng(3)
    shown = {str(k): rng.integers(0, 256, (h, w, 4)) for k, (h, w) in enumerate([(1, 1), (5, 6), (4, 4), (9, 17), (6, 6), (6, 6)])}
    lines = lines_of(spark, shown, "rgba")
    found = {r["texture_id"]["texture_id"]: bytes(r["payload"]) for r in blocks.bc3_payload(lines.withColumn("texture_id", F.struct("texture_id", F.lit(1).alias("level")))).collect()}
    whole = spark.createDataFrame([(k, v.shape[1], v.shape[0], v.astype(np.uint8).tobytes()) for k, v in shown.items()], "path string, width int, height int, rgba binary")
    assert found == {r["path"]: bytes(r["payload"]) for r in blocks.bc3_of_rasters(whole).collect()}
    one = raster.bc3_color(lines.where("texture_id = '1'")).where("by = 1 and bx = 1").first()
    edge = shown["1"][4:, 4:, :3].reshape(-1, 3)
    as_word = lambda c: (c[0] * 31 + 127) // 255 * 2048 + (c[1] * 63 + 127) // 255 * 32 + (c[2] * 31 + 127) // 255
    ends = {int(as_word([edge[:, 0].max() if a else edge[:, 0].min(), edge[:, 1].max(), edge[:, 2].max() if b else edge[:, 2].min()])) for a in (0, 1) for b in (0, 1)}
    assert one["c0"] in ends and one["c_bits"] < 1 << 4
    texels = scanlines.texels(lines, tuple("rgba"))
    assert {r["texture_id"]: bytes(r["payload"]) for r in blocks.bc3_payload(texels).collect()} == found
    assert scanlines.of_texels(texels, tuple("rgba")).exceptAll(lines).count() == 0


def test_encoding_shuffles_lines(spark):
    """No exchange takes a row for each texel."""
    plan = blocks.bc3_payload(lines_of(spark, {"a": np.zeros((8, 8, 4), int)}, "rgba"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_dds_lines_equal_texels(spark):
    shown = {f"/in/{k}.png": np.random.default_rng(k).integers(0, 256, (h, w, 4)) for k, (h, w) in enumerate([(3, 5), (8, 4)])}
    sizes = spark.createDataFrame([(k, v.shape[1], v.shape[0]) for k, v in shown.items()], "texture_id string, width int, height int")
    files = [jobs.dds_files(lines_of(spark, shown, "rgba"), sizes, fmt).select(F.concat(F.lit(fmt), "name").alias("texture_id"), "bytes") for fmt in ("DXT5", "8.8.8.8")]
    files = files[0].unionByName(files[1])
    mine, texels = scanlines.texels(raster.dds_lines(files), tuple("rgba")), raster.dds_texels(files)
    assert mine.count() == 2 * (15 + 32) and mine.exceptAll(texels.select(*mine.columns)).count() == 0


def test_strips_decode_as_blocks_do(spark):
    """Every format, both orders of corners and alphas, padding at the edges."""
    rng = np.random.default_rng(9)
    rows, blocks_of = [], []
    for k in range(24):
        kind, width, height = ("BC1", "BC2", "BC3")[k % 3], int(rng.integers(1, 11)), int(rng.integers(1, 8))
        size, across = (8 if kind == "BC1" else 16), -(-width // 4)
        for at_ in range(-(-height // 4)):
            data = rng.integers(0, 256, (across, size)).astype(np.uint8)
            rows.append((k, width, height, kind, at_, data.tobytes()))
            blocks_of += [(k, at_, bx, kind, data[bx].tobytes(), width, height) for bx in range(across)]
    mine = scanlines.texels(blocks.lines_of_strips(spark.createDataFrame(rows, "texture_id long, width int, height int, format string, at int, strip binary")), tuple("rgba"))
    each = spark.createDataFrame(blocks_of, "texture_id long, by int, bx int, format string, block binary, w int, h int")
    sizes = each.select("texture_id", "w", "h").distinct()
    theirs = blocks.decode_blocks(each.drop("w", "h")).join(sizes, "texture_id").where("x < w and y < h").select(*mine.columns)
    assert mine.count() == theirs.count() and mine.exceptAll(theirs).count() == 0


def entries(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([0, 0, 0, 1, None]), k, at(rng.randint(0, n * 20)) if rng.random() > 0.02 else None, rng.choice(["a", "b", None])) for k in range(n)]


@pytest.mark.parametrize("per", [(), ("task_id",), ("task_id", "part")])
def test_runs_in_ranges_equal_one_range(spark, per):
    """Whatever the ranges, the runs are those of one window over all entries; null keys, times and tones count as values."""
    rows = spark.createDataFrame(entries(400, 1), "task_id long, event_id long, ts timestamp, tone string").withColumn("part", F.col("event_id") % 3)
    found = {n: sorted(map(str, activity.collapse_runs(rows, 60, per=per, order=("ts", "event_id"), count=n).collect())) for n in (1, 2, 40)}
    assert found[1] == found[2] == found[40] and len(found[1]) > 50
    line = "order by ts, event_id" if not per else f"partition by {', '.join(per)} order by ts, event_id"
    rows.createOrReplaceTempView("entries")
    plain = spark.sql(f"""with b as (select *, lag(ts) over ({line}) as pts, lag(tone) over ({line}) as pt from entries),
      n as (select *, case when pts is null or unix_micros(ts) - unix_micros(pts) > 60000000 or not tone <=> pt then 1 else 0 end as new from b),
      r as (select *, sum(new) over ({line}) as run from n)
      select {''.join(c + ', ' for c in per)} run, tone, min(ts) as first_ts, max(ts) as last_ts, count(*) as repeats from r group by {''.join(c + ', ' for c in per)} run, tone""")
    assert sorted(map(str, plain.collect())) == found[1]
    assert activity.collapse_runs(rows.where("false"), 60, per=per, order=("ts", "event_id")).count() == 0


def test_a_hot_task_is_many_tasks_work(spark):
    rows = spark.range(4000).select(F.lit(1).alias("task_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7 % 4000).alias("ts"))
    spread = ranges.with_range(rows, "ts", 16).groupBy("_span").count().collect()
    assert len(spread) == 16 and max(r["count"] for r in spread) < 400
    found = activity.progress_view(rows, 16)
    assert [r["completed"] for r in found.join(rows, "event_id").orderBy("ts", "event_id").select("completed").collect()] == list(range(1, 4001))
    assert {r["total"] for r in found.collect()} == {4000}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = [n for n in found.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect() if n["count"]]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 1


def test_patches_count_whole_or_not_at_all(spark):
    rows = [(1, 1, "a", "1"), (1, 2, "a", "5"), (1, 2, "b", "bad"), (2, 1, "b", "3"), (2, 2, "b", None)]
    found = activity.fold_profiles(spark.createDataFrame(rows, "profile_id long, seq long, key string, value string"), ("a", "b")).orderBy("profile_id").collect()
    assert [(r["a"], r["b"]) for r in found] == [(1.0, None), (None, 3.0)]
    patches = [(1, 1, '{"name": "x", "size": 2}'), (1, 2, '{"name": "y", "size": "big"}'), (1, 3, '{"other": [1]}'), (2, 1, "[]"), (2, 2, None), (2, 3, "{"), (3, 1, '{"size": 2.5}'), (3, 2, '{"ratio": 3, "on": true}'), (4, 1, '{"name": null}')]
    settings = {"name": ("string", "none"), "size": ("bigint", 7), "ratio": ("double", 0.5), "on": ("boolean", False)}
    found = activity.fold_settings(spark.createDataFrame(patches, "profile_id long, seq long, patch string"), settings).orderBy("profile_id").collect()
    assert [tuple(r) for r in found] == [(1, 2, 1, "x", 2, 0.5, False), (2, 0, 3, "none", 7, 0.5, False), (3, 1, 1, "none", 7, 3.0, True), (4, 0, 1, "none", 7, 0.5, False)]


def test_dds_reader_reads_headers_and_first_levels_only(spark, tmp_path):
    shown = {f"/in/{k}.png": np.random.default_rng(k).integers(0, 256, (h, w, 4)) for k, (h, w) in enumerate([(4, 4), (8, 4), (16, 16)])}
    sizes = spark.createDataFrame([(k, v.shape[1], v.shape[0]) for k, v in shown.items()], "texture_id string, width int, height int")
    files = jobs.dds_files(lines_of(spark, shown, "rgba"), sizes, "8.8.8.8").withColumn("name", F.concat(F.lit("deep/er/"), "name"))
    assert jobs.save_files(jobs.Job(files, files), str(tmp_path / "out")) == 3
    for f in (tmp_path / "out" / "deep" / "er").iterdir():
        f.write_bytes(f.read_bytes() + b"levels" * 5000)
    (tmp_path / "out" / "bad.dds").write_bytes(b"DDS ")
    (tmp_path / "out" / "empty.dds").write_bytes(b"DDS " + struct.pack("<7I", 124, 0, 0, 4, 0, 0, 1) + b"\0" * 44 + struct.pack("<II4sI", 32, 4, b"DXT5", 0) + b"\0" * 36)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = lambda: spark.read.format("dds").option("partitionBytes", 40000)
    all_files = read().load(str(tmp_path / "out"))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in all_files.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"0.dds": "ok", "1.dds": "ok", "2.dds": "ok", "bad.dds": "not_dds", "empty.dds": "bad_size"}
    assert sum(r["bytes_read"] for r in rows.values()) == 3 * 128 + 4 * (16 + 32 + 256) + 4 + 128
    back = raster.dds_texels(all_files.select(F.col("path").alias("texture_id"), "bytes"))
    mine = {(r["texture_id"].rsplit("/", 1)[1], r["y"], r["x"]): (r["r"], r["g"], r["b"], r["a"]) for r in back.collect()}
    assert mine == {(f"{k}.dds", y, x): tuple(v[y, x]) for k, v in enumerate(shown.values()) for y in range(v.shape[0]) for x in range(v.shape[1])}
    heads = read().schema("path string, width int, bytes_read bigint").load(str(tmp_path / "out")).collect()
    assert sum(r["bytes_read"] for r in heads) == 4 * 128 + 4
    narrow = read().load(str(tmp_path / "out")).where("width <= 4 and status = 'ok' and length(path) > 3")
    assert {r["bytes_read"] for r in narrow.collect()} == {128 + 64, 128 + 128}
    same = raster.dds_info(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "out")).select("path", F.col("content").alias("bytes")))
    assert {r["path"].rsplit("/", 1)[1]: (r["width"], r["levels"], r["format"], r["status"]) for r in same.collect()} == {k: (r["width"], r["levels"], r["format"], r["status"]) for k, r in rows.items()}
    (tmp_path / "none").mkdir()
    assert read().load(str(tmp_path / "none")).count() == 0


def names_in(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_files_get_their_names_from_tasks(spark, tmp_path):
    """Nothing has a name before the commit; publishing can stop and go on; attempts that don't count leave nothing."""
    files = spark.createDataFrame([(f"d{k % 3}/f{k}.dds", bytes([k])) for k in range(20)], "name string, bytes binary").repartition(4)
    spark.dataSource.register(dds.DdsSource)
    folder = tmp_path / "out"
    files.write.format("dds").option("publish", "tasks").mode("append").save(str(folder))
    assert all(n.startswith(".attempts/") for n in names_in(folder))
    job = next(p for p in (folder / ".attempts").iterdir() if p.is_dir())
    (job / "lost").mkdir()
    (job / "lost" / "0").write_bytes(b"attempt of a lost task")
    manifest = (folder / ".attempts" / f"{job.name}.json").read_text()
    assert "lost" not in manifest
    first = next(p for p in job.iterdir() if p.name in manifest)
    (folder / "d0").mkdir()
    dds.move_out(str(folder), f".attempts/{job.name}/{first.name}")  # the driver was lost after some tasks had moved theirs
    assert dds.publish(spark, str(folder)) == 20 and dds.publish(spark, str(folder)) == 0
    assert names_in(folder) == sorted(f"d{k % 3}/f{k}.dds" for k in range(20))
    assert dds.save(files.limit(2), str(folder)) == 2 and len(names_in(folder)) == 20
    with pytest.raises(Exception, match="not a name"):
        dds.save(spark.createDataFrame([("../x", b"1")], "name string, bytes binary"), str(folder))
    assert len([n for n in names_in(folder) if not n.startswith(".attempts")]) == 20


def test_a_stream_writes_each_file_once(spark, tmp_path):
    import pyarrow as pa

    for fmt, size in (("8.8.8.8", 64), ("DXT5", 16)):
        source = tmp_path / f"in-{fmt}"
        source.mkdir()
        (source / "bad.png").write_bytes(b"no image")
        for k in range(3):
            (source / f"{k}.png").write_bytes(png(sample(4, 4), 6))
            files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(source))
            streams.dds_of_new_files(files, str(tmp_path / fmt), str(tmp_path / f"state-{fmt}"), fmt).awaitTermination(120)
            assert names_in(tmp_path / fmt) == [f"{j}.dds" for j in range(k + 1)]
        assert (tmp_path / fmt / "0.dds").stat().st_size == 128 + size
    # A batch that wrote and was lost before its commit runs again.
    folder = tmp_path / "again"
    batch = pa.RecordBatch.from_pydict({"name": ["a.dds"], "bytes": [b"x"]})
    lost, writer = dds.DdsStreamWriter(str(folder), "commit"), dds.DdsStreamWriter(str(folder), "commit")
    lost.write(iter([batch]))
    aborted = writer.write(iter([batch]))
    writer.abort([aborted, None], 0)
    done = writer.write(iter([batch]))
    writer.commit([done], 0)
    assert [n for n in names_in(folder) if not n.startswith(".attempts/" + lost.job)] == ["a.dds"]


def test_manifest_opens_its_files_only(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.dds").write_bytes(name.encode() * 9)
    (tmp_path / "c.dds").chmod(0)
    rows = [(0, "b.dds", 9), (1, f"file:{tmp_path}/a.dds", 9), (2, f"{tmp_path}/b.dds", 9), (3, "none.dds", 9)] * 2
    manifest = spark.createDataFrame([(k, p, n) for k, (_, p, n) in enumerate(rows)], "ord int, path string, length long").repartition(3)
    found = images.scan_list(spark, manifest, str(tmp_path), partition_bytes=20)
    assert found.columns == ["ord", "path", "length", "content"] and found.rdd.getNumPartitions() > 1
    assert [(r["ord"], bytes(r["content"])[:1]) for r in found.collect()] == [(0, b"b"), (1, b"a"), (2, b"b"), (4, b"b"), (5, b"a"), (6, b"b")]


def test_packages_of_a_real_root(spark, tmp_path):
    """Empty packages, sizes of all that is below, times of the packages' own directories, no plain files of the root."""
    import os

    for path, size in (("one/a.bin", 5), ("one/x/y/b.bin", 7), ("two.disabled/c.bin", 1)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"0" * size)
    (tmp_path / "empty").mkdir()
    (tmp_path / "note.txt").write_bytes(b"1")
    for k, name in enumerate(("one", "empty", "two.disabled")):
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    spark.dataSource.register(TreeSource)
    listing = spark.read.format("tree").option("entries", 1).load(str(tmp_path))
    found = catalog.list_packages(catalog.packages_of_paths(listing, str(tmp_path))).collect()
    assert sorted((r["name"], r["disabled"], r["bytes"], r["modified_at"].timestamp()) for r in found) == [("empty", False, 0, 1001.0), ("one", False, 12, 1000.0), ("two.disabled", True, 1, 1002.0)]


def test_runs_with_timers_equal_the_batch(spark, tmp_path):
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        rng = random.Random(5)
        first = [(rng.randint(0, 2), k, at(rng.randint(0, 3000) / 10), rng.choice("ab")) for k in range(500)]
        second = [(rng.randint(0, 2), 500 + k, at(200 + rng.randint(0, 3000) / 10), rng.choice("ab")) for k in range(300)]
        ends = [[(9, 1000, at(5000), "end")], [(9, 1001, at(5001), "end")], [(1, 1002, at(20), "z"), (9, 1003, at(9000), "end")]]
        schema = "task_id long, event_id long, ts timestamp, tone string"
        found = streamed(spark, tmp_path, [first, second, *ends], schema, lambda e: streams.runs_with_timers(e, 2, "5 minutes"), "timed")
        batch = activity.collapse_runs(spark.createDataFrame(first + second, schema), 2, per=("task_id",), order=("ts", "event_id")).collect()
        key = lambda r: (r["task_id"], r["tone"], r["first_ts"], r["last_ts"], r["repeats"])
        assert sorted(key(r) for r in found if r["tone"] != "end") == sorted(key(r) for r in batch) and len(batch) > 200
    finally:
        spark.conf.set(name, before)


def test_streamed_progress_of_running_tasks(spark, tmp_path):
    """Both sides are streams; progress shows while its task runs, what comes after the end never settles, late rows and old state go."""
    schema = "kind string, task_id long, event_id long, ts timestamp"
    batches = [
        [("start", 1, None, at(10)), ("p", 1, 1, at(5)), ("p", 1, 2, at(10)), ("p", 2, 3, at(12))],
        [("p", 1, 4, at(15)), ("start", 2, None, at(11)), ("p", 1, 5, at(31))],
        [("end", 1, None, at(30)), ("p", 2, 6, at(40))],
        [("p", 9, 7, at(100000)), ("start", 9, None, at(100000)), ("end", 8, None, at(100000))],
        [("p", 9, 8, at(100001)), ("start", 9, None, at(100001)), ("end", 8, None, at(100001))],
        [("p", 2, 9, at(41)), ("start", 1, None, at(9)), ("p", 9, 10, at(100002))],
    ]
    of = lambda e, kind, name: e.where(F.col("kind") == kind).select("task_id", F.col("ts").alias(name))
    both = lambda e: (e.where("kind = 'p'").select("task_id", "event_id", "ts"), of(e, "start", "start_ts"))
    live = streamed(spark, tmp_path / "live", batches, schema, lambda e: streams.running_progress(*both(e), "10 seconds", "1 hour"), "live")
    assert sorted((r["task_id"], r["event_id"]) for r in live if r["task_id"] < 9) == [(1, 2), (1, 4), (1, 5), (2, 3), (2, 6)]
    settled = streamed(spark, tmp_path / "settled", batches, schema, lambda e: streams.settled_progress(*both(e), of(e, "end", "end_ts"), "10 seconds", "1 hour"), "settled")
    rows = [r for b in batches[:3] for r in b]
    tasks = spark.createDataFrame([(1, at(10), at(30)), (2, at(11), at(99999))], "task_id long, start_ts timestamp, end_ts timestamp")
    batch = activity.in_task(spark.createDataFrame([r for r in rows if r[0] == "p"], schema), tasks)
    assert sorted((r["task_id"], r["event_id"]) for r in settled if r["task_id"] < 9) == sorted((r["task_id"], r["event_id"]) for r in batch.collect())


def test_state_of_streamed_progress_is_dropped(spark, tmp_path):
    """Rows leave both sides' state once the watermark has passed the longest time of a task."""
    schema, hours = "kind string, task_id long, event_id long, ts timestamp", 3600
    for k in range(8):
        rows = [(kind, 1, k * 10 + j, at(k * hours + j)) for j in range(10) for kind in ("p", "start")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    starts = events.where("kind = 'start'").select("task_id", F.col("ts").alias("start_ts"))
    made = streams.running_progress(events.where("kind = 'p'").select("task_id", "event_id", "ts"), starts, "10 seconds", "10 minutes")
    run = made.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in run.recentProgress]
    assert len(held) >= 8 and max(held) <= 60 and sum(o["numRowsRemoved"] for p in run.recentProgress for o in p["stateOperators"]) >= 100


def test_clear_colours_and_filters_of_png_files(spark):
    import zlib

    def file(color, pixels, clear, filters, depth=8):
        height, row = len(pixels), [np.array(p, ">u2" if depth == 16 else np.uint8).tobytes() for p in pixels]
        step = {0: 1, 2: 3}[color] * depth // 8
        lines, before = b"", bytes(len(row[0]))
        for kind, line in zip(filters, row):
            left, corner = bytes(step) + line, bytes(step) + before
            if kind == 1:
                out = [(v - left[i]) & 255 for i, v in enumerate(line)]
            elif kind == 3:
                out = [(v - (left[i] + before[i]) // 2) & 255 for i, v in enumerate(line)]
            elif kind == 4:
                out = []
                for i, v in enumerate(line):
                    p = left[i] + before[i] - corner[i]
                    out.append((v - min((left[i], before[i], corner[i]), key=lambda x: abs(p - x))) & 255)
            else:
                out = [(v - (before[i] if kind else 0)) & 255 for i, v in enumerate(line)]
            lines, before = lines + bytes([kind]) + bytes(out), line
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        width = len(row[0]) // step
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + (chunk(b"tRNS", clear) if clear else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    rng = np.random.default_rng(1)
    rgb, grey, deep = rng.integers(0, 3, (5, 21)), rng.integers(0, 4, (5, 6)), rng.integers(255, 259, (5, 6))
    rows = [("a.png", file(2, rgb, struct.pack(">3H", *rgb[2, 3:6]), [0, 1, 2, 3, 4])), ("b.png", file(0, grey, struct.pack(">H", 2), [4, 3, 1, 2, 0])), ("c.png", file(0, deep, struct.pack(">H", 257), [4, 4, 3, 1, 0], 16)), ("d.png", file(0, grey, b"", [4] * 5))]
    found = {r["path"]: np.frombuffer(r["rgba"], np.uint8).reshape(5, -1, 4) for r in images.decode(spark.createDataFrame(rows, "path string, content binary")).collect()}
    colors = rgb.reshape(5, 7, 3)
    assert (found["a.png"][..., :3] == colors).all() and (found["a.png"][..., 3] == np.where((colors == rgb[2, 3:6]).all(axis=-1), 0, 255)).all()
    assert (found["b.png"][..., 0] == grey).all() and (found["b.png"][..., 3] == np.where(grey == 2, 0, 255)).all()
    assert (found["c.png"][..., 0] == deep // 256).all() and (found["c.png"][..., 3] == np.where(deep == 257, 0, 255)).all()
    assert (found["d.png"][..., 3] == 255).all()
