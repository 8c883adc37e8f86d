"""File edges: decoding, the DDS sink, round trips, and the name rules with traps."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.functions import names
from weftspark.operators import activity, blocks, catalog, raster
from weftspark.plans import jobs
from weftspark.sources import images
from weftspark.streaming import activity as streams


def png(pixels: np.ndarray, color: int, depth: int = 8) -> bytes:
    height, width = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def sample(w: int, h: int) -> np.ndarray:
    y, x = np.mgrid[:h, :w]
    return np.stack([37 * x % 256, 59 * y % 256, 23 * (x + y) % 256, np.full_like(x, 255)], axis=2).astype(np.uint8)


def test_decode_and_scan(spark, tmp_path):
    picture = sample(4, 4)
    (tmp_path / "a.PNG").write_bytes(png(picture, 6))
    (tmp_path / "grey.png").write_bytes(png(picture[..., :1], 0))
    (tmp_path / "deep.png").write_bytes(png(np.array([[0x0A80]], ">u2"), 0, 16))
    (tmp_path / "t.tga").write_bytes(bytes([0, 0, 2] + [0] * 9) + struct.pack("<HHBB", 4, 4, 32, 32) + picture[..., [2, 1, 0, 3]].tobytes())
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_bytes(b"x")
    assert images.scan_images(spark, str(tmp_path)).count() == 5
    assert images.scan_images(spark, str(tmp_path / "none")).count() == 0
    files = spark.read.format("binaryFile").load(str(tmp_path)).where(names.is_image(F.col("path")))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.decode(files).collect()}
    assert bytes(rows["a.PNG"]["rgba"]) == picture.tobytes() == bytes(rows["t.tga"]["rgba"])
    assert bytes(rows["deep.png"]["rgba"]) == bytes([10, 10, 10, 255])
    assert rows["bad.png"]["status"] != "ok"
    texel = images.to_texels(images.decode(files)).where("texture_id like '%a.PNG' and y = 1 and x = 2").first()
    assert tuple(texel[3:]) == tuple(int(v) for v in picture[1, 2])


def test_rgba8_dds_round_trip(spark, tmp_path):
    picture = sample(4, 4)
    rows = [("/in/foo.v2.png", y, x, *map(int, picture[y, x])) for y in range(4) for x in range(4)]
    texels = spark.createDataFrame(rows, "texture_id string, y int, x int, r int, g int, b int, a int")
    sizes = spark.createDataFrame([("/in/foo.v2.png", 4, 4)], "texture_id string, width int, height int")
    files = jobs.convert_images(texels, sizes)
    spark.dataSource.register(images.DdsSource)
    files.write.format("dds").mode("append").save(str(tmp_path / "out"))
    data = (tmp_path / "out" / "foo.dds").read_bytes()
    assert len(data) == 128 + 64 and data[:4] == b"DDS " and data[128:] == picture.tobytes()
    back = jobs.dds_texels(files.select(F.col("name").alias("texture_id"), "bytes")).select("y", "x", "r", "g", "b", "a")
    assert sorted(map(tuple, back.collect())) == sorted(r[1:] for r in rows)


def test_bc3_keeps_dimensions_and_bounds_alpha(spark):
    picture = sample(8, 8)
    picture[..., 3] = np.arange(64).reshape(8, 8) * 4
    rows = [(1, y, x, *map(int, picture[y, x])) for y in range(8) for x in range(8)]
    texels = spark.createDataFrame(rows, "texture_id long, y int, x int, r int, g int, b int, a int")
    found = raster.bc3_decode(raster.bc3_alpha(texels.withColumn("v", F.col("a"))), raster.bc3_color(texels)).collect()
    assert {(r["y"], r["x"]) for r in found} == {(y, x) for y in range(8) for x in range(8)}
    assert max(abs(r["a"] - int(picture[r["y"], r["x"], 3])) for r in found) <= 16


def test_name_rules(spark):
    rows = spark.createDataFrame([("foo_n_c",), ("foo_c_n",), ("x.disabled.disabled",)], "n string")
    out = rows.select(names.split_prefix(F.col("n")).alias("p"), names.toggled(F.col("n")).alias("t"), names.display_name(F.col("n")).alias("d")).collect()
    assert [out[0]["p"], out[1]["p"], out[2]["t"], out[2]["d"]] == ["foo", "foo_c", "x", "x.disabled"]
    sizes = spark.createDataFrame([(10,), (1280,), (5 << 20,)], "b long").select(names.size_text(F.col("b"))).collect()
    assert [r[0] for r in sizes] == ["10 B", "1.3 KB", "5.0 MB"]


def test_resample_to_same_size_is_identity(spark):
    planes = spark.createDataFrame([(1, 0, 0, 7)], "texture_id int, y int, x int, v int")
    assert raster.resample(planes, 1, 1).collect() == planes.collect()


def test_delete_of_nothing(spark):
    packs = spark.createDataFrame([("a",)], "name string")
    _, done = catalog.delete(packs, spark.createDataFrame([("b",)], "name string"))
    assert [tuple(r) for r in done.collect()] == [("b", False)]


def test_stream_of_sessions(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(source).selectExpr("cast(ts as timestamp) as ts", "event_type as tone").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, tone string").parquet(str(tmp_path / "in"))
    run = streams.collapse_stream(events).writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("sessions").count() > 0


def test_block_colours_stay_near(spark):
    """Blocks of two colours and of gradients: the error of every channel is bounded by the palette's steps."""
    y, x = np.mgrid[:8, :8]
    picture = np.stack([x * 30, 255 - x * 30, np.full_like(x, 90), 16 * y + x], axis=2).astype(np.uint8)
    rows = [(1, j, i, *map(int, picture[j, i])) for j in range(8) for i in range(8)]
    texels = spark.createDataFrame(rows, "texture_id long, y int, x int, r int, g int, b int, a int")
    found = raster.bc3_decode(raster.bc3_alpha(texels.withColumn("v", F.col("a"))), raster.bc3_color(texels)).collect()
    far = [max(abs(r[c] - int(picture[r["y"], r["x"], k])) for r in found) for k, c in enumerate("rgba")]
    assert far[0] <= 20 and far[1] <= 20 and far[2] <= 8 and far[3] <= 8


def unpacked(format: str, block: bytes) -> list[tuple[int, ...]]:
    """The 16 texels of a block, step by step."""
    color = block if format == "BC1" else block[8:]
    words = struct.unpack("<HHI", color)
    wide = [((w >> 11) * 255 + 15) // 31 for w in words[:2]], [((w >> 5 & 63) * 255 + 31) // 63 for w in words[:2]], [((w & 31) * 255 + 15) // 31 for w in words[:2]]
    three = format == "BC1" and words[0] <= words[1]
    out = []
    for i in range(16):
        code = words[2] >> 2 * i & 3
        rgb = []
        for p, q in wide:
            rgb.append([p, q, (p + q) // 2 if three else (2 * p + q) // 3, 0 if three else (p + 2 * q) // 3][code])
        if format == "BC1":
            alpha = 0 if three and code == 3 else 255
        elif format == "BC2":
            alpha = (block[i // 2] >> 4 * (i % 2) & 15) * 17
        else:
            a, b, k = block[0], block[1], int.from_bytes(block[2:8], "little") >> 3 * i & 7
            levels = [a, b] + ([((7 - n) * a + n * b) // 7 for n in range(1, 7)] if a > b else [((5 - n) * a + n * b) // 5 for n in range(1, 5)] + [0, 255])
            alpha = levels[k]
        out.append((*rgb, alpha))
    return out


def test_decoding_of_block_formats(spark):
    rng = np.random.default_rng(11)
    rows = [(i, 0, 0, kind, rng.integers(0, 256, 8 if kind == "BC1" else 16, dtype=np.uint8).tobytes()) for i, kind in enumerate(("BC1", "BC2", "BC3") * 20)]
    found = blocks.decode_blocks(spark.createDataFrame(rows, "texture_id long, by int, bx int, format string, block binary")).collect()
    got = {(r["texture_id"], r["y"] * 4 + r["x"]): tuple(r[c] for c in "rgba") for r in found}
    assert got == {(i, k): t for i, _, _, kind, block in rows for k, t in enumerate(unpacked(kind, block))}


def pictured(spark, path: str, picture: np.ndarray, level: int | None = None):
    rows = [(path, y, x, *map(int, picture[y, x])) for y in range(picture.shape[0]) for x in range(picture.shape[1])]
    texels = spark.createDataFrame(rows, "texture_id string, y int, x int, r int, g int, b int, a int")
    return texels if level is None else texels.withColumn("level", F.lit(level))


def test_dds_files_have_the_size_of_their_blocks(spark):
    """Sizes that are no multiple of four; every file can be read back at its own size."""
    picture = sample(5, 7)
    sizes = spark.createDataFrame([("/in/odd.png", 5, 7)], "texture_id string, width int, height int")
    for fmt, size in (("DXT5", 2 * 2 * 16), ("R8G8B8A8_UNORM", 5 * 7 * 4)):
        files = jobs.convert_images(pictured(spark, "/in/odd.png", picture), sizes, fmt=fmt)
        row = files.first()
        assert row["name"] == "odd.dds" and len(row["bytes"]) == 128 + size
        back = raster.dds_texels(files.select(F.col("name").alias("texture_id"), "bytes"))
        assert {(r["y"], r["x"]) for r in back.collect()} == {(y, x) for y in range(7) for x in range(5)}
    with pytest.raises(ValueError):
        jobs.convert_images(pictured(spark, "/in/odd.png", picture), sizes, fmt="DXT9")
    assert len(jobs.convert_images(pictured(spark, "/in/odd.png", picture), sizes, fmt="DXT9", lenient=True).first()["bytes"]) == 128 + 64


def test_files_that_cannot_be_read(spark):
    rows = [("/in/a_c.dds", b"DDS " + bytes(200), 1), ("/in/b_c.dds", b"nothing", 2)]
    files = spark.createDataFrame(rows, "path string, bytes binary, ord int")
    done = jobs.split_files(files, on_error="collect")
    assert done.files.count() == 0 and [(r["ok"], r["message"]) for r in done.log.orderBy("ord").collect()] == [(False, "/in/a_c.dds: unsupported_format"), (False, "/in/b_c.dds: not_dds")]
    with pytest.raises(Exception, match="unsupported_format|not_dds"):
        jobs.split_files(files).files.collect()


def test_mip_chain_of_wrong_sizes_fails(spark):
    texels = pictured(spark, "t", sample(4, 4), 0).unionByName(pictured(spark, "t", sample(3, 2), 1))
    levels = spark.createDataFrame([("t", 0, 4, 4), ("t", 1, 3, 2)], "texture_id string, level int, width int, height int")
    with pytest.raises(Exception, match="2x2"):
        jobs.mip_files(texels, levels).files.collect()
    assert jobs.mip_files(texels, levels, on_error="collect").files.count() == 0
    good = pictured(spark, "t", sample(4, 4), 0).unionByName(pictured(spark, "t", sample(2, 2), 1)).unionByName(pictured(spark, "t", sample(1, 1), 2))
    sizes = spark.createDataFrame([("t", k, 4 >> k, 4 >> k) for k in range(3)], "texture_id string, level int, width int, height int")
    data = bytes(jobs.mip_files(good, sizes).files.first()["bytes"])
    assert len(data) == 128 + 3 * 16 and int.from_bytes(data[28:32], "little") == 3


def test_split_of_packed_files_to_images(spark, tmp_path):
    """Packed files to PNG and TGA files, which decode to the same channels."""
    picture = sample(4, 4)
    packed = jobs.convert_images(pictured(spark, "/in/rock_n.png", picture), spark.createDataFrame([("/in/rock_n.png", 4, 4)], "texture_id string, width int, height int"))
    files = packed.select(F.concat(F.lit("/in/"), "name").alias("path"), "bytes", F.lit(1).alias("ord"))
    for export in ("png", "TGA"):
        made = jobs.split_files(files, export).files
        out = images.encode(made, export).select(F.concat(F.lit("/x/"), "name").alias("path"), F.col("bytes").alias("content"))
        rows = {r["path"].split("/")[2].split(".")[0]: np.frombuffer(r["rgba"], np.uint8).reshape(4, 4, 4) for r in images.decode(out).collect()}
        assert set(rows) == {"rock_Roughness", "rock_Metallic", "rock_Normal"}
        assert (rows["rock_Roughness"][..., 0] == 255 - picture[..., 0]).all() and (rows["rock_Metallic"][..., 1] == picture[..., 2]).all()
        assert (rows["rock_Normal"] == np.stack([picture[..., 3], picture[..., 1], np.full((4, 4), 255), np.full((4, 4), 255)], axis=2)).all()
    assert jobs.split_files(files.withColumn("path", F.lit("/in/rock_c.dds")), export_alpha=False).files.count() == 1


def test_jpeg_files(spark, tmp_path):
    """A flat JPEG file, written by the JVM, and one that is none."""
    java = spark._jvm.java
    picture = java.awt.image.BufferedImage(16, 8, java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(8):
        for x in range(16):
            picture.setRGB(x, y, 200 << 16 | 100 << 8 | 50)
    spark._jvm.javax.imageio.ImageIO.write(picture, "jpg", java.io.File(str(tmp_path / "flat.jpg")))
    (tmp_path / "bad.jpg").write_bytes(b"nothing")
    pictures = spark.read.format("image").load(str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["status"], r["width"]) for r in images.picture_status(pictures).collect()) == [("bad.jpg", "not a picture", None), ("flat.jpg", "ok", 16)]
    texels = images.picture_texels(pictures).collect()
    assert len(texels) == 128 and all(abs(r["r"] - 200) < 4 and abs(r["g"] - 100) < 4 and abs(r["b"] - 50) < 4 and r["a"] == 255 for r in texels)


def test_files_of_levels_through_the_sink(spark, tmp_path):
    good = pictured(spark, "t", sample(4, 4), 0).unionByName(pictured(spark, "t", sample(2, 2), 1))
    sizes = spark.createDataFrame([("t", k, 4 >> k, 4 >> k) for k in range(2)], "texture_id string, level int, width int, height int")
    files = jobs.mip_files(good, sizes, fmt="8.8.8.8").files.withColumn("name", F.lit("Mipmap.dds"))
    spark.dataSource.register(images.DdsSource)
    files.write.format("dds").mode("append").save(str(tmp_path / "out"))
    data = (tmp_path / "out" / "Mipmap.dds").read_bytes()
    assert data[128:192] == sample(4, 4).tobytes() and data[192:] == sample(2, 2).tobytes()


def test_manifest_order_and_repeats(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.dds").write_bytes(name.encode())
    manifest = spark.createDataFrame([(0, f"{tmp_path}/b.dds"), (1, f"file://{tmp_path}/a.dds"), (2, f"{tmp_path}/b.dds")], "ord int, path string")
    assert [bytes(r["content"]) for r in images.scan_list(spark, manifest, str(tmp_path)).collect()] == [b"b", b"a", b"b"]


def test_import_stops_at_a_file_that_fails(spark):
    rows = [(1, "a", "dir", None), (2, "b", "dir", "no space"), (3, "c", "other", None), (4, "d", "file", "denied"), (5, "e", "dir", None)]
    sources = spark.createDataFrame(rows, "ord int, source string, kind string, error string")
    assert tuple(catalog.import_report(sources).first()) == (1, 1, "denied")
    with pytest.raises(Exception, match="denied"):
        catalog.import_outcome(sources).collect()


def test_runs_without_a_line_are_one_list(spark):
    entries = spark.createDataFrame([], "ts timestamp, tone string")
    assert activity.collapse_runs(entries, 1, per=()).count() == 0


def streamed(spark, tmp_path, batches, schema, make, name):
    """The rows of a stream over the batches, each a micro-batch of its own."""
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"raw{k}"))
        (part,) = (tmp_path / f"raw{k}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = make(events).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    return spark.table(name).collect()


def test_stream_of_runs_equals_the_batch(spark, tmp_path):
    """Entries out of order within the lateness; a sentinel closes the last runs, and a row later than the watermark is dropped."""
    from datetime import datetime, timedelta, timezone

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = lambda s: start + timedelta(seconds=s)
    first = [(1, 1, at(0), "a"), (1, 2, at(30), "a"), (2, 3, at(10), "b"), (1, 5, at(50), "b"), (1, 4, at(40), "a")]
    second = [(1, 6, at(300), "b"), (2, 7, at(45), "b"), (2, 8, at(290), "b")]
    third, fourth = [(9, 9, at(5000), "end")], [(9, 12, at(5100), "end")]  # rows are late by the watermark of the batch before
    late = [(1, 10, at(20), "z"), (9, 11, at(9000), "end")]
    schema = "task_id long, event_id long, ts timestamp, tone string"
    found = streamed(spark, tmp_path, [first, second, third, fourth, late], schema, lambda e: streams.collapse_runs_stream(e, 60, "5 minutes"), "runs")
    batch = activity.collapse_runs(spark.createDataFrame(first + second, schema), 60, per=("task_id",), order=("ts", "event_id")).collect()
    key = lambda r: (r["task_id"], r["tone"], r["first_ts"], r["last_ts"], r["repeats"])
    assert sorted(key(r) for r in found if r["tone"] != "end") == sorted(key(r) for r in batch)


def test_stream_drops_what_is_late_or_out_of_its_task(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    tasks = spark.createDataFrame([(1, at(10), at(20))], "task_id long, start_ts timestamp, end_ts timestamp")
    rows = [(1, at(5)), (1, at(10)), (1, at(20)), (1, at(21)), (2, at(15))]
    found = streamed(spark, tmp_path / "a", [rows], "task_id long, ts timestamp", lambda e: streams.progress_stream(e, tasks), "progress")
    assert sorted(r["ts"].timestamp() for r in found) == [at(10).timestamp(), at(20).timestamp()]
    batches = [[(at(0), "x")], [(at(4000), "y")], [(at(4001), "y")], [(at(1), "x")], [(at(9000), "end")]]  # the fourth is later than the watermark
    found = streamed(spark, tmp_path / "b", batches, "ts timestamp, tone string", lambda e: streams.collapse_stream(e, "1 minute", "10 seconds"), "late")
    assert sorted((r["tone"], r["repeats"]) for r in found) == [("x", 1), ("y", 2)]


def test_conversion_of_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.png").write_bytes(png(sample(4, 4), 6))
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "in"))
        run = streams.convert_new_files(files, lambda batch: images.decode(batch).select("path", "status"), str(tmp_path / "out"), str(tmp_path / "state"))
        run.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).where("status = 'ok'").count() == k + 1
