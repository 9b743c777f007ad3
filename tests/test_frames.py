"""The frame scan of video files and the writer of a file for each row, against bytes written here."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import files, frames


def write_video(path, n, w, h, space="420jpeg", seed=0):
    rng = np.random.default_rng(seed)
    luma = rng.integers(0, 256, (n, h, w), "u1")
    chroma = {"420jpeg": 2 * ((w + 1) // 2) * ((h + 1) // 2), "mono": 0, "444": 2 * w * h, "422": 2 * ((w + 1) // 2) * h}[space]
    head = f"YUV4MPEG2 W{w} H{h} F25:1 Ip A1:1 C{space}\n".encode()
    path.write_bytes(head + b"".join(b"FRAME\n" + y.tobytes() + rng.bytes(chroma) for y in luma))
    return luma


@pytest.fixture(scope="module")
def known(spark):
    frames.register(spark)
    return spark


def read(df):
    return {(r["video"], r["frame_id"]): np.frombuffer(bytes(r["pixels"]), "u1").reshape(r["h"], r["w"]) for r in df.collect()}


def test_frames_equal_the_bytes_written(known, tmp_path):
    made = {f"v{k}": write_video(tmp_path / f"v{k}.y4m", 10 + k, 7 + k, 5, space, k) for k, space in enumerate(("420jpeg", "mono", "444", "422"))}
    (tmp_path / "notes.txt").write_text("no video")
    df = known.read.format("y4m").option("frames", 4).load(str(tmp_path))
    got = read(df)
    assert set(got) == {(v, i) for v, a in made.items() for i in range(len(a))}
    assert all((got[v, i] == a[i]).all() for v, a in made.items() for i in range(len(a)))
    one = known.read.format("y4m").option("frames", 4).load(str(tmp_path / "v0.y4m"))
    assert one.rdd.getNumPartitions() == 3 and one.count() == 10


def test_options_and_filters_prune_what_is_read(known, tmp_path):
    made = write_video(tmp_path / "a.y4m", 50, 8, 6)
    write_video(tmp_path / "b.y4m", 50, 8, 6, seed=1)
    base = lambda: known.read.format("y4m").option("frames", 5)
    some = base().option("start", 7).option("end", 31).option("stride", 6).load(str(tmp_path)).where("video = 'a'")
    got = read(some)
    assert sorted(i for _, i in got) == [12, 18, 24, 30] and (got["a", 18] == made[18]).all()
    filtered = base().load(str(tmp_path)).where((F.col("frame_id") >= 10) & (F.col("frame_id") < 13) & (F.col("video") == "b"))
    assert sorted(read(filtered)) == [("b", 10), ("b", 11), ("b", 12)]
    reader = frames.Y4mReader({"path": str(tmp_path), "frames": "5"})
    rest = list(reader.pushFilters([frames.GreaterThan(("frame_id",), 41), frames.EqualTo(("video",), "a"), frames.EqualTo(("h",), 6)]))
    assert rest == [frames.EqualTo(("h",), 6)]
    assert [(p.video.name, p.first, p.last) for p in reader.partitions()] == [("a", 42, 47), ("a", 47, 50)]
    data = (tmp_path / "a.y4m").read_bytes()  # what lies outside a piece isn't even looked at
    head = data.index(b"FRAME\n")
    size = (len(data) - head) // 50
    (tmp_path / "a.y4m").write_bytes(data[: head + size] + b"x" * (30 * size) + data[head + 31 * size :])
    again = read(base().load(str(tmp_path)).where("video = 'a' and frame_id >= 31"))
    assert len(again) == 19 and (again["a", 40] == made[40]).all()
    with pytest.raises(Exception, match="isn't where the header puts it"):
        base().load(str(tmp_path)).where("video = 'a'").collect()


def test_videos_cut_off_empty_or_odd(known, tmp_path):
    write_video(tmp_path / "cut.y4m", 3, 4, 4)
    whole = (tmp_path / "cut.y4m").read_bytes()
    (tmp_path / "cut.y4m").write_bytes(whole[:-5])
    (tmp_path / "none.y4m").write_bytes(whole[: whole.index(b"\n") + 1])
    assert sorted(read(known.read.format("y4m").load(str(tmp_path)))) == [("cut", 0), ("cut", 1)]
    (tmp_path / "odd").mkdir()
    for k, bad in enumerate((b"", b"RIFF....", b"YUV4MPEG2 W4 H4 C420p10\nFRAME\n", b"YUV4MPEG2 W4 H4 Cmono16\nFRAME\n", b"YUV4MPEG2 W4 H4\nFRAME Ixyz\n" + bytes(24))):
        (tmp_path / "odd" / "x.y4m").write_bytes(bad)
        with pytest.raises(Exception, match="header|aren't read|fixed places"):
            known.read.format("y4m").load(str(tmp_path / "odd")).count()
        assert k < 5
    (tmp_path / "empty").mkdir()
    assert known.read.format("y4m").load(str(tmp_path / "empty")).count() == 0


def below(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def test_a_file_for_each_frame(known, tmp_path):
    made = write_video(tmp_path / "v.y4m", 6, 5, 4)
    root = tmp_path / "out"
    rows = known.read.format("y4m").option("frames", 2).load(str(tmp_path / "v.y4m")).withColumnRenamed("pixels", "classes")
    frames.class_files(rows).write.format("frame_files").mode("append").save(str(root))
    assert below(root) == [f"v/frame_{i}.png" for i in range(6)]
    seen = {r["path"].rsplit("_", 1)[1]: r for r in files.images(known, str(root), "*.png").collect()}
    assert all((np.frombuffer(bytes(seen[f"{i}.png"]["pixels"]), "u1").reshape(4, 5) == made[i]).all() for i in range(6))
    copies = files.image_files(known, str(root), "*.png").select(F.concat(F.lit("fold0/"), F.element_at(F.split("path", "/"), -1)).alias("path"), "content")
    copies.where("path like '%3.png'").write.format("frame_files").mode("append").save(str(root))
    assert len(below(root)) == 7 and (root / "fold0/frame_3.png").read_bytes() == (root / "v/frame_3.png").read_bytes()
    known.createDataFrame([("only.bin", bytearray(b"x")), ("empty.bin", None)], "path string, content binary").write.format("frame_files").mode("overwrite").save(str(root))
    assert below(root) == ["empty.bin", "only.bin"]


def test_an_aborted_job_leaves_nothing(known, tmp_path):
    root = tmp_path / "out"
    rows = known.range(20).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 13, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"data")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("frame_files").mode("append").save(str(root))
    for _ in range(50):  # tasks that still run when the job ends notice it
        if not root.exists() or below(root) == []:
            break
        time.sleep(0.1)
    assert not root.exists() or below(root) == []
    for bad in (["../x"], ["/x"], ["a", "a"]):
        with pytest.raises(Exception, match="below the root|two rows"):
            known.createDataFrame([(p, bytearray(b"1")) for p in bad], "path string, content binary").write.format("frame_files").mode("append").save(str(root))
    assert not root.exists() or below(root) == []


def test_a_retried_task_gives_one_file(tmp_path):
    """An attempt that failed after it wrote isn't among the messages, so it leaves nothing."""
    from pyspark.sql import Row

    writer = frames.FrameWriter(str(tmp_path), overwrite=False)
    writer.write(iter([Row(path="a", content=b"lost")]))
    kept = writer.write(iter([Row(path="a", content=b"kept")]))
    writer.commit([kept, None])
    assert below(tmp_path) == ["a"] and (tmp_path / "a").read_bytes() == b"kept"
