"""Archives of many frames, and games across any border."""

import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from plyframe.sources.archive import read_games
from plyframe.sources.linewise import read_games_linewise
from plyframe.sources.zstd_frames import frames_of, read_frames, scanned_frames, write_frames

SEP = "\n[Event "


def _games(n):
    return [f'[Event "League {i}"]\n[Site "s{i}"]\n[WhiteElo "{1000 + i}"]\n\n1. e4 e5 {i}. Nf3 {"é" * (i % 7)} *\n' for i in range(n)]


def _frames(text, sizes, **options):
    """Text cut at arbitrary bytes, a frame each."""
    data, out, at, i = text.encode(), b"", 0, 0
    while at < len(data):
        size = sizes[i % len(sizes)]
        out += zstandard.ZstdCompressor(**options).compress(data[at: at + size])
        at, i = at + size, i + 1
    return out


@pytest.mark.parametrize("sizes", [[37], [1, 200, 5], [10 ** 9]])
def test_no_record_is_lost_at_any_cut(spark, tmp, sizes):
    text = "\n".join(_games(14))
    path = os.path.join(tmp, "a.zst")
    with open(path, "wb") as f:
        f.write(_frames(text, sizes, write_checksum=len(sizes) > 1, write_content_size=sizes != [37]))
    want = text.split(SEP)
    for part in (1, 300, 10 ** 9):
        df = read_frames(spark, path, SEP, part)
        rows = sorted((r.record_id, r.value) for r in df.collect())
        assert [v for _, v in rows] == want, part
        assert part > 1 or df.rdd.getNumPartitions() == len(frames_of(path))


def test_skippable_frames_and_bad_files(tmp):
    path = os.path.join(tmp, "s.zst")
    frame = zstandard.ZstdCompressor().compress(b"x" * 100)
    with open(path, "wb") as f:
        f.write(frame + b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" + frame)
    assert frames_of(path) == [(0, len(frame)), (len(frame) + 11, len(frame))]
    for bad in (b"not zstd at all....", frame[:-3], frame + b"abc"):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(ValueError):
            frames_of(path)


def test_written_archives_have_many_frames_and_read_back(spark, tmp):
    games = _games(500)
    path = os.path.join(tmp, "out")
    write_frames(spark.createDataFrame([(g,) for g in games], "value string").repartition(3), path, frame_bytes=2000)
    files = [os.path.join(path, f) for f in os.listdir(path)]
    assert len(files) == 3 and all(len(frames_of(f)) > 3 for f in files)
    for f in files:
        with open(f, "rb") as s:
            assert scanned_frames(s, os.path.getsize(f)) == frames_of(f)  # the seek table says what is there
    got = read_games(spark, path, frames=True)
    assert sorted(r.s for r in got.select(F.element_at("headers", "Site").alias("s")).collect()) == sorted(f"s{i}" for i in range(500))
    assert read_games(spark, path).count() == 500  # Spark's own reader takes the same files


# -------------------------------------------------------------- linewise
def fold(text):
    """The line rules, one after another."""
    out, tags = [], {}
    for line in text.split("\n"):
        line = line.strip(" \t\n\x0b\x0c\r")
        if line.startswith("["):
            key, space, value = line.partition(" ")
            if space:
                tags[key[1:]] = value.strip('"]')
        elif line:
            out.append((dict(tags), line))
            tags = {}
    return out


def test_games_over_any_split(spark, tmp):
    rng = random.Random(5)
    lines = []
    for i in range(40):
        lines += [f'[{rng.choice(["Site", "Event", "Round"])} "v{i} {rng.choice("abc")}"]' for _ in range(rng.randrange(5))]
        lines += rng.choice([[], [""], ["", " "], ["[NoSpace]"]])
        lines += [f"1. e4 e5 {i}"] if rng.random() < 0.8 else []
    text = "\n".join(lines) + '\n[Site "left over"]\n'
    paths = []
    for i, t in enumerate((text, text.replace("\n", "\r\n"), "", "\n \n", '[Only "tags"]', "only moves\nand more")):
        paths.append(os.path.join(tmp, f"g{i}.pgn"))
        with open(paths[-1], "w", newline="") as f:
            f.write(t)
    old, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("61b", "400b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            rows = read_games_linewise(spark, paths).orderBy("game_id").collect()
            for i, path in enumerate(paths):
                with open(path, newline="") as f:
                    want = fold(f.read())
                assert [(r.headers, r.movetext) for r in rows if r.game_id.split("#")[0].endswith(f"g{i}.pgn")] == want, (size, i)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
