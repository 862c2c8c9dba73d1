"""Storage layout, the counts view, ledger and month catalogue, batch and streaming ingest."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plyframe.operators.counts import count_moves, merge_counts
from plyframe.operators.extract import extract_positions
from plyframe.operators.qualify import qualify_games
from plyframe.operators.recommend import top_moves
from plyframe.schemas import COUNTS
from plyframe.sources.archive import read_games
from plyframe.sources.storage import (compact_month, counts_view, current_loads, head_rows, merge_months,
                                      read_counts, read_merged, read_monthly, read_positions, row_at,
                                      write_bucketed_counts, write_month, write_positions, write_sorted)
from plyframe.streaming.ingest import (add_to_ledger, ingest, ingest_stream, list_months, load_ledger,
                                       pending_months)

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"
GAME = ('[Event "Rated Blitz game"]\n[WhiteElo "1500"]\n[BlackElo "1450"]\n[Termination "Normal"]\n\n'
        '1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 1-0\n\n')


def _archive(tmp, month, n=3, sub=""):
    d = os.path.join(tmp, sub) if sub else tmp
    os.makedirs(d, exist_ok=True)
    path = os.path.join(d, f"games_{month}.pgn")
    with open(path, "w") as f:
        f.write(GAME * n)
    return path


def test_positions_file_cap(spark, tmp):
    rows = [("Rated Blitz game", 1500, START, "e4")] * 25
    df = spark.createDataFrame(rows, "event string, player_elo_bucket int, base_fen string, move_san string")
    out = os.path.join(tmp, "pos")
    write_positions(df.coalesce(1), out, max_records=10)
    files = glob.glob(os.path.join(out, "*.parquet"))
    assert len(files) == 3 and read_positions(spark, out).count() == 25


def test_sorted_table_and_pushed_lookup(spark, tmp):
    rows = [(f"fen{i:04d}", 1500, "m", i) for i in range(400)]
    path = os.path.join(tmp, "merged")
    write_sorted(spark.createDataFrame(rows, COUNTS), path, partitions=4)
    ranges = []
    for f in sorted(glob.glob(os.path.join(path, "*.parquet"))):
        col = pq.read_table(f, columns=["base_fen"]).column(0).to_pylist()
        if col:
            assert col == sorted(col)
            ranges.append((col[0], col[-1]))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # disjoint key ranges
    lookup = top_moves(read_counts(spark, path), "fen0123", normalise=False)
    plan = lookup._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(base_fen,fen0123)" in plan
    assert lookup.first().plays == 123


def test_bucket_partition_pruning(spark, tmp):
    rows = [(START, b, "e4", 1) for b in (1400, 1500, 1600)]
    path = os.path.join(tmp, "bucketed")
    write_bucketed_counts(spark.createDataFrame(rows, COUNTS), path)
    assert sorted(d for d in os.listdir(path) if d.startswith("player_elo_bucket=")) == [
        "player_elo_bucket=1400", "player_elo_bucket=1500", "player_elo_bucket=1600"]
    df = spark.read.parquet(path).filter(F.col("player_elo_bucket") == 1500)
    assert "PartitionFilters: [isnotnull(player_elo_bucket" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1


def test_counts_view_sees_new_months(spark, tmp):
    monthly, merged = os.path.join(tmp, "monthly"), os.path.join(tmp, "merged")
    assert counts_view(spark, merged, monthly) is None
    c = spark.createDataFrame([(START, 1500, "e4", 2)], COUNTS)
    write_month(c, monthly, "2024-01")
    assert merge_counts(counts_view(spark, merged, monthly)).first().times_played == 2
    merge_months(spark, monthly, merged)
    write_month(c, monthly, "2024-02")  # written after the merge
    assert merge_counts(counts_view(spark, merged, monthly)).first().times_played == 4
    assert merge_counts(counts_view(spark, merged, monthly, prefer="merged_first")).first().times_played == 2
    write_month(c, monthly, "2024-02")  # rewrite of a month replaces it
    assert merge_counts(counts_view(spark, merged, monthly)).first().times_played == 4


def test_head_and_keyed_row(spark):
    df = spark.range(100).withColumn("k", F.col("id") * 3)
    assert head_rows(df, 10).count() == 10
    assert [row_at(df.repartition(5), i, "k").first().k for i in (0, 35, 99)] == [0, 105, 297]
    assert row_at(df, 100, "k").count() == 0 and row_at(df.limit(0), 0, "k").count() == 0


def test_ledger_is_a_set_in_order(spark, tmp):
    path = os.path.join(tmp, "ledger")
    assert load_ledger(spark, path).isEmpty()
    for run in (["2031-11"], ["2030-04", "2031-11"], []):
        got = add_to_ledger(spark, path, spark.createDataFrame([(m,) for m in run], "year_month string"))
    assert [r.year_month for r in got.collect()] == ["2030-04", "2031-11"]


def test_archive_links_of_a_listing(spark):
    pages = spark.createDataFrame([
        ("<li><a href=\"dump/plays_2031-11.pgn.zst\">x</a> 2030-04 <a href='q_2029-01.pgn.zst'>single quotes</a></li>",),
        ('<a href="b_2030-04.pgn.zst"></a><a href="a_2030-04.pgn.zst"></a><a href="c_2030-4.pgn.zst"></a>',),
        ('<a href="notes_2031-12.txt"></a><a href="a/b/c_2031-10.pgn.zst"></a>',), (None,), ("",)], "html string")
    got = [(r.year_month, r.url.rsplit("/", 1)[1]) for r in list_months(pages).collect()]
    assert sorted(got) == [("2030-04", "a_2030-04.pgn.zst"), ("2031-11", "plays_2031-11.pgn.zst")]
    done = spark.createDataFrame([("2031-11",)], "year_month string")
    assert [r.year_month for r in pending_months(list_months(pages), done, 5).collect()] == ["2030-04"]


def _total(df):
    return 0 if df is None else df.agg(F.sum("times_played")).first()[0] or 0


def test_a_full_load_replaces_the_month_whatever_wrote_it(spark, tmp):
    root = os.path.join(tmp, "monthly")
    c = lambda n: spark.createDataFrame([(START, 1500, "e4", n)], COUNTS)
    write_month(c(1), root, "2030-01", part="a")
    write_month(c(2), root, "2030-01", part="b")
    write_month(c(9), root, "2030-02", part="a")
    assert _total(read_monthly(spark, root)) == 12
    write_month(c(4), root, "2030-01", part="b")
    assert _total(read_monthly(spark, root)) == 14
    write_month(c(7), root, "2030-01")
    assert _total(read_monthly(spark, root)) == 16
    write_month(c(3), root, "2030-01", part="c")  # newer than the full load: added
    assert _total(read_monthly(spark, root)) == 19
    compact_month(spark, root, "2030-01")
    assert _total(read_monthly(spark, root)) == 19 and current_loads(spark, root).count() == 2
    write_month(c(1).limit(0), root, "2030-01")  # an empty month replaces as well
    assert _total(read_monthly(spark, root)) == 9


def test_view_after_a_covered_month_is_replaced(spark, tmp):
    root, merged = os.path.join(tmp, "monthly"), os.path.join(tmp, "merged")
    c = lambda n: spark.createDataFrame([(START, 1500, "e4", n)], COUNTS)
    write_month(c(2), root, "2030-01")
    write_month(c(5), root, "2030-02")
    assert _total(merge_months(spark, root, merged)) == 7
    write_month(c(10), root, "2030-01")
    assert _total(counts_view(spark, merged, root)) == 15
    assert _total(read_merged(spark, merged)) == 7 == _total(counts_view(spark, merged, root, prefer="merged_first"))
    merge_months(spark, root, merged)
    write_month(c(1), root, "2030-03")
    assert _total(counts_view(spark, merged, root)) == 16


def test_merged_data_without_a_finished_version_is_an_error(spark, tmp):
    root, merged = os.path.join(tmp, "monthly"), os.path.join(tmp, "merged")
    c = spark.createDataFrame([(START, 1500, "e4", 2)], COUNTS)
    write_month(c, root, "2030-01")
    write_sorted(c, merged)
    with pytest.raises(ValueError, match="no finished version"):
        counts_view(spark, merged, root)


def test_one_archive_through_both_paths_and_a_new_checkpoint(spark, tmp):
    src = os.path.join(tmp, "src")
    path = _archive(src, "2030-05", n=4)
    monthly = os.path.join(tmp, "monthly")
    archives = spark.createDataFrame([("2030-05", path)], "year_month string, path string")
    ingest(spark, archives, monthly)
    want = _total(read_monthly(spark, monthly))
    assert want == 4 * 6
    _archive(src, "2030-06", n=1)
    for name, files in (("c1", None), ("c2", 1)):
        ingest_stream(spark, src, monthly, os.path.join(tmp, name), max_files_per_trigger=files)
        assert _total(read_monthly(spark, monthly)) == want + 6
    ingest(spark, archives, monthly)
    assert _total(read_monthly(spark, monthly)) == want + 6


def test_high_ratings_count_alike_on_every_path(spark, tmp):
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    path = os.path.join(src, "games_2030-07.pgn")
    with open(path, "w") as f:
        f.write(GAME.replace("1500", "4100").replace("1450", "5200"))
    monthly, kept = os.path.join(tmp, "monthly"), os.path.join(tmp, "kept")
    archives = spark.createDataFrame([("2030-07", path)], "year_month string, path string")
    report = ingest(spark, archives, monthly).first()
    direct = count_moves(extract_positions(qualify_games(read_games(spark, path))))
    assert _total(read_monthly(spark, monthly)) == _total(direct) == report.positions
    assert report.files == 1 and report.seconds > 0
    ingest(spark, archives, kept, buckets=(600, 4200))
    assert _total(read_monthly(spark, kept)) == _total(direct.filter("player_elo_bucket between 600 and 4200"))


def test_batch_ingest_is_idempotent(spark, tmp):
    paths = [_archive(tmp, "2024-01"), _archive(tmp, "2024-02", n=2)]
    archives = spark.createDataFrame([("2024-01", paths[0]), ("2024-02", paths[1])], "year_month string, path string")
    monthly = os.path.join(tmp, "monthly")
    for _ in range(2):
        report = ingest(spark, archives, monthly)
    assert [(r.year_month, r.status) for r in report.collect()] == [("2024-01", "done"), ("2024-02", "done")]
    assert [(r.games_scanned, r.games_kept, r.positions) for r in report.collect()] == [(3, 3, 18), (2, 2, 12)]
    assert [r[0] for r in load_ledger(spark, monthly).collect()] == ["2024-01", "2024-02"]
    view = merge_counts(counts_view(spark, None, monthly))
    e4 = view.filter((F.col("base_fen") == START) & (F.col("move_san") == "e4")).first()
    assert e4.times_played == 5


def test_stream_ingest_twice_equals_once(spark, tmp):
    src = os.path.join(tmp, "src")
    _archive(src, "2024-01")
    monthly, ckpt = os.path.join(tmp, "monthly"), os.path.join(tmp, "ckpt")
    ingest_stream(spark, src, monthly, ckpt)
    _archive(src, "2024-02", n=2)
    ingest_stream(spark, src, monthly, ckpt)
    ingest_stream(spark, src, monthly, ckpt)
    got = merge_counts(counts_view(spark, None, monthly))
    batch = count_moves(extract_positions(qualify_games(read_games(spark, src))))
    assert sorted(got.collect()) == sorted(batch.collect())
    assert {r[0] for r in spark.read.parquet(monthly).select("month").distinct().collect()} == {"2024-01", "2024-02"}


def test_failed_month_does_not_stop_others(spark, tmp):
    good = _archive(tmp, "2024-03")
    bad = os.path.join(tmp, "games_2024-04.pgn.zst")
    with open(bad, "wb") as f:
        f.write(b"this is not zstd data at all")
    archives = spark.createDataFrame([("2024-03", good), ("2024-04", bad)], "year_month string, path string")
    monthly = os.path.join(tmp, "monthly")
    status = {r.year_month: r.status for r in ingest(spark, archives, monthly).collect()}
    assert status == {"2024-03": "done", "2024-04": "failed"}
    assert [r[0] for r in load_ledger(spark, monthly).collect()] == ["2024-03"]
    months = {r[0] for r in spark.read.parquet(monthly).select("month").distinct().collect()}
    assert months == {"2024-03"}


def test_update_run_caps_and_reports(spark, tmp):
    from plyframe.streaming.ingest import update_months
    archive_dir = os.path.join(tmp, "archives")
    for m in ("2024-01", "2024-02", "2024-03"):
        _archive(archive_dir, m)
    html = "".join(f'<a href="standard/games_{m}.pgn.zst">x</a>' for m in ("2024-01", "2024-02", "2024-03"))
    available = list_months(spark.createDataFrame([(html,)], "html string"))
    # Files on disk are plain text named like the listing's .zst links minus the suffix.
    available = available.withColumn("url", F.regexp_replace("url", r"\.zst$", ""))
    monthly = os.path.join(tmp, "monthly")
    pending, _ = update_months(spark, available, archive_dir, monthly, max_months=2, dry_run=True)
    assert [r.year_month for r in pending.collect()] == ["2024-01", "2024-02"]
    report, remaining = update_months(spark, available, archive_dir, monthly, max_months=2)
    assert [r.status for r in report.collect()] == ["done", "done"] and remaining == 1
    report, remaining = update_months(spark, available, archive_dir, monthly, max_months=2)
    assert [r.year_month for r in report.collect()] == ["2024-03"] and remaining == 0


def test_stream_month_split_over_files_and_batches(spark, tmp):
    src = os.path.join(tmp, "src")
    for i in range(3):
        _archive(os.path.join(src, f"x{i}"), "2024-05", n=i + 1)
    monthly, ckpt = os.path.join(tmp, "monthly"), os.path.join(tmp, "ckpt")
    ingest_stream(spark, src, monthly, ckpt, path_glob="*/*.pgn", max_files_per_trigger=1)
    e4 = merge_counts(counts_view(spark, None, monthly)).filter(
        (F.col("base_fen") == START) & (F.col("move_san") == "e4")).first()
    assert e4.times_played == 6
    parts = {r[0] for r in spark.read.parquet(monthly).select("part").distinct().collect()}
    assert len(parts) == 3
    from plyframe.streaming.ingest import stream_progress
    rows = stream_progress(spark, monthly).collect()
    assert sorted((r.games_scanned, r.games_kept, r.positions) for r in rows) == [(1, 1, 6), (2, 2, 12), (3, 3, 18)]


def test_batch_lookup_pushes_few_positions_into_the_scan(spark, tmp):
    from plyframe.operators.recommend import recommend
    rows = [(f"fen{i:04d}", 1500, "m", i) for i in range(400)]
    path = os.path.join(tmp, "merged")
    write_sorted(spark.createDataFrame(rows, COUNTS), path, partitions=4)
    reqs = spark.createDataFrame([(1, "fen0007", None, None), (2, "fen0300", None, None), (3, "fen0007", None, None)],
                                 "request_id long, fen string, elo_min string, elo_max string")
    out = recommend(reqs, read_counts(spark, path), key_is_fen=False, only=["fen0007", "fen0300"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "In(base_fen, [fen0007,fen0300])" in plan
    assert sorted((r.request_id, r.plays) for r in out.collect()) == [(1, 7), (2, 300), (3, 7)]


def test_stream_ingest_reads_zstd_archives(spark, tmp):
    import zstandard
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    with open(os.path.join(src, "games_2024-06.pgn.zst"), "wb") as f:
        f.write(zstandard.ZstdCompressor().compress((GAME * 4).encode()))
    monthly, ckpt = os.path.join(tmp, "monthly"), os.path.join(tmp, "ckpt")
    ingest_stream(spark, src, monthly, ckpt, path_glob="*.zst")
    e4 = merge_counts(counts_view(spark, None, monthly)).filter(
        (F.col("base_fen") == START) & (F.col("move_san") == "e4")).first()
    assert e4.times_played == 4


def test_stream_keeps_files_without_a_month(spark, tmp):
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    with open(os.path.join(src, "games.pgn"), "w") as f:
        f.write(GAME * 2)
    monthly, ckpt = os.path.join(tmp, "monthly"), os.path.join(tmp, "ckpt")
    ingest_stream(spark, src, monthly, ckpt)
    months = {r[0] for r in spark.read.parquet(monthly).select("month").distinct().collect()}
    assert months == {"unknown"}
    assert merge_counts(counts_view(spark, None, monthly)).agg(F.sum("times_played")).first()[0] == 12
