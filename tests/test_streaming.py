import datetime as dt
import glob
import os

from lodestone.streaming import windows


def test_late_events_are_dropped_where_the_watermark_holds(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2025, 1, d, h)
    batches = [[(day(1), "a", 1.0), (day(1, 5), "a", 2.0)], [(day(4), "a", 5.0)], [(day(4, 2), "a", 4.0)], [(day(1, 6), "a", 9.0), (day(4, 1), "a", 1.0)], [(day(9), "b", 1.0)]]
    schema = "ts timestamp, event_type string, value double"
    for i, rows in enumerate(batches):  # one file each, in the order of their times
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (part,) = glob.glob(str(tmp_path / f"w{i}" / "*.parquet"))
        target = tmp_path / "in" / f"{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        os.rename(part, target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    files = sorted(str(x) for x in (tmp_path / "in").iterdir())
    read = spark.read.parquet(files[0]).schema
    rows = lambda mode, n: {(r.begin.day, r.event_type): (r.events, r.value) for r in windows.run_once(spark, files, read, windows.window_counts, mode, mode, n).collect()}
    assert rows("complete", None) == {(1, "a"): (3, 12.0), (4, "a"): (3, 10.0), (9, "b"): (1, 1.0)}
    # the event of the first day that comes fourth is too late; the last window is still open
    assert rows("append", 1) == {(1, "a"): (2, 3.0), (4, "a"): (3, 10.0)}
