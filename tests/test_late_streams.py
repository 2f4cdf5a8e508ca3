"""Late periods as a stream: what comes after a period's state is gone, and closing over all sources."""

import random

from freshet.operators import lateness as batch
from freshet.streaming import lateness
from tests.test_streaming import drain

COLS = "src int, ev long, ar long, in_packets long, in_bytes long"


def source(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(path)


def test_too_late_after_the_state_is_gone(spark, tmp_path):
    at = lambda ar, ev=50: (1, ev, ar, 1, 10)
    src = source(spark, str(tmp_path / "in"), [[at(60)], [at(10_000_000, 9_999_990)], [at(10_000_001, 9_999_990)], [at(20_000_000, 9_999_990)], [at(20_000_001), at(20_000_002)]])
    got = drain(lateness.corrected_periods(src, "src", "ev", "ar", 100, 10, 200, delay="1 second"), "update", "gone").where("period_start = 0").collect()
    assert [(r.revision, r.n_final, r.packets, r.bytes, r.n_late, r.n_dropped) for r in got] == [(1, 1, 1, 10, 0, 0), (None, None, None, None, None, 2)]


def test_closing_over_all_sources(spark, tmp_path):
    r = random.Random(4)
    rows = sorted(((r.randrange(3), (ar := 1000 * i + r.randrange(900)) - r.randrange(3000), ar, 1, 1) for i in range(60)), key=lambda x: x[2])
    rows = [x for x in rows if x[0] != 2 or x[2] < 20_000]  # one source falls silent
    end = [(0, 10**7, 10**7, 1, 1)], [(0, 10**7, 10**7 + 1, 1, 1)], [(0, 10**7, 2 * 10**7, 1, 1)]
    src = source(spark, str(tmp_path / "in"), [rows[:20], rows[20:40], rows[40:], *end])
    got = drain(lateness.closed_periods(src, "src", "ev", "ar", 1000, 2000, 7000, "2 seconds"), "append", "closed").where("period_start < 1000000").collect()
    want = batch.closures(spark.createDataFrame(rows + [x for e in end for x in e], COLS), "src", "ev", "ar", 1000, 2000, 7000).where("period_start < 1000000").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({x.n_sources for x in got}) > 1
