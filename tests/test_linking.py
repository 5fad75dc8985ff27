import numpy as np
import pytest

from spotlake.operators import graph as G
from spotlake.operators import measure as M
from spotlake.streaming.linking import OnlineLinker
from spotlake.streaming.live import follow

KIND = "row_id long, frame long, x_nm double, y_nm double, err double"


def blinks(seed):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(150):
        start, p = int(rng.integers(0, 200)), rng.uniform(0, 900, 2)
        for f in range(start, start + int(rng.integers(1, 9))):
            if rng.random() < 0.8:
                rows.append((f, *map(float, p + rng.normal(0, 8, 2)), float(rng.uniform(3, 12))))
    rows.append((50, float("nan"), 1.0, 5.0))
    return [(i, *r) for i, r in enumerate(sorted(rows, key=str))]


@pytest.mark.parametrize("precision", [None, "err"])
def test_stream_in_batches_equals_the_whole(spark, tmp_path, precision):
    rng, rows = np.random.default_rng(1), blinks(4)
    late = 6
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, late))  # out of order, within what is allowed
    for i in range(5):
        part = order[i * len(order) // 5 : (i + 1) * len(order) // 5]
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        (next((tmp_path / "in" / str(i)).glob("part*"))).rename(tmp_path / f"in/{i}.parquet")
    schema = spark.createDataFrame([], KIND).schema
    linker = OnlineLinker(f"{tmp_path}/out", 30.0, 1, late, precision=precision)
    stream = follow(spark, f"{tmp_path}/in/*.parquet", schema, 1)
    query = linker.start(stream, f"{tmp_path}/check")
    query.awaitTermination()
    assert query.exception() is None
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out/settled").iterdir())
    assert last >= 4
    key = ["row_id", "group_id", "n_in_group"]
    got = sorted(map(tuple, linker.grouped(spark, schema, last).select(*key).collect()))
    want = sorted(map(tuple, G.link_blinks(spark.createDataFrame(rows, KIND), 30.0, 1, precision).select(*key).collect()))
    assert got == want and len(got) == len(rows)
    assert linker.settled(spark, schema, last).count() > 0.7 * len(rows)


def test_events_are_linked_in_a_circle(spark):
    rows = [(i, i, 8.0 * (i % 2), 8.0 * (i % 2)) for i in range(4)] + [(10 + i, i, 500.0 + 4 * (i % 2), 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "row_id long, frame long, x_nm double, y_nm double")
    # 8 nm apart on both axes is more than 10 in the plane: rows of one place in every other frame only.
    assert sorted(r["row_id"] for r in M.event_cores(df, 10.0, 0, 3).collect()) == [11, 12]
    assert sorted(r["row_id"] for r in M.event_cores(df, 12.0, 0, 3).collect()) == [1, 2, 11, 12]
