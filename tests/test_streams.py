"""Request streams over several micro-batches and restarts, against a plain loop."""

from datetime import UTC, datetime

import numpy as np
import pytest

from lodestrand.streaming import requests as R

SCHEMA = "request string, event long, ts timestamp, kind string"


def plain(events, mark, idle):
    out = set()
    by = {}
    for r, event, ms, kind in events:
        by.setdefault(r, []).append((ms, event, kind))
    for r, rows in by.items():
        open_, number = [], 0
        for ms, event, kind in sorted(rows, key=lambda e: e[:2]):
            if ms > mark:
                break
            if open_ and ms - open_[-1][0] > idle:
                out.add((r, number, open_[0][0], open_[-1][0] + idle, tuple(e for _, e in open_), "timeout"))
                open_, number = [], number + 1
            open_.append((ms, event))
            if kind in ("final", "error", None):
                out.add((r, number, open_[0][0], ms, tuple(e for _, e in open_), kind or "null"))
                open_, number = [], number + 1
        if open_ and open_[-1][0] + idle < mark:
            out.add((r, number, open_[0][0], open_[-1][0] + idle, tuple(e for _, e in open_), "timeout"))
    return out


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(2)
    at, out = 1_700_000_000_000, []
    for i in range(400):
        at += int(rng.integers(1, 40)) * 1000
        late = int(rng.integers(0, 200)) * 1000  # arrives in this place, though it happened earlier
        out.append((f"r{rng.integers(6)}", i, at - late, [None, "final", "error", "trace", "trace", "tool"][rng.integers(6)]))
    out += [("quiet", 900, at - 2_000_000, "trace"), ("ties", 902, at - 1_500_000, "trace"), ("ties", 901, at - 1_500_000, "trace"), ("open", 903, at, "trace"), (None, 904, at - 900_000, "final")]
    return sorted(out, key=lambda e: e[2] + (e[1] % 7) * 20_000)


def test_micro_batches_and_restart(spark, events, tmp_path):
    parts = np.array_split(np.arange(len(events)), 5)

    def put(k):
        rows = [(r, e, datetime.fromtimestamp(ms / 1000, UTC), kind) for r, e, ms, kind in (events[i] for i in parts[k])]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = R.run_sessions(spark, stream, str(tmp_path / "work"))
        return [(r.request, r.session, r.started_ms, r.ended_ms, tuple(r.events), r.outcome) for r in found.collect()]

    for k in range(3):
        put(k)
    first = run()
    assert first
    put(3)
    put(4)
    rows = run()  # goes on from the checkpoint
    assert len(rows) == len(set(rows)) and set(first) <= set(rows)
    mark = max(ms for _, _, ms, _ in events) - 600_000
    want = plain(events, mark, 300_000)
    assert set(rows) == want and {r[5] for r in rows} == {"final", "error", "null", "timeout"}
    assert run() and len(run()) == len(rows)  # nothing new, nothing twice


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert R.run_sessions(spark, stream, str(tmp_path / "work")).count() == 0
