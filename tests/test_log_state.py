"""First matches and status of logs from a stream, against those of the whole table."""

import random
import time

import pytest

from pipecheck.operators import logs
from pipecheck.streaming import log_state as s
from tests.conftest import values

LINES = "path string, line_no bigint, line string"


def sample(rng, n):
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "quiet"]), k, rng.choice(["ERROR x", "ok", "WARN ", 'say "ERROR"\t', "fine"])) for k in range(n)]
    return [r if r[0] != "quiet" else (*r[:2], "nothing") for r in rows]


def run(spark, folder, **options):
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = s.run_state(stream, f"{folder}/state", f"{folder}/checkpoint", **options)
    assert query.awaitTermination(120)
    return s.latest_state(spark, f"{folder}/state")


def add(frame, rows, folder):
    frame(rows, LINES).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_batches_and_restarts_give_the_batch_answer(spark, frame, tmp_path):
    rows = sample(random.Random(1), 300)
    add(frame, rows[150:200], tmp_path)
    add(frame, rows[:150], tmp_path)
    first = run(spark, tmp_path, shown=5)
    assert {r.path: r.n_lines for r in first.collect()}["hot"] == sum(r[0] == "hot" for r in rows[:200])
    add(frame, rows[200:], tmp_path)
    state = run(spark, tmp_path, shown=5)
    columns = ("path", "line_no", "line", "n_matches", "n_more")
    assert values(s.shown_lines(state, 5), *columns) == values(logs.first_matches(frame(rows, LINES), shown=5), *columns)
    want = {p: (sum(r[0] == p for r in rows), "no match" if p == "quiet" else "matched", False) for p in ("hot", "a", "b", "quiet")}
    assert {r.path: (r.n_lines, r.status, r.closed) for r in state.collect()} == want


def test_a_batch_that_is_lost_and_repeated_counts_once(spark, frame, tmp_path, monkeypatch):
    rows = sample(random.Random(2), 60)
    add(frame, rows[:30], tmp_path)
    run(spark, tmp_path)
    add(frame, rows[30:], tmp_path)
    make = s.state_after

    def lost(*args, **options):
        step = make(*args, **options)

        def fails(batch, number):
            step(batch, number)
            raise RuntimeError("lost behind the write")

        return fails

    with monkeypatch.context() as m:
        m.setattr(s, "state_after", lost)
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path)
    state = run(spark, tmp_path)
    assert {r.path: r.n_lines for r in state.collect()} == {p: sum(r[0] == p for r in rows) for p in {r[0] for r in rows}}


def test_idle_logs_are_closed_and_leave(spark, frame, tmp_path):
    seen = []
    for name in ("one", "two", "three"):
        add(frame, [(name, 1, "ERROR")], tmp_path)
        seen.append({r.path: r.closed for r in run(spark, tmp_path, idle_seconds=2).collect()})
        time.sleep(2.1)
    assert seen[0] == {"one": False} and seen[1] == {"one": True, "two": False} and seen[2] == {"two": True, "three": False}
