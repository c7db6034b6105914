"""The resumable model step against a stub that counts what it is sent."""

import pytest

from docflow.operators import calls as C


def _stub(folder):
    """Fails twice for most prompts, once with a header; notes each call in a file of its own."""
    import os
    import uuid

    class Busy(RuntimeError):
        status_code = 429

        def __init__(self, said, headers=None):
            super().__init__(said)
            self.headers = headers or {}

    def answer(prompt, attempt):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{prompt}|{attempt}")
        if prompt == "bad key":
            raise RuntimeError("Invalid API key")
        if prompt == "odd":
            raise ValueError("no idea")
        if prompt == "never":
            raise RuntimeError("connection reset")
        if prompt == "slow" and attempt == 1:
            raise Busy("busy", {"Retry-After": "40"})
        if prompt.startswith("twice") and attempt <= 2:
            raise RuntimeError("HTTP 503, try again in 3 seconds")
        return f"{prompt} done"

    return answer


class Clock:
    def __init__(self):
        self.now, self.paused = 1000.0, []

    def time(self):
        return self.now

    def pause(self, seconds):
        self.paused.append(seconds)
        self.now += seconds


PROMPTS = [("d", f"n{i}", p) for i, p in enumerate(["plain", "twice a", "twice b", "twice b", "slow", "bad key", "odd", "never", "", None])]


def _calls(folder):
    return sorted(f.read_text() for f in folder.iterdir())


def test_resumable_step(spark, tmp_path):
    sent, log, clock = tmp_path / "sent", str(tmp_path / "log"), Clock()
    sent.mkdir()
    prompts = spark.createDataFrame(PROMPTS, "doc_id string, node_id string, prompt string")
    run = lambda **more: C.resumable_step(prompts, log, _stub(str(sent)), most_attempts=4, clock=clock.time, pause=clock.pause, **more)
    early = {r.node_id: r for r in run(most_rounds=1).collect()}
    assert early["n0"].state == "answered" and early["n1"].state == early["n4"].state == early["n7"].state == "waiting" and early["n5"].state == early["n6"].state == "failed"
    got = {r.node_id: (r.state, r.attempts, r.content, r.error) for r in run().collect()}  # a restart goes on
    assert got == {
        "n0": ("answered", 1, "plain done", None), "n1": ("answered", 3, "twice a done", None), "n2": ("answered", 3, "twice b done", None), "n3": ("answered", 3, "twice b done", None), "n4": ("answered", 2, "slow done", None),
        "n5": ("failed", 1, None, "Invalid API key"), "n6": ("failed", 1, None, "no idea"), "n7": ("failed", 4, None, "connection reset"), "n8": ("answered", 1, " done", None), "n9": ("open", 0, None, None),
    }
    want = ["plain|1", "slow|1", "slow|2", "bad key|1", "odd|1", "|1", *(f"twice {x}|{i}" for x in "ab" for i in (1, 2, 3)), *(f"never|{i}" for i in (1, 2, 3, 4))]
    assert _calls(sent) == sorted(want)
    attempts = C.read_log(spark, log)
    assert attempts.count() == len(want)
    waits = {(r.prompt_hash, r.attempt): r.not_before - r["at"] for r in attempts.where("not ok").collect()}
    texts = {r.h: r.p for r in prompts.selectExpr("sha2(prompt, 256) h", "prompt p").distinct().collect()}
    by = {(texts[h], i): w for (h, i), w in waits.items()}
    assert by["slow", 1] == 40 and by["twice a", 1] == by["twice a", 2] == 3 and [by["never", i] for i in (1, 2, 3)] == [1, 2, 4]
    assert run().count() == len(PROMPTS) and _calls(sent) == sorted(want)  # nothing is sent again
    assert clock.now >= 1040


def test_time_runs_out(spark, tmp_path):
    clock, sent = Clock(), tmp_path / "sent"
    sent.mkdir()
    one = spark.createDataFrame([("d", "n", "never")], "doc_id string, node_id string, prompt string")
    got = C.resumable_step(one, str(tmp_path / "log"), _stub(str(sent)), most_attempts=100, most_elapsed=10, most_wait=4, clock=clock.time, pause=clock.pause).first()
    assert (got.state, got.attempts) == ("failed", 5) and clock.paused == [1, 2, 4, 4]


@pytest.mark.parametrize("rows", [[], [("d", "n", None)]])
def test_nothing_to_send(spark, tmp_path, rows):
    got = C.resumable_step(spark.createDataFrame(rows, "doc_id string, node_id string, prompt string"), str(tmp_path / "log"), lambda p, k: 1 / 0)
    assert got.count() == len(rows)
