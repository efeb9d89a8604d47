"""The state of a series in entries of several windows: stretches, late windows, and how often the state is asked."""

import random

import numpy as np
import pandas as pd

from opinara.streaming import lifecycle


class Map(dict):
    """A map state in memory that counts its calls."""

    calls = 0

    def containsKey(self, k):
        self.calls += 1
        return k in self

    def getValue(self, k):
        self.calls += 1
        return self[k]

    def updateValue(self, k, v):
        self.calls += 1
        self[k] = v


def tracker(base):
    t = lifecycle.IssueTracker(base)
    t.chunks = Map()
    return t


def test_stretches():
    r = random.Random(4)
    for _ in range(50):
        rates = [r.choice([0.0, 5.0, 12.0, 12.0, 25.0, 60.0]) for _ in range(r.randrange(1, 25))]
        cut, before, got = r.randrange(len(rates) + 1), lifecycle.START, []
        for part in (rates[:cut], rates[cut:]):
            some, before = lifecycle.next_stages(np.array(part, float), 5.0, before)
            got += lifecycle.NAMES[some].tolist()
        assert got == lifecycle.stages(rates, 5.0)


def test_late_windows(monkeypatch):
    monkeypatch.setattr(lifecycle, "CHUNK", 4)
    r = random.Random(5)
    for _ in range(40):
        t, told, rates = tracker(5.0), {}, {}
        for _ in range(5):
            batch = [(r.randrange(1, 30), r.choice([0.0, 5.0, 12.0, 25.0, 60.0])) for _ in range(r.randrange(1, 9))]
            rates |= dict(batch)
            for x in t.handleInputRows(("P", "F"), iter([pd.DataFrame(batch, columns=["window_no", "complaint_rate"])]), None):
                for row in x.itertuples():
                    assert told.get(row.window_no) != (row.from_stage, row.stage)
                    told[row.window_no] = (row.from_stage, row.stage)
            want = lifecycle.stages([rates[k] for k in sorted(rates)], 5.0)
            assert told == dict(zip(sorted(rates), zip(["detected", *want], want)))


def test_few_calls_of_the_state():
    t = tracker(5.0)
    rows = pd.DataFrame({"window_no": np.arange(20_000), "complaint_rate": np.arange(20_000) % 7 * 5.0})
    assert sum(map(len, t.handleInputRows(("P", "F"), iter([rows]), None))) == 20_000 and t.chunks.calls < 30
