import os

import pytest

from quarrystone.storage import Gathered, stored


@pytest.mark.parametrize("own", [True, False])
def test_gathered_keeps_every_round(spark, own):
    rounds = [stored(spark.range(i, i + 1).selectExpr("id", "id * 2 as twice"), "round") for i in range(8)]
    at = [r.inputFiles()[0].removeprefix("file://") for r in rounds]
    all_ = Gathered(rounds[0], "id", own=own, most=3)
    for r in rounds[1:]:
        all_.add(r)
        assert len(all_.parts) <= 3
        assert r.count() == 1  # the last round's table is what a loop goes on with
    rows = all_.rows()
    assert rows.columns == ["id"] and sorted(r.id for r in rows.collect()) == list(range(8))
    made = [f.removeprefix("file://") for t in all_.made for f in t.inputFiles()]
    assert made and all(map(os.path.exists, made))
    assert os.path.exists(at[0]) != own  # a round that went into a larger table goes only where it is owned
    all_.forget()
    assert not any(map(os.path.exists, made))
    assert os.path.exists(at[-1]) != own
