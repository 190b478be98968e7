"""What contained sequences exchange, and that it doesn't matter how their cells are dealt."""

import numpy as np

from cadenza.operators import containment as ct
from tests.test_containment import as_frame, clips, walk


def shuffled(spark, run):
    """Bytes that all stages of run() write for shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (found.apply(i) for found in [store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), none())] for i in range(found.size()))}
    before = stages()
    run()
    return sum(n for i, n in stages().items() if i not in before)


def test_only_what_agrees_is_exchanged(spark):
    rng = np.random.default_rng(3)
    df = as_frame(spark, {i: rng.gamma(2, size=int(rng.integers(24, 96))) for i in range(3000)})
    rows = []
    n = shuffled(spark, lambda: rows.extend(ct.deduplicate_sequences(df, 8, 20).collect()))
    assert len(rows) == 3000 and all(r.kept for r in rows)
    assert n < 40_000_000, n


def test_cells_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ct, "CELL_ROWS", 5)
    monkeypatch.setattr(ct, "PRODUCT", 7)
    found = clips(1) | {100 + k: np.repeat(np.arange(5.0) ** k, 9) for k in range(4)}  # the latter flat at most places
    got = {r.id: r.kept for r in ct.deduplicate_sequences(as_frame(spark, found), 8, 24).collect()}
    assert got == {i: w[0] for i, w in walk(found, 8, 24).items()}
