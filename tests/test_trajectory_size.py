"""What the evidence field exchanges for each of its cells."""

import random

from cadenza.operators import trajectory as tr
from tests.test_containment_size import shuffled
from tests.test_trajectory import OBS


def test_cells_are_exchanged_narrow(spark):
    rnd = random.Random(4)
    rows = [(s, a, a + rnd.randrange(1, 30_000_000), rnd.choice(("coarse", "fine", "local", "island")), rnd.uniform(-1, 1)) for s in range(300) for a in (rnd.randrange(10**9) for _ in range(40))]
    df = spark.createDataFrame(rows, OBS)
    cells = []
    n = shuffled(spark, lambda: cells.append(tr.build_field(df, df.where("value > 0.95").select("source_id", "start_ms", "end_ms"))[0].count()))
    assert cells[0] > 35_000
    assert n < 300 * cells[0], n / cells[0]
