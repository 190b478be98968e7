import numpy as np
import pytest

from cadenza.operators.neighbours import nearest_scores
from cadenza.plans.catalogue import queries


def test_every_reference_counts(spark, tmp_path):
    n = 30_000  # 6,000 references
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (n, 64)).astype(np.float32)
    v[n - 1] = v[n - 5]  # near a reference of large id only
    rows = spark.createDataFrame([(i, x.tolist(), 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    p = v[:, :32].astype(float)
    p /= np.linalg.norm(p, axis=1)[:, None]
    refs, some = p[::5], [0, 7, n - 5, n - 1]
    c = refs.mean(0)
    want = {i: max(p[i] @ c / np.linalg.norm(c), np.sort(refs @ p[i])[-2:].mean() - 0.02) for i in some}
    got = {r.vec_id: r.score for r in queries()["V2_profile_score"](spark, str(tmp_path)).where(f"vec_id in ({','.join(map(str, some))})").collect()}
    assert got == {i: pytest.approx(x, abs=2e-6) for i, x in want.items()}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_scores_do_not_depend_on_blocks(spark, block):
    v = np.random.default_rng(5).normal(0, 1, (40, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").repartition(3)
    got = {r.vec_id: r.scores for r in nearest_scores(df, df.where("vec_id < 20"), 2, block).collect()}
    assert got == {i: pytest.approx(sorted(v[:20] @ v[i])[:-3:-1]) for i in range(40)}
    assert nearest_scores(df, df.limit(0), 2).count() == 0
