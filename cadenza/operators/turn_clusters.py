"""Speaking turns of a source grouped into voices, and the voices of a target among them.

Average linkage: the two clusters of largest mean similarity merge while that is at least `link`;
clusters of different known roles never do, nor clusters with a pair of members that are below
`veto` in the second channel.  The mean similarity of two clusters is the dot product of their
sums over the product of their sizes, so no matrix of all pairs is needed to know it.

Sources of up to `DENSE` turns are worked as they are, each in a task.  Of larger ones a graph of
each turn's `NEIGHBOURS` nearest is made, from pairs of blocks of turns, and clusters that are
each other's best partner merge, all at a time, round by round.  Merging never makes a cluster more
alike to a third than its better part was, so these rounds give what merging the best pair
one by one would.  In a large source partners are looked for, and vetoes known, along the graph's
edges; with as many neighbours as there are turns that is all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.storage import materialised

LINK, VETO, COHESION = 0.50, 0.05, 0.30
DENSE, NEIGHBOURS, BLOCK = 512, 24, 4096
#: Turns that one task judges against a source's clusters.
SALT_TURNS = 8192
_TURN = ("source_id", "turn", "seconds", "primary", "secondary", "role", "usable")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 1e-12, n, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.array(column.tolist(), float))


def _linked(turns: pd.DataFrame, link: float, veto: float) -> np.ndarray:
    """The least turn of each turn's cluster."""
    turn, p, q = turns.turn.to_numpy(), _matrix(turns.primary), _matrix(turns.secondary)
    n = len(turn)
    names = {r: i for i, r in enumerate(sorted({r for r in turns.role if isinstance(r, str)}))}
    role = np.array([names.get(r, -1) for r in turns.role])
    total, worst, size, cluster = p @ p.T, q @ q.T, np.ones(n), np.arange(n)
    mean = np.triu(total, 1) + np.tril(np.full((n, n), -np.inf))
    mean[(worst < veto) | ((role[:, None] >= 0) & (role[None] >= 0) & (role[:, None] != role[None]))] = -np.inf
    while n > 1:
        i, j = divmod(int(mean.argmax()), n)
        if not mean[i, j] >= link:
            break
        for m, both in ((total, np.add), (worst, np.minimum)):
            m[i] = both(m[i], m[j])
            m[:, i] = m[i]
        size[i] += size[j]
        role[i] = max(role[i], role[j])
        cluster[cluster == j] = i
        size[j] = np.inf  # gone
        row = np.where((worst[i] < veto) | ((role[i] >= 0) & (role >= 0) & (role != role[i])) | np.isinf(size), -np.inf, total[i] / (size[i] * size))
        mean[i, i + 1 :], mean[:i, i] = row[i + 1 :], row[:i]
        mean[j], mean[:, j] = -np.inf, -np.inf
    return turn[cluster]


def neighbour_edges(turns: DataFrame, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(source_id, x, y, floor): pairs of turns x < y of which one is among the other's nearest, with
    their similarity in the second channel.  Each pair of a source's blocks is a group of its own."""
    plain = turns.select("source_id", "turn", "primary", "secondary")
    sizes = plain.groupBy("source_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = plain.join(sizes, "source_id").withColumn("mine", F.pmod(F.xxhash64("turn"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        source, lo, hi = rows.source_id.iloc[0], rows.lo.iloc[0], rows.hi.iloc[0]
        a, b = rows[rows.mine == lo], rows[rows.mine == hi]
        out = []
        for x, y in ((a, b), (b, a)) if lo != hi else ((a, a),):
            if not len(x) or not len(y):
                continue
            ids, others = x.turn.to_numpy(), y.turn.to_numpy()
            q, q2 = _matrix(x.secondary), _matrix(y.secondary)
            s = _matrix(x.primary) @ _matrix(y.primary).T
            s[ids[:, None] == others[None]] = -np.inf
            k = min(neighbours, s.shape[1])
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(len(ids)), k)
            j = best.ravel()
            found = s[i, j]
            keep = found > -np.inf
            i, j = i[keep], j[keep]
            out.append(pd.DataFrame({"source_id": source, "a": ids[i], "b": others[j], "s": found[keep], "floor": (q[i] * q2[j]).sum(1)}))
        return pd.concat(out) if out else pd.DataFrame({"source_id": [], "a": [], "b": [], "s": [], "floor": []})

    kind = dict(turns.dtypes)["source_id"]
    found = pairs.groupBy("source_id", "lo", "hi").applyInPandas(near, f"source_id {kind}, a long, b long, s double, floor double")
    order = Window.partitionBy("source_id", "a").orderBy(F.desc("s"), "b")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= neighbours)
    return best.select("source_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "floor").groupBy("source_id", "x", "y").agg(F.min("floor").alias("floor"))


def link_graph(turns: DataFrame, edges: DataFrame, link: float = LINK, veto: float = VETO, rounds: int = 1000) -> DataFrame:
    """(source_id, turn, cluster): rounds of merges between clusters that are each other's best."""
    first = turns.select(F.size("primary")).first()
    width = first[0] if first else 0
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12)))
    clusters = turns.select("source_id", F.col("turn").alias("c"), F.lit(1).cast("long").alias("n"), unit(F.col("primary").cast("array<double>")).alias("sum"), F.col("role"))
    clusters, edges = materialised(clusters, "clusters"), materialised(edges.select("source_id", "x", "y", "floor"), "edges")
    labels = turns.select("source_id", "turn", F.col("turn").alias("cluster"))
    for _ in range(rounds):
        end = lambda c: clusters.select("source_id", F.col("c").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("n", "sum", "role")])
        both = edges.join(end("x"), ["source_id", "x"]).join(end("y"), ["source_id", "y"])
        mean = F.aggregate(F.zip_with("x_sum", "y_sum", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / (F.col("x_n") * F.col("y_n"))
        open_ = (F.col("floor") >= veto) & F.coalesce(F.col("x_role") == F.col("y_role"), F.lit(True))
        able = both.where(open_).select("source_id", "x", "y", mean.alias("mean")).where(F.col("mean") >= link)
        # The largest mean, then the least names: one order of all pairs, the same seen from both ends.
        rank = F.struct("mean", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))
        best = able.select("source_id", F.explode(F.array("x", "y")).alias("c"), rank.alias("r")).groupBy("source_id", "c").agg(F.max("r").alias("r"))
        merges = best.groupBy("source_id", (-F.col("r.x")).alias("x"), (-F.col("r.y")).alias("y")).agg(F.count("*").alias("k")).where("k = 2")
        merges = materialised(merges.select("source_id", "x", F.col("y").alias("gone")), "merges")
        if merges.isEmpty():
            return labels
        to = lambda df, c: df.join(merges.select("source_id", F.col("gone").alias(c), F.col("x").alias("_to")), ["source_id", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        sums = F.array(*[F.sum(F.get("sum", F.lit(i))) for i in range(width)])
        clusters = materialised(to(clusters, "c").groupBy("source_id", "c").agg(F.sum("n").alias("n"), sums.alias("sum"), F.max("role").alias("role")), "clusters")
        moved = to(to(edges, "x"), "y").where("x <> y").select("source_id", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "floor")
        edges = materialised(moved.groupBy("source_id", "x", "y").agg(F.min("floor").alias("floor")), "edges")
        labels = materialised(to(labels.select("source_id", "turn", F.col("cluster").alias("c")), "c").select("source_id", "turn", F.col("c").alias("cluster")), "labels")
    raise RuntimeError(f"clusters still merge after {rounds} rounds")


def trimmed_centroid(m: np.ndarray, share: float = 0.10, least: int = 10, floor: float = 0.25) -> np.ndarray:
    """Unit mean; of `least` rows and more without those below the quantile or the floor, if two stay."""
    mean = _unit(m.mean(0))
    if len(m) < least:
        return mean
    scores = m @ mean
    keep = scores >= max(float(np.quantile(scores, share)), floor)
    return _unit(m[keep].mean(0)) if keep.sum() >= 2 else mean


_CLUSTER = """source_id {kind}, cluster long, members array<long>, n int, seconds double, primary_centroid array<double>, secondary_centroid array<double>,
 cohesion double, primary_median double, secondary_median double, known_rival boolean"""


def tightened(turns: DataFrame, labels: DataFrame, cohesion: float = COHESION) -> DataFrame:
    """Clusters without the members that are too far from their centroid: the farthest goes, until none
    is below `cohesion`.  One row a cluster, named by its least member."""

    def tighten(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        p, q, at = _matrix(rows.primary), _matrix(rows.secondary), list(range(len(rows)))
        while at:
            scores = p[at] @ trimmed_centroid(p[at])
            if scores.min() >= cohesion:
                break
            at.pop(int(scores.argmin()))
        if not at:
            return pd.DataFrame(columns=["source_id", "cluster"])
        cp, cq = trimmed_centroid(p[at]), trimmed_centroid(q[at])
        held = rows.iloc[at]
        sp, sq = p[at] @ cp, q[at] @ cq
        rival = any(isinstance(r, str) and r != "target" for r in held.role)
        row = (held.source_id.iloc[0], held.turn.iloc[0], held.turn.tolist(), len(at), float(held.seconds.sum()), cp.tolist(), cq.tolist(), float(sp.min()), float(np.median(sp)), float(np.median(sq)), rival)
        names = ["source_id", "cluster", "members", "n", "seconds", "primary_centroid", "secondary_centroid", "cohesion", "primary_median", "secondary_median", "known_rival"]
        return pd.DataFrame([row], columns=names)

    kind = dict(turns.dtypes)["source_id"]
    rows = turns.join(labels, ["source_id", "turn"])
    return rows.groupBy("source_id", "cluster").applyInPandas(tighten, _CLUSTER.format(kind=kind))


def _usable(turns: DataFrame) -> DataFrame:
    return turns.select(*_TURN).where("usable and primary is not null and secondary is not null")


def link_turns(turns: DataFrame, link: float = LINK, veto: float = VETO, dense: int = DENSE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(source_id, turn, cluster): the cluster of each turn, named by its least turn.  turns: source_id,
    turn (long, once a source), primary, secondary, role (null: unknown)."""
    sizes = turns.groupBy("source_id").agg(F.count("*").alias("_n"))
    part = lambda rule: turns.join(sizes.where(rule).select("source_id"), "source_id").select("source_id", "turn", "primary", "secondary", "role")
    large = materialised(part(F.col("_n") > dense), "large")
    kind = dict(turns.dtypes)["source_id"]

    def group(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("turn").reset_index(drop=True)
        return pd.DataFrame({"source_id": t.source_id, "turn": t.turn, "cluster": _linked(t, link, veto)})

    labels = part(F.col("_n") <= dense).groupBy("source_id").applyInPandas(group, f"source_id {kind}, turn long, cluster long")
    if large.isEmpty():
        return labels
    return labels.unionByName(link_graph(large, neighbour_edges(large, neighbours), link, veto))


def cluster_turns(turns: DataFrame, link: float = LINK, veto: float = VETO, cohesion: float = COHESION, dense: int = DENSE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The voices of each source; see `tightened` for the columns.  turns: as for `link_turns`, and seconds,
    usable (other turns are left out)."""
    rows = materialised(_usable(turns), "turns")
    return tightened(rows, link_turns(rows, link, veto, dense, neighbours), cohesion)


@dataclass
class TargetProfile:
    """What is known of the target: a centroid a channel, reference rows, and floors of both scores."""

    primary: list
    secondary: list
    primary_floor: float
    secondary_floor: float
    primary_references: list = field(default_factory=list)
    secondary_references: list = field(default_factory=list)


def profile_scores(vectors: np.ndarray, centroid: list, references: list) -> np.ndarray:
    """The better of the centroid's similarity and the mean of the two nearest references, less 0.02."""
    u, c = _unit(vectors), _unit(np.array(centroid, float))
    score = u @ c
    if len(references) < 2:
        return score
    near = np.sort(u @ _unit(np.array(references, float)).T, axis=1)
    return np.maximum(score, near[:, -2:].mean(1) - 0.02)


# Fixed values of the rule.
MARGIN = 0.06
UNION = (0.72, 0.70)
UNION_STRONG = (0.66, 0.60)
UNION_REFERENCE = (0.55, 0.50)
UNION_BONUS, UNION_MARGIN_BONUS = 0.10, 0.04
RIVAL = (0.68, 0.65)
RIVAL_GAP = 0.015
OUTLIER_DROP = 0.18
GUARD = (0.01, 0.02)
SLACK = (0.10, 0.12)
COMPETITOR = (2, 2.5)


def judge_clusters(rows: pd.DataFrame, profile: TargetProfile, roles: list[tuple[str, list, list | None]], margin: float, require_dominant: bool) -> pd.DataFrame:
    """Scores, family and cohort of one source's clusters (its rows), longest speech first."""
    rows = rows.sort_values(["seconds", "cluster"], ascending=[False, True], kind="stable").reset_index(drop=True)
    p, s = (np.array(rows[c].tolist(), float) for c in ("primary_centroid", "secondary_centroid"))
    p_score = np.round(profile_scores(p, profile.primary, profile.primary_references), 6)
    s_score = np.round(profile_scores(s, profile.secondary, profile.secondary_references), 6)
    both = np.minimum(p_score, s_score)
    allowed = np.ones(len(rows), bool)
    p_other = np.full(len(rows), -1.0)
    least = np.minimum(p_score, s_score) + 1.0 if not roles else np.full(len(rows), np.inf)
    p_gap, s_gap, nearest = np.full(len(rows), np.inf), np.full(len(rows), np.inf), np.full(len(rows), None, object)
    for role, centroid, second in roles:
        other = p @ _unit(np.array(centroid, float))
        gap = p_score - other
        second_gap = s_score - s @ _unit(np.array(second, float)) if second is not None else np.full(len(rows), -np.inf)
        # At the margin, or close under it with the second channel well above.  Two views can't outvote each other.
        allowed &= (gap >= margin) | ((gap >= margin - 0.02) & (second_gap >= margin + 0.02))
        least = np.minimum(least, np.minimum(gap, np.where(np.isinf(second_gap), s_score + 1.0, second_gap)))
        closer = other > p_other
        nearest[closer], p_other = role, np.maximum(p_other, other)
        p_gap, s_gap = np.where(closer, np.round(gap, 6), p_gap), np.where(closer, np.round(second_gap, 6), s_gap)
    rows = rows.assign(primary_score=p_score, secondary_score=s_score, nearest_role=nearest, primary_margin=np.where(nearest == None, np.nan, p_gap), least_margin=least, qualified=False, target=False, best=False, cohort=False, reason="no_qualifying_cluster")  # noqa: E711
    qualified = (p_score >= profile.primary_floor) & (s_score >= profile.secondary_floor) & allowed
    rows["qualified"] = qualified
    if not qualified.any():
        return rows
    at = np.flatnonzero(qualified)
    best = at[np.argmax(both[at])]
    near = lambda k: (p @ p[k], s @ s[k])
    pa, sa = near(best)
    rivals = [i for i in at if i != best and both[i] >= both[best] - RIVAL_GAP and (pa[i] < RIVAL[0] or sa[i] < RIVAL[1])]
    best = max([best, *rivals], key=lambda i: (p_score[i] + s_score[i]) / 2)
    pa, sa = near(best)
    wide = margin + UNION_MARGIN_BONUS
    ahead = (p_gap >= wide) | ((p_gap >= wide - 0.02) & (s_gap >= wide + 0.02))
    strong = (p_score >= UNION_STRONG[0]) & (s_score >= UNION_STRONG[1])
    alike = (pa >= UNION[0]) & (sa >= UNION[1])
    referred = (pa >= UNION_REFERENCE[0]) & (sa >= UNION_REFERENCE[1]) & (p_score >= profile.primary_floor + UNION_BONUS) & (s_score >= profile.secondary_floor + UNION_BONUS)
    family = qualified & (alike | (strong & ahead) | (referred & ahead))
    family[best] = True
    if require_dominant and not family[at[np.argmax(rows.seconds.to_numpy()[at])]]:
        rows["reason"] = "dominance_conflict"
        return rows
    rows["target"], rows["best"], rows["reason"] = family, np.arange(len(rows)) == best, "target_cluster_found"
    heard = ((rows.n >= COMPETITOR[0]) & (rows.seconds >= COMPETITOR[1])) | rows.known_rival
    rows["cohort"] = ~qualified & ~strong & heard.to_numpy(bool)
    return rows


_JUDGED = _CLUSTER + ", primary_score double, secondary_score double, nearest_role string, primary_margin double, least_margin double, qualified boolean, target boolean, best boolean, cohort boolean, reason string"
_VERDICT = "source_id {kind}, turn long, cluster long, verdict string, primary_effective double, secondary_effective double, cohort_margin double"


def judge_turns(turns: pd.DataFrame, clusters: pd.DataFrame, profile: TargetProfile) -> pd.DataFrame:
    """core, borderline, dropped or near_miss, or none, for turns of one source."""
    names = ["source_id", "turn", "cluster", "verdict", "primary_effective", "secondary_effective", "cohort_margin"]
    p, s = _matrix(turns.primary), _matrix(turns.secondary)
    cp, cs = (np.array(clusters[c].tolist(), float) for c in ("primary_centroid", "secondary_centroid"))
    place = {t: k for k, m in enumerate(clusters.members) for t in m}
    own = np.array([place.get(t, -1) for t in turns.turn])
    target = clusters.target.to_numpy(bool)
    in_target = (own >= 0) & target[own]
    p_prof, s_prof = profile_scores(p, profile.primary, profile.primary_references), profile_scores(s, profile.secondary, profile.secondary_references)
    p_eff = np.where(own >= 0, np.maximum((p * cp[own]).sum(1), p_prof), p_prof)
    s_eff = np.where(own >= 0, np.maximum((s * cs[own]).sum(1), s_prof), s_prof)
    rest = clusters.cohort.to_numpy(bool)
    p_other, s_other = ((v @ c[rest].T).max(1) if rest.any() else np.full(len(v), -1.0) for v, c in ((p, cp), (s, cs)))
    p_floor = np.maximum(clusters.primary_median.to_numpy()[own] - OUTLIER_DROP, profile.primary_floor - 0.03)
    s_floor = np.maximum(clusters.secondary_median.to_numpy()[own] - OUTLIER_DROP - 0.02, profile.secondary_floor - 0.03)
    beaten = (p_other > p_eff + GUARD[0]) & (s_other > s_eff - GUARD[1])
    slack = (p_eff >= p_floor - SLACK[0]) & (s_eff >= s_floor - SLACK[1])
    core = (p_eff >= p_floor) & (s_eff >= s_floor) & ~beaten
    verdict = np.where(core, "core", np.where(slack & (beaten | (p_eff - p_other >= 0)), "borderline", "dropped"))
    near = (own >= 0) & (p_prof >= profile.primary_floor + 0.03) & (s_prof >= profile.secondary_floor - 0.20)
    verdict = np.where(in_target, verdict, np.where(near & target.any(), "near_miss", "none"))
    name = np.where(own >= 0, clusters.cluster.to_numpy()[own], -1)
    return pd.DataFrame(dict(zip(names, (turns.source_id.to_numpy(), turns.turn.to_numpy(), name, verdict, p_eff, s_eff, p_eff - p_other), strict=True)))


def assign_target(turns: DataFrame, clusters: DataFrame, profile: TargetProfile, roles: list[tuple[str, list, list | None]], margin: float = MARGIN, require_dominant: bool = True) -> tuple[DataFrame, DataFrame]:
    """The judged clusters, and each usable turn's verdict.  roles: excluded voices, each with a centroid
    in the first and perhaps in the second channel.  Turns are judged in bounded parts of their source."""
    kind = dict(turns.dtypes)["source_id"]
    judge = lambda rows: judge_clusters(rows, profile, roles, margin, require_dominant)
    judged = materialised(clusters.groupBy("source_id").applyInPandas(judge, _JUDGED.format(kind=kind)), "judged")
    usable = _usable(turns)
    salts = lambda name: usable.groupBy("source_id").agg(F.ceil(F.count("*") / SALT_TURNS).cast("int").alias(name))
    dealt = usable.join(salts("parts"), "source_id").withColumn("salt", F.expr("cast(pmod(xxhash64(turn), parts) as int)"))
    known = judged.join(salts("copies"), "source_id").withColumn("salt", F.expr("explode(sequence(0, copies - 1))"))

    def verdicts(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(c):
            return pd.DataFrame(columns=["source_id", "turn", "cluster", "verdict", "primary_effective", "secondary_effective", "cohort_margin"])
        return judge_turns(t, c, profile)

    pairs = dealt.groupBy("source_id", "salt").cogroup(known.groupBy("source_id", "salt"))
    return judged, pairs.applyInPandas(verdicts, _VERDICT.format(kind=kind))
