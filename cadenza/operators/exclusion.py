"""Whether a row sounds more like an excluded voice than like the target, by centroids and best references.

Each channel gives a row two margins against a voice: target minus voice by centroid, and by the best of all
references.  A channel votes against the row where neither is above `NEAR`.  References go to the tasks in
blocks of bounded size; what comes back is a number for each row and voice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.decisions import yes
from cadenza.operators.storage import materialised

# Fixed values of the rules.
NEAR, CLEAR = 0.02, 0.15
#: References that a task holds at a time; voices at the most.
BLOCK, VOICES = 4096, 4096
TARGET = ""


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 1e-12, n, 1)


def channel_scores(rows: DataFrame, references: DataFrame, channel: str, block: int = BLOCK) -> DataFrame:
    """id, voice, <channel>_centroid, <channel>_direct: similarity of each row to each voice's centroid (the unit mean of its
    references) and to its best reference.  rows: id, <channel>; references: voice, <channel>; null vectors are
    passed over."""
    refs = materialised(references.select("voice", F.col(channel).cast("array<double>").alias("v")).where("voice is not null and v is not null"), "references")
    sizes = refs.groupBy("voice").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("width")).collect() if refs.select("voice").distinct().limit(VOICES + 1).count() <= VOICES else None
    if sizes is None:
        raise ValueError(f"over {VOICES} voices")
    names = sorted(r.voice for r in sizes)
    number, width, total = {v: i for i, v in enumerate(names)}, max((r.width for r in sizes), default=0), sum(r.n for r in sizes)
    unit = F.transform("v", lambda x: x / F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12)))
    means = refs.select("voice", unit.alias("u")).groupBy("voice").agg(F.array(*[F.avg(F.get("u", F.lit(i))) for i in range(width)]).alias("m")).collect()
    centres = np.zeros((len(names), width))
    for r in means:
        centres[number[r.voice]] = r.m
    schema = f"id {dict(rows.dtypes)['id']}, voice string, {channel}_centroid double, {channel}_direct double"
    if not names:
        return rows.sparkSession.createDataFrame([], schema)
    blocks, out = max(1, -(-total // block)), None
    for b in range(blocks):
        part = refs if blocks == 1 else refs.where(F.pmod(F.xxhash64("voice", "v"), F.lit(blocks)) == b)
        held_rows = part.select("voice", "v").collect()  # about `block`, by the hash
        code = np.array([number[r.voice] for r in held_rows], int)
        matrix = _unit(np.array([r.v for r in held_rows], float).reshape(-1, width))
        held = rows.sparkSession.sparkContext.broadcast((code, matrix, _unit(centres)))

        def best(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            code, matrix, centres = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _unit(np.array(batch.column("v").to_pylist(), float))
                near, direct = v @ centres.T, np.full((len(v), len(centres)), -np.inf)
                for k in np.unique(code):
                    direct[:, k] = (v @ matrix[code == k].T).max(1)
                at = np.repeat(np.arange(len(v)), len(centres))
                columns = [batch.column("id").take(pa.array(at)), pa.array(names).take(pa.array(np.tile(np.arange(len(centres)), len(v)))), pa.array(near.ravel()), pa.array(direct.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "voice", f"{channel}_centroid", f"{channel}_direct"])

        found = rows.select("id", F.col(channel).cast("array<double>").alias("v")).where("v is not null").mapInArrow(best, schema)
        out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out
    return out.groupBy("id", "voice").agg(F.max(f"{channel}_centroid").alias(f"{channel}_centroid"), F.max(f"{channel}_direct").alias(f"{channel}_direct"))


def voice_margins(rows: DataFrame, references: DataFrame, channels: Sequence[str], block: int = BLOCK) -> DataFrame:
    """id, voice, and for each channel <channel>_margin and <channel>_direct_margin: the target's scores less the voice's.  The
    target's references have the voice ''.  A channel without vectors on any of the three sides is null."""
    out = None
    for c in channels:
        scores = materialised(channel_scores(rows, references, c, block), "scores")
        own = scores.where(F.col("voice") == TARGET).select("id", F.col(f"{c}_centroid").alias("t"), F.col(f"{c}_direct").alias("d"))
        margin = scores.where(F.col("voice") != TARGET).join(own, "id").select("id", "voice", (F.col("t") - F.col(f"{c}_centroid")).alias(f"{c}_margin"), (F.col("d") - F.col(f"{c}_direct")).alias(f"{c}_direct_margin"))
        out = margin if out is None else out.join(margin, ["id", "voice"], "left")
    return out


def vote(channel: str) -> Column:
    return yes((F.col(f"{channel}_margin") <= NEAR) & (F.col(f"{channel}_direct_margin") <= NEAR))


def _first(audited: DataFrame, order: DataFrame, total: Column, fields: list[str]) -> DataFrame:
    """Each row's first rejecting voice by its place, else the one of least summed margin."""
    ranked = audited.join(order, "voice").withColumn("total", total)
    rank = F.struct(F.when(F.col("rejected"), 0).otherwise(1).alias("r"), F.when(F.col("rejected"), F.col("place").cast("double")).otherwise(F.col("total")).alias("m"), F.col("place").alias("p"))
    best = ranked.groupBy("id").agg(F.min_by(F.struct("voice", *fields), rank).alias("b"), F.min("clear").alias("all_clear"))
    return best.select("id", "b.*", "all_clear")


def exclusion_audit(rows: DataFrame, references: DataFrame, order: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, voice, rejected, the votes, and which rule rejected.  Rows without both vectors have none.

    A row is rejected where both channels vote against it; where it was recovered by a third channel (`tertiary`)
    and one channel votes while the other isn't ahead by 0.15 in both margins; where both raw channels vote; or where a
    `raw_rescue` has the raw first and the plain second channel against it.  rows: id, primary, secondary, raw_primary,
    raw_secondary, tier.  references: voice, and the same vectors.  order: voice, place."""
    m = voice_margins(rows.where("primary is not null and secondary is not null"), references, ["primary", "secondary", "raw_primary", "raw_secondary"], block)
    m = m.where("secondary_margin is not null").join(rows.select("id", "tier"), "id")
    for c in ("primary", "secondary"):
        m = m.withColumn(f"{c}_vote", vote(c))
        both = F.col("raw_primary_margin").isNotNull() & F.col("raw_secondary_margin").isNotNull()
        m = m.withColumn(f"raw_{c}_vote", both & vote(f"raw_{c}"))
    near = lambda c: (F.col(f"{c}_margin") < CLEAR) | (F.col(f"{c}_direct_margin") < CLEAR)
    conflict = yes(F.col("tier") == "tertiary") & ((F.col("primary_vote") & near("secondary")) | (F.col("secondary_vote") & near("primary")))
    m = m.withColumns({
        "tertiary_conflict": conflict,
        "raw_vote": F.col("raw_primary_vote") & F.col("raw_secondary_vote"),
        "diagonal_vote": yes(F.col("tier") == "raw_rescue") & F.col("raw_primary_vote") & F.col("secondary_vote"),
    })
    m = m.withColumns({"rejected": (F.col("primary_vote") & F.col("secondary_vote")) | F.col("tertiary_conflict") | F.col("raw_vote") | F.col("diagonal_vote"), "clear": F.lit(True)})
    fields = ["rejected", "primary_vote", "secondary_vote", "raw_vote", "tertiary_conflict", "diagonal_vote", "primary_margin", "secondary_margin", "primary_direct_margin", "secondary_direct_margin"]
    return _first(m, order, F.col("primary_margin") + F.col("secondary_margin"), fields).drop("all_clear")


def multimodel_audit(rows: DataFrame, references: DataFrame, order: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, voice, rejected, votes, all_clear: two of three models against the row reject it.  All is clear where every margin of
    every voice is at least 0.02; of a rejecting voice it is that voice's own.  rows, references: primary, secondary, third."""
    models = ["primary", "secondary", "third"]
    m = voice_margins(rows, references, models, block).where("secondary_margin is not null and third_margin is not null")
    clear = F.lit(True)
    for c in models:
        clear = clear & yes((F.col(f"{c}_margin") >= NEAR) & (F.col(f"{c}_direct_margin") >= NEAR))
    votes = sum((vote(c).cast("int") for c in models[1:]), vote(models[0]).cast("int"))
    m = m.withColumns({"votes": votes, "clear": clear}).withColumn("rejected", F.col("votes") >= 2)
    total = F.col("primary_margin") + F.col("secondary_margin") + F.col("third_margin")
    out = _first(m, order, total, ["rejected", "votes", "clear"])
    return out.select("id", "voice", "rejected", "votes", F.when(F.col("rejected"), F.col("clear")).otherwise(F.col("all_clear")).alias("all_clear"))
