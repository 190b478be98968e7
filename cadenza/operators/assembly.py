"""Assembling sentences from timed rows: joins, absorptions and installations that depend on what
was decided before, and on evidence near a row.

Whatever can be said of a row by itself is a range join or a window within a run; only the walk
over a run's rows, in which an earlier decision changes a later one, is a fold.  Evidence comes once to
a group of runs, not to each of its rows, and is asked by bisection there.

All times are integer milliseconds.  Inputs have segment_id, source_id, start_ms and end_ms.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict, deque
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.folds import Spans, fold_runs
from cadenza.operators.intervals import END, START, islands, merge, per_row

KEYS = ("source_id",)
KANA, CJK = re.compile("[぀-ヿ]"), re.compile("[一-鿿]")


def with_evidence(df: DataFrame, evidence: DataFrame, out: str, before: int = 0, after: int = 0, more: tuple[str, ...] = ()) -> DataFrame:
    """Adds `out`: the ascending intervals of the evidence, with the columns `more`, that overlap
    the row from `before` ahead of it to `after` behind it."""
    held = df.withColumns({"_start": F.col(START), "_end": F.col(END), START: F.col(START) - before, END: F.col(END) + after})
    one = F.struct(*[F.col(f"b_{c}").alias(c) for c in (START, END, *more)])
    found = per_row(held, evidence.select(*KEYS, START, END, *more), KEYS, lambda hit: [F.sort_array(F.collect_set(F.when(hit, one))).alias(out)])
    return found.withColumns({START: F.col("_start"), END: F.col("_end")}).drop("_start", "_end")


def _meets(intervals, a: int, b: int) -> bool:
    return any(min(b, x["end_ms"]) > max(a, x["start_ms"]) for x in intervals)


SPAN = "source_id long, start_ms long, end_ms long, n long"


def join_same_voice(
    rows: DataFrame, forbidden: DataFrame, gap: int = 850, cap: int = 20_000, floors: tuple[tuple[str, float], ...] = (("primary", 0.76), ("secondary", 0.64)), slack: int = 20, touch: int = 10
) -> DataFrame:
    """Neighbours of one voice join: at most `gap` apart, within `cap` in all, not over a
    forbidden interval in the gap (more than `touch`; one that holds both rows whole, give or
    take `slack`, is no barrier), and either both strict or with every vector column's similarity
    at its floor.  rows: strict and the vectors of floors.  Similarity is of neighbouring rows,
    the cap counts from the joined one's start.  Gives the joined spans with their number of rows."""
    from cadenza.functions.vectors import dot

    run = islands(rows, KEYS, gap, out="_run")  # rows of different runs are too far apart
    w = Window.partitionBy(*KEYS, "_run").orderBy(START, END, "segment_id")
    last = {f"_{c}": F.lag(c).over(w) for c in (START, END, "strict", *[c for c, _ in floors])}
    pairs = run.withColumns(last)
    same = F.lit(True)
    for column, floor in floors:
        same = same & (dot(column, f"_{column}") >= floor)
    pairs = pairs.withColumn("_same", F.coalesce((F.col("strict") & F.col("_strict")) | same, F.lit(False)))
    between = pairs.select("segment_id", *KEYS, F.col(f"_{END}").alias(START), F.col(START).alias(END), F.col(f"_{START}").alias("low"), F.col(END).alias("high"))
    bars = lambda hit: hit & ~((F.col(f"b_{START}") <= F.col("low") + slack) & (F.col(f"b_{END}") >= F.col("high") - slack))
    barred = per_row(between.where(F.col(START) < F.col(END)), forbidden, KEYS, lambda hit: [F.max(bars(hit)).alias("barred")], touch)
    flags = pairs.join(barred.where("barred").select("segment_id", "barred"), "segment_id", "left")
    joinable = F.col("_same") & F.col("barred").isNull() & (F.col(START) - F.col(f"_{END}") <= gap)

    def fold(some: SimpleNamespace) -> list:
        out: list[list] = []
        for source, a, b, ok in zip(some.source_id, some.start_ms, some.end_ms, some.ok, strict=True):
            if out and ok and b - out[-1][1] <= cap:
                out[-1][2], out[-1][3] = b, out[-1][3] + 1
            else:
                out.append([source, a, b, 1])
        return out

    plain = flags.select("segment_id", *KEYS, START, END, F.coalesce(joinable, F.lit(False)).alias("ok"))
    return fold_runs(plain, gap, fold, SPAN)


def join_owned(spans: DataFrame, units: DataFrame, barriers: DataFrame, least: int, bridge: int) -> DataFrame:
    """Spans that touch join; over a gap of at most `bridge` without a barrier in it they join if
    one of them is shorter than `least` or both have the same accepted owner.  The owner of a span
    is the unit that holds its middle: the shortest, then an accepted one, then the one that
    covers most, then the first.  units: unit_id, accepted."""
    def fold(some: SimpleNamespace) -> list:
        bars, u = Spans(some.barriers.start_ms, some.barriers.end_ms), some.units
        low, high = np.array(u.start_ms, np.int64), np.array(u.end_ms, np.int64)

        def owner(a: int, b: int):
            """(unit_id, accepted)."""
            holding = np.flatnonzero((2 * low <= a + b) & (a + b <= 2 * high)).tolist()
            rank = lambda i: (u.end_ms[i] - u.start_ms[i], not u.accepted[i], -max(0, min(b, u.end_ms[i]) - max(a, u.start_ms[i])), u.unit_id[i])
            best = min(holding, key=rank, default=None)
            return (None, False) if best is None else (u.unit_id[best], u.accepted[best])

        out: list[list] = []
        for source, a, b in zip(some.source_id, some.start_ms, some.end_ms, strict=True):
            if out:
                left, right = out[-1][1], out[-1][2]
                together = a <= right
                if not together and a - right <= bridge and not bars.meet(right, a):
                    together = min(right - left, b - a) < least
                    if not together:
                        (x, sure), (y, also) = owner(left, right), owner(a, b)
                        together = bool(sure and also and x == y)
                if together:
                    out[-1][2], out[-1][3] = max(right, b), out[-1][3] + 1
                    continue
            out.append([source, a, b, 1])
        return out

    evidence = {"units": (units.select(*KEYS, START, END, "unit_id", "accepted"), bridge), "barriers": (merge(barriers.select(*KEYS, START, END)), bridge)}
    return fold_runs(spans.select("segment_id", *KEYS, START, END), bridge, fold, SPAN, beside=evidence)


def absorb_remainders(rows: DataFrame, spans: DataFrame, blocked: DataFrame, least: int) -> DataFrame:
    """Rows take what is left of a span that holds them, on a side where that is shorter than
    `least`, unless the longer row would meet another one or a blocked interval.  Earlier rows'
    changes are seen by later ones.  Gives segment_id, source_id, start_ms, end_ms, joined."""
    held = with_evidence(rows.select("segment_id", *KEYS, START, END), spans, "spans")
    held = with_evidence(held, blocked, "blocked", before=least, after=least)

    def fold(some: SimpleNamespace) -> list:
        now = [[s, i, a, b, False] for s, i, a, b in zip(some.source_id, some.segment_id, some.start_ms, some.end_ms, strict=True)]
        for k, (row, spans, blocked) in enumerate(zip(now, some.spans, some.blocked, strict=True)):
            for s in spans:
                a, b = row[2], row[3]
                if not s["start_ms"] <= a < b <= s["end_ms"]:
                    continue
                low = s["start_ms"] if 0 < a - s["start_ms"] < least else a
                high = s["end_ms"] if 0 < s["end_ms"] - b < least else b
                others = ({"start_ms": o[2], "end_ms": o[3]} for j, o in enumerate(now) if j != k)
                if (low, high) != (a, b) and not _meets(others, low, high) and not _meets(blocked, low, high):
                    row[2:] = [low, high, True]
        return now

    return fold_runs(held, 2 * least, fold, "source_id long, segment_id long, start_ms long, end_ms long, joined boolean")


def local_conflicts(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(segment_id, state) of proposals: other where they meet evidence of another, unresolved
    where what they share with unresolved evidence isn't covered whole by target evidence inside
    that evidence, else uncontested.  evidence: state in target, other, unresolved."""
    of = lambda s: evidence.where(F.col("state") == s).select(*KEYS, START, END)
    p = proposals.select("segment_id", *KEYS, START, END)
    other = per_row(p, merge(of("other")), KEYS, lambda hit: [F.coalesce(F.max(hit), F.lit(False)).alias("other")])
    from cadenza.operators.intervals import overlap_join

    low, high = F.greatest(START, f"b_{START}"), F.least(END, f"b_{END}")
    pieces = overlap_join(p, of("unresolved")).select("segment_id", *KEYS, low.alias(START), high.alias(END), F.col(f"b_{START}").alias("low"), F.col(f"b_{END}").alias("high"))
    inside = lambda hit: hit & (F.col(f"b_{START}") >= F.col("low")) & (F.col(f"b_{END}") <= F.col("high"))
    part = F.struct(F.col(f"b_{START}").alias("a"), F.col(f"b_{END}").alias("b"))
    parts = per_row(pieces, of("target"), KEYS, lambda hit: [F.sort_array(F.collect_set(F.when(inside(hit), part))).alias("parts")])
    reach = F.aggregate("parts", F.col(START), lambda acc, x: F.when(x["a"] <= acc, F.greatest(acc, x["b"])).otherwise(acc))
    open_ = parts.where(reach < F.col(END)).select("segment_id").distinct().withColumn("open", F.lit(True))
    state = F.when(F.col("other"), "other").when(F.col("open"), "unresolved").otherwise("uncontested")
    return other.join(open_, "segment_id", "left").select("segment_id", state.alias("state"))


INSTALLED = "source_id long, segment_id long, installed boolean, reason string, replaced long"


def install(proposals: DataFrame, accepted: DataFrame, evidence: DataFrame) -> DataFrame:
    """Proposals in the order of start_ms, segment_id go in where they have no local conflict and
    cut no accepted row short; those they hold whole they replace, earlier installed ones
    included.  Gives each proposal's decision, its reason, and the number of rows it replaced."""
    states = local_conflicts(proposals, evidence)
    p = proposals.select("segment_id", *KEYS, START, END).join(states, "segment_id").withColumn("proposal", F.lit(True))
    a = accepted.select("segment_id", *KEYS, START, END, F.lit(None).cast("string").alias("state"), F.lit(False).alias("proposal"))

    def fold(some: SimpleNamespace) -> list:
        rows = list(zip(some.proposal, some.source_id, some.segment_id, some.start_ms, some.end_ms, some.state, strict=True))
        starts, ends = [r[3] for r in rows if not r[0]], [r[4] for r in rows if not r[0]]
        tops = [np.array(ends, np.int64)]  # the largest of 1, 2, 4, ... ends from each place on
        while 2 << (len(tops) - 1) <= len(ends):
            half = 1 << (len(tops) - 1)
            tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))

        def top(i: int, j: int) -> int:
            level = (j - i).bit_length() - 1
            return max(tops[level][i], tops[level][j - (1 << level)])

        # As starts ascend, what begins before a proposal stays for good: its largest end is enough.  Of what begins with it or
        # later there are the accepted rows from `at` on and at most one proposal, with the same start.
        before, at, same, out = None, 0, None, []
        for proposal, source, segment, a, b, state in rows:
            if not proposal:
                continue
            if same and same[0] < a:
                before, same = max(same[1], same[1] if before is None else before), None
            i = bisect_left(starts, a, at)
            if i > at:
                passed = int(top(at, i))
                before, at = passed if before is None else max(before, passed), i
            j = bisect_left(starts, b, at)
            cut = (before is not None and before > a) or (j > at and top(at, j) > b) or (same is not None and same[1] > b)
            reason = "local_identity_conflict" if state != "uncontested" else "would_truncate_existing" if cut else "eligible"
            n = 0
            if reason == "eligible":
                n, at, same = j - at + (same is not None), j, (a, b)
            out.append((source, segment, reason == "eligible", reason, n))
        return out

    return fold_runs(p.unionByName(a), 0, fold, INSTALLED)


def distinct_timed_texts(parts: DataFrame, tolerance: int = 350) -> DataFrame:
    """Timed texts without repeats: a part with the same squeezed text as a kept one that began
    within the lookback, and that overlaps it or has nearly its edges, is a repeat; the longer of
    both stays, in the first one's place.  Empty texts and times fall out.  parts: text."""
    lookback, end_tolerance = max(1000, 2 * tolerance), max(2 * tolerance, 750)

    def fold(some: SimpleNamespace) -> list:
        kept: list[list] = []
        places: dict[str, list[int]] = defaultdict(list)  # of kept parts with a squeezed text
        began: deque[tuple[int, int]] = deque()  # (start, place) as parts were kept or changed
        seen = -1  # the last place that is too old: looking back stops there
        for source, i, a, b, text, key in zip(some.source_id, some.segment_id, some.start_ms, some.stop_ms, some.text, some.squeezed, strict=True):
            while began and a - began[0][0] > lookback:
                start, place = began.popleft()
                if kept[place][2] == start:
                    seen = max(seen, place)
            for place in reversed(places[key]):
                k = kept[place]
                if place <= seen:
                    place = None
                    break
                if min(b, k[3]) > max(a, k[2]) or (abs(a - k[2]) <= tolerance and abs(b - k[3]) <= end_tolerance):
                    if b - a > k[3] - k[2]:
                        k[1:5] = [i, a, b, text]
                        began.append((a, place))
                    break
            else:
                place = None
            if place is None:
                places[key].append(len(kept))
                began.append((a, len(kept)))
                kept.append([source, i, a, b, text])
        return kept

    squeezed = F.regexp_replace(F.coalesce("text", F.lit("")), "(?U)\\s+", "")
    rows = parts.withColumns({"squeezed": squeezed, "stop_ms": F.col(END)}).where((squeezed != "") & (F.col(END) > F.col(START)))
    # Only starts matter for how far back a part looks.
    points = rows.select("segment_id", *KEYS, START, F.col(START).alias(END), "stop_ms", "text", "squeezed")
    return fold_runs(points, lookback, fold, "source_id long, segment_id long, start_ms long, end_ms long, text string", order=(START, "stop_ms", "segment_id"))


def fold_parallel_captions(cues: DataFrame, tolerance: int = 150) -> DataFrame:
    """Spoken cues whose edges are those of the kept cue before, give or take the tolerance, fold
    into it if they say the same: equal squeezed texts, or one in kana and a translation in Han
    characters, unless both name different actors.  The text in kana stays.  cues: text, kind,
    actor."""

    def parallel(p: dict, text: str, actor: str) -> bool:
        if p["actor"] and actor and p["actor"] != actor:
            return False
        if "".join(p["text"].split()) == "".join(text.split()):
            return True
        first, second = bool(KANA.search(p["text"])), bool(KANA.search(text))
        return first != second and bool(CJK.search(text if first else p["text"]))

    def fold(some: SimpleNamespace) -> list:
        out: list[dict] = []
        for segment, source, a, b, text, kind, actor in zip(some.segment_id, some.source_id, some.start_ms, some.stop_ms, some.text, some.kind, some.actor, strict=True):
            p = out[-1] if out else None
            near = p and abs(a - p["start_ms"]) <= tolerance and abs(b - p["end_ms"]) <= tolerance
            if near and kind == p["kind"] == "speech" and parallel(p, text or "", actor or ""):
                if KANA.search(text or "") and not KANA.search(p["text"]):
                    p["text"] = text
                continue
            out.append({"segment_id": segment, "source_id": source, "start_ms": a, "end_ms": b, "text": text or "", "kind": kind, "actor": actor or ""})
        return [tuple(p.values()) for p in out]

    points = cues.select("segment_id", *KEYS, START, F.col(START).alias(END), F.col(END).alias("stop_ms"), "text", "kind", "actor")
    return fold_runs(points, tolerance, fold, "segment_id long, source_id long, start_ms long, end_ms long, text string, kind string, actor string", order=(START, "stop_ms", "segment_id"))


def snap_to_words(rows: DataFrame, words: DataFrame, allowed: DataFrame, blocked: DataFrame, most: int = 80) -> DataFrame:
    """Edges inside a word move out to its edge, by `most` at the most, if the longer row lies
    within one allowed interval and meets no blocked one; the start is tried first, and the end
    with the start that came of it.  Words don't overlap each other.  Gives the rows with their
    new edges, the old ones as from_start and from_end, and blocked_words, the words that an edge
    could not move out of."""

    def hits(points: DataFrame, side: str) -> DataFrame:
        inside = lambda hit: F.when(hit & (F.col(f"b_{START}") < F.col(START)), F.struct(F.col(f"b_{START}").alias("a"), F.col(f"b_{END}").alias("b")))
        found = per_row(points, words.select(*KEYS, START, END), KEYS, lambda hit: [F.min(inside(hit)).alias(side)])
        return found.select("segment_id", side)

    def safe(df: DataFrame, low: Column, high: Column, out: str) -> DataFrame:
        tried = df.select("segment_id", *KEYS, low.alias(START), high.alias(END)).where(F.col(START).isNotNull() & F.col(END).isNotNull())
        within = lambda hit: [F.max(hit & (F.col(f"b_{START}") <= F.col(START)) & (F.col(f"b_{END}") >= F.col(END))).alias("within")]
        clear = per_row(per_row(tried, allowed, KEYS, within), blocked, KEYS, lambda hit: [F.max(hit).alias("met")])
        ok = F.coalesce("within", F.lit(False)) & ~F.coalesce("met", F.lit(False))
        return df.join(clear.select("segment_id", ok.alias(out)), "segment_id", "left")

    base = rows.select("segment_id", *KEYS, F.col(START).alias("from_start"), F.col(END).alias("from_end"))
    point = lambda c: base.select("segment_id", *KEYS, F.col(c).alias(START), (F.col(c) + 1).alias(END))
    at = base.join(hits(point("from_start"), "left"), "segment_id").join(hits(point("from_end"), "right"), "segment_id")
    low = F.when(F.col("from_start") - F.col("left.a") <= most, F.col("left.a"))
    high = F.when(F.col("right.b") - F.col("from_end") <= most, F.col("right.b"))
    at = safe(at.withColumns({"low": low, "high": high}), F.col("low"), F.col("from_end"), "left_ok")
    at = at.withColumn(START, F.when(F.col("left_ok"), F.col("low")).otherwise(F.col("from_start")))
    at = safe(at, F.col(START), F.col("high"), "right_ok")
    at = at.withColumn(END, F.when(F.col("right_ok"), F.col("high")).otherwise(F.col("from_end")))
    refused = F.array_compact(F.array(F.when(~F.col("left_ok"), F.col("left")), F.when(~F.col("right_ok"), F.col("right"))))
    return at.select("segment_id", *KEYS, START, END, "from_start", "from_end", F.array_distinct(refused).alias("blocked_words"))


def merge_tracks(first: DataFrame, second: DataFrame, blocked: DataFrame, changes: DataFrame, vetoes: DataFrame, certified: DataFrame, gap: int, cap: int) -> DataFrame:
    """Two tracks as one.  A row that meets a blocked interval, holds a veto whole, or has a change
    strictly inside is dropped; a row inside the kept one before adds its track to it; rows at most
    `gap` apart become one within `cap` if the whole is as free as each and lies in one certified
    interval; of overlapping rows that can't, the longer stays.  Gives start_ms, end_ms, tracks and
    how the row came: kept, contained, union or longer."""
    both = first.select("segment_id", *KEYS, START, END, F.lit(1).alias("track")).unionByName(second.select("segment_id", *KEYS, START, END, F.lit(2).alias("track")))
    points = changes.select(*KEYS, F.col("cut_ms").alias(START), (F.col("cut_ms") + 1).alias(END))
    evidence = {"blocked": blocked, "changes": points, "vetoes": vetoes, "certified": certified}

    def fold(some: SimpleNamespace) -> list:
        blocked, changes, vetoes, certified = (Spans(e.start_ms, e.end_ms) for e in (some.blocked, some.changes, some.vetoes, some.certified))

        def conflict(a: int, b: int) -> bool:
            return changes.inside(a + 1, b) or blocked.meet(a, b) or vetoes.inside(a, b)  # a change is one long

        out: list[list] = []
        for source, a, b, track in zip(some.source_id, some.start_ms, some.end_ms, some.track, strict=True):
            if conflict(a, b):
                continue
            left = out[-1] if out else None
            if left is None:
                out.append([source, a, b, {track}, "kept"])
                continue
            if left[1] <= a and left[2] >= b:
                left[3].add(track)
                left[4] = "contained" if left[4] == "kept" else left[4]
                continue
            space, low, high = a - left[2], left[1], max(left[2], b)
            if space <= gap and high - low <= cap and certified.hold(low, high) and not conflict(low, high):
                left[2], left[4] = high, "union"
                left[3].add(track)
            elif space < 0:
                if b - a > left[2] - left[1]:
                    left[1:4] = [a, b, {track}]
                left[4] = "longer"
            else:
                out.append([source, a, b, {track}, "kept"])
        return [(source, a, b, sorted(tracks), how) for source, a, b, tracks, how in out]

    beside = {k: (e.select(*KEYS, START, END), cap) for k, e in evidence.items()}
    schema = "source_id long, start_ms long, end_ms long, tracks array<int>, how string"
    return fold_runs(both, gap, fold, schema, order=(START, f"-{END}", "segment_id"), beside=beside)
