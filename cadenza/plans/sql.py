"""DuckDB expressions that several queries' SQL twins share."""

from __future__ import annotations

from cadenza.sources.fixtures import segments_sql

SEG, ERR, BUY, CLICK, VIEW = (segments_sql(k) for k in (None, "error", "purchase", "click", "view"))


def islands(src: str, gap: int = 0) -> str:
    return f"""(SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM {src}))"""


def merged(src: str, gap: int = 0, more: str = "") -> str:
    return f"""(SELECT source_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms{more} FROM {islands(src, gap)} GROUP BY source_id, island)"""


def subtracted(src: str, blocked: str, least: int = 0) -> str:
    """Pieces of rows with a segment_id; blocked has to be merged."""
    return f"""(SELECT segment_id, source_id, p AS start_ms, least(any_value(end_ms), coalesce(min(b_start), any_value(end_ms))) AS end_ms,
  any_value(o) AS row_start, any_value(end_ms) AS row_end FROM (
    SELECT st.*, b.start_ms AS b_start FROM (
      SELECT segment_id, source_id, end_ms, start_ms AS p, start_ms AS o FROM {src}
      UNION SELECT s.segment_id, s.source_id, s.end_ms, b.end_ms, s.start_ms FROM {src} s JOIN {blocked} b
        ON s.source_id = b.source_id AND b.end_ms > s.start_ms AND b.end_ms < s.end_ms) st
    LEFT JOIN {blocked} b ON b.source_id = st.source_id AND b.end_ms > st.p)
  GROUP BY segment_id, source_id, p HAVING least(any_value(end_ms), coalesce(min(b_start), any_value(end_ms))) - p > {least})"""


def pairs(a: str, b: str, least: int = 0) -> str:
    """Overlapping pairs x, y for use after FROM."""
    return f"{a} x JOIN {b} y ON x.source_id = y.source_id AND least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms) > {least}"


SHARED = "(least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms))"
