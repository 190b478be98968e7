"""Exact texts of parts of timed rows: only whole, measured units count, nothing is estimated.

Units are arrays of struct text, start_ms, end_ms, estimated.  Blanks are Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.vectors import let

_BLANK = "(?U)[\\s\\x{1c}-\\x{1f}]"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, f"{_BLANK}+", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def complete_units(text: Column, units: Column, start: Column, end: Column) -> Column:
    """The units in order of time if they are the text's own: each has a text, measured bounds within the
    row and a length, none overlaps the next, and together they spell the text but for blanks.  Else null."""

    def real(u: Column) -> Column:
        fine = (squeezed(u["text"]) != "") & ~u["estimated"] & (u["start_ms"] >= start) & (u["start_ms"] < u["end_ms"]) & (u["end_ms"] <= end)
        return F.coalesce(fine, F.lit(False))

    def checked(ordered: Column) -> Column:
        plain = F.transform(ordered, lambda o: o["unit"])
        spelt = F.array_join(F.transform(plain, lambda u: squeezed(u["text"])), "")
        follow = F.zip_with(F.slice(plain, 1, F.size(plain) - 1), F.slice(plain, 2, F.size(plain)), lambda a, b: a["end_ms"] <= b["start_ms"])
        return F.when((spelt == squeezed(text)) & F.forall(follow, lambda x: x), plain)

    keyed = F.array_sort(F.transform(units, lambda u, i: F.struct(u["start_ms"], u["end_ms"], i.alias("i"), u.alias("unit"))))
    # Checks of single units come first, so that the order is over whole numbers only.
    return F.when((F.size(units) > 0) & F.forall(units, real), let(keyed, checked))


def timed_slice(text: Column, ordered: Column, start: Column, end: Column) -> Column:
    """The text of the units that meet the span, with the blanks between them; empty if the span cuts one, or
    meets none.  ordered: of `complete_units`."""
    place = lambda u: F.struct(u["start_ms"].alias("s"), u["end_ms"].alias("e"), F.char_length(squeezed(u["text"])).alias("n"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to"), F.lit(False).alias("cut"))

    def step(acc: Column, u: Column) -> Column:
        met = F.least(end, u["e"]) > F.greatest(start, u["s"])
        past = acc["at"] + u["n"]
        return F.struct(
            past.alias("at"),
            F.coalesce(acc["from"], F.when(met, acc["at"])).alias("from"),
            F.when(met, past).otherwise(acc["to"]).alias("to"),
            (acc["cut"] | (met & ((u["s"] < start) | (u["e"] > end)))).alias("cut"),
        )

    def sliced(found: Column) -> Column:
        # Places of the characters that aren't blank, in order.
        chars = F.split(text, "")
        solid = F.filter(F.transform(chars, lambda c, i: F.when(~c.rlike(f"^{_BLANK}$") & (c != ""), i + 1)), lambda i: i.isNotNull())

        def cut(places: Column) -> Column:
            first = F.get(places, found["from"])
            last = F.coalesce(F.get(places, found["to"]) - 1, F.char_length(text))
            return trimmed(F.substr(text, first, last - first + 1))

        return F.when(found["cut"] | found["from"].isNull(), F.lit("")).otherwise(let(solid, cut))

    return let(F.aggregate(F.transform(ordered, place), zero, step), sliced)


def list_line(text: Column) -> Column:
    """One line for a manifest: bars widened, line ends as blanks, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(text, "\\|", "／"), "\r\n|[\n\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]", "\n")
    return trimmed(F.regexp_replace(F.regexp_replace(lines, "\n$", ""), "\n", " "))


def partial_text(full: Column, explicit: Column, joined: Column, keeps: Column, keep: Column, start: Column, end: Column, *timings: Column) -> Column:
    """Text of a kept part of a row: the one given for exactly this part; else the joint text of all parts, if there
    is one part or as many pieces of text as parts; else the first complete timing's slice; else empty.

    explicit: array of struct start_ms, end_ms, text; keeps: array of struct start_ms, end_ms, relative to the row's
    start; keep: one of them.  Pieces of the joint text stand between two semicolons, narrow or wide, or on lines."""
    own = F.filter(explicit, lambda x: (x["start_ms"] == keep["start_ms"]) & (x["end_ms"] == keep["end_ms"]) & (x["text"] != ""))
    given = F.get(own, F.lit(0))["text"]
    whole = trimmed(F.coalesce(joined, F.lit("")))
    pieces = F.split(F.regexp_replace(F.regexp_replace(whole, "；；|;;", "\n"), "\n$", ""), "\r\n|[\n\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]")
    place = F.array_position(F.transform(keeps, lambda k: F.struct(k["start_ms"], k["end_ms"])), F.struct(keep["start_ms"], keep["end_ms"])).cast("int")
    shared = F.when(F.size(keeps) == 1, whole).when((F.size(pieces) == F.size(keeps)) & (place > 0), F.get(pieces, place - 1))
    line = list_line(F.coalesce(full, F.lit("")))
    slices = [let(complete_units(line, t, start, end), lambda u: F.when(u.isNotNull(), timed_slice(line, u, start + keep["start_ms"], start + keep["end_ms"]))) for t in timings]
    found = F.coalesce(given, F.when(whole != "", shared), *slices, F.lit(""))
    return list_line(found)
