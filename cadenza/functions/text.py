"""Text functions as column expressions."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KANA = "[\\u3040-\\u30ff]"
CJK = "[\\u3040-\\u30ff\\u3400-\\u9fff]"
#: Marks that end a sentence, with optional closing quotes (fixed values).
TERMINAL = "[.!?。！？…]+[\"'”’」』)）]*$"


def safe_name(value: Column, fallback: str = "item", limit: int = 80) -> Column:
    """Runs of other than word characters become _; _ and . fall off the ends; at most 80."""
    cleaned = F.regexp_replace(value, "(?U)[^\\w.-]+", "_")
    cut = F.substring(F.regexp_replace(cleaned, "^[_.]+|[_.]+$", ""), 1, limit)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))


def language_of(text: Column, current: Column) -> Column:
    """Kana means ja; else a known code stays; else other CJK means zh; else the code or 'und'."""
    known = F.lower(F.trim(current))
    return F.when(text.rlike(KANA), "ja").when(known.isin("ja", "zh", "en", "fr", "de", "es"), known).when(text.rlike(CJK), "zh").otherwise("und")


def export_language(code: Column) -> Column:
    """Upper case, with long names mapped to codes; null for what holds a separator."""
    aliases = F.create_map(*[F.lit(x) for x in ("JAPANESE", "JA", "CHINESE", "ZH", "ENGLISH", "EN", "JP", "JA", "CN", "ZH")])
    upper = F.upper(F.trim(code))
    return F.when(~upper.rlike("[|/\\\\\\n]"), F.coalesce(F.try_element_at(aliases, upper), upper))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, clamped at 0, half-even at the millisecond."""
    ms = F.greatest(F.bround(seconds * 1000), F.lit(0)).cast("long")
    part = lambda n, width: F.lpad(n.cast("string"), width, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(
        F.when(hours > 99, hours.cast("string")).otherwise(part(hours, 2)), F.lit(":"), part(F.floor(ms / 60_000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(","), part(ms % 1000, 3)
    )


def join_texts(left: Column, right: Column) -> Column:
    """With one blank between, unless an edge is CJK or a side is empty."""
    a, b = F.rtrim(F.coalesce(left, F.lit(""))), F.ltrim(F.coalesce(right, F.lit("")))
    tight = (a == "") | (b == "") | a.rlike(CJK + "$") | b.rlike("^" + CJK)
    return F.when(tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def clean_dialogue(text: Column) -> Column:
    """Without markup and speaker labels; '' for music and for several speakers in one cue."""
    plain = F.regexp_replace(F.regexp_replace(text, "\\{[^}]*\\}|<[^>]*>", ""), "\\\\[Nn]", "\n")
    several = plain.rlike("(?ms)^\\s*[-–—][^\\S\\n]*\\S.*^\\s*[-–—][^\\S\\n]*\\S")
    plain = F.regexp_replace(plain, "(?m)^\\s*[-–—]\\s*", "")
    bare = F.regexp_replace(plain, "(?m)^\\s*(\\([^)]*\\)|\\[[^\\]]*\\]|[A-Z][\\w .]{0,20}:)\\s*", "")
    return F.when(plain.rlike("[♪♫♬]") | several, "").otherwise(F.trim(F.regexp_replace(bare, "\\s+", " ")))


def training_text(revised: Column, text: Column, heard: Column) -> Column:
    """The revised text, else the text, else what was heard; on one line, without separators."""
    first = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (revised, text, heard)])
    return F.trim(F.regexp_replace(F.regexp_replace(first, "\\|", "／"), "\\s+", " "))


def is_complete(text: Column) -> Column:
    return F.rtrim(text).rlike(TERMINAL)


def has_content(text: Column) -> Column:
    """Any letter or number."""
    return text.rlike("[\\p{L}\\p{N}]")


def sentences(text: Column) -> Column:
    """Pieces up to and with their terminal marks."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("([^.!?。！？\\n]+[.!?。！？]*)"), 1), lambda x: F.trim(x)), lambda x: x != "")


def infer_language(text: Column, reported: Column) -> Column:
    """Kana means ja; else what was reported, by its code; Han characters mean zh where nothing
    better was; an empty report is 'auto'."""
    t, r = F.coalesce(text, F.lit("")), F.lower(F.coalesce(F.nullif(reported, F.lit("")), F.lit("auto")))
    plain = F.when(r.isin("chinese", "mandarin"), "zh").when(r.isin("japanese", "ja"), "ja")
    return F.when(t.rlike(KANA), "ja").otherwise(F.coalesce(plain, F.when(t.rlike("[\\u4e00-\\u9fff]"), "zh"), r))


BLANK = " \t\n\x0b\x0c\r"
_NO_BLANK = dict.fromkeys(map(ord, BLANK))


def _cuts_of(text: str | None, fragments) -> list[int] | None:
    if not text or fragments is None or any(f is None for f in fragments):
        return None
    sizes = [len(f.translate(_NO_BLANK)) for f in fragments]
    if 0 in sizes or "".join(fragments).translate(_NO_BLANK) != text.translate(_NO_BLANK):
        return None
    places = [i for i, c in enumerate(text) if c not in BLANK]
    return [0, *[places[n] for n in list(accumulate(sizes))[:-1]], len(text)]


def text_cuts(text: Column, fragments: Column) -> Column:
    """Where the fragments begin in the text, and its length: null if an empty one is among them
    or, blanks aside, they aren't the text.  One pass over both."""

    def cuts(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([_cuts_of(t, f) for t, f in zip(texts, parts, strict=True)], dtype=object)

    cuts.__annotations__ = {"texts": pd.Series, "parts": pd.Series, "return": pd.Series}
    return F.pandas_udf(cuts, "array<int>")(text, fragments)


def provenance(audited: Column, shown: Column, score: Column, reference: Column) -> tuple[Column, Column]:
    """How sure a crop's confidence is, and what it is: only an audit, else a navigation, of
    exactly the crop's span counts; a score that isn't finite is none."""
    finite = lambda c: F.when(~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")), c.cast("double"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    method = F.when(yes(audited), "exact_acoustic_identity_audit").when(yes(shown), "exact_review_navigation")
    return method, F.when(yes(audited), finite(score)).when(yes(shown), finite(reference))

#: Entities that captions hold (fixed values); others stay as they are.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def spoken_line(text: Column) -> Column:
    """What one speaker says in a cue: without markup, speaker names and labels in brackets, in one
    line; of a cue with kana and lines of Han characters alone, only the lines with kana.  '' for
    music, for several dashed lines, names or labels, and where no letter is left."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>|\\{[^}]*\\}", "")
    for name, char in ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    plain = F.replace(F.regexp_replace(plain, "\\\\[Nn]", "\n"), F.lit("\\h"), F.lit(" "))
    space = "(?U)^\\s+|\\s+$"
    trim = lambda x: F.regexp_replace(x, space, "")
    rows = F.split(plain, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    some = lambda xs: F.filter(xs, lambda x: x != "")
    many = lambda xs: F.size(F.array_distinct(some(xs))) > 1

    def of(lines: Column) -> Column:
        dashed = F.size(F.filter(lines, lambda x: x.rlike("(?U)^[-–—]\\s*\\S"))) > 1
        names = F.transform(F.split(plain, "\n"), lambda x: F.regexp_extract(x, "(?U)^(?:[-–—]\\s*)?([^:：\\n]{1,24})[:：]", 1))
        labels = F.transform(lines, lambda x: F.regexp_extract(x, "(?U)^[（(【\\[]([^）)】\\]]{1,24})[）)】\\]]\\s*\\S", 1))
        mixed = F.exists(lines, lambda x: x.rlike(KANA)) & F.exists(lines, lambda x: ~x.rlike(KANA) & x.rlike("[\\u4e00-\\u9fff]"))
        kept = F.when(mixed, F.filter(lines, lambda x: x.rlike(KANA))).otherwise(lines)
        for pattern in ("(?U)^[-–—]\\s*", "(?U)^[^:：]{1,24}[:：]\\s*", "(?U)^[（(【\\[][^）)】\\]]{1,24}[）)】\\]]\\s*"):
            kept = F.transform(kept, lambda x: F.regexp_replace(x, pattern, ""))  # noqa: B023
        clean = some(F.transform(kept, trim))
        joined = F.array_join(clean, "\u0000")
        line = F.when(F.exists(clean, lambda x: x.rlike(KANA)), F.replace(joined, F.lit("\u0000"), F.lit(""))).otherwise(F.replace(joined, F.lit("\u0000"), F.lit(" ")))
        line = trim(F.regexp_replace(line, "(?U)\\s+", " "))
        return F.when(plain.rlike("[♪♫♬]") | dashed | many(names) | many(labels) | ~line.rlike("\\p{L}"), "").otherwise(line)

    return F.element_at(F.transform(F.array(some(F.transform(rows, trim))), of), 1)
