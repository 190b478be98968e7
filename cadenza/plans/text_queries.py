"""Queries over texts: scalar functions, cue and transcript assembly, over the turns of
`conversations` and the texts of `documents`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import text as tf
from cadenza.plans.catalogue import register
from cadenza.sources import fixtures as fx

KANA, CJK = "[ぁ-ヿ]", "[ぁ-ヿ㐀-鿿]"


def turns(spark, d):
    return fx.table(spark, d, "conversations")


@register("X1_safe_name", r"""SELECT conv_id, turn, coalesce(nullif(substr(regexp_replace(regexp_replace(substr(text, 1, 60), '[^\p{L}\p{N}_.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 1, 80), ''), 'item') AS name FROM conversations""")
def safe_name(spark, d):
    return turns(spark, d).select("conv_id", "turn", tf.safe_name(F.substring("text", 1, 60)).alias("name"))


@register("X1_safe_name_whole")
def safe_name_whole(spark, d):
    """Of whole texts; the SQL twin of X1_safe_name states a prefix."""
    return turns(spark, d).select("conv_id", "turn", tf.safe_name(F.col("text")).alias("name"))


@register("X2_language_of_text", f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{KANA}') THEN 'ja' WHEN lower(trim(lang)) IN ('ja', 'zh', 'en', 'fr', 'de', 'es') THEN lower(trim(lang)) WHEN regexp_matches(text, '{CJK}') THEN 'zh' ELSE 'und' END AS language FROM documents""")
def language_of_text(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tf.language_of(F.col("text"), F.col("lang")).alias("language"))


@register("X4_export_language", "SELECT doc_id, upper(trim(lang)) AS code FROM documents")
def export_language(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tf.export_language(F.col("lang")).alias("code"))


@register("X5_srt_time", """SELECT event_id, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS srt
  FROM (SELECT event_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM events)""")
def srt_time(spark, d):
    return fx.table(spark, d, "events").select("event_id", tf.srt_time(F.col("value")).alias("srt"))


@register("X6_join_texts", f"""SELECT conv_id, turn, CASE WHEN a = '' OR b = '' OR regexp_matches(a, '{CJK}$') OR regexp_matches(b, '^{CJK}') THEN a || b ELSE a || ' ' || b END AS joined
  FROM (SELECT conv_id, turn, rtrim(substr(text, 1, 40), ' ') AS a, ltrim(substr(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), 1, 40), ' ') AS b FROM conversations)""")
def join_texts(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, d).withColumn("n", F.lead("text").over(w))
    return t.select("conv_id", "turn", tf.join_texts(F.substring("text", 1, 40), F.substring("n", 1, 40)).alias("joined"))


@register("X6_join_texts_whole")
def join_texts_whole(spark, d):
    """Of whole texts; the SQL twin of X6_join_texts states prefixes."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns(spark, d).withColumn("n", F.lead("text").over(w)).select("conv_id", "turn", tf.join_texts(F.col("text"), F.col("n")).alias("joined"))


@register("X8_training_text", r"""SELECT conv_id, turn, trim(regexp_replace(replace(CASE WHEN turn % 3 = 0 THEN trim(role) || '|' || trim(text) ELSE trim(text) END, '|', '／'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS line FROM conversations""")
def training_text(spark, d):
    revised = F.when(F.col("turn") % 3 == 0, F.concat(F.trim("role"), F.lit("|"), F.trim("text")))
    return turns(spark, d).select("conv_id", "turn", tf.training_text(revised, F.col("text"), F.lit(None).cast("string")).alias("line"))


@register("X10_complete_text", """SELECT doc_id, regexp_matches(rtrim(coalesce(text, ''), ' '), '[.!?。！？…]+["''”’」』)）]*$') AS complete FROM documents""")
def complete_text(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tf.is_complete(F.coalesce("text", F.lit(""))).alias("complete"))


@register("X16_has_content", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')")
def has_content(spark, d):
    return fx.table(spark, d, "documents").where(tf.has_content(F.col("text"))).select("doc_id")


PARTS = r"""(SELECT conv_id, turn, i, trim(p, ' ') AS sentence FROM (SELECT conv_id, turn, unnest(s) AS p, generate_subscripts(s, 1) AS i FROM
  (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[^.!?。！？\n]+[.!?。！？]*'), lambda x: trim(x, ' ') <> '') AS s FROM conversations)))"""


def parts(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.posexplode(tf.sentences(F.col("text"))).alias("i", "sentence")).withColumn("i", (F.col("i") + 1).cast("long"))


@register("X11_timed_sentences", f"""SELECT conv_id, turn, i, sentence, round(10.0 * (upto - length(sentence)) / total, 6) AS start, round(10.0 * upto / total, 6) AS stop FROM (
  SELECT *, sum(length(sentence)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS upto, sum(length(sentence)) OVER (PARTITION BY conv_id, turn) AS total FROM {PARTS})""")
def timed_sentences(spark, d):
    """Each turn lasts ten seconds; its sentences share them by their characters."""
    w = Window.partitionBy("conv_id", "turn")
    p = parts(spark, d).withColumn("n", F.char_length("sentence"))
    p = p.withColumns({"upto": F.sum("n").over(w.orderBy("i")), "total": F.sum("n").over(w)})
    share = lambda c: F.round(10.0 * c / F.col("total"), 6)
    return p.select("conv_id", "turn", "i", "sentence", share(F.col("upto") - F.col("n")).alias("start"), share(F.col("upto")).alias("stop"))


@register("X12_assemble_on_flush", f"""SELECT conv_id, CAST(g AS BIGINT) AS g, count(*) AS n, string_agg(sentence, ' ' ORDER BY turn, i) AS text FROM (
  SELECT *, sum(flush) OVER (PARTITION BY conv_id ORDER BY turn, i) AS g FROM (SELECT *, CASE WHEN regexp_matches(lag(sentence) OVER (PARTITION BY conv_id ORDER BY turn, i), '[.!?]$') THEN 1 ELSE 0 END AS flush FROM {PARTS})) GROUP BY conv_id, g""")
def assemble_on_flush(spark, d):
    """Pieces join until one ends in a terminal mark."""
    w = Window.partitionBy("conv_id").orderBy("turn", "i")
    p = parts(spark, d).withColumn("flush", F.when(F.lag("sentence").over(w).rlike("[.!?]$"), 1).otherwise(0)).withColumn("g", F.sum("flush").over(w))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "i", "sentence")))
    return p.groupBy("conv_id", "g").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["sentence"]), " ").alias("text"))


@register("X21_digest_keys", "SELECT source, sha256(count(*) || ':' || CAST(sum(doc_id) AS BIGINT) || ':' || CAST(sum(doc_id * doc_id % 1000003) AS BIGINT)) AS key FROM documents GROUP BY source")
def digest_keys(spark, d):
    """A key of each source's set of ids, the same in whatever order rows come, from sums that
    merge: no list of a source's ids is ever held."""
    docs = fx.table(spark, d, "documents").select("source", "doc_id").groupBy("source")
    sums = docs.agg(F.count("*").alias("n"), F.sum("doc_id").alias("a"), F.sum(F.col("doc_id") * F.col("doc_id") % 1000003).alias("b"))
    text = F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return sums.select("source", F.sha2(text.cast("binary"), 256).alias("key"))


@register("X25_token_bigrams", """SELECT lang, count(DISTINCT b) AS bigrams FROM (SELECT lang, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: lang || ':' || w[i] || '>' || w[i + 1])) AS b
  FROM (SELECT lang, list_filter(string_split(lower(replace(text, chr(10), ' ')), ' '), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 1) GROUP BY lang""")
def token_bigrams(spark, d):
    w = F.filter(F.split(F.lower(F.regexp_replace("text", "\n", " ")), " "), lambda x: x != "")
    docs = fx.table(spark, d, "documents").select("lang", w.alias("w")).where(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(F.col("lang"), F.lit(":"), a, F.lit(">"), b))
    distinct = docs.select("lang", F.explode(F.array_distinct(pairs)).alias("b")).distinct()
    return distinct.groupBy("lang").agg(F.count("*").alias("bigrams"))


@register("F9_drop_marked_texts", "SELECT regexp_matches(text, '(?i)^licensed under') AS dropped, count(*) AS n FROM documents GROUP BY 1")
def drop_marked_texts(spark, d):
    """Texts with a boilerplate opening against the others, as an audit."""
    docs = fx.table(spark, d, "documents").select(F.col("text").rlike("(?i)^licensed under").alias("dropped"))
    return docs.groupBy("dropped").agg(F.count("*").alias("n"))


@register("J12_attach_fragments", "SELECT conv_id, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS text, (SELECT role FROM conversations x WHERE x.conv_id = c.conv_id GROUP BY role ORDER BY count(*) DESC, role LIMIT 1) AS role FROM conversations c GROUP BY conv_id")
def attach_fragments(spark, d):
    """Ordered concatenation with the most frequent role; the first by name in a tie."""
    t = turns(spark, d)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    joined = t.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(texts, " ").alias("text"))
    role = t.groupBy("conv_id", "role").agg(F.count("*").alias("k")).groupBy("conv_id").agg(F.min_by("role", F.struct(-F.col("k"), "role")).alias("role"))
    return joined.join(role, "conv_id")


@register("S6_training_manifest", r"""SELECT conv_id, turn, 'clips/' || conv_id || '_' || turn || '.wav|' || role || '|EN|' || trim(regexp_replace(replace(trim(text, ' '), '|', '／'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS line FROM conversations WHERE regexp_matches(text, '[\p{L}\p{N}]')""")
def training_manifest(spark, d):
    t = turns(spark, d).where(tf.has_content(F.col("text")))
    none = F.lit(None).cast("string")
    path = F.concat(F.lit("clips/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".wav"))
    return t.select("conv_id", "turn", F.concat_ws("|", path, "role", F.lit("EN"), tf.training_text(none, F.col("text"), none)).alias("line"))


@register("J30_text_previews", "SELECT conv_id, role, array_to_string((list_distinct_ordered)[1:4], ' / ') AS previews FROM (SELECT conv_id, role, list(p ORDER BY first_turn) AS list_distinct_ordered FROM (SELECT conv_id, role, substr(text, 1, 30) AS p, min(turn) AS first_turn FROM conversations GROUP BY ALL) GROUP BY conv_id, role)")
def text_previews(spark, d):
    """Up to four distinct openings of each role, in order."""
    p = turns(spark, d).groupBy("conv_id", "role", F.substring("text", 1, 30).alias("p")).agg(F.min("turn").alias("first"))
    ordered = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("first", "p"))), 1, 4), lambda x: x["p"])
    return p.groupBy("conv_id", "role").agg(F.array_join(ordered, " / ").alias("previews"))


@register("X9_text_similarity")
def text_similarity(spark, d):
    """2 * LCS / (lengths) of letters of neighbouring turns, vectorised."""
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, d).withColumn("n", F.lead("text").over(w)).where("n is not null")
    return t.select("conv_id", "turn", F.round(F.pandas_udf(ratio, "double")("text", "n"), 6).alias("similarity"))


def lcs_ratio(a: str, b: str) -> float:
    """Longest common subsequence of the letters, by bits of one integer a row."""
    a, b = ([c for c in x.lower() if c.isalpha()] for x in (a, b))
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))
