"""Files as tables, and tables as files.

Readers keep a row a file only as long as a file is one unit (manifests, captions); all else is
columnar.  Schemas are stated, never inferred.  Rows that don't parse go to quarantine columns
or fall out as each docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENTENCE = (
    "start: double, end: double, text: string, language: string, speaker_score: double, accepted: boolean, "
    "reject_reason: string, audio_file: string, diagnostics: map<string,string>"
)
MANIFEST = f"batch_id string, target string, sentences array<struct<{SENTENCE}>>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Batch manifests: a row a sentence with its ordinal from 1.  Of a folder with both names,
    batch_manifest.json wins over manifest.json."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*manifest.json").json(path)
    file = F.col("_metadata.file_path")
    named = raw.select("*", F.regexp_extract(file, "^(.*)/[^/]*$", 1).alias("folder"), file.endswith("/batch_manifest.json").alias("main"))
    order = Window.partitionBy("folder").orderBy(F.desc("main"))
    one = named.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return one.select("batch_id", "target", "folder", F.posexplode("sentences").alias("pos", "s")).select("batch_id", "target", "folder", (F.col("pos") + 1).alias("ordinal"), "s.*")


def write_manifests(segments: DataFrame, path: str) -> None:
    """JSON lines of one object a batch: counts, reasons of rejection, and sentences in order.
    segments: batch_id, ordinal, accepted, reject_reason, and what a sentence holds."""
    other = [c for c in segments.columns if c != "batch_id"]
    reasons = segments.where("not accepted").groupBy("batch_id", F.coalesce(F.nullif("reject_reason", F.lit("")), F.lit("unknown")).alias("r")).agg(F.count("*").alias("n"))
    summary = reasons.groupBy("batch_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("r", "n")))).alias("reject_summary"))
    rows = segments.groupBy("batch_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in other if c != "ordinal"])), lambda a, b: a["ordinal"] - b["ordinal"]).alias("sentences"))
    rows.join(summary, "batch_id", "left").write.mode("overwrite").json(path)


def write_csv(segments: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in their order, with a header; other columns are dropped, missing ones empty."""
    known = set(segments.columns)
    segments.select(*[F.col(f) if f in known else F.lit(None).cast("string").alias(f) for f in fields]).write.mode("overwrite").option("header", True).csv(path)


def write_srt(lines: DataFrame, path: str) -> None:
    """lines: n, start, stop (seconds), text.  Blocks of one file stay in the order of n."""
    from cadenza.functions.text import srt_time

    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("stop")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    lines.repartitionByRange("n").sortWithinPartitions("n").select(block.alias("value")).write.mode("overwrite").text(path)


_TIME = "(?:(\\d+):)?(\\d{1,2}):(\\d{1,2})[.,](\\d{1,3})"


def _ms(text):
    """Milliseconds of a time stamp; hundredths and tenths count as such."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, _TIME, i), F.lit("")).cast("long"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(text, _TIME, 4), 3, "0").cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + fraction


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Captions in SRT, VTT and ASS: file, cue (from 1), start_ms, end_ms, text, style, kind.

    Karaoke tags and styles of songs make lyrics, placing tags and styles of signs make
    screen_text, all else is speech.  Comments, empty cues and those that end before they start
    fall out; exact repeats count once."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{srt,vtt,ass,ssa}").text(path, wholetext=True)
    file = raw.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\\r\\n?", "\n").alias("body"))
    blocks = file.where("not file rlike '(?i)[.](ass|ssa)$'").select("file", F.posexplode(F.split("body", "\\n\\s*\\n")).alias("i", "b"))
    arrow = F.regexp_extract("b", "([^\\n]*-->[^\\n]*)", 1)
    plain = blocks.where("b like '%-->%'").select(
        "file", "i", F.split_part(arrow, F.lit("-->"), F.lit(1)).alias("from"), F.split_part(arrow, F.lit("-->"), F.lit(2)).alias("to"),
        F.regexp_replace("b", "^[\\s\\S]*?-->[^\\n]*\\n?", "").alias("text"), F.lit("").alias("style"),
    )
    lines = file.where("file rlike '(?i)[.](ass|ssa)$'").select("file", F.posexplode(F.split("body", "\\n")).alias("i", "b")).where("b like 'Dialogue:%'")
    f = F.split(F.regexp_replace("b", "^Dialogue:\\s*", ""), ",", 10)
    styled = lines.select("file", "i", F.get(f, 1).alias("from"), F.get(f, 2).alias("to"), F.get(f, 9).alias("text"), F.get(f, 3).alias("style"))
    cues = plain.unionByName(styled).withColumns({"start_ms": _ms(F.col("from")), "end_ms": _ms(F.col("to"))})
    lyrics = F.col("text").rlike("\\\\k[fo]?\\d") | F.col("style").rlike("(?i)song|lyric|karaoke|\\b(op|ed)\\b")
    screen = F.col("text").rlike("\\\\(pos|move)\\(") | F.col("style").rlike("(?i)sign|screen|title")
    kind = F.when(lyrics, "lyrics").when(screen, "screen_text").otherwise("speech")
    bare = F.regexp_replace(F.regexp_replace("text", "\\{[^}]*\\}|<[^>]*>", ""), "\\\\[Nn]", "\n")
    clean = F.regexp_replace(bare, "^\\s+|\\s+$", "")
    cues = cues.select("file", "i", "start_ms", "end_ms", clean.alias("text"), "style", kind.alias("kind")).where("end_ms > start_ms and text <> ''")
    once = cues.groupBy("file", "start_ms", "end_ms", "text", "style", "kind").agg(F.min("i").alias("i"))
    order = Window.partitionBy("file").orderBy("start_ms", "i")
    return once.withColumn("cue", F.row_number().over(order)).drop("i")


def discover_sidecars(files: DataFrame) -> DataFrame:
    """(target, caption) for file names in column `path`: same stem or `stem.` as a prefix;
    ASS and SSA first, then names with jp or ja, then the shortest."""
    p = files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    media = p.where("lower(name) rlike '[.](mkv|mp4|wav|flac|mp3)$'").select(F.col("path").alias("target"), F.regexp_replace("name", "[.][^.]*$", "").alias("stem"))
    captions = p.where("lower(name) rlike '[.](ass|ssa|srt|vtt)$'").withColumn("bare", F.regexp_replace("name", "[.][^.]*$", ""))
    # Every prefix of the caption's name that ends before a dot is a stem that it may belong to.
    parts = F.split("bare", "[.]")
    stems = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    keyed = captions.select("path", "name", F.explode(stems).alias("stem"))
    rank = Window.partitionBy("target").orderBy(F.desc(F.lower("name").rlike("[.](ass|ssa)$")), F.desc(F.lower("name").rlike("jp|ja")), F.length("name"), "path")
    return media.join(keyed, "stem").withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("target", F.col("path").alias("caption"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of every file below the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def import_packages(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, conflicts) of rows (sha, reference_key, role_key, label): one row a key, with its
    labels' number of rows; keys with more than one label are conflicts."""
    g = packages.groupBy("sha", "reference_key", "role_key").agg(F.min("label").alias("label"), F.count_distinct("label").alias("labels"), F.count("*").alias("n"))
    return g.where("labels = 1").drop("labels"), g.where("labels > 1").drop("label")


def save_bank(vectors: DataFrame, path: str) -> None:
    """A vector bank: the vectors, and one row of metadata to check them by."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    kept = spark.read.parquet(f"{path}/vectors")
    kept.agg(F.count("*").alias("n"), F.max(F.size("primary")).alias("width"), F.min(F.size("primary")).alias("least")).write.mode("overwrite").parquet(f"{path}/meta")


def load_bank(spark: SparkSession, path: str) -> DataFrame:
    """The bank's vectors; fails if their number or a width isn't what was saved."""
    v = spark.read.parquet(f"{path}/vectors")
    meta = spark.read.parquet(f"{path}/meta").first()
    got = v.agg(F.count("*").alias("n"), F.max(F.size("primary")).alias("width"), F.min(F.size("primary")).alias("least")).first()
    if tuple(meta) != tuple(got) or meta.width != meta.least:
        raise ValueError(f"the bank holds {tuple(got)}; saved were {tuple(meta)}")
    return v


def missing_features(wanted: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Keys that the store hasn't: the only ones to compute."""
    return wanted.select(key).distinct().join(store.select(key), key, "left_anti")


def upsert(store: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The store with new rows in place of old ones of their key."""
    return store.join(new.select(key), key, "left_anti").unionByName(new)


#: What a review may hold (fixed names); anything else in it falls out.
REVIEW = (
    "ordinal int, filename string, label string, partial_start double, partial_end double, partial_text string, "
    "partial_intervals array<array<double>>, partial_texts array<struct<start: double, end: double, text: string>>, "
    "notes string, revised_text string"
)


def read_reviews(spark: SparkSession, path: str, name: str = "*review*.json") -> DataFrame:
    """Review maps: a row a review, with its folder and key.  Entries that aren't objects fall out,
    as do fields of other names; a file without reviews has none."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    held = F.from_json(F.get_json_object("value", "$.reviews"), "map<string,string>")
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1).alias("folder"), F.explode(held).alias("key", "item"))
    objects = rows.where(F.ltrim("item").startswith("{"))
    return objects.select("folder", "key", F.from_json("item", REVIEW).alias("r")).select("folder", "key", "r.*")


def read_cluster_reports(spark: SparkSession, path: str) -> DataFrame:
    """Cluster reports anywhere under the path: a row a cluster, with the report's folder relative
    to the path ('.' for the path itself).  Files that hold no list of clusters fall out."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="cluster_report.json")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    base = str(root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root)).rstrip("/")
    folder = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1), "^[a-z]+:/+", "/")
    plain = "/" + base.split(":", 1)[-1].lstrip("/") if ":" in base else base
    inside = F.regexp_replace(F.substr(folder, F.lit(len(plain) + 1)), "^/+", "")
    clusters = F.get_json_object("value", "$.clusters")
    listed = raw.where(F.ltrim(clusters).startswith("["))
    return listed.select(F.coalesce(F.nullif(inside, F.lit("")), F.lit(".")).alias("folder"), F.posexplode(F.from_json(clusters, "array<string>")).alias("position", "cluster"))


def reference_clips(spans: DataFrame, lengths: DataFrame, gap: int = 350, pad: int = 50, longest: int = 8000, least: int = 800) -> DataFrame:
    """Which clips to cut of each reference: its spans, merged over `gap` and padded, in pieces of
    `longest`, of which a last one under `least` falls out; a reference that gives none is one
    clip, whole.  spans: source_id, start_ms, end_ms; lengths: source_id, length_ms.  Rows only:
    source_id, clip (from 1), start_ms, end_ms."""
    from cadenza.operators.intervals import END, START, merge

    padded = merge(spans, ("source_id",), gap).join(lengths, "source_id")
    padded = padded.select("source_id", F.greatest(F.col(START) - pad, F.lit(0)).alias("a"), F.least(F.col(END) + pad, F.col("length_ms")).alias("b"))
    starts = F.sequence(F.col("a"), F.col("b") - least, F.lit(longest))
    pieces = padded.where(F.col("b") - F.col("a") >= least).select("source_id", "b", F.explode(starts).alias(START))
    pieces = pieces.select("source_id", START, F.least(F.col("b"), F.col(START) + longest).alias(END))
    whole = lengths.join(pieces.select("source_id"), "source_id", "left_anti").select("source_id", F.lit(0).cast("long").alias(START), F.col("length_ms").alias(END))
    number = F.row_number().over(Window.partitionBy("source_id").orderBy(START))
    return pieces.unionByName(whole).select("source_id", number.alias("clip"), START, END)
