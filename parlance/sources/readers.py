"""Readers of log lines, interval files, histories, lexicons, cards, manifests and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.sources import sinks

# Fixed format: an interval of a TextGrid file.
TEXTGRID = r'xmin\s*=\s*([\d.]+)\s*\n\s*xmax\s*=\s*([\d.]+)\s*\n\s*text\s*=\s*"((?s:.*?))"'
SEGMENT = "struct<speaker_id:string,role:string,text:string,start:double,end:double,segment_id:string>"


def _ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def _object(line: Column) -> Column:
    """The line if it is a JSON object, else null."""
    return F.when(F.startswith(line, F.lit("{")) & F.try_parse_json(line).isNotNull(), line)


def json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(json): the lines that are JSON objects; anything else is skipped."""
    return spark.read.text(paths).select(_object(F.trim("value")).alias("json")).where("json is not null")


def prefixed_json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(json): what begins at a line's first brace, where that is a JSON object."""
    line = F.expr("substring(value, instr(value, '{'))")
    return spark.read.text(paths).where("instr(value, '{') > 0").select(_object(F.trim(line)).alias("json")).where("json is not null")


def role_of_file(name: Column) -> Column:
    """DOCTOR or PATIENT as the file's name says, else null."""
    found = F.upper(F.regexp_extract(F.lower(name), "(?:^|[^a-z])(doctor|patient)(?:[^a-z]|$)", 1))
    return F.when(found != "", found)


def textgrid(spark: SparkSession, paths: str | list[str], cutoff_ms: int) -> DataFrame:
    """(file, role, ordinal, start_ms, end_ms, text) of the intervals that say something before the cutoff.

    Ordinals count all intervals of the file from 1. Ends are cut to the cutoff;
    what is empty then goes. A file is one row while it is taken apart.
    """
    files = spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("file"), "value")
    return _intervals(files, cutoff_ms)


def packed_textgrid(spark: SparkSession, paths: str | list[str], cutoff_ms: int) -> DataFrame:
    """textgrid of many interval files packed as lines of JSON (file: its name, value: its text), so that a session is no file of its own."""
    return _intervals(spark.read.schema("file string, value string").json(paths), cutoff_ms)


def _intervals(files: DataFrame, cutoff_ms: int) -> DataFrame:
    column = lambda i: F.regexp_extract_all("value", F.lit(TEXTGRID), F.lit(i))
    each = files.select("file", F.posexplode(F.arrays_zip(column(1).alias("a"), column(2).alias("b"), column(3).alias("text"))).alias("at", "x"))
    rows = each.select("file", role_of_file(F.col("file")).alias("role"), (F.col("at") + 1).alias("ordinal"), _ms(F.col("x.a").try_cast("double")).alias("start_ms"), F.least(_ms(F.col("x.b").try_cast("double")), F.lit(cutoff_ms)).alias("end_ms"), F.trim("x.text").alias("text"))
    return rows.where("text <> '' and start_ms <= " + str(cutoff_ms) + " and end_ms > start_ms")


def histories(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Typed rows of history files: objects with an id and an array `segments`."""
    files = spark.read.schema(f"session_id long, segments array<{SEGMENT}>").json(paths)
    each = files.select("session_id", F.posexplode("segments").alias("position", "s"))
    return each.select("session_id", "position", F.coalesce("s.speaker_id", F.lit("")).alias("speaker_id"), F.coalesce("s.role", F.lit("UNKNOWN")).alias("role"), F.coalesce("s.text", F.lit("")).alias("text"), _ms(F.coalesce("s.start", F.lit(0.0))).alias("start_ms"), _ms(F.coalesce("s.end", F.lit(0.0))).alias("end_ms"))


def emission_spans(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(session_id, window_index, from_ms, until_ms) of the window records that emitted something."""
    kind = "event string, session_id long, window_index long, emitted_from_seconds double, emitted_until_seconds double"
    records = json_lines(spark, paths).select(F.from_json("json", kind).alias("r")).select("r.*").where("event = 'window_continuity'")
    at = lambda c: _ms(F.coalesce(c, F.lit(0.0)))
    return records.select("session_id", F.coalesce("window_index", F.lit(0)).alias("window_index"), at("emitted_from_seconds").alias("from_ms"), at("emitted_until_seconds").alias("until_ms")).where("until_ms > from_ms")


def session_rows(spark: SparkSession, path: str, session: int) -> DataFrame:
    """One session's rows of a store (see sinks), by position; the filter reaches the scan."""
    return sinks.stored(spark, path).where(F.col("session_id") == session).orderBy("position")


def lexicon(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, canonical, ordinal, variant) from lines `canonical | variant | variant`, # for remarks.

    Of lines with one canonical the first counts; a variant belongs to the first
    canonical that names it; case doesn't matter in either. Lines without a
    variant of their own are left out.
    """
    text = spark.read.text(paths, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where("trim(value) <> '' and not startswith(trim(value), '#')")
    parts = F.filter(F.transform(F.split("value", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    lines = text.select((F.col("line") + 1).alias("line"), parts.alias("parts")).where("size(parts) > 1")
    lines = lines.select("line", F.element_at("parts", 1).alias("canonical"), F.slice("parts", 2, F.size("parts")).alias("variants"))
    first = lambda by: F.row_number().over(Window.partitionBy(F.lower(by)).orderBy("line", "ordinal"))
    lines = lines.withColumn("ordinal", F.lit(0)).withColumn("n", first("canonical")).where("n = 1").drop("n", "ordinal")
    each = lines.select("line", "canonical", F.posexplode("variants").alias("ordinal", "variant"))
    return each.withColumn("n", first("variant")).where("n = 1").drop("n")


def cards(spark: SparkSession, paths: str | list[str], fields: list[str]) -> DataFrame:
    """(card_id, keywords) of the active cards that have exactly these fields, an id and a keyword."""
    rows = json_lines(spark, paths)
    keys, want = F.json_object_keys("json"), F.array(*map(F.lit, fields))
    exact = (F.size(F.array_except(keys, want)) == 0) & (F.size(F.array_except(want, keys)) == 0)
    card = F.from_json("json", "card_id string, status string, keywords array<string>").alias("c")
    return rows.where(exact).select(card).where("c.status = 'active' and c.card_id rlike '^[a-z0-9-]+$' and size(c.keywords) > 0").select("c.card_id", "c.keywords")


def verified_manifest(spark: SparkSession, manifest: str, files: str) -> DataFrame:
    """(ordinal, name, state): same, changed or missing, by the SHA-256 of each listed file's bytes."""
    listed = spark.read.schema("ordinal long, name string, sha256 string").json(manifest)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(files)
    held = found.select(F.element_at(F.split("path", "/"), -2).alias("name"), F.sha2("content", 256).alias("held"))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("held") == F.col("sha256"), "same").otherwise("changed")
    return listed.join(held, "name", "left").select("ordinal", "name", state.alias("state"))


def diarization(line: Column) -> Column:
    """Struct of (start_ms, end_ms, speaker) from `start end speaker`; null where a line says something else."""
    got = lambda i: F.regexp_extract(F.trim(line), r"^([\d.]+)\s+([\d.]+)\s+(\S+)", i)
    return F.when(got(3) != "", F.struct(_ms(got(1).try_cast("double")).alias("start_ms"), _ms(got(2).try_cast("double")).alias("end_ms"), got(3).alias("speaker")))


def timed_artifact(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(session_id, i, word, start_ms, end_ms) of word artifacts; times that aren't numbers count 0, ends before starts count as starts."""
    kind = "session_id long, words array<struct<word:string,start:string,end:string>>"
    each = json_lines(spark, paths).select(F.from_json("json", kind).alias("r")).select("r.session_id", F.posexplode("r.words").alias("i", "w"))
    at = lambda c: _ms(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    return each.select("session_id", "i", F.col("w.word").alias("word"), at("w.start").alias("start_ms"), F.greatest(at("w.start"), at("w.end")).alias("end_ms"))


def scenario_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(session_id, ordinal, role, text) of a scenario's events of type segment."""
    kind = "session_id long, events array<struct<type:string,role:string,text:string>>"
    each = spark.read.schema(kind).json(paths).select("session_id", F.posexplode("events").alias("ordinal", "e"))
    return each.where("e.type = 'segment'").select("session_id", "ordinal", "e.role", "e.text")


def artifacts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(run, files) of the files below a folder whose names match; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("run"), "path").groupBy("run").agg(F.count_distinct("path").alias("files"))


def phrase_inventory(rows: DataFrame) -> DataFrame:
    """(role, phrases, repeated, identity) of (role, phrase, hard_negative): blank phrases go, repeated ones count once.

    The identity is the SHA-256 of the role's sorted phrases, one to a line; hard
    negatives are not phrases.
    """
    kept = rows.where("not hard_negative").select("role", F.lower(F.trim("phrase")).alias("phrase")).where("phrase <> ''")
    each = kept.groupBy("role", "phrase").agg(F.count(F.lit(1)).alias("n"))
    line = F.array_join(F.array_sort(F.collect_list("phrase")), "\n")
    return each.groupBy("role").agg(F.count(F.lit(1)).alias("phrases"), F.count_if(F.col("n") > 1).alias("repeated"), F.sha2(line, 256).alias("identity"))
