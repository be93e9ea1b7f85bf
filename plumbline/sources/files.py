"""Files of texts, features and settings: whole texts, JSON lines, CSV, RTF, manifests, feature caches, models."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import lexicon as lex
from plumbline.operators import corpus
from plumbline.operators.corpus import cache_key

DOCUMENT = "id string, text string, labels array<array<int>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Single texts (id, text, labels) of JSON-lines files; a broken line fails."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)


def write_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as JSON lines, a folder for each value of `by`."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; quoted fields may hold line ends and doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_texts(spark: SparkSession, path: str, recursive: bool = True, endings: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(id, text, synthetic): whole text files, tidied unless they stand in a folder named generated; empty ones are left out."""
    read = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(endings) + "}").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    rows = read.select(F.regexp_extract(name, r"([^/]+)\.[^./]+$", 1).alias("id"), F.btrim("value", F.lit(" \t\r\n")).alias("text"), F.contains(name, F.lit("/generated/")).alias("synthetic")).where("text <> ''")
    return rows.withColumn("text", F.when(F.col("synthetic"), F.col("text")).otherwise(corpus.tidy(F.col("text"))))


#: What whole texts are stripped of at their ends.
ENDS = " \t\r\n"


def line_size(line: str, tidied: bool) -> tuple[int, bool, bool]:
    """(characters, blank lines before, blank lines after) of a line as corpus.tidy leaves it, -1 characters if it is blank; of the line itself if not tidied."""
    if not tidied:
        return len(line), False, False
    line = re.sub("[ \t]+", " ", line.removesuffix("\r").replace("\xad", "").replace("\xa0", " ")).strip(" ")
    # A mark that stands in a text counts as the break that tidy makes of it.
    return (len(line) + line.count("\x01"), False, False) if line else (-1, True, True)


def joined_sizes(a: tuple | None, b: tuple | None) -> tuple | None:
    """The size of lines that follow each other: a newline or blank between them, two newlines for blank lines; None without lines."""
    if a is None or b is None:
        return a or b
    if a[0] < 0:
        return (b[0], True, b[2])
    if b[0] < 0:
        return (a[0], a[1], True)
    return (a[0] + b[0] + (2 if a[2] or b[1] else 1), a[1], b[2])


class Size:
    """The size of a stretch of lines, read one by one, for each case of its ends: [left][right], stripped (1) as the ends of a text or not (0)."""

    def __init__(self, tidied: bool) -> None:
        self.tidied = tidied
        self.before: list[tuple | None] = [None, None]
        self.open: str | None = None
        self.after: tuple | None = None
        self.first = True

    def put(self, line: str) -> None:
        if not line.strip(ENDS):
            self.after = joined_sizes(self.after, line_size(line, self.tidied))
            return
        if self.open is None:
            self.before = [self.after, None]
        else:
            self.before, self.first = [joined_sizes(self._until(left, 0), self.after) for left in (0, 1)], False
        self.open, self.after = line, None

    def _until(self, left: int, right: int) -> tuple | None:
        line = self.open.lstrip(ENDS) if left and self.first else self.open
        return joined_sizes(self.before[left], line_size(line.rstrip(ENDS) if right else line, self.tidied))

    def flat(self) -> list[int]:
        """has (whether anything but ENDS is there), then the four sizes."""
        if self.open is None:
            return [0, *map(int, self.after * 4)]
        return [1, *(int(v) for left in (0, 1) for right in (0, 1) for v in (self._until(left, right) if right else joined_sizes(self._until(left, 0), self.after)))]


def whole_size(parts: list[list[int]]) -> int | None:
    """Characters of a text whose stretches have these flat sizes, in order; None if nothing but ENDS is there."""
    held = None
    for p in parts:
        has, v = p[0], [tuple(p[i : i + 3]) for i in (1, 4, 7, 10)]
        if held is None:
            held = has, v
        elif not has:
            held = held[0], [joined_sizes(x, v[0]) if not held[0] or i % 2 == 0 else x for i, x in enumerate(held[1])]
        elif not held[0]:
            held = 1, [joined_sizes(held[1][0], v[0]), joined_sizes(held[1][0], v[1]), v[2], v[3]]
        else:
            held = 1, [joined_sizes(held[1][left], v[right]) for left in (0, 2) for right in (0, 1)]
    return max(0, held[1][3][0]) if held and held[0] else None


def text_lengths(spark: SparkSession, path: str, recursive: bool = True, endings: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(id, n_chars, synthetic): the lengths of the texts of read_texts, of files of any size.

    A file is read in blocks by several tasks, line by line, so no text is held whole and
    a line is the most that is. A byte order mark at the start of a file isn't counted."""
    read = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(endings) + "}").option("lineSep", "\n").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([size.flat()], pa.list_(pa.int64()))], ["file", "block", "size"])

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != at:
                    if at is not None:
                        yield out()
                    at, size = (file, block), Size("/generated/" not in file)
                size.put(line)
        if at is not None:
            yield out()

    held = rows.mapInArrow(sizes, "file string, block long, size array<long>").groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "size"))), lambda p: p["size"]).alias("parts"))
    whole = F.udf(whole_size, "long", useArrow=False)
    return held.select(F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("id"), whole("parts").alias("n_chars"), F.contains("file", F.lit("/generated/")).alias("synthetic")).where("n_chars is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, fields) of a manifest {"documents": {id: {...}}}; none if it holds something else."""
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", "documents map<string,map<string,string>>").alias("m"))
    return held.where("m.documents is not null").select(F.explode("m.documents").alias("id", "fields"))


def hash_problems(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, problem): documents of a manifest without a text, or whose text has another SHA-256 than it says."""
    own = texts.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("actual"))
    rows = manifest.join(own, "id", "left").withColumn("problem", F.when(F.col("actual").isNull(), "missing").when(~F.col("actual").eqNullSafe(F.try_element_at("fields", F.lit("text_sha256"))), "changed"))
    return rows.where("problem is not null").select("id", "problem")


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, agent, prefix): what robots files (host, text) disallow to whom; agents that may read all have a null prefix."""
    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).withColumn("line", F.btrim(F.regexp_replace("line", "#.*", "")))
    lines = lines.where(F.contains("line", F.lit(":"))).select("host", "at", F.lower(F.btrim(F.substring_index("line", ":", 1))).alias("key"), F.btrim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    from pyspark.sql import Window as W

    agent = F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True).over(W.partitionBy("host").orderBy("at"))
    lines = lines.withColumn("agent", agent).where("agent is not null")
    said = lines.where("key = 'disallow' and value <> ''").select("host", "agent", F.col("value").alias("prefix"))
    open_ = lines.select("host", "agent").distinct().join(said.select("host", "agent").distinct(), ["host", "agent"], "left_anti").withColumn("prefix", F.lit(None).cast("string"))
    return said.unionByName(open_)


def candidates(catalogue: DataFrame, themes: dict[str, str], wanted: str, disallowed: list[str]) -> DataFrame:
    """Catalogue rows (doc_id, name, url, order) that may be read, match a pattern and have a theme; the first of each doc_id."""
    rows = catalogue.where(F.col("name").rlike(wanted)).where(corpus.allowed(F.col("url"), disallowed)).withColumn("theme", corpus.first_match(F.lower("name"), themes))
    best = rows.where("theme is not null").groupBy("doc_id").agg(F.min_by(F.struct("name", "url", "order", "theme"), "order").alias("r"))
    return best.select("doc_id", "r.*")


def planned(found: DataFrame, existing: DataFrame, themes: list[str], needed: int, buffer: int = 40) -> DataFrame:
    """Which candidates (doc_id, theme, order) to fetch: a quota of each theme, in the order of themes, then the rest in their order, needed + buffer in all."""
    from pyspark.sql import Window as W

    quota, limit = max(1, max(0, needed) // max(1, len(themes))), max(0, needed) + max(0, buffer)
    fresh = found.join(existing.select("doc_id"), "doc_id", "left_anti").withColumn("n", F.row_number().over(W.partitionBy("theme").orderBy("order")))
    rank = F.array_position(F.array(*map(F.lit, themes)), F.col("theme"))
    first = (F.col("n") <= quota) & (rank > 0)
    return fresh.withColumn("first", first).orderBy(F.col("first").desc(), F.when(first, rank).otherwise(0), "order").limit(limit).select("doc_id", "theme", "first")


def extraction(pages: Column, layer: Column, scanned: Column, least: int = 120) -> Column:
    """How a document's text is had: its text layer if it holds enough characters a page, else the recognised text, else none."""
    enough = (pages > 0) & (F.length(F.coalesce(layer, F.lit(""))) >= least * pages)
    return F.when(enough, "layer").when(F.btrim(F.coalesce(scanned, F.lit("")), F.lit(" \t\r\n")) != "", "recognised").otherwise("none")


def extracted(rows: DataFrame) -> DataFrame:
    """Adds method, content and chars to rows (pages, layer, scanned)."""
    out = rows.withColumn("method", extraction(F.col("pages"), F.col("layer"), F.col("scanned")))
    out = out.withColumn("content", F.when(F.col("method") == "layer", F.col("layer")).when(F.col("method") == "recognised", F.col("scanned")).otherwise(""))
    return out.withColumn("chars", F.length("content"))


def plain_of_rtf(source: str | None) -> str:
    """The text of RTF: groups of service destinations left out at any depth, escapes decoded, control words as breaks or nothing."""
    out: list[str] = []
    skipped: int | None = None
    depth = 0
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)?[ ]?|\\([^a-zA-Z'])|([{}])|([^\\{}]+)", (source or "").replace("\r\n", "\n").replace("\r", "\n")):
        code, word, _, sign, brace, text = m.groups()
        if brace == "{":
            depth += 1
            head = re.match(r"\\\*?\\?([a-zA-Z]+)", source[m.end() : m.end() + 60]) if skipped is None else None
            if head and head[1].lower() in lex.RTF_SERVICE:
                skipped = depth
        elif brace == "}":
            if skipped == depth:
                skipped = None
            depth -= 1
        elif skipped is None:
            if code:
                out.append(bytes([int(code, 16)]).decode("cp1251", "replace"))
            elif word:
                out.append("\n" if word.lower() in lex.RTF_BREAKS else " " if word.lower() in lex.RTF_BLANKS else "")
            elif sign in ("{", "}", "\\"):
                out.append(sign)
            elif text:
                out.append(text)
    return "".join(out)


@F.pandas_udf(T.StringType())
def rtf_text(source: pd.Series) -> pd.Series:
    return source.map(plain_of_rtf)


# ---- features


def feature_rows(features: DataFrame, pairs: DataFrame, model: str = "", max_length: int = 512, chunked: bool = False) -> DataFrame:
    """(key, pair_id, max_length, chunked, a list for each working feature) as a feature cache holds them."""
    from plumbline.operators.shaping import feature_lists

    keys = pairs.select("pair_id", cache_key(F.lit("demo"), F.lit(model), max_length, F.col("answer"), F.col("context")).alias("key"))
    return keys.join(feature_lists(features), "pair_id").select("key", "pair_id", F.lit(max_length).alias("max_length"), F.lit(chunked).alias("chunked"), *lex.WEIGHTS)


def shard(rows: DataFrame, index: Column, shards: int, k: int) -> DataFrame:
    """The rows of one shard."""
    return rows.where(F.pmod(index, F.lit(shards)) == k)


def read_feature_cache(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Feature rows of all files features_*.json below a folder, the last of each key; strict fails where a list is empty."""
    lists = ", ".join(f"{n} array<double>" for n in lex.WEIGHTS)
    read = spark.read.schema(f"key string, pair_id string, max_length int, chunked boolean, {lists}").option("recursiveFileLookup", "true").option("pathGlobFilter", "features_*").json(path)
    rows = read.where("key <> ''").withColumn("place", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))
    last = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("key", "place")]), "place").alias("r")).select("key", "r.*")
    if not strict:
        return last
    empty = [F.when(F.coalesce(F.size(n), F.lit(0)) <= 0, n) for n in lex.WEIGHTS]
    missing = F.array_compact(F.array(*empty))
    return last.withColumn("key", F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("no values of "), F.array_join(missing, ", "), F.lit(" for "), F.col("key"))).cast("string")).otherwise(F.col("key")))


def cached_features(pairs: DataFrame, cache: DataFrame, model: str = "", max_length: int = 512) -> DataFrame:
    """pairs with the feature lists of a cache, and whether it had them."""
    keyed = pairs.withColumn("key", cache_key(F.lit("demo"), F.lit(model), max_length, F.col("answer"), F.col("context")))
    return keyed.join(cache.drop("pair_id", "max_length", "chunked").withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


# ---- settings and models


@dataclass(frozen=True)
class Settings:
    """What a verification is run with; unknown names are refused, missing ones have defaults."""

    threshold: float = lex.THRESHOLD
    span_z: float = lex.SPAN_Z
    span_floor: float = lex.SPAN_FLOOR
    span_cap: float = lex.SPAN_CAP
    rule: str = "corroborated"
    rule_params: dict = field(default_factory=dict)
    expansion: str = "clause"
    least_chars: int = 0
    weights: dict = field(default_factory=lambda: dict(lex.WEIGHTS))

    @classmethod
    def of(cls, values: dict) -> Settings:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)


def whole_text(spark: SparkSession, path: str) -> str:
    """The text of one file wherever Spark can read it."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return rows[0][0]


def read_settings(spark: SparkSession, path: str) -> Settings:
    return Settings.of(json.loads(whole_text(spark, path)))


def write_settings(spark: SparkSession, settings: Settings, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(settings), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str, needed: tuple[str, ...]) -> dict:
    """A model's JSON object, which must hold the needed fields."""
    model = json.loads(whole_text(spark, path))
    missing = [n for n in needed if n not in model]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return model


def chunked_payloads(rows: DataFrame, size: int) -> DataFrame:
    """(name, idx, payload) of (name, payload): payloads in chunks of `size` characters, one empty chunk for an empty one."""
    n = F.greatest(F.lit(1), F.ceil(F.length("payload") / size)).cast("int")
    out = rows.withColumn("idx", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.select("name", "idx", F.substring("payload", F.col("idx") * size + 1, F.lit(size)).alias("payload"))


def markup_template(pairs: DataFrame) -> DataFrame:
    """Rows for people to mark: id, question, answer and an empty list of spans."""
    return pairs.select("id", "context", "answer", F.array().cast("array<array<int>>").alias("labels"), F.lit("").alias("comment"))
