"""Sources: Parquet tables, CSV with drifting headers, JSON items, markdown folders, feeds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import parse_number, token_estimate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fields of a metrics file and the header keywords that name them, in order.
FIELDS = {
    "title": ["title", "名称", "标题"],
    "postedAt": ["post time", "post date", "publish", "发布时间", "发布日期"],
    "views": ["view", "播放", "观看"],
    "avgWatchTime": ["watch time", "观看时长", "平均观看"],
    "completionRate": ["completion", "完成", "watch %", "watch%"],
    "shares": ["share", "分享", "转发"],
    "saves": ["save", "收藏", "favorite"],
    "comments": ["comment", "评论"],
    "likes": ["like", "点赞", "赞"],
}
TEXT_FIELDS = {"title", "postedAt", "avgWatchTime"}


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9_一-鿿]", "", name.lower())


def match_column(header: str) -> str | None:
    """The first field one of whose keywords is in the header, both reduced to letters and digits."""
    h = _plain(header)
    return next((f for f, words in FIELDS.items() if h and any(_plain(w) in h for w in words)), None)


def metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Video metrics of a CSV file whatever its headers: first matching column of each field, the rest null."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    first: dict[str, str] = {}
    for c in raw.columns:
        if (f := match_column(c)) and f not in first:
            first[f] = c
    return raw.select(*[(F.col(f"`{first[f]}`") if f in TEXT_FIELDS else parse_number(F.col(f"`{first[f]}`"))).alias(f) if f in first else F.lit(None).cast("string" if f in TEXT_FIELDS else "double").alias(f) for f in FIELDS])


def markdown(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of the markdown files below a folder, less those whose path has an excluded part."""
    out = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    for e in exclude:
        out = out.where(~F.col("path").contains(e))
    return out


def front_matter(text: Column, key: str) -> Column:
    """A scalar of a document's leading --- block."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    return F.nullif(F.btrim(F.regexp_extract(block, rf"(?m)^{re.escape(key)}:[ \t]*(.*)$", 1), F.lit(" \t\r\"'")), F.lit(""))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """(path, slug, title, excerpt, text) of the published articles below a folder; the slug falls back to the file's name, the text is
    what follows the leading block."""
    out = markdown(spark, folder)
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    shown = F.lower(F.coalesce(front_matter(F.col("text"), "published"), F.lit("false")))
    body = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    kept = out.where(~shown.isin("false", "0", "null", "no", "~"))
    return kept.select("path", F.coalesce(front_matter(F.col("text"), "slug"), name).alias("slug"), front_matter(F.col("text"), "title").alias("title"), front_matter(F.col("text"), "excerpt").alias("excerpt"), body.alias("text"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file's rows as text, quotes doubled within quotes; cells that a short row lacks are ''."""
    return spark.read.csv(path, header=True, quote='"', escape='"').na.fill("")


MAX_TOKENS = 8192


def _packed(section: Column) -> Column:
    """A section's paragraphs, joined in order as long as they stay within MAX_TOKENS; a longer paragraph is a chunk of its own."""
    paragraphs = F.filter(F.split(F.btrim(section, F.lit(" \t\n\x0b\f\r")), "\n\n+"), lambda p: p.rlike(r"\S"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(s: Column, p: Column) -> Column:
        more = F.concat_ws("\n\n", s["held"], p)
        full = s["held"].isNotNull() & (token_estimate(more) > MAX_TOKENS)
        return F.struct(F.when(full, F.array_append(s["done"], s["held"])).otherwise(s["done"]).alias("done"), F.when(full, p).otherwise(more).alias("held"))

    return F.aggregate(paragraphs, start, step, lambda s: F.array_append(s["done"], s["held"]))


def markdown_chunks(text: Column) -> Column:
    """(title, chunk) in order: sections at level-two headings, those over MAX_TOKENS cut between paragraphs; what
    stands before the first goes; a document without headings is one chunk without title; null has none."""
    parts = F.split(text, r"(?m)^(?=## )")
    headed = F.filter(parts, lambda p: p.startswith("## "))
    none = F.array().cast("array<string>")
    sections = F.when(F.size(headed) > 0, headed).when(F.btrim(text) != "", F.array(text)).otherwise(none)

    def chunks(p: Column) -> Column:
        title = F.nullif(F.regexp_extract(p, r"\A## +([^\n]*)", 1), F.lit(""))
        long = p.startswith("## ") & (token_estimate(F.btrim(p, F.lit(" \t\n\x0b\f\r"))) > MAX_TOKENS)
        return F.transform(F.when(long, _packed(p)).otherwise(F.array(F.btrim(p, F.lit(" \t\n\x0b\f\r")))), lambda c: F.struct(title.alias("title"), c.alias("chunk")))

    return F.flatten(F.transform(sections, chunks))


def chunk_markdown(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chunk_index, title, chunk) of each document's chunks, see markdown_chunks."""
    out = docs.select(id_col, F.posexplode(markdown_chunks(F.col(text_col))).alias("chunk_index", "_c"))
    return out.select(id_col, "chunk_index", "_c.title", "_c.chunk")


def json_files(spark: SparkSession, folder: str, pattern: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, folder, name of the folder, text) of the files below a folder, whole; no rows where there is no such folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, folder string, name string, text string")
    out = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    for e in exclude:
        out = out.where(~F.col("path").contains(e))
    return out.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("name"), "text")


SCENES = "scenes array<struct<id: string, name: string, visualType: string, voiceover: string, texts: string>>"
META = "pipelineId string, topics array<string>, keyEntities string, article string, partNumber int"


def scenes(spark: SparkSession, folder: str, pattern: str = "scene-data.json", meta: str = "meta.json", exclude: tuple[str, ...] = ("_test-fixtures",)) -> tuple[DataFrame, DataFrame]:
    """(scenes, errors): (source_id, ordinal, scene_id, name, visual_type, voiceover, texts, topics, entities, article, part) of the scene files below a folder, and
    (path, error) of those that can't be read. A record beside a scene file gives its id, else its folder's name does; files without an array of scenes give none."""
    files = json_files(spark, folder, pattern, exclude).withColumn("doc", F.try_parse_json("text"))
    listed = F.schema_of_variant(F.try_variant_get("doc", "$.scenes", "variant")).startswith("ARRAY")
    side = json_files(spark, folder, meta, exclude).select("folder", F.from_json("text", META).alias("m"))
    good = files.where(F.coalesce(listed, F.lit(False))).join(side, "folder", "left")
    one = good.select(F.coalesce(F.nullif("m.pipelineId", F.lit("")), "name").alias("source_id"), F.posexplode(F.from_json("text", SCENES)["scenes"]).alias("ordinal", "s"), "m")
    rows = one.select("source_id", "ordinal", F.col("s.id").alias("scene_id"), "s.name", F.col("s.visualType").alias("visual_type"), "s.voiceover", "s.texts", "m.topics", F.col("m.keyEntities").alias("entities"), F.col("m.article").alias("article"), F.col("m.partNumber").alias("part"))
    return rows, files.where("doc IS NULL").select("path", F.lit("not JSON").alias("error"))


CATALOG = "array<struct<file: string, type: string, description: string, source: string, license: string, used_in: array<string>, keywords: array<string>>>"


def catalog(spark: SparkSession, folder: str, pattern: str = "catalog.json") -> DataFrame:
    """(ordinal, file, type, description, source, license, used_in, keywords) of a catalog's entries; a missing file, one that isn't JSON and one without entries give none."""
    text = json_files(spark, folder, pattern).select(F.posexplode(F.from_json(F.when(F.try_parse_json("text").isNotNull() & F.btrim("text").startswith("["), F.col("text")), CATALOG)).alias("ordinal", "e"))
    return text.select("ordinal", "e.*").where("file IS NOT NULL")
