"""Sounds and frames made of the texts' bytes: decoded, put together, located and measured, with SQL that counts the bytes one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.operators import audio, frames
from quillon.plans.twins import registry
from quillon.sources.audio import wav_blocks, wav_bytes, wav_file
from quillon.sources.readers import table

Q, S, query = registry()

BLOCK, RATE, SEGMENT = 4096, 8000, 4000
#: 16-bit numbers of a text's bytes, the low byte first.
BYTES = "(SELECT {key}, octet_length(encode(text)) AS size, regexp_extract_all(hex(encode(text)), '.{{4}}') AS q FROM {table} WHERE text IS NOT NULL)"
NUMBER = "(('0x' || q[1:2])::INT + 256 * ('0x' || q[3:4])::INT)"
SIGNED = f"(CASE WHEN {NUMBER} >= 32768 THEN {NUMBER} - 65536 ELSE {NUMBER} END)"


@query("wav_blocks", f"""WITH b AS {BYTES.format(key="doc_id", table="documents")}, s AS (SELECT doc_id, size, i, {SIGNED} AS v FROM (SELECT doc_id, size, unnest(q) AS q, unnest(range(len(q))) AS i FROM b WHERE size % 2 = 0))
SELECT CAST(doc_id AS VARCHAR) AS path, NULL AS error, {RATE} AS sample_rate, size // 2 AS total, i // {BLOCK} * {BLOCK} AS at, CAST(count(*) AS INT) AS core, CAST(sum(v) AS BIGINT) AS core_sum, CAST(least(size // 2 - i // {BLOCK} * {BLOCK}, {BLOCK} + 100) AS INT) AS held FROM s GROUP BY doc_id, size, i // {BLOCK}
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, {RATE}, 0, 0, 0, 0, 0 FROM b WHERE size = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'odd number of data bytes', NULL, NULL, NULL, NULL, NULL, NULL FROM b WHERE size % 2 = 1""")
def _(s, d):
    files = table(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), wav_file(F.encode("text", "UTF-8"), F.lit(RATE)).alias("content"))
    return wav_blocks(files, BLOCK, 100).withColumn("held", F.size("pcm")).withColumn("held", F.when(F.col("error").isNull(), F.col("held"))).drop("pcm")


def _even(text: str):
    data = F.encode(text, "UTF-8")
    return F.substring(data, F.lit(1), F.octet_length(data) - F.octet_length(data) % 2)


def _turn_sounds(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("path"), _even("text").alias("data"))


TRACKS = f"""b AS {BYTES.format(key="conv_id, turn", table="conversations")},
t AS (SELECT *, CAST(floor(greatest(ceil((len(q) / {RATE}.0::DOUBLE + 0.5) * 30 - 1e-6), 1) / 30.0::DOUBLE * {RATE} + 0.5) AS BIGINT) AS target FROM b),
o AS (SELECT *, CAST(coalesce(sum(target) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(target) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM t),
v AS (SELECT conv_id, start + i AS p, {SIGNED} AS v FROM (SELECT conv_id, start, unnest(q) AS q, unnest(range(len(q))) AS i FROM o)),
g AS (SELECT conv_id, p // {SEGMENT} AS s, sum(v) AS plain, sum(v * (p % {SEGMENT} + 1)) AS placed FROM v GROUP BY 1, 2),
e AS (SELECT conv_id, total, unnest(range((total - 1) // {SEGMENT} + 1)) AS s FROM (SELECT DISTINCT conv_id, total FROM o))"""


def weighted(pcm):
    """The sum of the samples, each by its place from 1."""

    @F.arrow_udf("long")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([int(np.dot(v, np.arange(1, len(v) + 1))) for v in (s.values.to_numpy().astype(np.int64) for s in x)], pa.int64())

    return run(pcm)


@query("track_segments", f"WITH {TRACKS} SELECT conv_id AS track, total, s * {SEGMENT} AS at, CAST(least({SEGMENT}, total - s * {SEGMENT}) AS INT) AS n, CAST(coalesce(plain, 0) AS BIGINT) AS plain, CAST(coalesce(placed, 0) AS BIGINT) AS placed FROM e LEFT JOIN g USING (conv_id, s)")
def _(s, d):
    sounds = _turn_sounds(s, d)
    blocks = wav_blocks(sounds.select("path", wav_file(F.col("data"), F.lit(RATE)).alias("content")), 1000)
    parts = sounds.select(F.col("conv_id").alias("track"), F.col("turn").alias("ordinal"), "path", (F.octet_length("data") / 2 / RATE).alias("seconds"))
    made = audio.track(parts, blocks, RATE, SEGMENT)
    # written as files and read again
    files = made.select("track", "total", "at", wav_bytes(F.col("pcm"), F.lit(RATE)).alias("content")).withColumn("path", F.concat_ws("/", "track", "at"))
    back = wav_blocks(files.select("path", "content"), SEGMENT).select("path", "core", "core_sum", "pcm")
    placed = weighted("pcm")
    return files.drop("content").join(back, "path").select("track", "total", "at", F.col("core").alias("n"), F.col("core_sum").alias("plain"), placed.alias("placed"))


@query("sound_onsets")
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), _even("text").alias("data"))
    blocks = wav_blocks(docs.select("path", wav_file(F.col("data"), F.lit(RATE)).alias("content")), BLOCK, 399)
    # of each sound of 400 samples and more, the 400 from its middle on
    whole = wav_blocks(docs.select("path", wav_file(F.substring("data", (F.floor(F.octet_length("data") / 4) * 2 + 1).cast("int"), F.lit(800)), F.lit(RATE)).alias("content"))).where("total >= 400 OR total = 400")
    return audio.onsets(blocks, whole.select(F.col("path").alias("needle"), "path", F.slice("pcm", 1, 400).alias("pcm")))


WIDE, HIGH, STEP = 16, 20, 2
SMALL = frames.Layout(top=6, right=5, bottom=9, left=2, rail=(4, 17), lane=14, exempt=((3, 10, 2, 4), (1, 5, 1, 5)), glow=1)
PIXELS = f"""b AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS size FROM documents WHERE text <> ''),
l AS (SELECT doc_id, regexp_extract_all(rpad(hx, CAST(ceil(size / {WIDE * HIGH * 4}.0) * {WIDE * HIGH * 8} AS INT), '0'), '.{{8}}') AS q FROM b),
p AS (SELECT doc_id, n // {WIDE * HIGH} AS f, n % {WIDE} AS x, n % {WIDE * HIGH} // {WIDE} AS y, 0.299::DOUBLE * ('0x' || q[1:2])::INT + 0.587::DOUBLE * ('0x' || q[3:4])::INT + 0.114::DOUBLE * ('0x' || q[5:6])::INT AS lum FROM (SELECT doc_id, unnest(q) AS q, unnest(range(len(q))) AS n FROM l)),
c AS (SELECT doc_id || '/' || f AS frame, 'black' AS "check", count(*) FILTER (lum < 5) AS found, count(*) AS total FROM p WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY ALL
UNION ALL SELECT doc_id || '/' || f, 'top', count(*) FILTER (lum > 80), count(*) FROM p WHERE x % 2 = 0 AND y % 2 = 0 AND y < 6 AND NOT (x BETWEEN 3 AND 9 AND y BETWEEN 2 AND 3) AND NOT (x BETWEEN 1 AND 4 AND y BETWEEN 1 AND 4) AND x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 18 GROUP BY ALL
UNION ALL SELECT doc_id || '/' || f, 'right', count(*) FILTER (lum > 80), count(*) FROM p WHERE x >= 11 AND x % 2 = 1 AND y % 2 = 0 AND y BETWEEN 4 AND 16 GROUP BY ALL
UNION ALL SELECT doc_id || '/' || f, 'bottom', count(*) FILTER (lum > 80), count(*) FROM p WHERE x % 2 = 0 AND y IN (11, 13) GROUP BY ALL
UNION ALL SELECT doc_id || '/' || f, 'content', count(*) FILTER (lum > 80), count(*) FROM p WHERE x BETWEEN 2 AND 10 AND x % 2 = 0 AND y BETWEEN 6 AND 10 AND y % 2 = 0 GROUP BY ALL)"""


@query("frame_checks", f"""WITH {PIXELS} SELECT frame, "check", found, total, CASE WHEN "check" = 'black' THEN CASE WHEN found = total THEN 'fail' ELSE 'pass' END WHEN "check" = 'content' THEN CASE WHEN found / total < 0.01 THEN 'warn' ELSE 'pass' END WHEN found / total <= 0.05 THEN 'pass' WHEN "check" = 'top' THEN 'warn' ELSE 'fail' END AS level FROM c""")
def _(s, d):
    size = WIDE * HIGH * 4
    data = F.encode("text", "UTF-8")
    cut = table(s, d, "documents").where("text <> ''").select("doc_id", data.alias("data")).withColumn("f", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / size).cast("int"))))
    part = F.rpad(F.substring("data", F.col("f") * size + 1, F.lit(size)), F.lit(size), F.lit(b"\x00"))
    made = cut.select(F.concat_ws("/", "doc_id", "f").alias("frame"), F.lit(WIDE).alias("width"), F.lit(HIGH).alias("height"), part.alias("data"))
    return frames.frame_checks(frames.tiles(made, 7), SMALL, STEP).select("frame", "check", "found", "total", "level")
