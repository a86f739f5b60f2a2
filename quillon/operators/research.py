"""Research records: briefs, versioned documents with their errors, JSON-LD rules, alerts in advance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.urls import normalize_url
from quillon.operators.evidence import errors, priority
from quillon.operators.trends import within_window

#: Order of a source's kind in a brief; any other comes last.
ORDER = {"primary": 0, "authoritative-secondary": 1, "independent-secondary": 2, "community": 3}


def brief(sources: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(content_id, place, url, title, source_type, published_at) of each content's candidate sources (content_id, ordinal, url, title,
    source_type, category, published_at): one a canonical address by priority, none older than the window (undated ones stay), in the
    order of their kind and then their own."""
    from pyspark.sql import Window

    given = sources.where(F.coalesce("url", F.lit("")) != "").withColumn("_key", F.concat_ws("\x01", F.col("content_id").cast("string"), normalize_url(F.col("url"))))
    first = F.min("ordinal").over(Window.partitionBy("_key"))  # one that replaces another takes its place
    one = given.withColumn("_first", first).withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc(priority(F.col("source_type"))), "ordinal"))).where("_rn = 1")
    kept = within_window(one, F.col("published_at"), now, days)
    rank = F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in ORDER.items()], F.lit(99))
    place = F.row_number().over(Window.partitionBy("content_id").orderBy(rank, "_first"))
    kind = F.coalesce(F.nullif("source_type", F.lit("")), F.nullif("category", F.lit("")), F.lit("independent-secondary"))
    return kept.select("content_id", place.alias("place"), normalize_url(F.col("url")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), kind.alias("source_type"), "published_at")


def document_errors(doc: Column, version: str, required: list[str], kinds: dict[str, str], choices: dict[str, list[str]], items: tuple[str, list[str]] | None = None) -> Column:
    """Messages about a versioned JSON document (a variant): another version stops the rest; then missing fields, fields of another type,
    values beyond their choices, and what the items of one array lack."""
    at = lambda f: F.try_variant_get(doc, f"$.{f}", "string")
    kind = lambda f: F.regexp_extract(F.schema_of_variant(F.try_variant_get(doc, f"$.{f}", "variant")), "^([A-Z]+)", 1)
    names = {"ARRAY": "array", "OBJECT": "object", "STRING": "string", "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "BOOLEAN": "boolean"}
    js = lambda f: F.coalesce(*[F.when(kind(f) == k, F.lit(v)) for k, v in names.items()], F.lit("null"))
    have = lambda f: at(f).isNotNull() | F.try_variant_get(doc, f"$.{f}", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(doc, f"$.{f}", "variant"))
    found = [F.when(~F.coalesce(have(f), F.lit(False)), F.lit(f"Missing required field: {f}")) for f in required]
    found += [F.when(have(f) & (js(f) != k), F.concat(F.lit(f'Field "{f}" must be of type {k}, got '), js(f))) for f, k in kinds.items()]
    found += [F.when(have(f) & ~at(f).isin(*some), F.concat(F.lit(f'Field "{f}" must be one of [{", ".join(some)}], got "'), at(f), F.lit('"'))) for f, some in choices.items()]
    whole = F.array_compact(F.array(*found))
    if items:
        name, need = items
        listed = F.try_variant_get(doc, f"$.{name}", "array<variant>")
        lacks = F.flatten(F.transform(listed, lambda x, i: F.array_compact(F.array(*[F.when(F.coalesce(F.is_variant_null(F.try_variant_get(x, f"$.{f}", "variant")), F.lit(True)), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"] missing required field: {f}"))) for f in need]))))
        whole = F.concat(whole, F.coalesce(lacks, F.array().cast("array<string>")))
    other = F.coalesce(at("schemaVersion"), F.lit("undefined")) != version
    return F.when(doc.isNull() | F.is_variant_null(doc), F.array(F.lit("Input must be a plain object"))).when(other, F.array(F.concat(F.lit('schemaVersion "'), F.coalesce(at("schemaVersion"), F.lit("undefined")), F.lit(f'" does not match expected "{version}"')))).otherwise(whole)


def alert_preview(before: Column, after: Column, threshold: int, lost: bool) -> Column:
    """(valid, alert, kind) of a move between two positions as texts; an empty second one is a lost ranking."""
    a, b = F.btrim(before).try_cast("int"), F.btrim(after).try_cast("int")
    empty = F.btrim(after) == ""
    valid = F.coalesce((a >= 1) & (empty | (b >= 1)), F.lit(False))
    fires = valid & F.when(empty, F.lit(lost)).otherwise(b - a >= threshold)
    return F.struct(valid.alias("valid"), F.coalesce(fires, F.lit(False)).alias("alert"), F.when(fires, F.when(empty, "lost").otherwise("drop")).alias("kind"))


def _node_errors(node: Column) -> Column:
    """Messages about one node of a JSON-LD document; types without rules pass."""
    text = lambda p: F.try_variant_get(node, p, "string")
    size = lambda p: F.coalesce(F.size(F.try_variant_get(node, p, "array<variant>")), F.lit(0))
    kind = text('$["@type"]')
    places = F.transform(F.try_variant_get(node, "$.itemListElement", "array<variant>"), lambda x: F.try_variant_get(x, "$.position", "int"))
    order = F.transform(F.filter(F.transform(places, lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i"))), lambda x: ~x["p"].eqNullSafe(x["i"])), lambda x: F.concat(F.lit("BreadcrumbList position "), F.coalesce(x["p"].cast("string"), F.lit("undefined")), F.lit(" should be "), x["i"].cast("string")))
    is_a = lambda t: kind.eqNullSafe(t)
    lacks = lambda p: F.coalesce(text(p), F.lit("")) == ""
    url = lambda p: ~F.coalesce(text(p).rlike("^[a-z][a-z0-9+.-]*:"), F.lit(False))
    found = errors(
        (kind.isNull(), "node without @type"), (is_a("Article") & (lacks("$.headline") | (F.length(text("$.headline")) > 110)), "Article.headline"),
        (is_a("Article") & (lacks("$.description") | (F.length(text("$.description")) > 320)), "Article.description"), (is_a("Article") & url("$.url"), "Article.url"), (is_a("Article") & (size("$.image") < 1), "Article.image"),
        (is_a("Article") & lacks("$.inLanguage"), "Article.inLanguage"), (is_a("FAQPage") & (size("$.mainEntity") < 2), "FAQPage.mainEntity"), (is_a("BreadcrumbList") & (size("$.itemListElement") < 2), "BreadcrumbList.itemListElement"),
        (is_a("ItemList") & (size("$.itemListElement") < 1), "ItemList.itemListElement"), (is_a("ItemList") & ~F.coalesce(F.try_variant_get(node, "$.numberOfItems", "int") > 0, F.lit(False)), "ItemList.numberOfItems"),
    )
    return F.concat(found, F.when(is_a("BreadcrumbList"), F.coalesce(order, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


def json_ld_errors(doc: Column) -> Column:
    """Messages about a JSON-LD document (a variant): of itself, or of each node of its graph."""
    graph = F.try_variant_get(doc, '$["@graph"]', "array<variant>")
    plain = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    context = F.coalesce(F.try_variant_get(doc, '$["@context"]', "string"), F.lit("")) == ""
    whole = errors((context, "missing @context"), (F.size(graph) == 0, "empty @graph"))
    nodes = F.when(graph.isNotNull(), F.flatten(F.transform(graph, _node_errors))).otherwise(_node_errors(doc))
    return F.when(~plain, F.array(F.lit("document is not an object"))).otherwise(F.concat(whole, nodes))


def series_errors(series_id: Column, part: Column, parts: Column) -> Column:
    """Messages about a series' figures: a kebab-case id, part and number of parts from 1 to 5, the part within them."""
    whole = lambda x: x.between(1, 5)
    return errors(
        (F.coalesce(series_id, F.lit("")) == "", "seriesId is required"), ((series_id != "") & ~series_id.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "seriesId must be kebab-case"),
        (part.isNull(), "partNumber is required"), (~whole(part), "partNumber must be an integer 1-5"), (parts.isNull(), "totalParts is required"), (~whole(parts), "totalParts must be an integer 1-5"), (part > parts, "partNumber must be <= totalParts"),
    )


