"""Documents that refer to each other: their link graph, the lint of a documentation folder, and the gate of an article."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.dictionary import terms_found
from quillon.operators.rules import Rule, findings
from quillon.operators.scratch import kept

#: Names that the lint leaves out, command lines, and how many of those are too many.
LEFT_OUT = r"^(?:spec|tickets)-"
COMMANDS = (r"npm run\s", r"node scripts/", r"git\s+\w")
MOST_COMMANDS = 5


def links(docs: DataFrame, name: str, content: str) -> DataFrame:
    """(source, target), distinct: the Markdown links of each document to a file, without what follows # or ?; addresses elsewhere are none."""
    found = docs.select(F.col(name).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(r"\[[^\]]*\]\(([^)\s#?]+)[^)]*\)"), 1))).alias("target"))
    return found.where(~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")).select("source", F.regexp_replace("target", "^(?:\\./)+", "").alias("target")).distinct()


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(name) of the roots and of all that edges (source, target) lead to from them, in as many rounds as the longest way has steps."""
    seen = front = kept(roots.select(F.col(roots.columns[0]).alias("name")).distinct(), "roots")
    while True:
        step = front.join(edges.hint("merge"), F.col("name") == F.col("source")).select(F.col("target").alias("name")).distinct()
        front = kept(step.join(seen.hint("merge"), "name", "left_anti"), "front")
        if not front.limit(1).count():
            return seen
        seen = kept(seen.union(front), "seen")


def between_cycles(edges: DataFrame) -> DataFrame:
    """(name) of what lies on a cycle, or on a way from one to another: what is left when names that nothing leads to, or that lead to nothing, are
    taken away again and again."""
    left = kept(edges.where("source <> target OR source = target").distinct(), "edges")
    n = left.count()
    while True:
        into, out = left.select(F.col("target").alias("n")).distinct(), left.select(F.col("source").alias("n")).distinct()
        both = into.join(out.hint("merge"), "n")
        some = left.join(both.withColumnRenamed("n", "source").hint("merge"), "source", "left_semi").join(both.withColumnRenamed("n", "target").hint("merge"), "target", "left_semi")
        left, was = kept(some.select("source", "target"), "edges"), n
        n = left.count()
        if n == was:
            return left.select(F.explode(F.array("source", "target")).alias("name")).distinct()


def graph_findings(docs: DataFrame, name: str, content: str, index_name: str) -> DataFrame:
    """(name, check, level, detail): links to files that there aren't (dead), files that no way from the index leads to (orphan), and those on or between cycles (circular)."""
    edges = kept(links(docs, name, content), "links")
    files = kept(docs.select(F.col(name).alias("name")).distinct(), "files")
    named = files.withColumnRenamed("name", "target").hint("merge")  # in no round is a table sent through the driver
    real = kept(edges.join(named, "target", "left_semi"), "real")
    row = lambda df, check, level, detail: df.select("name", F.lit(check).alias("check"), F.lit(level).alias("level"), detail.alias("detail"))
    dead = edges.join(named, "target", "left_anti").withColumnRenamed("source", "name")
    orphans = files.join(reachable(real, files.where(F.col("name") == index_name)).hint("merge"), "name", "left_anti").where(F.col("name") != index_name)
    circular = between_cycles(real)
    none = F.lit("")
    return row(dead, "dead-link", "FAIL", F.col("target")).union(row(orphans, "orphan", "WARN", none)).union(row(circular, "circular", "WARN", none))


def lint(docs: DataFrame, name: str, content: str, level_col: str, index_lines: DataFrame, deeper: tuple[str, ...]) -> DataFrame:
    """(name, level, category, check, detail) of a documentation folder's files (name, content, level: 1 for those at its top, 2 for those below).

    Each file but passing ones (LEFT_OUT) stands in a line (line) of the index; one at the top that refers to a ``deeper`` folder has a section of
    design decisions; one below has fewer than MOST_COMMANDS lines with a command. The names are looked for in the index's lines by
    automata of bounded size, whatever their number.
    """
    listed = terms_found(index_lines, "line", docs.where(F.col(name).isNotNull()), name).select(F.col("term").alias(name), F.lit(True).alias("_listed"))
    text = F.coalesce(content, F.lit(""))
    apart = F.col(name).rlike(LEFT_OUT)
    refers = reduce(lambda a, b: a | b, [text.contains(d) for d in deeper], F.lit(False))
    commands = F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike("|".join(COMMANDS))))
    rules = [
        Rule("FAIL", "index", "docs-index-missing", ~apart & F.col("_listed").isNull(), F.col(name)),
        Rule("FAIL", "structure", "l1-missing-design-decisions", (F.col(level_col) == 1) & ~apart & refers & ~text.rlike(r"(?m)^##\s+Design Decisions"), F.col(name)),
        Rule("WARN", "content", "l2-execution-instructions", (F.col(level_col) == 2) & (commands >= MOST_COMMANDS), commands),
    ]
    return findings(docs.join(listed, name, "left"), [name], rules)


#: Words that an article doesn't use, keywords of which its slug or excerpt holds one; limits of its length, excerpt, widgets and sections.
BANNED = ("leverage", "utilize", "facilitate", "delve", "seamless", "robust")
WORDS, EXCERPT, WIDGETS, SECTIONS = (800, 3000), 160, 5, (6, 10)
WIDGET = "<!-- widget:([a-z0-9-]+) -->"


def front_field(front: Column, key: str) -> Column:
    """A field of front matter: the last line that names it."""
    return F.try_element_at(F.regexp_extract_all(front, F.lit(rf"(?m)^[ \t]*{key}[ \t]*:[ \t]*(\S.*)$"), 1), F.lit(-1))


def article_gate(articles: DataFrame, key: str, text: str, registered: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """(key, level, category, check, detail) of each check that an article (front matter and body) doesn't pass; registered: widgets (widget).

    Blockers: B1 front matter, B2 language, B3 widgets, B4 sources, B5 links to bare domains, B8 banned words. Warnings: W1 words, W2 excerpt, W3 widgets,
    W4 sections, W5 keywords. B3a, B6 and B7 are reviewed by hand and always pass, so they give no row.
    """
    whole = F.coalesce(text, F.lit(""))
    block = r"(?s)\A---\n(.*?)\n---"
    front = F.when(whole.rlike(block), F.regexp_extract(whole, block, 1)).otherwise("")
    body = F.when(whole.rlike(block), F.substr(whole, F.length(F.regexp_extract(whole, block, 0)) + 1)).otherwise(whole)
    rows = articles.select(key, front.alias("_front"), body.alias("_body"), F.regexp_extract_all(whole, F.lit(WIDGET), 1).alias("_widgets"))
    known = registered.agg(F.collect_set("widget").alias("_known"))  # a registry's names
    field = lambda k: F.coalesce(F.btrim(front_field(F.col("_front"), k)), F.lit(""))
    rows = rows.join(F.broadcast(known)).select("*", *[field(k).alias(f"_{k}") for k in ("title", "slug", "excerpt", "published")])
    b = F.col("_body")
    words = F.size(F.filter(F.split(b, r"\s+"), lambda w: w.rlike("^[a-zA-Z]+$")))
    unknown = F.filter("_widgets", lambda w: ~F.array_contains("_known", w))
    banned = F.filter(F.array(*map(F.lit, BANNED)), lambda w: F.contains(F.lower(b), w))
    han = F.regexp_count(b, F.lit(r"[一-龥]"))
    bare = F.regexp_count(b, F.lit(r"\[[^\]]+\]\(https?://[^/]+\)\)"))
    parts = F.size(F.filter(F.split(b, r"(?m)^## "), lambda s: F.regexp_replace(s, r"\s", "") != ""))
    sourced = (b.contains("## Sources") | b.contains("Source:")) & b.contains("(")
    hinted = reduce(lambda x, y: x | y, [F.contains(F.lower("_excerpt"), F.lit(k)) | F.contains(F.lower("_slug"), F.lit(k)) for k in keywords], F.lit(False))
    rules = [
        Rule("FAIL", "B1", "Frontmatter format", (F.col("_title") == "") | (F.col("_slug") == "") | (F.col("_excerpt") == "") | (F.col("_published") != "true"), F.lit("")),
        Rule("FAIL", "B2", "Language", han > 0, han), Rule("FAIL", "B3", "Widget registration", F.size(unknown) > 0, F.array_join(unknown, ", ")),
        Rule("FAIL", "B4", "Source citations", ~sourced, F.lit("")), Rule("FAIL", "B5", "Link completeness", bare > 0, bare), Rule("FAIL", "B8", "AI vocabulary", F.size(banned) > 0, F.array_join(banned, ", ")),
        Rule("WARN", "W1", "Word count", ~words.between(*WORDS), words), Rule("WARN", "W2", "Excerpt length", F.length("_excerpt") > EXCERPT, F.length("_excerpt")), Rule("WARN", "W3", "Widget count", F.size("_widgets") > WIDGETS, F.size("_widgets")),
        Rule("WARN", "W4", "Section count", ~parts.between(*SECTIONS), parts), Rule("WARN", "W5", "SEO keywords", ~hinted, F.lit("")),
    ]
    return findings(rows, [key], rules)
