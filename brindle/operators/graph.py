"""Knowledge-graph operators over edge tables: traversal, paths, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize


#: Rows that a task groups or sorts at a time.
GROUP_ROWS = 500_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, about n of them, dealt by keys to tasks of GROUP_ROWS rows, so that a task's groups take the same memory whatever the input."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUP_ROWS)), *keys)


def undirected(edges: DataFrame, a: str = "src", b: str = "dst", weight: str | None = "weight") -> DataFrame:
    """(a, b, weight) in both directions, parallel edges summed, loops dropped. Tasks grow with the edges (counted first)."""
    w = F.col(weight) if weight else F.lit(1)
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), w.alias("weight")).union(edges.select(F.col(b), F.col(a), w))
    return dealt(both.where("a <> b"), 2 * edges.count(), "a", "b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def k_hop(edges: DataFrame, start: DataFrame, hops: int, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, hop): nodes reached from start (column node) within so many hops, either way along edges, with the least hop.

    Up to three hops are one plan of semi joins over the edges, which are kept once; more
    are rounds with a kept frontier that end early when nothing new is reached.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a)))
    both = materialize(dealt(both, 2 * edges.count(), "a", "b").distinct())
    if hops <= 3:
        front = start.select("node").distinct()
        seen = front.withColumn("hop", F.lit(0))
        for hop in range(1, hops + 1):
            front = both.join(front, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
            seen = seen.union(front.withColumn("hop", F.lit(hop)))
        return seen.groupBy("node").agg(F.min("hop").alias("hop"))
    seen = materialize(start.select("node").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, hops + 1):
        reached = both.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        front = materialize(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def shortest_path(edges: DataFrame, source: int, target: int, hops: int, a: str = "src", b: str = "dst") -> DataFrame:
    """(hop, node) of one shortest undirected path, no rows without one; of several parents the smallest is taken."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a)))
    both = materialize(dealt(both, 2 * edges.count(), "a", "b").distinct())
    spark = edges.sparkSession
    kind = both.schema["a"].dataType.simpleString()
    seen = spark.createDataFrame([(source, None, 0)], f"node {kind}, parent {kind}, hop int")
    front = seen
    for hop in range(1, hops + 1):
        reached = both.join(front.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        front = materialize(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(front)
        if front.isEmpty() or not front.where(F.col("node") == target).isEmpty():
            break
    path, now = [], target
    while True:  # as many single-row lookups as the path has hops
        row = seen.where(F.col("node") == now).first()
        if row is None:
            return spark.createDataFrame([], f"hop int, node {kind}")
        path.append((row["hop"], row["node"]))
        if row["parent"] is None:
            return spark.createDataFrame(path[::-1], f"hop int, node {kind}")
        now = row["parent"]


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): synchronous label propagation over undirected weighted edges (a, b, weight both ways).

    A node takes the label with most weight around it, its own label included; ties go
    to the smallest label. Communities are named by their smallest member.
    """
    edges = materialize(edges)
    n = edges.count()
    labels = materialize(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = dealt(edges, n, "b").join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", "weight")
        own = labels.select("node", "label", F.lit(1).cast("double").alias("weight"))
        tally = votes.select("node", "label", F.col("weight").cast("double").alias("weight")).union(own)
        tally = dealt(tally, n, "node", "label").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        new = materialize(tally.groupBy("node").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        labels = new
        if moved:
            break
    names = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(names, "label").select("node", "community")


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of (node, community) on undirected weighted edges (a, b, weight both ways)."""
    c, n = communities, edges.count()
    placed = dealt(edges, n, "a").join(dealt(c.select(F.col("node").alias("a"), F.col("community").alias("ca")), n, "a"), "a")
    placed = dealt(placed, n, "b").join(dealt(c.select(F.col("node").alias("b"), F.col("community").alias("cb")), n, "b"), "b")
    per = placed.groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    all_weight = F.broadcast(edges.agg(F.sum("weight").alias("m2")))
    return per.crossJoin(all_weight).agg(F.sum(F.col("inside") / F.col("m2") - resolution * F.pow(F.col("total") / F.col("m2"), F.lit(2))).alias("modularity"))


def candidates(docs: DataFrame, doc_id: str, text: str, min_idf: float = 3.5) -> DataFrame:
    """(name, mentions, confidence, kind, signals): entity candidates in lower case, with the documents that mention them so.

    Signals are terms of high idf, terms of Markdown headings (.85), identifiers in
    inline code (.9) and texts of links within the blog (.75); the most confident,
    and of equal ones the first, gives the kind.
    """
    from ..functions import text as tx

    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        F.array_distinct(tx.tokens(t, 3)).alias("terms"),
        tx.tokens(F.array_join(F.regexp_extract_all(t, F.lit(r"(?md)^#{1,3}\s+(.+)$"), F.lit(1)), "\n"), 3).alias("heads"),
        F.filter(F.transform(F.regexp_extract_all(t, F.lit("`([^`]{2,50})`"), F.lit(1)), lambda x: F.lower(F.trim(x))), lambda x: x.rlike(r"^[a-z_][a-z0-9_.#+-]+$")).alias("codes"),
        F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"\[([^\]]+)\]\(/blog/[^)]+\)"), F.lit(1)), lambda x: F.lower(F.trim(x))), lambda x: F.length(x).between(3, 50)).alias("links"),
    )
    others = F.array_except(F.concat("heads", "codes", "links"), "terms")
    marks = lambda x, term: F.struct(x.alias("name"), F.lit(term).alias("term"), F.array_contains("heads", x).alias("head"), F.array_contains("codes", x).alias("code"), F.array_contains("links", x).alias("link"))
    names = found.select(F.explode(F.concat(F.transform("terms", lambda x: marks(x, True)), F.transform(others, lambda x: marks(x, False)))).alias("x")).select("x.*")
    marked = F.col("head") | F.col("code") | F.col("link")
    per = names.groupBy("name").agg(F.count_if("term").alias("df"), F.count("*").alias("any"), F.count_if(marked).alias("marked"), *[F.bool_or(c).alias(c) for c in ("head", "code", "link")])
    scored = per.crossJoin(F.broadcast(docs.agg(F.count("*").alias("total")))).withColumn("idf", F.log(F.col("total") / F.nullif(F.col("df"), F.lit(0))))
    rare = F.coalesce(F.col("idf") >= min_idf, F.lit(False))
    rules = [(rare, F.least(F.lit(0.9), 0.4 + 0.05 * F.col("idf")), "technology", "high_idf"), (F.col("head"), F.lit(0.85), "concept", "heading"), (F.col("code"), F.lit(0.9), "code", "inline_code"), (F.col("link"), F.lit(0.75), "concept", "link_text")]
    best = F.greatest(*[F.when(on, c).otherwise(0.0) for on, c, _, _ in rules])
    kind = F.coalesce(*[F.when(on & (c == best), F.lit(k)) for on, c, k, _ in rules])
    signals = F.array_compact(F.array(*[F.when(on, F.lit(s)) for on, _, _, s in rules]))
    return scored.where(rare | (F.col("marked") > 0)).select("name", F.when(rare, F.col("any")).otherwise(F.col("marked")).alias("mentions"), best.alias("confidence"), kind.alias("kind"), signals.alias("signals"))


def significant(found: DataFrame) -> DataFrame:
    """Candidates with three mentions, or two signals and a confidence of .8."""
    return found.where("mentions >= 3 or (confidence >= 0.8 and size(signals) >= 2)")


def link_relations(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, href, target, relation): every link of a page, as often as it stands there.

    Links within the site are references to their href. Absolute http links are
    links_to github:owner/repository, or else site:domain without www. Fragments
    alone and other schemes are no links to pages.
    """
    quoted = F.regexp_extract_all(html, F.lit(r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*')"), F.lit(1))
    found = pages.select(F.col(page_id).alias("page_id"), F.explode(quoted).alias("q")).select("page_id", F.expr("trim(substring(q, 2, length(q) - 2))").alias("href"))
    outside = F.col("href").rlike("(?i)^(https?:)?//")
    inside = ~outside & ~F.col("href").rlike("^(#|$|[a-zA-Z][a-zA-Z0-9+.-]*:)")
    domain = F.regexp_replace(F.lower(F.regexp_extract("href", r"^[^/]*//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"www\.", "")
    repository = F.regexp_extract("href", r"^[^/]*//[^/?#]*/([^/?#]+/[^/?#]+)", 1)
    away = F.when((domain == "github.com") & (repository != ""), F.concat(F.lit("github:"), repository)).otherwise(F.concat(F.lit("site:"), domain))
    return found.where(inside | outside & (domain != "")).select("page_id", "href", F.when(outside, away).otherwise(F.col("href")).alias("target"), F.when(outside, "links_to").otherwise("references").alias("relation"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach; nodes of any ordered type, loops allowed, nulls left out.

    Each round hooks every node to the smallest node around it and then to that node's
    own; a round is kept in the shared folder, and the loop ends when none moves. A node
    with very many edges is pre-aggregated where its edges lie.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    both = materialize(both.union(both.select("y", "x")).distinct())
    roots = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        around = both.join(roots.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        hooked = roots.join(around, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("to"))
        lower = hooked.groupBy(F.col("was").alias("node")).agg(F.min("to").alias("down"))  # what a root's members have found, the root follows
        moved = hooked.join(lower, "node", "left").select("node", "was", F.least("to", "down").alias("to"))
        jump = moved.select(F.col("node").alias("to"), F.col("to").alias("far"))
        now = materialize(moved.join(jump, "to", "left").select("node", "was", F.least("to", "far").alias("root")))
        roots = now.select("node", "root")
        if now.where("root <> was").isEmpty():
            return roots
