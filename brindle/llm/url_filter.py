"""URL filtering by fixed host and path rules, and by mined association rules for the rest.

Tokens of a URL are its host's labels and its path's parts. FP-growth mines the
token combinations that the labels' blocked URLs share; rules that conclude
"block" are pruned by support (blocked rows) and confidence, both counted over all
labelled rows, and a rule is dropped if a rule on fewer of its tokens is at least
as confident. Matching is by inverted index: a URL's tokens look up the rules
that are filed under them, and a rule whose tokens are all there fits.

Mining stays small whatever the URLs look like, and loses no rule:

* Only tokens with enough blocked rows of their own take part.
* Tokens that stand in the very same rows are one item; any of them stands for it
  in a match, as the rules on each of them would.
* A URL that is blocked as often as a rule needs makes all its combinations rules'
  candidates, so more copies of it than that are not mined.
* Rules have ``max_items`` items at most. Longer baskets are cut into groups of a
  few items, and every choice of max_items groups is mined as one basket: each
  combination of that size is in one at least. Supports come out too high by that,
  never too low; the exact count follows for all candidates.

All of it is DataFrame functions and Spark's FP-growth; nothing runs in Python.
Distinct URLs without a fixed rule are matched once each. Rules and items are
broadcast only below a checked number.

A null URL, or one without ``://``, has an empty host and path, which no fixed rule
fits; its verdict is the mined rules' and so the default, allow. Ids may be null or
repeated, each row is judged; other columns are ignored; an empty table gives no
rows; without labels no rule is mined and the default holds. Of equally confident
rules that fit a URL the one with the largest id (a hash of its tokens) is named.
Very long URLs are judged whole.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (rule, verdict): host and all its subdomains, path by prefix; the longest fitting rule wins.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.7
MIN_ROWS = 20
MAX_ITEMS = 3
GROUP_ITEMS = 4
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, way in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(way)).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens; digits count as one token of their kind."""
    labels = F.transform(F.filter(F.split(host, r"[.\-:]"), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.filter(F.split(F.lower(path), r"[/.\-_]"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.when(x.rlike(r"^\d+$"), F.lit("#")).otherwise(x)))
    return F.array_distinct(F.concat(labels, parts))


def _small(df: DataFrame) -> DataFrame:
    """df (materialised) as a broadcast side if its rows are few, as it is otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _chosen_groups(items: Column, max_items: int) -> Column:
    """Baskets of at most max_items groups of items that together hold every combination of max_items."""
    numbers = F.sequence(F.lit(0), F.ceil(F.size(items) / F.lit(GROUP_ITEMS)).cast("int") - 1)
    chosen = F.transform(numbers, lambda g: F.array(g))
    for _ in range(max_items - 1):
        chosen = F.flatten(F.transform(chosen, lambda c: F.transform(F.filter(numbers, lambda g: g > F.element_at(c, -1)), lambda g: F.array_append(c, g))))
    baskets = F.transform(chosen, lambda c: F.flatten(F.transform(c, lambda g: F.slice(items, g * GROUP_ITEMS + 1, GROUP_ITEMS))))
    return F.when(F.size(items) > GROUP_ITEMS * max_items, baskets).otherwise(F.array(items))


def _found(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """baskets (with a column items) joined with every rule whose items they hold; a rule is filed under its rarest item."""
    posted = baskets.select("*", F.explode("items").alias("anchor"))
    filed = _small(rules).withColumnRenamed("items", "wanted")
    return posted.join(filed, "anchor").where(F.size(F.array_except("wanted", "items")) == 0).drop("anchor", "wanted")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = 1, max_items: int = MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Rules that conclude block, and the items of their tokens; labelled has tokens and block (boolean).

    Rules: rule_id, anchor, items, confidence, support (a share of the rows). Items: token, item. A rule needs
    min_support of all rows and min_rows rows, blocked ones each time.
    """
    session = labelled.sparkSession
    urls = labelled.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("block").alias("n_block"))
    urls = materialize(urls.withColumn("url", F.xxhash64("tokens")))
    rows, blocked = urls.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_block"), F.lit(0))).first()
    least = max(1, min_rows, -int(-min_support * rows // 1))
    same = [F.sum("n").alias("n"), F.sum("n_block").alias("n_block"), F.count("*").alias("urls"), F.sum(F.col("url").cast("decimal(38,0)")).alias("url_sum"), F.bit_xor(F.xxhash64("url", F.lit(1))).alias("url_xor")]
    tokens = urls.select("url", "n", "n_block", F.explode("tokens").alias("token")).groupBy("token").agg(*same).where(F.col("n_block") >= least)
    classes = tokens.groupBy("n", "n_block", "urls", "url_sum", "url_xor").agg(F.min("token").alias("item"), F.collect_list("token").alias("members"))
    items = materialize(classes.select("item", F.col("n").alias("item_rows"), F.explode("members").alias("token")))
    kept = urls.select("url", "n", "n_block", F.explode("tokens").alias("token")).join(_small(items), "token")
    baskets = materialize(kept.groupBy("url", "n", "n_block").agg(F.array_sort(F.collect_set("item")).alias("items")))

    copies = F.least("n_block", F.lit(least))
    some = baskets.where("n_block > 0").select(copies.alias("copies"), F.explode(_chosen_groups(F.col("items"), max_items)).alias("items"))
    many = some.select("items", "copies", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"), F.lit(1000))).alias("from"))
    mined_rows = materialize(many.select("items", F.explode(F.sequence("from", F.least(F.col("from") + 999, F.col("copies") - 1).cast("int")))).select("items"))
    n = mined_rows.count()
    shuffles = int(session.conf.get("spark.sql.shuffle.partitions"))
    share = (least - 0.5) / n if n else 1.0  # the growth rounds up to whole rows
    grown = FPGrowth(itemsCol="items", minSupport=min(1.0, share), numPartitions=shuffles).fit(mined_rows).freqItemsets
    sets = grown.where((F.col("freq") >= least) & (F.size("items") <= max_items)).select(F.array_sort("items").alias("items"))
    sets = sets.withColumn("rule_id", F.xxhash64(F.concat_ws(" ", "items")))
    rare = items.select("item", "item_rows").distinct()
    anchors = sets.select("rule_id", F.explode("items").alias("item")).join(rare, "item").groupBy("rule_id").agg(F.min_by("item", F.struct("item_rows", "item")).alias("anchor"))
    candidates = materialize(sets.join(anchors, "rule_id").select("rule_id", "anchor", "items"))

    counted = _found(baskets, candidates).groupBy("rule_id").agg(F.sum("n").alias("all_rows"), F.sum("n_block").alias("n_block"))
    good = counted.where((F.col("n_block") >= least) & (F.col("n_block") >= F.lit(min_confidence) * F.col("all_rows")))
    rules = candidates.join(good, "rule_id").select("rule_id", "anchor", "items", (F.col("n_block") / F.col("all_rows")).alias("confidence"), (F.col("n_block") / F.lit(rows)).alias("support"))
    rules = materialize(rules)
    # a rule is redundant if a part of it is a rule that is at least as confident
    parts = [F.array(*[F.element_at("items", i + 1) for i in c]) for size in range(2, max_items + 1) for k in range(1, size) for c in combinations(range(size), k)]
    sizes = [size for size in range(2, max_items + 1) for k in range(1, size) for _ in combinations(range(size), k)]
    if parts:
        own = rules.select("rule_id", "confidence", F.explode(F.array_compact(F.array(*[F.when(F.size("items") == size, F.xxhash64(F.concat_ws(" ", p))) for size, p in zip(sizes, parts, strict=True)]))).alias("part"))
        shorter = rules.select(F.col("rule_id").alias("part"), F.col("confidence").alias("part_confidence"))
        redundant = own.join(shorter, "part").where("part_confidence >= confidence").select("rule_id").distinct()
        rules = rules.join(redundant, "rule_id", "left_anti")
    return materialize(rules), items.select("token", "item")


def match(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(host, path, rule_id, confidence): the most confident rule of each distinct URL that any rule fits."""
    used = materialize(items.join(rules.select(F.explode("items").alias("item")).distinct(), "item").select("token", "item"))
    own = urls.select("host", "path", F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token")).join(_small(used), "token")
    baskets = own.groupBy("host", "path").agg(F.collect_set("item").alias("items"))
    fits = _found(baskets, rules.select("rule_id", "anchor", "items", "confidence"))
    best = F.max(F.struct("confidence", "rule_id")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", F.col("best.rule_id").alias("rule_id"), F.col("best.confidence").alias("confidence"))


def url_filter(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = 1, max_items: int = MAX_ITEMS) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every page; labels has page_id and block (boolean, null: unknown)."""
    slim = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = slim.withColumns({"rule": rule, "fixed": verdict})
    known = labels.select(F.col("page_id").alias("_id"), "block").where("block is not null")
    labelled = slim.join(known, F.col("page_id") == F.col("_id")).select(tokens_of(F.col("host"), F.col("path")).alias("tokens"), "block")
    open_urls = judged.where("rule is null and host <> ''").select("host", "path").distinct()
    found = match(open_urls, *mine(labelled, min_support, min_confidence, min_rows, max_items)).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "rule_id", "confidence")
    joined = judged.join(found, (F.col("rule").isNull()) & (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    mined = F.when(F.col("rule_id").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("fixed", mined).alias("verdict"), "confidence")


def contract(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels mark a page by its id: low quality or toxic means block. A rule rests on MIN_ROWS blocked rows at least."""
    marked = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return url_filter(pages, marked, min_rows=MIN_ROWS)
