"""Web sources: links, robots rules, crawl frontiers, archives and blocked addresses."""

from __future__ import annotations

import io
import ipaddress
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize


def links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", hosts: list[str] | None = None) -> DataFrame:
    """(page_id, link): absolute http links of a page, fragments cut, queries kept; fragments alone are skipped."""
    found = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href\s*=\s*"([^"]*)"'), F.lit(1))).alias("href"))
    found = found.where(~F.startswith("href", F.lit("#")) & (F.length("href") > 0))
    origin = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"^([a-zA-Z]+://[^?#]*/)", 1)
    plain = F.regexp_replace("href", "#.*$", "")
    link = F.when(plain.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), plain).when(F.startswith(plain, F.lit("//")), F.concat(F.regexp_extract("url", "^([a-zA-Z]+:)", 1), plain)).when(F.startswith(plain, F.lit("/")), F.concat(origin, plain)).otherwise(F.concat(folder, plain))
    out = found.select("page_id", link.alias("link")).where(F.col("link").rlike("^https?://"))
    if hosts is not None:
        out = out.where(F.lower(F.regexp_extract("link", "://([^/?#]*)", 1)).isin([h.lower() for h in hosts]))
    return out


def robots_rules(robots: DataFrame, agent: str = "brindle") -> DataFrame:
    """(host, allow, prefix) from (host, content): rules of sections for the agent or *; comments and malformed lines skipped."""
    lines = robots.select("host", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))
    lines = lines.select("host", "at", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where(F.col("line").rlike("^[A-Za-z-]+[ \t]*:"))
    parts = lines.select("host", "at", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    # a file is small: its lines fold in order inside one row
    files = parts.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "field", "value"))).alias("lines"))
    start = F.expr("named_struct('on', false, 'open', false, 'rules', cast(array() as array<struct<allow:boolean,prefix:string>>))")

    def step(acc, x):
        agent_line = x["field"] == "user-agent"
        mine = (x["value"] == "*") | (F.lower(x["value"]) == agent.lower())
        on = F.when(agent_line, F.when(acc["open"], acc["on"] | mine).otherwise(mine)).otherwise(acc["on"])
        rule = acc["on"] & x["field"].isin("allow", "disallow") & (x["value"] != "")
        added = F.concat(acc["rules"], F.array(F.struct((x["field"] == "allow").alias("allow"), F.regexp_replace(x["value"], r"\*$", "").alias("prefix"))))
        return F.struct(on.alias("on"), agent_line.alias("open"), F.when(rule, added).otherwise(acc["rules"]).alias("rules"))

    return files.select("host", F.explode(F.aggregate("lines", start, step)["rules"]).alias("r")).select("host", "r.allow", "r.prefix")


def allowed(probes: DataFrame, rules: DataFrame) -> DataFrame:
    """probes (host, path) with allowed: an Allow prefix wins over any Disallow; without a rule all is allowed."""
    found = probes.join(rules, "host", "left").groupBy("host", "path").agg(F.coalesce(F.bool_or(F.when(F.startswith("path", "prefix"), F.col("allow"))), F.lit(False)).alias("yes"), F.coalesce(F.bool_or(F.when(F.startswith("path", "prefix"), ~F.col("allow"))), F.lit(False)).alias("no"))
    return found.select("host", "path", (F.col("yes") | ~F.col("no")).alias("allowed"))


def crawl(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): breadth-first frontier over (src, dst) from seeds (node), ignoring case; each level is materialised."""
    edges = materialize(edges.select(F.lower("src").alias("src"), F.lower("dst").alias("dst")).distinct())
    seen = materialize(seeds.select(F.lower("node").alias("node")).distinct().withColumn("depth", F.lit(0)))
    front = seen
    for level in range(1, depth + 1):
        new = edges.join(front, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = materialize(new.withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def blocked_address(host: str) -> bool:
    """Loopback, private, link-local and other addresses that a fetch must not reach; names are not resolved."""
    if host.lower() == "localhost":
        return True
    try:
        a = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified


@F.pandas_udf(T.BooleanType())
def url_is_blocked(urls: pd.Series) -> pd.Series:
    def one(u):
        if u is None:
            return True
        try:
            parts = urlsplit(u)
        except ValueError:
            return True
        return parts.scheme not in ("http", "https") or not parts.hostname or blocked_address(parts.hostname)

    return urls.map(one)


#: Archive entries by preference, fixed values.
PREFERRED = [".txt", ".html", ".htm", ".md"]


def archive_entries(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """(path, entry, text, status) of the best text entry of every ZIP under path.

    Every file gives a row. The status is ok, no text (no entry of a preferred kind), too
    large (all such entries are above most_bytes; the largest is named) or broken.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        kinds = [(PREFERRED.index(e), -i.file_size, i.filename) for i in z.infolist() if (e := next((x for x in PREFERRED if i.filename.lower().endswith(x)), None))]
                        fit = [k for k in kinds if -k[1] <= most_bytes]
                        if fit:
                            name = min(fit)[2]
                            out.append((p, name, z.read(name).decode("utf-8", "replace"), "ok"))
                        else:
                            out.append((p, min(kinds, key=lambda k: k[1])[2], None, "too large") if kinds else (p, None, None, "no text"))
                except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, zlib.error):
                    out.append((p, None, None, "broken"))
            yield pd.DataFrame(out, columns=["path", "entry", "text", "status"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, entry string, text string, status string")


def read_archives(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """(path, entry, text) of the archives that could be read; archive_entries has a row with its status for every file."""
    return archive_entries(spark, path, most_bytes).where("status = 'ok'").drop("status")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, text, content_hash) of every Markdown file under path, without dependency and version folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(path)
    text = F.decode("content", "UTF-8")
    return files.where(~F.col("path").rlike("/(node_modules|\\.git)/")).select("path", F.substring(F.sha2("path", 256), 1, 16).alias("doc_id"), text.alias("text"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))


def read_images(spark: SparkSession, path: str, extensions: tuple = (".png", ".jpg", ".jpeg", ".gif", ".webp")) -> DataFrame:
    """(path, length, modified) of image files by extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fit = F.lit(False)
    for e in extensions:
        fit = fit | F.endswith(F.lower("path"), F.lit(e))
    return files.where(fit).select("path", "length", F.col("modificationTime").alias("modified"))
