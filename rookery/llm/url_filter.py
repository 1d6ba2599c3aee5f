"""URL filters: explicit rules first, then trust and distrust propagated over links between hosts.

Trust is personalised PageRank from hosts with allowed pages along links; distrust is the same from hosts with
blocked pages against them. Ranks stay distributed tables; a round is one join and one sum per host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import lower_ascii
from rookery.session import stage


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host and a path prefix, as in ``example.org/es/``."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (
    Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"), Rule("block", "com/de/"),
)
DAMPING, ROUNDS = 0.85, 12


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for texts without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits, or nulls. ``rules`` is a parameter of bounded length."""
    pattern = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern = F.when(fits, r.pattern) if pattern is None else pattern.when(fits, r.pattern)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if pattern is None else (pattern, verdict)


def host_edges(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links to other hosts in the whole HTML, counted, and one edge each way between a host and its parent domain."""
    target = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1))
    out = pages.select(host.alias("src"), F.explode(F.transform(target, lower_ascii)).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    parent = F.regexp_extract("src", r"^[^.]+\.(.+\..+)$", 1)
    child = pages.select(host.alias("src")).distinct().select("src", parent.alias("dst")).where("dst <> ''")
    kin = child.unionByName(child.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return out.unionByName(kin).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host, seed), ``rounds`` power steps.

    Mass of hosts without links out is not handed on, it counts where it arrived.
    """
    degree = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    step = stage(edges.join(degree, "src").select("src", "dst", (damping * F.col("weight") / F.col("total")).alias("share")), "pagerank_steps")
    total = seeds.agg(F.sum("seed")).first()[0] or 1.0
    start = stage(seeds.select("host", (F.col("seed") / total).alias("rank")), "pagerank_seeds")
    now = start
    for k in range(rounds):
        moved = now.join(step, now["host"] == step["src"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        back = start.select("host", ((1 - damping) * F.col("rank")).alias("rank"))
        now = moved.unionByName(back).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % 4 == 3 or k == rounds - 1:
            now = stage(now, "pagerank")
    return now


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, bias: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): one row per input row.

    Without a rule, a page is blocked if its host's distrust is over ``bias`` times its trust. Hosts that nothing
    reaches, the empty host of null and malformed URLs among them, are allowed. Null HTML has no links; repeated
    rows each get a row; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    pattern, verdict = matched(rules, F.col("host"), F.col("path"))
    ruled = stage(parsed.withColumns({"rule": pattern, "ruled": verdict}), "url_rules")
    edges = stage(host_edges(pages, host), "url_edges")
    seeds = stage(
        ruled.where("host <> ''").groupBy("host").agg(
            F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")
        ),
        "url_seeds",
    )
    trust = pagerank(edges, seeds.where("allowed > 0").select("host", (F.col("allowed") / F.col("n")).alias("seed")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = pagerank(back, seeds.where("blocked > 0").select("host", (F.col("blocked") / F.col("n")).alias("seed")))
    scores = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    zero = F.lit(0.0)
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.coalesce("distrust", zero) > bias * F.coalesce("trust", zero), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"),
    )
