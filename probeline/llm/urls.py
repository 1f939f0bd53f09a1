"""URL filters: rules by host and path, and link-graph propagation for what no rule names. DataFrame expressions only.

Trust starts at hosts with allowed pages and flows along host edges; distrust starts at hosts with blocked pages and
flows against them. Both are personalised PageRank in whole numbers (shares of ``MASS``), so that sums do not depend on
the order of rows. A host whose distrust is at least its trust, and not zero, is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.llm.tables import LOWER, UPPER, cut, text_of

MASS = 10**24  # of each kind's score, shared out in whole numbers
TOLD = 10**9  # parts of the mass that one unit of the returned scores stands for
DAMPING = 85  # hundredths
ROUNDS = 12  # at least; more as long as they reach new hosts
#: (verdict, rule): a rule is a host, which stands for its subdomains too, and a path that begins with a slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (``A-Z`` lower-cased) and path; both empty for null and for a text without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A struct ``rule, verdict`` of the longest rule that fits, null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """Distinct ``(src, dst)``: links between hosts, and each host with its parent domain in both directions.

    The parent of a host is what follows its first dot. Links to the own host and null or empty hosts are left out.
    """
    own = pages.select(F.col(host_col).alias("src"), F.regexp_extract_all(text_of(html_col), F.lit(LINK), F.lit(1)).alias("_to"))
    links = own.select("src", F.explode("_to").alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    links = links.withColumn("dst", F.regexp_replace("dst", r"^[^@]*@", "")).distinct()
    hosts = own.select("src").union(links.select("dst")).distinct().filter("src like '%.%.%'")
    up = hosts.select("src", F.substring(F.col("src"), F.locate(".", F.col("src")) + 1, F.char_length("src")).alias("dst"))
    both = links.union(up).union(up.select("dst", "src"))
    return both.filter("src <> dst and src <> '' and dst <> ''").distinct()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(kind, host, score)`` after ``rounds`` of propagation, and more until a round reaches no new host.

    ``seeds`` has ``kind, host, weight`` (longs); per kind the weights are shared out of ``MASS``. ``edges`` has
    ``kind, src, dst``. What reaches a host without onward edges stays there. Empty seeds give an empty result. Scores are
    decimals of 38 digits; a share below one part in ``MASS`` of them is lost.
    """
    degree = edges.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    links = cut(edges.join(degree, ["kind", "src"]))
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = seeds.join(F.broadcast(total), "kind")  # as many rows as there are kinds
    start = cut(start.select("kind", "host", whole(F.col("weight").cast("decimal(12,0)") * F.lit(str(MASS)).cast("decimal(25,0)"), F.col("total")).alias("seed")))
    score = start.withColumnRenamed("seed", "score")
    back = start.select("kind", "host", whole(F.col("seed") * (100 - DAMPING), 100).alias("score"))
    turn, reached = 0, -1
    while True:
        part = whole(whole(F.col("score") * DAMPING, 100), F.col("degree")).alias("score")
        sent = score.withColumnRenamed("host", "src").join(links, ["kind", "src"]).select("kind", F.col("dst").alias("host"), part)
        score = sent.union(back).groupBy("kind", "host").agg(F.sum("score").cast("decimal(38,0)").alias("score"))
        turn += 1
        if turn % 4 == 0 or turn >= rounds - 1:
            score = cut(score)
        if turn >= rounds - 1:
            now = score.filter("score > 0").count()
            if turn >= rounds and now == reached:
                return score
            reached = now


def whole(x: Column, divisor: Column | int) -> Column:
    """``x`` divided and rounded down, exactly; ``div`` would give 64 bits."""
    x, by = x.cast("decimal(38,0)"), (divisor if isinstance(divisor, Column) else F.lit(divisor)).cast("decimal(20,0)")
    return ((x - x % by) / by).cast("decimal(38,0)")


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", rounds: int = ROUNDS,
) -> DataFrame:
    """One row per input row: the id, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of its host.

    A page that no rule fits has its host's verdict; a host that neither score reaches is allowed, an empty host too.
    Seeds weigh as many pages as their rules fit, so repeated rows count again. An empty table gives an empty result.
    A page is read once for its links, however long; columns of other names are not read.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    placed = pages.select(id_col, host.alias("host"), path.alias("path"), F.col(html_col).alias("_html"))
    ruled = placed.withColumn("_fit", best_rule(F.col("host"), F.col("path"), rules))
    seeds = ruled.filter("_fit is not null").groupBy(F.col("_fit.verdict").alias("kind"), "host").agg(F.count("*").alias("weight"))
    edges = host_edges(placed, "host", "_html")
    edges = edges.select(F.lit("allow").alias("kind"), "src", "dst").union(edges.select(F.lit("block"), "dst", "src"))
    score = spread(edges, seeds, rounds).groupBy(F.col("host").alias("_host")).agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).cast("decimal(38,0)").alias(name)
          for kind, name in (("allow", "trust"), ("block", "distrust"))]
    )
    out = ruled.drop("_html").join(score, F.col("host") == F.col("_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    method = F.when((distrust > 0) & (distrust >= trust), "block").otherwise("allow")
    return out.select(
        id_col, "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", method).alias("verdict"),
        *[whole(score, TOLD).cast("long").alias(name) for name, score in (("trust", trust), ("distrust", distrust))],
    )
