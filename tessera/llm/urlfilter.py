"""URL filters: host rules and trust over the link graph, as DataFrame functions.

Rules decide first.  Urls that no rule fits get their host's verdict: personalised PageRank from trusted hosts along
links (trust), and from blocked hosts against links (distrust), iterated until the scores settle; a host whose
distrust is above ``tau`` times its trust and above ``floor`` of a seed's mean share is blocked.  Pages are counted
into weighted host edges before anything is shuffled, and the iterations run over hosts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: (host suffix, path prefix, verdict)
RULES: list[tuple[str, str, str]] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DAMPING, TAU = 0.85, 1.0
#: Both in mean shares of a seed, so that they don't depend on the crawl's size: the sum of changes at which scores count
#: as settled (what is left then adds up to DAMPING / (1 - DAMPING) of it at most), and the least distrust that blocks.
TOLERANCE, FLOOR = 1e-6, 1e-6

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    return F.expr(f"CASE WHEN coalesce(instr({url}, '://'), 0) = 0 THEN '' ELSE translate(regexp_extract(substring({url}, instr({url}, '://') + 3), '^[^/?#]*', 0), '{_AZ[0]}', '{_AZ[1]}') END")


def path_of(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.expr(f"CASE WHEN coalesce(instr({url}, '://'), 0) = 0 THEN '' ELSE regexp_extract(substring({url}, instr({url}, '://') + 3), '^[^/?#]*([^?#]*)', 1) END")


def _rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host, path) and its verdict; of equally long ones the longer host, then block, wins."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    rule = verdict = None
    for host, path, what in ranked:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if ranked else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links of pages with column ``host`` to other hosts, counted; relative links stay on the host."""
    links = pages.where(F.col("host") != "").select("host", F.explode(F.expr(f"regexp_extract_all({html_col}, '(?i)href\\\\s*=\\\\s*[\"\\']?((?:https?:)?//[^\"\\' >]+)', 1)")).alias("link"))
    links = links.withColumn("link", F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return links.select(F.col("host").alias("src"), host_of("link").alias("dst")).where("dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank (host, score) along edges (src, dst, weight) from seeds (host, share).

    What a host without links holds goes back to the seeds.  That only scales all scores, so it is left out of the rounds
    and made up for at the end, where scores are divided by their sum: they sum to 1, and without any edges they are
    the seeds' shares.  ``rest`` is what a round adds; it is passed on until it sums to ``tolerance`` of the seeds' or
    less.  Its sum shrinks by ``damping`` at least, so the rounds end.  Each round is one aggregate by target, written
    to the shared folder; the round before is deleted.
    """
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = C.settle(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "edges")
    first = (F.col("share") * (1 - damping)).cast("double")
    state, before, most = seeds.select("host", first.alias("score"), first.alias("rest")), None, None
    while True:
        path = C.shared_path(spark, "scores")
        state.write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        if before is not None:
            C.drop_path(spark, before)
        before = path
        sums = state.agg(F.sum("rest").alias("rest"), F.sum("score").alias("score")).first()
        most = tolerance * (sums["rest"] or 0.0) if most is None else most
        if (sums["rest"] or 0.0) <= most:
            return state.select("host", (F.col("score") / F.lit(sums["score"] or 1.0)).alias("score"))
        flow = state.where("rest > 0").join(share, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("rest") * F.col("p") * damping).alias("score"))
        parts = flow.withColumn("rest", F.col("score")).unionByName(state.select("host", "score", F.lit(0.0).alias("rest")))
        state = parts.groupBy("host").agg(F.sum("score").alias("score"), F.sum("rest").alias("rest"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tau: float = TAU, floor: float = FLOOR, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed, as is any host that no
    seed reaches.  Trusted seeds are hosts with pages that a rule allows, blocked ones those with pages that a rule
    blocks, in proportion to those pages.  Ids may be null or repeat.  An empty table gives no rows; extra columns are
    ignored; a very long page is searched whole.
    """
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    p = p.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), "html")
    rule, verdict = _rule_of(RULES if rules is None else rules)
    named = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    counts = named.where("host != ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"), F.count("*").alias("k"))
    counts = C.settle(counts, "hosts")
    total = counts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.count_if(F.col("good") > 0).alias("trusted"), F.count_if(F.col("bad") > 0).alias("blocked"), F.sum("k").alias("k")).first()
    edges = C.settle(host_edges(p), "links")

    def seeds(column: str, n: int | None) -> DataFrame:
        return counts.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(n or 1))).alias("share"))

    trust = propagate(edges, seeds("good", total["g"]), tolerance / (total["trusted"] or 1))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, seeds("bad", total["b"]), tolerance / (total["blocked"] or 1))
    hosts = counts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").na.fill(0.0, ["trust", "distrust"])
    hosts = hosts.withColumn("host_verdict", F.when((F.col("distrust") > floor / (total["blocked"] or 1)) & (F.col("distrust") > tau * F.col("trust")), "block").otherwise("allow"))
    hosts = hosts.select("host", "host_verdict", "trust", "distrust")
    out = C.salted_join(named, hosts, ["host"], C.heavy(counts.select("host", "k"), total["k"] or 0), by="path", how="left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "host_verdict", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
