"""URL filter: a stated rule list first, then association rules that FP-growth mines from labelled URLs."""

import string
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORT = 0.002  # share of the labelled URLs that a rule's tokens and its label must have
CONFIDENCE = 0.6  # share of unwanted ones among the URLs that have a rule's tokens
RULES = 1_000_000  # rules of a model, after pruning, beyond which mining fails
UNWANTED = "label:block"


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host, path, verdict) that fits, else null.

    A rule fits its host and all its subdomains if the path starts with the rule's path.
    """
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: domain endings, words of the host, folders of the path, names in the query. Ids in the path are none."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -n, n), ".")))
    words = F.transform(F.filter(F.split(host, r"[.\-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("word:"), x))
    folders = F.transform(F.filter(F.split(F.lower(path), "/"), lambda x: ~x.rlike(r"^$|\d")), lambda x: F.concat(F.lit("path:"), x))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    return F.array_distinct(F.concat(F.when(F.size(labels) > 0, ends).otherwise(F.array().cast("array<string>")), words, folders, names))


def document_of(url: Column) -> Column:
    """The document id that a page's path names after its language folder, else null."""
    return F.expr("try_cast(nullif(regexp_extract(coalesce({u}, ''), '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') as bigint)".replace("{u}", url))


def _covered(items: tuple[str, ...], confidence: float, best: dict[tuple[str, ...], float]) -> bool:
    """Whether a rule with fewer of these tokens is as confident."""
    if 1 << len(items) <= len(best):
        return any(best.get(some, -1.0) >= confidence for n in range(len(items)) for some in combinations(items, n))
    mine_ = set(items)
    return any(c >= confidence and len(other) < len(items) and mine_.issuperset(other) for other, c in best.items())


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = RULES) -> list[tuple[tuple[str, ...], float]]:
    """Rules (tokens, confidence): URLs with all these tokens are unwanted (toxic, or of low quality) with this confidence.

    Every labelled page is used. A rule goes if one with fewer of its tokens is as confident; all others stay. Without labels there are no rules.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    rows = pages.select(document_of("url").alias("doc_id"), tokens(host_of(F.col("url")), path_of(F.col("url")), F.col("url")).alias("items")).join(known, "doc_id")
    baskets = rows.select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(UNWANTED))).otherwise(F.col("items")).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    found = rules.filter(F.array_contains("consequent", UNWANTED)).select(F.array_sort("antecedent").alias("items"), "confidence")
    best: dict[tuple[str, ...], float] = {}
    for r in found.orderBy(F.size("items"), "items").toLocalIterator():  # shorter rules first; only those that stay are held
        items = tuple(r["items"])
        if not _covered(items, r["confidence"], best):
            best[items] = r["confidence"]
            if len(best) > most:
                raise ValueError(f"more than {most} rules stay after pruning; raise the support or the confidence")
    return [(tuple(sorted(t)), c) for t, c in sorted(best.items(), key=lambda x: (-x[1], sorted(x[0])))]


def matched(rules: list[tuple[tuple[str, ...], float]]):
    """A function from a column of token arrays to the confidence of the best rule whose tokens are all there, else null.

    An inverted index leads from a token to the rules that have it; a rule matches when it was met as often as it has tokens.
    """
    index: dict[str, list[int]] = {}
    for k, (items, _) in enumerate(rules):
        for t in items:
            index.setdefault(t, []).append(k)

    @F.arrow_udf("double")
    def confidence(column: pa.Array) -> pa.Array:
        out = []
        for items in column.to_pylist():
            met: dict[int, int] = {}
            for t in items or ():
                for k in index.get(t, ()):
                    met[k] = met.get(k, 0) + 1
            out.append(max((rules[k][1] for k, n in met.items() if n == len(rules[k][0])), default=None))
        return pa.array(out, pa.float64())

    return confidence


def judged(pages: DataFrame, labels: DataFrame, stated: list[tuple[str, str, str]], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and the mined confidence of every page, repeated and null rows included.

    The stated rule decides; else a mined rule blocks; else the page is allowed.
    """
    mined = mine(pages, labels, support, confidence)
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = parts.select("page_id", "host", "path", stated_rule(F.col("host"), F.col("path"), stated).alias("s"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("items"))
    scored = found.withColumn("confidence", matched(mined)("items") if mined else F.lit(None).cast("double"))
    verdict = F.coalesce("s.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("s.rule").alias("rule"), verdict.alias("verdict"), "confidence")
