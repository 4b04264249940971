"""URL filter: rules first, then gradient-boosted trees on lexical features of the URL."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.sources.shared import materialize

#: Fitting reads about so many labelled URLs at most, chosen by a hash of the row.
SAMPLE_URLS = 20_000
TREES, DEPTH = 20, 4
SMOOTHING = 5.0
#: Rules are part of the expression of each row.
MOST_RULES = 1_000
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/%=&?:+"

FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy",
    "parameters", "query_length", "longest_label", "has_port", "encoded", "suffix_rate", "suffix_count",
    "domain_rate", "domain_count",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a URL; both empty if it is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.translate(part(1), upper, upper.lower()), part(2)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host/path) that fits, else null; a rule fits its host and all subdomains."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: keep them in a table")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def _share(text: Column, pattern: str) -> Column:
    size = F.length(text)
    return F.when(size == 0, 0.0).otherwise(1 - F.length(F.regexp_replace(text, pattern, "")) / size)


def _entropy(text: Column) -> Column:
    """Bits per character over the usual characters of URLs."""
    size = F.length(text)
    total = F.lit(0.0)
    for c in _ALPHABET:
        p = (size - F.length(F.translate(text, c, ""))) / size
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return F.when(size == 0, 0.0).otherwise(total)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with the features that need nothing but the URL, its suffix and domain."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return urls.withColumns({
        "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")), "labels": F.size(labels),
        "digit_ratio": _share(url, "[0-9]"), "host_digit_ratio": _share(F.col("host"), "[0-9]"),
        "hyphens": F.length("host") - F.length(F.translate("host", "-", "")), "entropy": _entropy(F.lower(url)),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.length(query),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
        "has_port": F.col("host").rlike(":[0-9]+$").cast("int"),
        "encoded": F.size(F.split(url, "%")) - 1,
        "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})


def _rates(labelled: DataFrame, column: str) -> DataFrame:
    """Per value and fold: the smoothed share of blocked URLs and their number in the other fold; fold 2 has all."""
    sums = labelled.groupBy(column, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))
    ways = sums.select(column, F.explode(F.expr("array(1 - fold, 2)")).alias("fold"), "n", "bad")
    total = ways.groupBy(column, "fold").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return total.select(column, "fold", ((F.col("bad") + SMOOTHING / 2) / (F.col("n") + SMOOTHING)).alias(f"{column}_rate"),
                        F.log1p("n").alias(f"{column}_count"))


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    for column, table in rates.items():
        rows = rows.join(table, [column, "fold"], "left").fillna({f"{column}_rate": 0.5, f"{column}_count": 0.0})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


class Filter:
    """Boosted trees and the suffix statistics they use."""

    def __init__(self, model: GBTClassificationModel | None, rates: dict[str, DataFrame], constant: float) -> None:
        self.model, self.rates, self.constant = model, rates, constant

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (url, host, path, ...) with ``score``, the probability that the URL is to be blocked."""
        if self.model is None:
            return rows.withColumn("score", F.lit(self.constant))
        names = rows.columns
        made = _with_rates(lexical(rows).withColumn("fold", F.lit(2)), self.rates)
        return self.model.transform(made).select(
            *names, vector_to_array("probability")[1].alias("score"))


def fit(labelled: DataFrame) -> Filter:
    """Learn from URLs (url, host, path, label 0 or 1); the trees see about SAMPLE_URLS rows of them.

    Suffixes and domains are counted over all labelled rows: for a training row over the other half of them, for other rows over all.
    With labels of one kind only the filter gives all URLs that label; with none it blocks nothing.
    """
    size = labelled.groupBy("label").count().collect()
    counts = {r[0]: r[1] for r in size}
    if len(counts) < 2:
        return Filter(None, {}, float(next(iter(counts), 0)))
    share = min(1.0, SAMPLE_URLS / sum(counts.values()))
    chance = F.pmod(F.xxhash64("url", "row_"), F.lit(1_000_003))
    folded = labelled.withColumn("fold", F.pmod(F.hash("row_", "url"), F.lit(2)))
    sample = lexical(folded.where(chance < share * 1_000_003))
    own = [f for f in FEATURES if not f.startswith(("suffix_", "domain_"))]
    sample = materialize(sample.select("label", "fold", "suffix", "domain", *own), "labelled-urls")
    places = folded.select("fold", "label", *[F.substring_index("host", ".", -n).alias(c) for n, c in ((1, "suffix"), (2, "domain"))])
    rates = {c: materialize(_rates(places, c), f"{c}-rates") for c in ("suffix", "domain")}
    train = _with_rates(sample, rates).select("features", F.col("label").cast("double").alias("label"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1, cacheNodeIds=False).fit(train)
    return Filter(model, rates, 0.0)


def judged(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row; the rules' verdicts are the labels of the trees.

    A null URL and one without ``://`` have an empty host and path, and the trees' verdict. Repeated rows and null ids stay as they are.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, value in rules.items():
        verdict = F.when(F.col("rule") == rule, value).otherwise(verdict)
    rows = rows.withColumn("ruled", verdict)
    labelled = rows.where("ruled IS NOT NULL").select(
        "url", "host", "path", F.col("page_id").alias("row_"), (F.col("ruled") == "block").cast("int").alias("label"))
    scored = fit(labelled).scored(rows)
    return scored.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
