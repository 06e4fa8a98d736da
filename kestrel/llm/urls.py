"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is native: URL parts, rules and features are column expressions, the
trees are fitted and applied by Spark ML. The labelled URLs are pages whose
path ends in the number of a labelled document; a URL is bad when that
document's quality label is 0. Suffix statistics (how often a host's last label
occurs among all labelled URLs, and its smoothed share of bad ones) are joined
from a staged table; only the trees' fit is on a bounded sample (``TRAIN_URLS``).

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and gets the trees' verdict on empty features; an empty path does not
start with a rule's ``/``; without labelled URLs everything is allowed, and
with one class of them everything gets that class; repeated rows are judged
one by one; a null id is kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import bounded_sample, id_text, small_side, staged

# Fixed values: (verdict, host, path); the longest rule that fits decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Bound on the labelled URLs the trees are fitted on (about; see bounded_sample).
TRAIN_URLS = 20_000
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 7
# Rows of prior belief in a suffix's share of bad URLs.
PRIOR_ROWS = 20.0
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy",
            "parameters", "hyphens", "has_fragment", "suffix_urls", "suffix_bad"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumns({"host": F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER),
                           "path": F.regexp_extract(url, parts, 2)})


def fits(host: str, path: str) -> Column:
    h = F.col("host")
    return ((h == host) | h.endswith("." + host)) & F.col("path").startswith(path)


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (text of the longest one that fits, else null) and ruled (its verdict)."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        rule = F.when(fits(host, path), host + path).otherwise(rule)
        ruled = F.when(fits(host, path), verdict).otherwise(ruled)
    return df.withColumns({"rule": rule, "ruled": ruled})


def entropy(s: Column) -> Column:
    """Bits per character of a text, 0 for an empty one."""
    n = F.char_length(s)
    share = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.char_length(F.replace(s, c, F.lit("")))) / n)
    bits = F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(0.0)


def with_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the lexical features of a URL with host and path, and its suffix (the host's last label)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.char_length(url)

    def count(s, pattern: str) -> Column:
        return F.regexp_count(s, F.lit(pattern)).cast("double")

    return df.withColumns({
        "url_length": n.cast("double"), "host_length": F.char_length("host").cast("double"),
        "path_length": F.char_length("path").cast("double"), "depth": count(F.col("path"), "/+[^/]"),
        "host_labels": count(F.col("host"), "[^.]+"),
        "digit_ratio": F.when(n > 0, count(url, "[0-9]") / n).otherwise(0.0), "entropy": entropy(url),
        "parameters": count(query, "[^&]+"), "hyphens": count(F.col("host"), "-"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.element_at(F.split("host", r"\."), -1)})


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, bad (1.0 or 0.0) of the pages whose path ends in a labelled document's number."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    named = with_parts(pages.select("page_id", "url")).withColumn(
        "doc_id", F.regexp_extract("path", r"/(\d+)[^/\d]*/?$", 1).try_cast("bigint"))
    return named.join(known, "doc_id").select("page_id", "url", (F.col("quality") == 0).cast("double").alias("bad"))


def with_suffix(df: DataFrame, suffixes: DataFrame, share: float) -> DataFrame:
    return (df.join(suffixes, "suffix", "left")
            .fillna({"suffix_urls": 0.0, "suffix_bad": share}))


def train(labelled: DataFrame) -> tuple[PipelineModel | float, DataFrame | None, float]:
    """(fitted trees, or the one class there is; suffix statistics and share of bad URLs over all labelled)."""
    every = staged(with_features(with_parts(labelled)).select("page_id", "url", "bad", "suffix"), "url_labelled")
    rows = staged(with_features(with_parts(bounded_sample(every, id_text("page_id"), TRAIN_URLS))), "url_sample")
    n, bad = rows.agg(F.count(F.lit(1)), F.sum("bad")).first()
    if not n or bad in (0.0, float(n)):
        return (1.0 if n and bad else 0.0), None, 0.0
    share = every.agg(F.avg("bad")).first()[0]
    suffixes = small_side(staged(every.groupBy("suffix").agg(
        F.count(F.lit(1)).cast("double").alias("suffix_urls"),
        ((F.sum("bad") + PRIOR_ROWS * share) / (F.count(F.lit(1)) + PRIOR_ROWS)).alias("suffix_bad")), "url_suffixes"))
    # The sample is bounded; in one sorted partition its sums, and so the trees, are always the same.
    rows = with_suffix(rows, suffixes, share).coalesce(1).sortWithinPartitions("page_id", "url")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="bad", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED)
    return PipelineModel([assembler, trees.fit(assembler.transform(rows))]), suffixes, share


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    model, suffixes, share = train(labelled)
    df = with_rule(with_parts(pages.select("page_id", "url")), rules)
    if isinstance(model, float):
        df = df.withColumn("prediction", F.lit(model))
    else:
        df = model.transform(with_suffix(with_features(df), suffixes, share))
    method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))
