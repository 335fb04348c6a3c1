"""URL filter: host and path rules first, gradient-boosted trees for the rest.

URLs that a rule decides are the labelled ones. Trees are boosted on lexical
features of a bounded sample of them and then compiled to one SQL expression, so
judging stays within code generation. Only DataFrame and SQL functions are used.

Defined results: a null URL or one without ``://`` has an empty host and path;
no rule fits it, and the trees judge it by its features (a null URL counts as
empty text). Without labelled rows of both verdicts the trees are left out: the
only verdict seen decides, or else ``allow``. Repeated rows are judged one by one;
null page ids are kept. URLs of one score share a verdict, and 0.5 allows. URLs may
be of any length; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

ALLOW, BLOCK = "allow", "block"
RULES = {"com/": ALLOW, "example.com/en/": BLOCK, "www.example.com/en/": ALLOW, "net/es/": BLOCK, "net/fr/": BLOCK}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "fragment", "secure", "suffix_share", "suffix_block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, parts, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, ``host`` and ``path``, and ``suffix``, the host's last label."""
    url = F.coalesce("url", F.lit(""))
    count = lambda c, sign: (F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))).cast("double")
    length = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    each = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    entropy = F.aggregate(each, F.lit(0.0), lambda s, n: s - F.when(n > 0, n / length * F.log2(n / length)).otherwise(0.0))
    return df.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "host_depth": count(F.col("host"), "."), "path_depth": count(F.col("path"), "/"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / length, "hyphens": count(url, "-"), "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "query_length": F.length(query).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"), "secure": F.lower(url).startswith("https:").cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


@dataclass
class UrlModel:
    #: Sum of tree outputs; positive blocks. None: ``default`` decides.
    margin: Column | None
    default: str
    #: suffix, suffix_share and suffix_block; at most ``suffixes`` rows.
    suffixes: DataFrame


def _tree(node, names: tuple[str, ...]) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    goes_left = F.col(names[split.featureIndex()]) <= float(split.threshold())
    return F.when(goes_left, _tree(node.leftChild(), names)).otherwise(_tree(node.rightChild(), names))


def train(labelled: DataFrame, *, train_rows: int = 20_000, trees: int = 10, depth: int = 3, suffixes: int = 1000, seed: int = 7) -> UrlModel:
    """Boost trees on about ``train_rows`` labelled rows, chosen by a hash of the URL.

    Suffix statistics are counted over all labelled rows; the ``suffixes`` most
    frequent ones keep their own, the others share the overall figures.
    """
    stats = labelled.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).orderBy(F.desc("n"), "suffix").limit(suffixes)
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).first()
    n, blocked = total["n"], total["blocked"]
    rate = blocked / n if n else 0.0
    # Both verdicts weigh the same, so that a suffix never seen leans to neither.
    heavy, light = 0.5 / max(blocked, 1), 0.5 / max(n - blocked, 1)
    bad, good = F.col("blocked") * heavy + 0.5 / max(n, 1), (F.col("n") - F.col("blocked")) * light + 0.5 / max(n, 1)
    stats = stage(stats.select("suffix", (F.col("n") / max(n, 1)).alias("suffix_share"), (bad / (bad + good)).alias("suffix_block")), "suffixes")
    if not 0 < blocked < n:
        return UrlModel(None, BLOCK if n and blocked == n else ALLOW, stats)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "url"), 11).cast("double") / float(1 << 53)
    sample = with_suffix(labelled.where(unit < min(1.0, train_rows / n)), stats).withColumn("weight", F.when(F.col("label") > 0, F.lit(n * heavy)).otherwise(F.lit(n * light)))
    sample = stage(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label", "weight"), "sample")
    if sample.select("label").distinct().count() < 2:
        return UrlModel(None, BLOCK if rate > 0.5 else ALLOW, stats)
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed, checkpointInterval=-1).fit(sample)
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        margin = margin + F.lit(float(weight)) * _tree(tree._java_obj.rootNode(), FEATURES)
    return UrlModel(margin, BLOCK if rate > 0.5 else ALLOW, stats)


def with_suffix(df: DataFrame, stats: DataFrame) -> DataFrame:
    joined = df.join(F.broadcast(stats), "suffix", "left")
    return joined.withColumns({"suffix_share": F.coalesce("suffix_share", F.lit(0.0)), "suffix_block": F.coalesce("suffix_block", F.lit(0.5))})


def url_filter(pages: DataFrame, *, rules: dict[str, str] | None = None, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' probability of block) of every row."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    parsed = parsed.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    featured = lexical(parsed).withColumn("ruled", verdict)
    labelled = featured.where("ruled is not null").withColumn("label", (F.col("ruled") == BLOCK).cast("double"))
    model = train(labelled, **options)
    judged = with_suffix(featured, model.suffixes)
    if model.margin is None:
        score = F.lit(1.0 if model.default == BLOCK else 0.0)
    else:
        score = 1 / (1 + F.exp(-2 * model.margin))
    judged = judged.withColumn("score", score)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")
