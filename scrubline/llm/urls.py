"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Features are lengths, depth, share of digits, entropy of the characters,
number of parameters, and smoothed block rates of the host's suffixes among all
labelled URLs. The trees learn from at most ``max_train`` labelled URLs, chosen
by digest; their rates come from the labels of the other folds, so that no URL's own
label is in its features. Scoring uses DataFrame functions only.

Results for unusual rows: a null URL, or one without ``://``, has an empty host
and path and is judged by the trees. Repeated rows are judged alike. Without
labelled URLs of both kinds the trees give the more frequent verdict, allow if
there is none. A URL labelled more than once counts once per label. Very long URLs
are read whole. Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import ascii_lower, salted_join
from scrubline.staging import stage

# (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_share", "hyphens", "longest_label",
    "entropy", "parameters", "has_fragment", "has_extension", "rate_1", "rate_2", "rate_all",
]


SUFFIXES = {"rate_1": 1, "rate_2": 2, "rate_all": 0}
FOLDS = 5  # of labelled URLs, by digest


def parts(urls: DataFrame) -> DataFrame:
    """``row, url, host, path``."""
    after = F.regexp_extract("url", "(?s)^.*?://(.*)$", 1)
    out = urls.select(F.struct("*").alias("row"), F.coalesce("url", F.lit("")).alias("url"))
    return out.withColumn("host", ascii_lower(F.regexp_extract(after, "(?s)^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1))


def by_rule(rules=RULES) -> Column:
    """``rule, verdict`` of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _suffix(k: int) -> Column:
    """The last ``k`` labels of the host; the whole host for 0."""
    return F.col("host") if not k else F.substring_index("host", ".", -k)


def lexical(df: DataFrame) -> DataFrame:
    """``df`` with the features that need no labels."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    size = F.greatest(F.length(url), F.lit(1))
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    split = F.split(host, "\\.")
    return df.withColumns({
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")), "labels": F.size(split),
        "digit_share": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / size,
        "hyphens": F.length(host) - F.length(F.translate(host, "-_", "")),
        "longest_label": F.array_max(F.transform(split, F.length)), "entropy": F.round(entropy, 6),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"), "has_extension": path.rlike("\\.[A-Za-z0-9]{1,5}$").cast("int"),
    })


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int")


def _spread(df: DataFrame) -> list[str]:
    """What tells rows of one URL apart: the hashable columns of ``row``, if there is one, beside the URL."""
    fields = df.schema["row"].dataType.fields if "row" in df.columns else []
    names = [f.name.lower() for f in fields]
    kinds = {f.name: f.dataType.simpleString() for f in fields if names.count(f.name.lower()) == 1}
    quote = lambda n: n.replace("`", "``")
    return ["url", *[f"row.`{quote(n)}`" for n, kind in kinds.items() if "map<" not in kind and "variant" not in kind]]


class UrlModel:
    """Block rates of suffixes and boosted trees, fitted on labelled URLs.

    ``labelled`` has ``url, host, path, label`` (1: block).
    """

    def __init__(self, labelled: DataFrame, max_train: int = 20_000, smoothing: float = 5.0, trees: int = 10, depth: int = 3, seed: int = 7):
        order = F.xxhash64("url")
        every = stage(labelled.select("url", "host", "path", "label").distinct(), "labelled")
        self.sample = stage(every.orderBy(order, "url", "label").limit(max_train), "sampled")
        n, blocked = every.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        self.prior, self.smoothing = (blocked + 0.5) / (n + 1) if n else 0.0, smoothing
        in_fold = [_fold() == i for i in range(FOLDS)]
        self.rates = {
            name: stage(
                every.groupBy(_suffix(k).alias(f"_{name}")).agg(
                    F.array(*[F.count_if(x & (F.col("label") == 1)) for x in in_fold]).alias(f"{name}_blocked"),
                    F.array(*[F.count_if(x) for x in in_fold]).alias(f"{name}_seen"),
                ),
                name,
            )
            for name, k in SUFFIXES.items()
        }
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        self.model = None
        kinds = self.sample.agg(F.count_distinct("label")).first()[0]
        if kinds == 2:
            trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed, checkpointInterval=-1)
            self.model = trees.fit(self.assembler.transform(self.features(self.sample, fitting=True)).select("features", F.col("label").cast("double").alias("label")))

    def features(self, df: DataFrame, fitting: bool = False) -> DataFrame:
        """``df`` with all features; ``fitting`` leaves the labels of a row's own fold out of its rates."""
        hosts = df.select("host").distinct()  # suffixes are looked up once per host
        for name, rate in self.rates.items():
            hosts = salted_join(hosts.withColumn(f"_{name}", _suffix(SUFFIXES[name])), rate, [f"_{name}"], ["host"], "left").drop(f"_{name}")
        out = salted_join(lexical(df), hosts, ["host"], _spread(df), "left")

        def labels(counts: str) -> Column:
            total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
            own = F.get(counts, _fold()) if fitting else F.lit(0)
            return F.coalesce(total - own, F.lit(0))

        rate = lambda name: (labels(f"{name}_blocked") + self.smoothing * self.prior) / (labels(f"{name}_seen") + self.smoothing)
        out = out.withColumns({name: rate(name) for name in SUFFIXES})
        return out.withColumns({c: F.col(c).cast("double") for c in FEATURES})

    def judge(self, df: DataFrame) -> DataFrame:
        """``df`` with ``blocked``."""
        if self.model is None:
            return df.withColumn("blocked", F.lit(self.prior > 0.5))
        scored = self.model.transform(self.assembler.transform(self.features(df)))
        return scored.withColumn("blocked", F.col("prediction") > 0.5).select(*df.columns, "blocked")


def judge(urls: DataFrame, rules=RULES, labelled: DataFrame | None = None, max_train: int = 20_000) -> DataFrame:
    """``row, host, path, rule, verdict``. Without ``labelled`` the URLs that a rule decides are the labelled ones."""
    ruled = parts(urls).withColumn("found", by_rule(rules))
    if labelled is None:
        labelled = ruled.where(F.col("found").isNotNull()).withColumn("label", (F.col("found.verdict") == "block").cast("int"))
    judged = UrlModel(labelled, max_train).judge(ruled)
    return judged.select("row", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
