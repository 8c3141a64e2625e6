"""URL filter: host and path rules first, else logistic regression on hashed character n-grams of host and path.

All of it is DataFrame expressions. The model is fitted by full-batch gradient descent over a small table of labelled
URLs: the table becomes one row of arrays (its size is bounded by MAX_LABELLED, a larger one is refused), and a fold over
the iterations updates the weights. The fitted weights (BUCKETS + 1 numbers) are read once and put into the scoring
expression as a literal, so pages are scored in one pass without a join.

A null URL, or one without "://", has an empty host and path: no rule fits, the model decides by its intercept. Texts may
be of any length; equal rows each get their result; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS, GRAM, ITERATIONS, RATE, RIDGE, SCALE = 128, 3, 100, 3.0, 1e-4, 6.0
MAX_LABELLED = 2_000

#: (verdict, host, path) rules of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Labelled URLs (1: block) from which the query's model learns.
LABELLED = [
    ("https://docs.python.example.org/en/3/library", 0),
    ("https://encyclopedia.example.org/de/artikel/wasser", 0),
    ("https://library.example.net/en/books/1201", 0),
    ("http://www.museum.example.org/fr/collections", 0),
    ("https://news.example.org/en/2021/03/report.html", 0),
    ("https://science.example.org/es/articulo/77", 0),
    ("http://university.example.net/de/kurse", 0),
    ("https://blog.gardening.example.org/en/tomatoes", 0),
    ("https://www.weather.example.net/en/forecast", 0),
    ("https://recipes.example.org/fr/soupe", 0),
    ("http://maps.example.net/de/berlin", 0),
    ("https://history.example.org/en/timeline.html", 0),
    ("http://win-casino.example.net/en/bonus?ref=1", 1),
    ("http://free-pills.example.org/buy/now", 1),
    ("https://cheap-loans.example.net/de/sofort", 1),
    ("http://xxx-videos.example.org/watch", 1),
    ("http://casino-bonus.example.org/es/gratis", 1),
    ("http://click-ads.example.net/track/click", 1),
    ("https://adult-cams.example.org/live/xxx", 1),
    ("http://buy-followers.example.net/cheap", 1),
    ("http://pills-online.example.org/fr/acheter", 1),
    ("http://spam-track.example.net/ads/click.php", 1),
    ("http://lottery-win.example.org/winner", 1),
    ("http://warez-crack.example.net/download/free", 1),
]


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(host: str, path: str) -> str:
    return host + path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """Verdict (what = 0) or name of the longest rule that fits; null if none does. Rules are a short list that the driver holds."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(rule_name(r[1], r[2]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.lit(verdict if what == 0 else rule_name(h, p))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def grams(host: Column, path: Column) -> Column:
    """Buckets (1 to BUCKETS) of the GRAM-grams of "^host$" and of the path, each part hashed apart."""

    def of(text: Column, part: str) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.greatest(F.length(padded) - (GRAM - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: (F.pmod(F.xxhash64(F.lit(part), F.substring(padded, i, F.lit(GRAM))), F.lit(BUCKETS)) + 1).cast("int"))

    return F.concat(of(host, "h"), of(path, "p"))


def margin(buckets: Column, weights: Column) -> Column:
    """Intercept plus SCALE times the mean weight of the buckets; weights has the intercept last."""
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.element_at(weights, b))
    return F.element_at(weights, F.lit(BUCKETS + 1)) + total * SCALE / F.size(buckets)


def fit(labelled: DataFrame) -> list[float]:
    """Weights learnt from labelled(url string, label int, 1: block). Rows with a null label are left out."""
    url = F.col("url")
    rows = labelled.where("label is not null").select(grams(host_of(url), path_of(url)).alias("b"), F.col("label").cast("double").alias("y"))
    if (n := rows.limit(MAX_LABELLED + 1).count()) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    if not n:
        return [0.0] * (BUCKETS + 1)
    zero = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    # counts of a URL's buckets as shares, the intercept last
    share = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS)), lambda k: F.size(F.filter(F.col("b"), lambda b: b == k)) * SCALE / F.size("b"))
    one = rows.select(F.struct(F.concat(share, F.array(F.lit(1.0))).alias("x"), "y").alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rows"))

    def dot(w: Column, x: Column) -> Column:
        return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def step(w: Column, _: Column) -> Column:
        def add(g: Column, r: Column) -> Column:
            err = F.lit(1.0) / (1 + F.exp(-dot(w, r["x"]))) - r["y"]
            return F.zip_with(g, r["x"], lambda a, b: a + err * b)

        grad = F.aggregate(F.col("rows"), zero, add)
        return F.zip_with(w, grad, lambda a, g: a - RATE * (g / n + RIDGE * a))

    weights = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), zero, step).alias("w"))
    return list(weights.first()["w"])


def judge(df: DataFrame, weights: list[float], rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of block) of every row."""
    url = F.col(url_col).cast("string")
    parts = df.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    w = F.array(*map(F.lit, weights))
    scored = parts.withColumn("score", 1 / (1 + F.exp(-margin(grams(host, path), w))))
    verdict = F.coalesce(rule_of(host, path, rules, 0), F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", rule_of(host, path, rules, 1).alias("rule"), verdict.alias("verdict"), "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = fit(spark.createDataFrame(LABELLED, "url string, label int"))
    return judge(table(spark, sf_dir, "pages"), weights)
