"""URL filter by the ratio of two character language models, below a list of host and path rules.

Two Markov models, of accepted and of rejected URLs, give each character a probability after the longest of its last
ORDER characters that was seen, smoothed by all shorter ones (each order is mixed with the next shorter one by the
number of different continuations of its context). A URL's score is the difference of both log-likelihoods divided by
its length; the threshold is the one that separates held-back labelled URLs best. Only DataFrame functions are used.

Characters fall into SYMBOLS classes, so a model has SYMBOLS ** (ORDER + 1) cells whatever is read and is broadcast;
characters are added up where their URL is read, and one row per URL is shuffled.

Defined cases: a null URL and one without `://` have empty host and path, no rule, and the score of what text they have
(null counts as empty); ties with the threshold are accepted; where one kind of labelled URL is missing, its model is
uniform and the threshold 0; repeated rows count each in training and get equal rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowfeat.llm.common import stored, tuned

ORDER = 3
BITS = 5
SYMBOLS = 1 << BITS
# Number of each character: 0 is the edge of the URL, 1 any other character, then letters, a digit, and three signs.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Scores are rounded to so many steps per unit, within ±LIMIT, when the threshold is chosen.
STEPS, LIMIT = 100, 10
# One labelled URL in so many is held back for the threshold.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name and verdict (struct) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def symbols(url: Column) -> Column:
    """Class numbers of the characters after `://` (of all, without it), and the edge."""
    text = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    text = F.translate(ascii_lower(text), "123456789", "000000000")
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    return F.concat(F.transform(signs, lambda c: F.call_function("instr", F.lit(_ALPHABET), c) + 1), F.array(F.lit(0)))


def grams(urls: DataFrame) -> DataFrame:
    """A row for each character of `urls` (a column `url` and others): `gram` has it and the ORDER before it."""
    keep = urls.columns
    lined = urls.withColumn("symbols", symbols(F.col("url")))
    whole = F.col("symbols")
    for k in range(1, ORDER + 1):
        before = F.slice(F.concat(F.array_repeat(F.lit(0), k), "symbols"), 1, F.size("symbols"))
        shifted = F.transform(before, lambda b: F.shiftleft(b, BITS * k))  # noqa: B023
        whole = F.zip_with(whole, shifted, lambda a, b: a + b)
    return lined.select(*keep, F.explode(whole).alias("gram"))


def model(labelled: DataFrame) -> DataFrame:
    """`gram`, `value`: how much more likely the last symbol is in accepted URLs (log ratio). Stored.

    `labelled`: url, accept. The table has SYMBOLS ** (ORDER + 1) rows whatever is read.
    """
    seen = grams(labelled.select("url", F.when(F.col("accept"), 1).otherwise(0).alias("accept")))
    seen = seen.groupBy("gram").agg(F.sum("accept").alias("n1"), F.sum(1 - F.col("accept")).alias("n0"))
    seen = stored(seen)
    cells = labelled.sparkSession.range(SYMBOLS ** (ORDER + 1)).select(F.col("id").cast("int").alias("gram"))
    chance = [F.lit(1.0 / SYMBOLS), F.lit(1.0 / SYMBOLS)]
    for k in range(ORDER + 1):
        short = F.col("gram").bitwiseAND(SYMBOLS ** (k + 1) - 1)
        counts = seen.groupBy(short.alias("key")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
        totals = counts.groupBy(F.shiftright("key", BITS).alias("context")).agg(
            *[F.sum(f"c{i}").alias(f"t{i}") for i in (0, 1)], *[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in (0, 1)]
        )
        cells = cells.withColumn("key", short).join(counts, "key", "left")
        cells = cells.withColumn("context", F.shiftright("key", BITS)).join(totals, "context", "left")
        for i in (0, 1):
            t, d = (F.coalesce(F.col(f"{n}{i}"), F.lit(0)) for n in "td")
            mixed = (F.coalesce(F.col(f"c{i}"), F.lit(0)) + d * chance[i]) / (t + d)
            chance[i] = F.when(t > 0, mixed).otherwise(chance[i])
        cells = cells.select("gram", *[chance[i].alias(f"p{i}") for i in (0, 1)])
        chance = [F.col("p0"), F.col("p1")]
    return stored(cells.select("gram", (F.log("p1") - F.log("p0")).alias("value")))


def scored(urls: DataFrame, table: DataFrame) -> DataFrame:
    """Every row of `urls` (a column `url` and others) with its `score`, the mean of its characters' values.

    The model is broadcast: its size is fixed. Values of a row are added where the row is read.
    """
    keep = urls.columns
    ends = (F.col("gram").bitwiseAND(SYMBOLS - 1) == 0).cast("int")
    totals = (
        grams(urls)
        .join(F.broadcast(table), "gram")
        .groupBy(*keep)
        .agg(F.avg("value").alias("score"), F.sum(ends).alias("times"))  # equal rows come as one, `times` over
    )
    return totals.select(*keep, "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


def threshold(held_back: DataFrame) -> float:
    """The score that separates labelled URLs (`accept`, `score`) best: the most right in the mean of both kinds.

    Of equally good ones the one nearest to 0. Scores are counted in 2 * LIMIT * STEPS bins; 0 if a kind is missing.
    """
    bin_ = F.greatest(F.lit(-LIMIT * STEPS), F.least(F.lit(LIMIT * STEPS), F.floor(F.col("score") * STEPS)))
    bins = held_back.groupBy(bin_.alias("bin")).agg(F.count_if("accept").alias("good"), F.count_if(~F.col("accept")).alias("bad"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    right = F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.sum("bad").over(all_)
    right += 1 - F.coalesce(F.sum("good").over(below), F.lit(0)) / F.sum("good").over(all_)
    judged = bins.withColumn("right", F.when((F.sum("bad").over(all_) > 0) & (F.sum("good").over(all_) > 0), right))
    best = judged.where("right IS NOT NULL").orderBy(F.desc("right"), F.abs("bin"), "bin").select("bin").first()
    return best["bin"] / STEPS if best else 0.0


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """One row for each row of `pages` (page_id, url): page_id, url, host, path, rule, verdict, score.

    `labelled` (url, accept) teaches the models; by default the URLs of `pages` that a rule decides do.
    """
    tuned(pages.sparkSession)
    pages = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    if labelled is None:
        decided = pages.select("url", ruled(host, path, rules).alias("rule")).where("rule IS NOT NULL")
        labelled = decided.select("url", (F.col("rule.verdict") == "allow").alias("accept"))
    back = F.pmod(F.crc32("url"), F.lit(FOLDS)) == 0
    table = model(labelled.where(~back))
    limit = threshold(scored(labelled.where(back).select("url", "accept"), table))
    # floor(score * STEPS) is what was counted, so a score is accepted from the bin's lower end on
    by_model = F.when(F.floor(F.col("score") * STEPS) >= F.lit(round(limit * STEPS)), "allow").otherwise("block")
    out = scored(pages, table).withColumns({"host": host, "path": path}).withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    return out.select(
        "page_id", "url", "host", "path", "found.rule", F.coalesce("found.verdict", by_model).alias("verdict"), "score"
    )
