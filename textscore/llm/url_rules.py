"""URL filter: fixed host and path rules first, association rules mined by FP-growth for the rest.

A URL becomes a set of tokens, of every label of its host, segment of its path and key of its
query (``tokens``). Pages that a fixed rule judges are the labelled ones. A count over all of them
leaves the tokens that reach the support asked for, and of tokens that stand in the same pages one; Spark's
FP-growth finds their combinations that go with a verdict, rules
under the support or confidence asked for are dropped, and so is a rule that a more general one
makes redundant. The rules kept (at most ``max_rules``, the size of the model) form an
inverted index from each rule's rarest token; a URL looks up its own tokens there and keeps
the rules all of whose tokens it has. The rule of highest confidence decides, then higher
support, then fewer tokens, then the tokens' text.

Column functions only: mining runs in Spark's JVM code, judging is a projection without a
shuffle. A NULL URL, or one without ``://``, has an empty host and path; it fits no fixed
rule and gets ``default`` if no mined rule fits. With no labelled page every open verdict is
``default``. Repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "map<string, array<struct<items: array<string>, verdict: string, confidence: double, support: double>>>"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for every URL whose host is ``host`` or under it and whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def fixed_rule(rules: list[Rule], host_: Column, path_: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits; NULL if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _named(kind: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(kind + "="), x))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels, ends of the host, path segments, query keys, ending and mark.

    Digit runs of path segments count as 0. Nothing is left out, however long the URL is.
    """
    h, p = host(url), path(url)
    labels, parts = F.split(h, r"\."), F.filter(F.split(p, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    shape = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    one = {
        "scheme": F.lower(F.substring_index(url, "://", 1)),
        "under2": F.when(F.size(labels) > 1, F.substring_index(h, ".", -2)),
        "under3": F.when(F.size(labels) > 2, F.substring_index(h, ".", -3)),
        "top": F.element_at(labels, -1),
        "first": shape(F.get(parts, F.lit(0))),
        "ending": F.regexp_extract(p, r"(\.[A-Za-z]+|/)$", 1),
        "mark": F.regexp_extract(F.coalesce(url, F.lit("")), r"#(.*)$", 1),
    }
    many = {"label": labels, "part": F.transform(parts, shape), "key": F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))}
    single = F.array_compact(F.array(*[F.when(F.length(v) > 0, F.concat(F.lit(k + "="), v)) for k, v in one.items()]))
    lists = [_named(k, F.filter(v, lambda x: F.length(x) > 0)) for k, v in many.items()]
    return F.when(F.locate("://", url) > 0, F.array_distinct(F.concat(single, *lists))).otherwise(F.array().cast("array<string>"))


def vocabulary(rows: DataFrame, support: float) -> DataFrame:
    """(token): those of the baskets ``rows`` (tokens, page) that reach the support, one of several that stand in the same pages.

    ``page`` is a hash; pages are compared by their number and two sums over it. Kept is the first in order of text.
    """
    total = rows.count()
    each = rows.select(F.explode("tokens").alias("token"), F.pmod("page", F.lit(2147483647)).alias("a"), F.pmod(F.xxhash64("page"), F.lit(2147483629)).alias("b"))
    counted = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("n") >= support * total)
    return counted.groupBy("n", "a", "b").agg(F.min("token").alias("token")).select("token")


def mine(labelled: DataFrame, url: str, verdict: str, support: float, confidence: float, max_rules: int) -> list[dict]:
    """The association rules from token combinations to a verdict, as (items, verdict, confidence, support).

    ``support`` and ``confidence`` are shares. A rule is redundant where one with fewer of its tokens has
    the verdict with no less confidence; of the others at most ``max_rules`` are kept, the most confident,
    then most supported, then shortest. The driver holds no more than those.
    """
    rows = labelled.select(tokens(F.col(url)).alias("tokens"), F.concat(F.lit("verdict="), F.col(verdict)).alias("verdict"), F.xxhash64(url).alias("page"))
    known = vocabulary(rows, support)
    # at most (tokens of a page) / support tokens reach the support, so they are few enough for one array
    wanted = known.agg(F.array_sort(F.collect_list("token"))).scalar()
    baskets = rows.select(F.concat(F.array_intersect("tokens", wanted), F.array("verdict")).alias("items"))
    if baskets.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = (
        model.associationRules.where(F.col("consequent")[0].startswith("verdict="))
        .select(F.array_sort("antecedent").alias("items"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), "confidence", "support")
        .where(~F.exists("items", lambda x: x.startswith("verdict=")))
        .orderBy(F.desc("confidence"), F.desc("support"), F.size("items"), F.concat_ws(" ", "items"))
    )
    kept: list[dict] = []
    # a rule comes after every more general one of the same confidence, whose support is no smaller
    for row in found.toLocalIterator():
        if not any(k["verdict"] == row.verdict and set(k["items"]) <= set(row["items"]) for k in kept):
            kept.append({"items": list(row["items"]), "verdict": row.verdict, "confidence": row.confidence, "support": row.support})
        if len(kept) >= max_rules:
            break
    return kept


def inverted_index(rules: list[dict]) -> Column:
    """map(token -> rules) as a constant; each rule is filed under the token that the fewest rules have."""
    used = Counter(t for r in rules for t in r["items"])
    filed: dict[str, list[dict]] = {}
    for rule in rules:
        filed.setdefault(min(rule["items"], key=lambda t: (used[t], t)), []).append(rule)
    return F.from_json(F.lit(json.dumps(filed)), _INDEX)


def mined_verdict(url: Column, rules: list[dict]) -> Column:
    """The verdict of the best mined rule that fits; NULL if none does."""
    if not rules:
        return F.lit(None).cast("string")
    index, own = inverted_index(rules), tokens(url)
    near = F.flatten(F.transform(own, lambda t: F.coalesce(index[t], F.from_json(F.lit("[]"), _INDEX[12:-1]))))
    fitting = F.filter(near, lambda r: F.size(F.array_except(r["items"], own)) == 0)
    best = F.array_sort(
        F.transform(fitting, lambda r: F.struct((-r["confidence"]).alias("c"), (-r["support"]).alias("s"), F.size(r["items"]).alias("n"), F.concat_ws(" ", r["items"]).alias("t"), r["verdict"].alias("verdict")))
    )
    return F.get(best, F.lit(0))["verdict"]


def judge(
    pages: DataFrame, rules: list[Rule], url: str = "url", support: float = 0.01, confidence: float = 0.8, max_rules: int = 2000, default: str = "allow"
) -> DataFrame:
    """``pages`` with host, path, rule and verdict put in (columns of these names are replaced).

    The pages that a fixed rule judges label the mining; the others get the mined verdict.
    """
    fixed = unused(pages, "_fixed")
    named = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    named = named.withColumn(fixed, fixed_rule(rules, F.col("host"), F.col("path")))
    labelled = named.where(F.col(fixed).isNotNull()).select(url, F.col(f"{fixed}.verdict").alias("verdict"))
    mined = mine(labelled, url, "verdict", support, confidence, max_rules)
    return named.withColumns({
        "rule": F.col(f"{fixed}.rule"),
        "verdict": F.coalesce(F.col(f"{fixed}.verdict"), mined_verdict(F.col(url), mined), F.lit(default)),
    }).drop(fixed)
