"""Evaluation runs: pass rates, what changed between two runs, cost and latency, configuration differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage
from tidemark.operators.ordering import exact_quantiles, join_by_group, running_totals

# Fixed values.
ERRORS = ("model_error", "guardrail_error")
WATCHED_TAGS = ("safety", "false-block-trap", "false-sensitive-trap", "paraphrase")
KEY = ["suite", "case_id"]


def is_error(actual: Column) -> Column:
    return actual.isin(*ERRORS)


def pass_rates(cases: DataFrame, tags: Sequence[str] | None = WATCHED_TAGS) -> DataFrame:
    """Passed, scored and errors per suite and per tag of a suite; errors are not part of the denominator."""
    labels = F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))
    if tags is not None:
        labels = F.filter(labels, lambda t: t.isin(*tags))
    groups = F.concat(F.array(F.lit(None).cast("string")), labels)
    each = cases.select("suite", "passed", "actual", F.explode(groups).alias("tag"))
    out = each.groupBy("suite", "tag").agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.coalesce(is_error(F.col("actual")), F.lit(False))).alias("scored"),
        F.count_if(is_error(F.col("actual"))).alias("errors"))
    return out.withColumn("pass_rate", F.try_divide("passed", "scored"))


def breakdown(cases: DataFrame) -> DataFrame:
    """Passed of all cases per expected label (only where a suite has several) and per tag, with the missed ids.
    A miss is listed as a row of its own, so a long list never meets in one cell."""
    several = cases.groupBy("suite").agg((F.min("expected") != F.max("expected")).alias("_several"))
    marked = cases.join(several, "suite")
    label = F.when(F.col("_several"), F.array(F.concat(F.lit("expected="), "expected"))).otherwise(F.array().cast("array<string>"))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag="), t))
    each = marked.select("suite", "passed", F.explode(F.concat(label, tags)).alias("label"))
    return each.groupBy("suite", "label").agg(F.count_if("passed").alias("passed"), F.count("*").alias("cases"))


def misses(cases: DataFrame) -> DataFrame:
    return cases.where(~F.col("passed")).select(*KEY, "expected", "actual")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """What changed for each case: one row per changed case, and one per suite that only one run has."""
    suites = a.groupBy("suite").agg(F.count("*").alias("in_a")).join(b.groupBy("suite").agg(F.count("*").alias("in_b")), "suite", "full")
    whole = suites.where("in_a IS NULL OR in_b IS NULL").select(
        F.when(F.col("in_b").isNull(), "only in A").otherwise("only in B").alias("change"), "suite", F.lit(None).cast("string").alias("case_id"),
        F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("was"), F.lit(None).cast("string").alias("now"),
        F.coalesce("in_a", "in_b").alias("cases"))
    shared = suites.where("in_a IS NOT NULL AND in_b IS NOT NULL").select("suite")
    side = lambda df, mark: df.join(shared, "suite", "left_semi").select(
        *KEY, F.struct("passed", "expected", "actual", F.to_json("detail.policies").alias("policies")).alias(mark))
    joined = side(a, "_a").join(side(b, "_b"), KEY, "full_outer")
    was, now = F.col("_a.actual"), F.col("_b.actual")
    differs = ~was.eqNullSafe(now)
    change = (
        F.when(F.col("_b").isNull(), "only in A").when(F.col("_a").isNull(), "only in B")
        .when(is_error(was) | is_error(now), F.when(differs, "errors appeared or cleared"))
        .when(F.col("_a.passed") & ~F.col("_b.passed"), "regression").when(~F.col("_a.passed") & F.col("_b.passed"), "fix")
        .when(differs, F.when(F.col("_b.passed"), "still passing, different answer").otherwise("still failing, different answer"))
        .when(~F.col("_a.policies").eqNullSafe(F.col("_b.policies")), "same verdict, different policy"))
    cases = joined.select(change.alias("change"), *KEY, F.coalesce("_b.expected", "_a.expected").alias("expected"), was.alias("was"), now.alias("now"),
                          F.lit(1).cast("bigint").alias("cases")).where("change IS NOT NULL")
    return cases.unionByName(whole)


def has_regressions(changes: DataFrame) -> bool:
    return not changes.where("change = 'regression'").isEmpty()


def nearest_rank(df: DataFrame, value: str, share: float, keys: Sequence[str], name: str) -> DataFrame:
    """The ceil(share x n)-th smallest value per key, found on counted values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    place = F.greatest(F.lit(1), F.ceil(F.lit(share).cast("decimal(8,6)") * F.col("_size")))
    upto = join_by_group(running_totals(counted, keys, [F.col(value).asc()], {"_upto": F.col("_n")}), sizes, keys)
    return upto.where(F.col("_upto") >= place).groupBy(*keys).agg(F.min(value).alias(name))


def cost_and_latency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per suite and run, over the cases both runs measured: mean requests and tokens, total cost (null when a case
    has no price), median and nearest-rank p95 latency, fallbacks and retries."""
    measured = lambda df: df.where(F.col("detail.metrics").isNotNull() & ~is_error(F.col("actual"))).select(*KEY, "detail.metrics.*")
    left, right = measured(a), measured(b)
    rows = left.join(right.select(*KEY), KEY, "left_semi").withColumn("run", F.lit("A")).unionByName(
        right.join(left.select(*KEY), KEY, "left_semi").withColumn("run", F.lit("B")))
    keys = ["suite", "run"]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.avg("requests").alias("requests"), F.avg("input_tokens").alias("input_tokens"),
        F.avg("output_tokens").alias("output_tokens"), F.when(F.count_if(F.col("cost_usd").isNull()) == 0, F.sum("cost_usd")).alias("cost_usd"),
        F.count_if(F.coalesce("fallback_used", F.lit(False))).alias("fallbacks"), F.sum(F.coalesce("retries", F.lit(0))).alias("retries"))
    return (sums.join(exact_quantiles(rows, "latency_ms", {"latency_p50": 0.5}, keys), keys)
            .join(nearest_rank(rows, "latency_ms", 0.95, keys, "latency_p95"), keys))


def side_by_side(metrics: DataFrame, names: Sequence[str] = ("requests", "input_tokens", "output_tokens", "cost_usd", "latency_p50",
                                                             "latency_p95", "fallbacks", "retries")) -> DataFrame:
    """The two runs of cost_and_latency as old, new and relative change."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    long = metrics.select("suite", "run", F.inline(pairs))
    side = lambda r: F.max(F.when(F.col("run") == r, F.col("value")))
    out = long.groupBy("suite", "metric").agg(side("A").alias("old"), side("B").alias("new"))
    return out.withColumn("change", F.when(F.col("old") != 0, (F.col("new") - F.col("old")) / F.col("old")))


def leaves(df: DataFrame, config: str) -> DataFrame:
    """`path` (dotted) and `value` (text) of every leaf of JSON objects nested to any depth: what is no object, an empty object too. One pass per
    level, over the entries that are objects still."""
    frontier, found = df.select(F.lit(None).cast("string").alias("path"), F.parse_json(config).alias("_object")), None
    while found is None or not frontier.isEmpty():
        entries = frontier.select("path", F.explode(F.col("_object").cast("map<string,variant>")).alias("_key", "_value"))
        named = entries.select(F.concat_ws(".", "path", "_key").alias("path"), "_value", F.schema_of_variant("_value").alias("_kind"))
        level = cut_lineage(named.withColumn("_nested", F.coalesce(F.col("_kind").startswith("OBJECT<") & (F.col("_kind") != "OBJECT<>"), F.lit(False))))
        flat = level.where("NOT _nested").select("path", F.col("_value").cast("string").alias("value"))
        found = flat if found is None else found.unionByName(flat)
        frontier = level.where("_nested").select("path", F.col("_value").alias("_object"))
    return found


def config_changes(a: DataFrame, b: DataFrame, config: str = "config") -> DataFrame:
    """Configuration paths that differ between two headers: added, removed, changed, with list items gained and
    lost. A section only one run has is one row."""
    sections = lambda df: df.select(F.explode(F.map_keys(F.from_json(config, "map<string,string>"))).alias("section"))
    in_a, in_b = sections(a).withColumn("_a", F.lit(True)), sections(b).withColumn("_b", F.lit(True))
    both = in_a.join(in_b, "section", "full_outer")
    lonely = both.where("_a IS NULL OR _b IS NULL").select(
        F.col("section").alias("path"), F.when(F.col("_b").isNull(), "only in A").otherwise("only in B").alias("change"))
    paths = lambda df, name: leaves(df, config).withColumnRenamed("value", name)
    shared = both.where("_a AND _b").select("section")
    within = lambda df, name: paths(df, name).withColumn("section", F.substring_index("path", ".", 1)).join(shared, "section", "left_semi").drop("section").withColumn(f"_has_{name}", F.lit(True))
    joined = within(a, "old").join(within(b, "new"), "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")) | F.col("_has_old").isNull() | F.col("_has_new").isNull())
    items = lambda c: F.from_json(c, "array<string>")
    is_list = F.col("old").startswith("[") & F.col("new").startswith("[")
    kind = F.when(F.col("_has_old").isNull(), "added").when(F.col("_has_new").isNull(), "removed").when(is_list, "list changed").otherwise("changed")
    text = lambda c: F.array_join(F.array_sort(c), ", ")
    changed = joined.select(
        "path", kind.alias("change"), "old", "new", F.when(is_list, text(F.array_except(items("new"), items("old")))).alias("items_added"),
        F.when(is_list, text(F.array_except(items("old"), items("new")))).alias("items_removed"))
    return changed.unionByName(lonely, allowMissingColumns=True)


def token_costs(calls: DataFrame, prices: Sequence[tuple]) -> DataFrame:
    """Cost per case from its calls; null when a call that used tokens has no price. `prices` lists model family (part
    of the model id) and USD per million input and output tokens; the first family that an id holds is the one billed."""
    def price(k: int) -> Column:
        chosen = F.lit(None).cast("double")
        for row in reversed(prices):
            chosen = F.when(F.contains(F.col("model_id"), F.lit(row[0])), F.lit(float(row[k]))).otherwise(chosen)
        return chosen

    used = calls.where((F.col("input_tokens") > 0) | (F.col("output_tokens") > 0)).withColumns({"_in": price(1), "_out": price(2)})
    cost = (F.col("input_tokens") * F.col("_in") + F.col("output_tokens") * F.col("_out")) / 1_000_000
    sums = used.groupBy("case_id").agg(F.when(F.count_if(F.col("_in").isNull()) == 0, F.round(F.sum(cost), 6)).alias("cost_usd"), F.lit(True).alias("_used"))
    every = calls.select("case_id").distinct().join(sums, "case_id", "left")
    return every.select("case_id", F.when(F.col("_used").isNull(), F.lit(0.0)).otherwise(F.col("cost_usd")).alias("cost_usd"))


ASSESSMENTS = (
    "array<struct<topicPolicy: struct<topics: array<struct<name: string, action: string>>>, "
    "contentPolicy: struct<filters: array<struct<type: string, action: string>>>, "
    "sensitiveInformationPolicy: struct<piiEntities: array<struct<type: string, action: string>>, "
    "regexes: array<struct<name: string, action: string>>>, wordPolicy: struct<customWords: array<struct<action: string>>>>>"
)


def blocked_labels(assessments: Column) -> Column:
    """What blocked a text, as sorted distinct kind:name labels."""
    def labels(a: Column) -> Column:
        empty = F.array().cast("array<string>")
        named = lambda entries, kind, name: F.coalesce(F.transform(F.filter(entries, lambda e: e["action"] == "BLOCKED"), lambda e: F.concat(F.lit(kind + ":"), e[name])), empty)
        words = F.coalesce(F.transform(F.filter(a["wordPolicy"]["customWords"], lambda e: e["action"] == "BLOCKED"), lambda e: F.lit("word:custom")), empty)
        return F.concat(named(a["topicPolicy"]["topics"], "topic", "name"), named(a["contentPolicy"]["filters"], "content", "type"),
                        named(a["sensitiveInformationPolicy"]["piiEntities"], "pii", "type"),
                        named(a["sensitiveInformationPolicy"]["regexes"], "regex", "name"), words)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(assessments, labels))))
