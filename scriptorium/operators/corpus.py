"""Corpus work: gates, deduplication, summaries, style models, splits and classifier metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators.ranking import ranked


def gates(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """adds failures (the codes of checks that don't hold; an unknown result counts as failed) and passed."""
    failures = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(code)) for code, ok in checks.items()]))
    return rows.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def ascii_share(text: Column) -> Column:
    """share of ASCII letters among letters; 0 without any."""
    return X.ratio(F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit(r"\p{L}")))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values; of an array's elements if it is one."""
    if dict(rows.dtypes)[column].startswith("array"):
        rows = rows.select(F.explode(column).alias(column))
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def needs_work(scores: DataFrame, dimensions: Sequence[str], id_col: str = "doc_id", most: float = 80.0, least: float = 60.0) -> DataFrame:
    """whether a text's composite score is under ``most`` and one of the dimensions under ``least``."""
    from scriptorium.operators.scoring import composite_score

    score = composite_score()
    low = F.exists(F.array(*[F.col(c) for c in dimensions]), lambda x: x < least)
    return scores.select(id_col, ((score >= 0) & (score < most) & low).alias("needs_work"))


def top_values(rows: DataFrame, kinds: dict[str, Column], k: int) -> DataFrame:
    """A2: of each kind the k most frequent values, ties by value. Rows are summed per value first, from one scan."""
    pairs = F.array(*[F.struct(F.lit(name).alias("kind"), value.alias("value")) for name, value in kinds.items()])
    counts = rows.select(F.inline(pairs)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Sequence[str]) -> DataFrame:
    """Per key the values of the first row by ``order``, and how many others there were.

    A minimum of a struct instead of a window: summed up before the shuffle, so that a hot key costs one row a task.
    """
    ranked = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    found = rows.groupBy(*keys).agg(F.min(ranked).alias("_first"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
    return found.select(*keys, *(F.col(f"_first._v{i}").alias(v) for i, v in enumerate(values)), "n_duplicates")


def describe(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, min, max, mean and population deviation of each column, as rows; one aggregation."""
    wide = rows.groupBy(*by).agg(*[F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop(c), F.lit(0.0)), 6).alias("sd")).alias(c) for c in columns])
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(c)[k].alias(k) for k in ("n", "low", "high", "mean", "sd")]) for c in columns])))


def top_tokens(tokens: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """A3: the k most frequent tokens (ties by token); per group with ``by``, by rank of pre-summed counts."""
    counts = tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), "token").limit(k)
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "token"))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def percentiles(rows: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles by linear interpolation, as p10, p25, ..."""
    return rows.groupBy(*by).agg(*[F.round(F.percentile(column, F.lit(q)), 6).alias(f"p{round(100 * q)}") for q in shares])


def map_average(rows: DataFrame, map_col: str, n_rows: DataFrame) -> DataFrame:
    """Mean of each key over all rows; a missing key counts as 0. ``n_rows`` has the one number n."""
    sums = rows.select(F.explode(map_col).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))
    return sums.crossJoin(F.broadcast(n_rows)).select("key", F.round(F.col("total") / F.col("n"), 9).alias("mean"))


def split_of(key: Column, seed: str, train: int = 70, validation: int = 15) -> Column:
    """M2: train, validation or test by hash of seed and key, the same wherever and whenever it runs."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def positional_split(rows: DataFrame, order: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """M3: by position in the order, for tables so small that a hash leaves a part empty."""
    placed = ranked(rows, [F.col(order)], "_rank", "_all")
    share = F.col("_rank") / F.col("_all")
    return placed.withColumn("split", F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")).drop("_rank", "_all")


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and Brier score (of column probability)."""
    y, p = F.col(label), F.col(prediction)
    n = rows.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.round(F.avg((F.col("probability") - y) * (F.col("probability") - y)), 9).alias("brier"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = X.ratio(tp, tp + fp), X.ratio(tp, tp + fn)
    return n.select(*by, "tp", "fp", "tn", "fn", "brier", F.round(X.ratio(tp + tn, tp + fp + tn + fn), 9).alias("accuracy"), F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(X.ratio(2 * precision * recall, precision + recall), 9).alias("f1"))


def auroc(rows: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Area under the ROC curve with tied scores taken together; 0.5 if one label is missing.

    Rows are summed per distinct score first; the running sum over scores is taken from range partitions and their
    sums, so that no task sees all of them.
    """
    scores = rows.groupBy(F.col(probability).alias("p")).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    placed = ranked(scores, [F.desc("p")], "_rank", total="pos", running="above")
    area = placed.agg(F.sum(F.col("neg") * (F.col("above") + F.col("pos") / 2)).alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return area.select(F.round(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos") * F.col("neg"))).otherwise(F.lit(0.5)), 9).alias("auroc"))


def calibration(rows: DataFrame, bins: int = 10, label: str = "label", probability: str = "probability", prediction: str = "prediction") -> DataFrame:
    """Expected calibration error; the last bin is closed."""
    own = rows.groupBy(F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("p"), F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("right"))
    return own.agg(F.round(F.coalesce(F.sum(F.col("n") * F.abs(F.col("p") - F.col("right"))) / F.sum("n"), F.lit(0.0)), 9).alias("ece"))


def taken_records(records: DataFrame, seen: DataFrame, checks: dict[str, Column], key: str, order: Sequence[Column], most: int) -> DataFrame:
    """Of records not seen before, each key once, those that pass all checks, the first ``most`` in the order: a downloader's own limit."""
    new = records.join(seen.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return gates(new, checks).filter("passed").drop("failures", "passed").orderBy(*order).limit(most)


def looked_up(rows: DataFrame, works: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with what a table of works knows of their key; of several works the least counts, unknown ones stay with nulls."""
    known = works.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_w"))
    return rows.join(known, key, "left").select(*rows.columns, *(F.col(f"_w.{c}").alias(c) for c in columns), F.col("_w").isNotNull().alias("found"))


def quality_gate(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """M8: whether each metric reaches its minimum, and all do."""
    return metrics.select(*(F.col(k) for k in least), *((F.col(k) >= v).alias(f"{k}_ok") for k, v in least.items()), F.forall(F.array(*[F.col(k) >= v for k, v in least.items()]), lambda x: x).alias("passed"))


def validate_pairs(rows: DataFrame, labels: Sequence[str], pair: str = "pair_id", label: str = "label", digest: str = "text_hash") -> DataFrame:
    """Rows with unknown labels, incomplete pairs, pairs with a repeated label, texts found in several pairs, class balance."""
    pairs = rows.groupBy(pair).agg(F.count_distinct(label).alias("kinds"), F.count(F.lit(1)).alias("n"))
    one = pairs.agg(F.count_if(F.col("kinds") < len(labels)).alias("incomplete_pairs"), F.count_if(F.col("n") > F.col("kinds")).alias("duplicate_labels"))
    leaks = rows.groupBy(digest).agg(F.count_distinct(pair).alias("pairs"), F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("pairs") > 1).alias("leaked_texts"))
    own = rows.agg(F.count_if(~F.col(label).isin(*labels)).alias("unknown_labels"), F.round(F.count_if(F.col(label) == labels[0]) / F.count(F.lit(1)), 6).alias("balance"))
    return one.crossJoin(leaks).crossJoin(own)  # one row each


def domain_scores(docs: DataFrame, keywords: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Best and second domain by share of its keywords that occur; ties by name.

    ``keywords`` (domain, keyword) is a rule table; it becomes a literal, so that documents aren't multiplied.
    """
    table: dict[str, list[str]] = {}
    for r in keywords.select("domain", "keyword").collect():  # a rule table of some hundred rows
        table.setdefault(r["domain"], []).append(r["keyword"])
    low = F.lower(F.col(text_col))
    scored = F.array(*[F.struct((-F.size(F.filter(F.array(*map(F.lit, sorted(set(words)))), lambda w: F.contains(low, w))) / len(set(words))).alias("rank"), F.lit(name).alias("domain")) for name, words in sorted(table.items())])
    best = docs.select(id_col, F.array_sort(scored).alias("best"))
    return best.select(id_col, F.col("best")[0]["domain"].alias("domain"), F.round(-F.col("best")[0]["rank"], 6).alias("confidence"), F.get("best", F.lit(1))["domain"].alias("second"), F.round(-F.get("best", F.lit(1))["rank"], 6).alias("second_confidence"))


#: F1, O2: severities from the gravest on.
SEVERITIES = ("must_fix", "should_fix", "cosmetic")


def hits_of(low: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """of the rules (pattern, category, severity) that occur in a lower-case text: pattern, category, severity, n."""
    if not rules:
        return F.array().cast("array<struct<pattern:string,category:string,severity:string,n:bigint>>")
    entries = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("category"), F.lit(s).alias("severity")) for p, c, s in rules])
    n = lambda p: F.floor((F.char_length(low) - F.char_length(F.replace(low, p, F.lit("")))) / F.char_length(p)).cast("bigint")
    return F.transform(F.filter(entries, lambda e: F.contains(low, e["pattern"])), lambda e: F.struct(e["pattern"].alias("pattern"), e["category"].alias("category"), e["severity"].alias("severity"), n(e["pattern"]).alias("n")))


def lexicon_hits(docs: DataFrame, lexicon: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: str | None = None) -> DataFrame:
    """A row per document and phrase that occurs, with its count, category and severity, and its place in the
    document's order by severity, then count. ``least`` leaves out what is less grave.

    ``lexicon`` (pattern, category, severity) is a rule table; it becomes one literal.
    """
    known = SEVERITIES[: SEVERITIES.index(least) + 1] if least else None
    rules = [(r["pattern"], r["category"], r["severity"]) for r in lexicon.collect() if known is None or r["severity"] in known]  # some hundred rows
    grave = F.create_map(*[F.lit(x) for kv in ((s, i) for i, s in enumerate(SEVERITIES)) for x in kv])
    rows = docs.select(id_col, F.lower(F.col(text_col)).alias("_low")).select(id_col, hits_of(F.col("_low"), rules).alias("_h"))
    keyed = F.transform("_h", lambda h: F.struct(F.coalesce(F.element_at(grave, h["severity"]), F.lit(len(SEVERITIES))).alias("g"), (-h["n"]).alias("m"), h["pattern"].alias("p"), h.alias("h")))
    return rows.select(id_col, F.posexplode(F.array_sort(keyed)).alias("place", "_x")).select(id_col, "_x.h.*", F.col("place"))
