"""Naive Bayes on titles: features, counts, predictions and five-fold thresholds, all as joins of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels, word endings in order, and confidence thresholds from the highest.
LABELS = ("target", "non_target")
ENDINGS = ("ization", "ational", "iveness", "fulness", "ments", "ment", "tion", "ing", "ics", "ers", "ies", "ed", "er", "or", "s")
THRESHOLDS = (0.995, 0.99, 0.98, 0.95, 0.90, 0.85)
FOLDS, EVIDENCE = 5, 5
#: Fixed value: what counts as a word of a title.
WORD = "[a-z0-9+#.]+"
VARIANTS = ("baseline", "stem", "char", "stem_char")
#: Words that say too little to stand alone as evidence.
GENERIC = (
    "associate", "manager", "analyst", "engineer", "specialist", "consultant", "operations", "business", "product", "software", "data", "systems",
    "technical", "technology", "program", "project", "development", "sales", "service", "services", "support", "customer", "client", "staff", "team",
    "part", "time", "full", "shift", "remote", "hybrid", "intern", "internship",
)


def stem(word: Column) -> Column:
    """The word without its first known ending that leaves four letters."""
    ladder = F.when(F.lit(False), word)
    for e in ENDINGS:
        ladder = ladder.when(word.endswith(e) & (F.length(word) - len(e) >= 4), F.left(word, F.length(word) - len(e)))
    return ladder.otherwise(word)


def features(title: Column, variant: str = "baseline") -> Column:
    """The features of a title, repeats included: words and pairs, with stems or parts of words by variant."""
    words = F.regexp_extract_all(F.lower(title), F.lit(WORD), F.lit(0))
    single = F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: F.concat(F.lit("w:"), w))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat(F.lit("b:"), a, F.lit("_"), b)))
    found = [single, F.filter(pairs, lambda p: p.isNotNull())]
    if variant in ("stem", "stem_char", "exclusive"):
        found.append(F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: F.concat(F.lit("s:"), stem(w))))
    if variant in ("char", "stem_char"):
        for size in (3, 4):
            marked = lambda w: F.concat(F.lit("^"), w, F.lit("$"))
            parts = lambda w, size=size: F.transform(F.sequence(F.lit(1), F.length(w) + 3 - size), lambda k: F.concat(F.lit(f"c{size}:"), F.substring(marked(w), k, F.lit(size))))
            found.append(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 3), _one(parts))))
    return F.concat(*found)


def _one(f):
    return lambda w: f(w)


def fold_of(title: Column) -> Column:
    """One of five folds by the first digits of the title's hash."""
    return F.pmod(F.conv(F.left(F.sha2(title, 256), F.lit(8)), 16, 10).cast("long"), F.lit(FOLDS)).cast("int")


def nb_counts(labels: DataFrame, variant: str = "baseline") -> DataFrame:
    """(feature, fold, target, non_target): how often each feature occurs in each fold's titles of each label."""
    rows = labels.where(F.col("classification_status").isin(*LABELS)).select(fold_of(F.col("normalized_title")).alias("fold"), F.col("classification_status").alias("label"), F.explode(features(F.col("normalized_title"), variant)).alias("feature"))
    return rows.groupBy("feature", "fold").agg(*(F.count_if(F.col("label") == x).alias(x) for x in LABELS))


def _sizes(labels: DataFrame, counts: DataFrame, held: bool) -> DataFrame:
    """(fold, docs, totals, vocabulary) of what trains: all folds (fold -1), or all but the row's."""
    docs = labels.where(F.col("classification_status").isin(*LABELS)).groupBy(fold_of(F.col("normalized_title")).alias("fold")).agg(*(F.count_if(F.col("classification_status") == x).alias(f"docs_{x}") for x in LABELS))
    totals = counts.groupBy("fold").agg(*(F.sum(x).alias(f"sum_{x}") for x in LABELS))
    each = docs.join(totals, "fold", "left").na.fill(0)
    # A feature is in the vocabulary without fold k when it occurs in another fold.
    spread = counts.groupBy("feature").agg(F.collect_set("fold").alias("folds"))
    spark = labels.sparkSession
    wanted = spark.range(FOLDS if held else 1).select((F.col("id") if held else F.lit(-1)).cast("int").alias("fold"))
    sums = F.broadcast(wanted).join(each.withColumnRenamed("fold", "other"), F.col("fold") != F.col("other")).groupBy("fold").agg(*(F.sum(c).alias(c) for c in each.columns if c != "fold"))
    keys = spread.groupBy("folds").agg(F.count("*").alias("n"))
    vocabulary = F.broadcast(wanted).join(keys, F.size(F.array_except("folds", F.array("fold"))) > 0).groupBy("fold").agg(F.sum("n").alias("vocabulary"))
    return sums.join(vocabulary, "fold", "left").na.fill(0)


def nb_predict(labels: DataFrame, titles: DataFrame, variant: str = "baseline", prior: str = "observed", held: bool = False) -> DataFrame:
    """(normalized_title, predicted, confidence) of the distinct titles, by add-one smoothed counts.

    ``held`` predicts each title by the folds that it isn't in. Without titles of both labels the answer is
    non_target with confidence 0.5. Counts of labelled titles are small beside the titles; the join on
    features is theirs.
    """
    counts = nb_counts(labels, variant)
    sizes = _sizes(labels, counts, held)
    total = counts.groupBy("feature").agg(*(F.sum(x).alias(x) for x in LABELS))
    rows = titles.select("normalized_title").distinct().withColumn("fold", fold_of(F.col("normalized_title")) if held else F.lit(-1))
    found = rows.select("normalized_title", "fold", F.explode(features(F.col("normalized_title"), variant)).alias("feature")).groupBy("normalized_title", "fold", "feature").agg(F.count("*").alias("n"))
    known = found.join(total, "feature", "left")
    if held:
        own = counts.select("feature", "fold", *(F.col(x).alias(f"own_{x}") for x in LABELS))
        known = known.join(own, ["feature", "fold"], "left")
        for x in LABELS:
            known = known.withColumn(x, F.coalesce(x, F.lit(0)) - F.coalesce(f"own_{x}", F.lit(0)))
    rows_ = known.join(F.broadcast(sizes), "fold")
    logs = lambda x: F.sum(F.col("n") * F.log((F.coalesce(x, F.lit(0)) + 1) / (F.col(f"sum_{x}") + F.greatest("vocabulary", F.lit(1)))))
    scored = rows.join(rows_.groupBy("normalized_title").agg(*(logs(x).alias(f"log_{x}") for x in LABELS)), "normalized_title", "left").join(F.broadcast(sizes), "fold", "left")
    docs = lambda x: F.coalesce(f"docs_{x}", F.lit(0))
    start = lambda x: F.lit(0.0) if prior == "balanced" else F.log((docs(x) + 1) / (docs(LABELS[0]) + docs(LABELS[1]) + 2))
    delta = start(LABELS[0]) + F.coalesce(f"log_{LABELS[0]}", F.lit(0.0)) - start(LABELS[1]) - F.coalesce(f"log_{LABELS[1]}", F.lit(0.0))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), delta))))
    able = (docs(LABELS[0]) > 0) & (docs(LABELS[1]) > 0)
    return scored.withColumn("p", F.when(able, p)).select("normalized_title", F.when(F.col("p") >= 0.5, "target").otherwise("non_target").alias("predicted"), F.coalesce(F.greatest("p", 1 - F.col("p")), F.lit(0.5)).alias("confidence"))


def _known(labels: DataFrame, titles: DataFrame, variant: str, held: bool) -> DataFrame:
    """(normalized_title, feature, target, non_target): each title's distinct features with what trains on them."""
    counts = nb_counts(labels, variant)
    total = counts.groupBy("feature").agg(*(F.sum(x).alias(x) for x in LABELS))
    rows = titles.select("normalized_title").distinct().withColumn("fold", fold_of(F.col("normalized_title")) if held else F.lit(-1))
    found = rows.select("normalized_title", "fold", F.explode(F.array_distinct(features(F.col("normalized_title"), variant))).alias("feature")).join(total, "feature", "left")
    if held:
        found = found.join(counts.select("feature", "fold", *(F.col(x).alias(f"own_{x}") for x in LABELS)), ["feature", "fold"], "left")
    else:
        found = found.withColumns({f"own_{x}": F.lit(0) for x in LABELS})
    return found.select("normalized_title", "fold", "feature", *((F.coalesce(x, F.lit(0)) - F.coalesce(f"own_{x}", F.lit(0))).alias(x) for x in LABELS))


def _top(rows: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    """The first features of each group in order, as one text; a group gathers EVIDENCE of them at most."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= EVIDENCE)
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "feature"))), lambda x: x["feature"]), ", ").alias("evidence"))


def nb_evidence(labels: DataFrame, predictions: DataFrame, variant: str = "baseline") -> DataFrame:
    """``predictions`` (normalized_title, predicted, ...) with the features that speak most for what is predicted."""
    known = _known(labels, predictions, variant, False).join(predictions.select("normalized_title", "predicted"), "normalized_title")
    of = lambda a, b: F.when(F.col("predicted") == LABELS[0], F.col(a)).otherwise(F.col(b))
    first = _top(known.withColumn("ratio", (of(*LABELS) + 1) / (of(*LABELS[::-1]) + 1)), [F.desc("ratio"), F.col("feature")], ["normalized_title"])
    return predictions.join(first, "normalized_title", "left")


def exclusive_predict(labels: DataFrame, titles: DataFrame, held: bool = False) -> DataFrame:
    """(normalized_title, predicted, confidence, evidence) by features that titles of one label alone have.

    A title with such features of one label only gets it, with 0.995 if the strongest occurs five times or
    more, else 0.99; others are non_target with 0.5. Features against need more occurrences and no generic word.
    """
    kind, value = F.split_part("feature", F.lit(":"), F.lit(1)), F.substring("feature", 3, 2**30)
    target, non_target = (F.col(x) for x in LABELS)
    specific = ~F.exists(F.split(value, "_"), lambda w: w.isin(*GENERIC)) & ((kind == "b") & (non_target >= 4) | kind.isin("w", "s") & (non_target >= 8) & (F.length(value) >= 5))
    signal = F.when((target >= 2) & (non_target == 0), LABELS[0]).when((target == 0) & specific, LABELS[1])
    rows = _known(labels, titles, "exclusive", held).select("normalized_title", "feature", signal.alias("signal"), F.greatest(*LABELS).alias("n")).where("signal IS NOT NULL")
    found = rows.groupBy("normalized_title").agg(F.count_distinct("signal").alias("kinds"), F.max("signal").alias("signal"), F.max("n").alias("n")).where("kinds = 1")
    first = _top(rows.join(found.select("normalized_title"), "normalized_title"), [F.desc("n"), F.desc(F.length("feature")), F.col("feature")], ["normalized_title"])
    every = titles.select("normalized_title").distinct().withColumn("fold", fold_of(F.col("normalized_title")) if held else F.lit(-1))
    able = _sizes(labels, nb_counts(labels, "exclusive"), held).where((F.col(f"docs_{LABELS[0]}") > 0) & (F.col(f"docs_{LABELS[1]}") > 0)).select("fold", F.lit(True).alias("able"))
    out = every.join(F.broadcast(able), "fold", "left").join(found, "normalized_title", "left").join(first, "normalized_title", "left")
    good = F.col("able").isNotNull() & F.col("signal").isNotNull()
    return out.select("normalized_title", F.when(good, F.col("signal")).otherwise(LABELS[1]).alias("predicted"), F.when(~good, 0.5).when(F.col("n") >= 5, 0.995).otherwise(0.99).alias("confidence"), F.when(good, F.col("evidence")).otherwise("").alias("evidence"))


def compare_variants(labels: DataFrame) -> DataFrame:
    """Held-out figures of each variant and prior: by label and threshold, how many are selected, with precision and recall."""
    held = [nb_predict(labels, labels, v, p, held=True).withColumns({"variant": F.lit(v), "class_prior": F.lit(p)}) for v in VARIANTS for p in ("observed", "balanced")]
    held.append(exclusive_predict(labels, labels, held=True).drop("evidence").withColumns({"variant": F.lit("exclusive"), "class_prior": F.lit("observed")}))
    every = reduce(DataFrame.unionByName, held)
    truth = labels.where(F.col("classification_status").isin(*LABELS)).select("normalized_title", F.col("classification_status").alias("actual"))
    rows = every.join(truth, "normalized_title").select("variant", "class_prior", "predicted", "actual", "confidence")
    keys = ["variant", "class_prior"]
    limits = F.array(*map(F.lit, THRESHOLDS))
    chosen = rows.select(*keys, F.col("predicted").alias("label"), (F.col("actual") == F.col("predicted")).alias("right"), F.explode(F.filter(limits, lambda t: F.col("confidence") >= t)).alias("threshold"))
    counted = chosen.groupBy(*keys, "label", "threshold").agg(F.count("*").alias("selected"), F.count_if("right").alias("hits"))
    totals = rows.groupBy(*keys, F.col("actual").alias("label")).agg(F.count("*").alias("total"))
    grid = totals.select(*keys, "label", "total", F.explode(limits).alias("threshold"))
    out = grid.join(counted, [*keys, "label", "threshold"], "left").na.fill(0, ["selected", "hits"])
    return out.select(*keys, "label", "threshold", "selected", F.round(F.try_divide(F.col("hits").cast("double"), F.col("selected")), 5).alias("precision"), F.round(F.col("hits") / F.col("total"), 5).alias("recall"))


def nb_thresholds(labels: DataFrame, predictions: DataFrame, gate: float = 0.98, minimum: int = 10) -> DataFrame:
    """By predicted label, the lowest threshold whose predictions are right often enough, with their precision and number.

    A label without one has the threshold 1.001.
    """
    truth = labels.select("normalized_title", F.col("classification_status").alias("actual"))
    rows = predictions.join(truth, "normalized_title").select("predicted", (F.col("actual") == F.col("predicted")).alias("right"), F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"), "confidence").where("confidence >= threshold")
    g = rows.groupBy("predicted", "threshold").agg(F.count("*").alias("n"), F.count_if("right").alias("hits"))
    good = g.where((F.col("n") >= minimum) & (F.col("hits") / F.col("n") >= gate))
    best = good.groupBy("predicted").agg(F.min(F.struct("threshold", "n", "hits")).alias("b"))
    both = labels.sparkSession.sql(f"SELECT explode(array{LABELS!r}) AS predicted")
    return both.join(best, "predicted", "left").select("predicted", F.coalesce("b.threshold", F.lit(1.001)).alias("threshold"), F.coalesce(F.round(F.col("b.hits") / F.col("b.n"), 5), F.lit(0.0)).alias("holdout_precision"), F.coalesce("b.n", F.lit(0)).alias("holdout_count"))


def auto_labels(labels: DataFrame, review: DataFrame, emitted: tuple[str, ...] = ("non_target",), **options) -> DataFrame:
    """The predictions for titles under review that pass their label's threshold; only the labels that may be emitted."""
    held = nb_predict(labels, labels, held=True, **options)
    limits = nb_thresholds(labels, held)
    return nb_predict(labels, review, **options).where(F.col("predicted").isin(*emitted)).join(F.broadcast(limits), "predicted").where("confidence >= threshold")
