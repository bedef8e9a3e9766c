"""Evaluation tables. Everything about labels starts from one small table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.labels import to_known_class
from tablemill.functions.numeric import ratio_or_null, ratio_or_zero, text_to_double
from tablemill.operators.ordering import running_totals

METRICS = (
    "accuracy",
    "precision_macro",
    "recall_macro",
    "f1_macro",
    "precision_weighted",
    "recall_weighted",
    "f1_weighted",
)


def outcome_counts(preds: DataFrame, by: list[str]) -> DataFrame:
    """Rows per (by, y_true, y_pred): the only pass over the predictions themselves."""
    return preds.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(preds: DataFrame, by: list[str]) -> DataFrame:
    hit = F.col("y_true").eqNullSafe(F.col("y_pred")).cast("double")
    return preds.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion_counts(preds: DataFrame, k: int, by: list[str]) -> DataFrame:
    """All k x k cells per group, empty ones as 0."""
    return _all_cells(outcome_counts(preds, by), k, by)


def _all_cells(counts: DataFrame, k: int, by: list[str]) -> DataFrame:
    classes = F.sequence(F.lit(0), F.lit(k - 1))
    cells = (
        counts.select(*by)
        .distinct()
        .select(*by, F.explode(classes).alias("y_true"))
        .select(*by, "y_true", F.explode(classes).alias("y_pred"))
    )
    joined = cells.join(counts, [*by, "y_true", "y_pred"], "left")
    return joined.select(*by, "y_true", "y_pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def confusion_norm(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells as a share of their true class; a class without rows gives 0."""
    row = Window.partitionBy(*by, "y_true")
    return cells.withColumn("share", ratio_or_zero(F.col("n"), F.sum("n").over(row)))


def pivot_confusion(cells: DataFrame, classes: list[str], value: str, by: list[str]) -> DataFrame:
    """One row per true class, one column per predicted class: the form that is written out."""
    names = F.array(*[F.lit(c) for c in classes])
    picked = [
        F.max(F.when(F.col("y_pred") == i, F.col(value))).alias(c) for i, c in enumerate(classes)
    ]
    return (
        cells.groupBy(*by, "y_true")
        .agg(*picked)
        .select(*by, F.get(names, F.col("y_true")).alias("class_name"), *[f"`{c}`" for c in classes])
    )


def prf_classwise(preds: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class 0..k-1; a zero denominator gives 0."""
    return classwise_from_counts(outcome_counts(preds, by), k, by)


def classwise_from_counts(counts: DataFrame, k: int, by: list[str]) -> DataFrame:
    """As :func:`prf_classwise`. A row without a prediction is a miss of its true class."""
    same, none = F.col("y_true").eqNullSafe(F.col("y_pred")), F.lit(0).cast("long")
    sides = F.filter(
        F.array(
            F.struct(
                F.col("y_true").alias("class"),
                F.when(same, F.col("n")).otherwise(0).alias("tp"),
                none.alias("fp"),
                F.when(~same, F.col("n")).otherwise(0).alias("fn"),
            ),
            F.struct(
                F.col("y_pred").alias("class"),
                none.alias("tp"),
                F.when(~same, F.col("n")).otherwise(0).alias("fp"),
                none.alias("fn"),
            ),
        ),
        lambda side: side["class"].isNotNull(),
    )
    empty = F.lit(0).cast("long")
    blanks = (
        counts.select(*by)
        .distinct()
        .select(
            *by,
            F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("class"),
            empty.alias("tp"),
            empty.alias("fp"),
            empty.alias("fn"),
        )
    )
    tallies = (
        counts.select(*by, F.inline(sides))
        .unionByName(blanks)
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return tallies.select(
        *by,
        "class",
        "tp",
        "fp",
        "fn",
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
    )


def summary_from_classwise(classwise: DataFrame, by: list[str], total: str = "n") -> DataFrame:
    """Accuracy, macro means over classes that occur, and support-weighted means."""
    occurs = (F.col("tp") + F.col("fp") + F.col("fn")) > 0

    def macro(c: str) -> Column:
        return F.avg(F.when(occurs, F.col(c))).alias(f"{c}_macro")

    def weighted(c: str) -> Column:
        return ratio_or_zero(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"{c}_weighted")

    return classwise.groupBy(*by).agg(
        ratio_or_zero(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[macro(c) for c in ("precision", "recall", "f1")],
        *[weighted(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias(total),
    )


def oof_metrics(preds: DataFrame, k: int) -> DataFrame:
    """Metrics per model over all folds pooled."""
    return summary_from_classwise(prf_classwise(preds, k, ["model"]), ["model"], "n_samples_oof")


def fold_classwise(preds: DataFrame, k: int) -> DataFrame:
    return prf_classwise(preds, k, ["fold", "model"])


def fold_metrics(preds: DataFrame, k: int) -> DataFrame:
    return summary_from_classwise(fold_classwise(preds, k), ["fold", "model"], "n_test")


def metrics_by_level(preds: DataFrame, k: int) -> DataFrame:
    """Fold-level and pooled metrics in one table; pooled rows have a NULL fold.

    The pooled counts are added up from the fold counts, so the data is read once.
    """
    counts = outcome_counts(preds, ["fold", "model"])
    levels = counts.groupingSets(
        [["fold", "model", "y_true", "y_pred"], ["model", "y_true", "y_pred"]],
        "fold",
        "model",
        "y_true",
        "y_pred",
    ).agg(F.sum("n").alias("n"))
    keyed = levels.withColumn("fold", F.coalesce("fold", F.lit(-1)))
    table = summary_from_classwise(classwise_from_counts(keyed, k, ["fold", "model"]), ["fold", "model"])
    return table.withColumn("fold", F.nullif("fold", F.lit(-1)))


def plus_minus(mean: Column, std: Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, std)


def fold_mean_std(per_fold: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and sample deviation over folds per model, with printed form."""
    table = per_fold.groupBy("model").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
        F.count_distinct("fold").alias("n_folds"),
        F.sum("n_test").alias("n_samples_total"),
    )
    return table.select(
        "*", *[plus_minus(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(f"{m}_mean_pm_std") for m in metrics]
    )


def classwise_mean_std(per_fold: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds per (model, class), and total support."""
    stats = ("precision", "recall", "f1", "support")
    table = per_fold.groupBy("model", "class").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in stats],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in stats],
        F.sum("support").alias("support_total"),
    )
    return table.select(
        "*",
        *[
            plus_minus(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(f"{m}_mean_pm_std")
            for m in ("precision", "recall", "f1")
        ],
    )


def accuracy_summary(values: DataFrame) -> DataFrame:
    """n, mean and sample deviation per model of text or number accuracies.

    One value alone has deviation 0; cells that are no number are skipped. ``per_fold``
    keeps the fold -> accuracy map (one entry per outer fold).
    """
    usable = values.select("fold", "model", text_to_double(F.col("accuracy").cast("string")).alias("v")).filter(
        F.col("v").isNotNull()
    )
    return usable.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("v").alias("mean"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("fold", "v")))).alias("per_fold"),
    )


def one_vs_rest(preds: DataFrame, by: list[str], k: int) -> DataFrame:
    """Positive and negative rows per (by, class, distinct score)."""
    per_class = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda c: F.struct(
            c.alias("class"),
            F.get(F.col("proba"), c).alias("score"),
            (F.col("y_true") == c).cast("long").alias("pos"),
        ),
    )
    long = preds.select(*by, F.inline(per_class))
    return long.groupBy(*by, "class", "score").agg(
        F.sum("pos").alias("pos"), F.sum(F.lit(1) - F.col("pos")).alias("neg")
    )


def roc_points(preds: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(fpr, tpr) at every distinct score per class, best score first.

    A class that is absent, or is every row, has no curve.
    """
    scores = one_vs_rest(preds, by, k)
    summed = running_totals(
        scores,
        [F.desc("score")],
        {"tp": "pos", "fp": "neg"},
        [*by, "class"],
        grand={"n_pos": "pos", "n_neg": "neg"},
    )
    return summed.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(
        *by,
        "class",
        "score",
        "pos",
        "neg",
        "n_pos",
        "n_neg",
        ratio_or_null(F.col("fp"), F.col("n_neg")).alias("fpr"),
        ratio_or_null(F.col("tp"), F.col("n_pos")).alias("tpr"),
        "tp",
    )


def auc_ovr(preds: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Area under each one-vs-rest curve; NULL where the class has no curve.

    The trapezoid under the step from one score to the next is neg x (2 tp - pos) / 2 in
    counts, so the area is one sum per class and needs no look at the neighbour.
    """
    scores = one_vs_rest(preds, by, k)
    summed = running_totals(
        scores, [F.desc("score")], {"tp": "pos"}, [*by, "class"], grand={"n_pos": "pos", "n_neg": "neg"}
    )
    twice_area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")).cast("double"))
    pairs = 2.0 * F.first("n_pos").cast("double") * F.first("n_neg").cast("double")
    return summed.groupBy(*by, "class").agg(
        F.try_divide(twice_area, pairs).alias("auc"),
        F.first("n_pos").alias("support_pos"),
    )


def eval_external(
    df: DataFrame, label: str, predicted: str, classes: list[str]
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Evaluation against given labels: (facts, summary, per class).

    Rows without a label and rows with a class the model does not know are counted and left
    out; ``facts`` names up to 20 unknown classes. ``reason`` says why nothing was evaluated:
    there is no such column, no label in it, or none of a known class. Without the column
    there are facts only, in the same columns.
    """
    absent = label not in df.columns
    truth = to_known_class(F.lit(None).cast("string") if absent else F.col(f"`{label}`").cast("string"), classes)
    guess = to_known_class(F.col(predicted).cast("string"), classes)
    rows = df.select(truth.alias("truth"), guess.alias("guess"))
    known = F.coalesce(F.col("truth").isin(*classes), F.lit(False))
    # class names only: labels nobody knows may be many, and are counted as one
    counts = rows.groupBy(
        F.when(known, F.col("truth")).alias("truth"),
        F.when(F.col("guess").isin(*classes), F.col("guess")).alias("guess"),
        F.col("truth").isNotNull().alias("labelled"),
    ).agg(F.count(F.lit(1)).alias("n"))
    unknown = rows.filter(F.col("truth").isNotNull() & ~known).select("truth").distinct()
    names = [r["truth"] for r in unknown.orderBy("truth").limit(21).collect()]
    preview = "; ".join(names[:20]) + (" ..." if len(names) > 20 else "")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))

    facts = counts.agg(
        total(F.lit(True)).alias("n_rows_total"),
        total(F.col("labelled")).alias("n_rows_with_label"),
        total(~F.col("labelled")).alias("n_rows_missing_label"),
        total(F.col("labelled") & F.col("truth").isNull()).alias("n_rows_unknown_label"),
        total(F.col("truth").isNotNull()).alias("n_rows_evaluated"),
    ).select(
        "*",
        F.lit(preview).alias("unknown_labels_preview"),
        F.when(F.col("n_rows_evaluated") > 0, F.lit("ok")).otherwise(F.lit("skipped")).alias("status"),
        F.when(F.lit(absent), F.lit(f"no column {label}"))
        .when(F.col("n_rows_with_label") == 0, F.lit(f"no label in {label}"))
        .when(F.col("n_rows_evaluated") == 0, F.lit(f"no known class in {label}"))
        .alias("reason"),
    )
    if absent:
        return facts, None, None
    index = F.create_map(*[F.lit(x) for pair in zip(classes, range(len(classes))) for x in pair])
    outcomes = counts.filter("truth IS NOT NULL").select(
        F.lit("external").alias("model"),
        index[F.col("truth")].alias("y_true"),
        F.coalesce(index[F.col("guess")], F.lit(-1)).alias("y_pred"),
        "n",
    )
    classwise = classwise_from_counts(outcomes, len(classes), ["model"]).filter(F.col("class") >= 0)
    summary = summary_from_classwise(classwise, ["model"], "n_rows")
    return facts, summary, classwise


def class_order_firstseen(table: DataFrame, name: str, position: str, model: str, preferred: str) -> DataFrame:
    """Class names by first position, from the preferred model's rows when it has any."""
    firsts = table.groupBy(name).agg(
        F.min(F.when(F.col(model) == preferred, F.col(position))).alias("_p"),
        F.min(position).alias("_any"),
    )
    has = F.max(F.col("_p").isNotNull()).over(Window.partitionBy())
    kept = firsts.withColumn("_has", has).select(
        name, F.when(F.col("_has"), F.col("_p")).otherwise(F.col("_any")).alias("_first")
    )
    ordered = kept.filter(F.col("_first").isNotNull())
    return ordered.select(
        name, (F.row_number().over(Window.orderBy("_first")) - 1).alias("class_order")
    )
