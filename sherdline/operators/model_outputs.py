"""What happens around a model: which rows need it, running it, and turning its output into fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polyline as pl
from ..functions.rules import piece_type
from .ordering import join_on

SIDE_EDGES = ("top_edge", "bottom_edge", "left_edge", "right_edge")

# ---- running predictors -----------------------------------------------------------------------------


class Predictor:
    """Base of the pluggable scorers: set up once per task, predict per batch, clean up at the end."""

    name = "predictor"
    version = "1.0"

    def setup(self) -> None:
        """Load the model."""

    def predict(self, row: Mapping[str, object]) -> str:
        """The prediction for one input row as text (JSON where it has parts)."""
        raise NotImplementedError

    def predict_batch(self, batch: pd.DataFrame) -> pd.Series:
        """The predictions for a batch; models that score many rows at once override this."""
        return pd.Series([self.predict(row) for row in batch.to_dict("records")], index=batch.index, dtype=object)

    def cleanup(self) -> None:
        """Free the model."""


PREDICTORS: dict[str, type[Predictor]] = {}


def register(kind: type[Predictor]) -> type[Predictor]:
    """Adds a predictor under its class name without ``Predictor``, lower case; the last one wins."""
    PREDICTORS[kind.__name__.removesuffix("Predictor").lower()] = kind
    return kind


def predictor(name: str) -> type[Predictor]:
    if name not in PREDICTORS:
        raise KeyError(f"unknown predictor {name!r}, known: {sorted(PREDICTORS)}")
    return PREDICTORS[name]


def score_batches(df: DataFrame, key: str, make: Callable[[], Predictor], continue_on_error: bool = True) -> DataFrame:
    """Runs one predictor per task over Arrow batches; an error becomes a column, or fails the job.

    Rows are scored one at a time only in a batch that raises, to find the ones at fault.
    """

    def one_by_one(model: Predictor, batch: pd.DataFrame) -> tuple[list, list]:
        done, errors = [], []
        for row in batch.to_dict("records"):
            try:
                done.append(model.predict(row))
                errors.append(None)
            except Exception as error:
                done.append(None)
                errors.append(str(error))
        return done, errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        model.setup()
        try:
            for batch in batches:
                try:
                    done, errors = list(model.predict_batch(batch)), [None] * len(batch)
                except Exception:
                    if not continue_on_error:
                        raise
                    done, errors = one_by_one(model, batch)
                yield pd.DataFrame({key: batch[key].to_numpy(), "prediction": pd.Series(done, dtype=object), "error": pd.Series(errors, dtype=object)})
        finally:
            model.cleanup()

    key_type = df.schema[key].dataType.simpleString()
    return df.mapInPandas(run, f"{key} {key_type}, prediction string, error string")


def needs_processing(kind: str, version: str, skip_processed: bool = True, force: bool = False) -> Column:
    """Rows a scorer of this kind must see.

    ``force`` turns the skip off, but not for segmentation and line count, whose skip setting it
    does not reach; the circle and edge scorers look at no setting at all.
    """
    differs = lambda c: ~F.col(c).eqNullSafe(F.lit(version))
    tests = {
        "line": lambda: differs("line_detection_model_version"),
        "script": lambda: F.col("script_type").isNull() | differs("script_type_classification_model_version"),
        "segmentation": lambda: F.col("segmentation_coords").isNull() | differs("segmentation_model_version"),
        "count": lambda: F.col("line_count").isNull() | differs("classification_model_version"),
        "scale": lambda: F.col("scale_unit").isNull() | differs("scale_model_version"),
        "circle": lambda: F.col("has_circle").isNull(),
        "edges": lambda: F.lit(True),
    }
    if kind not in tests:
        raise KeyError(f"unknown scorer kind {kind!r}, known: {sorted(tests)}")
    off = not skip_processed or (force and kind not in ("segmentation", "count"))
    if off and kind not in ("circle", "edges"):
        return F.lit(True)
    return tests[kind]()


def merge_updates(results: DataFrame) -> DataFrame:
    """Per fragment and field the value of the last scorer that wrote it, failed scorers included.

    ``results`` has ``id, processor_no, success, field, value``; NULL is a value like any other.
    """
    return (
        results.filter(F.col("field").isNotNull())
        .groupBy("id", "field")
        .agg(F.max_by(F.struct("value"), F.col("processor_no")).alias("last"))
        .select("id", "field", F.col("last.value").alias("value"))
    )


def run_outcome(results: DataFrame) -> DataFrame:
    """A fragment counts as processed when any of its scorers succeeded."""
    return results.groupBy("id").agg(F.bool_or("success").alias("ok"))


# ---- detections ----------------------------------------------------------------------------------------


def lines_from_detections(detections: DataFrame, min_confidence: float = 0.25) -> DataFrame:
    """Detections above the threshold, numbered from the top of their image (an image has few)."""
    kept = detections.filter(F.col("confidence") >= min_confidence)
    image = Window.partitionBy("image_id")
    return kept.withColumn("line_id", F.row_number().over(image.orderBy("y1", "det_no", "det_id"))).withColumn(
        "num_lines", F.count(F.lit(1)).over(image)
    )


def lines_record(images: DataFrame, detections: DataFrame, version: str, min_confidence: float = 0.25) -> DataFrame:
    """One record for every image: its lines from the top with number, box and confidence, their count and
    mean confidence; an image without detections has an empty list, count 0 and confidence 0."""
    box = F.struct("x1", "y1", "x2", "y2").alias("bbox")
    kept = detections.filter(F.col("confidence") >= min_confidence)
    line = F.when(F.col("confidence").isNotNull(), F.struct("y1", "det_no", "det_id", box, "confidence"))
    found = images.select("image_id").join(kept, "image_id", "left").groupBy("image_id").agg(
        F.sort_array(F.collect_list(line)).alias("lines"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence")
    )
    number = lambda x, i: F.struct((i + 1).alias("line_id"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence"))
    return found.select(
        "image_id", F.size("lines").alias("num_lines"), F.transform("lines", number).alias("lines"), "mean_confidence", F.lit(version).alias("model_version")
    )


def circle_flag(images: DataFrame, detections: DataFrame, threshold: float) -> DataFrame:
    """Whether an image shows a circle: any detection of class 0 at the threshold."""
    seen = detections.groupBy("image_id").agg(
        F.max((F.col("class_no") == 0) & (F.col("confidence") >= threshold)).alias("hit")
    )
    return images.select("image_id").join(seen, "image_id", "left").select(
        "image_id", F.coalesce("hit", F.lit(False)).alias("has_circle")
    )


def primary_detection(detections: DataFrame) -> DataFrame:
    box = F.struct("x1", "y1", "x2", "y2", "confidence", "class_no")
    return detections.groupBy("image_id").agg(F.min_by(box, F.struct("det_no", "det_id")).alias("box")).select("image_id", "box.*")


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: int = 10) -> Column:
    """Whole-pixel box with padding, held inside the image."""
    whole = lambda c: c.cast("int")  # noqa: E731 - truncates towards zero
    return F.struct(
        F.greatest(F.lit(0), whole(x1) - pad).alias("x1"), F.greatest(F.lit(0), whole(y1) - pad).alias("y1"),
        F.least(width.cast("int"), whole(x2) + pad).alias("x2"), F.least(height.cast("int"), whole(y2) + pad).alias("y2"),
    )


def crop_geometry(
    xs: Column, ys: Column, width: Column, height: Column, pixels_per_unit: Column,
    target: float = 100.0, pad: int = 4, longest: int = 1024, rescale_from_factor: bool = False,
) -> Column:
    """Padded bounds of a contour and the size of the crop at the target ratio.

    ``rescale_from_factor`` tells the two capped forms apart: shrinking the rounded size, or
    shrinking the factor and rounding again.
    """
    # each step is bound once: written out, the bounds would be sought again for every use, dozens of times
    whole = lambda c: c.cast("int")
    bounds = F.struct(
        whole(F.array_min(xs)).alias("x0"), whole(F.array_max(xs)).alias("x1"), whole(F.array_min(ys)).alias("y0"), whole(F.array_max(ys)).alias("y1"),
        whole(width).alias("width"), whole(height).alias("height"), pixels_per_unit.alias("ratio"),
    )
    at_least_3 = lambda v: F.greatest(F.lit(3.0), F.bround(v))

    def padded(b: Column) -> Column:
        return F.struct(
            F.greatest(F.lit(0), b["x0"] - pad).alias("x0"), F.greatest(F.lit(0), b["y0"] - pad).alias("y0"),
            F.least(b["width"] - 1, b["x1"] + pad).alias("x1"), F.least(b["height"] - 1, b["y1"] + pad).alias("y1"),
            (b["ratio"] > 0).alias("known"), F.greatest(F.lit(0.05), F.lit(target) / b["ratio"]).alias("factor"),
        )

    def sized(c: Column) -> Column:
        w, h = ((c[f"{axis}1"] - c[f"{axis}0"] + 1).cast("double") for axis in "xy")
        out = F.struct(c.alias("c"), w.alias("w"), h.alias("h"), at_least_3(w * c["factor"]).alias("out_w"), at_least_3(h * c["factor"]).alias("out_h"))
        return pl.let(out, capped)

    def capped(s: Column) -> Column:
        larger = F.greatest(s["out_w"], s["out_h"])
        return pl.let(F.struct(s.alias("s"), F.when(larger > longest, F.lit(float(longest)) / larger).alias("cap")), finished)

    def finished(t: Column) -> Column:
        s, cap = t["s"], t["cap"]
        c, w, h, out_w, out_h = (s[n] for n in ("c", "w", "h", "out_w", "out_h"))
        known, factor = c["known"], c["factor"]
        if rescale_from_factor:
            small_w, small_h, small = at_least_3(w * factor * cap), at_least_3(h * factor * cap), factor * cap
        else:
            small_w, small_h, small = at_least_3(out_w * cap), at_least_3(out_h * cap), factor
        return F.struct(
            *[c[n].alias(n) for n in ("x0", "y0", "x1", "y1")],
            F.when(known, F.when(cap.isNull(), factor).otherwise(small)).otherwise(F.lit(1.0)).alias("factor"),
            F.when(known, F.when(cap.isNull(), out_w).otherwise(small_w)).otherwise(w).cast("long").alias("out_width"),
            F.when(known, F.when(cap.isNull(), out_h).otherwise(small_h)).otherwise(h).cast("long").alias("out_height"),
        )

    return pl.let(pl.let(bounds, padded), sized)


# ---- class scores ----------------------------------------------------------------------------------------


def softmax(logits: Column) -> Column:
    raised = pl.let(F.array_max(logits), lambda most: F.transform(logits, lambda v: F.exp(v - most)))
    return pl.let(raised, lambda e: pl.let(pl.total(e), lambda whole: F.transform(e, lambda v: v / whole)))


def classify(df: DataFrame, names: Sequence[str], threshold: float, logits: str = "logits") -> DataFrame:
    """Adds ``class_index`` (the first maximum, which is also the line count of a count network),
    ``class_name, confidence, probabilities`` and the status the confidence calls for."""
    scored = pl.hold(df, {"__p": softmax(F.col(logits))})
    index = F.array_position("__p", F.array_max("__p")) - 1
    listed = F.array(*[F.lit(n) for n in names])
    confidence = F.array_max("__p")
    return scored.withColumns(
        {
            "class_index": index,
            "class_name": F.get(listed, index.cast("int")),
            "confidence": confidence,
            "probabilities": F.map_from_arrays(listed, F.col("__p")),
            "status": F.when(confidence < threshold, "completed_low_confidence").otherwise("completed"),
        }
    ).drop("__p")


def borders_from_probs(probabilities: Column, thresholds: Sequence[float], piece: Column | None = None) -> Column:
    """Sides whose probability reaches its threshold are borders, the others tears."""
    pairs = F.arrays_zip(
        F.array(*[F.lit(s) for s in SIDE_EDGES]).alias("side"), probabilities.alias("p"),
        F.array(*[F.lit(float(t)) for t in thresholds]).alias("t"),
    )
    side = lambda test: F.transform(F.filter(pairs, test), lambda s: s["side"])
    flag = lambda i: F.get(probabilities, F.lit(i)) >= float(thresholds[i])
    fields = [
        side(lambda s: s["p"] >= s["t"]).alias("borders"), side(lambda s: s["p"] < s["t"]).alias("tears"),
        piece_type(*[flag(i) for i in range(4)]).alias("piece_type"),
    ]
    if piece is not None:
        kinds = F.array(F.lit("interior"), F.lit("edge"), F.lit("corner"))
        fields.append(F.get(kinds, (F.array_position(piece, F.array_max(piece)) - 1).cast("int")).alias("piece_guess"))
    return F.struct(*fields)


# ---- training ------------------------------------------------------------------------------------------------


def train_classifier(df: DataFrame, features: str, label: str, classes: Sequence[int], max_iter: int = 50):
    """Class-weighted multinomial logistic regression on vectors.

    ``features`` is an array column.  Returns the fitted pipeline; ``predict_classes`` applies it.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from .metrics import class_weights

    weights = class_weights(df, label, list(classes)).select(F.col("label").alias(label), "weight")
    prepared = join_on(df, weights, [label]).withColumn("__vector", array_to_vector(F.col(features)))
    model = LogisticRegression(
        featuresCol="__vector", labelCol=label, weightCol="weight", maxIter=max_iter, regParam=0.01, family="multinomial"
    )
    return Pipeline(stages=[model]).fit(prepared)


def predict_classes(model, df: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(df.withColumn("__vector", array_to_vector(F.col(features))))
    return scored.withColumn("probabilities", vector_to_array("probability")).drop("__vector", "rawPrediction", "probability")


def train_side_classifiers(df: DataFrame, features: str, targets: Sequence[str], max_iter: int = 50) -> dict:
    """One weighted binary model per side, weight negatives over positives on the positive rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    prepared = df.withColumn("__vector", array_to_vector(F.col(features)))
    models = {}
    for target in targets:
        yes = F.count_if(F.col(target))
        balance = prepared.agg(F.when(yes > 0, (F.count(F.lit(1)) - yes) / yes).otherwise(F.lit(1.0)))
        weighted = prepared.withColumn(
            "__weight", F.when(F.col(target), balance.scalar()).otherwise(F.lit(1.0))
        ).withColumn("__label", F.col(target).cast("double"))
        models[target] = LogisticRegression(
            featuresCol="__vector", labelCol="__label", weightCol="__weight", maxIter=max_iter, regParam=0.01
        ).fit(weighted.select("__vector", "__label", "__weight"))
    return models


def predict_sides(models: Mapping[str, object], df: DataFrame, features: str, prefix: str = "p_") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = df.withColumn("__vector", array_to_vector(F.col(features)))
    for target, model in models.items():
        name = prefix + target.removeprefix("t_")
        scored = (
            model.transform(scored)
            .withColumn(name, F.get(vector_to_array("probability"), F.lit(1)))
            .drop("rawPrediction", "probability", "prediction")
        )
    return scored.drop("__vector")
