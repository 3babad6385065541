"""The convolutional network out of fold, and what it looks at."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import networks
from ..operators.blocks import stored
from ..sources.tables import CHANNELS, EPOCH_SAMPLES, epoch_arrays
from .registry import query

#: Stored epochs that make one of the network's, and its folds.
JOINED, FOLDS = 4, 5


def long_epochs(spark, sf_dir):
    """label, part, x (64 samples of four channels times eight), y (logarithm of the first channel's power), fold: four epochs of a label in a row."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = epoch_arrays(spark, sf_dir).withColumn("_nth", nth).withColumn("part", F.floor(F.col("_nth") / JOINED))
    whole = rows.groupBy("label", "part").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("_e")).where(F.size("_e") == JOINED)
    x = F.transform(F.flatten(F.col("_e.x")), lambda v: v * 8)
    first = F.filter(x, lambda _, i: i % CHANNELS == 0)
    power = F.aggregate(first, F.lit(0.0), lambda a, v: a + v * v)
    return whole.select("label", "part", x.alias("x"), F.log(power / (JOINED * EPOCH_SAMPLES)).alias("y"), ((F.col("label") + F.col("part")) % FOLDS).alias("fold"))


def _trained(spark, sf_dir, epochs: int):
    rows = stored(long_epochs(spark, sf_dir), "epochs")
    return rows, networks.train_out_of_fold(rows, "x", "y", "fold", FOLDS, JOINED * EPOCH_SAMPLES, CHANNELS, epochs=epochs)


@query("wavenet_folds")
def wavenet_folds(spark, sf_dir, epochs: int = 60):
    """Power of the first channel by a network of width 25, sixty epochs, standardised targets: error and explained share of predictions out of fold."""
    rows, (nets, losses, scales) = _trained(spark, sf_dir, epochs)
    done = networks.predictions(rows, "x", "fold", nets, scales, JOINED * EPOCH_SAMPLES, CHANNELS)
    e = F.col("y") - F.col("predicted")
    shares = done.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), (1 - F.avg(e * e) / F.var_pop("y")).alias("r2"))
    return shares.withColumns({"first_loss": F.lit(losses[0]), "last_loss": F.lit(losses[-1])})


@query("wavenet_saliency")
def wavenet_saliency(spark, sf_dir, epochs: int = 60):
    """How much each sample and channel moves the network's output, on average over epochs that it has not seen."""
    rows, (nets, _, _) = _trained(spark, sf_dir, epochs)
    return networks.saliency(rows, "x", "fold", nets, JOINED * EPOCH_SAMPLES, CHANNELS)
