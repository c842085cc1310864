"""Measured things: arms and motions, trajectories, layouts over widths, curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: standard gravity in m/s2.
GRAVITY = 9.80665
#: Control points of the keyword easings.
EASINGS = {"linear": (0.0, 0.0, 1.0, 1.0), "ease": (0.25, 0.1, 0.25, 1.0), "ease-in": (0.42, 0.0, 1.0, 1.0), "ease-out": (0.0, 0.0, 0.58, 1.0), "ease-in-out": (0.42, 0.0, 0.58, 1.0)}
EASING_TOLERANCE = 0.01


def arm_torques(links: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, joint, reach, torque): worst-case static torque about each joint of planar arms stretched out level.

    links: arm, joint (order from the base), length, mass; arms: arm, payload. A link's weight acts at its middle,
    the payload at the tip. With running sums s of lengths and m of masses from the tip inwards no pairs of
    links are needed: the torque about a joint is the torque about the next one plus its own length times
    all that hangs beyond its middle.
    """
    w = W.partitionBy("arm").orderBy(F.desc("joint"))
    beyond = F.coalesce(F.sum("mass").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    own = links.join(arms.select("arm", "payload"), "arm").withColumn("_part", F.col("length") * GRAVITY * (F.col("mass") / 2 + beyond + F.coalesce("payload", F.lit(0.0))))
    up = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return own.select("arm", "joint", F.sum("length").over(up).alias("reach"), F.sum("_part").over(up).alias("torque"))


def bezier_progress(control: tuple[float, float, float, float], x: np.ndarray) -> np.ndarray:
    """Progress of a cubic Bezier easing at times x, by halving the curve's parameter."""
    x1, y1, x2, y2 = control
    at = lambda a, b, t: 3 * (1 - t) ** 2 * t * a + 3 * (1 - t) * t**2 * b + t**3
    lo, hi = np.zeros_like(x), np.ones_like(x)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = at(x1, x2, mid) < x
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return at(y1, y2, (lo + hi) / 2)


def infer_easing(samples: DataFrame) -> DataFrame:
    """(motion, easing, rms, accepted): the keyword easing nearest to each sampled motion (motion, k, value), samples
    evenly spaced. Motions that do not move give no row. The five curves are evaluated in Arrow batches at
    each sample; errors are folded in the JVM."""
    w = W.partitionBy("motion")
    o = w.orderBy("k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = samples.withColumns({"_f": F.first("value").over(o), "_l": F.last("value").over(o), "_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("k")) - 1})
    moved = p.where(F.abs(F.col("_l") - F.col("_f")) > 1e-9).select("motion", ((F.col("value") - F.col("_f")) / (F.col("_l") - F.col("_f"))).alias("p"), (F.col("_i") / (F.col("_n") - 1)).alias("x"))

    def curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf["x"].to_numpy(float)
            yield pd.concat([pd.DataFrame({"motion": pdf["motion"], "easing": name, "e": (pdf["p"] - bezier_progress(c, x)) ** 2}) for name, c in EASINGS.items()])

    kind = dict(samples.dtypes)["motion"]
    errors = moved.mapInPandas(curves, f"motion {kind}, easing string, e double").groupBy("motion", "easing").agg(F.sqrt(F.avg("e")).alias("rms"))
    best = errors.groupBy("motion").agg(F.min(F.struct("rms", "easing")).alias("b"))
    return best.select("motion", F.col("b.easing").alias("easing"), F.col("b.rms").alias("rms"), (F.col("b.rms") <= EASING_TOLERANCE).alias("accepted"))


def simulate(runs: DataFrame, steps: int) -> DataFrame:
    """(run, energy_start, energy_end, angle, speed): damped pendulums (run, angle, speed, length, damping, dt) stepped
    by classical Runge-Kutta. A run depends on itself alone, so runs are stepped side by side as arrays in
    Arrow batches."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = np.stack([pdf["angle"].to_numpy(float), pdf["speed"].to_numpy(float)])
            length, damping, dt = (pdf[c].to_numpy(float) for c in ("length", "damping", "dt"))
            slope = lambda s: np.stack([s[1], -GRAVITY / length * np.sin(s[0]) - damping * s[1]])  # noqa: B023, E731
            energy = lambda s: 0.5 * (length * s[1]) ** 2 + GRAVITY * length * (1 - np.cos(s[0]))  # noqa: B023, E731
            start = energy(y)
            for _ in range(steps):
                k1 = slope(y)
                k2 = slope(y + dt / 2 * k1)
                k3 = slope(y + dt / 2 * k2)
                k4 = slope(y + dt * k3)
                y = y + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
            yield pd.DataFrame({"run": pdf["run"], "energy_start": start, "energy_end": energy(y), "angle": y[0], "speed": y[1]})

    return runs.select("run", "angle", "speed", "length", "damping", "dt").mapInPandas(step, f"run {dict(runs.dtypes)['run']}, energy_start double, energy_end double, angle double, speed double")


def breakpoints(boxes: DataFrame, element: str, viewport: str, form: str) -> DataFrame:
    """(element, below, above, before, after): widths between which the form of an element changes, from neighbouring
    viewports of the same element."""
    w = W.partitionBy(element).orderBy(viewport)
    pairs = boxes.select(element, F.lag(viewport).over(w).alias("below"), F.col(viewport).alias("above"), F.lag(form).over(w).alias("before"), F.col(form).alias("after"))
    return pairs.where(F.col("below").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")))


def sibling_relations(boxes: DataFrame) -> DataFrame:
    """(parent, a, b, relation, gap) of consecutive siblings (parent, element, ordinal, x, y, w, h): row when b starts
    right of a's end, column when below it, overlap else."""
    w = W.partitionBy("parent").orderBy("ordinal")
    nxt = boxes.select("parent", F.col("element").alias("a"), "x", "y", "w", "h", *(F.lead(c).over(w).alias(f"_{c}") for c in ("element", "x", "y"))).where("_element is not null")
    right, down = F.col("_x") - (F.col("x") + F.col("w")), F.col("_y") - (F.col("y") + F.col("h"))
    return nxt.select("parent", "a", F.col("_element").alias("b"), F.when(right >= 0, "row").when(down >= 0, "column").otherwise("overlap").alias("relation"), F.when(right >= 0, right).when(down >= 0, down).otherwise(F.lit(0.0)).alias("gap"))


def ema_state(rows: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """(key, n, ema): the exponential mean of each key's values in order. Weights are powers, so the recurrence is a
    sum over numbered rows."""
    numbered = rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(order))).withColumn("_n", F.count("*").over(W.partitionBy(key)))
    weight = F.pow(F.lit(1 - alpha), (F.col("_n") - F.col("_i")).cast("double")) * F.when(F.col("_i") == 1, 1.0).otherwise(alpha)
    return numbered.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight * F.col(value)).alias("ema"))
