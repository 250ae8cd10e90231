"""Synthetic training sequences from movement definitions, reproducible row by row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAMES = 64


def sequence_of(flips: float, twists: float, seed: int, frames: int = FRAMES, noise: float = 0.02) -> np.ndarray:
    """(frames, 3): cumulative flip and twist in degrees and height in torso lengths of a jump with smooth onset and landing."""
    rng = np.random.default_rng(seed)
    onset, landing = 0.2 + 0.05 * rng.random(), 0.8 + 0.05 * rng.random()
    air = np.clip((np.linspace(0, 1, frames) - onset) / (landing - onset), 0, 1)
    turned = air * air * (3 - 2 * air)
    height = 4 * air * (1 - air) * (1 + 0.3 * rng.random())
    made = np.column_stack([360 * flips * turned, 360 * twists * turned, height])
    return made + noise * rng.standard_normal(made.shape) * np.array([10.0, 10.0, 1.0])


def generate(definitions: DataFrame, samples: int) -> DataFrame:
    """trick_id, sample, step, flip_deg, twist_deg, height: ``samples`` sequences of each definition.

    The seed is a hash of definition and sample, so a sequence does not depend on partitioning or on retries.
    """
    wanted = definitions.select("trick_id", "flips", "twists", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    seeded = wanted.withColumn("seed", F.abs(F.xxhash64("trick_id", "sample") % (1 << 31)))

    def run(batches):
        for batch in batches:
            if len(batch):
                made = np.concatenate([sequence_of(*one) for one in zip(batch["flips"], batch["twists"], batch["seed"], strict=True)])
                keys = batch[["trick_id", "sample"]].loc[batch.index.repeat(FRAMES)].reset_index(drop=True)
                yield keys.assign(step=np.tile(np.arange(FRAMES), len(batch)), flip_deg=made[:, 0], twist_deg=made[:, 1], height=made[:, 2])

    return seeded.mapInPandas(run, "trick_id long, sample int, step int, flip_deg double, twist_deg double, height double")


def mirrored(sequences: DataFrame) -> DataFrame:
    """The sequences with the twist turned the other way."""
    return sequences.withColumn("twist_deg", -F.col("twist_deg"))


def encoded_properties(definitions: DataFrame, bins: list[float]) -> DataFrame:
    """trick_id and the nearest bin of flips and twists, the lower of equals."""
    table = F.array(*(F.lit(float(b)) for b in bins))
    nearest = lambda c: (F.array_position(F.transform(table, lambda b: F.abs(b - F.col(c))), F.array_min(F.transform(table, lambda b: F.abs(b - F.col(c))))) - 1).cast("long")
    return definitions.select("trick_id", nearest("flips").alias("flip_bin"), nearest("twists").alias("twist_bin"))
