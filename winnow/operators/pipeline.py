"""Configuration, extraction and stages (rows S17, S20, T12, K14, K15, R5, R6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from winnow.functions.files import exists, folders, remove
from winnow.operators.registry import config_hash


@dataclass(frozen=True)
class ClusteringConfig:
    """A clustering of several levels; each list has an entry for each level."""

    n_levels: int
    n_clusters: list[int]
    n_iters: int = 50
    n_splits: list[int] = field(default_factory=list)
    n_resampling_steps: list[int] = field(default_factory=list)
    sample_size: list[int] = field(default_factory=list)
    sampling_strategy: str = "c"
    subset_indices_path: str | None = None

    def __post_init__(self) -> None:
        for name in ("n_clusters", "n_splits", "n_resampling_steps", "sample_size"):
            values = getattr(self, name)
            if name != "n_clusters" and not values:
                object.__setattr__(self, name, [1] * self.n_levels if name != "sample_size" else [0] * self.n_levels)
            elif len(values) != self.n_levels:
                raise ValueError(f"{name} needs {self.n_levels} entries")
        if self.sampling_strategy not in ("c", "r"):
            raise ValueError(f"unknown strategy {self.sampling_strategy!r}")
        if any(s > 1 and r > 1 for s, r in zip(self.n_splits, self.n_resampling_steps, strict=True)):
            raise ValueError("a level is either split or resampled")


def merged_config(*layers: dict) -> dict:
    """Later layers win where they have a value."""
    out: dict = {}
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v is not None}
    return out


def sample_name(levels: int, strategy: str, multiplier: int, target: int, suffix: str = "") -> str:
    """The name of a sample."""
    return f"{levels}{strategy}_mul{multiplier}_{target}_balanced_selection" + (f"_{suffix}" if suffix else "")


def memoised(spark: SparkSession, root: str, config: dict, make: Callable[[], DataFrame], exclude: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """What a run with this configuration wrote before, else what ``make`` gives, written."""
    folder = f"{root}/{config_hash(config, exclude)}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def steps(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the folders step=0, 1, ... that were written to their end."""
    if not exists(spark, root):
        return []
    named = (name.partition("step=") for name in folders(spark, root))
    known = sorted(int(number) for before, _, number in named if not before and number.isdigit())
    return [k for k in known if exists(spark, f"{root}/step={k}/_SUCCESS")]


def latest_step(spark: SparkSession, root: str) -> int | None:
    """The last of the folders step=0, 1, ... that was written to its end."""
    return max(steps(spark, root), default=None)


def keep_steps(spark: SparkSession, root: str, most: int) -> list[int]:
    """Remove the oldest whole steps beyond ``most``, and return those that stay."""
    known = steps(spark, root)
    for k in known[: max(0, len(known) - most)]:
        remove(spark, f"{root}/step={k}")
    return known[max(0, len(known) - most) :]


def run_stages(stages: dict[str, tuple[list[str], Callable[..., object]]]) -> dict[str, object]:
    """The results of stages (names of inputs, function), each after those it needs."""
    done: dict[str, object] = {}
    waiting = dict(stages)
    while waiting:
        ready = [n for n, (needs, _) in waiting.items() if all(x in done for x in needs)]
        if not ready:
            raise ValueError(f"stages wait for each other or for what is missing: {sorted(waiting)}")
        for n in ready:
            needs, make = waiting.pop(n)
            done[n] = make(*(done[x] for x in needs))
    return done


def pooled(patch: np.ndarray, grid: int = 8) -> np.ndarray:
    """Means over a grid of cells; a small deterministic stand-in for a network."""
    rows, cols = (np.linspace(0, n, grid + 1).astype(int) for n in patch.shape)
    out = np.zeros((grid, grid), np.float32)
    for i in range(grid):
        for j in range(grid):
            cell = patch[rows[i] : max(rows[i + 1], rows[i] + 1), cols[j] : max(cols[j + 1], cols[j] + 1)]
            out[i, j] = np.nanmean(cell) if cell.size and not np.isnan(cell).all() else 0.0
    return out.ravel()


def extracted(patches: DataFrame, model: Callable[[np.ndarray], np.ndarray] = pooled) -> DataFrame:
    """(id, embedding) of patches (id, values, width); the model sees one patch at a time.

    A patch that is null, empty or not a whole number of lines has a null embedding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values, width in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole = values and width and len(values) % width == 0
                out.append(model(np.array(values, float).reshape(-1, width)) if whole else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])

    return patches.select("id", "values", "width").mapInArrow(run, "id long, embedding array<float>")
