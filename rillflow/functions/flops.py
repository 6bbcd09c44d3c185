"""Operations of a training step from sequence lengths, for decoders of several families.

A shape is described by parts, not by family: ordinary or latent attention, all layers full or most of them sliding,
dense feed-forward of two or three matrices or experts with a router and shared ones. The estimate is
6 x weights a token meets x tokens + 12 x heads x head width x sum over layers of length x length attended to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.metrics import device_tflops


@dataclass(frozen=True)
class Latent:
    """Low-rank attention: ranks of queries (None: full) and of keys and values, head widths without and with rotation, and of values."""

    q_rank: int | None
    kv_rank: int
    plain: int
    rotated: int
    value: int


@dataclass(frozen=True)
class Experts:
    """Experts in a layer, those chosen for a token, shared ones, width of each, and leading layers that are dense."""

    total: int
    chosen: int
    width: int
    shared: int = 0
    dense_layers: int = 0


@dataclass(frozen=True)
class Shape:
    hidden: int
    layers: int
    vocab: int
    heads: int
    kv_heads: int
    mlp: int
    head_dim: int | None = None
    mlp_matrices: int = 3
    qk_norm: bool = False
    experts: Experts | None = None
    latent: Latent | None = None
    window: int | None = None
    full_every: int = 6  # of sliding layers, each so-manieth is full

    @property
    def width(self) -> int:
        if self.latent:
            return self.latent.plain + self.latent.rotated
        return self.head_dim or self.hidden // self.heads

    def attention(self) -> int:
        a = self.latent
        if a is None:
            return self.hidden * self.width * (2 * self.heads + 2 * self.kv_heads)
        query = self.heads * self.width
        down_and_up = self.hidden * query if a.q_rank is None else a.q_rank * (self.hidden + query)
        keys = self.hidden * (a.kv_rank + a.rotated) + self.heads * (a.plain + a.value) * a.kv_rank
        return down_and_up + keys + self.heads * a.value * self.hidden

    def weights(self) -> int:
        """Weights that a token meets, input and output embeddings included."""
        feed = self.hidden * self.mlp * self.mlp_matrices
        norm = self.hidden + self.kv_heads * self.width if self.qk_norm else 0
        e = self.experts
        dense, sparse = (self.layers, 0) if e is None else (e.dense_layers, self.layers - e.dense_layers)
        routed = 0 if e is None else self.hidden * (e.total + 3 * e.width * (e.chosen + e.shared))
        return dense * feed + sparse * routed + self.layers * (self.attention() + norm) + 2 * self.vocab * self.hidden

    def sliding_layers(self) -> int:
        return self.layers - self.layers // self.full_every if self.window else 0

    def attended(self, length: Column) -> Column:
        """Sum over layers of length times the length it attends to."""
        n = length.cast("double")
        far = (self.layers - self.sliding_layers()) * n * n
        return far + self.sliding_layers() * n * F.least(n, F.lit(float(self.window))) if self.window else far


def step_flops(df: DataFrame, shape: Shape | None, length: str, keys: list[str] = ()) -> DataFrame:
    """(keys, tokens, flops) of the sequences of each step; an unknown shape counts 0."""
    n = F.col(length)
    if shape is None:
        return df.groupBy(*keys).agg(F.sum(n).alias("tokens"), F.lit(0.0).alias("flops"))
    per = 6.0 * shape.weights() * n + 12.0 * shape.heads * shape.width * shape.attended(n)
    return df.groupBy(*keys).agg(F.sum(n).alias("tokens"), F.sum(per).alias("flops"))


def utilisation(df: DataFrame, shape: Shape | None, length: str, seconds: str, device: str, keys: list[str]) -> DataFrame:
    """(keys, tflops, mfu): achieved tera-operations per second and their share of the device's peak."""
    t = step_flops(df, shape, length, keys).join(df.groupBy(*keys).agg(F.max(seconds).alias("__s")), keys)
    got = F.col("flops") / F.col("__s") / 1e12
    return t.select(*keys, got.alias("tflops"), (got / device_tflops(device)).alias("mfu"))
