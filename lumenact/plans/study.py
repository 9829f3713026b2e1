"""The chain most queries share: encode, first fire, split, discover, classify."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import fetched
from ..operators import corpus, discover, linear, temporal
from ..operators.encode import JUMPRELU, TOPK, encode
from ..session import stage
from . import fixtures as fx

RATIO = 0.8
SEED = 42
K = 8
TOPK_K = 4


def encoded(spark: SparkSession, acts: DataFrame, kind: str = JUMPRELU, carry=None) -> DataFrame:
    return encode(
        acts, fx.sae_weights(spark), kind, k=TOPK_K,
        bias=fx.sae_bias(spark) if kind == JUMPRELU else None,
        carry=carry or ("sample_id", "label", "layer", "step"), precision="float64")


class Study:
    """Lazily built tables of one data folder, each computed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def samples(self) -> DataFrame:
        return fx.samples(self.spark, self.sf_dir)

    @cached_property
    def alive(self) -> DataFrame:
        return self.samples.where(F.col("n_steps") > 0)

    @cached_property
    def fired(self) -> DataFrame:
        return encoded(self.spark, fx.activations(self.spark, self.sf_dir))

    @cached_property
    def first(self) -> DataFrame:
        return stage(discover.first_fire(self.fired))

    @cached_property
    def cuts(self) -> DataFrame:
        return stage(corpus.split_cuts(self.alive, RATIO, SEED, ["label"]))

    def part(self, df: DataFrame, split: str) -> DataFrame:
        return corpus.with_split(df, self.cuts, SEED, ["label"]).where(F.col("split") == split).drop("split")

    @cached_property
    def train(self) -> DataFrame:
        return self.part(self.alive, "train")

    @cached_property
    def test(self) -> DataFrame:
        return self.part(self.alive, "test")

    @cached_property
    def train_first(self) -> DataFrame:
        return self.part(self.first, "train")

    @cached_property
    def test_first(self) -> DataFrame:
        return self.part(self.first, "test")

    @cached_property
    def chosen(self) -> DataFrame:
        """The best layer's K features on the training split."""
        return fetched(discover.discover(
            self.train_first, self.train, K, fx.D_SAE, layers=fx.layer_frame(self.spark)), K)

    @cached_property
    def ids(self) -> list[int]:
        return discover.feature_ids_in_order(self.chosen)

    @cached_property
    def layer(self) -> int:
        return self.chosen.select("layer").first()[0]

    @cached_property
    def classes(self) -> list[int]:
        return linear.class_list(self.samples)

    def picks(self, first: DataFrame) -> DataFrame:
        """Firings of the chosen features."""
        return linear.restrict(first, self.layer, self.ids)

    @cached_property
    def counts(self) -> DataFrame:
        return linear.bernoulli_counts(self.picks(self.train_first), self.train, self.ids)

    @cached_property
    def weights(self) -> DataFrame:
        return linear.as_arrays(linear.bernoulli_weights(self.counts))

    @cached_property
    def predictions(self) -> DataFrame:
        fires = linear.with_bias(self.picks(self.test_first), self.test)
        return linear.score(fires, self.weights, self.classes)

    def curve(self, grid, inclusive: bool = False) -> DataFrame:
        return temporal.confidence_curve(
            self.picks(self.test_first), self.test, self.weights, self.classes, grid, inclusive)
