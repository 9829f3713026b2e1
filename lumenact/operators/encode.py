"""Sparse encoding of hidden states.

The weights of a layer are read tile by tile: a tile is a range of features
whose matrix stays under a byte limit, and only tiles are ever collected and
broadcast. The vectors are read once, whatever the number of tiles: a task goes
over all tiles of its layer for each block of vectors and keeps what fires, or
the best k so far. So the plan is the same for every size of the weights, has
no shuffle, and runs on streams as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TILE_BYTES = 256 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024

TOPK = "topk"
JUMPRELU = "jumprelu"


def _top_mask(pre: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest per row; the lowest feature wins a tie."""
    if k >= pre.shape[1]:
        return np.ones(pre.shape, dtype=bool)
    cut = np.partition(pre, pre.shape[1] - k, axis=1)[:, pre.shape[1] - k][:, None]
    mask = pre >= cut
    tied = np.flatnonzero(mask.sum(axis=1) > k)
    if len(tied):
        above, equal = pre[tied] > cut[tied], pre[tied] == cut[tied]
        room = k - above.sum(axis=1, keepdims=True)
        mask[tied] = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return mask


def _pre_activations(x: np.ndarray, part: dict) -> np.ndarray:
    if part["b_dec"] is not None:
        x = x - part["b_dec"]
    return x @ part["w"] + part["b_enc"]


def _fired_topk(x: np.ndarray, parts: list[dict], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fired ids row after row and how many each row has: the best k over all tiles.

    Tiles come in the order of their ids, so the columns kept so far hold lower
    ids than the next tile's, and a tie still goes to the lowest feature.
    """
    best = np.zeros((len(x), 0), dtype=parts[0]["w"].dtype)
    ids = np.zeros((len(x), 0), dtype=np.int32)
    for part in parts:
        pre = np.concatenate([best, _pre_activations(x, part)], axis=1)
        every = np.concatenate([ids, np.broadcast_to(part["ids"], (len(x), len(part["ids"])))], axis=1)
        mask = _top_mask(pre, k)
        best = pre[mask].reshape(len(x), -1)
        ids = every[mask].reshape(len(x), -1)
    return ids.ravel(), np.full(len(x), ids.shape[1])


def _fired_jumprelu(x: np.ndarray, parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Fired ids row after row and how many each row has: all above their threshold."""
    rows, ids = [], []
    for part in parts:
        hit_rows, hit_columns = np.nonzero(_pre_activations(x, part) > part["threshold"])
        rows.append(hit_rows)
        ids.append(part["ids"][hit_columns])
    rows, ids = np.concatenate(rows), np.concatenate(ids)
    order = np.argsort(rows, kind="stable")
    return ids[order], np.bincount(rows, minlength=len(x))


def _encoder(tiles: list, kind: str, k: int | None, carry: Sequence[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tile.value for tile in tiles]
        d_model, dtype = parts[0]["w"].shape[0], parts[0]["w"].dtype
        widest = max(part["w"].shape[1] for part in parts)
        rows = max(1, BLOCK_BYTES // (widest * dtype.itemsize))
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                block = batch.slice(start, rows)
                h = block.column("h")
                if h.null_count or not np.all(np.diff(h.offsets.to_numpy()) == d_model):
                    raise ValueError(f"hidden states must have d_model={d_model} values")
                x = h.flatten().to_numpy(zero_copy_only=False).astype(dtype)
                x = x.reshape(block.num_rows, d_model)
                ids, counts = _fired_jumprelu(x, parts) if kind == JUMPRELU else _fired_topk(x, parts, k)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                fired = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*[block.column(c) for c in carry], fired], names=[*carry, "fired"])

    return encode


def layer_sizes(weights: DataFrame) -> list:
    """Per layer: features, range of feature ids, and the width of the weights."""
    rows = (
        weights.groupBy("layer")
        .agg(
            F.min("feature_id").alias("low"), F.max("feature_id").alias("high"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.size("w")).alias("d_min"), F.max(F.size("w")).alias("d_max"),
        ).collect()
    )
    return sorted(rows, key=lambda row: row["layer"])


def _pull(weights: DataFrame) -> pa.Table:
    return weights.select("layer", "feature_id", "w", "b_enc", "threshold").toArrow()


def _tile_values(rows: pa.Table, b_dec, dtype) -> dict:
    rows = rows.sort_by("feature_id")
    flat = rows["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    w = flat.reshape(rows.num_rows, -1)
    return {
        "ids": rows["feature_id"].to_numpy().astype(np.int32),
        "w": np.ascontiguousarray(w.T.astype(dtype)),
        "b_enc": rows["b_enc"].to_numpy().astype(dtype),
        "threshold": rows["threshold"].to_numpy().astype(dtype),
        "b_dec": b_dec,
    }


def encode(
    activations: DataFrame,
    weights: DataFrame,
    kind: str,
    k: int | None = None,
    bias: DataFrame | None = None,
    layers: Sequence[int] | None = None,
    carry: Sequence[str] = ("sample_id", "label", "layer", "step"),
    max_tile_bytes: int = MAX_TILE_BYTES,
    precision: str = "float32",
) -> DataFrame:
    """Add `fired array<int>`, the sorted feature ids active in each vector.

    kind "topk": the k largest of x.W + b_enc. kind "jumprelu": the features
    with (x - b_dec).W + b_enc above their threshold. Feature ids of a layer
    run from 0 to its number of features - 1.
    """
    if kind not in (TOPK, JUMPRELU):
        raise ValueError(f"unknown encoder kind {kind!r}")
    if kind == TOPK and (k is None or k < 1):
        raise ValueError("a topk encoder needs k >= 1")
    spark = activations.sparkSession
    dtype = np.dtype(precision)
    sizes = layer_sizes(weights if layers is None else weights.where(F.col("layer").isin(list(layers))))
    if not sizes:
        raise ValueError("no weights for the requested layers")
    biases = {}
    if kind == JUMPRELU and bias is not None:
        biases = {r["layer"]: np.array(r["b_dec"], dtype=dtype)
                  for r in bias.where(F.col("layer").isin([s["layer"] for s in sizes])).collect()}

    # Small weights of several layers come in one go, large ones tile by tile.
    total_bytes = sum(s["n"] * s["d_max"] * dtype.itemsize for s in sizes)
    wanted = [s["layer"] for s in sizes]
    whole = _pull(weights.where(F.col("layer").isin(wanted))) if total_bytes <= max_tile_bytes else None

    schema = T.StructType(
        [*[activations.schema[c] for c in carry], T.StructField("fired", T.ArrayType(T.IntegerType()))])
    parts = []
    for size in sizes:
        if size["d_min"] != size["d_max"]:
            raise ValueError(f"layer {size['layer']} has weights of different widths")
        per_tile = max(1, max_tile_bytes // (size["d_max"] * dtype.itemsize))
        tiles = []
        for low in range(size["low"], size["high"] + 1, per_tile):
            high = min(low + per_tile - 1, size["high"])
            if whole is not None:
                part = whole.filter(pc.equal(whole["layer"], size["layer"]))
            else:
                part = _pull(weights.where(
                    (F.col("layer") == size["layer"]) & F.col("feature_id").between(low, high)))
            if part.num_rows:
                tiles.append(spark.sparkContext.broadcast(_tile_values(part, biases.get(size["layer"]), dtype)))
        rows = activations.where(F.col("layer") == size["layer"]).select(*carry, "h")
        parts.append(rows.mapInArrow(_encoder(tiles, kind, k, carry), schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
