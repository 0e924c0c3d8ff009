"""Semantic segmentation of frames with a model the caller supplies.

A model is a picklable factory: called once per Python worker, it returns a
function from a float32 batch (n, 3, h, w) to logits (n, classes, h', w').
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from framesift import params as P
from framesift.functions import kernels, resample
from framesift.functions.arrays import binary_from_rows, by_block, byte_rows, chunks, stacked

Run = Callable[[np.ndarray], np.ndarray]

_OPEN: dict[object, Run] = {}


@dataclass(frozen=True)
class OnnxModel:
    """Weights at a path every executor can read."""

    path: str

    def __call__(self) -> Run:
        import onnxruntime
        from pyarrow import fs as pafs
        files, at = pafs.FileSystem.from_uri(self.path)
        with files.open_input_stream(at) as stream:
            session = onnxruntime.InferenceSession(stream.read(), providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda batch: session.run(None, {name: batch})[0]

    def identity(self) -> str:
        """What tells these weights from others: their checksum, wherever they lie."""
        from pyarrow import fs as pafs
        files, at = pafs.FileSystem.from_uri(self.path)
        digest = hashlib.sha256()
        with files.open_input_stream(at) as stream:
            while part := stream.read(1 << 20):
                digest.update(part)
        return f"sha256 {digest.hexdigest()}"

    def declared_size(self) -> tuple[int, int] | None:
        """Width and height when the model fixes them."""
        import onnxruntime
        from pyarrow import fs as pafs
        files, at = pafs.FileSystem.from_uri(self.path)
        with files.open_input_stream(at) as stream:
            session = onnxruntime.InferenceSession(stream.read(), providers=["CPUExecutionProvider"])
        shape = session.get_inputs()[0].shape
        if len(shape) == 4 and all(isinstance(v, int) and v > 1 for v in shape[2:]):
            return shape[3], shape[2]
        return None


def _opened(model) -> Run:
    if model not in _OPEN:
        _OPEN[model] = model()
    return _OPEN[model]


@dataclass(frozen=True)
class ModelInfo:
    size: tuple[int, int]
    classes: int
    offset: int


def inspect_model(model, width: int, height: int, class_ids: tuple[int, ...] = ()) -> ModelInfo:
    """Run the model once before the job, so a wrong one fails at the start.

    The offset is 1 for label sets with a background class in front.
    """
    declared = getattr(model, "declared_size", lambda: None)()
    w, h = declared or (width, height)
    out = np.asarray(model()(np.zeros((1, 3, h, w), dtype=np.float32)))
    if out.ndim != 4 or out.shape[0] != 1:
        raise ValueError(f"the model's output has shape {list(out.shape)}, not 1 x classes x height x width")
    classes = out.shape[1]
    if classes > P.SEG_MAX_CLASSES:
        raise ValueError(f"{classes} classes do not fit one byte per label (at most {P.SEG_MAX_CLASSES})")
    offset = int(classes == P.SEG_CLASSES_WITH_BACKGROUND)
    for c in class_ids:
        if c + offset >= classes:
            raise ValueError(f"class {c + offset} is outside the model's {classes} classes")
    return ModelInfo((w, h), classes, offset)


def normalised(rgb: np.ndarray) -> np.ndarray:
    """(n, h, w, 3) bytes to the (n, 3, h, w) float32 input of the model."""
    mean = np.asarray(P.NORM_MEAN, dtype=np.float32)
    std = np.asarray(P.NORM_STD, dtype=np.float32)
    v = (rgb.astype(np.float32) / np.float32(255.0) - mean) / std
    return np.ascontiguousarray(v.transpose(0, 3, 1, 2))


def segment_frames(rgb, width, height, model, info: ModelInfo, batch_pixels: int = 1 << 21,
                   size: tuple[Column, Column] | None = None) -> Column:
    """Label maps at inference size, one byte per pixel.

    `size` gives the inference size of each row where it differs; rows of equal
    shape are inferred together.

    The class is picked at the model's own stride; labels are then enlarged by
    nearest neighbour, never blended.
    """
    @F.arrow_udf(T.BinaryType())
    def run(pixels: pa.Array, w: pa.Array, h: pa.Array, to_w: pa.Array, to_h: pa.Array) -> pa.Array:
        infer = _opened(model)
        values = byte_rows(pixels)
        sizes = [None if not ok or s[0] is None else s for ok, *s in zip(
            np.asarray(pixels.is_valid()), *(c.to_pylist() for c in (w, h, to_w, to_h)))]
        sizes = [s and tuple(s) for s in sizes]

        def block(rows, size):
            sw, sh, iw, ih = size
            for part in chunks(rows, iw * ih, batch_pixels):
                scaled = resample.resize(stacked(values, part).reshape(-1, sh, sw, 3), iw, ih, "lanczos3")
                logits = infer(normalised(scaled))
                if logits.ndim != 4 or logits.shape[1] != info.classes:
                    raise ValueError(f"the output shape is now {logits.shape}")
                small = kernels.first_max(logits.transpose(1, 0, 2, 3))
                if small.shape[1:] != (ih, iw):
                    small = small[:, kernels.nearest(small.shape[1], ih)[:, None],
                                  kernels.nearest(small.shape[2], iw)[None, :]]
                yield from small
        return binary_from_rows(by_block(len(values), sizes, block))
    to_w, to_h = size or (F.lit(info.size[0]), F.lit(info.size[1]))
    return run(rgb, width, height, to_w.cast("int"), to_h.cast("int"))
