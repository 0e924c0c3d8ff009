"""Arrow UDFs over pixel columns.

A frame's pixels are one BINARY value, row-major; RGB is interleaved.  Each UDF
works on whole Arrow batches: rows of one size are processed as one numpy block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql import types as T

from framesift import params as P
from framesift.functions import kernels, resample
from framesift.functions.arrays import binary_from_rows, by_block, byte_rows, chunks, number_rows, stacked

# Thumbnail pixels per mask block: row sweeps pay off over many frames at once.
MASK_PIXELS = 1 << 22


def _sizes(width: pa.Array, height: pa.Array, *present: pa.Array) -> list[tuple | None]:
    ok = np.ones(len(width), dtype=bool)
    for column in present:
        ok &= ~np.asarray(column.is_null())
    ws, hs = width.to_pylist(), height.to_pylist()
    return [(w, h) if good and w is not None and h is not None else None
            for w, h, good in zip(ws, hs, ok)]


def _checked(values: list[np.ndarray], rows: np.ndarray, length: int) -> None:
    for i in rows:
        if values[i].size != length:
            raise ValueError(f"{length} bytes expected, a frame has {values[i].size}")


def quantise(values: str | Column, channels: str = "gray") -> Column:
    """64 floats in [-1, 1] to the bytes of an 8x8 frame.

    `rgb` rotates the gray values by 1 and 7 positions for green and blue.
    """
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        flat, first, length = number_rows(column)

        def block(rows, n):
            v = flat[first[rows][:, None] + np.arange(n)].astype(np.float64)
            g = np.clip(np.floor((v + 1.0) * 127.5), 0, 255).astype(np.uint8)
            return g if channels == "gray" else np.stack(
                [g, np.roll(g, -1, axis=1), np.roll(g, -7, axis=1)], axis=2).reshape(len(rows), -1)
        return binary_from_rows(by_block(len(length), [None if n < 0 else int(n) for n in length], block))
    return run(values)


def rgb_to_gray(rgb: str | Column) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        values = byte_rows(column)
        shapes = [v.size if ok else None for v, ok in zip(values, np.asarray(column.is_valid()))]

        def block(rows, length):
            for part in chunks(rows, length // 3):
                yield from kernels.luma(stacked(values, part).reshape(len(part), -1, 3))
        return binary_from_rows(by_block(len(values), shapes, block))
    return run(rgb)


@F.arrow_udf(T.DoubleType())
def _laplacian(gray: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    values = byte_rows(gray)

    def block(rows, size):
        w, h = size
        _checked(values, rows, w * h)
        for part in chunks(rows, w * h):
            yield from kernels.laplacian_variance(stacked(values, part).reshape(-1, h, w), None)
    return pa.array(by_block(len(values), _sizes(width, height, gray), block), pa.float64())


@F.arrow_udf(T.DoubleType())
def _laplacian_masked(gray: pa.Array, width: pa.Array, height: pa.Array, valid: pa.Array) -> pa.Array:
    values, masks = byte_rows(gray), byte_rows(valid)
    masked = np.asarray(valid.is_valid())

    def block(rows, key):
        w, h, has_mask = key
        _checked(values, rows, w * h)
        for part in chunks(rows, w * h):
            mask = stacked(masks, part).reshape(-1, h, w) if has_mask else None
            yield from kernels.laplacian_variance(stacked(values, part).reshape(-1, h, w), mask)
    shapes = [None if s is None else (*s, bool(m))
              for s, m in zip(_sizes(width, height, gray), masked)]
    return pa.array(by_block(len(values), shapes, block), pa.float64())


def laplacian_variance(gray, width, height, valid=None) -> Column:
    """Sharpness of a gray frame, over valid pixels when `valid` is given."""
    if valid is None:
        return _laplacian(gray, width, height)
    return _laplacian_masked(gray, width, height, valid)


@F.arrow_udf(T.DoubleType())
def _mad(a: pa.Array, b: pa.Array, a_valid: pa.Array, b_valid: pa.Array) -> pa.Array:
    left, right = byte_rows(a), byte_rows(b)
    lmask, rmask = byte_rows(a_valid), byte_rows(b_valid)
    lm, rm = np.asarray(a_valid.is_valid()), np.asarray(b_valid.is_valid())
    ok = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    shapes = [(x.size, y.size, bool(p), bool(q)) if good else None
              for x, y, p, q, good in zip(left, right, lm, rm, ok)]

    def block(rows, key):
        n = min(key[0], key[1])
        for part in chunks(rows, max(n, 1)):
            valid = None
            if key[2]:
                valid = stacked(lmask, part)[:, :n] != 0
            if key[3]:
                other = stacked(rmask, part)[:, :n] != 0
                valid = other if valid is None else valid & other
            yield from kernels.mean_abs_diff(
                stacked(left, part)[:, :n], stacked(right, part)[:, :n], valid)
    return pa.array(by_block(len(left), shapes, block), pa.float64())


def mean_abs_diff(a, b, a_valid=None, b_valid=None) -> Column:
    """Motion between two gray frames in [0, 1]; pixels masked in either are skipped."""
    none = F.lit(None).cast("binary")
    return _mad(a, b, none if a_valid is None else a_valid, none if b_valid is None else b_valid)


def motion_of(a: pa.Array, b: pa.Array) -> pa.Array:
    """The same for two columns of a batch, without masks."""
    none = pa.array([None] * len(a), pa.binary())
    return _mad.func(a, b, none, none)


@F.arrow_udf(T.BinaryType())
def nn_scale(pixels: pa.Array, width: pa.Array, height: pa.Array, to_width: pa.Array,
             to_height: pa.Array) -> pa.Array:
    """Nearest-neighbour scale of one-byte pixels; labels are never interpolated."""
    values = byte_rows(pixels)
    shapes = [None if a is None or b is None else (*a, *b)
              for a, b in zip(_sizes(width, height, pixels), _sizes(to_width, to_height))]

    def block(rows, key):
        w, h, dw, dh = key
        _checked(values, rows, w * h)
        for part in chunks(rows, max(w * h, dw * dh)):
            frame = stacked(values, part).reshape(-1, h, w)
            if (w, h) == (dw, dh):
                yield from frame
            else:
                yield from frame[:, kernels.nearest(h, dh)[:, None], kernels.nearest(w, dw)[None, :]]
    return binary_from_rows(by_block(len(values), shapes, block))


def resize_rgb(rgb, width, height, to_width, to_height, filter_name: str = "lanczos3") -> Column:
    """Convolution resize of RGB frames; an identical size passes through."""
    @F.arrow_udf(T.BinaryType())
    def run(pixels: pa.Array, w: pa.Array, h: pa.Array, dw: pa.Array, dh: pa.Array) -> pa.Array:
        values = byte_rows(pixels)
        shapes = [None if a is None or b is None else (*a, *b)
                  for a, b in zip(_sizes(w, h, pixels), _sizes(dw, dh))]

        def block(rows, key):
            sw, sh, tw, th = key
            _checked(values, rows, sw * sh * 3)
            for part in chunks(rows, 4 * max(sw * sh, tw * th)):
                yield from resample.resize(
                    stacked(values, part).reshape(-1, sh, sw, 3), tw, th, filter_name)
        return binary_from_rows(by_block(len(values), shapes, block))
    return run(rgb, width, height, to_width, to_height)


def metric_height(width, height, metric_width: int = P.METRIC_WIDTH) -> Column:
    """Height of the metric thumbnail: unchanged up to the metric width."""
    w, h = F.col(width) if isinstance(width, str) else width, F.col(height) if isinstance(height, str) else height
    scaled = F.floor(h.cast("long") * metric_width / F.greatest(w, F.lit(1)))
    return F.when(w <= metric_width, h).otherwise(F.greatest(scaled, F.lit(1))).cast("int")


def metric_width(width, metric_width: int = P.METRIC_WIDTH) -> Column:
    w = F.col(width) if isinstance(width, str) else width
    return F.least(w, F.lit(metric_width)).cast("int")


def metric_thumbnail(rgb, width, height, limit: int = P.METRIC_WIDTH) -> Column:
    """RGB thumbnail at most `limit` wide, by bilinear convolution."""
    return resize_rgb(rgb, width, height, metric_width(width, limit),
                      metric_height(width, height, limit), "bilinear")


def crop_rgb(rgb, width, height, left, top, to_width, to_height) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(pixels: pa.Array, w: pa.Array, h: pa.Array, x: pa.Array, y: pa.Array, dw: pa.Array,
            dh: pa.Array) -> pa.Array:
        values = byte_rows(pixels)
        out = []
        for v, *box in zip(values, *(c.to_pylist() for c in (w, h, x, y, dw, dh))):
            if None in box:
                out.append(None)
                continue
            sw, sh, ox, oy, tw, th = box
            out.append(v.reshape(sh, sw, 3)[oy:oy + th, ox:ox + tw])
        return binary_from_rows(out)
    return run(rgb, width, height, left, top, to_width, to_height)


def channel(rgb, number: int) -> Column:
    """One channel of an RGB frame."""
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        ok = np.asarray(column.is_valid())
        return binary_from_rows([v.reshape(-1, 3)[:, number] if good else None
                                 for v, good in zip(byte_rows(column), ok)])
    return run(rgb)


def label_to_mask(labels, class_id: int) -> Column:
    """0 where the label is the class (ignore), 255 elsewhere."""
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        values = byte_rows(column)
        shapes = [v.size if ok else None for v, ok in zip(values, np.asarray(column.is_valid()))]

        def block(rows, n):
            for part in chunks(rows, max(n, 1)):
                yield from np.where(stacked(values, part) == class_id, 0, 255).astype(np.uint8)
        return binary_from_rows(by_block(len(values), shapes, block))
    return run(labels)


def mask_dilate(mask, width, height, radius: int) -> Column:
    """Grow the masked region by `radius` pixels in both axes."""
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        values = byte_rows(column)

        def block(rows, size):
            sw, sh = size
            _checked(values, rows, sw * sh)
            for part in chunks(rows, sw * sh):
                yield from kernels.grow_invalid(stacked(values, part).reshape(-1, sh, sw), radius)
        return binary_from_rows(by_block(len(values), _sizes(w, h, column), block))
    return run(mask, width, height)


def sky_mask(rgb, gray, width, height, luma_min: int = P.SKY_LUMA_MIN,
             blue_bias: int = P.SKY_BLUE_BIAS, gradient_max: int = P.SKY_GRADIENT_MAX,
             dilate: int = P.SKY_DILATE) -> Column:
    """0 over the sky found from the top edge; all valid when the sizes disagree."""
    @F.arrow_udf(T.BinaryType())
    def run(colour: pa.Array, luma: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        rgbs, grays = byte_rows(colour), byte_rows(luma)

        def block(rows, size):
            sw, sh = size
            for part in chunks(rows, sw * sh, MASK_PIXELS):
                fits = sw * sh > 0 and all(
                    rgbs[i].size == sw * sh * 3 and grays[i].size == sw * sh for i in part)
                if not fits:
                    for i in part:
                        yield _one_sky(rgbs[i], grays[i], sw, sh)
                    continue
                hit = kernels.sky_from_top(
                    stacked(rgbs, part).reshape(-1, sh, sw, 3),
                    stacked(grays, part).reshape(-1, sh, sw), luma_min, blue_bias, gradient_max)
                yield from kernels.grow_invalid(np.where(hit, 0, 255).astype(np.uint8), dilate)

        def _one_sky(c, g, sw, sh):
            if sw * sh == 0 or c.size != sw * sh * 3 or g.size != sw * sh:
                return np.full(sw * sh, 255, np.uint8)
            hit = kernels.sky_from_top(c.reshape(1, sh, sw, 3), g.reshape(1, sh, sw),
                                       luma_min, blue_bias, gradient_max)
            return kernels.grow_invalid(np.where(hit, 0, 255).astype(np.uint8), dilate)[0]
        return binary_from_rows(by_block(len(rgbs), _sizes(w, h, colour, luma), block))
    return run(rgb, gray, width, height)


@F.arrow_udf(T.DoubleType())
def valid_fraction(mask: pa.Array) -> pa.Array:
    """Share of non-zero bytes; an empty mask is fully valid."""
    values = byte_rows(mask)
    shapes = [v.size if ok else None for v, ok in zip(values, np.asarray(mask.is_valid()))]

    def block(rows, n):
        for part in chunks(rows, max(n, 1)):
            yield from (np.count_nonzero(stacked(values, part), axis=1) / n if n else np.ones(len(part)))
    return pa.array(by_block(len(values), shapes, block), pa.float64())


def masked_fraction(mask) -> Column:
    """Share of the frame that is masked out; 0 when there is no mask."""
    return F.coalesce(1.0 - valid_fraction(mask), F.lit(0.0))


def label_argmax(logits, classes: int) -> Column:
    """Class-major logits of one frame to one label per pixel; the first maximum wins."""
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        flat, first, length = number_rows(column)

        def block(rows, n):
            for part in chunks(rows, n):
                v = flat[first[part][:, None] + np.arange(n)].reshape(len(part), classes, -1)
                yield from kernels.first_max(v.transpose(1, 0, 2))
        return binary_from_rows(by_block(len(length), [None if n < 0 else int(n) for n in length], block))
    return run(logits)


@F.arrow_udf(T.BinaryType())
def mask_and(a: pa.Array, b: pa.Array) -> pa.Array:
    """Zero wherever either mask is zero; a missing mask changes nothing."""
    left, right = byte_rows(a), byte_rows(b)
    there = list(zip(np.asarray(a.is_valid()), np.asarray(b.is_valid())))
    shapes = [(x.size, y.size) if p and q else None for x, y, (p, q) in zip(left, right, there)]

    def block(rows, sizes):
        if sizes[0] != sizes[1]:
            raise ValueError(f"masks of {sizes[0]} and {sizes[1]} pixels cannot be combined")
        for part in chunks(rows, max(sizes[0], 1)):
            yield from np.where(stacked(right, part) == 0, 0, stacked(left, part))
    both = by_block(len(left), shapes, block)
    return binary_from_rows([x if p and not q else y if q and not p else v for x, y, (p, q), v in zip(left, right, there, both)])


@F.arrow_udf(T.DoubleType())
def squared_error(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sum of squared differences of two equally sized gray frames."""
    left, right = byte_rows(a), byte_rows(b)
    ok = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    shapes = [(x.size, y.size) if good else None for x, y, good in zip(left, right, ok)]

    def block(rows, sizes):
        if sizes[0] != sizes[1]:
            raise ValueError(f"frames of {sizes[0]} and {sizes[1]} pixels cannot be compared")
        for part in chunks(rows, max(sizes[0], 1)):
            difference = stacked(left, part).astype(np.int32) - stacked(right, part)
            yield from np.square(difference).sum(axis=1, dtype=np.int64).astype(np.float64)
    return pa.array(by_block(len(left), shapes, block), pa.float64())


JUDGEMENT = T.StructType([
    T.StructField("thumb_w", T.IntegerType()),
    T.StructField("thumb_h", T.IntegerType()),
    T.StructField("gray", T.BinaryType()),
    T.StructField("sfm", T.BinaryType()),
    T.StructField("training", T.BinaryType()),
    T.StructField("sharpness", T.DoubleType()),
])


def judge(rgb, width, height, labels=None, label_w=None, label_h=None, sky_id: int | None = None,
          people_id: int | None = None, heuristic_sky: dict | None = None,
          sky_dilate: int = P.SEG_SKY_DILATE, people_dilate: int = P.SEG_PEOPLE_DILATE,
          limit: int = P.METRIC_WIDTH) -> Column:
    """Thumbnail, masks and sharpness of output frames in one pass over the pixels.

    Class masks are dilated at label size and scaled to the thumbnail; their
    structure-from-motion set limits sharpness.  The model wins over the sky
    heuristic.  `sfm` is NULL when nothing is masked, `training` when no class
    may be hidden from a trainer.
    """
    seg = [("sky", sky_id, sky_dilate), ("people", people_id, people_dilate)] if labels is not None else []
    seg = [(c, i, d) for c, i, d in seg if i is not None]
    sky = dict(luma_min=P.SKY_LUMA_MIN, blue_bias=P.SKY_BLUE_BIAS, gradient_max=P.SKY_GRADIENT_MAX,
               dilate=P.SKY_DILATE) | (heuristic_sky or {})
    by_luma = heuristic_sky is not None and not any(c == "sky" for c, _, _ in seg)
    none = F.lit(None)

    @F.arrow_udf(JUDGEMENT)
    def run(pixels: pa.Array, w: pa.Array, h: pa.Array, classes: pa.Array, lw: pa.Array,
            lh: pa.Array) -> pa.Array:
        values, maps = byte_rows(pixels), byte_rows(classes)
        labelled = np.asarray(classes.is_valid())
        shapes = [None if a is None else (*a, *((x, y) if ok else (0, 0)))
                  for a, x, y, ok in zip(_sizes(w, h, pixels), lw.to_pylist(), lh.to_pylist(), labelled)]

        def block(rows, key):
            sw, sh, mw, mh = key
            _checked(values, rows, sw * sh * 3)
            tw = min(sw, limit)
            th = sh if sw <= limit else max(sh * limit // max(sw, 1), 1)
            for part in chunks(rows, tw * th, MASK_PIXELS):
                small = np.concatenate([
                    resample.resize(stacked(values, few).reshape(-1, sh, sw, 3), tw, th, "bilinear")
                    for few in chunks(part, 3 * sw * sh)])
                gray = kernels.luma(small)
                masks: dict[str, np.ndarray] = {}

                def add(name, mask):
                    for sidecar in P.MASK_ROUTING[name]:
                        old = masks.get(sidecar)
                        masks[sidecar] = mask if old is None else np.where(mask == 0, 0, old)
                for name, number, grow in seg if mw else []:
                    found = np.where(stacked(maps, part).reshape(-1, mh, mw) == number, 0, 255)
                    found = kernels.grow_invalid(found.astype(np.uint8), grow)
                    add(name, found[:, kernels.nearest(mh, th)[:, None], kernels.nearest(mw, tw)[None, :]])
                if by_luma:
                    hit = kernels.sky_from_top(small, gray, sky["luma_min"], sky["blue_bias"],
                                               sky["gradient_max"])
                    add("sky", kernels.grow_invalid(np.where(hit, 0, 255).astype(np.uint8), sky["dilate"]))
                sharp = kernels.laplacian_variance(gray, masks.get("sfm"))
                for k in range(len(part)):
                    yield {"thumb_w": tw, "thumb_h": th, "gray": gray[k].tobytes(),
                           "sfm": masks["sfm"][k].astype(np.uint8).tobytes() if "sfm" in masks else None,
                           "training": (masks["training"][k].astype(np.uint8).tobytes()
                                        if "training" in masks else None),
                           "sharpness": float(sharp[k])}
        return pa.array(by_block(len(values), shapes, block), _JUDGEMENT_ARROW)
    return run(rgb, width, height,
               none.cast("binary") if labels is None else labels,
               none.cast("int") if label_w is None else label_w,
               none.cast("int") if label_h is None else label_h)


_JUDGEMENT_ARROW = pa.struct([
    ("thumb_w", pa.int32()), ("thumb_h", pa.int32()), ("gray", pa.binary()), ("sfm", pa.binary()),
    ("training", pa.binary()), ("sharpness", pa.float64())])


def register(spark: SparkSession) -> None:
    """Make the array metrics callable from SQL."""
    spark.udf.register("laplacian_variance", _laplacian)
    spark.udf.register("laplacian_variance_masked", _laplacian_masked)
    spark.udf.register("mean_abs_diff", _mad)
    spark.udf.register("nn_scale", nn_scale)
    spark.udf.register("valid_fraction", valid_fraction)
    spark.udf.register("mask_and", mask_and)
