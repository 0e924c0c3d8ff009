"""Sizes, camera intrinsics and positions as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from framesift import params as P


def _even(v: Column) -> Column:
    return v.cast("int").bitwiseAND(F.lit(~1))


def output_size(kind: Column, factor: Column, exact_w: Column, exact_h: Column,
                width: Column, height: Column) -> tuple[Column, Column]:
    """Output width and height for a size spec: `same`, `scale` or `exact`.

    Scaled sides round half away from zero and are at least 2; every side is
    made even.  A factor outside (0, 8] gives NULL.
    """
    in_range = (factor > 0) & (factor <= P.MAX_SCALE)

    def side(v: Column, exact: Column) -> Column:
        scaled = F.greatest(F.round(v.cast("double") * factor), F.lit(2.0))
        return _even(F.when(kind == "same", v)
                     .when(kind == "exact", exact)
                     .when((kind == "scale") & in_range, scaled.cast("int")))
    return side(width, exact_w), side(height, exact_h)


def stretch(v: Column) -> Column:
    return F.when(v > 0.01, v).otherwise(F.lit(1.0))


def fov(in_w: Column, out_w: Column) -> Column:
    return in_w.cast("double") / F.greatest(out_w, F.lit(1)).cast("double")


def pinhole_intrinsics(k00, k11, calib_w, calib_h, stretch_x, stretch_y, in_w, in_h, out_w,
                       out_h) -> list[Column]:
    """fx, fy, cx, cy of the undistorted output.  Both focals back out the
    horizontal stretch."""
    sx, sy = stretch(stretch_x), stretch(stretch_y)
    ratio_x = F.try_divide(in_w.cast("double"), calib_w.cast("double")) * sx
    ratio_y = F.try_divide(in_h.cast("double"), calib_h.cast("double")) * sy
    back = F.lit(1.0) / sx
    f = fov(in_w, out_w)
    return [k00 * ratio_x * back / f, k11 * ratio_y * back / f,
            out_w.cast("double") / 2.0, out_h.cast("double") / 2.0]


def cover_crop(width, height, to_w, to_h) -> dict[str, Column]:
    """Scaled size and crop origin that cover a target without stretching."""
    scale = F.greatest(F.try_divide(to_w.cast("double"), width), F.try_divide(to_h.cast("double"), height))
    scaled_w = F.greatest(F.round(width * scale).cast("int"), to_w.cast("int"))
    scaled_h = F.greatest(F.round(height * scale).cast("int"), to_h.cast("int"))
    half = F.lit(2)
    return {
        "scaled_w": scaled_w,
        "scaled_h": scaled_h,
        "crop_x": F.floor((scaled_w - to_w) / half).cast("int"),
        "crop_y": F.floor((scaled_h - to_h) / half).cast("int"),
    }


def duration_of(duration_s: Column, frames: Column, fps: Column) -> Column:
    """Probed duration, else frames over fps, else NULL."""
    return F.coalesce(duration_s, frames.cast("double") / F.greatest(fps, F.lit(1.0)))


def position_index(pos: Column, duration_s: Column, frames: Column, fps: Column) -> tuple[Column, Column]:
    """Start second and frame number of a relative position; 10 s when the length is unknown."""
    clamped = F.least(F.greatest(pos, F.lit(0.0)), F.lit(0.98))
    start = clamped * F.coalesce(duration_of(duration_s, frames, fps), F.lit(10.0))
    return start, F.round(start * fps).cast("long")


def round_up(v: Column, step: int) -> Column:
    return (F.ceil(v / F.lit(step)) * step).cast("int")


def inference_size(width: Column, height: Column, seg_width: int = P.SEG_WIDTH) -> tuple[Column, Column]:
    """Model input size: configured width and matching height, both rounded up to 32."""
    w = -(-max(seg_width, P.SEG_STRIDE) // P.SEG_STRIDE) * P.SEG_STRIDE
    h = F.greatest(F.floor(height.cast("long") * w / F.greatest(width, F.lit(1))), F.lit(P.SEG_STRIDE))
    return F.lit(w), round_up(h, P.SEG_STRIDE)
