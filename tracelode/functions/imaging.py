"""Geometry of screenshots as SQL expressions, and the pixel and recogniser kernels in numpy with Arrow wrappers.

Recognition models are not part of this package: the kernels take their inputs and outputs as arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import ship

#: Fixed values of preparation, detection and recognition.
MIN_WIDTH, MAX_SIDE, DARK_BELOW, TOP_BAR = 1200, 2400, 0.45, 0.06
STRETCH_LOW, STRETCH_HIGH = 32.0, 224.0
LUMA = (0.2126, 0.7152, 0.0722)
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
TEXT_ABOVE, BOX_ABOVE, UNCLIP, MIN_SIDE, MAX_BOXES = 0.3, 0.5, 1.5, 6, 150
LINE_HEIGHT, MIN_LINE_WIDTH, FLAT_RANGE, INK = 48, 8, 12, 64.0
BAND_PAD, BAND_MIN_WIDTH, BAND_MIN_HEIGHT, AVATAR_SHARE, BAND_LINES = 8, 40, 12, 0.12, 3
DATE_HINT = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b|[0-9]{1,2}[:/.-][0-9]|\b(am|pm)\b"

# --- geometry -----------------------------------------------------------------------------------------------------


def _round(x: Column) -> Column:
    return F.floor(x + 0.5)


def target_size(w: Column, h: Column) -> Column:
    """struct(w, h) to which an image is scaled: at least MIN_WIDTH wide, then at most MAX_SIDE long; zeros for no size."""
    up = F.greatest(F.lit(1.0), F.lit(float(MIN_WIDTH)) / w)
    down = F.least(F.lit(1.0), F.lit(float(MAX_SIDE)) / (F.greatest(w, h) * up))
    side = lambda x: F.greatest(F.lit(1), _round(x * up * down)).cast("int")
    real = F.coalesce((w > 0) & (h > 0) & ~F.isnan(w.cast("double")) & ~F.isnan(h.cast("double")), F.lit(False))
    return F.when(real, F.struct(side(w).alias("w"), side(h).alias("h"))).otherwise(F.struct(F.lit(0).alias("w"), F.lit(0).alias("h")))


def should_invert(luminance: Column) -> Column:
    return F.coalesce(~F.isnan(luminance) & (luminance < DARK_BELOW), F.lit(False))


def top_cut(h: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.floor(h * TOP_BAR)), F.lit(0)).cast("int")


def clamp_byte(v: Column) -> Column:
    return F.when(F.isnan(v.cast("double")) | v.isNull(), 0).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), _round(v)))).cast("int")


def stretched(v: Column, low: float = STRETCH_LOW, high: float = STRETCH_HIGH) -> Column:
    return clamp_byte((v - low) * 255.0 / (high - low)) if high > low else clamp_byte(v)


def preparation(w: Column, h: Column, luminance: Column, low: float = STRETCH_LOW, high: float = STRETCH_HIGH) -> Column:
    """struct of the whole plan for an image."""
    size = target_size(w, h)
    return F.struct(w.alias("src_w"), h.alias("src_h"), size["w"].alias("target_w"), size["h"].alias("target_h"), should_invert(luminance).alias("invert"), top_cut(size["h"]).alias("top_cut"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def to_source(box: Column, w: Column, h: Column, cut: Column) -> Column:
    """A box of the prepared, cut image as shares of the source image."""
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))
    x, y = unit(box["x"] / w), unit((box["y"] + cut) / h)
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(0.0), F.least(unit(box["w"] / w), 1 - x)).alias("w"), F.greatest(F.lit(0.0), F.least(unit(box["h"] / h), 1 - y)).alias("h"))


def in_unit_square(box: Column) -> Column:
    """Whether an overlay box can be drawn over the source."""
    return F.coalesce((box["x"] >= 0) & (box["y"] >= 0) & (box["w"] > 0) & (box["h"] > 0) & (box["x"] + box["w"] <= 1) & (box["y"] + box["h"] <= 1), F.lit(False))


def band_box(boxes: Column, w: Column, h: Column) -> Column:
    """The padded box around boxes, within the image; null if it is too small to read again."""
    edge = lambda pick, f: pick(F.transform(boxes, f))
    x0 = F.greatest(F.lit(0.0), F.floor(edge(F.array_min, lambda b: b["x"]) - BAND_PAD).cast("double"))
    y0 = F.greatest(F.lit(0.0), F.floor(edge(F.array_min, lambda b: b["y"]) - BAND_PAD).cast("double"))
    x1 = F.least(w.cast("double"), F.ceil(edge(F.array_max, lambda b: b["x"] + b["w"]) + BAND_PAD).cast("double"))
    y1 = F.least(h.cast("double"), F.ceil(edge(F.array_max, lambda b: b["y"] + b["h"]) + BAND_PAD).cast("double"))
    return F.when((x1 - x0 >= BAND_MIN_WIDTH) & (y1 - y0 >= BAND_MIN_HEIGHT), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def header_band(lines: Column, w: Column, h: Column) -> Column:
    """Where the name and handle stand: around the first lines, without the avatar's column. ``lines``: array of struct(text, bbox)."""
    head = F.slice(F.filter(lines, lambda x: F.trim(x["text"]) != ""), 1, BAND_LINES)
    band = band_box(F.transform(head, lambda x: x["bbox"]), w, h)
    left = F.greatest(band["x"], w * AVATAR_SHARE)
    width = band["x"] + band["w"] - left
    return F.when(width >= BAND_MIN_WIDTH, F.struct(left.alias("x"), band["y"].alias("y"), width.alias("w"), band["h"].alias("h")))


def date_band(lines: Column, w: Column, h: Column) -> Column:
    """Around the bottommost line that looks like a timestamp."""
    last = F.try_element_at(F.filter(lines, lambda x: x["text"].rlike(DATE_HINT)), F.lit(-1))
    return F.when(last.isNotNull(), band_box(F.array(last["bbox"]), w, h))


def merged_band(lines: Column, band: Column, again: Column) -> Column:
    """Lines with those whose middle lies in ``band`` replaced by ``again`` (top-down, left to right), if that is read with more confidence."""
    within = lambda x: (x["bbox"]["x"] + x["bbox"]["w"] / 2).between(band["x"], band["x"] + band["w"]) & (x["bbox"]["y"] + x["bbox"]["h"] / 2).between(band["y"], band["y"] + band["h"])
    mean = lambda rows: F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size(rows)
    old = F.filter(lines, within)
    wins = (F.size(old) > 0) & (F.size(again) > 0) & (mean(again) > mean(old))
    first = F.array_position(F.transform(lines, within), True).cast("int")
    before = F.slice(lines, F.lit(1), first - 1)
    after = F.filter(lines, lambda x, i: (i >= first) & ~within(x))
    in_order = F.array_sort(again, lambda a, b: F.when(a["bbox"]["y"] != b["bbox"]["y"], F.signum(a["bbox"]["y"] - b["bbox"]["y"])).otherwise(F.signum(a["bbox"]["x"] - b["bbox"]["x"])).cast("int"))
    return F.when(wins, F.concat(before, in_order, after)).otherwise(lines)


# --- pixels -------------------------------------------------------------------------------------------------------


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Of pixels (..., 3), 0 to 255."""
    return rgb[..., :3].astype(np.float64) @ np.array(LUMA)


def mean_luminance(rgb: np.ndarray, every: int = 7) -> float:
    """0 to 1, of every seventh pixel each way."""
    part = luminance(rgb[::every, ::every])
    return float(part.mean() / 255) if part.size else 0.0


def prepared_gray(rgb: np.ndarray, invert: bool, cut: int, low: float = STRETCH_LOW, high: float = STRETCH_HIGH) -> np.ndarray:
    """Grey, inverted if dark, stretched, without the status bar."""
    v = luminance(rgb)
    v = 255 - v if invert else v
    out = np.clip(np.floor((v - low) * 255 / (high - low) + 0.5), 0, 255).astype(np.uint8)
    return out[max(0, min(cut, len(out) - 1)) :]


def padded_32(n: int) -> int:
    return max(32, -(-n // 32) * 32)


def _normalised(rgb: np.ndarray) -> np.ndarray:
    """Pixels (h, w, 3) as planes (3, h, w), each channel normalised."""
    return ((rgb[..., :3] / 255 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)).transpose(2, 0, 1).astype(np.float32)


def detector_input(rgb: np.ndarray) -> np.ndarray:
    """(1, 3, H, W) with sides padded with zeros to multiples of 32."""
    h, w = rgb.shape[:2]
    out = np.zeros((1, 3, padded_32(h), padded_32(w)), dtype=np.float32)
    out[0, :, :h, :w] = _normalised(rgb)
    return out


def _labels(mask: np.ndarray) -> np.ndarray:
    """Components of the true pixels that touch by a side: each gets the least index among its pixels, others the size of the mask.

    Minima spread along runs of rows and columns in turn, so a component settles in about as many rounds as it has bends.
    """
    none = mask.size
    label = np.where(mask, np.arange(none).reshape(mask.shape), none)
    while True:
        before = label
        for axis in (0, 1):
            lane = label if axis else label.T
            on = (mask if axis else mask.T).ravel()
            start = on & ~np.concatenate([[False], on[:-1]])
            start |= on & (np.arange(on.size) % lane.shape[1] == 0)
            if not start.any():
                return label
            run = np.cumsum(start) - 1
            least = np.minimum.reduceat(np.where(on, lane.ravel(), none), np.flatnonzero(start))
            lane = np.where(on, least[np.maximum(run, 0)], none).reshape(lane.shape)
            label = lane if axis else lane.T
        if np.array_equal(before, label):
            return label


def text_boxes(probability: np.ndarray) -> list[tuple[float, float, float, float, float]]:
    """(x, y, w, h, score) of the text areas of a probability map (h, w), the largest first: components above the threshold, widened by area over outline."""
    h, w = probability.shape
    label = _labels(probability > TEXT_ABOVE)
    out = []
    for k in np.unique(label[label < label.size]):
        ys, xs = np.nonzero(label == k)
        x0, x1, y0, y1, n = xs.min(), xs.max(), ys.min(), ys.max(), len(xs)
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        score = float(probability[ys, xs].mean())
        if min(bw, bh) < MIN_SIDE or score < BOX_ABOVE:
            continue
        d = n * UNCLIP / max(1, 2 * (bw + bh))
        left, top = max(0.0, x0 - d), max(0.0, y0 - d)
        out.append((left, top, min(float(w), x1 + d + 1) - left, min(float(h), y1 + d + 1) - top, score))
    return sorted(out, key=lambda b: -b[2] * b[3])[:MAX_BOXES]


def reading_order(boxes: list[tuple]) -> list[tuple]:
    """Boxes row by row: a box joins the first row whose first box has its middle near, by 0.6 of the median height or 4."""
    if not boxes:
        return []
    near = max(4.0, 0.6 * sorted(b[3] for b in boxes)[len(boxes) // 2])
    rows: list[list[tuple]] = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        row = next((r for r in rows if abs(b[1] + b[3] / 2 - r[0][1] - r[0][3] / 2) <= near), None)
        if row is None:
            rows.append([b])
        else:
            row.append(b)
    return [b for row in rows for b in sorted(row, key=lambda b: b[0])]


def resized(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(m) + 0.5) * n / m - 0.5
        low = np.clip(np.floor(at).astype(int), 0, n - 1)
        return low, np.minimum(low + 1, n - 1), np.clip(at - low, 0, 1)

    (y0, y1, fy), (x0, x1, fx) = axis(rgb.shape[0], h), axis(rgb.shape[1], w)
    fy, fx = fy[:, None, None], fx[None, :, None]
    top = rgb[y0][:, x0] * (1 - fx) + rgb[y0][:, x1] * fx
    return top * (1 - fy) + (rgb[y1][:, x0] * (1 - fx) + rgb[y1][:, x1] * fx) * fy


def ink_threshold(values: np.ndarray) -> int:
    """The grey level (0 to 255) that parts levels into two classes with the greatest variance between them."""
    count = np.bincount(values.ravel().astype(np.int64), minlength=256).astype(np.float64)
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    between[(below == 0) | (above == 0)] = -1
    return int(np.argmax(between)) if between.max() >= 0 else 128


def recogniser_input(rgb: np.ndarray, box: tuple, height: int = LINE_HEIGHT) -> np.ndarray:
    """(1, 3, height, width) of a box: ink and ground spread apart around the box's own threshold, scaled to one height."""
    x, y, w, h = box[:4]
    x0, y0 = max(0, int(np.floor(x))), max(0, int(np.floor(y)))
    crop = rgb[y0 : max(y0 + 1, int(np.ceil(y + h))), x0 : max(x0 + 1, int(np.ceil(x + w))), :3].astype(np.float64)
    levels = np.clip(np.floor(luminance(crop) + 0.5), 0, 255)
    low, high = levels.min(), levels.max()
    if high - low >= FLAT_RANGE:
        cut = ink_threshold(levels)
        crop = np.where(crop <= cut, INK * (crop - low) / max(1.0, cut - low), 255 - INK * (high - crop) / max(1.0, high - cut))
    width = max(MIN_LINE_WIDTH, -(-height * crop.shape[1] // crop.shape[0]))
    return _normalised(resized(crop, width, height))[None]


def decode_line(scores: np.ndarray, characters: list[str]) -> tuple[str, float]:
    """Text and mean confidence (0 to 100) of a recogniser's scores (steps, classes): the best class of each step, repeats as one, class 0 for none.

    Scores may be probabilities or not. One class more than there are characters is the space.
    """
    if not scores.size:
        return "", 0.0
    best, top = scores.argmax(axis=1), scores.max(axis=1)
    if abs(scores[0].sum() - 1) < 0.05:
        p = np.clip(top, 0, 1)
    else:
        p = 1 / np.exp(scores - top[:, None]).sum(axis=1)
    signs = ["", *characters, " "] if scores.shape[1] >= len(characters) + 2 else ["", *characters]
    fresh = (best != 0) & (best != np.concatenate([[-1], best[:-1]])) & (best < len(signs))
    return "".join(signs[k] for k in best[fresh]), float(p[fresh].mean() * 100) if fresh.any() else 0.0


def decoded(scores: Column, classes: Column, characters: list[str]) -> Column:
    """struct(text, confidence) of flat arrays of scores."""
    ship()
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])

    @F.pandas_udf(kind)
    def run(flat: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_line(np.asarray(x, dtype=np.float64).reshape(-1, int(k)), characters) for x, k in zip(flat, n)], columns=kind.names)

    return run(scores, classes)


def boxes_of(probability: Column, width: Column) -> Column:
    """array of struct(x, y, w, h, score) of flat probability maps, in reading order."""
    ship()
    kind = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "w", "h", "score")]))

    @F.pandas_udf(kind)
    def run(flat: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("x", "y", "w", "h", "score"), map(float, b))) for b in reading_order(text_boxes(np.asarray(x, dtype=np.float64).reshape(-1, int(k))))] for x, k in zip(flat, w)], dtype=object)

    return run(probability, width)
