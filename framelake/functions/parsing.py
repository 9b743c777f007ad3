"""Column functions that read paths, names, labels and units; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raw label -> class; any other raw label is class 0.
RAW_LABELS = {0: 0, 50: 0, 255: 0, 5: 1, 11: 2, 12: 3, 13: 4, 21: 5, 22: 6, 23: 7, 24: 8, 25: 9, 31: 10, 32: 11, 33: 12}


def frame_id(path: Column) -> Column:
    """The number in frame_<number>_, null if there is none."""
    return F.regexp_extract(path, r"frame_(\d+)_", 1).try_cast("bigint")


def video_and_start(path: Column) -> tuple[Column, Column]:
    """Video name and first frame of a clip from .../video<n>/video<n>_<start>/...; null if either is missing."""
    video = F.nullif(F.regexp_extract(path, r"(video\d+)/", 1), F.lit(""))
    start = F.regexp_extract(path, r"video\d+_(\d+)/", 1).try_cast("bigint")
    return F.when(start.isNotNull(), video), F.when(video.isNotNull(), start)


def path_part(path: Column, from_end: int) -> Column:
    """A part of a path counted from its end (1: the file), null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def fold_id(name: Column) -> Column:
    """The digits at a name's end, 0 if there are none."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def video_or_unknown(name: Column) -> Column:
    return F.when(name.rlike(r"^video\d+$"), name).otherwise("unknown")


def raw_to_class(raw: Column, table: dict[int, int] = RAW_LABELS) -> Column:
    """Class of a raw label, 0 for unknown ones."""
    by = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(by, raw.cast("int")), F.lit(0))


def module_prefix(node: Column, depth: int) -> Column:
    """The first depth parts of a node's name."""
    return F.substring_index(node, "/", depth)


def without_suffix(node: Column, suffixes: tuple[str, ...]) -> Column:
    return F.regexp_replace(node, "(" + "|".join(suffixes) + ")$", "")


def parameter_key(key: Column) -> Column:
    """A parameter's key without the prefixes that wrappers put before it."""
    return F.regexp_replace(key, r"^(module\.|_orig_mod\.)", "")


def duration_text(us: Column) -> Column:
    """Microseconds in the unit that suits their size."""
    return F.when(us >= 1_000_000, F.format_string("%.2f s", us / 1e6)).when(us >= 1000, F.format_string("%.2f ms", us / 1e3)).otherwise(F.format_string("%.1f us", us.cast("double")))


def size_text(n: Column) -> Column:
    """Bytes in the unit that suits their number."""
    out = F.format_string("%.0f B", n.cast("double"))
    for unit, name in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")):
        out = F.when(n >= unit, F.format_string(f"%.2f {name}", n / F.lit(float(unit)))).otherwise(out)
    return out


def keyword_class(label: Column, keywords: dict[str, int]) -> Column:
    """The class of the first keyword that the lower-cased label contains, null if none."""
    out = F.lit(None).cast("int")
    for word, cls in reversed(keywords.items()):
        out = F.when(F.lower(label).contains(word), cls).otherwise(out)
    return out


def image_of_mask(mask_path: Column, mark: str = "_watershed_mask") -> Column:
    """The image's path beside a mask's."""
    return F.replace(mask_path, F.lit(mark), F.lit(""))


def truth_copy(video: Column, frame: Column, fold: Column) -> Column:
    """Where a truth image of a fold is copied to."""
    return F.format_string("GT_orig_%d/%s/frame_%06d_gt_idx.png", fold, video, frame)


def padded(size: Column, multiple: int) -> tuple[Column, Column]:
    """Pixels to add before and after a side so that multiple divides it."""
    more = F.pmod(-size, F.lit(multiple))
    return F.floor(more / 2).cast("int"), (more - F.floor(more / 2)).cast("int")


def probabilities(logits: Column) -> Column:
    """Softmax over an array of logits; the sigmoid where there is only one."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(logits) == 1, F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))).otherwise(F.transform(powers, lambda x: x / total))


def label_of(probs: Column, least: float = 0.5) -> Column:
    """The most probable class, ties to the lowest; of a single probability whether it is at least least."""
    return F.when(F.size(probs) == 1, (probs[0] >= least).cast("int")).otherwise((F.array_position(probs, F.array_max(probs)) - 1).cast("int"))


def mask_set(value: Column) -> Column:
    """Whether a mask's value, from 0 to 1, counts as set."""
    return F.coalesce(value > 0.5, F.lit(False))
