"""Exports: a plan of actions and names that needs no file system, then a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, file_name, stem
from ..types import QUALITY_EXPORT
from . import groups


def named(path: Column) -> Column:
    """Whether a path ends in a file name."""
    return ~file_name(path).isin("", "..")


def skipped(items: DataFrame) -> DataFrame:
    """The items (path, position) without a file name, which ``plan`` leaves out, as failures (position, ok, error)."""
    text = F.concat(F.lit("skipped (no file name): "), F.coalesce("path", F.lit("")))
    return items.where(~F.coalesce(named(F.col("path")), F.lit(False))).select(F.col("position").cast("long").alias("position"), F.lit(False).alias("ok"), text.alias("error"))


def plan(items: DataFrame, corrected: bool, prefix: str | None = None, start: int = 1, watermark: bool = False) -> DataFrame:
    """source, action (render or copy) and base_name of items (path, position from 0, noop, retouch_empty).

    Numbers follow the item's position, so skipped items leave gaps; what is rendered is a jpg."""
    path = F.col("path")
    edit = F.lit(corrected) & (~F.col("noop") | ~F.col("retouch_empty"))
    render = edit | F.lit(watermark)
    raw_ext = F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1)
    ext = F.when(render | (raw_ext == ""), "jpg").otherwise(raw_ext)
    if prefix is not None and prefix.strip():
        name = F.format_string("%s_%03d.%s", F.lit(prefix), (F.col("position") + start).cast("long"), ext)
    else:
        name = F.when(render, F.concat(stem(path), F.lit(".jpg"))).otherwise(file_name(path))
    return items.where(named(path)).select(path.alias("source"), "position", F.when(render, "render").otherwise("copy").alias("action"), edit.alias("edited"), name.alias("base_name"))


def ending(name: Column) -> Column:
    """The last point and what follows it; a leading point alone makes no ending."""
    return F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)


def suffixed(name: Column, n: Column) -> Column:
    """``name`` for 0, else ``stem (n).ext``."""
    return F.when(n == 0, name).otherwise(F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(" ("), n.cast("string"), F.lit(")"), ending(name)))


def _with_parent(d: DataFrame, name: str) -> DataFrame:
    """d with parent and number of a column of names."""
    stem_ = F.regexp_replace(F.col(name), r"(?<=.)\.[^.]*$", "")
    base, n = F.regexp_extract(stem_, r"^(.+) \([1-9]\d{0,17}\)$", 1), F.regexp_extract(stem_, r"^.+ \(([1-9]\d{0,17})\)$", 1)
    return d.withColumns({"parent": F.when(base != "", F.concat(base, ending(F.col(name)))), "number": F.when(base != "", n).cast("long")})


def unique_names(planned: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """planned with target: in item order each takes the first free of name, ``stem (1).ext`` and so on; no two targets are equal,
    and none is a name of ``existing``.

    A name can be claimed by its own base's first item and, with its number, by the base that it is made of (its parent).
    Whoever comes first has it: the parent if its item that reaches the number stands before. That item's index
    is the number less the numbers below it that are taken otherwise, which depends on lower claims only, so claims are decided in
    rounds until none changes. Then the k-th item of a base has the k-th number that is left, by a running count of the taken
    numbers. Windows run by base and stream; nothing is gathered."""
    items = planned.select(F.col("position").cast("long").alias("position"), F.col("base_name").alias("base"))
    items = groups.written(items.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("position")) - 1))
    if existing is None:
        taken = items.sparkSession.createDataFrame([], "base string, number long")
    else:
        names = _with_parent(existing.select("name").distinct(), "name")
        taken = names.select(F.col("name").alias("base"), F.lit(0).cast("long").alias("number"))
        taken = groups.written(taken.unionAll(names.where("parent is not null").select(F.col("parent").alias("base"), "number")).distinct())
    bases = _with_parent(items.groupBy("base").agg(F.min("position").alias("first")), "base")
    there = bases.select(F.col("base").alias("_b"))
    rivals = bases.where("parent is not null").join(there, F.col("parent") == F.col("_b"), "left_semi")
    # names that exist are nobody's
    rivals = groups.written(rivals.join(taken.where("number = 0").select(F.col("base").alias("_t")), F.col("base") == F.col("_t"), "left_anti"))
    claims = rivals.select("base", F.lit(True).alias("own"))
    if rivals.head(1):
        below = Window.partitionBy("parent").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
        both = rivals.select("parent", "number", "base", "first").unionAll(taken.select(F.col("base").alias("parent"), "number", F.lit(None).alias("base"), F.lit(None).alias("first")))
        counted = both.withColumn("gone", F.coalesce(F.sum(F.col("base").isNull().cast("long")).over(below), F.lit(0)))
        fixed = groups.written(counted.where("base is not null"))
        at = items.select(F.col("base").alias("_b"), F.col("k").cast("long").alias("_k"), "position")
        while True:
            d = fixed.join(claims, "base")
            d = d.withColumn("before", F.coalesce(F.sum(F.col("own").cast("long")).over(below), F.lit(0)))
            lost = claims.where("not own").select(F.col("base").alias("_l"), F.lit(1).alias("shift"))
            d = d.join(lost, F.col("parent") == F.col("_l"), "left")
            index = F.col("number") - F.col("gone") - F.col("before") - F.coalesce("shift", F.lit(0))
            d = d.withColumn("_i", index).join(at, (F.col("parent") == F.col("_b")) & (F.col("_i") == F.col("_k")), "left")
            new = groups.written(d.select("base", F.coalesce(F.col("position") > F.col("first"), F.lit(True)).alias("own"), (F.col("own") != F.coalesce(F.col("position") > F.col("first"), F.lit(True))).alias("changed")))
            claims = new.select("base", "own")
            if not new.where("changed").head(1):
                break
    decided = rivals.join(claims, "base")
    shut = taken.unionAll(decided.select(F.when(F.col("own"), F.col("parent")).otherwise(F.col("base")).alias("base"), F.when(F.col("own"), F.col("number")).otherwise(0).alias("number")))
    # numbers left below each taken one: items of that index and later are moved on by it
    shut = shut.withColumn("k", F.col("number") - F.row_number().over(Window.partitionBy("base").orderBy("number")) + 1)
    marks = shut.select("base", "k", F.lit(1).alias("gone"), F.lit(None).cast("long").alias("position"))
    marks = marks.unionAll(items.select("base", F.col("k").cast("long"), F.lit(0), "position"))
    moved = F.sum("gone").over(Window.partitionBy("base").orderBy("k", F.desc("gone")).rowsBetween(Window.unboundedPreceding, 0))
    out = marks.withColumn("n", F.col("k") + moved).where("position is not null")
    out = out.select("position", suffixed(F.col("base"), F.col("n")).alias("target"))
    return planned.join(out, "position")


def summary(results: DataFrame) -> DataFrame:
    """copied and the errors in item order of rows (position, ok, error)."""
    errors = F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("position", "error")))), lambda s: s["error"])
    return results.agg(F.count_if("ok").alias("copied"), errors.alias("errors"))


def position(where: Column, w: Column, h: Column, ew: Column, eh: Column, margin: Column) -> Column:
    """Top left corner of a watermark; unknown places are bottomRight."""
    left, top, right, bottom = margin, margin, w - ew - margin, h - eh - margin
    half = lambda a: F.when(a < 0, F.ceil(a / 2)).otherwise(F.floor(a / 2)).cast("int")
    x = F.when(where.isin("topLeft", "bottomLeft"), left).when(where == "center", half(w - ew)).otherwise(right)
    y = F.when(where.isin("topLeft", "topRight"), top).when(where == "center", half(h - eh)).otherwise(bottom)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def fit_aspect(x: Column, y: Column, w: Column, h: Column, ratio: Column) -> Column:
    """A rectangle shrunk to a ratio around its centre and pushed into the frame."""
    nw, nh = F.when(w / h > ratio, h * ratio).otherwise(w), F.when(w / h > ratio, h).otherwise(w / ratio)
    cx, cy = x + w / 2.0, y + h / 2.0
    return F.struct(clamp(cx - nw / 2.0, 0.0, 1.0 - nw).alias("x"), clamp(cy - nh / 2.0, 0.0, 1.0 - nh).alias("y"), nw.alias("w"), nh.alias("h"))


def locked(mode: str, start: tuple, edges: tuple, ratio: Column) -> tuple:
    """Edges (left, top, right, bottom) of a drag brought to a ratio of width to height; start: x, y, w, h before.

    A corner's width sets its height, and what then leaves the frame is cut, top, bottom, left and right in
    turn, with the other side following. A side sets the other extent, centred and limited by the frame."""
    left, top, right, bottom = edges
    west, north = "w" in mode, "n" in mode
    if set(mode) & set("we") and set(mode) & set("ns"):

        def tall(l, t, r, b):
            return (l, b - (r - l) / ratio, r, b) if north else (l, t, r, t + (r - l) / ratio)

        def wide(l, t, r, b):
            return (r - (b - t) * ratio, t, r, b) if west else (l, t, l + (b - t) * ratio, b)

        e = tall(left, top, right, bottom)
        for side, limit, follow in ((1, 0.0, wide), (3, 1.0, wide), (0, 0.0, tall), (2, 1.0, tall)):
            over = e[side] < limit if limit == 0.0 else e[side] > limit
            cut = follow(*(F.lit(limit) if i == side else v for i, v in enumerate(e)))
            e = tuple(F.when(over, a).otherwise(b) for a, b in zip(cut, e))
        return e
    x, y, w, h = start
    if set(mode) & set("we"):
        mid = y + h / 2.0
        most = F.least(mid, 1.0 - mid) * 2.0
        tall_ = F.least((right - left) / ratio, most)
        width = F.when((right - left) / ratio > most, most * ratio).otherwise(right - left)
        return (right - width, mid - tall_ / 2.0, right, mid + tall_ / 2.0) if west else (left, mid - tall_ / 2.0, left + width, mid + tall_ / 2.0)
    mid = x + w / 2.0
    most = F.least(mid, 1.0 - mid) * 2.0
    wide_ = F.least((bottom - top) * ratio, most)
    height = F.when((bottom - top) * ratio > most, most / ratio).otherwise(bottom - top)
    return (mid - wide_ / 2.0, bottom - height, mid + wide_ / 2.0, bottom) if north else (mid - wide_ / 2.0, top, mid + wide_ / 2.0, top + height)


def drag(mode: str, x: Column, y: Column, w: Column, h: Column, dx: Column, dy: Column, least: float = 0.05, ratio: Column | None = None) -> Column:
    """A rectangle after a drag of ``mode``: move, or one or two of the letters n, s, w, e; ``ratio`` locks its shape."""
    if mode == "move":
        return F.struct(clamp(x + dx, 0.0, 1.0 - w).alias("x"), clamp(y + dy, 0.0, 1.0 - h).alias("y"), w.alias("w"), h.alias("h"))
    x1, y1, x2, y2 = x, y, x + w, y + h
    if "w" in mode:
        x1 = clamp(x + dx, 0.0, x2 - least)
    if "e" in mode:
        x2 = clamp(x + w + dx, x1 + least, 1.0)
    if "n" in mode:
        y1 = clamp(y + dy, 0.0, y2 - least)
    if "s" in mode:
        y2 = clamp(y + h + dy, y1 + least, 1.0)
    if ratio is not None and mode:
        x1, y1, x2, y2 = locked(mode, (x, y, w, h), (x1, y1, x2, y2), ratio)
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


# fixed values
ASPECTS = {"Free": None, "1:1": 1.0, "4:5": 0.8, "16:9": 16 / 9, "Original": None}


def aspect(choice: Column, width: Column, height: Column) -> Column:
    """The ratio of a choice in units of the frame (null: free), for a photo of that size."""
    r = F.when(choice == "Original", width / height)
    for name, value in ASPECTS.items():
        if value is not None:
            r = F.when(choice == name, F.lit(value)).otherwise(r)
    return r * height / width


def request(selects: DataFrame, rename: bool = False, prefix: str = "", start: int = 1, kind: str = "none", text: str = "", image: str | None = None) -> tuple[DataFrame, dict | None, dict | None]:
    """(items, naming, watermark) of an export: selects (path, with params and heals, null for none); a blank
    prefix renames nothing, and a watermark needs a text or an image."""
    naming = {"prefix": prefix.strip(), "start": start} if rename and prefix.strip() else None
    mark = {"kind": "text", "text": text.strip()} if kind == "text" and text.strip() else {"kind": "image", "image_path": image} if kind == "image" and image else None
    return selects, naming, mark


#: Bytes of a plan, edits and stamps included, up to which it is broadcast; larger plans are joined by shuffles.
FEW_BYTES = 32 << 20


def execute(planned: DataFrame, files: DataFrame, folder: str, mark: dict | None = None, overlay=None, font: bytes | None = None) -> DataFrame:
    """Carries out a plan (source, position, action, edited, target, params, heals) on files (path, content, width,
    height, data, error): copies bytes, or renders and encodes as JPEG. One row (position, ok, error) an item; a file
    that cannot be read or decoded is an error of its own and stops nothing. Only copies read contents, and only
    renders decode; a small plan is broadcast, so that neither is shuffled."""
    from ..sources import fonts, jpeg
    from ..sources.sink import write_files
    from . import kernels, render

    def run(batches):
        import pandas as pd

        letters = None if font is None else fonts.Font(font)
        for b in batches:
            for r in b.itertuples():
                body, error, a = None, None, kernels.array(r)
                if a is None:
                    error = f"{r.source}: {r.error or 'cannot decode'}"
                else:
                    try:
                        a = render.full(a, render._params(r), r.heals if r.heals is not None else ()) if r.edited else a
                        body = jpeg.encode(render.watermark(a, mark, overlay, letters), QUALITY_EXPORT)
                    except ValueError as e:
                        error = f"{r.source}: {e}"
                yield pd.DataFrame([(r.position, r.target, body, error)], columns=["position", "target", "content", "error"])

    planned = planned.withColumn("position", F.col("position").cast("long"))
    size = planned.agg(F.sum(F.octet_length(F.to_json(F.struct(*planned.columns))))).first()[0]
    few = F.broadcast if (size or 0) <= FEW_BYTES else lambda d: d
    f = files.withColumnRenamed("path", "source")
    schema = "position long, target string, content binary, error string"
    copies = f.select("source", "content").join(few(planned.where("action = 'copy'").select("source", "position", "target")), "source")
    copies = copies.select("position", "target", "content", F.when(F.col("content").isNull(), F.concat("source", F.lit(": cannot read"))).alias("error"))
    wanted = planned.where("action <> 'copy'").select("source", "position", "edited", "target", "params", "heals")
    renders = f.select("source", "width", "height", "data", "error").join(few(wanted), "source").mapInPandas(run, schema)
    lost = planned.join(f.select("source").distinct(), "source", "left_anti")
    lost = lost.select("position", "target", F.lit(None).cast("binary").alias("content"), F.concat("source", F.lit(": not found")).alias("error"))
    return write_files(copies.unionByName(renders).unionByName(lost), folder)


def status(copied: Column, folder: Column, errors: Column) -> Column:
    """What an export reports: one photo or many, and the first of its failures."""
    failed = F.when(F.size(errors) > 0, F.concat(F.lit(" — "), F.size(errors).cast("string"), F.lit(" failed ("), F.get(errors, F.lit(0)), F.lit(")"))).otherwise("")
    return F.concat(F.lit("Exported "), copied.cast("string"), F.lit(" photo"), F.when(copied == 1, "").otherwise("s"), F.lit(" to "), folder, failed)
