"""Reviewing: view filters, counts, labels, decisions, settings and presets as folds of event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIEWS = ("all", "blurry", "eyes", "duplicates", "keepers", "rejects")


def decide(log: DataFrame) -> DataFrame:
    """Decisions after a log (path, seq, decision): the same decision again removes it, another replaces it.

    What was before another decision does not matter, so the last run of equal decisions tells all: an odd number of them
    stays. The run begins after the last event of another decision. Aggregates only, which merge before they meet."""
    last = log.groupBy("path", "decision").agg(F.max("seq").alias("seq"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq"), F.desc("decision")))
    two = last.withColumn("_n", nth).where("_n <= 2").groupBy("path")
    ends = two.agg(*[F.max(F.when(F.col("_n") == n, F.struct("seq", "decision"))).alias(c) for n, c in ((1, "_last"), (2, "_other"))])
    e = F.struct("seq", "decision")
    run = log.join(ends, "path").where((F.col("decision") == F.col("_last.decision")) & (F.col("_other").isNull() | (e > F.col("_other"))))
    left = run.groupBy("path").agg(F.first("_last.decision").alias("decision"), F.count("*").alias("_m"))
    return left.where("_m % 2 = 1").select("path", "decision")


def view(photos: DataFrame, decisions: DataFrame, kind: str) -> DataFrame:
    """photos (with is_blurry, both_closed, cluster) of a view, with their decision."""
    d = photos.join(decisions, "path", "left")
    keep = {
        "all": F.lit(True), "blurry": F.col("is_blurry"), "eyes": F.coalesce("both_closed", F.lit(False)),
        "duplicates": F.col("cluster").isNotNull(), "keepers": F.col("decision") == "keep", "rejects": F.col("decision") == "reject",
    }
    if kind not in keep:
        raise ValueError(f"unknown view {kind}")
    return d.where(keep[kind])


def counts(photos: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: photos of each view; rejects and keepers count all stored decisions."""
    p = photos.agg(
        F.count("*").alias("all"), F.count_if("is_blurry").alias("blurry"), F.count_if(F.coalesce("both_closed", F.lit(False))).alias("eyes"),
        F.count("cluster").alias("duplicates"),
    )
    d = decisions.agg(F.count_if(F.col("decision") == "keep").alias("keepers"), F.count_if(F.col("decision") == "reject").alias("rejects"))
    both = p.crossJoin(d)  # one row each
    done = F.col("keepers") + F.col("rejects")
    return both.withColumn("progress", F.when(F.col("all") == 0, 0.0).otherwise(done / F.col("all")))


def labels(is_blurry: Column, both_closed: Column, cluster: Column) -> Column:
    made = F.array(
        F.when(is_blurry, "Blurry"), F.when(F.coalesce(both_closed, F.lit(False)), "Eyes shut"), F.when(cluster.isNotNull(), F.concat(F.lit("Duplicate "), cluster.cast("string")))
    )
    return F.array_compact(made)


def eyes_verdict(eyes_known: Column, both_closed: Column) -> Column:
    return F.when(~eyes_known, "no face").when(both_closed, "closed").otherwise("open")


def eyes_verdict_fine(eyes_known: Column, both: Column, any_: Column) -> Column:
    return F.when(~eyes_known, "no face detected").when(both, "BOTH CLOSED").when(any_, "one closed").otherwise("open")


def presets(log: DataFrame) -> DataFrame:
    """Presets after a log (seq, op, name, params): save upserts by trimmed name (empty names fail) and keeps the
    place; delete takes the exact name; a save after a delete starts a new place."""
    d = log.withColumn("key", F.when(F.col("op") == "save", F.trim("name")).otherwise(F.col("name"))).where("op <> 'save' or key <> ''")
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy("key"))
    live = d.withColumn("gone", gone).where("op = 'save' and (gone is null or seq > gone)")
    return live.groupBy(F.col("key").alias("name")).agg(F.max_by("params", "seq").alias("params"), F.min("seq").alias("position"))


def with_defaults(photos: DataFrame, settings: DataFrame, defaults: dict) -> DataFrame:
    """photos with each setting, or its default where the path has none."""
    d = photos.join(settings, "path", "left")
    return d.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def sync_to_all(selects: DataFrame, current: dict) -> DataFrame:
    """Every parameter of one photo, geometry included, for all selects; retouch is not copied."""
    return selects.withColumns({k: F.lit(v) for k, v in current.items()})


def apply_preset(settings: DataFrame, preset: dict, geometry: tuple = ("straighten", "crop_x", "crop_y", "crop_w", "crop_h")) -> DataFrame:
    """The preset's look on each photo's own geometry."""
    return settings.withColumns({k: F.lit(v) for k, v in preset.items() if k not in geometry})


def blur_verdict(face_blurry: Column, frame_blurry: Column) -> Column:
    return F.coalesce(face_blurry, frame_blurry)


def stamps(points: DataFrame, spacing: float = 0.6) -> DataFrame:
    """Brush points (stroke, seq, x, y, r) that lie spacing * r or more from the last kept one, in order."""
    all_ = F.sort_array(F.collect_list(F.struct("seq", "x", "y", "r")))

    def step(acc, p):
        last = F.element_at(acc, -1)
        near = F.sqrt(F.pow(p["x"] - last["x"], 2) + F.pow(p["y"] - last["y"], 2)) < spacing * p["r"]
        return F.when((F.size(acc) > 0) & near, acc).otherwise(F.array_append(acc, p))

    d = points.groupBy("stroke").agg(all_.alias("p"))
    first = F.slice("p", 1, 1)
    kept = F.aggregate(F.slice("p", F.lit(2), F.size("p")), first, step)
    return d.select("stroke", F.explode(kept).alias("s")).select("stroke", "s.seq", "s.x", "s.y", "s.r")


def undo_stroke(heals: Column) -> Column:
    return F.slice(heals, F.lit(1), F.greatest(F.size(heals) - 1, F.lit(0)))
