"""Review edits on states and segments, status changes and the index of accepted subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 5e-4
#: Review states and what may follow each.
TRANSITIONS = (("AUTO", "EDITED"), ("AUTO", "ACCEPTED"), ("AUTO", "REJECTED"), ("EDITED", "EDITED"), ("EDITED", "ACCEPTED"), ("EDITED", "REJECTED"))
PROTECTED = ("EDITED", "ACCEPTED")


def edit_pieces(edits: DataFrame, eps: float = 0.0) -> DataFrame:
    """(video_id, t, edit): from time ``t`` on the last edit that covers it, null where none does; edits are (video_id, edit_no, start_s, end_s, new_state).

    Only edits meet edits here, at most twice their number squared in a subject; rows and segments find their piece by a running window.
    """
    e = edits.where("start_s < end_s").select("video_id", "edit_no", (F.col("start_s") - eps).alias("e0"), (F.col("end_s") - eps).alias("e1"), "new_state")
    cuts = e.select("video_id", F.explode(F.array("e0", "e1")).alias("t")).distinct()
    own = e.withColumnRenamed("video_id", "e_id")
    over = cuts.join(own, (F.col("video_id") == F.col("e_id")) & (F.col("t") >= F.col("e0")) & (F.col("t") < F.col("e1")), "left")
    return over.groupBy("video_id", "t").agg(F.max_by("new_state", "edit_no").alias("edit"))


def _running(name: str, *order: str):
    """The last mark at or before a row; marks are structs, so a mark of null counts."""
    return F.last(name, ignorenulls=True).over(Window.partitionBy("video_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def apply_edits(states: DataFrame, edits: DataFrame, eps: float = EPSILON) -> DataFrame:
    """``states`` with state and source of the last edit that covers a row; edits are (video_id, edit_no, start_s, end_s, new_state).

    A row lies in an edit from start - eps up to, not including, end - eps. Rows are united with the pieces of the edits and take the last piece before them: one exchange,
    and no row is multiplied.
    """
    row = F.struct(*[F.col(c) for c in states.columns])
    rows = states.select("video_id", F.col("t_sec").alias("__t"), F.lit(1).alias("__kind"), row.alias("__row"))
    marks = edit_pieces(edits, eps).select("video_id", F.col("t").alias("__t"), F.lit(0).alias("__kind"), F.struct("edit").alias("__mark"))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("__now", _running("__mark", "__t", "__kind")["edit"]).where("__kind = 1")
    out = both.select("__row.*", "__now")
    edited = F.col("__now").isNotNull()
    return out.withColumn("state", F.coalesce("__now", "state")).withColumn("source", F.when(edited, "manual").otherwise(F.col("source"))).drop("__now")


def overlay_edits(segs: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments cut at edit borders, each piece with the last edit that covers it, neighbours of one state and source merged."""
    cuts = segs.select("video_id", F.explode(F.array("start_s", "end_s")).alias("t")).union(edits.select("video_id", F.explode(F.array("start_s", "end_s")).alias("t"))).distinct()
    seg = segs.select("video_id", F.col("start_s").alias("t"), F.lit(0).alias("kind"), F.col("end_s").alias("upto"), F.struct("start_s", "end_s", "state", "source").alias("seg"))
    edit = edit_pieces(edits).select("video_id", "t", F.lit(0).alias("kind"), F.struct("edit").alias("mark"))
    rows = cuts.withColumn("kind", F.lit(1)).unionByName(seg, allowMissingColumns=True).unionByName(edit, allowMissingColumns=True)
    rows = rows.withColumn("seg", _running("seg", "t", "kind", "upto")).withColumn("edit", _running("mark", "t", "kind", "upto")["edit"]).where("kind = 1")
    w = Window.partitionBy("video_id").orderBy("t")
    pieces = rows.withColumn("end", F.lead("t").over(w)).where((F.col("end") <= F.col("seg.end_s")) & (F.col("t") >= F.col("seg.start_s")))
    got = pieces.select("video_id", "t", "end", F.coalesce("edit", "seg.state").alias("state"), F.when(F.col("edit").isNotNull(), "manual").otherwise(F.col("seg.source")).alias("source"))
    change = F.coalesce((F.col("state") != F.lag("state").over(w)) | (F.col("source") != F.lag("source").over(w)) | (F.col("t") != F.lag("end").over(w)), F.lit(True))
    runs = got.withColumn("run", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("video_id", "run").agg(F.min("t").alias("start_s"), F.max("end").alias("end_s"), F.first("state").alias("state"), F.first("source").alias("source")).drop("run")


def check_edits(edits: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, edit_no, error) of edits that are not finite, not ordered, or cover no row."""
    finite = ~(F.isnan("start_s") | F.isnan("end_s") | F.col("start_s").isNull() | F.col("end_s").isNull())
    basic = F.when(~finite, "not finite").when(F.col("end_s") <= F.col("start_s"), "not ordered").when(F.col("start_s") < 0, "outside")
    checked = edits.withColumn("error", basic)
    t = frames.select(F.col("video_id").alias("f_id"), F.col("t_sec").alias("f_t"))
    inside = (F.col("video_id") == F.col("f_id")) & (F.col("f_t") >= F.col("start_s") - EPSILON) & (F.col("f_t") < F.col("end_s") - EPSILON)
    empty = checked.where("error is null").join(t, inside, "left_anti").withColumn("error", F.lit("covers no row"))
    return checked.where("error is not null").unionByName(empty).select("video_id", "edit_no", "error")


def allowed_transitions(changes: DataFrame) -> DataFrame:
    """``changes`` (video_id, old_status, new_status) with ``allowed``."""
    pairs = F.array([F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return changes.withColumn("allowed", F.array_contains(pairs, F.concat_ws(">", "old_status", "new_status")))


def pending(catalog: DataFrame, manifests: DataFrame, force: bool = False) -> DataFrame:
    """Catalog rows still to do: without a manifest, or failed; with ``force`` all whose review is not protected."""
    m = manifests.select(F.col("video_id").alias("m_id"), F.col("review_status").alias("m_status"), F.col("error").alias("m_error"))
    out = catalog.join(m, F.col("video_id") == F.col("m_id"), "left")
    free = ~F.coalesce(F.col("m_status").isin(*PROTECTED), F.lit(False))
    todo = free if force else F.col("m_id").isNull() | (F.col("m_error").isNotNull() & free)
    return out.where(todo).drop("m_id", "m_status", "m_error")


def upsert(existing: DataFrame, new: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows of ``new``, and those of ``existing`` with other keys."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def rebuild_index(manifests: DataFrame, previous: DataFrame, carried: list[str]) -> DataFrame:
    """Accepted manifests; workbook fields that a manifest lacks come from the previous index."""
    p = previous.select(F.col("video_id").alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in carried])
    out = manifests.where("review_status = 'ACCEPTED'").join(p, F.col("video_id") == F.col("p_id"), "left")
    for c in carried:
        out = out.withColumn(c, F.coalesce(c, f"p_{c}") if c in manifests.columns else F.col(f"p_{c}"))
    return out.drop("p_id", *[f"p_{c}" for c in carried])
