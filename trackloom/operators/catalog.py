"""A library of videos in folders whose hierarchy is their path.

videos(id, file_name, custom_name, folder_path, created_date, file_size, duration,
is_processed, original_video_id, processed_video_ids, ...), folders(path, name,
parent_path, created_date, modified_date, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def display_name() -> Column:
    return F.coalesce("custom_name", "file_name")


def with_counts(folders: DataFrame, videos: DataFrame) -> DataFrame:
    """folders with video_count and subfolder_count, counted anew."""
    v = videos.groupBy(F.col("folder_path").alias("path")).agg(F.count("*").alias("video_count"))
    s = folders.where("parent_path is not null").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("subfolder_count"))
    return folders.drop("video_count", "subfolder_count").join(v, "path", "left").join(s, "path", "left").fillna(0, ["video_count", "subfolder_count"])


def search(videos: DataFrame, query: str = "", extension: str | None = None, min_size: int | None = None, max_size: int | None = None, since: Column | None = None, until: Column | None = None, folder: str | None = None) -> DataFrame:
    """All given criteria together; limits are inclusive."""
    tests = [T.contains_any_case(F.col("file_name"), query) | T.contains_any_case(F.coalesce("custom_name", F.lit("")), query)] if query.strip() else []
    tests += [F.endswith(F.lower("file_name"), F.lit("." + extension.lower()))] if extension else []
    tests += [F.col("file_size") >= min_size] if min_size is not None else []
    tests += [F.col("file_size") <= max_size] if max_size is not None else []
    tests += [F.col("created_date") >= since] if since is not None else []
    tests += [F.col("created_date") <= until] if until is not None else []
    tests += [T.in_subtree(F.col("folder_path"), folder)] if folder is not None else []
    for test in tests:
        videos = videos.where(test)
    return videos


def ranked(videos: DataFrame, folders: DataFrame, query: str, by: str = "relevance") -> DataFrame:
    """Videos and folders that match, in one list (kind, id, name, score, created, modified, size, depth, count), sorted.

    Videos have no date of change, so their creation counts; folders have no size.
    Dates and sizes rise here, while browsing shows them falling.
    """
    v = search(videos, query).select(F.lit("video").alias("kind"), F.col("id").alias("id"), display_name().alias("name"), T.video_relevance(display_name(), F.col("file_name"), F.col("folder_path"), query).alias("score"), F.col("created_date").alias("created"), F.col("created_date").alias("modified"), F.col("file_size").alias("size"), T.depth(F.col("folder_path")).alias("depth"), F.lit(0).cast("long").alias("count"))
    f = folders.where(T.contains_any_case(F.col("name"), query)).select(F.lit("folder").alias("kind"), F.col("path").alias("id"), "name", T.folder_relevance(F.col("name"), F.col("video_count"), F.col("subfolder_count"), query).alias("score"), F.col("created_date").alias("created"), F.col("modified_date").alias("modified"), F.lit(0).cast("long").alias("size"), T.depth(F.col("path")).alias("depth"), F.col("video_count").alias("count"))
    orders = {"relevance": F.desc("score"), "name": F.asc(F.lower("name")), "created": F.asc("created"), "modified": F.asc("modified"), "size": F.asc("size"), "depth": F.asc("depth"), "count": F.desc("count")}
    return v.unionByName(f).orderBy(orders[by], "kind", "id")


def browse(videos: DataFrame, folder: str, by: str = "created", offset: int = 0, limit: int | None = None) -> DataFrame:
    """A folder's videos; dates and sizes fall, names rise in any case."""
    orders = {"created": F.desc("created_date"), "size": F.desc("file_size"), "name": F.asc(F.collate(display_name(), "UNICODE_CI"))}
    page = videos.where(F.col("folder_path") == folder).orderBy(orders[by], "id").offset(offset)
    return page if limit is None else page.limit(limit)


def facets(videos: DataFrame, now: Column, extension: str | None = None, period: str | None = None, bucket: str | None = None, depths: tuple[int, int] | None = None) -> DataFrame:
    """Videos by extension, day/week/month/year of now, size bucket and depth range."""
    if extension:
        videos = videos.where(F.endswith(F.lower("file_name"), F.lit("." + extension)))
    if period:
        videos = videos.where(T.same_period(F.col("created_date"), now, period))
    if bucket:
        videos = videos.where(T.size_bucket(F.col("file_size")) == bucket)
    if depths:
        videos = videos.where(T.depth(F.col("folder_path")).between(*depths))
    return videos


def folders_with(folders: DataFrame, videos: DataFrame, processed: bool) -> DataFrame:
    """Folders in which any video is, or is not, processed."""
    hit = videos.where(F.col("is_processed") == processed).select(F.col("folder_path").alias("path"))
    return folders.join(hit, "path", "left_semi")


def unprocessed(videos: DataFrame) -> DataFrame:
    """Videos that can be processed and of which no processed copy exists."""
    done = videos.where("original_video_id is not null").select(F.col("original_video_id").alias("id"))
    return videos.where("not is_processed and original_video_id is null").join(done, "id", "left_anti")


def missing(known: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Rows of known without a counterpart: orphans, stale entries, files to adopt."""
    return known.join(present.select(*keys), list(keys), "left_anti")


def existing(known: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    return known.join(present.select(*keys), list(keys), "left_semi")


def copies(videos: DataFrame) -> DataFrame:
    """(original_id, copy_id) from the arrays of processed copies; ids without a video are left out."""
    pairs = videos.select(F.col("id").alias("original_id"), F.explode("processed_video_ids").alias("copy_id"))
    return pairs.join(videos.select(F.col("id").alias("copy_id")), "copy_id", "left_semi").select("original_id", "copy_id")


def delete_videos(videos: DataFrame, ids: DataFrame) -> DataFrame:
    """Without ids(id), and without processed copies of deleted originals; a deleted copy leaves its original's array."""
    gone = ids.select("id").distinct()
    below = videos.join(gone, "id", "left_semi").select(F.explode("processed_video_ids").alias("id"))
    every = gone.union(below).distinct()
    left = videos.join(every, "id", "left_anti")
    kept = left.select("id", F.posexplode_outer("processed_video_ids").alias("place", "copy")).join(every.select(F.col("id").alias("copy"), F.lit(True).alias("is_gone")), "copy", "left").where("is_gone is null and copy is not null")
    arrays = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "copy"))), lambda x: x["copy"]).alias("kept_ids"))
    return left.join(arrays, "id", "left").withColumn("processed_video_ids", F.coalesce("kept_ids", F.array().cast("array<string>"))).drop("kept_ids")


def moved_path(path: Column, old: str, new: str) -> Column:
    """The path under its renamed folder; paths that only begin alike stay."""
    return F.when(path == old, F.lit(new)).when(F.startswith(path, F.lit(old + "/")), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def rename_folder(folders: DataFrame, videos: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    name = F.when(F.col("path") == old, F.lit(new.rsplit("/", 1)[-1])).otherwise(F.col("name"))
    f = folders.withColumns({"name": name, "parent_path": moved_path(F.col("parent_path"), old, new)}).withColumn("path", moved_path(F.col("path"), old, new))
    return f, videos.withColumn("folder_path", moved_path(F.col("folder_path"), old, new))


def move_folder(folders: DataFrame, videos: DataFrame, folder: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """Under another parent; into itself or below is an error."""
    if parent == folder or parent.startswith(folder + "/"):
        raise ValueError("a folder cannot move into itself")
    new = "/".join(x for x in (parent, folder.rsplit("/", 1)[-1]) if x)
    f, v = rename_folder(folders, videos, folder, new)
    return f.withColumn("parent_path", F.when(F.col("path") == new, F.lit(parent or None)).otherwise(F.col("parent_path"))), v


def delete_folder(folders: DataFrame, videos: DataFrame, folder: str, keep_videos: bool = False) -> tuple[DataFrame, DataFrame]:
    """Without the subtree; its videos go too, or move to the folder's parent."""
    left = folders.where(~T.in_subtree(F.col("path"), folder))
    inside = T.in_subtree(F.col("folder_path"), folder)
    if keep_videos:
        return left, videos.withColumn("folder_path", F.when(inside, F.lit(folder.rpartition("/")[0])).otherwise(F.col("folder_path")))
    return left, videos.where(~inside)


def move_videos(videos: DataFrame, folders: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """moves(id, target): videos where they now are, and the moves that failed with a reason."""
    known = videos.select("id").distinct().withColumn("has_video", F.lit(True))
    places = folders.select(F.col("path").alias("target")).union(videos.sparkSession.range(1).select(F.lit("").alias("target"))).distinct().withColumn("has_target", F.lit(True))
    checked = moves.dropDuplicates(["id"]).join(known, "id", "left").join(places, "target", "left")
    reason = F.when(F.col("has_video").isNull(), "no such video").when(F.col("has_target").isNull(), "no such folder")
    checked = checked.withColumn("reason", reason)
    good = checked.where("reason is null").select("id", "target")
    return videos.join(good, "id", "left").withColumn("folder_path", F.coalesce("target", "folder_path")).drop("target"), checked.where("reason is not null").select("id", "target", "reason")


def recents(rows: DataFrame, user: str, term: str, ts: str, most: int, any_case: bool = False) -> DataFrame:
    """Each user's latest distinct terms, newest first; of equal ones the last spelling."""
    from pyspark.sql import Window

    same = F.lower(term) if any_case else F.col(term)
    last = rows.withColumn("same", same).groupBy(user, "same").agg(F.max_by(term, ts).alias(term), F.max(ts).alias(ts))
    w = Window.partitionBy(user).orderBy(F.desc(ts), term)
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("same")


def apply_trims(segments: DataFrame, trims: DataFrame, saved: DataFrame, duration: Column, key: str = "video_id") -> DataFrame:
    """Saved segments with their trims (before, after: seconds added at the ends), within the duration; empty ones go."""
    own = segments.join(saved, [key, "seg_idx"], "left_semi").join(trims, [key, "seg_idx"], "left").fillna(0.0, ["before", "after"])
    cut = own.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - F.col("before")), "end": F.least(duration, F.col("end") + F.col("after"))})
    return cut.where("start < end")


def review_state(actions: DataFrame, key: str = "video_id") -> DataFrame:
    """saved, removed and favorited index sets after actions(key, seq, action, idx) in order.

    save, remove and favorite add; undo_* takes out of that set.  Removing takes an
    index out of saved and favorited, and undoing that does not bring them back.

    Of an index only the last action that touches a set counts for it, so no log is gathered.
    """
    last = lambda add, *drop: F.max(F.when(F.col("action").isin(add, *drop), F.struct("seq", "action")))["action"] == add
    ends = actions.groupBy(key, "idx").agg(
        last("save", "undo_save", "remove").alias("saved"), last("remove", "undo_remove", "save").alias("removed"), last("favorite", "undo_favorite", "remove").alias("favorited")
    )
    return ends.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col(c), F.col("idx")))).alias(c) for c in ("saved", "removed", "favorited")])


def free_names(wanted: DataFrame, folders: DataFrame) -> DataFrame:
    """wanted(parent_path, name) that no sibling has, in any case, after the names are cleaned."""
    clean = wanted.withColumn("same", F.lower(T.sanitized_folder_name(F.col("name"))))
    return clean.join(folders.select("parent_path", F.lower("name").alias("same")), ["parent_path", "same"], "left_anti").drop("same")


def search_here(videos: DataFrame, folders: DataFrame, folder: str, query: str) -> tuple[DataFrame, DataFrame]:
    """Matches among a folder's own videos and subfolders."""
    inside = F.coalesce("parent_path", F.lit("")) == folder
    return videos.where((F.col("folder_path") == folder) & (T.contains_any_case(display_name(), query) | T.contains_any_case(F.col("file_name"), query))), folders.where(inside & T.contains_any_case(F.col("name"), query))


def relative_path(path: Column, root: str) -> Column:
    """Below a library's root; the root itself is empty, and other paths are null."""
    return F.when(path == root, F.lit("")).when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30))


def full_path(path: Column, root: str) -> Column:
    return F.when(path == "", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), path))


def split_library(videos: DataFrame, saved: str = "saved", processed: str = "processed") -> DataFrame:
    """Paths moved under the root of saved or of processed videos; those that are there stay."""
    there = T.in_subtree(F.col("folder_path"), saved) | T.in_subtree(F.col("folder_path"), processed)
    moved = F.when(F.col("is_processed"), full_path(F.col("folder_path"), processed)).otherwise(full_path(F.col("folder_path"), saved))
    return videos.withColumn("folder_path", F.when(there, F.col("folder_path")).otherwise(moved))


def newest_files(files: DataFrame, ts: str) -> DataFrame:
    return files.orderBy(F.desc_nulls_last(ts), "name")
