"""A social feed: joins, searches, counters, policies and writes over plain tables.

profiles(id, username, ...), highlights(id, author_id, caption, tags, created_at, ...),
likes(user_id, highlight_id), comments(id, highlight_id, author_id, ...),
follows(follower_id, following_id), user_blocks(blocker_id, blocked_id),
polls(id, highlight_id), poll_options(id, poll_id, sort_order, ...),
poll_votes(poll_id, option_id, user_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = 20


def page(rows: DataFrame, *order: Column | str, first: int = 0, last: int = PAGE - 1) -> DataFrame:
    """Rows first to last, both included, of a total order."""
    return rows.orderBy(*order).offset(first).limit(last - first + 1)


def newest(highlights: DataFrame, number: int = 0, size: int = PAGE) -> DataFrame:
    return page(highlights, F.desc("created_at"), "id", first=number * size, last=number * size + size - 1)


def with_author(highlights: DataFrame, profiles: DataFrame) -> DataFrame:
    """highlights with `author`, the profile as a struct; null where there is none."""
    author = profiles.select(F.col("id").alias("author_key"), F.struct("*").alias("author"))
    return highlights.join(author, F.col("author_id") == F.col("author_key"), "left").drop("author_key")


def with_poll(highlights: DataFrame, polls: DataFrame, options: DataFrame) -> DataFrame:
    """highlights with `poll`, a struct whose options are sorted by place and id; null where there is none."""
    rest = [c for c in options.columns if c not in ("poll_id", "sort_order", "id")]
    listed = options.groupBy(F.col("poll_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sort_order", "id", *rest))).alias("options"))
    full = polls.join(listed, "id", "left")
    return highlights.join(full.select(F.col("highlight_id").alias("poll_key"), F.struct(*full.columns).alias("poll")), F.col("id") == F.col("poll_key"), "left").drop("poll_key")


def followed_by(follows: DataFrame, user: str | int) -> DataFrame:
    return follows.where(F.col("follower_id") == user).select(F.col("following_id").alias("id"))


def following_feed(highlights: DataFrame, follows: DataFrame, user: str | int, number: int = 0) -> DataFrame:
    """The newest of those whom the user follows; nobody followed, nothing shown."""
    return newest(highlights.join(followed_by(follows, user).withColumnRenamed("id", "author_id"), "author_id", "left_semi"), number)


def without_blocked(shown: DataFrame, blocks: DataFrame, user: str | int) -> DataFrame:
    """Applied to a page that is already cut, so pages may come up short."""
    return shown.join(blocks.where(F.col("blocker_id") == user).select(F.col("blocked_id").alias("author_id")), "author_id", "left_anti")


def people(follows: DataFrame, profiles: DataFrame, user: str | int, followers: bool) -> DataFrame:
    """Profiles of the user's followers, or of those followed, by id."""
    own, other = ("following_id", "follower_id") if followers else ("follower_id", "following_id")
    ids = follows.where(F.col(own) == user).select(F.col(other).alias("id"))
    return profiles.join(ids, "id", "left_semi").orderBy("id")


def single(rows: DataFrame) -> DataFrame:
    """rows, which must be exactly one."""
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError("no row where one is wanted" if n == 0 else "several rows where one is wanted")
    return rows


def touch(rows: DataFrame, changed: DataFrame, key: str, now: Column) -> DataFrame:
    """rows(key, updated_at, ...) with `updated_at` set to now where changed(key) names them."""
    hit = changed.select(key).distinct().withColumn("is_changed", F.lit(True))
    return rows.join(hit, key, "left").withColumn("updated_at", F.when(F.col("is_changed"), now).otherwise(F.col("updated_at"))).drop("is_changed")


def is_following(ids: DataFrame, follows: DataFrame, user: str | int) -> DataFrame:
    """ids(id) with whether the user follows each."""
    mine = followed_by(follows, user).distinct().withColumn("hit", F.lit(True))
    return ids.join(mine, "id", "left").select("id", F.col("hit").isNotNull().alias("is_following"))


def my_votes(shown: DataFrame, votes: DataFrame, user: str | int) -> DataFrame:
    """shown(poll_id, ...) with the option that the user chose, if any; one join instead of a query a row."""
    mine = votes.where(F.col("user_id") == user).select("poll_id", F.col("option_id").alias("my_option"))
    return shown.join(mine, "poll_id", "left")


def search_highlights(highlights: DataFrame, term: str) -> DataFrame:
    """By caption or place in any case, or by an exact tag."""
    clean = T.search_term(term)
    like = F.lit(f"%{clean}%")
    return highlights.where(F.ilike(F.col("caption"), like) | F.array_contains("tags", clean) | F.ilike(F.col("location_name"), like))


def search_people(profiles: DataFrame, term: str) -> DataFrame:
    """The term's own % and _ stay wildcards."""
    return profiles.where(F.ilike(F.col("username"), F.lit(f"%{term}%"))).orderBy("id").limit(PAGE)


def trending(highlights: DataFrame, latest: int = 50, top: int = 12) -> DataFrame:
    """The commonest tags of the latest posts; a tag twice in a post counts twice."""
    tags = highlights.orderBy(F.desc("created_at"), "id").limit(latest).select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(top)


# ------------------------------------------------------------------ counters

def recount(base: DataFrame, base_key: str, rows: DataFrame, row_key: str, name: str) -> DataFrame:
    """base with the number of rows per key as `name`."""
    n = rows.groupBy(F.col(row_key).alias("counted")).agg(F.count("*").alias(name))
    return base.drop(name).join(n, F.col(base_key) == F.col("counted"), "left").drop("counted").fillna(0, [name])


def apply_changes(counters: DataFrame, changes: DataFrame, key: str, name: str, clamp: bool = True) -> DataFrame:
    """counters after changes(key, delta); summed up per key before they meet the counters.

    clamp: none falls below 0 — after all of a batch, where single steps would have
    been held one by one.
    """
    delta = changes.groupBy(key).agg(F.sum("delta").alias("delta"))
    moved = F.col(name) + F.coalesce("delta", F.lit(0))
    return counters.join(delta, key, "left").withColumn(name, F.greatest(F.lit(0), moved) if clamp else moved).drop("delta")


# ------------------------------------------------------------------ writes

def _one_a_key(rows: DataFrame, *keys: str) -> DataFrame:
    """Of several rows of a key the one whose other columns, in their order, are greatest; these must have an order (no maps)."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def insert_new(table: DataFrame, rows: DataFrame, *unique: str) -> tuple[DataFrame, DataFrame]:
    """The table with rows whose key is new, and the rows that were refused.  A key with a null is always new."""
    whole = F.lit(True)
    for c in unique:
        whole = whole & F.col(c).isNotNull()
    keyed, loose = _one_a_key(rows.where(whole), *unique), rows.where(~whole)
    known = table.select(*unique)
    return table.unionByName(keyed.join(known, list(unique), "left_anti").select(*table.columns)).unionByName(loose.select(*table.columns)), keyed.join(known, list(unique), "left_semi")


def upsert(table: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows update `columns` of known keys and are added otherwise; of several for a key the greatest holds."""
    new = _one_a_key(rows, key)
    fresh = new.select(F.col(key).alias("new_key"), F.lit(True).alias("is_new"), *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = table.join(fresh, F.col(key) == F.col("new_key"), "left")
    kept = joined.select(*[(F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)) for c in table.columns])
    return kept.unionByName(new.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def delete_where_in(table: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    return table.join(keys.select(*columns), list(columns), "left_anti")


def record_flags(flags: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(user_id, local_video_id, reason, flag_count, flag_events) after flags(user_id, local_video_id, seq, reason, events).

    The first flag of a video gives the reason; each adds at least 1, or its number of
    events, and appends these in order.  A null video never meets another.
    """
    rows = flags.withColumn("n", F.greatest(F.size("events"), F.lit(1)).cast("long"))
    if table is not None:
        old = table.select("user_id", "local_video_id", F.lit(-1).cast("long").alias("seq"), "reason", F.col("flag_events").alias("events"), F.col("flag_count").alias("n"))
        rows = old.unionByName(rows)
    alone = F.when(F.col("local_video_id").isNull(), F.struct("seq", "user_id")).otherwise(F.lit(None))
    summed = rows.withColumn("alone", alone).groupBy("user_id", "local_video_id", "alone").agg(
        F.min_by("reason", "seq").alias("reason"), F.sum("n").alias("flag_count"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "events"))), lambda x: x["events"])).alias("flag_events")
    )
    return summed.drop("alone")


def new_profiles(profiles: DataFrame, accounts: DataFrame) -> DataFrame:
    """profiles with one for each of accounts(id, full_name) that has none."""
    made = accounts.select("id", F.coalesce("full_name", F.lit("Volleyball Player")).alias("display_name"), F.concat(F.lit("user_"), F.substring("id", 1, 8)).alias("username"))
    return profiles.unionByName(made.dropDuplicates(["id"]).join(profiles.select("id"), "id", "left_anti"), allowMissingColumns=True)


def cascade(tables: dict[str, DataFrame], name: str, gone: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables after rows of `name` with gone(id) went, and all that hang on them.

    links: (parent, its key, child, the child's column).
    """
    out = dict(tables)
    todo = [(name, "id", gone)]
    while todo:
        table, key, keys = todo.pop(0)
        lost = out[table].join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")
        out[table] = out[table].join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti")
        todo += [(child, column, lost.select(parent_key)) for parent, parent_key, child, column in links if parent == table]
    return out


# ------------------------------------------------------------------ policies

def own(column: str):
    return lambda user: F.col(column) == user


#: Rows that a user may see or delete, and rows that a user may write, by table; missing: nobody.
POLICIES = {
    ("profiles", "select"): lambda user: F.lit(True),
    ("profiles", "update"): own("id"),
    **{(t, "select"): lambda user: F.lit(True) for t in ("highlights", "likes", "comments", "follows", "polls", "poll_options", "poll_votes")},
    **{(t, v): own(c) for t, c in (("highlights", "author_id"), ("comments", "author_id"), ("likes", "user_id"), ("follows", "follower_id"), ("poll_votes", "user_id"), ("user_blocks", "blocker_id"), ("contributions", "user_id")) for v in ("insert", "delete")},
    ("content_reports", "insert"): own("reporter_id"),
    ("content_reports", "select"): own("reporter_id"),
    ("user_blocks", "select"): own("blocker_id"),
    ("contributions", "select"): own("user_id"),
    ("moderation_actions", "select"): own("target_user_id"),
}


def secure(rows: DataFrame, table: str, verb: str, user: str | int, highlights: DataFrame | None = None, polls: DataFrame | None = None) -> DataFrame:
    """The rows that the user may use.  Polls and options are for the author of their highlight to write."""
    if verb == "insert" and table in ("polls", "poll_options"):
        mine = highlights.where(F.col("author_id") == user).select(F.col("id").alias("highlight_id"))
        if table == "poll_options":
            return rows.join(polls.join(mine, "highlight_id", "left_semi").select(F.col("id").alias("poll_id")), "poll_id", "left_semi")
        return rows.join(mine, "highlight_id", "left_semi")
    policy = POLICIES.get((table, verb))
    return rows.where(policy(user) if policy else F.lit(False))


def stored_objects(objects: DataFrame, user: str) -> DataFrame:
    """Objects whose first folder is the user's."""
    return objects.where(F.split("name", "/")[0] == user)


def violations(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all checks, and the others with the names of those they break.  A null result keeps a check."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in checks.items()]))
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def checks_of(table: str) -> dict[str, Column]:
    """Checks that rows of a table keep."""
    return {
        "profiles": lambda: {"privacy_level": F.col("privacy_level").isin("public", "followers_only", "private")},
        "follows": lambda: {"no_self_follow": F.col("follower_id") != F.col("following_id")},
        "user_blocks": lambda: {"no_self_block": F.col("blocker_id") != F.col("blocked_id")},
        "contributions": lambda: {"trigger_type": F.col("trigger_type").isin("low_score", "user_removed", "user_trimmed", "reported")},
    }.get(table, dict)()


def is_blocked(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(blocker_id, blocked_id) with whether the block exists."""
    known = blocks.select("blocker_id", "blocked_id", F.lit(True).alias("hit")).distinct()
    return pairs.join(known, ["blocker_id", "blocked_id"], "left").withColumn("is_blocked", F.col("hit").isNotNull()).drop("hit")
