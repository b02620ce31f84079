"""Labels and references of a book: duplicates, missing targets, groups, candidates, edits and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.similarity import near_keys_by_deletions
from ..session import cut_lineage


def targets_of(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("category") == "label")


def references_of(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("category") == "reference")


def target_counts(symbols: DataFrame) -> DataFrame:
    return targets_of(symbols).groupBy("book_id", "key").agg(F.count("*").alias("n_targets"))


def duplicate_labels(symbols: DataFrame) -> DataFrame:
    return target_counts(symbols).filter(F.col("n_targets") > 1)


def resolve(symbols: DataFrame) -> DataFrame:
    """References with the number of targets of their key. Targets are counted before the join, so a hot key is one row."""
    return (
        references_of(symbols)
        .join(target_counts(symbols), ["book_id", "key"], "left")
        .withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))
        .withColumn("resolved", F.col("n_targets") == 1)
    )


def missing_refs(symbols: DataFrame) -> DataFrame:
    keys = targets_of(symbols).select("book_id", "key").distinct()
    return references_of(symbols).join(keys, ["book_id", "key"], "left_anti")


def symbol_summary(symbols: DataFrame) -> DataFrame:
    """Per book: labels, references, resolved, duplicate keys and unresolved references, in one pass over keys."""
    is_label = F.col("category") == "label"
    keys = symbols.groupBy("book_id", "key").agg(
        F.count_if(is_label).alias("labels"), F.count_if(~is_label).alias("refs")
    )
    return keys.groupBy("book_id").agg(
        F.sum("labels").alias("labels"),
        F.sum("refs").alias("references"),
        F.sum(F.when(F.col("labels") == 1, F.col("refs")).otherwise(0)).alias("resolved"),
        F.count_if(F.col("labels") > 1).alias("duplicate_keys"),
        F.sum(F.when(F.col("labels") != 1, F.col("refs")).otherwise(0)).alias("unresolved"),
    )


def symbol_cube(symbols: DataFrame) -> DataFrame:
    """Counts per book and kind with all subtotals."""
    return symbols.cube("book_id", "kind").agg(
        F.count_if(F.col("category") == "label").alias("labels"),
        F.count_if(F.col("category") == "reference").alias("references"),
        F.grouping("book_id").alias("all_books"), F.grouping("kind").alias("all_kinds"),
    )


# --- groups -----------------------------------------------------------------


def group_keys(symbols: DataFrame, phase: str) -> DataFrame:
    """Keys of each group: duplicate keys share the group of their namespace, a missing key is its own group."""
    if phase == "duplicates":
        keys = duplicate_labels(symbols).select("book_id", "key", X.key_namespace(F.col("key")).alias("grp"))
    else:
        keys = missing_refs(symbols).select("book_id", "key", F.col("key").alias("grp")).distinct()
    return keys


def reference_groups(symbols: DataFrame, phase: str) -> DataFrame:
    """One row per group: an id from its keys, and how many references, targets and editable labels it owns.

    The members stay rows (`group_members`): a hot key must not become one array.
    """
    keys = group_keys(symbols, phase)
    counts = symbols.groupBy("book_id", "key").agg(
        F.count_if(F.col("category") == "reference").alias("refs"), F.count_if(F.col("category") == "label").alias("labels"),
    )
    owned = keys.join(counts, ["book_id", "key"], "left")
    grouped = owned.groupBy("book_id", "grp").agg(
        X.set_digest(F.col("key")).alias("_digest"),
        F.count("*").alias("keys"), F.sum("refs").alias("references"), F.sum("labels").alias("editable_labels"),
    )
    named = grouped.withColumn("group_id", F.concat(F.lit(f"reference-{phase}-"), F.substr("_digest", F.lit(1), F.lit(16)))).drop("_digest")
    if phase == "duplicates":
        evidence = targets_of(symbols).groupBy("book_id", X.key_namespace(F.col("key")).alias("grp")).agg(F.count("*").alias("targets"))
        return named.join(evidence, ["book_id", "grp"], "left")
    return named.withColumn("editable_labels", F.lit(0).cast("bigint"))


def group_members(symbols: DataFrame, phase: str) -> DataFrame:
    """Every occurrence of a group with its role: reference, label (writable) or evidence (read only)."""
    # Read four times below. Keys compress so well that they look small enough to be broadcast.
    keys = cut_lineage(group_keys(symbols, phase)).hint("merge")
    own = symbols.join(keys, ["book_id", "key"]).select(
        "book_id", "grp", "id", "key",
        F.when(F.col("category") == "label", "label").otherwise("reference").alias("role"),
    )
    if phase != "duplicates":
        return own
    groups = keys.select("book_id", "grp").distinct()
    others = (
        targets_of(symbols).join(keys.select("book_id", "key").hint("merge"), ["book_id", "key"], "left_anti")
        .withColumn("grp", X.key_namespace(F.col("key"))).join(groups, ["book_id", "grp"], "left_semi")
        .select("book_id", "grp", "id", "key", F.lit("evidence").alias("role"))
    )
    return own.unionByName(others)


def _pool(frame: DataFrame) -> DataFrame:
    return frame.withColumn("pool_family", X.family(X.key_kind(F.col("key")))).withColumn(
        "pool_number", X.normal_number(X.key_number(F.col("key"))))


def candidate_pools(symbols: DataFrame) -> DataFrame:
    """Members of every candidate pool: missing keys and the targets of the same family and normalised number.

    A missing key and a target are candidates of each other exactly when they share (book, family, number). The pool
    says so with one row per member instead of one row per pair.
    """
    wanted = _pool(missing_refs(symbols).select("book_id", "key").distinct())
    pools = wanted.select("book_id", "pool_family", "pool_number").distinct()
    offered = _pool(targets_of(symbols)).join(pools, ["book_id", "pool_family", "pool_number"], "left_semi")
    return offered.select("book_id", "pool_family", "pool_number", F.lit("target").alias("role"), "id", "key").unionByName(
        wanted.select("book_id", "pool_family", "pool_number", F.lit("missing").alias("role"), F.lit(None).cast("string").alias("id"), "key"))


def candidate_counts(symbols: DataFrame) -> DataFrame:
    """Number of candidate targets and of their distinct keys for every missing key."""
    wanted = _pool(missing_refs(symbols).select("book_id", "key").distinct())
    offered = (
        _pool(target_counts(symbols)).groupBy("book_id", "pool_family", "pool_number")
        .agg(F.sum("n_targets").alias("candidates"), F.count("*").alias("candidate_keys"), F.min("key").alias("first_key"))
    )
    return (
        wanted.join(offered, ["book_id", "pool_family", "pool_number"], "left")
        .select("book_id", "key", F.coalesce("candidates", F.lit(0)).alias("candidates"),
                F.coalesce("candidate_keys", F.lit(0)).alias("candidate_keys"), "first_key")
    )


def near_keys(symbols: DataFrame, n: int = P.NEAR_KEY_COUNT, cutoff: float = P.NEAR_KEY_CUTOFF) -> DataFrame:
    """The `n` most similar target keys of the same family for every missing key, by matching-block ratio."""
    wanted = missing_refs(symbols).select("book_id", "key").distinct()
    offered = targets_of(symbols).select("book_id", "key").distinct()
    blocked = lambda f: f.withColumn("family", X.family(X.key_kind(F.col("key"))))
    return near_keys_by_deletions(cut_lineage(blocked(wanted)), cut_lineage(blocked(offered)), n, cutoff)


def open_headings(members: DataFrame, scoped: DataFrame) -> DataFrame:
    """Ids of the headings that some occurrence of a group lies under, each once.

    Members of one scope may share the id of one row of `scoped`; only ids of headings leave it.
    """
    opened = scoped.select("book_id", "id", F.col("scope.id").alias("_open"))
    return members.select("book_id", "grp", "id").distinct().join(opened, ["book_id", "id"]).select(
        "book_id", "grp", F.explode("_open").alias("id")).distinct()


def scope_headings(members: DataFrame, scoped: DataFrame, headings: DataFrame) -> DataFrame:
    """Headings that some occurrence of a group lies under."""
    return open_headings(members, scoped).join(headings, ["book_id", "id"])


def targets_in_lines(reads: DataFrame, symbols: DataFrame) -> DataFrame:
    """Targets on the lines of a read; `symbols` carries `line`, and an end of 0 reads to the end of the page."""
    wanted = reads.select("book_id", "page", "read_id", "start_line", "end_line")
    end = F.when(F.col("end_line") == 0, F.lit(2147483647)).otherwise(F.col("end_line"))
    return (
        targets_of(symbols).join(wanted, ["book_id", "page"])
        .filter((F.col("line") >= F.col("start_line")) & (F.col("line") <= end))
        .select("read_id", "book_id", "page", "id", "line")
    )


def targets_seen(hits: DataFrame, views: DataFrame, symbols: DataFrame) -> DataFrame:
    """Targets known from a hit by id or from a viewed page."""
    targets = targets_of(symbols)
    by_id = targets.join(hits.select("book_id", "id").distinct(), ["book_id", "id"], "left_semi")
    by_page = targets.join(views.select("book_id", "page").distinct(), ["book_id", "page"], "left_semi")
    return by_id.select("book_id", "id").union(by_page.select("book_id", "id")).distinct()


def grow_known(known: DataFrame, found: DataFrame) -> DataFrame:
    return known.select("book_id", "id").union(found.select("book_id", "id")).distinct()


# --- edits ------------------------------------------------------------------


def check_edits(edits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edits with the first rule each breaks, or null: unknown id, repeated id, bad key, changed kind or number.

    `edits` has book_id, category (label or reference), id and the new key. Both sides of the joins grow with the corpus,
    but their size is guessed from compressed files, so hints keep them from being broadcast.
    """
    repeats = edits.groupBy("book_id", "category", "id").agg(F.count("*").alias("_times"))
    known = symbols.select("book_id", "category", "id", F.col("key").alias("old_key"), "page", "command", "start", "end")
    joined = edits.join(repeats.hint("merge"), ["book_id", "category", "id"]).join(known.hint("merge"), ["book_id", "category", "id"], "left")
    return joined.withColumn(
        "problem",
        F.when(F.col("old_key").isNull(), "unknown_id")
        .when(F.col("_times") > 1, "repeated_id")
        .when(~F.col("key").rlike("(?U)^(?:" + P.KEY_NAME + r")\z"), "bad_key")
        .when((F.col("category") == "label") & (X.key_namespace(F.col("key")) != X.key_namespace(F.col("old_key"))), "changed_kind_or_number"),
    ).drop("_times")


def key_counts_after(symbols: DataFrame, edits: DataFrame) -> DataFrame:
    """Targets per key if the label edits were made: one less for the old key, one more for the new one."""
    now = targets_of(symbols).groupBy("book_id", "key").agg(F.count("*").alias("d"))
    changes = edits.filter(F.col("category") == "label").join(
        targets_of(symbols).select("book_id", "id", F.col("key").alias("old_key")), ["book_id", "id"])
    less = changes.groupBy("book_id", F.col("old_key").alias("key")).agg((-F.count("*")).alias("d"))
    more = changes.groupBy("book_id", "key").agg(F.count("*").alias("d"))
    return now.unionByName(less).unionByName(more).groupBy("book_id", "key").agg(F.sum("d").alias("n_targets"))


def deferrable(symbols: DataFrame, edits: DataFrame) -> DataFrame:
    """References in duplicate groups that the label edits leave without any target and that are not edited.

    Only groups with writable labels qualify, and every duplicate key is writable in its own group.
    """
    keys = group_keys(symbols, "duplicates").select("book_id", "key")
    empty = key_counts_after(symbols, edits).filter(F.col("n_targets") == 0).select("book_id", "key")
    edited = edits.filter(F.col("category") == "reference").select("book_id", "id")
    return (
        references_of(symbols).join(keys, ["book_id", "key"], "left_semi").join(empty, ["book_id", "key"], "left_semi")
        .join(edited, ["book_id", "id"], "left_anti").select("book_id", "id", "key")
    )


def check_unconfirmed(items: DataFrame, symbols: DataFrame, edits: DataFrame, deferrable_ids: DataFrame) -> DataFrame:
    """Unconfirmed references with the code of the rule they break, or null.

    `items` has book_id, id, reason and bibliography (which of the two lists it came from). Only a missing or
    deferrable, unedited occurrence of the right kind, listed once and with a reason, may stay unconfirmed.
    """
    refs = references_of(symbols).select("book_id", "id", "key", "kind")
    has_target = targets_of(symbols).select("book_id", "key").distinct().withColumn("_target", F.lit(True))
    edited = edits.filter(F.col("category") == "reference").select("book_id", "id").distinct().withColumn("_edited", F.lit(True))
    later = deferrable_ids.select("book_id", "id").distinct().withColumn("_later", F.lit(True))
    times = items.groupBy("book_id", "id").agg(F.count("*").alias("_times"))
    no = F.lit(False)
    joined = (
        items.join(times, ["book_id", "id"]).join(refs, ["book_id", "id"], "left").join(has_target, ["book_id", "key"], "left")
        .join(edited, ["book_id", "id"], "left").join(later, ["book_id", "id"], "left")
    )
    bad = (
        F.col("kind").isNull()
        | ((F.col("kind") == "bibliography") != F.col("bibliography"))
        | (F.coalesce("_target", no) & ~F.coalesce("_later", no))
        | F.coalesce("_edited", no) | (F.col("_times") > 1) | X.is_blank(F.col("reason"))
    )
    code = F.when(F.col("bibliography"), "BIBLIOGRAPHY_REVIEW").otherwise("REFERENCE_REVIEW")
    return joined.select("book_id", "id", "bibliography", "reason", F.when(bad, code).alias("problem"))


def check_group(symbols: DataFrame, edits: DataFrame, pending: DataFrame, phase: str = "duplicates") -> DataFrame:
    """Problems that remain in each group after its edits.

    References: the new key must have exactly one target and the group must know it; otherwise the reason says
    ambiguous_target, missing_target or target_not_in_context. Labels: an edited group label must be unique. Edits of
    occurrences that no group owns are reported too.
    """
    members = group_members(symbols, phase)
    counts = key_counts_after(symbols, edits)
    new_keys = edits.select("book_id", "id", F.col("key").alias("_new"))
    after = members.join(new_keys, ["book_id", "id"], "left").withColumn("new_key", F.coalesce("_new", "key"))
    supported = after.filter(F.col("role") != "reference").select("book_id", "grp", "new_key").distinct().withColumn("_known", F.lit(True))
    counted = after.join(counts.withColumnRenamed("key", "new_key"), ["book_id", "new_key"], "left").withColumn(
        "n_targets", F.coalesce("n_targets", F.lit(0)))
    refs = (
        counted.filter(F.col("role") == "reference").join(supported, ["book_id", "grp", "new_key"], "left")
        .join(pending.select("book_id", "id").distinct(), ["book_id", "id"], "left_anti")
        .withColumn("reason", F.when(F.col("n_targets") > 1, "ambiguous_target").when(F.col("n_targets") == 0, "missing_target")
                    .when(F.col("_known").isNull(), "target_not_in_context"))
    )
    labels = counted.filter((F.col("role") == "label") & (F.col("n_targets") != 1)).withColumn("reason", F.lit("duplicate_label"))
    strays = (
        edits.join(members.filter(F.col("role") != "evidence").select("book_id", "id").distinct(), ["book_id", "id"], "left_anti")
        .select("book_id", F.lit(None).cast("string").alias("grp"), "id", F.col("key").alias("new_key"), F.lit("not_owned").alias("reason"))
    )
    out = ["book_id", "grp", "id", "new_key", "reason"]
    return refs.filter(F.col("reason").isNotNull()).select(*out).unionByName(labels.select(*out)).unionByName(strays)


def group_resolved(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """A group is resolved when each of its keys has one target, or no reference uses the key any more."""
    is_label = F.col("category") == "label"
    counts = symbols.groupBy("book_id", "key").agg(F.count_if(is_label).alias("t"), F.count_if(~is_label).alias("r"))
    keys = members.filter(F.col("role") == "reference").select("book_id", "grp", "key").distinct()
    groups = members.select("book_id", "grp").distinct()
    judged = keys.join(counts, ["book_id", "key"], "left").groupBy("book_id", "grp").agg(
        F.bool_and((F.coalesce("t", F.lit(0)) == 1) | (F.coalesce("r", F.lit(0)) == 0)).alias("ok"))
    # A group without references is not resolved.
    return groups.join(judged, ["book_id", "grp"], "left").select("book_id", "grp", F.coalesce("ok", F.lit(False)).alias("resolved"))


def owned(edits: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits inside and outside what the groups may write."""
    writable = members.filter(F.col("role") != "evidence").select("book_id", "id").distinct()
    return edits.join(writable, ["book_id", "id"], "left_semi"), edits.join(writable, ["book_id", "id"], "left_anti")


def stale_edits(edits: DataFrame, snapshot: DataFrame, current: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Edits whose page layout, or whose occurrence's key, differs between snapshot and current pages.

    `before` and `after` are symbol indexes; pages carry book_id, page, tex. Each side grows with the corpus, but its
    size is guessed from compressed files, so hints keep all four from being broadcast at once.
    """
    was = snapshot.select("book_id", "page", F.sha2(X.layout(F.col("tex")), 256).alias("_was"))
    now = current.select("book_id", "page", F.sha2(X.layout(F.col("tex")), 256).alias("_now"))
    old = before.select("book_id", "id", "page", F.col("key").alias("_old_key"))
    new = after.select("book_id", "id", F.col("key").alias("_new_key"))
    joined = edits.join(old.hint("merge"), ["book_id", "id"], "left").join(new.hint("merge"), ["book_id", "id"], "left")
    joined = joined.join(was.hint("merge"), ["book_id", "page"], "left").join(now.hint("merge"), ["book_id", "page"], "left")
    stale = ~F.col("_was").eqNullSafe(F.col("_now")) | F.col("_new_key").isNull() | ~F.col("_old_key").eqNullSafe(F.col("_new_key"))
    return joined.withColumn("stale", stale).drop("_was", "_now", "_old_key", "_new_key", "page")
