"""Quality rules. Each returns violations (book_id, page, code, detail); `all_violations` unites them."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .markup import markers
from .references import duplicate_labels  # noqa: F401  (re-exported for rule authors)
from .scope import counter_closure

RULES: dict[str, Callable[..., DataFrame]] = {}


def register_rule(code: str, fn: Callable[..., DataFrame]) -> None:
    """Add a rule of one's own: a function from input tables to violations."""
    RULES[code] = fn


def run_rules(codes: list[str] | None = None, **tables: DataFrame) -> DataFrame:
    """Violations of all registered rules, or of those named, whose input tables are given by the names of their parameters."""
    found = []
    for code, rule in RULES.items():
        wanted = list(signature(rule).parameters)
        if (codes is None or code in codes) and all(w in tables for w in wanted):
            found.append(rule(*[tables[w] for w in wanted]))
    if not found:
        raise ValueError("no registered rule has all its tables")
    return all_violations(*found)


def _violation(rows: DataFrame, code: str | Column, detail: Column, page: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    page = F.col("page") if page is None else page
    return rows.select("book_id", page.cast("bigint").alias("page"), code.alias("code"), detail.cast("string").alias("detail"))


def all_violations(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def bounded(violations: DataFrame, n: int = P.MAX_DIAGNOSTICS) -> DataFrame:
    """First `n` violations per book and code, by page and detail, and whether there are more.

    The rank keeps at most n + 1 rows per group on the map side, so a rule that fires everywhere stays small.
    """
    order = Window.partitionBy("book_id", "code").orderBy("page", "detail")
    ranked = violations.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n + 1)
    kept = F.filter(F.array_sort(F.collect_list(F.struct("_n", "page", "detail"))), lambda v: v["_n"] <= n)
    return ranked.groupBy("book_id", "code").agg(
        F.transform(kept, lambda v: F.struct(v["page"].alias("page"), v["detail"].alias("detail"))).alias("errors"),
        (F.max("_n") > n).alias("has_more"))


def check_body(pages: DataFrame) -> DataFrame:
    """UNSAFE_TEX and BODY_REQUIRED."""
    hits = F.array_compact(F.array(
        F.when(F.contains("tex", F.lit("^^")) | F.col("tex").rlike(P.BODY_FORBIDDEN), "UNSAFE_TEX"),
        F.when(F.contains("tex", F.lit("\\begin{document}")) | F.contains("tex", F.lit("\\end{document}")), "BODY_REQUIRED"),
    ))
    rows = pages.select("book_id", "page", "tex", F.explode(hits).alias("_code"))
    detail = F.coalesce(F.nullif(F.regexp_extract("tex", P.BODY_FORBIDDEN, 0), F.lit("")), F.lit(""))
    return _violation(rows, F.col("_code"), F.when(F.col("_code") == "UNSAFE_TEX", detail).otherwise(""))


def check_public(setups: DataFrame) -> DataFrame:
    """UNSAFE_TEX and PREAMBLE_REQUIRED for shared definitions (`public_tex`)."""
    tex = F.col("public_tex")
    hits = F.array_compact(F.array(
        F.when(F.contains(tex, F.lit("^^")) | tex.rlike(P.PREAMBLE_FORBIDDEN), "UNSAFE_TEX"),
        F.when(F.contains(tex, F.lit("\\begin{document}")) | F.contains(tex, F.lit("\\end{document}")), "PREAMBLE_REQUIRED"),
    ))
    rows = setups.select("book_id", F.explode(hits).alias("_code"))
    return _violation(rows, F.col("_code"), F.lit(""), F.lit(None))


def check_manual_numbers(pages: DataFrame) -> DataFrame:
    rows = pages.filter(F.col("tex").rlike(P.MANUAL_NUMBERING))
    return _violation(rows, "AUTOMATIC_NUMBERING", F.regexp_extract("tex", P.MANUAL_NUMBERING, 0))


def page_coverage(returned: DataFrame, owned: DataFrame) -> DataFrame:
    """PAGE_COVERAGE: pages returned by a batch differ from the pages it owns, in number or order.

    Both have book_id, batch_no, ord (position in the list) and page.
    """
    a = returned.select("book_id", "batch_no", "ord", F.col("page").alias("_got"))
    b = owned.select("book_id", "batch_no", "ord", F.col("page").alias("_want"))
    rows = a.join(b, ["book_id", "batch_no", "ord"], "full").filter(~F.col("_got").eqNullSafe(F.col("_want")))
    per_batch = rows.groupBy("book_id", "batch_no").agg(F.min(F.coalesce("_want", "_got")).alias("page"))
    return _violation(per_batch, "PAGE_COVERAGE", F.col("batch_no"))


def check_ids(records: DataFrame) -> DataFrame:
    """INVALID_ID: an id used twice in a batch, across types too, or with characters that break a marker."""
    repeated = records.groupBy("book_id", "batch_no", "id").agg(F.count("*").alias("n"), F.min("page").alias("page")).filter(F.col("n") > 1)
    malformed = records.filter(~F.col("id").rlike("(?U)^(?:" + P.RECORD_ID + r")\z"))
    return _violation(repeated, "INVALID_ID", F.col("id")).unionByName(_violation(malformed, "INVALID_ID", F.col("id")))


def check_anchors(marks: DataFrame, records: DataFrame) -> DataFrame:
    """MISSING_ANCHOR: markers and records of a batch differ; PAGE_SCOPE: a record names a page outside its batch;
    ANCHOR_PAGE: the marker exists, but not on the page the record names.

    `marks` has book_id, batch_no, page, command, key; `records` has book_id, batch_no, page, command, id and
    in_batch, whether the page belongs to the batch.
    """
    keys = ["book_id", "batch_no", "command", "key"]
    used = marks.groupBy(*keys).agg(F.count("*").alias("_used"), F.min("page").alias("_p"))
    listed = records.withColumnRenamed("id", "key").groupBy(*keys).agg(F.count("*").alias("_listed"), F.min("page").alias("_q"))
    uneven = used.join(listed, keys, "full").filter(F.coalesce("_used", F.lit(0)) != F.coalesce("_listed", F.lit(0)))
    missing = _violation(uneven, "MISSING_ANCHOR", F.col("key"), F.coalesce("_q", "_p"))
    outside = _violation(records.filter(~F.col("in_batch")), "PAGE_SCOPE", F.col("id"))
    places = marks.select(*keys, "page").distinct()
    inside = records.filter(F.col("in_batch")).withColumnRenamed("id", "key")
    astray = inside.join(places, [*keys, "page"], "left_anti").join(used.select(*keys), keys, "left_semi")
    return missing.unionByName(outside).unionByName(_violation(astray, "ANCHOR_PAGE", F.col("key")))


def check_labels(symbols: DataFrame) -> DataFrame:
    return _violation(symbols.filter(~F.col("key").rlike("(?U)^(?:" + P.KEY_NAME + r")\z")), "LABEL_NAME", F.col("key"))


def valid_box(box: Column) -> Column:
    """Four finite numbers inside the unit square, left before right and top before bottom."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = (F.size(box) == 4) & finite & (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1)
    return F.coalesce(ok, F.lit(False))


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """Pixel rectangle, rounded half to even; null when it is smaller than a pixel."""
    x0, y0, x1, y1 = (F.bround(F.get(box, F.lit(i)) * d).cast("int") for i, d in enumerate((width, height, width, height)))
    return F.when(valid_box(box) & (x0 < x1) & (y0 < y1), F.array(x0, y0, x1, y1))


def check_boxes(assets: DataFrame) -> DataFrame:
    return _violation(assets.filter(~valid_box(F.col("bbox"))), "IMAGE_REGION", F.col("id"))


def repairable(assets: DataFrame, books: DataFrame) -> DataFrame:
    """Whether each asset has a known page and a valid box, so that it can be cut out again."""
    known = F.col("page").isNotNull() & F.col("page").between(F.lit(1), F.col("page_count")) & valid_box(F.col("bbox"))
    return assets.join(books.select("book_id", "page_count"), "book_id", "left").withColumn(
        "repairable", F.coalesce(known, F.lit(False))).drop("page_count")


def check_counters(rules: DataFrame, seeds: DataFrame, setups: DataFrame) -> DataFrame:
    """COUNTER_RULE: repeated rule or seed, a level the class lacks, an impossible share, or a cycle.

    `rules` are a book's own, in the order `ord`; of repeated rules the last one holds. Cycles are looked for in the
    effective rules, reached from the book's own names.
    """
    from .scope import effective_rules

    twice = rules.groupBy("book_id", "name").agg(F.count("*").alias("n")).filter(F.col("n") > 1).withColumn("_d", F.concat(F.lit("repeated rule "), "name"))
    classed = rules.join(setups.select("book_id", "documentclass"), "book_id")
    article = F.col("documentclass") == "article"
    level = classed.filter(
        ((F.col("reset_by") == F.col("name")) & (F.col("name") != "")) | (article & ((F.col("reset_by") == "chapter") | (F.col("name") == "chapter")))
    ).withColumn("_d", F.concat(F.lit("level of "), "name"))
    shares = rules.filter(
        (F.col("shared_with") != "")
        & (~F.col("name").isin(P.THEOREMS) | ~F.col("shared_with").isin(P.THEOREMS) | (F.col("shared_with") == F.col("name")) | (F.col("reset_by") != ""))
    ).withColumn("_d", F.concat(F.lit("share of "), "name"))
    # Only theorem-like defaults take part in the search, as counters without a rule end a chain.
    fields = ["reset_by", "shared_with", "style", "prefix_parent"]
    once = rules.groupBy("book_id", "name").agg(F.max_by(F.struct(*fields), "ord").alias("r")).select("book_id", "name", "r.*")
    effective = effective_rules(once, setups).filter(F.col("name").isin(P.THEOREMS)).unionByName(
        once.filter(~F.col("name").isin(P.THEOREMS)).select("book_id", "name", "reset_by", "shared_with", "style", "prefix_parent"))
    cyclic = counter_closure(effective).filter("cyclic").join(once.select("book_id", "name"), ["book_id", "name"], "left_semi").withColumn(
        "_d", F.concat(F.lit("cycle at "), "name"))
    seeded = seeds.groupBy("book_id", "name").agg(F.count("*").alias("n")).filter(F.col("n") > 1).withColumn("_d", F.concat(F.lit("repeated seed "), "name"))
    chapterless = seeds.join(setups.select("book_id", "documentclass"), "book_id").filter(article & (F.col("name") == "chapter")).withColumn(
        "_d", F.lit("seed of chapter"))
    return all_violations(*[
        _violation(p, "COUNTER_RULE", F.col("_d"), F.lit(None)) for p in (twice, level, shares, cyclic, seeded, chapterless)])


def heading_patch(headings: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headings with patched levels, HEADING_COVERAGE violations). Same ids in the same order are required.

    Both carry `ord`, the position in the book; the first position that differs is reported per book.
    """
    a = headings.select("book_id", "ord", F.col("id").alias("_was"), "page")
    b = patches.select("book_id", "ord", F.col("id").alias("_got"), F.col("level").alias("_level"))
    wrong = a.join(b, ["book_id", "ord"], "full").filter(~F.col("_was").eqNullSafe(F.col("_got")))
    first = wrong.groupBy("book_id").agg(F.min_by(F.struct("ord", "_was", "_got", "page"), "ord").alias("m"))
    detail = F.concat_ws(" ", F.col("m.ord").cast("string"), F.coalesce("m._was", F.lit("-")), F.coalesce("m._got", F.lit("-")))
    violations = _violation(first, "HEADING_COVERAGE", detail, F.col("m.page"))
    good = headings.join(first.select("book_id"), "book_id", "left_anti").join(
        patches.select("book_id", "id", F.col("level").alias("_level")), ["book_id", "id"])
    return good.withColumn("level", F.col("_level")).drop("_level"), violations


def check_appendix(headings: DataFrame, setups: DataFrame) -> DataFrame:
    """APPENDIX_HEADING: the appendix must start at a chapter of a book or a section of an article."""
    wanted = setups.filter(F.coalesce("appendix_start", F.lit("")) != "").select("book_id", F.col("appendix_start").alias("id"), "documentclass")
    level = F.when(F.col("documentclass") == "book", "chapter").otherwise("section")
    found = headings.select("book_id", "id", F.col("level").alias("_level"))
    ok = wanted.join(found, ["book_id", "id"]).filter(F.col("_level") == level).select("book_id").distinct()
    return _violation(wanted.join(ok, "book_id", "left_anti"), "APPENDIX_HEADING", F.col("id"), F.lit(None))


def overlaps(ranges: DataFrame) -> DataFrame:
    """Line ranges that begin inside an earlier range of the same page: the furthest end so far decides, no self-join.

    Rows of a page are cut into blocks of lines, so that one crowded page is not one task.
    """
    from ..functions.scan import Running, running

    ordered = ranges.withColumn("_key", F.shiftleft(F.col("start_line").cast("bigint"), 32) + F.col("seq"))
    seen = running(ordered, ["book_id", "page"], ["_key"], F.shiftright("_key", 38),
                   [Running("_far", "max", F.col("end_line"), inclusive=False)])
    return seen.filter(F.col("_far") >= F.col("start_line")).drop("_key", "_far")


def check_grants(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """REFERENCE_REPAIR_SCOPE and REFERENCE_ACTION for requested repairs.

    `requests` has book_id, page, seq, start_line, end_line, reason, viewed, phase and mixed (whether the same answer
    also edits or queries).
    """
    sized = pages.select("book_id", "page", F.greatest(F.lit(1), F.size(X.split_lines(F.col("tex")))).alias("_size"))
    rows = requests.join(sized, ["book_id", "page"], "left").withColumn(
        "_end", F.when(F.col("end_line") == 0, F.col("_size")).otherwise(F.col("end_line")))
    scope = rows.filter(
        (F.col("phase") != "missing") | F.col("_size").isNull() | ~F.col("viewed") | X.is_blank(F.col("reason"))
        | ~((F.col("start_line") >= 1) & (F.col("start_line") <= F.col("_end")) & (F.col("_end") <= F.col("_size"))))
    mixed = requests.filter(F.col("mixed"))
    ranged = rows.filter(F.col("_size").isNotNull()).select("book_id", "page", "seq", "start_line", F.col("_end").alias("end_line"))
    where = F.concat_ws(":", F.col("seq").cast("string"), F.col("start_line").cast("string"))
    return all_violations(
        _violation(scope, "REFERENCE_REPAIR_SCOPE", where), _violation(mixed, "REFERENCE_ACTION", where),
        _violation(overlaps(ranged), "REFERENCE_REPAIR_SCOPE", F.concat(where, F.lit(" overlap"))))


def marker_violations(pages: DataFrame) -> DataFrame:
    """LABEL_NAME over the pages themselves, comments included, as the conversion check reads them."""
    raw = F.regexp_extract_all("tex", F.lit(P.NATIVE_MARKER), F.lit(0))
    rows = pages.select("book_id", "page", F.explode(raw).alias("_t")).withColumn("key", X.argument_of(F.col("_t")))
    return check_labels(rows)


def in_page_scope(requests: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests inside their book, PAGE_SCOPE violations): end page and chosen setup pages must exist."""
    joined = requests.join(books.select("book_id", "page_count"), "book_id")
    bad = (F.col("end_page") > F.col("page_count")) | F.exists("setup_pages", lambda p: (p < 1) | (p > F.col("page_count")))
    return joined.filter(~bad).drop("page_count"), _violation(joined.filter(bad), "PAGE_SCOPE", F.col("request_id"), F.lit(None))


for _code, _fn in (
    ("UNSAFE_TEX", check_body), ("AUTOMATIC_NUMBERING", check_manual_numbers), ("LABEL_NAME", marker_violations),
    ("IMAGE_REGION", check_boxes), ("INVALID_ID", check_ids), ("MISSING_ANCHOR", check_anchors),
    ("COUNTER_RULE", check_counters), ("APPENDIX_HEADING", check_appendix), ("PAGE_COVERAGE", page_coverage),
):
    register_rule(_code, _fn)
