"""Section scope of every occurrence, and counters computed from declared rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scan import Running, page_block, position, running
from ..session import cut_lineage


def level_index(level: Column) -> Column:
    """0 for the outermost heading level."""
    return F.array_position(F.array(*[F.lit(h) for h in P.HEADINGS]), level) - 1


def with_headings(markers: DataFrame, headings: DataFrame) -> DataFrame:
    """Markers of headings with the level and number of their record; other markers pass through."""
    records = headings.select(
        "book_id", F.col("id").alias("key"), F.lit(P.HEADING_COMMAND).alias("command"), "level", "number", "title"
    )
    return markers.join(records, ["book_id", "key", "command"], "left")


def heading_scope(markers: DataFrame, headings: DataFrame) -> DataFrame:
    """Open ancestors of every marker, outermost first, as `scope`.

    Equal to a stack from which a heading removes its own level and all below: the last heading of a level is open
    exactly when no heading of an outer level came later. Five running values, no stack.
    """
    placed = with_headings(markers, headings).withColumn("pos", position(F.col("page"), F.col("start")))
    levels = range(len(P.HEADINGS))
    here = F.when(F.col("command") == P.HEADING_COMMAND, level_index(F.col("level")))
    record = F.struct(
        F.col("pos").alias("pos"), here.cast("int").alias("level"), F.col("number").alias("number"), F.col("key").alias("id")
    )
    specs = [Running(f"_s{n}", "last", F.when(here == n, record)) for n in levels]
    seen = running(placed, ["book_id"], ["pos"], page_block(F.col("pos")), specs)
    opened = []
    for n in levels:
        outer = [F.coalesce(F.col(f"_s{m}.pos"), F.lit(-1)) for m in range(n)]
        latest = F.greatest(*outer) if len(outer) > 1 else (outer[0] if outer else F.lit(-1))
        opened.append(F.when(F.col(f"_s{n}.pos") > latest, F.col(f"_s{n}").dropFields("pos")))
    return seen.withColumn("scope", F.array_compact(F.array(*opened))).drop(*[f"_s{n}" for n in levels], "level", "number", "title")


def last_headings(places: DataFrame, markers: DataFrame) -> DataFrame:
    """Places (book_id, pos and more) with `heading`, the place of the last heading before each; null before the first.

    The scope of a place is that of its last heading, so places need not carry scopes, only one number.
    """
    heads = markers.filter(F.col("command") == P.HEADING_COMMAND).select("book_id", position(F.col("page"), F.col("start")).alias("pos"))
    both = cut_lineage(places.withColumn("_head", F.lit(None).cast("bigint")).unionByName(heads.withColumn("_head", F.col("pos")), allowMissingColumns=True))
    seen = running(both, ["book_id"], ["pos"], page_block(F.col("pos")), [Running("heading", "last", F.col("_head"))])
    return seen.filter(F.col("_head").isNull()).drop("_head")


# --- counters ---------------------------------------------------------------

# Counters that a class resets by itself, before any rule.
NATIVE_RESETS_BOOK = {
    "section": "chapter", "subsection": "section", "subsubsection": "subsection",
    "equation": "chapter", "figure": "chapter", "table": "chapter", "footnote": "chapter",
}
NATIVE_RESETS_ARTICLE = {"subsection": "section", "subsubsection": "subsection"}
# Native counters printed with their parent in front.
NATIVE_PREFIXED = {"section", "subsection", "subsubsection", "equation", "figure", "table"}

RULE_TYPE = "struct<reset_by:string,shared_with:string,style:string,prefix_parent:boolean>"


def effective_rules(rules: DataFrame, setups: DataFrame) -> DataFrame:
    """One rule per counter and book: class defaults, overridden by the book's own rules.

    The nine theorem-like counters share the first one unless a rule says otherwise.
    """
    rows = []
    for documentclass, resets in (("book", NATIVE_RESETS_BOOK), ("article", NATIVE_RESETS_ARTICLE)):
        for name in P.BUILTIN_COUNTERS:
            parent = resets.get(name, "")
            prefixed = bool(parent) and name in NATIVE_PREFIXED
            rows.append((documentclass, name, parent, "", "Roman" if name == "part" else "arabic", prefixed))
        for name in P.THEOREMS:
            rows.append((documentclass, name, "", "" if name == "theorem" else "theorem", "arabic", False))
    defaults = F.array(*[
        F.struct(F.lit(c).alias("class"), F.lit(n).alias("name"), F.lit(r).alias("reset_by"),
                 F.lit(s).alias("shared_with"), F.lit(t).alias("style"), F.lit(p).alias("prefix_parent"))
        for c, n, r, s, t, p in rows
    ])
    base = setups.select("book_id", F.explode(F.filter(defaults, lambda d: d["class"] == F.col("documentclass"))).alias("d"))
    base = base.select("book_id", "d.name", "d.reset_by", "d.shared_with", "d.style", "d.prefix_parent")
    own = rules.select("book_id", "name", *[F.col(c).alias("_" + c) for c in ("reset_by", "shared_with", "style", "prefix_parent")])
    # The closed set of names keeps both sides at 18 rows per book.
    return base.join(own, ["book_id", "name"], "left").select(
        "book_id", "name",
        *[F.coalesce("_" + c, c).alias(c) for c in ("reset_by", "shared_with", "style", "prefix_parent")],
    )


def _rule_map(rules: DataFrame) -> DataFrame:
    """All rules of a book in one map; at most 18 entries, the counter names being a closed set."""
    entry = F.struct("name", F.struct("reset_by", "shared_with", "style", "prefix_parent").alias("rule"))
    return rules.groupBy("book_id").agg(F.map_from_entries(F.collect_set(entry)).alias("rules"))


def _walk(rules: Column, name: Column) -> Column:
    """Names reached by following share-or-reset links, the start first; stops at the end or at a repeat."""
    start = F.struct(F.array(name).alias("seen"), F.lit(False).alias("cyclic"), name.alias("at"))

    def step(acc: Column, _: Column) -> Column:
        rule = F.try_element_at(rules, acc["at"])
        up = F.coalesce(F.when(rule["shared_with"] != "", rule["shared_with"]).otherwise(rule["reset_by"]), F.lit(""))
        over = acc["cyclic"] | (up == "")
        again = F.array_contains(acc["seen"], up)
        return F.when(over, acc.withField("at", F.lit(""))).otherwise(
            F.struct(
                F.when(again, acc["seen"]).otherwise(F.concat(acc["seen"], F.array(up))).alias("seen"),
                again.alias("cyclic"), F.when(again, "").otherwise(up).alias("at"),
            )
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(P.BUILTIN_COUNTERS) + len(P.THEOREMS))), start, step)


def counter_closure(rules: DataFrame) -> DataFrame:
    """Root and cycle flag of every counter: names are a closed set, so the walk stays inside one row."""
    walked = _rule_map(rules).select("book_id", "rules", F.explode(F.map_keys("rules")).alias("name"))
    walked = walked.withColumn("walk", _walk(F.col("rules"), F.col("name")))
    return walked.select(
        "book_id", "name", F.element_at("walk.seen", -1).alias("root"),
        (F.size("walk.seen") - 1).alias("depth"), F.col("walk.cyclic").alias("cyclic"),
    )


def _roman(value: Column) -> Column:
    """Roman numerals from the four decimal digits of a positive number."""
    digits = [
        (1000, ["", "M", "MM", "MMM"]),
        (100, ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]),
        (10, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]),
        (1, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]),
    ]
    parts = []
    for unit, names in digits:
        digit = F.floor(value / unit).cast("int") % 10
        if unit == 1000:
            thousands = F.floor(value / 1000).cast("int")
            parts.append(F.repeat(F.lit("M"), thousands))
        else:
            parts.append(F.element_at(F.array(*[F.lit(n) for n in names]), digit + 1))
    return F.concat(*parts)


def format_counter(value: Column, style: Column) -> Column:
    """A counter value in its style; values without a letter or numeral print as nothing, like the typesetter."""
    letter = F.when(value.between(1, 26), F.chr(F.lit(96) + value)).otherwise("")
    roman = F.when(value > 0, _roman(F.greatest(value, F.lit(0)))).otherwise("")
    return (
        F.when(style == "roman", F.lower(roman)).when(style == "Roman", roman)
        .when(style == "alph", letter).when(style == "Alph", F.upper(letter))
        .otherwise(value.cast("string"))
    )


def materialise_counters(steps: DataFrame, rules: DataFrame, seeds: DataFrame, appendix: DataFrame | None = None) -> DataFrame:
    """Visible number of every counted element.

    `steps` (book_id, page, start, id, counter) lists what advances a counter, headings included. A counter counts
    its own steps since the last step of any counter above it; a seed applies until the first reset. Counters above
    are known from their last step, so the data is scanned three times, however deep the nesting.

    `appendix` (book_id, id) names the heading that starts the appendix: its counter begins again, in capital letters.
    In a book with a cycle of rules nothing can be counted: `cyclic` is true there, value and number are null.
    """
    # Each result that several steps below read is a stage table, or all before it would be planned and done again for each.
    rules = cut_lineage(rules)
    rings = cut_lineage(counter_closure(rules).filter("cyclic").select("book_id").distinct())
    uncounted = steps.join(rings, "book_id", "left_semi").select(
        "book_id", "page", "start", "id", "counter", F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("string").alias("visible_number"),
        F.lit(True).alias("cyclic"))
    steps, rules = steps.join(rings, "book_id", "left_anti"), rules.join(rings, "book_id", "left_anti")
    books = _rule_map(rules)
    chains = F.map_from_entries(F.transform(F.map_keys("rules"), lambda n: F.struct(n, _walk(F.col("rules"), n)["seen"])))
    # One row per book. Maps are some kilobytes each, but their files are far smaller, so each join below asks for a merge
    # join: by the size of the files, the maps of all books would be broadcast.
    books = cut_lineage(books.withColumn("chains", chains))

    def shared_by(name: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("rules"), name)["shared_with"], F.lit(""))

    placed = steps.join(books.hint("merge"), "book_id").withColumn("pos", position(F.col("page"), F.col("start")))
    root = F.when(shared_by(F.col("counter")) != "", shared_by(F.col("counter"))).otherwise(F.col("counter"))
    own = cut_lineage(placed.select("book_id", "pos", "page", "start", "id", "counter", root.alias("root")))
    # Each counter also sees the steps of the counters above it, as resets.
    below = books.select("book_id", "rules", "chains", F.explode(F.map_keys("rules")).alias("below"))
    links = below.filter(shared_by(F.col("below")) == "").select(
        "book_id", "below", F.explode(F.slice(F.try_element_at(F.col("chains"), F.col("below")), 2, 2147483646)).alias("root"))
    resets = own.join(links.hint("merge"), ["book_id", "root"]).select("book_id", "pos", F.col("below").alias("stream"), F.lit(1).alias("reset"))
    counted = own.select("book_id", "pos", F.col("root").alias("stream"), F.lit(0).alias("reset"))
    starts = own.limit(0).select("book_id", F.col("pos").alias("_app_pos"), F.col("root").alias("_app_root"))
    if appendix is not None:
        starts = own.join(appendix.select("book_id", "id"), ["book_id", "id"]).groupBy("book_id").agg(
            F.min("pos").alias("_app_pos"), F.min_by("root", "pos").alias("_app_root"))
        again = starts.select("book_id", (F.col("_app_pos") - 1).alias("pos"), F.col("_app_root").alias("stream"), F.lit(1).alias("reset"))
        resets = resets.unionByName(again)
    block = page_block(F.col("pos"))
    segmented = running(cut_lineage(counted.unionByName(resets)), ["book_id", "stream"], ["pos"], block,
                        [Running("segment", "sum", F.col("reset").cast("bigint"))])
    numbered = running(
        segmented.filter(F.col("reset") == 0), ["book_id", "stream", "segment"], ["pos"], block,
        [Running("nth", "sum", F.lit(1).cast("bigint"))],
    )
    seeded = numbered.join(
        seeds.select("book_id", F.col("name").alias("stream"), F.col("value").cast("bigint").alias("seed")), ["book_id", "stream"], "left"
    )
    value = F.col("nth") + F.when(F.col("segment") == 0, F.coalesce("seed", F.lit(0))).otherwise(0)
    values = seeded.select("book_id", F.col("stream").alias("root"), "pos", value.alias("value"))
    valued = cut_lineage(own.join(values.hint("merge"), ["book_id", "root", "pos"]))

    # Values of the counters above: the last one before this element, per heading level.
    specs = [Running(f"_v_{a}", "last", F.when(F.col("root") == a, F.struct("pos", "value"))) for a in P.HEADINGS]
    above = running(valued, ["book_id"], ["pos"], block, specs)
    seed_map = seeds.groupBy("book_id").agg(F.map_from_entries(F.collect_set(F.struct("name", F.col("value").cast("bigint")))).alias("seed_map"))
    above = above.join(seed_map, "book_id", "left").join(books.hint("merge"), "book_id").join(starts, "book_id", "left")
    last = F.map_from_arrays(F.array(*[F.lit(a) for a in P.HEADINGS]), F.array(*[F.col(f"_v_{a}") for a in P.HEADINGS]))
    above = above.withColumn("_last", last).withColumn("_chain", F.try_element_at(F.col("chains"), F.col("root")))

    def value_now(name: Column) -> Column:
        """0 after a reset by a counter above it, the seed before the first step."""
        reset_at = F.aggregate(
            F.slice(F.try_element_at(F.col("chains"), name), 2, 2147483646), F.lit(-1).cast("bigint"),
            lambda acc, up: F.greatest(acc, F.coalesce(F.try_element_at(F.col("_last"), up)["pos"], F.lit(-1))))
        mine = F.try_element_at(F.col("_last"), name)
        return (
            F.when(mine["pos"] > reset_at, mine["value"]).when(reset_at >= 0, F.lit(0).cast("bigint"))
            .otherwise(F.coalesce(F.try_element_at(F.col("seed_map"), name), F.lit(0).cast("bigint")))
        )

    def rule_of(name: Column) -> Column:
        return F.try_element_at(F.col("rules"), name)

    parts = F.transform("_chain", lambda n, i: format_counter(
        F.when(i == 0, F.col("value")).otherwise(value_now(n)),
        F.when(F.coalesce((n == F.col("_app_root")) & (F.col("pos") >= F.col("_app_pos")), F.lit(False)), "Alph").otherwise(rule_of(n)["style"])))
    # Prefixes reach up while each rule asks for its parent.
    shown = F.aggregate(
        "_chain", F.struct(F.lit(1).alias("n"), F.lit(True).alias("go")),
        lambda acc, n: F.struct(
            F.when(acc["go"] & rule_of(n)["prefix_parent"] & (rule_of(n)["reset_by"] != ""), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["go"] & rule_of(n)["prefix_parent"]).alias("go")),
        lambda acc: acc["n"])
    visible = F.array_join(F.reverse(F.slice(parts, F.lit(1), shown)), ".")
    counted = above.select("book_id", "page", "start", "id", "counter", "value", visible.alias("visible_number"), F.lit(False).alias("cyclic"))
    return counted.unionByName(uncounted)
