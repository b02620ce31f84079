"""Tokens of marked-up pages: markers, environment tokens, symbols, lines.

A page is one row, so everything that stays inside a page (offsets, line numbers, occurrence ordinals) is computed
in that row before it is exploded, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.scan import Running, page_block, position, running


@dataclass(frozen=True)
class MarkupDialect:
    """Patterns that point the token operators at another markup language.

    `environment` matches one opening, closing or label token. `begin`, `end` and `name` are patterns applied to the
    token: whether it opens, whether it closes, and the group that names it. `ignore` lists names without a closing.
    """

    name: str
    environment: str
    begin: str
    end: str
    label: str
    name_group: str
    synthetic: str | None = None
    ignore: tuple[str, ...] = ()
    comment: str | None = None


TEX = MarkupDialect(
    name="tex",
    environment=P.ENV_TOKEN,
    begin=r"^\\(?:begin|\[)",
    end=r"^\\(?:end|\])",
    label=r"^\\label",
    name_group=r"\{([^{}\s]+)\}",
    synthetic=P.DISPLAY_MATH,
    comment=P.COMMENT_BY_PARITY,
)

HTML = MarkupDialect(
    name="html",
    environment=r"</?[A-Za-z][A-Za-z0-9]*[^<>]*>",
    begin=r"^<[A-Za-z]",
    end=r"^</",
    label=r"^$",
    name_group=r"^</?([A-Za-z][A-Za-z0-9]*)",
    ignore=("br", "meta", "img", "hr", "input", "link"),
)


def visible(tex: Column, dialect: MarkupDialect = TEX) -> Column:
    """Page text with comments blanked the way environment tokens need it."""
    return X.mask_comments_by_parity(tex) if dialect.comment else tex


def marker_array(tex: Column) -> Column:
    """Markers of a page as an array: command, key, offsets, category and ordinal inside the category."""
    found = X.matches(tex, P.MARKER)

    def shape(m: Column) -> Column:
        command = X.command_of(m["token"])
        category = (
            F.when(command == "label", "label")
            .when(command.isin("ref", "eqref", "nameref"), "reference")
            .otherwise("record")
        )
        return F.struct(
            command.alias("command"), X.argument_of(m["token"]).alias("key"), category.alias("category"),
            m["start"].alias("start"), (m["start"] + F.length(m["token"])).alias("end"),
        )

    return F.transform(found, shape)


def markers(pages: DataFrame, with_context: bool = False) -> DataFrame:
    """One row per marker that no comment hides."""
    hidden = pages.withColumn("_text", X.mask_comments(F.col("tex")))
    array = marker_array(F.col("_text"))
    if with_context:
        array = F.transform(
            array, lambda m: m.withField("context", X.context(F.col("_text"), m["start"], m["end"]))
        )
    # The ordinal of an occurrence counts its own category within the page.
    def numbered(category: str) -> Column:
        chosen = F.filter(F.col("_markers"), lambda m: m["category"] == category)
        return F.transform(chosen, lambda m, i: m.withField("ordinal", i))

    rows = hidden.withColumn("_markers", array).select(
        "book_id", "page",
        F.explode(F.concat(numbered("label"), numbered("reference"), numbered("record"))).alias("m"),
    )
    return rows.select("book_id", "page", "m.*")


def visible_markers(pages: DataFrame) -> DataFrame:
    """Markers outside comments by the parity rule, as needed before positional rewriting."""
    return (
        pages.select("book_id", "page", F.explode(marker_array(X.mask_comments_by_parity(F.col("tex")))).alias("m"))
        .select("book_id", "page", "m.*")
    )


def occurrence_id(page: Column, category: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit("-"), category, F.lit("-"), ordinal.cast("string"))


def symbols(pages: DataFrame, with_context: bool = True) -> DataFrame:
    """The label and reference index: id, key parts, command, category, offsets and context."""
    found = markers(pages, with_context).filter(F.col("category") != "record")
    return found.select(
        "book_id", "page",
        occurrence_id(F.col("page"), F.col("category"), F.col("ordinal")).alias("id"),
        "category", "command", "key",
        X.key_kind(F.col("key")).alias("kind"),
        X.key_number(F.col("key")).alias("number"),
        X.key_namespace(F.col("key")).alias("namespace"),
        "start", "end",
        *(["context"] if with_context else []),
    )


def compact(frame: DataFrame) -> DataFrame:
    """The projection for readers: no offsets."""
    return frame.drop("start", "end")


def env_token_array(tex: Column, dialect: MarkupDialect = TEX) -> Column:
    """Environment tokens of a page: op (begin, end, label), name, offset, line and ordinal per op."""
    found = X.matches(visible(tex, dialect), dialect.environment)

    def shape(m: Column) -> Column:
        token = m["token"]
        op = F.when(token.rlike(dialect.begin), "begin").when(token.rlike(dialect.end), "end").otherwise("label")
        name = F.regexp_extract(token, dialect.name_group, 1)
        if dialect.synthetic:
            name = F.when(name == "", dialect.synthetic).otherwise(name)
        return F.struct(op.alias("op"), name.alias("name"), m["start"].alias("start"), m["line"].alias("line"))

    tokens = F.transform(found, shape)
    if dialect.ignore:
        tokens = F.filter(tokens, lambda t: ~F.lower(t["name"]).isin(*dialect.ignore))
    return tokens


def env_tokens(pages: DataFrame, dialect: MarkupDialect = TEX) -> DataFrame:
    """One row per environment token. `ordinal` counts openings of a page from 1 and is null elsewhere."""
    array = pages.select("book_id", "page", env_token_array(F.col("tex"), dialect).alias("_tokens"))
    begins = F.transform(
        F.filter(F.col("_tokens"), lambda t: t["op"] == "begin"), lambda t, i: t.withField("ordinal", i + 1)
    )
    others = F.transform(
        F.filter(F.col("_tokens"), lambda t: t["op"] != "begin"),
        lambda t: t.withField("ordinal", F.lit(None).cast("int")),
    )
    return array.select("book_id", "page", F.explode(F.concat(begins, others)).alias("t")).select(
        "book_id", "page", "t.*"
    )


def lines(pages: DataFrame, text: str = "tex") -> DataFrame:
    """One row per line, numbered from 1."""
    return (
        pages.select("book_id", "page", F.posexplode(X.split_lines(F.col(text))).alias("line", "text"))
        .withColumn("line", F.col("line") + 1)
    )


def document_offsets(pages: DataFrame, text: str = "tex") -> DataFrame:
    """Offset of each page in the running text of its book."""
    sized = pages.select("book_id", "page", F.length(text).cast("bigint").alias("length"))
    pos = position(F.col("page"), F.lit(0))
    summed = running(
        sized, ["book_id"], ["page"], page_block(pos), [Running("_end", "sum", F.col("length"))]
    )
    return summed.select("book_id", "page", "length", (F.col("_end") - F.col("length")).alias("offset"))


def space_view(frame: DataFrame, text: str) -> DataFrame:
    """Text without horizontal space at line ends, and the source offset of each kept character run.

    `runs` lists the kept pieces as (start in the view, start in the source), enough to map any offset back.
    """
    gaps = X.matches(F.col(text), r"[ \t]+(?=\r?\n)")
    def placed(found: Column) -> Column:
        removed = X.running_sums(F.transform(found, lambda g: F.length(g["token"])))
        first = F.array(F.struct(F.lit(0).alias("view"), F.lit(0).alias("source")))
        return F.concat(first, X.once(removed, lambda sums: F.transform(found, lambda g, i: X.once(
            g["start"] + F.length(g["token"]), lambda source: F.struct((source - F.get(sums, i)).alias("view"), source.alias("source"))))))

    runs = X.once(gaps, placed)
    return frame.withColumn("view", X.space_view(F.col(text))).withColumn("runs", runs)


def layout_fingerprint(pages: DataFrame) -> DataFrame:
    """Hash of a page with label and reference keys blanked."""
    return pages.select("book_id", "page", F.sha2(X.layout(F.col("tex")), 256).alias("layout"))
