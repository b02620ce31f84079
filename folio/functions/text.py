"""Column functions on text: matches with offsets, comment rules, keys, windows, lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

# Every line boundary of Unicode text, a carriage return with its line feed counting once.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Every match as `array<struct<token,start,line>>`; offsets count characters from 0, lines from 1.

    Spark gives matches or the pieces between them, not positions; positions are the prefix sum of both lengths.
    """
    return once(text, lambda t: _placed(t, pattern))


def running_sums(values: Column) -> Column:
    """Sums of an array's elements up to each place.

    Each round adds what stands 1, 2, 4, ... places before, so the cost is that of a few passes, not of growing copies.
    """
    def rounds(x: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(x))).cast("int") - 1)
        return F.aggregate(steps, x, lambda acc, k: F.transform(
            acc, lambda v, i: v + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))

    return once(values, lambda x: F.when(F.size(x) < 2, x).otherwise(rounds(x)))


def _placed(text: Column, pattern: str) -> Column:
    pieces = F.split(text, pattern, -1)

    def moved(piece: Column, token: Column) -> Column:
        # What a piece and its match add to the offset stands above 32 bits, its line ends below, so one sum gives both.
        return (F.shiftleft((F.length(piece) + F.length(token)).cast("bigint"), 32)
                + (F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))))

    def place(tokens: Column) -> Column:
        # The piece behind the last match has no token: its sum, null, is not read.
        return once(running_sums(F.zip_with(pieces, tokens, moved)), lambda at: F.transform(tokens, lambda t, i: F.struct(
            t.alias("token"), (F.shiftright(F.get(at, i), 32).cast("int") - F.length(t)).alias("start"),
            (F.get(at, i).bitwiseAND(F.lit((1 << 32) - 1)).cast("int") + 1).alias("line"))))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _blank(text: Column, pattern: str) -> Column:
    pieces = F.split(text, pattern, -1)
    hidden = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rejoined = F.array_join(
        F.zip_with(pieces, hidden, lambda p, h: F.concat(p, F.coalesce(F.repeat(F.lit(" "), F.length(h)), F.lit("")))),
        "",
    )
    return F.when(F.contains(text, F.lit("%")), rejoined).otherwise(text)


def mask_comments(text: Column) -> Column:
    """Blank every comment that no backslash precedes; offsets stay the same."""
    return _blank(text, P.COMMENT_AFTER_NON_BACKSLASH)


def mask_comments_by_parity(text: Column) -> Column:
    """Blank every comment whose percent sign follows an even number of backslashes; offsets stay the same."""
    return _blank(text, P.COMMENT_BY_PARITY)


def strip_comments(line: Column) -> Column:
    """Cut comments by backslash parity, keeping the backslashes before the percent sign."""
    return F.regexp_replace(line, r"(?<!\\)((?:\\\\)*)%[^\n]*", "$1")


def command_of(token: Column) -> Column:
    return F.substring_index(F.substr(token, F.lit(2)), "{", 1)


def argument_of(token: Column) -> Column:
    at = F.locate("{", token)
    return F.substr(token, at + 1, F.length(token) - at - 1)


def key_kind(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def key_number(key: Column) -> Column:
    return F.get(F.split(key, ":"), F.lit(1))


def key_namespace(key: Column) -> Column:
    return F.substring_index(key, ":", 2)


def family(kind: Column) -> Column:
    """Kinds that may stand for one another when a reference has no target."""
    statements = [t for t in P.THEOREMS if t != "exercise"]
    return (
        F.when(kind.isin(statements), "statement")
        .when(kind.isin("exercise", "problem"), "exercise")
        .otherwise(kind)
    )


@cache
def _foldings() -> dict[str, str]:
    """Lower-case characters that full case folding changes further, by the rule of the Unicode database."""
    lower = (chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).lower() == chr(c))
    return {c: c.casefold() for c in lower if c.casefold() != c}


def _ranges(codes: list[int]) -> str:
    """A character class of ascending codes, neighbours as ranges."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def fold_case(text: Column) -> Column:
    """Full case folding: lower case, then what differs from it (ß as ss, ligatures, the final sigma, ...).

    Texts in ASCII are done with lower case, and only those with a rare letter are taken apart.
    """
    table = _foldings()
    rare = F.lit(_ranges([ord(c) for c in table if c != "ß"]))
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    letters = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(lookup, c), c)), "")
    # Two quick looks first: most texts are ASCII, most others have nothing beyond Latin-1.
    beyond = F.lit("[\\xb5\\x{100}-\\x{ffff}]")
    full = lambda t: F.when(F.rlike(t, beyond) & F.rlike(t, rare), letters(t)).otherwise(F.replace(t, F.lit("ß"), F.lit("ss")))
    return once(F.lower(text), lambda low: F.when(F.rlike(low, F.lit("[^\\x00-\\x7f]")), full(low)).otherwise(low))


def normal_number(number: Column) -> Column:
    primes = F.replace(F.replace(F.replace(number, F.lit("prime"), F.lit("'")), F.lit("′"), F.lit("'")), F.lit("″"), F.lit("''"))
    return fold_case(primes)


def context(text: Column, start: Column, end: Column, width: int = P.CONTEXT_CHARS) -> Column:
    begin = F.greatest(F.lit(0), start - width)
    return F.substr(text, begin + 1, end + width - begin)


def line_of(text: Column, offset: Column) -> Column:
    prefix = F.substr(text, F.lit(1), offset)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    lines = F.split(text, LINE_END, -1)
    open_end = F.element_at(lines, -1) == ""
    return F.when(open_end, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def keep_lines(text: Column) -> Column:
    """Lines with their ends, so that joining them gives the text again."""
    ends = F.regexp_extract_all(text, F.lit(LINE_END), F.lit(0))
    whole = F.zip_with(F.split(text, LINE_END, -1), ends, lambda p, e: F.concat(p, F.coalesce(e, F.lit(""))))
    return F.filter(whole, lambda x: x != "")


def space_view(text: Column) -> Column:
    """Text without blanks and tabs before a line end."""
    return F.regexp_replace(text, r"[ \t]+(?=\r?\n)", "")


def occurrences(text: Column, part: Column) -> Column:
    """Number of non-overlapping occurrences of a literal part."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (gone / F.length(part)).cast("int")).otherwise(F.lit(0))


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*\z")


def layout(text: Column) -> Column:
    """Text with the keys of labels and references blanked."""
    return F.regexp_replace(text, r"\\(label|ref|eqref|nameref)\{([^{}]+)\}", "$1{}")


def set_digest(column: Column) -> Column:
    """Order-free digest of a group of distinct strings, combined on the map side.

    Each member gives two 60-bit numbers from its SHA-256; the digest is over their sums and the count.
    """
    hexed = F.sha2(column, 256)
    high = F.conv(F.substr(hexed, F.lit(1), F.lit(15)), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substr(hexed, F.lit(16), F.lit(15)), 16, 10).cast("decimal(20,0)")
    return F.sha2(F.concat_ws(":", F.count(column).cast("string"), F.sum(high).cast("string"), F.sum(low).cast("string")), 256)
