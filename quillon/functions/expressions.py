"""Column expressions with the semantics that the queries rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_VERSION = ['""', '"None"', '"0"']


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), UPPER, LOWER)


def ascii_ilike(c: Column | str, pattern: str, escape: str = "\\") -> Column:
    """LIKE that folds ASCII letters alone; null stays null."""
    return F.like(ascii_lower(c), F.lit("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in pattern)), F.lit(escape))


def search_pattern(term: str | None) -> str:
    """A substring pattern; % and _ of the term are literal, a backslash of it is not."""
    return "%" if term is None else "%" + term.replace("%", "\\%").replace("_", "\\_") + "%"


def contains_term(c: Column | str, term: str | None) -> Column:
    """``search_pattern`` applied; a lone backslash before an ordinary character stands for it."""
    pattern = search_pattern(term)
    out, at = "", 0
    while at < len(pattern):
        if pattern[at] == "\\" and at + 1 < len(pattern) and pattern[at + 1] not in "%_\\":
            at += 1
        elif pattern[at] == "\\":
            out += pattern[at]
            at += 1
            if at >= len(pattern):
                return F.lit(False)
        out += pattern[at]
        at += 1
    return ascii_ilike(c, out)


def unordered_between(c: Column | str, a, b) -> Column:
    """Between the smaller and the larger bound; null if either is null, unlike least and greatest."""
    if a is None or b is None:
        return F.lit(None).cast("boolean")
    return col(c).between(min(int(a), int(b)), max(int(a), int(b)))


def tri_state(c: Column | str, complete: bool | None) -> Column:
    """Set, unset, or whatever."""
    if complete is None:
        return F.lit(True)
    return col(c).isNotNull() if complete else col(c).isNull()


def blank(c: Column | str) -> Column:
    """Null, or spaces only (no other white space)."""
    return col(c).isNull() | (F.trim(col(c)) == "")


def unquoted(c: Column | str) -> Column:
    """A JSON-encoded string without its quotes; a lone quote doesn't match."""
    return F.when(F.like(col(c), F.lit('"%"')), F.substr(col(c), F.lit(2), F.char_length(col(c)) - 2)).otherwise(col(c))


def has_version(c: Column | str) -> Column:
    return ~blank(c) & ~col(c).isin(*NO_VERSION)


def stringified(c: Column | str) -> Column:
    """Null becomes the word null, booleans the words true and false."""
    return F.coalesce(col(c).cast("string"), F.lit("null"))


def key_part(c: Column | str) -> Column:
    """Null and the empty string are the same key."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def content_id(kind: str, *columns: Column | str) -> Column:
    """A deterministic id of a unique key."""
    return F.sha2(F.concat_ws("\x01", F.lit(kind), *map(key_part, columns)), 256)


def floor_second(c: Column | str) -> Column:
    """Epoch seconds of a timestamp, floored."""
    return F.floor(F.unix_micros(col(c).cast("timestamp")) / 1_000_000).cast("long")


def whole(c: Column | str, up: bool = False) -> Column:
    """A number as a whole one, rounded down (or up); null, not an error, beyond 64 bits."""
    number = F.ceil(col(c).cast("double")) if up else F.floor(col(c).cast("double"))
    return F.when(F.abs(col(c).cast("double")) < float(1 << 63), number).cast("long")


def connectivity(c: Column | str) -> Column:
    return F.when(col(c).isin("Local Push", "Local Polling"), "offline").when(col(c).isin("Cloud Push", "Cloud Polling"), "online")
