"""Text expressions on segment text.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() and str.isspace() treat as blank.
WS = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters as a list; trimming with it stays clear of regular expressions.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Fixed value: characters after which a long text may be cut.
CUT_AFTER = "。！？!?；;，,、 "
DEFAULT_SPEAKER = "S00"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it.

    Spark shares repeated expressions only where every row needs them, not inside CASE
    branches; binding the value to a lambda variable shares it there too.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Every run of blanks becomes one space."""
    return F.regexp_replace(c, f"{WS}+", " ")


def first_char(c: Column) -> Column:
    return F.substring(c, 1, 1)


def last_char(c: Column) -> Column:
    return F.substring(c, -1, 1)


def is_ascii(char: Column) -> Column:
    return F.ascii(char).between(0, 127)


def separator(left: Column, right: Column) -> Column:
    """Blank between two texts only where both touching characters are ASCII."""
    touching = (F.length(left) > 0) & (F.length(right) > 0) & is_ascii(last_char(left)) & is_ascii(first_char(right))
    return F.when(touching, F.lit(" ")).otherwise(F.lit(""))


def join_text(left: Column, right: Column) -> Column:
    return F.concat(left, separator(left, right), right)


def subtitle_separator(left: Column, right: Column) -> Column:
    """No blank before closing punctuation nor after an opening bracket."""
    closes = right.rlike(r"^[,.;:!?，。！、；：）】》\])？]")
    opens = left.rlike(r"[(\[{（【《]\z")
    return F.when((F.length(left) == 0) | (F.length(right) == 0) | closes | opens, F.lit("")).otherwise(F.lit(" "))


def join_subtitle_parts(parts: Column) -> Column:
    """Join an array of texts with ``subtitle_separator``; blank parts vanish."""
    kept = F.filter(F.transform(parts, lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: F.length(t) > 0)
    return F.aggregate(kept, F.lit(""), lambda acc, t: F.concat(acc, subtitle_separator(acc, t), t))


def split_long_text(c: Column, max_chars: int) -> Column:
    """Cut at ``max_chars`` or after a cut character past half of it, then re-pack short pieces."""
    early = max(1, max_chars // 2)
    blank = r"\[\]^\\-"
    cut = "".join("\\" + ch if ch in blank else ch for ch in CUT_AFTER)
    lead = f".{{{early - 1}}}"
    room = max_chars - early
    pattern = f"(?s){lead}[^{cut}]{{0,{room}}}[{cut}]|{lead}[^{cut}]{{{room + 1}}}|.+"
    text = strip(c)
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.filter(F.transform(pieces, strip), lambda p: F.length(p) > 0)

    def pack(acc: Column, piece: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + F.length(piece) <= max_chars)
        return F.when(
            fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(join_text(last, piece)))
        ).otherwise(F.concat(acc, F.array(piece)))

    packed = F.aggregate(pieces, F.array().cast("array<string>"), pack)
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(packed)


_PREFIX = rf"^([A-Za-z0-9_ -]{{1,32}}):{WS}+([^\r\n]*)\z"


def lines_of(c: Column) -> Column:
    """Lines of a text; no entry for an empty end."""
    unified = F.regexp_replace(c, r"\r\n|[\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", "\n")
    pieces = F.split(unified, "\n", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def prefixed_speaker(c: Column) -> Column:
    """``Name: text`` on the first line -> struct(speaker, body)."""
    text = strip(F.coalesce(c, F.lit("")))
    lines = lines_of(text)
    head = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    found = head.rlike(_PREFIX)
    name = strip(F.regexp_extract(head, _PREFIX, 1))
    body = strip(F.regexp_extract(head, _PREFIX, 2))
    rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    joined = F.when(F.size(lines) > 1, strip(F.array_join(F.concat(F.array(body), rest), "\n"))).otherwise(body)
    return F.struct(
        F.when(found & (F.length(name) > 0), name).otherwise(F.lit(DEFAULT_SPEAKER)).alias("speaker"),
        F.when(found, joined).otherwise(text).alias("body"),
    )


def strip_ass_markup(c: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\{[^\n]*?\}", "")
    return F.replace(
        F.replace(F.replace(bare, F.lit("\\h"), F.lit(" ")), F.lit("\\N"), F.lit("\n")), F.lit("\\n"), F.lit("\n")
    )


def escape_ass(c: Column) -> Column:
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    escaped = F.translate(escaped, "{}", "()")
    return F.replace(escaped, F.lit("\n"), F.lit("\\N"))


def display_text(speaker: Column, text: Column, *, show_speaker: bool, name: Column | None = None) -> Column:
    """``name: text``; the display name falls back to the speaker tag."""
    if not show_speaker:
        return text
    tag = speaker if name is None else F.coalesce(F.when(F.length(name) > 0, name), speaker)
    return F.when(F.length(F.coalesce(speaker, F.lit(""))) == 0, text).otherwise(F.concat(tag, F.lit(": "), text))


def normal_phrase(c: Column) -> Column:
    """Lower-case, only letters a-z, digits and CJK, single blanks."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['`]", "")
    return F.trim(F.regexp_replace(low, r"[^a-z0-9\x{4E00}-\x{9FFF}]+", " "))


def is_short_phrase(normal: Column) -> Column:
    return (F.length(normal) > 0) & (F.length(normal) <= 64) & (F.size(F.split(normal, " ")) <= 6)


def ends_sentence(c: Column) -> Column:
    return rstrip(c).rlike(r"""[.!?。！？…][\"')\]}）】》]*\z""")


def looks_complete(c: Column) -> Column:
    return F.right(strip(c), F.lit(1)).isin(*".!?。！？")


def count_of(c: Column, characters: str) -> Column:
    """How many of the characters occur; a fraction of the cost of a regular expression."""
    return (F.length(c) - F.length(reduce(lambda x, one: F.replace(x, F.lit(one)), characters, c))).cast("bigint")
