"""Reading model replies: JSON of several shapes, handled as VARIANT in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesheet.functions.text import let, strip


def json_or_fragment(content: Column, *, object_only: bool = False) -> Column:
    """The whole text as JSON, else its first JSON-looking part, else null."""
    pattern = r"(?s)(\{.*\})" if object_only else r"(?s)(\{.*\}|\[.*\])"
    return let(
        strip(content), lambda c: F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, pattern, 1)))
    )


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def _list(v: Column) -> Column:
    return F.when(_type(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _filled(v: Column) -> Column:
    """Null for what counts as missing: null, blank, empty, zero, false."""
    empty = F.try_variant_get(v, "$", "string").isin("", "[]", "{}", "0", "false")
    return F.when(~empty, v)


def _filled_list(v: Column, names: list[str]) -> Column:
    """First named field that is neither missing nor empty; null unless it is a list."""
    return let(F.coalesce(*[_filled(_at(v, n)) for n in names]), _list)


def _own_list(v: Column, names: list[str]) -> Column:
    """The list in one of an object's fields, or the value itself when it is a list."""
    return F.when(_type(v).startswith("OBJECT"), _filled_list(v, names)).otherwise(_list(v))


def reply_items(content: Column) -> Column:
    """array<variant> of reply items; null when the reply has no list."""
    return let(json_or_fragment(content), lambda data: _own_list(data, ["translations", "translated", "items"]))


def item_text(item: Column, *, plain_null: str = "") -> Column:
    """Text of one item: an object's text / translation / translated, else the scalar."""
    filled = lambda name: F.nullif(F.try_variant_get(item, f"$.{name}", "string"), F.lit(""))
    scalar = F.coalesce(F.try_variant_get(item, "$", "string"), F.lit(plain_null))
    return strip(
        F.when(_type(item).startswith("OBJECT"), F.coalesce(filled("text"), filled("translation"), filled("translated"), F.lit(""))).otherwise(scalar)
    )


def parse_translations(content: Column) -> Column:
    """array<string> in reply order; null when the reply is unusable."""
    return F.transform(reply_items(content), lambda x: item_text(x, plain_null="None"))


def unit_parts(item: Column, ids: Column) -> Column:
    """Translations of the parts of one unit, aligned by id, else by order; null when they do not fit."""

    def read(p: Column) -> Column:
        named = F.when(_type(p).startswith("OBJECT"), F.try_variant_get(p, "$.id", "string"))
        return F.struct(named.alias("id"), item_text(p).alias("t"))

    def align(pairs: Column) -> Column:
        def pick(seg_id: Column, at: Column) -> Column:
            named = F.filter(pairs, lambda p: p["id"] == seg_id)  # the last part with an id wins
            return F.coalesce(F.try_element_at(named, F.lit(-1))["t"], F.get(pairs, at)["t"])

        alone = F.array(F.coalesce(F.get(pairs, F.lit(0))["t"], item_text(item)))
        fits = F.coalesce(F.size(pairs) == F.size(ids), F.lit(False))
        return F.when(F.size(ids) == 1, alone).when(fits, F.transform(ids, pick))

    return let(F.transform(_own_list(item, ["parts", "translations", "items"]), read), align)


def parse_ranking(content: Column) -> Column:
    """array<struct<id, score, title, reason>> from ``{"selected": [...]}``; null when unusable."""
    selected = let(json_or_fragment(content, object_only=True), lambda data: _at(data, "selected"))
    items = F.filter(let(selected, _list), lambda x: _type(x).startswith("OBJECT"))
    get = lambda x, n, t: F.try_variant_get(x, f"$.{n}", t).alias(n)
    return F.transform(items, lambda x: F.struct(get(x, "id", "string"), get(x, "score", "double"), get(x, "title", "string"), get(x, "reason", "string")))


def reply_content(response: Column) -> Column:
    """``message.content``, else the first choice's, else ``text``, each only when a string."""

    def text(v: Column, path: str) -> Column:
        is_text = _type(F.try_variant_get(v, path, "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(v, path, "string"))

    paths = ["$.message.content", "$.choices[0].message.content", "$.text"]
    return strip(let(F.try_parse_json(response), lambda v: F.coalesce(*[text(v, p) for p in paths], F.lit(""))))
