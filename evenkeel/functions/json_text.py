"""How values of JSON columns are shown, at any depth, as built-in functions.

A text is parsed as a VARIANT, which puts the keys of every object in order, and written again without
white space. Shown, a value of any depth is that text token by token: brackets go, a colon becomes an
equals sign (nothing before an empty text), a comma gets a space, texts lose their quotes. So no
recursion and no Python is needed.

Real numbers, and whole ones beyond 64 bits, read as doubles and are written in the shortest form that
reads back as the same double: plain from 1e-5 to below 1e16, else like 1.5e20. As a VARIANT would drop
a fraction of zero, they travel as texts behind a mark; a text that begins with the mark gets a second one.

A null or invalid text has no value. A repeated key makes a text invalid unless
``spark.sql.variant.allowDuplicateKeys`` is set; then the last one counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\ue000"
#: Loops are possessive, so that long texts need no recursion.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
TOKEN = rf'{STRING}|[\[\]{{}}:,]|[^\s"\[\]{{}}:,]++'
TOKENS_SHOWN = rf':""|{TOKEN}'
#: A token that may be a number, or all up to the next one; whatever fits in neither stands alone, so that nothing is lost.
PIECE = rf'[-0-9][^\s"\[\]{{}}:,]*+|(?:{STRING}|[\s\[\]{{}}:,]|[^-0-9\s"\[\]{{}}:,][^\s"\[\]{{}}:,]*+)++|"'
REAL = r"^-?[0-9]+[.eE]|^-0$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _each(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change), "")


def real_text(number: Column) -> Column:
    """The shortest text of a number in text, read as a double."""
    return let(number.cast("double").cast("string"), _shortest)


def _shortest(java: Column) -> Column:
    sign, digits = F.regexp_extract(java, "^(-?)", 1), F.concat(F.regexp_extract(java, r"^-?(\d)\.", 1), F.regexp_extract(java, r"^-?\d\.(\d*?)0*E", 1))
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    rest = F.substr(digits, power + 2)
    plain = F.concat(sign, F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, "0"), F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(sign, F.substr(digits, F.lit(1), F.lit(1)), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), power.cast("string"))
    # A cast that fails costs more than all else here, so plain numbers do without.
    return F.when(~F.contains(java, F.lit("E")) | power.isNull(), java).when(power.between(0, 15), plain).when(power.between(-5, -1), small).otherwise(scientific)


def _marked(json: Column) -> Column:
    """``json`` with real numbers as marked texts."""
    whole = lambda t: t.try_cast("decimal(38,0)")
    beyond = lambda t: (F.length(t) > 18) & t.rlike("^-?[0-9]+$") & ~F.coalesce(whole(t).between(F.lit(-(2**63)), F.lit(str(2**64 - 1)).cast("decimal(38,0)")), F.lit(False))
    real = lambda t: F.when(t.rlike(REAL) | beyond(t), F.concat(F.lit(f'"{MARK}'), real_text(t), F.lit('"'))).otherwise(t)
    doubled = F.regexp_replace(json, rf'(?<!\\)"(?={MARK}|\\u[eE]000)', f'"{MARK}')
    return F.when(json.rlike(r"[0-9][.eE]|-0|[0-9]{18}"), _each(doubled, PIECE, real)).otherwise(doubled)


def _unmarked(token: Column) -> Column:
    """A token with its number bare, or with one mark less."""
    second = F.startswith(token, F.lit(f'"{MARK}{MARK}'))
    return F.when(second, F.concat(F.lit('"'), F.substr(token, F.lit(3)))).when(F.startswith(token, F.lit(f'"{MARK}')), F.substr(token, F.lit(3), F.length(token) - 3)).otherwise(token)


def _bare(token: Column) -> Column:
    """The content of a text token; any other token itself."""
    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    plain = F.when(F.contains(token, F.lit("\\")), F.variant_get(F.parse_json(token), "$", "string")).otherwise(inner)
    return F.when(F.startswith(token, F.lit('"')), plain).otherwise(token)


def parsed(json: Column) -> Column:
    """A JSON text as a VARIANT with its real numbers as marked texts; null if there is none.

    Where several cells of a text are shown, a column of its own for this reads the text once for all.
    """
    return F.try_parse_json(_marked(json))


def json_text(json: Column, path: str | None = None) -> Column:
    """The value at a dotted path of keys, the whole one without a path, as marked JSON text with its keys in order; null if there is none."""
    return value_text(parsed(json), path)


def value_text(value: Column, path: str | None = None) -> Column:
    """``json_text`` of a text that is parsed already."""
    if path is not None:
        quoted = lambda part: f"['{part}']" if '"' in part else f'["{part}"]'
        value = F.try_variant_get(value, "$" + "".join(map(quoted, path.split("."))), "variant")
    return F.to_json(value)


def plain_json(text: Column) -> Column:
    """A marked JSON text as JSON."""
    return F.when(F.contains(text, F.lit(MARK)), _each(text, TOKEN, _unmarked)).otherwise(text)


def shown(text: Column) -> Column:
    """A marked JSON text as it is shown: lists and objects of any depth joined by comma and space, objects as k=v."""
    show = lambda t: F.when(t.isin("[", "]", "{", "}", ':""'), "").when(t == ":", "=").when(t == ",", ", ").otherwise(_bare(_unmarked(t)))
    return _each(text, TOKENS_SHOWN, show)


def json_cell(json: Column, path: str, compare: bool = False) -> Column:
    """Text of the value at a dotted path: a missing or null one as ``null``, lists joined by comma and space, objects as k=v.

    A key with an empty text shows alone, at any depth. For comparisons a list or an object is its JSON
    text, but an object whose state is a text reads ``state (reason)``, or the state alone without a reason
    text, and a missing or null value reads ``-``.
    """
    return value_cell(parsed(json), path, compare)


def value_cell(value: Column, path: str, compare: bool = False) -> Column:
    """``json_cell`` of a text that is parsed already."""
    text = value_text(value, path)
    return F.coalesce(let(text, _compared), F.lit("-")) if compare else F.coalesce(shown(text), F.lit("null"))


def _compared(text: Column) -> Column:
    is_object, is_list = F.startswith(text, F.lit("{")), F.startswith(text, F.lit("["))
    fields = F.when(is_object & F.contains(text, F.lit('"state":')), F.struct(*[_text_at(text, name).alias(name) for name in ("state", "reason")]))
    judged = lambda f: F.when(F.coalesce(f["reason"], F.lit("")) == "", f["state"]).otherwise(F.concat(f["state"], F.lit(" ("), f["reason"], F.lit(")")))
    return F.when(text == "null", "-").when(is_object | is_list, F.coalesce(let(fields, judged), plain_json(text))).otherwise(_bare(_unmarked(text)))


def _text_at(text: Column, name: str) -> Column:
    """The text at a key; null for any other value, as for a number behind a mark."""
    found = F.to_json(F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant"))
    is_text = lambda t: F.startswith(t, F.lit('"')) & (F.startswith(t, F.lit(f'"{MARK}{MARK}')) | ~F.startswith(t, F.lit(f'"{MARK}')))
    return let(found, lambda t: F.when(is_text(t), _bare(_unmarked(t))))
