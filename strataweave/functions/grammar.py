"""Conditions in a text, as typed predicates: parameter, operator, value and unit, and the value in a base unit."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The units that a condition may have, their base unit and how many of it they are.
UNITS = {
    "メガパスカル": ("Pa", "1000000"),
    "MPa": ("Pa", "1000000"),
    "キロパスカル": ("Pa", "1000"),
    "kPa": ("Pa", "1000"),
    "パスカル": ("Pa", "1"),
    "ミリメートル": ("m", "0.001"),
    "mm": ("m", "0.001"),
    "ミリ": ("m", "0.001"),
    "センチメートル": ("m", "0.01"),
    "cm": ("m", "0.01"),
    "メートル": ("m", "1"),
    "度": ("度", "1"),
    "℃": ("度", "1"),
    "°C": ("度", "1"),
    "%": ("%", "1"),
    "パーセント": ("%", "1"),
    "リットル": ("L", "1"),
    "ℓ": ("L", "1"),
    "l": ("L", "1"),
    "L": ("L", "1"),
    "キログラム": ("g", "1000"),
    "kg": ("g", "1000"),
    "グラム": ("g", "1"),
    "時間": ("時間", "1"),
    "年": ("年", "1"),
    "月": ("月", "1"),
    "日": ("日", "1"),
    "件": ("件", "1"),
    "名": ("人", "1"),
    "人": ("人", "1"),
    "回": ("回", "1"),
    "割": ("%", "10"),
    "パーミル": ("%", "0.1"),
    "‰": ("%", "0.1"),
}
OPERATORS = {"以上": ">=", "以下": "<=", "未満": "<", "を超える": ">", "を超え": ">", "超える": ">", "超": ">"}
KANJI_DIGITS = {c: n for n, c in enumerate("〇一二三四五六七八九")} | {"零": 0}
KANJI_UNITS = {"十": 10, "百": 100, "千": 1000}
KANJI_GROUPS = {"万": 10_000, "億": 10**8}

_NUMBER = r"(?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?[万億]?|[〇零一二三四五六七八九十百千万億]+(?:[・.][〇零一二三四五六七八九]+)?)"
_longest_first = lambda words: "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
_PREDICATE = re.compile(rf"({_NUMBER})\s*({_longest_first(UNITS)})\s*({_longest_first(OPERATORS)})")
_PARTICLES = " \t\n\r　のがはをにでとへやもか、。「」『』（）()･・,:：;；"
_NAME = re.compile(r"[一-龯ァ-ヶー]{2,10}\Z")
_OTHER_NAME = re.compile(r"[^\s、。「」『』（）()･・,:：;；0-9〇一-龯ぁ-ん]+\Z")
#: How far before a value its parameter may stand.
_REACH = 12
_PREDICATES = "array<struct<parameter:string,operator:string,value:decimal(38,9),unit:string,base_value:decimal(38,9),base_unit:string,raw:string>>"


def number(text: str) -> Decimal:
    """The number that decimal digits or Chinese numerals write, with a fraction where there is one."""
    if text[0] in "0123456789":
        scale = KANJI_GROUPS.get(text[-1], 1)
        return Decimal(text.rstrip("万億").replace(",", "")) * scale
    whole, _, rest = text.replace(".", "・").partition("・")
    total = group = digits = 0
    for c in whole:
        if c in KANJI_DIGITS:
            digits = digits * 10 + KANJI_DIGITS[c]
        elif c in KANJI_UNITS:
            group += (digits or 1) * KANJI_UNITS[c]
            digits = 0
        else:
            total += (group + digits or 1) * KANJI_GROUPS[c]
            group = digits = 0
    fraction = "".join(str(KANJI_DIGITS[c]) for c in rest)
    return Decimal(f"{total + group + digits}.{fraction or 0}")


def parse(text: str | None) -> list[dict]:
    """The predicates of a text in order; full-width letters and digits count as plain ones."""
    out = []
    plain = unicodedata.normalize("NFKC", (text or "").replace("℃", "\0").replace("ℓ", "\1").replace("・", "\2"))
    plain = plain.replace("\0", "℃").replace("\1", "ℓ").replace("\2", "・")
    for m in _PREDICATE.finditer(plain):
        before = plain[max(0, m.start() - _REACH) : m.start()].rstrip(_PARTICLES)
        name = _NAME.search(before) or _OTHER_NAME.search(before)
        value, (base, factor) = number(m[1]), UNITS[m[2]]
        if abs(value) < 10**20:
            out.append({"parameter": name[0] if name else "?", "operator": OPERATORS[m[3]], "value": value, "unit": m[2], "base_value": value * Decimal(factor), "base_unit": base, "raw": m[0]})
    return out


def predicates(text: Column) -> Column:
    """The predicates of a text: ``parameter, operator, value, unit, base_value, base_unit, raw``.

    A predicate is a number, a unit and an operator, one after the other.
    Values are exact decimals. The parameter is the name that stands before, a
    particle between them or not; ``?`` if there is none. A text without
    predicates, or null, gives an empty array.
    """
    amount = pa.decimal128(38, 9)
    struct = pa.struct([("parameter", pa.string()), ("operator", pa.string()), ("value", amount), ("unit", pa.string()), ("base_value", amount), ("base_unit", pa.string()), ("raw", pa.string())])
    quantum = Decimal(1).scaleb(-9)

    @F.arrow_udf(_PREDICATES)
    def parsed(texts: pa.Array) -> pa.Array:
        rows = [[{k: v.quantize(quantum) if isinstance(v, Decimal) else v for k, v in p.items()} for p in parse(t)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(struct))

    return parsed(text)
