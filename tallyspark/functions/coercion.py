"""Column functions that turn a cell's text into a date, an amount or a currency, or say why not.

Each returns a struct with the value and a reason; exactly one of them is null, but for a blank
currency, which has neither.

Dates and amounts are read in steps, each of which names what the later ones need.  ``parse_date`` and
``parse_amount`` join the steps into one expression; ``read_column`` lays them out as columns of a
table, so that whole-stage code reads every cell once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.model import AMOUNT

# White space, as the original importer strips it.
SPACE = "\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
# The same, character by character.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Month names and their short forms.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
# Currency signs in the order in which they are looked for; a later one counts.
CURRENCY_SYMBOLS = {"£": "GBP", "$": "USD", "€": "EUR", "¥": "JPY", "₹": "INR", "₨": "PKR"}
# The date layouts that are read, in this order.
YEAR_FIRST = "^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$"
COMPACT = "^([0-9]{4})([0-9]{2})([0-9]{2})$"
DAY_NAMED = "^([0-9]{1,2})[\\s\\-/.]*([A-Za-z]{3,9})\\.?[\\s\\-/.,]*([0-9]{2}|[0-9]{4})$"
NAMED_DAY = "^([A-Za-z]{3,9})\\.?[\\s\\-/.]*([0-9]{1,2})[\\s\\-/.,]*([0-9]{2}|[0-9]{4})$"
NUMERIC = "^([0-9]{1,2})[-/. ]([0-9]{1,2})[-/. ]([0-9]{2}|[0-9]{4})$"
TIME_TAIL = "(?i)[T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?(\\.[0-9]+)?\\s*(Z|[+-][0-9]{2}:?[0-9]{2})?$"


Fields = dict[str, Column]
Step = Callable[[Fields], Fields]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _only_if(test: Column, fields: Fields, names: list[str], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of some fields for the few rows that pass the test, else null.

    A lambda is not part of whole-stage code: sentences about bad cells would make its one method so
    large that the JVM never compiles it.
    """
    return F.when(test, let(F.struct(*(fields[name].alias(name) for name in names)), body))


def _joined(fields: Fields, steps: list[Step]) -> Column:
    """The last step's ``result`` as one expression."""
    if not steps:
        return fields["result"]
    whole = {**fields, **steps[0](fields)}
    if len(steps) == 1:
        return whole["result"]
    return let(F.struct(*(column.alias(name) for name, column in whole.items())), lambda row: _joined({name: row[name] for name in whole}, steps[1:]))


def read_column(rows: DataFrame, raw: Column, steps: list[Step], result: str) -> DataFrame:
    """``rows`` with the steps' result as the column ``result``; what a step names is a column in between."""
    kept = [*(c for c in rows.columns if c != result), result]
    fields: Fields = {"raw": raw}
    for step in steps:
        new = step(fields)
        rows = rows.withColumns({f"__{result}_{name}": column for name, column in new.items()})
        fields |= {name: F.col(f"__{result}_{name}") for name in new}
    return rows.withColumn(result, fields["result"]).select(*kept)


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(SPACES))


def _replaced(needed: Column, text: Column, pattern: str, new: str = "") -> Column:
    """``text`` with what matches replaced; a cheap test that each match passes spares most cells the pattern."""
    return F.when(needed, F.regexp_replace(text, pattern, new)).otherwise(text)


def _without_time(text: Column) -> Column:
    return strip(_replaced(text.contains(":"), text, TIME_TAIL))


def _group(text: Column, pattern: str, number: int) -> Column:
    return F.regexp_extract(text, pattern, number)


def _number(text: Column, pattern: str, number: int) -> Column:
    return _group(text, pattern, number).try_cast("int")


def _full_year(year: Column) -> Column:
    return F.when(year >= 100, year).when(year < 70, year + 2000).otherwise(year + 1900)


def _month_name(month: Column) -> Column:
    return F.get(F.array(*(F.lit(name) for name in MONTH_NAMES)), month - 1)


def _result(value: Column, reason: Column, kind: str) -> Column:
    return F.struct(value.cast(kind).alias("value"), reason.cast("string").alias("reason"))


def _quoted(shown: Column, *rest: Column | str) -> Column:
    return F.concat(F.lit('"'), shown, F.lit('"'), *(part if isinstance(part, Column) else F.lit(part) for part in rest))


def _pad(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def date_steps(order: Column | None = None) -> list[Step]:
    """Steps that read a date; ``order`` (dmy or mdy) is asked only where the text reads both ways."""
    order = F.lit(None).cast("string") if order is None else order
    layouts = [YEAR_FIRST, COMPACT, DAY_NAMED, NAMED_DAY, NUMERIC]
    months = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))

    def text(p: Fields) -> Fields:
        shown = F.coalesce(strip(p["raw"]), F.lit(""))
        return {"shown": shown, "s": _without_time(shown)}

    def layout(p: Fields) -> Fields:
        s = p["s"]
        compact = s.rlike(COMPACT) & _number(s, COMPACT, 1).between(1900, 2100)
        found = [s.rlike(YEAR_FIRST), compact, s.rlike(DAY_NAMED), s.rlike(NAMED_DAY), s.rlike(NUMERIC)]
        return {"kind": reduce(lambda chain, pair: chain.when(pair[1], pair[0]), list(enumerate(found))[1:], F.when(found[0], 0)).otherwise(-1)}

    def parts(p: Fields) -> Fields:
        def part(i: int) -> Column:
            cases = [(p["kind"] == k, _group(p["s"], pattern, i)) for k, pattern in enumerate(layouts)]
            return reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))

        return {"one": part(1), "two": part(2), "three": part(3)}

    def numbers(p: Fields) -> Fields:
        one, two, three = (p[name].try_cast("int") for name in ("one", "two", "three"))
        word = F.when(p["kind"] == 2, p["two"]).when(p["kind"] == 3, p["one"])
        return {"a": one, "b": two, "word": word, "named": F.when(word.isNotNull(), let(word, lambda w: F.element_at(months, F.lower(w)))), "y": F.when(p["kind"].isin(0, 1), one).otherwise(_full_year(three)), "last": three}

    def choice(p: Fields) -> Fields:
        a, b, kind = p["a"], p["b"], p["kind"]
        day_first = (a > 12) | ((b <= 12) & (a != b) & F.coalesce(order == "dmy", F.lit(False)))
        month_first = (b > 12) | (a == b) | F.coalesce(order == "mdy", F.lit(False))
        numeric = kind == 4
        return {
            "m": F.when(kind.isin(0, 1), b).when(kind.isin(2, 3), p["named"]).when(numeric & day_first, b).when(numeric & month_first, a),
            "d": F.when(kind.isin(0, 1), p["last"]).when(kind == 2, a).when(kind == 3, b).when(numeric & day_first, a).when(numeric & month_first, b),
            "open": numeric & ~day_first & ~month_first,
        }

    def length(p: Fields) -> Fields:
        return {"days": F.dayofmonth(F.last_day(F.try_to_date(F.concat_ws("-", _pad(p["y"], 4), _pad(p["m"], 2), F.lit("01")))))}

    def fault(p: Fields) -> Fields:
        a, b, kind = p["a"], p["b"], p["kind"]
        return {
            "fault": F.when(p["shown"] == "", 1)
            .when(kind == -1, 2)
            .when(p["word"].isNotNull() & p["named"].isNull(), 3)
            .when((kind == 4) & (a > 12) & (b > 12), 4)
            .when(p["open"], 5)
            .when(~p["m"].between(1, 12), 6)
            .when(~p["d"].between(1, p["days"]), 7)
            .otherwise(0)
        }

    def told(p: Fields) -> Fields:
        def reason(r: Column) -> Column:
            shown, a, b, y = r["shown"], r["a"], r["b"], r["y"].cast("string")
            both_ways = _quoted(
                shown, " is ambiguous: ", a.cast("string"), " ", _month_name(b), " ", y, " if the file is day-first, ", b.cast("string"), " ", _month_name(a), " ", y,
                ' if it is month-first — set dateOrder to "dmy" or "mdy"',
            )
            return (
                F.when(r["fault"] == 1, F.lit("the date is blank"))
                .when(r["fault"] == 2, _quoted(shown, " is not a date format this importer recognises"))
                .when(r["fault"] == 3, _quoted(shown, ' does not name a month I recognise ("', r["word"], '")'))
                .when(r["fault"] == 4, _quoted(shown, " has no valid month: neither ", a.cast("string"), " nor ", b.cast("string"), " can be one"))
                .when(r["fault"] == 5, both_ways)
                .when(r["fault"] == 6, _quoted(shown, " has month ", r["m"].cast("string"), ", which does not exist"))
                .when(r["fault"] == 7, _quoted(shown, " is not a real date — ", _month_name(r["m"]), " ", y, " has ", r["days"].cast("string"), " days"))
            )

        return {"reason": _only_if(p["fault"] > 0, p, ["fault", "shown", "a", "b", "word", "y", "m", "days"], reason)}

    def valued(p: Fields) -> Fields:
        date = F.try_to_date(F.concat_ws("-", _pad(p["y"], 4), _pad(p["m"], 2), _pad(p["d"], 2)))
        return {"result": _result(F.when(p["reason"].isNull(), date), p["reason"], "date")}

    return [text, layout, parts, numbers, choice, length, fault, told, valued]


def parse_date(raw: Column, order: Column | None = None) -> Column:
    """A date, or a reason.  ``order`` (dmy or mdy) is asked only where the text reads both ways."""
    return _joined({"raw": raw}, date_steps(order))


def is_ambiguous_date(raw: Column) -> Column:
    """Whether a date reads both ways."""
    s = _without_time(strip(raw))
    a, b = _number(s, NUMERIC, 1), _number(s, NUMERIC, 2)
    return F.when(s.rlike(NUMERIC), F.coalesce((a <= 12) & (b <= 12) & (a != b), F.lit(False))).otherwise(False)


def forced_order(raw: Column) -> Column:
    """The order that a date states for itself, or null."""
    s = _without_time(strip(raw))
    a, b = _number(s, NUMERIC, 1), _number(s, NUMERIC, 2)
    return F.when((a > 12) & (b <= 12), "dmy").when((b > 12) & (a <= 12), "mdy")


def comma_votes(raw: Column) -> Column:
    """1 if a cell writes its decimals with a comma, -1 with a dot, 0 if it cannot tell."""
    s = F.regexp_replace(raw, "[^0-9.,]", "")
    comma, dot = F.length(F.substring_index(s, ",", -1)), F.length(F.substring_index(s, ".", -1))
    return (
        F.when(s.contains(",") & s.contains("."), F.when(comma < dot, 1).otherwise(-1))
        .when(s.rlike(",[0-9]{1,2}$"), 1)
        .when(s.rlike("\\.[0-9]{1,2}$"), -1)
        .otherwise(0)
    )


def decimal_comma(votes: Column) -> Column:
    """Aggregate: a column writes decimal commas if two cells say so and none says otherwise."""
    return (F.count_if(votes == 1) > 1) & (F.count_if(votes == -1) == 0)


def amount_steps(comma: Column | None = None) -> list[Step]:
    """Steps that read an amount; ``comma`` says that its column writes decimal commas."""
    comma = F.lit(False) if comma is None else F.coalesce(comma, F.lit(False))
    coded = f"(^|[{SPACE}])([A-Za-z]{{3}})(?=$|[{SPACE}])"
    signs = "[" + "".join(CURRENCY_SYMBOLS).replace("$", "\\$") + "]"

    def inside(p: Fields) -> Fields:
        """The cell without brackets, which make it negative."""
        shown = F.coalesce(strip(p["raw"]), F.lit(""))
        bracketed = shown.startswith("(") & shown.rlike("^\\(.*\\)$")
        return {"shown": shown, "minus": bracketed, "s": F.when(bracketed, strip(F.regexp_extract(shown, "^\\((.*)\\)$", 1))).otherwise(shown)}

    def without_symbol(p: Fields) -> Fields:
        sign = reduce(lambda found, pair: F.when(p["s"].contains(pair[0]), pair[1]).otherwise(found), CURRENCY_SYMBOLS.items(), F.lit(None).cast("string"))
        return {"sign": sign, "bare": _replaced(sign.isNotNull(), p["s"], signs)}

    def without_code(p: Fields) -> Fields:
        lettered = p["bare"].rlike("[A-Za-z]{2}")
        code = F.when(lettered, let(p["bare"], lambda bare: F.nullif(F.regexp_extract(bare, coded, 2), F.lit(""))))
        # Only the first code is taken out.
        return {"lettered": lettered, "currency": F.coalesce(F.upper(code), p["sign"]), "plain": strip(_replaced(lettered, p["bare"], f"^(.*?){coded}", "$1 "))}

    def without_tag(p: Fields) -> Fields:
        s = p["plain"]
        tag = F.when(p["lettered"], F.upper(F.coalesce(F.nullif(F.regexp_extract(s, "(?i)^(CR|DR)\\b", 1), F.lit("")), F.nullif(F.regexp_extract(s, "(?i)(CR|DR)$", 1), F.lit("")))))
        rest = strip(F.regexp_replace(F.regexp_replace(s, f"(?i)^(CR|DR)[{SPACE}]*", ""), f"(?i)[{SPACE}]*(CR|DR)$", ""))
        return {"credit": F.coalesce(tag == "CR", F.lit(False)), "untagged": F.when(tag.isNotNull(), rest).otherwise(s)}

    def without_lead(p: Fields) -> Fields:
        led = p["untagged"].startswith("-")
        return {"led": led, "unled": strip(_replaced(led | p["untagged"].startswith("+"), p["untagged"], "^[+-]"))}

    def without_trail(p: Fields) -> Fields:
        minus = p["unled"].contains("-")
        digits = F.translate(_replaced(minus | p["unled"].contains("+"), p["unled"], "[+-]$"), SPACES, "")
        return {"negative": (p["minus"] != p["credit"]) != (p["led"] != (minus & p["unled"].rlike("-$"))), "digits": digits}

    def split(p: Fields) -> Fields:
        """How many digits stand behind the decimal mark; null if all marks group."""
        s = p["digits"]
        commas, dots = (F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit(""))) for mark in (",", "."))
        after_comma, after_dot = (F.length(F.substring_index(s, mark, -1)) for mark in (",", "."))
        decimals = (
            F.when((commas > 0) & (dots > 0), F.least(after_comma, after_dot))
            .when((commas == 1) & (dots == 0) & ((after_comma != 3) | comma), after_comma)
            .when((commas == 0) & (dots == 1) & (after_dot != 3), after_dot)
        )
        return {"good": s.rlike("^[0-9.,]*[0-9][0-9.,]*$"), "figures": F.translate(s, ".,", ""), "decimals": decimals}

    def valued(p: Fields) -> Fields:
        whole = F.when(p["decimals"].isNull(), p["figures"]).otherwise(F.left(p["figures"], F.length(p["figures"]) - p["decimals"]))
        fraction = F.when(p["decimals"].isNull(), "").otherwise(F.right(p["figures"], p["decimals"]))
        written = F.concat(F.lit("0"), whole, F.lit("."), fraction, F.lit("0"))
        # Read with more digits than are kept, so that rounding is half up and an overflow shows.
        return {"size": F.when(p["good"], F.round(written.try_cast("decimal(38,12)"), 4).try_cast(AMOUNT))}

    def told(p: Fields) -> Fields:
        blank, bad, huge = p["shown"] == "", ~p["good"], p["size"].isNull()

        def reason(r: Column) -> Column:
            return F.when(r["shown"] == "", F.lit("the amount is blank")).when(~r["good"], _quoted(r["shown"], " is not a number")).otherwise(_quoted(r["shown"], " is larger than a ledger can hold"))

        return {"reason": _only_if(blank | bad | huge, p, ["shown", "good"], reason)}

    def result(p: Fields) -> Fields:
        fine = p["reason"].isNull()
        value = F.when(p["negative"], -p["size"]).otherwise(p["size"]).cast(AMOUNT)
        return {"result": F.struct(F.when(fine, value).alias("value"), F.when(fine, p["currency"]).alias("currency"), p["reason"].alias("reason"))}

    return [inside, without_symbol, without_code, without_tag, without_lead, without_trail, split, valued, told, result]


def parse_amount(raw: Column, comma: Column | None = None) -> Column:
    """(value, currency, reason): an amount with the currency that its cell names."""
    return _joined({"raw": raw}, amount_steps(comma))


def coerce_currency(raw: Column) -> Column:
    """A currency code, nothing for a blank, or a reason."""
    s = strip(F.coalesce(raw, F.lit("")))
    symbol = F.element_at(F.create_map(*(F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair)), s)
    value = F.coalesce(symbol, F.when(s.rlike("^[A-Za-z]{2,5}$"), F.upper(s)))
    return _result(value, F.when((s != "") & value.isNull(), _quoted(s, " is not a currency code")), "string")


def bank_digits(raw: Column) -> Column:
    """The last four digits, or null without digits."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(digits != "", F.right(digits, F.lit(4)))
