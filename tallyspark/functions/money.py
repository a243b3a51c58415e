"""Amounts as text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.matching import DEFAULT_CURRENCY

# How British English writes the common currencies.
SYMBOLS = {
    "GBP": "£", "EUR": "€", "USD": "US$", "JPY": "JP¥", "INR": "₹", "CAD": "CA$", "AUD": "A$", "NZD": "NZ$", "CNY": "CN¥",
    "HKD": "HK$", "ILS": "₪", "KRW": "₩", "MXN": "MX$", "TWD": "NT$", "VND": "₫", "BRL": "R$", "PHP": "₱",
}


def number_text(amount: Column, digits: int = 2) -> Column:
    """An amount with thousands commas and fixed decimals, rounded half up."""
    return F.format_number(F.round(amount, digits), digits)


def money_text(amount: Column, currency: Column, digits: int = 2) -> Column:
    """An amount with its currency's sign, or its code where the sign is unknown or the code malformed."""
    code = F.upper(F.trim(F.coalesce(F.when(currency != "", currency), F.lit(DEFAULT_CURRENCY))))
    symbol = F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SYMBOLS.items())), code)
    plain = number_text(F.abs(amount), digits)
    minus = F.when(F.round(amount, digits) < 0, "-").otherwise("")
    led = F.concat(minus, F.coalesce(symbol, F.concat(code, F.lit(" "))), plain)
    return F.when(code.rlike("^[A-Z]{3}$"), led).otherwise(F.concat(minus, plain, F.lit(" "), code))


def mixed_text(amount: Column) -> Column:
    """A total over several currencies."""
    return F.concat(number_text(amount), F.lit(" (mixed currencies)"))
