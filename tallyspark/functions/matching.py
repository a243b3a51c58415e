"""Column functions that decide whether two invoices look alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say what kind of company a supplier is.
LEGAL_SUFFIXES = ["ltd", "limited", "llc", "l l c", "inc", "incorporated", "plc", "gmbh", "pty", "corp", "corporation", "co", "company", "llp", "lp", "sa", "bv", "ag"]
# Words that name a branch or site.
BRANCH_WORDS = [
    "north", "south", "east", "west", "northern", "southern", "eastern", "western",
    "northeast", "northwest", "southeast", "southwest", "central", "upper", "lower",
    "inner", "outer", "first", "second", "third", "fourth", "fifth",
    "one", "two", "three", "four", "five", "ii", "iii", "iv",
]

DEFAULT_CURRENCY = "GBP"


def normal_currency(currency: Column) -> Column:
    """Upper case; a blank or missing currency is the default."""
    return F.upper(F.coalesce(F.when(currency != "", currency), F.lit(DEFAULT_CURRENCY)))


def normal_vendor(name: Column) -> Column:
    """Lower-case words without punctuation and legal suffixes; a name of suffixes only keeps them."""
    base = F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    kept = F.filter(F.split(base, " "), lambda w: ~w.isin(LEGAL_SUFFIXES))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(base)


def normal_invoice_number(number: Column) -> Column:
    """Lower-case letters and digits; zeros between a leading word and the next digit are dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(number), "[^a-z0-9]", ""), "^([a-z]*)0+([0-9])", "$1$2")


def vendor_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, for names in normal form."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def differs_only_by_branch(a: Column, b: Column) -> Column:
    """Whether names in normal form differ, and only by words that name a branch or a number."""
    left, right = F.split(a, " "), F.split(b, " ")
    odd = F.filter(F.array_union(F.array_except(left, right), F.array_except(right, left)), lambda w: w != "")
    return (F.size(odd) > 0) & F.forall(odd, lambda w: w.isin(BRANCH_WORDS) | w.rlike("^[0-9]+$"))


def days_between(a: Column, b: Column) -> Column:
    """Whole days between two dates; null, which no limit admits, if either is missing."""
    return F.abs(F.datediff(a, b))


def cents(amount: Column) -> Column:
    return F.round(amount * 100, 0).cast("long")


def is_transposition(a: Column, b: Column) -> Column:
    """Whether two amounts in cents differ by one swap of neighbouring digits."""
    return F.array_contains(neighbour_swaps(a), cents(b).cast("string"))


def neighbour_swaps(amount: Column) -> Column:
    """All texts that one swap of different neighbouring digits makes of an amount in cents."""
    text = cents(amount).cast("string")
    places = F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    unlike = F.filter(places, lambda i: F.substring(text, i, F.lit(1)) != F.substring(text, i + 1, F.lit(1)))
    return F.transform(
        unlike,
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.lit(1)), F.substring(text, i, F.lit(1)), F.substring(text, i + 2, F.length(text))),
    )


def raised_swaps(amount: Column) -> Column:
    """The larger amounts that one swap of neighbouring digits makes of an amount in whole cents."""

    def swapped(k: int) -> Column:
        low, high = F.expr(f"{10**k}L"), F.expr(f"{10 ** (k + 1)}L")
        right, left = F.call_function("div", amount, low) % 10, F.call_function("div", amount, high) % 10
        return F.when((amount >= high) & (right > left), amount + (right - left) * 9 * low)

    return F.array_compact(F.array(*(swapped(k) for k in range(15))))


def normal_bank(account: Column) -> Column:
    """The last four digits, filled with zeros in front."""
    return F.lpad(F.right(F.regexp_replace(F.coalesce(account, F.lit("")), "[^0-9]", ""), F.lit(4)), 4, "0")


def cadence_tolerance(cadence: Column) -> Column:
    return F.greatest(F.lit(3.0), cadence * 0.15)


def on_schedule(gap: Column, cadence: Column) -> Column:
    """Whether a gap in days lies on the beat of a cadence."""
    return F.abs(gap - cadence) <= cadence_tolerance(cadence)


def schedule_cadence(dates: Column) -> Column:
    """The median gap of an array of dates that keep a steady beat, else null.

    Three dates at least, a median of five days at least, and seven tenths of the gaps on the beat.
    For whole tables the rekeyed rule finds the same by windows; this form serves arrays.
    """
    sorted_dates = F.array_sort(F.filter(dates, lambda d: d.isNotNull()))
    places = F.when(F.size(sorted_dates) > 1, F.sequence(F.lit(1), F.size(sorted_dates) - 1)).otherwise(F.array().cast("array<int>"))
    gaps = F.array_sort(F.transform(places, lambda i: F.datediff(F.get(sorted_dates, i), F.get(sorted_dates, i - 1))))
    n = F.size(gaps)
    upper, lower = F.get(gaps, F.floor(n / 2).cast("int")), F.get(gaps, F.floor((n - 1) / 2).cast("int"))
    median = (upper + lower) / 2
    held = F.size(F.filter(gaps, lambda g: on_schedule(g, median)))
    return F.when((F.size(sorted_dates) >= 3) & (median >= 5) & (held * 10 >= n * 7), median)
