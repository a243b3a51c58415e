"""Column settlement on random header rows against a plain search, and numbers as text."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from tallyspark.functions.sentences import two_places
from tallyspark.operators import mapping


def header_rows(seed, number):
    rng = random.Random(seed)
    known = [p.title() for phrases in mapping.PHRASES.values() for p in phrases]
    odd = ["", "Cost Centre", "Invoice Reference", "Payment Details", "Due Date", "Supplier Code", "VAT Amount", "Invoce No", "Net  Amnt", "Line No", "Bank", "Doc Ref", 'Say "Net"']
    return [[rng.choice(known if rng.random() < 0.6 else odd) for _ in range(rng.randint(0, 9))] for _ in range(number)]


def plain(header):
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in header.lower()).split())


def fixed(x):
    return str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))


def expected(names, score, chosen):
    """{field: (column, confidence, reason)}; ``score(field, column)`` gives (score, why)."""
    fields, required = mapping.FIELDS, mapping.REQUIRED
    out, owner = {}, {}
    for f in fields:
        if f in chosen:
            want = chosen[f]
            hits = [] if want is None else [want] if isinstance(want, int) and want < len(names) else [i for i, n in enumerate(names) if not isinstance(want, int) and plain(n) == plain(want)]
            if hits:
                owner[hits[0]] = f
                out[f] = (hits[0], 1.0, f'you chose "{names[hits[0]]}" for {f}')
            else:
                shown = f"column {want}" if isinstance(want, int) else f'"{want}"'
                out[f] = (None, 0.0, f"you left {f} without a column" if want is None else f"you mapped {f} to {shown}, which this header row does not have")
    bids = sorted((-score(f, c)[0], c, fields.index(f)) for f in fields for c in range(len(names)))

    def win(f, c, note=""):
        own, why = score(f, c)
        owner[c] = f
        rivals = [(-s, d) for s, d, k in bids if fields[k] == f and d != c and -s > 0]
        sure, doubt = own, ""
        if rivals and own - rivals[0][0] < 0.15:
            sure = own - (0.15 - (own - rivals[0][0]))
            doubt = f'; "{names[rivals[0][1]]}" scored almost as well ({fixed(rivals[0][0])}) and may be the right column instead'
        out[f] = (c, max(0.0, int(sure * 100 + 0.5) / 100), why + doubt + note)

    def auction():
        for s, c, k in bids:
            if -s >= 0.35 and fields[k] not in out and c not in owner:
                win(fields[k], c)

    auction()
    robbed = {}
    for f in required:
        if f not in out:
            loot = [c for s, c, k in bids if fields[k] == f and -s >= 0.35 and owner.get(c) not in (None, *required)]
            if loot:
                loser = owner[loot[0]]
                robbed[loser] = (f, loot[0])
                del out[loser]
                win(f, loot[0], f"; {loser} matched this column more closely, but {loser} is optional and an import with no {f} cannot run at all")
    auction()
    for f in fields:
        if f in out:
            continue
        near = [(-s, c) for s, c, k in bids if fields[k] == f and -s > 0][:1]
        if f in robbed:
            taker, c = robbed[f]
            reason = f'{f} has no column of its own: "{names[c]}" was the best evidence for it, but {taker} is required and had no other candidate, so the column went there'
        elif not near:
            reason = f"no column in this header row resembles {f}"
        elif near[0][0] >= 0.35 and near[0][1] in owner:
            reason = f'{f} has no column of its own: "{names[near[0][1]]}" scored {fixed(near[0][0])} for it, but is a stronger match for {owner[near[0][1]]}'
        else:
            reason = f'no column matched {f}; the nearest was "{names[near[0][1]]}" at {fixed(near[0][0])}, below the 0.35 threshold'
        out[f] = (None, 0.0, reason)
    return out


def test_random_headers(spark):
    rows = header_rows(1, 150)
    heads = spark.createDataFrame([(f"f{i}", r) for i, r in enumerate(rows)], "file_id string, cells array<string>")
    scored = mapping.header_scores(heads.select(F.explode("cells").alias("header"))).collect()
    score = {(r.header, r.field): (r.score, r.why) for r in scored}
    for chosen in ({}, {"reference": 1, "amount": "net amount", "currency": None}, {"bankLast4": "Nowhere", "invoiceDate": 0}):
        got = {}
        for r in mapping.suggest_mapping(heads, chosen).collect():
            got.setdefault(r.file_id, {})[r.field] = (r.column, r.confidence, r.reason)
        for i, names in enumerate(rows):
            want = expected(names, lambda f, c: score[names[c], f], chosen)  # noqa: B023
            assert got[f"f{i}"] == want, names


def test_two_places(spark):
    values = [k / 1000 for k in range(0, 1200, 5)] + [0.575, 1.005, 0.625, 0.125, 0.44999999999999996]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", two_places(F.col("x")).alias("text")).collect()
    assert all(r.text == fixed(r.x) for r in rows)
