"""Personal data, with DataFrame functions alone: regular expressions propose
spans, validators (Luhn, mod-97, digit counts) confirm them, and context words
nearby adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import digits, gaps, joined, named, spans

#: Characters looked at on either side of a proposed span.
CONTEXT = 40
#: Score from which a proposal of the method's own kinds is reported.
THRESHOLD = 0.6

#: Patterns are written so that a scan is linear: a run is entered at its start
#: only (or where the last match ended), and taken without backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: Runs of 13 digits or more: as a run is taken whole, shorter ones have no part that would pass.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"

CARD_WORDS = r"(?i)\b(?:card|visa|master ?card|amex|credit|debit|karte|carte|tarjeta)\b"
BANK_WORDS = r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|transfer)\b"
ID_WORDS = r"(?i)\b(?:ssn|social security|insurance|tax id|national id)\b"
#: Words that speak against a person's data: sample and order numbers.
AGAINST = r"(?i)\b(?:example|sample|order|invoice|version|isbn|serial)\b"


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN's check digits hold (ISO 7064 mod 97-10)."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.left(account, F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def score(span: Column, base: float, valid: Column, words: str) -> Column:
    """Base of the pattern, 0.4 for a validator that confirms (none without),
    0.3 for a context word, 0.3 less for a word that speaks against it."""
    near = F.concat(span["before"], F.lit(" \n "), span["after"])
    return F.when(valid, F.lit(base + 0.4) + F.when(near.rlike(words), 0.3).otherwise(0.0) - F.when(near.rlike(AGAINST), 0.3).otherwise(0.0)).otherwise(F.lit(0.0))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, arrays of spans by kind, ``_base`` and ``_all``.

    Works in one scan without a shuffle; texts are read whole. A null text is
    empty; repeated rows each give a row; null ids stay null; other columns
    are ignored; an empty table gives an empty one.
    """
    kinds = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "national_id": NATIONAL_ID}
    text = F.col("_text")
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    out = out.select("doc_id", "_text", *(gaps(text, p).alias(f"_g_{k}") for k, p in kinds.items()))
    out = out.select("doc_id", *(F.when(F.col(f"_g_{k}").isNotNull(), spans(text, p, F.col(f"_g_{k}"), 0 if k in ("email", "ip", "phone") else CONTEXT)).alias(f"_f_{k}") for k, p in kinds.items()))

    def digit_count(x: Column, low: int, high: int) -> Column:
        return F.length(digits(x["v"])).between(low, high)

    def card(x: Column) -> Column:
        return F.when(digit_count(x, 16, 19), luhn(digits(x["v"]))).otherwise(F.lit(False))

    def short_card(x: Column) -> Column:
        return F.when(digit_count(x, 13, 15), score(x, 0.0, luhn(digits(x["v"])), CARD_WORDS) >= THRESHOLD).otherwise(F.lit(False))

    def ip(x: Column) -> Column:
        return F.forall(F.split(x["v"], r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.right(p, F.lit(3)).cast("int") <= 255))

    rules = (
        ("email", "email", None), ("ip", "ip", ip), ("card", "card", card), ("phone", "phone", lambda x: digit_count(x, 8, 15)),
        ("iban", "iban", lambda x: score(x, 0.3, mod97(F.replace(x["v"], F.lit(" "), F.lit(""))), BANK_WORDS) >= THRESHOLD),
        ("national_id", "national_id", lambda x: score(x, 0.0, F.lit(True), ID_WORDS) >= THRESHOLD),
        ("short_card", "card", short_card),
    )
    none = F.array().cast("array<struct<k:int,s:int,e:int,t:string>>")
    out = out.select("doc_id", *(F.coalesce(named(F.col(f"_f_{source}"), kind, i, keep), none).alias(kind) for i, (kind, source, keep) in enumerate(rules)))
    base = F.concat("email", "ip", "card", "phone")
    return out.select("*", joined(base, False).alias("_base"), joined(F.concat(base, "iban", "national_id", "short_card"), False).alias("_all"))
