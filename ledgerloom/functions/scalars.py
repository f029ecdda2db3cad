"""Column expressions over bank text, money and labels."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.thresholds import FAMILY, NON_SPEND, SUBCATEGORY_ALIASES, UPI_NOISE


def _blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def counterparty_key(desc: Column) -> Column:
    """Second segment of ``UPI/NAME/…``, white space collapsed, upper case; else null."""
    parts = F.split(desc, "/")
    name = _blank_to_null(F.upper(_squeeze(F.get(parts, F.lit(1)))))
    return F.when(F.upper(F.trim(F.get(parts, F.lit(0)))) == "UPI", name)


def parse_upi(desc: Column, noise=UPI_NOISE) -> Column:
    """struct(vpa, ref, note) of a UPI description, null for any other."""
    parts = F.filter(F.transform(F.split(desc, "/"), lambda x: F.trim(x)), lambda x: x != "")
    segments = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    vpa = F.get(F.filter(segments, lambda x: x.rlike(r"(?U)^[\w.\-]{2,}@[A-Za-z]\w*$")), F.lit(0))
    ref = F.get(F.filter(segments, lambda x: x.rlike(r"(?U)^\d{6,}$")), F.lit(0))
    last = F.get(segments, F.size(segments) - 1)
    kept = (F.size(segments) >= 2) & ~F.upper(last).isin([n.upper() for n in noise]) & ~last.eqNullSafe(vpa) & ~last.eqNullSafe(ref)
    value = F.struct(vpa.alias("vpa"), ref.alias("ref"), F.when(kept, last).alias("note"))
    return F.when(F.upper(F.get(parts, F.lit(0))) == "UPI", value)


def strip_upi_ref(desc: Column) -> Column:
    """Drop the reference segment of a UPI description and the note "UPI"; others stay."""
    pattern = r"(?i)^(UPI/[^/]+)/\d{4,}/([^\n]*)$"
    trimmed = F.trim(desc)
    head, note = F.regexp_extract(trimmed, pattern, 1), F.trim(F.regexp_extract(trimmed, pattern, 2))
    short = F.when((note == "") | (F.upper(note) == "UPI"), head).otherwise(F.concat(head, F.lit("/"), note))
    return F.coalesce(F.when(trimmed.rlike(pattern), short).otherwise(desc), F.lit(""))


def embed_text(debit_credit: Column, desc: Column, note: Column) -> Column:
    """Lower-cased direction, description without reference, and note; blanks are skipped."""
    parts = [_blank_to_null(debit_credit), _blank_to_null(strip_upi_ref(desc)), _blank_to_null(note)]
    return F.lower(F.trim(F.concat_ws(" ", *parts)))


def parse_string_list(text: Column) -> Column:
    """A JSON array, or comma-separated text, as an array; null and empty give none."""
    plain = F.filter(F.split(text, ","), lambda x: x != "")
    parsed = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
    return F.coalesce(F.when(text == "", F.array().cast("array<string>")), parsed, plain, F.array().cast("array<string>"))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` names it; this also keeps generated code small."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _digits(text: Column) -> Column:
    return (text != "") & (F.translate(text, "0123456789", "") == "")


def parse_amount(cell: Column) -> Column:
    """struct(value decimal, direction) of a money cell, null if it is not one.

    A word for credit or debit that stands alone gives the direction, credit before
    debit; what is left without signs of the currency must be one number, in which
    commas may stand anywhere after the first digit. Signs are dropped.
    """
    text = F.concat(F.lit(" "), F.upper(F.translate(cell, "\n₹", " ")), F.lit(" "))
    marks = {d: [f" {w}{dot} " for w in words for dot in ("", ".")] for d, words in (("credit", ("CR", "CREDIT")), ("debit", ("DR", "DEBIT")))}
    has = {d: functools.reduce(operator.or_, [text.contains(m) for m in own]) for d, own in marks.items()}
    for label in [*marks["credit"], *marks["debit"]]:
        text = F.replace(text, F.lit(label), F.lit(" "))
    for label in ("INR", "RS.", "RS"):
        text = F.replace(text, F.lit(label), F.lit(""))
    direction = F.when(has["credit"], "credit").when(has["debit"], "debit")

    def read(signed: Column) -> Column:
        return _let(F.when(signed.startswith("-"), F.substr(signed, F.lit(2))).otherwise(signed), number)

    def number(plain: Column) -> Column:
        whole = F.substring_index(plain, ".", 1)
        rest = F.substr(plain, F.length(whole) + 2)
        good = _digits(F.translate(whole, ",", "")) & ~whole.startswith(",") & (~plain.contains(".") | _digits(rest))
        return F.when(good, F.translate(plain, ",", "").try_cast("decimal(18,2)"))

    value = _let(F.ltrim(F.trim(text), F.lit("+")), read)
    return F.get(F.filter(F.array(F.struct(value.alias("value"), direction.alias("direction"))), lambda x: x["value"].isNotNull()), F.lit(0))


#: Accepted layouts of dates, in the order in which they are tried, each with the texts it may read.
DATE_FORMATS = [
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yy", r"^\d{1,2}-\d{1,2}-\d{2}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("d MMM, yyyy", r"^\d{1,2} [A-Za-z]{3}, \d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("d-MMM-yy", r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]{4,} \d{4}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
]


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_statement_date(cell: Column) -> Column:
    """The date in a cell if an accepted layout reads it; two-digit years are 2000 to 2068.

    The text's shape says in which order day, month and year stand; months are numbers,
    names or the first three letters of names, in any case.
    """
    shapes: dict[str, list[str]] = {}
    for layout, shape in DATE_FORMATS:
        shapes.setdefault("".join(dict.fromkeys(c for c in layout if c in "dMy")), []).append(shape)

    def month(text: Column) -> Column:
        place = F.when(F.length(text) == 3, F.array_position(F.lit([m[:3] for m in MONTHS]), text)).otherwise(F.array_position(F.lit(list(MONTHS)), text))
        return F.when(_digits(text), text).otherwise(F.nullif(place, F.lit(0)).cast("string"))

    def date(words: Column) -> Column:
        day, name, year = (F.get(words, F.lit(i)) for i in range(3))
        short = F.length(year) == 2
        full = F.when(short & (year > "68"), None).when(short, F.concat(F.lit("20"), year)).otherwise(year)
        return F.concat_ws("-", full, F.lpad(month(F.lower(name)), 2, "0"), F.lpad(day, 2, "0"))

    def read(clean: Column) -> Column:
        words = F.split(F.regexp_replace(clean, "[-/., ]+", " "), " ")
        ordered = None
        for order, own in shapes.items():
            test, value = clean.rlike("|".join(own)), F.array(*[F.get(words, F.lit(order.index(c))) for c in "dMy"])
            ordered = F.when(test, value) if ordered is None else ordered.when(test, value)
        return _let(ordered, date)

    text = _let(F.trim(F.translate(cell, "\n", " ")), read)
    return F.get(F.filter(F.array(text), lambda x: F.length(x) == 10), F.lit(0)).try_cast("date")


#: What the rows of a statement's balances begin with.
OPENING = ("opening balance", "balance b/f", "balance brought forward", "b/f")
CLOSING = ("closing balance", "balance c/f", "balance carried forward", "c/f")


def _begins(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text begins with a phrase that ends where a word does."""
    ends = lambda n: ~F.substr(text, F.lit(n + 1), F.lit(1)).rlike(r"\w")
    return functools.reduce(operator.or_, [text.startswith(x) & ends(len(x)) for x in phrases])


def balance_artifact(desc: Column) -> Column:
    """"opening" or "closing" for a statement's balance rows, else null."""
    text = F.lower(_squeeze(desc))
    return F.when(_begins(text, OPENING), "opening").when(_begins(text, CLOSING), "closing")


def account_ref(header: Column) -> Column:
    """Account number in a statement's header, masked digits allowed, at least one plain; upper case.

    Each mention of an account is looked at: after a word for number and a colon or
    hyphen, if any, stand 6 to 20 digits, masks and hyphens. The first that fits counts.
    """

    def number(after: Column) -> Column:
        text = F.ltrim(after)
        named = None
        for word in ("number", "no.", "no", "#"):
            test, value = text.startswith(word), F.ltrim(F.substr(text, F.lit(len(word) + 1)))
            named = F.when(test, value) if named is None else named.when(test, value)
        text = named.otherwise(text)
        text = F.when(text.startswith(":") | text.startswith("-"), F.ltrim(F.substr(text, F.lit(2)))).otherwise(text)
        return F.substring(F.get(F.split(text, "[^0-9x*-]", 2), F.lit(0)), 1, 20)

    fits = lambda x: (F.length(x) >= 6) & ~x.startswith("-") & (F.translate(x, "0123456789", "") != x)
    mentions = F.split(F.lower(F.translate(header, "\n\r\t", "   ")), "account|a/c")
    found = F.filter(F.transform(F.slice(mentions, 2, F.greatest(F.size(mentions), F.lit(1))), number), fits)
    return _blank_to_null(F.upper(F.get(found, F.lit(0))))


#: Bank names looked for in a header, in order.
BANK_NAMES = (
    "hdfc", "icici", "sbi", "state bank", "axis", "kotak", "yes bank",
    "idfc", "indusind", "punjab national", "canara", "union bank",
    "bank of baroda", "federal", "rbl", "au small finance",
)


def bank_label(header: Column) -> Column:
    """"kotak" for the dedicated layout, else the first known bank with " (auto)", else "generic"."""
    low = F.lower(header)
    out = F.when(low.contains("kotak"), "kotak")
    for name in BANK_NAMES:
        out = out.when(low.contains(name), f"{name} (auto)")
    return out.otherwise("generic")


def relationship_subcategory(relationship: Column) -> Column:
    return F.when(F.lower(F.trim(relationship)).isin(*FAMILY), "Family").otherwise("Peer Transfer")


def canonical_subcategory(sub: Column) -> Column:
    """Aliases to one name; null and empty to "Other"."""
    out = F.when(sub.isNull() | (sub == ""), "Other")
    for alias, name in SUBCATEGORY_ALIASES.items():
        out = out.when(F.lower(F.trim(sub)) == alias, name)
    return out.otherwise(F.trim(sub))


def spend_category(category: Column) -> Column:
    return F.coalesce(category, F.lit("Uncategorized"))


def is_spend(category: Column) -> Column:
    return ~spend_category(category).isin(*NON_SPEND)


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def prev_month(month: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), -1), "yyyy-MM")


def next_month(month: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1), "yyyy-MM")


def month_index(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def money(col: Column) -> Column:
    """A decimal sum as a double with two places, null as 0."""
    return F.round(F.coalesce(col, F.lit(0)).cast("decimal(38,2)"), 2).cast("double")


def classify_feedback(old: dict[str, Column], new: dict[str, Column], sent: dict[str, Column]) -> Column:
    """"corrected", "refined" or "confirmed" from the label before, the edit, and which fields it sends."""
    corrected = sent["category"] & new["category"].isNotNull() & ~new["category"].eqNullSafe(old["category"])
    refined = F.lit(False)
    for name in ("subcategory", "merchant", "tags"):
        if name in new:
            refined = refined | (sent[name] & ~new[name].eqNullSafe(old[name]))
    return F.when(corrected, "corrected").when(refined, "refined").otherwise("confirmed")


def grams(text: Column, q: int) -> Column:
    """The different runs of ``q`` characters of a text; none for a shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - q + 1)
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))
