"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksum validators (Luhn for card numbers, mod-97
for IBANs, the range of each part for IP addresses) confirm them, and words nearby
adjust a score.  Four base kinds (email, ip, card, phone) are always reported when they
pass their validator; further kinds (iban, ssn, local_phone, short_card) are reported if
their score with the context reaches ``MIN_SCORE``.

Spans are code point offsets, end exclusive.  They come from splitting the text at the
pattern: the lengths of the pieces between matches and of the matches add up to the
positions.  The patterns are written with possessive quantifiers and may start only where
a run starts (or right behind the last match), which finds the same matches as the plain
patterns in time linear in the text.

Scale: one projection over the scan, no shuffle and no Python.

Edge cases: a null text counts as empty and has no spans; documents are handled row by
row, so null and repeated ids do no harm.  Empty tables give empty results.  Only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "local_phone", "short_card")
#: Score that spans of the further kinds need.
MIN_SCORE = 0.5
#: Code points on either side of a span that are searched for context words.
CONTEXT = 40

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
#: What a text must contain to be worth splitting; cheap tests that miss nothing.
TRIGGERS = {
    "email": "@",
    "phone": "+",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){12}",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
}
#: Score without context, by kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3, "short_card": 0.3}
#: Words nearby that raise a kind's score by 0.3, as whole words in any case.
FOR = {
    "email": "mail|e-mail|email|contact|write|courriel|correo",
    "ip": "ip|host|server|address|client|adresse",
    "card": "card|visa|mastercard|credit|debit|payment|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|whatsapp|telefon|teléfono|téléphone",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security",
    "local_phone": "phone|tel|call|mobile|fax|telefon|teléfono|téléphone",
    "short_card": "card|visa|amex|credit|debit|payment|carte|karte|tarjeta",
}
#: Words nearby that lower any score by 0.3.
AGAINST = "version|isbn|issn|order|invoice|serial|build|release"


#: Matches whose positions are added up in one go; longer lists are taken in such runs, so
#: that the work stays linear in their number.
_RUN = 256
_SPANS = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, match, before, after>> of a kind's pattern, leftmost
    non-overlapping; before and after are up to ``CONTEXT`` code points between matches."""
    pattern = PATTERNS[kind]
    none = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        before = F.substring(x["gap"], F.greatest(F.length(x["gap"]) - (CONTEXT - 1), F.lit(1)), F.lit(CONTEXT))
        span = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"), before.alias("before"), F.substring(x["next"], 1, CONTEXT).alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    def run(acc: Column, some: Column) -> Column:
        own = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        return _once(own, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["runs"], r["spans"]).alias("runs")))

    def located(both: Column) -> Column:
        pieces, found = both["pieces"], both["found"]
        n = F.size(found)
        rows = F.zip_with(F.zip_with(F.slice(pieces, 1, n), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("match"))), F.slice(pieces, 2, n), lambda x, after: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), after.alias("next")))
        many = lambda r: F.transform(F.sequence(F.lit(1), F.size(r), F.lit(_RUN)), lambda i: F.slice(r, i, F.lit(_RUN)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("runs"))
        return F.when(n > 0, F.flatten(F.aggregate(_once(rows, many), start, run, lambda acc: acc["runs"]))).otherwise(none)

    trigger = TRIGGERS[kind]
    worth = text.contains(trigger) if len(trigger) == 1 else text.rlike(trigger)
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(worth, _once(both, located)).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1: the first four characters go to
    the end, letters count from 10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    no = F.lit(False)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike(r"^0*+(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(no)
    if kind == "short_card":
        return F.when(n.between(13, 15), luhn(digits)).otherwise(no)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        bare = F.regexp_replace(match, " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(no)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-|0000$")
    return F.lit(True)


def _confirmed(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["match"]))


def _scored(kind: str, spans: Column) -> Column:
    """The spans with kind and score, from the words within ``CONTEXT`` code points."""

    def score(x: Column) -> Column:
        near = F.concat_ws(" ", x["before"], x["after"])
        up = F.when(near.rlike(rf"(?iu)\b(?:{FOR[kind]})\b"), 0.3).otherwise(0.0)
        down = F.when(near.rlike(rf"(?iu)\b(?:{AGAINST})\b"), 0.3).otherwise(0.0)
        value = F.least(F.greatest(F.lit(PRIOR[kind]) + up - down, F.lit(0.0)), F.lit(1.0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(value, 2).alias("score"))

    return F.transform(spans, score)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, base and more: arrays of (kind, start, end, score), by kind as listed and
    then by start."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumns({f"m_{k}": _matches(F.col("text"), k) for k in PATTERNS})
    spans = {}
    for kind in (*BASE_KINDS, *MORE_KINDS):
        found = F.col("m_card" if kind == "short_card" else f"m_{kind}")
        spans[kind] = _scored(kind, _confirmed(found, kind))
    out = out.select("doc_id", *[v.alias(k) for k, v in spans.items()])
    more = F.filter(F.concat(*MORE_KINDS), lambda x: x["score"] >= min_score)
    return out.select("doc_id", F.concat(*BASE_KINDS).alias("base"), more.alias("more"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``find_pii``."""
    kinds = F.transform("base", lambda x: x["kind"])
    n = {k: (F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS}
    listed = _listed(F.col("base"))
    every = F.concat_ws(",", F.when(F.size("base") > 0, listed), F.when(F.size("more") > 0, _listed(F.col("more"))))
    return found.select("doc_id", *n.values(), F.sha2(listed.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))
