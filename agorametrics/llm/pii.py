"""Personal data: patterns propose spans, checks confirm them, context words adjust the score.

The patterns find the same leftmost matches as the plain forms in the comments; possessive
repeats and look-behinds only keep them linear on long runs. A span's place is the length of
what ``split`` leaves before it.

Kinds: email, ip, card, phone; iban, of its country's length and with a mod-97 check; secret, a
run of 20 to 512 letters, digits, ``_``, ``+``, ``/`` or ``-`` with at least three letters and three
digits. The first four are always reported if their check holds; the others need a score of at
least 0.5. A score starts at the kind's own value, rises by 0.2 if a context word stands within
40 characters of the span, and falls by 0.4 if a word against it does. So an iban stays unless
it is called a serial number, and a secret goes unless it is called a token, a password or the like.

Defined cases: null text counts as empty; kinds are searched one by one, so spans of different
kinds may overlap; matches that fail their check are dropped and not tried again; a text of any
length is searched whole; repeated rows, also of one doc_id, are each searched; no rows give no
rows; only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")
# Characters of an iban by country, as in the public registry. Fixed values.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK",
    21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_IBANS = "|".join(
    rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{size - 4}}}"
    for size, codes in IBAN_LENGTHS.items()
)
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBANS})(?![A-Za-z0-9])",
    # The longest runs of these characters, if of 20 or more.
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
}
# What a text must hold for the pattern to be tried at all.
HINTS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20}",
}
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "secret": 0.4}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|adresse|direcci",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|appel|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "secret": r"token|secret|passw|\bpwd\b|(?:api|access|private)[ _-]?key|\bauth(?!or)|bearer|credential|contrase|mot de passe",
}
CONTEXT_BONUS = 0.2
AGAINST = {
    "iban": r"serial|tracking|\bsku\b|licen[cs]e",
    "secret": r"\bsha-?[0-9]+\b|\bmd5\b|checksum|\bcommit\b|\bdigest\b",
}
AGAINST_MALUS = 0.4
NEAR = 40
LEAST_SCORE = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits is a multiple of ten."""
    each = F.split(F.reverse(digits), "")
    each = F.filter(each, lambda c: c != "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
    )
    total = F.aggregate(F.transform(each, value), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """The first four characters moved to the end and letters as 10 to 35 leave 1."""
    packed = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substr(packed, F.lit(5)), F.substring(packed, 1, 4))
    each = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97
    ).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(each, F.lit(0), step) == 1


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        small = lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(parts, small)
    if kind == "card":
        size = F.length(_digits(match))
        return F.when((size >= 13) & (size <= 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        letters = F.length(match) - F.length(F.regexp_replace(match, "[A-Za-z]", ""))
        return F.length(match).between(20, 512) & (letters >= 3) & (F.length(_digits(match)) >= 3)
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    """Confirmed matches as structs (start, end, score), in code points."""
    pattern = PATTERNS[kind]
    pieces = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.split(text, pattern).alias("before"),
    )
    pieces = F.filter(pieces, lambda p: p["match"].isNotNull())
    placed = F.aggregate(
        pieces,
        F.struct(
            F.lit(0).alias("end"),
            F.lit(None).cast("array<struct<match:string,start:int,end:int>>").alias("found"),
        ),
        lambda acc, p: F.struct(
            (acc["end"] + F.length(p["before"]) + F.length(p["match"])).alias("end"),
            # Only what holds is kept, so the list stays short.
            F.when(
                _holds(kind, p["match"]),
                F.concat(
                    F.coalesce(acc["found"], F.array().cast("array<struct<match:string,start:int,end:int>>")),
                    F.array(
                        F.struct(
                            p["match"].alias("match"),
                            (acc["end"] + F.length(p["before"])).alias("start"),
                            (acc["end"] + F.length(p["before"]) + F.length(p["match"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    around = lambda s: F.lower(
        F.substr(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, s["end"] - s["start"] + 2 * NEAR)
    )

    def score(s: Column) -> Column:
        value = F.lit(SCORES[kind]) + F.when(around(s).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        if kind in AGAINST:
            value = value - F.when(around(s).rlike(AGAINST[kind]), AGAINST_MALUS).otherwise(0.0)
        return value

    scored = F.transform(
        placed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score"))
    )
    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(text.rlike(HINTS[kind]), F.coalesce(scored, none)).otherwise(none)


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, iban, secret): an array of (start, end, score) for each kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", *(_matches(k, F.col("text")).alias(k) for k in KINDS))


def span_text(kinds: tuple[str, ...], scores: bool = False) -> Column:
    """All spans as kind:start:end, joined by commas, by kind and start."""

    def one(kind: str) -> Column:
        parts = lambda s: [F.lit(kind), s["start"], s["end"]] + (
            [F.format_number(s["score"], 2)] if scores else []
        )
        return F.transform(kind, lambda s: F.concat_ws(":", *parts(s)))

    return F.array_join(reduce(F.concat, (one(k) for k in kinds)), ",")


def redacted(docs: DataFrame, name: str = "text") -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in angle brackets.

    Of spans that overlap, the one that begins first goes first; what it covers is done with.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def tagged(kind: str) -> Column:
        parts = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
        return F.transform(_matches(kind, F.col("text")), parts)

    spans = F.array_sort(reduce(F.concat, map(tagged, KINDS)))
    rows = rows.select("doc_id", "text", spans.alias("spans"))
    out = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["end"], acc).otherwise(
            F.struct(
                s["end"].alias("end"),
                F.concat(
                    acc["out"],
                    F.substr(F.col("text"), acc["end"] + 1, s["start"] - acc["end"]),
                    F.lit("<"),
                    s["kind"],
                    F.lit(">"),
                ).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["end"] + 1)),
    )
    return rows.select("doc_id", out.alias(name))
