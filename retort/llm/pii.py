"""Personal data in texts, with DataFrame functions only: patterns propose spans, validators confirm, context decides.

Each kind has a pattern whose leftmost non-overlapping matches are proposed, a validator for what the match must hold
(Luhn for cards, remainder 1 modulo 97 for account numbers, ranges and digit counts elsewhere) and a score. Words near a
span that speak of its kind raise the score, words that speak of something else lower it; a span stays from ``ACCEPT`` on.
The four base kinds score so high that a confirmed match always stays; the added kinds need a checksum or context.

The patterns are possessive and start at the head of a run, so that they find what the plain patterns find in time
linear in the text, without recursion on long runs. Positions, in code points, are running sums over the pieces between
matches, taken block by block; context comes from the neighbouring pieces, and redacted texts are put together from blocks
of the text, so that a text with very many matches takes time about in proportion.

Defined cases: a null text is an empty text, and stays null when redacted; spans of different kinds may overlap and all stay,
and of overlapping spans the first gives the mark in a redacted text; equal rows give equal rows; names of further columns do
not matter, as the given row travels in a column of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans stay from this score on.
ACCEPT = 0.5
#: Characters before and after a span in which context words count, and the matches at either side that they may reach over, each of five characters or more.
CONTEXT, REACHED = 40, 8
#: Values of which running sums are taken at once, and code points of a text that are cut from at once.
BLOCK, PART = 128, 1024


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, a cheap test that a text may hold it, its score and its context words."""

    name: str
    pattern: str
    hint: str
    score: float
    near: str
    against: str = r"(?i)\b(?:version|isbn|order no|invoice|serial|build)\b"


_LOCAL = "A-Za-z0-9._%+-"
#: Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Account numbers of the length of their country; of countries that are not listed, the longest run of at most 34 characters."""
    known = "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
    listed = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    return rf"(?<![A-Za-z0-9])(?:{known}|(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"


BASE_KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.95, r"(?i)\b(?:e-?mail|contact|write)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", 0.8, r"(?i)\b(?:ip|host|server|address)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.9, r"(?i)\b(?:card|visa|credit|debit|payment)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.8, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
)
ADDED_KINDS = (
    Kind("iban", _iban_pattern(), "[A-Z]{2}[0-9]{2}", 0.6, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-", 0.3, r"(?i)\b(?:ssn|social security)\b"),
)
KINDS = BASE_KINDS + ADDED_KINDS


def digit_values(match: Column) -> Column:
    """The digits of a match as numbers, in order."""
    return F.transform(F.split(F.regexp_replace(match, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def luhn(match: Column) -> Column:
    """True where the digits of a match pass the Luhn check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    backwards = F.transform(F.reverse(digit_values(match)), lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d))
    return F.aggregate(backwards, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(match: Column) -> Column:
    """True where an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    left = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return left == 1


def confirmed(kind: str, match: Column) -> Column:
    """What a match must hold besides its pattern."""
    n = F.char_length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(match)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def running(values: Column, first: int, op: Callable[[Column, Column], Column]) -> Column:
    """What ``op`` makes of ``first`` and all values before each: block by block, then within blocks, so that no long array is copied for each value."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def before(array: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, none, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(first), op))
    each = F.flatten(F.zip_with(blocks, before(totals, F.lit(first)), before))
    return F.when(F.size(values) > 0, each).otherwise(F.array().cast("array<int>"))


def with_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """For each row of ``docs``: ``row`` with its columns and ``spans``, an array of ``start, no, kind, end, score`` (code points, end exclusive) by start, then kind as listed."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    none = F.array().cast("array<string>")
    given = docs.select(F.struct(*docs.columns).alias("row"))
    found = given.withColumns({f"found_{k.name}": F.coalesce(F.when(text.rlike(k.hint), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))), none) for k in kinds})
    gaps = found.withColumns({f"gaps_{k.name}": F.when(F.size(f"found_{k.name}") > 0, F.split(text, k.pattern)).otherwise(none) for k in kinds})
    lengths = {}
    for k in kinds:  # of a gap and the match after it
        lengths[f"lengths_{k.name}"] = F.zip_with(F.slice(f"gaps_{k.name}", 1, F.size(f"found_{k.name}")), f"found_{k.name}", lambda g, m: F.char_length(g) + F.char_length(m))
    ended = gaps.withColumns(lengths)
    placed = ended.withColumns({f"from_{k.name}": running(F.col(f"lengths_{k.name}"), 0, lambda a, x: a + x) for k in kinds})
    each = [_placed_spans(no, k) for no, k in enumerate(kinds)]
    return placed.select("row", F.sort_array(F.filter(F.concat(*each), lambda x: x["score"] >= ACCEPT)).alias("spans"))


def _placed_spans(no: int, kind: Kind) -> Column:
    """The confirmed matches of one kind as spans."""
    found, gaps = F.col(f"found_{kind.name}"), F.col(f"gaps_{kind.name}")
    matches = F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i")))

    def around(i: Column) -> Column:
        """The characters before and after a match, a space between."""
        first = F.greatest(i - REACHED, F.lit(0))
        before = F.zip_with(F.slice(gaps, first + 1, i - first + 1), F.slice(found, first + 1, i - first), lambda g, m: F.concat(F.right(g, F.lit(CONTEXT)), F.coalesce(m, F.lit(""))))
        after = F.zip_with(F.slice(gaps, i + 2, F.lit(REACHED + 1)), F.slice(found, i + 2, F.lit(REACHED)), lambda g, m: F.concat(F.left(g, F.lit(CONTEXT)), F.coalesce(m, F.lit(""))))
        # a piece that is cut stands at the far end or fills the context alone
        return F.concat(F.right(F.array_join(before, ""), F.lit(CONTEXT)), F.lit(" "), F.left(F.array_join(after, ""), F.lit(CONTEXT)))

    def span(x: Column) -> Column:
        start = F.get(F.col(f"from_{kind.name}"), x["i"]) + F.char_length(F.get(gaps, x["i"]))
        return F.struct(start.alias("start"), F.lit(no).alias("no"), F.lit(kind.name).alias("kind"), (start + F.char_length(x["m"])).alias("end"), _score(kind, around(x["i"])).alias("score"))

    return F.transform(F.filter(matches, lambda x: confirmed(kind.name, x["m"])), span)


def _score(kind: Kind, around: Column) -> Column:
    score = F.lit(kind.score) + F.when(around.rlike(kind.near), 0.3).otherwise(0.0) - F.when(around.rlike(kind.against), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets, overlapping spans by the first; same columns."""
    text = F.col("row.text")
    found = with_spans(docs).withColumn("ends", running(F.transform("spans", lambda x: x["end"]), 0, lambda a, x: F.greatest(a, x)))
    found = found.withColumn("parts", F.when(F.size("spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))

    def cut(start: Column, end: Column) -> Column:
        """The text from ``start`` to ``end``, from the parts that hold it."""
        first = F.floor(start / PART).cast("int")
        whole = F.array_join(F.slice("parts", first + 1, F.floor(end / PART).cast("int") - first + 1), "")
        return F.substr(whole, start - first * PART + 1, end - start)

    pieces = F.zip_with("spans", "ends", lambda x, e: F.when(x["start"] >= e, F.concat(cut(e, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(""))
    last = F.greatest(F.element_at("ends", -1), F.element_at("spans", -1)["end"])
    clean = F.concat(F.array_join(pieces, ""), cut(last, F.char_length(text)))
    new = F.when(F.size("spans") > 0, clean).otherwise(text)
    out = found.select(F.col("row").withField("text", new).alias("row"), (F.size("spans") > 0).alias("changed"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("changed"), F.char_length("row.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
        out = out.select(F.col("row").withField("n_chars", length).alias("row"))
    return out.select("row.*")
