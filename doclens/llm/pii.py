"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksum validators (Luhn, mod 97) confirm
them, and context words nearby adjust a score.  Positions come from cutting the
text at the matches: a match starts after the pieces and matches before it.

Time grows with the text and its matches, not with their product.  Runs in
patterns are possessive, and a pattern that opens with a long run may start only where
the run does, or where the match before it ended.  The text is cut once for a kind;
sums over what stands before a match are taken in blocks, as a running array
would be copied for each match; context is read from the pieces beside a span, and
masks from a text cut into short chunks, never from the text's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and their patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# in one piece, or in groups of four and a rest; words behind it are taken off again by the checksum
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+(?![A-Za-z0-9])|(?:\x20[A-Z0-9]{4}(?![A-Za-z0-9])){2,7}+(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+)"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE_KINDS = KINDS[:4]
# Words that make a kind likelier when they stand near a span.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer|konto)\b",
    "national_id": r"(?i)\b(?:ssn|social|security|id)\b",
}
#: Score without context, what a context word adds, and the score from which an added kind is kept.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "national_id": 0.4}
CONTEXT_GAIN, KEEP, NEAR = 0.1, 0.5, 60
#: Matches on either side of a span that may stand within NEAR characters of it: the shortest has five, and a piece between them.
NEIGHBOURS = 12
#: Items of a block whose running sums are taken together, code points of a chunk of text.
BLOCK, CHUNK = 64, 500

_SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check; the empty string doesn't."""
    turned = _characters(F.reverse(digits))
    parts = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return (F.length(digits) > 0) & (F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether the letters and digits of an account number leave 1 modulo 97 once its first four are put last."""
    bare = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_characters(moved), F.lit(0), step) == 1


def _octets(ip: Column) -> Column:
    return F.forall(F.split(ip, r"\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).cast("int") <= 255), F.lit(False)))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return _octets(match)
    if kind == "card":
        n = F.length(_digits(match))
        return n.between(12, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    if kind == "national_id":
        return ~F.substring(match, 1, 3).isin("000", "666") & (F.substring(match, 1, 1) != "9") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, value, fold, body) -> Column:
    """body(item, index from 1, before) of each item; before folds the values (ints from 0) of all earlier items.

    Blocks first, then inside each block: n * BLOCK / 2 + (n / BLOCK)^2 / 2 steps for n items.
    """
    zero = F.lit(0)
    over = lambda part: F.aggregate(part, zero, lambda a, x: fold(a, value(x)))

    def parts(items):
        cut = F.transform(F.sequence(zero, F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(items) > 0, _let(cut, totals))

    def totals(cut):
        return _let(F.transform(cut, over), lambda sums: F.flatten(F.transform(cut, lambda part, b: _let(F.aggregate(F.slice(sums, F.lit(1), b), zero, fold), lambda base: inside(part, b, base)))))

    def inside(part, b, base):
        return F.transform(part, lambda x, i: body(x, b * BLOCK + i + 1, fold(base, over(F.slice(part, F.lit(1), i)))))

    return _let(items, parts)


def _trimmed(kind: str, match: Column) -> Column:
    """The match; of an account number in groups the longest run of groups from its start that the checksum confirms."""
    if kind != "iban":
        return match
    prefix = lambda n: F.concat_ws(" ", F.slice(F.split(match, " "), 1, n))
    tried = F.transform(F.sequence(F.size(F.split(match, " ")), F.lit(1), F.lit(-1)), prefix)
    return F.coalesce(F.get(F.filter(tried, lambda m: _valid(kind, m)), 0), match)


def _matches(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """Spans of the valid matches of one kind.  hint: a plain string without which there is no match."""
    # one more piece than matches: the last one comes with no match
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.coalesce(p, F.lit("")).alias("before"), F.coalesce(m, F.lit("")).alias("match")))

    def span(pair, i, before):
        kept, start = _trimmed(kind, pair["match"]), before + F.length(pair["before"])
        made = F.struct(start.alias("start"), (start + F.length(kept)).alias("end"), i.cast("int").alias("i"), F.substr(pair["match"], F.length(kept) + 1).alias("rest"))
        return F.when((pair["match"] != "") & _valid(kind, kept), made)

    def near(pairs, s):
        """NEAR characters before and behind a span, of the pieces and matches beside it."""
        first = F.greatest(s["i"] - NEIGHBOURS, F.lit(1))
        before = F.transform(F.slice(pairs, first, s["i"] - first), lambda p: F.concat(F.right(p["before"], F.lit(NEAR)), p["match"]))
        before = F.concat(F.array_join(before, ""), F.right(F.element_at(pairs, s["i"])["before"], F.lit(NEAR)))
        behind = F.transform(F.slice(pairs, s["i"] + 1, F.lit(NEIGHBOURS + 1)), lambda p: F.concat(F.left(p["before"], F.lit(NEAR)), p["match"]))
        behind = F.concat(s["rest"], F.array_join(behind, ""))
        return F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(behind, F.lit(NEAR)))

    def scored(pairs):
        def one(s):
            score = F.lit(SCORE[kind]) + F.when(near(pairs, s).rlike(CONTEXT[kind]), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

        spans = _running(pairs, lambda p: F.length(p["before"]) + F.length(p["match"]), lambda a, x: a + x, span)
        return F.transform(F.filter(spans, lambda s: s.isNotNull()), one)

    out = _let(pairs, scored)
    if kind not in BASE_KINDS:
        out = F.filter(out, lambda s: s["score"] >= KEEP)
    return F.when(text.rlike(hint), out).otherwise(F.array().cast(_SPANS))


def _ordered(spans: Column) -> Column:
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))


#: Cheap tests that let most texts skip a kind.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "national_id": r"[0-9]{3}-[0-9]{2}-"}
_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "national_id": NATIONAL}


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """Adds the column out: all spans of a text as (start, end, kind, score), by start, then kind as in KINDS.

    Offsets count code points, the end is exclusive.  Spans of one kind don't
    overlap, spans of several kinds may.  Null and empty texts have no
    span; every row is kept, repeated ones too; a column of the name given is
    replaced.  Base kinds are kept whatever their score; the others need a score of KEEP.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [_matches(text, k, _PATTERNS[k], _HINTS[k]) for k in KINDS]
    return docs.withColumn(out, _ordered(F.concat(*kinds)))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def joined_scores(spans: Column) -> Column:
    """The scores of spans in their order, two digits each."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first. Null text stays null."""
    found = find_pii(docs, text_col, "__pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    def part(chunks, begin, stop):
        """Code points from begin to stop, of the chunks they lie in."""
        first = F.floor(begin / CHUNK).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.floor(stop / CHUNK).cast("int") - first + 1), "")
        return F.substr(held, begin - first * CHUNK + 1, stop - begin)

    def replaced(chunks):
        # what stands between the end of all spans before and a span that begins behind it
        gap = lambda s, _, at: F.when(s["start"] >= at, F.concat(part(chunks, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        parts = _running(F.col("__pii"), lambda s: s["end"], lambda a, x: F.greatest(a, x), gap)
        end = F.array_max(F.transform("__pii", lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), part(chunks, end, F.length(text)))

    done = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), replaced)
    return found.withColumn(text_col, F.when(F.size("__pii") > 0, done).otherwise(F.col(text_col))).drop("__pii")
