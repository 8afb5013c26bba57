"""Personal data in texts, by DataFrame expressions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for IBANs, value ranges for addresses),
and words near a span, before or after it, raise the score of the weaker kinds. Positions come from the gaps between
matches: the text split at a pattern gives the gaps, whose lengths and those of the matches sum up to each match's start.
All patterns are possessive and start only at the head of a run or where the last match ended. An IBAN is matched by its
head alone; from there every end of a word up to 34 characters is tried.

The cost grows with the length of a text, however many spans it has: sums run over blocks of FOLD matches, so that no long
array is copied for each match; checks come before spans are built; and parts of a text are taken from its pieces of PIECE
characters, as a substring is searched from the beginning of its string.

Starts count code points from 0; ends are exclusive. A null text counts as an empty one and has no spans. Repeated rows get
equal spans; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ONE = "struct<start:int,stop:int,found:string>"
SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,score:double,base:boolean>>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    worth = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    plain = F.upper(F.regexp_replace(code, " ", ""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    number = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(number, F.lit(0), lambda a, x: (a * F.when(x >= 10, 100).otherwise(10) + x) % 97) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, what a text must have for it, its check, its score and what context adds."""

    name: str
    pattern: str
    needs: str
    check: Callable[[Column], Column] | None = None
    score: float = 1.0
    context: str = ""
    base: bool = False
    longer: Callable[[Column, Column], Column] | None = None  # makes the found text of a match that is only a head


def _parts_at_most_255(found: Column) -> Column:
    return F.forall(F.split(found, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))


#: Characters of an IBAN by country, from the ISO 13616 registry.
IBAN_LENGTHS = {
    n: codes.split()
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"


def _iban(ahead: Column, head: Column) -> Column:
    """The IBAN at the start of a text, or null: mod-97 is tried at every end of a word from 15 to 34 characters. The
    country's length comes first, then the longest, as words after an IBAN may be capitals or digits too."""
    ends = F.array(*(F.regexp_extract(ahead, rf"^(?:\x20?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])", 0) for n in range(34, 14, -1)))
    valid = F.filter(ends, lambda c: (c != "") & mod97(c))
    usual = F.create_map(*(F.lit(x) for n, codes in IBAN_LENGTHS.items() for code in codes for x in (code, n)))
    fits = F.filter(valid, lambda c: F.length(F.regexp_replace(c, " ", "")) == F.try_element_at(usual, F.substring(head, 1, 2)))
    return F.coalesce(F.get(fits, F.lit(0)), F.get(valid, F.lit(0)))


#: The four base kinds, in their listed order.
BASE_KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", base=True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digit", _parts_at_most_255, base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "digit", lambda m: F.length(_digits(m)).between(12, 19) & luhn(_digits(m)), base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(9, 15), base=True),
)
#: Kinds that the method adds; those whose score stays under the threshold need a context word within CONTEXT characters.
MORE_KINDS = (
    Kind("iban", IBAN_HEAD + r"(?=(?:\x20?[A-Z0-9]){11})", "digit", None, 0.9, longer=_iban),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digit", None, 0.3, r"(?i)ssn|social security|tax id|steuer"),
    Kind("local_phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "digit", None, 0.3, r"(?i)phone|call|tel\b|tel\.|mobile|fax"),
)
CONTEXT, CONTEXT_WORTH, THRESHOLD = 40, 0.4, 0.5
#: Characters that a match may be made longer by: 34, a space before each but the first, and the one after.
AHEAD = 68


#: Elements that are folded into one array before it is added to the blocks before it; characters of a text's pieces.
FOLD, PIECE = 64, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _folded(items: Column, start: Column, advance: Callable, emit: Callable, kind: str, finish: Callable) -> Column:
    """A running number over an array: emit(state, x) gives what x adds to the result, an array<kind>, and advance(state, x)
    the state after x. The value is finish(last state, result); null for an empty array. Spark copies an aggregate's state
    at each step, so the states at the blocks' starts come first, by themselves, and then each block's own result."""
    first = F.struct(start.alias("s"), _none("int").alias("at"))
    one = lambda a, x: F.struct(advance(a["s"], x).alias("s"), F.concat(a["now"], emit(a["s"], x)).alias("now"))

    def run(blocks: Column) -> Column:
        def out(states: Column) -> Column:
            own = lambda part, i: F.aggregate(part, F.struct(F.get(states["at"], i).alias("s"), _none(kind).alias("now")), one, lambda a: a["now"])
            return finish(states["s"], F.flatten(F.transform(blocks, own)))

        step = lambda a, part: F.struct(F.aggregate(part, a["s"], advance).alias("s"), F.concat(a["at"], F.array(a["s"])).alias("at"))
        return _let(F.aggregate(blocks, first, step), out)

    def cut(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / FOLD).cast("int")), lambda b: F.slice(x, b * FOLD + 1, F.lit(FOLD)))

    return _let(_let(items, lambda x: F.when(F.size(x) > 0, cut(x))), run)


def _pieces(text: Column) -> Column:
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def _between(pieces: Column, start: Column, stop: Column) -> Column:
    """The characters from start to stop of a text in pieces."""
    start, stop = F.greatest(start, F.lit(0)), F.greatest(start, stop, F.lit(0))
    i, j = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
    first, last = F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, j), F.lit(""))
    whole = F.when(j - i > 1, F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")).otherwise(F.lit(""))
    apart = F.concat(F.substr(first, start - i * PIECE + 1, F.lit(PIECE)), whole, F.substr(last, F.lit(1), stop - j * PIECE))
    return F.when(i == j, F.substr(first, start - i * PIECE + 1, stop - start)).otherwise(apart)


_STEP = "struct<gap:int,found:string,right:boolean>"


def _steps(text: Column, pattern: str, check: Callable[[Column], Column] | None = None) -> Column:
    """The gaps before each match and at the end, with the match and whether it passes the check."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    right = lambda f: f.isNotNull() if check is None else f.isNotNull() & F.coalesce(check(f), F.lit(False))
    return F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("found")), lambda x: F.struct(x["gap"].alias("gap"), x["found"].alias("found"), right(x["found"]).alias("right"))).cast(f"array<{_STEP}>")


def _placed(steps: Column) -> Column:
    """The right matches of _steps, as array<struct<start, stop, found>>."""
    after = lambda at, x: at + x["gap"] + F.coalesce(F.length(x["found"]), F.lit(0))

    def span(at: Column, x: Column) -> Column:
        made = F.struct((at + x["gap"]).alias("start"), after(at, x).alias("stop"), x["found"].alias("found"))
        return F.when(x["right"], F.array(made)).otherwise(_none(_ONE))

    return F.coalesce(_folded(steps, F.lit(0), after, span, _ONE, lambda _, out: out), _none(_ONE))


def matches(text: Column, pattern: str, check: Callable[[Column], Column] | None = None) -> Column:
    """All leftmost non-overlapping matches that pass the check, as array<struct<start, stop, found>>."""
    return _placed(_steps(text, pattern, check))


def _lengthened(pieces: Column, heads: Column, kind: Kind) -> Column:
    """Matches made longer from their heads on; those that come to nothing or start within the one before are left out."""
    whole = F.transform(heads, lambda s: F.struct(s["start"].alias("start"), kind.longer(_between(pieces, s["start"], s["start"] + AHEAD), s["found"]).alias("found")))
    spans = F.transform(F.filter(whole, lambda s: s["found"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["found"])).alias("stop"), s["found"].alias("found")))
    apart = _folded(spans, F.lit(0), lambda at, s: F.when(s["start"] >= at, s["stop"]).otherwise(at), lambda at, s: F.when(s["start"] >= at, F.array(s)).otherwise(_none(_ONE)), _ONE, lambda _, out: out)
    return F.coalesce(apart, _none(_ONE))


def _spans(text: Column, found: Column, kind: Kind, rank: int) -> Column:
    def made(found: Column, pieces: Column | None) -> Column:
        def scored(s: Column) -> Column:
            score = F.lit(kind.score)
            if kind.context:
                near = F.concat_ws("\n", _between(pieces, s["start"] - CONTEXT, s["start"]), _between(pieces, s["stop"], s["stop"] + CONTEXT))
                score = score + F.when(near.rlike(kind.context), F.lit(CONTEXT_WORTH)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind.name).alias("kind"), score.cast("double").alias("score"), F.lit(kind.base).alias("base"))

        spans = F.transform(found if kind.longer is None else _lengthened(pieces, found, kind), scored)
        return F.filter(spans, lambda s: s["score"] >= THRESHOLD) if kind.context else spans

    if kind.longer is None and not kind.context:
        out = made(found, None)
    else:
        out = F.when(F.size(found) > 0, _let(_pieces(text), lambda p: made(found, p)))
    return F.coalesce(out, F.array().cast(SPANS))


@cache
def _every_span(application: str, text_col: str) -> Column:
    """The spans of all kinds. Making the expression takes as long as running it on small data, so it is kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [*BASE_KINDS, *MORE_KINDS]
    needs = {"digit": text.rlike("[0-9]"), **{k.needs: F.contains(text, F.lit(k.needs)) for k in kinds if k.needs != "digit"}}
    steps = F.array(*(F.coalesce(F.when(needs[k.needs], _steps(text, k.pattern, k.check)), _none(_STEP)) for k in kinds))
    # one expression places the matches of all kinds
    placed = lambda every: F.array_sort(F.concat(*(_spans(text, F.get(every, F.lit(r)), k, r) for r, k in enumerate(kinds))))
    return _let(F.transform(steps, _placed), placed)


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` and a column of its spans, ordered by start, then kind: struct<start, rank, stop, kind, score, base>.
    An existing column of that name is replaced; other columns and repeated rows stay as they are."""
    return docs.withColumn(out_col, _every_span(docs.sparkSession.sparkContext.applicationId, text_col))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; where spans overlap, the first one's name stands."""

    def run(pieces: Column) -> Column:
        def piece(at: Column, s: Column) -> Column:
            made = F.concat(_between(pieces, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.when(s["start"] >= at, F.array(made)).otherwise(_none("string"))

        rest = lambda at, out: F.concat(F.array_join(out, ""), _between(pieces, at, F.length(text)))
        return _folded(spans, F.lit(0), lambda at, s: F.greatest(at, s["stop"]), piece, "string", rest)

    return F.when(F.size(spans) > 0, _let(_pieces(text), run)).otherwise(text)


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
