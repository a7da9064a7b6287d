"""Text functions as columns, without Python on the executors.

Regular expressions follow the semantics of a host language whose word characters are
Unicode letters, digits and the underscore, and whose line ends are ``\\n`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
SPACE = r"(?U)[\s\x1c-\x1f]+"

#: What is neutralized, in this order.
UNSAFE = (
    r"(?diu)\b(ignore|disregard|forget|override)\s+(all\s+|any\s+)?(previous|prior|above|earlier|preceding|system)\s+(instructions?|prompts?|context|rules?)",
    r"(?diu)\bnew\s+(system\s+)?instructions?\s*:",
    r"(?diu)\byou\s+(are|must)\s+now\b.{0,40}?(act|behave|respond)\s+as\b",
    r"(?diu)<\|[a-z_]+\|>",
    r"(?d)\[/?INST\]|<<\/?SYS>>",
    r"(?dimu)^\s*#{0,4}\s*(system|assistant|developer|tool)\s*:",
    r"(?diu)</?\s*(tool_call|tool_use|function_call|antml:invoke|invoke|tool)\b[^>]*>",
    r'(?diu)"(tool_calls|function_call)"\s*:',
)
NEUTRALIZED = "[neutralized]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends (all of Unicode's, not U+0020 alone)."""
    return F.regexp_replace(_col(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def normalized_key(x: Column | str) -> Column:
    """What exact repeats share: lower case, with every run of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(_col(x)), NOT_WORD, " "))


def flat(x: Column | str) -> Column:
    """Lower case, with white space made single spaces."""
    return F.lower(F.trim(F.regexp_replace(_col(x), SPACE, " ")))


def verbatim(quote: Column | str, transcript: Column | str) -> Column:
    """The stripped quote if the transcript has it, apart from case and white space; else null."""
    q = _col(quote)
    return F.when((strip(q) != "") & F.contains(flat(transcript), flat(q)), strip(q))


def sanitize(x: Column | str) -> Column:
    """Text in which override phrases, role marks and tool calls are neutralized."""
    out = _col(x)
    for pattern in UNSAFE:
        out = F.regexp_replace(out, pattern, NEUTRALIZED)
    return out


def telegraph(x: Column | str) -> Column:
    """Without the leading English article and lower-case ones within."""
    return F.regexp_replace(F.regexp_replace(_col(x), r"(?iu)^(?:the|a|an)\s+", ""), r"(?<=[\s(])(?:the|a|an)\s+", "")


def tokens(x: Column | str) -> Column:
    """Estimated number of tokens: a quarter of the characters, and one."""
    return (F.floor(F.length(_col(x)) / 4) + 1).cast("int")


def words(x: Column | str) -> Column:
    """The words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(_col(x)), F.lit(WORD), F.lit(0))


def overlap(text: Column | str, tags: Column | str, query: list[str] | Column) -> Column:
    """How many distinct query words are in the text or are tags."""
    q = F.array(*[F.lit(w) for w in sorted(set(query))]).cast("array<string>") if isinstance(query, list) else query
    held = F.concat(words(text), F.transform(F.coalesce(_col(tags), F.array().cast("array<string>")), F.lower))
    return F.size(F.array_intersect(q, held))


def quote_shown(text: Column | str, quote: Column | str) -> Column:
    return (F.coalesce(_col(quote), F.lit("")) != "") & ~F.contains(F.lower(_col(text)), F.lower(_col(quote)))


def render(text="text", quote="quote", valid_from="valid_from", valid_until="valid_until") -> Column:
    """A fact as a line: telegraphed text, its quote if that adds something, and its validity."""
    start, end = F.nullif(_col(valid_from), F.lit("")), F.nullif(_col(valid_until), F.lit(""))
    body = F.concat(telegraph(text), F.when(quote_shown(text, quote), F.concat(F.lit(' — "'), _col(quote), F.lit('"'))).otherwise(""))
    validity = F.concat(F.lit(" (valid "), F.coalesce(start, F.lit("?")), F.lit(" -> "), F.coalesce(end, F.lit("now")), F.lit(")"))
    return F.concat(body, F.when(start.isNotNull() | end.isNotNull(), validity).otherwise(""))


def judged(answer: Column | str, expected: Column | str) -> Column:
    """Whether any expected string is in the answer, reasoning traces aside."""
    spoken = F.lower(F.regexp_replace(_col(answer), r"(?s)<think>.*?</think>", ""))
    return F.coalesce(F.exists(_col(expected), lambda e: F.contains(spoken, F.lower(e))), F.lit(False))


def first_json(x: Column | str) -> Column:
    """The text from its first brace or bracket on, without code fences."""
    bare = strip(F.regexp_replace(strip(x), r"(?dm)^```(?:json)?|```$", ""))
    brace, bracket = F.nullif(F.instr(bare, "{"), F.lit(0)), F.nullif(F.instr(bare, "["), F.lit(0))
    return F.substring(bare, F.coalesce(F.least(brace, bracket), F.lit(1)), F.length(bare))


def parse_json(x: Column | str) -> Column:
    """The JSON value that a reply ends with, as a variant; null if it can't be parsed or more follows."""
    # the parser stops behind a value; within brackets it must go on to the end
    held = F.try_parse_json(F.concat(F.lit("["), first_json(x), F.lit("]")))
    one = F.try_variant_get(held, "$[1]", "variant").isNull()
    return F.when(one, F.try_variant_get(held, "$[0]", "variant"))


def clamp(x: Column | str) -> Column:
    """Limited to 0 and 1; what is no number becomes 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(x)))


#: Fixed value: the digits of ids, in order.
ID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def sortable_id(at_ms: Column, place: Column, *parts: Column | str) -> Column:
    """A 26-character id that sorts by time and place: ten characters of a time in milliseconds, nine of a place (below 2**45), seven of a hash of the parts."""

    def letters(x: Column, n: int) -> list[Column]:
        return [F.substring(F.lit(ID_DIGITS), (F.shiftrightunsigned(x, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in reversed(range(n))]

    seed = F.xxhash64(*[_col(p).cast("string") for p in parts])
    return F.concat(*letters(at_ms, 10), *letters(place, 9), *letters(seed, 7))


def ulid(*parts: Column | str) -> Column:
    """A 26-character id from a hash of the parts: the same input gives the same id on every run.

    Ten characters as of a time, of which the first is 0 to 7, and sixteen more.
    """
    seed = F.concat_ws("\x1f", *[_col(p).cast("string") for p in parts])
    # five bits from each of two hex digits of the hash
    hexed = F.sha2(seed, 256)
    place = lambda i: F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).cast("int")
    letters = [F.substring(F.lit(ID_DIGITS), F.pmod(place(i), F.lit(8 if i == 0 else 32)) + 1, F.lit(1)) for i in range(26)]
    return F.concat(*letters)
