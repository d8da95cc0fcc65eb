"""Rule detectors: patterns with a cheap necessary condition each, and what can be done with their matches.

Patterns use neither lookaround nor backreferences and never match the empty string, so that they mean the
same to java.util.regex and to RE2.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT = "[REDACTED]"
SPANS = "array<struct<entity_type:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """An entity type, its pattern, and a gate (a contains string, or a pattern) that every match implies."""

    entity: str
    pattern: str
    contains: str | None = None
    gate: str | None = None

    def may_match(self, text: Column) -> Column:
        return text.contains(self.contains) if self.contains else text.rlike(self.gate or self.pattern)


#: Both sides of the @ are bounded (64 and 255 characters are the most an address may have), so that a long run of
#: letters costs time in proportion to its length.
EMAIL = Rule("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,}", contains="@")
IP = Rule("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", gate=r"[0-9]\.[0-9]")
PHONE = Rule("PHONE_NUMBER", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", contains="+1 (")
CARD = Rule("CREDIT_CARD_NUMBER", r"[0-9]{16}", gate=r"[0-9]{16}")
TOKEN = Rule("AUTH_TOKEN", r'token = "[0-9a-f]{40}"', contains='token = "')
IBAN = Rule("IBAN_CODE", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", gate=r"[A-Z]{2}[0-9]{2}")
PASSWORD = Rule("PASSWORD", r"[Pp]assword: ?[^ \n]+", contains="assword:")
AWS_KEY = Rule("AWS_CREDENTIALS", r"AKIA[0-9A-Z]{16}", contains="AKIA")
LICENSE = Rule("US_DRIVER_LICENSE", r"DL-[0-9]{8}", contains="DL-")

#: The five types planted in the sample tables; also the default order of a chain.
DEFAULT_RULES: tuple[Rule, ...] = (EMAIL, IP, PHONE, CARD, TOKEN)
ALL_RULES: tuple[Rule, ...] = (*DEFAULT_RULES, IBAN, PASSWORD, AWS_KEY, LICENSE)
#: Entity types whose matches are left alone unless asked for.
DENIED = ("US_DRIVER_LICENSE",)

#: What a detection service is asked for by default, and how user types are added to it.
BUILT_IN_INFO_TYPES = (
    "PHONE_NUMBER", "EMAIL_ADDRESS", "CREDIT_CARD_NUMBER", "LOCATION", "PERSON_NAME", "AGE", "DATE_OF_BIRTH",
    "CREDIT_CARD_TRACK_NUMBER", "CREDIT_CARD_EXPIRATION_DATE", "ETHNIC_GROUP", "GENDER", "IBAN_CODE", "IP_ADDRESS", "PASSPORT",
    "AUTH_TOKEN", "AWS_CREDENTIALS", "BASIC_AUTH_HEADER", "PASSWORD", "GCP_CREDENTIALS", "MEDICAL_RECORD_NUMBER",
)


def any_of(rules: Sequence[Rule]) -> str:
    return "|".join(f"(?:{r.pattern})" for r in rules)


def info_types(user: Column) -> Column:
    """The built-in set with an array of user types added, without repeats, sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(x) for x in BUILT_IN_INFO_TYPES]), user)))


def stored_info_type(project: str, name: str) -> str:
    return f"projects/{project}/storedInfoTypes/{name}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def replace(text: Column, rules: Sequence[Rule] = DEFAULT_RULES, token: str = REPLACEMENT) -> Column:
    """Every match of every rule becomes token; rule after rule, each behind its gate."""
    quoted = token.replace("\\", "\\\\").replace("$", "\\$")

    def by(rule: Rule) -> Callable[[Column], Column]:
        return lambda t: F.when(rule.may_match(t), F.regexp_replace(t, rule.pattern, quoted)).otherwise(t)

    for rule in rules:
        text = let(text, by(rule))
    return text


def replace_once(text: Column, rules: Sequence[Rule] = DEFAULT_RULES, token: str = REPLACEMENT) -> Column:
    """All rules in one pass over the text: matches never overlap, the leftmost rule in the list wins."""
    gate = rules[0].may_match(text)
    for rule in rules[1:]:
        gate = gate | rule.may_match(text)
    return F.when(gate, F.regexp_replace(text, any_of(rules), token)).otherwise(text)


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """The gaps between matches (one more than there are) and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def mask(text: Column, rules: Sequence[Rule] = DEFAULT_RULES, char: str = "X") -> Column:
    """Every match becomes as many characters char as it has; the length of the text stays."""
    gaps, matches = _cut(text, any_of(rules))
    masked = F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit(char), F.length(m)), F.lit("")))), "")
    gate = rules[0].may_match(text)
    for rule in rules[1:]:
        gate = gate | rule.may_match(text)
    return F.when(gate, masked).otherwise(text)


def count_matches(text: Column, rule: Rule) -> Column:
    return F.when(rule.may_match(text), F.size(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))).otherwise(0)


def spans(text: Column, rule: Rule) -> Column:
    """Half-open character spans of a rule's matches, in order."""
    gaps, matches = _cut(text, rule.pattern)
    sizes = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        one = F.struct(F.lit(rule.entity).alias("entity_type"), begin.alias("start"), (begin + x["hit"]).alias("end"))
        return F.struct((begin + F.coalesce(x["hit"], F.lit(0))).alias("at"), F.when(x["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(one))).alias("found"))

    return F.when(rule.may_match(text), F.aggregate(sizes, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(SPANS))


def all_spans(text: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    return F.flatten(F.array(*[spans(text, r) for r in rules]))


def allowed(found: Column, denied: Sequence[str] = DENIED) -> Column:
    """Spans without those of denied entity types."""
    return F.filter(found, lambda s: ~F.coalesce(s["entity_type"].isin(*denied), F.lit(False)))


def mask_spans(text: Column, found: Column, char: str = "X") -> Column:
    """Characters in any span become char. A missing end means the text's end, a missing start its beginning;
    a span without both changes nothing. Ends are clipped to the text; order and overlap don't matter.

    The spans are sorted and the text is put together from its pieces once, not once a span.
    """

    def of(t: Column) -> Column:
        size = F.length(t)
        clipped = F.transform(found, lambda s: F.struct(F.greatest(F.coalesce(s["start"], F.lit(0)), F.lit(0)).alias("a"), F.least(F.coalesce(s["end"], size), size).alias("b"), (s["start"].isNull() & s["end"].isNull()).alias("off")))
        sorted_ = F.array_sort(F.filter(clipped, lambda s: ~s["off"] & (s["b"] > s["a"])))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, s: Column) -> Column:
            begin = F.greatest(s["a"], acc["at"])
            end = F.greatest(s["b"], acc["at"])
            return F.struct(end.alias("at"), F.concat(acc["parts"], F.array(F.substring(t, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(char), end - begin))).alias("parts"))

        done = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(t, acc["at"] + 1, size))
        return F.when(F.size(sorted_) > 0, F.aggregate(sorted_, start, step, done)).otherwise(t)

    return let(text, of)


def sample(text: Column, chars: int) -> Column:
    """The first characters of a text. What is written is the sample alone."""
    return F.substring(text, 1, chars)
