"""Sensitive-data detectors: labelled patterns, some gated by a checksum, as Catalyst expressions.

``scan`` reports counts per category with the policy's action, never the values; ``redact`` replaces the matches of
the categories whose action is redact or block, in the order of the registry, each on the result of the one before.
Defined results: null and empty texts have no findings, a null stays null; texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.json import map_string_values, string_values

REDACTED = "<redacted>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit(text: Column, at: Column | int) -> Column:
    return F.substr(text, F.lit(at) if isinstance(at, int) else at, F.lit(1)).cast("int")


def luhn(value: Column) -> Column:
    """Payment card number of 13 to 19 digits with a valid check digit."""
    d = F.reverse(_digits(value))
    doubled = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
        lambda i: F.when(i % 2 == 0, F.when(_digit(d, i) * 2 > 9, _digit(d, i) * 2 - 9).otherwise(_digit(d, i) * 2)).otherwise(_digit(d, i)),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.length(d).between(13, 19) & (total % 10 == 0)


def iban(value: Column) -> Column:
    """Account number whose rearranged digits leave 1 modulo 97; folded digit by digit."""
    s = F.upper(F.regexp_replace(value, r"\s+", ""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, ch: F.when(ch.rlike("^[0-9]$"), (a * 10 + ch.try_cast("int")) % 97).when(ch == "", a).otherwise((a * 100 + F.ascii(ch) - 55) % 97),
    )
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


def aba(value: Column) -> Column:
    """Nine-digit routing number with the weights 3, 7, 1."""
    d = _digits(value)
    total = 3 * (_digit(d, 1) + _digit(d, 4) + _digit(d, 7)) + 7 * (_digit(d, 2) + _digit(d, 5) + _digit(d, 8)) + _digit(d, 3) + _digit(d, 6) + _digit(d, 9)
    return (F.length(d) == 9) & (total % 10 == 0)


def ssn(value: Column) -> Column:
    """Social security number with a possible area, group and serial."""
    d = _digits(value)
    area = F.substr(d, F.lit(1), F.lit(3)).cast("int")
    possible = (area != 0) & (area != 666) & (area < 900) & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6), F.lit(4)) != "0000")
    return (F.length(d) == 9) & possible


def phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def nino(value: Column) -> Column:
    """National insurance number with an allowed prefix."""
    s = F.upper(F.regexp_replace(value, " ", ""))
    bad = s.rlike("^[DFIQUV]|^.[DFIOQUV]|^(?:BG|GB|NK|KN|NT|TN|ZZ)")
    return (F.length(s) == 9) & ~bad


# The dihedral group's multiplication and the permutation of the check digit scheme.
_VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
_VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]


def verhoeff(value: Column) -> Column:
    """Number whose Verhoeff check digit is right, as a fold over its digits from the right."""
    d = F.reverse(_digits(value))
    table, perm = F.lit(_VERHOEFF_D), F.lit(_VERHOEFF_P)
    step = lambda c, i: F.get(F.get(table, c), F.get(F.get(perm, (i - 1) % 8), _digit(d, i)))
    return (F.length(d) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), step) == 0)


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(value, ""), lambda ch: ch != "")
    n = F.size(chars).cast("double")
    share = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, ch: a - share(ch) * F.log2(share(ch)))
    return F.when(F.length(value) > 0, F.abs(total)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Detector:
    """A labelled pattern; ``valid`` decides whether a match counts."""

    category: str
    group: str
    severity: str
    pattern: str
    valid: Callable[[Column], Column] | None = field(default=None, compare=False)
    ignore_case: bool = False

    @property
    def source(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern

    def count(self, text: Column) -> Column:
        found = tx.matches(text, self.source)
        return F.size(F.filter(found, self.valid) if self.valid else found)

    def scrub(self, text: Column) -> Column:
        return tx.replace_valid(text, self.source, self.valid, REDACTED) if self.valid else tx.replace(text, self.source, REDACTED)


# Categories, groups, severities and patterns, in the order in which they are applied.
_FIRST = [
    Detector("email", "pii", "warning", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    Detector("api_key", "secret", "critical", r"\bsk-[A-Za-z0-9_-]{8,}"),
    Detector("aws_key", "secret", "critical", r"\bAKIA[0-9A-Z]{16}\b"),
    Detector("google_api_key", "secret", "critical", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    Detector("jwt", "secret", "critical", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Detector("bearer_token", "secret", "critical", r"\b[Bb]earer\s+[A-Za-z0-9._-]+\b"),
    Detector("github_token", "secret", "critical", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    Detector("slack_token", "secret", "critical", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    Detector("private_key", "secret", "critical", r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----"),
    Detector("password", "credential", "critical", r"\b(?:password|passphrase|passwd|pwd)\b\s*(?:is|:|=)\s*\S+", ignore_case=True),
    Detector("credit_card", "financial", "critical", r"\b\d(?:[ -]?\d){12,18}\b", luhn),
    Detector("iban", "financial", "critical", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", iban),
    Detector("us_routing", "financial", "critical", r"\b\d{9}\b", aba),
]
_BIC = r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"
_LAST = [
    Detector("us_ssn", "gov_id", "critical", r"\b\d{3}-\d{2}-\d{4}\b", ssn),
    Detector(
        "phone",
        "pii",
        "warning",
        r"(?<!\w)(?:\+?1[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|(?<!\w)\+\d{9,15}(?!\d)",
        phone,
    ),
    Detector("ipv4", "pii", "warning", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"),
    Detector("ipv6", "pii", "warning", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b|\b(?:[A-Fa-f0-9]{1,4}:){1,7}:(?:[A-Fa-f0-9]{1,4}\b)?"),
    Detector("mac_address", "pii", "warning", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    Detector(
        "special_category",
        "special_category",
        "warning",
        r"\b(?:diagnos(?:is|es|ed)?|hiv|pregnan(?:t|cy)|disab(?:led|ility)|biometric|fingerprints?|genetic|ethnicity|religio(?:n|us))\b",
        ignore_case=True,
    ),
]
LOCALE_PACKS = {
    "uk": [Detector("uk_nino", "gov_id", "critical", r"\b[A-Z]{2}\d{6}[A-D]\b", nino)],
    "in": [Detector("in_aadhaar", "gov_id", "critical", r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b", verhoeff)],
}


def builtin(spark: SparkSession) -> list[Detector]:
    """The registry; the countries of bank codes are those that the JVM knows."""
    countries = sorted(spark._jvm.java.util.Locale.getISOCountries())

    def bic(value: Column) -> Column:
        return F.length(value).isin(8, 11) & F.substr(value, F.lit(5), F.lit(2)).isin(countries)

    return [*_FIRST, Detector("swift_bic", "financial", "critical", _BIC, bic), *_LAST]


def with_locales(detectors: list[Detector], *codes: str) -> list[Detector]:
    """The registry with the packs of these countries; a detector that is there already isn't added twice."""
    out = list(detectors)
    for code in codes:
        if code.lower() not in LOCALE_PACKS:
            raise ValueError(f"no pack for {code!r}; there are {sorted(LOCALE_PACKS)}")
        out += [d for d in LOCALE_PACKS[code.lower()] if d.category not in {x.category for x in out}]
    return out


def with_entropy(detectors: list[Detector], min_length: int = 24, min_entropy: float = 3.5) -> list[Detector]:
    """The registry with a detector of opaque tokens; an earlier one is replaced."""
    opaque = Detector(
        "high_entropy_secret", "secret", "warning", rf"\b[A-Za-z0-9+/=_-]{{{min_length},}}\b", lambda v: (F.length(v) >= min_length) & (entropy(v) >= min_entropy)
    )
    return [*(d for d in detectors if d.category != opaque.category), opaque]


@dataclass(frozen=True)
class Policy:
    """An action per category or group; the category wins over its group, that over the default."""

    actions: tuple[tuple[str, str], ...] = ()
    default: str = "flag"

    def action(self, category: str, group: str = "") -> str:
        table = dict(self.actions)
        return table.get(category) or table.get(group) or self.default


def policy(name: str = "default") -> Policy:
    """A preset: default, gdpr, pci or strict."""
    presets = {
        "default": Policy((("secret", "redact"), ("email", "redact"))),
        "gdpr": Policy((("special_category", "block"), ("pii", "redact"), ("gov_id", "redact"), ("financial", "redact"), ("secret", "redact"), ("credential", "block"))),
        "pci": Policy((("financial", "block"), ("secret", "redact"), ("pii", "redact"))),
        "strict": Policy((("secret", "block"), ("credential", "block"), ("financial", "block"), ("gov_id", "block")), "redact"),
    }
    return presets[name]


def counts(text: Column, detectors: Iterable[Detector]) -> list[Column]:
    """One count column per category, named after it."""
    return [d.count(text).alias(d.category) for d in detectors]


def nested_counts(document: Column, detectors: Iterable[Detector]) -> list[Column]:
    """One count column per category over all string values of a JSON text; a match never reaches from one value into the next."""
    values = string_values(document)
    found = lambda d: F.aggregate(values, F.lit(0), lambda n, v: n + F.coalesce(d.count(v), F.lit(0)))
    return [found(d).alias(d.category) for d in detectors]


def findings(text: Column, detectors: Iterable[Detector], rules: Policy) -> Column:
    """ARRAY<STRUCT<category, grp, severity, action, cnt>> of the categories found, sorted by category."""
    rows = [
        F.struct(
            F.lit(d.category).alias("category"),
            F.lit(d.group).alias("grp"),
            F.lit(d.severity).alias("severity"),
            F.lit(rules.action(d.category, d.group)).alias("action"),
            d.count(text).alias("cnt"),
        )
        for d in sorted(detectors, key=lambda d: d.category)
    ]
    return F.filter(F.array(*rows), lambda f: f.cnt > 0)


def redact(df: DataFrame, column: str, detectors: Iterable[Detector], rules: Policy) -> DataFrame:
    """``df`` with ``redacted``: the text after all detectors whose action is redact or block."""
    df = df.withColumn("redacted", F.col(column))
    for d in detectors:
        if rules.action(d.category, d.group) in ("redact", "block"):
            df = df.withColumn("redacted", d.scrub(F.col("redacted")))
    return df


def verdict(found: Column) -> Column:
    """What a gate does with these findings: block before flag before redact, else allow."""
    has = lambda action: F.exists(found, lambda f: f.action == action)
    return F.when(has("block"), "block").when(has("flag"), "flag").when(has("redact"), "redact").otherwise("allow")


def guard(df: DataFrame, found: str) -> tuple[DataFrame, DataFrame]:
    """(passed, blocked) rows by the findings column."""
    stop = verdict(F.col(found)) == "block"
    return df.filter(~stop), df.filter(stop)


#: The recordings' scrubber: ordered patterns, the last one for any long opaque token.
RECORDING_PATTERNS = [d.pattern for d in _FIRST[:6]] + [r"\b[A-Za-z0-9_-]{32,}\b"]


def scrub_document(document: Column) -> Column:
    """The recordings' scrubber over the string values of a JSON text; names stay."""
    return map_string_values(document, scrub_recording)


def scrub_recording(text: Column) -> Column:
    for source in RECORDING_PATTERNS:
        text = tx.replace(text, source, REDACTED)
    return text


# Ranks of severities.
SEVERITY_RANK = {"info": 0, "warning": 1, "critical": 2}


def auto_flags(found: Column) -> Column:
    """ARRAY<STRUCT<action, categories, severity>>: what a ledger notes of a row's findings, for block, redact and flag in this order.

    A redaction is noted as info, the others with the highest severity among their findings; actions without findings are left out.
    """
    rank = lambda f: F.when(f.severity == "critical", 2).when(f.severity == "warning", 1).otherwise(0)
    of = lambda action: F.filter(found, lambda f: f.action == action)
    rows = []
    for action in ("block", "redact", "flag"):
        own = of(action)
        top = F.array_max(F.transform(own, rank))
        names = F.array_sort(F.array_distinct(F.transform(own, lambda f: f.category)))
        severity = F.lit("info") if action == "redact" else F.when(top == 2, "critical").when(top == 1, "warning").otherwise("info")
        rows.append(F.struct(F.lit(action).alias("action"), names.alias("categories"), severity.alias("severity")))
    return F.filter(F.array(*rows), lambda r: F.size(r.categories) > 0)
