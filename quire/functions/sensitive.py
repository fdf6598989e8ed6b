"""Sensitive file names and leaked credentials."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import any_of, bind

_NAME = (
    r"(?is)\A(?:\.env|credentials?|secrets?)(?:\.|\z)"
    r"|\Aid_(?:rsa|dsa|ecdsa|ed25519)\z"
    r"|\.(?:pem|key)\z"
)


def is_sensitive_name(base: Column) -> Column:
    return base.rlike(_NAME)


@dataclass(frozen=True)
class SecretRule:
    """One content rule.

    ``pattern`` is the token without its surroundings. ``hint`` is a literal that every
    match contains; texts without it never reach the regular expression. With ``alphabet``
    the token must not touch another character of that class on either side. With
    ``needs_context`` it must follow ``Bearer `` or have ``=`` or ``:`` within the 32
    bytes before it, on the same line.
    """

    name: str
    pattern: str
    hint: str = ""
    alphabet: str = ""
    severity: str = "hard"
    needs_context: bool = False

    def _token(self) -> str:
        before = f"(?<![{self.alphabet}])" if self.alphabet else ""
        after = f"(?![{self.alphabet}])" if self.alphabet else ""
        return f"{before}{self.pattern}{after}"

    def regex(self) -> str:
        if not self.needs_context:
            return self._token()
        # The token is tried first; looking back is the slow part.
        return rf"(?={self._token()})(?<=Bearer |[=:][^\n\r]{{0,31}}){self._token()}"

    def _subject(self, text: Column) -> Column:
        # One character per byte, so that the 32-byte reach is counted in bytes.
        if self.needs_context:
            return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
        return text

    def _worth_searching(self, text: Column) -> Column | None:
        if self.hint:
            return F.contains(text, F.lit(self.hint))
        return text.rlike(self._token()) if self.needs_context else None

    def found_in(self, text: Column) -> Column:
        hit = self._subject(text).rlike(self.regex())
        likely = self._worth_searching(text)
        return hit if likely is None else likely & hit

    def hits_in(self, text: Column) -> Column:
        hits = F.regexp_count(self._subject(text), F.lit(self.regex())).cast("bigint")
        likely = self._worth_searching(text)
        if likely is None:
            return hits
        return F.when(likely, hits).otherwise(F.lit(0).cast("bigint"))


# Key block titles, token prefixes, token lengths and alphabets.
_KEY_BLOCKS = (
    ("private_key", "PRIVATE KEY"),
    ("rsa_private_key", "RSA PRIVATE KEY"),
    ("openssh_private_key", "OPENSSH PRIVATE KEY"),
    ("ec_private_key", "EC PRIVATE KEY"),
    ("dsa_private_key", "DSA PRIVATE KEY"),
    ("pgp_private_key", "PGP PRIVATE KEY BLOCK"),
)
_BLOCK_START = "-----BEGIN "
_UPPER_ALNUM = "A-Z0-9"
_TOKEN_CHARS = "A-Za-z0-9_-"
_TOKENS = (
    ("aws_akia", "AKIA", _UPPER_ALNUM, 16, 16, "hard"),
    ("aws_asia", "ASIA", _UPPER_ALNUM, 16, 16, "hard"),
    ("github_ghp", "ghp_", _TOKEN_CHARS, 30, 255, "soft"),
    ("github_gho", "gho_", _TOKEN_CHARS, 30, 255, "soft"),
    ("github_ghu", "ghu_", _TOKEN_CHARS, 30, 255, "soft"),
    ("github_ghs", "ghs_", _TOKEN_CHARS, 30, 255, "soft"),
    ("github_ghr", "ghr_", _TOKEN_CHARS, 30, 255, "soft"),
    ("sk_token", "sk-", _TOKEN_CHARS, 40, 255, "soft"),
)


def default_secret_rules() -> tuple[SecretRule, ...]:
    blocks = tuple(
        SecretRule(
            name=name,
            pattern=f"(?s:-----BEGIN {title}-----.*?-----END {title}-----)",
            hint=f"-----BEGIN {title}-----",
        )
        for name, title in _KEY_BLOCKS
    )
    tokens = tuple(
        SecretRule(
            name=name,
            pattern=f"{prefix}[{alphabet}]{{{least},{most}}}",
            hint=prefix,
            alphabet=alphabet,
            severity=severity,
        )
        for name, prefix, alphabet, least, most, severity in _TOKENS
    )
    return blocks + tokens


def has_secret(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    """Whether any rule finds something. One literal search rules out all key blocks."""
    blocks = [rule for rule in rules if rule.hint.startswith(_BLOCK_START)]
    others = [rule.found_in(text) for rule in rules if rule not in blocks]
    guarded = F.contains(text, F.lit(_BLOCK_START)) & any_of(
        [rule.found_in(text) for rule in blocks]
    )
    return any_of([*others, guarded])


def first_secret_rule(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    """Name of the first rule, in the given order, that finds something; else null."""
    chain = F.lit(None).cast("string")
    for rule in reversed(rules):
        chain = F.when(rule.found_in(text), F.lit(rule.name)).otherwise(chain)
    return chain


def finding_counts(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    """``array<struct<rule, severity, n_hits>>`` holding the rules that found something."""
    counted = F.array(
        *[
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(rule.severity).alias("severity"),
                rule.hits_in(text).alias("n_hits"),
            )
            for rule in rules
        ]
    )
    return bind(counted, lambda found: F.filter(found, lambda f: f["n_hits"] > 0))
