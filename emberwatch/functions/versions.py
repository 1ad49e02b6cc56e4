"""Version orders as string keys: one version precedes another exactly if its key does, so range checks are plain
comparisons that need no function over pairs. Keys are worked out once per distinct version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a number's length: no string has a number that is longer.
_DIGITS = 10
_PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "~") + " "
_TO = "".join(chr(ord(c) + 256) for c in _PUNCT)


def _number(digits: Column) -> Column:
    """Length, then digits without leading zeros: longer numbers are greater."""
    bare = F.regexp_replace(digits, r"\A0+", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), _DIGITS, "0"), bare)


def _epoch(version: Column) -> tuple[Column, Column]:
    """Twenty digits, and what follows. An epoch beyond twenty digits counts as 0."""
    e = F.regexp_replace(F.regexp_extract(version, r"\A([0-9]+):", 1), r"\A0+", "")
    e = F.when(F.length(e) > 20, "").otherwise(e)
    return F.lpad(e, 20, "0"), F.regexp_replace(version, r"\A[0-9]+:", "")


def _dpkg_fragment(text: Column) -> Column:
    def pair(x: Column) -> Column:
        return F.concat(F.translate(F.translate(F.regexp_extract(x, r"\A([^0-9]*)", 1), "~", "\x01"), _PUNCT, _TO), F.lit("\x02"), _number(F.regexp_extract(x, r"([0-9]*)\z", 1)))

    pairs = F.regexp_extract_all(text, F.lit(r"[^0-9]+[0-9]*|[0-9]+"), F.lit(0))
    return F.concat(F.when(text == "", "\x02" + "0" * _DIGITS).otherwise(F.array_join(F.transform(pairs, pair), "")), F.lit("\x02"))


def dpkg_key(version: Column) -> Column:
    """Epoch, upstream, revision; a tilde precedes the end, the end letters, letters other characters."""
    epoch, rest = _epoch(version)
    upstream = F.when(rest.contains("-"), F.regexp_extract(rest, r"(?s)\A(.*)-[^-]*\z", 1)).otherwise(rest)
    revision = F.when(rest.contains("-"), F.regexp_extract(rest, r"-([^-]*)\z", 1)).otherwise("")
    return F.concat(epoch, _dpkg_fragment(upstream), _dpkg_fragment(revision))


def rpm_key(version: Column) -> Column:
    """Epoch, then letters, numbers, tildes and carets in turn; other characters only separate."""
    epoch, rest = _epoch(version)
    tokens = F.regexp_extract_all(rest, F.lit(r"[A-Za-z]+|[0-9]+|~|\^"), F.lit(0))
    code = F.transform(tokens, lambda t: F.when(t == "~", "\x01").when(t == "^", "\x03").when(t.rlike("^[0-9]"), F.concat(F.lit("\x05"), _number(t))).otherwise(F.concat(F.lit("\x04"), t, F.lit("\x01"))))
    return F.concat(epoch, F.array_join(code, ""), F.lit("\x02"))


def semver_key(version: Column) -> Column:
    """Up to three numbers and a prerelease, which precedes the release; null for what isn't such a version."""
    bare = F.regexp_replace(F.regexp_replace(version, r"\Av", ""), r"(?s)\+.*\z", "")
    core = F.regexp_extract(bare, r"\A([^-]*)", 1)
    pre = F.when(bare.contains("-"), F.regexp_extract(bare, r"(?s)\A[^-]*-(.*)\z", 1))
    parts = F.split(core, r"\.", -1)
    numbers = F.transform(F.slice(F.concat(parts, F.array(F.lit("0"), F.lit("0"))), 1, 3), lambda p: F.lpad(F.regexp_replace(p, r"\A0+(?=[0-9])", ""), 20, "0"))
    ids = F.transform(F.split(pre, r"\.", -1), lambda i: F.when(i.rlike(r"\A[0-9]+\z"), F.concat(F.lit("1"), F.lpad(F.regexp_replace(i, r"\A0+(?=[0-9])", ""), 20, "0"))).otherwise(F.concat(F.lit("2"), i)))
    tail = F.when(pre.isNull(), "~").otherwise(F.concat(F.lit("!"), F.array_join(ids, "\x01")))
    return F.when(core.rlike(r"\A[0-9]{1,20}(\.[0-9]{1,20}){0,2}\z"), F.concat(F.array_join(numbers, ""), tail))


def key_for(kind: Column, version: Column) -> Column:
    return F.when(kind == "dpkg", dpkg_key(version)).when(kind == "rpm", rpm_key(version)).when(kind == "semver", semver_key(version))
