"""Secrets in texts, with DataFrame and SQL functions only.

Base spans are pattern matches. Beside them, every run of 20 or more characters of the base64
alphabet is a candidate: the Shannon entropy of a window of 20 characters slides over it, kept up by
the counts of the character that leaves and of the one that enters, and a candidate whose best window
reaches the limit of its character class, and that no allow-list rule suppresses, is added as a span.
Positions come from the lengths of what lies between the matches and of the matches themselves.

The work is linear in a candidate's length: its characters are split once, and the counts of a window
are five bits each, twelve of them in a long, so that a step changes one of seven longs. Matches are
placed in blocks, so that no growing array is copied for each of them. No pattern repeats a group that
Java matches by recursion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Bits a character that a window must reach: hexadecimal, letters and digits, all of base64.
LIMITS = {"entropy_hex": 2.7, "entropy_alnum": 3.4, "entropy_base64": 3.5}

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that are long enough
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
LOW, LONGS = 43, 7  # the least code of a candidate's characters (43 to 122), and longs of twelve counts
PLACED = 256  # matches of a block
# The allow-list. A candidate that one of these finds is no secret.
ALLOWED = (
    r"^[A-Za-z]+$",  # a word
    r"^[0-9_/=+-]+$",  # a number, a date, a rule
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # a UUID
    r"(?i)example|sample|placeholder|changeme|dummy|your[_-]?(key|token|secret)|redacted|xxxx",
    r"0123456789|abcdefgh|ABCDEFGH|12345678",
    r"(.)\1{7}",  # one character again and again
    r"^(?:[A-Za-z]{1,12}[/_=-])++[A-Za-z]{0,12}$",  # words joined by marks; possessive, so that Java loops
)
KINDS = ("assign", "access", "hex", *LIMITS)


def _quote(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _bind(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _places(pattern: str, group: int = 0) -> str:
    """SQL for array<struct<s, e, v>>: code-point span and a group of every match in ``text``."""
    p = _quote(pattern)
    value = f"regexp_extract_all(text, {p}, {group})"
    rows = f"zip_with(split(text, {p}, -1), arrays_zip(regexp_extract_all(text, {p}, 0), {value}), (g, h) -> struct(length(g) as g, length(h['0']) as n, h['1'] as v))"
    kind = "array<struct<s:int,e:int,v:string>>"
    step = "if(x.n is null, a, struct(a.at + x.g + x.n as at, concat(a.found, array(struct(a.at + x.g as s, a.at + x.g + x.n as e, x.v as v))) as found))"
    block = f"aggregate(slice(r, b * {PLACED} + 1, {PLACED}), struct(0 as at, cast(array() as {kind}) as found), (a, x) -> {step})"
    moved = "transform(y.found, z -> struct(z.s + t.at as s, z.e + t.at as e, z.v as v))"
    joined = f"aggregate(transform(sequence(0, (size(r) - 1) div {PLACED}), b -> {block}), struct(0 as at, cast(array() as array<{kind}>) as found), (t, y) -> struct(t.at + y.at as at, concat(t.found, array({moved})) as found), t -> flatten(t.found))"
    return f"if(text rlike {p}, {_bind(rows, 'r', joined)}, cast(array() as {kind}))"


def entropy(value: str) -> str:
    """SQL for the greatest entropy of a window of ``value``, in bits a character; its characters are those of CANDIDATE."""
    weights = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0:.17g}D" for c in range(WINDOW + 2)) + ")"
    codes = f"transform(split({value}, ''), x -> ascii(x) - {LOW - 1})"
    # Each character that enters, as 1 and more, after the one that then leaves, as its negative.
    events = _bind(codes, "q", f"flatten(zip_with(q, slice(concat(array_repeat(0, {WINDOW}), q), 1, size(q)), (e, l) -> if(l > 0, array(-l, e), array(e))))")
    sign = "if(e > 0, 1, -1)"
    word, shift = "(abs(e) - 1) div 12", "cast(5 * ((abs(e) - 1) % 12) as int)"
    count = f"cast(shiftright(element_at(a.c, cast({word} + 1 as int)), {shift}) & 31 as int)"
    sums = f"a.s + element_at({weights}, {count} + {sign} + 1) - element_at({weights}, {count} + 1)"
    step = f"struct(transform(a.c, (x, j) -> if(j = {word}, x + {sign} * shiftleft(1L, {shift}), x)) as c, {sums} as s, a.n + {sign} as n, if(e > 0 and a.n + 1 = {WINDOW}, greatest(a.best, {math.log2(WINDOW):.17g}D - ({sums}) / {WINDOW}), a.best) as best)"
    return f"aggregate({events}, struct(array_repeat(0L, {LONGS}) as c, 0D as s, 0 as n, 0D as best), (a, e) -> {step}, a -> a.best)"


def _tagged(array: str, kind: int, keep: str) -> str:
    return f"transform(filter({array}, x -> {keep}), x -> struct(x.s as s, {kind} as k, x.e as e))"


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text), found over the whole text.

    n_assign, n_access, n_hex count base spans; base_sha256 digests them; spans lists base and added
    ones; n_added counts the latter. A null or empty text has none (the digest of the empty string); a
    null doc_id is passed on; repeated rows come back repeated; no rows, no rows.
    """
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.expr(_places(ASSIGN, 2)).alias("a"),
        F.expr(_places(ACCESS)).alias("k"),
        F.expr(_places(HEX)).alias("h"),
        F.expr(_places(CANDIDATE)).alias("c"),
    )
    base = found.select(
        "doc_id",
        F.expr(f"array_sort(concat({_tagged('a', 0, 'length(x.v) >= 6')}, {_tagged('k', 1, 'x.e - x.s >= 20')}, {_tagged('h', 2, 'true')}))").alias("base"),
        F.expr("filter(c, x -> not (" + " or ".join(f"x.v rlike {_quote(p)}" for p in ALLOWED) + "))").alias("c"),
    )
    kind = "if(x.v rlike '^[0-9a-fA-F]+$', 3, if(x.v rlike '^[A-Za-z0-9]+$', 4, 5))"
    rated = base.select("doc_id", "base", F.expr(f"transform(c, x -> struct(x.s as s, {kind} as k, x.e as e, {entropy('x.v')} as bits))").alias("c"))
    limits = "array(0D, 0D, 0D, " + ", ".join(f"{v}D" for v in LIMITS.values()) + ")"
    added = f"transform(filter(c, x -> x.bits >= element_at({limits}, x.k + 1) and not exists(base, b -> x.s >= b.s and x.e <= b.e)), x -> struct(x.s as s, x.k as k, x.e as e))"
    rated = rated.select("doc_id", "base", F.expr(added).alias("added"))
    every = rated.select("doc_id", "base", "added", F.expr("array_sort(concat(base, added))").alias("spans"))
    count = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{KINDS[i]}") for i in range(3)]
    return every.select("doc_id", *count, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("added").cast("long").alias("n_added"))
