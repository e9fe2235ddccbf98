"""Scalar functions as Column expressions: they stay inside Spark's generated code.

Absent strings are empty, not null, everywhere in this library; ``text`` applies that rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_SPACE = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The string, or the empty string for null."""
    return F.coalesce(col(c), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.when(F.trim(text(c)) != "", col(c))


# ---------------------------------------------------------------- identities


def short_sha(c: Column | str) -> Column:
    """First 16 hex digits of SHA-256: the form of source and document ids."""
    return F.substring(F.sha2(text(c), 256), 1, 16)


def chunk_id(source_id: Column | str, url: Column | str, heading_path: Column | str, index: Column | str) -> Column:
    """SHA-256 of the parts without separators; names a chunk's place, not its content."""
    return F.sha2(F.concat(text(source_id), text(url), text(heading_path), col(index).cast("string")), 256)


def document_hash(markdown: Column | str) -> Column:
    """SHA-256 of the text with line ends and outer white space trimmed."""
    lines = F.regexp_replace(text(markdown), r"(?m)[ \t]+$", "")
    return F.sha2(F.regexp_replace(lines, r"(?U)^\s+|\s+$", ""), 256)


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def library_id_parts(c: Column | str) -> Column:
    """struct(namespace, name, version) of ``/namespace/name[/version]``; null where it is not one.

    Two segments need the namespace ``local``; three may have any.
    """
    parts = F.split(text(c), "/", -1)
    whole = F.forall(F.slice(parts, 2, 3), lambda p: F.trim(p) != "")
    two = (F.size(parts) == 3) & (parts[1] == "local")
    valid = text(c).startswith("/") & whole & (two | (F.size(parts) == 4))
    return F.when(valid, F.struct(parts[1].alias("namespace"), parts[2].alias("name"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("version")))


def citation_url(canonical: Column | str, url: Column | str) -> Column:
    return F.coalesce(blank_to_null(canonical), col(url))


def heading_label(heading_path: Column | str, title: Column | str, url: Column | str) -> Column:
    return F.coalesce(blank_to_null(heading_path), blank_to_null(title), col(url))


def embedding_text(title: Column | str, heading: Column | str, content: Column | str) -> Column:
    """Title, heading (unless it says the same as the title) and content, blank ones left out."""
    t, h = F.trim(text(title)), F.trim(text(heading))
    own = F.when(F.lower(t) != F.lower(h), blank_to_null(h))
    return F.concat_ws("\n\n", blank_to_null(t), own, blank_to_null(F.trim(text(content))))


# ---------------------------------------------------------------- names and words


def normal_content(c: Column | str) -> Column:
    """Lower case with white space runs as one blank: what makes two results the same."""
    return F.trim(F.regexp_replace(F.lower(text(c)), ANY_SPACE, " "))


def normal_name(c: Column | str) -> Column:
    """One form for all ways to write a name: camel case, dashes, underscores, blanks."""
    spaced = F.regexp_replace(F.trim(text(c)), "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(spaced), "[^a-z0-9]+", " "))


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(text(c)), "[^a-z0-9]+"), lambda w: w != "")


def version_mention(c: Column | str) -> Column:
    """First version such as 1.2 or v1.2.3 in the text, without its v; empty if none."""
    return F.regexp_extract(text(c), r"\bv?(\d+\.\d+(?:\.\d+)?)\b", 1)


def estimated_tokens(c: Column | str) -> Column:
    n = F.size(F.filter(F.split(text(c), ANY_SPACE), lambda w: w != ""))
    return F.floor(n * F.lit(1.3)).cast("int")


def has_technical_identifier(c: Column | str) -> Column:
    """Whether a query names an identifier and so gains from lexical search too."""
    q = text(c)
    inner = q.rlike(r"/[\p{L}\p{Nd}]|[\p{L}\p{Nd}][.-][\p{L}\p{Nd}]|\p{Ll}\p{Lu}")
    # A token of which every letter is upper case, two at least, beside some lower-case letter.
    tokens = F.filter(F.split(q, r"[^\p{L}\p{Nd}._/-]+"), lambda t: t != "")
    shout = F.exists(tokens, lambda t: t.rlike(r"\p{Lu}[^\p{L}]*\p{Lu}") & ~t.rlike(r"[\p{L}&&[^\p{Lu}]]"))
    return inner | (q.rlike(r"\p{Ll}") & shout)


def redact(c: Column | str, secret: str) -> Column:
    """The text without the secret, cut to whole characters of at most 300 bytes; what was cut ends in dots."""
    shown = F.replace(text(c), F.lit(secret), F.lit("[redacted]")) if secret else text(c)
    raw = F.encode(shown, "UTF-8")
    # A character has at most four bytes, so one of these cuts falls between two.
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(300, 296, -1)]
    return F.when(F.octet_length(shown) <= 300, shown).otherwise(F.concat(F.coalesce(*cuts), F.lit("...")))


# ---------------------------------------------------------------- vectors


def balanced_sum(terms: list[Column]) -> Column:
    """Sum as a balanced tree, so that the expression stays shallow."""
    while len(terms) > 1:
        terms = [reduce(lambda a, b: a + b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def is_valid_vector(c: Column | str, width: int | None = None) -> Column:
    v = col(c)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    right = (F.size(v) == width) if width else (F.size(v) > 0)
    return F.coalesce(v.isNotNull() & right & finite, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; 1 where the widths differ or a norm is zero."""
    x, y = col(a), col(b)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norms > 0), 1.0 - dot(x, y) / norms).otherwise(F.lit(1.0))


def cosine_distance_to(c: Column | str, vector: list[float]) -> Column:
    """Cosine distance to one known vector: the products are unrolled, so they compile."""
    v, n = col(c), len(vector)
    size = sum(float(x) * float(x) for x in vector) ** 0.5
    if not size:
        return F.lit(1.0)
    parts = [F.get(v, F.lit(i)).cast("double") for i in range(n)]
    product = balanced_sum([p * F.lit(float(x)) for p, x in zip(parts, vector, strict=True)])
    norm = F.sqrt(balanced_sum([p * p for p in parts]))
    return F.when((F.size(v) == n) & (norm > 0), 1.0 - product / (norm * F.lit(size))).otherwise(F.lit(1.0))


# ---------------------------------------------------------------- ranking


K1, B, RRF_K = 1.2, 0.75, 60


def idf(total: Column, df: Column) -> Column:
    return F.log(1.0 + (total - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, df: Column, total: Column, length: Column, average: Column) -> Column:
    return idf(total, df) * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * length / average))


def rrf_term(rank: Column) -> Column:
    return 1.0 / (F.lit(float(RRF_K)) + rank)
