"""Row-identity hashes.

Every random choice in the library is a hash of the row's key and a seed, so a result does not depend on
partitioning, row order or a task being retried. ``rand`` and ``randn`` have none of these properties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def key_string(key, *salt) -> Column:
    """``key:salt1:salt2`` as text; ``key`` is a column name, a list of names or a Column."""
    cols = key if isinstance(key, (list, tuple)) else [key]
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    parts += [s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salt]
    return F.concat_ws(":", *parts)


def md5_key(key, *salt) -> Column:
    """The 128-bit digest the splits are ordered by (SQL engines agree on md5)."""
    return F.md5(key_string(key, *salt))


def hash60(key, *salt) -> Column:
    """The first 60 bits of :func:`md5_key` as a non-negative bigint; same order as the digest."""
    return F.conv(F.substring(md5_key(key, *salt), 1, HASH_BITS // 4), 16, 10).cast("bigint")


UNIFORM_BITS = 52


def uniform(*parts) -> Column:
    """A double in (0, 1) from the digest of the parts, written as text and joined by colons (SQL engines agree on it)."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    h = F.conv(F.substring(F.md5(text), 1, UNIFORM_BITS // 4), 16, 10).cast("bigint")
    return (h.cast("double") + F.lit(0.5)) * F.lit(2.0**-UNIFORM_BITS)


def uniform_sql(*parts: str) -> str:
    """The same draw as SQL text; the parts are SQL expressions."""
    text = " || ':' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"((cast('0x' || substr(md5({text}), 1, {UNIFORM_BITS // 4}) as bigint) + 5e-1) * {2.0**-UNIFORM_BITS!r})"


def normal(*parts) -> Column:
    """A standard normal draw: Box-Muller on two hash-derived uniforms."""
    u1, u2 = uniform(*parts, "radius"), uniform(*parts, "angle")
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def normal_sql(*parts: str) -> str:
    """:func:`normal` as SQL text."""
    u1, u2 = uniform_sql(*parts, "'radius'"), uniform_sql(*parts, "'angle'")
    return f"(sqrt(-2e0 * ln({u1})) * cos(6.283185307179586e0 * {u2}))"


# --- four draws from one digest: two words of 60 bits, each of two draws of 30 ---------------------------------------

DRAWS = 4
_WORD, HALF_BITS = 15, 30  # hexadecimal digits of a word, bits of a draw
_MASK = (1 << HALF_BITS) - 1


def _word_sql(block: str, number: str, parts: tuple[str, ...]) -> str:
    text = " || ':' || ".join(f"cast({p} as varchar)" for p in (*parts, block))
    return f"cast('0x' || substr(md5({text}), 1 + {_WORD} * ({number}), {_WORD}) as bigint)"


def _unit_sql(word: str, half: str) -> str:
    return f"((case when ({half}) = 0 then {word} >> {HALF_BITS} else {word} & {_MASK} end + 5e-1) * {2.0**-HALF_BITS!r})"


def draw_sql(number: str, *parts: str) -> str:
    """Uniform draw ``number`` (an SQL expression) of the blocks of four that follow the parts."""
    word = _word_sql(f"({number}) // {DRAWS}", f"(({number}) % {DRAWS}) // 2", parts)
    return _unit_sql(word, f"({number}) % 2")


def poisson1_sql(u: str) -> str:
    """:func:`poisson1` as SQL text."""
    cdf = poisson1_cdf()
    return "case " + " ".join(f"when {u} < {c!r}e0 then {k}" for k, c in enumerate(cdf)) + f" else {len(cdf)} end"


def poisson1_cdf(terms: int = 16) -> list[float]:
    p, acc, out = 2.718281828459045**-1, 0.0, []
    for k in range(terms):
        acc += p
        out.append(acc)
        p /= k + 1
    return out


def poisson1(u: Column) -> Column:
    """A Poisson(1) count by inverting the distribution function at a uniform."""
    cdf = poisson1_cdf()
    out = F.when(u < cdf[0], 0)
    for k, c in enumerate(cdf[1:], 1):
        out = out.when(u < c, k)
    return out.otherwise(len(cdf))
