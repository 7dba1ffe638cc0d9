"""Deterministic pseudo-random numbers.

Draws are functions of (seed, key), so a result does not depend on partitioning, on retries or on
the engine: md5 is the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _key(seed: int, keys) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])


def digest(seed: int, *keys) -> Column:
    return F.md5(_key(seed, keys))


def _hex(value: Column) -> Column:
    return F.conv(value, 16, 10)


def order_key(seed: int, *keys) -> Column:
    """A 52-bit shuffle key: sorting by it visits rows in a reproducible random order.

    52 bits fit a double exactly, so order statistics on the key are exact.
    """
    return _hex(F.substring(digest(seed, *keys), 1, 13)).cast("long")


def _parts(digest: Column, n: int = 4) -> list[Column]:
    return [_hex(F.substring(digest, 1 + 8 * i, 8)).cast("double") / F.lit(4294967296.0) for i in range(n)]


def uniforms(seed: int, *keys) -> list[Column]:
    """Four numbers in [0, 1) from one digest."""
    return _parts(digest(seed, *keys))


def attempts(numbers: Column, seed: int, kinds, *keys) -> Column:
    """An array of ``(attempt, u)`` to explode: per attempt four uniforms for every kind, in order.

    The numbers come out of the generator, so filters above it read them instead of hashing again.
    """
    digests = F.transform(
        numbers, lambda a: F.struct(a.alias("attempt"), *[digest(seed, F.lit(k), *keys, a).alias(k) for k in kinds])
    )
    return F.transform(
        digests, lambda d: F.struct(d["attempt"].alias("attempt"), F.array(*[u for k in kinds for u in _parts(d[k])]).alias("u"))
    )


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    Not ``get``, which works out its type anew for every row, through all values nested in it.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def start(seed: int, *keys) -> Column:
    """What the digests of (seed, keys, number) begin with: made once per row, however many numbers follow. See ``draw``."""
    return F.concat(_key(seed, keys), F.lit(":"))


def words(digest: Column, n: int = 4) -> list[Column]:
    """The first ``n`` numbers of a digest, two to a whole number of 64 bits; see ``halves``."""
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long") for i in range((n + 1) // 2)]


def halves(word: Column) -> list[Column]:
    """The two numbers in [0, 1) that a word holds."""
    return [h.cast("double") / F.lit(4294967296.0) for h in (F.shiftrightunsigned(word, 32), word.bitwiseAND(F.lit(0xFFFFFFFF)))]


def draw(begin: Column, number: Column, n: int, use) -> Column:
    """``use`` of the first ``n`` uniforms, at most four, of a ``start`` and a number: those of ``uniforms`` and ``attempts``."""
    found = F.md5(F.concat(begin, number.cast("string")))
    if n <= 2:
        return let(words(found, n)[0], lambda w: use(halves(w)[:n]))
    pair = lambda d: F.struct(*[w.alias(f"w{i}") for i, w in enumerate(words(d, n))])
    return let(found, lambda d: let(pair(d), lambda w: use([*halves(w["w0"]), *halves(w["w1"])][:n])))


def spread(u: Column, low, high) -> Column:
    """Map a number in [0, 1) to [low, high)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return low + u * (high - low)
