"""String, set and link similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: size of the link graph's universe.
UNIVERSE = 6_274_625


def edit_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


#: Stands in the place of a letter that is taken; a NUL of the strings themselves counts as another letter.
_TAKEN, _NUL = "\0", "\ue000"


def _assigned(a: Column, b: Column) -> Column:
    """(left, rest): letters of ``a`` that found a partner, in order, and ``b`` with the partners taken out.

    Each letter of ``a`` in turn takes the first equal letter of ``b`` within reach that is still there.
    """
    reach = F.greatest(F.floor(F.greatest(F.length(a), F.length(b)) / 2) - 1, F.lit(0)).cast("int")

    def step(state: Column, x: Column) -> Column:
        low = F.greatest(x["i"] - reach, F.lit(1))
        at = F.position(x["c"], F.substr(state["rest"], low, F.greatest(x["i"] + reach - low + 1, F.lit(0))))
        taken = F.struct(F.concat(state["left"], x["c"]).alias("left"), F.overlay(state["rest"], F.lit(_TAKEN), low + at - 1, F.lit(1)).alias("rest"))
        # A letter that is nowhere in ``b`` leaves the state before anything is cut.
        return F.when(F.contains(b, x["c"]), F.when(at > 0, taken).otherwise(state)).otherwise(state)

    letters = F.transform(F.split(a, ""), lambda c, i: F.struct((i + 1).alias("i"), c.alias("c")))
    return F.aggregate(letters, F.struct(F.lit("").alias("left"), b.alias("rest")), step)


def jaro(a: Column | str, b: Column | str) -> Column:
    """Jaro similarity, as letters that match within reach and their order say; 0 if a string is empty."""
    a, b = (F.col(s) if isinstance(s, str) else s for s in (a, b))
    x, y = (F.replace(s, F.lit(_TAKEN), F.lit(_NUL)) for s in (a, b))

    def score(found: Column) -> Column:
        right = F.filter(F.zip_with(F.split(found["rest"], ""), F.split(y, ""), lambda r, c: F.when(r == _TAKEN, c)), lambda c: c.isNotNull())
        m = F.length(found["left"])
        unlike = F.size(F.filter(F.zip_with(F.split(found["left"], ""), right, lambda p, q: p != q), lambda differ: differ))
        return F.when(m == 0, 0.0).otherwise((m / F.length(x) + m / F.length(y) + (m - F.floor(unlike / 2)) / m) / 3)

    # One array of one struct, so that the assignment is worked out once though it is read many times.
    value = F.transform(F.array(_assigned(x, y)), score)[0]
    return F.when(a.isNotNull() & b.isNotNull(), F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(value))


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """Jaro similarity, raised by up to four common first letters where it is above 0.7."""
    a, b = (F.col(s) if isinstance(s, str) else s for s in (a, b))
    shortest = F.least(F.length(a), F.length(b), F.lit(4))
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda k: (k <= shortest) & (F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k))))
    return F.transform(F.array(jaro(a, b)), lambda s: F.when(s > 0.7, s + same * 0.1 * (1 - s)).otherwise(s))[0]


def hamming_similarity(a: Column, b: Column) -> Column:
    """Differing places, the difference in length included, against the greater length."""
    longest = F.greatest(F.length(a), F.length(b))
    at = lambda s, i: F.substr(s, i, F.lit(1))
    differ = F.aggregate(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), F.lit(0), lambda n, i: n + F.when(at(a, i) == at(b, i), 0).otherwise(1))
    return F.when(longest == 0, 1.0).otherwise(1 - differ / longest)


def _words(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = _words(a), _words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def _common(a: Column, b: Column) -> Column:
    return F.size(F.filter(_words(a), lambda w: F.array_contains(_words(b), w)))


def token_cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(_common(a, b), F.sqrt(F.size(_words(a)) * F.size(_words(b)))), F.lit(0.0))


def token_dice(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * _common(a, b), F.size(_words(a)) + F.size(_words(b))), F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(_common(a, b), F.greatest(F.size(_words(a)), F.size(_words(b)))), F.lit(0.0))


def starts_with(a: Column, b: Column) -> Column:
    return F.startswith(b, a).cast("double")


def ends_with(a: Column, b: Column) -> Column:
    return F.endswith(b, a).cast("double")


def same(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def starts_or_ends_with(long: Column, short: Column) -> Column:
    return F.startswith(F.lower(long), F.lower(short)) | F.endswith(F.lower(long), F.lower(short))


def string_features(mention: Column, entity: Column) -> dict[str, Column]:
    """Five features; all 0 where the mention is longer than the entity."""
    fits = F.length(mention) <= F.length(entity)
    guard = lambda c: F.when(fits, c).otherwise(0.0)
    return {
        "es": guard(edit_similarity(mention, entity)),
        "jaro_winkler": guard(jaro_winkler(mention, entity)),
        "start_with": guard(starts_with(mention, entity)),
        "end_with": guard(ends_with(mention, entity)),
        "same": guard(same(mention, entity)),
    }


def ngd(common: Column, size_a: Column, size_b: Column, universe: int = UNIVERSE) -> Column:
    """Normalised distance as a similarity; 0 if any size is 0."""
    high, low = F.greatest(size_a, size_b), F.least(size_a, size_b)
    value = 1 - (F.ln(high) - F.ln(common)) / (F.ln(F.lit(float(universe))) - F.ln(low))
    return F.when((common > 0) & (low > 0), value).otherwise(0.0)


def pmi(common: Column, size_a: Column, size_b: Column, universe: int = UNIVERSE, normalized: bool = True) -> Column:
    if normalized:
        return F.when((common > 0) & (size_a > 0) & (size_b > 0), common / F.least(size_a, size_b)).otherwise(0.0)
    return F.when((common > 0) & (size_a > 0) & (size_b > 0), common * F.lit(float(universe)) / (size_a * size_b)).otherwise(0.0)


def njs(common: Column, size_a: Column, size_b: Column) -> Column:
    """ln(common + 1) / ln(union + 1); two empty sets give 0."""
    return F.coalesce(F.try_divide(F.ln(common + 1.0), F.ln(size_a + size_b - common + 1.0)), F.lit(0.0))


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def phrase_kernel(matches: Column, cover: Column, matched: Column, total: Column) -> Column:
    """Weight of a partly matched phrase: total * matches/cover * (matched/total)^2."""
    return F.coalesce(total * F.try_divide(matches, cover) * F.pow(F.try_divide(matched, total), F.lit(2.0)), F.lit(0.0))
