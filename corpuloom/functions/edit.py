"""Edit distance of one, and mnemonic aliases of addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values. The alphabets of an alias: three letters, a digit, a hyphen, a check symbol.
LETTERS = "ABCDEFGHIJKMNOPQRSTUVWXYZ"
DIGITS = "234679"
CHECK = DIGITS + "ACDEFGHJKMNPQRTUVWXYZ"
CHECK_DIGEST = CHECK + "BIOS"
BODY_LETTERS = 3
TOKEN = rf"(?<![A-Za-z0-9_])[A-Z]{{2,}}[{DIGITS}]-?[{CHECK}](?![A-Za-z0-9_])"
CODES = len(LETTERS) ** BODY_LETTERS * len(DIGITS)


def one_edit(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    near = F.levenshtein(a, b)
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    places = F.sequence(F.lit(0), F.greatest(F.length(a) - 1, F.lit(0)))
    differ = F.filter(places, lambda i: F.get(chars_a, i) != F.get(chars_b, i))
    i, j = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    swapped = (
        (F.length(a) == F.length(b)) & (F.size(differ) == 2) & (j == i + 1)
        & (F.get(chars_a, i) == F.get(chars_b, j)) & (F.get(chars_a, j) == F.get(chars_b, i))
    )
    return (near == 1) | ((near == 2) & swapped)


def check_symbol(body: Column) -> Column:
    """The check symbol of a body of three letters and a digit; '' of anything else.

    The digest weighs each place by a power of four, modulo the digest's
    alphabet, and the sum modulo the printed alphabet picks the symbol.
    """
    terms = [((F.instr(F.lit(CHECK_DIGEST), F.substring(body, i + 1, 1)) - 1) * 4**i) % len(CHECK_DIGEST) for i in range(BODY_LETTERS + 1)]
    total = terms[0] + terms[1] + terms[2] + terms[3]
    legal = body.rlike(rf"^[{LETTERS}]{{{BODY_LETTERS}}}[{DIGITS}]$")
    return F.when(legal, F.substring(F.lit(CHECK), (total % len(CHECK) + 1).cast("int"), F.lit(1))).otherwise("")


def body_of(number: Column) -> Column:
    """The ``number``-th body (from 0): letters count up from the right, the digit fastest."""
    n = F.pmod(number, F.lit(CODES))
    digit = F.substring(F.lit(DIGITS), (n % len(DIGITS) + 1).cast("int"), F.lit(1))
    rest = F.floor(n / len(DIGITS))
    letters = []
    for _ in range(BODY_LETTERS):
        letters.append(F.substring(F.lit(LETTERS), (rest % len(LETTERS) + 1).cast("int"), F.lit(1)))
        rest = F.floor(rest / len(LETTERS))
    return F.concat(*reversed(letters), digit)


def normalise_alias(written: Column) -> Column:
    """Upper case without white space, the hyphen before the check symbol restored."""
    compact = F.upper(F.regexp_replace(F.coalesce(written, F.lit("")), r"(?U)\s+", ""))
    at = BODY_LETTERS + 1
    bare = (F.length(compact) == at + 1) & ~F.endswith(compact, F.lit("-"))
    return F.when(bare, F.concat(F.substring(compact, 1, at), F.lit("-"), F.substring(compact, at + 1, 1))).otherwise(compact)


def folded_aliases(normal: Column) -> Column:
    """What a spelling may stand for once look-alike glyphs are folded; RN may be M."""
    fold = F.translate(normal, "01L58", "OIISB")
    return F.array_distinct(F.array(fold, F.replace(fold, F.lit("RN"), F.lit("M"))))


def checks(alias: Column) -> Column:
    """Whether an alias carries the check symbol of its body."""
    return (check_symbol(F.split_part(alias, F.lit("-"), F.lit(1))) == F.split_part(alias, F.lit("-"), F.lit(2))) & F.contains(alias, F.lit("-"))


def looks_like_alias(written: Column) -> Column:
    """Whether a spelling has the shape of an alias with a symbol that a check may be."""
    any_check = CHECK + CHECK.lower()
    t = F.trim(written)
    return t.rlike(rf"^[A-Za-z]{{{BODY_LETTERS}}}[{DIGITS}][-\s]?[{any_check}]$") | t.rlike(rf"^RN[A-Za-z]{{{BODY_LETTERS - 1}}}[{DIGITS}][-\s]?[{any_check}]$")


def is_mnemonic_shaped(written: Column) -> Column:
    """As :func:`looks_like_alias`, whatever the last symbol is."""
    t = F.trim(written)
    return t.rlike(rf"^[A-Za-z]{{{BODY_LETTERS}}}[{DIGITS}][-\s]?[A-Za-z0-9]$") | t.rlike(rf"^RN[A-Za-z]{{{BODY_LETTERS - 1}}}[{DIGITS}][-\s]?[A-Za-z0-9]$")
