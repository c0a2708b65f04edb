"""Column functions on bases, contexts and strands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which bases an ambiguity letter stands for; other letters match nothing.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# With ``parity`` few letters are known, and U stands for A or G.
IUPAC_PARITY = {k: IUPAC[k] for k in "ACGTNYWSH"} | {"U": "AG"}


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(seq))


def base_or_n(base: Column) -> Column:
    """A, C, G, T in upper case, anything else N."""
    up = F.upper(base)
    return F.when(up.isin("A", "C", "G", "T"), up).otherwise("N")


def most_frequent_base(a: Column, c: Column, g: Column, t: Column) -> Column:
    """The commonest of four counts; ties and no counts go to the first in order A, C, G, T."""
    top = F.greatest(*[F.coalesce(x, F.lit(0)) for x in (a, c, g, t)])
    pairs = zip("ACGT", (a, c, g, t), strict=True)
    return F.coalesce(*[F.when(F.coalesce(x, F.lit(0)) == top, b) for b, x in pairs])


def iupac_regex(pattern: str, parity: bool = False) -> str:
    table = IUPAC_PARITY if parity else IUPAC
    return "^" + "".join(f"[{table[p]}]" if p in table else "[^\\s\\S]" for p in pattern) + "$"


def iupac_match(context: Column, patterns: list[str], parity: bool = False) -> Column:
    """The first of the patterns, in their order, that the context fits; null if none."""
    return F.coalesce(*[F.when(context.rlike(iupac_regex(p, parity)), p) for p in patterns])


def collapse_h(context: Column) -> Column:
    """Three-letter context with A, C, T beside the central C written as H."""
    side = lambda i: F.when(F.substring(context, i, 1).isin("A", "C", "T"), "H").otherwise(F.substring(context, i, 1))
    return F.concat(side(1), F.substring(context, 2, 1), side(3))


def bisulfite_negative(neg: Column, second: Column) -> Column:
    """Strand that was converted: the read's, turned for second ends."""
    return neg != second


def base_calls(base: Column, ref_negative: Column, read_negative: Column) -> dict[str, Column]:
    """0/1 indicators of a read base at a cytosine, both on the forward strand.

    On the cytosine's strand: C (not converted), T (converted), A or G; on the other
    strand: opposite, and opposite A, which speaks for a C>T variant.
    """
    on = F.when(ref_negative, complement(base)).otherwise(base)
    same = ref_negative == read_negative
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    return {
        "c": flag(same & (on == "C")),
        "t": flag(same & (on == "T")),
        "ag": flag(same & on.isin("A", "G")),
        "opp_tot": flag(~same & on.isin("A", "C", "G", "T")),
        "opp_a": flag(~same & (complement(on) == "A")),
    }


def percent(level: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(100 * level + 0.5).cast("int")


def meth(c: Column, t: Column, c_nonconv: Column | None = None) -> Column:
    """C / (C + T); null without reads.  ``c_nonconv`` counts unconverted reads in."""
    top = c if c_nonconv is None else c + c_nonconv
    return F.try_divide(top.cast("double"), (top + t).cast("double"))


def strand_sign(neg: Column) -> Column:
    return F.when(neg, -1).otherwise(1)


def strand_char(neg: Column) -> Column:
    return F.when(neg, "-").otherwise("+")


def reduced(num: Column, den: Column) -> Column:
    """A fraction in lowest terms, as a struct, so that equal values are equal; 0/0 stays."""
    n, d = num.cast("long"), den.cast("long")
    start = F.struct(n.alias("a"), d.alias("b"))
    # Euclid's steps: two at least halve a number
    turn = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, turn, lambda s: F.greatest(s["a"], F.lit(1).cast("long")))
    return F.transform(F.array(gcd), lambda g: F.struct(F.expr("1L") * F.floor(n / g), F.floor(d / g)))[0].cast("struct<num:bigint,den:bigint>")
