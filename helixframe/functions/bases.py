"""Column functions over base strings (A, C, G, T) and their labels.

All are built-in expressions, so they stay inside generated code and can be pushed
around by the optimiser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: base order; a base's code is its place.
BASES = "ACGT"


def normalise(text: Column) -> Column:
    """Upper case without surrounding white space."""
    return F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))


def is_valid(sequence: Column, length: int | None = None) -> Column:
    """Whether a string is non-empty, holds bases only and has the given length."""
    ok = sequence.rlike("^[ACGT]+$")
    return F.coalesce(ok & (F.length(sequence) == length) if length else ok, F.lit(False))


def gc_count(sequence: Column) -> Column:
    return (F.length(sequence) - F.length(F.translate(sequence, "GC", ""))).cast("long")


def gc_fraction(sequence: Column) -> Column:
    return gc_count(sequence) / F.length(sequence)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGT", "TGCA"))


def longest_run(sequence: Column) -> Column:
    """Length of the longest stretch of one base; null for an empty string."""
    runs = F.regexp_extract_all(sequence, F.lit("(A+|C+|G+|T+)"), F.lit(1))
    return F.array_max(F.transform(runs, F.length)).cast("long")


def slice_of(sequence: Column, start: Column, stop: Column) -> Column:
    """Characters ``[start, stop)`` counted from 0."""
    return F.substr(sequence, start + 1, stop - start)


def strand_window(genome: Column, position: Column, strand: Column, width: int) -> Column:
    """The ``width`` bases upstream of a position: before it on '+', reverse complement of those from it on '-'."""
    plus = slice_of(genome, position - width, position)
    minus = reverse_complement(slice_of(genome, position, position + width))
    return F.when(strand == "+", plus).otherwise(minus)


def window_status(fragment: Column, genome_window: Column, start: int, stop: int) -> Column:
    """Status of the slice of a fragment that must equal a genome window: verified, mismatch or out of bounds."""
    return (
        F.when(genome_window.isNull() | (F.length(fragment) < stop) | (F.length(genome_window) < stop - start), "window_out_of_bounds")
        .when(slice_of(fragment, F.lit(start), F.lit(stop)) == genome_window, "verified")
        .otherwise("window_mismatch")
    )


def module_window(modules: list[Column], shift: int, width: int) -> Column:
    """The ``width`` characters that end ``shift`` after the start of the last module; null where they leave the string."""
    whole = F.concat(*modules)
    end = F.length(F.concat(*modules[:-1])) + shift
    return F.when((end >= width) & (end <= F.length(whole)), slice_of(whole, end - width, end))


def codes(sequence: Column) -> Column:
    """Base codes 0 to 3 by position."""
    return F.transform(F.sequence(F.lit(1), F.length(sequence)), lambda i: F.instr(F.lit(BASES), F.substr(sequence, i, F.lit(1))) - 1)


def decode(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda c: F.substr(F.lit(BASES), c + 1, F.lit(1))), "")


def one_hot(sequence: Column) -> Column:
    """A row of four noughts and ones for each position."""
    return F.transform(codes(sequence), lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: (b == c).cast("int")))


def kmers(sequence: Column, k: int) -> Column:
    """All overlapping substrings of length k, in order; none for shorter strings."""
    last = F.length(sequence) - k + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(sequence, i, F.lit(k))))


def kmer_code(kmer: Column, k: int) -> Column:
    """Base-4 number of a k-mer, first base most significant."""
    out = F.lit(0)
    for i in range(k):
        out = out * 4 + F.instr(F.lit(BASES), F.substring(kmer, i + 1, 1)) - 1
    return out


def _code_at(sequence: Column, place: Column) -> Column:
    return F.instr(F.lit(BASES), F.substr(sequence, place, F.lit(1))) - 1


def spaced_pair_codes(sequence: Column, gaps: tuple[int, ...], length: int) -> Column:
    """Column numbers of the base pairs at the given distances: a block of 16 a position, gap after gap."""

    def block(gap: int, offset: int) -> Column:
        places = F.sequence(F.lit(0), F.lit(length - gap - 1))
        return F.transform(places, lambda p: F.lit(offset) + p * 16 + _code_at(sequence, p + 1) * 4 + _code_at(sequence, p + 1 + gap))

    starts = [sum((length - g) * 16 for g in gaps[:i]) for i in range(len(gaps))]
    return F.concat(*(block(g, o) for g, o in zip(gaps, starts, strict=True)))


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings of one length differ; null where lengths differ."""
    same = F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(None)).when(F.length(a) == 0, 0).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + x))


#: Letters of strings that can be packed: the bases and the codes for sets of them.
PACKED = "ACGTNRYSWKMBDHV-"
#: Letters in a packed number: four bits each, the sign bit left out.
PER_WORD = 15
_LOW_BITS = int("1" * 16, 16)


def packed(text: Column, length: int) -> list[Column]:
    """A string of ``length`` as numbers of ``PER_WORD`` letters; other letters raise, so that no two strings look alike."""
    letters = F.when(F.translate(text, PACKED, "") == "", F.translate(text, PACKED, "0123456789abcdef")).otherwise(F.raise_error(F.concat(F.lit("no string of bases: "), text)).cast("string"))
    return [F.conv(F.substring(letters, k + 1, min(PER_WORD, length - k)), 16, 10).cast("long") for k in range(0, length, PER_WORD)]


def packed_differences(a: list[Column], b: list[Column]) -> list[Column]:
    """For two packed strings the numbers that have one bit set for each letter that differs (see `letter_bits`)."""
    out = []
    for x, y in zip(a, b, strict=True):
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        out.append(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(_LOW_BITS)))
    return out


def letter_bits(positions: list[int], length: int) -> list[int]:
    """Masks of the bits that stand for these positions (from 0) in `packed_differences`."""
    out = [0] * -(-length // PER_WORD)
    for p in positions:
        word, place = divmod(p, PER_WORD)
        out[word] |= 1 << 4 * (min(PER_WORD, length - word * PER_WORD) - 1 - place)
    return out


def packed_hamming(a: list[Column], b: list[Column]) -> Column:
    """Positions at which two packed strings differ; no array and no loop, so it stays in generated code."""
    total = F.lit(0)
    for d in packed_differences(a, b):
        total = total + F.bit_count(d)
    return total.cast("long")


# --------------------------------------------------------------------------- labels and scores


def group_right_open(value: Column, low, high) -> Column:
    """weak below ``low``, medium from it to below ``high``, strong from there."""
    return F.when(value < low, "weak").when(value < high, "medium").otherwise("strong")


def group_right_closed(value: Column, low, high) -> Column:
    """weak up to and with ``low``, medium up to and with ``high``, strong above."""
    return F.when(value <= low, "weak").when(value <= high, "medium").otherwise("strong")


def distance_bucket(distance: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    """Name of the closed range that holds a distance; null outside all."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high in ranges:
        out = out.when(distance.between(low, high), f"{low}-{high}")
    return out


def blend(scores: list[Column], weights: list[float]) -> Column:
    """Weighted sum of scores; the weights must sum to 1."""
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError(f"weights must sum to 1, not {sum(weights)}")
    out = F.lit(0.0)
    for s, w in zip(scores, weights, strict=True):
        out = out + s * float(w)
    return out


def affine(score: Column, intercept, slope) -> Column:
    return intercept + slope * score


def candidate_id(generator: Column, group: Column, seed: Column, index: Column, prefix: str = "G25") -> Column:
    return F.concat(F.lit(f"{prefix}_"), generator, F.lit("_"), group, F.lit("_R"), seed.cast("string"), F.lit("_I"), F.lpad(index.cast("string"), 3, "0"))


def git_blob_sha1(content: Column) -> Column:
    """SHA-1 as git names a blob: over ``blob <size>`` and a zero byte before the content."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))
