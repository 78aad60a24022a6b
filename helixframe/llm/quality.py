"""Quality rules by distribution divergence.

Every document yields a histogram of character classes and one of common words of
its language.  The references are fixed histograms of running prose in each language
(``CHAR_SHARES``, ``COMMON_WORDS``), so that no corpus can shift them.  A document's verdict
compares its histograms to its language's reference by Jensen-Shannon distance (base 2,
from 0 to 1); a histogram with too few counts is not judged.  Two limits hold: a fixed one,
and one from the distances themselves - by language and length class, the median over all
documents that pass the base rules and a multiple of the median deviation from it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import map_batches, materialize, texts_of, words_of

#: Classes: lower and upper case letters by vowel or not, letters past ASCII, digits, sentence marks, other marks of ASCII, the rest.
CHAR_CLASSES = ("vowel", "consonant", "upper", "letter", "digit", "sentence", "mark", "other")

# Percent of the characters of running prose, white space left out, in the order of the classes.
CHAR_SHARES = {
    "en": (35.5, 57.0, 3.0, 0.1, 0.8, 3.4, 0.1, 0.1),
    "de": (34.0, 53.5, 6.0, 2.0, 0.8, 3.5, 0.1, 0.1),
    "fr": (40.0, 48.5, 2.8, 4.0, 0.8, 3.7, 0.1, 0.1),
    "es": (42.5, 47.5, 2.8, 2.8, 0.8, 3.4, 0.1, 0.1),
}
# Frequent function words of each language, in words per 10,000 of running prose.
_WORD_COUNTS = {
    "en": "the 650 of 330 and 280 to 260 a 225 in 205 that 110 is 100 was 95 for 92 it 90 he 90 as 70 with 70 on 68 be 60 you 60 at 52 by 52 this 50 not 48 are 45 but 44 from 43 or 42 have 40 an 35 they 35 which 33",
    "de": "die 300 der 310 und 270 in 170 den 120 das 105 von 100 zu 100 ist 90 mit 80 sich 72 des 72 auf 72 für 65 im 65 nicht 65 dem 62 ein 62 eine 55 sie 55 es 52 er 52 als 50 auch 48 an 45 werden 36 hat 36 aus 35 dass 32 nach 30",
    "fr": "de 480 la 275 le 225 et 210 les 190 des 150 en 130 un 115 du 110 que 105 une 100 est 100 a 90 qui 85 dans 85 pour 80 il 75 par 65 au 60 ne 60 pas 55 se 55 sur 50 plus 50 ce 50 avec 35 son 35 sont 30 aux 30",
    "es": "de 600 la 390 que 310 el 290 en 260 y 260 a 200 los 170 se 130 del 120 las 110 un 110 por 100 con 95 no 95 una 85 su 75 para 70 es 65 al 60 lo 55 como 50 más 42 o 40 le 35 ha 35 me 35 pero 32 sus 32 si 32",
}
COMMON_WORDS = {k: {w: int(n) for w, n in zip(v.split()[::2], v.split()[1::2], strict=True)} for k, v in _WORD_COUNTS.items()}
LANGUAGES = tuple(COMMON_WORDS)

#: Guards: histograms of fewer characters or words than these are not judged.
MIN_CHARS, MIN_WORDS = 200, 50
#: A limit is the median of its class (language, and words by powers of two) plus SPREADS median deviations, each
#: of LEAST_SPREAD at least; a class of fewer than MIN_CLASS documents has the limits below only.
SPREADS, LEAST_SPREAD, MIN_CLASS = 6.0, 0.005, 30
#: Largest Jensen-Shannon distances that a kept document may have.  A word histogram
#: of n words may be further off by WORD_NOISE / sqrt(n), the distance that chance makes.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, WORD_NOISE = 0.28, 0.25, 1.25

SYMBOLS = "#*$%&|<>"
MIN_BASE_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


def _class_table() -> np.ndarray:
    table = np.full(0x3000, CHAR_CLASSES.index("other"), dtype=np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if code < 128:
            if c in "aeiou":
                name = "vowel"
            elif c.islower():
                name = "consonant"
            elif c.isupper():
                name = "upper"
            elif c.isdigit():
                name = "digit"
            elif c in ".,;:!?'\"()-":
                name = "sentence"
            elif code > 32 and code < 127:
                name = "mark"
            else:
                name = "other"
        else:
            name = "upper" if c.isupper() else "letter" if c.isalpha() else "digit" if c.isdigit() else "other"
        table[code] = CHAR_CLASSES.index(name)
    return table


def repeated_words(words: list[bytes]) -> int:
    """Words covered by an 8-word window that occurs twice or more in the list."""
    if len(words) <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    # Ranks of runs of 1, 2, 4, 8 words: each is the rank of a pair of shorter ones, so equality is exact.
    for step in (1, 2, 4):
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1] if step < 4 else pair
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(ids), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


_SPACES = " \t\n\x0b\x0c\r"
_FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<array<long>>"


def _features():
    table = _class_table()
    lists = [{w.encode(): i for i, w in enumerate(COMMON_WORDS[k])} for k in LANGUAGES]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for text in texts_of(batch.column("text")):
            words = words_of(text)
            lines = [x for x in text.split("\n") if x.strip(_SPACES)]
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            codes = codes[codes > 32]
            chars = np.bincount(table[np.minimum(codes, len(table) - 1)], minlength=len(CHAR_CLASSES))
            counts = Counter(w.strip(b".,;:!?").lower() for w in words)
            common = []
            for known in lists:
                row = [0] * (len(known) + 1)
                for w, i in known.items():
                    row[i] = counts.get(w, 0)
                row[-1] = len(words) - sum(row)
                common.append(row)
            out.append(
                (
                    len(words),
                    len(text) - sum(text.count(c) for c in _SPACES),
                    sum(text.count(c) for c in SYMBOLS),
                    len(lines) - len(set(lines)),
                    repeated_words(words),
                    chars.tolist(),
                    common,
                )
            )
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common"]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), *(pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "lang", *names]
        )

    return step


def languages() -> dict[str, tuple[list[float], list[float]]]:
    """The references: for each language the shares of character classes, and of its common words and all others."""
    out = {}
    for k in LANGUAGES:
        chars, words = CHAR_SHARES[k], COMMON_WORDS[k].values()
        out[k] = ([x / sum(chars) for x in chars], [*(x / 10_000 for x in words), 1 - sum(words) / 10_000])
    return out


def _share(counts):
    """A histogram of counts as shares; all zero where it is empty."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p, q):
    """Jensen-Shannon distance, base 2, of two arrays of shares of equal length."""

    def term(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def _limits(passed: DataFrame) -> DataFrame:
    """``(judged, length, char_limit, word_limit)``: one row a language and power of two of words; a limit is null in small classes."""
    by, names = ["judged", "length"], ("char", "word")
    half = lambda c: F.percentile_approx(c, 0.5, 1000)
    medians = passed.groupBy(*by).agg(*(half(f"{k}_distance").alias(f"{k}_median") for k in names))
    off = passed.join(F.broadcast(medians), by)
    spreads = off.groupBy(*by).agg(
        *(half(F.abs(F.col(f"{k}_distance") - F.col(f"{k}_median"))).alias(f"{k}_spread") for k in names),
        *(F.first(f"{k}_median").alias(f"{k}_median") for k in names),
        *(F.count(f"{k}_distance").alias(f"{k}_n") for k in names),
    )
    limit = lambda k: F.when(F.col(f"{k}_n") >= MIN_CLASS, F.col(f"{k}_median") + SPREADS * F.greatest(F.col(f"{k}_spread"), F.lit(LEAST_SPREAD)))
    return spreads.select(*by, *(limit(k).alias(f"{k}_limit") for k in names))


def quality_rules(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """One row per document with its base counts, distances and ``kept``.

    Reads ``doc_id``, ``text`` and ``lang``; other columns are ignored, whatever their
    names.  A null text counts as empty.  A null or unknown ``lang`` is judged against
    the nearest reference.  Repeated rows, and rows that share an id, are judged one by one,
    each by its own text.  The limits gather one row a language and power of two of words.
    ``max_char_distance`` and ``max_word_distance`` hold besides the limits of the class.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    feats = materialize(map_batches(rows, _features, _FEATURES), "quality")
    base_failed = (F.col("n_words") < MIN_BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    feats = feats.withColumn("base_failed", base_failed)

    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x)
    out = feats.withColumn("n_chars", n_chars).withColumn("char_share", _share(F.col("chars")))
    refs = languages()

    def array(values):
        return F.array(*(F.lit(float(v)) for v in values))

    chars = {k: js_distance(F.col("char_share"), array(r[0])) for k, r in refs.items()}
    common = {k: js_distance(_share(F.col("common")[LANGUAGES.index(k)]), array(r[1])) for k, r in refs.items()}

    def pick(found):
        case = F
        for k, c in found.items():
            case = case.when(F.col("lang") == k, c)
        return case.otherwise(F.least(*found.values()))

    out = out.withColumn("char_distance", F.when(F.col("n_chars") >= min_chars, pick(chars)))
    out = out.withColumn("word_distance", F.when(F.col("n_words") >= min_words, pick(common)))
    # Rows of one class: those of no known language are together.
    out = out.withColumn("judged", F.when(F.col("lang").isin(*refs), F.col("lang")).otherwise(F.lit(""))).withColumn("length", F.floor(F.log2(F.greatest("n_words", F.lit(1)))))
    limits = _limits(out.where(~F.col("base_failed")))
    out = out.join(F.broadcast(limits), ["judged", "length"], "left")
    most_words = max_word_distance + WORD_NOISE / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > F.least(F.lit(max_char_distance), "char_limit")) | (F.coalesce("word_distance", F.lit(0.0)) > F.least(most_words, F.col("word_limit")))
    out = out.withColumn("kept", ~F.col("base_failed") & ~far)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
