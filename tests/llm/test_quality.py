import random

import pytest

from helixframe.llm import quality
from tests.llm.texts import SCHEMA, corpus, documents, split


def brute_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    gone = [False] * len(words)
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            gone[i : i + 8] = [True] * 8
    return sum(gone)


@pytest.mark.parametrize("text", ["", "a b c", "a b c d e f g h", "a " * 9, "a b c d e f g h i a b c d e f g h z", "x y " * 30, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 9"])
def test_repeated_words(text):
    assert quality.repeated_words(split(text)) == brute_repeats(split(text))


def test_base_counts_and_odd_rows(spark):
    rows = corpus() + [(2000, "A # b* $ a line\nA # b* $ a line\n\n  \na line", "en", "a", 1)]
    found = quality.quality_rules(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    wanted = []
    for doc_id, text, *_ in rows:
        t, words = text or "", split(text)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        repeats = brute_repeats(words) if len(words) < 1000 else quality.repeated_words(words)
        wanted.append((doc_id, len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats, len(words) < 20 or 100 * repeats > 30 * len(words)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r[:7]) for r in found), key=key) == sorted(wanted, key=key)
    assert all(not r["kept"] for r in found if r["base_failed"])


#: Running prose; sentences are drawn from it, so that documents differ.
PROSE = """The old house stood at the end of the lane, and nobody in the village could say who had built it.
In the summer the children went down to the river with their books and a basket of bread and cheese.
He had not been to the market for a week, but the price of corn was the same as it had been in the spring.
They walked for an hour on the road by the hill, which was wet from the rain that fell in the night.
She told them that the letter was from her brother, who worked on a ship and was not often at home.
It is hard to say what you would have done with this, or if they are as kind as he thinks they are.
The people of the town came to the square in the evening to hear the music and to talk of the day.
A small boat lay by the bridge, and the man in it was mending a net with great care.""".split("\n")


def prose(rng, lines=12):
    words = [line.split() for line in PROSE]
    piece = lambda: (w := rng.choice(words))[(k := rng.randrange(len(w) - 5)) : k + rng.randint(3, 5)]
    return "\n".join(" ".join(x for _ in range(3) for x in piece()) for _ in range(lines))


def test_divergence_rejects_symbol_noise_and_keeps_prose(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng), "en", "a", 1) for i in range(12)]
    rows.append((99, " ".join(f"q{j}%%%### &&&{j}$$$" for j in range(60)), "en", "a", 1))
    found = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i]["kept"] for i in range(12))
    assert not found[99]["base_failed"] and not found[99]["kept"]


def test_short_documents_are_not_judged_by_distance(spark):
    rows = [(1, " ".join(f"#{i}" for i in range(25)), "en", "a", 1)]
    found = quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).first()
    assert found["char_distance"] is None and found["kept"]


def test_empty_table(spark):
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_limits_follow_the_class(spark):
    """Navigation lines lie under the loose constants, but far from the prose of their language and length."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 10), "en", "a", 1) for i in range(60)]
    words = prose(rng, 6).split()
    menu = " | ".join(" ".join(words[k : k + 3]) for k in range(0, len(words), 3))
    found = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame([*rows, (99, menu, "en", "a", 1)], SCHEMA)).collect()}
    assert all(found[i]["kept"] for i in range(60))
    assert found[99]["char_distance"] < quality.MAX_CHAR_DISTANCE
    assert found[99]["word_distance"] < quality.MAX_WORD_DISTANCE + quality.WORD_NOISE / found[99]["n_words"] ** 0.5
    assert not found[99]["base_failed"] and not found[99]["kept"]


def _prose(rng, lang, n, junk=False):
    known = list(quality.COMMON_WORDS[lang])
    out = []
    for _ in range(n):
        w = rng.choice(known) if rng.random() < 0.4 else "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(3, 9)))
        out.append(f"{w} |" if junk else w)
    return " ".join(out)


def test_the_verdict_against_brute_force(spark):
    """Distances to the fixed references with numpy, limits by class, and the guards; some ids are shared."""
    import numpy as np

    rng = random.Random(3)
    rows = [(i, _prose(rng, lang, rng.choice([30, 70, 90, 100, 120]), junk=i % 19 == 0), lang, "a", 1) for i, lang in enumerate(["en"] * 120 + ["de"] * 60 + ["fr"] * 20)]
    rows += [(5, "#i@@i " * 3 + " ".join(f"#i@@{i}" for i in range(100)), "en", "a", 1), (5, None, "en", "a", 1), (900, _prose(rng, "es", 80), None, "a", 1)]
    found = quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    table, refs = quality._class_table(), quality.languages()

    def distance(p, q):
        p, q = np.array(p, dtype=float), np.array(q, dtype=float)
        p = p / p.sum()
        m = (p + q) / 2
        part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum()
        return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))

    judged = []
    for doc_id, text, lang, *_ in rows:
        words = split(text)
        codes = [ord(c) for c in text or "" if ord(c) > 32]
        chars = np.bincount(table[codes], minlength=8) if codes else np.zeros(8)
        repeats = brute_repeats(words)
        failed = len(words) < 20 or 100 * repeats > 30 * len(words)
        by = {}
        for k, (ref_chars, ref_words) in refs.items():
            plain = [w.decode().strip(".,;:!?").lower() for w in words]
            counts = [plain.count(w) for w in quality.COMMON_WORDS[k]]
            by[k] = (distance(chars, ref_chars) if len(codes) >= 200 else None, distance([*counts, len(words) - sum(counts)], ref_words) if len(words) >= 50 else None)
        pick = [by[lang][x] if lang in by else min((v[x] for v in by.values() if v[x] is not None), default=None) for x in (0, 1)]
        judged.append((doc_id, failed, lang if lang in by else "", int(np.log2(max(1, len(words)))), len(words), *pick))
    half = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    wanted = []
    for doc_id, failed, lang, length, n, *own in judged:
        kept = not failed
        for x, fixed in ((0, quality.MAX_CHAR_DISTANCE), (1, quality.MAX_WORD_DISTANCE + quality.WORD_NOISE / max(1, n) ** 0.5)):
            peers = [j[5 + x] for j in judged if j[2:4] == (lang, length) and not j[1] and j[5 + x] is not None]
            if len(peers) >= quality.MIN_CLASS:
                middle = half(peers)
                fixed = min(fixed, middle + quality.SPREADS * max(quality.LEAST_SPREAD, half([abs(p - middle) for p in peers])))
            kept = kept and not (own[x] is not None and own[x] > fixed)
        wanted.append((doc_id, n, failed, kept, *(None if v is None else round(v, 5) for v in own)))
    got = [(r["doc_id"], r["n_words"], r["base_failed"], r["kept"], *(None if r[c] is None else round(r[c], 5) for c in ("char_distance", "word_distance"))) for r in found]
    for a, b in zip(sorted(got, key=str), sorted(wanted, key=str), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=2e-5)
    assert {kept for _, _, _, kept, *_ in got} == {True, False}


def test_a_corpus_of_junk_does_not_move_the_references(spark):
    junk = [(i, " ".join(f"#i@@i{i}-{j}" for j in range(100)), "en", "a", 1) for i in range(50)]
    found = quality.quality_rules(spark.createDataFrame(junk, SCHEMA)).collect()
    assert not any(r["kept"] or r["base_failed"] for r in found)
    assert not quality.quality_rules(spark.createDataFrame(junk[:1], SCHEMA)).first()["kept"]
