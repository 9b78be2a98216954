"""Source divergence, toxicity and filter interactions against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from awkward import awkward, documents, nothing, prose  # noqa: F401
from pyspark.sql import functions as F

from keepwise.llm import filter_audit, source_audit, toxicity

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- source divergence


def divergence(rows, min_docs, top):
    """rows: (lang, source, text); the whole result by definition."""
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    n, docs, groups = Counter(), defaultdict(int), sorted({r[:2] for r in rows})
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(UPPER))
        for t in terms:
            n[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (k, t), d in docs.items() if k == lang and d >= min_docs)
        sources = [s for k, s in groups if k == lang]

        def p(count, total):
            return 1 + 1_000_000_000 * (count + 5) // (total + 5 * len(kept))

        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        per = {s: {t: p(n[lang, s, t], total[s]) for t in kept} for s in sources}
        whole = {t: p(sum(n[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(per[s][t] - per[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, per[s][t] - whole[t]) for t in kept if n[lang, s, t] and per[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:most])}
    return out


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(4)
    deep = "x" * 70
    words = ["The", "the", "straße", "STRASSE", "a" * 8, "a" * 9, "a" * 16, "a" * 17, deep, deep + "y", deep + "yz", "日本", "b1c", "İ", "rare"]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "de", None])
        text = " ".join(rng.choice(words[: 4 + i % 11]) for _ in range(rng.randrange(0, 30)))
        rows.append((lang, f"s{min(rng.randrange(20), 9)}", text))
    rows += [("en", "s1", " ".join(words) * 300), ("xx", "alone", "once"), ("yy", None, None), ("yy", "b", ""), ("yy", "b", "1 2 3"), ("en", "empty", "")]
    rows += [rows[0]] * 3
    return rows, spark.createDataFrame([(i, *r, "z", 1) for i, r in enumerate(rows)], "doc_id int, lang string, source string, text string, term string, n int").repartition(3)


@pytest.mark.parametrize("least, top", [(3, 2), (1, 50), (1000, 50)])
def test_divergence_of_sources(sources, least, top):
    rows, df = sources
    found = [tuple(r) for r in source_audit.audit(df, least, top).collect()]
    assert len(found) == len(set(found)) and set(found) == divergence(rows, least, top)


def test_small_slices_and_blocks_change_nothing(sources, monkeypatch):
    rows, df = sources
    expected = {tuple(r) for r in source_audit.term_counts(df.na.fill("").select("lang", "source", "text")).collect()}
    assert {tuple(r) for r in source_audit.term_counts(df.na.fill("").select("lang", "source", "text"), slice_bytes=90).collect()} == expected
    blocks = source_audit.source_distances.__defaults__
    monkeypatch.setattr(source_audit.source_distances, "__defaults__", (3, 2))
    assert blocks == (source_audit.TERMS, source_audit.SOURCES)
    assert {tuple(r) for r in source_audit.audit(df, 2, 5).collect()} == divergence(rows, 2, 5)


def test_divergence_of_awkward_rows(documents, nothing):  # noqa: F811
    rows = [tuple(r) for r in documents.select("lang", "source", "text").collect()]
    assert {tuple(r) for r in source_audit.audit(documents, 2).collect()} == divergence(rows, 2, 50)
    assert source_audit.op11(nothing).count() == 0
    assert source_audit.op11(documents).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_large_counts_stay_exact(spark):
    big = 9 * 10**12
    row = spark.range(1).select(source_audit.probability(F.lit(big), F.lit(10 * big), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (big + 5) // (10 * big + 35)


def test_pointers_sort_like_bytes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        words = [bytes(rng.choice([97, 98, 200], rng.integers(1, 90)).astype(np.uint8)) for _ in range(60)]
        words += [b"a" * int(k) for k in rng.integers(1, 100, 40)] + words[:20]
        buffer = np.frombuffer(b" ".join(words) + bytes(8), np.uint8)
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes + 1) - sizes - 1
        order, new = source_audit.sorted_pointers(buffer, starts, sizes)
        assert order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
        ordered = [words[i] for i in order]
        assert new.tolist() == [i == 0 or ordered[i] != ordered[i - 1] for i in range(len(words))]


# --- filter interactions


def interactions(rows, labels):
    """rows: (doc_id, text, source); the whole result by definition."""
    marks = defaultdict(set)
    for i, q, t in labels:
        marks[i] |= {m for m, v in (("good", q), ("toxic", t)) if v == 1}
    smallest: dict = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    fails = []
    for i, text, source in rows:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)}
        f |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > smallest[text]}
        fails.append((source or "", {k for k, v in f.items() if v}, marks[i] if i is not None else set()))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, _, _ in fails}:
            left = [x for x in fails if x[0] == part]
            every = list(left)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                redundant = sum(letter in x[1] for x in every) - len(gone)
                lost = [sum(m in x[2] for x in gone) for m in ("good", "toxic")]
                out[part, order, step] = (len(left), len(gone), redundant, sum(x[1] == {letter} for x in every), *lost)
                shapley[part, letter] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filters_in_every_order(spark, documents, nothing):  # noqa: F811
    extra = [(100 + k, t, "a") for k, t in enumerate([prose(50, 300), prose(50, 300), "A " * 250, "x # y", None, "", "same " * 400, "é" * 100 + "A" * 2, "é" * 97 + "A" * 3])]
    more = [*extra, (30, extra[0][1], None), (None, "x # y", "a"), (104, "x # y", "a"), (105, "x # y", "b")]
    df = documents.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string")).withColumn("removed", F.lit(1))
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 0, 0), (13, 1, None), (None, 1, 1), (100, None, 1), (101, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    found = [tuple(r) for r in filter_audit.op13(df, labels).collect()]
    assert len(found) == len(set(found)) and set(found) == interactions(rows, [tuple(r) for r in labels.collect()])
    assert filter_audit.op13(nothing, labels).count() == 0
    assert {r.shapley for r in filter_audit.op13(df, labels.limit(0)).collect()} == {r[-1] for r in found}


def test_three_filters_of_ones_own(spark):
    rows = spark.range(12).select(F.col("id").alias("row"), (F.col("id") % 2).cast("string").alias("part"), F.lit(1).alias("m"))
    fails = {"x": rows.filter("row < 6").select("row"), "y": rows.filter("row % 3 = 0").select("row"), "z": rows.limit(0).select("row")}
    found = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(rows, fails, ["m"]).collect()}
    assert len(found) == 2 * 6 * 3
    r = found["0", "xyz", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.m, r.shapley) == (2, 1, 1, 1, 1, 3 * 2 + 3 * 1)


# --- toxicity


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(2)
    words, stems = ["abcab", "abcabc", "bbbbbbbbbbb", "cabcabcaba", "a"], ["ccc", "acbacb", "bacbacbacba"]
    automaton = toxicity.Automaton(words, stems)
    automaton.STATES = 300
    for _ in range(4000):
        text = rng.choice([*words, *stems]) if rng.random() < 0.6 else ""
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(text) + 1)
            text = text[:k] + rng.choice(["", "a", "b", "c", "é"]) + text[k + rng.randrange(2) :]
        text += "".join(rng.choice("abc") for _ in range(rng.randrange(5)))
        fits = [distance(text, w) for w in words if distance(text, w) <= toxicity.edits(len(w))]
        starts = [min(distance(text[:n], s) for n in range(len(text) + 1)) for s in stems]
        fits += [d for d, s in zip(starts, stems, strict=True) if d <= toxicity.edits(len(s))]
        assert automaton.errors(text) == min(fits, default=None), text


def test_quotation_is_told_from_abuse():
    matcher = toxicity.Matcher(toxicity.Lexicon(["nasty", "horrible"], [], ["nasta"]))

    def look(text):
        features, n, q = toxicity.document_features(text, matcher)
        return features[1], n, q

    plain, n, q = look("you are nasty and h0rrrrible")
    assert (n, q) == (2, 0)
    told, n, q = look('she wrote: "you are nasty and horrible" and left')
    assert (n, q) == (2, 2) and told == 0
    assert look("> nasty thing")[1:] == (1, 1) and look("« nasty » nasty")[1:] == (2, 1) and look("„nasty“ ok")[2] == 1
    assert look('a "quote" then nasty "again"')[1:] == (1, 0)
    assert look("he said nasty")[0] < look("he is nasty")[0] < look("you nasty")[0]
    assert look("nasti nastys nasta horible horble n a s t y")[1:] == (1, 0)  # one error from six letters on
    assert look(None) == look("") == (0.0, 0, 0)
    long = "word " * 300_000 + "nasty " + "word " * 300_000
    assert look(long)[1] == 1 and look("nasty" * 500_000)[1] == 0


def test_toxicity_learns_and_scores_everything(spark, documents, nothing):  # noqa: F811
    rng = random.Random(7)
    bad = ["wretched", "vermin", "despicable"]
    rows, labels = [], []
    for i in range(700):
        words = prose(i, 60).split()
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            word = rng.choice([*bad, "grob" + rng.choice(["a", "en", "ian", "heit", "sack"])])
            words.insert(rng.randrange(60), word)
        rows.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, int(toxic)))
    spelled = ["wretchd", "vemrin", "d3spicable", "DESPICABLE!", "verrrrmin", "grobmensch"]
    held = [(5000 + k, prose(900 + k, 40) + f" {w} {w} ") for k, w in enumerate(spelled)]
    held += [(6000 + k, prose(950 + k, 40)) for k in range(6)] + [(7000, f'{prose(3, 40)}\nHe wrote: "vermin, wretched" {prose(4, 40)}')]
    df = spark.createDataFrame(rows + held, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (3, 7), (1001, 0)], "doc_id long, toxic int")
    found = toxicity.op12(df, marks).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    of = {r.doc_id: r for r in found}
    out = [of[i].predicted == t for i, t in labels if of[i].held_out]
    assert len(out) > 100 and all(out)
    caught = [of[5000 + k].predicted for k in range(len(spelled))]
    assert caught == [1, 0, 1, 1, 1, 1]  # two letters swapped are two errors, too many for six letters
    assert not any(of[6000 + k].predicted for k in range(6)) and of[7000].predicted == 0 and of[7000].n_quoted == 2
    assert of[4].score == of[5].score and toxicity.op12(nothing, marks).count() == 0
    assert {r.score for r in toxicity.op12(documents, marks.limit(0)).collect()} == {0.5}
    one = toxicity.op12(documents, marks.filter("toxic = 1")).collect()
    assert len({r.score for r in one}) == 1


def test_given_tables_held_out(spark):
    sf = "/root/testdata/sf0.01"
    df, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.op12(df, marks).filter("held_out").join(marks, "doc_id").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in found) >= 0.95 * len(found)
