"""Operators on documents against brute force, on rows with every awkward case."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from awkward import awkward, documents, nothing  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepwise.llm import bpe, chunks, license_scan, mixing, near_dup, quality, substring_dedup

UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- near-duplicates


def shingles(text, size):
    w = words((text or "").translate(UPPER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def linked(pairs, size, percent):
    """Component of every (id, text): the smallest id reachable over similar texts."""
    sets = [shingles(t, size) for _, t in pairs]
    group = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and pairs[i][0] is not None and pairs[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    names = {g: min((p[0] for p, h in zip(pairs, group, strict=True) if h == g and p[0] is not None), default=None) for g in group}
    return Counter((p[0], len(s), names[g]) for p, s, g in zip(pairs, sets, group, strict=True))


def test_near_duplicates(documents, nothing):
    found = near_dup.op1(documents)
    assert rows(found, "doc_id", "n_shingles", "component_id") == linked(awkward(), 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())
    assert near_dup.op1(nothing).count() == 0


def test_near_duplicates_through_a_chain(spark):
    """Each text resembles the next one only; a star around one of them would lose the ends."""
    texts = [[f"w{i + 12 * k}" for i in range(200)] for k in range(12)]
    pairs = [(100 - k, " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(near_dup.op1(df), "doc_id", "n_shingles", "component_id") == linked(pairs, 3, 85)


def test_one_of_each_group_stays(documents):
    kept = near_dup.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    ids = Counter(r.doc_id for r in kept.collect())
    # 1, 2, 3 follow 0; of the equal rows 13 one stays, of the different rows 12 both; null ids stay.
    assert ids == Counter([0, 4, 5, 6, 7, 9, 10, 11, 12, 12, 13, None, None, 14, 15])


def test_routed_texts_grow_with_the_rows_that_share_an_id(spark, monkeypatch):
    counts = []

    def counting(*args):
        out = routed(*args)
        counts[-1] += out.count()
        return out

    routed = near_dup._routed
    monkeypatch.setattr(near_dup, "_routed", counting)
    base = [f"w{i}" for i in range(300)]
    for n in (50, 200):
        counts.append(0)
        # Near copies and equal rows, all under one id.
        texts = [" ".join([*base[: i % n], f"x{i % n}", *base[i % n + 1 :]]) for i in range(2 * n)]
        found = near_dup.op1(spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")).collect()
        assert len(found) == 2 * n and {r.component_id for r in found} == {7}
    assert counts[1] <= 5 * counts[0]


def test_texts_are_found_where_they_were_written(spark):
    """Rows are joined by chunk inside the buckets: no exchange of texts, whichever side is larger."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(90).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(3)
        table = chunks.chunked(docs)
        asked = table.filter("doc_id % 3 = 0").groupBy("row").agg(F.max("doc_id").alias("n"))
        for found in (chunks.of_rows(table, asked), chunks.of_rows(table, asked.select("row"), "left_semi")):
            plan = found._jdf.queryExecution().executedPlan().toString()
            scan = next(i for i, line in enumerate(plan.splitlines()) if "text#" in line and "FileScan" in line)
            assert "Bucketed: true" in plan and not any("Exchange" in line for line in plan.splitlines()[:scan])
            assert sorted((r.doc_id, r.text) for r in found.collect()) == [(i, f"text {i}") for i in range(0, 90, 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_copies_of_members_grow_slower_than_their_square(spark):
    sizes = [near_dup.SKETCH_BLOCK * n for n in (1, 4, 100)]
    df = spark.createDataFrame([(k,) for k in sizes], "k long")
    assert [r.n for r in df.select(near_dup.sketch_blocks(F.col("k")).alias("n")).collect()] == [1, 2, 10]


def test_links_between_blocks_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SKETCH_BLOCK", 1)
    texts = [[f"w{i + 12 * k}" for i in range(200)] for k in range(12)]
    pairs = [(100 - k, " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(near_dup.op1(df), "doc_id", "n_shingles", "component_id") == linked(pairs, 3, 85)


def test_tensored_keys_meet_as_often_as_they_should():
    m = near_dup.tables_per_side(0.85)
    assert (1 - (1 - 0.85**near_dup.HALF) ** m) ** 2 >= 1 - near_dup.MISS


# --- repeated passages


def without_repeats(pairs, window=20):
    """(id, words, removed, digest) by looking at every window in order."""
    seen, out = set(), Counter()
    for i, text in sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, len(p[1] or ""))):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if tuple(w[k : k + window]) in seen:
                gone[k : k + window] = [True] * window
            seen.add(tuple(w[k : k + window]))
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substring_dedup(documents, nothing):
    found = substring_dedup.op6(documents)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == without_repeats(awkward())
    done = substring_dedup.deduplicate(documents)
    assert done.columns == [*documents.columns, "n_words", "n_removed"]
    assert substring_dedup.op6(nothing).count() == 0


def test_passages_that_overlap_themselves(spark):
    texts = ["a " * 100, "b a " * 60, " ".join(str(i % 7) for i in range(90)), "a " * 19, "a " * 20]
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(substring_dedup.op6(df), "doc_id", "n_words", "n_removed", "kept_sha256") == without_repeats(pairs)


# --- tokens


def test_bpe_as_the_library(documents, nothing):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(bpe.VOCABULARY)))
    expected = Counter()
    for i, text in awkward():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert rows(bpe.op9(documents), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    assert bpe.encode(documents).columns == ["doc_id", "lang", "source", "n_chars", "row", "size", "ids"]
    assert bpe.op9(nothing).count() == 0


def test_words_join_to_the_text():
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(bpe.VOCABULARY)))
    split = bpe.splitter(["<|endoftext|>"])
    pieces = [" ", "  ", "\n", "\t", "a", "B", "9", "'s", ".", "é", "漢", "<|endoftext|>", "\x1c", "\x85", " ", "​"]
    rng = np.random.default_rng(0)
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 9)))
        parts = split(text)
        assert "".join(parts) == text
        one_by_one = [i for e in tokenizer.encode_batch(parts, add_special_tokens=False) for i in e.ids]
        assert one_by_one == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_broken_bytes_decode_to_replacement_characters(spark):
    ids = spark.createDataFrame([([447],), (None,), ([],), ([50256],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(ids).collect()] == ["�", "", "", "<|endoftext|>"]


# --- licenses


def test_license_scan(documents, nothing):
    found = {(r.doc_id, r.n_words): r for r in license_scan.scan(documents).collect()}
    for i, text in awkward():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        places = [k for k in range(len(w)) for p, _ in license_scan.BASE if w[k : k + len(p.split())] == p.split()]
        r = found[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(places, default=None), max(places, default=None))
    assert found[15, 17].base_labels == "apache-2,cc-by-nc,mit"
    assert license_scan.scan(nothing).count() == 0


def test_texts_are_cut_into_words_once_for_the_votes(documents):
    keyed = documents.select("doc_id", "text")
    plan = license_scan.votes(keyed, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_a_notice_with_changes_is_found(spark):
    notice = license_scan.NOTICES[0][0].split()
    changed = [*notice[:9], "dear", *notice[9:]]
    half = notice[: len(notice) // 2]
    texts = [" ".join(["x", *t, "y"]) for t in (notice, changed, half)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [found[i].labels for i in range(3)] == ["mit-text", "mit-text", ""]
    assert found[0].score == 1.0 and 0.8 <= found[1].score < 1 and found[2].score < 0.6


def test_notices_with_changed_words_are_found(spark):
    """Any one word changed, and every third as far as a fifth of the words; one more change is too many."""
    texts, expected = [], []
    for text, label in license_scan.NOTICES:
        notice = text.split()
        most = int(0.2 * len(notice))
        changes = [{p} for p in range(len(notice))] + [{2 + 3 * c for c in range(n)} for n in (most, most + 1)]
        for gone in changes:
            texts.append(" ".join(["x", *("other" if p in gone else w for p, w in enumerate(notice)), "y"]))
            expected.append(label if len(gone) <= most else "")
    rows = [*enumerate(texts), (None, texts[2]), (None, texts[2]), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan(df).collect()
    assert len(found) == len(rows)
    labels = {r.doc_id: r.labels for r in found}
    assert [labels[i] for i in range(len(texts))] == expected and labels[None] == expected[2]


def test_words_of_the_longest_template(spark):
    masks = [(1 << 62) | (1 << 61), 1, (1 << 63) - 1, 0b1001, 0]
    df = spark.createDataFrame([(m,) for m in masks], "mask long")
    assert [r.n for r in df.select(license_scan.words_covered(df.mask).alias("n")).collect()] == [4, 3, 65, 6, 0]


# --- quality


def test_quality_learns_and_scores_everything(spark, documents, nothing):
    good = [(i, f"{' '.join(f'Word{(i * k) % 97} and' for k in range(30))}.", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(f"BUY{(i * k) % 89}!!" for k in range(30)), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (5, None), (3, 7)], "doc_id long, quality int")
    found = quality.op7(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out]
    assert held and all(r.predicted == (r.doc_id < 1000) for r in held if r.doc_id >= 1000 or 20 <= r.doc_id < 150)
    assert quality.op7(nothing, labels).count() == 0
    assert {r.score for r in quality.op7(docs, labels.limit(0)).collect()} == {0.5}


# --- mixing


def test_targets():
    assert mixing.targets([("b", 10), (None, 100), ("a", 100)]) == {"b": 20.0, "a": pytest.approx(177.0), None: pytest.approx(118.0)}
    assert mixing.targets([]) == {}
    assert mixing.targets([("a", 0), ("b", 5)]) == {"a": 0.0, "b": pytest.approx(7.5)}


def test_mix_comes_near_its_targets(spark, documents, nothing):
    rng = np.random.default_rng(1)
    rows_ = [(i, "w " * int(rng.integers(0, 60)), ["x", "y", None, "z"][min(int(rng.integers(0, 9)), 3)]) for i in range(4000)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    found = mixing.op10(df).collect()
    again = mixing.op10(df.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    taken, goal = Counter(), {}
    for r in found:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source_size] += r.taken
        goal[r.source_size] = r.target
    assert all(abs(taken[s] - g) <= 60 for s, g in goal.items())
    assert mixing.op10(nothing).count() == 0
    assert mixing.op10(documents).count() == documents.count()
    assert mixing.mix(documents).columns == documents.columns


@pytest.mark.parametrize(("sf", "gap"), [("sf0.01", 0.001), ("sf0.1", 0.0001)])
def test_mix_of_the_given_tables(spark, sf, gap):
    """50 and 500 documents a source, of very different lengths."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, goal = Counter(), {}
    for r in mixing.op10(docs).collect():
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - g) <= gap * g + 1 for s, g in goal.items())


def test_blocks_keep_their_bound_when_rows_share_an_id(spark):
    """A third of the rows has no id; they spread over the blocks, and however the rows lie they are decided alike."""
    rows_ = [(None if i % 3 == 0 else i, "s", 5 + i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows_, "unit long, source string, size long")
    same = mixing._numbered(df.repartition(5)).collect()
    groups = Counter((r.unit, r.size) for r in same)
    assert {(r.unit, r.size, r.same) for r in same} == {(*k, i) for k, n in groups.items() for i in range(n)}
    first, again = (rows(mixing.copies(x, block_rows=200), "unit", "size", "copies") for x in (df, df.repartition(7)))
    assert first == again


def test_a_long_document_is_decided_against_all_others():
    import random

    rng = random.Random(5)
    size = [3000.0] + [float(rng.randrange(1, 60)) for _ in range(400)]
    chance = [0.5] * len(size)
    words_, number = sum(c * s for c, s in zip(chance, size, strict=True)), sum(chance)
    mixing.settle_large(chance, size, rng)
    assert chance[0] in (0, 1)
    assert sum(c * s for c, s in zip(chance, size, strict=True)) == pytest.approx(words_)
    assert sum(chance) == pytest.approx(number)
    chance, size = [0.5, 0.25, 0.75, 1.0], [10.0, 4.0, 8.0, 3.0]
    mixing.land(chance, size)
    assert chance == [0.0, 1.0, 1.0, 1.0]  # 12 words


def test_flight_keeps_both_totals():
    import random

    rng = random.Random(3)
    size = [float(rng.randrange(1, 500)) for _ in range(300)]
    chance = [0.37] * 300
    mixing.fly(chance, size, rng)
    assert sum(0 < c < 1 for c in chance) <= 2
    assert sum(chance) == pytest.approx(111.0)
    assert sum(c * s for c, s in zip(chance, size, strict=True)) == pytest.approx(0.37 * sum(size))
