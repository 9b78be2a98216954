"""Each pipeline stage on its own input against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import public_tokenizers
import pytest
from awkward import prose
from test_documents import linked, words
from tokenizers import Tokenizer

import corpus_pipeline
from keepwise.llm import bpe, mixing, quality

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, passages that repeat, blank texts and two sources."""
    rows, passage = [], prose(300, 60)
    for i in range(24):
        text = prose(400 + i // 3, 150 + i)  # three texts that begin alike
        if i % 8 == 5:
            text = f"{text} {passage}"
        rows.append((i, text, "en", "a" if i % 3 else "b", len(text)))
    rows += [(40, rows[0][1], "en", "a", 0), (41, "", "en", "a", 0), (42, None, "en", None, None), (43, "one two", "de", None, 7)]
    return spark.createDataFrame(rows, COLUMNS).repartition(2).cache()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_quality_stage_keeps_what_scores_well(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.op7(given, labels).collect()}
    kept = STAGE["quality_classifier"](spark, given, SF)
    assert kept.columns == given.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in scores.items() if s >= 0.7)


def test_near_dedup_stage_keeps_one_of_each_group(spark, docs):
    kept = STAGE["minhash_near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    groups = {i: c for i, _, c in linked(pairs(docs), 5, 80)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in groups.items() if i == c)
    assert len(set(groups.values())) < len(groups)


def test_passage_stage_cuts_what_stood_earlier(spark, docs):
    done = {r.doc_id: r for r in STAGE["substring_dedup"](spark, docs, SF).collect()}
    seen, cut = set(), 0
    for i, text in sorted(pairs(docs)):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        left = [a for a, g in zip(w, gone, strict=True) if not g]
        cut += sum(gone)
        assert words(done[i].text) == left
        if not any(gone):
            assert done[i].text == text
    assert cut > 60 and len(done) == docs.count()


def test_mixing_stage_takes_whole_documents_near_the_targets(spark, docs):
    mixed = STAGE["source_mixing"](spark, docs, SF).collect()
    size = {i: len(words(t)) for i, t in pairs(docs)}
    source = {r.doc_id: r.source for r in docs.collect()}
    per, taken = defaultdict(int), defaultdict(int)
    for i, s in source.items():
        per[s] += size[i]
    for r in mixed:
        taken[r.source] += size[r.doc_id]
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    texts = dict(pairs(docs))
    assert all(texts[r.doc_id] == r.text for r in mixed)
    goals = mixing.targets(list(per.items()))
    assert all(abs(taken[s] - goal) <= 2 * max(size.values()) for s, goal in goals.items())


def test_token_stage_is_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(bpe.VOCABULARY)))
    expected = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in pairs(docs))
    found = STAGE["bpe_encode_decode"](spark, docs, SF).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found) == expected
