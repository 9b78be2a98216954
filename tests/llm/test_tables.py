"""Vectors, archives, conversations and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from awkward import documents  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from keepwise.llm import chat, exact_topk, hilbert_ann, warc
from keepwise.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(50, rows[50][1]), (900, [0.0] * 16), (901, None), (902, [1.0, None]), (903, [float("nan")] * 16)]
    rows += [(904, []), (None, rows[0][1]), (905, [2.0]), (906, [float("inf")] + [0.0] * 15)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)


def usable(df):
    rows = {(r.vec_id, tuple(r.embedding)) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)}
    return [(i, np.pad(np.array(v), (0, 16 - len(v)))) for i, v in sorted(rows)]


def best(rows, score, k=5):
    out = {}
    for q, x in rows:
        if q % 50 == 0:
            others = sorted((-score(x, y), i) for i, y in rows if i != q)
            out[q] = [(i, -s) for s, i in others[:k]]
    return out


def grouped(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_top_k(spark, vectors):
    rows = [(i, np.floor(256 * v)) for i, v in usable(vectors)]
    assert grouped(exact_topk.op4(vectors)) == best(rows, lambda a, b: int(a @ b))
    assert exact_topk.op4(vectors.limit(0)).count() == 0


def test_queries_meet_blocks_in_batches(spark, vectors, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(exact_topk, "BATCH", 1)
    rows = [(i, np.floor(256 * v)) for i, v in usable(vectors)]
    assert grouped(exact_topk.op4(vectors)) == best(rows, lambda a, b: int(a @ b))
    queries = spark.range(0, 3000, 1, 12).selectExpr("id", "array(double(id)) as v", "0D as threshold")
    blocks = spark.range(10).selectExpr("id as block", "int(id % 2) as group")

    def sizes(q, b):
        return pa.table({"packs": pa.array([q.num_rows]), "blocks": pa.array([b.num_rows])})

    met = exact_topk._meet(queries, blocks, 2, sizes, "packs long, blocks long").collect()
    assert sum(r.packs for r in met) == 2 * 12 and max(r.packs for r in met) < 6
    assert all(r.blocks == 5 for r in met) and len(met) == 2 * 12


def test_blocks_are_pruned():
    import pyarrow as pa

    m = np.zeros((64, 4))
    m[:32] = 100
    table = pa.table({"ids": [np.arange(32).tobytes(), np.arange(32, 64).tobytes()], "m": [m[:32].tobytes(), m[32:].tobytes()]})
    opened = exact_topk.Blocks(table, 4)
    opened.m[1] = None  # would fail if it were scored
    scores, ids = opened.search(-1, np.ones(4), 5, float("-inf"))
    assert list(ids) == [0, 1, 2, 3, 4] and set(scores) == {400}


def test_hilbert_neighbours(spark, vectors):
    rows = [(i, v) for i, v in usable(vectors) if v.any()]
    true = best(rows, lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)))
    found = grouped(hilbert_ann.op8(vectors))
    assert set(found) == set(true)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in true[q]}) for q in true)
    assert hits >= 0.9 * sum(map(len, true.values()))
    at = dict(rows)
    for q, near in found.items():
        for i, s in near:
            assert s == pytest.approx(max(at[q] @ y / np.sqrt((at[q] @ at[q]) * (y @ y)) for j, y in rows if j == i), abs=1e-12)
    assert hilbert_ann.op8(vectors.limit(0)).count() == 0


def test_askers_of_a_block_are_dealt(spark, vectors, monkeypatch):
    whole = grouped(hilbert_ann.op8(vectors))
    monkeypatch.setattr(hilbert_ann, "ASKERS", 3)
    found = grouped(hilbert_ann.op8(vectors))
    # The last bit of a product depends on how many rows are multiplied at once.
    assert {q: [(i, pytest.approx(s, abs=1e-12)) for i, s in near] for q, near in whole.items()} == found
    asks = spark.range(60).selectExpr("id as asker", "array(1D) as q", "0L as block")
    rows = spark.range(10).selectExpr("id as gid", "array(1D) as v", "array(id) as ids", "0L as block")
    asking, copies = hilbert_ann._dealt(asks, rows)
    counts = {r.salt: r["count"] for r in asking.groupBy("salt").count().collect()}
    assert sum(counts.values()) == 60 and max(counts.values()) < 15
    assert {r.salt: r["count"] for r in copies.groupBy("salt").count().collect()} == dict.fromkeys(range(20), 10)


def test_hilbert_curve_visits_neighbours():
    side = np.arange(16)
    cells = np.array([(a, b) for a in side for b in side])
    order = cells[np.argsort(hilbert_ann.hilbert_keys(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


PAGES = [
    (3, "http://a/1", "same é"),
    (1, "http://a/2", "same é"),
    (2, "http://b\r\nX: y", "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\nend"),
    (4, None, None),
    (5, "u", ""),
    (6, "u", "\r\n\r\nx\r\n\r\n"),
    (6, "u", "\r\n\r\nx\r\n\r\n"),
    (None, "n", "same é"),
    (None, "m", "alone"),
    (7, "long", "y" * 300_000),
]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    first: dict = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = Counter()
    for i, _, html in PAGES:
        raw, origin = (html or "").encode(), first.get(html or "")
        again = origin is not None and i != origin
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expected[i, len(raw), digest, "revisit" if again else "response", origin if again else None] += 1
    found = warc.op3(pages)
    assert Counter(tuple(r) for r in found.collect()) == expected
    assert warc.op3(pages.limit(0)).count() == 0


def test_archive_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = warc.write_archives(pages, str(tmp_path / "w"), min_bytes=3)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path).glob("part-*"))
    assert raw.count(b"same \xc3\xa9") == 1 and raw.count(b"WARC-Type: revisit") == 2
    back = {(r.page_id, r.url): r for r in warc.read_archives(spark, path, True).collect()}
    assert back[2, "http://b%0D%0AX: y"].payload == PAGES[2][2]
    assert back[3, "http://a/1"].payload == "" and back[3, "http://a/1"].refers_to == 1
    assert back[5, "u"].record_type == "response"


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "bot", "content": None}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "response": "b"},
        {"instruction": "a", "input": "c", "output": "b"},
        {"data": {"messages": [{"role": "system", "content": "s"}]}},
        {"messages": []},
        {"something": {"else": 1}},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, "no json"), (8, None)]
    done = {r.id: r for r in chat.to_turns(spark.createDataFrame(rows, "id int, record string")).collect()}
    turns = {i: r.turns and [tuple(t) for t in r.turns] for i, r in done.items()}
    assert turns[0] == [("user", "a"), ("bot", "")]
    assert turns[1] == turns[2] == [("user", "a"), ("assistant", "b")]
    assert turns[3] == [("user", "a"), ("user", "c"), ("assistant", "b")]
    assert turns[4] == [("system", "s")] and turns[5] == []
    assert [done[i].layout for i in (2, 6, 7, 8)] == ["prompt-response", None, None, None]


TALKS = [
    (1, 1, "assistant", "x <|im_end|> <\\|im_start|> <|\n"),
    (1, 0, "user", "<\\\\|<"),
    (2, 0, "ro\nle%0A", ""),
    (2, None, None, None),
    (3, 0, "system", "s"),
    (3, 1, "user", "u"),
    (3, 2, "assistant", "漢字 🎈<"),
    (3, 2, "assistant", "漢字 🎈<"),
    (None, 0, "assistant", "n"),
]


def test_conversations_round_trip(spark):
    df = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", TALKS)
    found = chat.op5(df)
    assert Counter(tuple(r) for r in found.collect()) == Counter(con.execute(chat.ORACLE).fetchall())
    assert chat.op5(df.limit(0)).count() == 1
    back = chat.format_turns(chat.to_turns(chat.records(df))).select("turns", chat.read_turns(F.col("formatted")).alias("back"))
    assert back.filter(~F.col("turns").eqNullSafe(F.col("back"))).count() == 0


def test_long_texts_and_conversations_stay_whole(spark):
    """Above 20,000,000 characters in a text, and above 128 MiB in a conversation."""
    sizes = [(1, 0, "user", 'a\\"<|', 5_100_000), (1, 1, "assistant", "b", 3)]
    sizes += [(2, t, ["user", "assistant"][t % 2], 'c{"x":', 170_000) for t in range(140)]
    df = spark.createDataFrame(sizes, "conv_id long, turn long, role string, piece string, n int")
    df = df.withColumn("text", F.expr("repeat(piece, n)"))
    found = {r.conv_id: r for r in chat.op5(df).collect()}
    for i in (1, 2):
        turns = [(role, piece * n) for c, _, role, piece, n in sizes if c == i]
        said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        loss = "".join(text for role, text in turns if role == "assistant")
        size = sum(24 + len(role) + len(text) + text.count("<|") for role, text in turns)
        expected = (i, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
        assert tuple(found[i]) == expected


def test_large_records_of_every_layout(spark):
    """A text no variant can hold, in each layout and in none."""
    short = [
        {"messages": [{"role": "user", "content": "L"}, {"content": None, "role": "bot"}]},
        {"data": {"messages": [{"role": "system", "content": "L"}]}},
        {"conversations": [{"from": "human", "value": "a \\\"{"}, {"from": "gpt", "value": "L"}]},
        {"turns": [{"role": "r", "text": "L"}]},
        {"instruction": "a", "input": None, "output": "L"},
        {"messages": [{"role": "user", "content": "L", "more": "x"}]},
        {"prompt": {"response": "L"}},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(short)] + [(7, '{"prompt": "L", "response": ')]
    df = spark.createDataFrame(rows, "id int, record string")
    large = df.withColumn("record", F.expr("replace(record, '\"L\"', concat('\"', repeat('y', 20100000), '\"'))"))
    small = {r.id: r for r in chat.to_turns(df).collect()}
    cut = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.regexp_replace(t["text"], "^y{20100000}$", "L").alias("text")))
    found = {r.id: r for r in chat.to_turns(large).select("id", "layout", cut.alias("turns")).collect()}
    assert {i: (r.layout, r.turns) for i, r in found.items()} == {i: (r.layout, r.turns) for i, r in small.items()}
    assert [found[i].layout for i in (5, 6, 7)] == [None] * 3 and all(found[i].layout for i in range(5))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rows = con.execute(ORACLE[name])
    order = [df.columns.index(d[0]) for d in rows.description]
    assert Counter(tuple(r[i] for i in order) for r in df.collect()) == Counter(rows.fetchall())


def test_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == list(QUERIES) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        seen.append(docs.count())
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    assert Counter((r.doc_id, r.decoded) for r in done.collect()) == texts
    assert seen[1] <= seen[0] and seen[2] < seen[1] and seen[3] == seen[2]
    assert Counter((r.doc_id, r.decoded) for r in corpus_pipeline.run(spark, SF).collect()) == texts
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents, SF).count() >= 0, name
