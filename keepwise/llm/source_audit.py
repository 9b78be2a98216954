"""Source divergence audit: how the word use of each source differs from its language and its neighbours.

1. Each task reads Arrow batches and cuts them into slices of about ``SLICE_BYTES``. The texts of a slice,
   ordered by (lang, source), lie in one buffer. Pointers to the word starts are sorted by what they point at: a multikey
   quicksort with eight bytes as one character, which sorts a slice by its current eight bytes and
   goes on with each run of equal ones that is not yet at its end. Words longer than ``DEEP`` bytes are rare; what is left of them
   is compared as byte strings. The sort is stable, so the texts of a source stand together in each
   run of equal words, and the run yields the word's count and document count per source.
2. The partial counts are summed in Spark per (lang, source, term), then per (lang, term); terms in
   enough documents are kept.
3. Distances of sources: the kept terms of a language are dealt by hash to blocks of about ``TERMS``, its
   sources to blocks of about ``SOURCES``. A group is a block of terms and a pair of source blocks, and
   sums |p - q| for all pairs in a matrix of bounded size. Terms that no source of the group has need no rows: they all differ by the same amount.

A word or source that holds a third of all rows is pre-aggregated before any shuffle. A document longer
than a slice is counted in several pieces, cut between words, and still counts once. Totals and the list
of groups stay in Spark; nothing is broadcast or collected. All arithmetic is on integers.

Defined results: null text, lang and source are ''; texts without terms, or empty, still name their
group; repeated rows are documents of their own; a language without kept terms has pairs of value 0; a
source alone in its language has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm.common import stored

SLICE_BYTES = 12 << 20
STEP = 8  # bytes compared at once
DEEP = 64  # words are compared in steps up to here
MIN_DOCS = 30
TOP = 50
TERMS, SOURCES = 512, 256
SCALE, PRIOR = 1_000_000_000, 5

_IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_REST = re.compile(rb"[A-Za-z\x80-\xff]*")
# What remains of eight bytes, read from the left, when only so many belong to the word.
_FIRST_BYTES = np.array([((1 << 64) - 1) ^ ((1 << 8 * (STEP - n)) - 1) for n in range(STEP + 1)], np.uint64)


def _runs(new: np.ndarray) -> np.ndarray:
    """Run number of each position, from marks where a run starts."""
    return np.cumsum(new) - 1


def sorted_pointers(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words at ``starts`` by their bytes, stable, and marks where another word begins.

    ``buffer`` is padded with ``STEP`` bytes; no word holds a zero byte.
    """
    eight = np.lib.stride_tricks.sliding_window_view(buffer, STEP)

    def key(at: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(sizes[at] - depth, 0, STEP)
        raw = np.ascontiguousarray(eight[np.where(left > 0, starts[at] + depth, 0)]).view(">u8").ravel().astype(np.uint64)
        return raw & _FIRST_BYTES[left]

    first = key(np.arange(len(starts)), 0)
    order = np.argsort(first, kind="stable")
    first = first[order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    depth = STEP
    todo = np.arange(len(order))  # positions whose run may not be at its end
    while True:
        # Runs of equal words so far, with a member that goes on, are sorted by what follows.
        run = _runs(new[todo])
        open_ = np.bincount(run, weights=sizes[order[todo]] > depth) > 0
        todo = todo[(open_ & (np.bincount(run) > 1))[run]]
        if not len(todo):
            return order, new
        run, at = _runs(new[todo]), order[todo]
        if depth < DEEP:
            after = key(at, depth)
        else:
            tails = [buffer[s + depth : s + n].tobytes() for s, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]
            places = {t: i for i, t in enumerate(sorted(set(tails)))}
            after = np.array([places[t] for t in tails], np.uint64)
        inner = np.lexsort((after, run))
        order[todo] = at[inner]
        after = after[inner]
        starts_run = new[todo]
        new[todo] = starts_run | np.append(True, after[1:] != after[:-1])
        if depth >= DEEP:
            return order, new
        depth += STEP


def _slice_counts(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, word, count, documents) over texts whose group numbers ascend."""
    joined = b"\x00".join(texts).lower() + bytes(STEP)
    buffer = np.frombuffer(joined, np.uint8)
    inside = np.concatenate([[False], _IN_TERM[buffer], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        none = np.array([], np.int64)
        return none, [], none, none
    order, new = sorted_pointers(buffer, starts, sizes)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(text_ends, starts[order], side="right")
    group = groups[text]
    new_text, new_group = new.copy(), new.copy()
    new_text[1:] |= text[1:] != text[:-1]
    new_group[1:] |= group[1:] != group[:-1]
    heads = np.flatnonzero(new_group)
    counts = np.diff(np.append(heads, len(order)))
    documents = np.add.reduceat(new_text.astype(np.int64), heads)
    at = order[heads]
    words = [joined[s : s + n] for s, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]
    return group[heads], words, counts, documents


def _pieces(text: bytes, size: int):
    """A long text cut outside its words; a single longer word stays whole."""
    lo = 0
    while lo < len(text):
        hi = min(lo + size, len(text))
        rest = _REST.match(text, hi)
        hi = rest.end()
        yield text[lo:hi]
        lo = hi


_COUNTS = "lang string, source string, term string, n long, docs long"


def _count_terms(slice_bytes: int):
    def run(batches):
        def emit(rows: list[tuple[str, str, bytes]]):
            rows.sort(key=lambda r: r[:2])
            names = sorted({r[:2] for r in rows})
            number = {g: i for i, g in enumerate(names)}
            group, words, n, docs = _slice_counts([r[2] for r in rows], np.array([number[r[:2]] for r in rows]))
            return batch(group, names, words, n, docs)

        def long_text(lang: str, source: str, text: bytes):
            total: Counter = Counter()
            for piece in _pieces(text, slice_bytes):
                _, words, n, _ = _slice_counts([piece], np.zeros(1, np.int64))
                for w, c in zip(words, n.tolist(), strict=True):
                    total[w] += c
            ones = np.ones(len(total), np.int64)
            return batch(ones - 1, [(lang, source)], list(total), np.array(list(total.values()), np.int64), ones)

        def batch(group, names, words, n, docs):
            langs, sources = pa.array([g[0] for g in names], pa.string()), pa.array([g[1] for g in names], pa.string())
            at = pa.array(group, pa.int64())
            terms = pa.array(words, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        held, size = [], 0
        for b in batches:
            for lang, source, text in zip(b.column(0), b.column(1), b.column(2).cast(pa.binary()), strict=True):
                lang, source, text = lang.as_py(), source.as_py(), text.as_py()
                if len(text) > slice_bytes:
                    yield long_text(lang, source, text)
                    continue
                held.append((lang, source, text))
                size += len(text) + 1
                if size >= slice_bytes:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return run


def term_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(lang, source, term, n, docs): how often a term stands in a source, and in how many documents."""
    partial = docs.mapInArrow(_count_terms(slice_bytes), _COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * wide(n + PRIOR)
    below = wide(total + PRIOR * terms)
    whole = F.call_function("div", above, below)
    return F.when(terms > 0, F.lit(1).cast("long") + whole.cast("long"))


def _distances(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums over the terms of one group, for each pair of a source of one block with one of the other."""
    import pyarrow.compute as pc

    lang, _, low, high = (k.as_py() for k in key)
    marks = rows.filter(pc.is_null(rows["term"])).sort_by([("block", "ascending"), ("source", "ascending")])
    sources, rest, block = marks["source"].to_pylist(), marks["p"].to_numpy(), marks["block"].to_numpy()
    found = rows.filter(pc.is_valid(rows["term"]))
    number = {s: i for i, s in enumerate(sources)}
    codes = found["term"].combine_chunks().dictionary_encode()
    width = len(codes.dictionary)
    p = np.repeat(rest[:, None], width, axis=1)
    p[np.array([number[s] for s in found["source"].to_pylist()], np.int64), codes.indices.to_numpy()] = found["p"].to_numpy()
    out: dict[str, list] = {"source": [], "item": [], "value": [], "unseen": []}
    for i in np.flatnonzero(block == low).tolist():
        others = np.flatnonzero(block == high) if low != high else np.arange(i + 1, len(sources))
        value = np.abs(p[others] - p[i]).sum(axis=1).tolist()
        unseen = np.abs(rest[others] - rest[i]).tolist()
        for j, v, u in zip(others.tolist(), value, unseen, strict=True):
            for a, b in ((i, j), (j, i)):
                out["source"].append(sources[a])
                out["item"].append(sources[b])
                out["value"].append(v)
                out["unseen"].append(u)
    n = len(out["source"])
    return pa.table(
        {
            "lang": pa.array([lang] * n, pa.string()),
            "source": pa.array(out["source"], pa.string()),
            "item": pa.array(out["item"], pa.string()),
            "value": pa.array(out["value"], pa.int64()),
            "unseen": pa.array(out["unseen"], pa.int64()),
            "seen": pa.array([width] * n, pa.int64()),
        }
    )


def source_distances(kept: DataFrame, groups: DataFrame, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, item, value): sum of |p - q| over the kept terms, for all pairs of sources of a language.

    ``kept`` has (lang, source, term, p) where a source has the term, ``groups`` (lang, source, n_terms, p0,
    n_sources) with the probability of a term it does not have.
    """
    blocks = F.ceil(F.col("n_sources") / sources)
    groups = groups.withColumns(
        {"block": F.pmod(F.xxhash64("source"), blocks), "blocks": blocks, "buckets": F.greatest(F.lit(1), F.ceil(F.col("n_terms") / terms)), "p0": F.coalesce("p0", F.lit(0))}
    )
    marks = groups.select("lang", "source", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    rows = kept.select("lang", "source", "term", "p").join(groups.select("lang", "source", "block", "blocks", "buckets"), ["lang", "source"])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets"))).drop("buckets")
    rows = rows.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    grouped = rows.select("lang", "bucket", "low", "high", "block", "source", "term", "p").groupBy("lang", "bucket", "low", "high")
    sums = grouped.applyInArrow(_distances, "lang string, source string, item string, value long, unseen long, seen long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.max("unseen").alias("unseen"), F.sum("seen").alias("seen"))
    sums = sums.join(groups.select("lang", "source", "n_terms"), ["lang", "source"])
    return sums.select("lang", "source", "item", (F.col("value") + (F.col("n_terms") - F.col("seen")) * F.col("unseen")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank; see the module's text."""
    empty = F.lit("")
    read = docs.select(*[F.coalesce(F.col(c), empty).alias(c) for c in ("lang", "source", "text")])
    counts = stored(term_counts(read), "term_counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = counts.select("lang", "source", "term", "n").join(terms.drop("docs"), ["lang", "term"])
    kept = stored(kept, "kept_terms")

    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    distinct = kept.select("lang", "term", "n_lang").distinct()
    per_lang = distinct.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n_lang").alias("n_all"))
    groups = read.groupBy("lang", "source").agg(F.lit(1).alias("there")).drop("there")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    groups = groups.join(sizes, "lang").join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.fillna(0, ["n_source", "n_terms", "n_all"])
    groups = stored(groups.withColumn("p0", probability(F.lit(0), F.col("n_source"), F.col("n_terms"))), "groups")

    kept = kept.join(groups.select("lang", "source", "n_source", "n_terms", "n_all"), ["lang", "source"])
    kept = kept.withColumn("p", probability(F.col("n"), F.col("n_source"), F.col("n_terms")))
    q = probability(F.col("n_lang"), F.col("n_all"), F.col("n_terms"))
    order = [F.desc("value"), F.asc("item")]
    per_group = Window.partitionBy("lang", "source").orderBy(*order)
    more = kept.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
    more = more.withColumn("rank", F.row_number().over(per_group)).filter(F.col("rank") <= top)
    pairs = source_distances(kept, groups).withColumn("rank", F.row_number().over(per_group))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(more.withColumn("part", F.lit("term")).select(columns))


def op11(docs: DataFrame) -> DataFrame:
    return audit(docs)


ORACLE = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws
  from documents
), w as (select lang, source, id, unnest(ws) as term from d),
kept as (select lang, term, count(*) as n from w group by all having count(distinct id) >= 30),
all_of as (select lang, count(*) as v, sum(n) as total from kept group by lang),
groups as (select distinct lang, source from d),
counted as (select lang, source, term, count(*) as n from w group by all),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as n_lang from groups g join kept k on k.lang = g.lang
  left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term
), p as (
  select dense.lang, source, term, n,
    1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by dense.lang, source) + 5 * v)::hugeint as p,
    1 + (1000000000::hugeint * (n_lang + 5)) // (total + 5 * v)::hugeint as q
  from dense join all_of on all_of.lang = dense.lang
), apart as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select g.lang, g.source, h.source as item, coalesce(value, 0) as value from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join apart on apart.lang = g.lang and apart.source = g.source and apart.item = h.source
), rows_of as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q
), ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from rows_of)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked
where part = 'pair' or rank <= 50
"""
