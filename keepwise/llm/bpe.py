"""BPE encoding and decoding through a table of distinct words.

A word is what stands between the places where a space is followed by a visible character; the space
belongs to the word after it. The tokenizer never merges across such a place, so words can be encoded
one by one. Texts of added tokens are words of their own.

1. Documents are written as a bucketed table of chunks (see ``chunks``).
2. The words that are frequent in a bounded sample are encoded once, up front and in tasks, and broadcast (at
   most ``FREQUENT`` words of ``FREQUENT_CHARS`` characters). They only save traffic.
3. Each chunk sends its other distinct words, packed by hash, to the word partitions.
4. A word partition encodes each of its distinct words once and answers every request with the ids, in
   the order asked.
5. Each chunk gets its answers and joins the ids back by position.

Nothing is broadcast that grows with the data, the words of a partition are bounded by the number of
partitions, and a common word is asked for once per chunk, however often it stands there. Decoding
joins ids to pieces; the table of pieces is the vocabulary, whatever the input.

Defined results: null texts are empty, empty texts have no ids; rows keep their number and columns,
repeated rows included; null ids decode to an empty text; ids outside the vocabulary are an error.
"""

from __future__ import annotations

import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.llm.chunks import PARTITION_BITS, chunked

VOCABULARY = "byte_bpe_50k.json"  # a public vocabulary's name, or the path of another
# A space before anything but white space; what Python and the tokenizer may see differently stays inside.
CUT = re.compile(r" (?=[!-~¡-῿])")
CHUNK_ROWS = 1000
SLICE_ROWS = 200  # rows decoded at once
FREQUENT = 100_000  # words encoded up front and known to all tasks
FREQUENT_CHARS = 32  # longest of them
SLICE_WORDS = 1000  # frequent words encoded at once
SAMPLE_CHUNKS = 6  # chunks they are counted in


@lru_cache(1)
def load(path: str):
    """The tokenizer, loaded where it is used and once per process; the driver needs none."""
    from tokenizers import Tokenizer

    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    tokenizer = Tokenizer.from_file(str(path))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def added_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in load(path).get_added_tokens_decoder().items()}


def splitter(added: list[str]):
    """A function from a text to its words, in order; joined they are the text."""
    special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def plain(text: str) -> list[str]:
        first, *rest = CUT.split(text)
        return [*([first] if first else []), *[" " + w for w in rest]]

    def split(text: str) -> list[str]:
        if special is None or not any(a in text for a in added):
            return plain(text)
        return [w for part in special.split(text) for w in ([part] if part in added else plain(part))]

    return split


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _by_partition(words: set[str], partitions: int) -> dict[int, list[str]]:
    """Distinct words by word partition, in a fixed order."""
    out: dict[int, list[str]] = {}
    for w in sorted(words):
        out.setdefault(_hash(w) % partitions, []).append(w)
    return out


def _pack(words: list[str]) -> bytes:
    import zstandard

    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return zstandard.compress(np.array([len(raw), *map(len, raw)], np.uint32).tobytes() + b"".join(raw), 6)


def _unpack(blob: bytes) -> list[str]:
    import zstandard

    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4)) + 4 * (n + 1)
    starts = [4 * (n + 1), *ends[:-1].tolist()]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts, ends.tolist(), strict=True)]


REQUEST = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary())])


class Frequent:
    """The frequent words with their ids, as compact tables; ``place`` is built where it is used."""

    def __init__(self, table: pa.Table):
        ids = table["ids"].combine_chunks()
        self.words = table["word"].combine_chunks()
        self.sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int32)
        self.ids = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)

    @cached_property
    def place(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}


def frequent_words(table: DataFrame, path: str) -> Frequent:
    """The most frequent short words of the sample, encoded in tasks; the same for every input size."""

    def count(batches):
        from collections import Counter

        split, seen = splitter(list(added_tokens(path))), Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(w for w in split(t.as_py() or "") if len(w) <= FREQUENT_CHARS)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def encoded(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_WORDS):
                words = whole.column(0).slice(lo, SLICE_WORDS)
                ids = [e.ids for e in load(path).encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    # The first chunks of the first input partitions: the filter prunes buckets and row groups.
    sample = table.filter(F.col("chunk").isin([p << PARTITION_BITS for p in range(SAMPLE_CHUNKS)])).select("text__")
    counted = sample.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word")
    return Frequent(most.mapInArrow(encoded, "word string, ids array<int>").toArrow())


def _ask(partitions: int, path: str, frequent):
    """The requests of one chunk: (part, chunk, words)."""

    def run(docs: pa.Table) -> pa.Table:
        split, words = splitter(list(added_tokens(path))), set()
        for text in docs["text__"]:
            words.update(split(text.as_py() or ""))
        chunk = docs["chunk"][0].as_py()
        asked = _by_partition(words.difference(frequent.value.place), partitions)
        return pa.table([list(asked), [chunk] * len(asked), [_pack(w) for w in asked.values()]], schema=REQUEST)

    return run


def _answer(path: str):
    """Encode each distinct word of the partition once: (part, chunk, ids) in the order asked."""

    def run(batches):
        import zstandard

        tokenizer, known = load(path), {}
        at = None
        for batch in batches:
            blobs = []
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if part != at:
                    at, known = part, {}
                words = _unpack(blob.as_py())
                new = [w for w in words if w not in known]
                for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, np.int32).tobytes()
                ids = [known[w] for w in words]
                sizes = np.array([len(i) // 4 for i in ids], np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                # Bytes of equal weight side by side compress well.
                planes = flat.view(np.uint8).reshape(-1, 4).T.tobytes()
                blobs.append(zstandard.compress(sizes.tobytes() + planes, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["part", "chunk", "ids"]
            )

    return run


def _read_answer(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int32, n)
    planes = np.frombuffer(raw, np.uint8, offset=4 * n).reshape(4, -1)
    return sizes, np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _join_back(partitions: int, path: str, frequent, decoded: bool):
    """Ids of every document of one chunk, from the answers to its distinct words; decoded where asked."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("row")
        split = splitter(list(added_tokens(path)))
        known = frequent.value.place
        # Split twice rather than keep a million words.
        rare: set[str] = set()
        for t in docs["text__"]:
            rare.update(split(t.as_py() or ""))
        rare.difference_update(known)
        asked = _by_partition(rare, partitions)
        place, sizes, flat = dict(known), [frequent.value.sizes], [frequent.value.ids]
        got = dict(zip(answers["part"].to_pylist(), answers["ids"].to_pylist(), strict=True)) if asked else {}
        for part, own in asked.items():
            n, ids = _read_answer(got[part], len(own))
            place.update(zip(own, range(len(place), len(place) + len(own)), strict=True))
            sizes.append(n)
            flat.append(ids)
        sizes, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        places = [np.fromiter(map(place.__getitem__, split(t.as_py() or "")), np.int64) for t in docs["text__"]]
        counts = [len(p) for p in places]
        at = np.concatenate(places)
        # Take the range of each word's ids, one after the other.
        n = sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(starts[at] - (ends - n), n)
        word_ends = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        lists = pa.ListArray.from_arrays(pa.array(word_ends, pa.int32()), pa.array(flat[take], pa.int32()))
        columns = {"rest": docs["rest"], "ids": lists}
        if decoded:
            parts = [_text_of(lists.slice(lo, SLICE_ROWS), pieces(path)) for lo in range(0, len(lists), SLICE_ROWS)]
            columns["decoded"] = pa.chunked_array(parts, pa.string())
        return pa.table(columns)

    return run


def encode(docs: DataFrame, text: str = "text", path: str = VOCABULARY, decoded: bool = False) -> DataFrame:
    """The documents without their text but with ``ids``; a column of that name is replaced.

    ``decoded`` adds the text the ids decode to, in the tasks that join them back (replacing a column
    of that name); ``decode`` does the same for ids that are stored.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Other columns travel as one, so that none of their names can clash.
    others = [c for c in docs.columns if c not in (text, "ids") and not (decoded and c == "decoded")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("__none"))
    table = chunked(docs.select(F.col(f"`{text}`").alias("text__"), rest.alias("rest")), CHUNK_ROWS)
    asked = table.select("chunk", "text__").groupBy("chunk")  # the buckets: nothing is shuffled
    frequent = spark.sparkContext.broadcast(frequent_words(table, path))
    requests = asked.applyInArrow(_ask(partitions, path, frequent), "part int, chunk long, words binary")
    dealt = requests.repartition(partitions, "part").sortWithinPartitions("part")
    answers = dealt.mapInArrow(_answer(path), "part int, chunk long, ids binary")
    fields = [table.schema["rest"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    back = _join_back(partitions, path, frequent, decoded)
    done = table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(back, T.StructType(fields))
    return done.select(*[F.col(f"rest.`{c}`") for c in others], *[f.name for f in fields[1:]])


@lru_cache(1)
def pieces(path: str) -> pa.Array:
    """The bytes of every id, once per process; byte-level pieces are undone by the fixed byte alphabet."""
    tokenizer = load(path)
    # Fixed values of byte-level vocabularies: printable Latin-1 stands for itself, the rest from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = [b""] * tokenizer.get_vocab_size()
    added = added_tokens(path)
    for piece, i in tokenizer.get_vocab().items():
        out[i] = piece.encode() if piece in added else bytes(back[c] for c in piece)
    return pa.array(out, pa.binary())


def _text_of(lists: pa.Array, known: pa.Array) -> pa.Array:
    """Join ids to pieces by position in the table of pieces, and pieces to texts."""
    flat = known.take(lists.flatten())
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), b"")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.as_py().decode("utf-8", "replace") for b in joined], pa.string())


def decode(df: DataFrame, ids: str = "ids", name: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """The rows with the text of their ids (replacing a column of that name); bytes that are not UTF-8 become replacement characters."""
    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    at = df.columns.index(ids)

    def run(batches):
        known = pieces(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(lo, SLICE_ROWS)
                texts = _text_of(batch.column(at), known)
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def op9(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Encode and decode every document, and digest both."""
    done = encode(docs.select("doc_id", "text"), path=path, decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
