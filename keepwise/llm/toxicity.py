"""Toxicity: a learned lexicon, matched with spelling errors, and scores of the context of each match.

1. Lexicon. From a bounded sample of labelled documents (``MAX_TRAIN``) Spark counts in how many toxic and other
   documents each word stands, and sums the same for word beginnings. Words whose presence speaks for
   the toxic label beyond chance enter the lexicon, and so do stems: beginnings of at least ``FORMS`` words with the
   same property, so that unseen endings are found.
2. Misspellings. The lexicon is a trie. Its Levenshtein automaton reads a word letter by letter; a state is
   the set of trie nodes that can be reached with how many errors, and is built when a text first asks for it.
   Terms of ``ONE_EDIT`` letters may differ in one letter, of ``TWO_EDITS`` in two. Digits and signs that stand for letters, and letters
   repeated three times or more, are read as the letters meant. Words of the sample that match only with errors and are
   not toxic there are exceptions.
3. Context. Each match is judged in a window of its line: inside quotation marks or a quoted line, near a word of
   reporting, or addressed to a reader. ``FACTORS`` turn that into a score of the window; quoted matches are
   summed apart from the others, so that quoting abuse is not abuse.
4. A logistic regression on the sums per document, fitted by Spark on the same sample, gives the score.

Everything but the fit covers all rows and whole texts. Broadcast are the lexicon (at most ``LEXICON`` terms and as many exceptions)
and the weights. Texts are read in pieces cut between words, so memory does not grow with a text's words.

Defined results: null and empty texts have no matches and get the score of a document without any;
labels that are null or not 0/1 are no training rows; an id labelled twice counts with its larger label, an id
with several rows trains with its smallest text; a null id is never held out; repeated rows are scored
each; with training rows of one class only the score is (toxic + 1) / (rows + 2), without any 0.5.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import stored

MAX_TRAIN = 20_000
LEXICON = 2_000
STEM, LONGEST, FORMS = 4, 10, 3  # letters of a stem, words it must begin
EVIDENCE, PRECISION = 11.0, 0.6
STEM_EVIDENCE, STEM_DOCS = 20.0, 3  # many beginnings are tried, so they need more; words of one document count apart
ONE_EDIT, TWO_EDITS = 6, 10
PIECE = 1 << 20
WINDOW = 90  # characters looked at on either side
PREDICT_AT = 0.5
FILES = 16  # the sample is bounded, so few files hold it whatever the input
COUNTED = 100_000  # words a counting task holds before it passes them on

WORD = re.compile(r"[\w@$*]+")
REPEATED = re.compile(r"(.)\1{2,}")
# Signs read as letters, quotation marks with what closes them, words of reporting and of address.
MEANT = str.maketrans("013457@$", "oieastas")
MARKS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "‘": "’"}
REPORTS = set("say said says call called calls wrote quote quoted sagt sagte schrieb nannte zitat dit disait écrit cite dijo dice escribió llamó cita".split())
ADDRESSES = set("you your yours u du dich dir dein deine tu te toi ton ta vous votre eres usted ti tus".split())
# What a window's score is multiplied by.
FACTORS = {"quoted": 0.3, "reported": 0.6, "addressed": 1.25}
STRENGTH = (1.0, 0.7, 0.5)  # by number of errors


def plain(word: str) -> str:
    """The letters a lower-case word stands for; '' when there are none."""
    text = word.strip("*_")
    if text.isascii() and text.isalpha():
        return REPEATED.sub(r"\1", text) if len(text) > 2 else text
    if not any(c.isalpha() for c in text):
        return ""
    return REPEATED.sub(r"\1", text.translate(MEANT))


def edits(letters: int) -> int:
    return (letters >= ONE_EDIT) + (letters >= TWO_EDITS)


class Automaton:
    """The Levenshtein automaton of all terms at once, over the trie of the terms."""

    STATES = 50_000

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.allowed = [0]  # most errors any term below a node may have
        self.word_end, self.stem_end = [-1], [-1]  # errors allowed when a term ends here
        for terms, ends in ((words, self.word_end), (stems, self.stem_end)):
            for term in terms:
                self._add(term, ends)
        self._clear()

    def _add(self, term: str, ends: list[int]) -> None:
        node, k = 0, edits(len(term))
        self.allowed[0] = max(self.allowed[0], k)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                for column in (self.allowed, self.word_end, self.stem_end):
                    column.append(0 if column is self.allowed else -1)
            node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], k)
        ends[node] = k

    def _clear(self) -> None:
        # States: (nodes with errors), transitions so far, fewest errors of a stem ended here, of a word.
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.stem_errors: list[int | None] = []
        self.word_errors: list[int | None] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Number of a state, after letters of the terms are skipped; -1 when nothing can match any more."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.allowed[child] and e < reached.get(child, 99):
                    reached[child] = e
                    todo.append(child)
        if not reached:
            return -1
        key = tuple(sorted(reached.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            for ends, errors in ((self.stem_end, self.stem_errors), (self.word_end, self.word_errors)):
                errors.append(min((e for n, e in key if e <= ends[n]), default=None))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < reached.get(node, 99):
                reached[node] = e

        for node, e in self.states[state]:
            reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        self.next[state][c] = found = self._state(reached)
        return found

    def errors(self, word: str) -> int | None:
        """Fewest errors with which the word is a term or begins with a stem; None when it does not match."""
        if len(self.states) > self.STATES:
            self._clear()
        state, best = self.start, None
        for c in word:
            after = self.next[state].get(c)
            state = self._step(state, c) if after is None else after
            if state < 0:
                return best
            e = self.stem_errors[state]
            if e is not None and (best is None or e < best):
                best = e
        e = self.word_errors[state]
        return e if best is None or (e is not None and e < best) else best


@dataclass
class Lexicon:
    words: list[str]
    stems: list[str]
    exceptions: list[str]


class Matcher:
    """Errors of each word of a text, remembered for words that match; knows most words that do not."""

    REMEMBER = 100_000

    def __init__(self, lexicon: Lexicon):
        self.automaton = Automaton(lexicon.words, lexicon.stems)
        self.exceptions = set(lexicon.exceptions)
        self.found: dict[str, int] = {}
        self.others: set[str] = set()

    def learn(self, words: set[str]) -> bool:
        """Whether any of the words matches."""
        for w in words - self.others:
            if w in self.found:
                continue
            meant = plain(w)
            e = self.automaton.errors(meant) if meant else None
            if e is None or (e and meant in self.exceptions):
                if len(self.others) > self.REMEMBER:
                    self.others.clear()
                self.others.add(w)
            else:
                if len(self.found) > self.REMEMBER:
                    self.found = {k: v for k, v in self.found.items() if k in words}
                self.found[w] = e
        return not self.found.keys().isdisjoint(words)


def pieces(text: str):
    """(start, end) of the pieces of a text, cut between words."""
    lo = 0
    while lo < len(text):
        hi = min(lo + PIECE, len(text))
        rest = WORD.match(text, hi)
        hi = rest.end() if rest else hi
        yield lo, hi
        lo = hi


def quoted(left: str, right: str) -> bool:
    """Whether a quotation opened on the left of a place is still open there and closed on its right."""
    closing = None
    for c in left:
        if closing is None:
            closing = MARKS.get(c)
        elif c in closing:
            closing = None
    return closing is not None and any(c in right for c in closing)


def window_score(left: str, right: str, errors: int) -> tuple[float, bool]:
    """Score of one match from its line to the left and right, and whether it is quoted."""
    inside = quoted(left, right) or left.lstrip().startswith(">")
    near = set(re.findall(r"\w+", f"{left[-WINDOW:]} {right[:WINDOW]}"))
    score = STRENGTH[errors]
    score *= FACTORS["quoted"] if inside else 1.0
    score *= FACTORS["reported"] if near & REPORTS else 1.0
    score *= FACTORS["addressed"] if near & ADDRESSES and not inside else 1.0
    return score, inside


FEATURES = ["strongest", "abuse", "density", "quotes"]


def document_features(text: str | None, matcher: Matcher) -> tuple[list[float], int, int]:
    """The sums over the windows of one text, and how many matches it has, in all and quoted."""
    data = (text or "").lower()
    n_words, scores, inside = 0, [], []
    for lo, hi in pieces(data):
        words = WORD.findall(data[lo:hi])
        n_words += len(words)
        if not matcher.learn(set(words)):
            continue
        for m in WORD.finditer(data, lo, hi):
            errors = matcher.found.get(m.group())
            if errors is None:
                continue
            # The line around the match, as far as a few windows.
            start = max(data.rfind("\n", 0, m.start()) + 1, m.start() - 8 * WINDOW)
            end = data.find("\n", m.end(), m.end() + 8 * WINDOW)
            right = data[m.end() : end if end >= 0 else m.end() + 8 * WINDOW]
            score, is_quoted = window_score(data[start : m.start()], right, errors)
            (inside if is_quoted else scores).append(score)
    total = math.fsum(scores)
    features = [max(scores, default=0.0), math.log1p(total), math.log1p(100 * total / max(n_words, 1)), math.log1p(math.fsum(inside))]
    return features, len(scores) + len(inside), len(inside)


def _counted_words(batches):
    """Partial (stem, word, toxic, other): documents with the word, by label; for beginnings toxic documents only."""
    seen: dict[tuple[bool, str], list[int]] = {}

    def counted():
        columns = [[t[0] for t in seen], [t[1] for t in seen], [n[0] for n in seen.values()], [n[1] for n in seen.values()]]
        kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["stem", "word", "toxic", "other"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = text.as_py().lower()
            words = {plain(w) for lo, hi in pieces(data) for w in set(WORD.findall(data[lo:hi]))}
            words = {w for w in words if 1 < len(w) <= 40}
            terms = [(False, w) for w in words]
            if toxic:
                terms += [(True, s) for s in {w[:n] for w in words for n in range(STEM, min(len(w), LONGEST + 1))}]
            for t in terms:
                seen.setdefault(t, [0, 0])[0 if toxic else 1] += 1
            if len(seen) > COUNTED:
                yield counted()
    yield counted()


def training_rows(docs: DataFrame, labels: DataFrame, train: Column | None, max_rows: int) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled ids, those with the smallest hashes."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if train is not None:
        marks = marks.filter(train)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # short rows, a bounded broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    return stored(rows.coalesce(FILES), "training")


def learn_lexicon(rows: DataFrame, n_toxic: int, n_rows: int) -> Lexicon:
    """Words and stems whose presence speaks for the toxic label."""
    prior = n_toxic / n_rows
    partial = rows.mapInArrow(_counted_words, "stem boolean, word string, toxic long, other long")
    both = partial.groupBy("stem", "word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    both = stored(both.coalesce(FILES), "words")
    counted = both.filter("not stem").drop("stem")
    in_docs = both.filter(F.col("stem") & (F.col("toxic") >= STEM_DOCS)).select("word")
    share = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("other") + 1)
    evidence = F.col("toxic") * F.log(share / prior)

    def telling(df: DataFrame, least: float = EVIDENCE) -> DataFrame:
        found = df.withColumn("evidence", evidence).filter((F.col("evidence") >= least) & (share >= PRECISION))
        return found.orderBy(F.desc("evidence"), "word")

    starts = counted.filter(F.length("word") > STEM).select(
        F.explode(F.sequence(F.lit(STEM), F.least(F.length("word") - 1, F.lit(LONGEST)))).alias("n"), "word", "toxic", "other"
    )
    starts = starts.select(F.substring("word", F.lit(1), F.col("n")).alias("word"), "toxic", "other")
    starts = starts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.count("*").alias("forms"))
    longest = LONGEST - STEM + 1
    starts = telling(starts.filter(F.col("forms") >= FORMS).join(in_docs, "word"), STEM_EVIDENCE)
    found = {r.word: (r.toxic, r.other) for r in starts.limit(LEXICON * longest).collect()}
    # Of the beginnings one inside the other, the shortest; as long as it can be with the same documents.
    stems: list[str] = []
    for stem in sorted(found):
        if not any(stem[:n] in found for n in range(STEM, len(stem))):
            longer = [s for s in found if s.startswith(stem) and found[s] == found[stem]]
            stems.append(max(longer, key=len))
    stems = sorted(stems, key=lambda s: (-found[s][0], s))[:LEXICON]
    words = [r.word for r in telling(counted).limit(LEXICON).collect()]
    words = [w for w in words if not any(w.startswith(s) for s in stems)][: LEXICON - len(stems)]
    draft = Lexicon(words, stems, [])

    def near(batches):
        automaton = Automaton(draft.words, draft.stems)
        for batch in batches:
            yield batch.filter(pa.array([bool(automaton.errors(w.as_py())) for w in batch.column(0)], pa.bool_()))

    misread = counted.mapInArrow(near, counted.schema).filter((F.col("other") > 0) & (share < 0.5))
    exceptions = misread.orderBy(F.desc("other"), "word").limit(LEXICON).collect()
    return Lexicon(words, stems, [r.word for r in exceptions])


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The documents with the columns FEATURES, ``n_matches`` and ``n_quoted``, which their names must not hold yet."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    added = [*[(f, "double") for f in FEATURES], ("n_matches", "long"), ("n_quoted", "long")]
    schema = docs.withColumns({name: F.lit(None).cast(kind) for name, kind in added}).schema
    at = docs.columns.index(text)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            rows = [(*f, n, q) for f, n, q in (document_features(t.as_py(), matcher) for t in batch.column(at))]
            columns = list(zip(*rows, strict=True)) or [()] * len(added)
            new = [pa.array(c, pa.float64() if kind == "double" else pa.int64()) for c, (_, kind) in zip(columns, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[n for n, _ in added]])

    return docs.mapInArrow(run, schema)


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    bias: float

    def score(self) -> Column:
        total = F.lit(self.bias)
        for name, w in zip(FEATURES, self.weights, strict=True):
            total = total + F.col(name) * w
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_rows: int = MAX_TRAIN) -> Model:
    """Lexicon and weights learned from the labelled documents for which ``train`` holds."""
    rows = training_rows(docs, labels, train, max_rows)
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, n = counts.get(1, 0), sum(counts.values())
    if toxic in (0, n):
        chance = (toxic + 1) / (n + 2)
        return Model(Lexicon([], [], []), [0.0] * len(FEATURES), math.log(chance / (1 - chance)))
    # Imported here, so that the workers of the scoring tasks do not carry it.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    lexicon = learn_lexicon(rows, toxic, n)
    features = with_features(rows, lexicon).select("toxic", *FEATURES)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(features).select(F.col("toxic").cast("double").alias("label"), F.col("v").alias("features"))
    vectors = vectors.persist()
    learned = LogisticRegression(regParam=1e-3, maxIter=60).fit(vectors)
    vectors.unpersist()
    return Model(lexicon, [float(w) for w in learned.coefficients], float(learned.intercept))


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fifth that is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches and n_quoted for every document."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    scored = with_features(docs.select("doc_id", "text"), model.lexicon).withColumn("score", model.score())
    predicted = (F.col("score") >= PREDICT_AT).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "n_matches", "n_quoted")
