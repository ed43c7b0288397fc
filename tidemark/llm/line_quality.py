"""Quality rules, and a linear-chain conditional random field that marks lines as content or boilerplate.

A document's lines are a sequence. Each has a few features of its form; the field has a weight for each feature and
label, for each step between labels and for the first label. Only whole documents are labelled, so the labels of lines
are latent: the field is fitted by posterior regularisation. In turn, forward-backward (numpy) gives the marginals of
all lines under the present field, pulled no further than needed for most words of a bad document to be boilerplate
and nearly all of a good one's content; then the field follows these marginals by gradient ascent. So a bad document
may have lines of content and a good one a footer, and the step weights are learnt from both. Viterbi decoding marks
the lines; a document is kept if enough of its words are in content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .folds import sample_rows
from .scratch import small_batches

#: Words of a window whose repeats count, fewest words of a document, most repeated words in percent.
REPEAT_WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Share of words in content from which a document is kept.
CONTENT_SHARE = 0.5
#: Documents of either label that the field is fitted on.
FITTED = 1500
#: While fitting: most boilerplate expected in a good document, least in a bad one, as shares of its words.
MOST_IN_GOOD, LEAST_IN_BAD = 0.1, 0.6
#: Lines of a document that is fitted on, half from its beginning and half from its end: what comes to the driver is bounded.
LINES = 200
CONTENT, BOILERPLATE = 0, 1
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWERCASE = np.zeros(256, bool)
_LOWERCASE[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
FEATURES = ("always", "1-2 words", "3-5 words", "6-10 words", "over 25 words", "symbols over 3 %", "symbols over 10 %", "capitals over 30 %", "exclamations over 5 %", "digits over 20 %", "no stop at end", "line repeated", "one word over 15 %", "one word over 40 %", "few lower-case letters", "long words")


@dataclass
class Lines:
    """Lines with a word of a slice, in order."""

    doc: np.ndarray
    words: np.ndarray  # of each line
    number: np.ndarray  # among all lines of its document, from 0
    features: np.ndarray  # (lines, FEATURES) 0 or 1


@dataclass
class Counts:
    """Per document: words, characters in words, symbols, repeated lines, words in repeated windows."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def measure(s: bt.Slice) -> tuple[Counts, Lines]:
    """The base counts of all documents, and their lines."""
    data, n, docs = s.data, len(s.data), s.count
    starts, ends, at = bt.word_spans(s, bt.NOT_SPACE)
    words = np.diff(at)
    doc_of_word = np.repeat(np.arange(docs), words)
    per_doc = lambda mask: bt.tally(mask, s.offsets[:-1], s.offsets[1:])
    # lines: pieces between \n, never across documents
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([s.offsets[:-1], breaks + 1])) if docs else np.zeros(0, np.int64)
    begin = begin[begin < n]
    end = np.append(begin[1:], n) if len(begin) else begin
    end = end - (data[end - 1] == 0x0A) if len(end) else end
    first_word = np.searchsorted(starts, begin)
    in_line = np.append(first_word[1:], len(starts)) - first_word if len(begin) else first_word
    use = in_line > 0
    number = np.arange(len(begin)) - np.searchsorted(begin, s.offsets)[np.searchsorted(s.offsets, begin, "right") - 1]
    number = number[use]
    begin, end, in_line, first_word = begin[use], end[use], in_line[use], first_word[use]
    doc = np.searchsorted(s.offsets, begin, "right") - 1
    # lines equal to an earlier one
    h = bt.span_hashes(data, begin, end)
    order = np.lexsort((np.arange(len(h)), h, doc))
    again = np.zeros(len(h), bool)
    if len(h):
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    shared = again.copy()
    shared[order[:-1]] |= again[order[1:]]
    # windows of words found twice or more
    symbols_of_words = bt.span_hashes(data, starts, ends)
    w = bt.grams(symbols_of_words, REPEAT_WINDOW)
    inside = bt.ragged(at[:-1], np.maximum(words - REPEAT_WINDOW + 1, 0))
    v = w[inside] ^ bt.mix(doc_of_word[inside].astype(np.uint64))
    ranked = np.sort(v)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    repeated = np.zeros(docs, np.int64)
    if len(twice):
        hit = inside[twice[np.minimum(np.searchsorted(twice, v), len(twice) - 1)] == v]
        change = np.zeros(len(starts) + REPEAT_WINDOW + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + REPEAT_WINDOW, -1)
        repeated = np.bincount(doc_of_word[np.cumsum(change)[: len(starts)] > 0], minlength=docs)
    counts = Counts(words, per_doc(((data & 0xC0) != 0x80) & ~bt.SPACE[data]), per_doc(_SYMBOLS[data]), np.bincount(doc[again], minlength=docs), repeated)
    # features of lines
    size = np.maximum(bt.tally((data & 0xC0) != 0x80, begin, end), 1)
    share = lambda mask: bt.tally(mask, begin, end) / size
    line_of_word = np.repeat(np.arange(len(begin)), in_line)
    member = bt.ragged(first_word, in_line)
    pair = np.sort(symbols_of_words[member] ^ bt.mix(line_of_word.astype(np.uint64) << np.uint64(20)))
    most = np.ones(len(begin), np.int64)
    if len(pair):
        key = symbols_of_words[member] ^ bt.mix(line_of_word.astype(np.uint64) << np.uint64(20))
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        times = np.diff(np.append(edge, len(pair)))
        if (times > 1).any():
            values, times = pair[edge][times > 1], times[times > 1]
            where = np.minimum(np.searchsorted(values, key), len(values) - 1)
            same = values[where] == key
            np.maximum.at(most, line_of_word[same], times[where[same]])
    top = np.where(most > 1, most / np.maximum(in_line, 1), 0)
    last = data[ends[first_word + in_line - 1] - 1] if len(begin) else np.zeros(0, np.uint8)
    marks = share(_SYMBOLS[data])
    columns = [
        np.ones(len(begin), bool), in_line <= 2, (in_line >= 3) & (in_line <= 5), (in_line >= 6) & (in_line <= 10), in_line > 25,
        marks > 0.03, marks > 0.1, share(_UPPER[data]) > 0.3, share(data == 0x21) > 0.05, share(_DIGIT[data]) > 0.2,
        ~_STOP[last], shared, (top > 0.15) & (in_line > 5), top > 0.4, share(_LOWERCASE[data] | (data >= 0x80)) < 0.4, size / np.maximum(in_line, 1) > 14,
    ]
    return counts, Lines(doc, in_line, number, np.stack(columns, axis=1).astype(np.float64) if len(begin) else np.zeros((0, len(FEATURES))))


@dataclass
class Field:
    """A linear-chain conditional random field with two labels."""

    emit: np.ndarray  # (FEATURES, 2)
    step: np.ndarray  # (2, 2) from, to
    first: np.ndarray  # (2,)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Most likely labels of one sequence of emission scores (lines, 2)."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = (scores[0] + self.first).tolist()
        back = []
        for x, y in scores[1:].tolist():
            from_a, from_b = a + s00, b + s10
            to_b_a, to_b_b = a + s01, b + s11
            back.append((0 if from_a >= from_b else 1, 0 if to_b_a >= to_b_b else 1))
            a, b = max(from_a, from_b) + x, max(to_b_a, to_b_b) + y
        label = 0 if a >= b else 1
        path = [label]
        for choice in reversed(back):
            label = choice[label]
            path.append(label)
        return path[::-1]


#: Used where no labels are given: forms that are usual in boilerplate count against content.
DEFAULT = Field(np.stack([np.zeros(len(FEATURES)), np.array([-2.0, 0.5, 0.2, 0, -0.5, 1, 2, 2, 2, 1, 0.3, 0.5, 2, 3, 1, 0.5])], axis=1), np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))


class Chains:
    """Sequences of lines, longest first, for passes that take a step in all of them together."""

    def __init__(self, sequences: list[np.ndarray]):
        self.length = np.array([len(x) for x in sequences])
        self.at = np.cumsum(self.length) - self.length
        self.x = np.concatenate(sequences)
        self.alive = [int((self.length > t).sum()) for t in range(int(self.length[0]))]  # the first ones reach place t
        self.owner = np.repeat(np.arange(len(self.length)), self.length)
        self.follow = np.flatnonzero(self.owner[1:] == self.owner[:-1])

    def marginals(self, e: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each line's label, and of the labels of each line and the next, from emission scores."""
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        for t, m in enumerate(self.alive):
            i = self.at[:m] + t
            alpha[i] = e[i] + (first if t == 0 else np.logaddexp(alpha[i - 1][:, :1] + step[0], alpha[i - 1][:, 1:] + step[1]))
        for t in range(len(self.alive) - 2, -1, -1):
            i = self.at[: self.alive[t + 1]] + t
            ahead = e[i + 1] + beta[i + 1]
            beta[i] = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
        end = self.at + self.length - 1
        z = np.logaddexp(alpha[end, 0], alpha[end, 1])[self.owner]
        f = self.follow
        pair = np.exp(alpha[f][:, :, None] + step + (e + beta)[f + 1][:, None, :] - z[f][:, None, None])
        return np.exp(alpha + beta - z[:, None]), pair


def fit(sequences: list[np.ndarray], labels: list[int], words: list[np.ndarray] | None = None, rounds: int = 5, steps: int = 40, rate: float = 0.5, l2: float = 1e-5) -> Field:
    """A field from sequences of lines whose documents have labels; ``words`` counts those of each line (1 each if not given). Classes weigh the same."""
    if len(set(labels)) < 2:
        return DEFAULT
    order = sorted(range(len(labels)), key=lambda i: -len(sequences[i]))
    y = np.array(labels)[order]
    chains = Chains([sequences[i] for i in order])
    size = np.concatenate([words[i] for i in order]).astype(float) if words else np.ones(len(chains.x))
    total = np.bincount(chains.owner, size)
    weight = (0.5 / np.bincount(y)[y] / chains.length)[chains.owner]
    theta = [np.zeros((chains.x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)]
    mean, square, turn = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    # at first a line has its document's label, but not for certain
    q = np.where(y[chains.owner] == BOILERPLATE, 0.9, 0.02)
    truth = np.stack([1 - q, q], axis=1)
    pairs = truth[chains.follow][:, :, None] * truth[chains.follow + 1][:, None, :]
    for r in range(rounds):
        for _ in range(steps):
            turn += 1
            one, two = chains.marginals(chains.x @ theta[0], theta[1], theta[2])
            gap = (truth - one) * weight[:, None]
            slopes = [chains.x.T @ gap - l2 * theta[0], ((pairs - two) * weight[chains.follow][:, None, None]).sum(axis=0) - l2 * theta[1], gap[chains.at].sum(axis=0) - l2 * theta[2]]
            for k in range(3 if r else 1):  # steps are learnt from marginals, not from whole documents' labels
                mean[k] = 0.9 * mean[k] + 0.1 * slopes[k]
                square[k] = 0.99 * square[k] + 0.01 * slopes[k] ** 2
                theta[k] = theta[k] + rate * np.sqrt(1 - 0.99**turn) / (1 - 0.9**turn) * mean[k] / (np.sqrt(square[k]) + 1e-8)
        if r < rounds - 1:
            truth, pairs = _regularised(chains, theta, y, size, total)
    return Field(*theta)


def _regularised(chains: Chains, theta: list[np.ndarray], y: np.ndarray, size: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals nearest to the field's under which every document's expected share of boilerplate is within its bound."""
    e = chains.x @ theta[0]
    low, high = np.where(y == BOILERPLATE, 0.0, -30.0), np.where(y == BOILERPLATE, 30.0, 0.0)
    pull = np.zeros(len(y))  # added to the boilerplate scores of a document; 0 where the bound holds without
    for turn in range(14):
        moved = e.copy()
        moved[:, BOILERPLATE] += pull[chains.owner]
        one, two = chains.marginals(moved, theta[1], theta[2])
        share = np.bincount(chains.owner, one[:, BOILERPLATE] * size) / total
        short = share < np.where(y == BOILERPLATE, LEAST_IN_BAD, MOST_IN_GOOD)
        if turn == 0:
            held = short != (y == BOILERPLATE)
        low, high = np.where(short, pull, low), np.where(short, high, pull)
        pull = np.where(held, 0.0, (low + high) / 2)
    return one, two


def learn(docs: DataFrame, labels: DataFrame, fitted: int = FITTED) -> Field:
    """A field from at most ``fitted`` rows of either label (lowest hashes; of equal rows one), of each at most LINES lines; the default one without both labels."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    texts = sample_rows(docs, known.filter("quality = 1"), fitted, 7).withColumn("y", F.lit(CONTENT)).unionByName(sample_rows(docs, known.filter("quality = 0"), fitted, 7).withColumn("y", F.lit(BOILERPLATE))).select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bt.slices(batch.column(2)):
                _, lines = measure(s)
                cuts = np.searchsorted(lines.doc, np.arange(s.count + 1))
                both_ends = [np.arange(a, b) if b - a <= LINES else np.concatenate([np.arange(a, a + LINES // 2), np.arange(b - LINES // 2, b)]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                raw = [lines.features[i].astype(np.uint8).tobytes() for i in both_ends]
                words = [lines.words[i].astype("<i4").tobytes() for i in both_ends]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.count), batch.column(1).slice(s.first, s.count), pa.array(raw, pa.binary()), pa.array(words, pa.binary())], names=["doc_id", "y", "x", "w"])
        bt.release()

    rows = sorted(texts.mapInArrow(run, "doc_id long, y int, x binary, w binary").collect(), key=lambda r: (r.doc_id, r.y, bytes(r.x), bytes(r.w)))
    rows = [r for r in rows if len(r.x)]
    return fit([np.frombuffer(r.x, np.uint8).reshape(-1, len(FEATURES)).astype(np.float64) for r in rows], [r.y for r in rows], [np.frombuffer(r.w, "<i4") for r in rows])


def rate_quality(docs: DataFrame, field: Field, carry: list[str], share: float = CONTENT_SHARE, only_kept: bool = False) -> DataFrame:
    """row (struct of the ``carry`` columns), the base counts, n_content_words, base_failed, kept, boilerplate (numbers of the lines marked so): one row per document.

    Words are runs of anything but ASCII white space; lines are separated by \\n and those without a word are no part of the
    sequence. base_failed: under 20 words, or over 30 % of them in repeated 8-word windows. kept: not base_failed, and
    at least ``share`` of the words in lines that Viterbi decoding marks as content. A null text has no words and
    fails. Repeated rows are rated alike; an empty table gives an empty one; extra columns matter only if carried.
    A text of any length is labelled whole: it takes about 30 bytes of memory a byte beyond the first megabyte.
    ``only_kept`` leaves out the others.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(field)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("text").cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words"]
    schema = rows.select("row", *(F.lit(0).cast("long").alias(x) for x in names), F.lit(True).alias("base_failed"), F.lit(True).alias("kept"), F.expr("cast(array() as array<int>)").alias("boilerplate")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for s in bt.slices(batch.column(1)):
                counts, lines = measure(s)
                scores = lines.features @ field.emit
                cuts = np.searchsorted(lines.doc, np.arange(s.count + 1)).tolist()
                failed = (counts.n_words < LEAST_WORDS) | (100 * counts.n_repeat_words > MOST_REPEATED * counts.n_words)
                content, marked = np.zeros(s.count, np.int64), []
                for d in range(s.count):
                    a, b = cuts[d], cuts[d + 1]
                    labels = np.array(field.viterbi(scores[a:b]) if b > a else [], np.int64)
                    content[d] = lines.words[a:b][labels == CONTENT].sum()
                    marked.append(lines.number[a:b][labels == BOILERPLATE].tolist())
                kept = ~failed & (content >= share * counts.n_words)
                columns = [counts.n_words, counts.word_chars, counts.n_symbols, counts.n_dup_lines, counts.n_repeat_words, content]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.count), *(pa.array(x.astype(np.int64)) for x in columns), pa.array(failed), pa.array(kept), pa.array(marked, pa.list_(pa.int32()))], names=schema.names)
                yield out.filter(pa.array(kept)) if only_kept else out
        bt.release()

    return rows.mapInArrow(run, schema)
