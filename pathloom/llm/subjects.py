"""Subject areas of documents: seeded non-negative factors of the term matrix of their sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.common import written
from pathloom.llm.sentences import Words, terms_of
from pathloom.llm.words import words_of

#: Terms in fewer sentences, or in a smaller share of all sentences, are not in the matrix. A sentence has a few dozen terms, so no
#: corpus has more than a few dozen / LEAST_RATE terms in it.
LEAST_COUNT, LEAST_RATE = 4, 4e-6
#: Labelled documents used for the seeds at most (in the order of a hash of their key).
LABELLED = 20_000
#: What a subject's title or scope adds to the counts of its words.
SCOPE_WEIGHT = 2.0
#: Sentences (of labels: documents) that say as much of a term as what is usual.
FEW = 2
#: In how many labelled documents a term must stand for its labels to count half; what labels count beside the corpus then.
TRUSTED, ANCHOR = 8, 1.0
#: Alternating passes at most; they end when no component's terms move by more than SETTLED of its weight. Updates of the mixtures in a pass.
PASSES, SETTLED, INNER = 6, 0.02, 8
#: A sentence is about a subject if so much of its terms is explained by it, and it explains this share of what all subjects do.
ABOUT_TERMS, ABOUT_SHARE = 1.5, 0.6
#: A document has a subject if so much of its sentences is about it; below RARE a subject is only touched on.
QUARTER, RARE = 0.25, 0.2
#: Terms that mark a remark in passing: this share of the subject sentences they stand in (at least REMARKS of them) is about a subject
#: that their document (of at least LONG sentences) only touches on.
REMARK_SHARE, REMARKS, LONG = 0.6, 15, 5
#: Characters of texts that make one block of the matrix, about; terms of one block of a factor; parts of a sum added up in one group.
BLOCK_CHARS, BLOCK, FAN_IN = 4 << 20, 65536, 32
#: Distinct terms a task counts before it hands them on.
COUNTED = 1 << 21

_MATRIX = "docs array<{}>, doc_rows binary, row_terms binary, cols binary, distinct binary, counts binary"


def _matrix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of the matrix with a numbering of terms of their own."""
    words = Words()

    def block(keys: list, texts: list[str]) -> pd.DataFrame:
        nonlocal words
        if len(words) > words.REMEMBERED:
            words = Words()
        w, row, doc = words.sentences(texts)
        distinct, rows, cols = words.terms(w, row)
        # sentences in the order of documents, which come without gaps
        docs, doc_rows = np.unique(doc, return_counts=True)
        order = np.argsort(doc, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = place[rows]
        cols = cols[np.argsort(rows, kind="stable")]
        out = [doc_rows.astype(np.int32), np.bincount(rows, minlength=len(doc)).astype(np.int32), cols.astype(np.int32), distinct, np.bincount(cols, minlength=len(distinct)).astype(np.int32)]
        return pd.DataFrame([[[keys[d] for d in docs], *[x.tobytes() for x in out]]], columns=["docs", "doc_rows", "row_terms", "cols", "distinct", "counts"])

    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch["doc"], batch["text"]):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield block(keys, texts)
                keys, texts, size = [], [], 0
    if keys:
        yield block(keys, texts)


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many sentences of a task's blocks each term stands."""
    terms, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        t, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return t, np.bincount(at, np.concatenate([p[1] for p in parts]), len(t)).astype(np.int64)

    for batch in batches:
        for d, c in zip(batch["distinct"], batch["counts"]):
            terms, counts = merged([(terms, counts), (np.frombuffer(d, np.int64), np.frombuffer(c, np.int32))])
            if len(terms) > COUNTED:
                yield pd.DataFrame({"t": terms, "n": counts})
                terms, counts = terms[:0], counts[:0]
    yield pd.DataFrame({"t": terms, "n": counts})


@dataclass
class Matrix:
    """The sentences of some documents as rows of a sparse 0/1 matrix (entries in the order of rows), with each row's document."""

    rows: np.ndarray
    cols: np.ndarray
    docs: np.ndarray
    keys: list

    @classmethod
    def of(cls, r, hashes: np.ndarray) -> Matrix:  # noqa: ANN001
        """A block with the vocabulary's numbers of terms; terms that aren't in it are left out."""
        distinct, cols = np.frombuffer(r.distinct, np.int64), np.frombuffer(r.cols, np.int32)
        at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
        number = np.where(hashes[at] == distinct, at, -1)[cols]
        row_terms, doc_rows = np.frombuffer(r.row_terms, np.int32), np.frombuffer(r.doc_rows, np.int32)
        known = number >= 0
        return cls(np.repeat(np.arange(len(row_terms)), row_terms)[known], number[known], np.repeat(np.arange(len(doc_rows)), doc_rows), list(r.docs))

    @property
    def n(self) -> int:
        return len(self.docs)


@dataclass
class Components:
    """The factor of terms: each one's subject, its weight in that subject's component (0: none), and its weight in the background."""

    subject: np.ndarray
    inside: np.ndarray
    outside: np.ndarray

    def moved(self, before: Components, k: int) -> float:
        """The largest share of a component's weight that has moved."""
        same = self.subject == before.subject
        gone = np.bincount(before.subject, np.where(same, np.abs(self.inside - before.inside), before.inside), k)
        come = np.bincount(self.subject, np.where(same, 0, self.inside), k)
        return float((gone + come).max()) / 2


def mixtures(m: Matrix, h: Components, k: int, rounds: int = INNER) -> np.ndarray:
    """What each subject explains of each row's terms (rows x subjects), by multiplicative updates for the divergence.

    For given components the mixtures are a convex problem: where the updates begin makes no difference to where they end. Terms that
    only the background has need no updates, they count as explained by it.
    """
    bearing = h.inside[m.cols] > 0
    rows, cols = m.rows[bearing], m.cols[bearing]
    # only subjects of which a row has a term
    keys, place = np.unique(rows * k + h.subject[cols], return_inverse=True)
    of, a, b = keys // k, h.inside[cols], h.outside[cols]
    terms = np.maximum(np.bincount(m.rows, minlength=m.n), 1)
    said, w, rest = np.zeros(len(keys)), np.ones(len(keys)), np.ones(m.n)
    for _ in range(rounds):
        x = w[place] * a
        said = np.bincount(place, x / (x + rest[rows] * b), len(keys))
        w = said / terms[of] + 1e-6
        rest = 1 - np.bincount(of, said, m.n) / terms + 1e-6
    out = np.zeros(m.n * k)
    out[keys] = said
    return out.reshape(m.n, k)


def verdicts(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's strongest subject and whether it is about it."""
    top, most = mass.argmax(axis=1), mass.max(axis=1)
    return top, (most >= ABOUT_TERMS) & (most >= ABOUT_SHARE * mass.sum(axis=1))


def fractions(m: Matrix, top: np.ndarray, about: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of each document's sentences about each subject, and its number of sentences."""
    d = len(m.keys)
    n = np.bincount(m.docs, minlength=d)
    hits = np.bincount(m.docs[about] * k + top[about], minlength=d * k).reshape(d, k)
    return hits / np.maximum(n, 1)[:, None], n


def _summed(blocks: DataFrame, of_block: Callable[[Matrix], np.ndarray], hashes, size: int, fan_in: int = FAN_IN) -> np.ndarray:  # noqa: ANN001
    """The sum of a vector over all blocks. Each task adds up its own blocks and gives what isn't zero, in pieces; the pieces are added up in a tree,
    fan_in parts at a time, so that no group grows with the data."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for r in batch.itertuples():
                total += of_block(Matrix.of(r, hashes.value))
        task = TaskContext.get().partitionId()
        for b in range(0, size, BLOCK):
            part = total[b : b + BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                yield pd.DataFrame({"task": [task], "piece": [b // BLOCK], "at": [at.astype(np.int32).tobytes()], "x": [part[at].tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK)
        group = group.sort_values("task")
        for at, x in zip(group["at"], group["x"]):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(x)
        at = np.flatnonzero(total)
        return pd.DataFrame({"task": [group["task"].iloc[0] // fan_in], "piece": group["piece"].iloc[:1], "at": [at.astype(np.int32).tobytes()], "x": [total[at].tobytes()]})

    kind = "task int, piece int, at binary, x binary"
    n = blocks.rdd.getNumPartitions()
    parts = blocks.mapInPandas(partial, kind)
    while n > 1:
        parts = parts.groupBy("piece", F.floor(F.col("task") / fan_in)).applyInPandas(add, kind)
        n = -(-n // fan_in)
    out = np.zeros(size)
    for r in parts.collect():  # no more than the factor itself
        at = np.frombuffer(r["at"], np.int32) + r["piece"] * BLOCK
        out[at] += np.frombuffer(r["x"])
    return out


def shares(counts: np.ndarray, totals: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Of each term's sentences, the share that is about each subject; of few sentences, rather what is usual."""
    return (counts + FEW * base[:, None]) / (totals + FEW)


def anchored(p: np.ndarray, overall: np.ndarray) -> Components:
    """Components from the shares of each term's sentences that are about each subject: a term belongs to the subject that has most of it, as far as
    it has more than terms of all subjects give it; else to the background."""
    k = len(p)
    best = p.argmax(axis=0)
    top = np.sort(np.vstack([p, np.zeros_like(overall)]), axis=0)
    # as far as the subject is above what terms of all subjects have, and ahead of the next one
    pure = np.clip((top[-1] - np.maximum(0.3, top[-2] + 0.15)) / 0.4, 0, 1)
    inside, outside = pure * overall, (1 - pure) * overall + 1e-3
    return Components(best, inside / np.maximum(np.bincount(best, inside, k), 1e-9)[best], outside / outside.sum())


def subject_areas(
    documents: DataFrame, key: str, text: str, subjects: DataFrame, labels: DataFrame, subject: str = "subject", about: tuple[str, ...] = ("title", "scope"),
    least_count: int = LEAST_COUNT, passes: int = PASSES,
) -> DataFrame:
    """key, subject, fraction (of the document's sentences about it), mixture (its share of what all subjects explain of the document) and sentences, for
    every subject a document has.

    Defined cases: documents with a null or empty text, or without sentences about a subject, have no row; null keys have none; repeated
    documents and labels count once; labels of unknown documents, or of a value that is no subject ('none'), only say
    that no subject is meant; without labels the subjects' own words are the seeds; without subjects or documents
    the result is empty; other columns are ignored. Texts are read whole.

    Method: the matrix has a row per sentence and a column per term (a word or a pair of neighbours; the terms of at least
    least_count sentences of the corpus and LEAST_RATE of all). Seeds from labelled sentences and the subjects' scopes anchor one component per
    subject beside a background. Then, over the whole corpus and until the components settle, the sentences' mixtures are solved for the
    components, and the components for the mixtures: so terms the labels don't know come to the subject they occur with, and terms that only stand in
    labelled documents leave it. The mixtures say what a sentence is about; terms that, over the whole corpus, accompany subjects their documents only
    touch on mark remarks in passing, which don't count. The matrix is written once, in blocks; documents never shuffle; the vocabulary and
    three numbers for each of its terms are all that tasks share.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    names = [r[0] for r in subjects.where(F.col(subject).isNotNull()).select(subject).distinct().orderBy(subject).collect()]
    k = len(names)
    docs = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    result = f"doc {kind}, subject string, fraction double, mixture double, sentences long"
    empty = spark.createDataFrame([], result).withColumnRenamed("doc", key)
    if not k:
        return empty
    blocks = written(docs.mapInPandas(_matrix_rows, _MATRIX.format(kind)))

    sentences = blocks.agg(F.sum(F.octet_length("row_terms"))).first()[0] or 0
    enough = max(least_count, LEAST_RATE * sentences / 4)
    counts = blocks.select("distinct", "counts").mapInPandas(_term_counts, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
    known = counts.where(F.col("n") >= enough).toPandas().sort_values("t")
    v = len(known)
    if not v:
        return empty
    vocabulary, overall = known["t"].to_numpy(np.int64), known["n"].to_numpy(float)
    hashes = spark.sparkContext.broadcast(vocabulary)

    # seeds
    said = labels.select(F.col(key).alias("doc"), F.col(subject).alias("s")).where("doc is not null").groupBy("doc").agg(F.collect_set("s").alias("said"))
    place = {s: i for i, s in enumerate(names)}
    labelled = {r["doc"]: [place[x] for x in r["said"] if x in place] for r in said.orderBy(F.xxhash64("doc")).limit(LABELLED).collect()}
    told = spark.sparkContext.broadcast(labelled)

    def from_labels(m: Matrix) -> np.ndarray:
        y, judged = np.zeros((len(m.keys), k)), np.zeros(len(m.keys), bool)
        for i, d in enumerate(m.keys):
            if (own := told.value.get(d)) is not None:
                judged[i] = True
                y[i, own] = 1 / max(1, len(own))
        out = np.zeros((k + 2, v + 1))
        entries = judged[m.docs[m.rows]]
        of, cols = m.docs[m.rows[entries]], m.cols[entries]
        for j in range(k):
            out[j, :v] = np.bincount(cols, y[of, j], v)
        out[k, :v] = np.bincount(cols, minlength=v)
        out[k + 1, :v] = np.bincount(np.unique(of * v + cols) % v, minlength=v)
        out[:k, v] = y.sum(axis=0)
        out[k, v] = judged.sum()
        return out.ravel()

    sums = _summed(blocks, from_labels, hashes, (k + 2) * (v + 1)).reshape(k + 2, v + 1)
    base = sums[:k, v] / max(1.0, sums[k, v]) if sums[k, v] else np.full(k, 1 / k)
    for r in subjects.select(subject, *about).collect():
        if r[subject] in place:
            for t in {t for a in about for t in terms_of(words_of(r[a]))}:
                at = int(np.searchsorted(vocabulary, t))
                if at < v and vocabulary[at] == t:
                    sums[place[r[subject]], at] += SCOPE_WEIGHT
                    sums[k : k + 2, at] += SCOPE_WEIGHT
    # a document's sentences are no independent evidence: how far a share is believed goes by the documents it is from
    independent = sums[k + 1, :v]
    seeded = shares(sums[:k, :v] * independent / np.maximum(sums[k, :v], 1), independent, base)
    trust = independent / (independent + TRUSTED)
    h = anchored(seeded, overall)

    for done in range(passes + 1):
        now = spark.sparkContext.broadcast(h)

        def explained(m: Matrix, now=now) -> np.ndarray:  # noqa: ANN001
            mass = mixtures(m, now.value, k)
            # terms of subjects in passing
            top, yes = verdicts(mass)
            share, n = fractions(m, top, yes, k)
            judged = yes & (n[m.docs] >= LONG)
            rare = judged & (share[m.docs, top] < RARE)
            marks = [np.bincount(m.cols[x[m.rows]], minlength=v) for x in (judged, rare)]
            # of a sentence that says little about subjects, little is about them
            mass /= np.maximum(mass.sum(axis=1), ABOUT_TERMS)[:, None]
            # what each subject explains of a sentence counts for all its terms
            r, j = np.nonzero(mass > 0.01)
            n = np.bincount(m.rows, minlength=m.n)
            first = np.cumsum(n) - n
            entries = np.repeat(first[r] - np.cumsum(n[r]) + n[r], n[r]) + np.arange(n[r].sum())
            out = np.bincount(np.repeat(j, n[r]) * v + m.cols[entries], np.repeat(mass[r, j], n[r]), k * v)
            return np.concatenate([out, mass.sum(axis=0), *marks])

        sums = _summed(blocks, explained, hashes, k * v + k + 2 * v)
        n_in, n_rare = sums[k * v + k :].reshape(2, v)
        found = shares(sums[: k * v].reshape(k, v), overall, sums[k * v : k * v + k] * 4 / sentences)
        after = anchored((found + ANCHOR * trust * seeded) / (1 + ANCHOR * trust), overall)
        if done == passes or after.moved(h, k) < SETTLED:
            break
        now.unpersist()
        h = after
    # the components whose mixtures would bring back the same, with the marks of the last pass
    marks = spark.sparkContext.broadcast((n_in >= REMARKS) & (n_rare >= REMARK_SHARE * n_in))

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                m = Matrix.of(r, hashes.value)
                mass = mixtures(m, now.value, k)
                top, yes = verdicts(mass)
                yes &= np.bincount(m.rows, marks.value[m.cols], m.n) == 0
                share, n = fractions(m, top, yes, k)
                mix = np.stack([np.bincount(m.docs, mass[:, j], len(m.keys)) for j in range(k)], axis=1)
                mix /= np.maximum(mix.sum(axis=1), 1e-9)[:, None]
                d, j = np.nonzero(share >= QUARTER)
                yield pd.DataFrame({"doc": [m.keys[x] for x in d], "subject": [names[x] for x in j], "fraction": share[d, j], "mixture": mix[d, j], "sentences": n[d]})

    return blocks.mapInPandas(give, result).dropDuplicates(["doc", "subject"]).withColumnRenamed("doc", key)
