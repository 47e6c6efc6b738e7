"""The whole corpus encoded with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.common import write_shared
from pathloom.llm.lexicon import Lexicon, compile_words

#: Fixed value: how the vocabulary's texts are cut into words before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words counted for the lexicon. It needn't cut as WORDS does: what the lexicon lacks is merged.
COUNTED = r" ?\p{L}+"
#: Most words in the lexicon, and its longest word in bytes.
LEXICON_WORDS, LEXICON_BYTES = 65_536, 64
#: Words kept by a task beside the lexicon.
MEMO_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a line per token, base64 of its bytes and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: again and again the leftmost pair of the lowest rank is merged. n log n, also for very long words."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    start, end, prev = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != k:
            continue
        end[i] = k
        alive[j] = False
        if k < n:
            prev[k] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[start[i] : end[i]]])
        i = end[i]
    return out


def frequent_words(texts: DataFrame, text: str, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts (counted over the whole corpus), at most `limit` of them; ties by the word."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(COUNTED), F.lit(0))).alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 and octet_length(w) <= {LEXICON_BYTES}")
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(limit).collect()]


def share(spark: SparkSession, content: bytes, kind: str) -> str:
    """Put a file into the shared folder, have executors fetch it; its name among SparkFiles. Lost executors fetch it again."""
    path = write_shared(spark, content, kind)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _encode(vocabulary: str, lexicon: str, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = read_ranks(SparkFiles.get(vocabulary)), Lexicon(SparkFiles.get(lexicon))
        cut = regex.compile(WORDS).findall
        memo: dict[str, list[int]] = {}

        def ids_of(word: str) -> list[int]:
            # a lone surrogate can't come from valid UTF-8; it would be encoded as Python does
            raw = word.encode("utf-8", "surrogatepass")
            ids = known.get(raw)
            if ids is None:
                ids = merge(raw, ranks)
            if len(memo) < MEMO_WORDS and len(raw) <= LEXICON_BYTES:
                memo[word] = ids
            return ids

        for batch in batches:
            values, offsets = [], [0]
            for text in batch.column(keep).to_pylist():
                for word in cut(text or ""):
                    ids = memo.get(word)
                    values.extend(ids_of(word) if ids is None else ids)
                offsets.append(len(values))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], lists], names=[*batch.schema.names[:keep], "ids"])

    return run


def encode_corpus(documents: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """key and ids (array<int>) of every row: its text encoded by the vocabulary file, without special tokens.

    Defined cases: null and empty texts give an empty list; texts of white space only have their tokens; special tokens' strings
    in a text are ordinary text; a null key is kept; repeated rows stay repeated; an empty table gives an empty
    result; other columns are ignored. Texts are encoded whole, whatever their length.

    Method: the corpus's frequent words with their ids form a minimal acyclic transducer (see lexicon), which tasks map into
    memory from a shared file; any other word is merged exactly. Two passes over the texts: one in the JVM to count
    words, one in Python to encode; nothing but word counts is shuffled. Executors fetch the vocabulary, too, from the shared folder.
    """
    ranks = read_ranks(vocabulary)
    words = sorted({w.encode("utf-8") for w in frequent_words(documents, text)})
    name = share(documents.sparkSession, compile_words((w, tuple(merge(w, ranks))) for w in words), "lexicon")
    rows = documents.select(F.col(key), F.col(text))
    kind = documents.schema[key].dataType.simpleString()
    with open(vocabulary, "rb") as f:
        ranks_file = share(documents.sparkSession, f.read(), "vocabulary")
    return rows.mapInArrow(_encode(ranks_file, name, 1), f"`{key}` {kind}, ids array<int>")
