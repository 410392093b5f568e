"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The corpus' words are counted over all documents; the most frequent are encoded once and compiled into a minimal acyclic
transducer: a shared-suffix automaton over bytes whose arcs carry numbers that add up to the word's place in a table of
id lists. Its arrays are one file that Spark hands to every executor, memory-mapped by each worker. A word that the
automaton does not hold is merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom import shared

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pattern by which this vocabulary parts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words compiled into the automaton, and the longest of them in bytes; both bound its size.
WORDS, WORD_BYTES = 65_536, 64
#: Words remembered by one worker before it forgets them.
REMEMBERED = 400_000


def ranks(tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary's pieces with their ids, which are their merge ranks."""
    with open(os.path.join(tokenizers, vocabulary + ".tiktoken"), "rb") as f:
        return {base64.b64decode(piece): int(number) for piece, number in (line.split() for line in f if line.strip())}


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one word: of all neighbours that form a piece, those of the lowest rank, leftmost first, are joined until
    none is left. A queue of pairs keeps very long words near n log n."""
    if word in rank:
        return [rank[word]]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(queue)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := rank.get(whole := parts[i] + parts[j])) is not None:
            heapq.heappush(queue, (r, i, whole))

    while queue:
        _, i, whole = heapq.heappop(queue)
        if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != len(whole) or parts[i] + parts[j] != whole:
            continue  # one side has been joined since
        parts[i], parts[j] = whole, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [rank[p] for p in parts if p is not None]


class Automaton:
    """A minimal acyclic transducer from words (bytes) to id lists, over arrays that may be memory-mapped."""

    FIELDS = ("first", "label", "target", "skip", "final", "ids_at", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.first, self.label, self.target, self.skip, self.final, self.ids_at, self.ids = (arrays[f] for f in self.FIELDS)

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Automaton:
        """By adding the words in order and sharing each finished suffix with an equal state made before."""
        order = sorted(words)
        # a state under construction: [is final, {label: state}]; a finished one is a number in `states`
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]
        last = b""

        def finish(down_to: int) -> None:
            while len(path) > down_to + 1:
                state = path.pop()
                shape = (state[0], tuple(sorted(state[1].items())))
                if shape not in known:
                    known[shape] = len(states)
                    states.append(shape)
                path[-1][1][last[len(path) - 1]] = known[shape]

        for w in order:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            finish(same)
            for b in w[same:]:
                path.append([False, {}])
            path[-1][0] = True
            last = w
        finish(0)
        states.append((path[0][0], tuple(sorted(path[0][1].items()))))
        count: list[int] = []  # words that each state accepts; states come after those they lead to
        first, label, target, skip, final = [0], [], [], [], []
        for is_final, arcs in states:
            total = int(is_final)
            for b, s in arcs:
                label.append(b)
                target.append(s)
                skip.append(total)
                total += count[s]
            count.append(total)
            first.append(len(label))
            final.append(is_final)
        lists = [words[w] for w in order]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        ids = np.fromiter((i for x in lists for i in x), np.int32, int(at[-1]))
        return cls(dict(zip(cls.FIELDS, (np.array(first, np.int32), np.array(label, np.uint8), np.array(target, np.int32), np.array(skip, np.int32), np.array(final, np.bool_), at, ids), strict=True)))

    def save(self, path: str) -> None:
        with open(path, "wb") as out:
            out.write(self.packed())

    def packed(self) -> bytes:
        """A line of JSON with each array's kind, length and place, then the arrays."""
        head, at = {}, 0
        for f in self.FIELDS:
            a = self.arrays[f]
            head[f] = (a.dtype.str, len(a), at)
            at += -(-a.nbytes // 8) * 8
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 1) % 8) + b"\n"
        raws = [self.arrays[f].tobytes() for f in self.FIELDS]
        return text + b"".join(raw + b"\0" * (-len(raw) % 8) for raw in raws)

    @classmethod
    def open(cls, path: str) -> Automaton:
        with open(path, "rb") as f:
            text = f.readline()
        whole = np.memmap(path, np.uint8, "r")
        body = whole[len(text) :]
        return cls({f: body[at : at + n * np.dtype(kind).itemsize].view(kind) for f, (kind, n, at) in json.loads(text).items()})

    def find(self, word: bytes) -> list[int] | None:
        state, number = len(self.final) - 1, 0
        first, label, target, skip = self.first, self.label, self.target, self.skip
        for b in word:
            lo, hi = int(first[state]), int(first[state + 1])
            i = lo + int(label[lo:hi].searchsorted(b))
            if i == hi or label[i] != b:
                return None
            number += int(skip[i])
            state = int(target[i])
        if not self.final[state]:
            return None
        return self.ids[int(self.ids_at[number]) : int(self.ids_at[number + 1])].tolist()


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, seen = regex.compile(PATTERN).findall, Counter()

    def out() -> pa.RecordBatch:
        words = [w for w in seen if len(w) <= WORD_BYTES]
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([seen[w] for w in words], pa.int64())})

    for b in batches:
        for text in _texts(b["text"]):
            seen.update(find(text))
        if len(seen) > REMEMBERED:
            yield out()
            seen.clear()
    yield out()


def frequent_words(texts: DataFrame, most: int = WORDS) -> DataFrame:
    """word, n: the `most` most frequent words over all texts (ties by the word), none over WORD_BYTES bytes."""
    counts = texts.select("text").filter("text is not null").mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("n"), "word").limit(most)


_OPEN: dict[str, tuple[Automaton, dict]] = {}


def _encoder(name: str, rank: Broadcast) -> Callable[[str], list[int]]:
    """What encodes a text, with the automaton of that file; one for each worker process."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = (Automaton.open(SparkFiles.get(name)), {})
    automaton, memory = _OPEN[name]

    def encode(word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        found = automaton.find(raw)
        if found is None:
            found = merge(raw, rank.value)
        if len(memory) >= REMEMBERED:
            memory.clear()
        if len(raw) <= 4 * WORD_BYTES:
            memory[word] = found
        return found

    def whole(text: str) -> list[int]:
        ids: list[int] = []
        get, add = memory.get, ids.extend
        for w in split(text):
            known = get(w)
            add(known if known is not None else encode(w))
        return ids

    split = regex.compile(PATTERN).findall
    return whole


def lexicon(texts: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[str, Broadcast]:
    """Compiles the frequent words of all texts; the name under which every executor has the file, and the vocabulary's ranks
    (a fixed table), which a worker fetches when it meets a word that is not in it."""
    spark = texts.sparkSession
    rank = ranks(tokenizers, vocabulary)
    words = [r["word"].encode() for r in frequent_words(texts).collect()]  # at most WORDS of WORD_BYTES bytes
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = f"{shared.scratch(spark, 'lexicon')}/{name}"
    shared.write_bytes(spark, path, Automaton.compile({w: merge(w, rank) for w in words}).packed())
    spark.sparkContext.addFile(path)
    return name, spark.sparkContext.broadcast(rank)


def encoded(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents(doc_id, text) to doc_id, ids: the vocabulary's ids of the whole text, without special tokens.

    A null or empty text has no ids: an empty list, not null. Strings that look like special tokens are ordinary text.
    Repeated rows come out repeated; further columns are left out.
    """
    docs = documents.select("doc_id", "text")
    name, rank = lexicon(docs, tokenizers, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _encoder(name, rank)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = [np.array(whole(t), np.int32) for t in _texts(part["text"])]
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists], ["doc_id", "ids"])

    return docs.mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents to their rows with n_tokens (int; 0 for a null or empty text) added."""
    name, rank = lexicon(documents.select("text"), tokenizers, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _encoder(name, rank)
        for b in batches:
            n = pa.array([len(whole(t)) for t in _texts(b["text"])], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, "n_tokens"])

    kept = documents.drop("n_tokens")
    return kept.mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_tokens int")
