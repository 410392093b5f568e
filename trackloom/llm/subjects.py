"""Subject areas of documents: term weighting, truncated singular value decomposition, seed centroids refined iteratively.

The row of the matrix is a clause, not a document: a document may have several subjects, and one of them only in passing.
The terms of a clause are its pairs of neighbouring words. A bounded sample of labelled documents tells which terms are
tied to a subject, and which belong to remarks: in clauses that hold a remark's term, the terms of a subject do not go
with the document's labels ("where someone mentioned the ..."). Both kinds are weighted by that and by how rare they are.
The clauses of all documents, at length one, are cut to their leading singular vectors; the centroids of the subjects and
the one of remarks begin at their seed terms, and are refined over all clauses until they stand still. Each clause belongs
to the centroid nearest by cosine, if that is near enough. A clause of a subject with terms enough is a statement about it,
and a document has the subjects it makes at least STATEMENTS statements about.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom import shared

#: Statements about a subject that make it one of the document's, and the tied terms a clause needs to be one.
STATEMENTS, TERMS = 2, 3
#: Labelled documents the ties are learned on, and what a tie takes: of the way from how frequent the subject is at all to
#: always, how far a term's labelled documents must go, and their number. A remark's term is one whose clauses go less than
#: REMARK of the way from chance to always with the labels.
SAMPLE, SHARE, SEEN, REMARK = 50_000, 0.5, 3, 0.5
#: Singular vectors, passes of the power iteration, least cosine of a clause to its centroid, and the rounds of refinement:
#: they end when no centroid moves by more than STILL.
RANK, PASSES, LEAST_COS, ROUNDS, STILL = 256, 5, 0.05, 12, 1e-3
#: Words after which a clause ends at the latest.
LONGEST = 64
#: Characters of text taken apart at a time, and terms counted before they are handed on.
CHUNK, REMEMBERED = 1_000_000, 300_000
#: The words that join clauses of one rank, in English, Spanish and French.
JOINING = ("and", "but", "or", "y", "e", "o", "pero", "et", "mais", "ou")
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*|[.!?;\n,:()\[\]{}\"<>|]")
_PLAIN = re.compile(r"[a-z0-9]+(?:['-][a-z0-9]+)*|[.!?;\n,:()\[\]{}\"<>|]")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_BREAK = frozenset('.!?;\n,:()[]{}"<>|') | frozenset(JOINING)


class _Bare(dict):
    """Characters beyond ASCII, by code: letters without accents, quotes as the plain ones, other signs as blanks; what
    cannot be seen is nothing."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)):
            if not unicodedata.combining(c) and unicodedata.category(c) != "Cf":
                out += c if c.isascii() or c.isalnum() else "'" if c == "’" else '"' if c in "“”«»" else " "
        self[code] = out
        return out


_BARE = _Bare()


def words(text: str) -> list[str]:
    """Words in lower case without accents, and the marks that end clauses; what cannot be seen is left out."""
    t = text.lower()
    if not t.isascii():
        t = _OTHER.sub(lambda m: m[0].translate(_BARE), t)
    return (_PLAIN if t.isascii() else _WORD).findall(t)


def clauses(text: str) -> list[list[str]]:
    """The words of each clause, those of two words at least."""
    out, own = [], []
    for w in words(text):
        if w in _BREAK or len(own) == LONGEST:
            if len(own) > 1:
                out.append(own)
            own = []
        if w not in _BREAK:
            own.append(w)
    if len(own) > 1:
        out.append(own)
    return out


def _terms(clause: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(clause, clause[1:], strict=False)}


def _count_terms(kinds: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, own) to the labelled documents of each term: how many, and how many of each subject."""
        seen: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            n = np.stack(list(seen.values())) if seen else np.empty((0, kinds + 1), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(c) for c in n.T)], ["term", "n", *(f"s{i}" for i in range(kinds))])

        for b in batches:
            for text, own in zip(b["text"], b["own"].to_pylist(), strict=True):
                add = np.zeros(kinds + 1, np.int64)
                add[[0, *(i + 1 for i in own)]] = 1
                for t in set().union(*map(_terms, clauses(text.as_py() or ""))):
                    if t in seen:
                        seen[t] += add
                    else:
                        seen[t] = add.copy()
                if len(seen) > REMEMBERED:
                    yield out()
                    seen.clear()
        yield out()

    return count


def _count_remarks(tied: dict[str, int], base: list[float]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, own) to the clauses of each untied term that hold a subject's terms: how many, in how many of them the subject
        is among the document's labels, and in how many it would be by chance. Null stands for all terms."""
        seen: Counter = Counter()
        right: Counter = Counter()
        chance: Counter = Counter()
        for b in batches:
            for text, own in zip(b["text"], b["own"].to_pylist(), strict=True):
                for c in clauses(text.as_py() or ""):
                    terms = _terms(c)
                    about = Counter(tied[t] for t in terms if t in tied)
                    if about:
                        rest = [t for t in terms if t not in tied]
                        subject = min(about, key=lambda s: (-about[s], s))
                        seen.update(rest)
                        chance.update(dict.fromkeys(rest, base[subject]))
                        if subject in own:
                            right.update(rest)
        names: list = [*seen, None]
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array(names, pa.string()),
                "n": pa.array([*seen.values(), sum(seen.values())], pa.int64()),
                "m": pa.array([*(right[t] for t in seen), sum(right.values())], pa.int64()),
                "e": pa.array([*(chance[t] for t in seen), sum(chance.values())], pa.float64()),
            }
        )

    return count


class Lexicon:
    """Numbers of terms by the numbers of their words."""

    def __init__(self, terms: list[str]):
        pairs = [t.split(" ") for t in terms]
        self.word = {w: i + 1 for i, w in enumerate(sorted({w for p in pairs for w in p}))}
        self.size = len(self.word) + 2
        code = np.array([self.word[a] * self.size + self.word[b] for a, b in pairs], np.int64)
        self.order = np.argsort(code)
        self.code = code[self.order]
        self.word.update(dict.fromkeys(_BREAK, self.size - 1))

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) to (doc_id, ids): the terms' numbers, -1 between clauses; documents without terms go."""
        for b in batches:
            begin, chars = 0, 0
            texts = b["text"]
            for i in range(b.num_rows):
                chars += len(texts[i].as_py() or "")
                if chars > CHUNK or i == b.num_rows - 1:
                    yield self._encoded(b["doc_id"].slice(begin, i + 1 - begin), texts.slice(begin, i + 1 - begin))
                    begin, chars = i + 1, 0

    def _encoded(self, docs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        end, get = self.size - 1, self.word.get
        flat: list[int] = []
        size = []
        for t in texts:
            own = [get(w, 0) for w in words(t.as_py() or "")]
            flat += own
            flat.append(end)
            size.append(len(own) + 1)
        w = np.array(flat, np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        stop = w == end
        # places since the last mark; a clause is cut behind LONGEST of them
        at = np.arange(len(w))
        since = at - np.maximum.accumulate(np.where(stop, at, -1)) if len(w) else at
        piece = np.cumsum(stop | ((since - 1) % LONGEST == 0))
        code = w[:-1] * self.size + w[1:]
        ok = (w[:-1] > 0) & (w[1:] > 0) & ~stop[:-1] & ~stop[1:] & (piece[:-1] == piece[1:]) if len(w) else np.empty(0, bool)
        place = np.searchsorted(self.code, code[ok])
        hit = self.code[np.minimum(place, len(self.code) - 1)] == code[ok]
        where = np.flatnonzero(ok)[hit]
        ids, doc, piece = self.order[place[hit]], doc[where], piece[where]
        key, once = np.unique(piece * len(self.code) + ids, return_index=True)
        ids, doc, piece = key % len(self.code), doc[once], piece[once]
        # a mark before each clause but a document's first
        new = np.flatnonzero(np.diff(piece) != 0) + 1
        new = new[doc[new] == doc[new - 1]] if len(new) else new
        ids, doc = np.insert(ids, new, -1), np.insert(doc, new, doc[new] if len(new) else [])
        some, n = np.unique(doc, return_counts=True)
        off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([docs.take(pa.array(some)), pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])


class _Clauses:
    """The clauses of a batch of encoded documents: for each term its clause, and for each clause its document's row."""

    def __init__(self, b: pa.RecordBatch, weight: np.ndarray):
        off = b["ids"].offsets.to_numpy()
        flat = b["ids"].flatten().to_numpy(zero_copy_only=False)
        new = flat < 0
        first = np.zeros(len(flat), bool)
        first[(off[:-1] - off[0])[np.diff(off) > 0]] = True
        clause = np.cumsum(new | first) - 1
        self.term, self.of = flat[~new].astype(np.int64), clause[~new]
        self.n = int(clause[-1]) + 1 if len(flat) else 0
        self.begin = np.searchsorted(self.of, np.arange(self.n))
        row = np.repeat(np.arange(b.num_rows), np.diff(off))[~new]
        self.row = row[self.begin] if self.n else row
        w = weight[self.term]
        self.value = w / np.sqrt(np.bincount(self.of, w**2, self.n))[self.of]

    def nearest(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each clause, and its cosine; near: terms x centroids, the cosines of the terms."""
        if not self.n:
            return np.empty(0, np.int64), np.empty(0)
        cos = np.add.reduceat(near[self.term] * self.value[:, None], self.begin, axis=0)
        best = cos.argmax(1)
        return best, cos[np.arange(self.n), best]


def _gram(weight: np.ndarray):
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The products of the values of each two terms of a clause, added up by pair of terms (i <= j)."""
        size = np.int64(len(weight))
        for b in batches:
            c = _Clauses(b, weight)
            n = np.diff(np.append(c.begin, len(c.term)))
            later = np.repeat(c.begin + n, n) - np.arange(len(c.term))  # of the clause, from the term on
            left = np.repeat(np.arange(len(c.term)), later)
            right = left + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
            i, j = c.term[left], c.term[right]
            key, at = np.unique(np.minimum(i, j) * size + np.maximum(i, j), return_inverse=True)
            x = np.bincount(at, c.value[left] * c.value[right], len(key))
            yield pa.RecordBatch.from_pydict({"i": key // size, "j": key % size, "x": x})

    return gram


def leading(i: np.ndarray, j: np.ndarray, x: np.ndarray, size: int, rank: int) -> np.ndarray:
    """The leading eigenvectors of a symmetric matrix (its entries with i <= j), by power iteration on a random block."""
    other = i != j
    i, j, x = np.concatenate([i, j[other]]), np.concatenate([j, i[other]]), np.concatenate([x, x[other]])
    order = np.argsort(i, kind="stable")
    i, j, x = i[order], j[order], x[order]

    def times(q: np.ndarray) -> np.ndarray:
        out = np.zeros_like(q)
        for s in range(0, len(i), 20_000):
            a = i[s : s + 20_000]
            begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            out[a[begin]] += np.add.reduceat(q[j[s : s + 20_000]] * x[s : s + 20_000, None], begin, axis=0)
        return out

    q = np.linalg.qr(np.random.default_rng(11).normal(size=(size, min(rank + 16, size))))[0]
    for _ in range(PASSES):
        q = np.linalg.qr(times(q))[0]
    small = q.T @ times(q)
    turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :rank]
    return q @ turn


def _assigned_sums(weight: np.ndarray, near: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The values of the terms of the clauses of each centroid, added up: centroid, term, x."""
        total = np.zeros(near.shape)
        for b in batches:
            c = _Clauses(b, weight)
            best, cos = c.nearest(near)
            own = np.where(cos >= LEAST_COS, best, -1)[c.of]
            ok = own >= 0
            total += np.bincount(c.term[ok] * near.shape[1] + own[ok], c.value[ok], near.size).reshape(near.shape)
        t, s = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"s": pa.array(s, pa.int32()), "t": pa.array(t, pa.int32()), "x": total[t, s]})

    return add


def _statements(weight: np.ndarray, near: np.ndarray, is_tied: np.ndarray, names: list[str]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = len(names)
        for b in batches:
            c = _Clauses(b, weight)
            best, cos = c.nearest(near)
            ok = (cos >= LEAST_COS) & (best < kinds) & (np.bincount(c.of, is_tied[c.term], c.n) >= TERMS)
            key, n = np.unique(c.row[ok] * kinds + best[ok], return_counts=True)
            key, n = key[n >= STATEMENTS], n[n >= STATEMENTS]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(key // kinds)), pa.array(names, pa.string()).take(pa.array(key % kinds)), pa.array(n.astype(np.int64))], ["doc_id", "subject", "statements"])

    return judge


def _learned(sample: DataFrame, kinds: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """From labelled documents (text, own): terms, the subject each is tied to (`kinds` for remarks), and their weights."""
    facts = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.array_contains("own", i).cast("bigint")).alias(f"s{i}") for i in range(kinds)]).first()
    docs = facts["n"]
    if not docs:
        return [], np.empty(0, np.int64), np.empty(0)
    base = [facts[f"s{i}"] / docs for i in range(kinds)]
    cols = [f"s{i}" for i in range(kinds)]
    counts = sample.mapInArrow(_count_terms(kinds), "term string, n bigint, " + ", ".join(f"{c} bigint" for c in cols)).groupBy("term").agg(*[F.sum(c).alias(c) for c in ["n", *cols]]).filter(F.col("n") >= SEEN)
    best = F.greatest(*[F.struct(((F.col(c) + 2 * p) / (F.col("n") + 2)).alias("share"), F.lit(-i).alias("s"), F.lit(p + SHARE * (1 - p)).alias("least")) for i, (c, p) in enumerate(zip(cols, base, strict=True))])
    found = counts.select("term", "n", best.alias("b")).filter(F.col("b.share") >= F.col("b.least")).select("term", "n", "b.share", (-F.col("b.s")).alias("s")).orderBy("term").collect()  # terms of the sample
    tied = {r["term"]: r["s"] for r in found}
    seed = [r["s"] for r in found]
    weight = [max(2 * r["share"] - 1, 0.05) * max(np.log(docs / r["n"]), 0.5) for r in found]
    told = shared.stored(sample.mapInArrow(_count_remarks(tied, base), "term string, n bigint, m bigint, e double").groupBy("term").agg(*[F.sum(c).alias(c) for c in "nme"]), "remarks")
    whole = told.filter("term is null").first()
    usual = (whole["m"] - whole["e"]) / (whole["n"] - whole["e"]) if whole and whole["n"] > whole["e"] else 1.0
    # of the way from chance to always
    share = F.greatest((F.col("m") - F.col("e") + 2 * usual) / (F.col("n") - F.col("e") + 2), F.lit(0.0))
    remarks = told.filter(F.col("term").isNotNull() & (F.col("n") >= SEEN) & (share < REMARK)).select("term", "n", share.alias("share")).orderBy("term").collect()  # terms of the sample
    seed += [kinds] * len(remarks)
    weight += [(1 - r["share"]) * max(np.log(docs / r["n"]), 0.5) for r in remarks]
    return [*tied, *(r["term"] for r in remarks)], np.array(seed, np.int64), np.array(weight)


def assigned(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """documents(doc_id, text) and labels(doc_id, subject) to doc_id, subject, statements: each subject about which a
    document makes at least STATEMENTS statements.

    Labels are compared in lower case without outer blanks; those that are no subject, and labels of documents that do not
    exist, count for nothing. Null and empty texts have no subject. Without labels nothing is assigned.
    """
    spark = documents.sparkSession
    names = sorted(subjects)
    schema = "doc_id bigint, subject string, statements bigint"
    docs = documents.select("doc_id", "text").filter("text is not null and text <> ''")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(F.btrim("subject"))) - 1
    own = labels.select("doc_id", place.cast("int").alias("s")).filter("s >= 0").groupBy("doc_id").agg(F.collect_set("s").alias("own"))  # at most len(names) each
    chosen = own.orderBy(F.xxhash64("doc_id", F.lit(3))).limit(SAMPLE)
    sample = shared.stored(docs.join(F.broadcast(chosen), "doc_id").select("text", "own"), "labelled")
    terms, seed, weight = _learned(sample, len(names))
    if not terms:
        return spark.createDataFrame([], schema)
    ids = shared.stored(docs.mapInArrow(Lexicon(terms).encode, "doc_id bigint, ids array<int>"), "clauses")
    # pairs of the sample's terms: their number is bounded by the sample, not by the documents
    gram = ids.mapInArrow(_gram(weight), "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    if not gram.num_rows:
        return spark.createDataFrame([], schema)
    vectors = leading(gram["i"].to_numpy(), gram["j"].to_numpy(), gram["x"].to_numpy(), len(terms), min(RANK, len(terms)))
    centres = _unit(np.stack([(vectors[seed == s] * weight[seed == s, None]).sum(0) for s in range(len(names) + 1)]))
    for _ in range(ROUNDS):
        sums = np.zeros((len(centres), len(terms)))
        for r in ids.mapInArrow(_assigned_sums(weight, vectors @ centres.T), "s int, t int, x double").groupBy("s", "t").agg(F.sum("x").alias("x")).toLocalIterator():  # centroids x terms
            sums[r["s"], r["t"]] = r["x"]
        now = sums @ vectors
        now = _unit(np.where(np.abs(now).max(1, keepdims=True) > 0, now, centres))
        moved = np.linalg.norm(now - centres, axis=1).max()
        centres = now
        if moved <= STILL:
            break
    return ids.mapInArrow(_statements(weight, vectors @ centres.T, (seed < len(names)).astype(float), names), schema)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
