"""A mix of documents in which each source holds its target share of all tokens.

Membership is soft. A classifier trained on a bounded sample of the labelled table gives every document its posteriors
over the sources; the source noted for it is evidence as well, which may be wrong with a rate of NOISE (Bayes' rule): a
text that plainly speaks like another source counts for that one. Least squares by projected gradient then fits rates of
the documents, never negative and never above the cap of their source, whose expected tokens by membership and actual
tokens by noted source both meet the targets. The rates begin alike for all documents. Each step is one pass that adds up a
few numbers per pair of sources, by which the step is scaled; the rates that stand at the end are rounded to whole copies,
so that within each source the tokens lost and gained cancel. What the mix then holds, by source and by membership, is
reported by `shares`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom import shared
from trackloom.llm import tokens

#: Labelled rows the classifier is fitted on, and hashed features it has.
SAMPLE, FEATURES = 20_000, 1 << 14
#: Rate at which a noted source is taken to be wrong.
NOISE = 0.1
#: Steps of the descent at most; it ends when no share is missed by more than MISS, or the miss no longer falls by a part
#: of LESS in a step.
STEPS, MISS, LESS = 40, 1e-4, 0.02
#: What an expected total weighs against one by noted source.
EXPECTED = 0.2
#: Documents rounded together.
BLOCK = 4_096
_PART = re.compile(r"\n|[^\W\d_]+|\d+|[^\w\s]+|_+")


class _Features:
    """Places of a text's features among the hashed ones: its distinct words and signs (numbers by their length), and what
    stands beside signs and at the beginning of lines."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        out, last, place = set(), "^", self.place
        for w in _PART.findall((text or "").lower()):
            if w == "\n":
                last = "^"
                continue
            if w[0].isdigit():
                w = "0" * min(len(w), 4)
            out.add(w)
            if last == "^" or not w.isalpha() or not last[-1].isalnum():
                out.add(f"{last} {w}")
            last = w
        if len(place) > 400_000:
            place.clear()
        for w in out:
            if w not in place:
                place[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES
        return np.unique(np.fromiter((place[w] for w in out), np.int64, len(out)))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = _Features()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["source"], b["h"], pa.array([features(t.as_py()).astype(np.int32) for t in b["text"]], pa.list_(pa.int32()))], ["source", "h", "features"])


def fit_classifier(sample: list[tuple[np.ndarray, str]], names: list[str], rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a naive Bayes model of word presence, its evidence scaled so that held-out rows come out with
    the likelihood they deserve."""
    counts, rows = np.ones((len(names), FEATURES)) * 0.1, np.ones(len(names))
    place = {n: i for i, n in enumerate(names)}
    fit, held = sample[: len(sample) * 4 // 5], sample[len(sample) * 4 // 5 :]
    for f, label in fit:
        counts[place[label], f] += 1
        rows[place[label]] += 1
    p = counts / (rows[:, None] + 0.2)
    weights = np.log(p) - np.log(p.mean(0))
    prior = np.log(rows / rows.sum())
    best, scale = -np.inf, 0.0
    seen = [(weights[:, f].sum(1) if len(f) else np.zeros(len(names)), place[label]) for f, label in held]
    for s in (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
        score = 0.0
        for w, y in seen:
            z = prior + s * w
            score += z[y] - (z.max() + np.log(np.exp(z - z.max()).sum()))
        if score > best:
            best, scale = score, s
    return weights * scale, prior


def membership(post: np.ndarray, source: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Posteriors given the text, and the noted source as evidence: documents x sources. source: places, -1 for none; often:
    how frequent each source is."""
    wrong = NOISE * often[np.maximum(source, 0)]
    like = np.repeat(wrong[:, None], post.shape[1], axis=1)
    like[np.arange(len(post)), np.maximum(source, 0)] += 1 - NOISE
    out = np.where((source >= 0)[:, None], post * like, post)
    return out / out.sum(1, keepdims=True)


def mixed(documents: DataFrame, targets: DataFrame, tokenizers: str = tokens.TOKENIZERS, steps: int = STEPS) -> DataFrame:
    """documents(doc_id, source, text) and targets(source, target_share, max_repeats) to doc_id, source, n_tokens, rate,
    copies, membership: how often each document is used, and its membership in the sources of the targets, in order.

    The whole is as large as the targets and caps let it be: the smallest, over the sources, of cap times tokens over
    share. Documents whose source has no target, or a share of 0, get 0 copies, as do texts without tokens (null or
    empty). A target whose source has no tokens cannot be met: the others then share its part. Targets may not repeat a source.
    """
    spark = documents.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0").orderBy("source").collect()  # one row a source
    names = [r["source"] for r in rows]
    if len(set(names)) != len(names):
        raise ValueError("a source has two targets")
    counted = tokens.token_counts(documents.select("doc_id", "source", "text"), tokenizers)
    nothing = [F.lit(0.0).alias("rate"), F.lit(0).alias("copies"), F.array().cast("array<double>").alias("membership")]
    if not names:
        return counted.select("doc_id", "source", "n_tokens", *nothing)
    labelled = documents.filter(F.col("source").isin(names) & (F.length("text") > 0)).withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    n = labelled.count()
    some = labelled if n <= 2 * SAMPLE else labelled.filter(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * 2 * SAMPLE / n) + 1)
    taken = some.select("text", "source", "h").mapInArrow(_sample_features, "source string, h bigint, features array<int>").orderBy("h").limit(SAMPLE).toArrow()
    sample = [(f.values.to_numpy(), s.as_py()) for s, f in zip(taken["source"], taken["features"], strict=True)]
    weights, prior = fit_classifier(sample, names)
    place = {n: i for i, n in enumerate(names)}
    often = np.exp(prior) / np.exp(prior).sum()
    shape = spark.sparkContext.broadcast((np.ascontiguousarray(weights.T), prior))  # FEATURES x sources

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shape.value
        features = _Features()
        for x in batches:
            if not x.num_rows:
                continue
            z = np.tile(b, (x.num_rows, 1))
            for i, t in enumerate(x["text"]):
                f = features(t.as_py())
                if len(f):
                    z[i] += w[f].sum(0)
            e = np.exp(z - z.max(1, keepdims=True))
            source = np.array([place.get(s, -1) for s in x["source"].to_pylist()], np.int64)
            m = membership(e / e.sum(1, keepdims=True), source, often)
            off = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["source"], x["n_tokens"], pa.ListArray.from_arrays(off, pa.array(m.ravel()))], ["doc_id", "source", "n_tokens", "post"])

    docs = shared.stored(counted.mapInArrow(judge, "doc_id bigint, source string, n_tokens int, post array<double>"), "posteriors")
    share = np.array([r["target_share"] for r in rows], float)
    cap = np.array([r["max_repeats"] for r in rows], float)
    held = {r["source"]: float(r["n"]) for r in docs.filter(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    have = np.array([held.get(n, 0.0) for n in names])
    share = np.where(have > 0, share, 0)
    if not share.any():
        return docs.select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"), F.col("post").alias("membership"))
    share /= share.sum()
    total = float(np.min(np.where(share > 0, cap * have / np.where(share > 0, share, 1), np.inf)))
    return _fitted(docs, names, np.where(share > 0, cap, 0), share * total, total, have, steps).rounded(docs)


def _fitted(docs: DataFrame, names: list[str], cap: np.ndarray, goal: np.ndarray, total: float, have: np.ndarray, steps: int) -> _Rates:
    """Rates by projected gradient: each step moves along the rows of the totals, scaled by their products over the documents
    that are not at a bound."""
    rates = _Rates(names, cap, total / max(have[cap > 0].sum(), 1.0))
    target, weigh = np.concatenate([goal, goal]) / total, np.concatenate([np.full(len(goal), EXPECTED), np.ones(len(goal))])
    best = np.inf
    for _ in range(steps):
        totals, power = rates.totals(docs)
        miss = target - totals / total
        size = float(np.sqrt((weigh**2 * miss**2).sum()))
        if np.abs(miss).max() <= MISS or size > best * (1 - LESS):
            if size >= best:
                rates.moves.pop()  # the last step made it no better
            break
        best = size
        h = power / total
        ridge = 1e-4 * max(np.trace(h) / len(h), 1e-12)
        rates.moves.append(np.linalg.solve(h + np.diag(ridge / weigh**2), miss))
    return rates


class _Rates:
    """Rates of documents as a function of what the descent did so far: every worker recomputes them from the moves."""

    def __init__(self, names: list[str], cap: np.ndarray, start: float):
        self.names, self.cap, self.start, self.moves = names, cap, start, []

    def of(self, source: np.ndarray, post: np.ndarray) -> np.ndarray:
        """source: places among the names, -1 for others; post: documents x sources."""
        k = len(self.names)
        at = np.maximum(source, 0)
        cap = np.where(source >= 0, self.cap[at], 0)
        r = np.minimum(self.start, cap)
        for m in self.moves:
            r = np.clip(r + post @ m[:k] + m[k:][at], 0, cap)
        return r

    def _read(self, b: pa.RecordBatch, post: str = "post") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = {n: i for i, n in enumerate(self.names)}
        source = np.array([place.get(s, -1) for s in b["source"].to_pylist()], np.int64)
        return source, b[post].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.names)), b["n_tokens"].to_numpy(zero_copy_only=False).astype(float)

    def totals(self, docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by membership and by noted source, and the products of these rows over the documents free to move."""
        k = len(self.names)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, power = np.zeros(2 * k), np.zeros((2 * k, 2 * k))
            for b in batches:
                source, post, n = self._read(b)
                ok = source >= 0
                source, post, n = source[ok], post[ok], n[ok]
                r, cap = self.of(source, post), self.cap[source]
                row = np.zeros((len(source), 2 * k))
                row[:, :k] = post
                row[np.arange(len(source)), k + source] = 1
                total += (r * n) @ row
                free = (n > 0) & (r > 0) & (r < cap) if self.moves else n > 0
                power += row[free].T @ (row[free] * n[free, None])
            yield pa.RecordBatch.from_pydict({"i": np.arange(2 * k + 4 * k * k), "x": np.concatenate([total, power.ravel()])})

        got = {r["i"]: r["x"] for r in docs.mapInArrow(add, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}  # pairs of sources
        flat = np.array([got.get(i, 0.0) for i in range(2 * k + 4 * k * k)])
        return flat[: 2 * k], flat[2 * k :].reshape(2 * k, 2 * k)

    def rounded(self, docs: DataFrame) -> DataFrame:
        """Whole copies: within blocks of a source, the long documents first, each document takes what keeps the tokens used so
        far nearest to the sum of the rates so far. A large source has as many blocks as it needs."""
        cap = dict(zip(self.names, self.cap.tolist(), strict=True))

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                source, post, _ = self._read(b)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], b["n_tokens"], pa.array(self.of(source, post)), b["post"]], ["doc_id", "source", "n_tokens", "rate", "membership"])

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, owed = None, 0.0
            for b in batches:
                copies = []
                for s, k, n, r in zip(b["source"].to_pylist(), b["block"].to_pylist(), b["n_tokens"].to_pylist(), b["rate"].to_pylist(), strict=True):
                    if (s, k) != block:
                        block, owed = (s, k), 0.0
                    owed += r * n
                    c = 0 if not n or not r else int(min(max(round(owed / n), int(r)), -(-r // 1), cap.get(s, 0)))
                    owed -= c * n
                    copies.append(c)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], b["n_tokens"], b["rate"], pa.array(copies, pa.int32()), b["membership"]], ["doc_id", "source", "n_tokens", "rate", "copies", "membership"])

        blocks = docs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        h = F.xxhash64("doc_id", F.lit(29))
        rated = docs.mapInArrow(rate, "doc_id bigint, source string, n_tokens int, rate double, membership array<double>").join(F.broadcast(blocks.filter(F.col("source").isin(self.names))), "source", "left")
        spread = rated.withColumn("block", F.coalesce(F.pmod(h, F.col("blocks")), F.pmod(h, F.lit(1024)))).repartition("source", "block").sortWithinPartitions("source", "block", F.desc("n_tokens"), h, "doc_id")
        return spread.select("doc_id", "source", "n_tokens", "rate", "block", "membership").mapInArrow(settle, "doc_id bigint, source string, n_tokens int, rate double, copies int, membership array<double>")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, documents, tokens, used_tokens, share, expected_share: what each source of the targets holds of
    the mix, by noted source and by membership, whose difference from the target is what the mix misses."""
    names = [r["source"] for r in targets.select("source").filter("source is not null and target_share > 0 and max_repeats > 0").orderBy("source").collect()]  # one row a source
    used = F.col("n_tokens").cast("bigint") * F.col("copies")
    own = mix.groupBy("source").agg(F.sum((F.col("copies") > 0).cast("bigint")).alias("documents"), F.sum("n_tokens").cast("bigint").alias("tokens"), F.sum(used).alias("used_tokens"))
    by = mix.filter("copies > 0").agg(F.sum(used).alias("whole"), *[F.sum(used * F.get("membership", F.lit(i))).alias(f"m{i}") for i in range(len(names))])
    none = F.array().cast("array<struct<source: string, member: double>>")
    member = by.select("whole", F.explode_outer(F.array(*[F.struct(F.lit(n).alias("source"), F.col(f"m{i}").alias("member")) for i, n in enumerate(names)]) if names else none).alias("e")).select("whole", "e.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    part = lambda c: F.coalesce(F.col(c) / F.col("whole"), F.lit(0.0))
    joined = targets.select("source", "target_share").join(own, "source", "left").join(F.broadcast(member), "source", "left")
    return joined.select("source", "target_share", zero("documents"), zero("tokens"), zero("used_tokens"), part("used_tokens").alias("share"), part("member").alias("expected_share"))
