"""Mixes reach their shares within the caps; subjects are told by statements, not mentions; the subpackage stands alone."""

from __future__ import annotations

import pathlib
import random
import re

import numpy as np
import pyarrow as pa

from tests.conftest import rows
from trackloom.llm import mixing, subjects

DOCS, TARGETS = "doc_id bigint, source string, text string", "source string, target_share double, max_repeats int"


def documents(n, seed=1):
    r = random.Random(seed)
    words = {"a": "river tide storm wind", "b": "court judge law clause", "c": "soup bread salt oven"}
    out = []
    for i in range(n):
        s = "a" if r.random() < 0.6 else "b" if r.random() < 0.8 else "c"
        out.append((i, s, " ".join(r.choice(words[s].split()) for _ in range(r.randrange(5, 60)))))
    return out


def test_shares_are_reached_within_the_caps(spark):
    data = documents(800) + [(900, "a", None), (901, "b", ""), (902, None, "x y z"), (903, "other", "x y z"), (904, "a", "long " * 5000)]
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.3, 4)], TARGETS)
    mix = mixing.mixed(spark.createDataFrame(data, DOCS), t)
    got = {r["doc_id"]: r for r in mix.collect()}
    assert len(got) == len(data)
    assert all(got[i]["copies"] == 0 for i in (900, 901, 902, 903))
    cap = {"a": 1, "b": 2, "c": 4}
    assert all(0 <= r["copies"] <= cap.get(r["source"], 0) for r in got.values())
    for r in mixing.shares(mix, t).collect():
        assert abs(r["share"] - r["target_share"]) < 0.01


def test_rates_are_fitted_to_membership(spark):
    """Part of source a speaks like b: the descent must use less of those, and more of b's like, than alike rates would."""
    r = random.Random(7)
    data = documents(1500)
    data = [(i, s, t if s != "a" or i % 3 else " ".join(r.choice("court judge law clause".split()) for _ in range(30))) for i, s, t in data]
    d, t = spark.createDataFrame(data, DOCS), spark.createDataFrame([("a", 0.4, 3), ("b", 0.4, 3), ("c", 0.2, 3)], TARGETS)
    far = lambda mix, c: max(abs(r[c] - r["target_share"]) for r in mixing.shares(mix, t).collect())
    fitted, alike = mixing.mixed(d, t), mixing.mixed(d, t, steps=0)
    assert far(alike, "share") > 0.05 and far(fitted, "share") < 0.01
    assert far(fitted, "expected_share") < 0.03 < far(alike, "expected_share")


def test_membership_takes_both_as_evidence():
    often = np.array([0.5, 0.3, 0.2])
    m = mixing.membership(np.array([[0.4, 0.3, 0.3], [0.001, 0.998, 0.001], [0.2, 0.3, 0.5]]), np.array([0, 0, -1]), often)
    assert m[0, 0] > 0.9 and m[1, 1] > 0.9 and np.allclose(m[2], [0.2, 0.3, 0.5]) and np.allclose(m.sum(1), 1)


def test_targets_that_cannot_be_met_and_nothing_at_all(spark):
    t = spark.createDataFrame([("a", 0.5, 1), ("gone", 0.5, 3)], TARGETS)
    mix = mixing.mixed(spark.createDataFrame(documents(60), DOCS), t)
    assert {r["source"]: round(r["share"], 6) for r in mixing.shares(mix, t).collect()} == {"a": 1.0, "gone": 0.0}
    assert rows(mixing.mixed(spark.createDataFrame([], DOCS), t)) == []
    none = mixing.mixed(spark.createDataFrame(documents(5), DOCS), spark.createDataFrame([], TARGETS))
    assert {r["copies"] for r in none.collect()} == {0}


THINGS = {"law": ["the county judge", "the old lease", "a sworn statement", "the eviction notice paper"], "food": ["the head cook", "a pot of beans", "the soup", "the bread oven door"]}
SAID = {"law": ["was upheld in the ruling", "was struck down on appeal", "lacked a valid signature", "was filed late"], "food": ["simmered for three hours", "was baked that morning", "tasted of smoke", "sold out"]}


def corpus(n, seed=3):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        parts, count = [], {}
        for s in r.choice([["law"], ["food"], ["law", "food"], []]):
            for _ in range(r.randrange(1, 6)):
                parts.append(f"{r.choice(['We heard', 'As noted,', 'Again,'])} {r.choice(THINGS[s])} {r.choice(SAID[s])}{r.choice(['', ' on day 4', ' while we waited'])}.")
                count[s] = count.get(s, 0) + 1
        for _ in range(r.randrange(3)):
            parts.append(f"A poster about {r.choice(THINGS[r.choice(['law', 'food'])])} hung by the door.")
        parts.append("We waited, then went on.")
        r.shuffle(parts)
        docs.append((i, " ".join(parts), "en"))
        truth[i] = {s for s, c in count.items() if c >= 2}
    return docs, truth


def test_statements_count_and_mentions_do_not(spark):
    docs, truth = corpus(900)
    labels = [(i, s.upper() + " " if i % 7 == 0 else s) for i in range(500) for s in truth[i]] + [(10_000, "law"), (3, "no such subject"), (4, None)]
    extra = [(2000, None, "en"), (2001, "", None), (2002, " \n ", "fr"), (2003, "x" * 50_000, "en")]
    got = subjects.assigned(spark.createDataFrame(docs + extra, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), ["law", "food"])
    said = {}
    for r in got.collect():
        said.setdefault(r["doc_id"], set()).add(r["subject"])
    assert not {2000, 2001, 2002, 2003} & said.keys()
    held = range(500, 900)
    right = sum(len(said.get(i, set()) & truth[i]) for i in held)
    assert right / sum(len(said.get(i, set())) for i in held) > 0.95
    assert right / sum(len(truth[i]) for i in held) > 0.95


PHRASES = {
    "garden": ["raised bed", "clay soil", "late frost", "rose pruning", "compost heap", "seed tray", "green manure", "leaf mould", "root rot", "hedge shears", "wild meadow", "bean pole"],
    "stars": ["dark sky", "dwarf star", "red shift", "lunar halo", "solar wind", "deep field", "comet tail", "radio dish", "dust lane", "orbit decay", "star chart", "night glass"],
}
IDLE = ["we sat and talked", "nobody had the key", "it was tuesday again", "the tea went cold", "page nine is torn", "my sister rang twice"]


def prose(n, seed=5):
    """Other prose: a statement strings phrases of its subject together in any order, before or behind what links them."""
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        parts, count = [r.choice(IDLE) for _ in range(r.randrange(1, 5))], {}
        for s in r.choice([["garden"], ["stars"], ["garden", "stars"], []]):
            for _ in range(r.randrange(1, 5)):
                own = r.sample(PHRASES[s], 4)
                parts.append(r.choice([f"{own[0]} {own[1]} near {own[2]} {own[3]}", f"after {own[0]} {own[1]} {own[2]} we saw {own[3]}", f"{own[0]} {own[1]} {own[2]}"]))
                count[s] = count.get(s, 0) + 1
        for _ in range(r.randrange(3)):
            parts.append(f"{r.choice(PHRASES[r.choice(['garden', 'stars'])])} in the crossword clue list")
        r.shuffle(parts)
        docs.append((i, r.choice([". ", "; ", "\n"]).join(parts), "xx"))
        truth[i] = {s for s, c in count.items() if c >= 2}
    return docs, truth


def test_prose_of_another_build(spark):
    docs, truth = prose(900)
    labels = [(i, s) for i in range(500) for s in truth[i]]
    got = subjects.assigned(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), ["garden", "stars"])
    said = {(r["doc_id"], r["subject"]) for r in got.collect() if r["doc_id"] >= 500}
    want = {(i, s) for i in range(500, 900) for s in truth[i]}
    assert len(said & want) > 0.9 * len(want) and len(said & want) > 0.9 * len(said)


def test_every_tied_term_is_kept(spark):
    text = " ".join(f"w{k}" for k in range(4_100))
    sample = spark.createDataFrame([(text, [0])] * 3 + [("nothing of the kind", [1])] * 3, "text string, own array<int>")
    terms, seed, weight = subjects._learned(sample, 2)
    tied = {f"w{k} w{k + 1}" for k in range(4_099) if (k + 1) % subjects.LONGEST}
    assert tied <= set(terms) and len(terms) == len(seed) == len(weight)


def test_encoding_cuts_where_clauses_do():
    texts = ["The judge was here, and the judge left.", "x " * 300, "", None, "left. the judge", "Ha\u0301 judge was here"]
    lexicon = subjects.Lexicon(["the judge", "judge was", "was here", "judge left", "x x"])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6), pa.int64()), "text": pa.array(texts, pa.string())})
    got = {d: ids for b in lexicon.encode(iter([batch])) for d, ids in zip(b["doc_id"].to_pylist(), b["ids"].to_pylist(), strict=True)}
    split = lambda ids: [sorted(int(i) for i in part.split()) for part in " ".join(map(str, ids)).split("-1")]
    assert split(got[0]) == [[0, 1, 2], [0, 3]] and split(got[4]) == [[0]] and split(got[5]) == [[1, 2]]
    assert split(got[1]) == [[4]] * 5  # 300 words are five clauses
    assert got.keys() == {0, 1, 4, 5}


def test_leading_vectors_are_those_of_the_matrix():
    r = np.random.default_rng(3)
    a = r.normal(size=(60, 40)) * np.geomspace(1, 0.01, 40)
    g = a @ a.T
    i, j = np.nonzero(np.triu(np.ones((60, 60))))
    v = subjects.leading(i, j, g[i, j], 60, 5)
    true = np.linalg.eigh(g)[1][:, ::-1][:, :5]
    assert np.allclose(np.linalg.svd(true.T @ v)[1], 1, atol=1e-3)


def test_frequent_pairs_elsewhere_do_not_push_out_terms(spark):
    docs, truth = corpus(300)
    filler = [(5000 + i, " ".join(f"w{k}" for k in range(100)), "en") for i in range(400)]
    labels = [(i, s) for i in range(300) for s in truth[i]]
    got = subjects.assigned(spark.createDataFrame(docs + filler, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), ["law", "food"])
    said = {(r["doc_id"], r["subject"]) for r in got.collect()}
    want = {(i, s) for i in truth for s in truth[i]}
    assert len(said & want) > 0.95 * max(len(said), len(want))


def test_without_labels_or_texts(spark):
    d = spark.createDataFrame([(1, "the judge was here", "en")], "doc_id bigint, text string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    assert rows(subjects.assigned(d, none, ["law"])) == []
    assert rows(subjects.assigned(d.limit(0), none, ["law"])) == []


def test_nothing_outside_imports_the_subpackage():
    root = pathlib.Path(__file__).parents[2]
    for p in (root / "trackloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(?:from|import) trackloom\.llm|from trackloom import .*\bllm\b", p.read_text()), p
