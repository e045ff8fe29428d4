"""The wide near-duplicate links against exact Jaccard similarities."""

import random

import pytest

from vellumry.llm import components, minwise, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_copies_go_and_others_stay(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(80, 300))) for _ in range(60)]
    for base in texts[:20]:
        for edits in (1, 2, 3):  # similar copies
            w = base.split()
            for at in rng.sample(range(len(w)), edits):
                w[at] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    for base in texts[20:30]:  # half of the text is another
        w = base.split()
        texts.append(" ".join(w[:len(w) // 2] + rng.choices(vocabulary, k=len(w) // 2)))
    texts += [None, "", "a b", texts[40], texts[40].upper()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    known = [(i, t) for i, t in enumerate(texts) if t]
    for i, a in known:
        for j, b in known:
            if i < j and similarity(a, b) >= 0.87:
                assert not (i in kept and j in kept), (i, j, similarity(a, b))
    for j, b in known:
        if j not in kept:
            assert any(i != j and similarity(a, b) >= 0.7 for i, a in known), j


def test_long_lists_keep_the_original_first(spark, monkeypatch):
    monkeypatch.setattr(minwise, "LIST_ROWS", 8)
    rng = random.Random(22)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=250)
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(len(w)), 3):
            w[at] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(df).collect()] == [0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minwise.links(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_links_are_exact_at_the_limit(spark):
    rng = random.Random(23)
    texts = []
    for base in range(40):  # distinct words, so the last k replaced give (246 - k) / (246 + k)
        w = [f"b{base}x{i}" for i in range(250)]
        rng.shuffle(w)
        texts.append(" ".join(w))
        for k in (27, 28, 34):  # 0.802, 0.796, 0.757
            texts.append(" ".join(w[:250 - k] + [f"r{base}x{k}x{i}" for i in range(k)]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {tuple(sorted(r)) for r in minwise.links(df).collect()}
    for i in range(0, len(texts), 4):
        assert similarity(texts[i], texts[i + 1]) >= 0.8 > similarity(texts[i], texts[i + 2])
        assert any({i, i + 1} <= set(x) for x in found), i
    assert all(similarity(texts[a], texts[b]) >= 0.8 for a, b in found)


def one_list(spark, monkeypatch, rows, texts):
    """Groups by the links of texts that all meet in one list, in order of their ids."""
    monkeypatch.setattr(minwise, "ROWS", 0)
    monkeypatch.setattr(minwise, "BANDS", 1)
    monkeypatch.setattr(minwise, "LIST_ROWS", rows)
    monkeypatch.setattr(minwise, "FURTHER", tuple(range(40)))  # short texts of few shared bytes
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    group = list(range(len(texts)))
    for a, b in minwise.links(df).collect():
        group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return group


def test_parts_of_a_list_meet_all_leaders_before(spark, monkeypatch):
    texts = [" ".join(f"t{n}x{i}" for i in range(100)) for n in range(8)]
    texts += [t + " end" for t in texts]
    assert one_list(spark, monkeypatch, 4, texts) == [*range(8), *range(8)]


def test_a_leader_ties_all_groups_it_reaches(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(s, s + 250)) for s in (0, 100, 25, 75, 50)]
    assert one_list(spark, monkeypatch, 100, texts) == [0] * 5


def chains(rng, count, length):
    """Texts in chains: neighbours are similar, the ends are not, and the order hides it."""
    texts = []
    for n in range(count):
        texts += [" ".join(f"c{n}w{i}" for i in range(s, s + 300)) for s in range(0, 30 * length, 30)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("rows", [6, 16, 200])
def test_lists_of_any_length_lose_no_link(spark, monkeypatch, rows):
    """Against all pairs: parts, further bytes and pairs of blocks give the same groups."""
    texts = chains(random.Random(24), 4, 12)
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and similarity(texts[i], texts[j]) >= 0.8:
                want = [min(want[i], want[j]) if g in (want[i], want[j]) else g for g in want]
    assert len(set(want)) == 4 and one_list(spark, monkeypatch, rows, texts) == want


def test_recall_of_links_against_all_pairs(spark):
    rng = random.Random(25)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=200)
        for k in (0, 1, 2, 3, 4):
            w = list(base)
            for at in rng.sample(range(200), k):
                w[at] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    root = {r.node: r.root for r in components.components(minwise.links(df)).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    assert len(pairs) > 100 and sum(i in root and root[i] == root.get(j) for i, j in pairs) / len(pairs) > 0.99


def test_odd_rows_have_no_links_or_their_own(spark):
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, "a b c d e f"), (3, "g h i j k l"), (4, "g h i j k l m"), (5, "a  b C d E f"), (6, "x " * 200_000), (7, "x " * 200_001)]
    df = spark.createDataFrame([(*r, "k", b"d") for r in rows], "doc_id long, text string, key string, digest binary")
    found = {tuple(sorted(r)) for r in minwise.links(df).collect() if r.a != r.b}
    assert found <= {(3, 4), (6, 7)} and (6, 7) in found
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 6}


def test_lists_that_hold_the_same_texts_are_searched_once(spark):
    rng = random.Random(29)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(30):  # pairs that differ in one word, and texts by themselves
        w = rng.choices(vocabulary, k=200)
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(w[:100] + ["other"] + w[101:])), (3 * k + 2, " ".join(rng.choices(vocabulary, k=150)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = minwise.sketches(df).select("digest", minwise.F.explode("keys").alias("key"))
    every = minwise._shared(made).localCheckpoint()
    assert every.count() > 30 * 20
    assert minwise._distinct_lists(every).count() == 30 * 2
    listed = df.where("doc_id % 3 < 2").select("doc_id")
    near = {r.doc_id for r in minwise._maybe(df, listed).collect()}
    assert near == {r.doc_id for r in listed.collect()}
    assert {frozenset((r.a, r.b)) for r in minwise.links(df).collect()} == {frozenset((3 * k, 3 * k + 1)) for k in range(30)}
