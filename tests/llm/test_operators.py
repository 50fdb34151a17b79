"""The operators against brute force on small tables, and on rows that are null, empty, repeated or clash."""

import hashlib
import itertools
import math
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from moraine.llm import common, components, fingerprints, html_text, katz, langid, linking, mixing, near_dup, packing, quality, setsketch, substring_dup, topk, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCS)


def prose(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names."""
    base = prose(1, 60)
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, None), (3, None, "en", "a"), (4, "", "de", "b"), (None, base + " more", "en", "a"), (None, None, None, None),
        (5, " \t\n ", "en", "b"), (6, "one", "en", "b"), (6, "two words", "fr", "b"), (7, prose(2, 30_000), "en", "a"), (8, "é漢 \U0001f600 ñ", "fr", "c"), (9, base.upper(), "en", "c"),
    ]
    extra = {c: F.lit("mine") for c in ("score", "size", "kept", "predicted", "row", "h1", "quota", "id", "component", "part")}
    return docs(spark, rows).withColumns(extra)


EMPTY = [None]


def shingle_set(text, n):
    w = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def links_of(texts, n):
    sets = {k: shingle_set(t, n) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: root(k) for k in sets}, {k: len(s) for k, s in sets.items()}


def near_texts():
    r, out = random.Random(3), {}
    for g in range(12):
        base = prose(g, r.choice([3, 8, 40, 200]), 5000).split()
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            out[len(out)] = " ".join(w)
    # A chain: each is near the next, the ends are not near.
    chain = prose(99, 200, 5000).split()
    for k in range(8):
        chain[k * 20 : k * 20 + 9] = [f"c{k}_{j}" for j in range(9)]
        out[len(out)] = " ".join(chain)
    return out


@pytest.mark.parametrize("length", [4, 5])
def test_near_duplicates_equal_brute_force(spark, length):
    texts = near_texts()
    found = near_dup.near_duplicates(docs(spark, [(k, t, None, None) for k, t in texts.items()]), length=length).collect()
    component, sizes = links_of(texts, length)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in found} == {k: (component[k], sizes[k]) for k in texts}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_awkward_rows(awkward):
    got = near_dup.near_duplicates(awkward).collect()
    assert len(got) == 13
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 4), (None, None), (5, 5), (6, 6), (7, 7), (8, 8), (9, 1)}
    kept = near_dup.one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 3, 4, 5, 6, 6, 7, 8]


def test_rest_of_a_bucket_is_settled_exactly(spark):
    """A pivot that nothing is near: the others still find each other."""
    sets = {1: range(0, 100), 2: range(50, 150), 3: range(52, 152), 4: range(300, 400), 5: range(301, 401)}
    buckets = spark.createDataFrame([(7, i, 100) for i in sets], "key long, id long, size long")
    known = spark.createDataFrame([(i, list(s), [7]) for i, s in sets.items()], "id long, hashes array<long>, keys array<long>")
    none = lambda pairs: pairs.where("1 = 0")
    got = linking.connect(buckets, none, lambda ids: known.join(ids, "id", "left_semi"), 80).collect()
    assert {(r.id, r.component) for r in got} == {(2, 2), (3, 2), (4, 4), (5, 4)}


@pytest.mark.parametrize("in_one_task", [0, 10**6])
def test_components(spark, in_one_task):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(3, 3), (None, 4)]
    got = {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long"), in_one_task).collect()}
    neighbours = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            neighbours[a].add(b), neighbours[b].add(a)
    expected = {}
    for start in sorted(neighbours):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in expected:
                expected[x] = start
                stack += neighbours[x]
    assert got == expected


def test_setsketch_merges_and_estimates():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:]
    x, y, union = (setsketch.registers(np.sort(s), np.array([0, len(s)])) for s in (a, b, pool))
    assert (setsketch.merged(x, y) == union).all()
    assert abs(setsketch.likely_jaccard(x, y, np.array([2000]), np.array([2000]))[0] - 1 / 3) < 0.15
    assert not setsketch.registers(np.zeros(0, np.uint64), np.array([0, 0])).any()


def test_mixing(spark):
    r = random.Random(2)
    rows = [(k, prose(k, r.randrange(0, 60)), None, s) for k, s in enumerate(["a"] * 80 + ["b"] * 40 + ["c"] * 3 + [None] * 20)]
    first = mixing.mix(docs(spark, rows), shard_words=300).collect()
    size, taken, target = Counter(), Counter(), {}
    for x in first:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert 0 <= x.taken <= 3 * x.size
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    capped, expected = set(), {}
    while True:  # share, cap, share what is over
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in weight if s not in capped)
        expected = {s: 3.0 * size[s] if s in capped else left * weight[s] / free for s in weight}
        over = {s for s in weight if expected[s] > 3 * size[s] and s not in capped}
        if not over:
            break
        capped |= over
    for s in weight:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= max(8, 0.02 * target[s])
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3), shard_words=300).collect()
    assert sorted((x.doc_id, x.taken) for x in first) == sorted((x.doc_id, x.taken) for x in again)


def test_apportionment_is_highest_quotients(spark):
    r = random.Random(4)
    rows = [(g, k, float(r.randrange(0, 500)), r.randrange(0, 40)) for g in range(6) for k in range(r.randrange(1, 12))]
    # A group whose rows reach their room at one level.
    rows = [x for x in rows if x[0] != 5] + [(5, k, 10.0 * (k + 1), 15 * (k + 1)) for k in range(4)]
    frame = spark.createDataFrame(rows, "g int, k int, votes double, room long")
    got = {(x.g, x.k): x.quota for x in mixing.apportion(frame, F.col("votes"), F.lit(60).cast("long"), F.col("room"), ["g"], ["k"]).collect()}
    for g in range(6):
        own = [(k, v, room) for h, k, v, room in rows if h == g]
        quota = Counter()
        for _ in range(60):
            free = [(v / (2 * quota[k] + 1), -k) for k, v, room in own if quota[k] < room and v > 0]
            if not free:
                break
            quota[-max(free)[1]] += 1
        assert {k: got[g, k] for k, _, _ in own} == {k: quota[k] for k, _, _ in own}


def test_words_taken_are_a_run_of_blocks(spark):
    """A source of one shard: the mix takes the run that a simulation word by word takes."""
    rows = [(k, prose(k, (k * 7) % 23), None, s) for k, s in enumerate(["a"] * 60 + ["b"] * 5)]
    frame = docs(spark, rows)
    got = {x.doc_id: x for x in mixing.mix(frame, shard_words=10**6).collect()}
    order = frame.select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")).alias("place")).collect()
    place = {x.doc_id: x.place for x in order}
    size = {s: sum(got[i].size for i, _, _, g in rows if g == s) for s in "ab"}
    block = max(1, min(64, min(size.values()) // 64))
    # b can take three times its size, a the rest; blocks by highest quotients.
    target, quota = {s: got[next(i for i, _, _, g in rows if g == s)].target for s in "ab"}, Counter()
    for _ in range(round(sum(size.values()) / block)):
        free = [(target[s] / (2 * quota[s] + 1), -ord(s), s) for s in "ab" if quota[s] < 3 * size[s] // block]
        quota[max(free)[2]] += 1
    for s in "ab":
        owner = [i for i in sorted((i for i, _, _, g in rows if g == s), key=lambda i: (place[i], i)) for _ in range(got[i].size)]
        first = spark.range(1).select(F.pmod(F.xxhash64(F.lit(19), F.lit("0" + s), F.lit(0).cast("long")), F.lit(len(owner)).cast("long"))).first()[0]
        taken = Counter(owner[(first + k) % len(owner)] for k in range(quota[s] * block))
        assert {i: got[i].taken for i, _, _, g in rows if g == s} == {i: taken[i] for i, _, _, g in rows if g == s}


def test_mixing_of_awkward_rows(awkward):
    got = mixing.mix(awkward).collect()
    count = lambda t: len((t or "").split())
    want = Counter((x.doc_id, x.source, count(x.text)) for x in awkward.collect())
    assert Counter((x.doc_id, x.source, x.size) for x in got) == want and all(0 <= x.taken <= 3 * x.size for x in got)
    total = Counter()
    for (_, s, n), k in want.items():
        total[s] += n * k
    assert all(x.source_size == total[x.source] for x in got) and sum({x.source: x.target for x in got}.values()) == pytest.approx(sum(total.values()))
    assert mixing.repeated(awkward).columns == awkward.columns
    assert mixing.mix(awkward.limit(0)).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rows = [(k * 3, prose(k, n, 2000), None, None) for k, n in enumerate([400, 7, 3, 0, 1500, 90, 200])] + [(100, None, None, None)]
    texts = [t or "" for _, t, _, _ in rows]
    got = {x.doc_id: x for x in fingerprints.fingerprints(docs(spark, rows)).collect()}
    for k, (i, _, _, _) in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        x = got[i]
        assert x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (shingle_set(t, 5) for t in (text, edited, following))
        assert abs(x.near_edited - jaccard(a, b)) < 0.16 and abs(x.near_next - jaccard(a, c)) < 0.16


def test_ids_of_many_rows_are_split(spark):
    """Half the rows have one id and a quarter have none: the next document is still found, and no range holds most rows."""
    rows = [(None if k % 4 == 0 else 7 if k % 4 < 3 else k, prose(k, 12, 400), None, None) for k in range(400)]
    frame = docs(spark, rows)
    hashes = {x.text: x.h for x in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i is not None, i or 0, hashes[t]), i, t) for i, t, _, _ in rows)
    want = Counter()
    for (_, i, text), (_, _, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        want[i, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.edited_sha256) for x in fingerprints.fingerprints(frame).collect()) == want
    part = fingerprints.range_buckets(frame, "doc_id", F.xxhash64("text"), 16)
    sizes = [x["n"] for x in frame.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 70 and len(sizes) >= 12


def test_sketches_merge_and_count(spark):
    text = prose(8, 3000, 10**6)
    left, right = " ".join(text.split()[:1500]), " ".join(text.split()[1496:])
    row = spark.createDataFrame([(text, left, right)], "t string, l string, r string")
    t, l, r = (fingerprints.sketch(F.col(c)) for c in "tlr")
    got = row.select((t == fingerprints.merge(l, r)).alias("same"), fingerprints.distinct_shingles(t).alias("n"), fingerprints.containment(l, t).alias("c"), fingerprints.resemblance(l, t).alias("j")).first()
    assert got.same and abs(got.n / 2996 - 1) < 0.35 and got.c > 0.7 and abs(got.j - 0.5) < 0.15


def test_sketches_are_the_least_hashes(spark):
    """Against shingles as rows: hash each, keep the distinct ones, sort, take the first k."""
    texts = [prose(1, 700, 900), prose(2, 130), "a b c d", "", " x\t\ny ", prose(3, 40) + " " + prose(3, 40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    word = frame.select("id", F.posexplode(F.split("text", fingerprints.SPACES)).alias("at", "w")).where("w != ''").withColumn("h", F.xxhash64("w"))
    order = Window.partitionBy("id").orderBy("at")
    row = word.select("id", F.count("*").over(Window.partitionBy("id")).alias("n"), *(F.lead("h", j).over(order).alias(f"h{j}") for j in range(5)), F.row_number().over(order).alias("place"))
    long = row.where("n >= 5 and h4 is not null").select("id", F.xxhash64(*(f"h{j}" for j in range(5))).alias("s"))
    want = defaultdict(set)
    for x in long.collect():
        want[x.id].add((x.s & (2**64 - 1)) >> (64 - fingerprints.HASH_BITS))
    for x in frame.select("id", fingerprints.sketch(F.col("text")).alias("s"), fingerprints.distinct_shingles(fingerprints.sketch(F.col("text"))).alias("n")).collect():
        words_of = texts[x.id].split()
        if len(words_of) >= 5:
            assert x.s == sorted(want[x.id])[: fingerprints.K] and (len(want[x.id]) >= fingerprints.K or x.n == len(want[x.id]))
        else:
            assert len(x.s) == min(1, len(words_of))


def test_fingerprints_of_awkward_rows(awkward):
    got = fingerprints.fingerprints(awkward).collect()
    assert len(got) == 13 and len({x.fingerprint for x in got if x.doc_id == 1}) == 1
    assert sorted(x.n_chars for x in got) == sorted(len(x.text or "") for x in awkward.collect())
    base = next(x.fingerprint for x in got if x.doc_id == 1)
    assert {x.fingerprint for x in got if x.doc_id in (1, 2)} == {base} and {x.fingerprint for x in got if x.doc_id in (3, 4, 5)} == {""}
    assert all(x.near_edited == 1.0 for x in got if not x.n_chars) and all(0 <= x.near_next <= 1 for x in got)
    assert fingerprints.fingerprints(awkward.limit(0)).count() == 0


def katz_by_brute_force(tokens, trained, order, least):
    """P(w | words before) by the definition, from {id: tokens} and the ids that it learns from; and the histories of the highest order."""
    count = [None] + [Counter() for _ in range(order)]
    for i in trained:
        padded = ["<s>"] * (order - 1) + tokens[i]
        for at in range(order - 1, len(padded)):
            for n in range(1, order + 1):
                count[n][tuple(padded[at - n + 1 : at + 1])] += 1
    history = [None] + [Counter() for _ in range(order)]
    for n in range(1, order + 1):
        for gram, c in count[n].items():
            history[n][gram[:-1]] += c
    follow = [None] + [defaultdict(list) for _ in range(order)]
    for n in range(1, order + 1):
        for gram, c in count[n].items():
            if c >= least[n - 1]:
                follow[n][gram[:-1]].append(gram[-1])
    d = [None] + [katz.discounts([sum(x == r for x in c.values()) for r in range(1, 7)]) for c in count[1:]]
    less = lambda n, c: float(katz.discounted(np.array([c]), d[n])[0])
    total = sum(count[1].values())
    unknown = 1 - sum(less(1, c) for c in count[1].values()) / total

    def p(w, h):
        n = len(h) + 1
        c = count[n][(*h, w)]
        if n == 1:
            return less(1, c) / total if c else unknown
        if c >= least[n - 1]:
            return less(n, c) / history[n][h]
        own = follow[n][h]
        if not own:
            return p(w, h[1:])
        taken = sum(less(n, count[n][(*h, x)]) for x in own) / history[n][h]
        return (1 - taken) / (1 - sum(p(x, h[1:]) for x in own)) * p(w, h[1:])

    return p, count, list(follow[order])


@pytest.mark.parametrize("order,least", [(3, (1, 1, 2)), (3, (1, 1, 1)), (2, (1, 1)), (4, (1, 1, 2, 2)), (1, (1,))])
def test_katz_equals_brute_force(spark, tmp_path, order, least):
    rows = [(k, prose(k % 17, 5 + k % 40, 60), None, None) for k in range(120)] + [(500, None, None, None), (501, "", None, None), (None, "w1 W2", None, None), (502, prose(3, 30, 60) + " never seen w1 w2 w3", None, None)]
    frame = docs(spark, rows)
    found = katz.scores(frame, order, least, tables=str(tmp_path)).collect()
    got = {x.doc_id: x for x in found}
    tokens = {i: (t or "").lower().split() + ["</s>"] for i, t, _, _ in rows}
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in tokens}
    p, count, histories = katz_by_brute_force(tokens, [i for i in tokens if not held[i]], order, least)
    one = Counter({w: c for (w,), c in count[1].items()})
    n, v = sum(one.values()), len(one)
    for h in histories[:20]:
        assert sum(p(w, h) for w in [*one, "?"]) == pytest.approx(1)
    for i, t in tokens.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(t), sum(one[w] > 0 for w in t), n)
        assert x.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t))
        padded = ["<s>"] * (order - 1) + t
        assert x.score == pytest.approx(sum(math.log10(p(padded[k], tuple(padded[k - order + 1 : k]))) for k in range(order - 1, len(padded)))), i
    # The tables give the same scores to texts that the model didn't see before.
    again = katz.scores_from(frame.withColumn("doc_id", F.col("doc_id") + 7000), str(tmp_path)).collect()
    key = lambda x, shift: (-1 if x.doc_id is None else x.doc_id + shift, x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 6))
    assert sorted(key(x, 0) for x in again) == sorted(key(x, 7000) for x in found)


def test_katz_counts_do_not_depend_on_chunks_and_buckets(spark, monkeypatch):
    rows = [(k, prose(k % 17, 5 + k % 40, 60), None, None) for k in range(120)]
    frame = docs(spark, rows).repartition(3)
    want = sorted((x.doc_id, round(x.score, 8)) for x in katz.scores(frame).collect())
    exchange = katz.Exchange(frame, None, 3, (1, 1, 2))
    exchange.facts.bits = 6
    for kinds in katz._steps(3):
        exchange.count(kinds, learn=True)
    exchange.weigh(learn=True)
    assert sorted((x.doc_id, round(x.score, 8)) for x in exchange.score().collect()) == want
    exchange.close()


def test_katz_of_awkward_rows(awkward):
    got = katz.scores(awkward).collect()
    assert len(got) == 13 and len({x.train_tokens for x in got}) == 1
    words_of = lambda t: len((t or "").split()) + 1
    assert sorted(x.n_tokens for x in got) == sorted(words_of(x.text) for x in awkward.collect())
    one = {(x.n_tokens, x.base_score, x.score) for x in got if x.doc_id == 1}
    assert len(one) == 1 and {x.held_out for x in got if x.doc_id is None} == {False}
    empty = [x for x in got if x.doc_id in (3, 4, 5)]
    assert len({x.score for x in empty}) == 1 and all(x.n_tokens == x.n_known == 1 and x.score < 0 for x in empty)
    assert katz.scores(awkward.limit(0)).count() == 0
    untrained = katz.scores(awkward.where("doc_id = 6").withColumn("doc_id", F.lit(3))).collect()
    assert all(katz.in_training(x.doc_id) or x.score == 0 == x.train_tokens for x in untrained)
    assert all(0 < d < 1 for d in katz.discounts([0] * 6)[1:]) and all(0 < d < 1 for d in katz.discounts([9, 1, 7, 0, 2, 5])[1:])


def test_language_id(spark):
    r = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    text = lambda a: " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(30))
    rows = [(k, text(alphabets[g]), g, None) for k, g in enumerate(sorted(alphabets) * 40)] + [(900, None, "aa", None), (901, "123 !", "aa", None), (902, "", None, None)]
    frame = docs(spark, rows)
    got = {x.doc_id: x for x in langid.predict(frame.select("doc_id", "text"), langid.train(frame)).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(got[i].lang_pred == g for i, _, g, _ in rows[:120]) and all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.predict(frame, None).collect()} == {"und"}


def test_language_grams_are_of_characters():
    """Every n-gram of code points has one place, whatever bytes it takes; upper case and kinds of space are one."""
    text = "ÀB \t漢字é😀"
    t = words.Texts(pa.array(["x", text, None, "ΑΒ"]))
    code, at = langid.characters(t)
    assert list(code) == [ord(c) for c in "x" + "àb  漢字é😀" + "αβ"] and list(at) == [0, 1, 9, 9, 11]
    places, _ = langid.grams(t)
    same, _ = langid.grams(words.Texts(pa.array(["q àb\n\n漢字é😀"])))
    assert [list(p[5:9]) for p in places[:3]] == [list(p[6:10]) for p in same[:3]]


def held_out(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_language_id_is_right_on_rows_it_did_not_learn_from(spark, sf):
    frame = held_out(spark, sf, "documents").select("doc_id", "text", "lang")
    got = langid.predict(frame, langid.train(frame)).where((langid.id_remainder("doc_id", 4) == 2) & F.col("lang").isNotNull()).collect()
    got = [x for x in got if langid.has_letter(x.text)]
    assert len(got) > 10 and np.mean([x.lang == x.lang_pred for x in got]) >= 0.97


def test_quality_is_right_on_rows_it_did_not_learn_from(spark, sf):
    labels = held_out(spark, sf, "labels")
    got = quality.classify(held_out(spark, sf, "documents").select("doc_id", "text"), labels)
    got = got.join(labels.select("doc_id", "quality"), "doc_id").where((quality.id_remainder("doc_id", 5) == 0) & F.col("quality").isNotNull()).collect()
    good, bad = ([x.score for x in got if x.quality == y] for y in (1, 0))
    assert good and bad and np.mean([[g > b for b in bad] for g in good]) >= 0.95 and np.mean([x.predicted == x.quality for x in got]) >= 0.9


def test_samples_leave_no_label_out(spark):
    """Rare labels among many, more labels than rows allow for, and texts beyond the bound."""
    frame = spark.createDataFrame([(k, f"l{k % 7}" if k < 700 else "rare", "x" * (100 + k)) for k in range(701)], "doc_id long, lang string, text string")
    count = lambda f: Counter(x.lang for x in f.collect())
    assert count(common.bounded_sample(frame, "doc_id", "lang", 20)) == {**{f"l{k}": 20 for k in range(7)}, "rare": 1}
    assert count(common.bounded_sample(frame, "doc_id", "lang", 20, total=16)) == {**{f"l{k}": 2 for k in range(7)}, "rare": 1}
    assert set(count(common.bounded_sample(frame, "doc_id", "lang", 20, total=3)).values()) == {1}
    some = common.bounded_texts(frame, "lang", most_bytes=80_000)
    size = Counter()
    for x in some:
        size[x.lang] += len(x.text)
    assert len(size) == 8 and all(5_000 < n <= 10_000 for g, n in size.items() if g != "rare")
    assert len(common.bounded_texts(frame, "lang", most_bytes=10)) == 8


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    logits = r.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    truth = np.array([r.choice(3, p=q) for q in p])
    assert langid.temperature(logits * 3, truth) == pytest.approx(3, rel=0.15)


def test_quality(spark):
    rows = [(k, prose(k, 40) if k % 4 else prose(k, 40).upper().replace(" ", "!! "), None, None) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(150)] + [(None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows), labels).collect()
    assert all(x.predicted == int(x.doc_id % 4 > 0) for x in got) and all(0 <= x.score <= 1 for x in got)


def test_quality_sees_word_order():
    """Texts of phrases against the same words in any order, on rows that it didn't learn from; and all weights are used."""
    r = random.Random(3)
    phrases = [prose(f"phrase {k}", 4, 200).split() for k in range(40)]
    rows = []
    for k in range(400):
        text = [w for _ in range(15) for w in r.choice(phrases)]
        if k % 2:
            r.shuffle(text)
        rows.append((" ".join(text), 1 - k % 2))
    weights = quality.fit(rows[:300])

    def score(text):
        place, _ = quality.features(words.Texts(pa.array([text])))
        return weights[0] + 4 * weights[place].sum() / len(text.split())

    good, bad = ([score(t) for t, y in rows[300:] if y == label] for label in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    place, doc = quality.features(words.Texts(pa.array([prose(1, 3000, 10**6), None, "one", "two words"])))
    assert len(place) == len(doc) and place.min() > 0 and place.max() < 1 << quality.BITS and 0.4 < np.mean(place % 2 == 0) < 0.6


def test_classifiers_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 0, 1), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(awkward, labels).collect()
    assert len(found) == 13 and len({x.score for x in found if x.doc_id == 1 or x.text == prose(1, 60)}) == 1
    # Texts without words have the bias alone; what was learned as good is better than what was learned as bad.
    empty = {x.score for x in found if not (x.text or "").split()}
    assert len(empty) == 1 and all(x.predicted == int(x.score >= 0.3) for x in found)
    score = {x.doc_id: x.score for x in found}
    assert score[1] > score[7]
    kept = quality.accepted(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == sum(x.predicted for x in found) and {x.score for x in kept.collect()} <= {"mine"}
    assert {x.score for x in quality.classify(awkward, labels.limit(0)).collect()} == {0.5} and quality.classify(awkward.limit(0), labels).count() == 0
    got = langid.predict(awkward, langid.train(awkward)).collect()
    assert len(got) == 13 and all((x.lang_pred == "und" and x.score == 0) == (not langid.has_letter(x.text)) for x in got)
    learned = {x.lang for x in awkward.where((langid.id_remainder("doc_id", 4) != 2) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).collect()}
    assert {x.lang_pred for x in got} <= learned | {"und"} and len({x.lang_pred for x in got if x.doc_id == 1}) == 1
    assert langid.train(awkward.limit(0)) is None and langid.predict(awkward.limit(0), None).count() == 0


def topk_by_brute_force(rows, k=5, scale=256):
    """(query_id, ((score, vec_id), ...)) for every row whose id is divisible by 50; each row is its own candidate for no one but itself."""
    whole = [(i, None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(scale * c) for c in v]) for i, v in rows]
    out = []
    for n, (q, x) in enumerate(whole):
        if q is not None and q % 50 == 0 and x is not None:
            scored = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0, i) for m, (i, y) in enumerate(whole) if m != n and y is not None and len(x) == len(y)]
            out.append((q, tuple((-s, i) for s, _, _, i in sorted(scored, key=lambda t: t[:3])[:k])))
    return sorted(out, key=str)


def topk_rows(found):
    """The same from results: lists of equal query ids are told apart by nothing, so they are compared rank by rank."""
    got = defaultdict(list)
    for x in found:
        got[x.query_id, x.rank].append((x.score, x.vec_id))
    return {key: sorted(v, key=str) for key, v in got.items()}


def by_rank(lists):
    got = defaultdict(list)
    for q, best in lists:
        for n, x in enumerate(best):
            got[q, n + 1].append(x)
    return {key: sorted(v, key=str) for key, v in got.items()}


@pytest.mark.parametrize("block_rows", [100, 10**6])
def test_topk_equals_brute_force(spark, block_rows):
    """Ties, repeated ids of queries and of others, null ids, several lengths, empty vectors, and vectors that take no part."""
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(600, 8)), 1)  # many ties
    x[10:60] = x[10]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [0.0] * 8)]
    rows += [(None, [1.0] * 8), (None, [-1.0] * 8), (50, rows[50][1]), (100, [0.3] * 8), (7, [9.0] * 8), (0, [2.0]), (3, [2.0]), (4, [-2.0]), (2250, [1.0, 2.0, 3.0]), (2300, []), (2350, []), (11, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = topk.search(frame, F.col("vec_id") % 50 == 0, block_rows=block_rows, query_rows=5).collect()
    want = topk_by_brute_force(rows)
    assert topk_rows(got) == by_rank(want) and {q for q, best in want if not best} == {2250}
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_keeps_links_of_rows_with_one_id(spark):
    frame = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [3.0])], "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.search(frame, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 3 * 65536), (0, 1, 1, 6 * 65536), (0, 2, 0, 2 * 65536), (0, 2, 0, 2 * 65536)]


def test_threshold_stops_early_and_is_exact():
    """Where a few vectors stand out, reading stops; large numbers are scored as integers."""
    r = np.random.default_rng(8)
    x = r.integers(-50, 50, (5000, 6))
    x[:20] += r.integers(900, 1000, (20, 6))
    q = r.integers(1, 50, (4, 6))
    q[3] <<= 40
    rows = np.arange(5000)
    for at, best, score in topk.threshold_search(q, np.full(4, -1), np.full(4, -(2**62)), x, rows, rows, 5):
        exact = x @ q[at]
        order = np.lexsort((rows, -exact))[:5]
        assert list(best) == list(order) and list(score) == list(exact[order])


PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header><p>Site name, with commas, and more commas, in a header</p></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as everybody does, so please agree to them</p></div><div class="content"><div class=post>
<h1>Head &amp; line</h1><p>First paragraph of the article, which is long enough, and has <b>bold</b> parts.<p>Second one, not closed,
 with a&nbsp;space and <a href=y>a link</a><br>and a break; it goes on for a while, too.</p><form><p>A form, with, commas, that is long enough</p></form></div>
<p>A paragraph next to it, that is long enough to be kept since it has few links, and it says a little more.</p></div>
<aside><p>Something else, that is long enough, but set aside, as it were</p></aside><div id="comments"><p>A reader says, at some length, that this is wrong</p></div>
<footer>Foot</footer></body></html>"""


def test_html_text():
    assert html_text.main_text(PAGE) == (
        "Head & line First paragraph of the article, which is long enough, and has bold parts. Second one, not closed, with a space and a link and a break; it goes on for a while, too. "
        "A paragraph next to it, that is long enough to be kept since it has few links, and it says a little more."
    )
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    assert html_text.main_text("<body><article><h1>A</h1>b<p>c</article><div>d") == "A b c"
    assert html_text.main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


def test_names_of_wrappers_drop_no_article():
    body = "".join(f"<p>Sentence {k} of the article, which is long enough, with commas, to give points to it.</p>" for k in range(6))
    want = " ".join(body.replace("<p>", "").split("</p>")).strip()
    link = '<p><a href="/">A link to another page of this site, which is no article</a></p>'
    for name in ('class="content has-sidebar"', 'id="message-body"', 'class="post comments-open"', 'class="sidebar"'):
        for inside in (body, f"<article>{body}</article>", f"<main><div>{body}</div></main>"):
            assert html_text.main_text(f"<body><div>{link}</div><div {name}>{inside}</div></body>") == want, (name, inside[:9])
    assert html_text.main_text(f'<body><main><div id="message">{body}</div></main></body>') == want
    comments = "<p>A comment on it that is long, longer than the text, with commas, and with more words in it.</p>" * 9
    for tag in ("div", "article"):
        rest = f'<div id="comments"><ol class="comment-list"><li><{tag} class="comment-body">{comments}</{tag}></li></ol></div>'
        assert html_text.main_text(f"<body><article>{body}</article>{rest}</body>") == want
        assert html_text.main_text(f"<body><main><article>{body}</article>{rest}</main></body>") == want
    assert html_text.main_text(f'<body><div>{body}<div class="ad-slot">Buy this now, it is cheap, it is good, it is new.</div></div></body>') == want


def test_comments_and_several_articles():
    body = "".join(f"<p>Sentence {k} of the article, which is long enough, with commas, to give points to it.</p>" for k in range(6))
    want = " ".join(body.replace("<p>", "").split("</p>")).strip()
    comment = "".join(f"<article class='comment'><p>Reader {k} says, at length, with commas, and more commas, that it is wrong, wrong, and wrong again.</p></article>" for k in range(20))
    assert html_text.main_text(f"<body><article>{body}{comment}</article></body>") == want
    assert html_text.main_text(f"<body><article>{body}<section>{comment}</section></article></body>") == want
    assert html_text.main_text(f"<body><article class='comment'>{body}</article></body>") == want
    assert html_text.main_text(f"<body><main><article>{body}</article><article>{body}</article></main></body>") == f"{want} {want}"


@pytest.mark.parametrize("part", ["<div><p>some text, with a comma, that is long enough</p>", "<div class=ad>some text, with a comma, that is long enough", "<div></section></b>", "<article><a>x"])
def test_deep_pages_take_time_in_proportion(part):
    start = time.monotonic()
    text = html_text.main_text(part * 20_000 + "end")
    assert time.monotonic() - start < 5 and (text.endswith("end") or "ad" in part)


def test_html_rows(spark):
    hidden = '<body><div style="display:none"><p>Nothing of this, that is long enough, is seen.</p></div><p>Seen, and long enough to be the text.</p></body>'
    rows = [(1, "u", PAGE, "x", 5), (1, "u", PAGE, "x", 5), (None, None, None, None, None), (2, "v", "", "x", 5), (3, "w", hidden, "x", 5), (4, "z", "<p>" + "word, " * 100_000, "x", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages).collect()
    assert [len(x.text) for x in got] == [x.n_chars for x in got] and got[0] == got[1] and got[2].text == got[3].text == "" and html_text.extract(pages.limit(0)).count() == 0
    assert got[4].text == "Seen, and long enough to be the text." and got[5].n_chars == 6 * 100_000 - 1
    assert html_text.extract(pages).columns == ["page_id", "url", "text", "n_chars"]


def test_pages_of_the_table(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    for page in pages.html:
        article = re.search("<article>(.*?)</article>", page, re.S)[1].replace("<b>", "").replace("</b>", "")
        assert html_text.main_text(page) == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())


def bytes_as_ids():
    """An encoder for pack(), made here so that workers get it by value."""

    def encoder():
        return lambda text: struct.pack(f"<{len(text.encode())}I", *text.encode())

    return encoder


def unpacked(pieces, size=64):
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        documents[p.doc_id].append(p)
    for s in sequences.values():
        place = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == place and p.length > 0
            place += p.length
        assert place == size or place & (place - 1) == 0
    return documents


def test_packing_is_an_exact_round_trip(spark):
    rows = [(k, prose(k, n), None, None) for k, n in enumerate([0, 1, 5, 100, 300, 20, 20, 64])] + [(50, None, None, None)]
    documents = unpacked(packing.pack(docs(spark, rows), size=64, encoder=bytes_as_ids()).collect())
    for k, text, _, _ in rows:
        ids = list((text or "").encode()) + [1]
        place = 0
        for p in sorted(documents[k], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == place and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            place += p.length
        assert place == len(ids)


def test_fast_tokenizer_gives_the_same_ids():
    P = pytest.importorskip("public_tokenizers")
    plain, fast = packing.json_encoder(P.path("byte_bpe_50k.json")), packing.default_encoder()
    for text in ["", "a", "It's  they'll'S\n\n x\t y", "Ünïcödé × ÷ ² ³ ª º 12ab 3½", "漢字 \U0001f600", "a\x1cb\x85c\x7f", "<|endoftext|> x", " 's 'sx !!a|b__c", "\r\n \n\n  end  "]:
        assert fast(text) == plain(text), repr(text)


def test_fast_tokenizer_on_random_strings():
    """Ids, and as bytes, of 4000 strings of letters, marks, digits, kinds of space, contractions and characters beyond Latin-1."""
    P = pytest.importorskip("public_tokenizers")
    plain, fast = packing.json_encoder(P.path("byte_bpe_50k.json")), packing.default_encoder()
    r = random.Random(9)
    parts = [*"abzAZ019", *" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003", *"éÀÿß×÷ªº²½", *"'!|_-.,;()@#", "'s", "'LL", "'re", " the", "The ", "ing", "  ", "\r\n", "<|endoftext|>", "漢", "😀", "ا", "\u0301", "\x00", "\x7f"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 40)))
        assert fast(text) == plain(text), repr(text)


def test_hilbert_neighbours_touch():
    side = np.array(list(itertools.product(range(8), repeat=3)))
    place = packing.hilbert(side, 3)
    assert sorted(place) == list(range(512))
    path = side[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_of_awkward_rows(awkward):
    pieces = packing.pack(awkward, encoder=bytes_as_ids()).collect()
    assert {p.doc_id for p in pieces} == {None, *range(1, 10)} and packing.pack(awkward.limit(0), encoder=bytes_as_ids()).count() == 0


def test_substring_dedup(spark):
    passage = prose(77, 60, 5000)
    near = prose(78, 60, 5000).split()
    changed = near[:30] + ["other"] + near[31:]
    clean = [prose(100 + k, 150, 5000) for k in range(3)]
    rows = [
        (1, f"{clean[0]} {passage} {prose(5, 40, 5000)}"), (2, f"{prose(6, 70, 5000)} {passage} {prose(7, 20, 5000)}"), (3, clean[1]), (4, "short line\n" + prose(8, 50, 5000)), (5, "short line\n" + prose(9, 50, 5000)),
        (6, prose(10, 30, 5000) + "\n" + " ".join(near)), (7, prose(11, 30, 5000) + "\n" + " ".join(changed)), (8, None), (9, ""), (None, passage), (10, clean[2]),
    ]
    frame = docs(spark, [(i, t, None, None) for i, t in rows])
    found = substring_dup.clusters(frame).collect()
    assert {x.doc_id for x in found} == {1, 2, 6, 7}
    assert {x.doc_id for x in found if x.kept} == {1, 6}
    left = {x.doc_id: x for x in substring_dup.without_repeats(frame).collect()}
    texts = dict(rows)
    assert all(left[i].text == texts[i] for i in (1, 3, 4, 5, 6, 8, 9, 10, None))
    assert len(left[2].text.split()) <= 90 + 16 and left[2].n_chars == len(left[2].text) and len(left[7].text.split()) <= 30 + 12


def test_substrings_equal_brute_force(spark):
    """Every pair of documents that shares 50 words in a row is found, wherever the passage lies."""
    r = random.Random(12)
    passages = [prose(200 + k, r.randrange(51, 90), 5000) for k in range(10)]
    rows = [(k, f"{prose(300 + k, r.randrange(5, 90), 5000)} {passages[k % 10]} {prose(400 + k, r.randrange(5, 90), 5000)}", None, None) for k in range(30)]
    found = {x.doc_id for x in substring_dup.clusters(docs(spark, rows)).collect()}
    assert found == set(range(30))


def pasted(seeds, length=51):
    """Two documents for each seed, with one passage in the middle of a line of both."""
    out = []
    for k in seeds:
        r = random.Random(k)
        passage = prose(f"{k} passage", length, 5000)
        out += [(2 * k + j, f"{prose(f'{k} before {j}', r.randrange(5, 90), 5000)} {passage} {prose(f'{k} behind {j}', r.randrange(5, 90), 5000)}", None, None) for j in (0, 1)]
    return out


def test_bands_find_similar_paragraphs():
    """The share of paragraph pairs that meet in a band: as tuned at similarity 0.8, and as the formula says below."""
    r = np.random.default_rng(5)

    def met(common, own, pairs=3000):
        pool = r.integers(0, 2**63, (pairs, common + 2 * own)).astype(np.uint64)
        sets = np.concatenate([pool[:, : common + own].ravel(), np.hstack([pool[:, :common], pool[:, common + own :]]).ravel()])
        keys = np.stack(substring_dup.band_keys(sets, np.arange(2 * pairs + 1) * (common + own), substring_dup.BANDS, substring_dup.ROWS), axis=1)
        return (keys[:pairs] == keys[pairs:]).any(axis=1).mean()

    assert substring_dup.BANDS == 7 and met(40, 5) >= 0.995
    for common, own in ((80, 20), (40, 30)):
        assert met(common, own) == pytest.approx(1 - (1 - (common / (common + 2 * own)) ** 2) ** 7, abs=0.03)


def test_passages_in_the_middle_of_lines_are_found(spark):
    rows = pasted(range(400))
    found = {x.doc_id for x in substring_dup.clusters(docs(spark, rows)).collect()}
    assert found == {k for k, *_ in rows}


def without_repeats_by_brute_force(rows, least=24):
    """The words that stay in each document if every run of so many words goes that occurs before."""
    first, left = {}, {}
    for i, text in sorted(rows):
        w = text.lower().split()
        gone = [False] * len(w)
        for at in range(len(w) - least + 1):
            keeper, place = first.setdefault(tuple(w[at : at + least]), (i, at))
            if (keeper, place) != (i, at):
                begin = max(at, place + least) if keeper == i else at
                gone[begin : at + least] = [True] * (at + least - begin)
        left[i] = [x for x, g in zip(text.split(), gone) if not g]
    return left


def test_removed_stretches_equal_brute_force(spark):
    """No word of a repeated passage stays but in its first place, and no other word goes."""
    r = random.Random(31)
    passages = [prose(f"shared {k}", r.choice([23, 24, 25, 30, 51, 70, 100]), 5000) for k in range(12)]
    rows = [(k, " ".join(f"{prose(f'own {k} {j}', r.randrange(8, 60), 5000)} {r.choice(passages)}" for j in range(4)) + " " + prose(f"end {k}", 9, 5000)) for k in range(60)]
    frame = docs(spark, [(i, t, None, None) for i, t in rows])
    want = without_repeats_by_brute_force(rows)
    assert {x.doc_id: x.text.split() for x in substring_dup.without_repeats(frame).collect()} == want
    texts = {i: t.split() for i, t in rows}
    for x in substring_dup.clusters(frame).collect():
        assert x.n >= 24 and texts[x.doc_id][x.start : x.start + x.n] == texts[x.keeper_doc_id][x.keeper_start : x.keeper_start + x.n]


def test_runs_of_an_anchor_go_on_over_batches():
    rows = [(i, prose("passage", 60, 5000)) for i in range(6)] + [(9, "the " * 80), (10, "The " * 90)]
    text = {i: t for i, t in rows}
    table = pa.table({"doc_id": pa.array(list(text), pa.int64()), "text": list(text.values())})

    class Frame:
        def mapInArrow(self, run, schema):
            return pa.Table.from_batches(run(iter(table.to_batches())))

    sorted_rows = substring_dup.anchors(Frame(), 24).sort_by([(c, "ascending") for c in ("anchor", "doc_id", "start", "whole")]).combine_chunks()
    sorted_rows = pa.concat_tables([sorted_rows, sorted_rows]).sort_by([(c, "ascending") for c in ("anchor", "doc_id", "start", "whole")]).combine_chunks()

    def places(size):
        found = []
        for b in substring_dup.repeated_runs(iter(sorted_rows.to_batches(max_chunksize=size))):
            for x in b.to_pylist():
                found += [(x["doc_id"], x["start"] + k, x["keeper_doc_id"], x["keeper_start"] + k, x["kept"]) for k in range(x["m"])]
        return sorted(found)

    want = sorted([(i, k, 0, k, i == 0) for i in range(6) for k in range(37)] + [(i, k, 9, 0, (i, k) == (9, 0)) for i, n in ((9, 57), (10, 67)) for k in range(n)])
    assert all(places(size) == want for size in (1, 2, 3, 7, 1000))


def test_repeats_without_cuts_in_lines(spark):
    """Words over and over, passages in short lines, and passages that are wrapped at another width."""
    wrap = lambda text, n: "\n".join(" ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n))
    own = lambda k: wrap(prose(f"own {k}", 40, 5000), 6)
    short, other, tied = prose("short", 60, 5000), prose("other", 60, 5000), "the " * 70 + "| - " * 40
    rows = [
        (1, f"{own(1)}\n{wrap(short, 5)}\n{own(2)}"), (2, f"{own(3)}\n{wrap(short, 5)}\n{own(4)}"), (3, f"{own(5)}\n{wrap(other, 7)}\n{own(6)}"), (4, f"{own(7)}\n{wrap(other, 6)}\n{own(8)}"),
        (5, f"{prose('a', 20, 5000)} {tied} {prose('b', 20, 5000)}"), (6, f"{prose('c', 20, 5000)} {tied} {prose('d', 20, 5000)}"),
    ]
    left = {x.doc_id: x.text.split() for x in substring_dup.without_repeats(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert left == without_repeats_by_brute_force(rows) and [len(left[k]) for k in (2, 4, 6)] == [80, 80, 40]


def test_lines_that_occur_once_lengthen_no_run(spark):
    """A common line of 8 to 23 words beside lines of the same kind that occur once stays, also where a row occurs twice."""
    common = prose("common", 12, 5000)
    rows = [(k, f"{prose(f'{k} x', 10, 5000)}\n{common}\n{prose(f'{k} y', 10, 5000)}", None, None) for k in range(30)]
    assert substring_dup.clusters(docs(spark, rows)).count() == 0
    assert substring_dup.clusters(docs(spark, rows + rows)).count() == 0


def test_substrings_of_awkward_rows(spark, awkward):
    left = substring_dup.without_repeats(awkward)
    assert left.columns == awkward.columns
    # Copies of document 1 go, but for the row with its own id and what has no id; white space was no words, so it stays.
    texts = {x.doc_id: x.text for x in awkward.collect() if x.doc_id is not None}
    assert sorted(((x.doc_id, x.text) for x in left.collect() if x.doc_id is not None), key=str) == sorted(
        [(1, texts[1]), (1, texts[1]), (3, None), (4, ""), (5, texts[5]), (6, "one"), (6, "two words"), (7, texts[7]), (8, texts[8])], key=str
    )
    assert sum(x.doc_id is None for x in left.collect()) == 2
    assert substring_dup.clusters(awkward.limit(0)).count() == 0
    assert substring_dup.tuned_bands(0.8, 0.998) == 4


def test_word_hashes_depend_on_bytes_only():
    texts = ["Ab c d", "", None, "ab C d  \x0b e", "é"]
    t = words.Texts(pa.array(texts, pa.string()))
    assert list(t.per_doc) == [2, 0, 0, 3, 1]
    h = t.word_hashes(lower=True)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_pipeline(spark, sf):
    import corpus_pipeline

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, sf)
        assert after.columns == frame.columns, name
        frame = spark.createDataFrame(after.collect(), after.schema)
    assert frame.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, frame, sf).count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_take_empty_tables(spark, sf):
    import corpus_pipeline

    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_many_classes_of_an_anchor_are_compared_alike(spark):
    """The windows of an anchor in one stream, and by shuffling them: copies, edges, words over and over, rows that occur twice."""
    r = random.Random(41)
    passages = [prose(f"hot {k}", r.choice([24, 40, 60]), 5000) for k in range(4)] + ["the " * 50]
    rows = [(k, f"{prose(f'l {k}', r.randrange(0, 30), 5000)} {r.choice(passages)} {prose(f'r {k}', r.randrange(0, 30), 5000)}") for k in range(50)]
    rows += [(100 + k, rows[7][1]) for k in range(5)] + rows[:6]
    frame = docs(spark, [(i, t, None, None) for i, t in rows])
    one, two = ({tuple(x) for x in substring_dup.stretches(frame, 24, n).collect()} for n in (10**6, 0))
    assert one == two and len(one) > 50
    left = {i: t.split() for i, t in rows}
    for x in substring_dup.stretches(frame, 24).where("not kept").collect():
        left[x.doc_id][x.start : x.start + x.n] = [None] * x.n
    assert {i: [x for x in w if x] for i, w in left.items()} == without_repeats_by_brute_force(dict(rows).items())


def test_plan_of_the_mix_stays_small(spark, sf):
    plan = mixing.repeated(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
