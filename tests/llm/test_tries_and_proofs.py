"""The prefix trie, near duplicates by sketches, and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import docs, hard_rows, words
from pyspark.sql import functions as F

from trackloom.llm import bottom_k, merkle, ordering, prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, key long, depth long, n_convs string, of long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], CONVERSATIONS).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = sha(f"{len((role or '').encode())}:{role or ''}{text or ''}")
            own[conv].append(((turn is not None, turn or 0), digest, (role or "", text or "")))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = set()
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1]) if node else 0
    for node, own_members in members.items():
        ends = sorted(c for c in own_members if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(own_members), len(node), parent, len(own_members), children[node], leaves[node], saved[node], sha(",".join(map(str, ends)))))
    return out


def many_conversations(seed, n=60, longest=9):
    """Few different turns, so that prefixes are shared at every depth; ids in several hundreds."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        c = rnd.choice([k, 100 + k, 200 + k, 1000 + 7 * k])
        for turn in range(rnd.randrange(1, longest)):
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "é", "", None, "long text", "日本"])))
    return list({(r[0], r[1]): r for r in rows}.values())


def trie_rows(spark, rows, **options):
    conv = F.col("conv_id")
    found = prefix_trie.trie(conversations(spark, rows), conv - conv % 100, F.crc32(conv.cast("string")) % 6, **options)
    return [tuple(r) for r in found.collect()]


@pytest.mark.parametrize("options", [{}, {"block": 2, "piece_bytes": 3}, {"bits": 3, "block": 3}])
def test_trie_equals_brute_force(spark, options):
    rows = many_conversations(5, 60 if "bits" not in options else 12)
    found = trie_rows(spark, rows, **options)
    assert len(found) == len(set(found))
    assert set(found) == expected_trie(rows)


def test_trie_of_hard_rows(spark):
    long = [(7, k, "user", f"t{k % 3}") for k in range(150)]
    copies = [(200 + c, k, "user", "same") for c in range(40) for k in range(3)]
    rows = [*long, *copies, (8, None, None, None), (8, None, "user", "x"), (8, 0, "user", "x"), (8, 0, "user", "x"), (None, 1, "user", "lost"), (9, 5, "user", "word " * 20_000), (-3, 1, "user", "minus")]
    found = trie_rows(spark, rows, block=64, piece_bytes=10)
    assert len(found) == len(set(found))
    assert set(found) == expected_trie(rows)


def test_trie_without_conversations(spark):
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []
    conv = F.col("conv_id")
    assert prefix_trie.trie(conversations(spark, [(1, 1, "user", "x")]).where("conv_id < 0"), conv, F.lit(0)).collect() == []


def test_hot_keys_are_joined_once(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"))
    inner = ordering.join_hot(rows, keyed, ["k"], "n", share=10)
    assert {(r["v"], r["n"]) for r in inner.collect()} == {(v, 400 if v < 400 else 1) for v in range(1000)} and inner.count() == 1000
    left = ordering.join_hot(rows, keyed.where("k < 500"), ["k"], "n", "left", share=10)
    assert left.count() == 1000 and left.where("n is null").count() == 500


# ---------------------------------------------------------------- near duplicates


def expected_components(rows):
    sets = []
    for _, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(own[k : k + 4]) for k in range(max(len(own) - 3, 1))} if own else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    out = []
    for k, (doc, _) in enumerate(rows):
        c = least.get(find(k))
        out.append((doc, len(sets[k]), c, doc is not None and doc == c))
    return sorted(out, key=repr)


def near_rows(seed, groups=6, most=30):
    """Groups of texts with a few words changed each, some changed from one another in a chain, and passages that many share."""
    rnd = random.Random(seed)
    common = words(99, 30)
    rows, doc = [], 0
    for g in range(groups):
        base = words(seed * 100 + g, rnd.choice([12, 40, 90, 200])).split()
        for _ in range(rnd.randrange(2, most)):
            own = list(base)
            for _ in range(rnd.randrange(0, max(2, len(own) // 18))):
                own[rnd.randrange(len(own))] = f"z{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                base = own
            rows.append((doc, " ".join(own)))
            doc += 1
    for k in range(40):
        rows.append((doc + k, words(seed * 1000 + k, 40, 10**6) + " " + common))
    return rows


def component_rows(spark, rows, **options):
    found = bottom_k.near_duplicates(docs(spark, rows).repartition(3), **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"part": 4, "retained": 32, "keep": 0.3}])
def test_components_equal_brute_force(spark, options):
    rows = near_rows(3)
    assert component_rows(spark, rows, **options) == expected_components(rows)


def test_components_of_hard_rows(spark):
    rows = [r for r in hard_rows()] + [(20, "One TWO Three"), (21, "ÉCOLE est là aussi"), (22, "école est là aussi"), (None, None), (None, words(50, 30)), (None, words(50, 30))]
    assert component_rows(spark, rows) == expected_components(rows)


def test_components_of_no_rows(spark):
    assert bottom_k.near_duplicates(docs(spark, [(1, "x")]).where("doc_id < 0")).collect() == []


def test_estimates_are_near_the_similarity():
    rnd, found = np.random.RandomState(4), []
    for _ in range(200):
        values = rnd.randint(0, 1 << 62, 1000)
        a, b = np.sort(values[:900]), np.sort(values[100:])
        pad = lambda x: x[:64][None]
        found.append(bottom_k.estimates(pad(a), pad(b), np.array([64]), np.array([64]), 64)[0])
    rows, size = np.array([np.sort(rnd.permutation(300)[:64]) for _ in range(9)]), np.array([64, 64, 3, 64, 20, 64, 64, 1, 64])
    rows[np.arange(64)[None] >= size[:, None]] = np.iinfo(np.int64).max
    one_by_one = [[bottom_k.estimates(rows[[i]], rows[[j]], size[[i]], size[[j]], 64)[0] for j in range(9)] for i in range(9)]
    assert np.allclose(bottom_k._estimated(rows, rows, size, size, 64), one_by_one)
    assert abs(np.mean(found) - 0.8) < 0.02 and np.min(found) > bottom_k.KEEP


# ---------------------------------------------------------------- Merkle manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up_the_tree(digests, fan):
    """The root, and for each leaf its siblings level by level."""
    proofs, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[k : k + fan] for k in range(0, len(digests), fan)]
        for k, at in enumerate(places):
            run = runs[at // fan]
            proofs[k].append((run[: at % fan], run[at % fan + 1 :]))
            places[k] = at // fan
        digests = [sha("".join(run)) for run in runs]
    return digests[0] if digests else None, proofs


def expected_proofs(rows, fan=16):
    """rows: (doc_id, text, lang, source, n_chars)."""
    trees = defaultdict(list)
    for doc, text, lang, source, n in rows:
        head = "".join(map(field, (doc, source, lang, n)))
        leaf = sha(head + field(text))
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        low = text.translate({k: k + 32 for k in range(65, 91)}) if tampered and text is not None else text
        trees[(source is not None, (source or "").encode())].append(((doc is not None, doc or 0, leaf), doc, leaf, sha(head + field(low))))
    names = sorted(trees)
    built = [up_the_tree([x[2] for x in sorted(trees[s])], fan) for s in names]
    root, upper = up_the_tree([b[0] for b in built], fan)
    out = []
    for k, s in enumerate(names):
        for (_, doc, leaf, start), proof in zip(sorted(trees[s]), built[k][1], strict=True):
            h, every = start, ""
            for left, right in [*proof, *upper[k]]:
                h = sha("".join([*left, h, *right]))
                every += "".join([*left, *right])
            out.append((doc, leaf, built[k][0], root, sha(every), h, h == root))
    return sorted(out, key=repr)


def proof_rows(spark, rows, fan=16):
    table = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n long, tree string").repartition(3)
    found = merkle.prove(table, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.lower_cased(F.col("text")), fan)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("fan", [2, 16])
def test_proofs_equal_brute_force(spark, fan):
    rnd = random.Random(8)
    rows = [(k, f"Text {k} É", "en", "big" if k % 3 else f"s{rnd.randrange(40)}", k) for k in range(400)]
    found = proof_rows(spark, rows, fan)
    assert found == expected_proofs(rows, fan)
    assert 0 < sum(not r[-1] for r in found) < 200


def test_proofs_of_hard_rows(spark):
    rows = [(1, "A", "en", None, 1), (1, "A", "en", None, 1), (1, None, None, None, None), (None, "B", "en", "", 3), (2, "", "en", "é", 0), (3, "X " * 50_000, "en", "z", 5), (4, None, None, "z", None), (5, "Q", "en", "\U0001f600", 1), (6, "Q", "en", "￿", 1)]
    assert proof_rows(spark, rows, 2) == expected_proofs(rows, 2)


def test_one_row_is_its_own_root(spark):
    (found,) = proof_rows(spark, [(3, "same", "en", "s", 4)])
    assert found[1] == found[2] == found[3] == found[5] and found[4] == sha("") and found[6]
    assert merkle.prove(docs(spark, [(1, "x")]).where("doc_id < 0")).collect() == []
