"""Centroid clustering, the Merkle manifest and packing, each against a plain version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from text_samples import LONG, TEXTS, clashing, documents
from tokenizers import Tokenizer

from studyframe.llm import merkle, orchard, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            members = defaultdict(list)
            for (_, v), (_, j) in zip(kept, found):
                members[j].append(v)
            centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else c for j, c in enumerate(centroids)]
    sums = Counter()
    for d, j in found:
        sums[j] += d
    return Counter((i, j, d, sums[j], sum(sums.values())) for (i, _), (d, j) in zip(kept, found)), centroids


@pytest.mark.parametrize("k, dims, seed", [(16, 64, 1), (5, 3, 7), (1, 2, 1), (40, 2, 3)])
def test_clusters_equal_brute_force(spark, k, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, rng.uniform(-1, 1))) for _ in range(dims)]) for i in range(150)]
    rows += rows[:20] + [(7, rows[8][1]), (None, rows[3][1]), (None, [0.5] * dims)] + [(200 + i, rows[0][1]) for i in range(60)]  # repeats, ties, a hot vector
    rows += [(300, None), (301, []), (302, [0.1] * (dims + 1)), (303, [None] * dims), (304, [float("nan")] * dims), (305, [float("inf")] + [0.0] * (dims - 1))]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(0))
    got, centroids = orchard.cluster(frame, k=k, rounds=3, dims=dims, seed=seed)
    exact = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, want_centroids = plain_clusters(exact, k, 3, dims, 64, seed)
    assert centroids == want_centroids and Counter(map(tuple, got.collect())) == want
    digests = {r["cluster"]: r["centroid_sha256"] for r in orchard.centroid_digests(got, centroids).collect()}
    assert digests == {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in digests}


def test_clusters_of_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got, centroids = orchard.cluster(frame, dims=2)
    assert len(centroids) == 2 and sorted(map(tuple, got.collect())) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]
    got, centroids = orchard.cluster(frame.where("false"), dims=2)
    assert centroids == [] and got.collect() == [] and orchard.centroid_digests(got, centroids).collect() == []
    with pytest.raises(Exception, match="do not fit"):
        orchard.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dims=2)


def test_search_visits_few_centroids():
    """The walk ends early: of 200 spread centroids most are never looked at."""
    rng = np.random.default_rng(5)
    centroids = rng.integers(-1000, 1000, (200, 2))
    made, looked = orchard.Centroids(centroids.tolist(), 2), []
    real = orchard._squares
    orchard._squares = lambda x: (looked.append(len(x)), real(x))[1]
    try:
        near = (centroids + rng.integers(-3, 4, centroids.shape))[:100]
        best, distance = made.nearest(near)
    finally:
        orchard._squares = real
    every = ((near[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert sum(looked) < 0.5 * 100 * 200


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(nodes):
    """Levels from the leaves to the root, eight to one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    parts = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        head = field(doc_id) + field(source) + field(lang) + field(n)
        leaf = sha(head + field(text))
        lower = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        other = sha(head + field(lower)) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else leaf
        parts[lang].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, other))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda r: r[0])
        trees[name] = plain_tree([r[2] for r in parts[name]])
    crown = plain_tree([trees[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for pos, (_, doc_id, leaf, other) in enumerate(parts[name]):
            siblings, node = "", other
            for levels, i in ((trees[name], pos), (crown, at)):
                for level in levels[:-1]:
                    first = i // 8 * 8
                    left, right = "".join(level[first:i]), "".join(level[i + 1 : first + 8])
                    siblings, node, i = siblings + left + right, sha(left + node + right), i // 8
            root = crown[-1][0]
            out.append((doc_id, leaf, trees[name][-1][0], root, sha(siblings), node, node == root))
    return Counter(out)


def manifest_rows(docs):
    found = merkle.verified(merkle.document_manifest(docs))
    return Counter(map(tuple, found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified").collect()))


DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def test_manifest_of_odd_rows(spark):
    rows = [(i, t, lang, s, n) for (i, t, s), lang, n in zip(TEXTS, ["en", None, "", "=", "en", "É", "en"] * 2, [1, None] * 7)]
    rows += rows[:5] + [(-4, "Ä" * 9, "en", "s\n", 2**31 - 1)]
    assert manifest_rows(clashing(spark.createDataFrame(rows, DOCS))) == plain_manifest(rows)
    assert manifest_rows(spark.createDataFrame(rows[:1], DOCS)) == plain_manifest(rows[:1])
    assert manifest_rows(spark.createDataFrame([], DOCS)) == Counter()


@pytest.mark.parametrize("sizes", [(8, 9, 64), (65, 511, 1), (512, 513, 7), (4097, 1030, 3)])
def test_manifest_at_the_edges_of_blocks(spark, sizes):
    """Part sizes around one run, one block and several passes; the first part holds most rows."""
    rows = [(i if i % 50 else None, f"Text {i % 700}", f"l{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    assert manifest_rows(spark.createDataFrame(rows, DOCS).repartition(7)) == plain_manifest(rows)


def test_manifest_of_many_parts_and_deep_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)  # blocks of 8: four passes for 600 rows, three for 90 parts
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, f"A{i}", f"l{i % 90 if i > 600 else 0}", None, 1) for i in range(1200)]
    assert manifest_rows(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)


def test_manifest_sends_no_texts(spark):
    plan = merkle.document_manifest(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("Exchange", 1)[-1].split("\n", 1)[0] and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


ODD = [
    "", " ", "It's Bob'S don't 12 a1b2 --- x y z \x1c\x1d q", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> </w>", "ÀÉ é H̱ Å İ ß Σς ﬁ",
    "日本語 テスト 🙂🙂 ‍", "tab\tnew\nline\r\x0b\x0cend", "~!@#$%^&*()_+'ll'RE 'S", " ".join(f"w{i}q" for i in range(300)), "no-space" * 2000, "\x00 \x01 \x7f \x85",
]


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def packed_right(rows, want, sequence):
    """rows are the pieces of texts with the ids in want, a Counter of (doc_id, ids); returns the sizes of sequences."""
    at, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert 0 < len(ids) <= sequence
        at[r["sequence_id"]].append((r["offset"], len(ids)))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    sizes = []
    for places in at.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist()
        sizes.append(sum(n for _, n in places))
        assert sizes[-1] <= sequence
    needed = defaultdict(Counter)
    for (doc_id, ids), n in want.items():
        for i, x in enumerate(ids):
            needed[doc_id, len(ids)][i, x] += n
    assert {k: Counter((s + i, x) for s, ids in v for i, x in enumerate(ids)) for k, v in pieces.items()} == needed
    return sizes


def padding(sizes, sequence):
    return sum(0 if n & (n - 1) == 0 else sequence - n for n in sizes)


def test_parts_give_the_ids_of_whole_texts(monkeypatch):
    import pyarrow as pa

    texts = [*ODD, *(t or "" for _, t, _ in TEXTS)]
    want = plain_ids(texts)
    spec = packing._read(PATH)
    assert packing.Encoder(spec).wordwise
    for known in (400_000, 20):
        monkeypatch.setattr(packing, "KNOWN_PARTS", known)
        for encoder in (packing.Encoder(spec), packing.Encoder(packing._read(public_tokenizers.path("byte_bpe_50k.json")))):
            ids, bounds = encoder.encode(pa.array(["cut off", *texts]).slice(1))
            got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
            assert got == (want if encoder.wordwise else [e.ids + [2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)])


def test_packing_keeps_every_id(spark, docs):
    rows = [(i, t, "s") for i, t in enumerate(ODD, 100)] + TEXTS + [(1, TEXTS[0][1], "s1"), (1, "another text with this id", "s1"), (9, LONG, "s")]
    frame = clashing(documents(spark, rows)).withColumn("sequence_id", F.lit("x")).withColumn("offset", F.lit(0)).withColumn("pack_group", F.lit(None)).repartition(4)
    want = Counter((i, tuple(x)) for (i, _, _), x in zip(rows, plain_ids(t for _, t, _ in rows)))
    for sequence in (4096, 64):
        found = packing.pack(frame, PATH, sequence=sequence).collect()
        sizes = packed_right(found, want, sequence)
        assert padding(sizes, sequence) <= packing.SMALL_ROOM * len(sizes)
    several = packing.pack(frame, PATH, sequence=256, group_docs=4)
    assert several.select(F.col("sequence_id").bitwiseAND(~0xFFFFFFFF)).distinct().count() > 3
    packed_right(several.collect(), want, 256)
    assert sorted(map(tuple, several.drop("ids").collect()), key=str) == sorted(map(tuple, several.drop("ids").collect()), key=str)
    assert packing.pack(frame.where("false"), PATH).collect() == []


def test_padding_is_small(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "of", "the"], k=int(rng.paretovariate(0.8) * 20) % 9000)), "s") for i in range(3000)]
    found = packing.pack(documents(spark, rows), PATH, group_docs=700).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n")).collect()
    sizes = Counter()
    for r in found:
        sizes[r["sequence_id"]] += r["n"]
    assert padding(sizes.values(), 4096) < 0.005 * sum(sizes.values())


def plain_first_fit(sizes, room):
    left, out = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(left) if r >= s), len(left))
        if at == len(left):
            left.append(room)
        left[at] -= s
        out.append(at)
    return out


def test_tree_finds_the_first_bin_with_room():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 17, 400):
        sizes = sorted((rng.choice((1, 2, 100, rng.randint(1, 100))) for _ in range(n)), reverse=True)
        assert packing.first_fit(sizes, 100) == plain_first_fit(sizes, 100)
        rng.shuffle(sizes)
        assert packing.first_fit(sizes, 100) == plain_first_fit(sizes, 100)
