import random
import re
from collections import Counter

import numpy as np
import pytest

from text_samples import TEXTS, clashing, documents

from studyframe.llm import line_dedup as ld
from studyframe.llm import ngram_join as nj
from studyframe.llm.components import connected, tasks_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    roots = roots_of(len(rows), links)
    low = {}
    for (i, _, _), r in zip(rows, roots):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return Counter((i, len(s), low.get(r) if s else i) for (i, _, _), s, r in zip(rows, sets, roots))


def varied(n=160, seed=3):
    """Texts with near copies of all degrees, shared passages and a large group around one text."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    passage, rows, texts = [word() for _ in range(40)], [], []
    hub = [word() for _ in range(120)]
    for i in range(n):
        if i % 4 == 0:
            own = list(hub)
        elif i % 3 == 0 and texts:
            own = list(random.choice(texts))
        else:
            own = [word() for _ in range(random.randint(1, 150))]
        for _ in range(random.randint(0, 4)):
            own[random.randrange(len(own))] = word()
        if i % 5 == 0:
            own += passage
        texts.append(own)
        rows.append((i, " ".join(own), "s"))
    return rows


def result(frame):
    return Counter(tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect())


def test_near_duplicates_of_odd_rows(docs, doubled, empty):
    assert result(nj.near_duplicates(docs)) == brute(TEXTS)
    assert result(nj.near_duplicates(doubled)) == brute(TEXTS * 2)
    assert nj.near_duplicates(empty).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rows = varied()
    docs = documents(spark, rows)
    assert result(nj.near_duplicates(docs)) == brute(rows)
    assert result(nj.near_duplicates(docs, task_shingles=2000, hot_df=8)) == brute(rows)  # cut groups, hot shingles
    kept = {r["doc_id"] for r in nj.keep_one(docs).collect()}
    assert kept == {i for i, _, low in brute(rows) if i == low}


def test_local_join_finds_all_links_in_any_order():
    random.seed(7)
    sets = [np.unique(np.array([hash(s) % 2**63 for s in shingles(t)], dtype=np.uint64)) for _, t, _ in varied(120, 5)]
    sets = [s for s in sets if len(s)]
    full = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    parts = np.array([i % 2 for i in range(len(sets))])
    groups = lambda links: Counter(frozenset(i for i, r in enumerate(roots) if r == x) for roots in [roots_of(len(sets), links)] for x in set(roots))
    assert groups(nj.local_links(sets)) == groups(full)
    assert groups(nj.local_links(sets, parts)) == groups([(a, b) for a, b in full if parts[a] != parts[b]])


def test_sharing_with_many_is_not_sharing_with_one(spark, monkeypatch):
    """Texts made of passages of other texts, each of another one's, are not sent to be compared. As in a large corpus,
    the counters do not tell which shingles are rare."""
    texts = [[] for _ in range(60)]
    for k, (a, b) in enumerate(((1, 5), (2, 11), (3, 17), (7, 22))):
        for i in range(60):
            for j in (i, i + a, i + b):
                texts[j % 60].append(" ".join(f"p{k}x{i}w{n}" for n in range(24)))
    rows = [(i, " ".join(x), "s") for i, x in enumerate(texts)]
    rows += [(100, rows[3][1] + " one", "s"), (101, rows[3][1] + " two", "s")]
    monkeypatch.setattr(nj, "frequency_classes", lambda counts: np.zeros(len(counts), np.uint8))
    sent, tasks_of = [], nj.tasks_of
    monkeypatch.setattr(nj, "tasks_of", lambda members, *a: sent.append(members.count()) or tasks_of(members, *a))
    assert result(nj.near_duplicates(documents(spark, rows))) == brute(rows)
    assert sent == [3]


def test_lists_give_pairs_or_lead_to_their_first_node():
    import pyarrow as pa

    random.seed(5)
    rows, node = [], 0
    for shingle, m in enumerate((1, 2, 5, nj.PAIRED, nj.PAIRED + 1, 90, 1, 3, 40)):
        for n in sorted(random.choice((50, 55, 60, 100)) for _ in range(m)):
            rows.append((shingle, n, node, random.randint(1, 9)))
            node = (node + 37) % 1009
    want = Counter()
    for shingle in {r[0] for r in rows}:
        for sizes in ((50, 55, 60), (100,)):
            own = [r for r in rows if r[0] == shingle and r[1] in sizes]
            if len(own) > nj.PAIRED:
                want.update((r[2], own[0][2], min(x[3] for x in own), r[3]) for r in own)
            else:
                want.update((min(a[2], b[2]), max(a[2], b[2]), min(a[3], b[3]), None) for i, a in enumerate(own) for b in own[:i])
    for step in (1, 7, len(rows)):
        table = pa.Table.from_pylist([dict(zip(("shingle", "n", "node", "ell"), r)) for r in rows])
        got = Counter(tuple(r.values()) for batch in nj._list_links(iter(table.to_batches(max_chunksize=step))) for r in batch.to_pylist())
        assert got == want


def test_prefixes_are_not_kept_and_candidates_travel_as_texts(spark, monkeypatch):
    """What takes most disk: no table has the prefixes besides the shuffle that makes lists of them, and candidates are
    sent as compressed texts, but for texts that are longer than their shingles."""
    from pyspark.sql import functions as F

    rows = varied()
    rows += [(1000 + i, "a b c d e f g h " * 3000 + f"end{i}", "s") for i in range(3)]
    tables, sent, per_task, kept, written = [], [], nj.per_task, nj.kept, nj.written
    monkeypatch.setattr(nj, "kept", lambda df: tables.append(df.columns) or kept(df))
    monkeypatch.setattr(nj, "written", lambda df: tables.append(df.columns) or written(df))
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    monkeypatch.setattr(nj, "per_task", lambda df, *a: sent.append(df.agg(size("shingles"), size("packed"), F.max(F.octet_length("packed"))).first()) or per_task(df, *a))
    assert result(nj.near_duplicates(documents(spark, rows))) == brute(rows)
    assert not any({"cold", "hot", "shingle", "shingles"} & set(columns) for columns in tables)
    shingles, packed, longest = sent[0]
    assert 0 < shingles < 1000 and 0 < packed and longest < 2000


def test_names_rise_with_the_size_class():
    n = np.array([1, 2, 20, 21, 22, 500, 20_000, 10**6, 10**9])
    nodes = np.array([-1, 5, 7, -9, 0, 1 << 62, 3, 4, 2**63 - 1])
    names = nj.names_of(nodes, n)
    assert (np.diff(names) > 0).all()
    least, bare, ell = nj._told(names | 6 << nj.HASH_BITS)
    assert (bare == names).all() and (least <= n).all() and (ell <= np.maximum(1, n * 12 // 40)).all()
    assert (least[:4] == n[:4]).all() and (nj.MOST[nj.size_class(n)] >= n).all() and (nj.MOST[:-1] + 1 == nj.LEAST[1:]).all()


def test_counters_reach_the_driver_compressed(spark, monkeypatch):
    """The table of a few ids is small on its way to the driver, however many slots it has."""
    import pyspark.sql.classic.dataframe as classic

    from studyframe.llm.bits import Filter

    sizes, collect = [], classic.DataFrame.collect
    monkeypatch.setattr(classic.DataFrame, "collect", lambda self: [r for r in collect(self) if sizes.append(sum(len(x) for x in r if isinstance(x, (bytes, bytearray)))) or True])
    ids = spark.range(0, 3000, 7)
    found = Filter.of(ids)
    import pyarrow as pa

    assert found.has(pa.array(range(0, 3000, 7))).all() and not found.has(pa.array(range(1, 3000, 7))).all()
    assert 0 < sum(sizes) < 1_000_000


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    roots = roots_of(3000, edges)
    low = {}
    for i, r in enumerate(roots):
        low[r] = min(low.get(r, i), i)
    assert got == {i: low[roots[i]] for e in edges if e[0] != e[1] for i in e}


def test_components_of_bytes(spark):
    edges = spark.createDataFrame([(b"b", b"a"), (b"c", b"b"), (b"x", b"y"), (None, b"a")], "a binary, b binary")
    for few in (0, 100):
        assert {bytes(r["node"]): bytes(r["root"]) for r in connected(edges, few=few).collect()} == {b"a": b"a", b"b": b"a", b"c": b"a", b"x": b"x", b"y": b"x"}


def test_every_pair_is_due_once(spark):
    members = spark.range(60).selectExpr("id % 2 as comp", "id as node", "10 as weight")
    due = Counter()
    tasks = {}
    for r in tasks_of(members, 60, 70).collect():
        tasks.setdefault(r["task_key"], []).append((r["node"], r["part"]))
    for rows in tasks.values():
        across = len({p for _, p in rows}) > 1
        assert len(rows) * 10 <= 4 * 70 or not across
        due.update((a, b) for a, p in rows for b, q in rows if a < b and (p != q or not across))
    assert due == Counter((a, b) for a in range(60) for b in range(a + 1, 60) if (a - b) % 2 == 0)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bounded_edit_distance():
    random.seed(1)
    for _ in range(2000):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 12))) for _ in range(2))
        m = random.randint(0, 8)
        assert ld.distance_within(a, b, m) == (lev(a, b) <= m), (a, b, m)


def brute_lines(rows, spark):
    """Rows with their texts after removal, by all pairs of distinct lines."""
    import pyarrow as pa

    from studyframe.llm import textkernel as tk

    first, hashes = {}, {}
    named = {r["text"]: r["h"] for r in documents(spark, rows).selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted((((r[0] is not None, r[0] or 0), n, named[r[1]], line) for r in rows for n, line in enumerate((r[1] or "").split("\n"))), key=lambda x: x[:3])
    lines = [(i, (n, h), ld.normalise(line.encode())) for i, n, h, line in order if len(WORD.findall(line)) >= ld.LEAST_WORDS]
    distinct = list(dict.fromkeys(x for *_, x in lines))
    for line in distinct:
        for *_, data, bounds in tk.texts(pa.array([line.decode()])):
            hashes[line] = int(ld.Lines(data, bounds).simhash[0])
    links = [
        (i, j)
        for i, a in enumerate(distinct)
        for j, b in enumerate(distinct[:i])
        if (hashes[a] ^ hashes[b]).bit_count() <= ld.DISTANCE and 1 - lev(a.decode(), b.decode()) / max(len(a.decode()), len(b.decode())) >= ld.SIMILAR - 1e-12
    ]
    group = dict(zip(distinct, roots_of(len(distinct), links)))
    for i, n, line in lines:
        first.setdefault(group[line], (i, n))
    gone = {(i, n) for i, n, line in lines if first[group[line]] != (i, n)}
    out = Counter()
    for i, t, _ in rows:
        key = (i is not None, i or 0)
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (key, (n, named[t])) not in gone)
        out[i, kept] += 1
    return out, len(links)


def test_line_dedup_against_all_pairs(spark, docs, empty):
    random.seed(9)
    base = [" ".join("".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(random.randint(3, 30))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(random.randint(1, 5)):
            words = random.choice(base).split()
            for _ in range(random.choice((0, 0, 1, 1, 2))):
                k = random.randrange(len(words))
                words[k] = words[k][:-1] + random.choice("0x")
            lines.append(random.choice((" ", "  ")).join(words))
        rows.append((i, "\n".join([*lines, "short one", ""]), "s"))
    want, links = brute_lines(rows, spark)
    assert links > 5
    for chars in (ld.TASK_CHARS, 300):  # the latter cuts groups into parts
        gone = ld.removed_lines(documents(spark, rows), task_chars=chars)
        assert gone.count() > 0
    got = Counter((r["doc_id"], r["text"]) for r in ld.dedup_lines(documents(spark, rows)).collect())
    assert got == want
    short = [r for r in TEXTS if len(r[1] or "") < 10_000]
    assert Counter((r["doc_id"], r["text"]) for r in ld.dedup_lines(docs.where("text is null or length(text) < 10000")).collect()) == brute_lines(short, spark)[0]
    assert ld.dedup_lines(empty).count() == 0


def test_more_hashes_take_longer_keys():
    assert ld.block_count(10) == ld.DISTANCE + 2
    assert ld.block_count(10**9) > ld.block_count(10**6)


def test_lines_of_repeated_ids(spark):
    """Rows that share an id, or have none, keep their own lines; doubled rows share decisions; long lines count whole."""
    same, one, two = "the same line stands here twice", "unique words stand in this line", "nothing else is like these words"
    long = "x" * 12_000 + " and two more words"
    rows = [(3, same, "s"), (7, f"{same}\n{one}", "s"), (7, f"{two}\n{same}", "s"), (None, f"{one} but other\n{two}", "s"), (None, long, "s"), (None, "null ids are\nmany rows each", "s")]
    rows += [(8, f"{long}\na line of its own", "s")] * 2
    got = Counter((r["doc_id"], r["text"]) for r in ld.dedup_lines(clashing(documents(spark, rows))).collect())
    want = Counter({(3, same): 1, (7, one): 1, (7, ""): 1, (None, f"{one} but other\n{two}"): 1, (None, long): 1, (None, "null ids are\nmany rows each"): 1, (8, "a line of its own"): 2})
    assert got == want and got == brute_lines(rows, spark)[0]


def test_simhash_votes_of_short_and_long_lines():
    """Votes counted by byte lanes are those of the single bits; lines of 256 distinct words and more take the wide way."""
    import numpy as np

    from studyframe.llm import line_dedup, textkernel as tk

    assert line_dedup._LANES.view(np.uint8).reshape(256, 8).sum(axis=1).tolist() == [x.bit_count() for x in range(256)]
    rng = np.random.default_rng(3)
    for sizes in ((3, 40, 255, 7), (3, 256, 700, 5)):
        lines = [" ".join(f"w{x}" for x in rng.integers(0, 2 * n, n)) for n in sizes]
        lines[0] = "same same other"
        data = np.frombuffer("\n".join(lines).encode(), dtype=np.uint8)
        got = line_dedup.Lines(data, np.array([0, len(data)])).simhash
        for line, simhash in zip(lines, got.tolist()):
            own = np.frombuffer(line.encode(), dtype=np.uint8)
            words = set(tk.words_of(line_dedup._NORMAL[own], np.array([0, len(own)]), False).hashes.tolist())
            assert simhash == sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in words) > len(words))
